"""Tables between the jobs of an operator, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that has none gets one of its own, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fieldbook-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it has no lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of an id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def documents_only(docs: DataFrame, *wanted: str) -> DataFrame:
    """Columns by name; one that is missing is null, one that is ambiguous is an error of the caller."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(*(F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in wanted))
