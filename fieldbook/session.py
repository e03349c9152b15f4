"""Session settings for local work, and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A small session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldbook")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all nodes see, named by the cluster; a temporary one only on a single machine."""
    known = spark.conf.get(CHECKPOINT_SETTING, None)
    if known is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that all nodes share")
        known = tempfile.mkdtemp(prefix="fieldbook-")
        spark.conf.set(CHECKPOINT_SETTING, known)
    return known


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used where a frame feeds several scans (model folds, sampled cut points). Losing an executor then
    re-reads files instead of recomputing the lineage, and each scan reads only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
