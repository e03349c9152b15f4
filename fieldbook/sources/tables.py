"""File sources and sinks: CSV and Parquet tables, dated forecast snapshots, the active forecast."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.operators.relational import require_columns
from fieldbook.session import materialise


class SourceError(RuntimeError):
    """A table that cannot be read, with its path in the message."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = True) -> DataFrame:
    """CSV with a header row. Strict reading fails on malformed rows instead of nulling them."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return _read(lambda: reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path), path)


@dataclass(frozen=True)
class CheckedRows:
    """The rows of a file that fit its schema, and the lines that do not, as (line)."""

    rows: DataFrame
    rejects: DataFrame
    rejected: int


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, *, most: int | None = None) -> CheckedRows:
    """CSV with a header row, damaged lines apart from the rest.

    Lines with too few or too many cells, or a cell of another type, are rejects; the file is parsed once. More than
    ``most`` of them (None: any number) are a ``SourceError`` that names the path, their number and one of them.
    """
    line = "_line"
    while line in schema.names:
        line += "_"
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(line, T.StringType())])).option("header", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line)
    parsed = materialise(_read(lambda: reader.csv(path), path))
    damaged = parsed.filter(F.col(line).isNotNull()).select(F.col(line).alias("line"))
    seen = damaged.agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")).first()
    if most is not None and seen["n"] > most:
        raise SourceError(f"{seen['n']} damaged lines in {path}, at most {most} are allowed, for example: {seen['first'][:200]}")
    return CheckedRows(parsed.filter(F.col(line).isNull()).drop(line), damaged, seen["n"])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table; asks for the named columns and says which are missing."""
    df = _read(lambda: spark.read.parquet(path), path)
    return require_columns(df, columns).select(*columns) if columns else df


def _read(load, path: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise SourceError(f"file not found: {path}") from error
        raise SourceError(f"error loading {path}: {error.getMessage() or error}") from error


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_snapshot(df: DataFrame, path: str, run_date: date | str | None = None) -> None:
    """Store a forecast under its run date; a rerun on the same day replaces that day only."""
    day = F.current_date() if run_date is None else F.lit(str(run_date)).cast("date")
    (
        df.withColumn("run_date", day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, run_date: date | str | None = None) -> DataFrame:
    """One dated forecast, by default the newest; files of other days are listed, but not opened."""
    if run_date is None:
        run_date = newest_day(spark, path)
    day = f"{path}/run_date={run_date}"
    return _read(lambda: spark.read.option("basePath", path).parquet(day), day).withColumn("run_date", F.col("run_date").cast("date"))


def newest_day(spark: SparkSession, path: str) -> str:
    """The last run date with a file, from the names of the folders alone."""
    files = _read(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path), path)
    day = files.select(F.regexp_extract("path", r"/run_date=(\d{4}-\d{2}-\d{2})/", 1).alias("day")).filter("day <> ''").agg(F.max("day")).first()[0]
    if day is None:
        raise SourceError(f"no dated forecast in {path}")
    return day


def write_active(df: DataFrame, path: str) -> None:
    """The forecast that reports read, replaced as a whole."""
    write_table(df, path)


def switch_active(df: DataFrame, path: str) -> None:
    """Write a forecast beside the active one, and then point to it: readers see the old one whole or the new one whole."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/version={version}")
    spark = df.sparkSession
    at = spark.createDataFrame([(version,)], "version string").withColumn("switched", F.current_timestamp())
    at.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def read_active(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The forecast that was switched to last."""
    pointer = read_table(spark, f"{path}/pointer")
    version = pointer.agg(F.max_by("version", F.struct("switched", "version"))).first()[0]
    return read_table(spark, f"{path}/version={version}", columns)


def preview(df: DataFrame, order: Sequence[Column | str], n: int = 5) -> DataFrame:
    """First rows in an explicit order."""
    return df.orderBy(*order).limit(n)
