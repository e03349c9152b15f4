"""A training corpus from documents: good, single, clean of benchmarks and personal data, mixed by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import decontaminate, mixing, ngram_join, pii, quality
from fieldbook.llm.storage import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, with all their columns.

    Null and empty texts are judged as a text without words; repeated rows alike, also under a null id; the labels' null ids
    teach nothing. An empty table stays empty; columns of other names pass through.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Null and empty texts are near nothing and stay; of rows that share the least id all stay, as do rows with a null id. An
    empty table stays empty; columns of other names pass through.
    """
    return ngram_join.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage.

    Null and empty texts hold none and stay; an id leaves with all its rows; rows with a null id stay. An empty table or
    benchmark drops nothing; columns of other names pass through.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind.

    Null and empty texts stay as they are; every row is masked on its own, so nulls and repeated rows of other columns do not
    matter. An empty table stays empty; columns of other names pass through.
    """
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words, repeats counted.

    Null and empty texts have no words and are not taken; a null source is one of its own; equal rows are taken as often as
    the target needs. An empty table stays empty; columns of other names pass through, but for the four that are added.
    """
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]
#: The first stage is a trained classifier, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
