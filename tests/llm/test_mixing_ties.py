"""Mixing where many rows share one id, and where columns have the names of the plan."""

import pytest
from pyspark.sql import functions as F

from fieldbook.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint"


def taken_by_source(got):
    rows = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    return {r["source"]: (r["taken"], r["target"], r["size"]) for r in rows}


@pytest.mark.parametrize("ids,texts", [("null", "equal"), ("few", "own")])
def test_targets_are_met_whatever_the_ids(spark, ids, texts):
    key = {"null": F.lit(None).cast("bigint"), "one": F.lit(7).cast("bigint"), "few": F.col("id") % 3}[ids]
    text = F.lit("one two three") if texts == "equal" else F.concat(F.lit("one two "), F.col("id").cast("string"))
    rows = spark.range(6000).select(key.alias("doc_id"), text.alias("text"), F.when(F.col("id") < 1000, "b").otherwise("a").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    rows = rows.unionByName(spark.createDataFrame([(None, "", "a", 0), (None, None, None, None), (3, "x y", None, 3)], SCHEMA)).repartition(5)
    got = mixing.mix(rows)
    assert got.count() == 6003 and got.where("taken > 3 * size OR taken < 0").isEmpty()
    for taken, target, _ in taken_by_source(got).values():
        assert abs(taken - target) <= 3
    again = [sorted((tuple(r) for r in x.collect()), key=str) for x in (got, mixing.mix(rows.repartition(3)))]
    assert again[0] == again[1]
    kept = mixing.mixed_documents(rows)
    assert sum(r["taken"] for r in kept.collect()) == sum(r["taken"] for r in got.collect())


def test_columns_with_the_names_of_the_plan(spark):
    names = ["part", "of", "threshold", "passes", "size", "target", "taken", "source_size", "place", "row", "more", "text_", "_mix", "_mixplan", "_mixcut"]
    rows = spark.range(500).select(
        "id", F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
        *[F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in names],
    )
    got = mixing.mixed_documents(rows)
    assert got.columns == ["id", "doc_id", "text", "source", "part", "of", "threshold", "passes", "place", "row", "more", "text_", "_mix", "_mixplan", "_mixcut", "size", "source_size", "target", "taken"]
    assert all(r["part"] == f"part{r['id']}" and r["size"] == 2 and r["_mix"] == f"_mix{r['id']}" for r in got.collect())
    for taken, target, _ in taken_by_source(got).values():
        assert abs(taken - target) <= 2
    assert mixing.mixed_documents(rows.limit(0)).collect() == []
    assert mixing.mix(spark.createDataFrame([(1,)], "other int")).collect()[0]["taken"] == 0
