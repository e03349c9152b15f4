"""What the n-gram join keeps on disk, and its comparisons tile by tile."""

import numpy as np
from pyspark.sql import functions as F

from fieldbook.llm import ngram_join


def texts(spark, copies):
    rng = np.random.default_rng(11)
    rows = []
    for group in range(60):
        words = [f"g{group}w{i}" for i in range(200)]
        for c in range(copies):
            other = list(words)
            other[int(rng.integers(200))] = f"x{group}c{c}"
            rows.append((len(rows), " ".join(other)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6, "doc_id")


def test_the_index_holds_fewer_values_than_there_are_tokens(spark, monkeypatch):
    docs, kept, write = texts(spark, 3), {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    got = ngram_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 3 * 3 for i in range(180)}
    index = kept["near-index"]
    arrays = [c for c, kind in index.dtypes if kind.startswith("array")]
    values = index.agg(*[F.sum(F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0))).alias(c) for c in arrays]).first()
    assert 0 < sum(max(0, v) for v in values) < sum(r["n_shingles"] for r in got) / 2


def test_slots_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_SLOT_BITS", 10)
    assert ngram_join.slot_bits(texts(spark, 1).limit(0)) == 10
    bits = [ngram_join.slot_bits(texts(spark, n)) for n in (2, 8)]
    assert bits[1] == bits[0] + 2
    # of documents that share nothing, few tokens stand in a slot that is shared by chance, though others fill their own
    docs = texts(spark, 4)
    table = ngram_join.class_table(docs, bits=ngram_join.slot_bits(docs))
    assert (table.classes(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)) == 0).mean() > 0.75


def test_pairs_that_may_link_by_their_profiles(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    rows, want = [], set()
    for i in range(120):
        n, m = int(rng.integers(20, 400)), int(rng.integers(20, 400))
        a = pool[:n]
        b = np.concatenate([a[: int(min(n, m) * rng.random() ** 0.2)], pool[500 : 500 + m]])[:m]
        p, q = ngram_join.profile_of(a), ngram_join.profile_of(b)
        cells = sum((int(x) & (1 << 64) - 1 & int(y)).bit_count() for x, y in zip(p[:-1], q[:-1])) + min(int(p[-1]), int(q[-1]))
        if 7 * min(n, m) >= 3 * (n + m) and 7 * cells >= 3 * (n + m):
            want.add((i, -i))
        rows.append((i, -i, n, m, 0, 0, p.tolist(), q.tolist()))
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, n bigint, m bigint, lone bigint, lone_b bigint, profile array<bigint>, profile_b array<bigint>")
    assert 10 < len(want) < 110
    assert {tuple(r) for r in pairs.where(ngram_join.may_link()).select("a", "b").collect()} == want


def test_tiles_compare_every_pair(spark):
    rng = np.random.default_rng(4)
    sets = {c: sorted(rng.choice(14, int(rng.integers(8, 14)), replace=False).tolist()) for c in range(50)}
    table = spark.createDataFrame(list(sets.items()), "cls bigint, tokens array<bigint>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a bigint, b bigint")
    near = {(a, b) for a in sets for b in sets if a < b and 4 * len({*sets[a]} & {*sets[b]}) >= 3 * len({*sets[a]} | {*sets[b]})}
    assert near and {tuple(r) for r in ngram_join.verified(pairs, table).collect()} == near
    assert ngram_join.verified(pairs.limit(0), table).collect() == []
