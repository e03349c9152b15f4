"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words under a fixed mask; the mask ignores the other positions, so that a seed survives
substituted words there. The seeds of all benchmark items fill a table of fixed size. Each document's seeds are looked
up in it; the few that pass are joined with the benchmark's seeds by Spark. Around each hit the item is laid against the
document and all its matching stretches are taken, substitutions costing ``MISMATCH`` matches. Stretches on one diagonal
and on neighbouring ones (words left out or added) count together. A document leaks an item when ``MATCHED`` of the
item's words match, or ``SHARE`` of a shorter item.

Items of fewer than ``SPAN`` words have one more seed, of all their words, and are found where they stand as they are,
however short; ``item_words`` tells them apart. Null and empty items are never found. Null and empty texts leak nothing.
Items are told apart by id and words, so that ids may be null or repeat. Repeated rows give one row for a document and
an item; documents with a null doc_id are reported under null. Empty tables give no rows, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.sketch import both_slots, present
from fieldbook.llm.storage import documents_only, written
from fieldbook.llm.text import mix, text_slices, words_of

#: Word positions that a mask looks at: weight 6, spans of 9 and 10 words.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 4, 5, 6, 8), (0, 2, 3, 5, 8, 9), (0, 3, 4, 6, 7, 9))
SPAN = 10
MATCHED, SHARE, LEAST_STRETCH, MISMATCH, NEAR = 12, 0.7, 6, 2, 8
_MULTIPLIERS = np.random.RandomState(30).randint(1, 2**62, size=(len(MASKS), 6), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WHOLE = np.random.RandomState(31).randint(1, 2**62, size=SPAN, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _seeds(h: np.ndarray, places: tuple[int, ...] | range, multipliers: np.ndarray, start: int) -> np.ndarray:
    n = max(0, len(h) - places[-1])
    total = np.full(n, start, dtype=np.uint64)
    for place, by in zip(places, multipliers):
        total += h[place : place + n] * by
    return mix(total)


def seeds_of(h: np.ndarray, k: int) -> np.ndarray:
    """Seeds of mask k at each position where the mask fits."""
    return _seeds(h, MASKS[k], _MULTIPLIERS[k], k)


def whole_seeds(h: np.ndarray, n_words: int) -> np.ndarray:
    """Seeds of all of ``n_words`` words in a row, at each position."""
    return _seeds(h, range(n_words), _WHOLE, len(MASKS) + n_words)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, its words' hashes, its seeds and their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(1)):
                w = words_of(data, offsets)
                for i in np.flatnonzero(w.counts > 0).tolist():
                    h = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    found = [seeds_of(h, k) for k in range(len(MASKS))] + ([whole_seeds(h, len(h))] if len(h) < SPAN else [])
                    places = np.concatenate([np.arange(len(s)) for s in found])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first + i, 1), _lists([h.view(np.int64)], pa.int64()), _lists([np.concatenate(found).view(np.int64)], pa.int64()), _lists([places], pa.int32())],
                        names=["item_id", "item_words", "seeds", "places"],
                    )

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id bigint, item_words array<bigint>, seeds array<bigint>, places array<int>")


def hit_documents(docs: DataFrame, shared: Broadcast[np.ndarray], short: list[int]) -> DataFrame:
    """Documents with seeds that pass the table: doc_id, word hashes, the seeds and their positions; ``short`` are lengths of short items."""
    looked = [(MASKS[k][-1], seeds_of, k) for k in range(len(MASKS))] + [(n - 1, whole_seeds, n) for n in short]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(1)):
                w = words_of(data, offsets)
                rows, seeds, places = [], [], []
                for last, of, k in looked:
                    s = of(w.hashes, k)
                    one, two = both_slots(s)
                    at = np.flatnonzero(known[one])
                    at = at[known[two[at]] == 1]
                    row = np.searchsorted(w.bounds, at, side="right") - 1
                    inside = at + last < w.bounds[row + 1]
                    rows.append(row[inside]), seeds.append(s[at[inside]]), places.append(at[inside])
                row, seed, place = np.concatenate(rows), np.concatenate(seeds).view(np.int64), np.concatenate(places)
                order = np.argsort(row, kind="stable")
                row, seed, place = row[order], seed[order], place[order]
                some, begin = np.unique(row, return_index=True)
                if not len(some):
                    continue
                parts = np.append(begin, len(row)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(some + first)),
                        _lists([w.hashes[w.bounds[i] : w.bounds[i + 1]].view(np.int64) for i in some.tolist()], pa.int64()),
                        _lists([seed[a:b] for a, b in zip(parts[:-1], parts[1:])], pa.int64()),
                        _lists([place[a:b] - w.bounds[i] for i, a, b in zip(some.tolist(), parts[:-1], parts[1:])], pa.int32()),
                    ],
                    names=["doc_id", "words", "seeds", "places"],
                )

    return documents_only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, words array<bigint>, seeds array<bigint>, places array<int>")


def stretches_of(same: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of all maximal stretches by matches less MISMATCH times the mismatches, in order.

    The best stretch, then the best ones left and right of it, and so on, found in one pass over the runs of matches.
    """
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    found: list[tuple[int, int, int, int]] = []  # begin, end, worth before the begin and up to the end
    worth = at = 0
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        before = worth - MISMATCH * (begin - at)
        worth, at, low = before + end - begin, end, before
        while True:
            j = next((j for j in range(len(found) - 1, -1, -1) if found[j][2] < low), None)
            if j is None or found[j][3] >= worth:
                found.append((begin, end, low, worth))
                break
            begin, low = found[j][0], found[j][2]
            del found[j:]
    return [f[:2] for f in found]


def overlap(words: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int] | None:
    """Matched words of the item and the document's first matched word; None if too few match."""
    stretches = []
    for shift in sorted(shifts):
        low, high = max(0, -shift), min(len(item), len(words) - shift)
        same = words[low + shift : high + shift] == item[low:high]
        for a, b in stretches_of(same):
            if same[a:b].sum() >= min(LEAST_STRETCH, len(item)):
                stretches.append((shift, low + a, np.flatnonzero(same[a:b]) + low + a))
    need, best = min(MATCHED, int(np.ceil(SHARE * len(item)))), None
    for i, (shift, _, _) in enumerate(stretches):
        if i and stretches[i - 1][0] == shift:
            continue
        group = [s for s in stretches[i:] if s[0] - shift <= NEAR]
        matched = len(np.unique(np.concatenate([s[2] for s in group])))
        if matched >= need and (best is None or matched > best[0]):
            best = (matched, min(s[0] + s[1] for s in group))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, matched (words of the item), first_word (place in the document)."""
    items = written(benchmark_seeds(benchmark).withColumn("item", F.xxhash64("item_id", "item_words")).dropDuplicates(["item"]), "leak-items")
    short = sorted(r["n"] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # SPAN - 1 lengths
    seeds = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_place"))
    known = docs.sparkSession.sparkContext.broadcast(present(seeds, "seed"))
    found = hit_documents(docs, known, short).withColumn("key", F.xxhash64("doc_id", "words"))
    found = written(found, "leak-hits")
    known.destroy()  # the hits are a table now: nothing computes them again
    hits = found.select("key", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("key", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    laid = hits.join(seeds, "seed").groupBy("key", "item").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"))
    texts = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"))
    pairs = laid.join(texts, "key").join(items.select("item", "item_id", "item_words"), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item, shifts = (batch.column(batch.schema.get_field_index(n)) for n in ("words", "item_words", "shifts"))
            kept = []
            for i in range(batch.num_rows):
                w, t = doc[i].values.to_numpy(), item[i].values.to_numpy()
                if got := overlap(w, t, shifts[i].values.to_pylist()):
                    kept.append((i, len(t), *got))
            at = pa.array([k[0] for k in kept], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).take(at), batch.column(batch.schema.get_field_index("item_id")).take(at), *(pa.array([k[c] for k in kept], pa.int64()) for c in (1, 2, 3))],
                names=["doc_id", "item_id", "item_words", "matched", "first_word"],
            )

    out = pairs.select("doc_id", "item_id", "words", "item_words", "shifts").mapInArrow(run, "doc_id bigint, item_id bigint, item_words bigint, matched bigint, first_word bigint")
    best = out.groupBy("doc_id", "item_id", "item_words").agg(F.max(F.struct("matched", (-F.col("first_word")).alias("at"))).alias("b"))
    return best.select("doc_id", "item_id", "item_words", F.col("b.matched").alias("matched"), (-F.col("b.at")).alias("first_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item. Rows without a doc_id cannot be told apart and stay."""
    found = written(leaks(docs, benchmark).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    return docs.join(found, docs["doc_id"] == found["leaked"], "left_anti")
