"""Language identification by mixture inference.

A text is a sequence of units of 24 byte trigrams. Each language gives a unit a likelihood from its trigram
frequencies, and the text's language proportions are estimated by expectation-maximisation over the units, until no
proportion moves by more than ``TOLERANCE`` a round. Sets of the one, two, ... most probable languages are compared by
likelihood less half the logarithm of the number of units for each further language, as long as the likelihood of all
languages together could pay for one more; the best set's largest proportion names the language and is the score, and the set
is a result, too. Of equal proportions the language first by name counts.

Trigrams are counted over at most about ``FIT_DOCS`` documents of each language (all below a threshold of the hash of
doc_id); every text is predicted whole. A text that is null or has no letter is ``und`` with score 0, and so is every
text if there is nothing to learn from. A text of fewer than three bytes gets the most frequent language with its share.
Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.storage import crc32_of_id, documents_only
from fieldbook.llm.text import text_slices

FIT_DOCS, UNIT, SLOTS = 2_000, 24, 1 << 16
TOLERANCE = 1e-3
#: Languages that can be learnt: each is a dense row of SLOTS numbers in every task. More are refused, never cut.
MOST_NAMES = 1000
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Slot of the trigram that begins at each byte; SLOTS where a text ends before it does."""
    c = _FOLD[data]
    if len(c) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        c[1:][upper] += 0x20
    out = np.full(len(c), SLOTS, dtype=np.int32)
    if len(c) > 2:
        h = c[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + c[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77) + c[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D)
        out[:-2] = (h ^ (h >> np.uint32(15))) >> np.uint32(5) & np.uint32(SLOTS - 1)
        for back in (1, 2):
            last = offsets[1:] - back
            out[last[last >= offsets[:-1]]] = SLOTS
    return out


@dataclass
class Languages:
    """Names in order, their shares, and centred log-likelihoods of the trigram slots (one row more for no trigram)."""

    names: list[str]
    shares: np.ndarray
    table: np.ndarray

    def unit_values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of all units by language, and the offsets of the texts' units."""
        sizes = np.diff(offsets)
        counts = np.where(sizes > 2, -(-(sizes - 2) // UNIT), 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if bounds[-1] == 0:
            return np.zeros((0, len(self.names)), dtype=np.float32), bounds
        begins = np.repeat(offsets[:-1], counts) + UNIT * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts))
        # a unit also sums what lies between its text and the next one: slots without trigram, all 0
        slots = trigrams(data, offsets)
        return np.add.reduceat(self.table[slots], begins, axis=0), bounds

    def infer(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language and its proportion in each text, and the proportions of the chosen set (0 outside it)."""
        values, bounds = self.unit_values(data, offsets)
        counts, rows, n = np.diff(bounds), len(offsets) - 1, len(self.names)
        best, score = np.full(rows, int(np.argmax(self.shares))), np.full(rows, float(self.shares.max()))
        mixture = np.zeros((rows, n), dtype=np.float32)
        mixture[np.arange(rows), best] = 1.0
        some = np.flatnonzero(counts)
        if not len(some):
            return best, score, mixture
        at, size = bounds[:-1][some], counts[some]
        top = values.max(axis=1, keepdims=True)
        likely = np.exp(values - top)
        base = np.add.reduceat(top.ravel().astype(np.float64), at)
        share, fit = proportions(likely, size, np.ones((len(some), n), dtype=np.float32))
        single = np.add.reduceat(values.astype(np.float64), at, axis=0)
        first = np.argmax(single + np.log(self.shares + 1e-9), axis=1)
        chosen, proportion = first.copy(), np.ones(len(some))
        sets = np.zeros((len(some), n), dtype=np.float32)
        sets[np.arange(len(some)), first] = 1.0
        reached, price = single[np.arange(len(some)), first] - base, 0.5 * np.log(size + 1)
        ranked = np.argsort(-share, axis=1, kind="stable")
        for k in range(2, n + 1):
            # the fit of all languages is the most that a set can reach
            open_ = np.flatnonzero(fit - (k - 1) * price > reached)
            if not len(open_):
                break
            lines = np.concatenate([np.arange(at[i], at[i] + size[i]) for i in open_])
            allowed = np.zeros((len(open_), n), dtype=np.float32)
            np.put_along_axis(allowed, ranked[open_, :k], 1.0, axis=1)
            got, value = proportions(likely[lines], size[open_], allowed)
            value = value - (k - 1) * price[open_]
            better = value > reached[open_]
            rows_ = open_[better]
            reached[rows_], sets[rows_] = value[better], got[better]
            chosen[rows_], proportion[rows_] = np.argmax(got[better], axis=1), got[better].max(axis=1)
        best[some], score[some], mixture[some] = chosen, np.clip(proportion, 0.0, 1.0), sets
        return best, score, mixture


def proportions(likely: np.ndarray, size: np.ndarray, allowed: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text and their log-likelihood; ``likely`` has ``size`` rows of each text."""
    share = allowed.astype(np.float64) / allowed.sum(axis=1, keepdims=True)  # in single precision small steps would not end
    open_, lines, sizes = np.arange(len(size)), likely, size
    while len(open_):
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        part = lines * np.repeat(share[open_], sizes, axis=0)
        new = np.add.reduceat(part / np.maximum(part.sum(axis=1, keepdims=True), 1e-30), at, axis=0) / sizes[:, None]
        moved = np.abs(new - share[open_]).max(axis=1) > tolerance
        share[open_] = new
        if not moved.all():
            lines, open_, sizes = lines[np.repeat(moved, sizes)], open_[moved], sizes[moved]
    total = np.maximum((likely * np.repeat(share, size, axis=0)).sum(axis=1), 1e-30)
    return share, np.add.reduceat(np.log(total).astype(np.float64), np.concatenate([[0], np.cumsum(size)[:-1]]))


def learn(docs: DataFrame, most: int = FIT_DOCS) -> Languages:
    """Trigram likelihoods from documents with a language whose crc32 leaves another remainder than 1 when divided by 3."""
    given = documents_only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.coalesce(crc32_of_id(F.col("doc_id")) % 3 != 1, F.lit(True)))
    sizes = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_NAMES + 1).collect()}
    if len(sizes) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} values of lang: put them in order first")
    names = sorted(sizes)
    if not names:
        return Languages([], np.zeros(0), np.zeros((SLOTS + 1, 0), dtype=np.float32))
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    limit = F.lit(0)
    for name in names:
        limit = F.when(F.col("lang") == name, int(min(1.0, most / sizes[name]) * 1_000_000)).otherwise(limit)
    number = {name: i for i, name in enumerate(names)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            langs = np.array([number[v] for v in batch.column(1).to_pylist()], dtype=np.int64)
            for first, _, data, offsets in text_slices(batch.column(0)):
                slots = trigrams(data, offsets)
                of = np.repeat(langs[first : first + len(offsets) - 1], np.diff(offsets))
                real = slots < SLOTS
                seen, n = np.unique(of[real] * SLOTS + slots[real], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, seen]), return_inverse=True)  # as many as are there, not a dense table
                totals = np.bincount(at, weights=np.concatenate([totals, n])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys // SLOTS, pa.int32()), pa.array(keys % SLOTS, pa.int32()), pa.array(totals)], names=["lang", "slot", "n"])

    counts = given.where(place < limit).select("text", "lang").mapInArrow(counted, "lang int, slot int, n bigint")
    rows = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows for each language
    table = np.full((len(names), SLOTS), 0.1)
    table[rows["lang"].to_numpy(), rows["slot"].to_numpy()] += rows["n"].to_numpy()
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    logs = (logs - logs.mean(axis=0)).T.astype(np.float32) * np.float32(0.5)  # overlapping trigrams count half
    shares = np.array([sizes[n] for n in names], dtype=float)
    return Languages(names, shares / shares.sum(), np.vstack([logs, np.zeros((1, len(names)), dtype=np.float32)]))


def shown(names: list[str], shares: np.ndarray) -> str:
    """The languages of a set with their proportions, largest first."""
    held = [i for i in np.argsort(-shares, kind="stable").tolist() if shares[i] > 0.0005]
    return ", ".join(f"{names[i]} {shares[i]:.3f}" for i in held)


def predicted(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and languages (name and proportion of each of the chosen set, largest first) of every document."""
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    given = documents_only(docs, "doc_id", "text").select("doc_id", "text", held.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column(1)):
                letters = batch.column(3).slice(first, stop - first).to_numpy(zero_copy_only=False)
                if known.names:
                    number, score, mixture = known.infer(data, offsets)
                    names = [known.names[k] if ok else "und" for k, ok in zip(number.tolist(), letters.tolist())]
                    score = np.where(letters, score, 0.0)
                    sets = [shown(known.names, row) if ok else "" for row, ok in zip(mixture, letters.tolist())]
                else:
                    names, score, sets = ["und"] * len(letters), np.zeros(len(letters)), [""] * len(letters)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), batch.column(2).slice(first, stop - first), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return given.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, languages string")
