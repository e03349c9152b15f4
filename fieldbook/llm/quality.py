"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a normal density over the statistics of a text. Its covariance is the class's own, shrunk towards the
pooled one and towards a diagonal, and kept as a Cholesky factor. A score is the logistic function of the difference of
the log densities (half the difference of the squared Mahalanobis distances and log determinants) plus the log prior.

Null and empty texts have the statistics of an empty text and get a score. Repeated rows
give repeated results, extra columns are ignored, and an empty table gives no rows. Without labels of both classes
the model scores every text with the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.storage import crc32_of_id, documents_only
from fieldbook.llm.text import Words, distinct_rows, row_sums, shingles_of, text_slices, words_of

#: Labelled rows that a fit uses at most, taken by the hash of their id.
FIT_ROWS = 20_000
STATISTICS = [
    "words", "word_length", "long_words", "upper", "digits", "sentence_marks", "shouting", "symbols", "bars", "lines",
    "distinct_words", "repeated_words", "distinct_shingles", "spaces", "other_bytes",
]


def _flags(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(characters)] = 1
    return table


_UPPER, _DIGIT, _MARK, _SHOUT = _flags(bytes(range(65, 91))), _flags(b"0123456789"), _flags(b".,;:?"), _flags(b"!")
_SYMBOL, _BAR, _LINE, _SPACE = _flags(b"#$%&*@^~=<>{}[]\\_`"), _flags(b"|"), _flags(b"\n"), _flags(b" \t")
_TAIL, _HIGH = _flags(bytes(range(128, 192))), _flags(bytes(range(194, 256)))


def statistics(words: Words) -> np.ndarray:
    """A row of transformed statistics for each text."""
    data, offsets, counts = words.data, words.offsets, words.counts
    by = {k: row_sums(t[data], offsets) for k, t in dict(upper=_UPPER, digit=_DIGIT, mark=_MARK, shout=_SHOUT, symbol=_SYMBOL, bar=_BAR, line=_LINE, space=_SPACE, tail=_TAIL, high=_HIGH).items()}
    chars = np.maximum(np.diff(offsets) - by["tail"], 1)
    n = np.maximum(counts, 1)
    lengths = words.ends - words.starts
    _, distinct = distinct_rows(words.hashes, words.bounds)
    runs, places = shingles_of(words, 3)
    _, different = distinct_rows(runs, places)
    same = np.zeros(len(words.hashes), dtype=np.int64)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.bounds[:-1][words.bounds[:-1] < len(same)]] = 0
    root = np.sqrt
    return np.column_stack([
        np.log1p(counts), np.log1p(row_sums(lengths, words.bounds) / n), root(row_sums((lengths > 12).astype(np.int64), words.bounds) / n),
        root(by["upper"] / chars), root(by["digit"] / chars), root(by["mark"] / n), root(np.minimum(by["shout"] / n, 2)),
        root(np.minimum(by["symbol"] / n, 5)), root(np.minimum(by["bar"] / n, 2)), root(by["line"] / n),
        root(np.diff(distinct) / n), root(row_sums(same, words.bounds) / n), root(np.diff(different) / np.maximum(np.diff(places), 1)),
        root(by["space"] / chars), root(by["high"] / chars),
    ])


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the inverse-scaled covariances, and the constant of the log-density difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        distance = [(np.linalg.solve(self.factors[k], (z - self.means[k]).T) ** 2).sum(axis=0) for k in (0, 1)]
        difference = 0.5 * (distance[0] - distance[1]) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(difference, -700, 700)))


def fit(x: np.ndarray, labels: np.ndarray, pool: float = 0.1, diagonal: float = 0.05) -> Discriminant:
    """``pool`` is the weight of the pooled covariance, ``diagonal`` that of the scaled identity."""
    d = x.shape[1]
    centre, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(d), np.ones(d))
    z, sizes = (x - centre) / scale, np.array([(labels == k).sum() for k in (0, 1)])
    if sizes.min() < 2:
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return Discriminant(centre, scale, np.zeros((2, d)), np.stack([np.eye(d)] * 2), float(np.log(share / (1 - share))))
    means = np.stack([z[labels == k].mean(axis=0) for k in (0, 1)])
    scatter = [(z[labels == k] - means[k]).T @ (z[labels == k] - means[k]) for k in (0, 1)]
    pooled, factors, logs = sum(scatter) / sizes.sum(), [], []
    for k in (0, 1):
        own = (1 - pool) * scatter[k] / sizes[k] + pool * pooled
        own = (1 - diagonal) * own + diagonal * np.trace(own) / d * np.eye(d)
        factors.append(np.linalg.cholesky(own + 1e-9 * np.eye(d)))
        logs.append(np.log(np.diag(factors[k])).sum())
    return Discriminant(centre, scale, means, np.stack(factors), float(logs[0] - logs[1] + np.log(sizes[1] / sizes[0])))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and an array of the statistics."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column(1)):
                x = statistics(words_of(data, offsets))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), rows], names=["doc_id", "statistics"])

    return documents_only(docs, "doc_id", "text").mapInArrow(measured, "doc_id bigint, statistics array<double>")


def labelled_rows(labels: DataFrame, value: str, held_out: F.Column, rows: int) -> DataFrame:
    """doc_id and label of at most ``rows`` labelled rows that are not held out, the same ones in each run."""
    known = labels.where(F.col(value).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(value).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Discriminant:
    """Fit on labelled documents whose crc32 leaves another remainder than 1 when divided by 3."""
    chosen = labelled_rows(labels, "quality", crc32_of_id(F.col("doc_id")) % 3 == 1, rows)
    texts = documents_only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = with_statistics(texts).join(F.broadcast(chosen), "doc_id").select("label", "statistics").toArrow()
    x = sample["statistics"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return fit(x, sample["label"].to_numpy())


def quality_scores(docs: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column(1)):
                s = model.scores(statistics(words_of(data, offsets)))
                rest = [batch.column(i).slice(first, stop - first) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    given = documents_only(docs, "doc_id", "text").withColumn("held_out", F.coalesce(crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False)))
    return given.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    at, names = docs.columns.index("text"), docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column(at)):
                good = model.scores(statistics(words_of(data, offsets))) >= threshold
                yield pa.RecordBatch.from_arrays(batch.slice(first, stop - first).columns, names=names).filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)

