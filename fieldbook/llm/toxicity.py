"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums over all subsequences of three letters that span at most ``SPAN`` letters, each weighted by
``DECAY`` to the power of its span, so that letters left out or put in between weaken a match and do not undo it. Letters
are folded first: case goes, digits read as the letters they stand for, other characters of ASCII are dropped, a letter beyond
it stands for itself, as its bytes, and runs of three or more single letters are one word ("i d i o t").

A sentence is as toxic as its worst word, and a document's label holds for one of its sentences at least. Training
alternates: of the toxic documents without a positive sentence, the words that are more frequent than in clean documents
become positive examples; words of clean documents (the worst of them always) are the negative ones. Words are mapped by their kernel with the landmarks, whitened (Nystroem), and a
linear machine with squared hinge loss is fitted by Newton's method. Since the decision is linear in the landmarks'
subsequences, they are summed into one table of weights, and a word costs its subsequences, not its landmarks.

A document's probability is a logistic function of its worst word, its words beyond the margin, and its length, fitted on
the same documents. At most ``FIT_ROWS`` labelled documents of each label are fitted on, taken by the hash of doc_id.
Null and empty texts get the score of a text without words. Without labels of both kinds every score is the share of
label 1, or 0. Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.quality import labelled_rows
from fieldbook.llm.storage import crc32_of_id, documents_only
from fieldbook.llm.text import mix, powers, text_slices, words_of

FIT_ROWS, LANDMARKS, ROUNDS = 1_500, 240, 6
#: Standard deviations by which a positive example's word must be more frequent in toxic documents.
LEAST_SURPLUS = 1.6
#: Times that it is more frequent there; words of a language that toxic documents favour stay below.
LEAST_RATIO = 12
SPAN, DECAY, LETTERS = 6, 0.6, 64
#: Distances between the letters of a subsequence.
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
NO_WORD = -1.0
_FOLD = np.zeros(256, dtype=np.int64)
_FOLD[97:123] = _FOLD[65:91] = np.arange(1, 27)
for _digit, _letter in zip(b"0134578", b"oieastb"):
    _FOLD[_digit] = _letter - 96
for _i, _digit in enumerate(b"269"):
    _FOLD[_digit] = 27 + _i
_FOLD[128:192] = 31 + (np.arange(128, 192) & 31)
_FOLD_VALUE = np.random.RandomState(40).randint(1, 2**62, size=LETTERS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?")] = True


@dataclass
class Folded:
    """Letters of all words one after another, the words' bounds in them, their row and their sentence."""

    letters: np.ndarray
    bounds: np.ndarray
    row: np.ndarray
    sentence: np.ndarray


def folded(data: np.ndarray, offsets: np.ndarray) -> Folded:
    w = words_of(data, offsets, hashed=False)
    if not len(w.starts):
        none = np.zeros(0, dtype=np.int64)
        return Folded(none, np.zeros(1, dtype=np.int64), none, none)
    code = _FOLD[data]
    kept = np.concatenate([[0], np.cumsum(code > 0)])
    size = kept[w.ends] - kept[w.starts]
    row = np.repeat(np.arange(len(offsets) - 1), w.counts)
    line = np.concatenate([[0], np.cumsum(data == 10)])[w.starts]
    closes = _ENDS[data[w.ends - 1]]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = closes[:-1] | (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(fresh) - 1
    # a run of three or more single letters in a row is one word
    single = size == 1
    breaks = np.ones(len(row), dtype=bool)
    breaks[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    run = np.cumsum(breaks) - 1
    long = np.bincount(run)[run] >= 3
    begins = breaks | ~long
    begins &= size > 0
    first = np.flatnonzero(begins)
    return Folded(code[code > 0], np.append(kept[w.starts[first]], kept[-1]), row[first], sentence[first])


def distinct_words(f: Folded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and bounds of the distinct words, and each word's number among them."""
    sizes = np.diff(f.bounds)
    place = np.arange(len(f.letters)) - np.repeat(f.bounds[:-1], sizes)
    value = _FOLD_VALUE[f.letters] * powers(int(sizes.max()) + 1)[place]
    _, at, number = np.unique(mix(np.add.reduceat(value, f.bounds[:-1]) + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
    lengths = sizes[at]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    lines = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - f.bounds[at], lengths)
    return f.letters[lines], bounds, number


def norms(lengths: np.ndarray) -> np.ndarray:
    """Square root of the summed squared weights of a word's subsequences."""
    total = sum(np.maximum(lengths - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in GAPS)
    return np.sqrt(np.maximum(total, 1e-12))


def subsequences(letters: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, subsequence numbers, weight) for each pair of distances; a place is that of the first letter."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(letters))
    for a, b in GAPS:
        at = np.flatnonzero(place + a + b < end)
        yield at, (letters[at] * LETTERS + letters[at + a]) * LETTERS + letters[at + a + b], DECAY ** (a + b + 1)


def word_values(letters: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weights of each word's subsequences, summed and normalised; NO_WORD for words of fewer than three letters."""
    value = np.zeros(len(letters), dtype=np.float32)
    for at, number, weight in subsequences(letters, bounds):
        value[at] += table[number] * np.float32(weight)
    lengths = np.diff(bounds)
    sums = np.add.reduceat(value, bounds[:-1]) if len(lengths) else np.zeros(0, dtype=np.float32)
    return np.where(lengths > 2, sums / norms(lengths), np.float32(NO_WORD))


def pack(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return (np.concatenate(words) if words else np.zeros(0)).astype(np.int64), bounds


def kernels(words: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Normalised kernel of each word with each landmark."""
    letters, bounds = pack(landmarks)
    of = np.repeat(np.arange(len(landmarks)), np.diff(bounds))
    scale = 1.0 / norms(np.diff(bounds))
    found = [(number, of[at], weight) for at, number, weight in subsequences(letters, bounds)]
    numbers = np.unique(np.concatenate([n for n, _, _ in found]))
    rows = np.zeros((len(numbers) + 1, len(landmarks)), dtype=np.float32)
    for number, who, weight in found:
        np.add.at(rows, (np.searchsorted(numbers, number), who), weight * scale[who])
    place = np.full(LETTERS**3, len(numbers), dtype=np.int32)
    place[numbers] = np.arange(len(numbers))
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for first in range(0, len(words), 1000):
        letters, bounds = pack(words[first : first + 1000])
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        block = out[first : first + 1000]
        for at, number, weight in subsequences(letters, bounds):
            hit = place[number] < len(numbers)
            at, which = at[hit], place[number[hit]]
            if len(at):
                who, begin = np.unique(of[at], return_index=True)
                block[who] += np.add.reduceat(rows[which] * np.float32(weight), begin, axis=0)
        block /= norms(np.diff(bounds))[:, None]
    return out


def linear_machine(x: np.ndarray, y: np.ndarray, weights: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Weights and bias (last) of the L2 machine with squared hinge loss, by Newton steps on the active rows."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(20):
        active = y * (x @ w) < 1
        xa, c = x[active], cost * weights[active]
        new = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, (xa * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


@dataclass
class Toxicity:
    """Weights of the subsequences, the words' bias, and the logistic function of a document."""

    table: np.ndarray
    bias: float
    logistic: np.ndarray

    def document_values(self, f: Folded, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Worst word, words beyond the margin and words of each row; number of its sentences with a positive word."""
        out, sentences = np.zeros((rows, 3)), np.zeros(rows, dtype=np.int64)
        out[:, 0] = NO_WORD
        if len(f.row):
            letters, bounds, number = distinct_words(f)
            value = (word_values(letters, bounds, self.table) + np.float32(self.bias))[number]
            value = np.where(np.diff(f.bounds) > 2, value, NO_WORD)
            new = np.flatnonzero(np.diff(f.sentence, prepend=-1))
            worst, of = np.maximum.reduceat(value, new), f.row[new]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[begin], 0] = np.maximum.reduceat(worst, begin)
            out[:, 1] = np.bincount(f.row[value > 0.5], minlength=rows)
            out[:, 2] = np.bincount(f.row, minlength=rows)
            sentences = np.bincount(of[worst > 0], minlength=rows)
        return shaped(out), sentences

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(values @ self.logistic[:-1] + self.logistic[-1], -700, 700)))


def shaped(values: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(values[:, 0], -2, 2), np.log1p(values[:, 1]), np.log1p(values[:, 2])])


def labelled_words(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """label and the folded words (each once) of the chosen documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column(1)):
                f = folded(data, offsets)
                rows = [[] for _ in range(stop - first)]
                raw, at = f.letters.astype(np.uint8).tobytes(), f.bounds.tolist()
                for r, a, b in zip(f.row.tolist(), at[:-1], at[1:]):
                    if b - a > 2:
                        rows[r].append(raw[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array([list(dict.fromkeys(r)) for r in rows], pa.list_(pa.binary())), pa.array([len(r) for r in rows], pa.int64())], names=["label", "words", "n"])

    texts = documents_only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    return texts.mapInArrow(run, "label int, words array<binary>, n bigint")


def machine(positive: list[np.ndarray], worth: np.ndarray, negative: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Table of subsequence weights and bias of the machine on words, the worthiest positive and some negative as landmarks."""
    marks = positive[: LANDMARKS * 2 // 3] + negative[: LANDMARKS // 3]
    values, vectors = np.linalg.eigh(kernels(marks, marks).astype(np.float64))
    whiten = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
    x = kernels(positive + negative, marks) @ whiten
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    w = linear_machine(x, y, np.concatenate([worth / worth.sum(), np.full(len(negative), 2 / len(negative))]) * 1000)
    beta = whiten @ w[:-1]
    letters, bounds = pack(marks)
    of, scale = np.repeat(np.arange(len(marks)), np.diff(bounds)), 1.0 / norms(np.diff(bounds))
    table = np.zeros(LETTERS**3)
    for at, sequence, weight in subsequences(letters, bounds):
        np.add.at(table, sequence, weight * (beta * scale)[of[at]])
    return table.astype(np.float32), float(w[-1])


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Toxicity:
    """Fit on labelled documents whose crc32 leaves another remainder than 2 when divided by 4."""
    held = crc32_of_id(F.col("doc_id")) % 4 == 2
    totals = {r["toxic"]: r["n"] for r in labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held).groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    chosen = labelled_rows(labels.where("toxic = 1"), "toxic", held, rows).unionByName(labelled_rows(labels.where("toxic = 0"), "toxic", held, rows))
    data = labelled_words(docs, chosen).toArrow()
    label, sizes = data["label"].to_numpy(), data["n"].to_numpy()
    counts = np.array([(label == 0).sum(), (label == 1).sum()])
    if counts.min() < 5:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Toxicity(np.zeros(LETTERS**3, dtype=np.float32), NO_WORD, np.array([0.0, 0.0, 0.0, odds]))
    lists = data["words"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    number, vocabulary = coded.indices.to_numpy(), [np.frombuffer(w, dtype=np.uint8) for w in coded.dictionary.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    of = np.repeat(np.arange(len(label)), np.diff(bounds))
    seen = [np.bincount(number[label[of] == k], minlength=len(vocabulary)) for k in (0, 1)]
    letters, ends = pack(vocabulary)
    lengths = np.diff(ends)
    spread = np.argsort(mix(np.arange(len(vocabulary), dtype=np.uint64)), kind="stable")
    clean = spread[(seen[0] > 0)[spread]][:8000]
    toxic_of, toxic_number = of[label[of] == 1], number[label[of] == 1]
    explained, worth = np.zeros(len(label), dtype=bool), np.zeros(len(vocabulary))
    table, bias = np.zeros(LETTERS**3, dtype=np.float32), NO_WORD
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            # words that the toxic documents without a positive word have more often than clean ones
            open_ = ~explained[toxic_of]
            own = np.bincount(toxic_number[open_], minlength=len(vocabulary))
            expected = seen[0] * ((label == 1) & ~explained).sum() / counts[0]
            surplus = np.where((lengths > 3) & (own >= LEAST_RATIO * expected), (own - expected) / np.sqrt(own + expected + 1), 0)
            fresh = (surplus >= max(LEAST_SURPLUS, surplus.max() / 2)) & (worth == 0)
            if not fresh.any() and turn:
                continue
            worth[fresh] = np.sqrt(own[fresh]) + 1e-3
        else:
            # at last, all that the machine finds in toxic documents and clean ones hardly have
            found = (decided > 0.5) & (seen[1] > 0) & (seen[0] * counts[1] < 0.25 * seen[1] * counts[0])
            worth = np.where(found, np.sqrt(seen[1]), worth)
        positive = np.flatnonzero(worth)
        if not len(positive):
            positive = np.argsort(-surplus, kind="stable")[:10]
            worth[positive] = 1.0
        hard = np.argsort(-np.where((seen[0] > 0) & (worth == 0), decided, -9), kind="stable")[:4000] if turn else clean[:0]
        negative = np.unique(np.concatenate([clean, hard]))
        negative = negative[worth[negative] == 0]
        if not len(negative):
            break
        best = positive[np.argsort(-worth[positive], kind="stable")]
        table, bias = machine([vocabulary[i] for i in best], worth[best], [vocabulary[i] for i in negative])
        decided = word_values(letters, ends, table) + np.float32(bias)
        explained[:] = False
        explained[toxic_of[decided[toxic_number] > 0]] = True
    values3 = np.zeros((len(label), 3))
    values3[:, 0], values3[:, 2] = NO_WORD, sizes
    full = np.flatnonzero(np.diff(bounds))
    values3[full, 0] = np.maximum.reduceat(decided[number], bounds[:-1][full])
    values3[full, 1] = np.add.reduceat((decided[number] > 0.5).astype(np.int64), bounds[:-1][full])
    x = shaped(values3)
    logistic = logistic_fit(x, label)
    if logistic[:2].min() < 0:  # a worse word never lowers a score
        for k in np.flatnonzero(logistic[:2] < 0):
            x[:, k] = 0
        logistic = logistic_fit(x, label)
    logistic[-1] += np.log(totals[1] / totals[0]) - np.log(counts[1] / counts[0])
    return Toxicity(table, bias, logistic)


def toxic_scores(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and toxic_sentences, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column(1)):
                values, sentences = known.document_values(folded(data, offsets), stop - first)
                s = known.scores(values)
                rest = [batch.column(i).slice(first, stop - first) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(sentences, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "toxic_sentences"])

    given = documents_only(docs, "doc_id", "text").withColumn("held_out", F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False)))
    return given.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, toxic_sentences bigint")
