"""Cross-tokenizer alignment: how the tokens of two tokenizers lie over the same bytes.

A is a byte-level BPE and encodes space + text, B a piece model that adds the space itself. In a slice of texts, each
tokenizer has an incidence matrix of tokens and bytes, in hand-built compressed rows. Its product A·Bᵀ, by Gustavson's
rows, has the overlap links with the number of shared bytes. Bytes at which tokens of both end cut the tokens into groups;
the product of the incidence matrices of tokens and groups has the links within groups.

For the corpus counts, the texts of a task are taken in blocks of a few megabytes. A block is one row of a written table:
its documents, a matrix of documents and the block's distinct id pairs, and these pairs with their counts. Spark adds the
counts up over the blocks, finds the highest of each id of B (a table no larger than its vocabulary, so it is broadcast),
and joins them back to each block's pairs, where the documents' sums are a matrix times a vector. A pair is in a block
once, so no key has more rows than there are blocks.

A null or empty text, one whose token bytes are not its own, and one that is not valid UTF-8 have no tokens: zeros and ''.
Special tokens' strings are plain text. Every row is a document of its own, also repeated ones and those without an id.
Empty tables give no rows, extra columns are ignored. A text is held whole, with some 200 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.sparse import Csr, incidence, products, row_work, spans
from fieldbook.llm.storage import documents_only, written
from fieldbook.llm.text import text_slices

#: Bytes of text in a block, of which a longer text is one of its own.
BLOCK_BYTES = 4 << 20
#: How a byte-level BPE splits text before it merges; what "use_regex" stands for in the file.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of a vocabulary; a pair of ids is one number.
_IDS = 1 << 16
_PAIRS = _IDS * _IDS


@dataclass
class Tokenizers:
    """Both tokenizers as the contents of their files, so that executors need no files. Opened once in each task."""

    byte_bpe: bytes
    piece_model: bytes

    def __getstate__(self) -> dict:
        return {"byte_bpe": self.byte_bpe, "piece_model": self.piece_model}

    @cached_property
    def a(self):
        import tiktoken

        file = json.loads(self.byte_bpe)
        merges, vocabulary, split = file["model"]["merges"], file["model"]["vocab"], file["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and file["normalizer"] is None
        joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges)
        if not plain or any(vocabulary[m] != 256 + i for i, m in enumerate(joined)):
            raise ValueError("the byte-level BPE must number its merges in their order and have no normalizer")
        added = {t["content"] for t in file["added_tokens"]}
        if max(len(vocabulary), self.b.get_piece_size()) > _IDS:
            raise ValueError(f"vocabularies may have {_IDS} entries at most")
        ranks = {bytes(_byte_of(c) for c in word): i for word, i in vocabulary.items() if word not in added}
        return tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.piece_model)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        table = [b""] * self.a.n_vocab
        for word in self.a.token_byte_values():
            table[self.a.encode_single_token(word)] = word
        return table

    @cached_property
    def bytes_b(self) -> list[bytes]:
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))

    def encoded(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none if the bytes of either differ from space + text."""
        none = np.zeros(0, dtype=np.int64)
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            return none, none
        if not text:
            return none, none
        one, two = self.a.encode_ordinary(" " + plain), self.b.encode(plain)
        whole = b" " + text
        if b"".join([self.bytes_a[i] for i in one]) != whole or b"".join([self.bytes_b[i] for i in two]) != whole:
            return none, none
        return np.array(one, dtype=np.int64), np.array(two, dtype=np.int64)


def _byte_of(c: str) -> int:
    """The byte that a character of a byte-level entry stands for: printable ones for themselves, the rest counted on from 256."""
    n = ord(c)
    if n < 256:
        return n
    hidden = [*range(33), *range(127, 161), 173]
    return hidden[n - 256]


def read_tokenizers(byte_bpe: str, piece_model: str) -> Tokenizers:
    """The two files, read on the driver."""
    with open(byte_bpe, "rb") as one, open(piece_model, "rb") as two:
        return Tokenizers(one.read(), two.read())


@dataclass
class Aligned:
    """Tokens of a slice of documents over the bytes of space + text of all of them; ``a_bounds[i]:a_bounds[i + 1]`` are those of document i."""

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    @property
    def width(self) -> int:
        return int(self.a_ends[-1]) if len(self.a_ends) else 0

    @cached_property
    def cuts(self) -> np.ndarray:
        """Bytes at which a group ends."""
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    @cached_property
    def groups(self) -> tuple[Csr, Csr]:
        """Incidence of tokens and groups."""
        both = (np.searchsorted(self.cuts, ends) for ends in (self.a_ends, self.b_ends))
        return tuple(incidence(np.arange(len(g) + 1), g, len(self.cuts)) for g in both)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links of tokens that share bytes: place of the A token, of the B token, number of bytes."""
        yield from _links(spans(self.a_ends, self.width), spans(self.b_ends, self.width).transposed())

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links of tokens in one group."""
        one, two = self.groups
        yield from _links(one, two.transposed())

    def group_link_counts(self) -> np.ndarray:
        """Links within groups of each A token, without writing them down."""
        one, two = self.groups
        return row_work(one, two.transposed())


def _links(a: Csr, bt: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for first, c in products(a, bt):
        yield first + c.row_numbers(), c.columns, c.values


def aligned(texts: list[bytes], t: Tokenizers) -> Aligned:
    pairs = [t.encoded(x) for x in texts]
    none = [np.zeros(0, dtype=np.int64)]
    a, b = (np.concatenate(none + [p[k] for p in pairs]) for k in (0, 1))
    bounds = (np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs], dtype=np.int64)]) for k in (0, 1))
    return Aligned(a, b, *bounds, np.cumsum(t.sizes[0][a]), np.cumsum(t.sizes[1][b]))


class GroupText:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``: every id with what follows it comes from one table."""

    def __init__(self, t: Tokenizers):
        self.n = max(len(t.bytes_a), len(t.bytes_b))
        ids = np.arange(self.n).astype("S").astype(object)
        self.table = np.concatenate([ids + b",", ids + b"|", ids + b";"])

    def digests(self, x: Aligned) -> list[str]:
        groups = np.concatenate([2 * x.groups[0].columns, 2 * x.groups[1].columns + 1])
        order = np.argsort(groups, kind="stable")
        sorted_, ids = groups[order], np.concatenate([x.a, x.b])[order]
        last = np.append(sorted_[1:] != sorted_[:-1], True)[: len(ids)]
        parts = self.table[ids + self.n * np.where(last, 1 + sorted_ % 2, 0)].tolist()
        bounds = (x.a_bounds + x.b_bounds).tolist()
        return [hashlib.sha256(b"".join(parts[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:])]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Block:
    """Documents of a few megabytes of text, on the way to one row."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.digests, self.numbers, self.entries = 0, [], [], [], []

    def add(self, ids: pa.Array, x: Aligned, digests: list[str]) -> None:
        first, n = len(self.digests), len(digests)
        pairs = [np.zeros(0, dtype=np.int64)]
        for a, b, _ in x.overlaps():
            pairs.append((np.searchsorted(x.a_bounds, a, side="right") - 1) * _PAIRS + x.a[a] * _IDS + x.b[b])
        of, times = np.unique(np.concatenate(pairs), return_counts=True)
        self.entries.append((first + of // _PAIRS, of % _PAIRS, times))
        links = np.bincount(of // _PAIRS, weights=times, minlength=n).astype(np.int64)
        cuts = np.searchsorted(x.cuts, np.concatenate([[0], x.a_ends])[x.a_bounds], side="right")
        self.numbers.append(np.stack([np.diff(x.a_bounds), np.diff(x.b_bounds), np.diff(cuts), links, _sums(x.group_link_counts(), x.a_bounds)]))
        self.ids.extend(ids.to_pylist())
        self.digests.extend(digests)
        self.bytes += x.width

    def row(self, number: int) -> pa.RecordBatch:
        docs, pairs, times = (np.concatenate(x) for x in zip(*self.entries))
        keys, place = np.unique(pairs, return_inverse=True)
        counts = np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
        rank = np.empty(len(keys), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys))  # frequent pairs get small numbers, which pack well
        back = np.argsort(rank)
        place, order = rank[place], np.lexsort((rank[place], docs))
        values = {
            "block": [number], "ids": [self.ids], "digests": [self.digests], "numbers": [np.concatenate(self.numbers, axis=1).ravel()],
            "starts": [np.searchsorted(docs, np.arange(len(self.ids) + 1))], "pairs": [_packed(place[order])], "times": [_packed(times[order])],
            "keys": [keys[back]], "counts": [counts[back]],
        }
        return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for k, v in values.items()], names=list(values))


_LONGS = pa.list_(pa.int64())
_KINDS = {"block": pa.int64(), "ids": _LONGS, "digests": pa.list_(pa.string()), "numbers": _LONGS, "starts": _LONGS, "pairs": pa.binary(), "times": pa.binary(), "keys": _LONGS, "counts": _LONGS}
_BLOCK_SCHEMA = "block bigint, ids array<bigint>, digests array<string>, numbers array<bigint>, starts array<bigint>, pairs binary, times binary, keys array<bigint>, counts array<bigint>"
DIGEST_SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_group_links bigint"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], t: Tokenizers) -> Iterator[tuple[pa.Array, Aligned]]:
    for batch in batches:
        for first, stop, data, offsets in text_slices(batch.column(1)):
            yield batch.column(0).slice(first, stop - first), aligned([data[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])], t)


def blocks(docs: DataFrame, tokenizers: Broadcast[Tokenizers], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers.value
        text, number = GroupText(t), TaskContext.get().partitionId() << 32
        block = Block()
        for ids, x in _slices(batches, t):
            block.add(ids, x, text.digests(x))
            if block.bytes >= block_bytes:
                yield block.row(number)
                block, number = Block(), number + 1
        if block.ids:
            yield block.row(number)

    return documents_only(docs, "doc_id", "text").mapInArrow(run, _BLOCK_SCHEMA)


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, links of all documents that hold the pair linked, best (no other pair of the same b has more)."""
    each = found.select(F.explode(F.arrays_zip("keys", "counts")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.counts").alias("n"))
    total = each.groupBy("key").agg(F.sum("n").alias("links")).withColumn("b", F.col("key").bitwiseAND(_IDS - 1))
    total = written(total, "align-counts")
    most = total.groupBy("b").agg(F.max("links").alias("most"))  # as many rows as B has ids at most
    return total.join(F.broadcast(most), "b").select("key", F.shiftright("key", 16).alias("a"), "b", "links", (F.col("links") == F.col("most")).alias("best"))


def digest(docs: DataFrame, tokenizers: Tokenizers, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and n_group_links, the links within groups."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    found = written(blocks(docs, shared, block_bytes), "align-blocks")
    shared.destroy()  # the blocks are a table now: nothing computes them again
    keys = found.select(F.col("block").alias("of"), F.posexplode("keys").alias("place", "key"))
    weights = keys.join(pair_counts(found).select("key", "links", "best"), "key").select("of", "place", "links", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0] for c in left.column_names}
        starts, pairs, times = np.array(row["starts"].values), _unpacked(row["pairs"].as_py()), _unpacked(row["times"].as_py())
        links, best = np.zeros((2, len(right)), dtype=np.int64)
        place = right["place"].to_numpy()
        links[place], best[place] = right["links"].to_numpy(), right["best"].to_numpy()
        n_a, n_b, n_groups, n_links, n_inside = np.array(row["numbers"].values).reshape(5, -1)
        sums = {"n_best": _sums(times * best[pairs], starts), "count_sum": _sums(times * links[pairs], starts)}
        out = {"doc_id": row["ids"].values, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, **sums, "groups_sha256": row["digests"].values, "n_group_links": n_inside}
        return pa.table(out)

    bare = found.select("block", "ids", "digests", "numbers", "starts", "pairs", "times")
    return bare.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(run, DIGEST_SCHEMA)


def links(docs: DataFrame, tokenizers: Tokenizers, within: str = "bytes") -> DataFrame:
    """The links themselves: doc_id, a_place, b_place (token numbers in the document), a, b (ids), shared (bytes, or 1 within groups).

    ``within`` is "bytes" for tokens that overlap, "groups" for tokens of one group. A group's links are the product of its
    tokens of A and of B, so texts in which tokens seldom end together have very many of them; they are written a few rows
    of the product at a time.
    """
    if within not in ("bytes", "groups"):
        raise ValueError(f"within must be bytes or groups, not {within}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _slices(batches, tokenizers):
            for a, b, shared in x.overlaps() if within == "bytes" else x.group_links():
                doc = np.searchsorted(x.a_bounds, a, side="right") - 1
                out = {"doc_id": ids.take(pa.array(doc)), "a_place": a - x.a_bounds[doc], "b_place": b - x.b_bounds[doc], "a": x.a[a], "b": x.b[b], "shared": shared}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))

    return documents_only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, a_place bigint, b_place bigint, a bigint, b bigint, shared bigint")


def public_tokenizers(spark: SparkSession) -> Tokenizers:
    """The tokenizers of the query, from the settings ``fieldbook.tokenizers.a`` and ``.b`` if they name files."""
    import public_tokenizers as files

    one, two = (spark.conf.get(f"fieldbook.tokenizers.{k}", None) for k in "ab")
    return read_tokenizers(one or files.path("byte_bpe_50k.json"), two or files.path("piece_bpe_32k.model"))
