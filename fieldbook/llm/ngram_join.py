"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct runs of five words. Tokens (runs) are ordered from rare to frequent. Two sets of
Jaccard likeness 3/4 have overlap 3/4 of either size, so the first tokens they share lie within the prefixes of both.

1. Count: every token of every document is counted by fingerprint, as sorted runs of fingerprints that Spark shuffles by
   their leading bits. The counts fill two tables that give a token its frequency class: 0 if no two documents share a
   token of its slot, 1 for rare tokens, above for frequent ones, by powers of two. Whether a slot is shared is one bit, and
   there are as many slots as the texts need, up to a bound. A slot shared by chance changes the order of tokens only, never the result.
2. Index: a set with more tokens of class 0 than it may lose has no partner. Any other set indexes the rare tokens of its
   prefix singly. If the prefix reaches frequent tokens, it is extended by G + 1 and the frequent tokens in it are dealt
   into G hash groups: sets that share G + 1 of them share two in one group, so the pairs of each group are indexed as
   combinations. G follows the size, so that a set indexes about as many combinations as it has prefix tokens. The
   smaller set of a pair shares 6/7 of its tokens, so its prefix is shorter; keys in it are marked, and a pair meets
   under a key that its smaller set has marked.
3. Merge: keys under which the same sets stand say the same, and one of them is kept.
4. Verify: each set is compared with one marked set under each of its keys, that with the most frequent tokens, which in a
   group of copies is the nearest to all others. This joins most members of such a group in linear time. Only keys under which different components still meet are expanded into pairs, of different
   components that may reach the likeness by their size classes, sizes and profiles (tokens that are not lone, counted by cells of
   their hashes), and these are compared exactly. No pair of linked sets is missed.

Equal sets are one class and are indexed once a task. A null or empty text has no set and is linked with nothing. Rows
with one doc_id are documents of their own for their links and share the id; a null doc_id is never the name of a
component unless all of it is null. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.components import components
from fieldbook.llm.sketch import both_slots, present
from fieldbook.llm.storage import documents_only, written
from fieldbook.llm.text import distinct_rows, mix, shingles_of, text_slices, words_of

WORDS = 5
#: Documents a rare token is in at most.
RARE = 32
#: Bounds of the number of bits that say whether a slot is shared: 4 MB to 64 MB. Frequencies have a slot of a byte for 32 of them.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 25, 29
#: Bytes of text for a slot.
SLOT_BYTES = 8
#: Sets of a bucket; two buckets are a tile, in which sets are compared.
BUCKET_SETS, LEAST_BUCKETS = 4096, 8
#: Cells of a set's profile; four tokens of each are told apart.
CELLS = 512
_FLUSH = 500_000
_U64 = np.uint64


def token_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, sorted distinct tokens of the rows one after another, offsets of the rows."""
    for first, _, data, offsets in text_slices(texts):
        yield first, *distinct_rows(*shingles_of(words_of(data, offsets), WORDS))


def count_runs(docs: DataFrame, part_bits: int) -> DataFrame:
    """Sorted fingerprints and their counts, cut by leading bits: part, size, steps, counts."""
    shift = _U64(64 - 32 - part_bits)

    def blocks(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(parts) >> shift
        keys.sort()
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(keys))).astype(np.uint32)
        keys = keys[at]
        part = (keys >> _U64(32)).astype(np.int64)
        low = keys.astype(np.uint32)
        some, begin = np.unique(part, return_index=True)
        ends = np.append(begin[1:], len(part))
        rows = {"part": [], "size": [], "steps": [], "counts": []}
        for p, a, b in zip(some.tolist(), begin.tolist(), ends.tolist()):
            steps = np.diff(low[a:b], prepend=np.uint32(0)).astype(np.uint32)
            rows["part"].append(p), rows["size"].append(b - a)
            rows["steps"].append(steps.view(np.uint8).reshape(-1, 4).T.tobytes())
            rows["counts"].append(counts[a:b].view(np.uint8).reshape(-1, 4).T.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), pa.array(rows["size"], pa.int32()), pa.array(rows["steps"], pa.binary()), pa.array(rows["counts"], pa.binary())], names=list(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for _, tokens, _ in token_sets(batch.column(0)):
                kept.append(tokens)
                n += len(tokens)
                if n >= _FLUSH:
                    yield from blocks(kept)
                    kept, n = [], 0
        if n:
            yield from blocks(kept)

    return documents_only(docs, "text").mapInArrow(run, "part int, size int, steps binary, counts binary")


@dataclass(frozen=True)
class Frequencies:
    """Whether a slot is shared, by bits, and the frequency class of the most frequent token of a larger slot."""

    shared: np.ndarray
    often: np.ndarray

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        slots, places = tokens >> _U64(64 - _bits(self.shared) - 3), tokens >> _U64(64 - _bits(self.often))
        return (self.shared[slots >> _U64(3)] >> (slots & _U64(7)).astype(np.uint8) & 1) * self.often[places]


def _bits(table: np.ndarray) -> int:
    return len(table).bit_length() - 1


def slot_bits(docs: DataFrame) -> int:
    """As many bits as the texts need: of a corpus some words are shared, each of them by two documents or more."""
    size = documents_only(docs, "text").agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, math.ceil(math.log2(max(1, size / SLOT_BYTES)))))


def class_table(docs: DataFrame, rare: int = RARE, bits: int | None = None) -> Frequencies:
    """The frequency classes of slots, each the highest of the tokens in it."""
    bits = bits or slot_bits(docs)
    part_bits = min(bits - 8, 20, max(8, math.ceil(math.log2(max(1, docs.rdd.getNumPartitions()))) + 3))
    inside, wide = bits - part_bits, max(0, bits - 5 - part_bits)

    def unpacked(values: pa.ChunkedArray, sizes: list[int]) -> list[np.ndarray]:
        return [np.ascontiguousarray(np.frombuffer(v.as_py(), dtype=np.uint8).reshape(4, n).T).view(np.uint32).ravel() for v, n in zip(values, sizes)]

    def run(rows: pa.Table) -> pa.Table:
        sizes = rows["size"].to_pylist()
        keys = np.concatenate([np.cumsum(s, dtype=np.uint32) for s in unpacked(rows["steps"], sizes)])
        counts = np.concatenate(unpacked(rows["counts"], sizes))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(counts.astype(np.int64), at)
        many = total > 1
        total, keys = total[many], keys[at][many]
        bit, often = np.zeros(1 << inside, dtype=np.uint8), np.ones(1 << wide, dtype=np.uint8)
        bit[keys >> np.uint32(32 - inside)] = 1
        np.maximum.at(often, (keys.astype(_U64) >> _U64(32 - wide)).astype(np.int64), np.where(total <= rare, 1, 2 + np.log2(np.maximum(total / rare, 1))).astype(np.uint8))
        values = [np.packbits(bit, bitorder="little").tobytes(), often.tobytes()]
        return pa.table([rows["part"].slice(0, 1), *(pa.array([v], pa.binary()) for v in values)], names=["part", "shared", "often"])

    shared, often = np.zeros(1 << (bits - 3), dtype=np.uint8), np.ones(1 << (part_bits + wide), dtype=np.uint8)
    parts = count_runs(docs, part_bits).groupBy("part").applyInArrow(run, "part int, shared binary, often binary")
    for row in parts.toLocalIterator(prefetchPartitions=True):
        for table, values in ((shared, row["shared"]), (often, row["often"])):
            table[row["part"] * len(values) : (row["part"] + 1) * len(values)] = np.frombuffer(bytes(values), dtype=np.uint8)
    return Frequencies(shared, often)


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n must share with any partner: 3/4 of them, rounded up."""
    return (3 * n + 3) // 4


def shorter_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n must share with a partner that is not smaller: 6/7 of them, rounded up."""
    return (6 * n + 6) // 7


def index_keys(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys of one set: rare tokens of the prefix, and combinations of frequent ones. The lowest bit is the mark."""
    n = len(tokens)
    order = np.argsort(classes, kind="stable")
    tokens, classes = tokens[order], classes[order]
    need, more = least_overlap(n), shorter_overlap(n)
    first = n - need + 1
    rare = classes[:first] == 1
    keys, marks = [mix(tokens[:first][rare])], [np.flatnonzero(rare) <= n - more]
    if classes[first - 1] > 1:
        level = n.bit_length() - 1
        for k in {level, ((4 * n) // 3).bit_length() - 1}:
            groups = max(1, (1 << k) // 4)
            longer = min(n, n - need + groups + 1)
            place = np.flatnonzero(classes[:longer] > 1)
            often, near = tokens[place], place <= n - more + groups
            group = mix(often ^ _U64(0x5BD1E995)) & _U64(groups - 1)
            by = np.argsort(group, kind="stable")
            group, often, near = group[by], often[by], near[by]
            for step in range(1, len(often)):
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                keys.append(mix(mix(often[:-step][same]) + often[step:][same] * _U64(0x2545F4914F6CDD1D) + _U64(k)))
                marks.append((near[:-step] & near[step:])[same])
    keys, marks = np.concatenate(keys), np.concatenate(marks)
    return np.unique(keys >> _U64(1) << _U64(1) | marks.astype(_U64))


def profile_of(tokens: np.ndarray) -> np.ndarray:
    """Tokens by cells of their hashes: as many low bits of a cell's four as it has tokens, and last the tokens beyond 4."""
    counts = np.bincount((tokens % _U64(CELLS)).astype(np.int64), minlength=CELLS)
    bits = ((1 << np.minimum(counts, 4)) - 1).astype(np.uint8)
    return np.append((bits[::2] | bits[1::2] << 4).view(np.int64), np.maximum(counts - 4, 0).sum())


def with_classes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, tokens, offsets of the rows, and a hash of each row's set."""
    for first, tokens, offsets in token_sets(texts):
        total = np.zeros(len(tokens) + 1, dtype=_U64)
        np.cumsum(mix(tokens + _U64(0x632BE59BD9B4E019)), out=total[1:])
        yield first, tokens, offsets, mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(_U64)).view(np.int64)


def _with_hash(docs: DataFrame, *columns: str) -> DataFrame:
    """``same`` is a hash of the text, to find the text again."""
    return documents_only(docs, *columns).withColumn("same", F.xxhash64("text"))


def indexed(docs: DataFrame, shared: Broadcast[Frequencies]) -> DataFrame:
    """doc_id, n (set size), cls (hash of the set), same, and once a task for sets that may have partners: lone (tokens of class 0), usual (mean class), profile, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for batch in batches:
            for first, tokens, offsets, cls in with_classes(batch.column(1)):
                n = np.diff(offsets)
                classes = known.classes(tokens)
                alone = np.concatenate([[0], np.cumsum(classes == 0)])
                alone = alone[offsets[1:]] - alone[offsets[:-1]]
                usual = np.concatenate([[0], np.cumsum(classes, dtype=np.int64)])
                usual = (usual[offsets[1:]] - usual[offsets[:-1]]) / np.maximum(n, 1)
                maybe = (n > 2) & (alone <= n - least_overlap(n))
                keys, profiles = [None] * len(n), [None] * len(n)
                for i in np.flatnonzero(maybe).tolist():
                    if cls[i] in seen:
                        continue
                    seen.add(cls[i])
                    a, b = offsets[i], offsets[i + 1]
                    found = index_keys(tokens[a:b], classes[a:b])
                    if len(found):
                        keys[i] = found.view(np.int64)
                        profiles[i] = profile_of(tokens[a:b][classes[a:b] > 0])
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(cls), batch.column(2).slice(first, len(n)), pa.array(alone, pa.int64()), pa.array(usual), pa.array(profiles, kind), pa.array(keys, kind)],
                    names=["doc_id", "n", "cls", "same", "lone", "usual", "profile", "keys"],
                )

    return _with_hash(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, cls bigint, same bigint, lone bigint, usual double, profile array<bigint>, keys array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and tokens of the wanted sets (cls, same), once a task at least; other sets whose texts' hashes meet theirs by chance come along."""
    some = docs.sparkSession.sparkContext.broadcast(present(wanted, "same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = some.value, set()
        for batch in batches:
            one, two = both_slots(batch.column(1).to_numpy().view(_U64))
            for _, tokens, offsets, cls in with_classes(batch.column(0).filter(pa.array((known[one] & known[two]).astype(bool)))):
                new = [i for i, c in enumerate(cls.tolist()) if not (c in seen or seen.add(c))]
                sets = [tokens[offsets[i] : offsets[i + 1]].view(np.int64) for i in new]
                yield pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "tokens"])

    return _with_hash(docs, "text").mapInArrow(run, "cls bigint, tokens array<bigint>")


def kept_postings(keyed: DataFrame) -> DataFrame:
    """key, cls, marked: of the keys under which the same sets stand, and some marked one, one key."""
    each = keyed.select("cls", F.explode("keys").alias("k")).select("cls", F.shiftright("k", 1).alias("key"), (F.col("k") % 2 != 0).alias("marked"))
    lists = each.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.min("cls").alias("low"), F.max("cls").alias("high"), F.max("marked").alias("some"),
        F.bit_xor(F.xxhash64("cls", "marked")).alias("one"), F.sum(F.shiftright(F.xxhash64("marked", "cls"), 20)).alias("two"),
    )
    lists = lists.where("many > 1 AND some").groupBy("many", "low", "high", "one", "two").agg(F.min("key").alias("key"))
    return each.join(lists.select("key"), "key")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sets have a Jaccard likeness of 0.75 or more. A set is sent once to each tile that compares it."""
    buckets = max(LEAST_BUCKETS, -(-sets.count() // BUCKET_SETS))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    tiled = pairs.withColumn("tile", bucket("a") * buckets + bucket("b"))
    sent = tiled.select(F.col("tile").alias("to"), F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls")

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        cls, tokens = given["cls"].to_pylist(), given["tokens"].combine_chunks()
        offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        of = {c: flat[offsets[i] : offsets[i + 1]] for i, c in enumerate(cls)}
        kept = []
        for a, b in zip(rows["a"].to_pylist(), rows["b"].to_pylist()):
            x, y = of[a], of[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * both >= 75 * (len(x) + len(y) - both))
        return rows.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return tiled.groupBy("tile").cogroup(sent.groupBy("to")).applyInArrow(run, "a bigint, b bigint")


def may_link() -> F.Column:
    """Whether two sets can share 3/7 of their sizes' sum: by size, by tokens that are not lone, and by cells of their profiles.

    The words of the profiles are counted by functions of arrays: written out one by one, they were a method too long to be compiled.
    """
    most = F.least("n", "m", F.col("n") - F.col("lone"), F.col("m") - F.col("lone_b"))
    p, q, last = F.col("profile"), F.col("profile_b"), CELLS // 16
    words = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda total, x: total + x)
    cells = words - F.bit_count(p[last].bitwiseAND(q[last])) + F.least(p[last], q[last])
    need = 3 * (F.col("n") + F.col("m"))
    return (7 * most >= need) & (7 * cells >= need)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, and n_same, the number of documents with the same set."""
    classes = docs.sparkSession.sparkContext.broadcast(class_table(docs))
    data = written(indexed(docs, classes), "near-index")
    classes.destroy()  # the index is a table now: nothing computes it again
    keyed = written(data.where("keys IS NOT NULL").groupBy("cls", "n", "lone", "usual").agg(F.first("profile").alias("profile"), F.first("keys").alias("keys"), F.first("same").alias("same")), "near-keys")
    postings = kept_postings(keyed).join(keyed.select("cls", "n", "lone", "usual", "profile"), "cls")
    postings = written(postings, "near-postings")
    wanted = keyed.join(postings.select("cls").distinct(), "cls", "left_semi").select("cls", "same")
    sets = sets_of(docs, wanted).join(wanted.select("cls"), "cls", "left_semi")
    sets = written(sets.groupBy("cls").agg(F.first("tokens").alias("tokens")), "near-sets")
    heads = postings.where("marked").groupBy("key").agg(F.min(F.struct((-F.col("usual")).alias("unusual"), "cls", "n", "lone", "profile")).alias("head"))
    heads = heads.select("key", F.col("head.cls").alias("a"), *(F.col(f"head.{c}").alias(c) for c in ("n", "lone", "profile")))
    others = postings.select("key", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("lone").alias("lone_b"), F.col("profile").alias("profile_b"))
    stars = others.join(heads, "key").where((F.col("b") != F.col("a")) & may_link()).select("a", "b").distinct()
    stars = written(stars, "near-stars")
    links = written(verified(stars, sets), "near-links")
    part = components(links, "a", "b")

    placed = postings.join(part, postings["cls"] == part["vertex"], "left").select("key", "cls", "n", "lone", "profile", "marked", F.coalesce("component", "cls").alias("comp"))
    placed = written(placed, "near-placed")
    meeting = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    open_ = placed.join(meeting, "key", "left_semi")
    other = open_.select("key", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("lone").alias("lone_b"), F.col("profile").alias("profile_b"), F.col("comp").alias("comp_b"))
    # a key is split by size: a partner is in the size class of the smaller set or in the next one
    size_class = lambda n: F.floor(F.log(F.col(n)) / math.log(4 / 3)).cast("int")
    smaller = open_.where("marked").withColumnRenamed("cls", "a").withColumn("part", F.explode(F.array(size_class("n"), size_class("n") + 1)))
    rest = smaller.join(other.withColumn("part", size_class("m")), ["key", "part"]).where((F.col("comp") != F.col("comp_b")) & (F.col("n") <= F.col("m")) & may_link()).select("a", "b").distinct()
    more = written(verified(written(rest, "near-rest"), sets), "near-links")
    part = components(links.unionByName(more), "a", "b")

    classes = data.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same"))
    classes = classes.join(part, classes["cls"] == part["vertex"], "left").select("cls", "least", "n_same", F.coalesce("component", "cls").alias("comp"))
    classes = written(classes, "near-classes")
    names = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(classes.join(names, "comp").select("cls", "n_same", "component_id"), "near-names")
    out = data.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that name their component: one of each group, and all that have none. Rows without an id stay."""
    found = near_duplicates(docs)
    rest = written(found.where("component_id IS NOT NULL AND doc_id IS NOT NULL AND component_id <> doc_id").select(F.col("doc_id").alias("copy")).distinct(), "near-copies")
    return docs.join(rest, docs["doc_id"] == rest["copy"], "left_anti")
