"""Conversation prefix trie: what a cache of shared conversation beginnings would save.

A turn is known by the 128 bits of its role's and text's hash, so a conversation is a row of turn ids. Spark cuts the rows
by range (ids first, then conversation) into shards of bounded size. A shard pads its rows to a matrix, sorts it with
numpy's lexsort, and compares each row with the one above: the change masks of the columns, accumulated by OR, mark where a
node starts at each depth, and reduceat sums up each depth. Conversations of more turns than ``COLUMNS`` go on in further
matrices of their own, whose first key is the node they have in common.

Nodes on the path of a shard's first or last row may go on in a neighbour. A shard hands these on as parts, which are added
up by node; what neighbours have in common was counted by both, and the table of neighbouring ends corrects that: every
sum is linear in the common length, so one row for each common node does. The ids of conversations that end at such a node
are handed on in pieces and hashed in order as a stream.

Turns are ordered by turn (null first); rows of one turn by role, then text. Null role or text is empty. Rows without a
conv_id belong to no conversation. Empty tables have no nodes; extra columns are ignored. A conversation is held whole, as
20 bytes a turn, not as texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook.llm.storage import written

#: Columns of a matrix.
COLUMNS = 32
#: Turns of a shard on large inputs.
SHARD_TURNS = 1 << 18
#: Conversations in a piece of those that end at one node.
PIECE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_KINDS = {
    "kind": pa.string(), "shard": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "place": pa.int64(), "content": pa.binary(), "lengths": pa.list_(pa.int64()),
}
_SCHEMA = "kind string, shard int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, parent_key binary, place bigint, content binary, lengths array<bigint>"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: hash (hex) and code points of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turn = F.struct(F.row_number().over(order).alias("at"), F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("id"), F.length("text").cast("bigint").alias("n"))
    return rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 100, longest: int = 6) -> DataFrame:
    """conv_id, path (16 bytes for each turn), lengths: the first turns of each family's first conversation, then the own ones."""
    own = written(turns_of(conversations), "trie-turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    first = own.where(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest - 1).alias("shared"))
    rows = own.withColumn("h", head.cast("int")).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).join(first, "base", "left")
    none = F.slice("turns", 1, 0)
    shared = F.coalesce(F.slice("shared", 1, F.col("h")), none)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    return rows.select("conv_id", F.concat(shared, rest).alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("path"), F.transform("turns", lambda t: t["n"]).alias("lengths")
    )


class Shard:
    """The trie of some conversations: sorted rows, and for each depth its nodes as runs of rows."""

    def __init__(self, convs: np.ndarray, paths: list[bytes], lengths: np.ndarray, bounds: np.ndarray, columns: int = COLUMNS):
        depth = np.diff(bounds)
        ids = np.frombuffer(b"".join(paths), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        self.levels: list[dict[str, np.ndarray]] = [{"first": np.zeros(1, dtype=np.int64), "n": np.array([len(convs)]), "length": np.zeros(1, dtype=np.int64)}]
        order = np.lexsort((convs, depth > 0))  # those without turns stand before all others
        rows = np.arange((depth == 0).sum(), len(convs))
        group, at = np.zeros(len(rows), dtype=np.int64), 0
        while len(rows):
            # rows: places in the order of those that go on, which stand together by group; they are sorted among themselves
            here = order[rows]
            width = int(min(columns, depth[here].max() - at))
            held = np.minimum(depth[here] - at, width)
            inside = np.arange(width) < held[:, None]
            matrix = np.zeros((len(rows), width, 2), dtype=np.uint64)
            source = (bounds[:-1][here] + at)[:, None] + np.arange(width)
            matrix[inside] = ids[source[inside]]
            size = np.zeros((len(rows), width), dtype=np.int64)
            size[inside] = lengths[source[inside]]
            further = depth[here] > at + width  # those that end here stand before those that go on
            keys = [convs[here], further, *(matrix[:, j, k] for j in reversed(range(width)) for k in (1, 0)), group]
            by = np.lexsort(keys)
            order[rows], matrix, held, size, group = here[by], matrix[by], held[by], size[by], group[by]
            change = np.ones((len(rows), width), dtype=bool)
            change[1:] = (matrix[1:] != matrix[:-1]).any(axis=2) | (np.arange(width) >= held[:-1, None])
            change[1:, 0] |= group[1:] != group[:-1]
            change = np.logical_or.accumulate(change, axis=1)
            for j in range(width):
                some = np.flatnonzero(held > j)
                start = np.flatnonzero(change[some, j])
                self.levels.append({"first": rows[some[start]], "n": np.diff(np.append(start, len(some))), "length": size[some[start], j]})
            some = np.flatnonzero(depth[order[rows]] > at + width)
            group = np.cumsum(change[:, -1])[some]
            rows, at = rows[some], at + width
        self.order, self.depth = order, depth[order]
        self.convs = convs[order]
        self._sum_up()

    def _sum_up(self) -> None:
        """Each depth from the one below: children, leaves, saved tokens, smallest conversation, conversations that end."""
        below = None
        for d in range(len(self.levels) - 1, -1, -1):
            x = self.levels[d]
            first, n = x["first"], x["n"]
            x["saved"] = (n - 1) * x["length"]
            x["children"], x["leaves"], under = (np.zeros(len(first), dtype=np.int64) for _ in range(3))
            if below is not None:
                of = np.searchsorted(first, below["first"], side="right") - 1
                below["parent"] = of
                has, begin = np.unique(of, return_index=True)
                x["children"][has] = np.diff(np.append(begin, len(of)))
                x["leaves"][has] = np.add.reduceat(below["leaves"], begin)
                x["saved"][has] += np.add.reduceat(below["saved"], begin)
                under[has] = np.add.reduceat(below["n"], begin)
            x["leaves"][x["children"] == 0] = 1
            x["ending"] = n - under
            edges = np.stack([first, first + n], axis=1).ravel()
            x["conv"] = np.minimum.reduceat(np.append(self.convs, np.iinfo(np.int64).max), edges)[::2]
            below = x
        self.levels[0]["parent"] = np.zeros(1, dtype=np.int64)

    def ending(self, d: int, i: int) -> np.ndarray:
        """Conversations that end at a node, ascending: they stand before those that go on."""
        first = self.levels[d]["first"][i]
        return self.convs[first : first + self.levels[d]["ending"][i]]


def keys_of(path: bytes) -> list[bytes]:
    """A key for each depth: the hash of the path so far."""
    chain = hashlib.md5(b"")
    keys = [chain.digest()]
    for at in range(0, len(path), 16):
        chain.update(path[at : at + 16])
        keys.append(chain.digest())
    return keys


def _listed(convs: np.ndarray) -> bytes:
    return ",".join(map(str, convs.tolist())).encode()


def shard_rows(shard: int, convs: np.ndarray, paths: list[bytes], lengths: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole nodes ("child" below a part, else "node"), parts of those that may go on in a neighbour, pieces of their ends, and the shard's two ends."""
    x = Shard(convs, paths, lengths, bounds)
    ends = [int(x.order[0]), int(x.order[-1])]
    keys = [keys_of(paths[i]) for i in ends]

    def batch(n: int, **columns: object) -> pa.RecordBatch:
        filled = columns | {"shard": np.full(n, shard)}
        return pa.RecordBatch.from_arrays([pa.array(filled[k], kind) if k in filled else pa.nulls(n, kind) for k, kind in _KINDS.items()], names=list(_KINDS))

    def open_at(d: int) -> dict[int, bytes]:
        """Nodes of a depth on the path of the first row (the first node) or the last one (the last node)."""
        return {i: k[d] for i, k in ((0, keys[0]), (len(x.levels[d]["first"]) - 1, keys[1]) if d < len(x.levels) else (0, [])) if len(k) > d}

    yield batch(2, kind=["first", "last"], content=[paths[i] for i in ends], lengths=[lengths[bounds[i] : bounds[i + 1]] for i in ends])
    above: dict[int, bytes] = {}
    for d, level in enumerate(x.levels):
        open_, n = open_at(d), len(level["first"])
        up = np.full(n, None, dtype=object)
        for i, key in above.items():
            up[level["parent"] == i] = key
        sha = np.full(n, EMPTY_SHA, dtype=object)
        for i in np.flatnonzero(level["ending"]).tolist():
            if i not in open_:
                sha[i] = hashlib.sha256(_listed(x.ending(d, i))).hexdigest()
                continue
            ending = x.ending(d, i)
            places = range(0, len(ending), PIECE)
            yield batch(len(places), kind=["piece"] * len(places), key=[open_[i]] * len(places), place=list(places), content=[_listed(ending[at : at + PIECE]) for at in places])
        kind, key = np.where(np.equal(up, None), "node", "child").astype(object), np.full(n, None, dtype=object)
        for i in open_:
            kind[i], key[i] = "part", open_[i]
        parent = x.levels[d - 1]["conv"][level["parent"]] if d else np.zeros(n, dtype=np.int64)
        known = kind == "node"
        yield batch(
            n, kind=kind, key=key, parent_key=up, depth=np.full(n, d), conv_id=level["conv"], parent_conv_id=pa.array(parent, mask=~known), n_convs=level["n"],
            n_children=level["children"], n_leaves=level["leaves"], saved_tokens=level["saved"], ends_sha256=sha,
        )
        above = open_


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """The rows of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        held = pa.Table.from_batches(some)
        lengths = pa.concat_arrays(held["lengths"].chunks)
        bounds = np.concatenate([[0], np.cumsum(lengths.value_lengths().to_numpy())])
        yield from shard_rows(TaskContext.get().partitionId(), held["conv_id"].to_numpy(), held["path"].to_pylist(), lengths.flatten().to_numpy(), bounds)

    return rows.select("conv_id", "path", "lengths").repartitionByRange(shards, "path", "conv_id").mapInArrow(run, _SCHEMA)


def counted_twice(found: DataFrame) -> DataFrame:
    """For the common nodes of the last row of a shard and the first of the next: what to add to the sums of their parts."""
    last = found.where("kind = 'last'").select("shard", F.col("content").alias("a"), "lengths")
    first = found.where("kind = 'first'").select((F.col("shard") - 1).alias("shard"), F.col("content").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, lengths, b in zip(*(batch.column(c).to_pylist() for c in ("a", "lengths", "b"))):
                most = min(len(a), len(b)) // 16
                same = (np.frombuffer(a, dtype=np.uint64)[: 2 * most] == np.frombuffer(b, dtype=np.uint64)[: 2 * most]).reshape(-1, 2).all(axis=1)
                common = int(np.argmin(same)) if not same.all() else most
                rest = np.cumsum(np.array([0, *lengths[:common]], dtype=np.int64)[::-1])[::-1]
                out = {
                    "key": pa.array(keys_of(a[: 16 * common]), pa.binary()), "n_children": np.append(np.full(common, -1), 0),
                    "n_leaves": np.full(common + 1, -1 if 16 * common == len(a) else 0), "saved_tokens": rest,
                }
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))

    return last.join(first, "shard").mapInArrow(run, "key binary, n_children bigint, n_leaves bigint, saved_tokens bigint")


def hashed_pieces(pieces: DataFrame) -> DataFrame:
    """key, sha: the pieces of each node one after another, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "sha": [state.hexdigest()]})
                    key, state = k, hashlib.sha256()
                state.update(content)
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "sha": [state.hexdigest()]})

    ordered = pieces.select("key", "shard", "place", "content").repartition("key").sortWithinPartitions("key", "shard", "place")
    return ordered.select("key", "content").mapInArrow(run, "key binary, sha string")


def trie(conversations: DataFrame, shards: int | None = None, family: int = 100, longest: int = 6) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    rows = written(rebuilt(conversations, family, longest), "trie-rows")
    if shards is None:
        turns = rows.agg(F.sum(F.size("lengths")).alias("n")).first()["n"] or 0
        shards = max(1, min(turns >> 12, 256), turns // SHARD_TURNS)
    found = written(sharded(rows, shards), "trie-nodes")
    sides = found.where("kind = 'first'").agg(F.count(F.lit(1)).alias("n"), F.max("shard").alias("last")).first()
    if sides["n"] and sides["n"] != sides["last"] + 1:
        raise RuntimeError("a range between others is empty, so the neighbours of its neighbours are not known")

    parts = found.where("kind = 'part'")
    twice = counted_twice(found).select("key", F.lit(None).alias("parent_key"), F.lit(None).alias("depth"), F.lit(None).alias("conv_id"), F.lit(0).alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    sums = parts.select(twice.columns).unionByName(twice).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in NODE[3:7])
    )
    whole = written(sums.join(hashed_pieces(found.where("kind = 'piece'")), "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA))), "trie-parts")
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    joined = whole.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("parent")).select(NODE)
    # by shard, so that no parent has more children in one group than a shard has nodes
    here = parts.select("shard", F.col("key").alias("parent_key")).join(parents, "parent_key")
    children = found.where("kind = 'child'").drop("parent_conv_id").join(here, ["shard", "parent_key"]).withColumnRenamed("parent", "parent_conv_id").select(NODE)
    return found.where("kind = 'node'").select(NODE).unionByName(children).unionByName(joined)
