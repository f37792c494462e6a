"""Operator 12: the trie of conversation prefixes, in tables under minimal perfect hashes.

Turns are sorted and numbered over ranges, so that a conversation of any length is spread over
tasks. A prefix has a digest of 128 bits, the exclusive or of its turns' digests with their places;
it is a running sum, so conversations are cut into pieces of ``piece`` turns that start from the
digest before them. A shard is a set of pieces. It enumerates its distinct prefix digests, gives each
a slot by a minimal perfect hash (levels of a bit array that keep what has a place alone), verifies
digest, depth, parent and length of every row against its slot, and scatters counts into flat arrays.
Rows of equal prefixes in several shards are then summed by digest.

Sums over subtrees: a node's own value belongs to its smallest member, on whose path all nodes above
it lie. So every node's value goes to one slot of one shard, the one that holds its smallest member;
what lies on later pieces of that member's path is handed to the last slot of each earlier piece.
Every shard accumulates through its parent slots from the deepest nodes up, and the shards' sums are
added by digest. No subtree, prefix or conversation has to fit into one task.

The hash of the ids that end at a node is sequential: ids are sorted over ranges and joined there,
and one task hashes a node's parts as a stream.

Cases: rows without conversation take no part. Null roles and texts are empty. Turns of one number
are ordered by role, then text; repeated rows are repeated turns. Null turn numbers come first. The
remainder of a negative id has its sign. Other columns are ignored. An empty table has no members
and gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costdocs.llm.common import staged

NODES = """kind int, shard long, slot int, parent_slot int, depth long, key1 long, key2 long, parent1 long, parent2 long,
 bytes long, n long, conv_id long, open boolean"""
NODE, END, OPEN_PIECE = 0, 1, 2
SUMS = "key1 long, key2 long, saved_tokens long, n_leaves long"
ENDS = "key1 long, key2 long, first long, ids string"
HASHES = "key1 long, key2 long, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()
HEAVY, SALTS = 10_000, 32  # children of one node that are joined with it in one task; tasks that share more


@dataclass(frozen=True)
class Shards:
    """Turns of a conversation that stay together, and rows that a shard has on average."""

    piece: int = 4096
    rows: int = 200_000


# ---- turns -------------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, content, bytes) and spans (conv_id, part, before).

    The number of a turn, from 1, is ``at + before`` of its conversation and part; parts are ranges of
    the order, so a span says what is in earlier ones.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    order = ["conv_id", F.col("turn").asc_nulls_first()]
    # Beginnings are enough for the ranges: they bound what is sampled, and the order within a range is whole.
    ranged = rows.repartitionByRange(*order, F.left("role", F.lit(32)), F.left("text", F.lit(96))).sortWithinPartitions(*order, "role", "text")
    content = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    placed = ranged.select("conv_id", content.alias("content"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("place"))
    turns = staged(placed, "turns").withColumn("part", F.shiftright("place", 33))
    spans = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("conv_id", "part", "n", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1 - F.col("first")).alias("before"))
    return turns.withColumnRenamed("place", "at"), staged(spans, "spans")


def rebuilt(conversations: DataFrame, family: int = 5, folds: int = 9) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, depth, content, bytes, size) and conversations (conv_id, size).

    A conversation begins with the first turns of its family's first member and goes on with its own;
    their number comes from the CRC-32 of its id.
    """
    turns, spans = numbered(conversations)
    lengths = spans.groupBy("conv_id").agg(F.sum("n").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds
    convs = lengths.withColumns({"base": base, "h": heads})
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = staged(convs.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    told = turns.join(spans.select("conv_id", "part", "before").join(convs.select("conv_id", "h", "taken", "size"), "conv_id"), ["conv_id", "part"])
    told = told.withColumn("number", F.col("at") + F.col("before"))
    columns = ["content", "bytes", "size"]
    own = told.where("number > h").select("conv_id", (F.col("taken") + F.col("number") - F.col("h")).alias("depth"), *columns)
    first = told.where(F.col("number") < folds).select(F.col("conv_id").alias("base"), F.col("number").alias("depth"), "content", "bytes")
    borrowed = convs.select("conv_id", "base", "taken", "size").join(first, "base").where("depth <= taken").select("conv_id", "depth", *columns)
    return staged(own.unionByName(borrowed), "sequences"), convs.select("conv_id", "size")


# ---- shards ------------------------------------------------------------------------------


def _mixed(key1: np.ndarray, key2: np.ndarray, level: int) -> np.ndarray:
    x = key1 ^ (key2 * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A slot of ``0 … n - 1`` for each of n distinct keys of 128 bits; -1 for any other key."""

    def __init__(self, key1: np.ndarray, key2: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (whether a key alone is here, slots before)
        self.key1, self.key2 = np.zeros(len(key1), np.uint64), np.zeros(len(key1), np.uint64)
        rest, placed = np.arange(len(key1)), 0
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("the keys are not distinct")
            place = _mixed(key1[rest], key2[rest], len(self.levels)) % np.uint64(2 * len(rest))
            alone = np.bincount(place.astype(np.int64), minlength=2 * len(rest)) == 1
            self.levels.append((alone, placed + np.cumsum(alone) - alone))
            placed += int(alone.sum())
            rest = rest[~alone[place.astype(np.int64)]]
        slot = self._slots(key1, key2)
        self.key1[slot], self.key2[slot] = key1, key2
        if np.any(self.slots(key1, key2) != slot):
            raise ValueError("two keys have one slot")

    def __len__(self) -> int:
        return len(self.key1)

    def _slots(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(key1), -1, np.int64), np.arange(len(key1))
        for level, (alone, before) in enumerate(self.levels):
            place = (_mixed(key1[rest], key2[rest], level) % np.uint64(len(alone))).astype(np.int64)
            here = alone[place]
            out[rest[here]] = before[place[here]]
            rest = rest[~here]
        return out

    def slots(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        slot = self._slots(key1, key2)
        known = (slot >= 0) & (self.key1[slot] == key1) & (self.key2[slot] == key2) if len(self) else np.zeros(len(slot), bool)
        return np.where(known, slot, -1)


def _distinct(key1: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key2, key1))
    a, b = key1[order], key2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _prefixes(values: np.ndarray, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Running exclusive or within runs that begin at ``starts``."""
    running = np.bitwise_xor.accumulate(values)
    return running ^ np.concatenate([np.zeros(1, values.dtype), running])[starts][of]


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def node_table(shard: int, conv: np.ndarray, depth: np.ndarray, y1: np.ndarray, y2: np.ndarray, size_bytes: np.ndarray, size: np.ndarray, anchor: np.ndarray, piece: int) -> pa.Table:
    """A shard's nodes, the conversations that end there, and the pieces that others follow.

    Rows are the turns of pieces; every piece begins with an anchor row, which carries the digest before
    it. That of a first piece is the root, which is a node here; other anchors are nodes of other shards.
    """
    # An anchor has the depth of the turn before it, which may be here too: the turn comes first.
    order = np.lexsort((anchor, depth, conv))
    conv, depth, y1, y2, size_bytes, size, anchor = (x[order] for x in (conv, depth, y1, y2, size_bytes, size, anchor))
    starts = np.flatnonzero(anchor)
    of = np.cumsum(anchor) - 1
    key1, key2 = _prefixes(y1, starts, of), _prefixes(y2, starts, of)
    counted = ~anchor | (depth == 0)
    table = PerfectHash(*_distinct(key1[counted], key2[counted]))
    slot = np.where(counted, table.slots(key1, key2), -1)
    above = np.concatenate([np.full(1, -1), slot[:-1]])
    above[anchor] = -1
    parent1, parent2 = (np.concatenate([np.zeros(1, k.dtype), k[:-1]]) for k in (key1, key2))
    parent1[anchor], parent2[anchor] = 0, 0
    count = len(table)
    at = slot[counted]
    columns = {"depth": depth, "bytes": size_bytes, "parent1": parent1, "parent2": parent2, "parent_slot": above}
    flat = {}
    for name, values in columns.items():
        flat[name] = np.zeros(count, values.dtype)
        flat[name][at] = values[counted]
        if np.any(flat[name][at] != values[counted]):
            raise ValueError(f"two prefixes with one digest: {name}")
    smallest, longest = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)
    np.minimum.at(smallest, at, conv[counted])
    np.maximum.at(longest, at, size[counted])
    ends = np.flatnonzero(counted & (depth == size))
    followed = np.flatnonzero(~anchor & (depth % piece == 0) & (depth < size))
    rows = count + len(ends) + len(followed)
    blank = lambda n: np.zeros(n, np.int64)
    joined = lambda a, b, c: pa.array(np.concatenate([a, b, c]).astype(np.int64))
    none = blank(len(ends))
    slots = joined(np.arange(count), none, slot[followed]).cast(pa.int32())
    return pa.table(
        {
            "kind": pa.array(np.repeat([NODE, END, OPEN_PIECE], [count, len(ends), len(followed)]), pa.int32()),
            "shard": pa.array(np.full(rows, shard, np.int64)),
            "slot": slots,
            "parent_slot": joined(flat["parent_slot"], none, blank(len(followed))).cast(pa.int32()),
            "depth": joined(flat["depth"], depth[ends], depth[followed]),
            "key1": _as_long(np.concatenate([table.key1, key1[ends], key1[followed]])),
            "key2": _as_long(np.concatenate([table.key2, key2[ends], key2[followed]])),
            "parent1": _as_long(np.concatenate([flat["parent1"], parent1[ends], parent1[followed]])),
            "parent2": _as_long(np.concatenate([flat["parent2"], parent2[ends], parent2[followed]])),
            "bytes": joined(flat["bytes"], none, blank(len(followed))),
            "n": joined(np.bincount(at, minlength=count), none, blank(len(followed))),
            "conv_id": joined(smallest, conv[ends], conv[followed]),
            "open": pa.array(np.concatenate([longest > flat["depth"], none > 0, blank(len(followed)) > 0])),
        }
    )


def _shard_nodes(piece: int):
    def nodes(group: pa.Table) -> pa.Table:
        c = {name: group[name].to_numpy() for name in group.column_names}
        return node_table(
            int(c["shard"][0]), c["conv_id"], c["depth"], c["y1"].astype(np.int64).view(np.uint64), c["y2"].astype(np.int64).view(np.uint64),
            c["bytes"], c["size"], np.asarray(c["anchor"], bool), piece,
        )

    return nodes


def _accumulated(nodes: pa.Table, values: pa.Table) -> pa.Table:
    """A shard's sums over the subtrees within it, from the deepest nodes up."""
    slot, parent, depth = (np.asarray(nodes[c].to_numpy(), np.int64) for c in ("slot", "parent_slot", "depth"))
    count = len(slot)
    sums = {name: np.zeros(count, np.int64) for name in ("saved_tokens", "n_leaves")}
    above, level = np.full(count, -1, np.int64), np.zeros(count, np.int64)
    above[slot], level[slot] = parent, depth
    for name, array in sums.items():
        np.add.at(array, values["slot"].to_numpy(), values[name].to_numpy())
    order = np.argsort(-level, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if count else ():
        same = same[above[same] >= 0]
        for array in sums.values():
            np.add.at(array, above[same], array[same])
    some = np.flatnonzero((sums["saved_tokens"] != 0) | (sums["n_leaves"] != 0))
    row = np.zeros(count, np.int64)
    row[slot] = np.arange(count)
    picked = pa.array(row[some])
    return pa.table({"key1": nodes["key1"].take(picked), "key2": nodes["key2"].take(picked), **{n: pa.array(a[some]) for n, a in sums.items()}})


# ---- hashes of ids -----------------------------------------------------------------------


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows to one text of ids per key and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key1, key2, conv = (batch.column(c).to_numpy() for c in ("key1", "key2", "conv_id"))
        new = np.ones(len(conv), bool)
        new[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
        starts = np.flatnonzero(new)
        texts = list(map(str, conv.tolist()))
        ends = np.append(starts[1:], len(conv)).tolist()
        ids = [",".join(texts[a:b]) for a, b in zip(starts.tolist(), ends)]
        yield pa.RecordBatch.from_arrays([pa.array(key1[starts]), pa.array(key2[starts]), pa.array(conv[starts]), pa.array(ids, pa.string())], names=["key1", "key2", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of sorted (key, first id, ids) rows to one hash per key."""
    key, digest = None, None

    def rows(found: list) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["key1", "key2", "ends_sha256"])

    for batch in batches:
        found = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "ids"))):
            if (a, b) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                found.append((*key, digest.hexdigest()))
            key, digest = (a, b), hashlib.sha256(ids.encode())
        yield rows(found)
    if key is not None:
        yield rows([(*key, digest.hexdigest())])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key1, key2, ends_sha256) of the ascending, comma-joined ids of every key."""
    key = ["key1", "key2"]
    sorted_ids = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    parts = sorted_ids.mapInArrow(_joined_ids, ENDS)
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashed_ids, HASHES)


# ---- the trie ----------------------------------------------------------------------------


def _pieces(sequences: DataFrame, convs: DataFrame, shards: Shards) -> DataFrame:
    """Turns and anchors with the shard of their piece."""
    block = F.floor((F.col("depth") - 1) / shards.piece).cast("long")
    lane1, lane2 = F.xxhash64("content", "depth"), F.xxhash64("depth", "content")
    turns = sequences.select("conv_id", "depth", lane1.alias("y1"), lane2.alias("y2"), "bytes", "size", F.lit(False).alias("anchor"), block.alias("block"))
    long_ones = turns.where(F.col("size") > shards.piece).groupBy("conv_id", "size", "block").agg(F.bit_xor("y1").alias("y1"), F.bit_xor("y2").alias("y2"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = long_ones.withColumns({y: F.bit_xor(y).over(earlier) for y in ("y1", "y2")}).where("block > 0")
    zero = F.lit(0).cast("long")
    later = carried.select("conv_id", (F.col("block") * shards.piece).alias("depth"), "y1", "y2", zero.alias("bytes"), "size", F.lit(True).alias("anchor"), "block")
    roots = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "y1", "y2", "bytes")], "size", F.lit(True).alias("anchor"), zero.alias("block"))
    rows = turns.unionByName(later).unionByName(roots)
    n = max(1, -(-(sequences.count() + convs.count()) // shards.rows))
    return rows.withColumn("shard", F.pmod(F.xxhash64(F.shiftright("conv_id", 6), "block"), F.lit(n)))


def _one(column: str) -> Column:
    """A column that all rows of a digest must share."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.raise_error(F.lit(f"two prefixes with one digest: {column}"))).alias(column)


def prefix_trie(sequences: DataFrame, convs: DataFrame, shards: Shards = Shards()) -> DataFrame:
    """One row per distinct prefix of the sequences, the root included.

    ``sequences`` has (conv_id, depth from 1, content, bytes, size), ``convs`` every (conv_id, size).
    """
    key, parent = ["key1", "key2"], ["parent1", "parent2"]
    pieces = _pieces(sequences, convs, shards)
    local = staged(pieces.groupBy("shard").applyInArrow(_shard_nodes(shards.piece), NODES), "shard-nodes")
    home = F.min(F.struct("conv_id", "shard", "slot")).alias("home")
    same = [_one(c) for c in ("depth", "bytes", *parent)]
    nodes = local.where(F.col("kind") == NODE).groupBy(*key).agg(home, F.sum("n").alias("n_convs"), F.max("open").alias("open"), *same)
    nodes = staged(nodes.select(*key, "home.*", "n_convs", "open", "depth", "bytes", *parent), "nodes")

    block = F.floor((F.col("depth") - 1) / shards.piece).cast("long")
    own = {"saved_tokens": (F.col("n_convs") - 1) * F.col("bytes"), "n_leaves": F.when(F.col("open"), 0).otherwise(1).cast("long")}
    valued = nodes.withColumns({**own, "block": block}).where("saved_tokens <> 0 or n_leaves <> 0")
    names = list(own)
    deep = valued.where(F.col("block") > 0).groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in names])
    deep = deep.select("conv_id", "block", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("int").alias("slot"), *names)
    followed = local.where(F.col("kind") == OPEN_PIECE).select("conv_id", block.alias("block"), "shard", "slot", *[F.lit(0).cast("long").alias(c) for c in names])
    later = W.partitionBy("conv_id").orderBy(-F.col("block")).rangeBetween(W.unboundedPreceding, -1)
    handed = deep.unionByName(followed).withColumns({c: F.sum(c).over(later) for c in names}).where("shard is not null")
    values = valued.select("shard", "slot", *names).unionByName(handed.select("shard", "slot", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]))
    columns = local.where(F.col("kind") == NODE).select("shard", "slot", "parent_slot", "depth", *key)
    sums = columns.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(_accumulated, SUMS)
    sums = sums.groupBy(*key).agg(*[F.sum(c).alias(c) for c in names])

    children = nodes.where("depth > 0").groupBy(*[F.col(p).alias(k) for p, k in zip(parent, key)]).agg(F.count("*").alias("n_children"))
    children = staged(children, "children")
    hashes = end_hashes(local.where(F.col("kind") == END))
    found = _with_parents(nodes, children).join(children, key, "left").join(sums, key, "left").join(hashes, key, "left")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", *zeros, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def _with_parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Nodes with their parent's smallest member. A parent of very many children meets them in many tasks."""
    key, parent = ["key1", "key2"], ["parent1", "parent2"]
    is_child = F.col("depth") > 0
    rows = nodes.withColumns({"salt": F.pmod("key1", F.lit(SALTS)), **{f"_{p}": F.when(is_child, F.col(p)) for p in parent}})
    heavy = nodes.join(children.where(F.col("n_children") > HEAVY).select(*key), key, "left_semi")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    heavy = heavy.select(*[F.col(k).alias(f"_{p}") for k, p in zip(key, parent)], F.col("conv_id").alias("by_heavy"), salts)
    rows = rows.join(heavy, ["_parent1", "_parent2", "salt"], "left")
    # What is found already asks for itself, so that it does not crowd at its parent.
    asks = {f"_{p}": F.when(F.col("by_heavy").isNull(), F.col(f"_{p}")).otherwise(F.col(k)) for p, k in zip(parent, key)}
    others = nodes.select(*[F.col(k).alias(f"_{p}") for k, p in zip(key, parent)], F.col("conv_id").alias("by_key"))
    found = rows.withColumns(asks).join(others, ["_parent1", "_parent2"], "left")
    return found.withColumn("parent_conv_id", F.coalesce("by_heavy", "by_key")).select(*nodes.columns, "parent_conv_id")


def conversation_trie(conversations: DataFrame, shards: Shards = Shards()) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(conversations), shards)


# The CRC-32 of a text of ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
 lambda crc, x: list_reduce(range(9), lambda r, i: CASE WHEN i = 0 THEN r WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END,
 xor(crc, x)), 4294967295))"""

ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, h, coalesce(list(struct_pack(role, text) ORDER BY j) FILTER (j <= h), []) AS head FROM c LEFT JOIN t ON t.conv_id = c.base GROUP BY ALL),
o AS (SELECT b.conv_id, head, coalesce(list(struct_pack(role, text) ORDER BY j) FILTER (j > h), []) AS tail FROM b JOIN t USING (conv_id) GROUP BY ALL),
s AS (SELECT conv_id, list_concat(head, tail) AS turns FROM o),
m AS (SELECT conv_id, d AS depth, len(turns) AS size, sha256(CAST(to_json(turns[:d]) AS VARCHAR)) AS k,
  CASE WHEN d > 0 THEN sha256(CAST(to_json(turns[:d - 1]) AS VARCHAR)) END AS above, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM s)),
n AS (SELECT k, any_value(above) AS above, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, max(size) > depth AS open,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY k, depth),
u AS (SELECT v.k, sum(w.bytes * (w.n_convs - 1)) AS saved, count(*) FILTER (NOT w.open) AS leaves FROM n w JOIN m v ON v.conv_id = w.conv_id AND v.depth <= w.depth GROUP BY v.k),
i AS (SELECT above, count(*) AS n_children FROM n GROUP BY above)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(i.n_children, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
 CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256 FROM n LEFT JOIN n p ON p.k = n.above LEFT JOIN i ON i.above = n.k JOIN u ON u.k = n.k
"""
