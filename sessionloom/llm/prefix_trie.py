"""Conversation prefix trie: how much of a set of conversations is shared, node by node.

Every prefix of a conversation has a 128-bit digest, a running sum over its turns of digests of (place, role, text), so that long
conversations can be numbered and summed in bounded pieces. Distinct digests are the nodes, each with its members and the
smallest of them, its owner. A conversation owns a run of nodes at the end of its path, so the nodes and the paths above
them are cut into pieces that are dealt to shards; each shard has a minimal-perfect-hash table of its digests and flat
arrays by slot, into which counts are scattered and then added to the parents' slots, the deepest first. Nodes that several
shards share are summed at the end, so no subtree, however large, has to lie in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import parts_for, written

#: Turns of a piece of a path, and conversations whose pieces always go to one shard.
PIECE, NEIGHBOURS = 4096, 100
#: Rows of a shard, about.
SHARD_ROWS = 1 << 18
#: Bytes of a chunk of member ids.
CHUNK_BYTES = 1 << 16
#: First turns at most that a conversation takes over.
TAKEN = 5

KEY = ["k1", "k2"]
SUMS = ["s1", "s2", "s3", "s4"]


class SlotTable:
    """A minimal perfect hash over distinct 128-bit keys: n keys have the slots 0 to n - 1.

    Level by level, the keys that are alone in their place of a bit array are settled and the others go on; a key's slot is
    the rank of its bit. The keys are kept by slot, and every look-up is compared with them.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels, left, settled = [], np.arange(len(k1)), 0
        slot = np.zeros(len(k1), np.int64)
        while len(left):
            size = max(1, len(left) * 3 // 2)
            at = self._place(k1[left], k2[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = settled + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            ok = alone[at]
            slot[left[ok]] = rank[at[ok]]
            settled, left = settled + int(ok.sum()), left[~ok]
            if len(self.levels) > 200:
                raise ValueError("the keys of a slot table have to be distinct")
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        self.k1[slot], self.k2[slot] = k1, k2

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        h = (k1 ^ (k2 >> np.uint64(7))) + k2 * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.k1)

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slots of keys; ValueError if one of them is none of the table's."""
        out, left = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place(k1[left], k2[left], level, size)
            ok = alone[at]
            out[left[ok]] = rank[at[ok]]
            left = left[~ok]
        if len(left) or not (np.array_equal(self.k1[out], k1) and np.array_equal(self.k2[out], k2)):
            raise ValueError("a key is not in the slot table")
        return out


def _number(rows: DataFrame) -> DataFrame:
    """(conv, pos, what, chars): the turns, numbered from 0 in each conversation; what is a digest of role and text.

    Rows are range-partitioned by conversation and order, so that the turns of a very long one lie in several
    partitions; a number is the place in its partition's share of the conversation, plus what the shares before it have.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    order = ["conv", "turn", "role", "text"]
    base = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    dealt = base.repartitionByRange(parts_for(base), *order).sortWithinPartitions(*order)
    what = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = written(
        dealt.select("conv", F.spark_partition_id().alias("share"), F.monotonically_increasing_id().alias("id"), what.alias("what"), F.length("text").cast("long").alias("chars")),
        "turns",
    )
    local = F.row_number().over(Window.partitionBy("conv", "share").orderBy("id")) - 1
    shares = rows.groupBy("conv", "share").agg(F.count("*").alias("n"))
    of_conv = Window.partitionBy("conv").orderBy("share")
    before = shares.withColumn("before", F.coalesce(F.sum("n").over(of_conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most one share of a partition goes on from the partition before
    before = before.filter("before > 0").select("conv", "share", "before")
    return rows.withColumn("local", local).join(before, ["conv", "share"], "left").select(
        "conv", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "what", "chars"
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conv, depth (from 1), what, chars of all rebuilt conversations; conv and length of each, turnless ones too."""
    own = written(_number(conversations), "numbered")
    base = F.col("conv") - F.col("conv") % 100
    taken = F.crc32(F.col("conv").cast("string")) % (TAKEN + 1)
    sizes = own.groupBy("conv").agg(F.count("*").alias("own_length")).withColumns({"base": base, "taken": taken})
    donors = own.filter((F.col("conv") % 100 == 0) & (F.col("pos") < TAKEN)).withColumnRenamed("conv", "base")
    have = donors.groupBy("base").agg(F.count("*").alias("have"))
    sizes = sizes.join(have, "base", "left").withColumn("first", F.least("taken", F.coalesce("have", F.lit(0))))
    lengths = written(sizes.withColumn("length", F.col("first") + F.greatest(F.col("own_length") - F.col("taken"), F.lit(0))), "lengths")
    heads = lengths.filter("first > 0").select("conv", "base", "first").join(donors, "base").filter("pos < first")
    tails = own.join(lengths.select("conv", "taken", "first"), "conv").filter("pos >= taken")
    turns = heads.select("conv", (F.col("pos") + 1).alias("depth"), "what", "chars").unionByName(
        tails.select("conv", (F.col("first") + F.col("pos") - F.col("taken") + 1).alias("depth"), "what", "chars")
    )
    return turns, lengths.select("conv", "length")


def _prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, last) of every prefix, the empty one too; p is the prefix one turn shorter."""
    half = lambda h, i: F.shiftrightunsigned(h, 32) if i else h.bitwiseAND(0xFFFFFFFF)
    lanes = [half(F.xxhash64(F.lit(seed), "depth", "what"), i) for seed in (1, 2) for i in (0, 1)]
    rows = turns.select("conv", "depth", F.floor(F.col("depth") / PIECE).alias("piece"), "chars", *[x.alias(f"a{i}") for i, x in enumerate(lanes, 1)])
    each = [f"a{i}" for i in range(1, 5)]
    inside = Window.partitionBy("conv", "piece").orderBy("depth")
    rows = rows.withColumns({s: F.sum(a).over(inside) for s, a in zip(SUMS, each)})
    # a piece goes on with the sums of the pieces before it; conversations of one piece have nothing to add
    sums = turns.filter(F.col("depth") >= PIECE).select("conv").distinct()
    pieces = rows.join(sums, "conv", "left_semi").groupBy("conv", "piece").agg(*[F.sum(a).alias(a) for a in each])
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select("conv", "piece", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"b{i}") for i, a in enumerate(each, 1)])
    rows = rows.join(carry.filter("piece > 0"), ["conv", "piece"], "left")
    whole = {s: F.col(s) + F.coalesce(f"b{i}", F.lit(0)) for i, s in enumerate(SUMS, 1)}
    rows = rows.withColumns(whole).join(lengths, "conv")
    joined = lambda x, y: F.shiftleft(x.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(y.bitwiseAND(0xFFFFFFFF))
    now, was = [F.col(s) for s in SUMS], [F.col(s) - F.col(a) for s, a in zip(SUMS, each)]
    full = rows.select(
        "conv", "depth", joined(*now[:2]).alias("k1"), joined(*now[2:]).alias("k2"), joined(*was[:2]).alias("p1"), joined(*was[2:]).alias("p2"), "chars",
        (F.col("depth") == F.col("length")).alias("last"),
    )
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv", zero.alias("depth"), *[zero.alias(k) for k in ("k1", "k2", "p1", "p2", "chars")], (F.col("length") == 0).alias("last"))
    return full.unionByName(roots)


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of member ids of a node, as texts of a bounded size; rows come sorted by node and id."""
    out: list[tuple] = []
    key, first, ids, size = None, 0, [], 0

    def close() -> None:
        if ids:
            out.append((*key, first, ",".join(ids)))

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*KEY, "first", "ids"])

    for batch in batches:
        for k1, k2, conv in zip(*(batch[c].to_pylist() for c in (*KEY, "conv"))):
            if (k1, k2) != key or size > CHUNK_BYTES:
                close()
                key, first, ids, size = (k1, k2), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) > 4096:
            yield rows()
    close()
    if out:
        yield rows()


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, joined; chunks come sorted by node and first id, and only one is in memory at a time."""
    key, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        for k1, k2, ids in zip(*(batch[c].to_pylist() for c in (*KEY, "ids"))):
            if (k1, k2) == key:
                state.update(b",")
            else:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if len(out) > 4096:
            yield rows()
    if state:
        out.append((*key, state.hexdigest()))
    if out:
        yield rows()


def end_digests(prefixes: DataFrame, parts: int) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end.

    Ids become chunks of text where they lie; what has to be read in order by one task, a digest being sequential, is a node's chunks, as a stream.
    """
    ends = prefixes.filter("last").select(*KEY, "conv")
    sorted_ids = ends.repartitionByRange(parts, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
    chunks = written(sorted_ids.mapInArrow(_id_chunks, "k1 long, k2 long, first long, ids string"), "ids")
    return chunks.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_chunk_digests, "k1 long, k2 long, ends_sha256 string")


def _accumulated(table: pa.Table) -> pa.Table:
    """A shard's (k1, k2, n_children, n_leaves, saved): its own rows and what lies below them in its pieces."""
    column = {c: table[c].to_numpy() for c in table.column_names if c not in ("owned", "top")}
    owned, top = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("owned", "top"))
    k1, k2, p1, p2 = (column[c].view(np.uint64) for c in ("k1", "k2", "p1", "p2"))
    # a piece's first row has its parent in another piece, which only learns of its child here
    keys = np.unique(np.rec.fromarrays([np.concatenate([k1, p1[top]]), np.concatenate([k2, p2[top]])], names="a,b"))
    nodes = SlotTable(np.ascontiguousarray(keys["a"]), np.ascontiguousarray(keys["b"]))
    slot, above = nodes.slots(k1, k2), np.full(len(k1), -1, np.int64)
    deep = column["depth"] > 0
    known = deep & ~top
    above[known] = nodes.slots(p1[known], p2[known])
    above[top] = nodes.slots(p1[top], p2[top])
    children, leaves, saved = (np.zeros(len(nodes), np.int64) for _ in range(3))
    np.add.at(children, above[owned & deep], 1)
    np.add.at(leaves, slot, column["leaf"])
    np.add.at(saved, slot, column["worth"])
    parent, depth = np.full(len(nodes), -1, np.int64), np.full(len(nodes), -1, np.int64)
    parent[slot[known]], depth[slot] = above[known], column["depth"]
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    return pa.table({"k1": nodes.k1.view(np.int64), "k2": nodes.k2.view(np.int64), "n_children": children, "n_leaves": leaves, "saved": saved})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations(conv_id, turn, role, text, ...).

    A conversation's turns are ordered by turn (null first), rows of one turn by role and text. It is rebuilt: up to TAKEN first turns
    (the CRC-32 of its id decides) come from the conversation of its hundred, its own follow after as many. Result: conv_id (the node's
    smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: members beyond the first, times code points of the last text), ends_sha256 (ids of the members that end here).

    A null role or text is an empty one; rows without a conv_id belong to no conversation. Repeated rows are turns of
    their own. Other columns take no part. An empty table gives no node, not even a root.
    """
    prefixes = written(_prefixes(*rebuilt_turns(conversations)), "prefixes")
    parts = parts_for(prefixes)
    nodes = prefixes.groupBy("depth", *KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    nodes = written(nodes, "nodes")

    # a conversation owns its deepest nodes: those from `since` on; the rows above are the way to the root
    owners = nodes.groupBy("conv").agg(F.min("depth").alias("since"))
    way = prefixes.select("conv", "depth", *KEY, "p1", "p2").join(owners, "conv").filter("depth < since")
    way = written(way, "ways")
    leaf, worth = (F.col("n_ends") == F.col("n_convs")).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    mine = nodes.select("conv", "depth", *KEY, "p1", "p2", F.lit(True).alias("owned"), leaf.alias("leaf"), worth.alias("worth"))
    zero = F.lit(0).cast("long")
    rows = mine.unionByName(way.select("conv", "depth", *KEY, "p1", "p2", F.lit(False).alias("owned"), zero.alias("leaf"), zero.alias("worth")))
    piece = F.floor(F.col("depth") / PIECE)
    rows = rows.withColumn("piece", piece)

    # what the deeper pieces of a long path hold is added to the last row of each piece above them
    long = nodes.filter(F.col("depth") >= PIECE).select("conv").distinct()
    held = rows.select("conv", "piece", "leaf", "worth").join(long, "conv", "left_semi").groupBy("conv", "piece").agg(F.sum("leaf").alias("leaf"), F.sum("worth").alias("worth"))
    deeper = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    carry = held.select("conv", ((F.col("piece") + 1) * PIECE - 1).alias("depth"), F.sum("leaf").over(deeper).alias("leaf_below"), F.sum("worth").over(deeper).alias("worth_below"))
    rows = rows.join(carry.filter("leaf_below IS NOT NULL"), ["conv", "depth"], "left")
    added = lambda c: (F.col(c) + F.coalesce(f"{c}_below", zero)).alias(c)
    count = prefixes.count()
    shard = F.pmod(F.xxhash64(F.floor(F.col("conv") / NEIGHBOURS), "piece"), F.lit(max(1, -(-count // SHARD_ROWS))))
    top = (F.col("depth") > 0) & (F.col("depth") % PIECE == 0)
    pieces = rows.select(shard.alias("shard"), "depth", *KEY, "p1", "p2", "owned", top.alias("top"), added("leaf"), added("worth"))
    schema = "k1 long, k2 long, n_children long, n_leaves long, saved long"
    drop = lambda table: _accumulated(table.drop_columns(["shard"]))
    sums = pieces.groupBy("shard").applyInArrow(drop, schema).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])

    # the parent of an owner's first node is another's
    foot = way.filter("depth = since - 1").select("conv", "since", *KEY)
    parents = foot.join(nodes.select(*KEY, F.col("conv").alias("parent")), KEY).select("conv", F.col("since").alias("depth"), "parent")
    out = nodes.join(sums, KEY).join(end_digests(prefixes, parts), KEY, "left").join(parents, ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
