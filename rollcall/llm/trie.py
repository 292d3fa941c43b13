"""Operator 12: the prefix trie of conversations, from padded matrices of turn ids.

A conversation is cut into rows of WIDTH turns. Rows go to shards by range of (the node they start at, their turn ids, conversation), so that
equal prefixes are neighbours and even a conversation with countless copies is spread over shards. In a shard the rows make a padded matrix of
turn ids, put in order by numpy's lexsort; where a column changes, or one before it has (the change masks are OR-accumulated), a node starts,
and reduceat aggregates every depth. Nodes that touch a shard's first or last row may go on in the next shard: these alone are recombined.

A turn id is a 128-bit hash of (place, role, text); the key of a node is its depth and the exclusive or of the ids of its turns.

What a node sums over its subtree is also a sum over its members: the least member of a node stands for it, and of the nodes of a path each
conversation stands for the deepest ones. So each conversation gets the worth of its own nodes, and a second pass over the matrices adds these
up; no step walks the tree, whatever its depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, shared_dir, staged

#: Turns in a row of a matrix, and rows in a shard.
WIDTH, SHARD = 32, 20_000
_PAD = np.iinfo(np.int64).min
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
_NODE = "depth long, x1 long, x2 long, px1 long, px2 long, conv_id long, n_convs long, len long, worth long, leaves long, edge boolean"


def _hash(salt: int, *cols: Column) -> Column:
    """64 bits, never the padding; the salt comes first, so that two of them don't collide together."""
    h = F.xxhash64(F.lit(salt), *cols)
    return F.when(h == int(_PAD), F.lit(salt).cast("long")).otherwise(h)


def _numbered(turns: DataFrame, at: str) -> DataFrame:
    """(conv_id, idx, h1, h2, len): the turns of each conversation numbered from 0 by (turn, null first; role; text).

    Ranges are dealt and written once; a range adds up its own turns and starts after those that the conversation has in the ranges before.
    """
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = dealt.select("conv_id", _hash(1, F.col("role"), F.col("text")).alias("h1"), _hash(2, F.col("role"), F.col("text")).alias("h2"), F.char_length("text").cast("long").alias("len"), F.monotonically_increasing_id().alias("id"))
    rows = staged(rows.withColumn("part", F.shiftright("id", 33)), at, "turns")
    own = Window.partitionBy("conv_id", "part").orderBy("id")
    rows = rows.withColumn("i", (F.row_number().over(own) - 1).cast("long"))
    held = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").filter("first > 0")
    return rows.join(F.broadcast(held) if bounded(held, 64) else held, ["conv_id", "part"], "left").select("conv_id", (F.col("i") + F.coalesce("first", F.lit(0))).alias("idx"), "h1", "h2", "len")


def rebuilt(chats: DataFrame, at: str, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv_id), (conv_id, pos, h1, h2, len)): all conversations, and their turns once their heads are those of the first conversation of their hundred."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = chats.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    rows = staged(_numbered(turns, at), at, "numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = rows.filter(F.col("idx") < most - 1).select(F.col("conv_id").alias("base"), "idx", "h1", "h2", "len").filter(F.col("base") % every == 0)
    sizes = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h")).join(sizes, "base", "left")
    convs = staged(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head")), at, "conversations")
    first = convs.filter("head > 0").join(heads, "base").filter("idx < h").select("conv_id", F.col("idx").alias("pos"), "h1", "h2", "len")
    # the few numbers of a conversation go to its turns; a broadcast while a count allows it, else a join that can be split
    few = convs.select("conv_id", "h", "head")
    own = rows.join(F.broadcast(few) if bounded(few, 48) else few, "conv_id").filter("idx >= h").select("conv_id", (F.col("idx") - F.col("h") + F.col("head")).alias("pos"), "h1", "h2", "len")
    return convs.select("conv_id"), first.union(own)


def _matrix_rows(turns: DataFrame, at: str) -> DataFrame:
    """(conv_id, block, p1, p2, ids, lens, x1, x2): the rows of the matrices. ids: the two halves of each turn's id, in turn; p1, p2: the key of the node that a row starts at; x1, x2: the exclusive or of its own ids."""
    each = turns.withColumns({f"z{s}": _hash(s, F.col("pos"), F.col("h1"), F.col("h2")) for s in (1, 2)}).withColumn("block", F.floor(F.col("pos") / WIDTH))
    rows = each.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "z1", "z2", "len"))).alias("t"), *[F.bit_xor(f"z{s}").alias(f"x{s}") for s in (1, 2)])
    rows = staged(rows.select("conv_id", "block", F.flatten(F.transform("t", lambda x: F.array(x["z1"], x["z2"]))).alias("ids"), F.transform("t", lambda x: x["len"]).alias("lens"), "x1", "x2"), at, "rows")
    # keys at the starts of rows: within groups of 1024 rows of a conversation, and what the groups before come to
    far = rows.filter("block > 0").select("conv_id").distinct()
    long = rows.select("conv_id", "block", "x1", "x2", F.floor(F.col("block") / 1024).alias("g")).join(far, "conv_id", "left_semi")
    inner = Window.partitionBy("conv_id", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = long.groupBy("conv_id", "g").agg(*[F.bit_xor(f"x{s}").alias(f"t{s}") for s in (1, 2)]).select("conv_id", "g", *[F.coalesce(F.bit_xor(f"t{s}").over(outer), F.lit(0)).alias(f"g{s}") for s in (1, 2)])
    starts = long.select("conv_id", "block", "g", *[F.coalesce(F.bit_xor(f"x{s}").over(inner), F.lit(0)).alias(f"i{s}") for s in (1, 2)]).join(groups, ["conv_id", "g"])
    starts = starts.select("conv_id", "block", *[F.col(f"i{s}").bitwiseXOR(F.col(f"g{s}")).alias(f"p{s}") for s in (1, 2)]).filter("block > 0")
    starts = staged(starts, at, "starts")
    return rows.join(F.broadcast(starts) if bounded(starts, 64) else starts, ["conv_id", "block"], "left").select("conv_id", "block", *[F.coalesce(f"p{s}", F.lit(0)).cast("long").alias(f"p{s}") for s in (1, 2)], "ids", "lens", "x1", "x2")


def nodes_of(block: np.ndarray, p: np.ndarray, conv: np.ndarray, lengths: np.ndarray, ids: np.ndarray, lens: np.ndarray, worth: np.ndarray, leaves: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The nodes of a shard, a list of columns for every depth.

    ``p`` (2 x rows): the node a row starts at; ``ids`` (2 x rows x width): the padded matrix of turn ids; ``lens``: code points of the turns.
    The order is that of the shards' ranges (the padding comes first), so the nodes that another shard may hold too are those with the first or last row.
    """
    width, rows = ids.shape[2], len(conv)
    order = np.lexsort([conv, *(ids[s, :, j] for j in reversed(range(width)) for s in (1, 0)), p[1], p[0], block])
    block, p, conv, lengths, ids, lens, worth, leaves = block[order], p[:, order], conv[order], lengths[order], ids[:, order], lens[order], worth[order], leaves[order]
    key, change = p, np.ones(rows, bool)
    change[1:] = (block[1:] != block[:-1]) | (p[:, 1:] != p[:, :-1]).any(0)
    for j in range(width):
        change[1:] |= (ids[:, 1:, j] != ids[:, :-1, j]).any(0)
        starts = np.flatnonzero(change)
        live = lengths[starts] > j
        if not live.any():
            return
        ends, at = np.append(starts[1:], rows), starts[live]
        total = lambda v: np.add.reduceat(v, starts)[live]
        parent, key = key, key ^ np.where(lengths > j, ids[:, :, j], 0)
        yield [block[at] * WIDTH + j + 1, *key[:, at], *parent[:, at], np.minimum.reduceat(conv, starts)[live], (ends - starts)[live], lens[at, j], total(worth), total(leaves), ((starts == 0) | (ends == rows))[live]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as matrices, about 4 SHARD rows at most; where a task has more, all its nodes count as ones that another shard holds too."""
    names = ["depth", "x1", "x2", "px1", "px2", "conv_id", "n_convs", "len", "worth", "leaves", "edge"]

    def close(held: list[pa.RecordBatch], whole: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        number = lambda name: t[name].to_numpy().astype(np.int64)
        lengths = np.diff(t["lens"].chunk(0).offsets.to_numpy())
        rows, width = len(lengths), int(lengths.max())
        cell = np.repeat(np.arange(rows), lengths), np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        lens, ids = np.zeros((rows, width), np.int64), np.full((2, rows, width), _PAD)
        lens[cell] = t["lens"].chunk(0).flatten().to_numpy()
        halves = t["ids"].chunk(0).flatten().to_numpy()
        for s in (0, 1):
            ids[s][cell] = halves[s::2]
        for cols in nodes_of(number("block"), np.stack([number("p1"), number("p2")]), number("conv_id"), lengths, ids, lens, number("worth"), number("leaves")):
            cols[-1] = cols[-1] | (not whole)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    held, n, whole = [], 0, True
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= 4 * SHARD:
            whole = False
            yield from close(held, whole)
            held, n = [], 0
    if n:
        yield from close(held, whole)


def _nodes(rows: DataFrame, shards: int, at: str, name: str) -> DataFrame:
    """The nodes below the root: those inside one shard as they are, those at the edges of shards recombined."""
    dealt = rows.repartitionByRange(shards, "block", "p1", "p2", "ids", "conv_id")
    found = staged(dealt.select("block", "p1", "p2", "conv_id", "ids", "lens", "worth", "leaves").mapInArrow(_shards, _NODE), at, name)
    key = ["depth", "x1", "x2"]
    edge = found.filter("edge").groupBy(*key).agg(F.min("px1").alias("px1"), F.min("px2").alias("px2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("len").alias("len"), F.sum("worth").alias("worth"), F.sum("leaves").alias("leaves"))
    return found.filter("NOT edge").drop("edge").unionByName(edge)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows (depth, x1, x2, conv_id) of one node as one (depth, x1, x2, first, ids)."""
    for batch in batches:
        node = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
        conv = batch.column(3).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]).any(1)))) if len(conv) else np.zeros(0, np.int64)
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(conv)])]
        yield pa.RecordBatch.from_arrays([*(pa.array(node[starts, c]) for c in range(3)), pa.array(conv[starts]), pa.array(ids, pa.string())], ["depth", "x1", "x2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, x1, x2, sha256) of the runs of each node, which come in order; nothing is held but the digest."""
    import hashlib

    node, digest, out = None, None, []
    for batch in batches:
        for d, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (d, a, b) != node:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (d, a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["depth", "x1", "x2", "ends_sha256"])
                out = []
    if node:
        out.append((*node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["depth", "x1", "x2", "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of ``last`` (depth, x1, x2, conv_id): ids are put in order in ranges, written as runs, and the runs of a node stream through one digest."""
    spark, key = last.sparkSession, ["depth", "x1", "x2"]
    dealt = last.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    runs = dealt.mapInArrow(_runs, "depth long, x1 long, x2 long, first long, ids string")
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(chats: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``chats``: conv_id, turn, role, text. Rows with null conv_id go; null turns come first, null roles and texts are empty; equal turns are put
    in order by role and text, so repeated rows are turns of their own; texts may have any length; an empty table gives no nodes; other columns
    are ignored. The remainder of a negative conv_id has its sign, as in SQL.
    """
    spark, at = chats.sparkSession, shared_dir(chats.sparkSession)
    convs, turns = rebuilt(chats, at)
    rows = staged(_matrix_rows(turns, at), at, "matrix")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard))
    zero, key = F.lit(0).cast("long"), ["depth", "x1", "x2"]
    nodes = staged(_nodes(rows.withColumns({"worth": zero, "leaves": zero}), shards, at, "found-1"), at, "nodes-1")

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("px1").alias("x1"), F.col("px2").alias("x2")).agg(F.count("*").alias("n_children"))
    children = staged(children, at, "children")
    # each conversation stands for the nodes whose least member it is: what these save, and whether its last one has no children
    value = (F.col("n_convs") - 1) * F.col("len")
    stands = nodes.join(children, key, "left").groupBy("conv_id").agg(F.sum(value).alias("worth"), F.count_if(F.col("n_children").isNull()).alias("leaves"))
    stands = staged(stands, at, "stands")
    few = F.broadcast(stands) if bounded(stands, 64) else stands
    valued = rows.join(few, "conv_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("worth", "leaves")})
    nodes = staged(_nodes(valued, shards, at, "found-2"), at, "nodes-2")

    # of its least member a node counts the part from its own depth on: take away what that member saves above
    saved = nodes.select("conv_id", "depth", value.alias("v"), F.floor(F.col("depth") / 1024).alias("g"))
    inner = Window.partitionBy("conv_id", "g").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = saved.groupBy("conv_id", "g").agg(F.sum("v").alias("t")).select("conv_id", "g", F.coalesce(F.sum("t").over(outer), zero).alias("o")).filter("o > 0")
    above = saved.select("conv_id", "depth", "g", F.coalesce(F.sum("v").over(inner), zero).alias("i")).join(groups, ["conv_id", "g"], "left")
    above = above.select("conv_id", "depth", (F.col("i") + F.coalesce("o", zero)).alias("above")).filter("above > 0")

    # the end of each conversation: all its turns
    whole = rows.groupBy("conv_id").agg(F.sum(F.size("lens")).alias("depth"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    convs = staged(convs.join(whole, "conv_id", "left").join(few, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in (*key, "worth", "leaves")]), at, "whole")
    ends = staged(_ends(convs.select(*key, "conv_id")), at, "ends")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("px1"), F.col("x2").alias("px2"), F.col("conv_id").alias("parent"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("worth").alias("worth"), F.sum("leaves").alias("leaves")).filter("n_convs > 0")
    least = root.select(F.col("conv_id").alias("least"), F.lit(1).cast("long").alias("depth"))
    out = nodes.join(parents, ["depth", "px1", "px2"], "left").join(F.broadcast(least), "depth", "left").join(above, ["conv_id", "depth"], "left")
    out = out.select("conv_id", *key, F.coalesce("parent", "least").alias("parent_conv_id"), "n_convs", F.col("leaves").alias("n_leaves"), (F.col("worth") - F.coalesce("above", zero)).alias("saved_tokens"))
    tip = root.select("conv_id", *[zero.alias(c) for c in key], F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.col("worth").alias("saved_tokens"))
    out = out.unionByName(tip).join(children, key, "left").join(ends, key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
