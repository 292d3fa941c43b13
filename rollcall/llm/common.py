"""Shared pieces of the training-data operators: the shared folder, written tables, skew-proof joins, components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast up to so many bytes, counted as rows times their width; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that go to Python at a time.
TEXT_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/rollcall-{uuid.uuid4().hex}"


def staged(df: DataFrame, at: str, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: its lineage ends there, whatever executor is lost later."""
    path = f"{at}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, at: str, *names: str) -> None:
    """Removes tables that ``staged`` wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, size: int = TEXT_BYTES) -> None:
    """Whole texts go to Python about ``size`` bytes at a time (a longer text alone). The setting stays: it is read when a plan runs, not when it is made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(size))


def lean(run):
    """``run`` for ``mapInArrow``: what its task has freed goes back to the system when it ends, because the worker stays for the tasks of other stages."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def give_back() -> None:
    """Unused memory of Arrow's pool and of the C library goes back to the system (where the library can do that)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a bigint ``key`` whose hot values may hold a third of ``left``.

    A second key derived from the first makes Spark exchange both sides for this join alone,
    also where ``right`` comes from an aggregate by ``key``; adaptive execution can then split hot partitions.
    """
    more = F.pmod(F.col(key), F.lit(1021))
    return left.withColumn("_k2", more).join(right.withColumn("_k2", more), [key, "_k2"], how).drop("_k2")


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """The columns of ``docs`` as one struct ``row`` beside columns of an operator's own, so that names never clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in own.items()])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The ``columns`` of a packed frame again, some of them anew."""
    return df.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


def bounded(df: DataFrame, width: int = 48, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table of rows of ``width`` bytes (as held in a hash table) is small enough to be broadcast; counted, not guessed."""
    rows = most // width
    return df.limit(rows + 1).count() <= rows


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the edges (a, b) that are not the smallest of their component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        for end in (x, y, up[x], up[y]):
            np.minimum.at(new, end, low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == up).all():
            break
        up = new
    far = up != np.arange(len(nodes))
    return nodes[far], nodes[up[far]]


def contract(batches):
    """Edges (a, b) of a partition as stars around the smallest node, a bounded number of edges at a time."""
    held, n = [], 0

    def close():
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], ["a", "b"])

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        n += batch.num_rows
        if n >= 500_000:
            yield close()
            held, n = [], 0
    if n:
        yield close()


def components(edges: DataFrame, at: str, name: str) -> DataFrame:
    """(node, comp): the smallest node reachable over the undirected ``edges`` (a, b), for every node that has one.

    Large-star and small-star steps alternate until nothing changes, which they do after a number of rounds that grows with the logarithm of
    the graph (``contract`` before it saves some of them). Each round is written to the shared folder and the one
    before removed; nothing goes to the driver but two numbers.
    """
    spark = edges.sparkSession
    pairs = staged(edges.filter("a <> b"), at, f"{name}-0")
    before, k = None, 0
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = skew_join(both, least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = skew_join(large, small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        pairs, k = staged(pairs, at, f"{name}-{k + 1}"), k + 1
        dropped(spark, at, f"{name}-{k - 1}")
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    own = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(own)


def few_per(df: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` rows of least hash ``h`` for each value of ``by``, equal rows once: a bounded sample that depends on the rows alone.

    ``h`` is a hash of all that makes a row, not of an id that rows may share. Approximate counts of the different hashes thin the rows to about
    twice as many before they are made distinct and ranked, so no task ranks a whole class; the bound of k is exact. ``df`` has no columns ``_n``, ``_r``.
    """
    n = df.groupBy(by).agg(F.approx_count_distinct("h").alias("_n"))
    n = F.broadcast(n) if bounded(n) else n
    low = F.pmod("h", F.lit(2**30))
    thin = df.join(n, by).filter(low * F.col("_n") < (2 * k + 100) * 2**30).drop("_n").distinct()
    w = Window.partitionBy(by).orderBy(low, *sorted(set(df.columns) - {by}))
    return thin.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
