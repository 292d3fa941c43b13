"""Operator 8: URL filters by a Bloom filter cascade.

Level 1 holds the listed keys; level 2 the other keys of the corpus that level 1 lets through by mistake; level 3 the listed keys that
level 2 lets through, and so on until a level has no mistake left. Over the key universe the cascade was built on, membership is exact
and needs no join. Keys are dealt to shards by hash, each with a cascade of its own, so no task holds more than a bounded part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, shared_dir, staged

KEYS_PER_SHARD, LEAST_SHARDS = 200_000, 64
#: All cascades together are broadcast up to so many bytes; beyond it the URLs go to the shards.
BROADCAST_BYTES = 64 << 20
MOST_LEVELS = 60
#: Beyond the broadcast, rows of a shard that meet its levels in one task.
ROWS_PER_GROUP = 2_000_000

# The rules of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent domain and the start of the path, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Bloom:
    def __init__(self, bits: int, hashes: int, data: np.ndarray):
        self.bits, self.hashes, self.data = bits, hashes, data

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, rate: float, level: int) -> Bloom:
        bits = max(64, ceil(len(a) * log2(1 / rate) / log(2)))
        out = Bloom(bits, max(1, round(log2(1 / rate))), np.zeros(-(-bits // 8), np.uint8))
        for at in out._places(a, b, level):
            np.bitwise_or.at(out.data, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    def _places(self, a, b, level):
        b = b | np.uint64(1)
        for i in range(self.hashes):
            x = a + b * np.uint64(level * 101 + i + 1)
            x ^= x >> np.uint64(31)
            yield ((x * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.bits)).astype(np.int64)

    def has(self, a, b, level) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for at in self._places(a, b, level):
            ok &= (self.data[at >> 3] >> (at & 7)) & 1 == 1
        return ok


def build_cascade(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[Bloom]:
    """The levels for keys with the hash pairs (a, b)."""
    held, rest, out = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(held):
        if len(out) == MOST_LEVELS:
            raise ValueError("a listed and another key have the same 128-bit hash")
        rate = min(0.5, max(1e-4, sqrt(0.5) * len(held) / max(1, len(rest)))) if not out else 0.5
        out.append(Bloom.of(a[held], b[held], rate, len(out)))
        held, rest = rest[out[-1].has(a[rest], b[rest], len(out) - 1)], held
    return out


def in_cascade(levels: list[Bloom], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Membership: the first level that refuses a key decides, by whether it holds listed keys or mistakes."""
    out, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for i, level in enumerate(levels):
        ok = level.has(a[open_], b[open_], i)
        out[open_[~ok]] = i % 2 == 1
        open_ = open_[ok]
    out[open_] = len(levels) % 2 == 1
    return out


def _hashes(key: Column) -> list[Column]:
    """128 bits; the salt comes first, so that the two halves don't collide together."""
    return [F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b")]


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("a", F.lit(3)), F.lit(shards)).cast("int").alias("shard")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
    levels = build_cascade(a, b, pdf["listed"].to_numpy(bool))
    return pd.DataFrame([(pdf["shard"].iloc[0], i, x.bits, x.hashes, x.data.tobytes()) for i, x in enumerate(levels)], columns=["shard", "level", "bits", "hashes", "data"])


def cascade(universe: DataFrame, key: str, listed: str) -> tuple[DataFrame, int]:
    """(levels, number of shards) for distinct keys with a boolean flag; a row per shard and level."""
    spark = universe.sparkSession
    keys = staged(universe.select(*_hashes(F.col(key)), F.col(listed).alias("listed")), shared_dir(spark), "keys")
    shards = max(LEAST_SHARDS, -(-keys.count() // KEYS_PER_SHARD))
    built = keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, "shard int, level int, bits long, hashes int, data binary")
    return staged(built, shared_dir(spark), "levels"), shards


def _levels(rows) -> dict[int, list[Bloom]]:
    out: dict[int, list[Bloom]] = {}
    for shard, _, bits, hashes, data in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(shard, []).append(Bloom(bits, hashes, np.frombuffer(bytes(data), np.uint8)))
    return out


def _probe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _levels(shared.value)
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            shard, out = batch.column("shard").to_numpy(), np.zeros(len(a), bool)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                out[at] = in_cascade(levels.get(int(s), []), a[at], b[at])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["row", "listed"])

    return run


def _probe_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their group, a group's levels before its rows: only the levels of one group are held, however many rows it has."""
    group, held, levels = None, [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt", "kind")], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for at, to in zip([0, *cuts], [*cuts, len(key)]):
            if to > at:
                shard, salt, kind = key[at].tolist()
                if (shard, salt) != group:
                    group, held, levels = (shard, salt), [], None
                part = batch.slice(at, to - at)
                if kind == 0:
                    held += zip(part.column("shard").to_pylist(), *(part.column(c).to_pylist() for c in ("level", "bits", "hashes", "data")))
                    continue
                if levels is None:
                    levels, held = next(iter(_levels(held).values()), []), []
                a, b = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in "ab")
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(in_cascade(levels, a, b))], ["row", "listed"])


def mark_listed(df: DataFrame, key: Column, levels: DataFrame, shards: int) -> DataFrame:
    """``df`` with a boolean column ``listed``: whether the cascade holds ``key``, which must be of its universe."""
    cols = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *_hashes(key)).withColumn("shard", _shard(shards))
    shape = f"row {rows.schema['row'].dataType.simpleString()}, listed boolean"
    if (levels.agg(F.sum(F.octet_length("data"))).first()[0] or 0) <= BROADCAST_BYTES:
        got = levels.select("shard", "level", "bits", "hashes", "data").collect()
        out = rows.mapInArrow(_probe(df.sparkSession.sparkContext.broadcast([tuple(r) for r in got])), shape)
    else:  # rows stream past the levels of their shard; a shard with many rows is dealt to several groups, each with a copy of the levels
        size = rows.groupBy("shard").agg(F.ceil(F.count("*") / ROWS_PER_GROUP).alias("salts")).filter("salts > 1")
        hot = F.broadcast(size) if bounded(size) else size
        left = rows.join(hot, "shard", "left").withColumn("salt", F.pmod(F.xxhash64(F.to_json("row")), F.coalesce("salts", F.lit(1)))).drop("salts")
        right = levels.join(hot, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        both = right.withColumn("kind", F.lit(0)).unionByName(left.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        groups = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
        out = both.repartition(groups, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "level").mapInArrow(_probe_stream, shape)
    return out.select(*[F.col("row")[c].alias(c) for c in cols], "listed")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url; more columns are ignored).

    The longest rule that fits decides. For the rest a host is listed if a block rule fits one of its pages, and its pages are then
    blocked: exact membership over all hosts of the table, by the cascade. Null and odd URLs have an empty host and are allowed. URLs may have
    any length; a repeated row is judged each time; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    each = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    hosts = each.groupBy("host").agg(F.coalesce(F.max(F.col("fit.verdict") == "block"), F.lit(False)).alias("blocked"))
    levels, shards = cascade(hosts, "host", "blocked")
    marked = mark_listed(each.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled")), F.col("host"), levels, shards)
    return marked.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
