"""A table by key that takes upserts at the cost of the batch: a bucketed base, and a log of batches that is merged when the table is read.

Layout under a path: ``base/v=N`` (bucketed by the key, a file for each bucket), ``log/b=K`` (the last row of each key of batch K) and
``heads/h=N`` (the base's version, the last batch that is in it, its rows). A batch writes its own rows alone. When the log has grown to a share of
the base, the base is written anew with the log in it, so that all writing together stays in proportion to what has been appended.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import last_by_key, upsert
from .shared import exists, removed


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` is that of the base; ``order`` says which row of a key in a batch is the last; the log is merged into the base at ``share`` of its rows."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str = "ext_id"
    order: str = "position"
    buckets: int = 64
    share: float = 0.2

    def head(self) -> tuple[int, int, int]:
        """(version, last batch in it, rows)."""
        rows = self.spark.read.schema("folded long, rows long, h long").json(f"{self.path}/heads")
        return tuple(rows.orderBy(F.desc("h")).select("h", "folded", "rows").first())

    def write(self, base: DataFrame, version: int = 0, folded: int = -1) -> None:
        """A version of the base; the first one, unless told otherwise."""
        where = f"{self.path}/base/v={version}"
        dealt = base.select(*self.schema.names).repartition(self.buckets, self.key)
        dealt.write.mode("overwrite").option("path", where).bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name(version))
        rows = self.spark.read.schema(self.schema).parquet(where).count()
        self.spark.createDataFrame([(folded, rows)], "folded long, rows long").coalesce(1).write.mode("overwrite").json(f"{self.path}/heads/h={version}")

    def name(self, version: int) -> str:
        return f"rollcall_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_v{version}"

    def base(self, version: int) -> DataFrame:
        """The base, with its buckets known to Spark, so that a join by the key doesn't deal it anew."""
        name = self.name(version)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/base/v={version}'")
        return self.spark.table(name)

    def append(self, batch: DataFrame, k: int, at) -> None:
        """Batch ``k`` (0, 1, ...; rows of registry fields with ``order``), in effect from ``at`` on. A batch that comes again replaces itself, or is in the base by then."""
        version, folded, rows = self.head()
        if k <= folded:
            return
        last_by_key(batch, self.key, self.order).drop(self.order).withColumn("_at", at).write.mode("overwrite").parquet(f"{self.path}/log/b={k}")
        if self.log(folded).count() > self.share * rows:
            self.write(self.read(), version + 1, k)
            for gone in range(folded + 1):  # what the version before this one still read
                removed(self.spark, f"{self.path}/log/b={gone}")
            removed(self.spark, f"{self.path}/base/v={version - 1}")

    def log(self, folded: int) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/log"):
            return None
        return self.spark.read.parquet(f"{self.path}/log").filter(F.col("b") > folded)

    def read(self, most: int = 200_000) -> DataFrame:
        """The table with all batches in it. Up to ``most`` keys of the log are broadcast to the base; more are dealt to its buckets."""
        version, folded, _ = self.head()
        base, log = self.base(version), self.log(folded)
        if log is None:
            return base
        fields = [c for c in log.columns if c not in (self.key, "b", "lng", "lat")]
        newest = F.max_by(F.struct(*fields), "b").alias("_f")
        placed = F.max_by(F.struct("lng", "lat"), F.when(F.col("lng").isNotNull() & F.col("lat").isNotNull(), F.col("b"))).alias("_p")
        has = {"lng", "lat"} <= set(log.columns)
        one = log.groupBy(self.key).agg(newest, *[placed] * has).select(self.key, "_f.*", *[f"_p.{c}" for c in ("lng", "lat") if has])
        return upsert(base, one.withColumn(self.order, F.lit(0)), F.col("n._at"), self.key, self.order, most=most, buckets=self.buckets)
