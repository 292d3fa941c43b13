"""Statistics that are kept and follow changes: signed counts of the changed rows are added to stored ones, the registry is not read again.

One table of counts by (region, department, city) is kept, as large as there are localities. All its measures are sums over rows, so a
changed row counts -1 as it was and +1 as it is; distinct cities are those whose count is not 0. The statistics are sums over the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats

KEYS = ("region", "department", "city")


def measures(passes=stats.PASSES) -> dict[str, Column]:
    """What is counted of a row: published rows by aspect, and all rows by pass."""
    public = F.coalesce(F.col("status") == "published", F.lit(False))
    out = {"rows": F.lit(True), "total": public} | {f"n_{k}": public & c() for k, c in stats.COVERAGE.items()}
    for p in passes:
        out |= {f"{p.platform}_{x}": c for x, c in zip("srv", stats.pass_counts(p))}
    return out


def counts(df: DataFrame, passes=stats.PASSES) -> DataFrame:
    """The measures by region, department and city; rows may have a ``sign`` of -1."""
    sign = F.col("sign") if "sign" in df.columns else F.lit(1)
    return df.groupBy(*KEYS).agg(*[F.coalesce(F.sum(F.when(c, sign)), F.lit(0)).cast("long").alias(k) for k, c in measures(passes).items()])


def merged(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counts with signed ones added; places without rows go."""
    names = [c for c in old.columns if c not in KEYS]
    return old.unionByName(delta).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in names]).filter("rows <> 0")


@dataclass(frozen=True)
class KeptCounts:
    """The counts at ``path``, a version for every batch of changes; a batch that comes again writes the same version."""

    spark: SparkSession
    path: str

    def write(self, registry: DataFrame) -> None:
        counts(registry).write.mode("overwrite").parquet(f"{self.path}/v=0")

    def apply(self, before: DataFrame, after: DataFrame, k: int = 0) -> None:
        """Version k + 1 from version k and the changed rows: as they were (none of new ones), and as they are (none of deleted ones)."""
        signed = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
        merged(self.read(k), counts(signed)).write.mode("overwrite").parquet(f"{self.path}/v={k + 1}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version}")


def coverage(kept: DataFrame, *by: str) -> DataFrame:
    """``stats.coverage`` of the kept rows (AGG-1, AGG-2); ``by``: none, region or department."""
    names = ("total", *(f"n_{k}" for k in stats.COVERAGE))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    return stats.with_shares(kept.filter("total <> 0").groupBy(*by).agg(*sums) if by else kept.agg(*sums))


def progress(kept: DataFrame, passes=stats.PASSES) -> DataFrame:
    """``stats.progress`` of the kept rows (AGG-3)."""
    return stats.by_pass(kept.agg(*[F.coalesce(F.sum(f"{p.platform}_{x}"), F.lit(0)).alias(f"{p.platform}_{x}") for p in passes for x in "srv"]), passes)


def territory_rollup(kept: DataFrame) -> DataFrame:
    """``stats.territory_rollup`` of the kept rows (AGG-9)."""
    return kept.filter("total <> 0").rollup("region", "department").agg(F.sum("total").alias("n"), F.countDistinct("city").alias("n_localities"), F.grouping_id().alias("level"))
