"""Coverage, progress, funnel, territory roll-ups, clusters, visitors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import located, pixel_cell
from ..functions.text import clean_city, norm_city, unaccent


def percent(n: Column, total: Column) -> Column:
    """Per cent to one decimal, half up; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.floor(n * 1000.0 / total + 0.5) / 10.0)


def has(platform: str) -> Column:
    """Whether the served map has a platform; a null map has none (FLT-12)."""
    return F.coalesce(F.map_contains_key("social", platform), F.lit(False))


def linked() -> Column:
    return F.coalesce(F.size("social") > 0, F.lit(False))


COVERAGE = {"located": lambda: located(), "described": lambda: F.col("description").isNotNull(), "website": lambda: has("website"), "facebook": lambda: has("facebook"), "linkedin": lambda: has("linkedin"), "instagram": lambda: has("instagram"), "linked": linked, "enriched": lambda: F.col("enriched_at").isNotNull()}


def coverage(df: DataFrame, *by: str) -> DataFrame:
    """Total and, for each aspect, count and per cent, the rows without any link last; published rows, one scan (AGG-1, AGG-2)."""
    aggs = [F.count("*").alias("total"), *(F.count_if(c()).alias(f"n_{k}") for k, c in COVERAGE.items())]
    pub = df.filter("status = 'published'")
    return with_shares(pub.groupBy(*by).agg(*aggs) if by else pub.agg(*aggs))


def with_shares(out: DataFrame) -> DataFrame:
    """Counts of aspects with the complement of the links and all per cents."""
    out = out.withColumn("n_empty", F.col("total") - F.col("n_linked"))
    return out.withColumns({f"pct_{k}": percent(F.col(f"n_{k}"), F.col("total")) for k in (*COVERAGE, "empty")})


@dataclass(frozen=True)
class Pass:
    """A targeted discovery pass: what it looks for and the marker it leaves; social passes also count candidates already found."""

    platform: str
    marker: str
    social: bool = True


PASSES = (Pass("instagram", "ig_targeted"), Pass("facebook", "fb_targeted"), Pass("donation", "donation_checked"), Pass("website", "web_targeted", social=False))


def pending(p: Pass) -> Column:
    """Rows that a pass has still to visit: located, not linked, not marked, without a candidate (FLT-13)."""
    out = located() & ~has(p.platform) & ~F.coalesce(F.map_contains_key("markers", p.marker), F.lit(False))
    if p.social:
        out &= ~F.coalesce(F.array_contains("candidate_platforms", p.platform), F.lit(False))
    return out


def pass_counts(p: Pass) -> tuple[Column, Column, Column]:
    """Whether a row is scanned, remaining, validated."""
    return F.coalesce(F.map_contains_key("markers", p.marker), F.lit(False)), pending(p), has(p.platform)


def progress(df: DataFrame, passes=PASSES) -> DataFrame:
    """(platform, scanned, remaining, validated, pct) of each pass from one scan; 100 when there is nothing to do (AGG-3)."""
    return by_pass(df.agg(*[F.count_if(c).alias(f"{p.platform}_{x}") for p in passes for x, c in zip("srv", pass_counts(p))]), passes)


def by_pass(counts: DataFrame, passes=PASSES) -> DataFrame:
    """One row of counts as a row for each pass."""
    rows = F.array(*[F.struct(F.lit(p.platform).alias("platform"), *(F.col(f"{p.platform}_{x}").alias(n) for x, n in (("s", "scanned"), ("r", "remaining"), ("v", "validated")))) for p in passes])
    out = counts.select(F.inline(rows))
    both = F.col("scanned") + F.col("remaining")
    return out.withColumn("pct", F.when(both == 0, F.lit(100.0)).otherwise(percent(F.col("scanned"), both)))


def has_work(passes=PASSES) -> Column:
    out = F.lit(False)
    for p in passes:
        out = out | pending(p)
    return located() & (~F.coalesce(F.col("discovered"), F.lit(False)) | out)


def active_territory(df: DataFrame, order: DataFrame, threshold: int = 20) -> DataFrame:
    """(active, next, done): the first department of ``order`` (department, position) with more rows of work than the threshold, the one after it, those before it; the last one if none has work (AGG-5)."""
    work = df.filter(has_work()).groupBy("department").agg(F.count("*").alias("n")).filter(F.col("n") > threshold)
    seen = order.join(work, "department", "left")
    head = seen.agg(F.min(F.when(F.col("n").isNotNull(), F.col("position"))).alias("at"), F.max("position").alias("end"))
    head = head.withColumn("at", F.coalesce("at", "end"))
    met = order.withColumn("_1", F.lit(1)).join(F.broadcast(head.withColumn("_1", F.lit(1))), "_1").drop("_1")
    return met.agg(F.max(F.when(F.col("position") == F.col("at"), F.col("department"))).alias("active"), F.max(F.when(F.col("position") == F.col("at") + 1, F.col("department"))).alias("next"), F.array_sort(F.collect_list(F.when(F.col("position") < F.col("at"), F.col("department")))).alias("done"))


def territory_states(order: DataFrame, active: DataFrame) -> DataFrame:
    """(department, state): done, active or waiting (JN-18)."""
    met = order.withColumn("_1", F.lit(1)).join(F.broadcast(active.withColumn("_1", F.lit(1))), "_1").drop("_1")
    return met.select("department", F.when(F.col("department") == F.col("active"), "active").when(F.array_contains("done", F.col("department")), "done").otherwise("waiting").alias("state"))


def locality_index(df: DataFrame) -> DataFrame:
    """(department, city, n, updated) of every non-blank city (AGG-6)."""
    return df.filter("status = 'published' AND trim(city) <> ''").groupBy("department", "city").agg(F.count("*").alias("n"), F.max("updated_at").alias("updated"))


def theme_localities(df: DataFrame) -> DataFrame:
    """(department, category_id, city, n, theme_total, n_localities) (AGG-7)."""
    each = df.filter("status = 'published' AND trim(city) <> ''").groupBy("department", "category_id", "city").agg(F.count("*").alias("n"))
    w = Window.partitionBy("department", "category_id")
    return each.withColumns({"theme_total": F.sum("n").over(w), "n_localities": F.count("*").over(w)})


def combos(df: DataFrame, territories: DataFrame) -> DataFrame:
    """Distinct (department, category) of known departments (AGG-8)."""
    return df.filter("status = 'published'").select("department", "category_id").distinct().join(F.broadcast(territories.select("department")), "department", "left_semi")


def territory_rollup(df: DataFrame) -> DataFrame:
    """Entities and localities by (region, department), by region and in all; ``level`` 0, 1, 3 is the grouping id (AGG-9)."""
    return df.filter("status = 'published'").rollup("region", "department").agg(F.count("*").alias("n"), F.countDistinct("city").alias("n_localities"), F.grouping_id().alias("level"))


def locality_pages(df: DataFrame, cap: int = 600) -> DataFrame:
    """Per locality: total, categories present in order, the first ``cap`` names, how many remain (AGG-10)."""
    pub = df.filter("status = 'published' AND trim(city) <> ''")
    w = Window.partitionBy("department", "city")
    ranked = pub.withColumns({"r": F.row_number().over(w.orderBy("name", "id")), "total": F.count("*").over(w)})
    return ranked.groupBy("department", "city").agg(F.max("total").alias("total"), F.array_join(F.array_sort(F.collect_set("category_id")), ",").alias("themes"), F.array_sort(F.collect_list(F.when(F.col("r") <= cap, F.struct("r", "id", "name", "category_id")))).alias("shown")).withColumn("n_remaining", F.col("total") - F.size("shown"))


def freshness(df: DataFrame, floor: Column, at: str = "updated_at") -> DataFrame:
    """The latest update, not before a floor (AGG-11)."""
    return df.agg(F.greatest(F.coalesce(F.max(at), floor), floor).alias("fresh"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(step, n) for each named predicate or number, from one scan (AGG-12). Booleans are counted, numbers summed."""
    kinds = dict(df.select(*[c.alias(k) for k, c in steps.items()]).dtypes)
    one = df.agg(*[(F.count_if(c) if kinds[k] == "boolean" else F.coalesce(F.sum(c), F.lit(0)).cast("long")).alias(k) for k, c in steps.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).cast("long").alias("n")) for k in steps])))


def tiers(df: DataFrame) -> DataFrame:
    """(tier, n, mean) with the mean score to one decimal (AGG-13)."""
    return df.groupBy("tier").agg(F.count("*").alias("n"), (F.floor(F.sum("score") * 10.0 / F.count("*") + 0.5) / 10.0).alias("mean"))


def throughput(df: DataFrame, now: Column, total: Column, at: str = "at", seconds: int = 7200) -> DataFrame:
    """Rows of the last two hours, their span, seconds a row, rows a minute, and how long the rest takes (AGG-14). Times in epoch seconds."""
    one = df.filter((F.col(at) > now - seconds) & (F.col(at) <= now)).agg(F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("span_s"))
    each = F.when(F.col("n") > 1, F.col("span_s") / (F.col("n") - 1))
    return one.withColumns({"s_per_row": each, "rows_per_min": F.when(each > 0, 60.0 / each), "eta_s": each * F.greatest(total - F.col("n"), F.lit(0))})


def centroids(df: DataFrame) -> DataFrame:
    """Mean coordinates of a department (AGG-15)."""
    return df.filter(located()).groupBy("department").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def cluster(df: DataFrame, zoom: int, radius_px: int = 56) -> DataFrame:
    """(cx, cy, n, top_category, size): points by pixel cell with their most frequent category, the smaller id on a tie (AGG-16)."""
    cx, cy = pixel_cell(zoom, radius_px)
    by = df.filter(located()).select(cx.alias("cx"), cy.alias("cy"), "category_id").groupBy("cx", "cy", "category_id").agg(F.count("*").alias("k"))
    return _clusters(by, "cx", "cy")


def cluster_pyramid(df: DataFrame, deepest: int, radius_px: int = 64) -> DataFrame:
    """(zoom, cx, cy, n, top_category, size) for every zoom from 0 to ``deepest``: ``cluster`` of each with cells that nest (AGG-16).

    The points are read and counted once, by the cells of the deepest zoom; with cells of a power of two in pixels a cell of one zoom is
    four of the next, so every other zoom is a sum of these counts.
    """
    if radius_px & (radius_px - 1) or not 0 < radius_px <= 256:
        raise ValueError("cells nest if radius_px is a power of two up to 256")
    cx, cy = pixel_cell(deepest, radius_px)
    leaf = df.filter(located()).select(cx.alias("x"), cy.alias("y"), "category_id").groupBy("x", "y", "category_id").agg(F.count("*").alias("k"))
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), F.shiftright("x", deepest - z).alias("cx"), F.shiftright("y", deepest - z).alias("cy")) for z in range(deepest + 1)]))
    by = leaf.select("category_id", "k", levels.alias("c")).groupBy("c.zoom", "c.cx", "c.cy", "category_id").agg(F.sum("k").alias("k"))
    return _clusters(by, "zoom", "cx", "cy")


def _clusters(by: DataFrame, *cell: str) -> DataFrame:
    out = by.groupBy(*cell).agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("o"), F.col("category_id").alias("c"))).alias("t"))
    size = F.when(F.col("n") < 10, "s").when(F.col("n") < 100, "m").when(F.col("n") < 1000, "l").otherwise("xl")
    return out.select(*cell, "n", F.col("t.c").alias("top_category"), size.alias("size"))


def city_extents(df: DataFrame) -> DataFrame:
    """(city_key, city, n, west, south, east, north) (AGG-17)."""
    pub = df.filter(located() & (F.trim("city") != "")).withColumns({"city_key": norm_city(F.col("city")), "shown": clean_city(F.col("city"))})
    return pub.groupBy("city_key").agg(F.min("shown").alias("city"), F.count("*").alias("n"), F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))


def run_report(df: DataFrame, *by: str) -> DataFrame:
    """Counts by the given columns (AGG-19)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def daily_visitors(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct visitors and hits per day and kind (AGG-20); df: ts (timestamp), kind, visitor."""
    n = F.countDistinct("visitor") if exact else F.approx_count_distinct("visitor")
    return df.groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(n.alias("visitors"), F.count("*").alias("hits")).select(F.to_date("w.start").alias("day"), "kind", "visitors", "hits")


#: Of a visitor sketch: 2^12 registers, a relative standard error of 1.04 / 64 = 1.6 %.
SKETCH_BITS = 12


def visitor_sketches(df: DataFrame) -> DataFrame:
    """(day, kind, sketch, hits): what is kept of a day's hits (ts, kind, visitor) to count visitors of longer times without them (AGG-20)."""
    return df.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.hll_sketch_agg("visitor", SKETCH_BITS).alias("sketch"), F.count("*").alias("hits"))


def visitors_over(sketches: DataFrame, unit: str, *by: str) -> DataFrame:
    """(start, ..., visitors, hits) by week, month, quarter or year from the kept sketches: a visitor of several days counts once."""
    start = F.to_date(F.date_trunc(unit, "day")).alias("start")
    return sketches.groupBy(start, *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"), F.sum("hits").alias("hits"))


def dense_territories(stats: DataFrame, territories: DataFrame, text: str | None = None, sort: str = "name") -> DataFrame:
    """Every known department, zeros where there are no rows, with per cents; filtered by accent-free name or region, in one of three orders (JN-17)."""
    counts = [c for c, t in stats.dtypes if c != "department" and t in ("bigint", "int")]
    out = F.broadcast(territories).join(stats.select("department", *counts), "department", "left").fillna(0, counts)
    out = out.withColumn("pct_linked", percent(F.col("n_linked"), F.col("total")))
    if text:
        want = F.lower(unaccent(F.lit(text)))
        out = out.filter(F.contains(F.lower(unaccent(F.col("territory"))), want) | F.contains(F.lower(unaccent(F.col("region"))), want))
    order = {"name": [F.col("territory")], "total": [F.desc("total"), F.col("territory")], "pct": [F.desc("pct_linked"), F.col("territory")]}[sort]
    return out.orderBy(*order)
