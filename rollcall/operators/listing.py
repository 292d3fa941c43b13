"""Filtered, spatial and nearest-first listings, top-k and order-stable choices."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_m, in_box, in_cells, located, not_null_island
from ..functions.text import norm_city
from ..sources.shared import written


@dataclass(frozen=True)
class ListingQuery:
    categories: tuple[str, ...] = ()
    category: str | None = None
    department: str | None = None
    text: str | None = None
    box: tuple[float, float, float, float] | str | None = None
    near: tuple[float, float] | None = None  # lng, lat
    sort: str = "name"  # name, quality; ``near`` comes before both
    located: bool = False
    limit: int = 20
    offset: int = 0
    statuses: tuple[str, ...] = field(default=("published",))
    cells: bool = False  # the table has the key of ``geo.cell_key`` as a column ``cell``


def text_contains(text: str, *columns: str) -> Column:
    """Any column contains the text, case ignored; % and _ in it stay wildcards (FLT-2)."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).ilike(f"%{text}%")
    return out


def listing_filter(q: ListingQuery) -> Column:
    """The predicate of a listing (FLT-1)."""
    out = F.col("status").isin(*q.statuses)
    if q.categories:
        out &= F.col("category_id").isin(*q.categories)
    elif q.category:
        out &= F.col("category_id") == q.category
    if q.department:
        out &= F.col("department") == q.department
    if q.text:
        out &= text_contains(q.text, "name", "city")
    if q.box:
        out &= in_box(q.box) & in_cells(q.box) if q.cells else in_box(q.box)
    if q.located or q.near:
        out &= located()
    return out


def list_page(df: DataFrame, q: ListingQuery) -> DataFrame:
    """One page: nearest first, or best quality first, or by name; ids break ties (WIN-1)."""
    rows = df.filter(listing_filter(q))
    if q.near:
        rows = rows.withColumn("dist_m", distance_m(*q.near))
        order = [F.col("dist_m").asc_nulls_last(), F.col("name"), F.col("id")]
    elif q.sort == "quality":
        order = [F.col("score").desc_nulls_last(), F.col("name"), F.col("id")]
    else:
        order = [F.col("name"), F.col("id")]
    return rows.orderBy(*order).offset(q.offset).limit(q.limit)


def page_total(df: DataFrame, q: ListingQuery) -> DataFrame:
    """How many rows the predicate of a listing keeps (AGG-18)."""
    return df.filter(listing_filter(q)).agg(F.count("*").alias("total"))


def map_points(df: DataFrame) -> DataFrame:
    return df.filter(located() & not_null_island())


def distinct_on(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (WIN-2)."""
    return top_k(df, key, order, 1)


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key (WIN-3, WIN-4)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def dedup_stable(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """The first row of each key by position (WIN-5)."""
    return distinct_on(df, key, [F.col(position)])


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Consecutive positions from 0 in the order of the columns, without a window over one partition.

    Rows are dealt by range and each partition numbers its own; that is written once, and both the partitions' sizes and the rows are read
    from there (ranges come from a sample, so dealing twice would cut in different places). Ties are ordered by chance, once.
    """
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    marked = dealt.withColumn("_id", F.monotonically_increasing_id())
    part, at = F.shiftright("_id", 33).cast("long"), F.col("_id").bitwiseAND(2**33 - 1)
    marked = written(marked.withColumns({"_part": part, "_at": at}).drop("_id"))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return marked.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def unique_slugs(df: DataFrame, place: str = "department", slug: str = "slug", order: tuple[str, ...] = ("n", "id")) -> DataFrame:
    """A slug that repeats within its place gets its position in the whole list appended (WIN-9)."""
    listed = global_position(df, list(order))
    r = F.row_number().over(Window.partitionBy(place, slug).orderBy("position"))
    return listed.withColumn("unique_slug", F.when(r == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.col("position").cast("string"))))


def neighbours(df: DataFrame, place: str = "department", key: str = "city", size: str = "n", k: int = 24) -> DataFrame:
    """For each locality the k largest others of its place: (place, key, other, other_size, rank) (WIN-10)."""
    ranked = df.select(place, key, size).withColumn("r", F.row_number().over(Window.partitionBy(place).orderBy(F.desc(size), key)))
    top = ranked.filter(F.col("r") <= k + 1).select(place, F.col(key).alias("other"), F.col(size).alias("other_size"), F.col("r").alias("other_r"))
    met = ranked.join(top, place).filter(F.col(key) != F.col("other"))
    rank = F.col("other_r") - F.when(F.col("other_r") > F.col("r"), 1).otherwise(0)
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select(place, key, "other", "other_size", "rank")


def suggest_cities(df: DataFrame, text: str, k: int = 4) -> DataFrame:
    """City names that contain the text (two characters or more): those that begin with it, then the larger ones (WIN-11). df: city, n."""
    if len(text.strip()) < 2:
        return df.limit(0)
    want = norm_city(F.lit(text))
    key = norm_city(F.col("city"))
    return df.filter(F.contains(key, want)).orderBy(F.startswith(key, want).desc(), F.desc("n"), "city").limit(k)


def match_all_keywords(hits: DataFrame, k: int) -> DataFrame:
    """Ids that match all k keywords; hits: id, keyword (JN-16)."""
    return hits.groupBy("id").agg(F.countDistinct("keyword").alias("n")).filter(F.col("n") == k).select("id")


def unmatched(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_anti")


def having_any(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "left_semi")
