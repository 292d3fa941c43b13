"""Upserts, map and array merges, audit trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

REGISTRY_FIELDS = ("name", "city", "department", "region", "category_id", "description", "website", "tags")


def last_by_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, rows without one left out; taken before anything is dealt, so a key with most of the rows costs no more than others."""
    own = [c for c in batch.columns if c != key]
    return batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*own), order).alias("_l")).select(key, *[F.col("_l")[c].alias(c) for c in own])


def upsert(base: DataFrame, batch: DataFrame, now: Column, key: str = "ext_id", order: str = "position", fields=REGISTRY_FIELDS, most: int = 200_000, buckets: int | None = None) -> DataFrame:
    """``base`` with ``batch`` merged by key (JN-1).

    The last row of a key in the batch counts. Registry fields are replaced; coordinates only by coordinates; everything else that base
    has (links, evidence, status, source) stays. New keys come as published rows of the registry. ``updated_at`` is set on both.
    A batch of up to ``most`` keys (counted) is broadcast, so that the base is read and not dealt; a larger one is joined, dealt to as many
    ``buckets`` as a bucketed base has. ``now`` may be a column of the batch, as ``n.name``.
    """
    fields = [f for f in fields if f in base.columns and f in batch.columns]
    last = written(last_by_key(batch, key, order).drop(order))
    had = {c: F.col(f"b.{c}") for c in base.columns}

    def merged(b: dict[str, Column], new: Column, fresh: Column) -> list[Column]:
        out = []
        for c in base.columns:
            if c == key:
                col = F.coalesce(b[key], F.col(f"n.{key}"))
            elif c in fields:
                col = F.when(new, F.col(f"n.{c}")).otherwise(b[c])
            elif c in ("lng", "lat"):
                both = F.col("n.lng").isNotNull() & F.col("n.lat").isNotNull()
                col = F.when(both, F.col(f"n.{c}")).otherwise(b[c])
            elif c == "updated_at":
                col = F.when(new, now).otherwise(b[c])
            elif c == "status":
                col = F.when(fresh, "published").otherwise(b[c])
            elif c == "source":
                col = F.when(fresh, "registry").otherwise(b[c])
            else:
                col = b[c]
            out.append(col.alias(c))
        return out

    if last.limit(most + 1).count() <= most:
        keys = F.broadcast(last.select(key))
        old = base.alias("b").join(F.broadcast(last.withColumn("_new", F.lit(True))).alias("n"), F.col(f"b.{key}") == F.col(f"n.{key}"), "left")
        new = last.join(base.select(key).join(keys, key, "left_semi"), key, "left_anti").alias("n")
        none = {c: F.lit(None).cast(t.dataType) for c, t in zip(base.columns, base.schema)}
        return old.select(*merged(had, F.col("n._new").isNotNull(), F.lit(False))).unionByName(new.select(*merged(none, F.lit(True), F.lit(True))))
    n = last.withColumn("_new", F.lit(True))
    met = base.alias("b").join((n.repartition(buckets, key) if buckets else n).alias("n"), F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    return met.select(*merged(had, F.col("n._new").isNotNull(), F.col(f"b.{key}").isNull()))


def merge_maps(old: Column, new: Column, existing_wins: bool = False) -> Column:
    """Shallow merge of two maps; the right one wins unless told otherwise; null is empty (COL-3)."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    first, second = (b, a) if existing_wins else (a, b)
    return F.map_from_entries(F.concat(F.filter(F.map_entries(first), lambda e: ~F.map_contains_key(second, e["key"])), F.map_entries(second)))


def entries(m: Column) -> Column:
    """A map in a comparable form (COL-9)."""
    return F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))


def changed_links(old: Column, new: Column) -> Column:
    return entries(old) != entries(new)


def append_audit(old: Column, new: Column) -> Column:
    """An audit array with records added (COL-5)."""
    return F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()))


def archive_once(df: DataFrame, archive: str, *columns: str) -> DataFrame:
    """The columns kept as a struct where no archive exists yet (COL-6)."""
    return df.withColumn(archive, F.coalesce(F.col(archive), F.struct(*columns)))


def restore(df: DataFrame, archive: str, *columns: str) -> DataFrame:
    """The columns as archived, where they were (COL-6)."""
    return df.withColumns({c: F.when(F.col(archive).isNotNull(), F.col(archive)[c]).otherwise(F.col(c)) for c in columns})


def drop_key(m: Column, key: str, when: Column) -> Column:
    """A map without one key where the condition holds, e.g. to re-open judged rows (COL-4)."""
    return F.when(when, F.map_filter(m, lambda k, v: k != key)).otherwise(m)


def flatten_map(df: DataFrame, id_: str, m: str) -> DataFrame:
    """(id, platform, value...) for every entry of a map of structs that has a URL (COL-7)."""
    flat = df.select(id_, F.explode(m).alias("platform", "v"))
    return flat.select(id_, "platform", "v.*").filter("url IS NOT NULL AND url <> ''")


def clean_agenda(df: DataFrame, events: str, noisy) -> DataFrame:
    """Noisy events taken out of the stored arrays, with how many went (COL-8). ``noisy``: event column to predicate."""
    kept = F.filter(F.col(events), lambda e: ~F.coalesce(noisy(e), F.lit(False)))
    return df.withColumn("n_removed", F.size(events) - F.size(kept)).withColumn(events, kept)


def merge_candidates(old: DataFrame, new: DataFrame, kind: str, cap: int | None = None) -> DataFrame:
    """Candidates of ``old`` and those of ``new`` (id, url, position, score) with unseen URLs, ``added`` marking the latter; the best ``cap`` of each id (COL-2)."""
    fresh = new.join(old.select("id", "url"), ["id", "url"], "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("id", "url").orderBy("position"))).filter("_r = 1").drop("_r")
    out = old.withColumn("added", F.lit(False)).unionByName(first.withColumn("added", F.lit(True))).withColumn("kind", F.lit(kind))
    if cap:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "added", "position", "url"))).filter(F.col("_r") <= cap).drop("_r")
    return out


def union_families(*dfs: DataFrame) -> DataFrame:
    """One table from several of like columns, each with its place in the list (COL-10)."""
    out = None
    for i, df in enumerate(dfs):
        one = df.withColumn("family", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
