"""Registry rows: cleaning, classification, placement, submissions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_city, squeeze
from ..sources.shared import small


def valid_rows(df: DataFrame, id_: str = "id", name: str = "name", dissolved: str = "dissolved") -> DataFrame:
    """Rows with id and name that are not dissolved: a year after 1900 is a dissolution, the year 1 means active (FLT-5)."""
    year = F.when(F.trim(dissolved).rlike("^[0-9]{4}"), F.substring(F.trim(dissolved), 1, 4).cast("int"))
    return df.filter((F.trim(F.coalesce(F.col(id_).cast("string"), F.lit(""))) != "") & (F.trim(F.coalesce(name, F.lit(""))) != "") & ~F.coalesce(year > 1900, F.lit(False)))


def covered(df: DataFrame, territories: DataFrame) -> DataFrame:
    """Rows of known departments (FLT-6)."""
    return df.join(F.broadcast(territories.select("department")), "department", "left_semi")


def with_territory(df: DataFrame, territories: DataFrame) -> DataFrame:
    """Region and names of the department joined in (JN-4)."""
    return df.join(F.broadcast(territories), "department", "left")


def rule_pattern(patterns: list[str], whole: list[str] = ()) -> str:
    """One alternation of substrings and whole words; words end where no ASCII letter, digit or underscore follows."""
    parts = [re.escape(p) for p in patterns] + [f"(?<![0-9A-Za-z_]){re.escape(w)}(?![0-9A-Za-z_])" for w in whole]
    return "|".join(parts)


def classify(text: Column, rules: list[tuple[str, list[str], list[str]]], default: str) -> Column:
    """The category of the first rule (category, substrings, whole words) with any hit in the lower-cased text (PRJ-4)."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for category, patterns, whole in reversed(rules):
        out = F.when(low.rlike(rule_pattern(patterns, whole)), category).otherwise(out)
    return out


def remap_category(df: DataFrame, mapping: dict[str, str], known: set[str], column: str = "category_id") -> DataFrame:
    """Old category ids replaced; rows of ids that are then unknown go (PRJ-5)."""
    return df.replace(mapping, subset=[column]).filter(F.col(column).isin(*sorted(known)))


def geocode(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates for rows with address and postal code but none, from a gazetteer (address, postal, g_lng, g_lat); non-finite answers are dropped (JN-2)."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    answers = gazetteer.filter(finite(F.col("g_lng")) & finite(F.col("g_lat"))).select(norm_city(F.col("address")).alias("_a"), F.col("postal").alias("_p"), "g_lng", "g_lat").dropDuplicates(["_a", "_p"])
    out = df.withColumns({"_a": norm_city(F.col("address")), "_p": F.col("postal")}).join(answers, ["_a", "_p"], "left")
    miss = F.col("lng").isNull() | F.col("lat").isNull()
    return out.withColumns({"lng": F.when(miss, F.col("g_lng")).otherwise(F.col("lng")), "lat": F.when(miss, F.col("g_lat")).otherwise(F.col("lat"))}).drop("_a", "_p", "g_lng", "g_lat")


def place_by_locality(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Rows still without coordinates take the centre of their locality (city_key, postal, c_lng, c_lat), flagged approximate (JN-3)."""
    out = df.withColumn("city_key", norm_city(F.col("city"))).join(small(centroids), ["city_key", "postal"], "left")
    miss = F.col("lng").isNull() & F.col("c_lng").isNotNull()
    return out.withColumns({"geo_approx": F.coalesce("geo_approx", F.lit(False)) | miss, "lat": F.when(miss, F.col("c_lat")).otherwise(F.col("lat")), "lng": F.when(miss, F.col("c_lng")).otherwise(F.col("lng"))}).drop("city_key", "c_lng", "c_lat")


def validate_submissions(df: DataFrame, categories: set[str]) -> DataFrame:
    """``df`` with ``reasons`` (empty if valid) and what a valid row becomes: pending, of manual source (DEC-19)."""
    bad = lambda name, ok: F.when(~F.coalesce(ok, F.lit(False)), name)
    size = lambda c, a, b: F.length(squeeze(F.coalesce(c, F.lit("")))).between(a, b)
    empty_or = lambda c, p: F.coalesce(F.col(c), F.lit("")).rlike(f"^$|{p}")
    reasons = F.array_compact(F.array(
        bad("name", size("name", 2, 200)),
        bad("city", size("city", 1, 120)),
        bad("postal", F.col("postal").rlike("^[0-9]{5}$")),
        bad("category", F.col("category_id").isin(*sorted(categories))),
        bad("description", F.length(F.coalesce("description", F.lit(""))) <= 4000),
        bad("email", empty_or("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$")),
        bad("website", empty_or("website", r"^https?://[^\s]+$")),
        bad("tags", F.coalesce(F.size("tags"), F.lit(0)) <= 12),
    ))
    return df.withColumns({"reasons": reasons, "status": F.lit("pending"), "source": F.lit("manual")})


def correct_category(df: DataFrame, fixes: DataFrame) -> DataFrame:
    """Categories replaced by id (DEC-20); fixes: id, fixed."""
    return df.join(fixes, "id", "left").withColumn("category_id", F.coalesce("fixed", "category_id")).drop("fixed")


def trusted_address(trusted: Column, forwarded: Column, peer: Column) -> Column:
    """The trusted header, else the last forwarded entry, else the peer, else ``?`` (PRJ-25)."""
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    return F.coalesce(F.nullif(F.trim(trusted), F.lit("")), last, F.nullif(F.trim(peer), F.lit("")), F.lit("?"))


def visitor_id(ip: Column, agent: Column, day: Column, salt: str) -> Column:
    """An anonymous id that holds for a day (PRJ-24)."""
    return F.substring(F.sha2(F.concat_ws("|", ip, agent, day, F.lit(salt)).cast("binary"), 256), 1, 16)


def drop_robots(df: DataFrame, agent: str = "agent", pattern: str = "bot|crawl|spider|slurp|preview|fetch|curl|wget|python") -> DataFrame:
    """Rows of agents that are neither empty nor robots (FLT-8)."""
    a = F.coalesce(F.col(agent), F.lit(""))
    return df.filter((a != "") & ~F.lower(a).rlike(pattern))
