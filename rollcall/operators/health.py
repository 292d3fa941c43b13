"""Link health: probes, failure state, gates by age, reaping, purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_of, host_suffixes

# What an HTTP code says about a link.
DEAD_CODES, BLOCKED_CODES = (404, 410), (401, 403, 429)
DEAD_ERRORS = ("connect", "connect_timeout", "malformed")


def probe_status(code: Column, error: Column) -> Column:
    return F.when(error.isin(*DEAD_ERRORS) | code.isin(*DEAD_CODES), "dead").when(code.isin(*BLOCKED_CODES), "blocked").when(code.between(200, 399), "alive").otherwise("error")


def classify_probe(probes: DataFrame) -> DataFrame:
    """(id, platform, url, checked_at, status, http_code): a dead first attempt needs a dead second one, which else decides (DEC-10). probes also have attempt and error."""
    each = probes.withColumn("_s", probe_status(F.col("http_code"), F.col("error")))
    key = ["id", "platform", "url", "checked_at"]
    by = each.groupBy(*key).agg(*[F.max(F.when(F.col("attempt") == a, F.struct("_s", "http_code"))).alias(f"a{a}") for a in (1, 2)])
    use = F.when((F.col("a1._s") == "dead") & F.col("a2").isNotNull(), F.col("a2")).otherwise(F.coalesce("a1", "a2"))
    return by.withColumn("u", use).select(*key, F.col("u._s").alias("status"), F.col("u.http_code").alias("http_code"))


def fold_failures(states: DataFrame) -> DataFrame:
    """Running failure state of each (id, platform) over its probes (DEC-11): consecutive_failures and first_fail_at after every probe.

    Dead adds one and keeps the first time, alive sets 0 and null, others carry over; a new URL starts anew. Windows: runs begin at an alive
    probe or a change of URL; within a run the dead ones are counted. states: id, platform, url, status, checked_at, seq (unique order).
    """
    w = Window.partitionBy("id", "platform").orderBy("checked_at", "seq")
    reset = (F.col("status") == "alive") | ~F.col("url").eqNullSafe(F.lag("url").over(w))
    runs = states.withColumn("_run", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("id", "platform", "_run").orderBy("checked_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    dead = F.col("status") == "dead"
    return runs.withColumns({"consecutive_failures": F.sum(dead.cast("long")).over(r), "first_fail_at": F.min(F.when(dead, F.col("checked_at"))).over(r)}).drop("_run")


def latest_health(folded: DataFrame) -> DataFrame:
    """The last state of each (id, platform)."""
    w = Window.partitionBy("id", "platform").orderBy(F.desc("checked_at"), F.desc("seq"))
    return folded.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def due_for_probe(links: DataFrame, health: DataFrame, now: Column, max_age: int = 14, suspect_age: int = 1) -> DataFrame:
    """Links never checked, or not for so many days: one if last dead or in error, else fourteen (FLT-14). Times in epoch seconds."""
    h = health.select("id", "platform", F.col("status").alias("_s"), F.col("checked_at").alias("_at"))
    age = F.when(F.col("_s").isin("dead", "error"), suspect_age).otherwise(max_age) * 86400
    return links.join(h, ["id", "platform"], "left").filter(F.col("_at").isNull() | (F.col("_at") < now - age)).drop("_s", "_at")


def due_by_age(df: DataFrame, at: str, now: Column, days: int = 3) -> DataFrame:
    """Rows never done or done more than so many days ago (FLT-15)."""
    return df.filter(F.col(at).isNull() | (F.col(at) < now - days * 86400))


def due_for_score(df: DataFrame, scored: str, *inputs: str) -> DataFrame:
    """Rows never scored, or scored before the latest of the input times (FLT-16)."""
    latest = F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(c), F.lit(0)) for c in inputs])
    return df.filter(F.col(scored).isNull() | (F.col(scored) < latest))


def reapable(now: Column, min_fails: int = 2, min_age_hours: int = 12) -> Column:
    """Dead, failed often enough, and gone for certain (404, 410) or for hours (DEC-12)."""
    sure = F.col("http_code").isin(*DEAD_CODES)
    old = (now - F.col("first_fail_at")) >= min_age_hours * 3600
    return F.coalesce((F.col("status") == "dead") & (F.col("consecutive_failures") >= min_fails) & (F.coalesce(sure, F.lit(False)) | F.coalesce(old, F.lit(False))), F.lit(False))


def confirmed_deaths(folded: DataFrame, now: Column, min_fails: int = 2, min_age_hours: int = 12) -> DataFrame:
    """(id, platform, url, seq, dead_at, consecutive_failures, first_fail_at): when each run of failures could first be reaped (``reapable``), up to ``now``.

    That is at a probe, or so many hours after the first failure if no other probe came before. folded: rows of ``fold_failures`` with
    http_code. A run ends at an alive probe or with another URL, and has one death at most.
    """
    w = Window.partitionBy("id", "platform").orderBy("checked_at", "seq")
    reset = (F.col("status") == "alive") | ~F.col("url").eqNullSafe(F.lag("url").over(w))
    runs = folded.withColumns({"_run": F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("checked_at").over(w)})
    at = F.when(F.col("http_code").isin(*DEAD_CODES), F.col("checked_at")).otherwise(F.greatest("checked_at", F.col("first_fail_at") + min_age_hours * 3600))
    dead = runs.withColumn("dead_at", at).filter((F.col("status") == "dead") & (F.col("consecutive_failures") >= min_fails))
    dead = dead.filter((F.col("dead_at") == F.col("checked_at")) | F.coalesce(F.col("dead_at") < F.col("_next"), F.col("dead_at") <= now))
    each = dead.groupBy("id", "platform", "_run").agg(F.min(F.struct("dead_at", "checked_at", "seq", "url", "consecutive_failures", "first_fail_at")).alias("d"))
    return each.select("id", "platform", "d.url", "d.seq", "d.dead_at", "d.consecutive_failures", "d.first_fail_at")


def reap(links: DataFrame, health: DataFrame, now: Column, min_fails: int = 2, min_age_hours: int = 12) -> tuple[DataFrame, DataFrame]:
    """(links left, audit) without the links that can be reaped (DEC-12). links: id, platform, layer, url; the column layer goes before the map."""
    gone = health.filter(reapable(now, min_fails, min_age_hours)).select("id", "platform", "url", "http_code")
    met = links.join(gone.withColumn("_gone", F.lit(True)), ["id", "platform", "url"], "left")
    w = Window.partitionBy("id", "platform", "url").orderBy("layer")
    met = met.withColumn("_first", F.row_number().over(w))
    out = F.col("_gone").isNotNull() & (F.col("_first") == 1)
    return met.filter(~out).select(*links.columns), met.filter(out).select("id", "platform", "layer", "url", "http_code", F.lit("dead").alias("reason"), now.alias("at"))


def purge(links: DataFrame, hosts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(links left, audit) without links on listed hosts or below them (DEC-13)."""
    key = ["id", "platform", "layer"]
    bad = links.select(*key, F.explode(host_suffixes(host_of(F.col("url")))).alias("host")).join(hosts.select("host"), "host", "left_semi").select(*key).distinct()
    return links.join(bad, key, "left_anti"), links.join(bad, key, "left_semi").select(*links.columns, F.lit("directory").alias("reason"), now.alias("at"))


def single_platform(df: DataFrame, platform: str, marker: str) -> DataFrame:
    """Rows linked on a platform, without a site on either layer, not visited by the pass (FLT-17)."""
    has = lambda p: F.coalesce(F.map_contains_key("social", p), F.lit(False))
    seen = F.coalesce(F.map_contains_key("markers", marker), F.lit(False))
    return df.filter(has(platform) & ~has("website") & F.nullif(F.coalesce("website", F.lit("")), F.lit("")).isNull() & ~seen)
