"""Verdicts and decisions: fusion of priors and confidence, routing, rebuilding, moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .listing import distinct_on

# How far a match type and a site score are trusted before any judgement.
PRIORS = {"slug": 0.90, "top1": 0.70, "slug_sub": 0.60, "slug_city": 0.55, "top2": 0.50, "top3": 0.35, "title": 0.30, "fallback": 0.10}
UNKNOWN_PRIOR = 0.20
SITE_PRIORS = ((6, 0.80), (4, 0.50), (2, 0.30))
LOW_SITE_PRIOR = 0.15


def thousandths(x: Column) -> Column:
    return F.floor(x * 1000.0 + 0.5) / 1000.0


def prior_of(match: Column, priors: dict[str, float] = PRIORS) -> Column:
    out = F.lit(UNKNOWN_PRIOR)
    for name, p in priors.items():
        out = F.when(match == name, F.lit(p)).otherwise(out)
    return out


def site_prior(score: Column) -> Column:
    out = F.lit(LOW_SITE_PRIOR)
    for least, p in reversed(SITE_PRIORS):
        out = F.when(score >= least, F.lit(p)).otherwise(out)
    return out


def fuse(df: DataFrame) -> DataFrame:
    """``df`` (platform, match_type, site_score, confidence, trusted) with ``fused`` to three decimals (DEC-6)."""
    c, p = F.coalesce(F.col("confidence"), F.lit(0.0)), prior_of(F.coalesce("match_type", F.lit("fallback")))
    social = F.when(F.col("match_type") == "slug", 0.65 * p + 0.35 * c).otherwise(0.35 * p + 0.65 * c)
    site = 0.25 * site_prior(F.coalesce("site_score", F.lit(0))) + 0.75 * c
    return df.withColumn("fused", F.when(F.coalesce("trusted", F.lit(False)), F.lit(1.0)).otherwise(thousandths(F.when(F.col("platform") == "website", site).otherwise(social))))


def route(df: DataFrame, apply_th: float = 0.75, quar_th: float = 0.40, sure: float = 0.85) -> DataFrame:
    """``df`` (fused, verdict, confidence, trusted, platform) with ``route``: apply, quarantine or drop (DEC-7)."""
    social, open_ = F.col("platform") != "website", F.col("verdict") != "drop"
    apply = F.coalesce("trusted", F.lit(False)) | (social & (F.col("verdict") == "keep")) | (social & (F.col("verdict") == "quarantine") & (F.col("confidence") >= sure)) | (open_ & (F.col("fused") >= apply_th))
    return df.withColumn("route", F.when(apply, "apply").when(open_ & (F.col("fused") >= quar_th), "quarantine").otherwise("drop"))


def join_verdicts(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verdicts with match type (``fallback`` if unknown) and site score (0) of their URL; of repeated candidates the last counts (JN-10). candidates: id, url, kind, match_type, score, rank."""
    last = lambda df: distinct_on(df, ["id", "url"], [F.desc("rank")])
    social = last(candidates.filter("kind = 'social'")).select("id", "url", "match_type")
    site = last(candidates.filter("kind = 'site'")).select("id", "url", F.col("score").alias("site_score"))
    out = verdicts.join(social, ["id", "url"], "left").join(site, ["id", "url"], "left")
    return out.withColumns({"match_type": F.coalesce("match_type", F.lit("fallback")), "site_score": F.coalesce("site_score", F.lit(0))})


def dead_links(links: DataFrame, health: DataFrame, min_fails: int = 2) -> DataFrame:
    """Links that are dead on the same URL with so many failures (JN-11)."""
    h = health.filter((F.col("status") == "dead") & (F.col("consecutive_failures") >= min_fails)).select("id", "platform", "url").distinct()
    return links.join(h, ["id", "platform", "url"], "left_semi")


def rebuild_links(routed: DataFrame, archived: DataFrame, found: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, platform, url): routed links before separately found before archived ones, without the dead (DEC-8). All: id, platform, url; dead only on website and donation."""
    parts = [df.select("id", "platform", "url").withColumn("o", F.lit(o)) for o, df in enumerate((routed, found, archived))]
    best = distinct_on(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["id", "platform"], [F.col("o"), F.col("url")]).drop("o")
    gate = dead.filter(F.col("platform").isin("website", "donation")).select("id", "platform", "url").distinct()
    return best.join(gate, ["id", "platform", "url"], "left_anti")


def verdict_per_platform(df: DataFrame) -> DataFrame:
    """(id, platform, url, confidence, verdict, trusted): the first ``keep`` by position, else the last candidate; a trusted one wins with confidence 1, the last of several (WIN-6)."""
    trusted = F.coalesce("trusted", F.lit(False))
    choice = F.when(trusted, 0).when(F.col("verdict") == "keep", 1).otherwise(2)
    place = F.when(~trusted & (F.col("verdict") == "keep"), F.col("position")).otherwise(-F.col("position"))
    best = distinct_on(df.withColumns({"_c": choice, "_p": place}), ["id", "platform"], [F.col("_c"), F.col("_p")])
    return best.select("id", "platform", "url", F.when(trusted, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), F.when(trusted, "keep").otherwise(F.col("verdict")).alias("verdict"), trusted.alias("trusted"))


def best_site(df: DataFrame, stop_at: float = 0.7) -> DataFrame:
    """(id, url, confidence, verdict, position): sites read in order up to the first ``keep`` of ``stop_at`` or more; of these the most confident, the earliest on a tie (WIN-7)."""
    w = Window.partitionBy("id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    stop = (F.col("verdict") == "keep") & (F.col("confidence") >= stop_at)
    read = df.withColumn("_over", F.coalesce(F.max(stop).over(w), F.lit(False))).filter("NOT _over")
    return distinct_on(read, ["id"], [F.desc("confidence"), F.col("position")]).select("id", "url", "confidence", "verdict", "position")


def judge_requests(registry: DataFrame, candidates: DataFrame, page_text: DataFrame, max_sites: int = 2) -> DataFrame:
    """(id, platform, url, payload): what is put before a judge, per social candidate and per plausible site, with its page's text (PRJ-19)."""
    social = candidates.filter("kind = 'social'").select("id", "platform", "url", "title", F.lit(None).cast("string").alias("text"))
    site = candidates.filter("kind = 'site' AND (score >= 2 OR name_in_domain > 0)").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "rank", "url"))).filter(F.col("r") <= max_sites)
    site = site.join(page_text.select("url", "text"), "url", "left").select("id", F.lit("website").alias("platform"), "url", "title", "text")
    about = registry.select("id", F.concat_ws("\n", F.col("name"), F.col("city"), F.substring(F.coalesce("description", F.lit("")), 1, 500)).alias("about"))
    return social.unionByName(site).join(about, "id").select("id", "platform", "url", F.concat_ws("\n---\n", "about", "url", F.coalesce("text", "title")).alias("payload"))


def parse_verdicts(df: DataFrame, raw: str = "response") -> DataFrame:
    """``df`` with verdict, confidence and reason read from a JSON object somewhere in a text (PRJ-20)."""
    body = F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)\{.*\}", 0)
    obj = F.from_json(body, "verdict string, confidence string, reason string")
    v, c = F.lower(F.trim(obj["verdict"])), F.expr("try_cast(_o.confidence AS double)")
    out = df.withColumn("_o", obj)
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.isnan(c), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))))
    return out.withColumns({"verdict": F.when(F.lower(F.trim("_o.verdict")).isin("keep", "quarantine", "drop"), F.lower(F.trim("_o.verdict"))).otherwise("quarantine"), "confidence": conf, "reason": F.substring(F.coalesce("_o.reason", F.lit("")), 1, 240)}).drop("_o")


def resolve(quarantine: DataFrame, links: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, quarantine, audit) after moderation (DEC-17): keep moves a quarantined link to the links, drop to the audit; actions on what is not there do nothing, so a second run changes nothing.

    quarantine and links: id, platform, url; actions: id, platform, action; the last action by ``position`` counts.
    """
    act = distinct_on(actions, ["id", "platform"], [F.desc("position")]).select("id", "platform", "action")
    met = quarantine.join(act, ["id", "platform"], "left")
    kept = met.filter("action = 'keep'").select("id", "platform", "url")
    out = links.join(kept.select("id", "platform"), ["id", "platform"], "left_anti").select("id", "platform", "url").unionByName(kept)
    audit = met.filter("action = 'drop'").select("id", "platform", "url", F.lit("manual").alias("reason"))
    return out, met.filter("action IS NULL OR action NOT IN ('keep', 'drop')").drop("action"), audit


def moderation_queue(registry: DataFrame, quarantine: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """A page of entities with something in quarantine, by name, with how much and the total (DEC-18)."""
    n = quarantine.groupBy("id").agg(F.count("*").alias("n_links"))
    rows = registry.join(n, "id")
    one = F.lit(1).alias("_1")
    total = rows.agg(F.count("*").alias("total")).select("total", one)
    return rows.select("*", one).join(F.broadcast(total), "_1").drop("_1").orderBy("name", "id").offset((page - 1) * limit).limit(limit)


def promote(df: DataFrame, verdicts: DataFrame, min_conf: float = 0.7) -> DataFrame:
    """``df`` (id, website, social_site) with website set where a site was kept with enough confidence and none is served; ``examined`` marks rows with a verdict (DEC-15).

    Of verdicts of one confidence and url the first by ``position`` counts, in whatever order the rows come.
    """
    v = distinct_on(verdicts.filter("platform = 'website'"), ["id"], [F.desc("confidence"), F.col("url"), F.col("position")]).select("id", F.col("url").alias("_u"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    out = df.join(v, "id", "left")
    free = F.nullif(F.coalesce("website", F.lit("")), F.lit("")).isNull() & F.nullif(F.coalesce("social_site", F.lit("")), F.lit("")).isNull()
    ok = free & (F.col("_v") == "keep") & (F.col("_c") >= min_conf)
    return out.withColumns({"promoted": F.coalesce(ok, F.lit(False)), "website": F.when(ok, F.col("_u")).otherwise(F.col("website")), "examined": F.col("_v").isNotNull()}).drop("_u", "_v", "_c")
