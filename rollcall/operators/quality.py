"""The quality score of an entity: coverage, verification, health and freshness, 100 points in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of each part, days of full and of no credit, tier limits.
WEIGHTS = {
    "website": 15, "social": 12, "donation": 8,
    "judged": 15, "confidence": 10,
    "no_dead": 14, "all_alive": 6,
    "fresh_verified": 7, "fresh_health": 5, "fresh_press": 2, "has_press": 2, "upcoming": 4,
}
LEGACY_SHARE = 0.45
DECAY = {"verified": (90, 365), "health": (21, 90), "press": (60, 365)}
TIERS = ((80, "A"), (60, "B"), (40, "C"))
STALE_DAYS = 180


def decay(age_days: Column, full: float, zero: float) -> Column:
    """1 up to ``full`` days, 0 from ``zero`` on, linear between; 0 for null."""
    return F.when(age_days.isNull(), 0.0).when(age_days <= full, 1.0).when(age_days >= zero, 0.0).otherwise((zero - age_days) / (zero - full))


def quality(df: DataFrame, now: Column, w: dict[str, int] = WEIGHTS) -> DataFrame:
    """``df`` with score, tier and flags (DEC-16). Times in epoch seconds.

    Columns: has_website, has_social, has_donation (boolean), judged ('model', 'legacy' or null), mean_confidence (of kept served links),
    n_checked, n_dead, n_alive (testable links by state), has_quarantine, verified_at, health_at, press_at, n_press, n_upcoming, n_upcoming_matched.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    pts = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    age = lambda c: (now - F.col(c)) / 86400.0
    site, social, gift = yes("has_website"), yes("has_social"), yes("has_donation")
    linked, checked = site | social | gift, num("n_checked") > 0
    waiting = ~checked & (site | gift)
    total = (
        pts(site, w["website"]) + pts(social, w["social"]) + pts(gift, w["donation"])
        + pts(linked & (F.col("judged") == "model"), w["judged"]) + pts(linked & (F.col("judged") == "legacy"), w["judged"] * LEGACY_SHARE)
        + w["confidence"] * F.coalesce(F.col("mean_confidence"), F.lit(0.0))
        + pts(checked & (num("n_dead") == 0), w["no_dead"]) + pts(checked & (num("n_alive") == num("n_checked")), w["all_alive"])
        + pts(waiting, (w["no_dead"] + w["all_alive"]) * 0.5)
        + F.when(linked, w["fresh_verified"] * decay(age("verified_at"), *DECAY["verified"]) + w["fresh_health"] * decay(age("health_at"), *DECAY["health"])).otherwise(0.0)
        + w["fresh_press"] * decay(age("press_at"), *DECAY["press"])
        + pts(num("n_press") > 0, w["has_press"]) + pts(num("n_upcoming") > 0, w["upcoming"])
    )
    flag = lambda cond, name: F.when(cond, name)
    flags = F.array_compact(F.array(
        flag(~site, "no_website"), flag(~social, "no_social"), flag(~gift, "no_donation"),
        flag(F.col("judged") == "legacy", "verif_legacy"), flag(F.col("judged").isNull(), "verif_missing"),
        flag(checked & (num("n_dead") > 0), "dead_link_pending"), flag(waiting, "health_unchecked"), flag(~checked & ~waiting, "no_link"),
        flag(yes("has_quarantine"), "has_quarantine"), flag(num("n_press") == 0, "no_press"),
        flag(num("n_upcoming") > 0, "has_agenda"), flag(num("n_upcoming_matched") > 0, "agenda_own"),
        flag(age("verified_at") > STALE_DAYS, "stale_verif"),
    ))
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(total, 0).cast("int")))
    tier = F.lit("D")
    for least, name in reversed(TIERS):
        tier = F.when(F.col("score") >= least, name).otherwise(tier)
    return df.withColumns({"points": total, "score": score, "flags": flags}).withColumn("tier", tier)
