"""Local agendas: event relevance, radius join, name match, capped fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import within_radius
from ..functions.text import STOPWORDS, overlap, tokens
from ..sources.shared import written


def normalize_events(raw: DataFrame) -> DataFrame:
    """Nested feed records as flat events; the end falls back on the last date, then the start; rows without latitude go (SRC-4)."""
    c = F.col
    text = F.concat_ws(" ", "title", "description", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "))
    return raw.filter(c("coordinates.lat").isNotNull()).select("uid", "title", c("begin").alias("start"), F.coalesce("end", "last_end", "begin").alias("end"), "date_label", "city", "place", "url", F.coalesce("thumbnail", "image").alias("image"), c("coordinates.lat").alias("lat"), c("coordinates.lon").alias("lng"), text.alias("text"))


def relevant_events(df: DataFrame, slugs: tuple[str, ...], noise: str, url: str = "url", text: str = "text") -> DataFrame:
    """Events whose source slug is not blocked and whose text is no noise (FLT-7)."""
    slug = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^https?://[^/]+/([^/?#]+)", 1)
    return df.filter(~slug.isin(*slugs) & ~F.coalesce(F.col(text), F.lit("")).rlike(f"(?i){noise}"))


def upcoming(events: Column, now: Column) -> Column:
    """The events of an array that start at ``now`` or later (FLT-18)."""
    return F.filter(events, lambda e: e["start"] >= now)


def _bits(words: Column) -> Column:
    """A set of words as 64 bits: sets without a common bit share no word."""
    one = F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))


def _own(min_len: int, stop) -> Column:
    """The long name tokens, city tokens removed."""
    return F.filter(F.array_except(tokens(F.col("name"), stop), tokens(F.col("city"), stop)), lambda t: F.length(t) >= min_len)


def own_words(df: DataFrame, min_len: int = 5, stop=STOPWORDS) -> DataFrame:
    """``df`` (name, city) with the long name tokens, city tokens removed, instead."""
    return df.withColumn("_own", _own(min_len, stop)).withColumn("_own_bits", _bits(F.col("_own"))).drop("name", "city")


def text_words(df: DataFrame, stop=STOPWORDS) -> DataFrame:
    """``df`` (text) with the tokens of the text instead."""
    return df.withColumn("_words", tokens(F.col("text"), stop)).withColumn("_word_bits", _bits(F.col("_words"))).drop("text")


def share_words(pairs: DataFrame, min_common: int = 2) -> DataFrame:
    """``pairs`` of ``own_words`` and ``text_words`` with ``matched``: at least ``min_common`` words (1 or more) in common."""
    matched = (F.col("_own_bits").bitwiseAND(F.col("_word_bits")) != 0) & (overlap(F.col("_own"), F.col("_words")) >= min_common)
    return pairs.withColumn("matched", matched).drop("_own", "_own_bits", "_words", "_word_bits")


def name_in_text(pairs: DataFrame, min_common: int = 2, min_len: int = 5, stop=STOPWORDS) -> DataFrame:
    """``pairs`` (name, city, text) with ``matched``: enough long name tokens, city tokens removed, in the text (JN-9)."""
    return pairs.withColumn("matched", overlap(_own(min_len, stop), tokens(F.col("text"), stop)) >= min_common)


def _sides(entities: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the radius join; words are taken from each row once, not from each pair."""
    a = entities.select(F.col("id").alias("a_id"), F.col("lng").alias("a_lng"), F.col("lat").alias("a_lat"), "name", "city")
    b = events.select(F.col("uid").alias("b_id"), F.col("lng").alias("b_lng"), F.col("lat").alias("b_lat"), "text")
    return own_words(a), text_words(b)


def named_events(entities: DataFrame, events: DataFrame, km: float = 12.0) -> DataFrame:
    """(a_id, b_id, dist_km, matched) of all events within the radius of every entity, ``matched`` as in ``name_in_text`` (JN-9)."""
    return share_words(within_radius(*_sides(entities, events), km)).select("a_id", "b_id", "dist_km", "matched")


def assign_agenda(pairs: DataFrame, cap: int = 6) -> DataFrame:
    """(a_id, pos, b_id, matched, dist): matched first, then the nearest, up to the cap; distance to one decimal (WIN-8)."""
    w = Window.partitionBy("a_id").orderBy(F.desc("matched"), "dist_km", "b_id")
    return pairs.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= cap).select("a_id", "pos", "b_id", "matched", (F.floor(F.col("dist_km") * 10 + 0.5) / 10).alias("dist"))


def contenders(entities: DataFrame, events: DataFrame, km: float = 12.0, cap: int = 6, closer: float = 4.0) -> DataFrame:
    """(a_id, b_id, dist_km, matched): of the events within the radius, all that may stand in the entity's agenda.

    The agenda of the events within a ``closer``-th of the radius is made first. Where it is full, its last event is a bound: an event that comes
    after it can't be among the first ``cap`` of the whole radius. Where it isn't, every event within the radius stays.
    """
    a, b = _sides(entities, events)
    last = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("matched"), "dist_km"))
    near = share_words(within_radius(a, b, km / closer)).select("a_id", "dist_km", "matched")
    bound = near.withColumn("_r", last).filter(F.col("_r") <= cap).filter(F.col("_r") == cap)  # the first filter keeps what is sorted small
    bound = written(bound.select("a_id", (F.col("dist_km") * (1 + 1e-9) + 1e-9).alias("_far"), F.col("matched").alias("_only")))
    met = share_words(within_radius(a.join(bound, "a_id", "left"), b, km))
    close = F.col("_far").isNull() | (F.col("dist_km") <= F.col("_far"))
    return met.filter(F.when(F.coalesce("_only", F.lit(False)), F.col("matched") & close).otherwise(close | F.col("matched"))).select("a_id", "b_id", "dist_km", "matched")


def agendas(entities: DataFrame, events: DataFrame, km: float = 12.0, cap: int = 6) -> DataFrame:
    """The agenda of every entity: events within the radius, name matches first."""
    return assign_agenda(contenders(entities, events, km, cap), cap)
