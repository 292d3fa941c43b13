"""Structured Streaming jobs, each with a batch twin of the same rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import drop_robots, visitor_id
from ..sources.keyed import KeyedTable
from ..sources.shared import written
from .stateful import HEALTH_OUT, Health, Limit, accept, with_state

def health_events(probes: DataFrame, min_fails: int = 2, min_age_hours: int = 12, late: str = "1 hour") -> DataFrame:
    """State changes and confirmed deaths of links (STR-1), by ``kind``: ``state`` after every probe, ``death`` once a run of failures is certain.

    A death is certain at a 404 or 410 that makes ``min_fails`` failures, or ``min_age_hours`` after the first failure (if the last probe then was a
    dead one): a timer says so, without another probe, when the watermark passes that time (its ``checked_at``). Probes: id, platform, url, status, checked_at
    (epoch seconds), seq, http_code; those later than ``late`` behind the newest one are dropped. The batch twins are ``health.fold_failures``
    and ``health.confirmed_deaths``.
    """
    timed = with_state(probes).withColumn("ts", F.timestamp_millis(F.col("checked_at") * 1000 + 1)).withWatermark("ts", late)
    code = F.col("http_code") if "http_code" in probes.columns else F.lit(None)
    timed = timed.select("id", "platform", "url", "status", "checked_at", "seq", code.cast("int").alias("http_code"), "ts")
    return timed.groupBy("id", "platform").transformWithState(Health(min_fails, min_age_hours * 3600), HEALTH_OUT, "append", "eventTime")


def health_stream(probes: DataFrame, **how) -> DataFrame:
    """The failure state of each link after every probe."""
    return health_events(probes, **how).filter("kind = 'state'").drop("kind", "http_code")


def health_job(probes: DataFrame, path: str, checkpoint: str, **how):
    """One stream with two outputs, ``path``/kind=state and ``path``/kind=death; a batch that is run again replaces itself."""

    def one(batch: DataFrame, k: int) -> None:
        for kind in ("state", "death"):
            batch.filter(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/kind={kind}/batch={k}")

    return health_events(probes, **how).writeStream.foreachBatch(lambda df, k: one(written(df), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit_stream(hits: DataFrame, max_hits: int, window_s: float = 60.0, late: str = "1 hour") -> DataFrame:
    """(client, seq, at, accepted) by the sliding limit (STR-2); hits: client (long), seq (long), at (double, seconds).

    A client's state goes when the watermark says that no window to come holds an accepted hit of it; hits later than ``late`` behind the newest are dropped.
    """
    timed = with_state(hits).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6 + 1000).cast("long"))).withWatermark("ts", late)
    return timed.select("client", "seq", "at", "ts").groupBy("client").transformWithState(Limit(max_hits, window_s), "client long, seq long, at double, accepted boolean", "append", "eventTime")


def rate_limit(hits: DataFrame, max_hits: int, window_s: float = 60.0) -> DataFrame:
    """The batch twin of ``rate_limit_stream``: one client's hits stream through, sorted, with its recent hits as the only state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, recent = None, []
        for f in frames:
            ok = []
            for c, t in zip(f["client"], f["at"]):
                if c != client:
                    client, recent = c, []
                ok.append(accept(t, recent, max_hits, window_s))
            yield f.assign(accepted=ok)[["client", "seq", "at", "accepted"]]

    dealt = hits.select("client", "seq", "at").repartition("client").sortWithinPartitions("client", "at", "seq")
    return dealt.mapInPandas(run, "client long, seq long, at double, accepted boolean")


def human_visitors(hits: DataFrame, salt: str, agent: str = "agent") -> DataFrame:
    """(ts, kind, visitor, ...) of hits (ts, kind, ip, agent): robots gone, a visitor known by a hash that holds for a day and tells nothing else."""
    people = drop_robots(hits, agent)
    return people.withColumn("visitor", visitor_id(F.col("ip"), F.col(agent), F.date_format("ts", "yyyy-MM-dd"), salt)).drop("ip", agent)


def visitors_stream(hits: DataFrame, late: str = "1 day", exact: bool = True) -> DataFrame:
    """(day, kind, visitors) of hits (ts, kind, visitor; see ``human_visitors``), closed by watermark (STR-3).

    Exact: a visitor counts once a day and kind, whose keys are held until the day is closed. ``exact=False`` holds a sketch a day and kind
    instead, with a relative error of 5 %.
    """
    day = F.window("ts", "1 day").alias("w")
    hits = hits.withWatermark("ts", late)
    if exact:
        counted = hits.select(day, "kind", "visitor").dropDuplicates(["w", "kind", "visitor"]).groupBy("w", "kind").agg(F.count("visitor").alias("visitors"))
    else:
        counted = hits.groupBy(day, "kind").agg(F.approx_count_distinct("visitor").alias("visitors"))
    return counted.select(F.col("w.start").alias("day"), "kind", "visitors")


def throughput_stream(marks: DataFrame) -> DataFrame:
    """(start, n, us_per_row, s_per_row) of marks (ts) over two hours, every ten minutes (STR-6); the span is counted in whole microseconds."""
    at = F.unix_micros("ts")
    w = marks.withWatermark("ts", "2 hours").groupBy(F.window("ts", "2 hours", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    each = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / (F.col("n") - 1))
    return w.select(F.col("w.start").alias("start"), "n", each.alias("us_per_row"), (each / 1e6).alias("s_per_row"))


def versioned(path: str, version: int) -> str:
    return f"{path}/v={version}"


def registry_stream(files: DataFrame, table: KeyedTable, checkpoint: str, now: Column):
    """New register rows appended to the log of a kept table, a batch at a time (STR-4); a batch that is run again changes nothing. ``table.read()`` has them merged."""

    def one(batch: DataFrame, k: int) -> None:
        table.append(batch, k, now)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moderation_stream(actions: DataFrame, path: str, checkpoint: str):
    """Moderation actions appended under their batch id, so that a batch that is run again replaces itself (STR-5); ``decide.resolve`` applies them."""

    def one(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(versioned(path, k))

    return actions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
