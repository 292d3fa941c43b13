"""Queries of sources, sinks and streams: each writes the given rows to the shared folder and reads them by the operator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import decide, listing
from ..queries import ORACLE, query
from ..sources import registry as sinks
from ..sources.keyed import KeyedTable
from ..sources.shared import shared_folder
from ..streaming import jobs
from .adapters import NOW, duck, read, registry, sql, view
from .decision_queries import ISLANDS
from .stats_queries import NEAR


def stream(spark, sf, name):
    """A table as a file stream; a pattern, because a stream's plain path must be a folder and a table may be one file."""
    return spark.readStream.schema(read(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("SRC-1", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS titre, c_mktsegment || ' \"x\"' AS objet, CAST(NULL AS VARCHAR) AS siteweb FROM customer")
def register_file(spark, sf):
    path = shared_folder(spark)
    rows = read(spark, sf, "customer").selectExpr("c_custkey AS id", "concat('  ', c_name) AS titre", "concat(c_mktsegment, ' \"x\"') AS objet", "CAST(NULL AS string) AS siteweb")
    rows.write.csv(path, sep=";", header=True, compression="gzip", escape='"', ignoreLeadingWhiteSpace=False)
    return sinks.read_registry(spark, path).drop("_corrupt_record")


@query("SRC-2", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS city, CAST(NULL AS VARCHAR) AS currentWebsite FROM customer")
def entity_file(spark, sf):
    path = shared_folder(spark)
    rows = read(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 1000).alias("file"), F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city")).alias("e"))
    rows.groupBy("file").agg(F.to_json(F.collect_list("e")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    out = shared_folder(spark)
    sinks.write_results_json(sinks.read_entities_json(spark, path), out)
    return spark.read.schema(sinks.ENTITY).json(out).drop("postalCode")


def by_cell(spark, sf):
    """The registry as it is kept for boxes."""
    path = shared_folder(spark)
    sinks.write_by_cell(view(spark, sf, "registry"), path)
    return spark.read.parquet(path)


@query("FLT-3-cells", ORACLE["FLT-3"])
def boxed_by_cell(spark, sf):
    return by_cell(spark, sf).filter(geo.in_cells("-2,43,4,48.5") & geo.in_box("-2,43,4,48.5")).select("id")


@query("WIN-1-cells", ORACLE["WIN-1"])
def page_by_cell(spark, sf):
    return listing.list_page(by_cell(spark, sf), replace(NEAR, cells=True)).select("id", "name", F.floor("dist_m").cast("long").alias("dist_m"))


@query("SRC-8", "SELECT event_type AS kind, ('/p/' || event_id || repeat('x', 200))[1:120] AS path, '440' AS dept, CAST(user_id AS VARCHAR) AS visitor FROM events")
def visit_log(spark, sf):
    out = shared_folder(spark)
    hits = stream(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS ts", "event_type AS kind", "concat('/p/', event_id, repeat('x', 200)) AS path", "'44000' AS dept", "CAST(user_id AS string) AS visitor")
    sinks.append_visits(hits, f"{out}/log", f"{out}/at").awaitTermination()
    return spark.read.parquet(f"{out}/log").drop("ts")


def appended(df, out):
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/rows")


def stream_view(spark, sf, name):
    """A view over the streamed events."""
    return spark.sql(sql(name, "spark").replace("FROM events", "FROM {events}"), events=stream(spark, sf, "events"))


@query("STR-1", duck("probes") + ISLANDS + "SELECT id, platform, seq, status, consecutive_failures, first_fail_at FROM folded")
def health(spark, sf):
    """The state of every link after every probe, from the stream."""
    probes = stream_view(spark, sf, "probes").select("id", "platform", "url", "status", "checked_at", "seq")
    return appended(jobs.health_stream(probes), shared_folder(spark)).select("id", "platform", "seq", "status", "consecutive_failures", "first_fail_at")


DEATHS = """, due AS (SELECT *, CASE WHEN http_code IN (404, 410) THEN checked_at ELSE greatest(checked_at, first_fail_at + 43200) END AS dead_at, lead(checked_at) OVER (PARTITION BY id, platform ORDER BY checked_at, seq) AS next_at FROM folded)
SELECT id, platform, min(dead_at) AS dead_at, min_by(seq, (dead_at, checked_at, seq)) AS seq, min_by(url, (dead_at, checked_at, seq)) AS url, min_by(consecutive_failures, (dead_at, checked_at, seq)) AS consecutive_failures
FROM due WHERE status = 'dead' AND consecutive_failures >= 2 AND (dead_at = checked_at OR coalesce(dead_at < next_at, dead_at <= (SELECT max(checked_at) FROM probes) - 3600)) GROUP BY id, platform, run"""


@query("STR-1-deaths", duck("probes") + ISLANDS + DEATHS)
def deaths(spark, sf):
    """The confirmed deaths of the same stream: its second output."""
    probes = stream_view(spark, sf, "probes").select("id", "platform", "url", "status", "checked_at", "seq", "http_code")
    out = shared_folder(spark)
    jobs.health_job(probes, f"{out}/rows", f"{out}/at").awaitTermination()
    rows = spark.read.schema(jobs.HEALTH_OUT + ", batch int").parquet(f"{out}/rows").filter("kind = 'death'")
    return rows.select("id", "platform", F.col("checked_at").alias("dead_at"), "seq", "url", "consecutive_failures")


@query("STR-2", duck("marks") + """, n AS (SELECT client, seq, secs, row_number() OVER (PARTITION BY client ORDER BY secs, seq) AS r FROM marks),
f AS (WITH RECURSIVE f AS (
  SELECT client, seq, r, true AS accepted, [secs] AS recent FROM n WHERE r = 1
  UNION ALL
  SELECT n.client, n.seq, n.r, len(list_filter(recent, lambda x: x > secs - 3600)) < 6, CASE WHEN len(list_filter(recent, lambda x: x > secs - 3600)) < 6 THEN list_append(list_filter(recent, lambda x: x > secs - 3600), secs) ELSE list_filter(recent, lambda x: x > secs - 3600) END
  FROM f JOIN n ON n.client = f.client AND n.r = f.r + 1) SELECT * FROM f)
SELECT client, seq, accepted FROM f""")
def limited(spark, sf):
    """The rate limit on all events, from the stream."""
    hits = stream_view(spark, sf, "marks").select(F.col("client").cast("long").alias("client"), "seq", F.col("secs").cast("double").alias("at"))
    return appended(jobs.rate_limit_stream(hits, 6, 3600.0), shared_folder(spark)).select("client", "seq", "accepted")


AGENT = "CASE WHEN user_id % 13 = 0 THEN 'Some-Bot/1' WHEN user_id % 17 = 0 THEN '' ELSE 'Firefox/' || user_id % 3 END"


@query("STR-3", f"""WITH h AS (SELECT ts, event_type AS kind, {AGENT} AS agent, '10.0.' || user_id % 40 AS ip FROM events)
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, kind, count(DISTINCT sha256(concat_ws('|', ip, agent, strftime(ts, '%Y-%m-%d'), 'salt'))[1:16]) AS visitors FROM h WHERE agent LIKE 'Firefox%' AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(date_trunc('milliseconds', ts)) FROM h WHERE agent LIKE 'Firefox%') - INTERVAL 1 DAY GROUP BY ALL""")
def visitors(spark, sf):
    """Days that the watermark has closed, without robots, visitors by their daily hash."""
    hits = stream(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS ts", "event_type AS kind", f"{AGENT} AS agent", "'10.0.' || user_id % 40 AS ip")
    return appended(jobs.visitors_stream(jobs.human_visitors(hits, "salt")), shared_folder(spark)).withColumn("day", F.to_date("day"))


@query("STR-6", """WITH w AS (SELECT epoch_us(ts) AS us, unnest(range(CAST(epoch_us(ts) // 600000000 AS BIGINT) - 11, CAST(epoch_us(ts) // 600000000 AS BIGINT) + 1)) * 600 AS s FROM events)
SELECT s AS start, count(*) AS n, CASE WHEN count(*) > 1 THEN CAST(floor((max(us) - min(us)) / (count(*) - 1) / 1e3 + 0.5e0) AS BIGINT) END AS ms_per_row FROM w GROUP BY s HAVING (s + 7200) * 1000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 7200000000""")
def throughput(spark, sf):
    marks = stream(spark, sf, "events").selectExpr("CAST(ts AS timestamp) AS ts")
    rows = appended(jobs.throughput_stream(marks), shared_folder(spark))
    return rows.select(F.unix_seconds("start").alias("start"), "n", F.floor(F.col("us_per_row") / 1e3 + 0.5).alias("ms_per_row"))


@query("STR-4", ORACLE["JN-1"])
def register_drops(spark, sf):
    out = shared_folder(spark)
    base = read(spark, sf, "orders").filter("o_orderkey % 3 <> 2").selectExpr("o_orderkey AS ext_id", "o_orderpriority AS name", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 + 0.5D END AS lng", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 40 + 0.25D END AS lat", "'pending' AS status", "'manual' AS source", "0L AS updated_at")
    table = KeyedTable(spark, f"{out}/register", base.schema)
    table.write(base)
    drops = stream(spark, sf, "orders").selectExpr("o_orderkey div 2 * 2 AS ext_id", "concat('new ', o_orderpriority) AS name", "CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 7 + 0.5D END AS lng", "CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey % 9 + 0.5D END AS lat", "o_orderkey AS position")
    jobs.registry_stream(drops, table, f"{out}/at", F.lit(NOW).cast("long")).awaitTermination()
    return table.read()


@query("STR-5", ORACLE["DEC-17"])
def moderation(spark, sf):
    out = shared_folder(spark)
    v = view(spark, sf, "verdicts")
    acts = stream(spark, sf, "orders").filter("o_orderkey % 5 = 0").selectExpr("o_custkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'website' WHEN 1 THEN 'facebook' ELSE 'instagram' END AS platform", "o_orderkey AS position", "CASE WHEN o_orderkey % 2 = 0 THEN 'keep' ELSE 'drop' END AS action")
    jobs.moderation_stream(acts, f"{out}/actions", f"{out}/at").awaitTermination()
    actions = spark.read.parquet(f"{out}/actions").drop("v")
    by = lambda verdict: v.filter(F.col("verdict") == verdict).groupBy("id", "platform").agg(F.min("url").alias("url"))
    links, quarantine, audit = decide.resolve(by("quarantine"), by("keep"), actions)
    at = lambda df, name: df.select("id", "platform", "url", F.lit(name).alias("place"))
    return at(links, "link").unionByName(at(quarantine, "quarantine")).unionByName(at(audit, "audit"))
