"""Operator inputs from the driver's tables: SQL that Spark and DuckDB read alike, so both sides of a check start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
NOW = 1_735_689_600  # the "now" of every query, in epoch seconds

VIEWS = {
    "registry": """
SELECT c_custkey AS id, concat('R', cast(c_custkey AS string)) AS ext_id, concat(p_name, ' ', c_mktsegment) AS name,
  concat(n_name, ' ', cast(c_custkey % 4 AS string)) AS city, lpad(cast(n_nationkey AS string), 2, '0') AS department, r_name AS region,
  c_mktsegment AS category_id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE concat(p_type, ' ', p_brand) END AS description,
  CASE WHEN c_custkey % 3 = 0 THEN concat('https://www.', replace(p_name, ' ', '-'), '.org/') END AS website,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE -4 + (c_custkey * 104729 % 11000) / 1e3 END AS lng,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 42 + (c_custkey * 7919 % 8000) / 1e3 END AS lat,
  CASE WHEN c_custkey % 10 = 0 THEN 'pending' ELSE 'published' END AS status, 'registry' AS source,
  c_custkey % 3 = 0 AS l_website, c_custkey % 4 = 0 AS l_facebook, c_custkey % 5 = 0 AS l_instagram, c_custkey % 11 = 0 AS l_linkedin, c_custkey % 6 = 0 AS l_donation,
  1704067200 + (c_custkey % 400) * 86400 AS updated_at, CASE WHEN c_custkey % 3 = 1 THEN 1704067200 + c_custkey % 1000 END AS enriched_at, c_acctbal AS score,
  c_custkey % 5 = 1 AS m_fb, c_custkey % 6 = 2 AS m_ig, c_custkey % 7 = 3 AS m_gift, c_custkey % 8 = 4 AS m_web,
  c_custkey % 9 = 1 AS k_fb, c_custkey % 9 = 2 AS k_ig, c_custkey % 9 = 3 AS k_gift, c_custkey % 4 <> 3 AS discovered, p_name, p_brand
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = c_custkey % 200""",
    "territories": "SELECT lpad(cast(n_nationkey AS string), 2, '0') AS department, n_name AS territory, r_name AS region, cast(n_nationkey AS bigint) AS position FROM nation JOIN region ON n_regionkey = r_regionkey",
    "results": """
SELECT l_partkey AS id, l_linenumber AS rank, concat(CASE WHEN l_orderkey % 3 = 0 THEN p_name ELSE p_brand END, ' page ', cast(l_suppkey % 5 AS string)) AS title,
  CASE l_orderkey % 10
    WHEN 0 THEN concat('https://www.facebook.com/', replace(p_name, ' ', '-'), '/')
    WHEN 1 THEN concat('https://facebook.com/people/x/', cast(l_orderkey AS string))
    WHEN 2 THEN concat('https://www.facebook.com/', cast(1000000 + l_orderkey AS string))
    WHEN 3 THEN concat('https://instagram.com/', replace(p_name, ' ', '_'))
    WHEN 4 THEN concat('https://www.helloasso.com/associations/', replace(p_name, ' ', '-'))
    WHEN 5 THEN concat('http://', replace(p_name, ' ', '-'), '.example.org/a')
    WHEN 6 THEN concat('https://www.', replace(p_name, ' ', ''), '.fr')
    WHEN 7 THEN 'https://example-directory.org/x'
    WHEN 8 THEN concat('https://linkedin.com/company/', replace(p_name, ' ', '-'))
    ELSE concat('https://mairie-', cast(l_suppkey AS string), '.fr/', p_brand) END AS url,
  concat('see ', replace(p_name, ' ', '-'), '.org or https://x.com') AS body
FROM (SELECT l_partkey, l_linenumber, min(l_orderkey) AS l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey, l_linenumber) l JOIN part ON p_partkey = l_partkey""",
    "entities": "SELECT p_partkey AS id, p_name AS name, p_type AS city, p_brand AS department FROM part",
    "verdicts": """
SELECT o_custkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'website' WHEN 1 THEN 'facebook' ELSE 'instagram' END AS platform,
  concat('https://u', cast(o_orderkey % 7 AS string), '.org') AS url, o_orderkey AS position,
  (cast(floor(o_totalprice) AS bigint) % 1001) / 1e3 AS confidence, CASE o_orderstatus WHEN 'O' THEN 'keep' WHEN 'F' THEN 'quarantine' ELSE 'drop' END AS verdict,
  o_orderkey % 41 = 0 AS trusted, CASE o_orderkey % 5 WHEN 0 THEN 'slug' WHEN 1 THEN 'title' WHEN 2 THEN 'top1' WHEN 3 THEN 'fallback' ELSE 'odd' END AS match_type, cast(o_orderkey % 8 AS int) AS site_score
FROM orders""",
    "probes": """
SELECT user_id AS id, CASE event_id % 2 WHEN 0 THEN 'website' ELSE 'donation' END AS platform, concat('https://h', cast(user_id % 5 AS string), '.org/', CASE WHEN event_id % 50 = 0 THEN 'new' ELSE '' END) AS url,
  event_id AS seq, cast(floor(epoch_s) AS bigint) AS checked_at, CASE event_type WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'blocked' ELSE 'alive' END AS status,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 404 END WHEN 'signup' THEN 403 ELSE 200 END AS http_code
FROM {events_s} e""",
    "marks": "SELECT event_id AS seq, user_id AS client, cast(floor(epoch_s) AS bigint) AS secs, event_type AS kind, value FROM {events_s} e",
}


def sql(name: str, engine: str) -> str:
    """The text of a view for an engine."""
    secs = "unix_micros(cast(ts AS timestamp)) / 1e6" if engine == "spark" else "epoch_us(ts) / 1e6"
    events = f"(SELECT *, {secs} AS epoch_s FROM events)"
    return VIEWS[name].replace("{events_s}", events)


def duck(*names: str) -> str:
    """A WITH clause of views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({sql(n, 'duckdb')})" for n in names) + " "


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the driver's tables are bound by name, nothing is registered in the session."""
    import re

    text = sql(name, "spark")
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    bound = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text)
    return spark.sql(bound, **{t: read(spark, sf_dir, t) for t in used})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with its typed evidence: the map of served links, markers, platforms with candidates."""
    keep = lambda pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(c), F.lit(v)).alias("v")) for k, c, v in pairs]), lambda e: e["v"].isNotNull()))
    return view(spark, sf_dir, "registry").withColumns({
        "social": keep([(p, f"l_{p}", f"https://{p}/x") for p in ("website", "facebook", "instagram", "linkedin", "donation")]),
        "markers": keep([("fb_targeted", "m_fb", "1"), ("ig_targeted", "m_ig", "1"), ("donation_checked", "m_gift", "1"), ("web_targeted", "m_web", "1")]),
        "candidate_platforms": F.array_compact(F.array(F.when(F.col("k_fb"), "facebook"), F.when(F.col("k_ig"), "instagram"), F.when(F.col("k_gift"), "donation"))),
        "tags": F.array("p_brand"),
        "geo_approx": F.col("id") % 13 == 0,
    })
