"""Queries of the statistics, windows, sinks and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import kept, listing, search, stats
from ..operators.health import classify_probe
from ..operators.kept_index import KeptIndex
from ..queries import ORACLE, query
from ..sources import registry as sinks
from ..sources.shared import shared_folder
from .adapters import NOW, duck, read, registry, view
from .columns_queries import PENDING, docs_of

LINKED = "l_website OR l_facebook OR l_instagram OR l_linkedin OR l_donation"
ASPECTS = {"located": "lng IS NOT NULL", "described": "description IS NOT NULL", "website": "l_website", "facebook": "l_facebook", "linkedin": "l_linkedin", "instagram": "l_instagram", "linked": LINKED, "enriched": "enriched_at IS NOT NULL"}
PCT = lambda n: f"CASE WHEN count(*) = 0 THEN 0e0 ELSE floor({n} * 1e3 / count(*) + 0.5e0) / 1e1 END"
COVER = "count(*) AS total, " + ", ".join(f"count(*) FILTER ({w}) AS n_{k}, {PCT(f'count(*) FILTER ({w})')} AS pct_{k}" for k, w in ASPECTS.items()) + f", count(*) - count(*) FILTER ({LINKED}) AS n_empty, {PCT(f'(count(*) - count(*) FILTER ({LINKED}))')} AS pct_empty"
PUB = "FROM registry WHERE status = 'published'"


@query("AGG-1", duck("registry") + f"SELECT {COVER} {PUB}")
def coverage(spark, sf):
    return stats.coverage(registry(spark, sf))


@query("AGG-2", duck("registry") + f"SELECT department, {COVER} {PUB} GROUP BY department")
def coverage_by(spark, sf):
    return stats.coverage(registry(spark, sf), "department")


MARK = {"instagram": "m_ig", "facebook": "m_fb", "donation": "m_gift", "website": "m_web"}


@query("AGG-3", duck("registry") + "SELECT *, CASE WHEN scanned + remaining = 0 THEN 100e0 ELSE floor(scanned * 1e3 / (scanned + remaining) + 0.5e0) / 1e1 END AS pct FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS platform, count(*) FILTER ({MARK[p]}) AS scanned, count(*) FILTER ({w}) AS remaining, count(*) FILTER (l_{p}) AS validated FROM registry" for p, w in PENDING.items()) + ")")
def progress(spark, sf):
    return stats.progress(registry(spark, sf))


# territories before 04 have been worked through: their rows are discovered and marked
DONE = "department < '04'"
WORK = f", worked AS (SELECT * REPLACE ({', '.join(f'{c} OR {DONE} AS {c}' for c in ('discovered', *MARK.values()))}) FROM registry), work AS (SELECT department, count(*) AS n FROM worked WHERE lng IS NOT NULL AND (NOT discovered OR {' OR '.join(f'({w})' for w in PENDING.values())}) GROUP BY department HAVING count(*) > 20), head AS (SELECT coalesce(min(position), (SELECT max(position) FROM territories)) AS place FROM territories JOIN work USING (department))"


def active(spark, sf):
    marked = F.create_map(*[F.lit(x) for p in stats.PASSES for x in (p.marker, "1")])
    done = registry(spark, sf).withColumns({"discovered": F.col("discovered") | F.expr(DONE), "markers": F.when(F.expr(DONE), marked).otherwise(F.col("markers"))})
    return stats.active_territory(done, view(spark, sf, "territories"))


@query("AGG-5", duck("registry", "territories") + WORK + " SELECT max(CASE WHEN position = place THEN department END) AS active, max(CASE WHEN position = place + 1 THEN department END) AS next, coalesce(string_agg(CASE WHEN position < place THEN department END, ',' ORDER BY department), '') AS done FROM territories, head")
def active_territory(spark, sf):
    return active(spark, sf).select("active", "next", F.array_join("done", ",").alias("done"))


@query("JN-18", duck("registry", "territories") + WORK + " SELECT department, CASE WHEN position = place THEN 'active' WHEN position < place THEN 'done' ELSE 'waiting' END AS state FROM territories, head")
def states(spark, sf):
    return stats.territory_states(view(spark, sf, "territories"), active(spark, sf))


@query("AGG-6", duck("registry") + f"SELECT department, city, count(*) AS n, max(updated_at) AS updated {PUB} GROUP BY ALL")
def localities(spark, sf):
    return stats.locality_index(view(spark, sf, "registry"))


@query("AGG-7", duck("registry") + f"SELECT *, CAST(sum(n) OVER w AS BIGINT) AS theme_total, count(*) OVER w AS n_localities FROM (SELECT department, category_id, city, count(*) AS n {PUB} GROUP BY ALL) WINDOW w AS (PARTITION BY department, category_id)")
def themes(spark, sf):
    return stats.theme_localities(view(spark, sf, "registry"))


@query("AGG-8", duck("registry") + f"SELECT DISTINCT department, category_id {PUB} AND department < '20'")
def combos(spark, sf):
    return stats.combos(view(spark, sf, "registry"), view(spark, sf, "territories").filter("department < '20'"))


@query("AGG-9", duck("registry") + f"SELECT region, department, count(*) AS n, count(DISTINCT city) AS n_localities, CAST(grouping_id(region, department) AS BIGINT) AS level {PUB} GROUP BY ROLLUP (region, department)")
def rollup(spark, sf):
    return stats.territory_rollup(view(spark, sf, "registry"))


def kept_counts(spark, sf):
    """Counts of an older registry brought up to date: a third of the rows is new, a fifth was elsewhere and otherwise, others are deleted."""
    now = registry(spark, sf)
    gone = now.filter("id % 7 = 2").withColumn("id", F.col("id") + 1_000_000_000)
    was = now.filter("id % 3 <> 0 AND id % 5 = 1").withColumns({"department": F.lit("00"), "city": F.concat(F.lit("old "), "city"), "social": F.map_filter("social", lambda k, v: k == "website"), "status": F.lit("published"), "markers": F.lit(None).cast("map<string,string>")})
    table = kept.KeptCounts(spark, shared_folder(spark))
    table.write(now.filter("id % 3 <> 0 AND id % 5 <> 1").unionByName(was).unionByName(gone))
    table.apply(was.unionByName(gone), now.filter("id % 3 = 0 OR id % 5 = 1"))
    return table.read(1)


@query("AGG-1-kept", ORACLE["AGG-1"])
def coverage_kept(spark, sf):
    return kept.coverage(kept_counts(spark, sf))


@query("AGG-2-kept", ORACLE["AGG-2"])
def coverage_by_kept(spark, sf):
    return kept.coverage(kept_counts(spark, sf), "department")


@query("AGG-3-kept", ORACLE["AGG-3"])
def progress_kept(spark, sf):
    return kept.progress(kept_counts(spark, sf))


@query("AGG-9-kept", ORACLE["AGG-9"])
def rollup_kept(spark, sf):
    return kept.territory_rollup(kept_counts(spark, sf))


@query("AGG-10", duck("registry") + f"SELECT department, city, count(*) AS total, array_to_string(list_sort(list_distinct(list(category_id))), ',') AS themes, greatest(count(*) - 5, 0) AS n_remaining, array_to_string((list(id ORDER BY name, id))[1:5], ',') AS shown {PUB} GROUP BY ALL")
def locality_pages(spark, sf):
    return stats.locality_pages(view(spark, sf, "registry"), 5).select("department", "city", "total", "themes", "n_remaining", F.array_join(F.transform("shown", lambda x: x["id"].cast("string")), ",").alias("shown"))


@query("AGG-11", duck("registry") + "SELECT greatest(max(updated_at), 1720000000) AS fresh FROM registry")
def fresh(spark, sf):
    return stats.freshness(view(spark, sf, "registry"), F.lit(1720000000).cast("long"))


STEPS = {"total": "true", "discovered": "discovered", "with_candidates": "k_fb OR k_ig OR k_gift", "with_facebook": "l_facebook", "with_site": "l_website", "enriched": "enriched_at IS NOT NULL"}


@query("AGG-12", duck("registry") + " UNION ALL ".join(f"SELECT '{k}' AS step, count(*) FILTER ({w}) AS n FROM registry" for k, w in STEPS.items()) + " UNION ALL SELECT 'removed', CAST(sum(id % 3) AS BIGINT) FROM registry")
def funnel(spark, sf):
    return stats.funnel(view(spark, sf, "registry"), {k: F.expr(w) for k, w in STEPS.items()} | {"removed": F.col("id") % 3})


TIER = "CASE WHEN sc >= 80 THEN 'A' WHEN sc >= 60 THEN 'B' WHEN sc >= 40 THEN 'C' ELSE 'D' END"


@query("AGG-13", duck("registry") + f"SELECT {TIER} AS tier, count(*) AS n, floor(sum(sc) * 1e1 / count(*) + 0.5e0) / 1e1 AS mean FROM (SELECT CAST(id * 37 % 101 AS BIGINT) AS sc FROM registry) GROUP BY 1")
def tiers(spark, sf):
    return stats.tiers(view(spark, sf, "registry").selectExpr("id * 37 % 101 AS sc").selectExpr(f"{TIER} AS tier", "sc AS score"))


T = 1_705_000_000


@query("AGG-14", duck("marks") + f"SELECT n, span_s, span_s / (n - 1) AS s_per_row, 60e0 / (span_s / (n - 1)) AS rows_per_min, span_s / (n - 1) * greatest(1000 - n, 0) AS eta_s FROM (SELECT count(*) AS n, max(secs) - min(secs) AS span_s FROM marks WHERE secs > {T} - 7200 AND secs <= {T})")
def throughput(spark, sf):
    return stats.throughput(view(spark, sf, "marks"), F.lit(T), F.lit(1000), at="secs")


@query("AGG-15", duck("registry") + "SELECT department, CAST(floor(avg(lat) * 1e6 + 0.5) AS BIGINT) AS lat, CAST(floor(avg(lng) * 1e6 + 0.5) AS BIGINT) AS lng FROM registry WHERE lng IS NOT NULL GROUP BY department")
def centroids(spark, sf):
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c)
    return stats.centroids(view(spark, sf, "registry")).select("department", micro("lat"), micro("lng"))


PYRAMID = """, leaf AS (SELECT CAST(floor((lng + 180) / 360 * 256 * 512 / 64) AS BIGINT) AS x, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 512 / 64) AS BIGINT) AS y, category_id FROM registry WHERE lng IS NOT NULL),
c AS (SELECT zoom, x >> (9 - zoom) AS cx, y >> (9 - zoom) AS cy, category_id, count(*) AS k FROM leaf, range(0, 10) AS z(zoom) GROUP BY ALL)
SELECT CAST(zoom AS INT) AS zoom, cx, cy, CAST(sum(k) AS BIGINT) AS n, (list(category_id ORDER BY k DESC, category_id))[1] AS top_category, CASE WHEN sum(k) < 10 THEN 's' WHEN sum(k) < 100 THEN 'm' WHEN sum(k) < 1000 THEN 'l' ELSE 'xl' END AS size FROM c GROUP BY zoom, cx, cy"""


@query("AGG-16-zooms", duck("registry") + PYRAMID)
def pyramid(spark, sf):
    return stats.cluster_pyramid(view(spark, sf, "registry"), 9)


@query("AGG-16", duck("registry") + """, p AS (SELECT CAST(floor((lng + 180) / 360 * 256 * 512 / 56) AS BIGINT) AS cx, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 512 / 56) AS BIGINT) AS cy, category_id FROM registry WHERE lng IS NOT NULL),
c AS (SELECT cx, cy, category_id, count(*) AS k FROM p GROUP BY ALL)
SELECT cx, cy, CAST(sum(k) AS BIGINT) AS n, (list(category_id ORDER BY k DESC, category_id))[1] AS top_category, CASE WHEN sum(k) < 10 THEN 's' WHEN sum(k) < 100 THEN 'm' WHEN sum(k) < 1000 THEN 'l' ELSE 'xl' END AS size FROM c GROUP BY cx, cy""")
def clusters(spark, sf):
    return stats.cluster(view(spark, sf, "registry"), 9)


@query("AGG-17", duck("registry") + "SELECT lower(city) AS city_key, min(city) AS city, count(*) AS n, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM registry WHERE lng IS NOT NULL GROUP BY 1")
def extents(spark, sf):
    return stats.city_extents(view(spark, sf, "registry"))


NEAR = listing.ListingQuery(category="MACHINERY", box=(-3.0, 42.5, 6.0, 49.0), near=(1.5, 46.0), limit=50)
NEAR_WHERE = "status = 'published' AND category_id = 'MACHINERY' AND lng BETWEEN -3.0 AND 6.0 AND lat BETWEEN 42.5 AND 49.0"


@query("AGG-18", duck("registry") + f"SELECT count(*) AS total FROM registry WHERE {NEAR_WHERE}")
def total(spark, sf):
    return listing.page_total(view(spark, sf, "registry"), NEAR)


@query("AGG-19", "SELECT event_type AS status, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS day, count(*) AS n FROM events GROUP BY ALL")
def report(spark, sf):
    e = view(spark, sf, "marks").select(F.col("kind").alias("status"), F.floor(F.col("secs") / 86400).cast("long").alias("day"))
    return stats.run_report(e, "status", "day")


@query("AGG-20", "SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(DISTINCT user_id) AS visitors, count(*) AS hits FROM events GROUP BY ALL")
def daily(spark, sf):
    e = read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("user_id").alias("visitor"))
    return stats.daily_visitors(e)


@query("WIN-1", duck("registry") + f"SELECT id, name, CAST(floor(2 * 6371000 * asin(sqrt(pow(sin(radians(46.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(46.0)) * pow(sin(radians(1.5 - lng) / 2), 2)))) AS BIGINT) AS dist_m FROM registry WHERE {NEAR_WHERE} ORDER BY 3, name, id LIMIT 50")
def nearest(spark, sf):
    return listing.list_page(view(spark, sf, "registry"), NEAR).select("id", "name", F.floor("dist_m").cast("long").alias("dist_m"))


@query("WIN-1-quality", duck("registry") + "SELECT id FROM registry WHERE status = 'published' ORDER BY score DESC NULLS LAST, name, id LIMIT 20 OFFSET 40")
def best(spark, sf):
    return listing.list_page(view(spark, sf, "registry"), listing.ListingQuery(sort="quality", offset=40)).select("id")


@query("JN-6", duck("registry") + "SELECT id, CAST(floor(2 * 6371000 * asin(sqrt(pow(sin(radians(46.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(46.0)) * pow(sin(radians(1.5 - lng) / 2), 2))) / 10) AS BIGINT) AS decametres FROM registry WHERE lng IS NOT NULL")
def distances(spark, sf):
    return view(spark, sf, "registry").filter("lng IS NOT NULL").select("id", F.floor(geo.distance_m(1.5, 46.0) / 10).cast("long").alias("decametres"))


@query("WIN-2", duck("results") + "SELECT url, id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id, rank) AS r FROM results) WHERE r = 1")
def once(spark, sf):
    return listing.distinct_on(view(spark, sf, "results"), ["url"], [F.col("id"), F.col("rank")]).select("url", "id")


@query("WIN-5", duck("probes") + "SELECT url, id, platform, min(seq) AS seq FROM probes GROUP BY ALL")
def stable(spark, sf):
    return listing.dedup_stable(view(spark, sf, "probes"), ["id", "platform", "url"], "seq").select("id", "platform", "url", "seq")


LOC = f"loc AS (SELECT department, city, regexp_replace(lower(city), '[^a-z]+', '', 'g') AS slug, count(*) AS n {PUB} GROUP BY ALL)"


def locs(spark, sf):
    return stats.locality_index(view(spark, sf, "registry")).withColumn("slug", F.regexp_replace(F.lower("city"), "[^a-z]+", ""))


@query("WIN-9", duck("registry") + f", {LOC} SELECT department, city, CASE WHEN row_number() OVER (PARTITION BY department, slug ORDER BY position) = 1 THEN slug ELSE slug || '-' || position END AS unique_slug FROM (SELECT *, row_number() OVER (ORDER BY n, city) - 1 AS position FROM loc)")
def slug_collisions(spark, sf):
    return listing.unique_slugs(locs(spark, sf), order=("n", "city")).select("department", "city", "unique_slug")


@query("WIN-10", duck("registry") + f", {LOC}, o AS (SELECT a.department, a.city, b.city AS other, b.n AS other_size, row_number() OVER (PARTITION BY a.department, a.city ORDER BY b.n DESC, b.city) AS rank FROM loc a JOIN loc b ON a.department = b.department AND a.city <> b.city) SELECT * FROM o WHERE rank <= 2")
def neighbours(spark, sf):
    return listing.neighbours(locs(spark, sf), k=2).withColumn("rank", F.col("rank").cast("long"))


@query("WIN-11", duck("registry") + f", {LOC} SELECT city, n FROM loc WHERE contains(lower(city), 'n_1') ORDER BY starts_with(lower(city), 'n_1') DESC, n DESC, city LIMIT 4")
def suggestions(spark, sf):
    return listing.suggest_cities(locs(spark, sf), "N_1").select("city", "n")


@query("SRC-3", duck("registry") + "SELECT '{\"id\":' || id || ',\"name\":\"' || name || '\"}' AS value FROM registry WHERE lng IS NULL")
def lines(spark, sf):
    return sinks.unmatched_lines(view(spark, sf, "registry").filter("lng IS NULL").select("id", "name"))


@query("SRC-5", duck("registry") + "SELECT CAST((r - 1) // 100 AS BIGINT) AS batch, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM registry WHERE status = 'published') GROUP BY 1")
def batches(spark, sf):
    return sinks.export_batches(view(spark, sf, "registry").filter("status = 'published'"), 100)


@query("SRC-6", duck("registry") + f""", rows AS (
  SELECT 'https://x.org' || p AS loc, CAST(NULL AS BIGINT) AS lastmod, 'weekly' AS changefreq, '1.0' AS priority FROM (VALUES ('/'), ('/map'), ('/about')) t(p)
  UNION ALL SELECT 'https://x.org/place/' || department || '/' || replace(lower(city), ' ', '-'), max(updated_at), 'weekly', '0.6' {PUB} GROUP BY department, city
  UNION ALL SELECT 'https://x.org/org/' || id, updated_at, 'monthly', '0.5' {PUB})
SELECT *, CAST((row_number() OVER (ORDER BY priority, loc) - 1) // 500 AS BIGINT) AS chunk FROM rows""")
def sitemap(spark, sf):
    places = stats.locality_index(view(spark, sf, "registry")).withColumn("slug", F.replace(F.lower("city"), F.lit(" "), F.lit("-")))
    return sinks.sitemap_rows(view(spark, sf, "registry"), places, "https://x.org", 500)


@query("SRC-7", duck("registry") + "SELECT id, name, category_id AS category, city, id % 13 = 0 AS approx, lng, lat FROM registry WHERE lng IS NOT NULL AND NOT (lng BETWEEN -1 AND 1 AND lat BETWEEN -1 AND 1) ORDER BY id LIMIT 20000")
def geojson(spark, sf):
    shape = "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<id:bigint,name:string,category:string,city:string,approx:boolean>"
    f = sinks.to_geojson(registry(spark, sf)).select(F.from_json("feature", shape).alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query("SRC-9", "SELECT count(*) AS n_read, count(*) FILTER (c_acctbal < 0) AS n_skipped FROM customer")
def counters(spark, sf):
    df, seen = sinks.import_metrics(read(spark, sf, "customer"), F.col("c_acctbal") < 0, F.col("c_nationkey") > 3)
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["read"], seen.get["skipped"])], "n_read long, n_skipped long")


@query("JN-17", duck("registry", "territories") + f", s AS (SELECT department, count(*) AS total, count(*) FILTER ({LINKED}) AS n_linked {PUB} AND department < '15' GROUP BY 1) SELECT t.department, territory, region, coalesce(total, 0) AS total, coalesce(n_linked, 0) AS n_linked, CASE WHEN coalesce(total, 0) = 0 THEN 0e0 ELSE floor(n_linked * 1e3 / total + 0.5e0) / 1e1 END AS pct_linked FROM territories t LEFT JOIN s USING (department) WHERE contains(lower(territory), 'a') OR contains(lower(region), 'a')")
def dense(spark, sf):
    s = stats.coverage(registry(spark, sf).filter("department < '15'"), "department").select("department", "total", "n_linked")
    return stats.dense_territories(s, view(spark, sf, "territories").select("department", "territory", "region"), "A")


INDEX = """, fields AS (SELECT id, department, 0 AS priority, name AS x FROM docs UNION ALL SELECT id, department, 1, city FROM docs UNION ALL SELECT id, department, 2, category FROM docs UNION ALL SELECT id, department, 3, tags FROM docs UNION ALL SELECT id, department, 4, description FROM docs),
ix AS (SELECT token, id, department, CAST(min(priority) AS INT) AS priority FROM (SELECT id, department, priority, unnest(list_filter(regexp_split_to_array(lower(strip_accents(x)), '[^a-z0-9]+'), lambda t: length(t) > 1)) AS token FROM fields) GROUP BY ALL) """
DOCS = duck("registry") + ", docs AS (SELECT id, name, CASE WHEN category_id = 'FURNITURE' THEN '' ELSE lower(category_id) END AS category, coalesce(description, '') AS description, city, department, p_brand AS tags FROM registry)" + INDEX


@query("SCH-1", DOCS + "SELECT token, id, department, priority FROM ix")
def index(spark, sf):
    return search.build_index(docs_of(spark, sf)).select("token", "id", "department", "priority")


SYN = [("ring", "bolt"), ("red", "blue"), ("blue", "red")]


def wanted(spark):
    terms = spark.createDataFrame([("ring",), ("red",), ("small",)], "term string")
    return search.expand_synonyms(terms, spark.createDataFrame(SYN, "term string, alternative string"))


@query("SCH-2", "SELECT p_partkey AS id, count(*) AS n FROM part, (VALUES ('ring', 'ring'), ('ring', 'bolt'), ('red', 'red'), ('red', 'blue'), ('small', 'small')) s(term, token) WHERE contains(' ' || p_name || ' ', ' ' || token || ' ') GROUP BY 1")
def synonyms(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("token"))
    return p.join(F.broadcast(wanted(spark)), "token").groupBy("id").agg(F.count("*").alias("n"))


@query("SCH-3", DOCS + ", hit AS (SELECT DISTINCT term, id FROM ix JOIN (VALUES ('ring', 'ring'), ('ring', 'bolt'), ('red', 'red'), ('red', 'blue'), ('small', 'small')) s(term, token) USING (token)) SELECT term, id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY id) AS r FROM hit) WHERE r <= 3000")
def matches(spark, sf):
    return search.match_ids(search.build_index(docs_of(spark, sf)), wanted(spark))


@query("JN-16", DOCS + "SELECT id FROM ix WHERE token IN ('small', 'ring', 'household') GROUP BY id HAVING count(DISTINCT token) = 3")
def all_words(spark, sf):
    hits = search.build_index(docs_of(spark, sf)).filter(F.col("token").isin("small", "ring", "household")).select("id", F.col("token").alias("keyword"))
    return listing.match_all_keywords(hits, 3)


@query("SCH-4", DOCS + ", c AS (SELECT id, priority, CASE WHEN starts_with(token, 'widg') THEN 0 ELSE levenshtein(token, 'widg') END AS typos FROM ix WHERE token[1:1] = 'w'), b AS (SELECT id, min(typos * 10 + priority) AS m FROM c WHERE typos <= 1 GROUP BY id) SELECT id, CAST(m // 10 AS INT) AS typos, CAST(m % 10 AS INT) AS priority FROM b ORDER BY typos, priority, id LIMIT 20")
def suggest(spark, sf):
    return search.suggest(search.build_index(docs_of(spark, sf)), "widg", 20)


def kept_index(spark, sf):
    """The index of documents of which some were otherwise at first."""
    docs = docs_of(spark, sf)
    old = docs.withColumn("name", F.when(F.col("id") % 5 == 0, "widget wigdet old").otherwise(F.col("name"))).unionByName(docs.filter("id % 9 = 1").withColumn("id", F.col("id") + 1_000_000_000))
    index = KeptIndex(spark, shared_folder(spark))
    index.write(old)
    gone = old.filter("id >= 1000000000").withColumns({c: F.lit(None).cast(t) for c, t in old.dtypes if c != "id"})
    index.update(docs.filter("id % 5 = 0").unionByName(gone), 0)
    return index


@query("SCH-3-kept", ORACLE["SCH-3"])
def matches_kept(spark, sf):
    return kept_index(spark, sf).match_ids(wanted(spark))


@query("SCH-4-kept", ORACLE["SCH-4"])
def suggest_kept(spark, sf):
    return kept_index(spark, sf).suggest("widg", 20)
