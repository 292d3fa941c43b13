"""Queries of the projections and filters."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import geo, text, urls
from ..operators import ingest, listing, merge, pages, search, stats
from ..operators.agenda import relevant_events, upcoming
from ..operators.health import due_by_age, due_for_probe, due_for_score, fold_failures, latest_health, single_platform
from ..operators.match import search_texts
from ..operators.decide import parse_verdicts
from ..queries import query
from ..sources.registry import public_record
from .adapters import NOW, duck, read, registry, sql, view

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
SHORT = ", ".join(f"'{w.upper()}'" for w in text.STOPWORDS if len(w) <= 4)


def toks(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP})))"


def joined(a: str) -> str:
    return f"array_to_string(list_sort({a}), ' ')"


WORDS = lambda c: F.array_join(F.array_sort(c), " ")
POSTAL = "lpad(cast(o_orderkey * 37 % 100000 AS string), 5, '0')"
RULES = [("music", ["tion", "music"], ["the"]), ("sport", ["sport", "bleou"], ["von"]), ("culture", ["èn"], ["el"])]
WHOLE = lambda w: f"(^|[^0-9A-Za-z_]){w}($|[^0-9A-Za-z_])"


@query("PRJ-1", "SELECT p_partkey AS id, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_brand END), ''), nullif(trim(p_type), '')) AS picked FROM part")
def pick_alias(spark, sf):
    df = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_brand END").alias("nom"), F.col("p_type").alias("titre"))
    return df.select("id", text.pick(df, "missing", "nom", "titre").alias("picked"))


@query("PRJ-2", "SELECT o_orderkey AS id, concat_ws(' ', CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderkey % 90 AS string) END, CASE WHEN o_orderkey % 3 <> 0 THEN 'rue' END, o_orderpriority) AS address FROM orders")
def address(spark, sf):
    df = read(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderkey % 90 AS string) ELSE ' ' END AS adrs_numvoie", "CASE WHEN o_orderkey % 3 <> 0 THEN 'rue' END AS adrs_typevoie", "o_orderpriority AS adrs_voie")
    return df.select("id", text.address(df).alias("address"))


@query("PRJ-3", f"SELECT o_orderkey AS id, CASE WHEN p[1:2] IN ('97', '98') THEN p[1:3] WHEN p[1:2] = '20' THEN CASE WHEN p < '20200' THEN '2A' ELSE '2B' END ELSE p[1:2] END AS department FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN {POSTAL} END AS p FROM orders)")
def department(spark, sf):
    return read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"CASE WHEN o_orderkey % 11 = 0 THEN '123x' ELSE {POSTAL} END AS p").select("id", geo.department_of(F.col("p")).alias("department"))


@query("PRJ-4", "SELECT doc_id AS id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join([*p, *map(WHOLE, w)])}') THEN '{c}'" for c, p, w in RULES) + " ELSE 'other' END AS category FROM documents")
def classify(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), ingest.classify(F.col("text"), RULES, "other").alias("category"))


@query("PRJ-5", duck("registry") + "SELECT id, CASE category_id WHEN 'HOUSEHOLD' THEN 'HOME' ELSE category_id END AS category_id FROM registry WHERE category_id IN ('HOUSEHOLD', 'BUILDING', 'MACHINERY')")
def remap(spark, sf):
    return ingest.remap_category(view(spark, sf, "registry").select("id", "category_id"), {"HOUSEHOLD": "HOME"}, {"HOME", "BUILDING", "MACHINERY"})


@query("PRJ-6", "SELECT p_partkey AS id, concat_ws('|', nullif(trim(p_brand), ''), CASE WHEN p_size % 2 = 0 THEN p_type END) AS tags FROM part")
def tags(spark, sf):
    df = read(spark, sf, "part").selectExpr("p_partkey AS id", "p_brand AS nature", "CASE WHEN p_size % 2 = 0 THEN p_type ELSE '  ' END AS groupement")
    return df.select("id", F.array_join(text.tags_of(df, "nature", "groupement"), "|").alias("tags"))


@query("PRJ-7", "SELECT doc_id AS id, regexp_replace(regexp_replace(lower(strip_accents(trim(regexp_replace(text, '\\s+', ' ', 'g')))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugs(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.slugify(F.col("text")).alias("slug"))


@query("PRJ-8", "SELECT doc_id AS id, lower(strip_accents(trim(regexp_replace(concat(' ', text, '  é  '), '\\s+', ' ', 'g')))) AS key, trim(regexp_replace(concat(' ', text, '  é  '), '\\s+', ' ', 'g')) AS shown FROM documents")
def cities(spark, sf):
    c = F.concat(F.lit(" "), "text", F.lit("  é  "))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.norm_city(c).alias("key"), text.clean_city(c).alias("shown"))


@query("PRJ-9", f"SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(upper(strip_accents(replace(text, 'ß', 'SS'))), '[^A-Z0-9]+'), lambda w: w <> '' AND w NOT IN ({SHORT})), ' ') AS name_key FROM documents")
def name_keys(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.name_key(F.col("text")).alias("name_key"))


@query("PRJ-10", f"SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP})), ' ') AS norm FROM documents")
def name_norms(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.name_norm(F.col("text")).alias("norm"))


@query("PRJ-11", f"SELECT doc_id AS id, {joined(toks('text'))} AS tokens FROM documents")
def token_sets(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), WORDS(text.tokens(F.col("text"))).alias("tokens"))


HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"


@query("PRJ-12", f"SELECT page_id AS id, h AS host, CASE WHEN len(p) >= 2 THEN array_to_string(p[-2:], '.') ELSE h END AS base FROM (SELECT page_id, {HOST} AS h, string_split({HOST}, '.') AS p FROM pages)")
def hosts(spark, sf):
    h = urls.host_of(F.col("url"))
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), h.alias("host"), urls.base_domain(h).alias("base"))


@query("PRJ-13", "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') WHEN page_id % 3 = 1 THEN NULL ELSE url END AS url FROM pages")
def completed(spark, sf):
    df = read(spark, sf, "pages").selectExpr("page_id AS id", "CASE WHEN page_id % 3 = 0 THEN concat(' ', regexp_replace(url, '^https?://', '')) WHEN page_id % 3 = 1 THEN '  ' ELSE url END AS url")
    return df.select("id", urls.complete_url(F.col("url")).alias("url"))


SOCIAL = """, parts AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM results),
social AS (SELECT *, CASE host WHEN 'facebook.com' THEN 'facebook' WHEN 'instagram.com' THEN 'instagram' WHEN 'linkedin.com' THEN 'linkedin' WHEN 'helloasso.com' THEN 'donation' END AS platform,
  CASE WHEN host = 'facebook.com' AND seg[1] <> 'people' AND NOT regexp_matches(seg[1], '^[0-9]{6,}$') AND length(seg[1]) >= 4 THEN seg[1]
    WHEN host = 'instagram.com' AND length(seg[1]) >= 4 THEN seg[1] WHEN host = 'linkedin.com' THEN seg[2] WHEN host = 'helloasso.com' THEN seg[2] END AS slug FROM parts)
"""


@query("PRJ-14", duck("results") + SOCIAL + "SELECT id, rank, platform, slug, CASE platform WHEN 'facebook' THEN 'https://www.facebook.com/' || slug || '/' WHEN 'instagram' THEN 'https://www.instagram.com/' || slug || '/' WHEN 'linkedin' THEN 'https://www.linkedin.com/company/' || slug || '/' ELSE 'https://www.helloasso.com/associations/' || slug END AS page FROM social WHERE slug IS NOT NULL")
def social_pages(spark, sf):
    return urls.canonical_social(view(spark, sf, "results")).select("id", "rank", "platform", "slug", "page")


@query("PRJ-15", duck("registry") + "SELECT id, concat_ws('|', CASE WHEN l_donation THEN 'donation=https://donation/x' END, CASE WHEN l_facebook THEN 'facebook=https://facebook/x' END, CASE WHEN l_instagram THEN 'instagram=https://instagram/x' END, CASE WHEN l_linkedin THEN 'linkedin=https://linkedin/x' END, CASE WHEN website IS NOT NULL THEN 'website=' || website END) AS links, id % 13 = 0 AS geo_approx FROM registry")
def public(spark, sf):
    out = public_record(registry(spark, sf))
    return out.select("id", F.array_join(F.transform(merge.entries(F.col("links")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("links"), "geo_approx")


def docs_of(spark, sf):
    labels = read(spark, sf, "customer").selectExpr("c_mktsegment AS category_id", "lower(c_mktsegment) AS label").distinct().filter("label <> 'furniture'")
    return search.search_doc(registry(spark, sf), labels)


@query("PRJ-16", duck("registry") + "SELECT id, name, CASE WHEN category_id = 'FURNITURE' THEN '' ELSE lower(category_id) END AS category, coalesce(description, '') AS description, city, department, p_brand AS tags FROM registry")
def search_docs(spark, sf):
    return docs_of(spark, sf).withColumn("tags", F.array_join("tags", "|"))


@query("PRJ-17", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'short' WHEN length(text) > 140 THEN rtrim(text[1:137]) || '…' WHEN text = '' THEN 'none' ELSE text END AS blurb FROM documents")
def blurbs(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.blurb(F.when(F.col("doc_id") % 5 == 0, "short"), F.col("text"), "none").alias("blurb"))


@query("PRJ-18", duck("registry") + "SELECT id, p AS platform, CASE p WHEN 'website' THEN n || ' ' || city WHEN 'press' THEN '\"' || n || '\" ' || city ELSE n || ' ' || city || ' ' || p END AS query FROM (SELECT id, city, name AS n, unnest(['facebook', 'instagram', 'website', 'press']) AS p FROM registry)")
def queries_text(spark, sf):
    return search_texts(view(spark, sf, "registry").withColumn("name", F.concat("name", F.lit(" (old “x”)"))))


VERDICT_TEXT = "concat('so: {\"verdict\": \"', CASE o_orderkey % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'drop' WHEN 2 THEN 'maybe' ELSE 'quarantine' END, '\", \"confidence\": ', CASE o_orderkey % 5 WHEN 0 THEN '1.5' WHEN 1 THEN '\"bad\"' ELSE concat('0.', cast(o_orderkey % 10 AS string)) END, ', \"reason\": \"', o_orderpriority, '\"}.')"


@query("PRJ-20", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' ELSE 'quarantine' END AS verdict, CASE o_orderkey % 5 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 ELSE cast('0.' || (o_orderkey % 10) AS double) END AS confidence, o_orderpriority AS reason FROM orders")
def verdict_text(spark, sf):
    return parse_verdicts(read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{VERDICT_TEXT} AS response")).select("id", "verdict", "confidence", "reason")


# the pages by patterns instead of a parser: what is cut, entities, white space
ENTITIES = {"quot": '"', "copy": "©", "middot": "·", "lt": "<", "gt": ">", "amp": "&"}
DECODED = lambda c: functools.reduce(lambda x, e: f"regexp_replace({x}, '&{e[0]};?', '{e[1]}', 'g')", ENTITIES.items(), c)
SHOWN = lambda c: f"trim(regexp_replace({DECODED(c)}, '\\s+', ' ', 'g'))"
PARTS = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, {SHOWN("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")} AS title, {SHOWN("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")} AS name,
  {SHOWN("regexp_replace(regexp_replace(h, '(?s)<!--.*?-->|<title>.*?</title>|<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'g'), '<[^>]*>', ' ', 'g')")} AS body FROM p),
t AS (SELECT *, nullif(CASE WHEN title <> '' AND length(title) <= 120 AND body <> '' THEN title || ' - ' || body WHEN body <> '' THEN body ELSE title END, '') AS text FROM d)
"""


NAME_KEY = f"array_to_string(list_filter(regexp_split_to_array(upper(strip_accents(replace(name, 'ß', 'SS'))), '[^A-Z0-9]+'), lambda w: w <> '' AND w NOT IN ({SHORT})), ' ')"


@query("PRJ-21", PARTS + "SELECT page_id, url, substring(text, 1, 4000) AS text, CASE WHEN text IS NULL THEN 'empty' END AS error FROM t")
def page_texts(spark, sf):
    return pages.page_text(read(spark, sf, "pages"))


@query("PRJ-22", PARTS + f", k AS (SELECT *, {NAME_KEY} AS name_key FROM d) SELECT page_id, url, 0 AS pos, 'heading' AS place, name, name_key FROM k WHERE length(name) BETWEEN 6 AND 120 AND name_key <> ''")
def page_names(spark, sf):
    return pages.extract_org_names(read(spark, sf, "pages"), lambda c: F.length(c).between(6, 120), ("h1",))


@query("PRJ-23", duck("results") + "SELECT DISTINCT id, lower(unnest(regexp_extract_all(body || ' ' || title, '(?i)\\b([a-z0-9][a-z0-9-]{1,40}\\.(?:fr|com|org|net|bzh|eu|info))\\b', 1))) AS domain FROM results")
def domains(spark, sf):
    return urls.domain_mentions(view(spark, sf, "results"), "id", "body", "title")


@query("PRJ-24", duck("marks") + "SELECT seq AS id, sha256(concat_ws('|', cast(client AS string), kind, cast(secs // 86400 AS string), 'salt'))[1:16] AS visitor FROM marks")
def visitors(spark, sf):
    return view(spark, sf, "marks").select(F.col("seq").alias("id"), ingest.visitor_id(F.col("client").cast("string"), F.col("kind"), F.floor(F.col("secs") / 86400).cast("string"), "salt").alias("visitor"))


@query("PRJ-25", duck("marks") + "SELECT seq AS id, CASE WHEN seq % 4 = 0 THEN 't' || client WHEN seq % 4 = 1 THEN 'f' || client WHEN seq % 4 = 2 THEN 'p' || client ELSE '?' END AS addr FROM marks")
def addresses(spark, sf):
    df = view(spark, sf, "marks").selectExpr("seq AS id", "CASE WHEN seq % 4 = 0 THEN concat('t', client) END AS t", "CASE WHEN seq % 4 < 2 THEN concat('x, f', client, ' ') WHEN seq % 4 = 3 THEN ' , ' END AS f", "CASE WHEN seq % 4 < 3 THEN concat('p', client) ELSE ' ' END AS p")
    return df.select("id", ingest.trusted_address(F.col("t"), F.col("f"), F.col("p")).alias("addr"))


@query("PRJ-26", duck("registry") + "SELECT id, lng + (CAST(('0x' || md5(id || ':1')[1:8]) AS BIGINT) % 10001 / 1e4 - 0.5e0) * 4e-3 AS lng, lat + (CAST(('0x' || md5(id || ':2')[1:8]) AS BIGINT) % 10001 / 1e4 - 0.5e0) * 4e-3 AS lat, true AS geo_approx FROM registry WHERE lng IS NOT NULL")
def jittered(spark, sf):
    return geo.jitter(view(spark, sf, "registry").filter("lng IS NOT NULL").select("id", "lng", "lat"))


@query("PRJ-27", "SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN NULL ELSE 'HTTPS://own.org' END AS site FROM pages")
def safe_sites(spark, sf):
    return read(spark, sf, "pages").select(F.col("page_id").alias("id"), urls.safe_site(F.expr("CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'javascript:x' END"), F.lit("HTTPS://own.org")).alias("site"))


BOX = (-2.0, 43.0, 4.0, 48.5)
INBOX = "lng BETWEEN -2.0 AND 4.0 AND lat BETWEEN 43.0 AND 48.5"
Q = listing.ListingQuery(categories=("HOUSEHOLD", "BUILDING"), text="ring", box=BOX, located=True)


@query("FLT-1", duck("registry") + f"SELECT id FROM registry WHERE status = 'published' AND category_id IN ('HOUSEHOLD', 'BUILDING') AND (name ILIKE '%ring%' OR city ILIKE '%ring%') AND {INBOX}")
def listing_rows(spark, sf):
    return view(spark, sf, "registry").filter(listing.listing_filter(Q)).select("id")


@query("FLT-2", "SELECT doc_id AS id FROM documents WHERE text ILIKE '%ED%TION%'")
def contains(spark, sf):
    return read(spark, sf, "documents").filter(listing.text_contains("ed%tion", "text")).select(F.col("doc_id").alias("id"))


@query("FLT-3", duck("registry") + f"SELECT id FROM registry WHERE {INBOX}")
def boxed(spark, sf):
    return view(spark, sf, "registry").filter(geo.in_box("-2,43,4,48.5")).select("id")


@query("FLT-4", duck("registry") + "SELECT id FROM (SELECT id, lng, lat - 42 AS lat FROM registry) WHERE lng IS NOT NULL AND NOT (lng BETWEEN -1 AND 1 AND lat BETWEEN -1 AND 1)")
def islands(spark, sf):
    return listing.map_points(view(spark, sf, "registry").withColumn("lat", F.col("lat") - 42)).select("id")


@query("FLT-5", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 4 IN (0, 3)")
def valid(spark, sf):
    df = read(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority ELSE ' ' END AS name", "CASE o_orderkey % 4 WHEN 0 THEN '0001-01-01' WHEN 1 THEN cast(o_orderdate AS string) WHEN 2 THEN '1901-01-01' END AS dissolved")
    return ingest.valid_rows(df).select("id")


@query("FLT-6", duck("registry", "territories") + "SELECT id FROM registry WHERE department IN (SELECT department FROM territories WHERE position < 12)")
def known(spark, sf):
    return ingest.covered(view(spark, sf, "registry"), view(spark, sf, "territories").filter("position < 12")).select("id")


@query("FLT-7", "SELECT page_id AS id FROM pages WHERE regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) <> 'fr' AND NOT regexp_matches(html, '(?i)casino|licensed under')")
def relevant(spark, sf):
    return relevant_events(read(spark, sf, "pages"), ("fr",), "casino|licensed under", text="html").select(F.col("page_id").alias("id"))


@query("FLT-8", "SELECT event_id AS id FROM events WHERE event_type NOT IN ('view', 'error')")
def humans(spark, sf):
    df = read(spark, sf, "events").selectExpr("event_id AS id", "CASE event_type WHEN 'view' THEN 'Some-Bot/1' WHEN 'error' THEN '' ELSE 'Firefox' END AS agent")
    return ingest.drop_robots(df).select("id")


ORG = "CASE p_partkey % 6 WHEN 0 THEN 'Club ' || p_name WHEN 1 THEN upper(p_name) || ' DU LAC' WHEN 2 THEN 'Contact club' WHEN 3 THEN 'Club 02 40 12' WHEN 4 THEN p_name ELSE 'club@' || p_name END"


@query("FLT-9", f"SELECT id, n AS name FROM (SELECT p_partkey AS id, {ORG} AS n FROM part) WHERE id % 6 = 0 OR (id % 6 = 1 AND length(n) >= 12)")
def orgs(spark, sf):
    return read(spark, sf, "part").selectExpr("p_partkey AS id", f"{ORG} AS name").filter(text.looks_like_org(F.col("name")))


@query("FLT-10", f"SELECT page_id AS id FROM pages WHERE ends_with({HOST}, '.example.net') OR {HOST} IN (SELECT {HOST} FROM pages WHERE page_id < 20)")
def blocked(spark, sf):
    p = read(spark, sf, "pages")
    listed = p.filter("page_id < 20").select(urls.host_of(F.col("url")).alias("host")).union(p.sparkSession.createDataFrame([("example.net",)], "host string"))
    subs = p.join(urls.host_blocked(p.select("page_id", "url"), listed, "url", "page_id").select("page_id"), "page_id", "left_semi")
    # a parent of a listed host is not listed itself; a child is
    return subs.select(F.col("page_id").alias("id"))


@query("FLT-11", "SELECT page_id AS id FROM pages WHERE page_id % 3 <> 0")
def html(spark, sf):
    return urls.html_only(read(spark, sf, "pages").selectExpr("page_id AS id", "CASE WHEN page_id % 3 = 0 THEN 'https://a.org/x.PDF' ELSE url END AS url"), "url").select("id")


@query("FLT-12", duck("registry") + "SELECT id, l_facebook AS has_facebook, l_website OR l_facebook OR l_instagram OR l_linkedin OR l_donation AS linked, k_fb AS has_candidate FROM registry")
def json_tests(spark, sf):
    return registry(spark, sf).select("id", stats.has("facebook").alias("has_facebook"), stats.linked().alias("linked"), F.array_contains("candidate_platforms", "facebook").alias("has_candidate"))


PENDING = {"instagram": "lng IS NOT NULL AND NOT l_instagram AND NOT m_ig AND NOT k_ig", "facebook": "lng IS NOT NULL AND NOT l_facebook AND NOT m_fb AND NOT k_fb", "donation": "lng IS NOT NULL AND NOT l_donation AND NOT m_gift AND NOT k_gift", "website": "lng IS NOT NULL AND NOT l_website AND NOT m_web"}


@query("FLT-13", duck("registry") + " UNION ALL ".join(f"SELECT id, '{p}' AS pass FROM registry WHERE {w}" for p, w in PENDING.items()))
def gates(spark, sf):
    r = registry(spark, sf)
    hit = F.array_compact(F.array(*[F.when(stats.pending(p), p.platform) for p in stats.PASSES]))
    return r.select("id", F.explode(hit).alias("pass"))


LAST = "last AS (SELECT id, platform, status, checked_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY id, platform ORDER BY checked_at DESC, seq DESC) AS r FROM probes) WHERE r = 1)"
AT = 1_706_400_000


@query("FLT-14", duck("probes") + f", {LAST} SELECT l.id, l.platform FROM (SELECT DISTINCT id, platform FROM probes) l JOIN last USING (id, platform) WHERE checked_at < {AT} - CASE WHEN status IN ('dead', 'error') THEN 1 ELSE 14 END * 86400")
def due(spark, sf):
    p = view(spark, sf, "probes")
    return due_for_probe(p.select("id", "platform").distinct(), latest_health(fold_failures(p)), F.lit(AT))


@query("FLT-15", duck("registry") + f"SELECT id FROM registry WHERE enriched_at IS NULL OR enriched_at < {NOW} - 3 * 86400")
def agenda_due(spark, sf):
    return due_by_age(view(spark, sf, "registry"), "enriched_at", F.lit(NOW)).select("id")


@query("FLT-16", duck("registry") + "SELECT id FROM registry WHERE enriched_at IS NULL OR enriched_at < updated_at")
def score_due(spark, sf):
    return due_for_score(view(spark, sf, "registry"), "enriched_at", "updated_at").select("id")


@query("FLT-17", duck("registry") + "SELECT id FROM registry WHERE l_facebook AND NOT l_website AND website IS NULL AND NOT m_web")
def single(spark, sf):
    return single_platform(registry(spark, sf), "facebook", "web_targeted").select("id")


@query("FLT-18", duck("marks") + "SELECT client AS id, count(*) FILTER (WHERE secs >= 1705000000) AS n FROM marks GROUP BY client")
def upcoming_events(spark, sf):
    arr = view(spark, sf, "marks").groupBy(F.col("client").alias("id")).agg(F.collect_list(F.struct(F.col("secs").alias("start"))).alias("ev"))
    return arr.select("id", F.size(upcoming(F.col("ev"), F.lit(1705000000))).cast("long").alias("n"))
