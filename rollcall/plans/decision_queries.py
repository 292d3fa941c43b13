"""Queries of link resolution, decisions, health and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import decide, health, ingest, match
from ..operators import quality as q
from ..operators.listing import top_k
from ..operators.pages import page_text
from ..queries import query
from .adapters import NOW, duck, read, registry, view
from .columns_queries import HOST, LAST, SOCIAL, toks

# entities with their own tokens; social results with tokens of slug and title; the other results with their host
CAND = (
    duck("results", "entities")
    + SOCIAL
    + f""", who AS (SELECT id, list_filter({toks('name')}, lambda t: NOT list_contains({toks('city')}, t)) AS own, {toks('city')} AS place, name FROM entities),
st AS (SELECT s.*, own, place, list_has_any(own, {toks('slug')}) AS in_slug, list_has_any(place, {toks('slug')}) AS city_slug, len(list_intersect(own, {toks('title')})) AS n_title,
  CASE platform WHEN 'facebook' THEN 'https://www.facebook.com/' || slug || '/' WHEN 'instagram' THEN 'https://www.instagram.com/' || slug || '/' WHEN 'linkedin' THEN 'https://www.linkedin.com/company/' || slug || '/' ELSE 'https://www.helloasso.com/associations/' || slug END AS page FROM social s JOIN who USING (id) WHERE slug IS NOT NULL),
typed AS (SELECT *, CASE WHEN in_slug THEN 'slug' WHEN n_title >= 2 THEN 'title' WHEN city_slug THEN 'slug_city' WHEN n_title >= 1 AND rank <= 3 THEN 'top' || rank WHEN n_title >= 1 THEN 'fallback' END AS match_type FROM st),
soc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, platform, page ORDER BY rank) AS r FROM typed WHERE match_type IS NOT NULL) WHERE r = 1),
rest AS (SELECT r.*, own, place, {HOST} AS h, {toks(f"replace({HOST}, '.', ' ')")} AS dom, {toks('title')} AS ttl, replace({HOST}, '.', '') AS flat FROM results r JOIN who USING (id) WHERE {HOST} NOT IN ('facebook.com', 'instagram.com', 'linkedin.com', 'helloasso.com')),
lst AS (SELECT *, contains(h, 'mairie') OR (ends_with(h, '.fr') AND list_has_any(place, dom)) AS listing FROM rest),
feat AS (SELECT *, len(list_intersect(own, dom)) + len(list_filter(own, lambda t: NOT list_contains(dom, t) AND length(t) >= 4 AND contains(flat, t))) AS nd, len(list_intersect(own, ttl)) AS nt, CAST(list_has_any(place, dom) OR list_has_any(place, ttl) AS INT) AS cb FROM lst WHERE NOT listing AND h NOT IN ('example-directory.org', 'listings.example')),
site AS (SELECT *, CAST(nd * 3 + nt + cb AS INT) AS score FROM feat),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank, url) AS r FROM site) WHERE r <= 5),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, url) AS r FROM lst WHERE listing) WHERE r <= 3)
"""
)


def cands(spark, sf):
    return match.type_candidates(view(spark, sf, "entities"), view(spark, sf, "results"))


@query("DEC-1", CAND + "SELECT id, 'social' AS kind, page AS url, rank, match_type, CAST(NULL AS INT) AS score FROM soc UNION ALL SELECT id, 'site', url, rank, NULL, score FROM top5 UNION ALL SELECT id, 'listing', url, rank, NULL, NULL FROM top3")
def candidates(spark, sf):
    return cands(spark, sf).select("id", "kind", "url", "rank", "match_type", "score")


@query("DEC-2", CAND + "SELECT match_type, count(*) AS n FROM typed WHERE match_type IS NOT NULL GROUP BY 1")
def match_types(spark, sf):
    r = urls.canonical_social(view(spark, sf, "results")).join(view(spark, sf, "entities").select("id", "name", "city"), "id")
    from ..functions.text import tokens

    own = F.array_except(tokens(F.col("name")), tokens(F.col("city")))
    return r.select(match.match_type(own, tokens(F.col("city")), F.col("slug"), F.col("title"), F.col("rank")).alias("match_type")).filter("match_type IS NOT NULL").groupBy("match_type").agg(F.count("*").alias("n"))


@query("DEC-3", CAND + "SELECT id, rank, CAST(nd AS INT) AS name_in_domain, CAST(nt AS INT) AS name_in_title, score FROM top5")
def site_scores(spark, sf):
    return cands(spark, sf).filter("kind = 'site'").select("id", "rank", "name_in_domain", "name_in_title", "score")


@query("DEC-4", CAND + "SELECT id, rank FROM lst WHERE listing")
def locality_sites(spark, sf):
    from ..functions.text import tokens

    r = view(spark, sf, "results").join(view(spark, sf, "entities").select("id", "city"), "id").withColumn("host", urls.host_of(F.col("url")))
    return r.filter(urls.platform_of(F.col("url")).isNull() & match.is_locality_site(tokens(F.col("city")), F.col("host"))).select("id", "rank")


@query("WIN-3", CAND + "SELECT id, rank, url FROM top5")
def top_sites(spark, sf):
    return cands(spark, sf).filter("kind = 'site'").select("id", "rank", "url")


@query("WIN-4", CAND + "SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank, url) AS q FROM top5 WHERE nd = 0 AND nt >= 2) WHERE q <= 3")
def mentioned(spark, sf):
    return match.mentions(cands(spark, sf).filter("kind = 'site'")).select("id", "url")


@query("DEC-5", CAND + f", g AS (SELECT s.id, s.rank, s.url, page, own, {toks('slug')} AS st, list_concat(own, place) AS kn, name FROM st s JOIN who USING (id) WHERE platform = 'donation' AND len(s.own) > 0), ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, url) AS r FROM g WHERE len(list_intersect(own, st)) >= greatest(1, len(own) - 1) AND len(list_filter(st, lambda t: length(t) > 3 AND NOT list_contains({toks('name')}, t) AND NOT list_contains(kn, t))) = 0) SELECT id, page FROM ok WHERE r = 1".replace("s.own", "who.own").replace("page, own,", "page, who.own AS own,").replace("list_concat(own, place)", "list_concat(who.own, who.place)").replace(", name FROM st", ", who.name AS name FROM st"))
def strict_pages(spark, sf):
    return match.strict_slug(view(spark, sf, "entities"), view(spark, sf, "results"))


VERD = duck("verdicts") + """, fused AS (SELECT *, CASE WHEN trusted THEN 1e0 ELSE floor(CASE WHEN platform = 'website' THEN 0.25e0 * CASE WHEN site_score >= 6 THEN 0.8e0 WHEN site_score >= 4 THEN 0.5e0 WHEN site_score >= 2 THEN 0.3e0 ELSE 0.15e0 END + 0.75e0 * confidence
  WHEN match_type = 'slug' THEN 0.65e0 * 0.9e0 + 0.35e0 * confidence ELSE 0.35e0 * CASE match_type WHEN 'title' THEN 0.3e0 WHEN 'top1' THEN 0.7e0 WHEN 'fallback' THEN 0.1e0 ELSE 0.2e0 END + 0.65e0 * confidence END * 1000e0 + 0.5e0) / 1000e0 END AS fused FROM verdicts),
routed AS (SELECT *, CASE WHEN trusted OR (platform <> 'website' AND verdict = 'keep') OR (platform <> 'website' AND verdict = 'quarantine' AND confidence >= 0.85e0) OR (verdict <> 'drop' AND fused >= 0.75e0) THEN 'apply' WHEN verdict <> 'drop' AND fused >= 0.4e0 THEN 'quarantine' ELSE 'drop' END AS route FROM fused) """


def routed(spark, sf):
    return decide.route(decide.fuse(view(spark, sf, "verdicts")))


@query("DEC-6", VERD + "SELECT position, fused FROM fused")
def fused(spark, sf):
    return decide.fuse(view(spark, sf, "verdicts")).select("position", "fused")


@query("DEC-7", VERD + "SELECT position, route FROM routed")
def routes(spark, sf):
    return routed(spark, sf).select("position", "route")


@query("DEC-8", VERD + """, a AS (SELECT id, platform, min(url) AS url FROM routed WHERE route = 'apply' GROUP BY ALL), f AS (SELECT DISTINCT c_custkey AS id, 'donation' AS platform, 'https://f' AS url FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT DISTINCT c_custkey AS id, 'donation' AS platform, 'https://a' AS url FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT id, platform, url FROM (SELECT *, row_number() OVER (PARTITION BY id, platform ORDER BY o) AS q FROM (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 FROM f UNION ALL SELECT *, 2 FROM r)) WHERE q = 1)
SELECT id, platform, url FROM u WHERE NOT (platform = 'website' AND url = 'https://u3.org')""")
def rebuilt(spark, sf):
    c = read(spark, sf, "customer")
    found = c.filter("c_custkey % 3 = 0").selectExpr("c_custkey AS id", "'donation' AS platform", "'https://f' AS url")
    archived = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "'donation' AS platform", "'https://a' AS url")
    r = routed(spark, sf).filter("route = 'apply'").select("id", "platform", "url")
    dead = r.filter("url = 'https://u3.org'").select("id", "platform", "url")
    return decide.rebuild_links(r, archived, found, dead)


@query("DEC-9", CAND + ", s AS (SELECT id, platform, page AS url FROM (SELECT *, row_number() OVER (PARTITION BY id, platform ORDER BY rank, page) AS q FROM soc WHERE match_type IN ('slug', 'title') AND platform IN ('facebook', 'instagram', 'linkedin', 'donation')) WHERE q = 1 UNION ALL SELECT id, 'website', url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank, url) AS q FROM top5 WHERE nd >= 1) WHERE q = 1), l AS (SELECT id, 'facebook' AS platform, 'https://own' AS url FROM entities WHERE id % 2 = 0) SELECT * FROM l UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = s.id AND l.platform = s.platform)")
def auto(spark, sf):
    links = view(spark, sf, "entities").filter("id % 2 = 0").selectExpr("id", "'facebook' AS platform", "'https://own' AS url")
    return match.auto_apply(cands(spark, sf), links)


@query("DEC-14", duck("results", "entities") + f""", d AS (SELECT r.id, rank, h, name, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(body || ' ' || title, '(?i)\\b([a-z0-9][a-z0-9-]{{1,40}}\\.(?:fr|com|org|net|bzh|eu|info))\\b', 1), lambda x: lower(x)), CASE WHEN b IN ('facebook.com', 'instagram.com', 'linkedin.com', 'helloasso.com') THEN [] ELSE [b] END))) AS d
  FROM (SELECT *, {HOST} AS h, array_to_string(string_split({HOST}, '.')[-2:], '.') AS b FROM results) r JOIN entities USING (id)),
e AS (SELECT *, array_to_string(string_split(d, '.')[-2:], '.') AS domain FROM d), s AS (SELECT *, replace(split_part(domain, '.', 1), '-', '') AS flat FROM e WHERE domain NOT IN ('facebook.com', 'fb.com', 'instagram.com', 'twitter.com', 'x.com', 'linkedin.com', 'youtube.com', 'youtu.be', 'tiktok.com', 'helloasso.com', 'example-directory.org', 'listings.example', 'google.com', 'gmail.com', 'bit.ly', 'blogspot.com') AND length(domain) >= 5),
z AS (SELECT id, rank, domain, CAST(2 * CAST(list_has_any({toks("replace(domain, '.', ' ')")}, {toks('name')}) AS INT) + 2 * CAST(length(flat) >= 5 AND contains(replace(lower(name), ' ', ''), flat) AS INT) + CAST(h = 'facebook.com' AS INT) AS INT) AS score FROM s)
SELECT id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank, domain) AS q FROM z WHERE score >= 2) WHERE q = 1""")
def best_domains(spark, sf):
    return match.score_domains(view(spark, sf, "results"), view(spark, sf, "entities").select("id", "name"))


@query("WIN-13", duck("results") + ", o AS (SELECT id, url, min(rank) AS rank, any_value(title) AS t FROM results WHERE ends_with(regexp_extract(url, '^https?://([^/]+)', 1), 'example.org') GROUP BY id, url) SELECT id, url, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank % 2, rank, url) AS pos FROM (SELECT id, url, rank FROM (SELECT r.id, r.url, r.rank, row_number() OVER (PARTITION BY r.id, r.url ORDER BY r.rank % 2, r.rank) AS k FROM results r WHERE ends_with(regexp_extract(r.url, '^https?://([^/]+)', 1), 'example.org')) WHERE k = 1)) WHERE pos <= 3")
def press(spark, sf):
    r = view(spark, sf, "results").withColumns({"query": F.col("rank") % 2, "snippet": F.col("body")})
    return match.press_items(r, ("example.org",)).select("id", "url", "pos")


@query("WIN-12", duck("results") + "SELECT id, min(rank) AS rank FROM results GROUP BY id")
def first_result(spark, sf):
    return top_k(view(spark, sf, "results"), ["id"], [F.col("rank")], 1).select("id", "rank")


@query("PRJ-19", CAND + """, rq AS (SELECT id, platform, page AS url, title FROM soc UNION ALL SELECT id, 'website', url, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank, url) AS q FROM top5 WHERE score >= 2 OR nd > 0) WHERE q <= 2),
texts AS (SELECT DISTINCT 'http://' || replace(p_name, ' ', '-') || '.example.org/a' AS url, 'About ' || p_name || ' - Welcome to ' || p_name AS body FROM part WHERE p_partkey % 2 = 0)
SELECT rq.id, platform, rq.url, name || chr(10) || city || chr(10) || department || chr(10) || '---' || chr(10) || rq.url || chr(10) || '---' || chr(10) || CASE WHEN platform = 'website' AND body IS NOT NULL THEN body ELSE title END AS payload FROM rq JOIN entities e ON e.id = rq.id LEFT JOIN texts ON texts.url = rq.url""")
def requests(spark, sf):
    about = "concat('<title>About ', p_name, '</title><nav>menu</nav><p>Welcome to <b>', p_name, '</b><form>') AS html"
    sites = read(spark, sf, "part").filter("p_partkey % 2 = 0").selectExpr("concat('http://', replace(p_name, ' ', '-'), '.example.org/a') AS url", about)
    texts = page_text(sites.groupBy("url", "html").agg(F.lit(0).alias("page_id")))
    return decide.judge_requests(view(spark, sf, "entities").withColumn("description", F.col("department")), cands(spark, sf), texts)


@query("WIN-6", duck("verdicts") + """, c AS (SELECT *, row_number() OVER (PARTITION BY id, platform ORDER BY CASE WHEN trusted THEN 0 WHEN verdict = 'keep' THEN 1 ELSE 2 END, CASE WHEN NOT trusted AND verdict = 'keep' THEN position ELSE -position END) AS r FROM verdicts)
SELECT id, platform, url, CASE WHEN trusted THEN 1e0 ELSE confidence END AS confidence, CASE WHEN trusted THEN 'keep' ELSE verdict END AS verdict FROM c WHERE r = 1""")
def per_platform(spark, sf):
    return decide.verdict_per_platform(view(spark, sf, "verdicts")).drop("trusted")


@query("WIN-7", duck("verdicts") + ", s AS (SELECT *, min(CASE WHEN verdict = 'keep' AND confidence >= 0.7e0 THEN position END) OVER (PARTITION BY id) AS stop FROM verdicts WHERE platform = 'website') SELECT id, url, confidence, position FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, position) AS r FROM s WHERE stop IS NULL OR position <= stop) WHERE r = 1")
def best_site(spark, sf):
    return decide.best_site(view(spark, sf, "verdicts").filter("platform = 'website'")).drop("verdict")


@query("JN-10", duck("verdicts") + ", c AS (SELECT DISTINCT id, url FROM verdicts WHERE position % 3 = 0) SELECT v.id, v.position, CASE WHEN c.id IS NULL THEN 'fallback' ELSE 'slug' END AS match_type, CASE WHEN c.id IS NULL THEN 0 ELSE 4 END AS site_score FROM verdicts v LEFT JOIN c ON v.id = c.id AND v.url = c.url")
def verdict_candidates(spark, sf):
    v = view(spark, sf, "verdicts")
    c = v.filter("position % 3 = 0").select("id", "url", F.explode(F.array(F.lit("social"), F.lit("site"))).alias("kind"), F.lit("slug").alias("match_type"), F.lit(4).alias("score"), F.col("position").alias("rank"))
    return decide.join_verdicts(v.select("id", "url", "position"), c).select("id", "position", "match_type", "site_score")


ISLANDS = """, g AS (SELECT *, CASE WHEN status = 'alive' OR lag(url) OVER w IS DISTINCT FROM url THEN 1 ELSE 0 END AS s FROM probes WINDOW w AS (PARTITION BY id, platform ORDER BY checked_at, seq)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY id, platform ORDER BY checked_at, seq ROWS UNBOUNDED PRECEDING) AS run FROM g),
folded AS (SELECT *, CAST(sum(CASE WHEN status = 'dead' THEN 1 ELSE 0 END) OVER v AS BIGINT) AS consecutive_failures, min(CASE WHEN status = 'dead' THEN checked_at END) OVER v AS first_fail_at FROM runs WINDOW v AS (PARTITION BY id, platform, run ORDER BY checked_at, seq ROWS UNBOUNDED PRECEDING)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, platform ORDER BY checked_at DESC, seq DESC) AS r FROM folded) WHERE r = 1)
"""


@query("DEC-11", duck("probes") + ISLANDS + "SELECT id, platform, seq, consecutive_failures, first_fail_at FROM folded")
def failures(spark, sf):
    return health.fold_failures(view(spark, sf, "probes")).select("id", "platform", "seq", "consecutive_failures", "first_fail_at")


@query("JN-11", duck("probes") + ISLANDS + "SELECT DISTINCT id, platform, url FROM folded WHERE status = 'dead' AND consecutive_failures >= 2")
def dead(spark, sf):
    f = health.fold_failures(view(spark, sf, "probes"))
    return decide.dead_links(f.select("id", "platform", "url").distinct(), f)


@query("DEC-10", duck("probes") + "SELECT seq, CASE WHEN seq % 4 = 0 AND status = 'dead' THEN 'alive' ELSE status END AS status FROM probes")
def probe_states(spark, sf):
    p = view(spark, sf, "probes").withColumn("error", F.when((F.col("status") == "dead") & F.col("http_code").isNull(), "connect_timeout")).withColumn("checked_at", F.col("seq"))
    second = p.filter("seq % 4 = 0 AND status = 'dead'").withColumns({"attempt": F.lit(2), "http_code": F.lit(200), "error": F.lit(None).cast("string")})
    out = health.classify_probe(p.withColumn("attempt", F.lit(1)).unionByName(second))
    return out.select(F.col("checked_at").alias("seq"), "status")


AT = 1_706_500_000
GONE = f"SELECT id, platform, url, http_code FROM latest WHERE status = 'dead' AND consecutive_failures >= 2 AND (http_code IN (404, 410) OR {AT} - first_fail_at >= 12 * 3600)"


@query("DEC-12", duck("probes") + ISLANDS + f", gone AS ({GONE}) SELECT l.id, l.platform, g.id IS NULL AS kept FROM (SELECT DISTINCT id, platform FROM probes) l LEFT JOIN gone g USING (id, platform)")
def reaped(spark, sf):
    h = health.latest_health(health.fold_failures(view(spark, sf, "probes")))
    left, gone = health.reap(h.select("id", "platform", F.lit("column").alias("layer"), "url"), h, F.lit(AT))
    return left.select("id", "platform", F.lit(True).alias("kept")).unionByName(gone.select("id", "platform", F.lit(False).alias("kept")))


@query("DEC-13", f"SELECT page_id AS id, NOT ({HOST} = 'example.net' OR ends_with({HOST}, '.example.net')) AS kept FROM pages")
def purged(spark, sf):
    links = read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("website").alias("platform"), F.lit("map").alias("layer"), "url")
    left, gone = health.purge(links, spark.createDataFrame([("example.net",)], "host string"), F.lit(NOW))
    return left.select("id", F.lit(True).alias("kept")).unionByName(gone.select("id", F.lit(False).alias("kept")))


@query("DEC-15", duck("registry", "verdicts") + ", v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, url) AS r FROM verdicts WHERE platform = 'website') WHERE r = 1) SELECT r.id, coalesce(website IS NULL AND NOT l_website AND verdict = 'keep' AND confidence >= 0.7e0, false) AS promoted, v.id IS NOT NULL AS examined FROM registry r LEFT JOIN v ON v.id = r.id")
def promoted(spark, sf):
    r = registry(spark, sf).select("id", "website", F.col("social")["website"].alias("social_site"))
    return decide.promote(r, view(spark, sf, "verdicts")).select("id", "promoted", "examined")


def decay(age: str, full: int, zero: int) -> str:
    return f"CASE WHEN {age} IS NULL THEN 0e0 WHEN {age} <= {full} THEN 1e0 WHEN {age} >= {zero} THEN 0e0 ELSE ({zero} - {age}) / {zero - full}e0 END"


INPUT = f"""id, l_website AS has_website, l_facebook OR l_instagram OR l_linkedin AS has_social, l_donation AS has_donation, CASE id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'legacy' END AS judged, CASE WHEN id % 3 = 0 THEN (id % 5) / 4e0 END AS mean_confidence,
id % 4 AS n_checked, CASE WHEN id % 8 = 3 THEN 1 ELSE 0 END AS n_dead, CASE WHEN id % 8 = 2 THEN 2 ELSE 0 END AS n_alive, id % 9 = 0 AS has_quarantine,
CASE WHEN id % 3 < 2 THEN {NOW} - (id % 400) * 86400 END AS verified_at, CASE WHEN id % 2 = 0 THEN {NOW} - (id % 100) * 86400 END AS health_at, CASE WHEN id % 5 = 0 THEN {NOW} - (id % 380) * 86400 END AS press_at, id % 3 AS n_press, id % 2 AS n_upcoming, id % 4 - 2 AS n_upcoming_matched"""


@query("DEC-16", duck("registry") + f""", i AS (SELECT {INPUT} FROM registry), a AS (SELECT *, has_website OR has_social OR has_donation AS linked, ({NOW} - verified_at) / 86400e0 AS av, ({NOW} - health_at) / 86400e0 AS ah, ({NOW} - press_at) / 86400e0 AS ap FROM i),
p AS (SELECT *, (CASE WHEN has_website THEN 15e0 ELSE 0e0 END) + (CASE WHEN has_social THEN 12e0 ELSE 0e0 END) + (CASE WHEN has_donation THEN 8e0 ELSE 0e0 END) + (CASE WHEN linked AND judged = 'model' THEN 15e0 ELSE 0e0 END) + (CASE WHEN linked AND judged = 'legacy' THEN 6.75e0 ELSE 0e0 END) + 10 * coalesce(mean_confidence, 0e0)
 + (CASE WHEN n_checked > 0 AND n_dead = 0 THEN 14e0 ELSE 0e0 END) + (CASE WHEN n_checked > 0 AND n_alive = n_checked THEN 6e0 ELSE 0e0 END) + (CASE WHEN n_checked = 0 AND (has_website OR has_donation) THEN 10e0 ELSE 0e0 END)
 + (CASE WHEN linked THEN 7 * {decay('av', 90, 365)} + 5 * {decay('ah', 21, 90)} ELSE 0e0 END) + 2 * {decay('ap', 60, 365)} + (CASE WHEN n_press > 0 THEN 2e0 ELSE 0e0 END) + (CASE WHEN n_upcoming > 0 THEN 4e0 ELSE 0e0 END) AS pts FROM a),
s AS (SELECT *, CAST(least(100, greatest(0, round_even(pts, 0))) AS INT) AS score FROM p)
SELECT id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS tier, concat_ws(',', CASE WHEN NOT has_website THEN 'no_website' END, CASE WHEN NOT has_social THEN 'no_social' END, CASE WHEN NOT has_donation THEN 'no_donation' END, CASE WHEN judged = 'legacy' THEN 'verif_legacy' END, CASE WHEN judged IS NULL THEN 'verif_missing' END, CASE WHEN n_checked > 0 AND n_dead > 0 THEN 'dead_link_pending' END,
 CASE WHEN n_checked = 0 AND (has_website OR has_donation) THEN 'health_unchecked' END, CASE WHEN n_checked = 0 AND NOT (has_website OR has_donation) THEN 'no_link' END, CASE WHEN has_quarantine THEN 'has_quarantine' END, CASE WHEN n_press = 0 THEN 'no_press' END, CASE WHEN n_upcoming > 0 THEN 'has_agenda' END, CASE WHEN n_upcoming_matched > 0 THEN 'agenda_own' END, CASE WHEN av > 180 THEN 'stale_verif' END) AS flags FROM s""")
def scores(spark, sf):
    df = view(spark, sf, "registry").selectExpr(*split_columns(INPUT))
    return q.quality(df, F.lit(NOW)).select("id", "score", "tier", F.array_join("flags", ",").alias("flags"))


def split_columns(select: str) -> list[str]:
    """The columns of a select list whose commas inside CASE and brackets do not count."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(select[start:i])
            start = i + 1
    return [*out, select[start:]]


QUAR = "quar AS (SELECT id, platform, min(url) AS url FROM verdicts WHERE verdict = 'quarantine' GROUP BY ALL), own AS (SELECT id, platform, min(url) AS url FROM verdicts WHERE verdict = 'keep' GROUP BY ALL), act AS (SELECT id, platform, CASE WHEN max(position) % 2 = 0 THEN 'keep' ELSE 'drop' END AS action FROM verdicts WHERE position % 5 = 0 GROUP BY ALL)"


def moderated(spark, sf):
    v = view(spark, sf, "verdicts")
    by = lambda verdict: v.filter(F.col("verdict") == verdict).groupBy("id", "platform").agg(F.min("url").alias("url"))
    act = v.filter("position % 5 = 0").select("id", "platform", "position", F.when(F.col("position") % 2 == 0, "keep").otherwise("drop").alias("action"))
    return decide.resolve(by("quarantine"), by("keep"), act)


@query("DEC-17", duck("verdicts") + f", {QUAR}, m AS (SELECT q.*, action FROM quar q LEFT JOIN act USING (id, platform)) SELECT id, platform, url, 'link' AS place FROM m WHERE action = 'keep' UNION ALL SELECT o.*, 'link' FROM own o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = o.id AND m.platform = o.platform AND action = 'keep') UNION ALL SELECT id, platform, url, 'quarantine' FROM m WHERE action IS NULL UNION ALL SELECT id, platform, url, 'audit' FROM m WHERE action = 'drop'")
def resolved(spark, sf):
    links, quarantine, audit = moderated(spark, sf)
    at = lambda df, name: df.select("id", "platform", "url", F.lit(name).alias("place"))
    return at(links, "link").unionByName(at(quarantine, "quarantine")).unionByName(at(audit, "audit"))


@query("DEC-18", duck("registry", "verdicts") + f", {QUAR}, n AS (SELECT id, count(*) AS n_links FROM quar GROUP BY id) SELECT id, name, n_links, (SELECT count(*) FROM registry JOIN n USING (id)) AS total FROM registry JOIN n USING (id) ORDER BY name, id LIMIT 50 OFFSET 50")
def queue(spark, sf):
    v = view(spark, sf, "verdicts").filter("verdict = 'quarantine'").groupBy("id", "platform").agg(F.min("url").alias("url"))
    return decide.moderation_queue(view(spark, sf, "registry"), v, page=2).select("id", "name", "n_links", "total")


SUB = "o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 5 = 0 THEN '123' ELSE '44000' END AS postal, o_orderstatus AS category_id, CASE o_orderkey % 4 WHEN 0 THEN 'a@b.c' WHEN 1 THEN 'nope' ELSE '' END AS email, CASE o_orderkey % 3 WHEN 0 THEN 'ftp://x' WHEN 1 THEN 'https://x.org' END AS website"


@query("DEC-19", f"SELECT id, concat_ws(',', CASE WHEN name = ' ' THEN 'name' END, CASE WHEN postal = '123' THEN 'postal' END, CASE WHEN category_id NOT IN ('O', 'F') THEN 'category' END, CASE WHEN email = 'nope' THEN 'email' END, CASE WHEN website = 'ftp://x' THEN 'website' END) AS reasons, 'pending' AS status FROM (SELECT {SUB} FROM orders)")
def submissions(spark, sf):
    df = read(spark, sf, "orders").selectExpr(*split_columns(SUB)).withColumns({"city": F.lit("Nantes"), "description": F.lit(None).cast("string"), "tags": F.array(F.lit("x"))})
    return ingest.validate_submissions(df, {"O", "F"}).select("id", F.array_join("reasons", ",").alias("reasons"), "status")


@query("DEC-20", duck("registry") + "SELECT id, CASE WHEN id % 4 = 0 THEN 'FIXED' ELSE category_id END AS category_id FROM registry")
def fixed(spark, sf):
    r = view(spark, sf, "registry").select("id", "category_id")
    return ingest.correct_category(r, r.filter("id % 4 = 0").select("id", F.lit("FIXED").alias("fixed")))
