"""Hand-made boundary rows of the registry operators."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions import geo, text, urls
from rollcall.operators import decide, ingest, listing, merge, pages, search
from rollcall.sources import registry as sinks


def values(df):
    return [r[0] for r in df.collect()]


def test_departments(spark):
    df = spark.createDataFrame([(p,) for p in ("20199", "20200", "97100", "98800", "4400", "44x00", " 44000 ", "", None)], "p string")
    assert values(df.select(geo.department_of(F.col("p")))) == ["2A", "2B", "971", "988", None, None, "44", None, None]


def test_dissolved(spark):
    rows = [("1", "a", "0001-01-01"), ("2", "a", "1900-12-31"), ("3", "a", "1901-01-01"), ("4", "a", " "), ("5", " ", None), (None, "a", None)]
    df = spark.createDataFrame(rows, "id string, name string, dissolved string")
    assert [r.id for r in ingest.valid_rows(df).collect()] == ["1", "2", "4"]


def test_null_island(spark):
    df = spark.createDataFrame([(1, None, None), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, 1.0001, 0.0)], "id int, lng double, lat double")
    assert [r.id for r in listing.map_points(df).collect()] == [4]


def test_bad_boxes():
    for bad in ("1,2,3", "a,b,c,d", "5,0,1,1", "nan,0,1,1"):
        with pytest.raises(ValueError):
            geo.in_box(bad)


def test_whole_words_are_ascii(spark):
    df = spark.createDataFrame([("le soin",), ("soiné",), ("besoin",), ("soin_x",)], "t string")
    got = values(df.select(ingest.classify(F.col("t"), [("care", [], ["soin"])], "other")))
    assert got == ["care", "care", "other", "other"]
    assert ingest.rule_pattern(["a.b"]) == r"a\.b"


def test_names(spark):
    df = spark.createDataFrame([("Les Amis de l'Étang  (club)",)], "t string")
    r = df.select(text.name_key(F.col("t")), text.name_norm(F.col("t")), text.tokens(F.col("t")), text.slugify(F.col("t"))).first()
    assert tuple(r) == ("AMIS L ETANG", "amis etang", ["amis", "etang"], "les-amis-de-l-etang-club")


def test_social_pages(spark):
    rows = ["https://www.facebook.com/people/x/1", "https://facebook.com/1234567", "https://fb.com/abc", "https://facebook.com/pages/Nice-Club/99", "https://m.facebook.com/NiceClub?x", "https://youtube.com/watch?v=1", "https://www.youtube.com/@chan", "https://linkedin.com/in/me", "https://linkedin.com/school/s1", "https://tiktok.com/@handle/video/1", "https://x.com/intent", "https://x.com/me", "https://www.helloasso.com/associations/a-b/x", "not a url", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "id int, url string")
    got = {r.id: (r.platform, r.slug) for r in urls.canonical_social(df).collect()}
    assert got == {3: ("facebook", "Nice-Club"), 4: ("facebook", "NiceClub"), 6: ("youtube", "chan"), 8: ("linkedin", "s1"), 9: ("tiktok", "handle"), 11: ("twitter", "me"), 12: ("donation", "a-b")}
    assert 1 in {r.id for r in urls.canonical_social(df, strict=False).collect()}


def test_upsert_keeps_places_and_is_idempotent(spark):
    base = spark.createDataFrame([("R1", "old", 1.0, 2.0, "draft", "manual", "ev", 5), ("R2", "b", 3.0, 4.0, "published", "registry", "x", 5)], "ext_id string, name string, lng double, lat double, status string, source string, evidence string, updated_at long")
    batch = spark.createDataFrame([("R1", "first", 9.0, 9.0, 0), ("R1", "new", None, None, 1), ("R3", "c", 5.0, 6.0, 2)], "ext_id string, name string, lng double, lat double, position int")
    once = merge.upsert(base, batch, F.lit(7).cast("long"))
    rows = {r.ext_id: tuple(r)[1:] for r in once.collect()}
    assert rows == {"R1": ("new", 1.0, 2.0, "draft", "manual", "ev", 7), "R2": ("b", 3.0, 4.0, "published", "registry", "x", 5), "R3": ("c", 5.0, 6.0, "published", "registry", None, 7)}
    twice = merge.upsert(once, batch, F.lit(7).cast("long"))
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_verdict_folds(spark):
    rows = [(1, "facebook", "a", 1, 0.1, "drop", False), (1, "facebook", "b", 2, 0.2, "keep", False), (1, "facebook", "c", 3, 0.3, "keep", False), (2, "facebook", "d", 1, 0.1, "drop", False), (2, "facebook", "e", 2, 0.2, "quarantine", False), (3, "donation", "f", 1, 0.1, "drop", True), (3, "donation", "g", 2, 0.1, "drop", True)]
    df = spark.createDataFrame(rows, "id int, platform string, url string, position int, confidence double, verdict string, trusted boolean")
    assert {r.id: (r.url, r.confidence) for r in decide.verdict_per_platform(df).collect()} == {1: ("b", 0.2), 2: ("e", 0.2), 3: ("g", 1.0)}


def test_verdict_text(spark):
    df = spark.createDataFrame([('x {"verdict": "Keep", "confidence": 7} y',), ("nothing",), ('{"verdict": "odd", "confidence": "NaN"}',), (None,)], "response string")
    assert [(r.verdict, r.confidence) for r in decide.parse_verdicts(df).collect()] == [("keep", 1.0), ("quarantine", 0.0), ("quarantine", 0.0), ("quarantine", 0.0)]


def test_page_jobs(spark):
    html = "<title>T</title><nav><ul><li>Club nav</li></ul></nav><p>Body  text</p><table><tr><th>Ville</th><th>Nom</th></tr><tr><td>X</td><td>Club des Amis</td></tr></table><ul><li>Union sportive - foot</li><li>CLUB DES AMIS</li></ul><h2>Amicale laïque</h2><div class=asso><b>Comité des fêtes</b></div>"
    df = spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id long, url string, html string")
    out = {r.page_id: (r.text, r.error) for r in pages.page_text(df).collect()}
    assert out[1][0].startswith("T - Body text") and "nav" not in out[1][0] and out[2] == (None, "empty")
    assert {r.name for r in pages.extract_org_names(df).collect()} == {"Club des Amis", "Union sportive", "Amicale laïque", "Comité des fêtes"}


def test_suggest_allows_typos(spark):
    docs = spark.createDataFrame([(1, "d", "c", "association sportive"), (2, "d", "c", "assocation club")], "id long, department string, category string, name string")
    index = search.build_index(docs.withColumns({"city": F.lit(""), "tags": F.array().cast("array<string>"), "description": F.lit("")}))
    assert [r.id for r in search.suggest(index, "association").collect()] == [1, 2]
    assert [r.id for r in search.suggest(index, "spo").collect()] == [1]


def test_register_file(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes('id;titre;objet\n 1 ; "A; b" ;x\n2;short\n\n3;"q ""x""";y;extra\n'.encode())
    rows = sinks.read_registry(spark, str(p)).collect()
    assert [(r.id, r.titre) for r in rows] == [("1", "A; b"), ("2", "short"), ("3", 'q "x"')]


def test_register_file_limits_and_refusals(spark, tmp_path):
    import gzip

    members = [b"id;titre;objet\n"] + ["".join(f"{100 * m + i};t{i};x\n" for i in range(100)).encode() for m in range(3)] + [b"9;short\n8;a;b;c\n"]
    (tmp_path / "r.csv.gz").write_bytes(b"".join(gzip.compress(m) for m in members))  # several members, one after the other
    path = str(tmp_path / "r.csv.gz")
    assert [r.id for r in sinks.read_registry(spark, path, limit=7).collect()] == [str(i) for i in range(7)]
    df = sinks.read_registry(spark, path).cache()
    assert df.count() == 302 and sorted(r.line for r in sinks.refused_lines(df).collect()) == ["8;a;b;c", "9;short"]
    df.unpersist()


@pytest.mark.parametrize("parts", [1, 8, 211])
def test_global_position(spark, parts):
    import random

    from rollcall.operators.listing import global_position

    rnd, before = random.Random(parts), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for _ in range(3 if parts > 8 else 10):
            rows = [(rnd.randrange(40), i) for i in range(500)]
            rnd.shuffle(rows)
            got = global_position(spark.createDataFrame(rows, "k int, id int").repartition(7), ["k"]).collect()
            assert sorted(r.position for r in got) == list(range(500)) and sorted((r.k, r.id) for r in got) == sorted(rows)
            assert [r.k for r in sorted(got, key=lambda r: r.position)] == sorted(k for k, _ in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_radius_across_the_date_line_and_the_poles(spark):
    import math
    import random

    from rollcall.functions.geo import within_radius

    rnd = random.Random(3)
    places = [(179.99, 10.0), (-179.99, 10.0), (180.0, 10.0), (-180.0, 10.1), (0.0, 89.99), (180.0, 89.99), (90.0, -89.9), (-90.0, -89.95), (0.0, 0.0)]
    places += [(rnd.choice([-180, 0, 180]) + rnd.uniform(-1, 1), rnd.choice([-89, -70, 0, 60, 85, 89.5]) + rnd.uniform(-0.5, 0.5)) for _ in range(300)]
    places = [(max(-180.0, min(180.0, x)), max(-90.0, min(90.0, y))) for x, y in places]
    a = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)] + [(999, None, 1.0)], "a_id int, a_lng double, a_lat double")
    b = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "b_id int, b_lng double, b_lat double")

    def far(p, q):
        (x, y), (u, v) = [map(math.radians, z) for z in (p, q)]
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    for km in (2.5, 30.0, 400.0):
        want = {(i, j) for i, p in enumerate(places) for j, q in enumerate(places) if far(p, q) <= km}
        got = [(r.a_id, r.b_id) for r in within_radius(a, b, km).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_text_of_elements_that_are_never_closed():
    from rollcall.operators.pages import main_text

    assert main_text("<title>T</title><body><form><p>kept</p><nav>menu</nav><br>more", 100) == "T - kept more"
    assert main_text("<div><button>kept</div><nav>gone</nav><script>var x", 100) == "kept"
    assert main_text("<form>gone</form>stays", 100) == "stays"


def grams(t):
    words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    return {p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)}


def test_fuzzy_join_against_brute_force(spark):
    import random

    from rollcall.operators.match import dice_join, fuzzy_join

    rnd = random.Random(5)
    name = lambda: " ".join(rnd.choice(["club", "Clubs", "river", "rivers", "lac", "du lac", "amis", "ami", "x", "Éte"]) for _ in range(rnd.randint(0, 4)))
    a = [(i, name(), rnd.choice("pq")) for i in range(60)]
    b = [(i, name(), rnd.choice("pq")) for i in range(60)] + [(60, None, "p"), (61, "river", None)]

    want = set()
    for i, t, p in a:
        hits = [(-len(grams(t) & grams(u)) / len(grams(t) | grams(u)), j, len(grams(t) & grams(u))) for j, u, q in b if p == q and grams(t) and grams(u)]
        want |= {(i, j, c, r + 1) for r, (s, j, c) in enumerate(sorted(h for h in hits if h[0] < -0.3)[:3])}
    x, y = spark.createDataFrame(a, "id int, name string, block string"), spark.createDataFrame(b, "id int, name string, block string")
    assert {(r.a_id, r.b_id, r.common, r["rank"]) for r in fuzzy_join(x, y, "block").collect()} == want
    same = {(r.a_id, r.b_id) for r in dice_join(x, y, "block", 1, 1).collect()}
    assert {(i, j) for i, t, p in a for j, u, q in b if p == q and t and t.lower() == (u or "").lower() and t != "x"} - {(i, j) for i, t, p in a for j, u, q in b if t.strip() in ("x", "x x", "x x x", "x x x x")} <= same


def test_pages_of_platforms(spark):
    from rollcall.functions.urls import canonical_social

    links = {
        "https://www.facebook.com/pages/Les-Amis/123456789": "https://www.facebook.com/Les-Amis/", "https://facebook.com/photo.php/x": None, "https://facebook.com/abc": None, "https://facebook.com/1234567/": None, "https://facebook.com/people/x/1": None,
        "https://instagram.com/reel/abcd": None, "https://instagram.com/amis.club/": "https://www.instagram.com/amis.club/", "https://linkedin.com/school/lyc/about": "https://www.linkedin.com/school/lyc/", "https://linkedin.com/in/person": None,
        "https://youtube.com/@amis": "https://youtube.com/@amis", "https://youtube.com/c/Amis/videos": "https://youtube.com/c/Amis/videos", "https://youtube.com/watch?v=1": None, "https://tiktok.com/@amis": "https://www.tiktok.com/@amis", "https://tiktok.com/tag/amis": None,
        "https://x.com/amis/status/1": "https://twitter.com/amis", "https://twitter.com/search": None, "https://www.helloasso.com/associations/amis/adhesions": "https://www.helloasso.com/associations/amis", "https://helloasso.com/x": None, "https://other.org/amis": None, "https://facebook.com/": None,
    }
    got = {r.url: r.page for r in canonical_social(spark.createDataFrame([(u,) for u in links], "url string")).collect()}
    assert got == {u: p for u, p in links.items() if p}
    loose = {r.url for r in canonical_social(spark.createDataFrame([(u,) for u in links], "url string"), strict=False).collect()}
    assert {"https://facebook.com/abc", "https://facebook.com/1234567/", "https://linkedin.com/in/person"} <= loose


def crossed_by_hand(names, registry):
    """(page_id, name, matched, b_id, closest) of (page_id, name, block) against (id, name, block); a null block finds nothing."""
    out = []
    for page, t, p in names:
        hits = [(-len(grams(t) & grams(u)) / len(grams(t) | grams(u)), j) for j, u, q in registry if p is not None and p == q and grams(t) and grams(u)]
        sim, j = min((h for h in hits if h[0] < -0.3), default=(0, None))
        out.append((page, t, sim <= -0.45, j if sim <= -0.45 else None, None if sim <= -0.45 else j))
    return sorted(out, key=repr)


def test_cross_reference_against_brute_force(spark):
    import random

    rnd = random.Random(11)
    name = lambda: " ".join(rnd.choice(["club", "clubs", "river", "rivers", "lac", "amis", "ami", "tennis", "table"]) for _ in range(rnd.randint(1, 4)))
    keys = {(i % 20, name()): rnd.choice(["p", "q", None]) for i in range(80)}  # a name once a page
    names = [(page, t, block) for (page, t), block in keys.items()]
    registry = [(i, name(), rnd.choice("pq")) for i in range(60)] + [(60, None, "p"), (61, "club", None)]
    x = spark.createDataFrame([(page, t, t.upper(), block) for page, t, block in names], "page_id int, name string, name_key string, block string")
    y = spark.createDataFrame(registry, "id int, name string, block string")
    want = crossed_by_hand(names, registry)
    assert {w[2] for w in want} == {True, False} and any(w[4] is not None for w in want)
    assert sorted(map(tuple, pages.cross_reference(x, y, "block").collect()), key=repr) == want
    assert sorted(map(tuple, pages.cross_reference(x, y.limit(0), "block").collect()), key=repr) == crossed_by_hand(names, [])


def test_listing_query_against_brute_force(spark):
    """DEC-21 over its whole tables: the headings of all pages against the registry."""
    import html
    import re
    import unicodedata

    from compare import DATA, database

    from rollcall.functions.text import STOPWORDS
    from rollcall.plans.adapters import duck
    from rollcall.queries import QUERIES

    short = {w for w in STOPWORDS if len(w) <= 4}
    con, names = database(DATA), []
    registry = [(i, t, t[:1].upper()) for i, t in con.execute(duck("registry") + "SELECT id, name FROM registry").fetchall()]
    for page, text in con.execute("SELECT page_id, html FROM pages").fetchall():
        for t in re.findall("<h1>(.*?)</h1>", text or ""):
            t = " ".join(html.unescape(t).split())
            plain = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).upper()
            words = [w for w in re.findall("[A-Z0-9]+", plain) if w.lower() not in short]
            if 6 <= len(t) <= 120 and words:
                names.append((page, t, words[0][0]))
    assert names
    assert sorted(map(tuple, QUERIES["DEC-21"](spark, DATA).collect()), key=repr) == crossed_by_hand(names, registry)


def test_tied_verdicts_count_by_position(spark):
    rows = [(i, "website", f"https://u{i % 2}.org", p, 0.9, verdict) for p, verdict in ((7, "drop"), (2, "keep"), (5, "quarantine")) for i in range(40)]
    v = spark.createDataFrame(rows, "id int, platform string, url string, position int, confidence double, verdict string")
    df = spark.range(40).selectExpr("cast(id AS int) AS id", "cast(null AS string) AS website", "'' AS social_site")
    for tied in (v.orderBy("position"), v.orderBy(F.desc("position")), v.repartition(7)):
        assert {r.website for r in decide.promote(df, tied).filter("promoted").collect()} == {"https://u0.org", "https://u1.org"}
        assert decide.promote(df, tied).filter("promoted AND examined").count() == 40
