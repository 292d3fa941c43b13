"""Streams give what their batch twins give; small hand-made boundary rows."""

import random

from pyspark.sql import functions as F

from rollcall.functions.geo import within_radius
from rollcall.operators import decide, health, listing, match, quality
from rollcall.streaming import jobs


def streamed(spark, df, tmp_path, build, files=1):
    df.repartition(files).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = build(src)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


def test_health_stream(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i % 4, "website", rnd.choice(["u", "u", "u", "v"]), rnd.choice(["dead", "dead", "alive", "blocked", "error"]), 1000 + i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, platform string, url string, status string, checked_at long, seq long")
    got = streamed(spark, df, tmp_path, jobs.health_stream).select("id", "checked_at", "consecutive_failures", "first_fail_at").collect()
    want = health.fold_failures(df).select("id", "checked_at", "consecutive_failures", "first_fail_at").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rate_limit(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 3), i, rnd.random() * 600) for i in range(400)] + [(9, 1000 + i, float(i)) for i in range(7)] + [(9, 2000, 60.001)]
    df = spark.createDataFrame(rows, "client long, seq long, at double")
    batch = {r.seq: r.accepted for r in jobs.rate_limit(df, 6).collect()}
    assert [batch[1000 + i] for i in range(7)] == [True] * 6 + [False] and batch[2000]
    stream = {r.seq: r.accepted for r in streamed(spark, df, tmp_path, lambda s: jobs.rate_limit_stream(s, 6)).collect()}
    assert stream == batch


def test_failure_folds(spark):
    def fold(*states):
        rows = [(1, "website", "v" if s.endswith("*") else "u", s.rstrip("*"), i, i) for i, s in enumerate(states)]
        df = spark.createDataFrame(rows, "id long, platform string, url string, status string, checked_at long, seq long")
        r = health.latest_health(health.fold_failures(df)).first()
        return r.consecutive_failures, r.first_fail_at

    assert fold("dead", "dead") == (2, 0)
    assert fold("dead", "blocked", "dead") == (2, 0)
    assert fold("dead", "alive", "dead") == (1, 2)
    assert fold("dead", "dead*") == (1, 1) and fold("dead", "blocked*") == (0, None)


def test_reap_boundaries(spark):
    hour = 3600
    rows = [(1, "dead", 2, 500, 0), (2, "dead", 2, 500, 1), (3, "dead", 2, 404, None), (4, "dead", 1, 404, 0), (5, "dead", 2, None, None), (6, "alive", 5, 404, 0)]
    df = spark.createDataFrame(rows, "id int, status string, consecutive_failures int, http_code int, first_fail_at int")
    assert {r.id for r in df.filter(health.reapable(F.lit(12 * hour))).collect()} == {1, 3}


def test_routing_boundaries(spark):
    rows = [(1, "website", 0.75, "quarantine", 0.9, False), (2, "website", 0.4, "quarantine", 0.9, False), (3, "facebook", 0.1, "quarantine", 0.85, False), (4, "facebook", 0.9, "drop", 0.9, False), (5, "website", 0.399, "keep", 1.0, False), (6, "website", 0.0, "drop", 0.0, True)]
    df = spark.createDataFrame(rows, "id int, platform string, fused double, verdict string, confidence double, trusted boolean")
    assert {r.id: r.route for r in decide.route(df).collect()} == {1: "apply", 2: "quarantine", 3: "apply", 4: "drop", 5: "drop", 6: "apply"}


def test_best_site_stops_at_a_sure_keep(spark):
    rows = [(1, 1, "a", "keep", 0.69), (1, 2, "b", "keep", 0.9), (1, 3, "c", "keep", 0.99), (2, 1, "d", "drop", 0.95), (2, 2, "e", "keep", 0.7)]
    df = spark.createDataFrame(rows, "id int, position int, url string, verdict string, confidence double")
    assert {r.id: r.url for r in decide.best_site(df).collect()} == {1: "b", 2: "d"}


def test_moderation_is_idempotent(spark):
    q = spark.createDataFrame([(1, "website", "u"), (2, "website", "v"), (3, "facebook", "w")], "id int, platform string, url string")
    links = spark.createDataFrame([(1, "website", "old")], "id int, platform string, url string")
    acts = spark.createDataFrame([(1, "website", "keep", 1), (2, "website", "drop", 1), (9, "website", "keep", 1)], "id int, platform string, action string, position int")
    l1, q1, a1 = decide.resolve(q, links, acts)
    assert {tuple(r) for r in l1.collect()} == {(1, "website", "u")} and a1.count() == 1 and {r.id for r in q1.collect()} == {3}
    l2, q2, a2 = decide.resolve(q1, l1, acts)
    assert l2.collect() == l1.collect() and q2.collect() == q1.collect() and a2.count() == 0


def test_radius_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = lambda n, p: spark.createDataFrame([(i, rnd.uniform(-5, 8), rnd.uniform(42, 51)) for i in range(n)], f"{p}_id long, {p}_lng double, {p}_lat double")
    a, b = pts(300, "a"), pts(300, "b")
    grid = {(r.a_id, r.b_id) for r in within_radius(a, b, 30.0).collect()}
    from rollcall.functions.geo import haversine

    full = a.crossJoin(b).filter(haversine(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat"), 6371.0) <= 30.0)
    assert grid == {(r.a_id, r.b_id) for r in full.collect()} and grid


def test_trigram_prefix_filter_equals_brute_force(spark):
    rnd = random.Random(4)
    name = lambda: " ".join(rnd.choice(["river", "riverside", "club", "clubs", "stone", "stones", "walk"]) for _ in range(rnd.randint(1, 3)))
    a = spark.createDataFrame([(i, name(), "x") for i in range(60)], "id long, name string, d string")
    b = spark.createDataFrame([(i, name(), "x") for i in range(60)], "id long, name string, d string")

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    want = {(x.id, y.id) for x in a.collect() for y in b.collect() if len(grams(x.name) & grams(y.name)) * 10 > 3 * len(grams(x.name) | grams(y.name))}
    assert {(r.a_id, r.b_id) for r in match.fuzzy_join(a, b, "d", k=1000).collect()} == want


def test_global_position(spark):
    df = spark.range(1000).repartition(7).withColumn("n", F.col("id") % 3)
    got = sorted((r.position, r.n, r.id) for r in listing.global_position(df, ["n", "id"]).collect())
    assert [g[1:] for g in got] == sorted((i % 3, i) for i in range(1000)) and [g[0] for g in got] == list(range(1000))


def test_quality_decay(spark):
    df = spark.createDataFrame([(d,) for d in (None, 60.0, 90.0, 227.5, 365.0)], "d double")
    assert [r[0] for r in df.select(quality.decay(F.col("d"), 90, 365)).collect()] == [0.0, 1.0, 1.0, 0.5, 0.0]
