"""Kept statistics, sketches, cluster pyramids and the kept search index against recounts from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import kept, search, stats
from rollcall.operators.kept_index import KeptIndex, forms, forms_of

ROW = "id long, region string, department string, city string, status string, lng double, lat double, description string, enriched_at long, social map<string,string>, markers map<string,string>, candidate_platforms array<string>, discovered boolean"


def entity(rnd, i):
    pick = lambda *x: rnd.choice(x)
    place = pick(("r1", "01"), ("r1", "02"), ("r2", "03"), (None, None))
    links = {p: "u" for p in ("website", "facebook", "instagram", "linkedin") if rnd.random() < 0.3}
    return (i, *place, pick("a", "b", "c", None), pick("published", "published", "pending", None), pick(1.0, None), pick(2.0, None), pick("d", None), pick(1, None), pick(links, None), pick({"fb_targeted": "1", "web_targeted": "1"}, {}, None), pick(["facebook"], [], None), True)


def same(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


def test_kept_counts_follow_changes(spark, tmp_path):
    rnd = random.Random(1)
    now = {i: entity(rnd, i) for i in range(120)}
    table = kept.KeptCounts(spark, str(tmp_path))
    frame = lambda rows: spark.createDataFrame(list(rows), ROW)
    table.write(frame(now.values()))
    for k in range(4):
        changed = rnd.sample(sorted(now), 25)
        before = [now[i] for i in changed]
        after = {i: entity(rnd, i) for i in changed[:15]} | {1000 * (k + 1) + i: entity(rnd, 1000 * (k + 1) + i) for i in range(6)}  # the others are deleted
        now = {i: r for i, r in now.items() if i not in changed} | after
        for _ in range(2):  # each batch comes twice
            table.apply(frame(before), frame(after.values()), k)
    whole, counts = frame(now.values()), table.read(4)
    same(kept.coverage(counts), stats.coverage(whole))
    same(kept.coverage(counts, "department"), stats.coverage(whole, "department"))
    same(kept.progress(counts), stats.progress(whole))
    same(kept.territory_rollup(counts), stats.territory_rollup(whole))
    same(counts, kept.counts(whole))
    # all rows deleted
    table.apply(whole, whole.limit(0), 4)
    assert table.read(5).count() == 0
    same(kept.coverage(table.read(5)), stats.coverage(whole.limit(0)))


def test_pyramid_is_every_zoom(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(2, 5), rnd.gauss(46, 3), rnd.choice("abc")) for i in range(500)] + [(-1, None, 1.0, "a"), (-2, 179.99, 85.0, "b"), (-3, -180.0, -85.0, "c")]
    df = spark.createDataFrame(rows, "id long, lng double, lat double, category_id string")
    got = stats.cluster_pyramid(df, 7, 64)
    for zoom in (0, 3, 7):
        same(got.filter(F.col("zoom") == zoom).drop("zoom"), stats.cluster(df, zoom, 64))
    with pytest.raises(ValueError):
        stats.cluster_pyramid(df, 7, 56)


def test_sketches_of_longer_times(spark):
    rnd = random.Random(3)
    rows = [(f"2024-0{1 + d // 28}-{1 + d % 28:02d} 10:00:00", "view" if d % 2 else "home", f"v{rnd.randrange(4000)}") for d in range(56) for _ in range(400)]
    df = spark.createDataFrame(rows, "ts string, kind string, visitor string").withColumn("ts", F.to_timestamp("ts"))
    daily = stats.visitor_sketches(df)
    for unit, cut in (("month", 7), ("year", 4)):
        want = {}
        for ts, kind, v in rows:
            want.setdefault((ts[:cut], kind), set()).add(v)
        got = {(str(r.start)[:cut], r.kind): r for r in stats.visitors_over(daily, unit, "kind").collect()}
        assert set(got) == set(want)
        for k, v in want.items():
            assert abs(got[k].visitors - len(v)) <= 0.05 * len(v)  # three standard errors
        assert sum(r.hits for r in got.values()) == len(rows)


def test_forms(spark):
    words = ["a", "ab", "abc", "aab", "widget", "éàü", "aaaa"]
    got = {r.w: set(r.f) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", forms(F.col("w")).alias("f")).collect()}
    assert got == {w: forms_of(w) for w in words}


def docs_like(rnd, n):
    word = lambda: rnd.choice(["widget", "wigdet", "widgets", "wide", "window", "windowsill", "ring", "rings", "river"]) + rnd.choice(["", "", "s", "x"])
    return [(i, f"{word()} {word()}", "c", f"{word()}", rnd.choice(["city", word()]), rnd.choice(["01", "02"]), [word()]) for i in range(n)]


DOC = "id long, name string, category string, description string, city string, department string, tags array<string>"


def test_kept_index_answers_like_a_new_one(spark, tmp_path):
    rnd = random.Random(4)
    first = docs_like(rnd, 60)
    changed = [(i, *docs_like(rnd, 1)[0][1:]) for i in range(0, 60, 7)] + [(100, *docs_like(rnd, 1)[0][1:])]
    gone = [(3, None, None, None, None, None, None)]
    index = KeptIndex(spark, str(tmp_path), buckets=4)
    index.write(spark.createDataFrame(first, DOC))
    terms = spark.createDataFrame([("t", "ring"), ("t", "rings"), ("u", "widgets"), ("v", "nothing")], "term string, token string")
    now = {r[0]: r for r in first}
    for k, batch in enumerate(([], changed, gone)):
        if batch:
            index.update(spark.createDataFrame(batch, DOC), k)
        now |= {r[0]: r for r in batch}
        whole = search.build_index(spark.createDataFrame([r for r in now.values() if r[1]], DOC))
        same(index.match_ids(terms), search.match_ids(whole, terms))
        same(index.match_ids(terms, "01", 5), search.match_ids(whole, terms, "01", 5))
        for q in ("widg", "wigdets", "windowsil", "Ring", "r", "zzz", "windwosill"):
            assert index.suggest(q, 7).collect() == search.suggest(whole, q, 7).collect()
        assert index.suggest("widget", 5, "02").collect() == search.suggest(whole, "widget", 5, "02").collect()


def test_questions_read_few_buckets(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path), buckets=16)
    index.write(spark.createDataFrame(docs_like(random.Random(5), 200), DOC))
    terms = spark.createDataFrame([("t", "ring"), ("t", "river")], "term string, token string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else buckets are skipped all the same, but the plan doesn't say so
    found = plan(index.find(terms))
    assert "SelectedBucketsCount: 1 out of 16" in found or "SelectedBucketsCount: 2 out of 16" in found
    assert "Exchange hashpartitioning" not in found
    near = plan(index.tokens_like("widgat"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount" in near and "levenshtein" in near
    forms_read = [line for line in near.splitlines() if "forms" in line]
    assert forms_read and all("Bucketed: true" in line for line in forms_read)
