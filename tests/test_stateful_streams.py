"""Streams with timers over several micro-batches: against their batch twins; state that goes away."""

import random

from pyspark.sql import functions as F

from rollcall.operators import health
from rollcall.operators.ingest import visitor_id
from rollcall.streaming import jobs

PROBE = "id long, platform string, url string, status string, checked_at long, seq long, http_code int"


def in_turn(spark, rows, shape, parts, path, by):
    """A stream that reads ``parts`` files one after the other."""
    rows = sorted(rows, key=by)
    for i in range(parts):
        some = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(some, shape).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def probes(seed, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        status = rnd.choice(["dead", "dead", "dead", "alive", "blocked", "error"])
        out.append((rnd.randint(0, 7), rnd.choice(["website", "facebook"]), rnd.choice(["u"] * 6 + ["v"]), status, (i + 1) * 1800 + rnd.randint(0, 1700), i, rnd.choice([404, None, None, 500]) if status == "dead" else 200))
    return out


def test_deaths_and_states_over_batches(spark, tmp_path):
    rows = probes(1)
    stream = in_turn(spark, rows, PROBE, 8, f"{tmp_path}/in", lambda r: r[4])
    jobs.health_job(stream, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    got = spark.read.schema(jobs.HEALTH_OUT).parquet(f"{tmp_path}/out")
    df = spark.createDataFrame(rows, PROBE)
    folded = health.fold_failures(df)
    cols = ["id", "platform", "seq", "url", "status", "checked_at", "consecutive_failures", "first_fail_at"]
    assert sorted(map(str, got.filter("kind = 'state'").select(cols).collect())) == sorted(map(str, folded.select(cols).collect()))
    last = max(r[4] for r in rows) - 3600
    want = health.confirmed_deaths(folded, F.lit(last)).select("id", "platform", "url", "seq", "dead_at", "consecutive_failures", "first_fail_at").collect()
    deaths = got.filter("kind = 'death'").select("id", "platform", "url", "seq", F.col("checked_at").alias("dead_at"), "consecutive_failures", "first_fail_at").collect()
    assert sorted(map(str, deaths)) == sorted(map(str, want)) and len(want) > 10


def test_deaths_equal_reapable_links(spark):
    """A run has a death by ``now`` if some look at it up to then found its link reapable, and none else."""
    rows = probes(2, 120)
    df = spark.createDataFrame(rows, PROBE)
    folded = health.fold_failures(df)
    now = max(r[4] for r in rows) + 40_000
    deaths = {(r.id, r.platform, r.dead_at) for r in health.confirmed_deaths(folded, F.lit(now)).collect()}
    by = {}
    for r in sorted(folded.collect(), key=lambda r: (r.checked_at, r.seq)):
        by.setdefault((r.id, r.platform), []).append(r)
    want = set()
    for key, states in by.items():
        told, url = False, None
        for s, after in zip(states, [*states[1:], None]):
            if s.status == "alive" or s.url != url:
                told, url = False, s.url
            end = now + 1 if after is None else after.checked_at
            looks = [s.checked_at, *((s.first_fail_at + 43_200,) if s.first_fail_at is not None and s.checked_at < s.first_fail_at + 43_200 < end else ())]
            for t in looks:
                sure = s.http_code in (404, 410) or (s.first_fail_at is not None and t - s.first_fail_at >= 43_200)
                if not told and s.status == "dead" and s.consecutive_failures >= 2 and sure:
                    want.add((*key, t))
                    told = True
    assert deaths == want and deaths


def test_death_without_another_probe(spark, tmp_path):
    rows = [(1, "website", "u", "dead", 0, 0, 500), (1, "website", "u", "dead", 3600, 1, 500), (2, "website", "u", "dead", 0, 2, 500), (2, "website", "u", "dead", 60, 3, 500), (2, "website", "u", "alive", 7200, 4, 200), (9, "website", "u", "alive", 46_800, 5, 200)]
    stream = in_turn(spark, rows, PROBE, 3, f"{tmp_path}/in", lambda r: r[4])
    jobs.health_job(stream, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    got = spark.read.schema(jobs.HEALTH_OUT).parquet(f"{tmp_path}/out").filter("kind = 'death'").collect()
    assert [(r.id, r.checked_at, r.consecutive_failures) for r in got] == [(1, 43_200, 2)]


def limited(spark, rows, tmp_path, parts, max_hits, window):
    stream = in_turn(spark, rows, "client long, seq long, at double", parts, f"{tmp_path}/in", lambda r: r[2])
    out = jobs.rate_limit_stream(stream, max_hits, window)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.seq: r.accepted for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_limit_over_batches(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), i, 1 + rnd.random() * 20_000) for i in range(600)]
    got, _ = limited(spark, rows, tmp_path, 6, 3, 600.0)
    want = {r.seq: r.accepted for r in jobs.rate_limit(spark.createDataFrame(rows, "client long, seq long, at double"), 3, 600.0).collect()}
    assert got == want and 0 < sum(want.values()) < 600


def test_state_of_clients_goes(spark, tmp_path):
    """Thousands of clients with one hit each: their state is gone when their windows are over."""
    rows = [(c, c, 100.0 + c % 50) for c in range(3000)] + [(10_000, 10_000, 5_000.0), (10_001, 10_001, 20_000.0)]
    got, state = limited(spark, rows, tmp_path, 3, 6, 60.0)
    assert all(got.values()) and len(got) == 3002
    assert max(state) >= 1000 and state[-1] <= 2  # a client's times and its timer


def test_human_visitors(spark):
    rows = [("2024-01-01 10:00:00", "view", "1.1.1.1", "Firefox"), ("2024-01-01 11:00:00", "view", "1.1.1.1", "Firefox"), ("2024-01-02 10:00:00", "view", "1.1.1.1", "Firefox"), ("2024-01-01 10:00:00", "view", "1.1.1.2", "GoogleBot"), ("2024-01-01 10:00:00", "view", "1.1.1.3", None)]
    df = spark.createDataFrame(rows, "ts string, kind string, ip string, agent string").withColumn("ts", F.to_timestamp("ts"))
    got = [r.visitor for r in jobs.human_visitors(df, "s").orderBy("ts").collect()]
    assert len(got) == 3 and got[0] == got[1] != got[2]
    want = spark.range(1).select(visitor_id(F.lit("1.1.1.1"), F.lit("Firefox"), F.lit("2024-01-01"), "s")).first()[0]
    assert got[0] == want
