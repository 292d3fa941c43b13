"""Agendas where many events are near."""

import random

import pytest
from compare import DATA
from pyspark.sql import functions as F

from rollcall.functions import geo
from rollcall.operators import agenda
from rollcall.queries import QUERIES

WORDS = ["harbour", "festival", "garden", "lantern", "Été", "music", "the", "ab", "market"]


def made(spark, seed, n_events):
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k)) if rnd.random() < 0.95 else None
    at = lambda: (rnd.choice([2.3, 2.31, 2.5]), 48.8) if rnd.random() < 0.3 else (2.3 + rnd.uniform(-0.5, 0.5), 48.8 + rnd.uniform(-0.4, 0.4)) if rnd.random() < 0.9 else (rnd.uniform(-180, 180), rnd.uniform(-90, 90))
    a = spark.createDataFrame([(i, *at(), text(3), text(1)) for i in range(60)] + [(60, None, 48.8, "harbour garden", "")], "id int, lng double, lat double, name string, city string")
    b = spark.createDataFrame([(i, *at(), text(4)) for i in range(n_events)], "uid int, lng double, lat double, text string")
    return a, b


def brute(a, b, km):
    every = a.select(F.col("id").alias("a_id"), F.col("lng").alias("a_lng"), F.col("lat").alias("a_lat"), "name", "city").crossJoin(b.select(F.col("uid").alias("b_id"), F.col("lng").alias("b_lng"), F.col("lat").alias("b_lat"), "text"))
    dist = geo.haversine(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat"), 6371.0)
    return agenda.name_in_text(every.withColumn("dist_km", dist).filter(F.col("dist_km") <= km))


@pytest.mark.parametrize("km, n_events", [(30.0, 900), (30.0, 12), (3.0, 300)])
def test_agendas_are_those_of_all_pairs(spark, km, n_events):
    a, b = made(spark, n_events, n_events)
    pairs = brute(a, b, km).cache()
    got, want = ({tuple(r) for r in x.collect()} for x in (agenda.agendas(a, b, km), agenda.assign_agenda(pairs)))
    assert got == want and {m for _, _, _, m, _ in want} == {False, True}
    both = (x.select("a_id", "b_id", "matched") for x in (agenda.named_events(a, b, km), pairs))
    got, want = ([tuple(r) for r in x.orderBy("a_id", "b_id").collect()] for x in both)
    assert got == want and len(want) > 20


def test_few_of_many_pairs_are_ranked(spark, monkeypatch):
    a, b = made(spark, 5, 3000)
    seen, keep = [], agenda.assign_agenda
    monkeypatch.setattr(agenda, "assign_agenda", lambda pairs, cap=6: seen.append(pairs.count()) or keep(pairs, cap))
    agenda.agendas(a, b, 30.0).count()
    assert seen[0] * 5 < brute(a, b, 30.0).count()


@pytest.mark.parametrize("name", ["JN-9", "WIN-8"])
def test_words_are_not_taken_from_pairs(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "split(" in below and "split(" not in above + below.split("\n", 1)[0]
