"""The radius join where most points stand in one city."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions import geo


def brute(a, b, km):
    full = a.filter("a_lng IS NOT NULL AND a_lat IS NOT NULL").crossJoin(b)
    near = geo.haversine(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat"), 6371.0) <= km
    return {(r.a_id, r.b_id) for r in full.filter(near).collect()}


def points(spark, rnd, n, name, city):
    lng, lat = city
    rows = [(i, lng + rnd.gauss(0, 0.2), lat + rnd.gauss(0, 0.15)) for i in range(n // 2)] + [(n + i, *city) for i in range(n // 8)]  # many at one place
    rows += [(2 * n + i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(n // 8)] + [(3 * n + i, lng + rnd.uniform(-2, 2), max(-90.0, min(90.0, lat + rnd.uniform(-2, 2)))) for i in range(n // 4)]
    rows = [(i, (x + 180) % 360 - 180, y) for i, x, y in rows] + [(-1, None, 1.0)]
    return spark.createDataFrame(rows, f"{name}_id long, {name}_lng double, {name}_lat double")


@pytest.mark.parametrize("city", [(2.35, 48.86), (179.95, -17.0), (20.0, 89.0)])
@pytest.mark.parametrize("km", [30.0, 4.0])
def test_split_cells_give_the_same_pairs(spark, city, km):
    rnd = random.Random(str((city, km)))
    a, b = points(spark, rnd, 240, "a", city), points(spark, rnd, 400, "b", city)
    want = brute(a, b, km)
    rows = geo.within_radius(a, b, km, most=12).select("a_id", "b_id").collect()
    assert len(rows) == len({tuple(r) for r in rows}) and {tuple(r) for r in rows} == want and len(want) > 500
    assert {tuple(r) for r in geo.within_radius(a, b, km).select("a_id", "b_id").collect()} == want


def test_no_key_is_above_the_bound(spark, monkeypatch):
    rnd = random.Random(7)
    a, b = points(spark, rnd, 400, "a", (2.35, 48.86)), points(spark, rnd, 4000, "b", (2.35, 48.86))
    seen, keep = [], geo.split_cells
    monkeypatch.setattr(geo, "split_cells", lambda rows, most: seen.append((rows, out := keep(rows, most))) or out)
    geo.within_radius(a, b, 30.0, most=200).count()
    rows, parts = seen[0]
    of = parts.select("cx", "cy", F.explode("deep").alias("e"), "part", "salts").select("cx", "cy", "e.u", "e.v", "part", "salts")
    placed = rows.join(of, ["cx", "cy", "u", "v"])
    assert placed.count() == rows.count() > 2000  # every row of a hot cell is in one part
    dealt = placed.groupBy("cx", "cy", "part", F.pmod(F.xxhash64("b_id"), F.col("salts"))).count().agg(F.max("count")).first()[0]
    assert dealt <= 200 * 1.4  # a hash deals what stands at one place
    whole = rows.groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
    assert whole > 5 * 200 and parts.filter("salts > 1").count() >= 1
