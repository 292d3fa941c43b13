"""Keys along a curve, the ranges of a box, and what a scan reads of a table sorted by them."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rollcall.functions import geo
from rollcall.sources.registry import write_by_cell


def points(seed, n):
    rnd = random.Random(seed)
    some = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(n // 2)] + [(rnd.gauss(2, 3), rnd.gauss(47, 2)) for _ in range(n // 2)]
    return [(i, x, max(-90.0, min(90.0, y))) for i, (x, y) in enumerate([*some, (-180.0, -90.0), (180.0, 90.0), (0.0, 0.0)])] + [(-1, None, 1.0), (-2, 1.0, None)]


def key(lng, lat):
    x, y = (geo._quantised(v, low, span) for v, low, span in ((lng, -180.0, 360.0), (lat, -90.0, 180.0)))
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(geo.KEY_BITS))


def test_ranges_hold_the_box(spark):
    rows = points(1, 2000)
    got = {r.id: r.cell for r in spark.createDataFrame(rows, "id long, lng double, lat double").withColumn("cell", geo.cell_key()).collect()}
    assert got[-1] is None and got[-2] is None and all(got[i] == key(x, y) for i, x, y in rows if i >= 0)
    rnd = random.Random(2)
    boxes = [(-180.0, -90.0, 180.0, 90.0), (2.0, 47.0, 2.0, 47.0), (180.0, 90.0, 180.0, 90.0)]
    boxes += [(a, c, a + rnd.random() * 20, min(90.0, c + rnd.random() * 9)) for a, c in ((rnd.uniform(-180, 160), rnd.uniform(-90, 80)) for _ in range(60))]
    for box in boxes:
        for most in (1, 4, 32):
            ranges = geo.box_ranges(box, most)
            assert 1 <= len(ranges) <= most and all(b[1] + 1 < a[0] for b, a in zip(ranges, ranges[1:]))
            inside = [i for i, x, y in rows if i >= 0 and box[0] <= x <= box[2] and box[1] <= y <= box[3]]
            assert all(any(lo <= got[i] <= hi for lo, hi in ranges) for i in inside)
    # the ranges fit: few keys lie outside a box
    covered = sum(hi - lo + 1 for lo, hi in geo.box_ranges((1.0, 46.0, 4.0, 48.0), 32))
    assert covered < 1.6 * (3 / 360) * (2 / 180) * 4**geo.KEY_BITS


def test_a_small_box_reads_few_row_groups(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id", "-4 + (id * 104729 % 1100000) / 1e5 AS lng", "42 + (id * 7919 % 800000) / 1e5 AS lat", "repeat(md5(string(id)), 4) AS name")
    path = f"{tmp_path}/cells"
    write_by_cell(df, path, files=4, row_group=256 << 10)
    box = (1.0, 46.0, 1.4, 46.3)
    kept = spark.read.parquet(path).filter(geo.in_cells(box) & geo.in_box(box)).select("id", "name")
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(cell," in plan and "LessThanOrEqual(cell," in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = spark.read.parquet(path).filter(geo.in_cells(box) & geo.in_box(box)).select("id", "name")
        want = {r.id for r in df.filter(geo.in_box(box)).collect()}
        assert {r.id for r in kept.collect()} == want and len(want) > 50
        scan = kept._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in tmp_path.glob("cells/*.parquet")]
    assert sum(groups) >= 12 and read < 60_000 / 5
    everything = spark.read.parquet(path).filter(F.col("cell").isNotNull()).count()
    assert everything == 60_000
