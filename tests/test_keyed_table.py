"""Upserts whose cost follows the batch: against a dictionary, in plans, in bytes; replays and compaction."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollcall.operators.merge import last_by_key, upsert
from rollcall.sources.keyed import KeyedTable

BASE = "ext_id long, name string, lng double, lat double, status string, source string, updated_at long"
BATCH = "ext_id long, name string, lng double, lat double, position long"


def rows(seed, n, keys):
    rnd = random.Random(seed)
    return [(rnd.choice([rnd.randrange(keys)] * 9 + [None]) if n < 1000 else rnd.randrange(keys), rnd.choice([None, f"n{i}"]), *((None, None) if rnd.random() < 0.5 else (rnd.random(), rnd.choice([rnd.random(), None]))), i) for i in range(n)]


def folded(base, batches):
    """By hand: key to (name, lng, lat, status, source, updated_at)."""
    now = {r[0]: list(r[1:]) for r in base}
    for at, batch in enumerate(batches):
        for k, name, lng, lat, _ in {r[0]: r for r in sorted(batch, key=lambda r: r[-1]) if r[0] is not None}.values():
            old = now.setdefault(k, [None, None, None, "published", "registry", None])
            old[0], old[5] = name, at
            if lng is not None and lat is not None:
                old[1:3] = lng, lat
    return sorted(((k, *v) for k, v in now.items()), key=str)


def base_rows(n):
    return [(i, f"b{i}", i / 7 if i % 3 else None, i / 9 if i % 3 else None, "pending", "manual", -1) for i in range(n)]


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


@pytest.mark.parametrize("most", [200_000, 0])
def test_upsert_both_ways(spark, most):
    base, batch = base_rows(200), rows(1, 150, 300)
    got = upsert(spark.createDataFrame(base, BASE), spark.createDataFrame(batch, BATCH), F.lit(0).cast("long"), most=most)
    assert sorted(map(tuple, got.collect()), key=str) == folded(base, [batch])
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in spark.createDataFrame(base, BASE).schema]


def test_last_by_key_of_a_hot_key(spark):
    df = spark.createDataFrame([(1, f"n{i}", None, None, i) for i in range(500)] + [(2, "x", 1.0, 2.0, 7)], BATCH)
    assert sorted((r.ext_id, r.name) for r in last_by_key(df, "ext_id", "position").collect()) == [(1, "n499"), (2, "x")]


@pytest.mark.parametrize("most", [200_000, 0])
def test_batches_and_replays(spark, tmp_path, most):
    base, batches = base_rows(300), [rows(s, 40, 500) for s in range(8)]
    table = KeyedTable(spark, str(tmp_path), spark.createDataFrame(base, BASE).schema, buckets=4, share=0.3)
    table.write(spark.createDataFrame(base, BASE))
    versions = set()
    for k, batch in enumerate(batches):
        for _ in range(2):  # each batch comes twice
            table.append(spark.createDataFrame(batch, BATCH), k, F.lit(k).cast("long"))
        versions.add(table.head()[0])
        assert sorted(map(tuple, table.read(most).collect()), key=str) == folded(base, batches[: k + 1])
    assert len(versions) > 1  # the log went into the base on the way
    table.append(spark.createDataFrame(rows(99, 40, 500), BATCH), 0, F.lit(9).cast("long"))  # batch 0 again, long in the base
    assert sorted(map(tuple, table.read(most).collect()), key=str) == folded(base, batches)
    # another session that knows nothing but the path
    again = KeyedTable(spark.newSession(), str(tmp_path), table.schema, buckets=4, share=0.3)
    spark.sql(f"DROP TABLE {table.name(table.head()[0])}")
    assert sorted(map(tuple, again.read(most).collect()), key=str) == folded(base, batches)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_cost_follows_the_batch(spark, tmp_path):
    base = spark.range(100_000).selectExpr("id AS ext_id", "concat('name ', id) AS name", "id / 7 AS lng", "id / 9 AS lat", "'pending' AS status", "'manual' AS source", "0L AS updated_at")
    table = KeyedTable(spark, str(tmp_path), base.schema, buckets=8)
    table.write(base)
    whole, log = size(tmp_path / "base"), {}
    for k, n in enumerate((10, 1000)):  # each touches every bucket
        table.append(spark.createDataFrame(rows(k, n, 100_000), BATCH), k, F.lit(k).cast("long"))
        log[n] = size(tmp_path / "log" / f"b={k}")
    assert size(tmp_path / "base") == whole and table.head()[0] == 0
    assert log[10] < whole / 50 and log[10] < log[1000] < whole / 10
    # the base is not dealt: not with the log broadcast, and not with the log dealt to its buckets
    few = table.read()
    plan, dealt = exchanges(few)
    assert "BroadcastHashJoin" in plan and few.count() >= 100_000
    table_name = table.name(0)
    many = table.read(most=0)
    plan, dealt = exchanges(many)
    assert "Bucketed: true" in plan and table_name in plan and len(dealt) <= 1 and many.count() == few.count()
