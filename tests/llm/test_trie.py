"""Operator 12 against brute force: nulls, ties, repeated rows, long conversations, copies, many shards, empty tables, clashing columns."""

import hashlib
import random
import zlib

import pytest

from rollcall.llm import trie

SHAPE = "conv_id long, turn long, role string, text string, depth int, edge boolean, worth int, idx int"


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, own.get(c - c % 100, [])
        full[c] = tuple(base[:h]) + tuple(v[h:])
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids, below = {}, {}
    for p in members:
        for d in range(len(p) + 1):
            below.setdefault(p[:d], []).append(p)
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    out = []
    for p, m in members.items():
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below[p])
        ends = ",".join(map(str, sorted(c for c in m if full[c] == p)))
        leaves = sum(kids.get(q, 0) == 0 for q in below[p])
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True, 2, 3) for r in rows], SHAPE)


def same(spark, rows, shard=trie.SHARD):
    got = [tuple(r) for r in trie.prefix_trie(frame(spark, rows).repartition(5), shard).collect()]
    assert sorted(got, key=str) == by_hand(rows)


def sample(seed, n=150, most=9):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["hi", "hello there", "été", "", None, "ok"])
    rows = []
    for _ in range(n):
        c = rnd.randint(0, 420)
        for t in range(rnd.randint(1, most)):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]) if rnd.random() < 0.2 else "user", text()))
    return [*rows, *rows[:20], (None, 1, "user", "x")]


@pytest.mark.parametrize("shard", [trie.SHARD, 7])
def test_random_conversations(spark, shard):
    same(spark, sample(1), shard)


def test_rows_of_few_turns_and_small_tasks(spark, monkeypatch):
    """Conversations over several rows of a matrix; tasks that hold more rows than a shard."""
    monkeypatch.setattr(trie, "WIDTH", 2)
    monkeypatch.setattr(trie, "SHARD", 3)
    same(spark, sample(2, 60), 10_000)
    long = [(c, t, "user", f"{min(t, 37 + c)}") for c in (0, 3, 101) for t in range(80)]
    same(spark, [*sample(3, 40), *long], 5)


def test_copies_are_spread(spark):
    """One conversation in hundreds of copies, and turns at the root alone."""
    rows = [(100 * c, t, "user", "same" * t) for c in range(600) for t in range(3)] + [(5 + 100 * c, 0, "user", "lone") for c in range(7, 40)]
    same(spark, rows, 50)
    same(spark, [(7, 0, "user", "x"), (107, 0, "user", "y")])


def test_digests_over_several_runs(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "4")
    try:
        same(spark, [(100 * c, 0, "user", "same") for c in range(90)])
    finally:
        spark.conf.unset(key)


def test_empty(spark):
    none = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert trie.prefix_trie(none).count() == 0
