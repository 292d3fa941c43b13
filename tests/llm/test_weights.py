"""Packing by weights: every token in one place, targets held by small sources while they last."""

import random

import pytest

from rollcall.llm import packing


def laid(totals, size, weights, seed=0):
    """Pieces of random documents of every stream: {window: [(offset, stream, place, length)]}."""
    rnd, plan, out = random.Random(seed), packing.phases(totals, size, weights), {}
    for s, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(total - at, rnd.randint(1, 3 * size))
            for start, length, window, offset in packing.pieces(plan, size, s, at, n):
                out.setdefault(window, []).append((offset, s, at + start, length))
            at += n
    return out


def check(totals, size, out):
    held, whole = {}, sum(totals)
    for w in range(-(-whole // size)):
        at = 0
        for offset, s, place, length in sorted(out[w]):
            assert offset == at and place == held.get(s, 0) and length > 0
            at, held[s] = at + length, place + length
        assert at == min(size, whole - w * size)
    assert len(out) == -(-whole // size) and [held.get(s, 0) for s in range(len(totals))] == totals


@pytest.mark.parametrize("seed", range(60))
def test_every_token_has_one_place(seed):
    rnd = random.Random(seed)
    n, size = rnd.randint(1, 6), rnd.choice([64, 256])
    weights = [rnd.choice([0.5, 1, 2, 4]) for _ in range(n)]
    totals = [rnd.choice([0, 1, 7, 100, 5_000, 30_000]) for _ in range(n)]
    for w in (weights, None) if sum(totals) and min(totals) * size >= 2 * sum(totals) else (weights,):
        check(totals, size, laid(totals, size, w, seed))


def test_small_source_has_its_target_while_it_lasts():
    """A million tokens and a hundred, half and half: the hundred fill half of what they can, at the beginning."""
    for small, size in ((100, 64), (10_000, 256)):
        out = laid([1_000_000, small], size, [0.5, 0.5])
        check([1_000_000, small], size, out)
        share = [sum(x[3] for x in out[w] if x[1] == 1) for w in range(len(out))]
        lasts = max(w for w, x in enumerate(share) if x)
        assert lasts <= 2 * small / size + packing.ENDING and all(abs(x - size / 2) <= 1 for x in share[: lasts - packing.ENDING + 1 - (lasts < 3)] if lasts >= packing.ENDING)


def test_others_go_on_by_their_weights():
    out = laid([100_000, 2_000, 40_000], 100, [1, 1, 2])
    for w in range(90, 600):
        by = [sum(x[3] for x in out[w] if x[1] == s) for s in range(3)]
        assert by[1] == 0 and abs(by[0] - 100 / 3) <= 1.01 and abs(by[2] - 200 / 3) <= 1.01


def test_streams_by_weight():
    stream, start, totals, shares = packing.merge_small({0: 10**9, 1: 10**5, 2: 50}, 2048, {0: 0.5, 1: 0.5})
    assert stream[0] != stream[1] and stream[2] == stream[0] == 0 and start[2] == 10**9 and totals == [10**9 + 50, 10**5] and shares == [0.5, 0.5]
    assert packing.merge_small({0: 1000, 1: 10, 2: 1}, 64)[2] == [1011]


def test_pack_by_weights(spark):
    from test_llm_operators import check_packing

    texts = {i: "word and another " * 300 for i in range(60)} | {100 + i: "few of these " * 40 for i in range(12)} | {200: "no weight " * 50}
    name = lambda i: "big" if i < 100 else "small" if i < 200 else "other"
    docs = spark.createDataFrame([(i, t, name(i)) for i, t in texts.items()], "doc_id long, text string, source string").repartition(3)
    out = packing.pack(docs, 256, weights={"big": 1, "small": 1}).collect()
    by_seq = check_packing(out, texts, 256)
    small = sum(r.length for r in out if 100 <= r.doc_id < 200)
    for w in range(2 * small // 256 - packing.ENDING):
        assert abs(sum(r.length for r in by_seq[w] if 100 <= r.doc_id < 200) - 128) <= 1
    for bad in ({f"s{i}": 1 for i in range(600)}, {"big": 0}):
        with pytest.raises(ValueError):
            packing.pack(docs, 256, weights=bad)
