"""The top-k similarity join against brute force, and how its work grows with a block."""

import random

import pytest

from rollcall.operators import match

WORDS = ["river", "riverside", "club", "clubs", "stone", "stones", "walk", "walking", "of", "the", "sea"]


def grams(s):
    return frozenset(f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1))


def similarity(a, b):
    return len(a & b) / len(a | b)


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, d string")


@pytest.mark.parametrize("rounds", [((9, 10, 2), (3, 4, 2), (1, 2, 1)), ((9, 10, 1),), ((1, 2, 2),), ()])
def test_best_k_equal_brute_force(spark, rounds):
    rnd = random.Random(5)
    name = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 4)))
    a = [(i, name(), rnd.choice("xy")) for i in range(80)] + [(900, None, "x"), (901, "river", None)]
    b = [(i, name(), rnd.choice("xy")) for i in range(150)] + [(500 + i, "riverside club", "x") for i in range(6)]
    want = set()
    for i, s, d in a:
        if s and d:
            near = sorted((-similarity(grams(s), grams(t)), j) for j, t, e in b if e == d and t and grams(s) and 10 * len(grams(s) & grams(t)) > 3 * len(grams(s) | grams(t)))
            want |= {(i, j, r + 1) for r, (_, j) in enumerate(near[:3])}
    got = {(r.a_id, r.b_id, r.rank) for r in match.fuzzy_join(table(spark, a), table(spark, b), "d", rounds=rounds).collect()}
    assert got == want and len(want) > 100


def test_work_for_a_name_does_not_grow_with_its_block(spark, monkeypatch):
    """Every candidate has near copies; ten times as many other names of the same words make no more pairs to verify for it."""
    rnd = random.Random(6)
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "qui", "ro", "su", "ta", "ve", "wi", "xo", "zu"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(4))
    seen = {}
    keep = match._similar
    for size in (300, 3000):
        names = [f"{word()} {word()} {word()} club of the town" for _ in range(size)]
        cand = [(i, names[i] + " x", "d") for i in range(100)]
        registry = [(10 * i + c, n + (" s" * c), "d") for i, n in enumerate(names) for c in range(3)]
        pairs = []
        monkeypatch.setattr(match, "_similar", lambda met, *a, **b: pairs.append(met.count()) or keep(met, *a, **b))  # noqa: B023
        got = match.fuzzy_join(table(spark, cand), table(spark, registry), "d").collect()
        assert {(r.a_id, r.b_id // 10) for r in got} == {(i, i) for i in range(100)}
        seen[size] = pairs
    assert sum(seen[3000]) <= 2 * sum(seen[300]) + 300 and sum(seen[3000]) < 3000
