"""Operator 13 against brute force: every word range compared by edit distance."""

import random
import re

import pytest

from rollcall.llm.licenses import BASE, NOTICES, Finder, Notice, find_notices, license_report, pieces

SHAPE = "doc_id long, text string, label string, spans int, words int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranges_by_hand(words, notices):
    """(edits, notice, first word, last word) of all word ranges within the edits."""
    out = set()
    for i, n in enumerate(notices):
        for a in range(len(words)):
            for b in range(a, min(len(words), a + len(n.text.split()) + 5)):
                text = " ".join(words[a : b + 1])
                if abs(len(text) - len(n.text)) <= n.most and set(n.must) <= set(words[a : b + 1]) | (set(n.must) if text == n.text else set()):
                    d = distance(text, n.text)
                    if d <= n.most:
                        out.add((d, i, a, b))
    return out


def edited(rnd, text, k):
    s = list(text)
    for _ in range(k):
        at = rnd.randrange(len(s))
        s[at : at + 1] = rnd.choice([[], ["q"], [s[at], "z"], [s[at], " "]])
    return "".join(s)


def sample(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "license", "Under", "mit", "cc", "by", "nc", "été", "version", "2", "gnu", "x"])
    texts = []
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 8)))]
        for _ in range(rnd.randint(0, 3)):
            n = rnd.choice(NOTICES)
            parts += [edited(rnd, n.text, rnd.randint(0, n.most + 1)).upper() if rnd.random() < 0.3 else edited(rnd, n.text, rnd.randint(0, n.most)), rnd.choice([". ", ", (", "\n"]) + word()]
        texts.append(rnd.choice([" ", "-", " "]).join(parts))
    return [*texts, None, "", "!?", "CC-BY-NC cc by nc by nc cc by nc", "cc by ncx", "Under the MIT License, under\tthe mit\nlicense", "under the mït license", "Apache License, Version 2.0"]


def test_ranges_are_whole(spark):
    """Seeds and the bounded-error matching find every word range within the edits, and its number of edits."""
    finder = Finder(NOTICES)
    for text in sample(1):
        words = words_by_hand(text)
        joined = f" {' '.join(words)} "
        got = set()
        for i, a, b in finder.ranges(joined):
            n, t = NOTICES[i], joined[a:b]
            m = n.base or t == n.text or (all(f" {w} " in f" {t} " for w in n.must) and finder.patterns[i].fullmatch(t))
            if m:
                got.add((0 if m is True else sum(m.fuzzy_counts), i, joined.count(" ", 0, a) - 1, joined.count(" ", 0, b) - 1))
        assert got == ranges_by_hand(words, NOTICES)


def test_pieces_cover_the_notice():
    for n in NOTICES:
        if not n.base:
            assert "".join(p for _, p in pieces(n)) == n.text and len(pieces(n)) == n.most + 1
            assert all(n.text[a : a + len(p)] == p for a, p in pieces(n))


def test_report(spark):
    texts = sample(2)
    docs = spark.createDataFrame([(i, t, "l", 1, 2) for i, t in enumerate([*texts, texts[0]])], SHAPE)
    got = {r.doc_id: r for r in license_report(docs.repartition(3)).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate([*texts, texts[0]]):
        r, words = got[i], words_by_hand(text)
        places = [(n.label, a) for n in BASE for a in range(len(words)) if words[a : a + len(n.text.split())] == n.text.split()]
        starts = [a for _, a in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places}))
        # the method's labels: a best range is never lost, and nothing comes from outside the ranges
        every = ranges_by_hand(words, NOTICES)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert {s.label for s in r.spans} == set(filter(None, r.labels.split(",")))
        assert {(s.edits, s.notice, s.first_word, s.last_word) for s in r.spans} <= every
        assert bool(r.labels) == bool(every)
        for s in r.spans:
            assert words_by_hand(text[s.start : s.end]) == words[s.first_word : s.last_word + 1]
        others = [s for s in r.spans if not s.base]
        assert all(x.end <= y.start for x, y in zip(others, others[1:]))
        best = max((1 - e / len(NOTICES[n].text) for e, n, _, _ in every), default=0)
        assert r.score == pytest.approx(best, abs=1e-6)


def test_misspelt_notices(spark):
    texts = ["released undr teh mit license", "license: under the mpl license", "gnu general public licence version 2", "gnu general public license version 1", "plain words about a licence"]
    docs = spark.createDataFrame([(i, t, "l", 1, 2) for i, t in enumerate(texts)], SHAPE)
    assert [r.labels for r in sorted(license_report(docs).collect())] == ["", "", "gpl-2", "", ""]
    assert license_report(spark.createDataFrame([(0, "under teh mit license", "l", 1, 2)], SHAPE)).first().labels == "mit"
    assert license_report(docs.limit(0)).count() == 0
    only = find_notices(docs, (Notice("x", "plain words abuot", edits=2),)).filter("size(spans) > 0").first()
    assert only.doc_id == 4 and only.spans[0].label == "x"


def test_long_and_hostile_texts(spark):
    """Texts full of pieces of notices take time in proportion to their length."""
    import time

    took = []
    for size in (20_000, 80_000):
        texts = [(piece + " ") * (size // (len(piece) + 1)) for piece in ("under the mit license", "under the m", "license version", "permission to use copy")]
        docs = spark.createDataFrame([(i, t, "l", 1, 2) for i, t in enumerate(texts)], SHAPE)
        start = time.time()
        got = {r.doc_id: r for r in license_report(docs).collect()}
        took.append(time.time() - start)
        assert got[0].n_base == size // 22 and got[1].labels == ""
    assert took[1] < 10 * took[0] + 5
