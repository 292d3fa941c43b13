"""Small fixtures against brute force; nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from rollcall.llm import packing, signature_tree, url_filter, warc
from rollcall.llm.decontaminate import clean_documents, cut_spans, decontamination_report
from rollcall.llm.jaccard_join import jaccard_components, keep_one
from rollcall.llm.language import keep_identified, language_report
from rollcall.llm.quality import quality_report
from rollcall.llm.quotes import reply_order
from rollcall.llm.secrets import RULES, RuleSet, redact, report, scan_versions
from rollcall.llm.toxicity import toxicity_report

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, key int, row int, spans int"


def documents(spark, texts, lang="en"):
    """Rows with ids from 0; a (id, text) pair keeps its id; columns that operators also use inside come along."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}" if i else None, len(t or ""), "c", 1, 2, 3) for i, t in pairs], DOCS)


def table(df):
    return {r[0]: r for r in df.collect()}


# 1


def spans_by_hand(text):
    out = []
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for order, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [x for _, _, x in sorted(out)]


SECRETS = ["password=abcdefgh1 é", None, "", "ünï token : 'ABCDEFGH' " + "a1" * 20, "AKIA" + "A" * 12 + " AKIAAB", "password=secret=short password:secret:abcdefghijk", "toKen=12345678 paſsword=12345678", "x" * 200_000 + " secret='" + "0123456789abcdef" * 3]


def test_secrets(spark):
    docs = documents(spark, [*SECRETS, SECRETS[0], (3, SECRETS[3])])
    found, ledger = scan_versions(docs)
    got = report(found).collect()
    assert len(got) == 10 and ledger.count() == 7  # one blob each, null as the empty one
    for r in got:
        want = spans_by_hand((SECRETS + [SECRETS[0]])[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert report(scan_versions(docs.limit(0))[0]).count() == 0


def test_ledger_is_incremental(spark, tmp_path):
    docs = documents(spark, SECRETS)
    _, ledger = scan_versions(docs.limit(3))
    more = documents(spark, [*SECRETS, "new secret=abcdefghij"])
    found, after = scan_versions(more, ledger=ledger)
    assert found.count() == 9 and after.count() == 8
    # kept at a path: the second run appends what the first has not seen
    kept = f"{tmp_path}/ledger"
    scan_versions(docs.limit(3), ledger=kept)
    found, _ = scan_versions(more, ledger=kept)
    rows = spark.read.parquet(kept)
    assert rows.count() == rows.select("blob", "rules").distinct().count() == 8
    assert sorted(map(repr, report(found).collect())) == sorted(map(repr, report(scan_versions(more)[0]).collect()))
    other = RuleSet(RULES[:2])
    assert other.version != RuleSet().version
    assert scan_versions(docs, ledger=ledger, rules=other)[1].filter(f"rules = '{other.version}'").count() == 7


def test_redact(spark):
    docs = documents(spark, [*SECRETS, "no such thing"])
    out = table(redact(docs))
    assert redact(docs).columns == docs.columns and len(out) == 9
    assert out[8].text == "no such thing" and out[1].text is None and out[0].text == "[secret] é"
    assert all("[secret]" in out[i].text and not spans_by_hand(out[i].text) for i in (0, 3, 4, 5, 7))
    assert out[0].n_chars == len(out[0].text)


def test_redact_without_ids(spark):
    rows = [(None, SECRETS[0]), (None, SECRETS[0]), (None, "no such thing"), (None, None), (7, SECRETS[0]), (7, SECRETS[3]), (7, SECRETS[3])]
    got = [(r.doc_id, r.text) for r in redact(documents(spark, rows)).collect()]
    assert len(got) == 7 and all(not spans_by_hand(t or "") for _, t in got)
    assert sorted(t or "" for i, t in got if i is None) == ["", "[secret] é", "[secret] é", "no such thing"]


# 2


def hits_by_hand(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(size, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add(item)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["alpha", "Beta", "gamma", "É", "é", "delta1", "o"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 5, 9, 10, 11, 30, 30])] + [(77, None), (100, "The É was"), (9, "odd")]
    texts = [None, "", "-- !!", *(" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(40))]
    texts += [f"{texts[5]}, {items[k][1].upper()}... {texts[6]}" for k in (4, 5, 6, 7, 8)] + [items[8][1] * 3, "x " * 30_000 + items[9][1]]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n string")
    docs = documents(spark, texts)
    for r in decontamination_report(docs, bench).collect():
        assert tuple(r)[1:] == hits_by_hand(texts[r.doc_id], items), r.doc_id
    kept = {r.doc_id for r in clean_documents(docs, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not hits_by_hand(t, items)[4]}
    long = spark.createDataFrame([(1, items[8][1])], "item_id long, text string")
    cut = table(cut_spans(docs, long))
    assert all(hits_by_hand(cut[i].text, [(1, items[8][1])])[1] == 0 or hits_by_hand(texts[i], [(1, items[8][1])])[1] > hits_by_hand(cut[i].text, [(1, items[8][1])])[1] for i in cut)
    assert cut[3].text == texts[3] and cut_spans(docs, long).columns == docs.columns
    # rows that share an id, or have none, and rows that repeat
    odd = documents(spark, [(5, texts[43]), (5, texts[44]), (5, texts[43]), (None, texts[45]), (None, texts[46]), (None, None), (None, None)])
    want = sorted([repr((i, *hits_by_hand(t, items))) for i, t in [(5, texts[43]), (5, texts[44]), (5, texts[43]), (None, texts[45]), (None, texts[46]), (None, None), (None, None)]])
    assert sorted(repr(tuple(r)) for r in decontamination_report(odd, bench).collect()) == want
    assert sorted(r.text or "" for r in clean_documents(odd, bench).collect()) == sorted(t or "" for t in [texts[43], texts[44], texts[43], texts[45], texts[46], None, None] if not hits_by_hand(t, items)[4])
    clash = docs.withColumnsRenamed({"cls": "_cut", "key": "_id", "row": "_hash"})
    assert cut_spans(clash, long).columns == clash.columns and clean_documents(clash, bench).columns == clash.columns
    assert decontamination_report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination_report(docs.limit(0), bench).count() == 0


# 3


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow  do I fly?"), (1, 1, "assistant", "With wings.\nOr a plane."), (1, 2, "user", "> how do i fly?\nI meant cheaply."), (1, 3, "assistant", "> > How do I fly?\n> I meant cheaply.\nBy bus"), (1, 4, "user", "> Or a plane.\nWhich?"), (1, 5, "user", "thanks"),
        (2, 0, "user", None), (2, 1, "x", ""), (2, 1, "x", ""), (3, 7, "a", "> never said"), (None, 1, "a", "b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in reply_order(df).collect()}
    assert len(out) == 9
    assert [out[1, t].reply_to for t in range(6)] == [None, 0, 0, 2, 1, 4]
    assert [out[1, t].depth for t in range(6)] == [0, 1, 1, 2, 2, 3]
    assert [out[1, t].position for t in range(6)] == [1, 2, 5, 6, 3, 4]
    assert out[1, 3].text == "By bus" and (out[1, 3].n_quotes, out[1, 3].n_linked) == (2, 2)
    assert out[3, 7].n_quotes == 1 and out[3, 7].n_linked == 0 and out[3, 7].text == "" and out[2, 0].text == ""
    assert reply_order(df.limit(0)).count() == 0


def test_quotes_of_neighbouring_lines(spark):
    said = [
        "One  line\nand two\n\nand three\nand four", "First\n> One line\nlast", "> one line\n> and two\nA", "> and two\n>\n> and three\n> and four\nB", "> One line and two\n> and three\n> and four\nC",
        "> One line\n> and three\nD", "> and three\n> and two\nE", "> first\n> last\nF", "> > and three\n> > and four\n> B\nG", "and two\nand three", "> and two\n> and three\nH", "> and three\n> and four\n> and five\nI",
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c in (1, 2) for t, x in enumerate(said)] + [(3, 0, "user", "> one line\n> and two")], "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in reply_order(df).collect()}
    for c in (1, 2):
        assert [out[c, t].reply_to for t in range(12)] == [None, 0, 0, 0, 0, 4, 5, 1, 3, 8, 9, 10]
        assert [out[c, t].n_quotes for t in range(12)] == [0, 1, 1, 1, 1, 1, 1, 1, 2, 0, 1, 1]
        assert [out[c, t].n_linked for t in range(12)] == [0, 1, 1, 1, 1, 0, 0, 1, 2, 0, 1, 0]
    assert out[3, 0].n_quotes == 1 and out[3, 0].n_linked == 0


def threads_by_hand(rows):
    """{(conv, turn): (text, n_quotes, n_linked, reply_to, depth, position)}, message by message."""
    out = {}
    for conv in sorted({c for c, *_ in rows}):
        said = {t: x or "" for c, t, _, x in sorted(rows, key=lambda r: r[1]) if c == conv}
        lines, reply = {}, {}
        for t, x in said.items():
            lines[t] = []
            for line in re.split("\r?\n", x):
                marks = re.match(r"(?:[ \t]{0,3}>)*", line)[0]
                lines[t].append((marks.count(">"), line[len(marks) :]))
        clean = lambda b: " ".join(b.lower().split())

        def runs(t, lines=lines, clean=clean):
            found = []
            for i, (level, b) in enumerate(lines[t]):
                if clean(b):
                    if not found or found[-1][0] != level:
                        found.append((level, i, []))
                    found[-1][2].append(clean(b))
            return found

        def holds(t, passage, runs=runs, lines=lines, clean=clean):
            own = [clean(b) for level, b in lines[t] if level == 0 and clean(b)]
            n = len(passage)
            whole = [" ".join(r) for level, _, r in runs(t) if level == 0]
            text = " ".join(passage)
            return text in own or text in whole or any(" ".join(own[i : i + n]) == text for i in range(len(own) - n + 1))

        turns = list(said)
        for k, t in enumerate(turns):
            quotes = [(level, i, max((u for u in turns[:k] if holds(u, r)), default=None)) for level, i, r in runs(t) if level]
            linked = sorted(q for q in quotes if q[2] is not None)
            reply[t] = (len(quotes), len(linked), linked[0][2] if linked else turns[k - 1] if k else None)
        # runs of messages that answer the one before; a branch hangs on the message it answers
        depth, branches, hangs = {}, {}, {}
        for k, t in enumerate(turns):
            up = reply[t][2]
            depth[t] = 0 if up is None else depth[up] + 1
            if k and up == turns[k - 1]:
                last.append(t)
            else:
                last = branches[t] = [t]
                hangs.setdefault(up, []).append(t)
        order = []

        def walk(start, branches=branches, hangs=hangs, order=order):
            order.extend(branches[start])
            for t in reversed(branches[start]):
                for b in hangs.get(t, []):
                    walk(b)

        for root in hangs.get(None, []):
            walk(root)
        for t in turns:
            own = "\n".join(b for level, b in lines[t] if level == 0).strip()
            out[conv, t] = (own, *reply[t], depth[t], order.index(t) + 1)
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_quotes_against_brute_force(spark, monkeypatch, block):
    from rollcall.llm import quotes

    monkeypatch.setattr(quotes, "BLOCK", block)
    rnd, rows = random.Random(11), []
    for conv in range(120):
        said = []
        for t in range(rnd.randint(1, 14)):
            parts = []
            for _ in range(rnd.randint(1, 3)):
                if said and rnd.random() < 0.6:
                    lines = rnd.choice(said[-4:] if rnd.random() < 0.5 else said).split("\n")
                    i = rnd.randrange(len(lines))
                    some = lines[i : i + rnd.randint(1, 3)]
                    if rnd.random() < 0.2:
                        some = [" ".join(some)]
                    mark = rnd.choice(["> ", ">", ">  > ", "  > "])
                    parts += [mark + (x.upper() if rnd.random() < 0.3 else x) for x in some]
                if rnd.random() < 0.8:
                    parts += [" ".join(rnd.choice(["yes", "no", "thanks", "maybe so", "Éa", "t%d" % t]) for _ in range(rnd.randint(1, 2))) for _ in range(rnd.randint(1, 3))]
                if rnd.random() < 0.2:
                    parts.append(rnd.choice(["", ">", "> >  "]))
            said.append("\n".join(parts))
            rows.append((conv, t * 3 - 5, "user", said[-1]))
    # each answers the one before the last: a thread as deep as it gets
    rows += [(500, t, "user", (f"> line {t - 2}\n" if t > 1 else "") + f"line {t}") for t in range(40)]
    rows += [(501, 0, "user", "first"), *[(501, t, "user", "> first\nagain") for t in range(1, 30)]]
    rows += [(502, 0, "user", "word " * 40_000 + "\nend"), (502, 1, "a", "x"), (502, 2, "user", "> end")]
    df = spark.createDataFrame([(c, t, r, x, 1, 2) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, _b int, idx int")
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.reply_to, r.depth, r.position) for r in reply_order(df.repartition(5)).collect()}
    want = threads_by_hand(rows)
    assert sum(w[2] for w in want.values()) > 300
    assert {k: (got.get(k), w) for k, w in want.items() if got.get(k) != w} == {} and len(got) == len(want)


# 4


def test_warc(spark):
    big = "é" * 700
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "u\nv", "small"), (5, "x", "small"), (6, "y", ""), (7, "z", "\0" * 300_000), (2, "http://b/", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, top int")
    out = warc.warc_report(pages).collect()
    manifest = warc.write_warc(pages)
    assert all(len(m.offsets) == m.records for m in manifest.collect()) and manifest.agg({"records": "sum"}).first()[0] == 8
    assert len(out) == 8
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in out:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 1 else ("response", None))
    assert warc.warc_report(pages.limit(0)).count() == 0


def test_archive_has_a_leading_dictionary_and_single_records():
    records = [warc.record(i, "u", f"<p>common words {i}</p>".encode() * 9, "d", None, "2024-01-01T00:00:00Z") for i in range(200)]
    data, at = warc.archive(records)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert [warc.page_of(f["WARC-Record-ID"]) for f, _ in warc.read_archive(data)] == [str(i) for i in range(200)]
    assert [warc.page_of(warc.read_record(data, a)[0]["WARC-Record-ID"]) for a in at[::37]] == [str(i) for i in range(0, 200, 37)]
    assert len(data) < sum(map(len, records)) / 3


# 5


def test_language(spark):
    rnd = random.Random(1)
    words = {"aa": "the of and house river stone".split(), "bb": "der und das haus fluss stein".split()}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(3, 40))), lang) for i, lang in enumerate(["aa", "bb"] * 150)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !", "aa"), (903, "und das " * 30_000, None), (1, rows[1][1], "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_report(docs).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and out[903].lang_pred == "bb"
    held = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in out if out[i].held_out} == {i for i in out if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(out[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert language_report(docs.limit(0)).count() == 0


def test_language_fit_is_kernel_ridge_regression():
    """With every document a landmark, Nyström features give the exact weighted kernel ridge solution."""
    from rollcall.llm import language
    from rollcall.llm.grams import presence

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefgh "[: 5 + i % 4]) for _ in range(30)) for i in range(30)]
    lang = np.array(["xyz"[i % 3] if i < 24 else "x" for i in range(30)], object)
    packed = np.packbits(presence(texts, language.WIDTHS, language.BITS), axis=1)
    model = language.fit(packed, lang, 30, 0.5)
    sets = []
    for t in texts:
        rows, cols = language.presence([t], language.WIDTHS, language.BITS).nonzero()
        sets.append(set(cols.tolist()))
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    w = np.array([30 / 3 / (lang == x).sum() for x in lang])
    y = np.array([[1.0 if x == name else -1.0 for name in "xyz"] for x in lang])
    direct = k @ np.linalg.solve(w[:, None] * k + 0.5 * np.eye(30), w[:, None] * y)
    got = model.scorer()(np.unpackbits(packed, axis=1))
    assert model.languages == ["x", "y", "z"] and np.abs(got - direct).max() < 2e-3


def test_many_languages_stay_within_the_bounds(spark, monkeypatch):
    from rollcall.llm import language

    monkeypatch.setattr(language, "SAMPLE", 120)
    monkeypatch.setattr(language, "LANDMARKS", 9)
    rows = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 25] * 3} word {i % 25}", f"l{i % 25:02d}") for i in range(1000)] + [(2000 + i, "plenty more", "l00") for i in range(40)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 9 and "l00" in model.languages and len(model.landmarks) == 9


# 6


def components_by_hand(texts, width, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * den >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(n)] for n in (3, 8, 20, 60, 200, 1000)]
    texts = [None, "", " \n", "one", "ONE", "one two", "Same Same same", "É b c", "é b c"]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
                c[rnd.randrange(len(c))] = f"v{rnd.randint(0, 9)}"
            texts.append("  ".join(c[rnd.choice([0, 0, 1, 3]) :]).upper() if rnd.random() < 0.3 else " ".join(c))
    return texts


@pytest.mark.parametrize(("width", "num", "den", "bin_tokens"), [(3, 9, 10, 4_000_000), (5, 4, 5, 4_000_000), (3, 9, 10, 500)])
def test_jaccard_components(spark, width, num, den, bin_tokens):
    texts = near_copies(7)
    want = components_by_hand(texts, width, num, den)
    got = jaccard_components(documents(spark, texts), width, num, den, bin_tokens).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, *w) for i, w in enumerate(want)]


def test_keep_one(spark):
    docs = documents(spark, ["a b c d e f", "A b c d e f", "other text here is it", None, "", (1, "A b c d e f")])
    out = keep_one(docs, width=5, num=4, den=5)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4]
    assert keep_one(docs.limit(0)).count() == 0


def test_signature_tree_loses_nothing():
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    base = [np.unique(rnd.choice(pool, n)) for n in rnd.integers(5, 200, 30)]
    sets = [np.unique(np.concatenate([b[rnd.random(len(b)) > 0.04], rnd.choice(pool, 1)])) for b in base for _ in range(12)]
    tree, linked = signature_tree.SignatureTree(sets, max(map(len, sets))), signature_tree.Linked(len(sets))
    list(signature_tree.traverse(tree, tree, True, 9, 10, linked, 0))
    want = signature_tree.Linked(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 10 >= 9 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [linked.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


# 7


def check_packing(out, texts, size):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    total = sum(map(len, ids.values()))
    assert sorted(by_seq) == list(range(-(-total // size)))
    for w, rows in by_seq.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == (size if w < len(by_seq) - 1 else total - size * w)
    return by_seq


def test_packing(spark):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice(["hello", "world", "été", "naïve's", "12,5"]) for _ in range(rnd.randint(0, 300))) for i in range(60)}
    texts |= {60: None, 61: "", 62: "long " * 30_000, 63: "<|endoftext|>  two\n\n\tgaps "}
    docs = documents(spark, list(texts.items())).repartition(5)
    by_seq = check_packing(packing.pack(docs, 256).collect(), texts, 256)
    assert len(by_seq) > 100
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_gives_small_sources_their_turns(spark):
    rnd = random.Random(9)
    sources = ["big"] * 150 + [f"s{rnd.randrange(40)}" for _ in range(600)]
    rnd.shuffle(sources)
    texts = {i: "word and more words " * (300 if s == "big" else rnd.randint(1, 6)) for i, s in enumerate(sources)}
    docs = spark.createDataFrame([(i, t, sources[i], 1) for i, t in texts.items()], "doc_id long, text string, source string, n int").repartition(4)
    out = packing.pack(docs, 128).collect()
    by_seq = check_packing(out, texts, 128)
    small = [(r.sequence_id, r.offset, sources[r.doc_id], r.length) for r in out if sources[r.doc_id] != "big"]
    total, done, upto, most = {}, {}, 0, {}
    for _, _, s, n in small:
        total[s] = total.get(s, 0) + n
    for r in out:
        s = sources[r.doc_id]
        most[s] = max(most.get(s, 0), r.doc_tokens)
    every = sum(total.values())
    assert every / sum(r.length for r in out) < 1 / 4 and len(total) > 30 and len(by_seq) > 100
    if all(t / sum(r.length for r in out) < 1 / packing.LEAST_SHARE for t in total.values()):
        for _, _, s, n in sorted(small):
            upto, done[s] = upto + n, done.get(s, 0) + n
            assert all(abs(done.get(k, 0) / t - upto / every) <= 2 * max(most[x] / total[x] for x in total) for k, t in total.items())


def test_packing_keeps_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "one two", "a", 1, 2)] * 3 + [(None, "three", None, 1, 2)] * 2 + [(1, "other", "b", 1, 2)], "doc_id long, text string, source string, stream int, off int")
    out = packing.pack(docs, 64).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and sorted(r.offset for r in out)[0] == 0
    assert sum(r.length for r in out) == sum(n for n in (3, 3, 3, 2, 2, 2)) or sum(r.length for r in out) == max(r.offset + r.length for r in out)


def test_packing_keeps_target_shares(spark):
    texts = {i: "word " * 400 for i in range(60)}
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in texts.items()], "doc_id long, text string, source string")
    out = packing.pack(docs, 512, weights={"a": 0.75, "b": 0.25}).collect()
    by_seq = check_packing(out, texts, 512)
    for w in range(20):
        assert abs(sum(r.length for r in by_seq[w] if r.doc_id % 2 == 0) - 384) <= 1


def test_closed_form_is_round_robin():
    plan = packing.phases([1000, 333, 77], 64)
    for p in plan:
        for w in range(p.windows):
            x, y = w * 64, min((w + 1) * 64, p.tokens)
            got = [p.had(s, y) - p.had(s, x) for s in range(3)]
            assert sum(got) == y - x and min(got) >= 0
            assert all(abs(p.had(s, y) - y * t / 1410) < 1 for s, t in enumerate([1000, 333, 77]))  # deficits stay under a token


# 8


def test_cascade_is_exact():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**63, (2, 20_000), dtype=np.uint64)
    for share in (0.0, 0.01, 0.5, 1.0):
        listed = rnd.random(len(a)) < share
        levels = url_filter.build_cascade(a, b, listed)
        assert (url_filter.in_cascade(levels, a, b) == listed).all()


def test_judge_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://A.Example.com/en/12?x", "https://a.example.com/en/7/", "http://a.example.com/de/1", "http://x.net/de/8", "http://Q.example.net/de/8", "http://q.example.net/fr", "ftp://org/es/#a", "http://notorg/es/", "http://b.org?/es/", "http://q.example.net/fr"]
    pages = spark.createDataFrame([(i, u, "r", True) for i, u in enumerate(urls)], "page_id long, url string, row string, listed boolean")
    want = [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/12", "com/en/", "block"), ("a.example.com", "/en/7/", "example.com/en/7", "allow"), ("a.example.com", "/de/1", None, "block"), ("x.net", "/de/8", "net/de/", "allow"), ("q.example.net", "/de/8", "example.net/de/8", "block"), ("q.example.net", "/fr", None, "block"), ("org", "/es/", "org/es/", "block"), ("notorg", "/es/", None, "allow"), ("b.org", "", None, "allow"), ("q.example.net", "/fr", None, "block")]
    for limit in (64 << 20, 0):  # broadcast, then dealt to shards
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
        assert [got[i] for i in range(len(urls))] == want
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# 9


def quality_by_hand(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_quality(spark):
    rnd = random.Random(4)
    clean = [" ".join(rnd.choice(["the", "river", "runs", "of", "Stone", "and", "green", "hills", "it", "was"]) + f"{rnd.choice('abcdefgh')}x" for _ in range(120)) + "." for _ in range(30)]
    texts = [None, "", "a b\na b\n\n\nc", "x y z v w " * 3, "A B a b A B a b A B a b c", "$$ ## " * 2000, *clean]
    out = table(quality_report(documents(spark, texts)))
    for i, t in enumerate(texts):
        assert tuple(out[i])[1:7] == quality_by_hand(t)
    assert all(out[i].kept for i in range(6, len(texts)))
    odd = " ".join(f"##{i}$$" for i in range(400))
    assert not table(quality_report(documents(spark, [*clean, odd])))[30].kept
    assert quality_report(documents(spark, texts).limit(0)).count() == 0


def prose(rnd, n, common="the of and to in a is that for it".split(), odd=0.75):
    return " ".join(f"{rnd.choice('bcdfgh')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.choice('aeiou')}n" if rnd.random() < odd else rnd.choice(common) for _ in range(n))


def test_quality_judges_common_words(spark):
    rnd = random.Random(6)
    texts = [prose(rnd, rnd.choice([45, 120, 900])) for _ in range(40)]
    texts += [prose(rnd, 300, odd=1), prose(rnd, 60, odd=1), prose(rnd, 400, odd=0.97), prose(rnd, 400, common=["had"])]
    out = table(quality_report(documents(spark, texts)))
    assert not any(out[i].base_failed for i in out) and all(out[i].char_distance < 0.2 for i in out)
    assert sorted(i for i in out if not out[i].kept) == [40, 41, 42, 43]
    assert out[40].word_distance is None and out[40].share_distance > 0.3 and out[43].word_distance > 0.7


def judged_by_hand(docs):
    """{id: (kept, char, mix, share)} of (id, text, lang) rows, text by text."""
    from rollcall.llm import quality as q

    kinds = {c: k for k, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\n\r\x0b\x0c"), ("period", ".,;:"), ("mark", "!?'\"()-"), ("symbol", "#*$%&|<>")) for c in chars}

    def js(a, b):
        m = {k: (a.get(k, 0) + b.get(k, 0)) / 2 for k in {*a, *b}}
        return math.sqrt(max(0, sum(x[k] * math.log2(x[k] / m[k]) for x in (a, b) for k in x if x[k] > 0) / 2))

    def part(keys):
        return {k: keys.count(k) / max(1, len(keys)) for k in set(keys)}

    mean = lambda hists: {k: sum(h.get(k, 0) for h in hists) / len(hists) for k in set().union(*hists)}
    chars, words, base = {}, {}, {}
    for i, t, _ in docs:
        t = t or ""
        chars[i] = part([kinds.get(c) or ("other_ascii" if c < "\x80" else "letter" if c.isalpha() else "rest") for c in t])
        low = [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t))]
        words[i] = [w if w in q.COMMON_WORDS else None for w in low]
        base[i] = quality_by_hand(t)[5]
    guarded = {i for i, t, _ in docs if len(words[i]) >= q.LEAST_WORDS and len(t or "") >= q.LEAST_CHARS}
    langs = {}
    for i, _, lang in docs:
        if i in guarded and not base[i] and (lang or "") not in q.NO_LANGUAGE:
            langs.setdefault(lang, []).append(i)
    refs = {k: (mean([chars[i] for i in v]), mean([part(words[i]) for i in v])) for k, v in langs.items() if len(v) >= q.LEAST_DOCS}
    alone = lambda h: {k: v / (1 - h.get(None, 0)) for k, v in h.items() if k}
    out = {}
    for i, _, lang in docs:
        if i in guarded and refs:
            near = sorted((js(chars[i], c), k) for k, (c, _) in refs.items())
            common = [w for w in words[i] if w]
            mix = min(js(part(common), alone(w)) for _, w in refs.values()) if len(common) >= q.LEAST_COMMON else None
            two = lambda h: {"c": 1 - h.get(None, 0), "o": h.get(None, 0)}
            out[i] = (near[0][0], mix, js(two(part(words[i])), two(refs[lang if lang in refs else near[0][1]][1])))
        else:
            out[i] = (None, None, None)
    most = []
    for k, (least, top) in enumerate(q.BOUNDS.values()):
        steps = sorted(int(out[i][k] * q.STEPS) for i, _, lang in docs if out[i][k] is not None and not base[i] and lang in refs)
        at = lambda p: (steps[math.ceil(p * len(steps)) - 1] + 1) / q.STEPS
        most.append(min(top, max(least, at(0.5) + q.SPREAD * (at(0.75) - at(0.5)))) if steps else least)
    return {i: (not base[i] and not any(d is not None and d > m for d, m in zip(out[i], most)), *out[i]) for i, _, _ in docs}


def test_quality_against_brute_force(spark):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, rnd.choice([20, 45, 120, 400]), odd=rnd.choice([0.6, 0.75])), "en") for i in range(60)]
    rows += [(100 + i, " ".join(rnd.choice(["der", "und", "die", "Haus", "Fluß", "schön", "für", f"w{rnd.randrange(99)}"]) for _ in range(rnd.randint(60, 200))) + ".", "de") for i in range(30)]
    rows += [(200 + i, " ".join(f"{rnd.choice('#$%')}{rnd.randrange(999)}" for _ in range(80)), rnd.choice(["en", None, "xx"])) for i in range(8)]
    rows += [(300, prose(rnd, 300, odd=1), "en"), (301, prose(rnd, 300, common=["had"]), None), (302, None, "en"), (303, "", None), (304, "€ ∞ " * 150 + prose(rnd, 60), "de")]
    want = judged_by_hand(rows)
    out = table(quality_report(spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, chars int, known boolean")))
    for i, (kept, *far) in want.items():
        got = (out[i].char_distance, out[i].word_distance, out[i].share_distance)
        assert [g is None for g in got] == [f is None for f in far] and all(abs(g - f) < 2e-5 for g, f in zip(got, far) if f is not None), i
        assert out[i].kept == kept, i
    assert sum(not k for k, *_ in want.values()) >= 12


@pytest.mark.parametrize(("lang", "n"), [(None, 60), ("und", 60), ("", 60), ("xx", 1), ("xx", 19)])
def test_quality_takes_no_reference_from_junk(spark, lang, n):
    rnd = random.Random(7)
    clean = documents(spark, [prose(rnd, 200) for _ in range(40)])
    junk = documents(spark, [(100 + i, " ".join(f"##{rnd.randrange(10**6)}$$" for _ in range(100))) for i in range(n)], lang)
    # the same junk in a good language, and good texts without a reference of their own
    more = documents(spark, [(300, " ".join(f"##{i}$$" for i in range(400)))]).union(documents(spark, [(301, prose(rnd, 200))], "few")).union(documents(spark, [(302, prose(rnd, 200))], "rare"))
    out = table(quality_report(clean.union(junk).union(more)))
    assert not any(r.base_failed for r in out.values()) and len(out) == 43 + n
    assert sorted(i for i in out if out[i].kept) == [*range(40), 301, 302]


def test_quality_references_pass_the_base_rules(spark):
    rnd = random.Random(8)
    junk = [f"##{i}$$ $$%% ## && || " * 100 for i in range(60)]
    out = table(quality_report(documents(spark, [*[prose(rnd, 200) for _ in range(30)], *junk, " ".join(f"##{i}$$" for i in range(400))])))
    assert all(out[i].base_failed for i in range(30, 90)) and sorted(i for i in out if out[i].kept) == [*range(30)]


# 10


def test_toxicity(spark):
    rnd = random.Random(6)
    texts = [" ".join(["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40)] + (["wretched fool"] if i % 4 == 0 else [])) for i in range(400)] + [None, "", "y" * 100_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 1), (7777, 1), (1, None)], "doc_id long, toxic int")
    out = table(toxicity_report(docs, labels))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert sum(out[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert {r.score for r in toxicity_report(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity_report(docs.limit(0), labels).count() == 0


def test_toxicity_features_are_log_count_ratios(spark):
    """A feature's weight is its coefficient times the smoothed log ratio of the documents that have it, counted by hand."""
    from rollcall.llm import toxicity

    texts = ["abcd" if i % 2 else "wxyz" for i in range(40)] + ["abcd wxyz"] * 4
    y = [i % 2 for i in range(40)] + [1, 0, 1, 0]
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, features=1 << 20, steps=400)
    rows, cols = toxicity.present(texts)
    has = {}
    for r, c in zip(rows.tolist(), cols.tolist()):
        has.setdefault(c, []).append(y[r])
    ratio = {c: math.log((sum(v) + 1) / (22 + 2)) - math.log((len(v) - sum(v) + 1) / (22 + 2)) for c, v in has.items() if len(v) >= 3}
    assert {int(c) for c in np.flatnonzero(model.weights)} <= set(ratio)
    # the fit minimises the weighted logistic loss: no small step of the coefficients lowers it
    keep = sorted(c for c in ratio if ratio[c])
    x = np.array([[ratio[c] if c in set(cols[rows == i].tolist()) else 0.0 for c in keep] for i in range(44)])
    coef = np.array([model.weights[c] / ratio[c] for c in keep])
    loss = lambda w, b: np.mean(np.logaddexp(0, -(2 * np.array(y) - 1) * (x @ w + b))) + 0.5 / 44 * (w**2).sum()
    here = loss(coef, model.bias)
    for step in (0.05, -0.05):
        assert loss(coef, model.bias + step) > here - 1e-4
        assert all(loss(coef + step * np.eye(len(keep))[j], model.bias) > here - 1e-4 for j in range(len(keep)))
