"""Operator 9: quality rules by distribution divergence.

Each text's histograms over character classes and over common words are held against language references, the means of the histograms
of the documents of a language that pass the base rules. Three Jensen-Shannon distances decide: of the character classes and of the mix of
common words to the nearest reference, and of the share that common words have to that in the text's language. Texts under the minimum
lengths are not judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shared_dir, staged, text_batches
from .words import text_chunks, word_hashes

# Common function words of four languages, a parameter of the operator.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "le la les de des du et à un une que en est pour dans qui pas sur au avec ce il "
    "der die und das von zu mit den ist im für nicht eine ein auf dem des sich als auch "
    "el los las y que en un una por con para del se no es su lo más al"
).split()
COMMON_WORDS = tuple(sorted(set(COMMON_WORDS)))
CLASSES = ("lower", "upper", "digit", "space", "period", "mark", "symbol", "other_ascii", "letter", "rest")
#: Guards: characters and words that a text needs before its histogram is judged.
LEAST_CHARS, LEAST_WORDS = 200, 40
#: Limits follow from the documents' own distances to their references: the median and SPREAD times what lies between it and the upper
#: quartile, over the judged documents of languages with a reference, within these bounds (character classes, mix of the common words,
#: their share of all words). Distances are counted in steps of 1 / STEPS.
BOUNDS, SPREAD, STEPS = {"char_distance": (0.25, 0.35), "word_distance": (0.65, 0.75), "share_distance": (0.20, 0.26)}, 8, 1000
#: Common words that a text needs before their mix is judged.
LEAST_COMMON = 40
#: Documents (guarded, past the base rules) that a language needs for a reference, and values of ``lang`` that name no language.
LEAST_DOCS = 20
NO_LANGUAGE = ("", "und", "mis", "mul", "zxx")


def _class_table() -> np.ndarray:
    out = np.full(128, CLASSES.index("other_ascii"), np.int8)
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\n\r\x0b\x0c"), ("period", ".,;:"), ("mark", "!?'\"()-"), ("symbol", "#*$%&|<>")):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    return out


_TABLE = _class_table()
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile("[^\\x20\\x09-\\x0D]")


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif _WORD.search(line):
            seen.add(line)
    return n


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    rolled = hashes[:n].copy()
    for j in range(1, width):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    _, back, count = np.unique(rolled, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _features(common: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = word_hashes(list(common))
        order = np.argsort(known)
        sorted_ = known[order]
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for _, _, texts in text_chunks(batch.column(1)):
                part = [t or "" for t in texts]
                exact, _ = word_hashes(part, lower=False)
                low, firsts = word_hashes(part)
                at = np.minimum(np.searchsorted(sorted_, low), len(sorted_) - 1)
                hit = np.where(sorted_[at] == low, order[at], len(common)) if len(low) else np.zeros(0, int)
                for t, i, j in zip(part, firsts[:-1], firsts[1:]):
                    words = t.encode("utf-8", "surrogatepass").split()
                    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    chars = np.bincount(_TABLE[code[code < 128]], minlength=len(CLASSES))
                    kinds, times = np.unique(code[code >= 128], return_counts=True)
                    wide = sum(int(n) for c, n in zip(kinds, times) if chr(c).isalpha())
                    chars[CLASSES.index("letter")] += wide
                    chars[CLASSES.index("rest")] += len(t) - int(chars.sum())
                    blank = int(((code == 32) | ((code >= 9) & (code <= 13))).sum())
                    values = (len(words), len(t) - blank, len(_SYMBOLS.findall(t)), duplicate_lines(t), repeated_words(exact[i:j]), chars.tolist(), np.bincount(hit[i:j], minlength=len(common) + 1).tolist())
                    for c, v in zip(cols, values):
                        c.append(v)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, ints) for c in cols[5:])], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"])

    return run


def shares(hist: np.ndarray) -> np.ndarray:
    """Rows of counts (whole numbers) as rows of shares; an empty row stays 0."""
    return hist / np.maximum(hist.sum(1, keepdims=True), 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (base 2, 0 to 1) of each row of p to the histogram q, or to its row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0.0), np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.sqrt(np.maximum((left + right).sum(1) / 2, 0.0))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, width).astype(np.float64)


def _guarded(chars: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return (n_words >= LEAST_WORDS) & (chars.sum(1) >= LEAST_CHARS)


def _base_failed(n_words, n_repeat_words):
    """The base rules, on columns and on arrays."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _sums(width: int):
    """Partial sums of each language's shares, in units of 2^-30 so that their order does not matter; place -1 counts the documents."""

    def run(batches):
        for batch in batches:
            lang = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
            chars, words = _matrix(batch.column("chars"), len(CLASSES)), _matrix(batch.column("words"), width)
            n_words = batch.column("n_words").to_numpy()
            ok = _guarded(chars, n_words) & ~_base_failed(n_words, batch.column("n_repeat_words").to_numpy()) & ~np.isin(lang.astype(str), NO_LANGUAGE)
            both = np.concatenate([shares(chars), shares(words)], axis=1)
            for name in sorted(set(lang[ok])):
                mine = np.floor(both[ok & (lang == name)] * 2.0**30).astype(np.int64)
                value = np.append(mine.sum(0), len(mine))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value)), pa.array([*range(len(value) - 1), -1], pa.int32()), pa.array(value)], ["lang", "place", "value"])

    return run


def _distances(shared, width: int):
    def run(batches):
        refs = shared.value
        names = {name: i for i, (name, _, _) in enumerate(refs)}
        usual = np.array([1 - r[-1] for _, _, r in refs])
        # without the last place, that of all other words; a reference without common words has no mix
        mixes = [r[:-1] / r[:-1].sum() for _, _, r in refs if r[:-1].any()]
        for batch in batches:
            chars, words = _matrix(batch.column("chars"), len(CLASSES)), _matrix(batch.column("words"), width)
            ok = _guarded(chars, batch.column("n_words").to_numpy()) & bool(refs)
            mixed = ok & (words[:, :-1].sum(1) >= LEAST_COMMON) & bool(mixes)
            near, mix, part = (np.full(len(ok), np.nan) for _ in range(3))
            own = np.array([names.get(x or "", -1) for x in batch.column("lang").to_pylist()], np.int64)
            if ok.any():
                each = np.array([jensen_shannon(shares(chars[ok]), r) for _, r, _ in refs])
                near[ok] = each.min(0)
                # the share in the text's own language, in the nearest reference if it has none
                want = usual[np.where(own[ok] >= 0, own[ok], each.argmin(0))]
                got = 1 - shares(words[ok])[:, -1]
                part[ok] = jensen_shannon(np.stack([got, 1 - got], 1), np.stack([want, 1 - want], 1))
            if mixed.any():
                mix[mixed] = np.min([jensen_shannon(shares(words[mixed][:, :-1]), m) for m in mixes], axis=0)
            out = [pa.array(np.round(x, 6), mask=~m) for x, m in ((near, ok), (mix, mixed), (part, ok))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:7], *out, pa.array(own >= 0)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "share_distance", "known"])

    return run


def features(docs: DataFrame, common: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, words array<int>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(_features(common), shape)


def references(feats: DataFrame, width: int = len(COMMON_WORDS) + 1) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, character-class shares, common-word shares) of each language: the means over all its documents that pass the guards and the base rules.

    Null ``lang``, those of NO_LANGUAGE and languages with fewer than LEAST_DOCS such documents get none; their texts are held against the others'.
    """
    rows = feats.select("lang", "n_words", "n_repeat_words", "chars", "words").mapInArrow(_sums(width), "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value")).collect()
    out = []
    for lang in sorted({r[0] for r in rows}):
        got = {r[1]: r[2] for r in rows if r[0] == lang}
        if got[-1] < LEAST_DOCS:
            continue
        mean = np.array([got[i] for i in range(len(CLASSES) + width)]) / 2.0**30 / got[-1]
        out.append((lang, mean[: len(CLASSES)], mean[len(CLASSES) :]))
    return out


def limits(judged: DataFrame) -> dict[str, float]:
    """The largest distances that are kept, from counts of the distances of all documents that pass the base rules."""
    rows = judged.select(*[F.struct(F.lit(k).alias("measure"), F.floor(F.col(k) * STEPS).cast("int").alias("step")).alias(k) for k in BOUNDS])
    rows = rows.select(F.inline(F.array(*BOUNDS))).filter("step IS NOT NULL").groupBy("measure", "step").count().collect()  # STEPS + 1 rows a measure
    out = {}
    for k, (least, most) in BOUNDS.items():
        steps = sorted((r["step"], r["count"]) for r in rows if r["measure"] == k)
        upto, quantile = 0, {}
        for step, n in steps:
            upto += n
            for q in (0.5, 0.75):
                if upto >= q * sum(c for _, c in steps):
                    quantile.setdefault(q, (step + 1) / STEPS)
        out[k] = min(most, max(least, quantile[0.5] + SPREAD * (quantile[0.75] - quantile[0.5]))) if steps else least
    return out


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, share_distance) for every row.

    char_distance: of the character classes, to the nearest reference. word_distance: of the mix of common words, to the nearest, null for
    texts with fewer than LEAST_COMMON of them. share_distance: of common and other words, to the text's own language. Each above its limit
    (``limits``) is not kept; so are texts that fail the base rules. Null texts have no words and fail the base; repeated rows each keep
    their row; columns other than doc_id, text and lang are ignored. Each distinct ``lang`` value with LEAST_DOCS documents or more has one
    reference row on the driver; without any reference nothing is judged.
    """
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    feats, width = staged(features(docs), at, "features"), len(COMMON_WORDS) + 1
    shared = spark.sparkContext.broadcast(references(feats, width))
    shape = f"doc_id {dict(feats.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, share_distance double, known boolean"
    out = staged(feats.mapInArrow(_distances(shared, width), shape), at, "distances")
    dropped(spark, at, "features")
    failed = _base_failed(F.col("n_words"), F.col("n_repeat_words"))
    strange = F.lit(False)
    for k, most in limits(out.filter(~failed & F.col("known"))).items():
        strange |= F.coalesce(F.col(k) > most, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~strange).alias("kept"), *BOUNDS)
