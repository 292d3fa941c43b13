"""Operator 5: language identification with string kernels.

Kernel: blended-spectrum presence kernel over character 1- to 3-grams, k(x, y) = |X and Y| / sqrt(|X| |Y|) for the sets X, Y of hashed
n-grams. Nyström landmarks (documents of every language) give explicit features, on which one-versus-rest kernel ridge regression is
solved. Texts are scored in batches: presence matrix times landmarks, then times the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_per, lean, packed, text_batches, unpacked
from .grams import presence

WIDTHS, BITS = range(1, 4), 14
#: Bounds of the fit: labelled documents and landmarks per language, and of all languages together; beyond that the languages get fewer
#: each, LEAST_SAMPLE documents and one landmark at least, the most frequent languages first.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, SAMPLE, LANDMARKS, LEAST_SAMPLE = 400, 32, 6400, 640, 10
#: A document stays from this score on. The regression has no constant, so a text that shares nothing with what was learned has a value of 0 in
#: every language, which is a score of 0.5; this asks for a value of 0.1.
LEAST_SCORE = 0.55


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits, a row each
    coefficients: np.ndarray  # landmarks x languages

    def scorer(self):
        rows = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        norm = np.sqrt(np.maximum(rows.sum(1), 1))
        right, coefficients = (rows / norm[:, None]).T.copy(), self.coefficients.astype(np.float32)

        def score(bits: np.ndarray) -> np.ndarray:
            x = bits.astype(np.float32)
            return (x @ right) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) @ coefficients

        return score


def batches_of(texts: list[str], most: int = 96, chars: int = 250_000) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= most or held + len(t) > chars):
            yield start, i
            start, held = i, 0
        held += len(t)
    if texts:
        yield start, len(texts)


def _bits(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for a, b in batches_of(texts):
            packed = [row.tobytes() for row in np.packbits(presence(texts[a:b], WIDTHS, BITS), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(packed, pa.binary())], ["lang", "h", "bits"])


def shares(languages: int, per_language: int, per_landmark: int) -> tuple[int, int]:
    """Documents and landmarks that each of so many languages gets within the bounds of the fit."""
    return min(per_language, max(LEAST_SAMPLE, SAMPLE // max(languages, 1))), min(per_landmark, max(1, LANDMARKS // max(languages, 1)))


def kernel(packed: np.ndarray, landmarks: np.ndarray, rows: int = 128) -> np.ndarray:
    """k(x, y) of every row of packed presence bits with every landmark, a block of rows at a time."""
    right = np.unpackbits(landmarks, axis=1).astype(np.float32)
    right = (right / np.sqrt(np.maximum(right.sum(1, keepdims=True), 1))).T
    out = np.zeros((len(packed), len(landmarks)))
    for i in range(0, len(packed), rows):
        x = np.unpackbits(packed[i : i + rows], axis=1).astype(np.float32)
        out[i : i + rows] = (x @ right) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return out


def fit(packed: np.ndarray, lang: np.ndarray, per_landmark: int, ridge: float) -> KernelModel:
    """One-versus-rest kernel ridge regression on Nyström features; rows are weighted so that each language weighs the same."""
    languages = sorted(set(lang))
    which = np.concatenate([np.flatnonzero(lang == name)[:per_landmark] for name in languages])
    k = kernel(packed, packed[which])
    val, vec = np.linalg.eigh(k[which] + 1e-6 * np.eye(len(which)))
    white = vec / np.sqrt(np.maximum(val, 1e-6))  # Nyström: kernel rows times this are the features
    z = k @ white
    y = np.where(lang[:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    weight = len(lang) / len(languages) / (y > 0).sum(0)[np.searchsorted(np.array(languages), lang.astype(str))]
    solved = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * np.eye(z.shape[1]), z.T @ (y * weight[:, None]))
    return KernelModel(languages, packed[which], white @ solved)


def learn(train: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, per_landmark: int = LANDMARKS_PER_LANGUAGE, ridge: float = 0.1) -> KernelModel:
    """The model from labelled rows (doc_id, text, lang): of each language the ``per_language`` rows of least hash of
    (doc_id, text), equal rows once, within the bounds of the fit. Their presence bits, 2 KB each, are all that comes to the driver."""
    text_batches(train.sparkSession)
    train = train.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = [r[0] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(SAMPLE // LEAST_SAMPLE, LANDMARKS)).collect()]
    if not known:
        return KernelModel([], np.zeros((1, (1 << BITS) // 8), np.uint8), np.zeros((1, 0)))
    per_language, per_landmark = shares(len(known), per_language, per_landmark)
    train = train.filter(F.col("lang").isin(known))
    few = few_per(train.select("lang", F.xxhash64(F.lit(5), "doc_id", "text").alias("h"), "text"), "lang", per_language)
    rows = few.select("lang", "h", "text").mapInArrow(_bits, "lang string, h long, bits binary").orderBy("lang", "h", "bits").collect()
    return fit(np.stack([np.frombuffer(bytes(r[2]), np.uint8) for r in rows]), np.array([r[0] for r in rows], object), per_landmark, ridge)


def _predict(shared):
    """Rows (row) become (row, lang_pred, score): a struct that has the text goes through as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, score = KernelModel(*shared.value), None
        for batch in batches:
            texts = pc.struct_field(batch.column(0), "text").cast(pa.string()).to_pylist()
            known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
            lang, value = ["und"] * len(texts), [0.0] * len(texts)
            score = score or model.scorer()
            for a, b in batches_of([texts[i] for i in known]):
                s = score(presence([texts[i] for i in known[a:b]], WIDTHS, BITS))
                for i, j, top in zip(known[a:b], s.argmax(1), s.max(1)):
                    lang[i], value[i] = model.languages[j], round(min(1.0, max(0.0, (float(top) + 1) / 2)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(value, pa.float64())], ["row", "lang_pred", "score"])

    return run


def held_out(mod: int = 4, at: int = 2) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == at


def identify(docs: DataFrame, model: KernelModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``und`` with score 0 if the text is null or has no letter, or nothing could be learned."""
    return _predicted(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")


def _predicted(docs: DataFrame, model: KernelModel) -> DataFrame:
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.landmarks, model.coefficients))
    flat = packed(docs)
    return flat.mapInArrow(lean(_predict(shared)), f"row {flat.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows of ``docs`` that are not held out, predicted for all.

    A row with null doc_id is neither held out nor learned from. Rows are told apart by (doc_id, text): a repeated id with other texts counts
    like other ids, a repeated row once in learning, and each row gets a row of the result. Texts may have any length; an empty table gives no
    rows; other columns are ignored, whatever they are called. Of equal scores the first language by name wins.
    """
    model = learn(docs.filter(~held_out()))
    got = identify(docs, model)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the documents whose language can't be told (``und``, or a score under ``least``: junk, and texts in a language that was not
    learned); all columns stay, whatever they are called."""
    kept = _predicted(docs, learn(docs.filter(~held_out()))).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return unpacked(kept, docs.columns)
