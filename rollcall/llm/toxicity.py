"""Operator 10: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

From a bounded sample of labelled documents: hashed n-grams present in each, their smoothed log-count ratios between the classes,
and a logistic regression on presence times ratio. The n-grams that tell the classes apart best are kept as features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, few_per, shared_dir, skew_join, staged, text_batches
from .grams import gram_buckets
from .language import batches_of, held_out

WIDTHS, BITS = range(3, 7), 20
#: Bound of the labelled sample per class, and the size of the model: features kept (more of them fit the sample's noise, see README).
SAMPLE_PER_CLASS, FEATURES = 4000, 3000


@dataclass
class RatioModel:
    weights: np.ndarray  # by bucket: coefficient times log-count ratio
    bias: float


def present(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket), each pair once."""
    rows, cols = gram_buckets(texts, WIDTHS, BITS)
    pair = np.unique((rows << BITS) | cols)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _counts(batches):
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        texts, y = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy()
        for a, b in batches_of(texts):
            rows, cols = present(texts[a:b])
            hit = y[a:b][rows] == 1
            pos += np.bincount(cols[hit], minlength=1 << BITS)
            neg += np.bincount(cols[~hit], minlength=1 << BITS)
    some = np.flatnonzero(pos + neg >= 1)
    for i in range(0, len(some), 100_000):
        at = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pos[at]), pa.array(neg[at])], ["bucket", "pos", "neg"])


def _kept(shared):
    def run(batches):
        place = shared.value
        for batch in batches:
            texts, y = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                rows, cols = present(texts[a:b])
                at = place[cols]
                rows, at = rows[at >= 0], at[at >= 0]
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                feats = [at[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b], pa.int32()), pa.array(feats, pa.binary())], ["y", "feats"])

    return run


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, features: int = FEATURES, alpha: float = 1.0, l2: float = 1.0, steps: int = 300) -> RatioModel:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): of each class the ``per_class`` labelled rows of least hash of (doc_id, text), equal rows once."""
    none = RatioModel(np.zeros(1 << BITS, np.float32), 0.0)
    lab = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # numbers alone meet the labels; the texts of the few that are drawn come afterwards
    rows, keyed = docs.select(F.xxhash64("doc_id").alias("k"), "doc_id", F.xxhash64(F.lit(11), "doc_id", "text").alias("h")), lab.select(F.xxhash64("doc_id").alias("k"), F.col("doc_id").alias("id"), "y")
    met = (rows.join(F.broadcast(keyed), "k") if bounded(keyed) else skew_join(rows, keyed, "k")).filter("doc_id = id")
    few = few_per(met.select("y", "h", "doc_id"), "y", per_class).select("y", "h", F.col("doc_id").alias("id"))
    hashed = docs.withColumn("h", F.xxhash64(F.lit(11), "doc_id", "text"))
    texts = hashed.join(F.broadcast(few), "h").filter("doc_id = id").select("doc_id", "text", "y").distinct().select("text", "y")
    texts = staged(texts, shared_dir(docs.sparkSession), "sample")  # read more than once
    seen = {r[0]: r[1] for r in texts.groupBy("y").count().collect()}
    total = {r[0]: r[1] for r in lab.groupBy("y").count().collect()}
    if len(seen) < 2:
        return none
    counts = texts.mapInArrow(_counts, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + alpha) / (seen[1] + 2 * alpha), (F.col("neg") + alpha) / (seen[0] + 2 * alpha)
    # how much a feature tells: the gain in log likelihood of the two counts against one common rate
    both = (F.col("pos") + F.col("neg") + 2 * alpha) / (seen[1] + seen[0] + 4 * alpha)
    gain = F.col("pos") * F.log(p / both) + F.col("neg") * F.log(q / both)
    top = counts.filter("pos + neg >= 3").select("bucket", F.log(p / q).alias("ratio"), gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(features).collect()
    if not top:
        return none
    bucket, ratio = np.array([r[0] for r in top]), np.array([r[1] for r in top])
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    rows = texts.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(place)), "y int, feats binary").orderBy("y", "feats").collect()
    y = np.array([r[0] for r in rows], np.float64)
    feats = [np.frombuffer(bytes(r[1]), "<i4") for r in rows]
    col = np.concatenate(feats)
    row = np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    x = ratio[col]
    # the sample is drawn by class; weights give the classes the shares they have among all labelled documents
    share = {k: total[k] / seen[k] for k in seen}
    weight = np.array([share[int(v)] for v in y])
    weight /= weight.sum()
    coef, bias = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros_like(coef), np.zeros_like(coef), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the full sample
        z = np.bincount(row, x * coef[col], len(rows)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(col, x * err[row], len(ratio)) + l2 * coef / len(rows)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / np.sqrt(1 + step / 50)
        coef -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[bucket] = coef * ratio
    return RatioModel(weights, float(bias))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            texts, out = [t or "" for t in batch.column(1).to_pylist()], []
            for a, b in batches_of(texts):
                rows, cols = gram_buckets(texts[a:b], WIDTHS, BITS)
                hit = np.flatnonzero(weights[cols])
                pair = np.unique((rows[hit] << BITS) | cols[hit])
                z = np.bincount(pair >> BITS, weights[pair & ((1 << BITS) - 1)], b - a) + bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            value = np.round(np.concatenate(out) if out else np.zeros(0), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: RatioModel) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts get the score of no n-gram at all."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labels of the rows that are not held out, predicted for all.

    Without labels of both classes every score is 0.5. Labels of unknown documents, null or other values are left out; of repeated labels the largest counts.
    Rows are told apart by (doc_id, text): every text of a labelled id has its label, a repeated row counts once in learning, and each row gets a
    row of the result. Texts may have any length; an empty table gives no rows; other columns are ignored. Features of equal gain are taken by number.
    """
    text_batches(docs.sparkSession)
    model = learn(docs, labels.filter(~held_out(5, 0)))
    return score(docs, model).select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
