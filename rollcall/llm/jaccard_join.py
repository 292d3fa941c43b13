"""Operator 6: exact Jaccard join of documents on word shingles, by signature trees.

1. Every whole text becomes the set of its distinct shingles; documents with equal sets form one class (its 64-bit digest).
2. Candidate graph, lossless. A set of n tokens that is linked at all misses at most d = n (1 - t) of its tokens in its partner. So of any
   fixed order of the tokens, the d + 1 first of one set and those of its partner have one in common. The order is: tokens of one class
   alone, then rarer before more frequent ones. Tokens that only one class has lead nowhere: a class with more than d of them has no
   partner, any other one gives its next tokens as keys, each with its size band. A fixed share of the tokens (those of small hash) is
   enough for that; the few classes with d of those or fewer meet on all their tokens as well. Equal keys give star edges, never all pairs.
3. Connected components of that graph bound where links can be. Each is cut into bins of bounded token counts, on which signature
   trees (OR-combined token bitmaps and size ranges) are traversed in pairs; only pairs that survive the overlap bound are checked
   exactly, and pairs already connected are skipped. Parts of one large component meet only where their size ranges allow a link; their
   bitmaps prune once they have met.
4. Components of the links give the smallest reachable doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, contract, dropped, give_back, lean, packed, shared_dir, skew_join, staged, text_batches, unpacked
from .signature_tree import Linked, SignatureTree, size_bands, traverse
from .words import mix, shingle_sets, text_chunks

_U = np.uint64
#: The sample and the least count that say which tokens are frequent, and how many of them are kept: they change the cost, never the result.
SAMPLE_DOCS, LEAST_SEEN, FREQUENT_TOKENS = 4000, 8, 50_000
#: The share of all tokens that keys are made from, as a multiple of 1 - t (and half of them at most).
SHARE = 2.25
BIN_TOKENS = 4_000_000
#: Classes of one token that are counted; a token of more counts as one of ``MANY``.
COUNTED, MANY = 4096, 1 << 20
_HEAD_SENT, _HEAD_SIZE, _HEAD_FREQUENT = -3, -2, -1


def _digest(tokens: np.ndarray) -> int:
    a = int(mix(tokens).sum(dtype=np.uint64)) ^ (len(tokens) * 0x9E3779B97F4A7C15)
    return int(mix(np.array([a & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b, texts in text_chunks(batch.column(2)):
                for i, (_, s) in zip(range(a, b), shingle_sets(texts, width)):
                    n[i], cls[i] = len(s), _digest(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(cls)], ["doc_id", "h", "n_shingles", "cls"])

    return run


def _sampled(width: int):
    def run(batches):
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0)):
                for _, s in shingle_sets(texts, width):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["token"])

    return run


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of LEAST_SEEN documents or more of a sample, sorted, and the rank of each by its count there."""
    few = docs.select(F.xxhash64("doc_id", F.lit(7)).alias("s"), "doc_id").distinct().orderBy("s", "doc_id").limit(SAMPLE_DOCS).select("doc_id")
    texts = docs.join(F.broadcast(few), "doc_id", "left_semi").select("text")
    rows = texts.mapInArrow(_sampled(width), "token long").groupBy("token").count().filter(F.col("count") >= LEAST_SEEN).orderBy(F.desc("count"), "token").limit(FREQUENT_TOKENS).collect()
    token = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], len(token) - 1 - order


def most_missing(n: int, num: int, den: int) -> int:
    """The most tokens of a set of n that a linked set can lack."""
    return n * (den - num) // den


def token_space(tokens: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The tokens that a class sends, by space: the fixed share of them, and all of them where those are too few. The top bit tells the spaces apart."""
    cut = int(min(0.5, SHARE * (den - num) / den) * 2.0**64)
    some = tokens[: np.searchsorted(tokens, _U(cut))]
    return [some] if len(some) > most_missing(len(tokens), num, den) else [some, mix(tokens) | _U(1 << 63)]


def _tokens(width: int, num: int, den: int, shared):
    """Texts to rows (cls, kind, value): the tokens that are sent (kind 0), and what the class's head needs."""

    def run(batches):
        frequent, rank = shared.value
        seen = set()

        def rows(c, s):
            for space, sent in enumerate(token_space(s, num, den)):
                own = sent if space == 0 else s
                at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
                often = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
                yield np.zeros(int((~often).sum()), np.int32), sent[~often].view(np.int64)
                yield np.array([_HEAD_SENT - 3 * space, _HEAD_SIZE - 3 * space], np.int32), np.array([int((~often).sum()), len(s)])
                yield np.full(int(often.sum()), _HEAD_FREQUENT - 3 * space, np.int32), rank[at[often]]

        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0)):
                out = []
                for _, s in shingle_sets(texts, width):
                    if len(s) and (c := _digest(s)) not in seen:
                        seen.add(c)
                        out += [(np.full(len(k), c, np.int64), k, v) for k, v in rows(c, s)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["cls", "kind", "value"])

    return run


def _record(parts) -> pa.RecordBatch:
    c, k, v = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(k.astype(np.int32)), pa.array(v.astype(np.int64))], ["cls", "kind", "value"])


def _shared_tokens(batches):
    """Rows sorted by kind, value and class: heads go through; a token gets its number of classes as kind, or goes if it has one class alone."""
    token, held, many = None, [], False

    def closed():
        return [(np.array(held), np.full(len(held), len(held)), np.full(len(held), token))] if not many and len(held) > 1 else []

    for batch in batches:
        c, k, t = (batch.column(i).to_numpy() for i in range(3))
        heads = int(np.searchsorted(k, 0))
        out = [(c[:heads], k[:heads], t[:heads])] if heads else []
        c, t = c[heads:], t[heads:]
        if len(t):
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
            c, t = c[new], t[new]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            size = np.diff(np.append(first, len(t)))
            # the first and the last token may go on in other batches; those between are whole
            for i in sorted({0, len(first) - 1}):
                own = c[first[i] : first[i] + size[i]].tolist()
                if t[first[i]] != token:
                    out += closed()
                    token, held, many = t[first[i]], [], False
                elif own[0] == held[-1]:
                    own = own[1:]
                if not own:
                    continue
                if many or len(held) + len(own) > COUNTED:
                    own = own if many else held + own
                    out.append((np.array(own), np.full(len(own), MANY), np.full(len(own), token)))
                    held, many = own[-1:], True
                else:
                    held += own
            inner = np.arange(1, len(first) - 1)
            inner = inner[size[inner] > 1] if len(inner) else inner
            if len(inner):
                n = size[inner]
                at = np.repeat(first[inner] - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append((c[at], np.repeat(np.where(n > COUNTED, MANY, n), n), t[at]))
        if out:
            yield _record(out)
    if out := closed():
        yield _record(out)


def class_keys(kind: np.ndarray, value: np.ndarray, ends: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The keys of one class from its head and its shared tokens, sorted by kind and value: linked classes have one in common."""
    out = []
    for space in (0, 1):
        head = kind == _HEAD_SIZE - 3 * space
        if not head.any():
            continue
        n, sent = int(value[head][0]), int(value[kind == _HEAD_SENT - 3 * space][0])
        tokens = value[(kind > 0) & ((value < 0) == (space == 1))]
        more = most_missing(n, num, den) + 1 - (sent - len(tokens))
        if more <= 0:
            continue
        often = np.unique(value[kind == _HEAD_FREQUENT - 3 * space]).view(np.uint64)
        first = np.concatenate([tokens.view(np.uint64), mix(often + _U(1 << 40))])[:more]
        low, high = np.searchsorted(ends, [-(-num * n // den), n])
        out += [mix(first + mix(np.array([band * 2 + space + 1], np.uint64))) for band in range(low, high + 1)]
    return out


def _combined(keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """(key, a, b): each key once with its first owner as a and b; an edge (a, b) from that one to each other owner."""
    order = np.lexsort((owners, keys))
    k, c = keys[order], owners[order]
    first = np.concatenate(([True], k[1:] != k[:-1]))
    lead = c[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    other = lead != c
    a, b = np.unique(np.stack([lead[other], c[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    key = np.concatenate([k[first].view(np.int64), np.zeros(len(a), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([c[first], a])), pa.array(np.concatenate([c[first], b]))], ["key", "a", "b"])


def _prefixes(num: int, den: int, block: int = 400_000):
    """Rows sorted by class, kind and value become keys and edges; equal keys meet within a task first, so a key goes on once a block."""

    def run(batches):
        ends = size_bands(1 << 31)
        left = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        keys, owners, held = [], [], 0

        def take(c, k, v):
            nonlocal held
            cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True])))
            for i, j in zip(cut[:-1], cut[1:]):
                for x in class_keys(k[i:j], v[i:j], ends, num, den):
                    keys.append(x)
                    owners.append(np.full(len(x), c[i]))
                    held += len(x)

        for batch in batches:
            left = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(left)]
            end = int(np.searchsorted(left[0], left[0][-1])) if len(left[0]) else 0
            if end:
                take(*(x[:end] for x in left))
                left = [x[end:] for x in left]
            if held >= block:
                yield _combined(np.concatenate(keys), np.concatenate(owners))
                keys, owners, held = [], [], 0
        if len(left[0]):
            take(*left)
        if held:
            yield _combined(np.concatenate(keys), np.concatenate(owners))

    return run


def _stars(batches):
    """Rows sorted by key, then class: an edge from the first class of a key to each other one."""
    key = lead = None
    for batch in batches:
        k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        first = np.concatenate(([k[0] != key], k[1:] != k[:-1]))
        begin = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
        leads = np.where(begin >= 0, c[begin], lead if lead is not None else 0)
        key, lead = k[-1], leads[-1]
        if (other := leads != c).any():
            ab = np.unique(np.stack([leads[other], c[other]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], ["a", "b"])


def candidates(docs: DataFrame, at: str, width: int, num: int, den: int) -> DataFrame:
    """(cls, comp) of every class that may have a link: linked classes are in one component."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))
    rows = "cls long, kind int, value long"
    sent = docs.select("text").mapInArrow(lean(_tokens(width, num, den, shared)), rows)
    met = sent.repartition(F.when(F.col("kind") < 0, F.col("cls")).otherwise(F.col("value"))).sortWithinPartitions("kind", "value", "cls").mapInArrow(_shared_tokens, rows)
    keys = met.repartition("cls").sortWithinPartitions("cls", "kind", "value").mapInArrow(_prefixes(num, den), "key long, a long, b long")
    keys = staged(keys, at, "keys")
    stars = keys.filter("a = b").select("key", "a").repartition("key").sortWithinPartitions("key", "a").mapInArrow(lambda rows: contract(_stars(rows)), "a long, b long")
    local = keys.filter("a <> b").select("a", "b").mapInArrow(contract, "a long, b long")
    out = components(stars.union(local), at, "cand").withColumnsRenamed({"node": "cls"})
    dropped(docs.sparkSession, at, "keys")
    return out


def _sets(width: int):
    """Rows (text, cls, ...) become (..., cls, tokens), each class and place once a task; a row whose text is not of the class goes."""

    def run(batches):
        seen = set()
        for batch in batches:
            cls = batch.column(1).to_numpy()
            place = list(zip(*(c.to_pylist() for c in batch.columns[1:])))
            for a, b, texts in text_chunks(batch.column(0)):
                sets = [s for _, s in shingle_sets(texts, width)]
                own = []
                for i, s in enumerate(sets):
                    if place[a + i] not in seen and _digest(s) == cls[a + i]:
                        seen.add(place[a + i])
                        own.append(i)
                part = batch.slice(a, b - a).take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([sets[i].tobytes() for i in own], pa.binary())], [*batch.schema.names[1:], "tokens"])

    return run


def _links(num: int, den: int):
    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        """One bin of whole components, or two parts of one large component."""
        out = []
        for _, g in pdf.drop_duplicates(["comp", "part", "cls"]).groupby("comp", sort=False):
            ids = g["cls"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in g["tokens"]]
            left = np.flatnonzero((g["part"] == g["low"]).to_numpy())
            right = np.flatnonzero((g["part"] != g["low"]).to_numpy())
            if not len(left):
                continue
            linked = Linked(len(ids))
            largest = max(map(len, sets))
            a = SignatureTree([sets[i] for i in left], largest)
            if not len(right) or g["own"].iloc[0]:
                out += [(ids[left[i]], ids[left[j]]) for i, j in traverse(a, a, True, num, den, linked, 0)]
            if len(right):
                b = SignatureTree([sets[i] for i in right], largest)
                out += [(ids[left[i]], ids[right[j]]) for i, j in traverse(a, b, False, num, den, linked, len(left))]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return compared(pdf)
        finally:
            give_back()

    return run


_SPOT = "comp long, part long, bin long, low long, high long, own long"


def _bins(members: DataFrame, at: str, num: int, den: int, bin_tokens: int) -> DataFrame:
    """(doc_id, h, cls, comp, part, bin, low, high, own): where each class is compared. Small components share a bin; parts of a large one meet in pairs."""
    spark = members.sparkSession
    size = members.groupBy("comp").agg(F.sum("n").alias("held"))
    total = size.agg(F.sum("held")).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // bin_tokens) + 1)
    parts = skew_join(members, size, "comp")
    zero = F.lit(0).cast("long")
    single = parts.filter(F.col("held") <= bin_tokens).select("doc_id", "h", "cls", "comp", zero.alias("part"), F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin"), zero.alias("low"), zero.alias("high"), zero.alias("own"))
    large = staged(parts.filter(F.col("held") > bin_tokens).withColumn("band", F.floor(F.log(den / num, F.col("n").cast("double"))).cast("long")), at, "large")
    if large.isEmpty():
        return single
    ways = large.groupBy("comp", "band").agg(F.ceil(F.sum("n") / (bin_tokens // 2)).alias("ways"))
    cut = staged(large.join(F.broadcast(ways) if bounded(ways) else ways, ["comp", "band"]).withColumn("part", F.col("band") * 2**40 + F.pmod(F.xxhash64("cls"), "ways")), at, "cut")
    nodes = cut.groupBy("comp", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = nodes.alias("x"), nodes.alias("y")
    meets = x.join(y, (F.col("x.comp") == F.col("y.comp")) & (F.col("x.part") <= F.col("y.part")) & (den * F.col("x.hi") >= num * F.col("y.lo")) & (den * F.col("y.hi") >= num * F.col("x.lo")))
    meets = staged(meets.select(F.col("x.comp").alias("comp"), F.col("x.part").alias("low"), F.col("y.part").alias("high")), at, "meets")
    # a part is traversed against itself where it meets its first other part; alone only if it meets none
    other = meets.filter("low < high").groupBy("comp", "low").agg(F.min("high").alias("next"))
    meets = meets.join(other, ["comp", "low"], "left").filter("low < high OR next IS NULL").withColumn("own", (F.col("next").isNull() | (F.col("high") == F.col("next"))).cast("long"))
    by_part = meets.select("comp", "low", "high", "own", F.explode(F.array_distinct(F.array("low", "high"))).alias("part"))
    double = cut.join(by_part, ["comp", "part"]).select("doc_id", "h", "cls", "comp", "part", F.lit(-1).cast("long").alias("bin"), "low", "high", "own")
    return single.union(double)


def linked_classes(docs: DataFrame, width: int, num: int, den: int, bin_tokens: int, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows, links): (doc_id, h, n_shingles, cls) of every row of ``docs``, h being the hash of its text, and (cls, comp) of the classes that have a link to another."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    each = staged(docs.mapInArrow(lean(_classes(width)), "doc_id long, h long, n_shingles long, cls long"), at, "classes")
    cand = candidates(docs, at, width, num, den)
    least = each.filter("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("n_shingles").alias("n"))
    members = staged(skew_join(cand, least, "cls").select("cls", "comp", "n", "first.doc_id", "first.h"), at, "members")
    # the token sets of candidates alone, straight to their bins
    where = staged(_bins(members, at, num, den, bin_tokens), at, "where")
    side = (F.broadcast(where) if bounded(where, 120) else where).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    texts = docs.join(side, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "cls", "comp", "part", "bin", "low", "high", "own")
    sets = texts.mapInArrow(lean(_sets(width)), f"cls long, {_SPOT}, tokens binary")
    key = [F.col("bin"), F.when(F.col("bin") < 0, F.col("comp")).otherwise(0), F.col("low"), F.col("high")]
    links = sets.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).applyInPandas(_links(num, den), "a long, b long")
    comp = components(links, at, "links").withColumnsRenamed({"node": "cls"})
    dropped(docs.sparkSession, at, "members", "where", "large", "cut", "meets")
    return each, comp


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id bigint, text string; more columns are ignored).

    Documents link when the Jaccard similarity of their sets of ``width``-word shingles is at least num/den; component_id is the
    smallest doc_id reachable. Null or wordless texts have an empty set and link with nothing: component_id is their doc_id.
    Repeated doc_ids link like any other rows; a null doc_id keeps its row (component_id is the smallest non-null id, if any).
    Links are never lost; sets are compared by 64-bit token hashes.
    """
    each, comp = linked_classes(docs, width, num, den, bin_tokens, shared_dir(docs.sparkSession))
    least = each.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    linked = comp.join(least, "cls", "inner")
    first = linked.groupBy("comp").agg(F.min("first").alias("component"))
    of_class = least.join(skew_join(linked.select("cls", "comp"), first, "comp"), "cls", "left").select("cls", F.coalesce("component", "first").alias("component_id"))
    out = skew_join(each.filter("n_shingles > 0"), of_class, "cls", "left").select("doc_id", "n_shingles", "component_id")
    return out.union(each.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """``docs`` with one row of each component; all columns stay.

    That of the smallest doc_id stays (a null one comes last; then the text of smallest hash). Rows are told apart by doc_id and text, so
    rows without a doc_id, and different texts under one doc_id, are judged by their texts like any others; of rows that repeat both one
    stays. Texts without words are no copies of each other: their rows all stay.
    """
    at = shared_dir(docs.sparkSession)
    each, comp = linked_classes(docs, width, num, den, bin_tokens, at)
    rows = skew_join(each.filter("n_shingles > 0"), comp, "cls", "left").select("doc_id", "h", F.coalesce("comp", "cls").alias("comp"))
    alike = rows.groupBy("comp", "doc_id", "h").agg(F.count("*").alias("n"))
    first = alike.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    more = skew_join(alike, first, "comp").select("doc_id", "h", "n", stays.alias("stays")).filter("n > 1 OR NOT stays")
    more = staged(more.select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), F.col("stays").alias("again")), at, "copies")
    flat = packed(docs, doc_id=F.col("doc_id").cast("long"), h=F.xxhash64(F.col("text").cast("string")))
    same = (F.col("h") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))
    out = unpacked(flat.join(F.broadcast(more) if bounded(more, 80) else more, same, "left_anti"), docs.columns)
    again = more.filter("again")
    if again.isEmpty():
        return out
    # rows that repeat one that stays
    own = flat.join(F.broadcast(again) if bounded(again, 80) else again, same, "left_semi")
    return out.union(unpacked(own.dropDuplicates(["doc_id", "h"]), docs.columns))
