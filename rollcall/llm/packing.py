"""Operator 7: mixture-controlled packing by deficit round-robin over source queues.

Every window of ``size`` tokens takes from each queue its share of the mixture. The fractions of a token that a queue could not get
in one window are its deficit, carried to the next: after w windows queue s has had G_s(w) - G_{s-1}(w) tokens, with
G_s(w) = floor(w * size * F_s / F) and F_s the shares added up to s. These closed forms are the state of the round-robin at any
window, so each partition lays its own documents without running the ones before; deficits carry over windows and partitions alike.
The shares are the queues' own tokens (all queues then end together and only the last window is short) or given weights, which each
queue has while it lasts; the others then go on by theirs. A source under 1/512 of the bytes would get less than a few tokens a
window: such sources share one queue, in which their documents stand in the order in which weighted round-robin would finish them, so that
each is within one document of its own share at every point.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, lean, shared_dir, staged, text_batches
from .words import text_chunks

#: Sources below this share of the bytes take their turns in one queue; so the driver holds at most 512 queues.
LEAST_SHARE = 512
_CACHE = 400_000
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _MARKS = "0-9A-Za-zÀ-ÖØ-öø-ÿ", r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
# Where a byte-level BPE cuts anyway: before a lone space that a word follows, between letters and marks, and around other white space.
_SEGMENT = re.compile(f" ?[{_LETTERS}]+(?=[{_MARKS}{_WS}]|\\Z)|(?<=[{_LETTERS}])[{_MARKS}]+(?=[{_LETTERS}{_WS}]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian unsigned 16- or 32-bit bytes; each different segment of a text is encoded once while it stays in the bounded cache.

    A byte-level BPE file of the ``tokenizers`` library is read for its vocabulary and its cutting pattern. The merging of a segment is
    left to ``tiktoken`` where the file's merges are the order of its ids (several times faster), else to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, added = path, spec.get("added_tokens", [])
        self.added = {x["content"]: x["id"] for x in added}
        #: Tokens that the file adds are cut out of a text before anything else, the longest first.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.plain = not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word"))
        self.kind = np.dtype("<u2" if len({*spec["model"]["vocab"], *self.added}) <= 65536 else "<u4")
        self.seen: dict[str, bytes] = {}
        self.merge = self._by_rank(spec)  # the file's own contents are not held

    @cached_property
    def tok(self):
        """The tokenizer itself, loaded where it is needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _by_rank(spec: dict):
        import public_tokenizers
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        place = [model["vocab"][a + b] for a, b in pairs]
        if place != sorted(place):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as ``tokenizers`` gives them with ``add_special_tokens=False``."""
        if not self.cut or not (held := {i for i, t in enumerate(texts) if self.cut.search(t)}):
            return self._encode(texts)
        code, out = "HI"[self.kind.itemsize // 4], dict(zip((i for i in range(len(texts)) if i not in held), self._encode([t for i, t in enumerate(texts) if i not in held])))
        for i in held:
            if self.plain:
                between = self._encode(self.cut.split(texts[i]))
                own = [array(code, [self.added[m]]).tobytes() for m in self.cut.findall(texts[i])]
                out[i] = b"".join(x for pair in zip(between, [*own, b""]) for x in pair)
            else:
                out[i] = array(code, self.tok.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return [out[i] for i in range(len(texts))]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [_SEGMENT.findall(t) for t in texts]
        if len(self.seen) > _CACHE:
            self.seen.clear()
        new, code = set().union(*cut).difference(self.seen), "HI"[self.kind.itemsize // 4]
        if self.merge:
            merge, seen = self.merge, self.seen
            for s in new:
                seen[s] = array(code, merge(s)).tobytes()
        else:
            new = list(new)
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                for s, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False)):
                    self.seen[s] = array(code, e.ids).tobytes()
        get = self.seen.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def _tokenise(path: str, end: int, queues: dict[str, int], rest: int):
    """Rows get their queue, their place among the rows of their source in this partition (in tokens), and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, pid, before = Encoder(path), TaskContext.get().partitionId(), {}
        last = np.array([end], enc.kind).tobytes()
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for at, to, texts in text_chunks(batch.column(1), 1_000_000):
                ids = [x + last for x in enc.encode([t or "" for t in texts])]
                q = [queues.get(s, rest) for s in sources[at:to]]
                n, off = [len(x) // enc.kind.itemsize for x in ids], []
                for s, m in zip(sources[at:to], n):
                    off.append(before.get(s, 0))
                    before[s] = off[-1] + m
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([pid] * len(n), pa.int32()), batch.column(2).slice(at, to - at), pa.array(q, pa.int32()), pa.array(off, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "pid", "source", "queue", "off", "n", "ids"])

    return run


@dataclass(frozen=True)
class Phase:
    """Windows ``first`` to ``first + windows``: ``tokens`` in all, from queue s its tokens from ``start[s]`` on, in shares ``upto`` (added up, from 0)."""

    first: int
    windows: int
    tokens: int
    start: tuple[int, ...]
    upto: tuple[int, ...]

    def mark(self, s: int, x: int) -> int:
        """Tokens that the queues before s have had when the phase has laid x."""
        return x * self.upto[s] // self.upto[-1]

    def had(self, s: int, x: int) -> int:
        return self.mark(s + 1, x) - self.mark(s, x)


def phases(totals: list[int], size: int, weights: list[float] | None = None) -> list[Phase]:
    """The plan for queues of so many tokens each.

    With ``weights`` all queues that last get their shares of every window. When one is about to end, it gives what it has left in the next ENDING windows,
    which the others fill by their weights, and these go on. What is left when all end together, and all without weights, is laid in its own proportions.
    """
    out, done, first = [], [0] * len(totals), 0

    def lay(windows: int, tokens: int, parts: list[int]) -> None:
        nonlocal done, first
        p = Phase(first, windows, tokens, tuple(done), (0, *np.cumsum(parts).tolist()))
        done = [d + p.had(s, tokens) for s, d in enumerate(done)]
        first += windows
        out.append(p)

    left = lambda s: totals[s] - done[s]
    share = [max(1, round(w * 1_000_000)) for w in weights or []]
    while weights and len(live := [s for s in range(len(totals)) if left(s)]) > 1:
        every = sum(share[s] for s in live)
        full = min(left(s) * every // (share[s] * size) for s in live) - 1
        if full > 0:
            lay(full, full * size, [share[s] if s in live else 0 for s in range(len(totals))])
        ends = {s for s in live if left(s) * every < ENDING * share[s] * size}
        while others := [s for s in live if s not in ends]:
            room, rest = ENDING * size - sum(map(left, ends)), sum(share[s] for s in others)
            short = {s for s in others if left(s) * rest < room * share[s] + rest}
            if not short:
                break
            ends |= short
        if not others:
            break
        cut = [room * x // rest for x in np.cumsum([0, *(share[s] for s in others)]).tolist()]
        filled = dict(zip(others, (y - x for x, y in zip(cut, cut[1:]))))
        lay(ENDING, ENDING * size, [left(s) if s in ends else filled.get(s, 0) for s in range(len(totals))])
    rest = [left(s) for s in range(len(totals))]
    if sum(rest):
        lay(-(-sum(rest) // size), sum(rest), rest)
    return out


#: Windows in which a queue gives its last tokens.
ENDING = 3


def merge_small(totals: dict[int, int], size: int, weights: dict[int, float] | None = None) -> tuple[dict[int, int], dict[int, int], list[int], list[float]]:
    """(stream, start in it) of each queue, the streams' totals and weights: a queue worth too few whole tokens a window follows the largest in one stream.

    That is under two tokens of the queue's own share without ``weights``, and a weight under eight with them (none at all for queues without
    one), however large or small the queue is: a small one with a weight is a stream of its own while it lasts.
    """
    worth = weights if weights is not None else totals
    order = sorted(totals, key=lambda q: (-worth.get(q, 0), q))
    every, streams, shares, stream, start = sum(worth.get(q, 0) for q in totals), [], [], {}, {}
    for q in order:
        if not streams or worth.get(q, 0) * size >= (2 if weights is None else 8) * every:
            streams.append(0)
            shares.append(0.0)
            stream[q] = len(streams) - 1
        else:
            stream[q] = 0
        start[q] = streams[stream[q]]
        streams[stream[q]] += totals[q]
        shares[stream[q]] += worth.get(q, 0)
    return stream, start, streams, shares


def _lay(plan: list[Phase], size: int, itemsize: int):
    def run(batches):
        for batch in batches:
            docs, streams, offs, ns = (batch.column(k).to_pylist() for k in range(4))
            out = [[] for _ in range(8)]
            for d, s, o, n, raw in zip(docs, streams, offs, ns, batch.column(4)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{itemsize}").astype("<u4").tobytes()
                for start, length, window, place in pieces(plan, size, s, o, n):
                    for col, v in zip(out, (d, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, window, place, s)):
                        col.append(v)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "stream"]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in out[1:])], names)

    return run


def pieces(plan: list[Phase], size: int, s: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, window, offset in it) of the document that has places at .. at + n of stream s."""
    done = 0
    for p in plan:
        own = p.had(s, p.tokens)
        while done < n and p.start[s] <= at + done < p.start[s] + own:
            here = at + done - p.start[s]
            w = min(p.windows - 1, here * p.upto[-1] // ((p.upto[s + 1] - p.upto[s]) * size))
            while p.had(s, w * size) > here:
                w -= 1
            while p.had(s, min((w + 1) * size, p.tokens)) <= here:
                w += 1
            x, y = w * size, min((w + 1) * size, p.tokens)
            length = min(n - done, p.had(s, y) - here)
            yield done, length, p.first + w, p.mark(s, y) - p.mark(s, x) + here - p.had(s, x)
            done += length


def _turns(rows: DataFrame, base: DataFrame, where: str) -> DataFrame:
    """(source, pid, off, stream, at): where the rows (source, pid, off, n) of small sources stand in their stream.

    They are ordered by the share of its source's tokens that a row completes (weighted round-robin in closed form), dealt by range and
    written once; a partition adds up its own rows and starts where the ones before it end.
    """
    total = rows.groupBy("source").agg(F.sum("n").alias("total"))
    each = rows.join(base.drop("queue"), ["source", "pid"]).join(total, "source").withColumn("own", F.col("before") + F.col("off"))
    order = [(F.col("own") + F.col("n")) / F.col("total"), F.col("source"), F.col("own")]
    dealt = each.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    dealt = staged(dealt.select("source", "pid", "off", "n", "stream", "start", "id", "part"), where, "turns")
    ends = dealt.groupBy("part").agg(F.sum("n").alias("held"))
    ends = ends.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("inside", inside).join(F.broadcast(ends), "part")
    return staged(placed.select("source", "pid", "off", "stream", (F.col("start") + F.col("first") + F.col("inside")).alias("at")), where, "places")


def pack(docs: DataFrame, size: int = 2048, end: int = 1, tokenizer: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, stream.

    ``docs`` has doc_id, text and source; null texts are empty (a document is then its end id alone), a null source is a queue like any other,
    repeated rows are packed each, an empty table gives no rows, other columns are ignored.
    ``weights``: target share of the tokens by source, for at most ``LEAST_SHARE`` sources (more are refused), held by every source while it lasts, the small
    ones too; sources without a weight come last; the default is the corpus's own mixture. Texts may have any length: a document is cut where windows end.
    """
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    text_batches(spark)
    path = tokenizer or default_tokenizer()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"))
    if weights and (len(weights) > LEAST_SHARE or min(weights.values()) <= 0):
        raise ValueError(f"weights: at most {LEAST_SHARE} sources, each with a weight above 0")
    if weights:
        names = sorted(weights)
    else:
        by = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b"))
        every = by.agg(F.sum("b")).first()[0] or 0
        names = sorted(r[0] for r in by.filter(F.col("b") * LEAST_SHARE >= every).select("source").collect())
    queues = {s: i for i, s in enumerate(names)}
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, pid int, source string, queue int, off long, n long, ids binary"
    tokens = staged(docs.mapInArrow(lean(_tokenise(path, end, queues, len(names))), shape), at, "tokens")

    part = staged(tokens.groupBy("queue", "source", "pid").agg(F.sum("n").alias("n")), at, "parts")
    totals = {r[0]: r[1] for r in part.groupBy("queue").agg(F.sum("n")).collect()}  # at most LEAST_SHARE + 1 queues
    stream, start, sums, shares = merge_small(totals, size, {q: weights[names[q]] for q in totals if q < len(names)} if weights else None)
    plan = phases(sums, size, shares if weights else None)
    known = spark.createDataFrame([(q, stream[q], start[q]) for q in totals] or [(0, 0, 0)], "queue int, stream long, start long")
    # where each partition's share of a source starts: in its queue, or among its source's tokens
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = staged(part.join(F.broadcast(known), "queue").select("queue", "source", "pid", "stream", "start", before.alias("before")), at, "bases")
    side = F.broadcast(base) if bounded(base, 120) else base
    own = tokens.filter(F.col("queue") < len(names)).join(side.drop("queue"), ["source", "pid"]).select("doc_id", "stream", (F.col("start") + F.col("before") + F.col("off")).alias("off"), "n", "ids")
    laid = own
    if len(names) in totals:
        rest = tokens.filter(F.col("queue") == len(names))
        turns = _turns(rest.select("source", "pid", "off", "n"), base.filter(F.col("queue") == len(names)), at)
        turns = F.broadcast(turns) if bounded(turns, 120) else turns
        laid = laid.unionByName(rest.join(turns, ["source", "pid", "off"]).select("doc_id", "stream", F.col("at").alias("off"), "n", "ids"))
    itemsize = Encoder(path).kind.itemsize
    out = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, stream long"
    return laid.mapInArrow(_lay(plan, size, itemsize), out)
