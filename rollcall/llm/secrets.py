"""Operator 1: secret scans with an incremental blob ledger.

Every version (path, text) is content-addressed by the SHA-256 of its text. The ledger is a table of (blob, rules version,
findings); only blobs that it does not hold under the current rules version are scanned, each once however many paths have it,
and the findings are joined back to all paths. The ledger is a table that is kept and appended to, so a later run starts from it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, packed, shared_dir, staged, text_batches, unpacked


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters or more; texts without ``needle`` have none.

    A pattern must take time in proportion to the text, whatever the text repeats: where the start of a match may stand inside a run that it
    scans, the pattern also takes runs that don't match, with an empty group.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = 0
    needle: str = ""


# The three base kinds of the contract, then further well-known token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})|[A-Za-z0-9_-]+", 1, 1, needle="eyJ"),
)
SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = RULES
    version: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "version", hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least, r.flags) for r in self.rules]).encode()).hexdigest()[:16])


def find_spans(text: str, compiled: list[tuple[Rule, re.Pattern]]) -> list[dict]:
    """All spans of one whole text by start, then rule order; offsets in code points, end exclusive."""
    found = []
    for order, (rule, pattern) in enumerate(compiled):
        if rule.needle not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return [{"kind": kind, "start": a, "end": b} for a, _, b, kind in sorted(found)]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern, r.flags)) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [find_spans(t.as_py(), compiled) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["blob", "spans"])

    return run


def blob_of(text: Column) -> Column:
    """The content address; a null text is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: RuleSet = RuleSet()) -> DataFrame:
    """Ledger rows (blob, rules, spans) for the blobs of ``versions`` (blob, text) that ``ledger`` lacks under these rules.

    Seen pairs go before the texts are dealt, by a broadcast of their blobs while a count allows it.
    """
    blobs = versions.select("blob", F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rules") == rules.version).select("blob").distinct()
        blobs = blobs.join(F.broadcast(seen) if bounded(seen, 160) else seen, "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return blobs.mapInArrow(_scan(rules.rules), f"blob string, spans {SPANS}").select("blob", F.lit(rules.version).alias("rules"), "spans")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``; none before the first run."""
    try:
        return spark.read.parquet(path).select("blob", "rules", "spans")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def scan_versions(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | str | None = None, rules: RuleSet = RuleSet()) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): one findings row (path, blob, spans) for every row of ``docs``, and the ledger with the new blobs added.

    ``ledger`` is the table of an earlier run, or the path of a kept one: its rows are read (none before the first run) and the new ones
    are appended, so that the next run scans what it has not seen. A blob that the ledger holds more than once counts once. Null and empty texts
    have no spans; texts may have any length; repeated rows each keep their row; an empty table gives no rows; columns other than path and
    text are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    versions = docs.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text")).withColumn("blob", blob_of(F.col("text")))
    kept = ledger if isinstance(ledger, str) else None
    old = read_ledger(spark, kept) if kept else ledger
    new = staged(update_ledger(versions, old, rules), shared_dir(spark), "ledger")
    now = new if old is None else new.unionByName(old.select("blob", "rules", "spans"))
    # blobs without findings need no row on the right; the derived key lets a hot blob be split
    hits = _hits(now, rules).withColumn("b", F.xxhash64("found"))
    left = versions.select("path", "blob")
    same = (F.xxhash64("blob") == F.col("b")) & (F.col("blob") == F.col("found"))
    joined = left.join(F.broadcast(hits) if bounded(hits, 400) else hits, same, "left")
    findings = joined.select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    if kept:
        new.write.mode("append").parquet(kept)
    return findings, now


def _hits(ledger: DataFrame, rules: RuleSet) -> DataFrame:
    """(found, spans) of the blobs that have any, each once: runs that appended at the same time may have left a blob twice, with the same spans."""
    return ledger.filter((F.col("rules") == rules.version) & (F.size("spans") > 0)).groupBy(F.col("blob").alias("found")).agg(F.min("spans").alias("spans"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(findings: DataFrame, base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """The contract's columns from findings."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return findings.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(_digest(own).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", rules: RuleSet = RuleSet()) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark`` and n_chars, where there is such a column, counted anew.

    All rows and columns stay, whatever the other columns are called. Findings are joined by content, whatever the ids: they are few and
    are broadcast where a count says so, then the texts stay where they are.
    """
    _, ledger = scan_versions(docs, rules=rules)
    found = _hits(ledger, rules)
    rows = packed(docs, blob=blob_of(F.col("text").cast("string")))
    out = rows.join(F.broadcast(found) if bounded(found, 400) else found, F.col("blob") == F.col("found"), "left")
    text = F.col("row.text")
    # (text so far, end of the last span): each span copies the stretch before it and leaves the mark
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["done"].alias("done"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("done"), s["end"].alias("at"))
    )
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    out = out.select("row", F.when(F.col("spans").isNull(), text).otherwise(clean).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length("text"))
        new["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, **new)
