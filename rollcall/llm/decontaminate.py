"""Operator 2 [native]: benchmark decontamination by a broadcast hash set of normalised test n-grams.

Every occurrence of a window of n words contains a whole block of g = (n + 1) // 2 words whose start is a multiple of g. So the
documents are probed with their aligned blocks only; a block that equals part of a window is verified against the whole window,
with the words around it, before it counts. One pass over the texts; only hits and one head row a document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, bounded, packed, shared_dir, staged, unpacked

# Fixed value: the separators of the contract, upper case counted as letters because it is lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The normalised words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def windows(bench: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, n, win): the distinct windows of each item as word arrays of n words."""
    items = bench.select(F.col("item_id"), words_of(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("win")).distinct().withColumn("n", F.size("win"))


def text_hash(text: Column) -> Column:
    """What tells the texts under one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def hits(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_rows, n_words, found), one row per distinct doc_id and text, n_rows of them in ``docs``.

    found: the verified occurrences as (start, n, item_id) structs, start counted in words. The broadcast holds block hashes, and hash and
    place of the windows that have the block; a window that stands around a block by its hash is held against the window's own words.
    """
    win = windows(bench, size).withColumn("id", F.xxhash64("n", "win"))
    items = win.select(F.col("n").alias("wn"), "id", F.array_join("win", " ").alias("words"), "item_id")
    g = F.floor((F.col("n") + 1) / 2).cast("int")
    block = win.select("n", "win", "id").distinct().select("n", "win", "id", F.explode(F.sequence(F.lit(0), F.col("n") - g)).alias("place"))
    block = block.select(F.col("n").alias("bn"), F.xxhash64("n", F.slice("win", F.col("place") + 1, g)).alias("h"), F.struct("place", "id").alias("at"))
    block = block.groupBy("bn", "h").agg(F.collect_list("at").alias("at"))
    lengths = sorted(r[0] for r in win.select("n").distinct().collect())  # at most ``size`` of them

    w = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), words_of(F.col("text").cast("string")).alias("w"))
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("h"), F.size("w").cast("string").alias("context")))

    def blocks(n: int) -> Column:
        g = (n + 1) // 2
        one = lambda k: F.struct(
            (k * g).cast("int").alias("pos"),
            F.lit(n).alias("n"),
            F.xxhash64(F.lit(n), F.slice("w", k * g + 1, g)).alias("h"),
            F.array_join(F.slice("w", F.greatest(k * g - (n - g), F.lit(0)) + 1, n + (n - g)), " ").alias("context"),
        )
        many = F.floor(F.size("w") / g).cast("int")
        return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), one)).otherwise(F.array().cast("array<struct<pos:int,n:int,h:bigint,context:string>>"))

    probe = w.select("doc_id", "text_hash", F.inline(F.concat(head, *(blocks(n) for n in lengths))))
    side = F.broadcast(block) if (block.agg(F.sum(F.size("at") * 32 + 64)).first()[0] or 0) <= BROADCAST_BYTES else block
    met = probe.join(side, (probe.n == side.bn) & (probe.h == side.h), "left").filter("pos < 0 OR at IS NOT NULL")
    # verify: the window must stand in the words around the block, first by hash, then word for word
    context = F.split("context", " ")
    before = F.least(F.col("pos"), F.col("n") - F.floor((F.col("n") + 1) / 2)).cast("int")
    around = lambda a: F.slice(context, before - a["place"] + 1, F.col("n"))
    stands = lambda a: (a["place"] <= before) & (F.size(around(a)) == F.col("n")) & (F.xxhash64("n", around(a)) == a["id"])
    one = lambda a: F.struct((F.col("pos") - a["place"]).alias("start"), a["id"].alias("id"), F.array_join(around(a), " ").alias("words"))
    start = F.when(F.col("pos") >= 0, F.transform(F.filter("at", stands), one))
    rows = met.select("doc_id", "text_hash", "n", F.when(F.col("pos") < 0, F.col("context").cast("long")).alias("n_words"), F.explode_outer(start).alias("f")).filter("n_words IS NOT NULL OR f IS NOT NULL")
    rows = rows.select("doc_id", "text_hash", "n", "n_words", "f.start", F.coalesce("f.id", "text_hash").alias("id"), "f.words")
    few = F.broadcast(items) if bounded(items, 400) else items
    own = rows.alias("r").join(few.alias("i"), (F.col("r.id") == F.col("i.id")) & (F.col("r.n") == F.col("i.wn")) & (F.col("r.words") == F.col("i.words")), "left")
    found = F.collect_list(F.when(F.col("start").isNotNull() & F.col("wn").isNotNull(), F.struct("start", "n", "item_id")))
    return own.groupBy("doc_id", "text_hash").agg(F.count("n_words").alias("n_rows"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(found)).alias("found"))


def spans(found: Column) -> Column:
    """The union of sorted occurrences as disjoint (from, to) word ranges, to exclusive."""
    empty = F.array().cast("array<struct<from:int,to:int>>")

    def add(acc, x):
        end = x["start"] + x["n"]
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], end).alias("to"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["to"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("from"), end.alias("to")))))

    return F.aggregate(found, empty, add)


def n_hit(found: Column) -> Column:
    """Words inside any occurrence; ``found`` is sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["n"]).alias("end"), (a["hit"] + F.greatest(x["start"] + x["n"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("hit"))
    return F.aggregate(found, zero, step, lambda a: a["hit"])


def decontamination_report(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; different texts under one doc_id, or under none, are
    judged each, repeated rows each keep their row; extra columns are ignored. A long text is probed whole, block by block.
    """
    h = hits(docs, bench, size)
    items = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"].cast("string"))))
    out = h.select("n_rows", "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit(F.col("found")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("found") > 0).alias("contaminated"))
    return out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).drop("row", "n_rows")


def _joined(docs: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """The packed rows of ``docs`` joined with some (doc_id, text_hash, ...) of ``hits``, staged; broadcast where a count says so."""
    few = staged(few.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}), shared_dir(docs.sparkSession), "found")
    rows = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), text_hash=text_hash(F.col("text")))
    return rows.join(F.broadcast(few) if bounded(few, 160) else few, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), how)


def clean_documents(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the rows whose text holds any benchmark window; all columns stay, rows without doc_id are judged like any other."""
    bad = hits(docs, bench, size).filter(F.size("found") > 0).select("doc_id", "text_hash")
    return unpacked(_joined(docs, bad, "left_anti"), docs.columns)


def cut_spans(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with the benchmark passages taken out of ``text``; the other texts, rows and columns stay as they are.

    A passage goes with its separators up to the next word.
    """
    found = hits(docs, bench, size).filter(F.size("found") > 0).select("doc_id", "text_hash", spans(F.col("found")).alias("cut"))
    pieces = F.regexp_extract_all("text", F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.exists("cut", lambda c: (i >= c["from"]) & (i < c["to"]))), "")
    return unpacked(_joined(docs, found, "left"), docs.columns, text=F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept))
