"""Operator 3 [native]: chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes of a nesting level. Runs of equal level make a passage; its normalised form is hashed and
linked to the messages of the same conversation, by line, by neighbouring lines or whole, that came before: passages and originals of one
hash are put in the order of their turns and each passage takes the last original before it, so no pairs are made. The nearest earlier
author of a passage is the message that is answered; messages are then ordered by replies and given without their quotes.

No conversation, passage or thread is gathered in one task: running sums and maxima are taken within blocks of turns and carried from
block to block, and threads are resolved by doubling, in a number of rounds that grows with the logarithm of their nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, dropped, shared_dir, staged

#: Turns of one block: what one task has to order at a time of a conversation.
BLOCK = 1024


def parse_lines(text: Column) -> Column:
    """array<struct<level, body>> of the lines of a text: level counts the leading ``>`` marks (spaces between them allowed)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")

    def one(line):
        marks = F.regexp_extract(line, r"^((?:[ \t]{0,3}>)*)", 1)
        return F.struct(F.char_length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substring(line, F.char_length(marks) + 1, F.lit(2**31 - 1)).alias("body"))

    return F.transform(lines, one)


def normalise(body: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def own_text(lines: Column) -> Column:
    """The lines of level 0, blank lines at the ends cut."""
    return F.regexp_replace(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def whole_runs(text: Column) -> Column:
    """The runs of lines without quotes between them, normalised; quote marks with nothing behind them count as blank lines."""
    marks = r"(?md)^(?:[ \t]{0,3}>)++"
    text = F.regexp_replace(F.coalesce(text, F.lit("")), marks + r"[ \t\r]*$", "")
    runs = F.split(F.regexp_replace(text, marks + r"[^\n]*$", "\0"), "\0")
    return F.filter(F.transform(runs, normalise), lambda r: r != "")


def running(df: DataFrame, by: list[str], order: str, inclusive: bool = False, tie: tuple[str, ...] = (), **values: tuple[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``values``, ("sum" or "max", column): over the rows of the group before this one, or up to it.

    ``order`` is a bigint; a window orders a block of BLOCK of its values, and what the blocks before add up to is joined to each block.
    """
    df = df.withColumn("_b", F.floor(F.col(order) / BLOCK)).withColumns({f"_{k}": c for k, (_, c) in values.items()})
    how = {"sum": F.sum, "max": F.max}
    block = Window.partitionBy(*by, "_b").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*by, "_b").agg(*[how[a](f"_{k}").alias(f"_t_{k}") for k, (a, _) in values.items()])
    blocks = blocks.select(*by, "_b", *[how[a](f"_t_{k}").over(before).alias(f"_c_{k}") for k, (a, _) in values.items()])
    inner = df.select("*", *[how[a](f"_{k}").over(block).alias(f"_i_{k}") for k, (a, _) in values.items()])
    met = inner.join(blocks, [*by, "_b"])
    both = lambda k, a: F.greatest(f"_i_{k}", f"_c_{k}") if a == "max" else F.coalesce(f"_i_{k}", F.lit(0)) + F.coalesce(f"_c_{k}", F.lit(0))
    return met.withColumns({k: both(k, a) for k, (a, _) in values.items()}).drop("_b", *[f"{p}_{k}" for k in values for p in ("", "_t", "_c", "_i")])


def _text_hashes(text: Column) -> list[Column]:
    """128 bits that stand for a normalised text; the salt comes first, so that the two halves don't collide together."""
    return [F.xxhash64(F.lit(s), F.lit(0), text) for s in (1, 2)]


def _tables(lines: Column, most: Column) -> list[Column]:
    """For each half of the hashes an array by k of the hashes of the 2^k lines from every place on, as far as runs of ``most`` lines need them."""
    half = lambda k: F.call_function("shiftleft", F.lit(1), k - 1)
    longer = lambda x, s: F.zip_with(x, F.slice(x, s + 1, F.size(x)), lambda p, q: F.xxhash64(p, q))
    out = []
    for salt in (F.lit(1), F.lit(2)):
        first = F.array(F.transform(lines, lambda t: F.xxhash64(salt, t)))  # noqa: B023
        grown = F.aggregate(F.sequence(F.lit(1), _log2(most)), first, lambda t, k: F.concat(t, F.array(longer(F.element_at(t, -1), half(k)))))
        out.append(F.when(most > 1, grown).otherwise(first))
    return out


def _log2(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def _run_hashes(tables: list[Column], at: Column, n: Column) -> list[Column]:
    """128 bits that stand for the ``n`` lines from place ``at`` on: the longest block of a power of two at their start and the one at their end."""
    k = _log2(n)
    end = at + n - F.call_function("shiftleft", F.lit(1), k)
    return [F.xxhash64(F.lit(s), n, t[k][at], t[k][end]) for s, t in zip((1, 2), tables)]


def link_quotes(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, level, line, passage, source_turn): every quoted passage (neighbouring lines with words of one level), linked to the nearest earlier turn that holds it; null if none does.

    A turn holds a passage if it equals one of its own lines, as many neighbouring own lines as the passage has, or a whole run of them (wrapped
    in any way). Lines without words don't count. ``chats``: conv_id, turn (bigint), text; a (conv_id, turn) once. Neighbouring lines are compared by
    hashes of blocks of lines, at the places whose line begins a passage; a message of L lines takes L log L numbers, and no run of it is built as text.
    """
    at = shared_dir(chats.sparkSession)
    quoting = chats.select("conv_id", "turn", parse_lines(F.col("text")).alias("l")).filter(F.exists("l", lambda x: x["level"] > 0))
    lines = quoting.select("conv_id", "turn", F.posexplode("l").alias("line", "l")).select("conv_id", "turn", "line", F.col("l.level").alias("level"), normalise(F.col("l.body")).alias("body")).filter("body <> ''")
    # a passage: neighbouring lines of one level of one message
    w = Window.partitionBy("conv_id", "turn").orderBy("line")
    runs = lines.withColumn("new", F.when(F.col("level") == F.lag("level", 1, -1).over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"])
    quoted = runs.filter("level > 0").groupBy("conv_id", "turn", "run", "level").agg(F.min("line").alias("line"), F.count("*").cast("int").alias("n"), body.alias("own"))
    quoted = quoted.select("*", F.array_join("own", " ").alias("passage"), F.xxhash64(F.lit(1), F.col("own")[0]).alias("head"))
    # looked for as a line or a whole run, and as so many neighbouring lines
    halves = lambda h: F.struct(h[0].alias("h1"), h[1].alias("h2"))
    as_run = F.when(F.col("n") > 1, halves(_run_hashes(_tables(F.col("own"), F.col("n")), F.lit(0), F.col("n"))))
    quoted = quoted.withColumn("h", F.explode(F.array_compact(F.array(halves(_text_hashes(F.col("passage"))), as_run))))
    quoted = staged(quoted.select("conv_id", "turn", "run", "level", "line", "n", "passage", "head", "h.h1", "h.h2"), at, "quoted")

    # what may be quoted, of conversations that quote: own lines, whole runs, and neighbouring lines where the first one begins a passage
    convs = staged(quoted.groupBy("conv_id").agg(F.max("n").alias("most")), at, "convs")
    mine = F.filter(F.transform(F.filter(parse_lines(F.col("text")), lambda x: x["level"] == 0), lambda x: normalise(x["body"])), lambda b: b != "")
    said = chats.join(F.broadcast(convs) if bounded(convs, 64) else convs, "conv_id").select("conv_id", "turn", "most", mine.alias("own"), whole_runs(F.col("text")).alias("runs"))
    alone = F.array_distinct(F.transform(F.concat("own", "runs"), lambda t: halves(_text_hashes(t))))
    known = said.select("conv_id", "turn", F.inline(alone))

    heads = staged(quoted.filter("n > 1").select("conv_id", "head", "n").distinct(), at, "heads")
    own = F.transform("own", lambda t: F.xxhash64(F.lit(1), t))
    places = said.select("conv_id", "turn", F.size("own").alias("size"), F.posexplode(own).alias("place", "head"))
    places = places.join(F.broadcast(heads) if bounded(heads, 64) else heads, ["conv_id", "head"]).filter("place + n <= size")
    places = places.groupBy("conv_id", "turn", F.floor(F.col("place") / BLOCK).alias("part")).agg(F.collect_list(F.struct("place", "n")).alias("places"))
    tables = places.join(said.filter(F.size("own") > 1).select("conv_id", "turn", "most", "own"), ["conv_id", "turn"])
    tables = tables.select("conv_id", "turn", "places", *[t.alias(f"t{s}") for s, t in zip((1, 2), _tables(F.col("own"), F.least("most", F.size("own"))))])
    met = F.transform("places", lambda p: halves(_run_hashes([F.col("t1"), F.col("t2")], p["place"], p["n"])))
    known = known.unionByName(tables.select("conv_id", "turn", F.inline(F.array_distinct(met))))
    wanted = quoted.select("conv_id", "h1", "h2").distinct()
    known = known.join(F.broadcast(wanted) if bounded(wanted, 64) else wanted, ["conv_id", "h1", "h2"], "left_semi")

    none = F.lit(None).cast("struct<run:bigint,level:int,line:int,passage:string>")
    quotes = quoted.select("conv_id", "h1", "h2", "turn", F.lit(0).alias("kind"), F.struct("run", "level", "line", "passage").cast("struct<run:bigint,level:int,line:int,passage:string>").alias("q"))
    both = quotes.unionByName(known.select("conv_id", "h1", "h2", "turn", F.lit(1).alias("kind"), none.alias("q")))
    met = running(both, ["conv_id", "h1", "h2"], "turn", tie=("kind",), source_turn=("max", F.when(F.col("kind") == 1, F.col("turn"))))
    return met.filter("kind = 0").groupBy("conv_id", "turn", "q.run", "q.level", "q.line", "q.passage").agg(F.max("source_turn").alias("source_turn")).drop("run")


def reply_order(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, reply_to, depth, position), one row per distinct (conv_id, turn).

    reply_to: the source of the first linked quote of the outermost level; a message without one answers the turn before it in its
    conversation; the first has none. depth counts replies from the root; position is the place in the conversation read thread by thread
    (parents before their answers, those to a later message of a run first, answers to one message by turn). text is without quotes; texts may
    have any length. Of repeated (conv_id, turn) rows the least (role, text) counts; rows with null conv_id or turn go; null texts are empty; an empty
    table gives no rows; other columns are ignored. turn is a whole number.
    """
    at = shared_dir(chats.sparkSession)
    chats = chats.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    chats = _once(chats.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]), at)
    links = link_quotes(chats).groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked"), F.min(F.when(F.col("source_turn").isNotNull(), F.struct("level", "line", "source_turn"))).alias("first"))
    # numbers alone are dealt and ordered; the texts are joined at the end
    msgs = chats.select("conv_id", "turn").join(links, ["conv_id", "turn"], "left")
    msgs = running(msgs, ["conv_id"], "turn", before=("max", F.col("turn")), idx=("sum", F.lit(1).cast("long")))
    source = F.col("first.source_turn")
    msgs = msgs.withColumn("jump", source.isNotNull() & ~source.eqNullSafe(F.col("before")))
    # a linked reply to another message than the last begins a branch; the messages after it go on in it
    begins = F.col("jump") | F.col("before").isNull()
    msgs = running(msgs, ["conv_id"], "turn", inclusive=True, branch=("max", F.when(begins, F.col("turn"))), start=("max", F.when(begins, F.col("idx"))))
    msgs = msgs.select("conv_id", "turn", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce(source, F.col("before")).alias("reply_to"), "jump", "branch", (F.col("idx") - F.col("start")).alias("rank"))
    msgs = staged(msgs, at, "messages")
    placed = msgs.join(_branches(msgs, at), ["conv_id", "branch"]).drop("jump", "branch")
    texts = chats.select("conv_id", "turn", "role", own_text(parse_lines(F.col("text"))).alias("text"))
    out = texts.join(F.broadcast(placed) if bounded(msgs, 160) else placed, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", (F.col("base") + F.col("rank")).alias("depth"), (F.col("off") + F.col("rank") + 1).alias("position"))


def _once(chats: DataFrame, at: str) -> DataFrame:
    """The least (role, text) of each (conv_id, turn); only messages that repeat one are gathered."""
    again = staged(chats.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), at, "again")
    few = F.broadcast(again) if bounded(again, 64) else again
    least = F.min(F.struct("role", "text")).alias("m")
    some = chats.join(few, ["conv_id", "turn"], "left_semi").groupBy("conv_id", "turn").agg(least).select("conv_id", "turn", "m.role", "m.text")
    return chats.join(few, ["conv_id", "turn"], "left_anti").unionByName(some)


def _doubled(nodes: DataFrame, at: str, name: str, sums: list[str], up: bool) -> DataFrame:
    """``nodes`` (conv_id, branch, parent, ...) with the columns ``sums`` added up along the tree: over a node and all below it (``up``), or over it and all above it.

    Each round doubles the distance that has been added up, until no node has an ancestor that far.
    """
    df, k = staged(nodes.withColumn("anc", F.col("parent")), at, f"{name}-0"), 0
    while not df.filter("anc IS NOT NULL").isEmpty():
        far = df.select("conv_id", F.col("branch").alias("anc"), F.col("anc").alias("next"), *[F.col(s).alias(f"_{s}") for s in sums])
        step = df.join(far if not up else far.select("conv_id", "anc", "next"), ["conv_id", "anc"], "left")
        if up:
            below = df.filter("anc IS NOT NULL").groupBy("conv_id", F.col("anc").alias("branch")).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
            step = step.join(below, ["conv_id", "branch"], "left")
        step = step.withColumns({s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in sums} | {"anc": F.col("next")})
        df, k = staged(step.select(*df.columns), at, f"{name}-{k + 1}"), k + 1
        dropped(nodes.sparkSession, at, f"{name}-{k - 1}")
    return df.drop("anc")


def _branches(msgs: DataFrame, at: str) -> DataFrame:
    """(conv_id, branch, off, base): how many messages are read before a branch's first one, and the depth of that.

    A branch is read after the whole run of messages it hangs on; of several on one run, those on a later message first, then by turn.
    """
    size = msgs.groupBy("conv_id", "branch").agg(F.count("*").alias("len"), F.min(F.when(F.col("jump") & (F.col("rank") == 0), F.col("reply_to"))).alias("attach"))
    where = msgs.select("conv_id", F.col("turn").alias("attach"), F.col("branch").alias("parent"), (F.col("rank") + 1).alias("base"))
    nodes = staged(size.join(where, ["conv_id", "attach"], "left").withColumn("tree", F.col("len")), at, "nodes")
    tree = _doubled(nodes, at, "tree", ["tree"], up=True)
    # what is read before a branch, counted from its parent's first message: the parent's run and the trees of earlier siblings
    hung = tree.filter("parent IS NOT NULL")
    spots = hung.groupBy("conv_id", "parent", "attach").agg(F.sum("tree").alias("spot")).withColumn("order", -F.col("attach"))
    spots = running(spots, ["conv_id", "parent"], "order", later=("sum", F.col("spot"))).select("conv_id", "parent", "attach", "later")
    hung = running(hung, ["conv_id", "parent", "attach"], "branch", earlier=("sum", F.col("tree")))
    hung = hung.join(spots, ["conv_id", "parent", "attach"]).join(nodes.select("conv_id", F.col("branch").alias("parent"), F.col("len").alias("run")), ["conv_id", "parent"])
    offs = hung.select("conv_id", "branch", "parent", (F.col("run") + F.col("later") + F.col("earlier")).alias("off"), "base")
    zero = F.lit(0).cast("long")
    roots = nodes.filter("parent IS NULL").select("conv_id", "branch", "parent", zero.alias("off"), zero.alias("base"))
    return _doubled(roots.unionByName(offs), at, "offs", ["off", "base"], up=False).select("conv_id", "branch", "off", "base")
