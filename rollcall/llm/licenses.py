"""Operator 13: license scans by fuzzy search for short notices.

A notice that may have k edits is cut into k + 1 pieces: wherever it stands with at most k edits, one piece stands exactly (pigeonhole). An
automaton over the pieces of all notices reads each text once; every hit gives the few word ranges the notice could fill, and the ``regex``
library's bounded-error matching verifies them and counts the edits. Of ranges that overlap, the one with fewest edits is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .words import text_chunks


@dataclass(frozen=True)
class Notice:
    """Words of a license notice; ``must``: words that an edited copy has to hold unchanged; ``edits``: characters that may differ."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    edits: int = -1
    base: bool = False

    @property
    def most(self) -> int:
        return min(4, len(self.text) // 10) if self.edits < 0 else self.edits


# The base phrases of the contract, then well-known notices.
BASE = (
    Notice("mit", "under the mit license", edits=0, base=True),
    Notice("apache-2", "apache license version 2", edits=0, base=True),
    Notice("cc-by-nc", "cc by nc", edits=0, base=True),
)
NOTICES = (
    *BASE,
    Notice("mit", "under the mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-2", "apache license version 2", ("2",)),
    Notice("apache-2", "under the apache license version 2 0", ("2",)),
    Notice("cc-by", "licensed under cc by 4 0", ("cc", "by")),
    Notice("cc-by", "creative commons attribution 4 0 international", ("4",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc0", "cc0 1 0 universal", ("cc0",)),
    Notice("gpl-2", "gnu general public license version 2", ("2",)),
    Notice("gpl-3", "gnu general public license version 3", ("3",)),
    Notice("lgpl-3", "gnu lesser general public license version 3", ("3",)),
    Notice("agpl-3", "gnu affero general public license version 3", ("3",)),
    Notice("mpl-2", "mozilla public license version 2 0", ("2",)),
    Notice("mpl-2", "mozilla public license v 2 0", ("2",)),
    Notice("epl-2", "eclipse public license version 2 0", ("2",)),
    Notice("bsl-1", "boost software license version 1 0", ("1",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    *(Notice(label, f"spdx license identifier {name}", tuple(name.split()), 2) for label, name in (("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd", "bsd 3 clause"), ("gpl-3", "gpl 3 0"), ("mpl-2", "mpl 2 0"), ("isc", "isc"))),
)
SPANS = "array<struct<base:boolean,label:string,notice:int,edits:int,first_word:long,last_word:long,start:long,end:long>>"
#: Words where capitals have not been lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z lower-cased, bytes of words as they are, all others blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): the notice in so many parts of nearly equal length that edits can't touch all; a base phrase is one part with the blanks around it."""
    if notice.base:
        return [(-1, f" {notice.text} ")]
    n, parts = len(notice.text), notice.most + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    """The automaton and the patterns of a list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices, found = notices, {}
        for i, n in enumerate(notices):
            for offset, piece in pieces(n):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.most}}}") for n in notices]

    def ranges(self, words: str) -> set[tuple[int, int, int]]:
        """(notice, start, end) of the word ranges of ``words`` (words between single blanks, one blank at both ends) that a hit allows."""
        out = set()
        for last, (size, where) in self.automaton.iter(words):
            for i, offset in where:
                n, k = len(self.notices[i].text), self.notices[i].most
                at = last + 1 - size - offset  # where the notice starts if nothing before the piece was inserted or left out
                for start in range(max(1, at - k), min(len(words) - 1, at + k + 1)):
                    if words[start - 1] == " " != words[start]:
                        for end in range(max(start + 1, start + n - k), min(len(words), start + n + k + 1)):
                            if words[end] == " " != words[end - 1]:
                                out.add((i, start, end))
        return out

    def spans(self, words: str) -> list[tuple[int, int, int, int]]:
        """(edits, notice, start, end): all base places, and of the verified ranges those that overlap no better one (fewer edits, then longer, then listed first)."""
        hits = []
        for i, start, end in self.ranges(words):
            text, notice = words[start:end], self.notices[i]
            if notice.base or text == notice.text:
                hits.append((0, i, start, end))
            elif all(f" {w} " in f" {text} " for w in notice.must) and (m := self.patterns[i].fullmatch(text)):
                hits.append((sum(m.fuzzy_counts), i, start, end))
        kept: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}  # by stretches of 256 characters, so that a text full of notices stays linear
        for hit in sorted(hits, key=lambda h: (not self.notices[h[1]].base, h[0], h[2] - h[3], h[1], h[2])):
            _, i, start, end = hit
            near = range(start >> 8, (end >> 8) + 1)
            if self.notices[i].base or not any(s < end and start < e for b in near for s, e in taken.get(b, ())):
                kept.append(hit)
                for b in near:
                    taken.setdefault(b, []).append((start, end))
        return sorted(kept, key=lambda h: (h[2], h[3], h[1]))


def _scan(notices: tuple[Notice, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices)
        kind = pa.list_(pa.struct([("base", pa.bool_()), ("label", pa.string()), ("notice", pa.int32()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at, to, texts in text_chunks(batch.column(1), 2_000_000):
                counts, spans = [], []
                for text in texts:
                    own = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
                    words = f" {b' '.join(own).decode('utf-8', 'surrogatepass')} "
                    counts.append(len(own))
                    hits, out = finder.spans(words) if own else [], []
                    if hits:
                        place = [m.span() for m in _WORD.finditer(text)]
                        blank, seen, done = [], 0, 0
                        for x in sorted({p for h in hits for p in h[2:]}):  # words that begin before x
                            seen, done = seen + words.count(" ", done, x), x
                            blank.append((x, seen))
                        nth = dict(blank)
                        for edits, i, start, end in hits:
                            n, a, b = notices[i], nth[start] - 1, nth[end] - 1
                            out.append({"base": n.base, "label": n.label, "notice": i, "edits": edits, "first_word": a, "last_word": b, "start": place[a][0], "end": place[b][1]})
                    spans.append(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["doc_id", "n_words", "spans"])

    return run


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, spans) of every row of ``docs`` (doc_id, text); spans by start, in words (both ends included) and in code points of the text (end exclusive).

    Null and empty texts have no words and no spans; texts may have any length; repeated rows give a row each; an empty table gives no rows;
    other columns are ignored. Base phrases are reported wherever they stand, others where they overlap no better span.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(notices), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, spans {SPANS}")


def license_report(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row for every row of ``docs``.

    score: of the best span, the share of the notice's characters without an edit; 0 without spans. Rows as in ``find_notices``.
    """
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    long = F.array(*[F.lit(len(n.text)) for n in notices])
    best = F.array_max(F.transform("spans", lambda s: F.lit(1.0) - s["edits"] / F.element_at(long, s["notice"] + 1)))
    starts = F.transform(base, lambda s: s["first_word"])
    return find_notices(docs, notices).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.round(F.coalesce(best, F.lit(0.0)), 6).alias("score"),
        "spans",
    )
