"""Jobs over HTML pages: main text and organisation names (the parsers are small helpers inside ``mapInPandas``)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_org, name_key

SKIPPED = frozenset(("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "button"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Text(HTMLParser):
    """The title and the text outside chrome elements. One that is never closed hides nothing: its text stays."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.title, self.parts = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append((tag, len(self.parts)))

    def handle_endtag(self, tag):
        while any(name == tag for name, _ in self.open):
            name, at = self.open.pop()
            if name == tag:
                if tag in SKIPPED:
                    del self.parts[at:]
                break

    def handle_data(self, data):
        inside = self.open[-1][0] if self.open else ""
        if inside == "title":
            self.title.append(data)
        elif inside not in ("script", "style"):
            self.parts.append(data)


def main_text(html: str | None, max_chars: int) -> str | None:
    """Short title and main text, white space collapsed; null if nothing is left."""
    p = _Text()
    p.feed(html or "")
    p.close()
    title, body = (" ".join(" ".join(x).split()) for x in (p.title, p.parts))
    out = f"{title} - {body}" if title and len(title) <= 120 and body else body or title
    return out[:max_chars] or None


def page_text(pages: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(page_id, url, text, error): the main text of each page; ``empty`` as the error where there is none (PRJ-21)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [main_text(h, max_chars) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": text, "error": ["empty" if t is None else None for t in text]})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, error string")


class _Names(HTMLParser):
    """Texts at the places where lists of organisations put names: table cells, list items, headings, marked blocks."""

    BLOCKS = re.compile("association|asso|club|structure", re.I)

    def __init__(self, headings: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.headings = [], [], headings

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        self.stack.append({"tag": tag, "text": [], "hidden": tag in SKIPPED or bool(self.stack and self.stack[-1]["hidden"]), "block": bool(self.BLOCKS.search(marks)), "row": [], "rows": []})

    def handle_endtag(self, tag):
        if not any(x["tag"] == tag for x in self.stack):
            return
        while self.stack:
            top = self.stack.pop()
            self._close(top)
            if top["tag"] == tag:
                return

    def handle_data(self, data):
        if self.stack:
            self.stack[-1]["text"].append(data)

    def close(self):
        super().close()
        while self.stack:
            self._close(self.stack.pop())

    def _close(self, x):
        text = " ".join("".join(x["text"]).split())
        if x["hidden"]:
            return
        if self.stack:
            self.stack[-1]["text"].append(f" {text} ")
        up = next((y for y in reversed(self.stack) if y["tag"] == {"td": "tr", "th": "tr", "tr": "table"}.get(x["tag"])), None)
        if x["tag"] in ("td", "th") and up:
            up["row"].append(text)
        elif x["tag"] == "tr" and up:
            up["rows"].append(x["row"])
        elif x["tag"] == "table" and len(x["rows"]) >= 2:
            head = [c.lower() for c in x["rows"][0]]
            col = next((i for i, h in enumerate(head) if any(k in h for k in ("nom", "name", "association", "title", "titre"))), 0)
            self.found += [("table", r[col]) for r in x["rows"][1:] if len(r) > col]
        elif x["tag"] == "li":
            self.found.append(("list", re.split(r"\s[–—-]\s", text)[0].strip()))
        elif x["tag"] in self.headings or x["tag"] in ("h4", "strong", "b", "a") and any(y["block"] for y in self.stack):
            self.found.append(("heading" if x["tag"] in self.headings else "block", text))


def org_names(html: str | None, headings: tuple[str, ...] = ("h2", "h3")) -> list[tuple[str, str]]:
    p = _Names(headings)
    p.feed(html or "")
    p.close()
    return [(kind, t) for kind, t in p.found if t]


def extract_org_names(pages: DataFrame, check=looks_like_org, headings: tuple[str, ...] = ("h2", "h3")) -> DataFrame:
    """(page_id, url, pos, place, name, name_key): candidate names of each page, the first of each key; ``check`` decides what looks like one (PRJ-22)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, u, pos, place, t) for i, u, h in zip(f["page_id"], f["url"], f["html"]) for pos, (place, t) in enumerate(org_names(h, headings))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "pos", "place", "name"])

    kind = dict(pages.dtypes)["page_id"]
    names = pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, pos int, place string, name string")
    names = names.filter(check(F.col("name"))).withColumn("name_key", name_key(F.col("name"))).filter("name_key <> ''")
    r = F.row_number().over(Window.partitionBy("page_id", "name_key").orderBy("pos"))
    return names.withColumn("_r", r).filter("_r = 1").drop("_r")


def listings(df: DataFrame) -> DataFrame:
    """(id, url, title) of the listing arrays of entities (JN-13)."""
    return df.select("id", F.explode("listings").alias("l")).select("id", "l.url", "l.title")


def attach_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """The result of a page for every entity whose listings have its URL (JN-12)."""
    return listed.select("id", "url").distinct().join(pages, "url")


def cross_reference(names: DataFrame, registry: DataFrame, block: str) -> DataFrame:
    """(page_id, name, matched, b_id): names of pages found in the registry, or new (DEC-21). Both have the block column; registry: id, name."""
    from .match import fuzzy_join, split_matches

    keyed = names.withColumn("id", F.xxhash64("page_id", "name_key"))
    best = split_matches(fuzzy_join(keyed.select("id", "name", block), registry.select("id", "name", block), block))
    out = keyed.join(best.select(F.col("a_id").alias("id"), "b_id", "matched"), "id", "left")
    return out.select("page_id", "name", F.coalesce("matched", F.lit(False)).alias("matched"), F.when(F.col("matched"), F.col("b_id")).alias("b_id"), F.when(~F.coalesce("matched", F.lit(False)), F.col("b_id")).alias("closest"))
