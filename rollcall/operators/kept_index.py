"""The search index as a table that is kept: written once by buckets of tokens, brought up to date by document, asked without a scan.

Two tables under a path: ``postings`` (token, id, department, category, priority), bucketed by token, and ``forms`` (form, token), bucketed by form:
every token under its forms with up to two letters after the first gone. Two words with the same first letter and at most two typos between
them have such a form in common, so misspelt words are found by equality. A question reads the buckets of its tokens and forms alone.
Changed documents go to ``changes/b=K`` with all their postings; what the buckets hold of them no longer counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists, small
from .listing import top_k
from .search import allowed_typos, build_index

TYPOS = 2


def forms_of(word: str, most: int = TYPOS) -> set[str]:
    """The word with up to ``most`` letters after the first gone."""
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in combinations(range(1, len(word)), k)}


def forms(token: Column) -> Column:
    """``forms_of`` as an array of columns."""
    without = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    once = lambda t, start: F.when(F.length(t) >= start, F.transform(F.sequence(start, F.length(t)), lambda i: F.struct(without(t, i).alias("f"), i.alias("i"))))
    none = F.array().cast("array<struct<f:string,i:int>>")
    one = F.coalesce(once(token, F.lit(2)), none)
    two = F.flatten(F.transform(one, lambda x: F.coalesce(once(x["f"], x["i"]), none)))
    return F.array_distinct(F.concat(F.array(token), F.transform(F.concat(one, two), lambda x: x["f"])))


@dataclass(frozen=True)
class KeptIndex:
    spark: SparkSession
    path: str
    buckets: int = 64

    def name(self, table: str) -> str:
        return f"rollcall_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{table}"

    def _write(self, df: DataFrame, table: str, key: str) -> None:
        df.repartition(self.buckets, key).write.mode("overwrite").option("path", f"{self.path}/{table}").bucketBy(self.buckets, key).sortBy(key).saveAsTable(self.name(table))

    def _table(self, table: str, key: str, columns: str) -> DataFrame:
        name = self.name(table)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        return self.spark.table(name)

    def write(self, docs: DataFrame) -> None:
        """The index of search documents (see ``search.search_doc``)."""
        self._write(build_index(docs).select("token", "id", "department", "category", "priority"), "postings", "token")
        self._write(self.postings().select("token").distinct().select(F.explode(forms(F.col("token"))).alias("form"), "token"), "forms", "form")

    def update(self, docs: DataFrame, k: int) -> None:
        """Changed documents, as batch ``k``; one without any text is gone from the index. A batch that comes again replaces itself."""
        rows = build_index(docs).select("token", "id", "department", "category", "priority")
        every = docs.select("id").distinct().join(rows, "id", "left").select("token", "id", "department", "category", "priority")
        every.write.mode("overwrite").parquet(f"{self.path}/changes/b={k}")

    def postings(self) -> DataFrame:
        kind = dict(self.spark.read.parquet(f"{self.path}/postings").dtypes)
        return self._table("postings", "token", ", ".join(f"{c} {kind[c]}" for c in ("token", "id", "department", "category", "priority")))

    def find(self, tokens: DataFrame) -> DataFrame:
        """The postings of ``tokens`` (token, ...), with its other columns: few tokens are looked up in their buckets, many are dealt to them."""
        few = tokens.select("token").distinct().limit(1001).collect()
        base = self.postings()
        if len(few) <= 1000:
            base = base.filter(F.col("token").isin([r[0] for r in few]))
        own = list(base.columns)
        if exists(self.spark, f"{self.path}/changes"):
            changed = self.spark.read.parquet(f"{self.path}/changes")
            last = changed.groupBy("id").agg(F.max("b").alias("b"))
            newest = changed.join(small(last), ["id", "b"]).filter(F.col("token").isNotNull()).select(*own)
            base = base.join(small(last.select("id")), "id", "left_anti").select(*own).unionByName(newest)
        return base.join(small(tokens), "token")

    def match_ids(self, wanted: DataFrame, department: str | None = None, cap: int = 3000) -> DataFrame:
        """``search.match_ids`` over the kept index (SCH-3)."""
        hits = self.find(wanted)
        hits = hits.filter(F.col("department") == department) if department else hits
        return top_k(hits.select("term", "id").distinct(), ["term"], [F.col("id")], cap)

    def tokens_like(self, q: str) -> DataFrame:
        """(token, typos) of the tokens that begin with ``q`` or are like it but for the typos allowed; the changed documents' tokens are looked at one by one."""
        most = allowed_typos(q)
        near = self._table("forms", "form", "form string, token string").filter(F.col("form").isin(sorted(forms_of(q, most)))).select("token")
        begin = self.postings().filter(F.col("token").startswith(q)).select("token")
        every = near.union(begin)
        if exists(self.spark, f"{self.path}/changes"):
            every = every.union(self.spark.read.parquet(f"{self.path}/changes").filter(F.substring("token", 1, 1) == q[:1]).select("token"))
        t = F.col("token")
        typos = F.when(t.startswith(q), 0).otherwise(F.levenshtein(t, F.lit(q), most))
        return every.distinct().withColumn("typos", typos).filter(F.col("typos").between(0, most))

    def suggest(self, q: str, limit: int = 8, department: str | None = None) -> DataFrame:
        """``search.suggest`` over the kept index (SCH-4): the same rows in the same order, without a distance to every token of a letter."""
        hits = self.find(self.tokens_like(q.strip().lower()))
        hits = hits.filter(F.col("department") == department) if department else hits
        return hits.groupBy("id").agg(F.min(F.struct("typos", "priority")).alias("b")).select("id", "b.typos", "b.priority").orderBy("typos", "priority", "id").limit(limit)
