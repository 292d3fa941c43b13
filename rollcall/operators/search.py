"""Text search as batch jobs: inverted index, synonyms, keyword match, typo-tolerant suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import small

# Searchable fields in order of weight.
FIELDS = ("name", "city", "category", "tags", "description")


def search_doc(df: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, name, category, description, city, department, tags) with the category's label, empty if unknown (PRJ-16)."""
    out = df.join(small(categories), "category_id", "left")
    return out.select("id", "name", F.coalesce("label", F.lit("")).alias("category"), F.coalesce("description", F.lit("")).alias("description"), "city", "department", "tags")


def build_index(docs: DataFrame) -> DataFrame:
    """(token, id, priority, department, category): each token once a document, under its best field; 0 is the name (SCH-1)."""
    text = lambda f: F.array_join("tags", " ") if f == "tags" else F.col(f)
    fields = F.array(*[F.struct(F.lit(i).alias("priority"), tokens(text(f), ()).alias("ts")) for i, f in enumerate(FIELDS)])
    each = docs.select("id", "department", "category", F.explode(fields).alias("f")).select("id", "department", "category", "f.priority", F.explode("f.ts").alias("token"))
    return each.groupBy("token", "id", "department", "category").agg(F.min("priority").alias("priority"))


def expand_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(term, token): each term and its alternatives; one way unless listed both ways (SCH-2). synonyms: term, alternative."""
    more = terms.join(small(synonyms), "term").select("term", F.col("alternative").alias("token"))
    return terms.select("term", F.col("term").alias("token")).unionByName(more).distinct()


def match_ids(index: DataFrame, wanted: DataFrame, department: str | None = None, cap: int = 3000) -> DataFrame:
    """(term, id): ids with a wanted token (term, token) in any field, the first ``cap`` of each term by id (SCH-3)."""
    from .listing import top_k

    hits = index.filter(F.col("department") == department) if department else index
    return top_k(hits.join(small(wanted), "token").select("term", "id").distinct(), ["term"], [F.col("id")], cap)


def allowed_typos(q: str) -> int:
    """None in short words, one from four letters on, two from eight on."""
    return 0 if len(q) < 4 else 1 if len(q) < 8 else 2


def suggest(index: DataFrame, q: str, limit: int = 8, department: str | None = None) -> DataFrame:
    """(id, typos, priority): documents with a token that begins with q, or is like it but for a typo (two from eight letters on), same first letter (SCH-4)."""
    q = q.strip().lower()
    allowed = allowed_typos(q)
    t = F.col("token")
    near = F.substring(t, 1, 1) == q[:1]
    hits = index.filter(near & (F.col("department") == department)) if department else index.filter(near)
    typos = F.when(t.startswith(q), 0).otherwise(F.levenshtein(t, F.lit(q), allowed))
    found = hits.withColumn("typos", typos).filter(F.col("typos").between(0, allowed))
    return found.groupBy("id").agg(F.min(F.struct("typos", "priority")).alias("b")).select("id", "b.typos", "b.priority").orderBy("typos", "priority", "id").limit(limit)
