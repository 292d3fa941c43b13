"""Links of organisations: candidate typing, scores, fuzzy name joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, name_norm, overlap, tokens, trigrams, unaccent, word_trigrams
from ..functions.urls import bare_domain, base_domain, canonical_social, host_of, platform_of
from ..sources.shared import written
from .listing import top_k


@dataclass(frozen=True)
class Hosts:
    """Host lists of candidate typing: directories are no official sites; hints mark sites of localities."""

    directories: tuple[str, ...] = ("example-directory.org", "listings.example")
    locality_hints: tuple[str, ...] = ("mairie", "ville-", "commune", "townhall")
    refused: tuple[str, ...] = ("google.com", "gmail.com", "bit.ly", "blogspot.com")


def match_type(own: Column, city: Column, slug: Column, title: Column, rank: Column, stop=STOPWORDS) -> Column:
    """How a social result shows the name, in order of trust; null if it does not (DEC-2)."""
    slug_t, n_title = tokens(slug, stop), overlap(own, tokens(title, stop))
    return (
        F.when(F.arrays_overlap(own, slug_t), "slug")
        .when(n_title >= 2, "title")
        .when(F.arrays_overlap(city, slug_t), "slug_city")
        .when((n_title >= 1) & (rank <= 3), F.concat(F.lit("top"), rank.cast("string")))
        .when(n_title >= 1, "fallback")
    )


def flat_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(unaccent(host)), r"\.", "")


def site_features(own: Column, city: Column, host: Column, title: Column, stop=STOPWORDS) -> dict[str, Column]:
    """name_in_domain (tokens, and longer ones inside the flat host), name_in_title, and score = 3 x domain + title + city (DEC-3)."""
    dom, ttl, flat = tokens(F.replace(host, F.lit("."), F.lit(" ")), stop), tokens(title, stop), flat_host(host)
    inside = F.size(F.filter(F.array_except(own, dom), lambda t: (F.length(t) >= 4) & F.contains(flat, t)))
    in_domain, in_title = overlap(own, dom) + inside, overlap(own, ttl)
    bonus = (F.arrays_overlap(city, dom) | F.arrays_overlap(city, ttl)).cast("int")
    return {"name_in_domain": in_domain, "name_in_title": in_title, "score": in_domain * 3 + in_title + F.coalesce(bonus, F.lit(0))}


def is_locality_site(city: Column, host: Column, hosts: Hosts = Hosts(), stop=STOPWORDS) -> Column:
    """A hint in the host, or a city token in a .fr host that is no directory (DEC-4)."""
    hint = F.lit(False)
    for h in hosts.locality_hints:
        hint = hint | F.contains(host, F.lit(h))
    own = F.coalesce(F.arrays_overlap(city, tokens(F.replace(host, F.lit("."), F.lit(" ")), stop)), F.lit(False))
    return hint | (own & host.endswith(".fr") & ~base_domain(host).isin(*hosts.directories))


def type_candidates(entities: DataFrame, results: DataFrame, hosts: Hosts = Hosts(), stop=STOPWORDS) -> DataFrame:
    """(id, kind, platform, url, slug, host, title, rank, match_type, score, name_in_domain, name_in_title) of raw results (DEC-1).

    entities: id, name, city; results: id, rank, title, url. Kinds are social, listing (of a locality) and site; directories, structural
    rejects and social results without the name are dropped; sites keep their best five, listings their first three, and social
    candidates the first of each page.
    """
    who = entities.select("id", F.array_except(tokens(F.col("name"), stop), tokens(F.col("city"), stop)).alias("own"), tokens(F.col("city"), stop).alias("place"))
    r = results.filter("url IS NOT NULL AND url <> ''").join(who, "id").withColumns({"host": host_of(F.col("url")), "platform": platform_of(F.col("url"))})
    social = canonical_social(r.filter("platform IS NOT NULL"))
    social = social.withColumn("match_type", match_type(F.col("own"), F.col("place"), F.col("slug"), F.col("title"), F.col("rank"), stop)).filter("match_type IS NOT NULL")
    social = top_k(social, ["id", "platform", "page"], [F.col("rank")], 1)
    none = lambda t: F.lit(None).cast(t)
    social = social.select("id", F.lit("social").alias("kind"), "platform", F.col("page").alias("url"), "slug", "host", "title", "rank", "match_type", none("int").alias("score"), none("int").alias("name_in_domain"), none("int").alias("name_in_title"))
    rest = r.filter("platform IS NULL").withColumn("listing", is_locality_site(F.col("place"), F.col("host"), hosts, stop))
    flat = lambda df, kind: df.select("id", F.lit(kind).alias("kind"), none("string").alias("platform"), "url", none("string").alias("slug"), "host", "title", "rank", none("string").alias("match_type"), "score", "name_in_domain", "name_in_title")
    listing = top_k(rest.filter("listing"), ["id"], [F.col("rank"), F.col("url")], 3).withColumns({c: none("int") for c in ("score", "name_in_domain", "name_in_title")})
    site = rest.filter(~F.col("listing") & ~base_domain(F.col("host")).isin(*hosts.directories)).withColumns(site_features(F.col("own"), F.col("place"), F.col("host"), F.col("title"), stop))
    site = top_k(site, ["id"], [F.desc("score"), F.col("rank"), F.col("url")], 5)
    return social.unionByName(flat(listing, "listing")).unionByName(flat(site, "site"))


def mentions(sites: DataFrame, k: int = 3) -> DataFrame:
    """Sites whose title has the name but whose domain does not (WIN-4)."""
    return top_k(sites.filter("name_in_domain = 0 AND name_in_title >= 2"), ["id"], [F.desc("score"), F.col("rank"), F.col("url")], k)


def strict_slug(entities: DataFrame, results: DataFrame, geo: tuple[str, ...] = (), stop=STOPWORDS) -> DataFrame:
    """(id, page): the first donation page whose slug has all but one of the telling tokens and no long foreign one (DEC-5)."""
    name, city = tokens(F.col("name"), stop), tokens(F.col("city"), stop)
    places = F.array_union(city, F.array(*map(F.lit, geo)).cast("array<string>"))
    own = F.filter(F.array_except(name, places), lambda t: ~t.rlike("^[0-9]+$"))
    who = entities.select("id", own.alias("own"), F.array_union(name, places).alias("known")).filter(F.size("own") > 0)
    r = canonical_social(results.join(who, "id")).filter("platform = 'donation'").withColumn("slug_t", tokens(F.col("slug"), stop))
    foreign = F.filter(F.array_except("slug_t", "known"), lambda t: F.length(t) > 3)
    ok = (overlap(F.col("own"), F.col("slug_t")) >= F.greatest(F.lit(1), F.size("own") - 1)) & (F.size(foreign) == 0)
    return top_k(r.filter(ok), ["id"], [F.col("rank"), F.col("url")], 1).select("id", "page")


def score_domains(results: DataFrame, names: DataFrame, hosts: Hosts = Hosts(), stop=STOPWORDS) -> DataFrame:
    """(id, domain, score): the best bare domain of the results of an entity, scored by name and origin (DEC-14, WIN-12).

    results: id, rank, url, title, body; names: id, name.
    """
    p = platform_of(F.col("url"))
    own = F.when(p.isNull(), F.array(base_domain(host_of(F.col("url"))))).otherwise(F.array().cast("array<string>"))
    pool = F.array_distinct(F.concat(F.transform(F.regexp_extract_all(F.concat_ws(" ", "body", "title"), F.lit(bare_domain()), 1), F.lower), own))
    d = results.select("id", "rank", (p == "facebook").alias("from_page"), F.explode(pool).alias("d")).withColumn("domain", base_domain(F.col("d")))
    d = d.filter(platform_of(F.concat(F.lit("https://"), F.col("domain"))).isNull() & ~F.col("domain").isin(*hosts.directories, *hosts.refused) & (F.length("domain") >= 5)).join(names, "id")
    flat = F.replace(F.split_part("domain", F.lit("."), F.lit(1)), F.lit("-"), F.lit(""))
    score = 2 * F.arrays_overlap(tokens(F.replace("domain", F.lit("."), F.lit(" ")), stop), tokens(F.col("name"), stop)).cast("int") + 2 * ((F.length(flat) >= 5) & F.contains(F.replace(F.lower(unaccent(F.col("name"))), F.lit(" "), F.lit("")), flat)).cast("int") + F.coalesce(F.col("from_page"), F.lit(False)).cast("int")
    scored = d.withColumn("score", score).filter("score >= 2")
    return top_k(scored, ["id"], [F.desc("score"), F.col("rank"), F.col("domain")], 1).select("id", "domain", "score")


def ordered_sets(ids: DataFrame, freq: DataFrame, block: str) -> DataFrame:
    """(block, g, o, n): the different trigram sets g of ``ids`` (id, block, g), their trigrams rarest in the block first, and how many rows have each."""
    each = ids.groupBy(block, "g").agg(F.count("*").alias("n")).select(block, "g", "n", F.explode("g").alias("gram")).join(freq, [block, "gram"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")))
    return each.groupBy(block, "g", "n").agg(order.alias("o")).select(block, "g", F.transform("o", lambda e: e["gram"]).alias("o"), "n")


def meeting_pairs(x: DataFrame, y: DataFrame, block: str, num: int, of: int, shared: int = 1) -> DataFrame:
    """(block, ga, gb, n): all pairs of ordered sets (of ``shared`` trigrams or more) whose Jaccard similarity may be num/of or more, and n of y; each pair once.

    Such a pair shares ``shared`` (1 or 2) of the first size - ceil(size * num / of) + shared trigrams of both, its sizes are not too far apart, and
    after the first that both share enough others follow in either. So a pair is taken at these alone, and only if what may still be shared
    is enough. Two trigrams together are far rarer than one; that pays where the similarity leaves few of them.
    """

    def prefix(df, name):
        keep = F.size("g") - F.floor((F.size("g") * num + of - 1) / of) + shared
        first = df.filter(F.size("g") >= shared).select(block, F.col("g").alias(f"g{name}"), F.col("n").alias(f"n{name}"), F.slice("o", 1, keep.cast("int")).alias(f"p{name}"))
        p = F.col(f"p{name}")
        if shared == 1:
            keys = F.transform(p, lambda g, i: F.struct(g.alias("gram"), (i + 1).alias(f"i{name}")))
        else:
            keys = F.flatten(F.transform(p, lambda g, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda h, j: F.struct(F.concat_ws("\n", g, h).alias("gram"), (i + j + 2).alias(f"i{name}")))))
        return first.select("*", F.inline(keys))

    sa, sb = F.size("ga"), F.size("gb")
    near = (sa * of >= sb * num) & (sb * of >= sa * num)
    rest = (shared + F.least(sa - F.col("ia"), sb - F.col("ib"))) * (num + of) >= (sa + sb) * num
    met = prefix(x, "a").join(prefix(y, "b"), [block, "gram"]).filter(near & rest & (F.array_join(F.slice(F.array_intersect("pa", "pb"), 1, shared), "\n") == F.col("gram")))
    return met.select(block, "ga", "gb", F.col("nb").alias("n"))


def _similar(met: DataFrame, num: int, den: int, dice: bool = False) -> DataFrame:
    """The pairs at num/den or above, with common, size_a and size_b."""
    met = met.withColumns({"common": overlap(F.col("ga"), F.col("gb")), "size_a": F.size("ga"), "size_b": F.size("gb")})
    both = F.col("size_a") + F.col("size_b")
    top, all_ = (2 * F.col("common"), both) if dice else (F.col("common"), both - F.col("common"))
    return met.filter(top * den >= all_ * num)


def trigram_sets(a: DataFrame, b: DataFrame, block: str, grams: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ids of a, ids of b, ordered sets of a, of b): rows (id, block, g) with any trigrams, and what ``meeting_pairs`` takes. a and b have id, text and the block column."""
    ids = lambda df: df.select("id", block, F.array_sort(grams).alias("g")).filter(F.size("g") > 0)
    x, y = ids(a), ids(b)
    freq = y.select(block, "g").distinct().select(block, F.explode("g").alias("gram")).groupBy(block, "gram").agg(F.count("*").alias("df"))
    return x, y, ordered_sets(x, freq, block), ordered_sets(y, freq, block)


def _named(ids: DataFrame, block: str, name: str) -> DataFrame:
    return ids.select(F.col("id").alias(f"{name}_id"), block, F.col("g").alias(f"g{name}"))


def fuzzy_join(cand: DataFrame, registry: DataFrame, block: str, k: int = 3, min_num: int = 3, den: int = 10, rounds=((9, 10, 2), (3, 4, 2), (1, 2, 1))) -> DataFrame:
    """(a_id, b_id, common, size_a, size_b, rank): the best k registry names of each candidate name above the similarity, by word trigrams (JN-7). Both: id, name, block.

    Equal names count once, however many rows have them. The similarity is lowered in ``rounds``: a name that has k rows at or above one of them has its
    k best there, and does not meet the many names that are less similar; only the others go on to the next round. So a name with near copies
    probes few trigrams, its rarest, however large the block is. A round is (numerator, denominator, trigrams that a pair meets at).
    """
    x, y, left, index = trigram_sets(cand, registry, block, word_trigrams(F.col("name")))
    left, index, parts = written(left), written(index), []
    for num, of, shared in (*[r for r in rounds if r[0] * den > min_num * r[1]], (min_num, den, 1)):
        met = _similar(meeting_pairs(left, index, block, num, of, shared), num, of)
        if (num, of) != (min_num, den):
            met = written(met)
            full = met.groupBy(block, "ga").agg(F.sum("n").alias("held")).filter(F.col("held") >= k).select(block, "ga")
            parts.append(met.join(full, [block, "ga"], "left_semi"))
            left = left.join(full.withColumnRenamed("ga", "g"), [block, "g"], "left_anti")
        else:
            parts.append(met.filter(F.col("common") * den > (F.col("size_a") + F.col("size_b") - F.col("common")) * min_num))
    met = reduce(DataFrame.unionByName, parts).drop("n")
    sim = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    # of rows with equal names the k smallest ids can be among the best; ranks hold for all candidates of one name
    best = met.join(top_k(_named(y, block, "b"), [block, "gb"], [F.col("b_id")], k), [block, "gb"])
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(block, "ga").orderBy(F.desc(sim), "b_id"))).filter(F.col("rank") <= k)
    return best.join(_named(x, block, "a"), [block, "ga"]).select("a_id", "b_id", "common", "size_a", "size_b", "rank")


def dice_join(a: DataFrame, b: DataFrame, block: str, min_num: int, den: int, stop=STOPWORDS) -> DataFrame:
    """Pairs whose normalised names are similar by Dice over trigrams of the padded whole name; equal names always are (JN-8)."""
    norm = name_norm(F.col("name"), stop)
    grams = F.when(norm != "", trigrams(F.concat(F.lit("  "), norm, F.lit(" ")))).otherwise(F.array().cast("array<string>"))
    x, y, xo, yo = trigram_sets(a, b, block, grams)
    met = _similar(meeting_pairs(xo, yo, block, min_num, 2 * den - min_num), min_num, den, dice=True).drop("n")  # the Dice bound as a Jaccard bound
    return met.join(_named(x, block, "a"), [block, "ga"]).join(_named(y, block, "b"), [block, "gb"]).select("a_id", "b_id", "common", "size_a", "size_b")


def split_matches(best: DataFrame, accept_num: int = 45, accept_den: int = 100) -> DataFrame:
    """Best hits with ``matched``: accepted, or kept as the closest miss (WIN-14)."""
    return best.filter("rank = 1").withColumn("matched", F.col("common") * accept_den >= (F.col("size_a") + F.col("size_b") - F.col("common")) * accept_num)


def press_items(df: DataFrame, domains: tuple[str, ...], k: int = 3) -> DataFrame:
    """The first k items on press domains, by query, then rank; a URL once (WIN-13). df: id, query, rank, url, title, snippet."""
    press = df.filter(base_domain(host_of(F.col("url"))).isin(*domains))
    once = top_k(press, ["id", "url"], [F.col("query"), F.col("rank")], 1)
    kept = once.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("query", "rank", "url"))).filter(F.col("pos") <= k)
    return kept.select("id", "pos", "url", F.substring("title", 1, 200).alias("title"), F.substring("snippet", 1, 280).alias("snippet"))


def search_texts(df: DataFrame, passes=("facebook", "instagram", "website", "press")) -> DataFrame:
    """(id, platform, query): one search text per entity and pass, quotes and parentheses taken out (PRJ-18)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"\([^)]*\)|[\"“”«»]", " "), r"\s+", " "))
    city = F.coalesce("city", F.lit(""))
    kinds = F.array(*[F.lit(p) for p in passes])
    quoted = F.concat(F.lit('"'), clean, F.lit('"'))
    text = F.when(F.col("platform") == "website", F.concat_ws(" ", clean, city)).when(F.col("platform") == "press", F.concat_ws(" ", quoted, city)).otherwise(F.concat_ws(" ", clean, city, F.col("platform")))
    return df.withColumn("platform", F.explode(kinds)).select("id", "platform", F.trim(text).alias("query"))


def auto_apply(cands: DataFrame, links: DataFrame, platforms=("facebook", "instagram", "linkedin", "donation")) -> DataFrame:
    """(id, platform, url): sure social candidates and the best site with the name in its domain; links that exist win (DEC-9)."""
    social = cands.filter((F.col("kind") == "social") & F.col("platform").isin(*platforms) & F.col("match_type").isin("slug", "title"))
    social = top_k(social, ["id", "platform"], [F.col("rank"), F.col("url")], 1).select("id", "platform", "url")
    site = top_k(cands.filter("kind = 'site' AND name_in_domain >= 1"), ["id"], [F.desc("score"), F.col("rank"), F.col("url")], 1).select("id", F.lit("website").alias("platform"), "url")
    new = social.unionByName(site).join(links.select("id", "platform"), ["id", "platform"], "left_anti")
    return links.select("id", "platform", "url").unionByName(new)
