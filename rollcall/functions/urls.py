"""URL columns: hosts, completion, canonical pages of social platforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts of the platforms; top-level domains that are looked for in running text.
PLATFORMS = {
    "facebook.com": "facebook",
    "fb.com": "facebook",
    "instagram.com": "instagram",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "linkedin.com": "linkedin",
    "youtube.com": "youtube",
    "youtu.be": "youtube",
    "tiktok.com": "tiktok",
    "helloasso.com": "donation",
}
TOP_LEVELS = ("fr", "com", "org", "net", "bzh", "eu", "info")


@dataclass(frozen=True)
class PageRule:
    """Where a platform's URLs name an organisation's page: a pattern of the path, the group that is the name, and the page built from the groups.

    ``refused``: first path words that are no pages. ``loose``: the pattern of the variant that takes any name.
    """

    platform: str
    path: str
    page: str
    group: int = 1
    refused: str = ""
    loose: str = ""
    unlike: str = ""

    def pattern(self, strict: bool) -> str:
        words = f"(?!(?:{self.refused})(?:/|$))" if self.refused else ""
        return f"^/+{words}{self.path if strict or not self.loose else self.loose}"


# Names of four characters or more, no numbers of six digits or more, and the platforms' own path words and page roots.
_NAME = "(?![0-9]{6,}(?:/|$))([^/]{4,})"
PAGE_RULES = (
    PageRule("facebook", "(?:pages/+(?=[^/]+/+[^/]))?" + _NAME, "https://www.facebook.com/$1/", refused=r"people|groups|events|posts|photos?|videos|watch|share|login|hashtag|story|[^/]*\.php", loose="(?:pages/+(?=[^/]+/+[^/]))?([^/]+)"),
    PageRule("instagram", "([^/]{4,})", "https://www.instagram.com/$1/", refused="p|reels?|explore|stories|tv", loose="([^/]+)"),
    PageRule("linkedin", "(company|school)/+([^/]+)", "https://www.linkedin.com/$1/$2/", 2, loose="(company|school|in)/+([^/]+)"),
    PageRule("youtube", "(?=@|(?:c|channel|user)(?:/|$))(?:.*/)?@*([^/]+)/*$", "", unlike="watch?v="),
    PageRule("tiktok", "@+([^/]{4,})", "https://www.tiktok.com/@$1"),
    PageRule("twitter", "([^/]+)", "https://twitter.com/$1", refused="search|hashtag|i|intent|home"),
    PageRule("donation", "(?:[^/]+/+)*?associations/+([^/]+)", "https://www.helloasso.com/associations/$1"),
)


def bare_domain(top_levels: tuple[str, ...] = TOP_LEVELS) -> str:
    """A pattern of domains without scheme in running text."""
    return rf"(?i)\b([a-z0-9][a-z0-9-]{{1,40}}\.(?:{'|'.join(top_levels)}))\b"


def host_of(col: Column) -> Column:
    """The lower-case host without a leading ``www.``; empty if there is none (PRJ-12)."""
    return F.regexp_replace(F.coalesce(F.lower(F.try_parse_url(col, F.lit("HOST"))), F.lit("")), r"^www\.", "")


def base_domain(host: Column) -> Column:
    """The last two labels (PRJ-12)."""
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(host)


def complete_url(col: Column) -> Column:
    """Trimmed, blank as null, ``https://`` put before a URL without scheme (PRJ-13)."""
    url = F.nullif(F.trim(col), F.lit(""))
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def safe_site(social_site: Column, website: Column) -> Column:
    """The served site if it is http(s) (PRJ-27)."""
    url = F.coalesce(F.nullif(social_site, F.lit("")), website)
    return F.when(url.rlike("(?i)^https?://"), url)


def path_parts(col: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(col, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")


def platform_of(url: Column) -> Column:
    """The platform of a URL by its base domain, null for other hosts."""
    known = F.create_map(*[F.lit(x) for pair in PLATFORMS.items() for x in pair])
    return F.try_element_at(known, base_domain(host_of(url)))


def canonical_social(df: DataFrame, url: str = "url", strict: bool = True, rules: tuple[PageRule, ...] = PAGE_RULES) -> DataFrame:
    """``df`` with platform, slug and page: the root page of a social link, and only rows that have one (PRJ-14).

    ``strict`` also refuses numeric ids of six digits or more, short names and personal profiles.
    """
    link, path = F.col(url), F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    df = df.withColumn("platform", platform_of(link))
    found = F.lit(None).cast("struct<slug:string,page:string>")
    for r in rules:
        pattern = r.pattern(strict)
        slug = F.regexp_extract(path, pattern, r.group)
        page = F.regexp_replace(path, f"{pattern}.*$", r.page) if r.page else link
        fits = (F.col("platform") == r.platform) & (slug != "")
        if r.unlike:
            fits &= ~F.contains(link, F.lit(r.unlike))
        found = F.when(fits, F.struct(slug.alias("slug"), page.alias("page"))).otherwise(found)
    return df.withColumn("_found", found).filter("_found IS NOT NULL").withColumns({"slug": F.col("_found.slug"), "page": F.col("_found.page")}).drop("_found")


def domain_mentions(df: DataFrame, id_: str, *texts: str, top_levels: tuple[str, ...] = TOP_LEVELS) -> DataFrame:
    """(id, domain): distinct bare domains of the given top-level domains in the texts (PRJ-23)."""
    return df.select(id_, F.explode(F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(bare_domain(top_levels)), 1)).alias("d")).select(id_, F.lower("d").alias("domain")).distinct()


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_blocked(df: DataFrame, hosts: DataFrame, url: str, id_: str) -> DataFrame:
    """Rows of ``df`` whose host or a parent of it is in ``hosts`` (host); joined by suffix, so the list may be long (FLT-10)."""
    met = df.select(id_, F.explode(host_suffixes(host_of(F.col(url)))).alias("host")).join(hosts.select("host"), "host", "left_semi").select(id_).distinct()
    return df.join(met, id_, "left_semi")


def html_only(df: DataFrame, url: str) -> DataFrame:
    """Rows whose URL is no PDF (FLT-11)."""
    return df.filter(~F.lower(F.col(url)).endswith(".pdf"))
