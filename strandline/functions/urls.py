"""URL normal forms and predicates as Column expressions; bad URLs give null or false, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import fixed

#: Query parameters dropped by prefix, section names whose numeric id makes the slug
#: redundant, paths that are no article, and patterns of list pages.
TRACKING_PREFIXES = ("utm_", "fbclid", "ref", "source", "spm", "from", "ncid")
ARTICLE_SECTIONS = ("news", "article", "articles", "story")
HOME_PATHS = ("", "/index.html", "/index.htm", "/home", "/default.aspx", "/index")
LIST_PAGES = (
    r"/index(_\d+)?\.(html?|php|jsp|aspx?)$",
    r"pageindex=\d+",
    r"/overview(\.html?|\.aspx?)?$",
    r"/sitemap",
    r"/wzdt_",
    r"sakuin\.pdf$",
    r"/category/",
    r"/channel/",
    r"/tag/",
    r"/topic/",
)


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(part(url, "HOST"))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without its end slash and redundant slug, query without tracking
    and blank parameters; scheme and fragment go."""
    place = F.regexp_replace(F.lower(part(url, "AUTHORITY")), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), r"/+$", "")
    path = F.regexp_replace(path, rf"/({'|'.join(ARTICLE_SECTIONS)})/(\d+)(/[^/]+)?$", "/$1/$2")
    tracked = rf"(?i)^({'|'.join(TRACKING_PREFIXES)})"
    kept = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p.rlike(r"^[^=]+=.+") & ~p.rlike(tracked))
    query = F.array_join(kept, "&")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.concat(place, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def is_article_url(url: Column) -> Column:
    """Whether a URL can be an article: a path that is neither a home page nor a list page."""
    path = F.regexp_replace(F.lower(F.coalesce(part(url, "PATH"), F.lit(""))), r"/+$", "")
    query = F.lower(F.coalesce(part(url, "QUERY"), F.lit("")))
    lists = "|".join(LIST_PAGES)
    return F.coalesce(host(url).isNotNull() & ~path.isin(*HOME_PATHS) & ~path.rlike(lists) & ~query.rlike(lists), F.lit(False))


def safe_link(url: Column, domains: Column | None = None) -> Column:
    """An https link without fragment, null unless it has no user, a host name, the usual port
    and, where ``domains`` (array) is given, a host inside one of them."""
    name = host(url)
    authority = F.lower(part(url, "AUTHORITY"))
    good = (part(url, "PROTOCOL") == "https") & ~authority.contains("@") & ~name.rlike(r"^[\d.]+$|^\[|:") & name.contains(".") & authority.rlike(r"^[^:]+(:443)?$")
    if domains is not None:
        good = good & F.exists(domains, lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d)))
    path = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), part(url, "QUERY")), F.lit(""))
    return F.when(good, F.concat(F.lit("https://"), name, path, query))


def is_official(url: Column, country: str | None = None, domains: dict[str, tuple[str, ...]] = fixed.OFFICIAL_DOMAINS) -> Column:
    """Whether a URL's host is a government's domain (``country``'s, or any) or lies below one."""
    known = domains.get(country, ()) if country else [d for own in domains.values() for d in own]
    return F.coalesce(F.arrays_overlap(host_suffixes(host(url)), F.array(*map(F.lit, known)).cast("array<string>")), F.lit(False))


def host_suffixes(name: Column) -> Column:
    """``a.b.c`` gives [a.b.c, b.c, c]: the equi-join form of a suffix match."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
