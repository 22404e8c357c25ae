"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of an address that say nothing about its page.
STOP_WORDS = (
    "http https www html htm php aspx jsp index amp ref utm id page pages com org net io co uk edu gov "
    "jpg jpeg png gif svg webp mp4 mp3 pdf static assets cdn images img media"
).split()


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def canonical_href(url: Column) -> Column:
    """Trimmed, trailing slashes cut (a single one stays), all before the query in lower case."""
    base = F.trim(url)
    base = F.when(F.length(base) > 1, F.regexp_replace(base, "/+$", "")).otherwise(base)
    route = F.regexp_extract(base, r"^([^?]*)", 1)
    return F.concat(F.lower(route), F.substring(base, F.length(route) + 1, F.length(base)))


def classify(url: Column) -> Column:
    return F.when(url.rlike(r"^(data|blob):"), "resource").when(url.rlike(r"^(//|http)"), "external").otherwise("internal")


def tokens(url: Column) -> Column:
    """Words of host, path and query, escapes removed."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"%[0-9A-Fa-f]{2}", " ")), F.lit("([a-z0-9]+)"))


def semantic_tokens(url: Column, most: int = 12) -> Column:
    """Distinct words before query and fragment that say something about the page, at most ``most``."""
    core = F.regexp_extract(url, r"^([^?#]*)", 1)
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    words = F.split(F.lower(core), r"[/?&#=.:_\-]+")
    kept = F.filter(F.array_distinct(words), lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\d+$") & ~F.array_contains(stop, x))
    return F.slice(kept, 1, most)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")
