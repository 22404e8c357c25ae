"""URL functions over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..sources import table


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


def domain_of(spark, sf):
    """Each page's domain, canonical address and class."""
    url = F.col("url")
    return _pages(spark, sf).select("page_id", U.domain(url).alias("domain"), U.canonical_href(url).alias("href"), U.classify(url).alias("kind"))


def domain_pages(spark, sf):
    """Pages and paths of each domain."""
    url = F.col("url")
    return _pages(spark, sf).groupBy(U.domain(url).alias("domain")).agg(F.count("*").alias("n"), F.countDistinct(U.path(url)).alias("n_paths"), F.max(F.size(U.path_segments(url))).alias("depth"))


def url_path_tree(spark, sf):
    """Nodes of each domain's tree of path segments: parent and pages below."""
    rows = _pages(spark, sf).select(U.domain(F.col("url")).alias("domain"), U.path_segments(F.col("url")).alias("parts"))
    rows = rows.select("domain", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")).where("depth >= 1 and size(parts) > 0")
    node = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/"))
    rows = rows.select("domain", "depth", node(F.col("depth")).alias("path"), node(F.col("depth") - 1).alias("parent"))
    return rows.groupBy("domain", "depth", "path", "parent").agg(F.count("*").alias("n"))


def url_tokens(spark, sf):
    """Words of each address, and those that say something."""
    url = F.col("url")
    return _pages(spark, sf).select("page_id", F.array_join(U.tokens(url), " ").alias("tokens"), F.array_join(U.semantic_tokens(url), " ").alias("semantic"))


def page_profile(spark, sf):
    """Length, digest and link count of each page, straight from the html."""
    html = F.coalesce("html", F.lit(""))
    rows = table(spark, sf, "pages")
    return rows.select("page_id", F.length(html).alias("n_chars"), F.substring(F.sha2(F.encode(html, "UTF-8"), 256), 1, 16).alias("snapshot"), F.size(F.regexp_extract_all(html, F.lit("(<a )"))).alias("n_links"), F.size(F.regexp_extract_all(html, F.lit("(<p>)"))).alias("n_paragraphs"))


def link_targets(spark, sf):
    """Targets of links by class and number of pages."""
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'))).alias("href"))
    return rows.groupBy(U.classify(F.col("href")).alias("kind"), U.canonical_href(F.col("href")).alias("href")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


QUERIES = {f.__name__: f for f in (domain_of, domain_pages, url_path_tree, url_tokens, page_profile, link_targets)}

_D, _P = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)", "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_HREF = "lower(regexp_extract(b, '^([^?]*)', 1)) || substr(b, length(regexp_extract(b, '^([^?]*)', 1)) + 1)"
_BASE = "CASE WHEN length(trim({0})) > 1 THEN regexp_replace(trim({0}), '/+$', '') ELSE trim({0}) END AS b"
_STOP = ", ".join(f"'{x}'" for x in U.STOP_WORDS)
_KIND = "CASE WHEN regexp_matches({0}, '^(data|blob):') THEN 'resource' WHEN regexp_matches({0}, '^(//|http)') THEN 'external' ELSE 'internal' END"
_SEG = f"list_filter(string_split({_P}, '/'), lambda x: x <> '')"
_TOK = "regexp_extract_all(lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '%[0-9A-Fa-f][0-9A-Fa-f]', ' ', 'g')), '[a-z0-9]+')"

SQL = {
    "domain_of": f"SELECT page_id, {_D} AS domain, {_HREF} AS href, {_KIND.format('url')} AS kind FROM (SELECT *, {_BASE.format('url')} FROM pages)",
    "domain_pages": f"SELECT {_D} AS domain, count(*) AS n, count(DISTINCT {_P}) AS n_paths, max(len({_SEG}))::INT AS depth FROM pages GROUP BY 1",
    "url_path_tree": f"""WITH s AS (SELECT {_D} AS domain, {_SEG} AS parts FROM pages), r AS (SELECT domain, parts, unnest(range(1, len(parts) + 1)) AS depth FROM s)
        SELECT domain, depth::INT AS depth, '/' || array_to_string(parts[1:depth], '/') AS path, '/' || coalesce(array_to_string(parts[1:depth - 1], '/'), '') AS parent, count(*) AS n FROM r GROUP BY ALL""",
    "url_tokens": f"""SELECT page_id, array_to_string({_TOK}, ' ') AS tokens,
        coalesce(array_to_string((WITH x AS (SELECT t, min(i) AS i FROM (SELECT unnest(p) AS t, generate_subscripts(p, 1) AS i) GROUP BY t) SELECT list(t ORDER BY i) FROM x
            WHERE length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP}))[1:12], ' '), '') AS semantic
        FROM (SELECT *, regexp_split_to_array(lower(regexp_extract(url, '^([^?#]*)', 1)), '[/?&#=.:_-]+') AS p FROM pages)""",
    "page_profile": "SELECT page_id, length(h)::INT AS n_chars, substr(sha256(h), 1, 16) AS snapshot, len(regexp_extract_all(h, '<a '))::INT AS n_links, len(regexp_extract_all(h, '<p>'))::INT AS n_paragraphs FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)",
    "link_targets": f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), c AS (SELECT *, {_BASE.format('href')} FROM l)
        SELECT {_KIND.format('href')} AS kind, {_HREF} AS href, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM c GROUP BY 1, 2""",
}
