"""Fields of repeating page elements: accessors relative to a pattern, their trie, and the instances that they read.

A pattern is a path without indices.  An accessor is the last tag of the pattern, the path below it and an address:
``/li/a/@href``, ``/li/a/text()``.  Values are tied to the instance that holds them by the prefix of their path at the
pattern's depth, so this is an equality join and a page's nodes never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import xpath as X
from ..sources import kept, kept_large, side

#: Attributes whose value is an address, and those whose value is read by people.
URL_ATTRIBUTES = "href src srcset poster data-src data-lazy-src data-original data-original-src data-image xlink:href".split()
LABEL_ATTRIBUTES = "title aria-label alt placeholder aria-roledescription".split()
#: Elements whose text isn't content, and those that aren't instances of anything.
SILENT = ("script", "style")
FRAME = ("#document", "html", "head", "body")


def readable(rows: DataFrame) -> DataFrame:
    """Node tables with what is looked up below instead of texts and attributes: ``gx``, the path without indices, and ``found``, the (address, value) of each node.

    The functions below make both themselves where they are missing."""
    text = F.struct(F.lit("text()").alias("address"), F.when(~F.col("tag").isin(*SILENT), F.trim("text")).alias("value"))
    named = F.transform(F.filter(F.map_entries("attrs"), lambda x: x.key.isin(*URL_ATTRIBUTES, *LABEL_ATTRIBUTES)), lambda x: F.struct(F.concat(F.lit("@"), x.key).alias("address"), F.trim(x.value).alias("value")))
    found = F.filter(F.concat(F.array(text), F.coalesce(named, F.array())), lambda x: F.coalesce(x.value != "", F.lit(False)))
    return rows.select("page_id", "node_id", "tag", "xpath", "height", X.generalise(F.col("xpath")).alias("gx"), found.alias("found"))


def _readable(rows: DataFrame) -> DataFrame:
    return rows if "found" in rows.columns else readable(rows)


def contents(rows: DataFrame) -> DataFrame:
    """(page_id, node_id, xpath, gx, address, value): the text and the address and label attributes of each node, trimmed; empty ones are left out."""
    return _readable(rows).select("page_id", "node_id", "xpath", "gx", F.explode("found").alias("x")).select("page_id", "node_id", "xpath", "gx", "x.address", "x.value")


def patterns(rows: DataFrame, least: int = 2, least_height: int = 1) -> DataFrame:
    """(page_id, pattern, n): paths without indices that several elements of a page share, some of them with children."""
    own = _readable(rows).where(~F.col("tag").isin(*FRAME)).groupBy("page_id", F.col("gx").alias("pattern"))
    return own.agg(F.count("*").alias("n"), F.max("height").alias("height")).where((F.col("n") >= least) & (F.col("height") >= least_height)).select("page_id", "pattern", "n")


def _accessor(pattern: Column, path: Column, address: Column) -> Column:
    """The last tag of the pattern, what follows it in a path without indices, and the address."""
    return F.concat(F.lit("/"), F.element_at(F.split(pattern, "/"), -1), F.substring(path, F.length(pattern) + 1, F.length(path)), F.lit("/"), address)


def _instances(paths: DataFrame, chosen: DataFrame, *key: str) -> DataFrame:
    """(key..., pattern): each of ``paths`` (with ``gx``, a path without indices) with each chosen pattern that it begins with."""
    depth = F.regexp_count("gx", F.lit("/"))
    tops = paths.where(depth > 0).select(*paths.columns, F.explode(F.sequence(F.lit(1), depth)).alias("level"))
    return tops.withColumn("pattern", X.up_to(F.col("gx"), F.col("level") + 1)).join(chosen, [*key, "pattern"])


def _read(values: DataFrame, levels: DataFrame, *on: str) -> DataFrame:
    """``instance_values`` of ``values`` (contents with ``gx``), given the ``levels`` of the patterns that hold each path."""
    # what groups by instance or accessor afterwards finds a page's values in one place already, and they are moved before there is one for each level
    held = values.join(levels, [*on]).repartition("page_id").withColumn("level", F.explode("levels"))
    pattern, instance = (X.up_to(F.col(x), F.col("level") + 1) for x in ("gx", "xpath"))
    held = held.withColumns({"pattern": pattern, "instance": instance})
    return held.select("page_id", "pattern", "instance", "node_id", _accessor(F.col("pattern"), F.col("gx"), F.col("address")).alias("accessor"), "value")


def instance_values(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page_id, pattern, instance, node_id, accessor, value) of all that the instances of a page's patterns hold.

    ``chosen`` has (page_id, pattern). Patterns are looked up once for each path without indices of a page, however many nodes share it."""
    values, chosen = contents(rows), chosen.select("page_id", "pattern").distinct()
    levels = _instances(values.select("page_id", "gx").distinct(), chosen, "page_id").groupBy("page_id", "gx").agg(F.collect_list("level").alias("levels"))
    return _read(values, levels.hint("merge"), "page_id", "gx")


def learned(rows: DataFrame, chosen: DataFrame, *key: str) -> DataFrame:
    """``accessors`` of ``instance_values``, from paths without indices alone: neither instances nor values are made."""
    found = _instances(contents(rows).select("page_id", "gx", "address").distinct(), chosen.select("page_id", "pattern").distinct(), "page_id")
    return found.select(*key, "pattern", _accessor(F.col("pattern"), F.col("gx"), F.col("address")).alias("accessor")).distinct()


def _collected(values: DataFrame, distinct: bool) -> DataFrame:
    """(page_id, pattern, instance, fields): for each instance a map from accessor to its values, both in page order."""
    key = ["page_id", "instance"]  # the instance fixes the pattern
    lists = values.groupBy(*key, "accessor").agg(F.array_sort(F.collect_list(F.struct("node_id", "value"))).alias("found"))
    texts = F.transform("found", lambda x: x.value)
    lists = lists.select(*key, F.col("found")[0].node_id.alias("first"), "accessor", (F.array_distinct(texts) if distinct else texts).alias("values"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("first", "accessor", "values"))), lambda x: F.struct(x.accessor, x["values"]))
    return lists.groupBy(*key).agg(F.map_from_entries(entries).alias("fields")).select("page_id", X.generalise(F.col("instance")).alias("pattern"), "instance", "fields")


def summary_fields(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(page_id, pattern, instance, fields): distinct values of each accessor of each instance that holds any."""
    return _collected(instance_values(rows, chosen), distinct=True)


def accessors(values: DataFrame, *key: str) -> DataFrame:
    """The distinct accessors of each pattern (and further key columns), from ``instance_values``."""
    return values.select(*key, "pattern", "accessor").distinct()


def extraction_trie(routes: DataFrame, *key: str) -> DataFrame:
    """(key..., pattern, above, step, is_leaf): the accessors of each pattern as a trie whose chains are one step.

    ``above`` is the path to a trie node ('' at the top) and ``step`` leads on from it. An address (``text()`` or
    ``@attribute``) is a step of its own; tags are joined as long as only one other tag follows."""
    key = (*key, "pattern")
    steps = routes.select(*key, "accessor", F.posexplode(F.split(F.substring("accessor", 2, F.length("accessor")), "/")).alias("i", "next"))
    path = F.when(F.col("i") > 0, X.up_to(F.col("accessor"), F.col("i") + 1)).otherwise("")
    edges = kept_large(steps.select(*key, path.alias("path"), "next", (F.col("i") == F.regexp_count("accessor", F.lit("/")) - 1).alias("last")).distinct())
    ends = edges.groupBy(*key, "path").agg(F.count("*").alias("n"), F.max("last").alias("last")).where("path = '' or n > 1 or last").select(*key, "path")
    # leaves hang on the path before them; every other end hangs on the longest end before it
    leaves = edges.where("last").select(*key, F.col("path").alias("above"), F.col("next").alias("step"), F.lit(True).alias("is_leaf"))
    pre = F.concat(F.array(F.lit("")), F.coalesce(X.ancestors(F.col("path")), F.array().cast("array<string>")))
    up = ends.where("path <> ''").select(*key, "path", F.explode(pre).alias("above")).join(ends.withColumnRenamed("path", "above"), [*key, "above"]).groupBy(*key, "path").agg(F.max_by("above", F.length("above")).alias("above"))
    return leaves.union(up.select(*key, "above", F.substring("path", F.length("above") + 1, F.length("path")).alias("step"), F.lit(False)))


def pattern_query(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """(page_id, pattern, instance, fields): all subtrees of any page that match a pattern, with what its accessors find there.

    ``routes`` has (pattern, accessor), learned on whatever pages. Instances where no accessor finds a value are left out."""
    routes, values = routes.select("pattern", "accessor").distinct(), contents(rows)
    # every prefix of a path is an element's, so patterns and accessors are looked up once for each path and address of all pages
    found = _instances(values.select("gx", "address").distinct(), routes.select("pattern").distinct())
    found = found.withColumn("accessor", _accessor(F.col("pattern"), F.col("gx"), F.col("address"))).join(routes, ["pattern", "accessor"])
    levels = kept(found.groupBy("gx", "address").agg(F.collect_list("level").alias("levels")))
    return _collected(_read(values, side(levels), "gx", "address"), distinct=False)


# ---- what fields say


def _address_of(key: Column) -> Column:
    return F.lower(F.regexp_extract(key, r"([^/]+)/*$", 1))


def leaf_kind(key: Column) -> Column:
    """url, label or text by the end of an accessor; null for anything else."""
    end = _address_of(key)
    return F.when(end == "text()", "text").when(end.isin(*[f"@{a}" for a in URL_ATTRIBUTES]), "url").when(end.isin(*[f"@{a}" for a in LABEL_ATTRIBUTES]), "label")


def _plain(value: Column) -> Column:
    """Markup out, white space collapsed; a sign < that begins no tag stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"<[a-zA-Z!/][^>]*>", " "), r"\s+", " "))


def content_tree(fields: Column) -> Column:
    """A map of accessors to values as lines: addresses first, then texts and labels, each in its order; null and empty maps give ''.

    Each accessor gives its first value that isn't empty. Texts and labels whose words all occur in a longer one, or repeat an
    earlier one, are dropped, as are repeated addresses. Data addresses are cut to their media type. A line that ends
    in a colon takes up the next."""
    value = lambda e: F.coalesce(F.get(F.filter(F.transform(e.value, _plain), lambda v: v != ""), 0), F.lit(""))
    units = F.transform(F.map_entries(fields), lambda e: F.struct(leaf_kind(e.key).alias("kind"), value(e).alias("value")))
    units = F.filter(units, lambda u: u.kind.isNotNull() & (u.value != ""))
    return F.coalesce(_once(units, _lines), F.lit(""))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), 0)


def _lines(units: Column) -> Column:
    media = lambda v: F.regexp_extract(v, "^data:([^;,]*)[;,]", 1)
    short = lambda v: F.when(v.rlike("^data:[^;,]*[;,]"), F.concat(F.lit("data:"), F.when(media(v) == "", "inline").otherwise(media(v)))).otherwise(v)
    addresses = F.array_distinct(F.transform(F.filter(units, lambda u: u.kind == "url"), lambda u: short(u.value)))
    words = lambda v: F.array_distinct(F.regexp_extract_all(F.lower(v), F.lit(r"([\p{L}\p{N}]+)")))
    said = F.transform(F.filter(units, lambda u: u.kind != "url"), lambda u, i: F.struct(i.alias("i"), u.value.alias("value"), words(u.value).alias("words")))
    covers = lambda a, b: (F.size(a.words) >= F.size(b.words)) & ((F.size(a.words) > F.size(b.words)) | (a.i < b.i)) & (F.size(F.array_except(b.words, a.words)) == 0)
    kept = _once(said, lambda s: F.filter(s, lambda u: (F.size(u.words) == 0) | ~F.exists(s, lambda o: covers(o, u))))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("open"))
    added = lambda s, u: F.when(
        s.open, F.struct(F.concat(F.slice(s.lines, F.lit(1), F.size(s.lines) - 1), F.array(F.concat(F.element_at(s.lines, -1), F.lit(" "), u.value))).alias("lines"), F.lit(False).alias("open"))
    ).otherwise(F.struct(F.array_append(s.lines, u.value).alias("lines"), u.value.endswith(":").alias("open")))
    return F.array_join(F.concat(addresses, F.aggregate(kept, start, added, lambda s: s.lines)), "\n")


def field_text(fields: Column) -> Column:
    """A map of accessors to values as one line: texts and labels as they are, addresses by their words that say something."""
    of = lambda key, v: F.when(leaf_kind(key) == "url", F.array_join(F.slice(U.semantic_tokens(v), 1, 8), " ")).otherwise(T.normalised(v))
    parts = F.flatten(F.transform(F.map_entries(fields), lambda e: F.transform(e.value, lambda v: of(e.key, v))))
    return F.coalesce(F.array_join(F.filter(parts, lambda x: x != ""), " "), F.lit(""))


def rendered_instances(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """(page_id, pattern, instance, fields, text, lines): instances as fields, as one line and as a content tree."""
    found = pattern_query(rows, routes)
    return found.withColumns({"text": field_text(F.col("fields")), "lines": content_tree(F.col("fields"))})
