"""XPath algebra on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generalise(xp: Column) -> Column:
    """Indices stripped."""
    return F.regexp_replace(xp, r"\[\d+\]", "")


def segments(xp: Column) -> Column:
    return F.filter(F.split(xp, "/"), lambda x: x != "")


def depth(xp: Column) -> Column:
    return F.size(segments(xp))


def parent(xp: Column) -> Column:
    """The last segment dropped; the parent of a first segment is ``/``."""
    cut = F.regexp_replace(xp, r"/[^/]*$", "")
    return F.when(cut == "", "/").otherwise(cut)


def prefixes(xp: Column) -> Column:
    """All prefixes, the path itself last."""
    parts = segments(xp)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))


def ancestors(xp: Column) -> Column:
    """The strict prefixes of a path that begins with / and has no empty segments, the longest last; null if there are none."""
    level = F.regexp_count(xp, F.lit("/"))
    return F.when(level > 1, F.transform(F.sequence(F.lit(2), level), lambda i: up_to(xp, i)))


def up_to(xp: Column, n: Column) -> Column:
    """What comes before the n-th slash of a path, or all of it: with n - 1 the number of segments."""
    return F.call_function("substring_index", xp, F.lit("/"), n)


def is_ancestor(a: Column, d: Column) -> Column:
    """a is a strict prefix of d that ends at a segment."""
    return (a != "") & d.startswith(F.concat(a, F.lit("/")))


def relative(xp: Column, ancestor: Column) -> Column:
    return F.when(is_ancestor(ancestor, xp), F.substring(xp, F.length(ancestor) + 2, F.length(xp)))


def last_segments(xp: Column, n: int = 3) -> Column:
    """The last n segments, with ``…/`` before them if some are cut."""
    parts = segments(xp)
    return F.when(F.size(parts) > n, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -n, n), "/"))).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))
