"""References between regions, nations and customers, and rollbacks with reverse entries on the events as a log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import references
from ..sources import kept, table


def _concepts(spark, sf):
    """Customers refer to their nation by name, nations to their region by id, and a region to its first nation, which closes a circle."""
    t = lambda n: table(spark, sf, n)
    r, n, c = t("region"), t("nation"), t("customer")
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    first = n.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("first"))
    regions = r.join(first, r.r_regionkey == first.n_regionkey, "left").select(name("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.concat(F.col("r_name"), F.lit(" (led by {"), F.initcap("first"), F.lit("})")).alias("data"))
    nations = n.select(name("n", "n_nationkey"), F.col("n_name"), F.concat(F.lit("in {r"), F.col("n_regionkey").cast("string"), F.lit("}, {nobody}")))
    customers = c.join(n, c.c_nationkey == n.n_nationkey).select(name("c", "c_custkey"), F.lit(None), F.concat(F.lit("Lives {"), F.lower("n_name"), F.lit("} and pays in {1}")))
    return regions.union(nations).union(customers)


def resolved_references(spark, sf):
    """The texts of all concepts with their references resolved."""
    return references.resolved(_concepts(spark, sf))


def reference_cascade(spark, sf):
    """Everything that must be worked out again when a region changes, by distance."""
    regions = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return references.cascade(kept(_concepts(spark, sf)), regions)


def _log(spark, sf):
    """Events as edits of users, the type of the event replacing the one before; a purchase is caused by the user's event before it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events")
    cause = F.when(F.col("event_type") == "purchase", F.lag("event_id").over(w))
    return e.select(F.col("event_id").alias("edit_id"), "ts", F.lit("user").alias("actor"), F.col("user_id").alias("target"), F.lit("modify").alias("kind"), F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after"), cause.alias("causing_edit_id"))


def _first_errors(log):
    return log.where("after = 'error'").groupBy("target").agg(F.min("edit_id").alias("edit_id"))


def rollback_entries(spark, sf):
    """The entries that undoing each user's first error appends to the log."""
    log = kept(_log(spark, sf))
    return references.rollback_entries(log, _first_errors(log)).drop("ts")


def rollback_with_causes(spark, sf):
    """What users are once their first error, and what it caused, is undone."""
    log = kept(_log(spark, sf))
    return references.rolled_back_with_causes(log, _first_errors(log))


def undo_candidates(spark, sf):
    """The edit of each user that undoing would take back next, once the first errors are undone."""
    log = kept(_log(spark, sf))
    whole = log.unionByName(references.rollback_entries(log, _first_errors(log)))
    return references.last_edits(whole)


QUERIES = {f.__name__: f for f in (resolved_references, reference_cascade, rollback_entries, rollback_with_causes, undo_candidates)}

_LOG = """l AS (SELECT event_id AS edit_id, user_id AS target, lag(event_type) OVER w AS before, event_type AS after, CASE WHEN event_type = 'purchase' THEN lag(event_id) OVER w END AS cause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    x AS (SELECT target, min(edit_id) AS edit_id FROM l WHERE after = 'error' GROUP BY target)"""
_LED = "f AS (SELECT n_regionkey AS k, arg_min(n_name, n_nationkey) AS first FROM nation GROUP BY n_regionkey)"

SQL = {
    "resolved_references": f"""WITH {_LED}, r AS (SELECT r_regionkey AS k, r_name, first, upper(left(first, 1)) || lower(first[2:]) AS shown FROM region JOIN f ON k = r_regionkey)
        SELECT 'r' || k AS id, r_name || ' (led by in ' || r_name || ' (led by {{' || shown || '}}), {{nobody}})' AS text FROM r
        UNION ALL SELECT 'n' || n_nationkey, 'in ' || r_name || ' (led by in {{r' || k || '}}, {{nobody}}), {{nobody}}' FROM nation JOIN r ON k = n_regionkey
        UNION ALL SELECT 'c' || c_custkey, 'Lives in ' || r_name || ' (led by ' || CASE WHEN n_name = first THEN '{{' || shown || '}}' ELSE 'in {{r' || k || '}}, {{nobody}}' END || '), {{nobody}} and pays in {{1}}'
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN r ON k = n_regionkey""",
    "reference_cascade": f"""WITH RECURSIVE {_LED}, e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || n_nationkey, 'r' || k FROM f JOIN nation ON n_name = first
            UNION SELECT 'n' || n_nationkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
        p AS (SELECT 'r' || r_regionkey AS origin, 'r' || r_regionkey AS node, 0 AS d FROM region UNION SELECT origin, dst, d + 1 FROM p JOIN e ON node = src WHERE d < 16)
        SELECT origin, node, min(d)::INT AS distance FROM p WHERE node <> origin GROUP BY ALL""",
    "rollback_entries": f"""WITH {_LOG} SELECT l.edit_id + (SELECT max(edit_id) + 1 - min(edit_id) FROM l) AS edit_id, 'system:rollback' AS actor, l.target, 'rollback' AS kind, after AS before, before AS after, l.edit_id AS causing_edit_id FROM l JOIN x USING (edit_id)""",
    "rollback_with_causes": f"""WITH {_LOG}, u AS (SELECT l.*, edit_id IN (SELECT edit_id FROM x) OR coalesce(cause IN (SELECT edit_id FROM x), false) AS undone FROM l)
        SELECT target, CASE WHEN count(*) FILTER (undone) > 0 THEN (list(before ORDER BY edit_id) FILTER (undone))[1] ELSE arg_max(after, edit_id) END AS state, count(*) FILTER (undone) AS n_undone FROM u GROUP BY target""",
    "undo_candidates": f"WITH {_LOG} SELECT target, max(edit_id) AS edit_id FROM l WHERE edit_id NOT IN (SELECT edit_id FROM x) GROUP BY target",
}
