"""Logs, sessions and replay over events; causal chains over conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import logs
from ..sources import table


def _events(spark, sf):
    return table(spark, sf, "events")


def session_windows(spark, sf):
    """Sessions of each user with gaps of at most 30 minutes."""
    rows = logs.sessions(_events(spark, sf), "user_id", "ts", 1800, "event_id")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


def rate_limited(spark, sf):
    """Events with more than one event of the user in the hour that ends with them."""
    return logs.over_rate(_events(spark, sf), "user_id", "ts", 3600, 1).select("event_id", "recent")


def replay_since(spark, sf):
    """Each user's events after the 50th."""
    return logs.sequence(_events(spark, sf), "user_id", "ts", "event_id").where("seq > 50").select("user_id", "seq", "event_id")


def ring_buffer(spark, sf):
    """Each user's five newest events in append order."""
    return logs.newest(_events(spark, sf), "user_id", 5, "ts", "event_id").select("user_id", "slot", "event_id")


def asof_state(spark, sf):
    """Each user's last value before 16 January 2024; users whose last event is an error are gone."""
    rows = _events(spark, sf).withColumn("removed", F.col("event_type") == "error")
    return logs.state_as_of(rows, "user_id", "value", "removed", F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "ts", "event_id")


def latency_percentiles(spark, sf):
    """Percentiles of the last 200 values of each type."""
    last = logs.latest_by(_events(spark, sf), ["event_type"], 200, "ts", "event_id")
    p = lambda q: F.round(F.percentile("value", q), 2)
    return last.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.max("value"), 2).alias("most"), F.count("*").alias("n"))


def telemetry_rollup(spark, sf):
    """Events by type, with users and mean value."""
    kind = F.coalesce("event_type", F.lit("untyped"))
    return _events(spark, sf).groupBy(kind.alias("event_type")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 4).alias("mean"))


def idempotent_events(spark, sf):
    """Events that a window of a day accepts for their user and type; repeats inside it don't renew it."""
    return logs.first_within(_events(spark, sf), ["user_id", "event_type"], "ts", 86400, "event_id").select("event_id")


def revisioned_state(spark, sf):
    """Each user's revision count and current type."""
    rows = logs.sequence(_events(spark, sf), "user_id", "ts", "event_id")
    return rows.groupBy("user_id").agg(F.max("seq").alias("revision"), F.max_by("event_type", "seq").alias("current"))


def unchanged_skip(spark, sf):
    """Events whose type differs from the user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf).withColumn("before", F.lag("event_type").over(w)).where("before is null or before <> event_type").select("event_id", "before")


def cursor_position(spark, sf):
    """A cursor per user over 17 slots that each event moves by its number k, with wrap."""
    step = F.get_json_object("props", "$.k").cast("long")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, sf).select("event_id", F.pmod(F.sum(step).over(w), F.lit(17)).alias("slot"))


def rollback_state(spark, sf):
    """Each user's value when all purchases are rolled back: the last event that isn't one."""
    kept = _events(spark, sf).where("event_type <> 'purchase'").withColumn("removed", F.lit(False))
    return logs.state_as_of(kept, "user_id", "value", "removed", F.lit(True), "ts", "event_id")


def review_queue(spark, sf):
    """Users whose last signup or error has no later purchase."""
    kind = F.col("event_type")
    opened, closed = F.max(F.when(kind.isin("signup", "error"), F.struct("ts", "event_id"))), F.max(F.when(kind == "purchase", F.struct("ts", "event_id")))
    last = _events(spark, sf).groupBy("user_id").agg(opened.alias("o"), closed.alias("c"))
    return last.where("o is not null and (c is null or c < o)").select("user_id", F.col("o.event_id").alias("event_id"))


def delta_ledger(spark, sf):
    """Each (user, type) ledger entry: times seen, last event, state of the last one."""
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    return _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), last.alias("last_event"))


def version_lineage(spark, sf):
    """Each turn's parent, role changes and depth from the root of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("parent"), (F.row_number().over(w) - 1).alias("depth"), (F.lag("role").over(w) == F.col("role")).alias("same_role"))


def ordered_log(spark, sf):
    """The newest 25 events, 10 skipped."""
    return _events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).offset(10).limit(25).select("event_id", "user_id")


QUERIES = {f.__name__: f for f in (session_windows, rate_limited, replay_since, ring_buffer, asof_state, latency_percentiles, telemetry_rollup, idempotent_events, revisioned_state, unchanged_skip, cursor_position, rollback_state, review_queue, delta_ledger, version_lineage, ordered_log)}

SQL = {
    "session_windows": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS total FROM h GROUP BY ALL""",
    "rate_limited": "SELECT event_id, recent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 1",
    "replay_since": "SELECT user_id, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq FROM events) WHERE seq > 50",
    "ring_buffer": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS slot, event_id FROM b WHERE back <= 5""",
    "asof_state": "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts < TIMESTAMP '2024-01-16') WHERE rn = 1 AND event_type <> 'error'",
    "latency_percentiles": """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 200)
        SELECT event_type, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99, round(max(value), 2) AS most, count(*) AS n FROM l GROUP BY event_type""",
    "telemetry_rollup": "SELECT coalesce(event_type, 'untyped') AS event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "idempotent_events": """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
        r AS (SELECT user_id, event_type, min((t, event_id)) AS x FROM e GROUP BY ALL
              UNION ALL SELECT r.user_id, r.event_type, min((e.t, e.event_id)) FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.t >= r.x[1] + 86400000000 GROUP BY ALL)
        SELECT x[2] AS event_id FROM r""",
    "revisioned_state": "SELECT user_id, count(*)::INT AS revision, arg_max(event_type, (ts, event_id)) AS current FROM events GROUP BY user_id",
    "unchanged_skip": "SELECT event_id, before FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type",
    "cursor_position": "SELECT event_id, ((sum((props->>'$.k')::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 17 + 17) % 17)::BIGINT AS slot FROM events",
    "rollback_state": "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'purchase') WHERE rn = 1",
    "review_queue": """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('signup', 'error')) WHERE rn = 1)
        SELECT user_id, event_id FROM o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.user_id AND e.event_type = 'purchase' AND (e.ts > o.ts OR (e.ts = o.ts AND e.event_id > o.event_id)))""",
    "delta_ledger": "SELECT user_id, event_type, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY ALL",
    "version_lineage": "SELECT conv_id, turn, lag(turn) OVER w AS parent, (row_number() OVER w - 1)::INT AS depth, lag(role) OVER w = role AS same_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "ordered_log": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 10",
}
