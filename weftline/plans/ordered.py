"""Debounce, rates and chunk states over events: the batch twins of the streams in ``streaming.state``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs, ordered
from ..sources import table

HOUR = 3_600_000_000
TICKS = ordered.Ticks(2 * HOUR, 2, 24 * HOUR)
SPAWNS = ordered.Admissions(3, 24 * HOUR)


def _events(spark, sf):
    return table(spark, sf, "events")


def settled_bursts(spark, sf):
    """Each user's bursts of events, settled once two hours have passed without one; windows do it without Python."""
    rows = logs.sessions(_events(spark, sf).where("ts is not null"), "user_id", "ts", 7200, "event_id")  # a gap of just two hours is in the burst
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    return rows.groupBy("user_id", "session").agg((F.max(logs.micros("ts")) + 2 * HOUR).alias("settled_us"), last.alias("event_id"), F.count("*").alias("n"))


def cascade_ticks(spark, sf):
    """Ticks two hours after each user's last event, of which a day has at most two, and the events rejected for it."""
    rows = ordered.in_order(_events(spark, sf), "user_id", "ts", "event_id", TICKS)
    return rows.select("user_id", "kind", F.unix_micros("at").alias("at_us"), "event_id", "n")


def spawn_admissions(spark, sf):
    """The events that a limit of three accepted ones in a day accepts for their user, and those it rejects."""
    return ordered.in_order(_events(spark, sf), "user_id", "ts", "event_id", SPAWNS).select("event_id", "kind")


def _chunks(spark, sf):
    """A chunk for each user and day, whose members are the types of the day's events."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = _events(spark, sf).where("ts is not null and event_type is not null").groupBy("user_id", day.alias("chunk_id"))
    return rows.agg(F.min("event_id").alias("seq"), F.collect_set("event_type").alias("members")).select("seq", F.col("user_id").cast("string").alias("pattern"), "chunk_id", "members")


def absorbed_chunks(spark, sf):
    """What each day's chunk does to the chunk of its user that stands."""
    return ordered.absorbed(_chunks(spark, sf))


def chunk_ledger(spark, sf):
    """The chunks that stand in the end."""
    return ordered.ledger(absorbed_chunks(spark, sf))


def absorb_payloads(spark, sf):
    """The changes among them as flat messages; null fields are left out."""
    rows = absorbed_chunks(spark, sf).where("kind <> 'unchanged'")
    message = F.to_json(F.struct(F.concat(F.lit("chunk_"), "kind").alias("type"), F.col("pattern").alias("url"), "chunk_id", "replaced_chunk_id", "n_members"))
    return rows.select("seq", message.alias("payload"))


QUERIES = {f.__name__: f for f in (settled_bursts, cascade_ticks, spawn_admissions, absorbed_chunks, chunk_ledger, absorb_payloads)}

_EVENTS = """e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
    FROM events WHERE ts IS NOT NULL)"""
_TICKS = f"""r AS (
    SELECT user_id, rn, t, event_id, t + {TICKS.quiet} AS due, event_id AS last, 1 AS n, []::BIGINT[] AS ticks, false AS no, NULL::BIGINT AS fired, NULL::BIGINT AS fired_id, NULL::INT AS fired_n
    FROM e WHERE rn = 1
    UNION ALL
    SELECT user_id, rn, t, event_id,
           CASE WHEN no THEN CASE WHEN out THEN NULL ELSE due END ELSE t + {TICKS.quiet} END,
           CASE WHEN no THEN last ELSE event_id END,
           CASE WHEN out THEN 0 ELSE n END + CASE WHEN no THEN 0 ELSE 1 END,
           recent, no, CASE WHEN out THEN due END, CASE WHEN out THEN last END, CASE WHEN out THEN n END
    FROM (SELECT *, len(recent) >= {TICKS.most} AS no FROM (
          SELECT e.*, r.due, r.last, r.n, coalesce(r.due <= e.t, false) AS out,
                 list_filter(CASE WHEN r.due <= e.t THEN list_append(r.ticks, r.due) ELSE r.ticks END, lambda x: e.t - x < {TICKS.window}) AS recent
          FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))"""
_SPAWNS = f"""r AS (
    SELECT user_id, rn, event_id, [t] AS taken, true AS yes FROM e WHERE rn = 1
    UNION ALL
    SELECT user_id, rn, event_id, CASE WHEN len(recent) < {SPAWNS.most} THEN list_append(recent, t) ELSE recent END, len(recent) < {SPAWNS.most}
    FROM (SELECT e.*, list_filter(r.taken, lambda x: e.t - x < {SPAWNS.window}) AS recent FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))"""
_ABSORBED = """c AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY seq, chunk_id) AS rn FROM (
        SELECT min(event_id) AS seq, user_id::VARCHAR AS pattern, strftime(ts, '%Y-%m-%d') AS chunk_id, list(DISTINCT event_type) AS members
        FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)),
    r AS (
        SELECT pattern, rn, seq, chunk_id AS given, chunk_id AS stands, members AS held, 'added' AS kind, NULL::VARCHAR AS replaced, false AS beside, len(members) AS size FROM c WHERE rn = 1
        UNION ALL
        SELECT c.pattern, c.rn, c.seq, c.chunk_id,
               CASE WHEN list_has_all(c.members, r.held) AND len(c.members) > len(r.held) THEN c.chunk_id ELSE r.stands END,
               CASE WHEN list_has_all(c.members, r.held) THEN c.members ELSE r.held END,
               CASE WHEN list_has_all(r.held, c.members) THEN 'unchanged' WHEN list_has_all(c.members, r.held) THEN 'replaced' ELSE 'added' END,
               CASE WHEN list_has_all(c.members, r.held) AND len(c.members) > len(r.held) THEN r.stands END,
               NOT list_has_all(c.members, r.held) AND NOT list_has_all(r.held, c.members),
               CASE WHEN list_has_all(r.held, c.members) THEN len(r.held) ELSE len(c.members) END
        FROM r JOIN c ON c.pattern = r.pattern AND c.rn = r.rn + 1),
    a AS (SELECT seq, pattern, CASE WHEN beside THEN pattern || '::' || given ELSE pattern END AS tracked, kind,
                 CASE WHEN beside THEN given ELSE stands END AS chunk_id, replaced AS replaced_chunk_id, size AS n_members FROM r)"""

SQL = {
    "settled_bursts": f"""SELECT user_id, session, max(t) + {2 * HOUR} AS settled_us, arg_max(event_id, rn) AS event_id, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN t - before <= {2 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn)::BIGINT AS session
        FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY rn) AS before FROM (SELECT * FROM (WITH {_EVENTS} SELECT * FROM e)))) GROUP BY user_id, session""",
    "cascade_ticks": f"""WITH RECURSIVE {_EVENTS}, {_TICKS}
        SELECT user_id, 'tick' AS kind, fired AS at_us, fired_id AS event_id, fired_n::BIGINT AS n FROM r WHERE fired IS NOT NULL
        UNION ALL SELECT user_id, 'rejected', t, event_id, 1 FROM r WHERE no
        UNION ALL SELECT user_id, 'tick', due, last, n FROM r WHERE due IS NOT NULL AND rn = (SELECT max(rn) FROM e WHERE e.user_id = r.user_id)""",
    "spawn_admissions": f"WITH RECURSIVE {_EVENTS}, {_SPAWNS} SELECT event_id, CASE WHEN yes THEN 'accepted' ELSE 'rejected' END AS kind FROM r",
    "absorbed_chunks": f"WITH RECURSIVE {_ABSORBED} SELECT * FROM a",
    "chunk_ledger": f"WITH RECURSIVE {_ABSORBED} SELECT tracked, arg_max(chunk_id, seq) AS chunk_id, arg_max(n_members, seq) AS n_members FROM a WHERE kind <> 'unchanged' GROUP BY tracked",
    "absorb_payloads": f"""WITH RECURSIVE {_ABSORBED} SELECT seq, '{{"type":"chunk_' || kind || '","url":"' || pattern || '","chunk_id":"' || chunk_id || '",'
        || coalesce('"replaced_chunk_id":"' || replaced_chunk_id || '",', '') || '"n_members":' || n_members || '}}' AS payload FROM a WHERE kind <> 'unchanged'""",
}
