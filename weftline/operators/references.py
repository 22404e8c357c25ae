"""Texts that refer to each other: ``{name}`` stands for the text of the concept of that id or name.

Concepts are rows (id, name, data).  References are resolved level by level, one join each, whatever the texts' length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import kept
from . import graph, logs

#: Fixed value: what a reference looks like.
REFERENCE = r"\{([A-Za-z][\w \-]*(?:\.[A-Za-z][\w \-]*)*)\}"


def _pieces(text: Column) -> Column:
    """Texts and references in turn, as (at, text, ref); ref is null for texts, empty texts are left out."""
    texts, refs = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), 1)
    of = lambda at, t, r: F.struct(at.cast("int").alias("at"), t.alias("text"), r.alias("ref"))
    plain = F.transform(texts, lambda t, i: of(2 * i, t, F.lit(None).cast("string")))
    named = F.transform(refs, lambda r, i: of(2 * i + 1, F.concat(F.lit("{"), r, F.lit("}")), r))
    return F.filter(F.array_sort(F.concat(plain, named)), lambda x: (x.text != "") | x.ref.isNotNull())


def targets(concepts: DataFrame) -> DataFrame:
    """(slug, target, text): what each name stands for: the concept of that id, else the smallest id among those whose name has that slug."""
    ids = concepts.select(F.col("id").alias("slug"), "id", F.lit(0).alias("by_name"), F.coalesce("data", F.lit("")).alias("text"))
    names = concepts.select(T.slug(F.col("name")).alias("slug"), "id", F.lit(1), F.coalesce("data", F.lit("")))
    best = F.min_by(F.struct("id", "text"), F.struct("by_name", "id")).alias("x")
    return ids.union(names).where("slug <> ''").groupBy("slug").agg(best).select("slug", F.col("x.id").alias("target"), "x.text")


def resolved(concepts: DataFrame, depth: int = 8) -> DataFrame:
    """(id, text): each concept's data with its references replaced by the data of their targets, and so on down to ``depth`` levels.

    What has no target, or is already being resolved, stays as it is written; below the last level references stay too.
    Null data is empty. Ids are distinct; a concept's text is one row, so it is gathered."""
    known = kept(targets(concepts))
    rows = concepts.select("id", F.explode_outer(_pieces(F.coalesce("data", F.lit("")))).alias("p"))
    rows = rows.select("id", F.array(F.coalesce("p.at", F.lit(0))).alias("place"), F.coalesce("p.text", F.lit("")).alias("text"), T.slug(F.col("p.ref")).alias("slug"), F.array().cast("array<string>").alias("above"))
    done, open_ = [], kept(rows)
    for level in range(1, depth + 1):
        fits = F.coalesce((F.col("slug") != "") & ~F.array_contains("above", F.col("slug")), F.lit(False))
        done.append(open_.where(~fits).select("id", "place", "text"))
        joined = kept(open_.where(fits).join(known.withColumnRenamed("text", "found"), "slug", "left"))
        done.append(joined.where("target is null").select("id", "place", "text"))
        joined = joined.where("target is not null")
        if level == depth:
            done.append(joined.select("id", "place", F.col("found").alias("text")))
            break
        inner = joined.select("id", "place", F.array_append("above", F.col("slug")).alias("above"), F.explode(_pieces(F.col("found"))).alias("p"))
        open_ = kept(inner.select("id", F.array_append("place", F.col("p.at")).alias("place"), "p.text", T.slug(F.col("p.ref")).alias("slug"), "above"))
        if open_.isEmpty():
            break
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text)
    found = rows.groupBy("id").agg(F.array_join(parts, "").alias("text"))
    return concepts.select("id").join(found, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def consumers(concepts: DataFrame) -> DataFrame:
    """(src, dst): src is referred to by dst, by its id or by a name of the same slug; each pair once, none with itself."""
    refs = concepts.select(F.col("id").alias("dst"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("data", F.lit("")), F.lit(REFERENCE), 1))).alias("ref"))
    by_id = refs.join(concepts.select(F.col("id").alias("src")), F.col("ref") == F.col("src"))
    slugs = concepts.select(F.col("id").alias("src"), T.slug(F.col("name")).alias("slug")).where("slug <> ''")
    by_name = refs.withColumn("slug", T.slug(F.col("ref"))).join(slugs, "slug")
    return by_id.select("src", "dst").union(by_name.select("src", "dst")).where("src <> dst").distinct()


def cascade(concepts: DataFrame, changed: DataFrame, depth: int = 16) -> DataFrame:
    """(origin, node, distance): the concepts to work out again once each of ``changed`` (id) has changed, nearest first; the changed one itself is left out."""
    edges = kept(consumers(concepts))
    return graph.reach(edges, changed.select(F.col("id").alias("origin")), depth).where("distance > 0")


# ---- the log of edits


def with_causes(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``log`` that are undone together with ``chosen`` (edit_id): these and the edits that they caused."""
    ids = chosen.select("edit_id").distinct()
    both = ids.union(log.select("edit_id", F.col("causing_edit_id").alias("cause")).join(ids.select(F.col("edit_id").alias("cause")), "cause", "left_semi").select("edit_id")).distinct()
    return log.join(both, "edit_id", "left_semi")


def rollback_entries(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows that undoing each of ``chosen`` (edit_id) appends to ``log`` (edit_id, ts, actor, target, kind, before, after, causing_edit_id).

    Before and after change places, the cause is the undone edit. Ids follow the log's last one in the order of the undone edits."""
    high, least = log.agg(F.max("edit_id"), F.min("edit_id")).first()
    rows = log.join(chosen.select("edit_id").distinct(), "edit_id", "left_semi")
    return rows.select(
        (F.col("edit_id") + F.lit((high or 0) + 1 - (least or 0))).alias("edit_id"), "ts", F.lit("system:rollback").alias("actor"), "target", F.lit("rollback").alias("kind"),
        F.col("after").alias("before"), F.col("before").alias("after"), F.col("edit_id").alias("causing_edit_id"),
    )


def rolled_back_with_causes(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """(target, state, n_undone) once ``chosen`` edits and those that they caused are undone, the latest first."""
    undone = with_causes(log, chosen).select("edit_id", F.lit(True).alias("undone"))
    return logs.rolled_back(log.join(undone, "edit_id", "left"), F.col("undone"))


def last_edits(log: DataFrame) -> DataFrame:
    """(target, edit_id): the latest edit of each target that no rollback has undone, rollbacks aside."""
    undone = log.where("kind = 'rollback' and causing_edit_id is not null").select(F.col("causing_edit_id").alias("edit_id")).distinct()
    return log.where("kind <> 'rollback'").join(undone, "edit_id", "left_anti").groupBy("target").agg(F.max("edit_id").alias("edit_id"))
