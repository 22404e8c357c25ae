"""Chat formatting of reply trees, by DataFrame operations only.

Iterative self-joins double the distance that each message sees upwards, so paths of n messages take log2(n) rounds.
They give every leaf its root-to-leaf path and score; the best branches of each tree are formatted as conversations.

A turn is written ``### role: text </turn>`` and a line end, the role in URL encoding.  In texts a backslash is doubled,
``</turn>`` becomes ``<\\/turn>`` and ``##`` becomes ``#\\#``, so no text can hold a control string; dropping each
backslash before the character it guards restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

#: Fixed strings of the template, and what stands for control strings within texts (applied in this order).
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("##", "#\\#"))


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, depth, node): the best ``branches`` root-to-leaf paths of each tree, one row per message.

    ``messages`` has tree, node, parent and score; (tree, node) is a key, and a parent that is null or isn't there makes
    a root.  A branch scores the sum of its messages' scores (null counts 0), ties go to the smaller leaf.  Messages on a
    cycle have no root and are on no path.
    """
    rows = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    rows = rows.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), "score")
    # up: the ancestor 2**k above, span and total: messages and score from here until just below it
    first = jump = stash(rows.select("tree", "node", "up", F.lit(1).alias("span"), F.col("score").alias("total")), "jumps")
    jumps, resting, left = [], jump.where("up is null"), jump.where("up is not null").count()
    while left:  # messages that have reached their root rise no more and are not written again
        rising = jump.where("up is not null")
        jumps.append(rising)
        above = rising.union(resting).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("span").alias("span2"), F.col("total").alias("total2"))
        risen = rising.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("span") + F.col("span2")).alias("span"), (F.col("total") + F.col("total2")).alias("total"))
        jump = stash(risen, "jumps")
        resting = resting.union(jump.where("up is null"))
        before, left = left, jump.where("up is not null").count()
        if left == before:  # only messages on or below cycles still rise
            break
    parents = first.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = resting.join(stash(first.select("tree", "node").join(parents, ["tree", "node"], "left_anti"), "leaves"), ["tree", "node"])
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    path = stash(chosen.select("tree", F.col("node").alias("leaf"), "branch", F.col("span").alias("depth"), "node"), "paths")
    for step in jumps:
        rise = step.select("tree", "node", "up", "span")
        more = path.join(rise, ["tree", "node"]).select("tree", "leaf", "branch", (F.col("depth") - F.col("span")).alias("depth"), F.col("up").alias("node"))
        path = path.union(stash(more, "paths"))
    return path


def format_conversations(messages: DataFrame, branches: int = 1, trained_role: str = "assistant") -> DataFrame:
    """(tree, leaf, branch, n_turns, formatted, loss): each chosen path as one text.

    ``messages`` also has role and text (null: empty).  ``loss`` is an array of (start, length) in characters of
    ``formatted``: the texts of ``trained_role``, without markers.
    """
    rows = reply_paths(messages, branches).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.url_encode(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    rows = rows.select("tree", "leaf", "branch", "depth", (F.col("role") == trained_role).alias("trained"), F.char_length(head).alias("before"), F.char_length(text).alias("inside"), F.concat(head, text, F.lit(CLOSE)).alias("turn"))
    order = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn")).over(order), F.lit(0))
    rows = rows.withColumn("start", start + F.col("before"))
    turns = F.array_sort(F.collect_list(F.struct("depth", "turn", "trained", "start", "inside")))
    whole = rows.groupBy("tree", "leaf", "branch").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x.trained), lambda x: F.struct(x.start.alias("start"), x.inside.cast("long").alias("length")))
    return whole.select("tree", "leaf", "branch", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.turn"), "").alias("formatted"), spans.alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """The (role, text) of each turn, as written before formatting."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda x: F.url_decode(F.regexp_extract(x, f"^{OPEN}([^:]*){MIDDLE}", 1))
    text = lambda x: unescape(F.regexp_replace(x, f"^{OPEN}[^:]*{MIDDLE}", ""))
    return F.transform(parts, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, (x.start + 1).cast("int"), x.length.cast("int")))), "")


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each turn answers the one before it, ties ordered by role and
    text.  Rows with a null conv_id are one conversation; a null turn comes first.  The rows are written once, as several
    joins read them."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    rows = conversations.select("conv_id", "role", "text", node.alias("node"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return stash(rows.select(tree.alias("tree"), "conv_id", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")), "turns")


def format_report(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: counts and digests of turns and of the text under the mask."""
    rows = formatted.withColumn("turns", parse_turns(F.col("formatted"))).withColumn("trained", loss_text(F.col("formatted"), F.col("loss")))
    flat = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return rows.select(
        "tree",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(flat, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("trained"), "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
