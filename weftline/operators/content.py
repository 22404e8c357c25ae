"""Which elements of a page carry content: predicates, tags, the set that is kept and the tree without empty branches.

All on node tables (``pages.nodes``), JVM only. Ancestor questions are windows over pre-order ids within a page. Tag and
attribute names are lower case there; a null attribute value is empty."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..sources import written

#: Elements by role.
SKIPPED = "script style noscript meta link head #comment #declaration #text #document".split()
DOCUMENT = "html body head document #document".split()
INPUTS, FIELDS = "input textarea select".split(), "input textarea select option optgroup datalist output progress meter".split()
FORMS = "form fieldset legend label".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
IMAGES, VIDEOS = "img picture svg canvas".split(), "video source track".split()
MEDIA, MEDIA_BOXES = "img video source picture audio".split(), "picture video audio".split()
FALLBACKS = "noscript template".split()
#: Attribute values that give an element a role.
BUTTON_VALUES, INPUT_VALUES, MEDIA_VALUES = "button submit reset image".split(), "textbox searchbox combobox listbox spinbutton".split(), "img image video figure".split()
ROLES = ("button checkbox combobox grid gridcell link listbox menu menubar menuitem menuitemcheckbox menuitemradio option radio radiogroup searchbox slider spinbutton switch tab tablist textbox tree treeitem").split()
#: Attributes by what they hold.
TELLING = "alt title aria-label placeholder value".split()
READ_OUT = "alt title placeholder aria-label aria-description aria-placeholder aria-valuetext aria-roledescription label summary caption abbr".split()
DESCRIBING = "content data-tooltip data-title data-caption data-description data-alt data-label data-placeholder data-text data-name data-value datetime".split()
ADDRESSES = "href src action formaction poster cite longdesc background data-src data-href data-url".split()
NO_ADDRESSES = "style onclick onload onerror onmouseover".split()
#: Endings of addresses of media.
ENDINGS = {"images": "jpg jpeg png gif svg webp avif bmp ico", "video": "mp4 webm ogv mov m3u8", "audio": "mp3 wav ogg flac aac m4a"}

CSS_ADDRESS = r"url\(['\"]?([^'\")\s]+)['\"]?\)"


def is_url(value: Column) -> Column:
    """Whether a value looks like an address: a root path, a scheme, an image as data, or a path with a dot and no blank."""
    v = F.trim(value)
    path = v.contains("/") & v.contains(".") & ~v.contains(" ") & (F.length(v) < 500)
    return F.coalesce((v == "/") | (F.length(v) >= 2) & (v.rlike("(?i)^(?:https?://|//|/|data:image/)") | path), F.lit(False))


def _entries() -> Column:
    return F.map_entries(F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>")))


def _holds(values: list[str]) -> Column:
    return F.exists(_entries(), lambda e: F.lower(F.trim(e["value"])).isin(values))


def urls() -> Column:
    """All addresses in a node's attributes, in attribute order; of a style those in ``url()``, but data only of images."""
    css = F.filter(F.regexp_extract_all(F.coalesce(F.col("attrs")["style"], F.lit("")), F.lit(CSS_ADDRESS)), lambda u: ~u.startswith("data:") | u.startswith("data:image/"))
    return F.concat(F.transform(F.filter(_entries(), lambda e: ~e["key"].isin(NO_ADDRESSES) & is_url(e["value"])), lambda e: F.trim(e["value"])), css)


def input_like() -> Column:
    return F.col("tag").isin(INPUTS) | _holds(INPUT_VALUES) | F.coalesce(F.lower(F.trim(F.col("attrs")["contenteditable"])) == "true", F.lit(False))


def button_like() -> Column:
    return (F.col("tag") == "button") | _holds(BUTTON_VALUES)


def heading_like() -> Column:
    return F.col("tag").isin(HEADINGS) | _holds(["heading"])


def media_container() -> Column:
    return F.col("tag").isin(MEDIA_BOXES) | _holds(MEDIA_VALUES)


def fallback_copy() -> Column:
    return F.col("tag").isin(FALLBACKS)


def content_node() -> Column:
    """Whether a node itself, without its children, carries text, an address, media, something to use, a heading or a telling attribute."""
    telling = F.exists(_entries(), lambda e: e["key"].isin(TELLING) & (F.trim(e["value"]) != ""))
    own = (F.col("text") != "") | (F.size(urls()) > 0) | F.col("tag").isin(MEDIA) | button_like() | input_like() | heading_like() | telling
    return ~F.col("tag").isin(SKIPPED) & own


def categories() -> Column:
    """What a node is among button, input, link and text (over two signs), sorted; nothing for the document's own elements."""
    some = [(button_like(), "button"), (input_like(), "input"), ((F.size(urls()) > 0) | F.col("tag").isin(MEDIA), "link"), (F.length("text") > 2, "text")]
    found = F.array_compact(F.array(*[F.when(c, name) for c, name in some]))
    return F.when(F.col("tag").isin(SKIPPED + DOCUMENT), F.array().cast("array<string>")).otherwise(found)


def link_containers(rows: DataFrame) -> DataFrame:
    """(page_id, node_id, n): nodes at least two of whose children hold an address, themselves or below."""
    held = _reaching(rows.withColumn("mark", F.size(urls()) > 0))
    return held.where("reached and parent_id >= 0").groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where("n >= 2")


def _reaching(rows: DataFrame) -> DataFrame:
    """``reached``: whether a node or one below it is marked, that is whether the next marked id lies in its interval."""
    after = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("reached", F.coalesce(F.min(F.when(F.col("mark"), F.col("node_id"))).over(after) <= F.col("last_id"), F.lit(False)))


def keep_set(rows: DataFrame) -> DataFrame:
    """Content nodes and all nodes above one."""
    return _reaching(rows.withColumn("mark", content_node())).where("reached").drop("mark", "reached")


def without_empty_branches(rows: DataFrame) -> DataFrame:
    """(page_id, node_id, parent_id, last_id, tag, text, level): the tree in which a node without content stays only above two branches with content.

    Nodes without content and with one such branch hand it to the node above, those with none go; the root stays. A branch
    leaves exactly one child behind if any content is in it, so one count of children decides. The new parent is the last
    node before one on the level above, which needs no climbing."""
    held = _reaching(rows.withColumn("mark", content_node())).select("page_id", "node_id", "parent_id", "last_id", "tag", "text", "mark", "reached")
    held = written(held)  # read twice, and so is what stays; pages are parsed once
    branches = held.where("reached").groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    stay = written(held.join(branches, ["page_id", "node_id"], "left").where("mark or n >= 2 or parent_id < 0").select("page_id", "node_id", "last_id", "tag", "text"))
    # each node opens a level after its own id and closes it after its last one; closings come before what follows
    steps = stay.select("page_id", F.explode(F.array(F.struct(F.col("node_id").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("last_id").alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step")))).alias("s"))
    run = Window.partitionBy("page_id").orderBy("s.at", "s.kind").rowsBetween(Window.unboundedPreceding, 0)
    levels = steps.groupBy("page_id", "s").agg(F.count("*").alias("times")).withColumn("level", F.sum(F.col("s.step") * F.col("times")).over(run) - 1)
    placed = stay.join(levels.where("s.kind = 1").select("page_id", F.col("s.at").alias("node_id"), F.col("level").cast("int").alias("level")), ["page_id", "node_id"])
    as_parent = placed.select("page_id", "node_id", F.col("level").alias("on"), F.col("node_id").alias("above"), F.lit(None).cast("struct<last_id:int,tag:string,text:string,level:int>").alias("own"))
    as_child = placed.select("page_id", "node_id", (F.col("level") - 1).alias("on"), F.lit(None).cast("int").alias("above"), F.struct("last_id", "tag", "text", "level").alias("own"))
    before = Window.partitionBy("page_id", "on").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    linked = as_parent.unionByName(as_child).withColumn("parent_id", F.coalesce(F.last("above", True).over(before), F.lit(-1))).where("own is not null")
    return linked.select("page_id", "node_id", "parent_id", "own.*")


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (page_id, parent_id, mark) of pages one after another; a page begins with its document, which has no parent."""

    def sizes(parents: list[int], marks: list[bool]) -> tuple[int, int]:
        branches, reached = [0] * len(parents), list(marks)
        for i in range(len(parents) - 1, 0, -1):  # children come after their parent
            if reached[i]:
                reached[parents[i]] = True
                branches[parents[i]] += 1
        near, below = [0] * len(parents), [0] * len(parents)
        for i, p in enumerate(parents):
            if i:
                near[i] = p if marks[p] or branches[p] >= 2 or not p else near[p]
                if marks[i] or branches[i] >= 2:
                    below[near[i]] += 1
        return 1 + sum(below), max(below)

    page, parents, marks = None, [], []
    for batch in chain(batches, [None]):
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "parent_id", "mark"))) if batch is not None else [(None, -1, None)]:
            if row[1] < 0:
                if parents:
                    found.append((page, *sizes(parents, marks)))
                page, parents, marks = row[0], [], []
            parents.append(row[1])
            marks.append(row[2])
        found = [x for x in found if x[2]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["page_id", "n", "widest"])


def pruned_sizes(rows: DataFrame) -> DataFrame:
    """(page_id, n, widest): how many nodes of each page ``without_empty_branches`` leaves, and the most that one has below it; pages with one below another only.

    ``rows`` are as ``pages.nodes`` gives them, a page's nodes one after another. They are marked and counted where they are
    parsed, so that none is shuffled or written."""
    return rows.select("page_id", "parent_id", content_node().alias("mark")).mapInArrow(_pruned, "page_id long, n long, widest long")


def _tag(category: str, kind, value, source) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(category).alias("category"), as_column(kind).alias("kind"), as_column(value).alias("value"), as_column(source).alias("source"))


def _media_kind(address: Column) -> Column:
    end = F.lower(F.regexp_extract(address, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    kind = F.lit(None).cast("string")
    for name, endings in ENDINGS.items():
        kind = F.when(end.isin(endings.split()), name).otherwise(kind)
    return F.when(address.startswith("data:image/"), "images").otherwise(kind)


def tags(rows: DataFrame) -> DataFrame:
    """(page_id, node_id, category, kind, value, source): every tag of every node, once each.

    text: visible, accessible, metadata. interactive: inputs, buttons, links, forms, event_handlers. media: images, video,
    audio, by element and by an address's ending. urls: resource, external, internal. ``source`` is the attribute, or empty.
    Whole values are kept. Scripts and styles have no text in node tables and give none."""
    tag, attrs, entries = F.col("tag"), F.col("attrs"), _entries()
    real = lambda v: F.coalesce(v.rlike(r"[\p{L}\p{N}]"), F.lit(False))
    use = F.when(tag.isin(FIELDS), "inputs").when(tag == "button", "buttons").when(tag == "a", "links").when(tag.isin(FORMS), "forms")
    show = F.when(tag.isin(IMAGES) | (tag == "input") & (F.lower(F.trim(attrs["type"])) == "image"), "images").when(tag.isin(VIDEOS), "video").when(tag == "audio", "audio")
    role, editable = F.lower(F.trim(attrs["role"])), attrs["contenteditable"]
    handlers = F.array_sort(F.filter(F.map_keys(F.coalesce(attrs, F.create_map().cast("map<string,string>"))), lambda k: k.startswith("on") & (F.length(k) > 2)))
    single = [
        F.when(real(F.col("text")) & ~tag.isin(SKIPPED), _tag("text", "visible", F.col("text"), "")),
        F.when(use.isNotNull(), _tag("interactive", use, tag, "")),
        F.when(role.isin(ROLES), _tag("interactive", F.when(role == "button", "buttons").otherwise("inputs"), F.concat(tag, F.lit("[role="), role, F.lit("]")), "role")),
        F.when(editable.isin("true", ""), _tag("interactive", "inputs", F.concat(tag, F.lit("[contenteditable]")), "contenteditable")),
        F.when(F.size(handlers) > 0, _tag("interactive", "event_handlers", F.concat(tag, F.lit("["), F.get(handlers, 0), F.lit("]")), F.get(handlers, 0))),
        F.when(show.isNotNull(), _tag("media", show, tag, "")),
    ]
    told = F.transform(F.filter(entries, lambda e: e["key"].isin(READ_OUT + DESCRIBING) & real(e["value"])), lambda e: _tag("text", F.when(e["key"].isin(READ_OUT), "accessible").otherwise("metadata"), F.trim(e["value"]), e["key"]))

    def found(e):
        value, key = F.trim(e["value"]), e["key"]
        one = F.when((key.isin(ADDRESSES) & (value != "") & ~value.rlike("(?i)^(javascript|mailto|tel):")) | ~key.isin(ADDRESSES + NO_ADDRESSES) & is_url(value), F.array(value))
        several = F.filter(F.transform(F.split(value, r",\s+"), lambda part: F.regexp_extract(part, r"^\s*(\S*)", 1)), lambda u: u != "")
        inside = F.regexp_extract_all(value, F.lit(CSS_ADDRESS))
        return F.transform(F.when(key == "srcset", several).when(key == "style", inside).otherwise(F.coalesce(one, F.array().cast("array<string>"))), lambda u: F.struct(u.alias("u"), key.alias("key")))

    addresses = F.flatten(F.transform(entries, found))
    linked = F.transform(addresses, lambda a: _tag("urls", U.classify(a["u"]), a["u"], a["key"]))
    media = F.transform(F.filter(addresses, lambda a: _media_kind(a["u"]).isNotNull()), lambda a: _tag("media", _media_kind(a["u"]), a["u"], a["key"]))
    every = F.array_distinct(F.concat(F.array_compact(F.array(*single)), told, linked, media))
    return rows.select("page_id", "node_id", F.explode(every).alias("t")).select("page_id", "node_id", "t.*")
