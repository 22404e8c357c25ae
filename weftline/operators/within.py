"""What a page says by itself, worked off where it is parsed: a page comes in as one row of html, and only what is found
leaves its task. Nodes are neither shuffled nor kept, so that disk doesn't grow with them.

The steps give what those on node tables (``templates``, ``tree_match``, ``cohorts``) give; tests hold them together."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import side, written
from .cohorts import compiled, fitting
from .pages import _page_columns
from .templates import DRAWING, FRAME, SKIPPED
from .tree_match import REMEMBERED, common_subtree, edit_distance

#: Pages that are parsed before what was found in them is given on; subtrees whose signatures a task remembers.
PAGES_AT_ONCE, SIGNATURES = 100, 1 << 16

_SKIPPED, _FRAMED_OUT, _DRAWING = frozenset(SKIPPED), frozenset(SKIPPED + FRAME), frozenset(DRAWING)


class Page:
    """Nodes of a page in page order, as lists."""

    def __init__(self, html: str | None, hashes: tuple[str, ...] = ()):
        _, _, _, self.parents, self.lasts, self.tags, _, self.texts, attrs, self.heights, _, *made = _page_columns(None, None, html, hashes)
        self.attrs = [dict(a) for a in attrs]
        made = dict(zip((h for h in ("exact", "template", "shape") if h in hashes), made))
        self.templates, self.shapes = made.get("template", []), made.get("shape", [])
        self.plain = [t not in _SKIPPED for t in self.tags]
        self.framed = [t not in _FRAMED_OUT for t in self.tags]

    def nearest(self, tops: Sequence[bool]) -> list[int]:
        """The lowest of ``tops`` strictly above each node, -1 if there is none. The document is no top."""
        near = [-1] * len(tops)
        for i, p in enumerate(self.parents):
            if p > 0:  # parents come before their children
                near[i] = p if tops[p] else near[p]
        return near

    def reached(self, marks: Sequence[bool]) -> list[bool]:
        """Whether a node or one below it is marked."""
        out = list(marks)
        for i in range(len(out) - 1, 0, -1):
            if out[i]:
                out[self.parents[i]] = True
        return out

    def children(self) -> list[list[int]]:
        """The plain children of each node."""
        kids = [[] for _ in self.tags]
        for i, p in enumerate(self.parents):
            if p >= 0 and self.plain[i]:
                kids[p].append(i)
        return kids


def per_page(pages: DataFrame, of: Callable[[Page], Iterable[tuple]], schema: str, hashes: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, ...): the rows (by ``schema``) that ``of`` gives for each page (page_id, url, html)."""
    full = StructType.fromDDL(f"page_id long, {schema}")
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                ids, texts = (batch.column(c).slice(start, PAGES_AT_ONCE).to_pylist() for c in ("page_id", "html"))
                rows = [(page_id, *row) for page_id, html in zip(ids, texts) for row in of(Page(html, hashes))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, full)


# ---- templates


def group_instances(page: Page, least: int = 2, least_height: int = 1) -> dict[str, list[int]]:
    """The instances of the templates that stand for themselves (``templates.template_groups``)."""
    content = page.reached([f and bool(t or "href" in a or "src" in a) for f, t, a in zip(page.framed, page.texts, page.attrs)])
    held = defaultdict(list)
    for i, template in enumerate(page.templates):
        if page.framed[i] and page.heights[i] >= least_height and content[i]:
            held[template].append(i)
    held = {t: own for t, own in held.items() if len(own) >= least}
    in_link, reach = [False] * len(page.tags), -1
    for i, tag in enumerate(page.tags):
        in_link[i] = reach >= i
        if tag == "a" and "href" in page.attrs[i]:
            reach = max(reach, page.lasts[i])
    tops = [False] * len(page.tags)
    for own in held.values():
        for i in own:
            tops[i] = True
    near, inside = page.nearest(tops), set()
    for template, own in held.items():
        within = Counter()
        for i in own:
            while (i := near[i]) >= 0:
                within[page.templates[i]] += 1
        if len(own) in within.values():
            inside.add(template)
    return {t: own for t, own in held.items() if t not in inside and not all(in_link[i] for i in own)}


def _groups(page: Page) -> Iterator[tuple]:
    for own in group_instances(page).values():
        yield page.tags[own[0]], page.heights[own[0]], len(own)


def template_groups(pages: DataFrame) -> DataFrame:
    """(page_id, tag, height, n): templates that stand for themselves, without their instances."""
    return per_page(pages, _groups, "tag string, height int, n long", ("template",))


def _sub_templates(page: Page, least: int = 2, least_height: int = 2) -> Iterator[tuple]:
    groups = group_instances(page)
    n, kids = len(page.tags), page.children()
    hrefs = [i for i in range(n) if "href" in page.attrs[i]]
    address = page.reached(["href" in a or "src" in a for a in page.attrs])
    owner = {}  # instances of composite templates
    for template, own in groups.items():
        if any(len(kids[i]) >= 3 or len({page.attrs[j]["href"] for j in hrefs if i <= j <= page.lasts[i]}) >= 2 for i in own):
            owner |= dict.fromkeys(own, template)
    barred = {i for own in groups.values() for i in own}
    stops = page.reached([i in barred for i in range(n)])
    near = page.nearest(stops)
    pool = defaultdict(list)
    for i in range(1, n):
        top = near[i]
        if top in owner and not stops[i] and page.plain[i] and page.heights[i] >= least_height and len(kids[page.parents[i]]) >= 2 and page.tags[i] not in _DRAWING:
            pool[owner[top], page.shapes[i]].append(i)
    for (template, shape), own in pool.items():
        if len(own) >= max(least, len(groups[template])) and any(address[i] for i in own):
            yield template, shape, page.tags[own[0]], page.heights[own[0]], len(own), own[0]


def sub_templates(pages: DataFrame) -> DataFrame:
    """(page_id, template, shape, tag, height, n, first_id): ``templates.sub_templates`` of the page's template groups."""
    return per_page(pages, _sub_templates, "template string, shape string, tag string, height int, n long, first_id int", ("template", "shape"))


# ---- trees


class Tree:
    """A template's tree by its first instance: tags and depths in page order, and how often the template occurs."""

    def __init__(self, page: Page, root: int, n: int, levels: list[int], depth: int = 4):
        self.root, self.n_instances, self.height = root, n, page.heights[root]
        at = [j for j in range(root, page.lasts[root] + 1) if levels[j] - levels[root] <= depth and page.plain[j]]
        self.labels, self.depths = tuple(page.tags[j] for j in at), tuple(levels[j] - levels[root] for j in at)
        self.n, self.deep, self.bag = len(at), max(self.depths), Counter(self.labels)


def page_trees(page: Page) -> list[Tree]:
    """The trees of every repeated or single template of a page with children, in page order."""
    levels = [0] * len(page.tags)
    for i, p in enumerate(page.parents):
        if p >= 0:
            levels[i] = levels[p] + 1
    held = defaultdict(list)
    for i, template in enumerate(page.templates):
        if page.framed[i] and page.heights[i] >= 1:
            held[template].append(i)
    return [Tree(page, own[0], len(own), levels) for own in held.values()]


_distance, _common = functools.lru_cache(1 << 13)(edit_distance), functools.lru_cache(1 << 13)(common_subtree)  # pages of one kind hold the same pairs


def _of_pair(kept: Callable[..., int], of: Callable[..., int], x: Tree, y: Tree) -> int:
    return (kept if x.n + y.n <= REMEMBERED else of)(x.labels, x.depths, y.labels, y.depths)


def _pairs(trees: list[Tree], key: Callable[[Tree], tuple], near: Callable[[Tree], Iterable[tuple]]) -> Iterator[tuple[Tree, Tree, int]]:
    """Pairs in page order of which the second's key is near the first's, with the number of tags they have in common."""
    by_key = defaultdict(list)
    for t in trees:
        by_key[key(t)].append(t)
    for x in trees:
        for k in near(x):
            for y in by_key.get(k, ()):
                if x.root < y.root:
                    yield x, y, sum(min(c, y.bag[t]) for t, c in x.bag.items())


def near_pairs(trees: list[Tree], most: int = 3) -> Iterator[tuple[Tree, Tree, int]]:
    """Pairs whose edit distance is at most ``most``, with it (``tree_match.near_trees``)."""
    for x, y, shared in _pairs(trees, lambda t: t.n, lambda t: range(t.n - most, t.n + most + 1)):
        if max(x.n, y.n) - shared <= most and (distance := _of_pair(_distance, edit_distance, x, y)) <= most:
            yield x, y, distance


def similar_pairs(trees: list[Tree], percent: int = 80, least: int = 3) -> Iterator[tuple[Tree, Tree, int]]:
    """Pairs that have ``percent`` hundredths of the smaller tree in common, with the common nodes (``tree_match.similar_trees``)."""
    own = [t for t in trees if t.n >= least]
    for x, y, shared in _pairs(own, lambda t: (t.labels[0], t.deep), lambda t: [(t.labels[0], t.deep + d) for d in (-1, 0, 1)]):
        enough = percent * min(x.n, y.n)
        if 100 * shared >= enough and 100 * (common := _of_pair(_common, common_subtree, x, y)) >= enough:
            yield x, y, common


def _named(pairs: Iterable[tuple[Tree, Tree, int]]) -> Iterator[tuple]:
    return ((x.root, y.root, x.n, y.n, value) for x, y, value in pairs)


def tree_distances(pages: DataFrame) -> DataFrame:
    """(page_id, a, b, n, n2, distance) of the templates of each page."""
    return per_page(pages, lambda page: _named(near_pairs(page_trees(page))), "a int, b int, n int, n2 int, distance long", ("template",))


def common_subtrees(pages: DataFrame) -> DataFrame:
    """(page_id, a, b, n, n2, common) of the templates of each page."""
    return per_page(pages, lambda page: _named(similar_pairs(page_trees(page))), "a int, b int, n int, n2 int, common long", ("template",))


def _merged(page: Page) -> Iterator[tuple]:
    sets = {}  # each tree's root to the trees it is joined with
    for x, y, _ in similar_pairs(page_trees(page)):
        own, other = sets.setdefault(x.root, [x]), sets.setdefault(y.root, [y])
        if own is not other:
            own += other
            sets |= {t.root: own for t in other}
    for own in {id(s): s for s in sets.values()}.values():
        base = max(own, key=lambda t: (t.height, t.n_instances, -t.root))
        yield base.root, len(own), sum(t.n_instances for t in own)


def merged_templates(pages: DataFrame) -> DataFrame:
    """(page_id, base_id, n_templates, n_instances): templates joined by common subtrees, by the highest and most frequent of each set."""
    return per_page(pages, _merged, "base_id int, n_templates long, n_instances long", ("template",))


# ---- cohorts


def page_cohorts(page: Page, kids: list[list[int]]) -> list[int]:
    """The cohort of each node by its nearest node above with several children, -1 for those in none (``cohorts.cohorts``)."""
    near = page.nearest([p and len(k) >= 2 for p, k in zip(page.plain, kids)])
    return [top if p and len(k) != 1 else -1 for top, p, k in zip(near, page.plain, kids)]


def _cohort_sizes(page: Page) -> Iterator[tuple]:
    sizes = Counter(c for c in page_cohorts(page, page.children()) if c >= 0)
    yield from Counter(sizes.values()).items()


def cohort_sizes(pages: DataFrame) -> DataFrame:
    """(page_id, n, n_cohorts): how many cohorts of a page have n nodes."""
    return per_page(pages, _cohort_sizes, "n long, n_cohorts long")


@functools.lru_cache(SIGNATURES)
def _digest(tag: str, *kids: str) -> str:
    return hashlib.sha1(f"{tag}({','.join(kids)})".encode("utf-8", "surrogatepass")).hexdigest()


def page_signatures(page: Page, kids: list[list[int]], depth: int = 6) -> list[list[str]]:
    """The signatures of each plain node's subtree down to depth 0, 1 and so on; the last one holds for what is deeper, too (``cohorts.signatures``)."""
    out = [[]] * len(page.tags)
    for i in range(len(out) - 1, -1, -1):  # children come after their parent
        if page.plain[i]:
            below = [out[k] for k in kids[i]]
            levels = min(depth, max(map(len, below), default=0))
            out[i] = [_digest(page.tags[i]), *(_digest(page.tags[i], *[s[min(d, len(s) - 1)] for s in below]) for d in range(levels))]
    return out


def _settled(page: Page, depth: int = 6) -> Iterator[tuple]:
    kids = page.children()
    marks, members = page_signatures(page, kids, depth), defaultdict(list)
    for i, c in enumerate(page_cohorts(page, kids)):
        if c >= 0:
            members[c].append(marks[i])
    found = defaultdict(list)
    for c, own in members.items():
        counts = [len({s[min(d, len(s) - 1)] for s in own}) for d in range(depth + 1)]
        settled = next((max(1, d - 1) for d in range(1, depth + 1) if counts[d] == counts[d - 1]), depth)
        for s in own:
            found[s[min(settled, len(s) - 1)]].append((c, settled))
    for signature, own in found.items():
        yield signature, len(own), len({c for c, _ in own}), max(d for _, d in own)


def settled_signatures(pages: DataFrame) -> DataFrame:
    """(page_id, signature, n, n_cohorts, depth): ``cohorts.settled_groups`` by signature."""
    return per_page(pages, _settled, "signature string, n long, n_cohorts long, depth int")


# ---- patterns of child tags


def _instance_trees(page: Page, depth: int = 4) -> Iterator[tuple]:
    kids, found = page.children(), {}
    for i, template in enumerate(page.templates):
        if page.framed[i] and page.heights[i] >= 1:
            parts, stack = [], [(i, 0)]
            while stack:
                j, d = stack.pop()
                parts.append(f"{d} {page.tags[j]} {j - i}")
                if d < depth:
                    stack += [(k, d + 1) for k in reversed(kids[j])]
            found.setdefault((template, page.tags[i], " ".join(parts)), []).append(i)
    for (template, tag, tree), own in found.items():
        yield template, tag, tree, len(own), own[0]


def instance_trees(pages: DataFrame) -> DataFrame:
    """(pattern, tag, tree, n, at): distinct trees of the instances of all pages' templates, down to depth 4, how often each occurs, and where first (page_id, node_id).

    A tree is a string of depth, tag and distance from its root's id for each node in page order; tags have no blanks."""
    return _distinct(per_page(pages, _instance_trees, "pattern string, tag string, tree string, n long, node_id int", ("template",)).withColumn("at", F.struct("page_id", "node_id")), "pattern", "tag", "tree")


def _distinct(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("n").alias("n"), F.min("at").alias("at"))


@functools.lru_cache(1 << 10)
def _branches(tree: str) -> list[tuple[str, int, str]]:
    """Tag, distance and tree of each child of a tree's root."""
    parts = tree.split(" ")
    depths, tags, places = list(map(int, parts[0::3])), parts[1::3], list(map(int, parts[2::3]))
    starts = [i for i, d in enumerate(depths) if d == 1]
    return [(tags[a], places[a], " ".join(f"{depths[j] - 1} {tags[j]} {places[j] - places[a]}" for j in range(a, b))) for a, b in zip(starts, [*starts[1:], len(depths)])]


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``order``: the tags of a root's children, null without any."""
    for batch in batches:
        orders = [[tag for tag, _, _ in _branches(t)] or None for t in batch.column("tree").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(orders, pa.list_(pa.string()))], [*batch.schema.names, "order"])


def _taken(kind: str, wanted: list[str] | None, tree: str) -> Iterator[tuple[int, tuple[str, int, str]]]:
    """Children of a root with the position that a node of the PQ-tree gives them."""
    own = _branches(tree)
    if kind == "Q":
        yield from enumerate(own)
    elif kind == "P":
        yield from ((wanted.index(kid[0]), kid) for kid in own)
    else:
        first = {kid[0]: kid for kid in reversed(own)}
        yield from ((i, first[tag]) for i, tag in enumerate(wanted) if tag in first)


_PLACED = "pattern string, place string, above string, position int, tag string, tree string, n long, at struct<page_id: long, node_id: int>"
_PLACED_COLUMNS = pa.schema([
    ("pattern", pa.string()), ("place", pa.string()), ("above", pa.string()), ("position", pa.int32()), ("tag", pa.string()), ("tree", pa.string()), ("n", pa.int64()),
    ("at", pa.struct([("page_id", pa.int64()), ("node_id", pa.int32())])),
])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PAGES_AT_ONCE):
            part, rows = batch.slice(start, PAGES_AT_ONCE), []
            for pattern, place, kind, wanted, tree, n, at in zip(*(part.column(c).to_pylist() for c in ("pattern", "place", "kind", "wanted", "tree", "n", "at"))):
                for i, (tag, away, kid) in _taken(kind, wanted, tree):
                    rows.append((pattern, f"{place}/{i}", place, i, tag, kid, n, {"page_id": at["page_id"], "node_id": at["node_id"] + away}))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACED_COLUMNS)], schema=_PLACED_COLUMNS)


def pq_trees(trees: DataFrame, depth: int = 4) -> DataFrame:
    """(pattern, place, above, position, kind, tag, n): PQ-trees of ``instance_trees`` (``cohorts.pq_trees``), from like subtrees at once.

    Instances hold few distinct trees at a place, fewer the lower it lies; a level reads and writes these, not nodes."""
    key, found = ["pattern", "place", "above", "position", "tag"], []
    at = trees.select("pattern", F.lit("").alias("place"), F.lit(None).cast("string").alias("above"), F.lit(0).alias("position"), "tag", "tree", "n", "at")
    for level in range(depth + 1):
        at = written(at)
        ordered = StructType([*at.schema.fields, StructType.fromDDL("order array<string>")[0]])
        held = at.mapInArrow(_ordered, ordered) if level < depth else at.withColumn("order", F.lit(None).cast("array<string>"))
        orders = held.groupBy(*key, "order").agg(F.sum("n").alias("n"), F.max(F.struct(-F.col("at.page_id"), -F.col("at.node_id"))).alias("first"))
        forms = orders.groupBy(*key).agg(
            F.count("order").alias("orders"), F.count_distinct(F.array_sort("order")).alias("bags"), F.sum("n").alias("n"),
            F.max_by("order", F.struct(F.coalesce(F.size("order"), F.lit(0)), "first")).alias("order"),
        )
        forms = written(forms.withColumn("kind", F.when(F.col("orders") == 0, "leaf").when(F.col("orders") == 1, "Q").when(F.col("bags") == 1, "P").otherwise("longest")))
        found.append(forms.select("pattern", "place", "above", "position", F.when(F.col("kind") == "longest", "Q").otherwise(F.col("kind")).alias("kind"), "tag", "n"))
        if level < depth:
            wanted = F.when(F.col("kind") == "P", F.array_sort(F.array_distinct("order"))).when(F.col("kind") == "longest", F.col("order"))
            inner = at.join(side(forms.where("kind <> 'leaf'").select("pattern", "place", "kind", wanted.alias("wanted"))), ["pattern", "place"])
            at = _distinct(inner.mapInArrow(_placed, _PLACED), *key, "tree")
    return functools.reduce(DataFrame.union, found)


def _forms(page: Page) -> Iterator[tuple]:
    kids, found = page.children(), {}
    for i, template in enumerate(page.templates):
        if page.plain[i]:
            found.setdefault((template, page.tags[i], page.heights[i], tuple(page.tags[k] for k in kids[i])), []).append(i)
    for (template, tag, height, there), own in found.items():
        yield template, tag, height, list(there), len(own), own[0]


def pattern_matches(pages: DataFrame) -> DataFrame:
    """(pattern, n, n_pages): how many nodes of how many pages match the compiled pattern of each template (``cohorts.pattern_matches``).

    A page gives its distinct nodes by template and children's tags; patterns are compiled from and compared with those."""
    forms = written(per_page(pages, _forms, "template string, tag string, height int, there array<string>, n long, node_id int", ("template",)))
    own = forms.where(~F.col("tag").isin(*FRAME) & (F.col("height") >= 1))
    tree = F.concat_ws(" ", F.concat(F.lit("0 "), "tag", F.lit(" 0")), F.array_join(F.transform(F.when(F.size("there") > 0, F.col("there")), lambda t: F.concat(F.lit("1 "), t, F.lit(" 0"))), " "))
    trees = _distinct(own.select(F.col("template").alias("pattern"), "tag", tree.alias("tree"), "n", F.struct("page_id", "node_id").alias("at")), "pattern", "tag", "tree")
    heights = own.groupBy(F.col("template").alias("pattern")).agg(F.min("height").alias("least_height"))
    patterns = compiled(pq_trees(trees, depth=1), heights)
    like = ["tag", "there", "height"]
    fits = fitting(forms.select(*like).distinct(), patterns).select(*like, "pattern")
    matched = forms.join(side(written(fits)), like).groupBy("pattern", "page_id").agg(F.sum("n").alias("n"))
    return matched.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("page_id").alias("n_pages"))
