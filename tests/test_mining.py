"""Fields, templates and tree distances of pages against brute force on parsed pages."""

import functools
import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import catalog
from weftline.operators import fields, graph, pages, templates, tree_match
from weftline.sources import kept, order_pages, table

FOLDER = "/root/testdata/sf0.001"
CARD = '<article><h2><a href="/t/{0}">T{0}</a></h2><ul><li><a href="/x/{0}">x</a><b>{0}</b></li><li><a href="/y/{0}">y</a><b>z</b></li></ul></article>'
HTML = [
    "<body><main>" + "".join(CARD.format(i) for i in range(3)) + "</main><p>Loose words.</p><p>More words.</p></body>",
    "<body><a href='/l1'><div><b>one</b></div></a><a href='/l2'><div><b>two</b></div></a><div><b>three</b></div><style>p{}</style></body>",
    "<body><a href='/l1'><div><b>one</b></div></a><a href='/l2'><div><b>two</b></div></a><div><b>three</b></div><div><b>four</b></div></body>",
    "<body><section>" + "".join(f"<{t}>{'words ' * 12}</{t}>" for t in ("h1", "p", "dl", "pre")) + "<div><i>a</i></div></section><img src='/i.png' alt='An image'></body>",
    "<body><main>" + "".join(f"<article><h2>{i}</h2><div><p><a href='/p{j}'>p</a></p></div></article>" + ("<hr>" if i else "") for i in range(2) for j in range(1)) + "</main></body>",
    "", None, "just text", "<ul><li>a<li>b <a href=' /c '>c</a></ul><script>let a = '<p>';</script>",
]


@pytest.fixture(scope="module")
def made(spark):
    """Node tables of the made pages, of the smallest tables' pages and of some customers' orders, with their rows by page."""
    own = spark.createDataFrame([(i, f"/{i}", h, 1) for i, h in enumerate(HTML)], "page_id long, url string, html string, template int")
    real = table(spark, FOLDER, "pages").select((F.col("page_id") + 1000).alias("page_id"), "url", "html", F.lit(1).alias("template"))
    orders = order_pages(spark, FOLDER).where("page_id <= 40").select((F.col("page_id") + 5000).alias("page_id"), "url", "html", F.lit(1))
    rows = kept(pages.nodes(own.union(real).union(orders)))
    by_page = {}
    for r in sorted(rows.collect(), key=lambda r: (r.page_id, r.node_id)):
        by_page.setdefault(r.page_id, []).append(r)
    return rows, by_page


def gx(path):
    return re.sub(r"\[\d+\]", "", path)


def up(rows, r):
    """Nodes strictly above one, the lowest first."""
    while r.parent_id >= 0:
        r = rows[r.parent_id]
        yield r


def read(r):
    """What a node says: (address, value)."""
    out = [("text()", r.text)] if r.text and r.tag not in ("script", "style") else []
    return out + [(f"@{a}", r.attrs[a].strip()) for a in fields.URL_ATTRIBUTES + fields.LABEL_ATTRIBUTES if (r.attrs.get(a) or "").strip()]


# ---- fields


def brute_patterns(rows):
    held = {}
    for r in rows:
        if r.tag not in fields.FRAME:
            held.setdefault(gx(r.xpath), []).append(r)
    return {p for p, own in held.items() if len(own) >= 2 and max(r.height for r in own) >= 1}


def brute_fields(rows, wanted, distinct):
    """{(pattern, instance): {accessor: values}} by looking through each subtree."""
    out = {}
    for top in rows:
        pattern = gx(top.xpath)
        if pattern not in wanted:
            continue
        found = {}
        for r in rows[top.node_id : top.last_id + 1]:
            for address, value in read(r):
                found.setdefault(f"/{top.tag}{gx(r.xpath)[len(pattern) :]}/{address}", []).append((r.node_id, value))
        found = {k: [x for _, x in v] for k, v in sorted(found.items(), key=lambda e: (e[1][0][0], e[0]))}
        if wanted[pattern] is not None:
            found = {k: v for k, v in found.items() if k in wanted[pattern]}
        if found:
            out[pattern, top.xpath] = {k: list(dict.fromkeys(v)) if distinct else v for k, v in found.items()}
    return out


def test_summary_fields_equal_brute_force(made):
    rows, by_page = made
    expected = {(p, *k): v for p, own in by_page.items() for k, v in brute_fields(own, dict.fromkeys(brute_patterns(own)), True).items()}
    got = {(r.page_id, r.pattern, r.instance): r.fields for r in fields.summary_fields(rows, fields.patterns(rows)).collect()}
    assert len(expected) > 500 and got == expected


def test_pattern_query_reads_other_pages_and_drops_empty_instances(spark, made):
    rows, by_page = made
    routes = fields.accessors(fields.instance_values(rows, fields.patterns(rows)))
    wanted = {}
    for r in routes.collect():
        wanted.setdefault(r.pattern, set()).add(r.accessor)
    expected = {(p, *k): v for p, own in by_page.items() for k, v in brute_fields(own, wanted, False).items()}
    found = fields.rendered_instances(rows, routes).collect()
    assert {(r.page_id, r.pattern, r.instance): r.fields for r in found} == expected
    assert len(expected) > sum(len(brute_fields(own, dict.fromkeys(brute_patterns(own)), False)) for own in by_page.values())
    for r in found:
        held = expected[r.page_id, r.pattern, r.instance]  # accessors in page order
        assert r.text == naive_text(held) and r.lines == naive_tree(held)
    few = spark.createDataFrame([("/html/body/nav/ul/li", "/li/a/@title")], "pattern string, accessor string")
    assert fields.pattern_query(rows, few).count() == 0
    assert fields.pattern_query(rows.limit(0), routes).count() == 0


def nested(paths):
    """A trie of paths as nested dicts, chains of tags merged."""
    trie = {}
    for path in paths:
        parts, at = [s for s in path.split("/") if s], trie
        for s in parts[:-1]:
            at = at.setdefault(f"/{s}", {})
        at[parts[-1]] = None

    def merged(t):
        out = {}
        for k, v in t.items():
            while v is not None and len(v) == 1 and next(iter(v)).startswith("/"):
                (step, v), = v.items()
                k += step
            out[k] = None if v is None else merged(v)
        return out

    return merged(trie)


def test_extraction_trie_equals_nested_dicts(spark, made):
    rows, _ = made
    routes = fields.accessors(fields.instance_values(rows, fields.patterns(rows)), "page_id")
    more = [(-1, "/p", a) for a in ("/p/a/b/text()", "/p/a/b/@href", "/p/a/c/d/e/text()", "/p/q/r/text()", "/p/text()", "/p/a/c/d/f/@src")] + [(-2, "/s", "/s/t/u/text()")]
    routes = routes.union(spark.createDataFrame(more, routes.schema))
    wanted, got = {}, {}
    for r in routes.collect():
        wanted.setdefault((r.page_id, r.pattern), []).append(r.accessor)
    for r in fields.extraction_trie(routes, "page_id").collect():
        got.setdefault((r.page_id, r.pattern), []).append((r.above, r.step, r.is_leaf))

    def flat(t, path=""):
        for k, v in t.items():
            yield path, k, v is None
            if v is not None:
                yield from flat(v, path + k)

    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(flat(nested(v))) for k, v in wanted.items()}


def kind(key):
    end = [x for x in key.split("/") if x][-1:] or [""]
    end = end[0].lower()
    return "text" if end == "text()" else "url" if end[1:] in fields.URL_ATTRIBUTES and end[0] == "@" else "label" if end[1:] in fields.LABEL_ATTRIBUTES and end[0] == "@" else None


def naive_tree(held):
    units = []
    for key, values in (held or {}).items():
        plain = [" ".join(re.sub(r"<[a-zA-Z!/][^>]*>", " ", v).split()) for v in values]
        value = next((v for v in plain if v), "")
        if value and kind(key):
            m = re.match(r"data:([^;,]*)[;,]", value) if kind(key) == "url" else None
            units.append((kind(key), f"data:{m[1] or 'inline'}" if m else value))
    said = [(v, frozenset(re.findall(r"[^\W_]+", v.lower()))) for k, v in units if k != "url"]
    kept_lines = [v for i, (v, w) in enumerate(said) if not w or not any(w < o or w == o and j < i for j, (_, o) in enumerate(said))]
    lines, i = [], 0
    while i < len(kept_lines):
        joined = kept_lines[i].endswith(":") and i + 1 < len(kept_lines)
        lines.append(" ".join(kept_lines[i : i + 1 + joined]))
        i += 1 + joined
    return "\n".join([*dict.fromkeys(v for k, v in units if k == "url"), *lines])


def naive_text(held):
    from weftline.functions.url import STOP_WORDS

    parts = []
    for key, values in held.items():
        for v in values:
            if kind(key) == "url":
                words = re.split(r"[/?&#=.:_\-]+", re.split(r"[?#]", v)[0].lower())
                parts.append(" ".join([w for w in dict.fromkeys(words) if len(w) >= 3 and not w.isdigit() and w not in STOP_WORDS][:8]))
            else:
                parts.append(" ".join(v.split()))
    return " ".join(p for p in parts if p)


def test_content_tree_cases(spark):
    cases = [
        ({"/a/@href": ["/go"], "/a/h3/@title": ["Big News Today"], "/a/h3/text()": ["Big  News\nToday"], "/a/img/@src": [" ", "/i.png"]}, "/go\n/i.png\nBig News Today"),
        ({"/li/p/text()": ["Kind:"], "/li/b/text()": ["Paper"], "/li/i/text()": ["12"]}, "Kind: Paper\n12"),
        ({"/li/p/text()": ["Kind:"], "/li/b/text()": ["Size:"], "/li/i/text()": ["12:"]}, "Kind: Size:\n12:"),
        ({"/li/@title": ["7 readers"], "/li/b/text()": ["readers:"], "/li/i/text()": ["7"]}, "7 readers"),
        ({"/x/img/@alt": [""], "/x/img/@src": ["data:image/svg+xml,%3csvg"], "/y/img/@src": ["data:,x"]}, "data:image/svg+xml\ndata:inline"),
        ({"/a/@title": ["東京 タワー"], "/a/text()": ["東京 タワー 夜景"]}, "東京 タワー 夜景"),
        ({"/a/@aria-label": ["Amélie Æon"], "/a/h3/text()": ["amélie æon"]}, "Amélie Æon"),
        ({"/n/text()": ['<iframe src="x"></iframe>'], "/p/text()": ["a < b and <i>c</i> <$5"]}, "a < b and c <$5"),
        ({"/p/@class": ["box"], "/p/text()": ["!?"], "/q/text()": ["!?"], "": ["x"]}, "!?\n!?"),
        ({}, ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(cases)], "i int, f map<string,array<string>>")
    got = {r.i: r.t for r in df.select("i", fields.content_tree(F.col("f")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases] == [naive_tree(f) for f, _ in cases]


def test_fields_as_json(made):
    rows, _ = made
    one = fields.summary_fields(rows.where("page_id = 0"), fields.patterns(rows.where("page_id = 0"))).where("instance like '%/article[1]'").select(F.to_json("fields").alias("j")).first().j
    assert list(json.loads(one)) == ["/article/h2/a/@href", "/article/h2/a/text()", "/article/ul/li/a/@href", "/article/ul/li/a/text()", "/article/ul/li/b/text()"]


# ---- templates


def element(r):
    return r.tag not in templates.SKIPPED + templates.FRAME


def says(r):
    return bool(r.text) or "href" in r.attrs or "src" in r.attrs


def below(rows, r):
    return [x for x in rows[r.node_id : r.last_id + 1] if element(x)]


def brute_groups(rows, least_height=1):
    held = {}
    for r in rows:
        if element(r) and r.height >= least_height and any(map(says, below(rows, r))):
            held.setdefault(r.template, []).append(r)
    held = {t: own for t, own in held.items() if len(own) >= 2}
    inside = lambda own, other: all(any(o.node_id < r.node_id <= o.last_id for o in other) for r in own)
    out = {t: own for t, own in held.items() if not any(other[0].height > own[0].height and inside(own, other) for other in held.values())}
    linked = lambda r: any(x.tag == "a" and "href" in x.attrs for x in up(rows, r))
    return {t: own for t, own in out.items() if not all(map(linked, own))}


def free_of(rows, tops):
    return [r for r in rows if not any(t.node_id <= r.node_id <= t.last_id for t in tops)]


def brute_sections(rows, groups):
    tops = [r for own in groups.values() for r in own]
    kids = {}
    for r in free_of(rows, tops):
        chars = sum(len(x.text) for x in below(rows, r))
        if element(r) and says(r) and chars:
            kids.setdefault(r.parent_id, []).append(chars)
    free = {r.node_id for r in free_of(rows, tops)}
    found = [rows[p] for p, c in kids.items() if len(c) >= 3 and sum(c) >= 150 and p in free and element(rows[p])]
    return [(r, len(kids[r.node_id]), sum(kids[r.node_id])) for r in found if not any(x in found for x in up(rows, r))]


def test_template_groups_sections_and_orphans_equal_brute_force(made):
    rows, by_page = made
    groups = kept(templates.template_groups(rows))
    brute = {p: brute_groups(own) for p, own in by_page.items()}
    assert {(r.page_id, r.node_id) for r in groups.collect()} == {(p, r.node_id) for p, g in brute.items() for own in g.values() for r in own}
    sections = kept(templates.singleton_sections(rows, groups))
    found = {p: brute_sections(own, brute[p]) for p, own in by_page.items()}
    assert {(r.page_id, r.node_id, r.n, r.n_chars) for r in sections.collect()} == {(p, r.node_id, n, c) for p, own in found.items() for r, n, c in own}
    assert sum(map(len, found.values())) > 5
    orphans = {}
    for p, own in by_page.items():
        tops = [r for g in brute[p].values() for r in g] + [r for r, _, _ in found[p]]
        for r in free_of(own, tops):
            if element(r) and says(r):
                orphans.setdefault((p, r.parent_id, "link" if "href" in r.attrs else "text"), []).append(r.node_id)
    expected = {(*k, len(v), min(v)) for k, v in orphans.items() if len(v) >= 2}
    assert {(r.page_id, r.parent_id, r.kind, r.n, r.first_id) for r in templates.orphan_groups(rows, groups, sections).collect()} == expected and expected


def test_instances_in_links_give_way_to_the_links(made):
    rows, by_page = made
    groups = kept(templates.template_groups(rows))
    expected = set()
    for p, own in by_page.items():
        for t, members in brute_groups(own).items():
            links = {r.node_id: next((x.node_id for x in up(own, r) if "href" in x.attrs and x.tag not in templates.FRAME), None) for r in members}
            inside = [r for r in members if "href" not in r.attrs and links[r.node_id] is not None]
            free = [r for r in members if r not in inside]
            if not inside or len(free) >= 2:
                expected |= {(p, t, r.node_id, False) for r in free}
            elif len({x for x in links.values() if x is not None}) >= 2:
                expected |= {(p, t, x, True) for x in links.values() if x is not None}
    got = {tuple(r) for r in templates.promoted_instances(rows, groups).select("page_id", "template", "node_id", "promoted").collect()}
    assert got == expected
    assert any(promoted for *_, promoted in got)


def test_sub_templates_equal_brute_force(made):
    rows, by_page = made
    groups = kept(templates.template_groups(rows))
    expected = set()
    for p, own in by_page.items():
        mined = brute_groups(own)
        instances = {r.node_id for g in mined.values() for r in g}
        holding = {x.node_id for g in mined.values() for r in g for x in up(own, r)}
        children = {}
        for r in own:
            if r.tag not in templates.SKIPPED:
                children.setdefault(r.parent_id, []).append(r)
        for t, members in mined.items():
            hrefs = lambda r: {x.attrs["href"] for x in own[r.node_id : r.last_id + 1] if "href" in x.attrs}
            if not any(len(hrefs(r)) >= 2 or len(children.get(r.node_id, [])) >= 3 for r in members):
                continue
            pool = {}
            for r in members:
                queue = [r]
                while queue:
                    at = queue.pop()
                    kids = children.get(at.node_id, [])
                    free = [k for k in kids if k.node_id not in instances | holding]
                    queue += free
                    for k in free if len(kids) >= 2 else []:
                        pool.setdefault(k.shape, []).append(k)
            for shape, kids in pool.items():
                url = any("href" in x.attrs or "src" in x.attrs for k in kids for x in own[k.node_id : k.last_id + 1])
                if len(kids) >= max(2, len(members)) and kids[0].height >= 2 and url:
                    expected.add((p, t, shape, kids[0].tag, kids[0].height, len(kids), min(k.node_id for k in kids)))
    assert {tuple(r) for r in templates.sub_templates(rows, groups).select("page_id", "template", "shape", "tag", "height", "n", "first_id").collect()} == expected and expected


# ---- trees


def random_tree(rnd, size):
    """Tags and depths in page order."""
    depths = [0]
    for _ in range(size - 1):
        depths.append(rnd.randint(1, depths[-1] + 1))
    return [rnd.choice("abc") for _ in depths], depths


def to_nested(labels, depths):
    tree, stack = None, []
    for tag, d in zip(labels, depths):
        node = (tag, [])
        del stack[d:]
        if stack:
            stack[-1][1].append(node)
        tree = tree or node
        stack.append(node)
    freeze = lambda n: (n[0], tuple(freeze(c) for c in n[1]))
    return freeze(tree)


@functools.cache
def forest_distance(a, b):
    """By taking off the last root of either forest."""
    count = lambda f: sum(1 + count(c) for _, c in f)
    if not a or not b:
        return count(a or b)
    (x, xs), (y, ys) = a[-1], b[-1]
    return min(forest_distance(a[:-1] + xs, b) + 1, forest_distance(a, b[:-1] + ys) + 1, forest_distance(a[:-1], b[:-1]) + forest_distance(xs, ys) + (x != y))


def common(a, b):
    """Largest common subtree by trying all matchings."""
    if a[0] != b[0]:
        return 0
    few, many = sorted((a[1], b[1]), key=len)
    scores = [[common(x, y) for y in many] for x in few]
    return 1 + max((sum(scores[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(many)), len(few))), default=0)


def test_edit_distance_equals_recursion():
    rnd = random.Random(5)
    for _ in range(200):
        x, y = random_tree(rnd, rnd.randint(1, 11)), random_tree(rnd, rnd.randint(1, 11))
        assert tree_match.edit_distance(*x, *y) == forest_distance((to_nested(*x),), (to_nested(*y),))
    assert tree_match.edit_distance([], [], ["a"], [0]) == 1


def test_common_subtree_and_assignment_equal_permutations():
    rnd, rng = random.Random(6), np.random.default_rng(6)
    for _ in range(200):
        x, y = random_tree(rnd, rnd.randint(1, 9)), random_tree(rnd, rnd.randint(1, 9))
        assert tree_match.common_subtree(*x, *y) == common(to_nested(*x), to_nested(*y))
    for _ in range(100):
        gain = rng.integers(0, 9, (rng.integers(1, 6), rng.integers(1, 6)))
        few, many = sorted(gain.shape)
        whole = gain if gain.shape[0] <= gain.shape[1] else gain.T
        assert tree_match.assignment(gain) == max(sum(whole[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(many), few))


def test_trees_are_paired_without_loss(made):
    rows, by_page = made
    roots = rows.where("page_id < 1030 and height >= 1 and tag not in ('#document', 'html', 'head', 'body')").select("page_id", "node_id", "xpath")
    held = kept(templates.trees(rows, roots))
    trees = {}
    for r in held.collect():
        top = by_page[r.page_id][r.root_id]
        level = top.xpath.count("/")
        inner = [x for x in by_page[r.page_id][top.node_id : top.last_id + 1] if x.tag not in templates.SKIPPED and x.xpath.count("/") - level <= 4]
        assert (r.labels, r.depths) == ([x.tag for x in inner], [x.xpath.count("/") - level for x in inner])
        trees.setdefault(r.page_id, {})[r.root_id] = (r.labels, r.depths)
    assert sum(map(len, trees.values())) == roots.count()
    near, alike = set(), set()
    for p, own in trees.items():
        for a, b in itertools.combinations(sorted(own), 2):
            x, y = own[a], own[b]
            if abs(len(x[0]) - len(y[0])) <= 3 and (d := tree_match.edit_distance(*x, *y)) <= 3:
                near.add((p, a, b, d))
            if x[0][0] == y[0][0] and min(len(x[0]), len(y[0])) >= 3 and abs(max(x[1]) - max(y[1])) <= 1 and 100 * (c := tree_match.common_subtree(*x, *y)) >= 80 * min(len(x[0]), len(y[0])):
                alike.add((p, a, b, c))
    assert near and {(r.page_id, r.a, r.b, r.distance) for r in tree_match.near_trees(held).collect()} == near
    assert alike and {(r.page_id, r.a, r.b, r.common) for r in tree_match.similar_trees(held).collect()} == alike


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in graph.components_of(spark.createDataFrame(edges, "src long, dst long")).collect()} == root
    assert graph.components_of(spark.createDataFrame(edges, "src long, dst long").limit(0)).count() == 0


# ---- plans


@pytest.mark.parametrize("name", ["sibling_cohorts", "template_groups", "tree_distances", "common_subtrees", "settled_signatures", "merged_templates"])
def test_node_tables_are_not_gathered_for_broadcasts(spark, name):
    """Spark underestimates parsed tables, so that a join with one would be a broadcast of millions of nodes."""
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_order_pages_are_parsed_in_many_tasks(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert order_pages(spark, FOLDER).rdd.getNumPartitions() >= max(parts, 2 * spark.sparkContext.defaultParallelism)


def test_nodes_without_hashes_are_the_same_rows(spark):
    rows = order_pages(spark, FOLDER).where("page_id <= 40")
    whole, bare = pages.nodes(rows).drop("exact", "template", "shape"), pages.nodes(rows, hashes=False)
    text = lambda df: df.withColumn("attrs", F.to_json("attrs"))
    assert bare.columns == whole.columns and text(bare).exceptAll(text(whole)).isEmpty() and bare.count() == whole.count() > 0


def test_trees_are_found_by_one_join_and_read_once_by_both_sides(spark):
    rows = kept(pages.nodes(order_pages(spark, FOLDER).where("page_id <= 20")))
    roots = rows.where("height >= 1").groupBy("page_id", "template").agg(F.min("node_id").alias("node_id")).join(rows.select("page_id", "node_id", "xpath"), ["page_id", "node_id"])
    held = templates.trees(rows, kept(roots))
    joins = lambda df: re.findall(r"^[ (\d)*+:-]*\w*Join ", df._jdf.queryExecution().executedPlan().toString(), re.M)
    assert len(joins(held)) == 1
    for pairs in (tree_match.near_trees(held), tree_match.similar_trees(held)):
        assert len(joins(pairs)) == 1  # of the pairs; the trees aren't made anew for each side
