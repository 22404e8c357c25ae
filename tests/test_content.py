"""Kept elements, pruned trees, categories and tags against plain walks over parsed pages."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import content, pages
from weftline.sources import kept, order_pages, table

FOLDER = "/root/testdata/sf0.001"
HTML = [
    "<body><div><div><section><p>one</p></section></div><div></div><div><i> </i></div></div><ul><li><a href='/x.png?a'>x</a></li><li><b><a href='b/c.html'></a></b></li></ul></body>",
    "<main><input type='image' src='i.gif'><div role='Heading'></div><div role='button' onclick='go()' onblur='x'>Go!</div><div contenteditable='TRUE'></div><p contenteditable=''>q</p><label>n</label></main>",
    "<div style=\"background:url('bg.jpg') url(data:text/plain,a) url(data:image/png;base64,AA)\"></div><img srcset='/a.png 1x, /b.webp 2x' alt=' A cat '><video poster='data:image/png;base64,QQ'></video><a href='javascript:x()'>no</a><a href='mailto:a@b.c/d'>mail</a>",
    "<noscript><p>copy</p></noscript><template></template><figure role='figure'></figure><span title='--'></span><span data-title='T 1' data-x='//cdn.net/a'></span><span data-y='no / dot. here'></span><audio></audio><div value='v'></div>",
    "<table>" + "<tr><td>a<td>b</tr>" * 30 + "</table>", "<p>" + "word " * 50_000 + "</p>", "<div>" * 300 + "deep" + "</div>" * 300, "", None, "<div><p></p><p></p></div>",
]


@pytest.fixture(scope="module")
def made(spark):
    own = spark.createDataFrame([(i, f"/{i}", h) for i, h in enumerate(HTML)], "page_id long, url string, html string")
    real = table(spark, FOLDER, "pages").select((F.col("page_id") + 1000).alias("page_id"), "url", "html")
    orders = order_pages(spark, FOLDER).where("page_id <= 20").select((F.col("page_id") + 5000).alias("page_id"), "url", "html")
    rows = kept(pages.nodes(own.union(real).union(orders)))
    by_page = {}
    for r in sorted(rows.collect(), key=lambda r: (r.page_id, r.node_id)):
        by_page.setdefault(r.page_id, []).append(r)
    return rows, by_page


def _url(v):
    v = v.strip(" ")
    return v == "/" or len(v) >= 2 and (v.lower().startswith(("http://", "https://", "/", "data:image/")) or "/" in v and "." in v and " " not in v and len(v) < 500)


def _facts(r):
    import re

    values = {v.strip(" ").lower() for v in r.attrs.values()}
    css = [u for u in re.findall(r"url\(['\"]?([^'\")\s]+)['\"]?\)", r.attrs.get("style", "")) if not u.startswith("data:") or u.startswith("data:image/")]
    urls = [v for k, v in r.attrs.items() if k not in content.NO_ADDRESSES and _url(v)] + css
    button = r.tag == "button" or bool(values & set(content.BUTTON_VALUES))
    entry = r.tag in content.INPUTS or bool(values & set(content.INPUT_VALUES)) or r.attrs.get("contenteditable", "").strip(" ").lower() == "true"
    return urls, button, entry, r.tag in content.HEADINGS or "heading" in values


def _content(r):
    urls, *roles = _facts(r)
    return r.tag not in content.SKIPPED and (r.text != "" or bool(urls) or r.tag in content.MEDIA or any(roles) or any(r.attrs.get(k, "").strip(" ") for k in content.TELLING))


def _children(rows):
    below = {r.node_id: [] for r in rows}
    for r in rows[1:]:
        below[r.parent_id].append(r.node_id)
    return below


def test_kept_nodes_are_content_and_what_is_above(made):
    rows, by_page = made
    want = set()
    for page, nodes in by_page.items():
        keep = {r.node_id for r in nodes if _content(r)}
        for r in reversed(nodes):
            if r.node_id in keep and r.parent_id >= 0:
                keep.add(r.parent_id)
        want |= {(page, i) for i in keep}
    assert {(r.page_id, r.node_id) for r in content.keep_set(rows).collect()} == want


def test_pruned_trees_equal_splicing_bottom_up(made):
    rows, by_page = made
    want = set()
    for page, nodes in by_page.items():
        below = _children(nodes)
        for r in reversed(nodes):  # children first
            new = []
            for c in below[r.node_id]:
                if _content(nodes[c]) or len(below[c]) >= 2:
                    new.append(c)
                elif len(below[c]) == 1:
                    new += below[c]
            below[r.node_id] = new
        todo = [(0, -1, 0)]
        while todo:
            node, parent, level = todo.pop()
            want.add((page, node, parent, level, nodes[node].tag))
            todo += [(c, node, level + 1) for c in below[node]]
    got = [(r.page_id, r.node_id, r.parent_id, r.level, r.tag) for r in content.without_empty_branches(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_categories_and_link_lists(made):
    rows, by_page = made
    got = {(r.page_id, r.node_id): r.c for r in rows.select("page_id", "node_id", content.categories().alias("c")).collect()}
    lists = {}
    for page, nodes in by_page.items():
        leads = {r.node_id for r in nodes if _facts(r)[0]}
        for r in reversed(nodes):
            urls, button, entry, _ = _facts(r)
            some = [n for n, x in (("button", button), ("input", entry), ("link", urls or r.tag in content.MEDIA), ("text", len(r.text) > 2)) if x]
            assert got[page, r.node_id] == ([] if r.tag in content.SKIPPED + content.DOCUMENT else some)
            if r.node_id in leads and r.parent_id >= 0:
                leads.add(r.parent_id)
        for i, below in _children(nodes).items():
            if len(leads & set(below)) >= 2:
                lists[page, i] = len(leads & set(below))
    assert {(r.page_id, r.node_id): r.n for r in content.link_containers(rows).collect()} == lists


def test_tags_of_made_pages(made):
    rows, _ = made
    found = {p: set() for p in range(len(HTML))}
    for r in content.tags(rows.where(f"page_id < {len(HTML)}")).collect():
        found[r.page_id].add((r.category, r.kind, r.value, r.source))
    assert found[0] == {("text", "visible", "one", ""), ("text", "visible", "x", ""), ("interactive", "links", "a", ""), ("urls", "internal", "/x.png?a", "href"), ("media", "images", "/x.png?a", "href"), ("urls", "internal", "b/c.html", "href")}
    assert found[1] == {
        ("interactive", "inputs", "input", ""), ("media", "images", "input", ""), ("urls", "internal", "i.gif", "src"), ("media", "images", "i.gif", "src"), ("interactive", "buttons", "div[role=button]", "role"),
        ("interactive", "event_handlers", "div[onblur]", "onblur"), ("text", "visible", "Go!", ""), ("interactive", "inputs", "p[contenteditable]", "contenteditable"), ("text", "visible", "q", ""), ("interactive", "forms", "label", ""), ("text", "visible", "n", ""),
    }
    assert {t for t in found[2] if t[0] == "urls"} == {("urls", "internal", "bg.jpg", "style"), ("urls", "resource", "data:text/plain,a", "style"), ("urls", "resource", "data:image/png;base64,AA", "style"), ("urls", "internal", "/a.png", "srcset"), ("urls", "internal", "/b.webp", "srcset"), ("urls", "resource", "data:image/png;base64,QQ", "poster")}
    assert ("text", "accessible", "A cat", "alt") in found[2] and ("media", "video", "video", "") in found[2] and ("media", "images", "bg.jpg", "style") in found[2]
    assert ("text", "metadata", "T 1", "data-title") in found[3] and ("urls", "external", "//cdn.net/a", "data-x") in found[3] and not any(t[3] in ("title", "data-y") for t in found[3])
    assert found[7] == found[8] == found[9] == set()


def test_an_empty_table_gives_no_rows(made):
    none = made[0].where("page_id < 0")
    assert [f(none).count() for f in (content.keep_set, content.without_empty_branches, content.tags, content.link_containers)] == [0] * 4
