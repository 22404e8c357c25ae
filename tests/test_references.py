"""References between texts against a recursive version."""

import random
import re

from weftline.operators import references


def slug(name):
    return re.sub("[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_")


def brute(concepts, text, seen=frozenset(), depth=0, most=8):
    if depth >= most:
        return text

    def found(m):
        s = slug(m[1])
        if not s or s in seen:
            return m[0]
        hits = [c for c in concepts if c[0] == s] or sorted(c for c in concepts if slug(c[1]) == s)
        return brute(concepts, hits[0][2] or "", seen | {s}, depth + 1, most) if hits else m[0]

    return re.sub(references.REFERENCE, found, text)


def made():
    rnd = random.Random(11)
    names = [f"Concept {i % 9}" for i in range(14)]
    refs = [*names, "c3", "c5", "nobody", "CONCEPT-2", "a.b", "1x", ""]
    text = lambda: "".join(rnd.choice(["a ", "{", "}", "\n", f"{{{rnd.choice(refs)}}}", "$1 \\ "]) for _ in range(rnd.randrange(5)))
    return [(f"c{i}", n if i != 4 else None, None if i == 6 else text()) for i, n in enumerate(names)] + [("long", "Long", "x" * 50_000 + "{c3}" + "y" * 50_000)]


def test_resolved_equals_recursion(spark):
    rows = made()
    df = spark.createDataFrame(rows, "id string, name string, data string")
    for depth in (1, 2, 8):
        assert {r.id: r.text for r in references.resolved(df, depth).collect()} == {i: brute(rows, d or "", most=depth) for i, _, d in rows}
    assert references.resolved(df.limit(0)).count() == 0


def test_cascade_equals_breadth_first_search(spark):
    rows = made()
    df = spark.createDataFrame(rows, "id string, name string, data string")
    uses = lambda c, t: c[0] != t[0] and any(ref == t[0] or slug(ref) == slug(t[1]) and slug(t[1]) for ref in re.findall(references.REFERENCE, c[2] or ""))
    expected = set()
    for t in rows:
        seen, frontier, distance = {t[0]}, [t], 0
        while frontier:
            distance += 1
            frontier = [c for c in rows if c[0] not in seen and any(uses(c, f) for f in frontier)]
            seen |= {c[0] for c in frontier}
            expected |= {(t[0], c[0], distance) for c in frontier}
    assert expected and {tuple(r) for r in references.cascade(df, df.select("id")).collect()} == expected
