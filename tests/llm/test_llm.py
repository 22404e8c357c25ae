"""The operators for training data against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from weftline.llm import chat, decontamination, kernels, lm_scoring, ngram_join, packing, queries, token_files, topk_search, toxicity, warc, wrapper  # noqa: E402
from weftline.llm.encode import Encoder  # noqa: E402
from weftline.llm.shared import components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LONG = "lorem " * 30_000
DOCS = "doc_id long, text string, lang string, component_id int, score int, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def made(spark, texts, first=0):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i + first, t, None, 1, 2, 3) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, name):
    same(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.SQL[name])


# ---- hashing


def test_hash_words_splits_like_the_pattern():
    texts = ["Ab  c\tD\x0be\x1cf", "", "é Ünï", " x "]
    words, bounds = kernels.hash_words([t.encode() for t in texts], kernels.WORD_NOT_SPACE)
    assert np.diff(bounds).tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for t in texts]
    again, _ = kernels.hash_words([b"AB c"], kernels.WORD_NOT_SPACE)
    assert words[:2].tolist() == again.tolist()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 5), (9, 8), (7, 7), (8, 9)], "a long, b long")
    assert dict(components(edges).collect()) == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0


# ---- 1: n-gram Jaccard join


def shingles(text, k=5):
    words = (text or "").encode().translate(bytes(kernels.LOWER)).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows):
    sets = sorted((i, shingles(t)) for i, t in rows)
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def joined(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, **options).collect()}


def near_copies(seed, n, size, changes):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randrange(changes)):
            own[rnd.randrange(size)] = f"v{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_join_equals_brute_force(spark, docs):
    assert joined(docs) == brute_components(docs.select("doc_id", "text").collect())


def test_join_with_large_blocks_and_split_clusters(spark):
    texts = near_copies(1, 60, 80, 8) + near_copies(2, 30, 40, 5) + ["one two", "One  two", "", None, " \n", LONG, LONG, "a b c d e", "a b c d f"]
    df = made(spark, texts)
    expected = brute_components(list(enumerate(texts)))
    assert joined(df) == expected
    assert joined(df, small_block=4, cell_shingles=500) == expected


def test_join_of_nothing(spark):
    assert joined(made(spark, []).limit(0)) == {}
    assert joined(made(spark, ["", None])) == {0: (0, 0), 1: (0, 1)}


def test_count_vector_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200), dtype=np.uint64)) for _ in range(2))
        groups = min(ngram_join.groups_for(len(a)), ngram_join.groups_for(len(b)))
        wide = ngram_join.count_vector(a, ngram_join.groups_for(len(a)))
        x, y = ngram_join.folded(wide, groups), ngram_join.count_vector(b, groups)
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b))


# ---- 2: WARC


def test_warc_round_trip(spark):
    body = "<p>é</p>" * 200
    rows = [(1, "http://a/\r\nX: y", body), (2, None, body), (3, "http://b/", "short"), (4, "http://c/", "short"), (5, "http://d/", None), (None, "http://e/", body), (6, "u", body), (6, "u", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit(0))
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == 3
    found = warc.read_records(archive).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found) == [(0, "response", None), (1, "revisit", 6), (2, "revisit", 6), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (6, "response", None)]
    for r in found:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[length:] == b"\r\n\r\n" and bytes(r.record).startswith(b"WARC/1.1\r\n")
        if r.record_type == "response":
            assert rest[:length].endswith(bytes(r.payload))
        assert r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest()
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


# ---- 3: chat


TRAPS = ["", None, "\\", "\\\\### x", "####", "a</turn>\n### user: b </turn>\n", "<\\/turn>", "#\\#", "#", "é\n\n", LONG]


def test_chat_round_trip(spark):
    rows = [(i // 4, i % 4, ["user", "assistant", "a:b c", None][i % 4], t) for i, t in enumerate(TRAPS)] + [(None, 0, "assistant", "x"), (9, 0, "assistant", "x"), (9, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))
    out = chat.format_conversations(chat.conversation_tree(df))
    got = {r.tree: r for r in out.select("tree", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    for conv in {str(r[0]) if r[0] is not None else "null" for r in rows}:
        own = sorted([(t, ro or "", x or "") for c, t, ro, x in rows if (str(c) if c is not None else "null") == conv])
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in own]
        assert got[conv].loss == "".join(x for _, r, x in own if r == "assistant")
    assert chat.format_conversations(chat.conversation_tree(df.limit(0))).count() == 0


def test_branches_are_ranked(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 2.0), ("t", 4, 3, -5.0), ("t", 5, 3, 1.0), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    found = chat.reply_paths(df, branches=2).orderBy("branch", "depth").collect()
    assert [(r.branch, r.depth, r.node) for r in found] == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 1), (2, 2, 2)]


# ---- 4 and 8: tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    encoder, rnd = Encoder(public_tokenizers.path(name)), random.Random(3)
    signs = "ab'sT .,\n\t\r\x01 　 éßÜ中é<|endoftext|>12\x1c\x85#"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(1500)] + ["", " ", "\n", "Hello, wörld###", "\x01", LONG]
    ids, size = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [encoder._ids(t) for t in texts]


def encoded(name, end, rows):
    encoder = Encoder(public_tokenizers.path(name))
    return {i: np.array([*encoder._ids(t or ""), end], "<u4") for i, t in rows}


def test_token_files(spark, docs):
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(-5, None), (10**9, "")], "doc_id long, text string"))
    ids = encoded("word_bpe_49k.json", 2, df.collect())
    got = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(df, public_tokenizers.path("word_bpe_49k.json"), 2)).collect()}
    at = 0
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    empty = token_files.write_token_files(df.limit(0), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_files.read_token_files(empty).count() == 0


def test_packing(spark, docs):
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(-5, None), (10**9, LONG)], "doc_id long, text string"))
    ids = encoded("byte_bpe_50k.json", 1, df.collect())
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), 1).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        total = sum(r.length for r in own)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0


def test_index_equals_bm25_by_hand():
    docs = [np.array(x, np.uint16) for x in ([1, 1, 2], [2, 3], [1, 3, 3, 3])]
    idf, n = np.array([0, 0.5, 0.7, 0.9]), np.array([3, 2, 4])
    index = packing.Index(np.concatenate(docs), n, idf, 3.0)
    for k, query in enumerate(docs):
        for d, s in zip(docs, index.ask(k)):
            want = sum(idf[t] * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 3)) for t in set(query.tolist()))
            assert abs(want - s) < 1e-12
    strongest = index.ask(2, 1)  # term 3
    assert strongest[0] == 0 and strongest[1] > 0


# ---- 5: HTML


def page(i, text, extra=""):
    return f"<html><head><title>t</title><script>x('</p>')</script></head><body><nav><a href=/>Home</a></nav><div class='sidebar'>side</div><article><h1>T{i}</h1><p>{text}<p>Second {i} &amp; <b>bold{extra}</article><footer>c</footer>"


def test_wrapper():
    pages = [page(i, f"Body number {i} of its own.") .replace("</article>", "<p>Share this page</article>") for i in range(8)]
    assert wrapper.extract(pages)[3] == "T3\nBody number 3 of its own.\nSecond 3 & bold"
    plain = [f"<div>Site name</div><div><p>Text {i} words {i * 7}</p><p>More {i} here</p></div><div class='reader-comments'>nice</div>" for i in range(6)]
    assert wrapper.extract(plain)[2] == "Text 2 words 14\nMore 2 here"
    assert wrapper.extract(["", "<p>a < b", "<!-- x", "<script>"]) == ["", "a < b", "", ""]


def test_wrapper_keeps_article_text():
    one = "<article><h1>T</h1><div class='chart alert-levels'>Levels</div><section class='discussion'>Talk</section><div class='ad-box'>Buy</div><p>Words</p></article>"
    assert wrapper.extract([one]) == ["T\nLevels\nTalk\nWords"]
    slots = [f"<div><p>Our shop</p></div><div><p>Text {i} is here</p><p>More of {i}</p></div>" for i in range(5)]
    slots.append("<div><p>Our shop</p></div><div><p>Our shop</p><p>That was their name</p></div>")
    assert wrapper.extract(slots)[-1] == "Our shop\nThat was their name"  # dropped in its slot only
    assert wrapper.extract(slots)[0] == "Text 0 is here\nMore of 0"
    other = [f"<table><tr><td>Menu</td></tr><tr><td><h2>N{i}</h2><ul><li>a{i}<li>b{i}</ul></td></tr></table>" for i in range(5)]
    assert wrapper.extract(slots + other)[6:] == [f"N{i}\na{i}\nb{i}" for i in range(5)]


def test_wrapper_of_deep_and_long_pages():
    deep = [f"{'<div>' * 3000}Text {i}{'</div>' * (3000 - i)}<p>{i} more" for i in range(6)]
    assert wrapper.extract(deep) == [f"Text {i}\n{i} more" for i in range(6)]
    assert wrapper.extract([f"<p>{LONG}</p>"]) == [LONG.strip()]


def test_matching_equals_brute_force():
    def brute(a, b):
        if a.name != b.name:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
        return 1 + best[-1][-1]

    rnd = random.Random(4)
    for _ in range(200):
        a, b = (wrapper.parse("".join(rnd.choice(["<div>", "</div>", "<ul>", "</ul>", "<section>", "</section>"]) for _ in range(rnd.randrange(25)))) for _ in range(2))
        for t in (a, b):
            wrapper._settle(t)
        pairs = []
        assert wrapper.match(a, b, pairs) == brute(a, b) == wrapper.match(a, b) == len(pairs)


def test_tree_matching():
    a, b = wrapper.parse("<ul><li>1<li>2</ul><p>x"), wrapper.parse("<div>n</div><ul><li>1<li>2<li>3</ul>")
    for t in (a, b):
        wrapper._settle(t)
    pairs = []
    assert wrapper.match(a, b, pairs) == 4 == len(pairs)  # root, list and two items


def test_main_text_keeps_copies(spark):
    rows = [(i, "http://h.org/x" if i < 30 else None, page(0, "The same words.")) for i in range(60)] + [(99, "bad url", None), (None, "http://h.org/", page(1, "Other."))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("z"))
    got = wrapper.main_text(df, group_pages=8).collect()
    assert len(got) == 62 and sum(r.text == "T0\nThe same words.\nSecond 0 & bold" for r in got) == 60
    assert [r.n_chars for r in got if r.page_id == 99] == [0]
    assert wrapper.main_text(df.limit(0)).count() == 0


# ---- 6: toxicity


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits, toxic = sum(r.predicted and r.toxic for r in rows), sum(r.toxic for r in rows)
    wrong = sum(r.predicted and not r.toxic for r in rows)
    assert hits >= 0.9 * toxic and wrong <= 0.02 * len(rows)


def test_toxicity_tolerates_gaps(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(6))
    texts = [" ".join([word() for _ in range(15)] + (["blorgh"] if i % 4 == 0 else [])) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    extra = [" ".join(word() for _ in range(10)) + x for x in (" blorgh", " b.lorgh", " bl-orgh", "")] + [None, "", "b l o r g h it is"]
    df = made(spark, texts + extra)
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert [got[600 + i].predicted for i in range(7)] == [1, 1, 1, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.toxicity(df.limit(3), labels.where("toxic = 0")).collect()
    assert [r.score for r in none] == [0.0] * 3
    assert toxicity.keep_clean(df, labels).columns == df.columns


def test_toxicity_learns_from_rare_words(spark):
    rnd = random.Random(2)
    word = lambda n=7: "".join(rnd.choice("aeioulnrst") for _ in range(n))
    often = sorted({word() for _ in range(43_000)})  # each in two texts or more, unlike any word with the insult
    assert len(often) > 40_000
    clean = [" ".join(often[i::400]) for i in range(400)] * 2
    texts = clean + [" ".join([*rnd.sample(often, 20), f"{word(2)}blorgh{word(3)}"]) for _ in range(400)]
    labels = spark.createDataFrame([(i, int(i >= 800)) for i in range(1200)], "doc_id long, toxic int")
    df = made(spark, [*texts, f"{often[5]} zzblorghzz {often[7]}", f"{often[5]} {often[7]}"])
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df, labels).where("doc_id >= 1200").collect()}
    assert got == {1200: 1, 1201: 0}


# ---- 7: decontamination


def brute_contamination(docs, benchmark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    items |= own
                    hit.update(range(j, j + k))
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("chunk", [1 << 25, 40])
def test_contamination_equals_brute_force(spark, chunk):
    item = " ".join(f"q{i}" for i in range(20))
    bench = [(10, item), (9, "Short one here"), (2, "short one HERE"), (3, ""), (4, None), (5, "x x x x x x x x x x x x x x x")]
    texts = ["a " + item.upper() + " b", "short,one here... short one", item[:40], "x " * 40, "", None, LONG + item, "short one", "y " * 500 + "short one here"]
    docs = made(spark, texts)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(docs, b, chunk_bytes=chunk).collect()}
    expected = brute_contamination(list(enumerate(texts)), bench)
    assert got == expected
    kept = decontamination.decontaminate(docs, b, chunk_bytes=chunk)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in expected.items() if not x[-1]}
    assert decontamination.contamination(docs, b.limit(0)).where("contaminated").count() == 0


def test_longest_matches(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs, b = made(spark, ["a b " + item + " c"]), spark.createDataFrame([(1, "z " + item)], "item_id long, text string")
    m = decontamination.contamination(docs, b).first().matches
    assert [(x.item_id, x.doc_start, x.item_start, x.length) for x in m] == [("1", 2, 1, 30)]


def test_longest_matches_in_repeats(spark):
    docs = made(spark, ["x " * 20_000, "a x x x x x x x x x x x x x x b", None])
    b = spark.createDataFrame([(1, "x " * 15)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, b).collect()}
    assert got[0].n_hit == 20_000 and max(m.length for m in got[0].matches) == 15
    assert [(m.doc_start, m.length) for m in got[1].matches if m.item_start == 0] == [(1, 14), (2, 13)]


@pytest.mark.parametrize("chunk", [1 << 25, 40])
def test_rows_are_judged_by_their_text(spark, chunk):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (1, item), (1, "clean words"), (2, "clean words"), (2, "clean words"), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "never there at all"), (3, "...")], "item_id long, text string")
    kept = decontamination.decontaminate(docs, b, chunk_bytes=chunk).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (1, "clean words"), (2, "clean words"), (2, "clean words")]
    nothing = spark.createDataFrame([(1, "... !!"), (2, "-" * 100)], "item_id long, text string")
    assert decontamination.contamination(docs, nothing, chunk_bytes=chunk).where("n_hit = 0").count() == 6
    assert decontamination.contamination(docs.limit(0), b, chunk_bytes=chunk).count() == 0


# ---- 9: language models


def test_lm_scores_tell_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = lm_scoring.cross_entropy_difference(docs, labels.where("quality = 1")).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] < np.array(bad)) > 0.95


def test_lm_edge_cases(spark):
    df = made(spark, ["a b a c", "a b", "c c c", None, "", LONG])
    none = spark.createDataFrame([], "doc_id long")
    scored = lm_scoring.cross_entropy_difference(df, none).collect()
    assert [r.n_words for r in sorted(scored, key=lambda r: r.doc_id)] == [4, 2, 3, 0, 0, 30_000]
    uniform = np.log(30_015 + 7)  # tokens and vocabulary
    assert all(abs(r.target_loss - np.log(3 + 4)) < 1e-9 and r.background_loss < uniform for r in scored)
    assert lm_scoring.cross_entropy_difference(df.limit(0), none).count() == 0


@pytest.mark.parametrize("chunk, bucket", [(1 << 23, 1 << 21), (20_000, 10_000)])
def test_lm_counts_every_word_bigram_and_target(spark, chunk, bucket):
    rnd = random.Random(3)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.3)) % 20_000}" for _ in range(rnd.randrange(9))) for _ in range(30_000)] + [None, ""]
    good = set(range(0, 60_000, 2)) - set(range(100))
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 30_002, "w1 w1 w7") for i in range(30_000)] + [(None, "w1 w1 w7")]
    df, pairs, words, size = spark.createDataFrame(rows, "doc_id long, text string"), ({}, {}), ({}, {}), {}
    tokens = lambda t: list(zip(["^", *(t or "").split()], [*(t or "").split(), "$"]))
    for i, t in rows:
        for side in (0, 1) if i in good else (0,):
            for h, w in tokens(t):
                pairs[side][h, w] = pairs[side].get((h, w), 0) + 1
                words[side][w] = words[side].get(w, 0) + 1
                size[w] = 1
    assert len(size) > 8192 and len(good) > 20_000

    def loss(side, t):
        total, out = sum(words[side].values()) + len(size) + 2, 0.0
        for h, w in tokens(t):
            p, c = (words[side].get(w, 0) + 1) / total, words[side].get("$" if h == "^" else h, 0)
            out -= np.log(0.7 * pairs[side].get((h, w), 0) / c + 0.3 * p if c else p)
        return out / len(tokens(t))

    got = lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), chunk, bucket).collect()
    own, expected = {r.doc_id: r for r in got}, dict(rows)
    assert len(got) == len(rows) and set(own) == set(expected)
    for i in [None, *range(0, 60_001, 7)]:
        assert own[i].n_words == len(tokens(expected[i])) - 1
        assert abs(own[i].target_loss - loss(1, expected[i])) < 1e-6 and abs(own[i].background_loss - loss(0, expected[i])) < 1e-6


# ---- 10: top-k


@pytest.mark.parametrize("chunk", [1000, 3])
def test_top_k(spark, chunk):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(60)] + [(60, None), (61, [1.0, None]), (62, [float("nan")]), (63, [float("inf")]), (64, [1.0]), (None, [1.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk_search.top_k(df, F.col("vec_id") % 10 == 0, k=7, chunk=chunk).collect()
    able = {i: np.floor(1024 * np.array([*v, *[0.0] * (6 - len(v))])).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in able:
        if q % 10 == 0:
            best = sorted((-int(able[q] @ able[c]), c) for c in able if c != q)[:7]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        before, kept = kept, pipeline.stash(stage(spark, kept, FOLDER), "test")
        assert kept.columns == docs.columns and kept.count() <= before.count()
        assert kept.exceptAll(before).count() == 0
    rows = brute_components(kept.select("doc_id", "text").collect())
    assert all(i == c for i, (_, c) in rows.items())
    b = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()
    assert not any(x[-1] for x in brute_contamination(kept.select("doc_id", "text").collect(), b).values())
    packed = pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
