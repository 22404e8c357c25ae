"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import conversation_tree, format_conversations, format_report
from .conversation_repair import damage_and_repair
from .decontamination import contamination
from .hyperminhash import near_duplicates
from .lm_scoring import cross_entropy_difference
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .shared import table
from .token_files import read_token_files, write_token_files
from .topk_search import top_k
from .toxicity import toxicity
from .warc import read_records, write_archive
from .whitening import whiten
from .wrapper import main_text


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=5, percent=75)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(write_archive(table(spark, sf_dir, "pages"), min_revisit=1000))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], rows.schema))
    report = format_report(format_conversations(conversation_tree(rows)))
    return report.select(F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(shards)


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, percent=5).drop("matches")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))
                                                  WHEN len(w) > 0 THEN [md5(array_to_string(w, ' ') || ' ')] ELSE [] END) AS h FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM r JOIN e ON seen = a),
        c AS (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node),
        k AS (SELECT min(doc_id) AS class_id, list(doc_id) AS docs FROM (SELECT doc_id, md5(string_agg(h, '' ORDER BY h)) AS g FROM s GROUP BY doc_id) GROUP BY g),
        m AS (SELECT unnest(docs) AS doc_id, class_id FROM k)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(class_id, doc_id) AS class_id, component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) JOIN c USING (doc_id)""",
    "op7_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        t AS (SELECT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
        ks AS (SELECT DISTINCT k FROM t),
        p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
        h AS (SELECT DISTINCT doc_id, p.k, i, item_id FROM p JOIN t ON t.k = p.k AND x = array_to_string(w[i:i + p.k - 1], ' ')),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op2_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
        r AS (SELECT p.*, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, b::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN b >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN b >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM r""",
    "op3_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') AS escaped FROM c)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('### ' || role || ': ') + length(escaped) + length(' </turn>') + 1)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS f FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE f <> 0),
        p AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM p),
        q AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, blank, NOT blank AND nth > 1 AS dup, NOT blank AND nth = 1 AND regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') AS cut,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM r),
        nx(s, t, line) AS (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')),
        ins AS (SELECT DISTINCT s, s AS t, '' AS e, 0 AS cost, '' AS lines FROM nx UNION ALL SELECT s, t, 'I', 2, chr(10) || line FROM nx
                UNION ALL SELECT a.s, b.t, 'II', 4, chr(10) || a.line || chr(10) || b.line FROM nx a JOIN nx b ON b.s = a.t),
        mv AS (SELECT s, t, e || 'D' AS e, cost + 3 AS cost, lines, NULL AS need, 'D' AS kind, '' AS head FROM ins
               UNION ALL SELECT ins.s, nx.t, e || 'R', cost + 2, lines, NULL, 'R', chr(10) || line FROM ins JOIN nx ON nx.s = ins.t
               UNION ALL SELECT ins.s, nx.t, e || 'K', cost, lines, line[1], 'K', '' FROM ins JOIN nx ON nx.s = ins.t
               UNION ALL SELECT s, 1, e || 'K', cost, lines, 's', 'K', '' FROM ins WHERE t = 0),
        dp AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM d
            UNION ALL
            SELECT dp.conv_id, q.i, mv.t, min({'cost': best.cost + mv.cost + CASE WHEN cut AND kind <> 'D' THEN 1 ELSE 0 END, 'audit': best.audit || mv.e,
                   'lines': best.lines || mv.lines || CASE kind WHEN 'D' THEN '' WHEN 'R' THEN mv.head || text ELSE chr(10) || role || ':' || text END})
            FROM dp JOIN q ON q.conv_id IS NOT DISTINCT FROM dp.conv_id AND q.i = dp.i + 1 JOIN mv ON mv.s = dp.s AND (kind = 'D' OR NOT blank AND NOT dup AND (need IS NULL OR need = initial))
            GROUP BY dp.conv_id, q.i, mv.t),
        n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
                     count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id),
        f AS (SELECT n.conv_id, min({'cost': best.cost + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': best.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                     'lines': best.lines || CASE s WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS best
              FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = n.n GROUP BY n.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.lines[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op13_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' ')))
                                                  WHEN len(w) > 0 THEN [md5(array_to_string(w, ' ') || ' ')] ELSE [] END) AS h FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM r JOIN e ON seen = a),
        c AS (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_warc_archive, op3_chat_format, op4_token_files, op5_wrapper_text, op6_toxicity, op7_decontamination, op8_packing, op9_lm_scoring, op10_topk_search, op11_embedding_whitening, op12_conversation_repair, op13_minhash_near_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
