"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontaminate, fingerprint, packing, preference, sharding, simhash, spelling, substring, suffix, toxicity, vptree, warc
from .common import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read_table(spark, sf_dir, "pages"))


ORACLE_SQL["op1_warc_convert"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query
def op2_vptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op2_vptree_search"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op3_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op4_benchmark_automaton"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM i),
g AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w, k WHERE len(ws) >= k)),
m AS (SELECT doc_id, g.k, s, item_id FROM g JOIN i ON i.k = g.k AND i.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read_table(spark, sf_dir, "documents"))


@query
def op6_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_doubling_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
f AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM g JOIN f USING (gram) WHERE first_id < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
    ELSE coalesce((SELECT string_agg(u.x, ' ' ORDER BY u.i) FROM (SELECT unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i) u WHERE NOT list_contains(ps, u.i)), '') END) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
"""


@query
def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read_table(spark, sf_dir, "documents"))


@query
def op9_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op9_bucket_refinement"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, s, md5(gram) AS k FROM (
  SELECT doc_id, s, substr(h, 2 * s + 1, 800) AS gram
  FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400))),
r AS (SELECT doc_id, s FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
      FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS fresh FROM r)),
p AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM p),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last_b,
        string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE kept || substr(h, 2 * last_b + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@query
def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.report(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL["op10_preference_pairs"] = preference.ORACLE


@query
def op11_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_variable_grams"] = spelling.ORACLE


@query
def op12_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(read_table(spark, sf_dir, "documents"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.report(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL["op13_conversation_trie"] = conversation_trie.ORACLE
