"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lm, toxicity
from tessera.llm.chat import rendered
from tessera.llm.decontaminate import contained_items
from tessera.llm.licences import PERCENT, TEMPLATES, licence_scan
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import packed
from tessera.llm.store import stored
from tessera.llm.token_files import read_shards, write_shards
from tessera.llm.tokens import vocabulary
from tessera.llm.transport_stream import demuxed, muxed
from tessera.llm.url_filter import judge, rule_table

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: DuckDB: the words of a text column.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), " + _AZ + "), '[^ \\t\\n\\x0B\\f\\r]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP2_SQL = f"""
WITH t AS (SELECT 0 AS k, doc_id AS id, {_WORDS} AS ws FROM documents UNION ALL SELECT 1 AS k, item_id AS id, {_WORDS} AS ws FROM benchmark),
v AS (SELECT DISTINCT least(len(ws), 5) AS w FROM t WHERE k = 1 AND len(ws) > 0),
s AS (SELECT k, id, w, list_distinct(list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' '))) AS sh
      FROM t JOIN v ON CASE k WHEN 0 THEN len(ws) >= w ELSE least(len(ws), 5) = w END),
e AS (SELECT k, id, w, len(sh) AS n, unnest(sh) AS x FROM s)
SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(b.n) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared
FROM e d JOIN e b ON d.x = b.x AND d.w = b.w WHERE d.k = 0 AND b.k = 1 GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(b.n)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"))


_STATEMENTS = ", ".join("(%d, '%s', '%s')" % (k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
_PAIRS = "list_distinct(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))"
_NORMAL = "string_split(trim(regexp_replace(lower(%s), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
OP4_SQL = f"""
WITH t AS (SELECT k, licence, {_PAIRS} AS bi FROM (SELECT k, licence, {_NORMAL % "statement"} AS ws FROM (VALUES {_STATEMENTS}) AS v(k, licence, statement))),
c AS (SELECT doc_id, unnest(list_concat(
        string_split(regexp_replace(text, '\\n|([.!?])[ \\t\\r]+', '\\1' || chr(1), 'g'), chr(1)),
        list_filter(string_split(regexp_replace(text, '([.!?])\\s+|\\n\\s*\\n', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(trim(s, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), chr(10))))) AS segment FROM documents),
u AS (SELECT doc_id, unnest(list_concat([segment], CASE WHEN regexp_matches(segment, '[,;:()\\[\\]"]') THEN string_split_regex(segment, '[,;:()\\[\\]"]+') ELSE [] END)) AS unit FROM c),
s AS (SELECT doc_id, {_PAIRS} AS bi FROM (SELECT doc_id, {_NORMAL % "unit"} AS ws FROM u)),
m AS (SELECT s.doc_id, t.licence, len(list_intersect(s.bi, t.bi)) AS c, len(s.bi) AS n, len(t.bi) AS m FROM s JOIN t
      ON len(s.bi) * 200 >= {PERCENT} * (len(s.bi) + len(t.bi)) AND len(t.bi) * 200 >= {PERCENT} * (len(s.bi) + len(t.bi))
      WHERE len(list_intersect(s.bi, t.bi)) * 200 >= {PERCENT} * (len(s.bi) + len(t.bi)))
SELECT doc_id, licence, CAST(count(*) AS BIGINT) AS n_segments, max(2.0::DOUBLE * c / (n + m)) AS dice FROM m GROUP BY doc_id, licence
"""


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demuxed(stored(muxed(_table(spark, sf_dir, "documents")), "media", "zstd"))


#: The rules that the query is asked to apply.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_AZ}), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, verdict) AS (VALUES {", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)}),
q AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS b FROM r)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), 'allow') AS verdict
FROM p LEFT JOIN q ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) GROUP BY page_id
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(_table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
           string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS state
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
kept AS (SELECT min(conv_id) AS conv_id FROM t WHERE k = n GROUP BY state HAVING state NOT IN (SELECT state FROM t WHERE k < n))
SELECT conv_id, CAST((k - 1) // 256 AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat
FROM t SEMI JOIN kept USING (conv_id) GROUP BY conv_id, segment
"""


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.root = g.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(root) AS component_id, min(root) = s.doc_id AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(sh)
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_decontamination, op3_packing, op4_licence_scan, op5_transport_stream, op6_url_filter, op7_chat_format, op8_lm_scores, op9_minhash_near_dedup, op10_toxicity)}
SQL = {"op2_decontamination": OP2_SQL, "op4_licence_scan": OP4_SQL, "op6_url_filter": OP6_SQL, "op7_chat_format": OP7_SQL, "op9_minhash_near_dedup": OP9_SQL}
