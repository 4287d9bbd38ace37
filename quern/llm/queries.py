"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html_text, line_dedup, mixing, packing, simhash, suffix_dedup, topk, toxicity
from ._common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chats(table(spark, sf_dir, "conversations"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any length and passages of twenty words or more; `removed` has the original offsets as text."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.select("doc_id", "n_removed", F.size("removed").cast("long").alias("n_spans"), spans.alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.with_crc(packing.pack(docs, word_bpe)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_ALONE = "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in line_dedup.ALONE)
SQL = {
    "op2_chat": """
WITH t AS (
  SELECT *, coalesce(role, chr(1)) || chr(31) || coalesce(text, chr(1)) AS one FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), p AS (
  SELECT conv_id, turn, string_agg(one, chr(30)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS turns FROM t
), k AS (
  SELECT min(conv_id) AS conv_id FROM p WHERE n = turns AND so_far NOT IN (SELECT so_far FROM p WHERE n < turns) GROUP BY so_far
)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
FROM t JOIN k USING (conv_id) GROUP BY conv_id""",
    "op5_line_dedup": rf"""
WITH t AS (
  SELECT doc_id, text, regexp_extract(text, '^[\x09-\x0D\x20]*') AS head, regexp_extract_all(text, '(?:[{_ALONE}]|[^\x09-\x0D\x20{_ALONE}]+)[\x09-\x0D\x20]*') AS toks FROM documents
), w0 AS (
  SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS i FROM t
), w1 AS (
  SELECT doc_id, i, tok, regexp_extract(tok, '^[^\x09-\x0D\x20]+') AS word FROM w0
), w2 AS (
  SELECT *, substr(tok, length(word) + 1) AS ws, CAST('0x' || substr(md5(lower(word)), 1, 8) AS BIGINT) AS h FROM w1
), w3 AS (
  SELECT *, i = 0 OR lag(ws) OVER d LIKE '%' || chr(10) || '%' AS line,
    i = 0 OR lag(ws) OVER d LIKE '%' || chr(10) || '%' OR regexp_matches(lag(word) OVER d, '[.!?]$') OR regexp_matches(word, '^[A-Z]') OR (3 * lag(h) OVER d + h) % 8 = 0 AS chunk
  FROM w2 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), w AS (
  SELECT *, sum(line::INT) OVER d AS line_no, sum(chunk::INT) OVER d AS chunk_no FROM w3 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), words AS (
  SELECT doc_id, list(lower(word) ORDER BY i) AS words FROM w GROUP BY doc_id
), c AS (
  SELECT doc_id, CAST(min(i) AS BIGINT) AS s, CAST(max(i) + 1 AS BIGINT) AS e, CAST(min(i) + 20 AS BIGINT) AS least_e, CAST(max(i) - 19 AS BIGINT) AS most_s FROM w GROUP BY doc_id, chunk_no
), u AS (
  SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM w GROUP BY doc_id, line_no
  UNION SELECT a.doc_id, a.s, b.e FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.least_e <= b.e
  UNION SELECT a.doc_id, b.s, a.e FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.most_s >= b.s
), f AS (
  SELECT u.doc_id, s, e, first_value(u.doc_id) OVER g AS doc0, first_value(s) OVER g AS s0, first_value(e) OVER g AS e0
  FROM u JOIN words USING (doc_id) WINDOW g AS (PARTITION BY md5(array_to_string(list_slice(words, s + 1, e), ' ')) ORDER BY u.doc_id, s, e)
), r AS (
  SELECT doc_id, CASE WHEN doc_id = doc0 THEN greatest(s, e0) ELSE s END AS s, e FROM f WHERE doc_id <> doc0 OR s <> s0 OR e <> e0
), steps AS (
  SELECT doc_id, i, sum(n) AS n FROM (SELECT doc_id, s AS i, 1 AS n FROM r WHERE s < e UNION ALL SELECT doc_id, e, -1 FROM r WHERE s < e) GROUP BY doc_id, i
), m0 AS (
  SELECT w.doc_id, w.i, tok, ws, line, sum(coalesce(n, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i) > 0 AS bad FROM w LEFT JOIN steps ON w.doc_id = steps.doc_id AND w.i = steps.i
), m1 AS (
  SELECT *, bad AND NOT coalesce(lag(bad) OVER d, FALSE) AS starts, bad AND NOT coalesce(lead(bad) OVER d, FALSE) AS stops FROM m0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), m2 AS (
  SELECT *, sum(starts::INT) OVER d AS run FROM m1 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), m3 AS (
  SELECT *, bool_or(starts AND line) OVER (PARTITION BY doc_id, run) AS whole FROM m2
), p AS (
  SELECT *, CASE WHEN NOT bad THEN tok WHEN stops AND NOT whole THEN regexp_replace(ws, '^[ \t]+', '') ELSE '' END AS piece FROM m3
), q AS (
  SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM p
), spans AS (
  SELECT q.doc_id, min(z - length(tok)) + any_value(length(head)) AS a, max(z - length(piece)) + any_value(length(head)) AS z FROM q JOIN t ON t.doc_id = q.doc_id WHERE bad GROUP BY q.doc_id, run
), out AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY i) AS kept, CAST(count(*) FILTER (bad) AS BIGINT) AS n_removed FROM q GROUP BY doc_id
), runs AS (
  SELECT doc_id, count(*) AS n_spans, string_agg(a || '-' || z, ',' ORDER BY a) AS removed FROM spans GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(removed, '') AS removed, sha256(head || coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN out USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5""",
    "op9_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS most FROM s
), x AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w
), t AS (
  SELECT source, source_size, least(most, weight * max((total - before) / rest) OVER ()) AS target,
    CAST(('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift FROM x
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * n + shift) - floor(rate * (n - 1) + shift)) AS BIGINT) AS taken FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
