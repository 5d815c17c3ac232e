"""The queries opN_<name> and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from wayfold.llm import bpe, centroids, chat, embed_dedup, packing, pii, quality, schema_rewrite, simhash, tokens, topk, urls, warc
from wayfold.llm.stored import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


#: action, host, path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "action string, host string, path string"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.group(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def with_tool_calls(rows: DataFrame) -> DataFrame:
    """All conversations, with calls and results put in by arithmetic on conv_id and turn.

    The given texts hold no JSON. Assistant messages of every third conversation carry two
    calls (their text is the content): a valid one, with arguments as an object or as JSON
    text, and one that fails its schema on every fifth turn. In every ninth conversation the
    second call waits for results of later messages, in every ninth but three for its own.
    Results are added before and after their messages, and some that no call has."""
    calls = (F.col("role") == "assistant") & (F.col("conv_id") % 3 == 0)
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    number = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    given = F.when(F.col("conv_id") % 2 == 0, F.format_string('{"id": %s}', number)).otherwise(F.format_string('"{\\"id\\": %s}"', number))
    later = (F.col("turn") + 2).cast("string")
    waits = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") % 6 < 4), F.format_string('"a%s"', later)).when(F.col("conv_id") % 9 == 3, F.format_string('"b%s"', t)).otherwise(F.lit(""))
    limit = F.when(F.col("turn") % 5 == 0, F.lit('"5"')).otherwise(t)
    content = F.expr("substr(to_json(array(coalesce(text, ''))), 2, length(to_json(array(coalesce(text, '')))) - 2)")
    text = F.format_string('{"tool_calls": [ {"name": "lookup", "id": "a%s", "arguments": %s}, {"id": "b%s", "depends_on": [%s], "name": "search", "arguments": {"query": "q%s", "limit": %s}} ], "content": %s}', t, given, t, waits, c, limit, content)
    own = rows.select("conv_id", "turn", "role", F.when(calls, text).otherwise(F.col("text")).alias("text"))
    asked = rows.where(calls)
    answer = lambda turn, text: asked.select("conv_id", turn.alias("turn"), F.lit("tool").alias("role"), text.alias("text"))
    early = answer(F.col("turn") - 1, F.format_string('{"content": "r%s", "tool_call_id": "a%s"}', number, t))
    late = answer(F.col("turn") + 1, F.format_string('{"tool_call_id": "b%s", "content": {"ok": true, "n": %s}}', t, number))
    stray = asked.where("conv_id % 6 = 0").select("conv_id", "turn", F.lit("tool").alias("role"), F.lit('{"tool_call_id": "none", "content": null}').alias("text"))
    return own.unionByName(early).unionByName(late).unionByName(stray)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(with_tool_calls(table(spark, sf_dir, "conversations")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"), new_folder(spark, "warc"), least=0)


def op12_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_rewrite.rewrite_clients(table(spark, sf_dir, "clients"), new_folder(spark, "clients"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2:")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_urls": op6_urls,
    "op7_embeddings": op7_embeddings,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
    "op11_warc": op11_warc,
    "op12_schema_rewrite": op12_schema_rewrite,
    "op13_centroids": op13_centroids,
}

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))

_BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
_HITS = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS h, regexp_split_to_array(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{p}')" for k, (kind, p) in enumerate(_BASE))


def _clustering_sql(k: int, rounds: int) -> str:
    """The rounds unrolled, all vectors against all centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, v, min(struct_pack(d := d, c := c)) AS b FROM (SELECT vec_id, v.v, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} c) GROUP BY vec_id, v)")
        if r < rounds:
            means = f"SELECT b.c AS c, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM a{r}, range(1, 65) t(i) GROUP BY b.c, i"
            steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(m ORDER BY i) AS v FROM ({means}) GROUP BY c) n ON n.c = c.c)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM v QUALIFY c < {k}
), {", ".join(steps).replace(" AS (", " AS MATERIALIZED (")}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = b.c"""


ORACLE_SQL: dict[str, str] = {
    "op13_centroids": _clustering_sql(40, 5),
    # The base spans. The tables hold nothing that only the method's added kinds would find;
    # tests/llm has cases of those.
    "op1_pii": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_HITS}), x AS (
  SELECT doc_id, k, kind, h[i] AS hit, regexp_replace(h[i], '[^0-9]', '', 'g') AS digits,
         CAST(list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS pos
  FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM m)
), good AS (
  SELECT *, kind || ':' || CAST(pos AS VARCHAR) || ':' || CAST(pos + length(hit) AS VARCHAR) AS span FROM x
  WHERE kind = 'email'
     OR kind = 'ip' AND len(list_filter(string_split(hit, '.'), lambda s: coalesce(TRY_CAST(s AS HUGEINT) > 255, true))) = 0
     OR kind = 'phone' AND length(digits) BETWEEN 10 AND 15
     OR kind = 'card' AND length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j:
        CAST(digits[length(digits) - j] AS INTEGER) * (1 + j % 2) - CASE WHEN CAST(digits[length(digits) - j] AS INTEGER) * (1 + j % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0
), byd AS (
  SELECT doc_id, string_agg(span, ',' ORDER BY pos, k) AS spans, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip,
         count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone FROM good GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN byd ON byd.doc_id = d.doc_id""",
    "op7_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, (SELECT min(reach) FROM r WHERE r.vec_id = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(reach) FROM r WHERE r.vec_id = e.vec_id) AS kept
FROM embeddings e""",
    # The same calls and results as in with_tool_calls, with what the operator must say of them.
    "op10_chat": """
WITH k AS (
  SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0
), waiting AS (
  SELECT k.conv_id, k.turn, k.conv_id % 9 = 0 AND k.turn % 6 < 4 AND a.turn IS NOT NULL AS one, (k.turn + 2) % 6 < 4 AND b.turn IS NOT NULL AS two
  FROM k LEFT JOIN k a ON a.conv_id = k.conv_id AND a.turn = k.turn + 2 LEFT JOIN k b ON b.conv_id = k.conv_id AND b.turn = k.turn + 4
), place AS (
  SELECT conv_id, turn, turn + CASE WHEN one AND two THEN 4 WHEN one THEN 2 ELSE 0 END AS anchor, CASE WHEN one AND two THEN 4 WHEN one THEN 2 ELSE 0 END AS depth FROM waiting
), calling AS (
  SELECT c.*, p.anchor, p.depth, CAST(c.conv_id * 100 + c.turn AS VARCHAR) AS n, CAST(c.turn AS VARCHAR) AS t
  FROM conversations c JOIN place p ON p.conv_id = c.conv_id AND p.turn = c.turn WHERE c.role = 'assistant'
), every AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, turn AS anchor, 0 AS depth, 0 AS number, 0 AS answers, 0 AS n_calls, 0 AS n_valid, false AS linked, false AS cyclic,
    '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'unknown')) AS VARCHAR) || '}' AS message
  FROM conversations WHERE NOT coalesce(role = 'assistant' AND conv_id % 3 = 0, false)
  UNION ALL SELECT conv_id, turn, role, anchor, depth, 0, 0, 2, CASE WHEN turn % 5 = 0 THEN 1 ELSE 2 END, false, conv_id % 9 = 3,
    '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":"assistant","tool_calls":[{"arguments":{"id":' || n || '},"id":"a' || t || '","name":"lookup"},{"arguments":{"limit":'
    || CASE WHEN turn % 5 = 0 THEN '"5"' ELSE t END || ',"query":"q' || CAST(conv_id AS VARCHAR) || '"},"depends_on":['
    || CASE WHEN conv_id % 9 = 0 AND turn % 6 < 4 THEN '"a' || CAST(turn + 2 AS VARCHAR) || '"' WHEN conv_id % 9 = 3 THEN '"b' || t || '"' ELSE '' END || '],"id":"b' || t || '","name":"search"}]}'
  FROM calling
  UNION ALL SELECT conv_id, turn - 1, 'tool', anchor, depth + 1, 1, 1, 0, 0, true, false, '{"content":"r' || n || '","role":"tool","tool_call_id":"a' || t || '"}' FROM calling
  UNION ALL SELECT conv_id, turn + 1, 'tool', anchor, depth + 1, 2, 1, 0, 0, true, false, '{"content":{"n":' || n || ',"ok":true},"role":"tool","tool_call_id":"b' || t || '"}' FROM calling
  UNION ALL SELECT conv_id, turn, 'tool', turn, 0, 0, 1, 0, 0, false, false, '{"content":null,"role":"tool","tool_call_id":"none"}' FROM calling WHERE conv_id % 6 = 0
)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY anchor, depth, number, answers, turn, message) AS position, anchor AS anchor_turn, depth, n_calls, n_valid, linked, cyclic, message FROM every""",
    "op4_topk": """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op6_urls": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{a} {h}{p}'" for a, h, p in _BY_LENGTH)} END AS best FROM parts
)
SELECT page_id, host, path, substr(best, 7) AS rule, coalesce(substr(best, 1, 5), 'allow') AS verdict FROM ruled""",
}
