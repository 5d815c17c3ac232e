"""Map-like relations derived from the driver's tables by SQL that Spark and DuckDB share.

Only integer arithmetic and one final division, so both engines get the same doubles.
Braces name tables; RELATIONS may build on earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

RELATIONS: dict[str, str] = {
    "spots": """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'node/' WHEN 1 THEN 'way/' ELSE 'relation/' END || CAST(c_custkey AS STRING) AS id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'bathing_spot' ELSE 'dog_park' END AS kind,
       CASE c_custkey % 5 WHEN 1 THEN 'Park A' WHEN 2 THEN ' park a ' WHEN 3 THEN '  ' END AS name,
       CAST(590000000 + (c_custkey * 7919) % 8000000 AS DOUBLE) / 1e7 AS lat,
       CAST(175000000 + (c_custkey * 104729) % 12000000 AS DOUBLE) / 1e7 AS lon
FROM {customer}""",
    # clusters of four objects some 17 m apart, so that nodes double areas
    "twins": """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'node/' WHEN 1 THEN 'way/' ELSE 'relation/' END || CAST(c_custkey AS STRING) AS id,
       CASE WHEN (c_custkey - c_custkey % 4) % 3 = 0 THEN 'bathing_spot' ELSE 'dog_park' END AS kind,
       CASE c_custkey % 5 WHEN 1 THEN 'Park A' WHEN 2 THEN ' park a ' WHEN 3 THEN 'Beach' END AS name,
       CAST(590000000 + ((c_custkey - c_custkey % 4) * 7919) % 8000000 + (c_custkey % 4) * 1500 + (c_custkey % 7) * 37 AS DOUBLE) / 1e7 AS lat,
       CAST(175000000 + ((c_custkey - c_custkey % 4) * 104729) % 12000000 AS DOUBLE) / 1e7 AS lon,
       CASE c_custkey % 4 WHEN 1 THEN true WHEN 2 THEN false END AS leash_required,
       CASE c_custkey % 6 WHEN 2 THEN true WHEN 3 THEN false END AS fenced,
       CASE c_custkey % 7 WHEN 4 THEN false WHEN 5 THEN true END AS lit,
       CASE c_custkey % 3 WHEN 0 THEN 'fine_gravel' END AS surface,
       CASE WHEN c_custkey % 11 < 3 THEN 'unparsed' END AS season
FROM {customer}""",
    "points": """
SELECT CAST(s_suppkey AS BIGINT) AS query_id,
       CAST(590000000 + (CAST(s_suppkey AS BIGINT) * 1234577) % 8000000 AS DOUBLE) / 1e7 AS at_lat,
       CAST(175000000 + (CAST(s_suppkey AS BIGINT) * 7654337) % 12000000 AS DOUBLE) / 1e7 AS at_lon
FROM {supplier}""",
    "globe": """
SELECT CAST(o_orderkey AS BIGINT) AS query_id,
       CAST((CAST(o_orderkey AS BIGINT) * 104729) % 1700000 - 850000 AS DOUBLE) / 1e4 AS at_lat,
       CAST((CAST(o_orderkey AS BIGINT) * 1299709) % 3600000 - 1800000 AS DOUBLE) / 1e4 AS at_lon
FROM {orders}""",
    "tagged": """
SELECT CAST(p_partkey AS BIGINT) AS n,
       CASE p_partkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'w' WHEN 2 THEN 'r' ELSE 'a' END || CAST(p_partkey AS STRING) AS feature,
       CAST(550000000 + (p_partkey * 15485863) % 90000000 AS DOUBLE) / 1e7 AS lat,
       CAST(110000000 + (p_partkey * 32452843) % 90000000 AS DOUBLE) / 1e7 AS lon,
       CASE WHEN p_size % 4 = 0 THEN 'dog_park' WHEN p_size % 4 = 1 THEN 'bathing_place' WHEN p_size % 9 = 2 THEN 'swimming_area' END AS leisure,
       CASE p_size % 5 WHEN 0 THEN 'beach' WHEN 1 THEN 'water' END AS nature,
       CASE p_partkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'designated' WHEN 2 THEN 'no' WHEN 3 THEN 'leashed' WHEN 4 THEN 'unleashed' END AS dog,
       CASE p_partkey % 6 WHEN 0 THEN 'Stora Hundbadet' WHEN 1 THEN 'HUNDBAD 3' WHEN 2 THEN p_name WHEN 3 THEN '' WHEN 4 THEN 'hUnDbAd' END AS name,
       CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS fenced,
       CASE p_partkey % 3 WHEN 0 THEN 'fence' WHEN 1 THEN 'no' END AS barrier,
       CASE p_partkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN '' WHEN 2 THEN '24/7' END AS lit,
       CASE p_partkey % 4 WHEN 0 THEN 'fine_gravel' WHEN 1 THEN '' WHEN 2 THEN 'grass' END AS surface,
       CASE p_partkey % 12
         WHEN 0 THEN 'no @ (Jun 1-Aug 31)' WHEN 1 THEN 'no @ Oct-Feb' WHEN 2 THEN 'leashed @ (May 1-Sep 30)'
         WHEN 3 THEN 'leashed @ (May-Jun); NO @ (jul 1 - aug 15)' WHEN 4 THEN 'no @ (Jun 31-Aug 31)' WHEN 5 THEN 'no'
         WHEN 6 THEN 'no @ (Su 10:00-18:00)' WHEN 7 THEN '' WHEN 8 THEN 'no @ (January 2-March)' WHEN 9 THEN ' no @ Dec 24-Jan 6 ' WHEN 10 THEN 'no @ (Dec 24)' END AS dog_conditional
FROM {part}""",
    "objects": """
SELECT CASE l_returnflag WHEN 'A' THEN 'node' WHEN 'N' THEN 'way' ELSE 'relation' END AS type,
       CAST(l_partkey AS BIGINT) AS id, CAST(l_linenumber AS INT) AS version, CAST(l_orderkey AS BIGINT) AS seq,
       CAST(l_suppkey AS BIGINT) AS payload,
       CASE CAST(l_orderkey AS BIGINT) % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'modify' END AS op
FROM {lineitem}""",
    "way_nodes": """
SELECT CAST(l_orderkey AS BIGINT) AS way, CAST(l_linenumber AS INT) AS at, CAST(l_partkey AS BIGINT) AS node FROM {lineitem}""",
    "nodes": """
SELECT CAST(p_partkey AS BIGINT) AS node,
       CAST(590000000 + (p_partkey * 7919) % 4000000 * 2 AS DOUBLE) / 1e7 AS lat,
       CAST(175000000 + (p_partkey * 104729) % 6000000 * 2 AS DOUBLE) / 1e7 AS lon
FROM {part} WHERE p_partkey % 17 <> 0""",
    "fixes": """
SELECT CAST(user_id AS BIGINT) AS session, CAST(event_id AS BIGINT) AS seq,
       CAST(593000000 + (CAST(event_id AS BIGINT) * 7919) % 60000 AS DOUBLE) / 1e7 AS lat,
       CAST(180600000 + (CAST(event_id AS BIGINT) * 104729) % 60000 AS DOUBLE) / 1e7 AS lon
FROM {events}""",
    "marks": """
SELECT CAST(user_id AS BIGINT) AS session, CAST(event_id AS BIGINT) AS seq, event_type AS milestone,
       CAST((CAST(event_id AS BIGINT) * 7919) % 100000 AS DOUBLE) / 8 AS at_ms,
       CASE WHEN event_id % 3 = 0 THEN 'd' || CAST(event_id AS STRING) END AS detail
FROM {events}""",
    "answers": """
SELECT CAST(user_id AS BIGINT) AS session, CASE WHEN event_id % 2 = 0 THEN 'parks' ELSE 'bathing' END AS layer,
       (CAST(event_id AS BIGINT) * 31) % 97 AS token, CAST(event_id AS BIGINT) AS seq, event_id % 5 = 0 AS failed
FROM {events}""",
}


def sql(text: str, tables: dict[str, str]) -> str:
    """``text`` with every name in braces replaced: derived ones by subqueries."""
    for name, body in RELATIONS.items():
        if "{" + name + "}" in text:
            text = text.replace("{" + name + "}", "(" + sql(body, tables) + "\n) AS " + name)
    for t in TABLES:
        text = text.replace("{" + t + "}", tables.get(t, t))
    return text


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the Parquet tables of a folder."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in RELATIONS[name]}
    return spark.sql(RELATIONS[name], **frames)


def oracle(text: str) -> str:
    """DuckDB's form: relations as common table expressions."""
    used = [n for n in RELATIONS if "{" + n + "}" in text]
    head = ", ".join(f"{n} AS ({sql(RELATIONS[n], {})})" for n in used)
    for n in used:
        text = text.replace("{" + n + "}", n)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    text = text.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if head and text.upper().startswith(start):
            return f"{start}{head}, {text[len(start):]}"
    return f"WITH {head} {text}" if head else text
