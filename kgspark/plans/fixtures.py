"""Derived tables in the shapes of the store, as one SQL text for Spark and DuckDB alike.

Each table reads the given Parquet tables or other derived ones; literal tables
hold settings (topics, prices, aliases).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NOW = "TIMESTAMP '2024-02-01 00:00:00'"

TABLES = {
    "kg_entities": """
SELECT CAST(1 AS BIGINT) AS id, 'WORLD' AS canonical_name, 'world' AS type, 'General' AS topic, 'WORLD' AS alias1, CAST(1.0 AS DOUBLE) AS confidence, TIMESTAMP '2024-02-01 00:00:00' AS last_mentioned, CAST(NULL AS BIGINT) AS vec_id
UNION ALL SELECT CAST(2 + r_regionkey AS BIGINT), r_name, 'region', r_name, lower(r_name), CAST(1.0 AS DOUBLE), TIMESTAMP '2024-01-31 00:00:00', CAST(NULL AS BIGINT) FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), n_name, 'nation', r_name, lower(n_name), CAST(1.0 AS DOUBLE), TIMESTAMP '2024-01-30 00:00:00', CAST(NULL AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + s_suppkey, s_name, 'supplier', r_name, lower(s_name), CAST(0.9 AS DOUBLE), TIMESTAMP '2024-01-01 00:00:00' + s_suppkey * INTERVAL '1' MINUTE, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000000 + c_custkey, c_name, 'customer', CASE WHEN c_custkey % 10 = 7 THEN NULL ELSE c_mktsegment END, lower(c_name), CAST(0.8 AS DOUBLE), TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE, c_custkey FROM customer
UNION ALL SELECT 2000000 + p_partkey, concat(p_brand, ' ', p_name, ' ', p_type), CASE WHEN p_partkey % 97 = 5 THEN NULL ELSE 'part' END, p_type, p_name, CAST(0.7 AS DOUBLE), TIMESTAMP '2023-12-01 00:00:00' + p_partkey * INTERVAL '1' MINUTE, p_partkey FROM part""",
    "kg_part_of": """
SELECT 1000 + s_suppkey AS child_id, CAST(100 + s_nationkey AS BIGINT) AS parent_id FROM supplier
UNION ALL SELECT 1000000 + c_custkey, CAST(100 + c_nationkey AS BIGINT) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(2 + n_regionkey AS BIGINT) FROM nation""",
    "kg_edge_rows": """
SELECT 1000 + l_suppkey AS a_id, 1000000 + o_custkey AS b_id, concat('msg_', CAST(o_orderkey AS STRING)) AS message_id, round(1.0 - l_discount, 2) AS confidence, CAST(o_orderdate AS TIMESTAMP) AS seen_at, l_returnflag AS context
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "kg_related_to": """
SELECT a_id, b_id, count(DISTINCT message_id) AS weight, max(confidence) AS confidence, max(seen_at) AS last_seen, array_sort(array_agg(DISTINCT message_id)) AS message_ids, max(context) AS context FROM kg_edge_rows GROUP BY a_id, b_id""",
    "kg_facts": """
SELECT concat('f', CAST(event_id AS STRING)) AS id, 1000000 + user_id AS source_entity_id, concat(event_type, ' ', CAST(CAST(floor(value) AS INT) AS STRING)) AS content, CAST(ts AS TIMESTAMP) AS valid_at,
 CASE WHEN event_id % 3 = 0 THEN lead(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS invalid_at, CAST(1.0 AS DOUBLE) AS confidence, CAST(ts AS TIMESTAMP) AS created_at,
 CASE WHEN event_type = 'error' THEN 'llm' ELSE 'user' END AS source, event_id AS vec_id, (event_id % 50) * 1000 AS source_msg_id FROM events""",
    "kg_messages": """
SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS ts,
 conv_id * 7 + turn AS vec_id FROM conversations""",
    "kg_path_edges": """
SELECT a_id, b_id, message_ids, weight FROM kg_related_to WHERE weight >= 3
UNION ALL SELECT b_id, a_id, message_ids, weight FROM kg_related_to WHERE weight >= 3
UNION ALL SELECT child_id, parent_id, array_sort(array_agg(concat('part_', CAST(child_id AS STRING)))), CAST(1 AS BIGINT) FROM kg_part_of WHERE child_id < 1000 GROUP BY child_id, parent_id""",
    "kg_topics": """
SELECT * FROM (VALUES ('General', TRUE, FALSE, 'misc,other', 'world'), ('AFRICA', TRUE, FALSE, 'africa', 'region,nation'), ('AMERICA', TRUE, FALSE, 'america', 'region,nation'), ('ASIA', TRUE, TRUE, 'asia,far east', 'region,nation,supplier'),
 ('EUROPE', FALSE, FALSE, 'europe', 'region,nation'), ('MIDDLE EAST', TRUE, FALSE, 'middle east', 'region,nation'), ('AUTOMOBILE', TRUE, TRUE, 'cars', 'customer'), ('BUILDING', FALSE, TRUE, 'building', 'customer'), ('FURNITURE', TRUE, FALSE, 'furniture', 'customer'),
 ('MACHINERY', TRUE, FALSE, 'machines', 'customer'), ('HOUSEHOLD', TRUE, FALSE, 'home', 'customer'), ('MEDIUM', TRUE, FALSE, 'medium', 'part'), ('PROMO', TRUE, FALSE, 'promotion', 'promo part')) AS t(name, active, hot, aliases, labels)""",
    "kg_rules": "SELECT * FROM (VALUES ('nation', 'supplier'), ('nation', 'customer'), ('supplier', 'customer')) AS t(parent_type, child_type)",
    "kg_term_aliases": """
SELECT alias, CAST(id AS BIGINT) AS id FROM (VALUES ('thtion', 1000), ('retion', 1001), ('antion', 1002), ('ertion', 1003), ('ontion', 1004), ('hetion', 1005), ('enkeit', 1006), ('edtion', 1007), ('the the', 1008)) AS t(alias, id)""",
    "kg_model_prices": "SELECT model, CAST(input AS DOUBLE) AS input, CAST(output AS DOUBLE) AS output FROM (VALUES ('click', 1.0, 2.0), ('view', 0.5, 1.5), ('purchase', 3.0, 15.0)) AS t(model, input, output)",
    "kg_usage": "SELECT event_type AS model, 1 + user_id AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens FROM events",
    "kg_queries": "SELECT item_id AS qid, text FROM benchmark WHERE item_id % 20 = 0",
    "kg_vectors": "SELECT vec_id, embedding FROM embeddings",
    "kg_turns": "SELECT conv_id AS session_id, turn AS turn_id, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS ts, CASE WHEN role = 'user' THEN conv_id * 1000 + turn END AS user_msg_id FROM conversations",
    "kg_names": "SELECT * FROM (VALUES ('ASIA'), ('small ring'), ('supplier#000000003'), ('nobody')) AS t(name)",
    "kg_ids": "SELECT CAST(id AS BIGINT) AS id FROM (VALUES (1), (2), (104), (1003), (1005), (1000007), (1000010), (1000017), (2000005), (77)) AS t(id)",
    "kg_dlq": """
SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id % 4 AS BIGINT) AS attempt, CASE WHEN event_id % 2 = 0 THEN 'extract' ELSE 'write' END AS stage,
 CASE event_id % 9 WHEN 0 THEN 'connection REFUSED by host' WHEN 1 THEN 'rate limit hit' WHEN 2 THEN 'schema mismatch' WHEN 3 THEN '503 Service Unavailable' WHEN 4 THEN 'upstream: bad gateway' WHEN 5 THEN 'Conflicting transactions' WHEN 6 THEN 'model overloaded' WHEN 7 THEN 'Connection timed out' ELSE 'bad value' END AS error, props AS payload FROM events""",
}


def needed(sql: str) -> list[str]:
    """Derived tables that sql names, each after those it reads itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text) and name not in out:
                visit(TABLES[name])
                out.append(name)

    visit(sql)
    return out


def oracle(sql: str) -> str:
    """sql with the derived tables it reads as common table expressions."""
    sql = sql.strip()
    with_ = [f"{name} AS ({TABLES[name].strip()})" for name in needed(sql)]
    if not with_:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(with_)}, {sql[len('WITH RECURSIVE'):].strip()}"
    if sql.upper().startswith("WITH"):
        return f"WITH {', '.join(with_)}, {sql[4:].strip()}"
    return f"WITH {', '.join(with_)} {sql}"


class Tables:
    """The given and the derived tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._made:
            return self._made[name]
        if name in SOURCES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif f"kg_{name}" in TABLES:
            df = self.sql(TABLES[f"kg_{name}"])
        else:
            raise AttributeError(name)
        self._made[name] = df
        return df

    def sql(self, text: str) -> DataFrame:
        used = [n for n in (*SOURCES, *TABLES) if re.search(rf"\b{n}\b(?!_)", text)]
        for n in used:
            text = re.sub(rf"(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        have = {n: getattr(self, n.removeprefix("kg_")) for n in used if f"{{{n}}}" in text}
        if re.search(r"FROM \{kg_edge_rows\} GROUP BY a_id, b_id", text):
            # Dealt by pair they serve all steps of the distinct aggregates, so rows are shuffled once.
            have["kg_edge_rows"] = have["kg_edge_rows"].repartition("a_id", "b_id")
        return self.spark.sql(text, **have)
