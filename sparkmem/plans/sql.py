"""DuckDB counterparts of the adapters, as WITH clauses."""

from __future__ import annotations

OBS = """obs AS (SELECT doc_id AS id, substr(text, 1, 60) AS title, text AS content,
 list_extract(['manual','tool_use','decision','bugfix','pattern','config','discovery','learning'], CAST(doc_id % 8 + 1 AS INTEGER)) AS type,
 source AS project, CASE WHEN doc_id % 5 = 0 THEN 'personal' ELSE 'project' END AS scope, lang || '/' || source AS topic_key, doc_id % 100 AS session_id,
 (doc_id % 10 + 1) / 10 AS confidence, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS created_at,
 TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 + doc_id % 30 AS INTEGER)) AS updated_at,
 CASE WHEN doc_id % 50 = 0 THEN TIMESTAMP '2024-12-31' END AS deleted_at, CASE WHEN doc_id % 8 = 1 THEN lang END AS tool_name, doc_id % 2 = 0 AS t2, doc_id % 3 = 0 AS t3, doc_id % 7 = 0 AS t7 FROM documents)"""
LIVE = OBS + ", live AS (SELECT * FROM obs WHERE deleted_at IS NULL)"
METRICS = """metrics AS (SELECT event_id AS id, event_type AS operation_type, value AS duration_ms, user_id AS session_id, event_type <> 'error' AS success, event_id % 11 AS result_count, ts AS timestamp FROM events)"""
IMPORTANCE = """importance AS (SELECT l_partkey AS observation_id, access_count % 50 / 10 AS score, access_count, last_accessed
 FROM (SELECT l_partkey, count(*) AS access_count, max(l_shipdate) AS last_accessed FROM lineitem GROUP BY l_partkey))"""
EDGES = """edges AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS from_id, l_partkey AS to_id,
 list_extract(['references','relates_to','follows','supersedes','contradicts'], CAST(l_linenumber % 5 + 1 AS INTEGER)) AS relation, least(greatest(l_quantity / 5, 0.0), 10.0) AS weight,
 CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(l_linenumber * 7 % 5 AS INTEGER)) AS created_at, CASE WHEN l_linenumber < 6 THEN l_linenumber % 2 END AS evolution_id,
 o_orderdate AS valid_from, CASE WHEN l_shipdate > o_orderdate THEN l_shipdate END AS invalid_at, CASE WHEN l_returnflag = 'R' AND l_shipdate > o_orderdate THEN l_shipdate END AS valid_until,
 CASE l_returnflag WHEN 'R' THEN 'superseded' WHEN 'A' THEN 'deprecated' ELSE 'current' END AS fact_state FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
GRAPH = """nodes AS (SELECT 'r:' || r_regionkey AS id, r_name AS label, 'region' AS kind FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation' FROM nation
 UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'c:' || c_custkey, c_name, 'customer' FROM customer),
links AS (SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'belongs' AS type, 1.0 AS weight FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'uses', 2.0 FROM supplier
 UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'calls', 1.0 FROM customer)"""

CODE = """tree AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_nationkey + 1) % 25 AS next, 'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey || '.go' AS file FROM supplier JOIN nation ON n_nationkey = s_nationkey),
shared AS (SELECT * FROM tree WHERE k % 7 = 0)"""


def query(body: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
