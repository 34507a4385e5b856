"""Domain tables as views over the supplied tables: the same text for Spark SQL and for the DuckDB oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_users": "SELECT c_custkey AS user_id, c_name AS full_name, c_nationkey AS home_project FROM customer",
    "fx_projects": "SELECT c_nationkey AS project_id, min(c_custkey) AS owner_user_id, count(*) AS member_count FROM customer GROUP BY c_nationkey",
    "fx_members": "SELECT c_nationkey AS project_id, c_custkey AS user_id, c_custkey % 2 = 0 AS can_view_docs, c_custkey % 3 = 0 AS can_run_extractions FROM customer",
    "fx_documents": """SELECT o_orderkey AS document_id, c_nationkey AS project_id, concat('doc_', CAST(o_orderkey AS VARCHAR(20)), '.pdf') AS filename,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS processing_status, o_orderdate AS created_at, o_orderpriority AS form_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_results_raw": """SELECT l_orderkey AS document_id, o_orderpriority AS form_id, CASE WHEN l_linenumber IN (1,2) THEN 'manual' ELSE 'ai' END AS extraction_type,
        CASE l_linenumber WHEN 1 THEN 'reviewer_1' WHEN 2 THEN 'reviewer_2' END AS reviewer_role, l_linenumber AS slot,
        concat('{"returnflag":"', l_returnflag, '","linestatus":"', l_linestatus, '","quantity":', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)), '}') AS extracted_data,
        l_returnflag, l_linestatus, l_quantity, l_discount, l_shipdate AS created_at, l_partkey AS tb1, l_suppkey AS tb2, l_extendedprice AS tb3
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_results": """SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY document_id, slot ORDER BY created_at DESC, tb1 DESC, tb2 DESC, tb3 DESC) AS rn
        FROM fx_results_raw r) q WHERE rn = 1""",
    "fx_messy": """SELECT document_id, slot, extraction_type, reviewer_role, CASE WHEN tb1 % 11 = 0 THEN NULL WHEN tb1 % 5 = 0 THEN concat('  ', lower(l_returnflag), ' ') ELSE l_returnflag END AS f1,
        CASE WHEN tb2 % 7 = 0 THEN NULL WHEN tb2 % 3 = 0 THEN lower(l_linestatus) ELSE l_linestatus END AS f2, CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) AS f3 FROM fx_results""",
    "fx_assignments": """SELECT d.document_id, d.project_id, r.role AS reviewer_role, CASE WHEN d.document_id % 4 = 0 THEN 'completed' WHEN d.document_id % 4 = 1 THEN 'in_progress'
        WHEN d.document_id % 4 = 2 THEN 'pending' ELSE 'skipped' END AS status FROM fx_documents d
        CROSS JOIN (SELECT 'reviewer_1' AS role UNION ALL SELECT 'reviewer_2' UNION ALL SELECT 'adjudicator') r""",
    "fx_jobs": """SELECT event_id AS job_id, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing'
        ELSE 'cancelled' END AS status, props AS input_data, ts AS created_at, value FROM events""",
    "fx_activities": "SELECT event_id AS activity_id, user_id, event_type AS action_type, ts AS created_at FROM events",
    "fx_call_log": "SELECT event_id AS call_id, event_type AS model, value AS cost, CAST(floor(value) AS INT) AS total_tokens, event_type = 'error' AS rate_limited, ts FROM events",
    "fx_job_log": """SELECT user_id * 1000 + CAST(dayofyear(ts) AS INT) AS job_id, event_id AS seq, ts,
        CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'log' END AS type FROM events""",
    "fx_messages": "SELECT conv_id AS job_id, turn AS seq, role AS type, text AS message FROM conversations",
    "fx_ratings": "SELECT doc_id AS document_id, CAST(quality AS VARCHAR(2)) AS rater_1, CAST(1 - toxic AS VARCHAR(2)) AS rater_2 FROM labels",
    "fx_forms": """SELECT o_orderpriority AS form_id, concat('Form ', o_orderpriority) AS form_name, CASE WHEN count(*) % 2 = 0 THEN 'active' ELSE 'draft' END AS status,
        CASE WHEN o_orderpriority LIKE '1%' THEN '["returnflag","linestatus"]' WHEN o_orderpriority LIKE '2%' THEN 'not a list' ELSE '["returnflag","linestatus","quantity"]' END AS fields FROM orders GROUP BY o_orderpriority""",
    "fx_extractions": """SELECT project_id * 10 + CAST(substr(form_id, 1, 1) AS INT) AS extraction_id, project_id, form_id, max(created_at) AS created_at,
        CASE WHEN count(*) % 3 = 0 THEN 'failed' WHEN count(*) % 3 = 1 THEN 'completed' ELSE 'active' END AS status FROM fx_documents GROUP BY project_id, form_id""",
    "fx_extraction_results": """SELECT d.project_id * 10 + CAST(substr(d.form_id, 1, 1) AS INT) AS extraction_id, r.document_id, r.slot, r.extraction_type, r.reviewer_role, r.extracted_data, r.created_at
        FROM fx_results r JOIN fx_documents d ON r.document_id = d.document_id""",
    "fx_terms": "SELECT p_partkey AS ord, p_name AS term, p_brand AS code, p_type AS synonym FROM part",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, or a domain view over it."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for used in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
        if used in BASE or used in VIEWS:
            view(spark, sf_dir, used).createOrReplaceTempView(used)
    return spark.sql(text)


def oracle(body: str) -> str:
    """DuckDB text: `body` after the views it uses, as common table expressions."""
    needed: list[str] = []

    def need(text):
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(body)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)  # used many times over
    if not ctes:
        return body
    recursive = " RECURSIVE" if body.lstrip().upper().startswith("WITH RECURSIVE ") else ""
    return f"WITH{recursive} {ctes}{',' if body.lstrip().upper().startswith('WITH ') else ''}\n" + re.sub(r"^\s*WITH\s(?:RECURSIVE\s)?", "", body, flags=re.I)
