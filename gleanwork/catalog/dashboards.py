"""Dashboards, rules over the grid, exports and retry sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import fields
from ..plans import dashboard, review
from ..registry import query
from ..storage import written


@query("""SELECT d.document_id, count(*) FILTER (WHERE r.extraction_type = 'ai')::BIGINT AS n_ai, max(r.slot = 1) IS TRUE AS has_r1, max(r.slot = 2) IS TRUE AS has_r2,
CASE WHEN max(r.slot = 1) AND max(r.slot = 2) THEN CAST(max(r.l_returnflag) FILTER (WHERE slot = 1) = max(r.l_returnflag) FILTER (WHERE slot = 2) AS INT) + CAST(max(r.l_linestatus) FILTER (WHERE slot = 1) = max(r.l_linestatus) FILTER (WHERE slot = 2) AS INT)
+ CAST(max(CAST(r.l_quantity AS INT)) FILTER (WHERE slot = 1) = max(CAST(r.l_quantity AS INT)) FILTER (WHERE slot = 2) AS INT) END AS agreed, d.document_id % 4 = 0 AS adjudicated FROM fx_documents d LEFT JOIN fx_results r ON r.document_id = d.document_id GROUP BY d.document_id""")
def document_summary(spark, sf_dir):
    return dashboard.document_summary(view(spark, sf_dir, "fx_documents"), view(spark, sf_dir, "fx_results"), view(spark, sf_dir, "fx_assignments"))


@query("""SELECT extraction_id, count(*)::BIGINT AS n_results, count(DISTINCT document_id)::BIGINT AS n_documents, count(*)::BIGINT * 3 - count(*) FILTER (WHERE extraction_type = 'ai' AND slot % 2 = 1) AS filled_fields, (count(*) * 3)::BIGINT AS total_fields FROM fx_extraction_results GROUP BY 1""")
def extraction_fill(spark, sf_dir):
    results = view(spark, sf_dir, "fx_extraction_results")
    text = F.when((F.col("extraction_type") == "ai") & (F.col("slot") % 2 == 1), F.regexp_replace("extracted_data", '"linestatus":"[A-Z]"', '"linestatus":"N/A","x.source_text":"y"')).otherwise(F.col("extracted_data"))
    return dashboard.fill_stats(results.withColumn("extracted_data", text), "extraction_id")


@query("""SELECT p.project_id, count(*)::BIGINT AS n_documents, count(*) FILTER (WHERE processing_status = 'completed')::BIGINT AS n_completed, (SELECT count(*) FROM fx_extractions e WHERE e.project_id = p.project_id)::BIGINT AS n_extractions,
(SELECT count(*) FROM fx_extractions e WHERE e.project_id = p.project_id AND e.status = 'failed')::BIGINT AS n_failed_runs, (SELECT count(*) FROM fx_extraction_results r WHERE r.extraction_id // 10 = p.project_id)::BIGINT AS n_results FROM fx_documents p GROUP BY 1""")
def project_dashboard(spark, sf_dir):
    return dashboard.project_stats(view(spark, sf_dir, "fx_documents"), view(spark, sf_dir, "fx_extractions"), view(spark, sf_dir, "fx_extraction_results"))


@query("""SELECT e.extraction_id, e.project_id, f.form_name, CASE e.status WHEN 'active' THEN 'Active' WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' END AS status,
CASE f.fields WHEN 'not a list' THEN 0 ELSE len(string_split(f.fields, ',')) END::INT AS n_fields FROM fx_extractions e LEFT JOIN fx_forms f ON e.form_id = f.form_id""")
def extraction_list(spark, sf_dir):
    forms = view(spark, sf_dir, "fx_forms").select("form_id", "form_name", dashboard.list_length(F.col("fields")).alias("n_fields"))
    runs = view(spark, sf_dir, "fx_extractions").join(forms, "form_id", "left")
    return runs.select("extraction_id", "project_id", "form_name", dashboard.status_name(F.col("status")).alias("status"), "n_fields")


@query("SELECT r.document_id, r.slot FROM fx_extraction_results r WHERE r.extraction_id IN (SELECT extraction_id FROM fx_extractions WHERE status = 'active' AND project_id IN (SELECT project_id FROM fx_projects WHERE owner_user_id % 2 = 0))")
def results_of_runs(spark, sf_dir):
    mine = view(spark, sf_dir, "fx_projects").filter("owner_user_id % 2 = 0").select("project_id")
    runs = view(spark, sf_dir, "fx_extractions").filter("status = 'active'").join(mine, "project_id", "left_semi").select("extraction_id")
    return view(spark, sf_dir, "fx_extraction_results").join(runs, "extraction_id", "left_semi").select("document_id", "slot")


@query("""SELECT e.extraction_id, e.status, j.job_id, j.status AS job_status FROM fx_extractions e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY json_extract_string(input_data, '$.k') ORDER BY created_at DESC, job_id DESC) AS place FROM fx_jobs) WHERE place = 1) j
ON json_extract_string(j.input_data, '$.k') = CAST(e.extraction_id AS VARCHAR)""")
def runs_with_jobs(spark, sf_dir):
    jobs = view(spark, sf_dir, "fx_jobs").select(F.get_json_object("input_data", "$.k").alias("k"), "created_at", "job_id", F.col("status").alias("job_status"))
    newest = jobs.groupBy("k").agg(F.max(F.struct("created_at", "job_id", "job_status")).alias("j")).select(F.col("k").cast("bigint").alias("extraction_id"), "j.job_id", "j.job_status")
    return view(spark, sf_dir, "fx_extractions").select("extraction_id", "status").join(newest, "extraction_id", "left")


@query("SELECT field, count(*)::BIGINT AS n FROM (SELECT 'returnflag' AS field FROM fx_results WHERE l_returnflag = 'R' UNION ALL SELECT 'linestatus' FROM fx_results WHERE l_linestatus = 'F') GROUP BY 1")
def error_fields(spark, sf_dir):
    errors = F.map_filter(fields.as_map(F.col("extracted_data")), lambda k, v: v.isin("R", "F"))
    return dashboard.error_fields(view(spark, sf_dir, "fx_results").select(errors.alias("errors")), "errors")


@query("""WITH newest AS (SELECT user_id % 25 AS extraction_id, arg_max(job_id, (created_at, job_id)) AS job_id FROM fx_jobs GROUP BY 1), bad AS (SELECT j.job_id, d.document_id FROM fx_jobs j JOIN fx_documents d ON d.project_id = j.user_id % 25 AND d.document_id % 9 = j.job_id % 9 WHERE j.status IN ('failed', 'completed')),
f AS (SELECT n.extraction_id, b.document_id FROM newest n JOIN bad b ON n.job_id = b.job_id) SELECT extraction_id, document_id FROM f UNION ALL SELECT n.extraction_id, d.document_id FROM newest n JOIN fx_documents d ON d.project_id = n.extraction_id WHERE n.extraction_id NOT IN (SELECT extraction_id FROM f)""")
def retry_set(spark, sf_dir):
    """Documents fail in the jobs of their extraction that share their remainder by 9; only those of newest jobs are made, since no other is asked for."""
    jobs = view(spark, sf_dir, "fx_jobs").withColumn("extraction_id", F.col("user_id") % 25).select("extraction_id", "job_id", "created_at", "status")
    docs = view(spark, sf_dir, "fx_documents").select(F.col("project_id").cast("long").alias("extraction_id"), "document_id")
    newest = written(dashboard.newest_jobs(jobs))  # a row an extraction
    ended = jobs.filter("status in ('failed', 'completed')").join(F.broadcast(newest.select("job_id")), "job_id", "left_semi")
    slots = ended.select("job_id", "extraction_id", (F.col("job_id") % 9).alias("_slot"))
    bad = docs.withColumn("_slot", F.col("document_id") % 9).join(F.broadcast(slots), ["extraction_id", "_slot"]).select("job_id", "document_id")
    return dashboard.retry_set(newest, bad, docs)


RULE_ROWS = [(1, "returnflag", "required", None, None, None, None, None), (2, "quantity", "range", 3.0, 48.0, None, None, None), (3, "linestatus", "regex", None, None, "[F]", None, None), (4, "comment", "cross_field", None, None, None, None, "returnflag"), (5, "returnflag", "format", None, None, None, "email", None)]
BROKEN = """v AS (SELECT document_id, 1 AS rule_id, 'returnflag' AS field, NULL AS value FROM fx_results WHERE slot = 1 AND l_returnflag = 'N' UNION ALL SELECT document_id, 2, 'quantity', CAST(CAST(l_quantity AS INT) AS VARCHAR) FROM fx_results WHERE slot = 1 AND (CAST(l_quantity AS INT) < 3 OR CAST(l_quantity AS INT) > 48)
UNION ALL SELECT document_id, 3, 'linestatus', l_linestatus FROM fx_results WHERE slot = 1 AND l_linestatus <> 'F' UNION ALL SELECT document_id, 4, 'comment', NULL FROM fx_results WHERE slot = 1 AND l_returnflag <> 'N' UNION ALL SELECT document_id, 5, 'returnflag', l_returnflag FROM fx_results WHERE slot = 1 AND l_returnflag <> 'N')"""


def grid(spark, sf_dir):
    values = F.map_filter(fields.as_map(F.col("extracted_data")), lambda k, v: v != "N")
    return view(spark, sf_dir, "fx_results").filter("slot = 1").select("document_id", values.alias("values"))


@query(f"WITH {BROKEN} SELECT * FROM v")
def validate_all(spark, sf_dir):
    return review.violations(grid(spark, sf_dir), spark.createDataFrame(RULE_ROWS, review.RULES))


@query(f"""WITH {BROKEN} SELECT r.document_id, l_linestatus AS linestatus, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity, CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag END AS returnflag,
'[' || string_agg('{{"field":"' || v.field || '","rule_id":' || v.rule_id || '}}', ',' ORDER BY v.field, v.rule_id) || ']' AS violations FROM fx_results r JOIN v ON v.document_id = r.document_id WHERE r.slot = 1 GROUP BY ALL""")
def clean_export(spark, sf_dir):
    rows = grid(spark, sf_dir)
    broken = review.violations(rows, spark.createDataFrame(RULE_ROWS, review.RULES))
    return dashboard.clean_export(rows, broken, dashboard.all_fields(view(spark, sf_dir, "fx_results")))


@query("""WITH m AS (SELECT document_id, l_returnflag AS f, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM fx_results WHERE slot = 1), a AS (SELECT document_id, l_returnflag AS f, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM fx_results WHERE slot = 3),
l AS (SELECT 'returnflag' AS field, coalesce(m.f = a.f, false) AS ok FROM m FULL JOIN a ON m.document_id = a.document_id UNION ALL SELECT 'quantity', coalesce(m.q = a.q, false) FROM m FULL JOIN a ON m.document_id = a.document_id)
SELECT field, count(*)::BIGINT AS total_fields, count(*) FILTER (WHERE ok)::BIGINT AS matches, round_even((count(*) FILTER (WHERE ok) / count(*))::DOUBLE, 4) + 0.0::DOUBLE AS accuracy FROM l GROUP BY 1""")
def compare_statistics(spark, sf_dir):
    values = fields.field_values(view(spark, sf_dir, "fx_results"), "document_id", "slot").filter(F.col("field").isin("returnflag", "quantity"))
    return review.accuracy(review.result_compare(values.filter("slot = 1").drop("slot"), values.filter("slot = 3").drop("slot")), "field")


@query("""SELECT r.document_id, r.l_returnflag AS correct_value, x.l_returnflag AS iteration_value FROM fx_results r LEFT JOIN fx_results x ON x.document_id = r.document_id AND x.slot = r.slot + 2 WHERE r.slot IN (1, 2)""")
def feedback_on_iterations(spark, sf_dir):
    results = view(spark, sf_dir, "fx_results").select("document_id", "slot", "l_returnflag")
    asked = results.filter("slot in (1, 2)").select("document_id", (F.col("slot") + 2).alias("slot"), F.col("l_returnflag").alias("correct_value"))
    return asked.join(results.withColumnRenamed("l_returnflag", "iteration_value"), ["document_id", "slot"], "left").select("document_id", "correct_value", "iteration_value")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '—' WHEN 1 THEN '[2 items]' WHEN 2 THEN repeat('a', 100) || '…' WHEN 3 THEN '—' ELSE event_type END AS shown, substr(repeat(event_type, 60), 1, 200) AS preview, event_id % 5 IN (1, 2, 4) AS filled FROM events""")
def display_values(spark, sf_dir):
    json = F.expr("""CASE event_id % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '[1, {"a": 2}]' WHEN 2 THEN concat('{"value": "', repeat('a', 130), '"}') WHEN 3 THEN '{"value": null}' ELSE event_type END""")
    return view(spark, sf_dir, "events").select("event_id", dashboard.shown(json).alias("shown"), dashboard.preview(F.repeat("event_type", F.lit(60))).alias("preview"), dashboard.filled(json).alias("filled"))
