"""Listing, paging, latest runs, names, search and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import edits, tables
from ..registry import query


@query("SELECT document_id, created_at, (SELECT count(*) FROM fx_documents)::BIGINT AS total FROM fx_documents ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 40")
def documents_page(spark, sf_dir):
    return tables.page_with_total(view(spark, sf_dir, "fx_documents").select("document_id", "created_at"), [F.desc("created_at"), F.asc("document_id")], 3, 20)


@query("SELECT EXISTS (SELECT 1 FROM fx_documents WHERE processing_status = 'failed') AS found UNION ALL SELECT EXISTS (SELECT 1 FROM fx_documents WHERE processing_status = 'lost')")
def status_probe(spark, sf_dir):
    docs = view(spark, sf_dir, "fx_documents")
    return tables.any_row(docs, F.col("processing_status") == "failed").union(tables.any_row(docs, F.col("processing_status") == "lost"))


@query("""SELECT form_id, n_active, last_run, row_number() OVER (ORDER BY n_active = 0, last_run DESC NULLS LAST, form_id)::INT AS place FROM
(SELECT form_id, count(*) FILTER (WHERE status = 'active')::BIGINT AS n_active, max(created_at) AS last_run FROM fx_extractions GROUP BY 1)""")
def forms_active_first(spark, sf_dir):
    runs = view(spark, sf_dir, "fx_extractions").groupBy("form_id").agg(F.count_if(F.col("status") == "active").alias("n_active"), F.max("created_at").alias("last_run"))
    return tables.active_first(runs, F.col("n_active") > 0, "last_run", "form_id")


@query("""SELECT form_id, arg_max(extraction_id, (created_at, extraction_id)) AS latest, arg_max(extraction_id, (created_at, extraction_id)) FILTER (WHERE status = 'failed') AS latest_failed,
count(*) FILTER (WHERE status = 'active')::BIGINT AS n_active FROM fx_extractions GROUP BY 1""")
def latest_runs(spark, sf_dir):
    return tables.latest_runs(view(spark, sf_dir, "fx_extractions"), "form_id", "extraction_id", "created_at", "status")


@query("""SELECT document_id, extraction_type, slot, created_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id, extraction_type ORDER BY created_at DESC, slot DESC) AS place FROM fx_results) WHERE place = 1""")
def latest_by_type(spark, sf_dir):
    results = view(spark, sf_dir, "fx_results").select("document_id", "extraction_type", "slot", "created_at")
    return tables.latest(results, ["document_id", "extraction_type"], [F.desc("created_at"), F.desc("slot")])


@query("SELECT project_id, min(src)::INT AS src FROM (SELECT project_id, 0 AS src FROM fx_projects WHERE owner_user_id % 3 = 0 UNION ALL SELECT project_id, 1 FROM fx_members WHERE user_id % 10 = 0) GROUP BY 1")
def owned_then_joined(spark, sf_dir):
    owned = view(spark, sf_dir, "fx_projects").filter("owner_user_id % 3 = 0").select("project_id")
    joined = view(spark, sf_dir, "fx_members").filter("user_id % 10 = 0").select("project_id").distinct()
    return tables.first_of("project_id", owned, joined)


@query("SELECT job_id, row_number() OVER (ORDER BY created_at, job_id)::BIGINT AS place FROM fx_jobs WHERE status = 'pending'")
def queue_position(spark, sf_dir):
    pending = view(spark, sf_dir, "fx_jobs").filter("status = 'pending'").select("job_id", "created_at", F.lit("q").alias("queue"))
    return tables.numbered(pending, ["queue"], [F.asc("created_at"), F.asc("job_id")], "place", F.date_trunc("hour", "created_at")).select("job_id", "place")


@query("SELECT project_id, document_id, slot FROM (SELECT d.project_id, r.document_id, r.slot FROM fx_documents d JOIN fx_results r ON r.document_id = d.document_id ORDER BY d.project_id, r.document_id, r.slot LIMIT 30)")
def first_results_of_projects(spark, sf_dir):
    docs = view(spark, sf_dir, "fx_documents").select("project_id", "document_id")
    return tables.page(view(spark, sf_dir, "fx_results").select("document_id", "slot").join(docs, "document_id"), [F.asc("project_id"), F.asc("document_id"), F.asc("slot")], limit=30)


@query("SELECT s_suppkey FROM supplier WHERE lower(trim(s_name)) = 'supplier#000000003'")
def name_equals(spark, sf_dir):
    return tables.same_name(view(spark, sf_dir, "supplier"), "s_name", "  SUPPLIER#000000003 ").select("s_suppkey")


@query("SELECT ord, term FROM fx_terms WHERE contains(lower(term), 'bolt') OR contains(lower(synonym), 'promo') ORDER BY ord LIMIT 40")
def vocabulary_search(spark, sf_dir):
    terms = view(spark, sf_dir, "fx_terms").withColumn("synonyms", F.array(F.col("synonym"), F.lit("other")))
    both = tables.find_terms(terms, "BOLT", 40).unionByName(tables.find_terms(terms, "PrOmO", 40)).distinct()
    return both.orderBy("ord").limit(40).select("ord", "term")


@query("SELECT document_id FROM fx_documents WHERE contains(lower(form_id), 'high') OR processing_status = 'failed'")
def label_search(spark, sf_dir):
    docs = view(spark, sf_dir, "fx_documents").withColumn("labels", F.array("form_id", "processing_status"))
    return tables.find_labels(docs, "labels", "HIGH").unionByName(tables.find_labels(docs, "labels", "fail")).select("document_id").distinct()


@query("SELECT job_id, status FROM fx_jobs WHERE json_extract_string(input_data, '$.k') = '7'")
def jobs_holding_key(spark, sf_dir):
    return view(spark, sf_dir, "fx_jobs").filter(F.get_json_object("input_data", "$.k") == "7").select("job_id", "status")


@query("""SELECT w, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN created_at >= date_trunc('day', (SELECT max(created_at) FROM fx_activities)) THEN ['today', 'week', 'month', 'odd'] WHEN created_at >= (SELECT max(created_at) FROM fx_activities) - INTERVAL 7 DAY
THEN ['week', 'month', 'odd'] WHEN created_at >= (SELECT max(created_at) FROM fx_activities) - INTERVAL 30 DAY THEN ['month'] ELSE []::VARCHAR[] END) AS w FROM fx_activities) GROUP BY 1""")
def activity_windows(spark, sf_dir):
    acts = view(spark, sf_dir, "fx_activities")
    now = F.lit(acts.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    names = F.array(*[F.when(F.col("created_at") >= tables.since(now, w), F.lit(w)) for w in ("today", "week", "month", "odd")])
    return acts.select(F.explode(F.filter(names, lambda w: w.isNotNull())).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("SELECT project_id, user_id, role, full_name FROM (SELECT p.project_id, p.owner_user_id AS user_id, 'owner' AS role FROM fx_projects p UNION ALL SELECT m.project_id, m.user_id, 'member' FROM fx_members m WHERE NOT EXISTS (SELECT 1 FROM fx_projects p WHERE p.project_id = m.project_id AND p.owner_user_id = m.user_id)) x LEFT JOIN fx_users u USING (user_id)")
def project_members(spark, sf_dir):
    return tables.members_with_owner(view(spark, sf_dir, "fx_projects"), view(spark, sf_dir, "fx_members"), view(spark, sf_dir, "fx_users"))


@query("""SELECT a.document_id, a.reviewer_role, d.filename, coalesce(CASE WHEN u.user_id % 4 = 0 THEN NULL WHEN u.user_id % 4 = 1 THEN 'u' || u.user_id || '@x.org' ELSE u.full_name END, 'Reviewer ' || right(a.reviewer_role, 1)) AS name
FROM fx_assignments a JOIN fx_documents d ON a.document_id = d.document_id LEFT JOIN fx_users u ON u.user_id = a.document_id % 200 WHERE a.reviewer_role <> 'adjudicator'""")
def assignment_names(spark, sf_dir):
    people = view(spark, sf_dir, "fx_users").withColumn("email", F.when(F.col("user_id") % 4 == 1, F.concat(F.lit("u"), "user_id", F.lit("@x.org"))))
    people = people.withColumn("full_name", F.when(F.col("user_id") % 4 == 0, F.lit(None)).when(F.col("user_id") % 4 == 1, " ").otherwise(F.col("full_name")))
    rows = view(spark, sf_dir, "fx_assignments").filter("reviewer_role <> 'adjudicator'").join(view(spark, sf_dir, "fx_documents").select("document_id", "filename"), "document_id")
    rows = rows.withColumn("user", F.col("document_id") % 200)
    return tables.named(rows, "user", people, F.concat(F.lit("Reviewer "), F.right("reviewer_role", F.lit(1)))).select("document_id", "reviewer_role", "filename", "name")


@query("""SELECT activity_id, action_type <> 'click' OR user_id % 2 = 0 AS read, CASE WHEN action_type = 'click' AND user_id % 2 = 0 THEN TIMESTAMP '2024-05-01' END AS read_at FROM fx_activities""")
def mark_read(spark, sf_dir):
    acts = view(spark, sf_dir, "fx_activities").select("activity_id", "user_id", (F.col("action_type") != "click").alias("read"), F.lit(None).cast("timestamp_ntz").alias("read_at"))
    rows, _ = tables.mark_read(acts, F.col("user_id") % 2 == 0, F.expr("timestamp_ntz'2024-05-01'"))
    return rows.drop("user_id")


@query("SELECT count(*)::BIGINT AS n_marked FROM fx_activities WHERE action_type = 'click' AND user_id % 2 = 0")
def marked_count(spark, sf_dir):
    acts = view(spark, sf_dir, "fx_activities").withColumn("read", F.col("action_type") != "click").withColumn("read_at", F.lit(None).cast("timestamp_ntz"))
    return tables.mark_read(acts, F.col("user_id") % 2 == 0, F.expr("timestamp_ntz'2024-05-01'"))[1]


@query("SELECT job_id, CASE WHEN user_id % 2 = 0 AND status IN ('pending', 'processing') THEN 'cancelled' ELSE status END AS status FROM fx_jobs")
def cancel_jobs(spark, sf_dir):
    jobs = view(spark, sf_dir, "fx_jobs").select("job_id", "user_id", "status")
    return tables.set_where_in(jobs, F.col("user_id") % 2 == 0, "status", ["pending", "processing"], "cancelled").drop("user_id")


@query("""SELECT document_id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY md5(concat_ws(':', 'second', CAST(document_id AS VARCHAR))), document_id) AS place, count(*) OVER (PARTITION BY project_id) AS n
FROM fx_documents WHERE processing_status = 'completed' AND document_id % 4 <> 0) WHERE place <= greatest(1, floor(n * 20 / 100.0))""")
def second_sample(spark, sf_dir):
    docs = view(spark, sf_dir, "fx_documents").filter("processing_status = 'completed'")
    return tables.exact_sample(tables.unsampled(docs, docs.filter("document_id % 4 = 0"), "document_id"), "project_id", "document_id", 20, "second").select("document_id", "project_id")


@query("""SELECT document_id, slot, CASE WHEN document_id % 7 = 0 AND document_id % 3 <> 0 THEN 'X' ELSE l_returnflag END AS returnflag, document_id % 7 = 0 AND document_id % 3 = 0 AS kept FROM fx_results WHERE slot = 1""")
def edit_cells(spark, sf_dir):
    """Edits of cells, some of whose documents have no result: these come back as errors, the others take effect."""
    results = view(spark, sf_dir, "fx_results").filter("slot = 1").select("document_id", "slot", "extracted_data")
    cells = view(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit("returnflag").alias("field"), F.lit("X").alias("new_value"))
    held = results.filter("document_id % 3 <> 0")
    out, errors = edits.apply_edits(held, cells)
    lost = results.join(errors.select("document_id").distinct().withColumn("kept", F.lit(True)), "document_id", "left").filter("document_id % 3 = 0").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return out.withColumn("kept", F.lit(False)).unionByName(lost).select("document_id", "slot", F.get_json_object("extracted_data", "$.returnflag").alias("returnflag"), "kept")


@query("""SELECT r.document_id, r.slot FROM fx_results r LEFT JOIN (SELECT DISTINCT document_id FROM fx_assignments WHERE status = 'pending') a ON a.document_id = r.document_id
WHERE a.document_id IS NULL OR r.slot = 2 OR r.extraction_type = 'ai'""")
def blinded_results(spark, sf_dir):
    results = view(spark, sf_dir, "fx_results").select("document_id", "slot", "extraction_type", F.when(F.col("slot") == 2, 7).otherwise(8).alias("extracted_by"))
    mine = view(spark, sf_dir, "fx_assignments").filter("status = 'pending'").select("document_id", F.lit(7).alias("reviewer_user_id"))
    return tables.unblinded(results, mine, 7, "partial").select("document_id", "slot")
