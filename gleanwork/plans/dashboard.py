"""Dashboards: what stands where in a project, document by document and run by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm
from ..functions.fields import as_map

#: What a value shows as if there is nothing to show; fixed values.
NOTHING, NOT_FILLED, SHOWN, PREVIEW = "—", ("—", "N/A", ""), 100, 200
#: Names that statuses are shown by; fixed values, others show as they are.
STATUS_NAMES = {"active": "Active", "draft": "Draft", "completed": "Completed", "failed": "Failed", "pending": "Pending"}


def shown(json: Column) -> Column:
    """What a JSON value shows as: a list by its length, an object by its value, cut after 100 characters; null as a dash."""
    text = F.trim(json)
    inner = F.get_json_object(json, "$.value")
    value = F.coalesce(inner, F.lit(NOTHING))
    cut = F.when(F.length(value) > SHOWN, F.concat(F.substring(value, 1, SHOWN), F.lit("…"))).otherwise(value)
    valued = F.map_contains_key(F.from_json(json, "map<string,string>"), "value")
    return (
        F.when(json.isNull() | (text == "null"), F.lit(NOTHING))
        .when(text.startswith("["), F.concat(F.lit("["), F.coalesce(F.json_array_length(json), F.lit(0)).cast("string"), F.lit(" items]")))
        .when(text.startswith("{"), F.when(valued, cut).otherwise(F.substring(json, 1, SHOWN)))
        .otherwise(json)
    )


def filled(json: Column) -> Column:
    return F.coalesce(~shown(json).isin(*NOT_FILLED), F.lit(False))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW)


def list_length(json: Column) -> Column:
    """Length of a JSON list; 0 for anything else."""
    return F.coalesce(F.json_array_length(json), F.lit(0))


def status_name(status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, status), status)


def without_sources(values: Column) -> Column:
    """A map without the keys that hold a source text."""
    return F.map_filter(values, lambda k, _: ~F.lower(k).contains("source_text") & ~F.lower(k).contains("source text"))


def fill_stats(results: DataFrame, by: str) -> DataFrame:
    """(by, n_results, n_documents, filled_fields, total_fields) of results' values, source texts left out."""
    values = without_sources(as_map(F.col("extracted_data")))
    rows = results.select(by, "document_id", values.alias("v"))
    n_filled = F.size(F.map_filter("v", lambda _, x: filled(x)))
    return rows.groupBy(by).agg(F.count("*").alias("n_results"), F.count_distinct("document_id").alias("n_documents"), F.sum(n_filled).alias("filled_fields"), F.sum(F.size("v")).alias("total_fields"))


def document_summary(documents: DataFrame, results: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row a document: whether both reviewers, the machine and the adjudicator are done, and how far the reviewers agree.

    All of a document's results meet in one grouped pass; documents without any stay.
    """
    text = lambda role: F.max(F.when(F.col("reviewer_role") == role, F.col("extracted_data")))
    per = results.groupBy("document_id").agg(F.count_if(F.col("extraction_type") == "ai").alias("n_ai"), text("reviewer_1").alias("t1"), text("reviewer_2").alias("t2"))
    done = assignments.filter("reviewer_role = 'adjudicator'").groupBy("document_id").agg(F.max(F.col("status") == "completed").alias("adjudicated"))
    out = documents.select("document_id").join(per, "document_id", "left").join(done, "document_id", "left")
    m1, m2 = as_map(F.col("t1")), as_map(F.col("t2"))
    agreed = F.size(F.filter(F.map_keys(m1), lambda k: F.coalesce(norm.both_agree(F.try_element_at(m1, k), F.try_element_at(m2, k)), F.lit(False))))
    both = F.col("t1").isNotNull() & F.col("t2").isNotNull()
    return out.select(
        "document_id", F.coalesce("n_ai", F.lit(0)).alias("n_ai"), F.col("t1").isNotNull().alias("has_r1"), F.col("t2").isNotNull().alias("has_r2"),
        F.when(both, agreed).alias("agreed"), F.coalesce("adjudicated", F.lit(False)).alias("adjudicated"),
    )


def error_fields(errors: DataFrame, by: str) -> DataFrame:
    """(field, n): how often each key of the maps `by` occurs, the most frequent first."""
    return errors.select(F.explode(by).alias("field", "_")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def project_stats(documents: DataFrame, extractions: DataFrame, results: DataFrame) -> DataFrame:
    """(project_id, n_documents, n_completed, n_extractions, n_failed_runs, n_results): three grouped sides, joined by project."""
    docs = documents.groupBy("project_id").agg(F.count("*").alias("n_documents"), F.count_if(F.col("processing_status") == "completed").alias("n_completed"))
    runs = extractions.groupBy("project_id").agg(F.count("*").alias("n_extractions"), F.count_if(F.col("status") == "failed").alias("n_failed_runs"))
    found = results.groupBy("extraction_id").agg(F.count("*").alias("n")).join(extractions.select("extraction_id", "project_id"), "extraction_id").groupBy("project_id").agg(F.sum("n").alias("n_results"))
    return docs.join(runs, "project_id", "left").join(found, "project_id", "left").fillna(0)


def newest_jobs(jobs: DataFrame) -> DataFrame:
    """(extraction_id, job_id, created_at) of each extraction's newest job."""
    return jobs.groupBy("extraction_id").agg(F.max(F.struct("created_at", "job_id")).alias("_j")).select("extraction_id", "_j.job_id", "_j.created_at")


def retry_set(jobs: DataFrame, failures: DataFrame, documents: DataFrame) -> DataFrame:
    """(extraction_id, document_id) to run again: the documents that failed in an extraction's newest job; all of its documents if none did.

    jobs (extraction_id, job_id, created_at), failures (job_id, document_id), documents (extraction_id, document_id).
    Failures of older jobs are not looked at, and need not be there.
    """
    newest = newest_jobs(jobs).drop("created_at")
    failed = newest.join(failures, "job_id").select("extraction_id", "document_id").distinct()
    whole = documents.join(failed.select("extraction_id").distinct(), "extraction_id", "left_anti").join(newest.select("extraction_id"), "extraction_id", "left_semi")
    return failed.unionByName(whole.select("extraction_id", "document_id"))


def clean_export(grid: DataFrame, violations: DataFrame, fields: list[str]) -> DataFrame:
    """One row a document: its fields in sorted order, '' where missing, and its violations as a JSON list of (field, rule_id)."""
    listed = violations.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", "rule_id")))).alias("violations"))
    columns = [F.coalesce(F.try_element_at("values", F.lit(f)), F.lit("")).alias(f) for f in sorted(fields)]
    return grid.select("document_id", *columns).join(listed, "document_id", "left").fillna("[]", ["violations"])


def all_fields(results: DataFrame) -> list[str]:
    """The sorted union of the keys that results have: the header of an export, a short list."""
    rows = results.select(F.explode(F.map_keys(as_map(F.col("extracted_data")))).alias("field")).distinct().collect()
    return sorted(r.field for r in rows)


def first_fields(results: DataFrame, order: str) -> list[str]:
    """The keys of the first record, in its order: the header of a single export."""
    row = results.orderBy(order).select(F.map_keys(as_map(F.col("extracted_data")))).first()
    return list(row[0]) if row else []
