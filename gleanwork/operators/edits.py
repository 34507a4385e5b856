"""Cell edits, status guards, form checks and notification gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import as_map

#: Status changes an assignment may make; fixed values.
ALLOWED = (("pending", "in_progress"), ("pending", "skipped"), ("in_progress", "completed"), ("in_progress", "skipped"))


def apply_edits(results: DataFrame, edits: DataFrame, json: str = "extracted_data") -> tuple[DataFrame, DataFrame]:
    """(edited results, edits without a target) of edits (document_id, field, new_value); the last of a cell's edits is the largest."""
    cells = edits.groupBy("document_id", "field").agg(F.max("new_value").alias("new_value"))
    changes = cells.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "new_value"))).alias("_new"))
    joined = results.join(changes, "document_id", "left")
    keys = F.map_keys("_new")
    kept = F.map_filter(as_map(F.col(json)), lambda k, _: ~F.array_contains(keys, k))
    out = joined.withColumn(json, F.when(F.col("_new").isNull(), F.col(json)).otherwise(F.to_json(F.map_concat(kept, "_new")))).drop("_new")
    return out, edits.join(results.select("document_id").distinct(), "document_id", "left_anti")


def bad_transitions(changes: DataFrame, allowed=ALLOWED) -> DataFrame:
    """Changes (before, after) that the guard doesn't know; staying the same is no change."""
    known = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return changes.filter((F.col("before") != F.col("after")) & ~F.array_contains(known, F.concat_ws(">", "before", "after")))


def qa_status(comments: Column, reviewed: Column) -> Column:
    """flagged while a comment is unresolved, passed when reviewed without one, else in_progress."""
    open_ = F.size(F.map_filter(comments, lambda _, resolved: ~resolved))
    return F.when(open_ > 0, "flagged").when(reviewed > 0, "passed").otherwise("in_progress")


def rate_limited(status: Column, message: Column) -> Column:
    return F.coalesce(status == 429, F.lit(False)) | F.coalesce(F.lower(message).rlike("rate.?limit|too many requests|quota exceeded|resource exhausted"), F.lit(False))


def uploadable(name: Column, size: Column, content: Column, most: int = 100 * 1024 * 1024) -> Column:
    """A PDF by name and first bytes, not over the size cap."""
    return F.coalesce(F.lower(name).endswith(".pdf") & (size <= most) & (F.substring(content, 1, 5) == F.lit(b"%PDF-")), F.lit(False))


def field_problems(fields: DataFrame) -> DataFrame:
    """(form_id, field_name, problem) of form fields (form_id, field_name, field_type, options)."""
    name = ~F.col("field_name").rlike(r"^[A-Za-z][A-Za-z0-9_]{0,99}$")
    kind = ~F.col("field_type").isin("text", "number", "enum", "object", "array", "boolean")
    bare = (F.col("field_type") == "enum") & (F.coalesce(F.size("options"), F.lit(0)) <= 0)
    each = fields.withColumn("problem", F.explode(F.filter(F.array(*[F.when(c, F.lit(p)) for c, p in ((name, "name"), (kind, "type"), (bare, "options"))]), lambda p: p.isNotNull())))
    twice = fields.groupBy("form_id", "field_name").count().filter("count > 1").select("form_id", "field_name", F.lit("duplicate").alias("problem"))
    return each.select("form_id", "field_name", "problem").union(twice)


def notified(jobs: DataFrame, settings: DataFrame) -> DataFrame:
    """Finished jobs whose user wants to hear of that outcome; without settings, users hear of all."""
    wants = F.when(F.col("status") == "completed", F.coalesce("notify_completed", F.lit(True))).when(F.col("status") == "failed", F.coalesce("notify_failed", F.lit(True))).otherwise(F.lit(False))
    return jobs.join(settings, "user_id", "left").filter(wants)
