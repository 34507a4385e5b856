"""Dependency-staged extraction plans, and what pilots taught."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graphs
from ..operators.tables import numbered


def stages(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(name, stage, execution, waits_for) of an acyclic graph (name, needs): the longest chain of dependencies below.

    `issues` says beforehand whether the graph has cycles; names on a cycle or behind one are left out.
    """
    out = graphs.levels(nodes, needs).filter("stage is not null")
    sizes = out.groupBy("stage").agg(F.count("*").alias("_n"))
    out = out.join(sizes, "stage")
    execution = F.when(F.col("_n") > 1, "parallel").otherwise("sequential")
    return out.select("name", "stage", execution.alias("execution"), F.when(F.col("stage") > 1, F.col("stage") - 1).alias("waits_for"))


def topological(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(name, place): an order in which every name comes after what it needs; names of one stage by name.

    Stages are counted and added up first, and names numbered within parts of a stage, so no task orders all names.
    """
    out = graphs.levels(nodes, needs).filter("stage is not null")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a stage
    starts = out.groupBy("stage").agg(F.count("*").alias("_n")).select("stage", before.alias("_start"))
    inside = numbered(out, ["stage"], [F.asc("name")], "_place", F.substring("name", 1, 3))
    return inside.join(starts, "stage").select("name", (F.col("_start") + F.col("_place")).cast("int").alias("place"))


def issues(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(kind, name): dependencies that don't exist, names defined twice, and names on a cycle."""
    unknown = needs.join(nodes.withColumnRenamed("name", "needs"), "needs", "left_anti").select(F.lit("unknown").alias("kind"), F.col("needs").alias("name"))
    twice = nodes.groupBy("name").count().filter("count > 1").select(F.lit("duplicate").alias("kind"), "name")
    cyclic = graphs.on_cycles(needs).select(F.lit("cycle").alias("kind"), "name")
    return unknown.union(twice).union(cyclic).distinct()


def last_examples(feedback: DataFrame, by: str, newest: list[Column], note: str, n: int = 5) -> DataFrame:
    """(by, notes): the n newest notes of each key, oldest first, joined by |."""
    ranked = feedback.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*newest))).filter(F.col("_r") <= n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(note).alias("note"))))
    return ranked.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["note"]), "|").alias("notes"))


def field_coverage(form_fields: DataFrame, signature_fields: DataFrame) -> DataFrame:
    """(field, problem): form fields that no signature gives, fields given more than once, and given ones the form lacks."""
    missing = form_fields.join(signature_fields.select("field"), "field", "left_anti").select("field", F.lit("missing").alias("problem"))
    twice = signature_fields.groupBy("field").agg(F.count_distinct("signature").alias("n")).filter("n > 1").select("field", F.lit("duplicate").alias("problem"))
    extra = signature_fields.join(form_fields, "field", "left_anti").select("field", F.lit("unknown").alias("problem")).distinct()
    return missing.union(twice).union(extra)


def stage_problems(stages: DataFrame) -> DataFrame:
    """(stage, problem) of pipeline stages (stage, execution, signatures, provides, requires).

    A stage may require only what earlier stages provide; signatures of a parallel stage must provide
    different fields; a stage has signatures, and a parallel one more than one.
    """
    given = stages.select(F.col("stage").alias("by"), F.explode("provides").alias("field"))
    needed = stages.select("stage", F.explode("requires").alias("field"))
    late = needed.join(given, "field", "left").groupBy("stage", "field").agg(F.coalesce(F.min("by") >= F.col("stage"), F.lit(True)).alias("late")).filter("late")
    empty = stages.filter(F.size("signatures") == 0).select("stage", F.lit("no signatures").alias("problem"))
    alone = stages.filter((F.col("execution") == "parallel") & (F.size("signatures") == 1)).select("stage", F.lit("parallel with one signature").alias("problem"))
    overlap = stages.filter((F.col("execution") == "parallel") & (F.size("provides") > F.size(F.array_distinct("provides")))).select("stage", F.lit("field provided twice").alias("problem"))
    return late.select("stage", F.concat(F.lit("requires later field "), "field").alias("problem")).union(empty).union(alone).union(overlap)


def accumulate(feedback: DataFrame) -> DataFrame:
    """(field, examples, notes) of pilot feedback (field, iteration, rating, correct_value, note): corrections in order, notes once each."""
    rows = feedback.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("iteration", "rating", "correct_value", "note"))).alias("rows"))
    fixed = F.filter("rows", lambda r: (r["rating"] == "incorrect") & r["correct_value"].isNotNull())
    notes = F.array_distinct(F.filter(F.transform("rows", lambda r: F.trim(r["note"])), lambda n: n.isNotNull() & (n != "")))
    return rows.select("field", F.transform(fixed, lambda r: r["correct_value"]).alias("examples"), F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n").alias("notes"))
