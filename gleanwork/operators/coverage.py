"""Coverage, progress, assignment and cost summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import norm, shapes
from . import tables


def form_coverage(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per form: documents, extracted ones, failed ones that no run extracted, those never run, and the last run."""
    done = extracted.groupBy("form_id", "document_id").agg(F.max("created_at").alias("run"))
    joined = documents.select("form_id", "document_id", "processing_status").join(done, ["form_id", "document_id"], "left")
    total, ok = F.count("*"), F.count("run")
    failed = F.count_if(F.col("run").isNull() & (F.col("processing_status") == "failed"))
    return joined.groupBy("form_id").agg(total.alias("total_documents"), ok.alias("extracted"), failed.alias("failed"), F.greatest(F.lit(0), total - ok - failed).alias("not_run"), F.max("run").alias("last_run"))


def qa_dashboard(reviews: DataFrame, by: str) -> DataFrame:
    """Reviewed, flagged and passed counts with the pass rate; `flag` says whether a review was flagged."""
    n, flagged = F.count("*"), F.count_if("flag")
    return reviews.groupBy(by).agg(n.alias("reviewed"), flagged.alias("flagged"), (n - flagged).alias("passed"), norm.half_even((n - flagged) * 100.0 / n, 2).alias("pass_rate"))


def auto_assign(documents: DataFrame, users: dict[str, int]) -> DataFrame:
    """Each document under each role, with the role's user: a literal of a few rows, exploded."""
    roles = F.array(*[F.struct(F.lit(r).alias("reviewer_role"), F.lit(u).alias("user_id")) for r, u in users.items()])
    return documents.withColumn("r", F.explode(roles)).select("document_id", "r.reviewer_role", "r.user_id")


def complete(have: DataFrame, need: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that have every needed item: relational division by counting."""
    n = need.agg(F.count("*").alias("n"))
    counted = have.join(need, item, "left_semi").groupBy(key).agg(F.count_distinct(item).alias("c"))
    return counted.join(F.broadcast(n), F.col("c") == F.col("n"), "left_semi").select(key)  # one row


def call_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("total_cost"), F.round(F.avg("cost"), 6).alias("average_cost"),
        F.sum("total_tokens").alias("tokens"), F.min("ts").alias("first_call"), F.max("ts").alias("last_call"),
    )


def call_summary(calls: DataFrame) -> DataFrame:
    """One row: calls, models, cost in all and on average (0 for calls without prompt tokens), tokens, share of cache hits, first and last call."""
    cost = F.when(F.col("prompt_tokens") > 0, F.col("cost")).otherwise(F.lit(0.0))
    hits = F.count_if("cache_hit") / F.count("*")
    return calls.agg(
        F.count("*").alias("calls"), F.count_distinct("model").alias("models"), F.round(F.sum(cost), 4).alias("total_cost"), F.round(F.avg(cost), 6).alias("average_cost"),
        F.sum("prompt_tokens").alias("tokens"), F.round(hits, 6).alias("hit_rate"), F.min("ts").alias("first_call"), F.max("ts").alias("last_call"),
    )


def top_models(calls: DataFrame, n: int = 5) -> DataFrame:
    return calls.groupBy("model").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "model").limit(n)


def page_costs(jobs: DataFrame, pages: str, by: list[str], order: list, rate: float = 3.0, threshold: float = 500.0, block=None) -> DataFrame:
    """`jobs` with cost (a rate for a thousand pages), spent (in order, so far) and whether that is over the threshold."""
    costed = jobs.withColumn("cost", F.col(pages) / 1000.0 * rate)
    return tables.running_total(costed, "cost", by, order, "spent", block).withColumn("over", F.col("spent") > threshold)


def run_summary(runs: DataFrame, ok: str, start: str, end: str) -> DataFrame:
    """One row: runs, successes, and the wall time from the first start to the last end in seconds, two places."""
    return runs.agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), shapes.seconds(F.min(start), F.max(end)).alias("wall_s"))
