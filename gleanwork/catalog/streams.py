"""Messages, calls and runs over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import coverage
from ..registry import query
from ..streaming import live, messages


@query("""SELECT activity_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY activity_id DESC) AS back FROM fx_activities WHERE created_at > (SELECT max(created_at) FROM fx_activities) - INTERVAL 86400 SECOND) WHERE back <= 2""")
def replay_alive(spark, sf_dir):
    acts = view(spark, sf_dir, "fx_activities")
    now = F.lit(acts.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    return messages.replay(messages.alive(acts, "created_at", now, 86_400), "user_id", "activity_id", 2).select("activity_id", "user_id")


@query("""SELECT user_id, activity_id, CAST(floor((epoch_us(created_at) - before) / 1e6 / 30) AS BIGINT) AS beats FROM (SELECT *, lag(epoch_us(created_at)) OVER (PARTITION BY user_id ORDER BY created_at, activity_id) AS before FROM fx_activities) WHERE (epoch_us(created_at) - before) / 1e6 >= 30""")
def heartbeats(spark, sf_dir):
    return messages.heartbeats(view(spark, sf_dir, "fx_activities"), "user_id", "created_at", "activity_id")


@query("""SELECT s_suppkey AS model, CAST(row_number() OVER (ORDER BY s_suppkey % 3, s_acctbal, s_suppkey) AS INT) AS place FROM supplier WHERE s_suppkey % 3 < 2 OR s_suppkey % 2 = 0""")
def model_candidates(spark, sf_dir):
    now, old = F.expr("timestamp'2024-01-01 00:01:00'"), F.when(F.col("s_suppkey") % 2 == 0, F.expr("timestamp'2024-01-01 00:00:00'")).otherwise(F.expr("timestamp'2024-01-01 00:00:30'"))
    state = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'HALF_OPEN' ELSE 'OPEN' END")
    rank = F.struct("s_acctbal", "s_suppkey")
    return messages.candidates(view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"), rank.alias("rank"), state.alias("state"), old.alias("opened_at")), now)


@query("""SELECT count(*)::BIGINT AS calls, count(DISTINCT model)::BIGINT AS models, round(sum(CASE WHEN total_tokens > 0 THEN cost ELSE 0 END), 4) AS total_cost, round(avg(CASE WHEN total_tokens > 0 THEN cost ELSE 0 END), 6) AS average_cost, sum(total_tokens)::BIGINT AS tokens,
round(count(*) FILTER (WHERE call_id % 3 = 0) / count(*), 6) AS hit_rate, min(ts) AS first_call, max(ts) AS last_call FROM fx_call_log""")
def call_summary(spark, sf_dir):
    calls = view(spark, sf_dir, "fx_call_log").withColumn("prompt_tokens", F.col("total_tokens").cast("long")).withColumn("cache_hit", F.col("call_id") % 3 == 0)
    return coverage.call_summary(calls)


@query("SELECT model, count(*)::BIGINT AS calls FROM fx_call_log GROUP BY 1 ORDER BY calls DESC, model LIMIT 3")
def top_models(spark, sf_dir):
    return coverage.top_models(view(spark, sf_dir, "fx_call_log"), 3)


@query("""SELECT call_id, total_tokens / 1000.0::DOUBLE * 3.0::DOUBLE AS cost, round(spent, 6) AS spent, spent > 5 AS over FROM (SELECT *, sum(total_tokens) OVER (PARTITION BY model ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) * 0.003::DOUBLE AS spent FROM fx_call_log)""")
def page_costs(spark, sf_dir):
    jobs = view(spark, sf_dir, "fx_call_log").select("call_id", "model", "ts", F.col("total_tokens").cast("double").alias("pages"))
    out = coverage.page_costs(jobs, "pages", ["model"], [F.asc("ts"), F.asc("call_id")], threshold=5.0, block=F.date_trunc("hour", "ts"))
    return out.select("call_id", "cost", F.round("spent", 6).alias("spent"), "over")


@query("SELECT count(*)::BIGINT AS runs, count(*) FILTER (WHERE NOT rate_limited)::BIGINT AS successes, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS wall_s FROM fx_call_log")
def run_summary(spark, sf_dir):
    return coverage.run_summary(view(spark, sf_dir, "fx_call_log").withColumn("ok", ~F.col("rate_limited")), "ok", "ts", "ts")


@query("""WITH m AS (SELECT *, (epoch_us(ts) // 1000) AS t_ms, min((epoch_us(ts) // 1000)) OVER (PARTITION BY job_id) + 3900000 AS due, min(CASE WHEN type <> 'log' THEN (epoch_us(ts) // 1000) END) OVER (PARTITION BY job_id) AS done FROM fx_job_log),
r AS (SELECT job_id, seq, t_ms, least(due, coalesce(done, due)) AS ends FROM m WHERE t_ms < least(due, coalesce(done, due)))
SELECT * FROM (SELECT job_id, seq, (least(coalesce(lead(t_ms) OVER (PARTITION BY job_id ORDER BY t_ms, seq), ends), (SELECT max((epoch_us(ts) // 1000)) FROM fx_job_log)) - t_ms) // 30000 AS beats FROM r) WHERE beats > 0""")
def job_silences(spark, sf_dir):
    """Heartbeats in each silence of a job, until it ends or counts as stuck."""
    log = view(spark, sf_dir, "fx_job_log")
    return live.silences(log, F.lit(log.agg(F.max("ts")).first()[0]))


@query("""SELECT job_id, make_timestamp((due * 1000)::BIGINT) AS failed_at FROM (SELECT job_id, min((epoch_us(ts) // 1000)) + 3900000 AS due, min(CASE WHEN type <> 'log' THEN (epoch_us(ts) // 1000) END) AS done FROM fx_job_log GROUP BY 1)
WHERE coalesce(done >= due, true) AND due <= (SELECT max((epoch_us(ts) // 1000)) FROM fx_job_log)""")
def job_timeouts(spark, sf_dir):
    """Jobs that did not end in time, and when they failed for that."""
    log = view(spark, sf_dir, "fx_job_log")
    return live.deadlines(log, F.lit(log.agg(F.max("ts")).first()[0])).withColumn("failed_at", F.col("failed_at").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT user_id, event_id AS seq, (epoch_us(ts) // 1000) AS t_ms FROM events WHERE event_type <> 'signup'),
j AS (SELECT user_id, props AS subscriber, min((epoch_us(ts) // 1000)) AS joined FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT user_id, subscriber, seq, 'live' AS how FROM m JOIN j USING (user_id) WHERE t_ms > joined UNION ALL
SELECT user_id, subscriber, seq, 'replay' FROM (SELECT *, row_number() OVER (PARTITION BY user_id, subscriber ORDER BY t_ms DESC, seq DESC) AS back FROM m JOIN j USING (user_id) WHERE t_ms <= joined AND t_ms > joined - 432000000) WHERE back <= 5""")
def late_joiners(spark, sf_dir):
    """What each subscriber of a user's events sees: up to 5 of the last five days, then every later one."""
    events = view(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), "event_type", "props")
    joins = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("props").alias("subscriber"))
    return live.joined_views(events.filter("event_type <> 'signup'"), joins, "user_id", n=5, alive_s=432_000)


@query("""WITH a AS (SELECT event_id, epoch_us(ts) AS us, (event_id + CAST(floor(value * 20) AS BIGINT)) // 250 AS batch FROM events),
b AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000000 AS mark FROM a GROUP BY batch)
SELECT event_id, a.batch, coalesce(us < mark, false) AS late FROM a JOIN b USING (batch)""")
def late_events(spark, sf_dir):
    """Events that arrive in batches, some of them a while after they happened, with a watermark a day behind."""
    arrived = view(spark, sf_dir, "events").withColumn("batch", F.expr("(event_id + cast(floor(value * 20) as bigint)) div 250"))
    return live.late_rows(arrived, "ts", "batch", 86_400).select("event_id", "batch", "late")
