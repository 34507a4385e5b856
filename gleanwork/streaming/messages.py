"""Job messages and model calls: replay, progress, stuck jobs, circuit breaker; batch and stream alike."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import numbered

#: Circuit breaker: failures in a row that open it, seconds until it is tried again, successes that close it. Fixed values.
FAILURES, COOL_S, SUCCESSES = 3, 60, 2
#: Seconds after which a running job counts as stuck: its limit and the sweep's interval. Fixed values.
STUCK_S = 3600 + 300


#: Messages that a replay holds, and seconds that they live; seconds of silence after which a heartbeat goes out. Fixed values.
REPLAYED, ALIVE_S, SILENCE_S = 100, 3600, 30


def replay(messages: DataFrame, key: str, order: str, n: int = REPLAYED) -> DataFrame:
    """The last n messages of each key."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("_back", back).filter(F.col("_back") <= n).drop("_back")


def alive(messages: DataFrame, ts: str, now: Column, seconds: int = ALIVE_S) -> DataFrame:
    """Messages that a replay still holds at `now`."""
    return messages.filter(F.col(ts) > now - F.expr(f"interval {seconds} seconds"))


def heartbeats(messages: DataFrame, key: str, ts: str, order: str, every: int = SILENCE_S) -> DataFrame:
    """(key, order, beats): how many heartbeats went out in the silence before each message; messages without any are left out."""
    before = F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(key).orderBy(ts, order))
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - before) / 1e6
    return messages.select(key, order, F.floor(gap / every).cast("long").alias("beats")).filter("beats > 0")


def publish(messages: DataFrame, path: str, checkpoint: str):
    """Append a stream of job messages, as JSON, to a folder that a subscriber reads; started, to be stopped by the caller."""
    return messages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def progress_steps(items: DataFrame, by: str, order: str, block: Column | None = None) -> DataFrame:
    """(by, order, pct) of the items at which the percent done enters another ten; `block` as in `running_total`."""
    ranked = numbered(items.select(by, order), [by], [F.asc(order)], "done", block)
    ranked = ranked.join(items.groupBy(by).agg(F.count("*").alias("n")), by)
    pct, before = F.floor(F.col("done") * 100.0 / F.col("n")), F.floor((F.col("done") - 1) * 100.0 / F.col("n"))
    return ranked.filter(F.floor(pct / 10) != F.floor(before / 10)).select(by, order, pct.alias("pct"))


def stuck(jobs: DataFrame, as_of: DataFrame) -> DataFrame:
    """Pending or running jobs older than STUCK_S at the one instant that `as_of` holds."""
    waiting = jobs.filter(F.col("status").isin("pending", "processing"))
    return waiting.join(F.broadcast(as_of), F.col("created_at") < F.col("as_of") - F.expr(f"interval {STUCK_S} seconds"), "left_semi")  # one row


#: What a job of each type works on; its id stands in the job's input under {target}_id. Fixed values.
TARGETS = {"pdf_processing": "document", "form_generation": "form", "extraction": "extraction"}
TIMED_OUT = "Timed out: job exceeded maximum processing time"


def fail_stuck(jobs: DataFrame, as_of: DataFrame) -> DataFrame:
    """(job_id, status, progress, error_message, target, target_id): stuck jobs as failed ones, and what each worked on; null if its input names none."""
    target = F.coalesce(*[F.when(F.col("job_type") == kind, F.lit(name)) for kind, name in TARGETS.items()])
    ids = F.coalesce(*[F.when(F.col("job_type") == kind, F.get_json_object("input_data", f"$.{name}_id")) for kind, name in TARGETS.items()])
    return stuck(jobs, as_of).select("job_id", F.lit("failed").alias("status"), F.lit(0).alias("progress"), F.lit(TIMED_OUT).alias("error_message"), target.alias("target"), ids.alias("target_id"))


def mark_targets(rows: DataFrame, failed: DataFrame, target: str, key: str, status: str, error: str | None = None) -> DataFrame:
    """`rows` of one target (documents, say) with the status of those that a failed job worked on set to failed, and the error where there is a column for it."""
    hit = failed.filter((F.col("target") == target) & F.col("target_id").isNotNull()).groupBy("target_id").agg(F.first("error_message").alias("_error"))
    out = rows.join(hit, rows[key].cast("string") == F.col("target_id"), "left")
    out = out.withColumn(status, F.when(F.col("_error").isNotNull(), F.lit("failed")).otherwise(F.col(status)))
    out = out.withColumn(error, F.coalesce("_error", F.col(error))) if error else out
    return out.drop("_error", "target_id")


def tumbling(events: DataFrame, ts: str, width: str, *by: str) -> DataFrame:
    """Counts of tumbling windows; on a stream, give it a watermark first."""
    return events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def step(state: tuple[str, int, int, int], at: int, limited: bool) -> tuple[str, int, int, int]:
    """The breaker (name, failures, successes, opened) after one call; times in microseconds."""
    name, failures, successes, opened = state
    if name == "OPEN" and at - opened >= COOL_S * 1_000_000:
        name, successes = "HALF_OPEN", 0
    if limited:
        failures += 1
        if name == "HALF_OPEN" or failures >= FAILURES and name == "CLOSED":
            return "OPEN", failures, 0, at
        return name, failures, 0, opened
    if name == "HALF_OPEN":
        successes += 1
        return ("CLOSED", 0, 0, opened) if successes >= SUCCESSES else (name, failures, successes, opened)
    return name, 0, successes, opened


START = ("CLOSED", 0, 0, 0)


def _micros(rows: pd.DataFrame) -> list[int]:
    return rows["ts"].astype("datetime64[us]").astype("int64").tolist()


def _walk(rows: pd.DataFrame, state):
    out = []
    for at, call, limited in zip(_micros(rows), rows["call_id"], rows["rate_limited"]):
        new = step(state, at, bool(limited))
        if new[0] != state[0]:
            out.append((call, state[0], new[0]))
        state = new
    return state, out


COLUMNS = ["call_id", "before", "after"]
_STATE = "struct<name: string, failures: int, successes: int, opened: bigint>"


def block_exits(times: list[int], limited: list[bool]) -> tuple[list[tuple], list[int], list[tuple]]:
    """What a block of calls does to a breaker, whatever its state before: (exits, until, trials).

    `exits` has the state after the block for each of the closed states with 0, 1, ... failures and the half-open ones
    with 0, 1, ... successes. An open breaker is tried at the first call that comes late enough: `trials` has what
    follows from a trial, `until` the last call time for which that holds. Found from the last call to the first.
    """
    n, cool = len(times), COOL_S * 1_000_000
    closed = [("CLOSED", i, 0, 0) for i in range(FAILURES)]
    half = [("HALF_OPEN", 0, i, 0) for i in range(SUCCESSES)]
    tried = [half[0]] * n
    for i in range(n - 1, -1, -1):
        if limited[i]:
            again = bisect_left(times, times[i] + cool)
            opened = tried[again] if again < n else ("OPEN", 0, 0, times[i])
            closed, half = [*closed[1:], opened], [opened] * SUCCESSES
        else:
            closed, half = [closed[0]] * FAILURES, [*half[1:], closed[0]]
        tried[i] = half[0]
    until: list[int] = []
    trials: list[tuple] = []
    for at, exit_ in zip(times, tried):
        if until and (at == until[-1] or until[-1] >= times[0] + cool):
            continue
        if trials and trials[-1] == exit_:
            until[-1] = at
        else:
            until.append(at)
            trials.append(exit_)
    return closed + half, until, trials


def after_block(state: tuple, exits: list[tuple], until: list[int], trials: list[tuple]) -> tuple:
    name, failures, successes, opened = state
    if name == "OPEN":
        at = bisect_left(until, opened + COOL_S * 1_000_000)
        return trials[at] if at < len(until) else state
    return exits[failures if name == "CLOSED" else FAILURES + successes]


def breaker(calls: DataFrame, block: Column | None = None) -> DataFrame:
    """(model, call_id, before, after): each change of a model's breaker, in call order.

    A state follows from all calls before it, but a block of calls (an hour, or `block`, which must not fall along the
    time) is a small function from the state before to the state after. So blocks become functions in parallel, a
    model's functions are applied in order, and each block is walked from the state it then starts with, in parallel
    again. A task holds one block's calls, or one row for each block of a model.
    """
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp") if block is None else block
    rows = calls.select("model", "ts", "call_id", "rate_limited", hour.alias("block"))
    kind = rows.schema["block"].dataType.simpleString()
    name = rows.schema["model"].dataType.simpleString()

    def ordered(part):
        return part.sort_values(["ts", "call_id"])

    def function(key, part):
        part = ordered(part)
        exits, until, trials = block_exits(_micros(part), part["rate_limited"].tolist())
        return pd.DataFrame([(*key, exits, until, trials)], columns=["model", "block", "exits", "until", "trials"])

    def fold(key, part):
        state, out = START, []
        for r in part.sort_values("block").itertuples(index=False):
            out.append((key[0], r.block, *state))
            states = lambda x: [(s["name"], s["failures"], s["successes"], s["opened"]) for s in x]
            state = after_block(state, states(r.exits), list(r.until), states(r.trials))
        return pd.DataFrame(out, columns=["model", "block", "name", "failures", "successes", "opened"])

    def walk(key, part, entry):
        _, out = _walk(ordered(part), tuple(entry[["name", "failures", "successes", "opened"]].iloc[0]))
        return pd.DataFrame(out, columns=COLUMNS).assign(model=key[0])

    functions = rows.groupBy("model", "block").applyInPandas(function, f"model {name}, block {kind}, exits array<{_STATE}>, until array<bigint>, trials array<{_STATE}>")
    entries = functions.groupBy("model").applyInPandas(fold, f"model {name}, block {kind}, name string, failures int, successes int, opened long")
    walked = rows.groupBy("model", "block").cogroup(entries.groupBy("model", "block")).applyInPandas(walk, f"call_id long, before string, after string, model {name}")
    return walked.select("model", *COLUMNS)


def candidates(states: DataFrame, now: Column) -> DataFrame:
    """(model, place) of the models that a call may try: closed breakers first, half-open ones, then open ones that have cooled; each by `rank`.

    `states` are (model, rank, state, opened_at).
    """
    cooled = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / 1e6 >= COOL_S
    tier = F.when(F.col("state") == "CLOSED", 0).when(F.col("state") == "HALF_OPEN", 1).when((F.col("state") == "OPEN") & cooled, 2)
    order = Window.partitionBy().orderBy("tier", "rank")  # a short list
    return states.withColumn("tier", tier).filter("tier is not null").select("model", F.row_number().over(order).alias("place"))


def breaker_stream(calls: DataFrame) -> DataFrame:
    """The same over a stream of calls, with the breaker kept as state; batches must come in time order."""

    def one(key, frames, state):
        now = state.get if state.exists else START
        rows = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        now, out = _walk(rows, tuple(now))
        state.update(now)
        yield pd.DataFrame(out, columns=COLUMNS).assign(model=key[0])

    return calls.groupBy("model").applyInPandasWithState(one, "call_id long, before string, after string, model string", "name string, failures int, successes int, opened long", "append", "NoTimeout")


def once(messages: DataFrame, ts: str, delay: str, *keys: str) -> DataFrame:
    """A stream without the repeats that a late joiner gets from a replay, within the watermark."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, ts: str, gap: str, *by: str) -> DataFrame:
    """Counts of sessions that end after a gap; on a stream, give it a watermark first."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def sweep(jobs, every: str, act):
    """Start a stream that hands each batch's stuck jobs to `act`, at most every so often."""
    def batch(df, _):
        act(stuck(df, df.sparkSession.range(1).select(F.current_timestamp().alias("as_of"))))

    return jobs.writeStream.trigger(processingTime=every).foreachBatch(batch).start()
