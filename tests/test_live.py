"""Timers, replay and late rows as streams, against a plain reading of the same log."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleanwork.streaming import live


def stamp(ms):
    return F.timestamp_millis(ms)


def arrivals(spark, tmp_path, rows, schema, sizes, name="in"):
    """A stream that gets the rows in files of the given sizes, one file a batch."""
    folder, at = tmp_path / name, 0
    for i, n in enumerate(sizes):
        part = spark.createDataFrame(rows[at : at + n], schema).withColumn("ts", stamp("ms")).drop("ms")
        part.coalesce(1).write.mode("append").parquet(str(folder))
        at += n
        time.sleep(0.02)  # files are taken by their time
    assert at >= len(rows)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collected(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def plain_watch(log, end, silence, stuck):
    out = []
    for job in {r[0] for r in log}:
        mine = sorted((ms, seq, kind) for j, ms, seq, kind in log if j == job)
        closed = min([mine[0][0] + stuck, *(ms for ms, _, kind in mine if kind in live.TERMINAL)])
        done = any(ms == closed and kind in live.TERMINAL for ms, _, kind in mine) and closed < mine[0][0] + stuck
        times = [ms for ms, *_ in mine if ms < closed]
        for a, b in zip(times, [*times[1:], closed]):
            out += [(job, "heartbeat", t) for t in range(a + silence, min(b, end) + 1, silence)]
        if not done and closed <= end:
            out.append((job, "stuck", closed))
    return sorted(out)


LOG = "job_id string, ms long, seq long, type string"


def job_log(seed):
    rng, log = random.Random(seed), []
    for j in range(5):
        ms = rng.randrange(20_000)
        for seq in range(rng.randrange(1, 9)):
            log.append((f"j{j}", ms, seq, rng.choice(["log", "progress", "log", "log", "log", "complete"])))
            ms += rng.choice([0, 1000, 29_999, 30_000, 75_000])
    return sorted(log, key=lambda r: (r[1], r[0], r[2]))


def test_beats_and_deadlines_equal_a_plain_replay(spark, tmp_path):
    log = job_log(1)
    end = max(r[1] for r in log) + 400_000
    rows = [*log, ("last", end, 0, "complete"), ("last", end, 1, "log"), ("last", end, 2, "log")]  # moves the watermark
    rng = random.Random(2)
    shuffled = sorted(rows[:-3], key=lambda r: r[1] + rng.randrange(40_000)) + rows[-3:]  # out of order, within the delay
    stream = arrivals(spark, tmp_path, shuffled, LOG, [7, 1, 9, len(rows) - 19, 1, 1])
    got = collected(live.watch_stream(stream, delay="60 seconds", stuck_s=150), tmp_path, "watched")
    got = sorted((r.job_id, r.kind, int(r.at.timestamp() * 1000)) for r in got.collect() if r.job_id != "last")
    want = plain_watch(log, end - 60_000, 30_000, 150_000)
    assert got == want and {k for _, k, _ in got} == {"heartbeat", "stuck"}


def test_batch_watch_equals_a_plain_replay(spark):
    log = job_log(4) + [("z", 10**6, 0, "log")]
    end = max(r[1] for r in log)
    df = spark.createDataFrame(log, LOG).withColumn("ts", stamp("ms")).drop("ms")
    want = plain_watch(log, end, 30_000, 150_000)
    beats = live.silences(df, stamp(F.lit(end)), stuck_s=150).groupBy("job_id").agg(F.sum("beats").alias("n")).collect()
    assert {r.job_id: r.n for r in beats} == {j: n for j in {r[0] for r in log} if (n := sum(k == "heartbeat" and i == j for i, k, _ in want))}
    failed = {(r.job_id, int(r.failed_at.timestamp() * 1000)) for r in live.deadlines(df, stamp(F.lit(end)), stuck_s=150).collect()}
    assert failed == {(j, t) for j, k, t in want if k == "stuck"}


def test_timers_fire_by_the_clock_without_further_messages(spark, tmp_path):
    stream = arrivals(spark, tmp_path, [("a", 0, 0, "log"), ("b", 0, 0, "complete")], LOG, [2])
    out = live.watch_stream(stream, delay=None, silence_s=2, stuck_s=5)
    q = out.writeStream.format("memory").queryName("clocked").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 120
    while time.time() < until and not spark.table("clocked").filter("kind = 'stuck'").count():
        time.sleep(0.5)
    q.stop()
    got = [(r.job_id, r.kind) for r in spark.table("clocked").orderBy("at", "kind").collect()]
    assert got == [("a", "heartbeat"), ("a", "heartbeat"), ("a", "stuck")]


FEED = "job_id string, ms long, seq long, subscriber string, message string"


def plain_views(feed, n, alive):
    out = []
    for job in {r[0] for r in feed}:
        sent = sorted((ms, seq) for j, ms, seq, who, _ in feed if j == job and who is None)
        joined = {}
        for j, ms, _, who, _ in sorted(feed, key=lambda r: r[1]):
            if j == job and who is not None:
                joined.setdefault(who, ms)
        for who, at in joined.items():
            old = [s for ms, s in sent if at - alive < ms <= at][-n:]
            out.append((job, who, [(s, "replay") for s in old] + [(s, "live") for ms, s in sent if ms > at]))
    return sorted(out)


@pytest.mark.parametrize("ordered", [True, False])
def test_joiners_at_any_point_see_every_message_once(spark, tmp_path, ordered):
    rng = random.Random(7)
    feed = [(f"j{i % 3}", 10**6 + 1000 * i, i, None, f"m{i}") for i in range(60)]
    feed += [(f"j{rng.randrange(3)}", 10**6 + rng.randrange(60) * 1000 + rng.choice([0, 500]), None, f"s{k % 9}", None) for k in range(12)]
    feed.sort(key=lambda r: r[1] if ordered else r[1] + rng.randrange(15_000))
    want = plain_views(feed, 4, 9_000)
    rows = [*feed, ("last", 10**7, 0, None, "x"), ("last", 10**7, 1, None, "x"), ("last", 10**7, 2, None, "x")]
    stream = arrivals(spark, tmp_path, rows, FEED, [20, 3, 30, len(rows) - 55, 1, 1])
    got = collected(live.replay_stream(stream, delay="20 seconds", n=4, alive_s=9), tmp_path, f"replayed_{ordered}").collect()
    seen = {}
    for r in got:
        seen.setdefault((r.job_id, r.subscriber), []).append((r.seq, r.how))
    assert sorted((*k, v) for k, v in seen.items()) == [w for w in want if w[2]]
    df = spark.createDataFrame(feed, FEED).withColumn("ts", stamp("ms"))
    batch = live.joined_views(df.filter("subscriber is null"), df.filter("subscriber is not null"), n=4, alive_s=9).collect()
    assert sorted((r.job_id, r.subscriber, r.seq, r.how) for r in batch) == sorted((j, w, s, h) for j, w, rows in want for s, h in rows)


def test_each_row_is_on_time_or_late_once(spark, tmp_path):
    rng = random.Random(5)
    rows = [("j", int(1000 * i - rng.choice([0, 0, 0, 4000, 30_000, 80_000])), i, "log") for i in range(90)]
    sizes = [30, 1, 29, 30]
    stream = arrivals(spark, tmp_path, rows, LOG, sizes)
    for _ in range(2):  # the second run finds nothing new
        q = live.split_late(stream, "ts", 10, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    newest, want, at = None, {}, 0
    for n in sizes:
        part = rows[at : at + n]
        want |= {r[2]: newest is not None and r[1] < newest - 10_000 for r in part}
        newest, at = max([r[1] for r in part] + ([newest] if newest is not None else [])), at + n
    got = {name: sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out" / name)).collect()) for name in ("on_time", "late")}
    assert got == {"late": sorted(i for i, late in want.items() if late), "on_time": sorted(i for i, late in want.items() if not late)} and got["late"]
    counts = live.marks(spark, str(tmp_path / "out")).agg(F.sum("on_time"), F.sum("late"), F.count("*")).first()
    assert tuple(counts) == (len(got["on_time"]), len(got["late"]), 4)
    numbered = spark.createDataFrame([(*r, b) for b, (lo, hi) in enumerate([(0, 30), (30, 31), (31, 60), (60, 90)]) for r in rows[lo:hi]], LOG + ", batch int").withColumn("ts", stamp("ms"))
    assert {r.seq: r.late for r in live.late_rows(numbered, "ts", "batch", 10).collect()} == want
