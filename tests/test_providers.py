"""Providers, retries, reports of a run, registered metrics."""

import time

from pyspark.sql import functions as F

from gleanwork.plans import providers


class Counting:
    def __init__(self, made):
        made.add(1)
        self.calls = 0

    def __call__(self, texts, known, attempt):
        self.calls += 1
        if any("boom" in t for t in texts):
            raise RuntimeError("no answer")
        return [{"n": t[attempt] if attempt < len(t) else "", "seen": ",".join(sorted(k)), "calls": str(self.calls)} if t else {} for t, k in zip(texts, known)]


def test_attempts_end_with_an_answer_and_the_best_stays():
    answers = {"a": [{"x": "NR"}, {"x": ""}, {"x": "NR"}], "b": [{"x": "", "y": "1"}], "c": [{"x": ""}, {"x": "NR", "y": "n/r"}, {"x": "{}"}], "d": [{"x": ""}, {"x": "v"}]}
    got = providers.asked(lambda texts, known, attempt: [answers[t][attempt] for t in texts], list("abcd"), [{}] * 4)
    assert got == [({"x": "NR"}, 3), ({"x": "", "y": "1"}, 1), ({"x": "NR", "y": "n/r"}, 3), ({"x": "v"}, 2)]
    assert providers.asked(lambda *_: 1 / 0, ["a"], [{}]) == [(None, 3)]


def test_one_provider_a_partition_and_stages_that_know(spark):
    made = spark.sparkContext.accumulator(0)
    rows = [(i, "x") for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stages = [{"providers": {"first": lambda: Counting(made)}}, {"providers": {"one": lambda: providers.Patterns({"z": "(x)"}), "two": lambda: Counting(made)}, "requires": ["n"]}]
    out, seen = providers.observed(providers.run_stages(df, stages, batch=4))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 42 and made.value == 3 * 2  # three partitions, two counted providers
    assert got[0].failed == []
    assert got[0]["values"] | {"calls": "0"} == {"n": "x", "seen": "n", "calls": "0", "z": "x"}
    assert got[40].attempts == {"first": 3, "one": 3, "two": 3} and got[40]["values"] == {"z": "NR"} and got[40].failed == []
    assert seen.get == {"papers": 42, "calls": 40 * 3 + 2 * 9, "retried": 2, "failed": 0}
    failed = providers.run_stages(df.limit(1).withColumn("text", F.lit("boom")), stages[:1]).first()
    assert failed.failed == ["first"] and failed.attempts == {"first": 3} and failed["values"] == {}


def test_finished_papers_and_times_are_told(spark, tmp_path):
    spark.range(5).withColumn("text", F.lit("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    done, times = [], []
    log = providers.RunLog(times.append)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
        q = providers.papers_done(stream, lambda rows, batch: done.extend((batch, r.id) for r in rows.collect()), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
        until = time.time() + 30
        while not times and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert sorted(done) == [(0, i) for i in range(5)]
    assert times[0][1:3] == (0, 5) and times[0][3] >= 0


def test_a_registered_metric(spark):
    providers.register_metric(spark, "share_equal", lambda a, b: (a == b).mean())
    spark.createDataFrame([("g", "x", "x"), ("g", "x", "y"), ("h", "z", "z")], "k string, a string, b string").createOrReplaceTempView("metric_rows")
    assert {tuple(r) for r in spark.sql("SELECT k, share_equal(a, b) FROM metric_rows GROUP BY k").collect()} == {("g", 0.5), ("h", 1.0)}
