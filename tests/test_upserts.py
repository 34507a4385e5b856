"""Stored tables: what is written, and that buckets without changes keep their files."""

import os
import random

from pyspark.sql import functions as F

from gleanwork.sources import upserts

ROW = "k1 int, k2 string, a string, b double"


def files(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def at(day):
    return F.lit(f"2024-01-{day:02}").cast("timestamp")


def contents(spark, path):
    return {(r.k1, r.k2): (r.a, r.b, r.updated_at.day) for r in upserts.read(spark, path).collect()}


def test_upserts_equal_a_dictionary_and_leave_other_buckets(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "t")
    rows = [(i, "x" if i % 2 else "y", str(i % 7), None if i % 5 == 0 else i / 4) for i in range(300)]
    upserts.create(spark.createDataFrame(rows, ROW), ["k1", "k2"], path, at(1), 16)
    want = {(a, b): (c, d, 1) for a, b, c, d in rows}
    for day in (2, 3, 4):
        before = files(path)
        some = [(*rng.choice(rows)[:2], rng.choice(["0", "1", None]), rng.random()) for _ in range(3)] + [(1000 + day, "new", "n", None)]
        some += [(*some[0][:2], "later", None)]  # of one key the first in the order counts
        some = {(r[0], r[1], r[2]): r for r in some}.values()
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(some)], ROW + ", i int")
        n = upserts.upsert(spark, path, df.select("k1", "k2", "a", "i").withColumn("b", F.col("i") / 2).drop("i"), ["k1", "k2"], [F.asc("b")], at(day), 16)
        first = {}
        for i, r in enumerate(some):
            first.setdefault(r[:2], (r[2], i / 2))
        for k, v in first.items():
            if k not in want or want[k][:2] != v:
                want[k] = (*v, day)
        assert contents(spark, path) == want
        after = files(path)
        changed = {d for d in after if after[d] != before.get(d)}
        assert len(changed) == n and n < 16
        again = upserts.upsert(spark, path, df.select("k1", "k2", "a", (F.col("i") / 2).alias("b")), ["k1", "k2"], [F.asc("b")], at(day + 1), 16)
        assert again == 0 and files(path) == after


def test_missing_columns_updates_and_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, "k", "a", float(i)) for i in range(40)]
    upserts.create(spark.createDataFrame(rows, ROW), ["k1", "k2"], path, at(1), 8)
    upserts.upsert(spark, path, spark.createDataFrame([(1, "k", "z"), (99, "k", "z")], "k1 int, k2 string, a string"), ["k1", "k2"], [F.asc("a")], at(2), 8)
    got = contents(spark, path)
    assert got[1, "k"] == ("z", 1.0, 2) and got[99, "k"] == ("z", None, 2) and got[2, "k"] == ("a", 2.0, 1)
    assert upserts.update(spark, path, F.col("k1") == 3, at(3), a=F.lit("a")) == 0  # it has that value
    assert upserts.update(spark, path, F.col("k1") == 3, at(3), a=F.lit("u")) == 1 and contents(spark, path)[3, "k"] == ("u", 3.0, 3)
    assert upserts.delete(spark, path, F.col("b") > 100) == 0
    before = files(path)
    assert upserts.delete(spark, path, F.col("k1") == 5) == 1 and (5, "k") not in contents(spark, path)
    assert sum(files(path).get(d) != before[d] for d in before) == 1
    upserts.delete(spark, path, F.col("b").isNotNull())
    assert contents(spark, path) == {(99, "k"): ("z", None, 2)}
    assert upserts.upsert(spark, path, spark.createDataFrame([], ROW), ["k1", "k2"], [F.asc("b")], at(4), 8) == 0
