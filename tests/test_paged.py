import os

import pytest
from pyspark.sql import functions as F

from gleanwork.sources import paged

TEXTS = [("b-2", "one\n\ntwo", [(1, 0, 3), (2, 5, 8)]), ("a-1", "", None), ("é", "Grüße 🙂 " * 50, [(7, 0, 450)])]


def put(spark, path, rows):
    paged.write(spark.createDataFrame(rows, f"stem string, text string, pages {paged.PAGE_MAP}"), str(path))


def rows_of(df):
    return sorted((r.stem, r.text, r.pages and [tuple(p) for p in r.pages]) for r in df.collect())


def test_what_is_written_is_read(spark, tmp_path):
    put(spark, tmp_path, TEXTS)
    assert rows_of(paged.read(spark, str(tmp_path))) == sorted(TEXTS)
    assert rows_of(paged.read(spark, f"file://{tmp_path}")) == rows_of(paged.read(spark, f"file:{tmp_path}")) == sorted(TEXTS)
    assert sorted(os.listdir(tmp_path)) == sorted(f"{s}.md" for s, _, _ in TEXTS)  # nothing of the writing is left
    put(spark, tmp_path, [("a-1", "new", None)])  # a name once more replaces its file
    assert ("a-1", "new", None) in rows_of(paged.read(spark, str(tmp_path)))
    sizes = {r.stem: r.bytes for r in paged.read(spark, str(tmp_path)).collect()}
    assert sizes == {s: os.path.getsize(tmp_path / f"{s}.md") for s in sizes}


def test_awkward_files(spark, tmp_path):
    (tmp_path / "raw.md").write_bytes(b"ok \xff bad")
    (tmp_path / "open.md").write_text("<!-- PAGE_MAP: [1, 2")
    (tmp_path / "wrong.md").write_text('<!-- PAGE_MAP: {"a":1} -->\n\nx')
    (tmp_path / ".half.md").write_text("not yet")
    (tmp_path / "other.txt").write_text("other")
    (tmp_path / "sub.md").mkdir()
    got = rows_of(paged.read(spark, str(tmp_path)))
    assert got == [("open", "<!-- PAGE_MAP: [1, 2", None), ("raw", "ok � bad", None), ("wrong", '<!-- PAGE_MAP: {"a":1} -->\n\nx', None)]
    assert rows_of(paged.read(spark, str(tmp_path), glob="*.txt")) == [("other", "other", None)]
    assert paged.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="only appends"):
        paged.read(spark, str(tmp_path)).write.format(paged.NAME).mode("overwrite").save(str(tmp_path / "new"))
    with pytest.raises(Exception, match="no name for a file"):
        put(spark, tmp_path / "new", [("../up", "x", None)])


def test_files_are_dealt_by_size_and_left_out_by_name(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"doc-{i:03d}.md").write_text("x" * (1 + i * 7 % 400))
    every = paged.read(spark, str(tmp_path), split_bytes=4000)
    held = every.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("bytes").alias("n")).collect()
    assert len(held) > 10 and max(r.n for r in held) <= 4000
    stems = [f"doc-{i:03d}" for i in range(300)]
    cases = [
        (F.col("stem") == "doc-007", lambda s: s == "doc-007"), (F.col("stem").isin("doc-001", "doc-299", "no"), lambda s: s in ("doc-001", "doc-299")),
        (F.col("stem").contains("-1"), lambda s: "-1" in s), (F.col("stem").startswith("doc-2") & F.col("stem").endswith("7"), lambda s: s[:5] == "doc-2" and s[-1] == "7"),
        ((F.col("stem") > "doc-290") & (F.col("bytes") > 100), lambda s: s > "doc-290" and 1 + int(s[-3:]) * 7 % 400 > 100),
    ]
    for condition, holds in cases:
        assert sorted(r.stem for r in every.filter(condition).collect()) == [s for s in stems if holds(s)]
    plan = every.filter(F.col("stem").contains("-1"))._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan.split("BatchScan")[0]  # the listing has dealt with it


def test_stream_reads_each_file_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def run():
        stream = paged.watch(spark, str(source), settle_seconds=0).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        stream.awaitTermination(60)

    def seen():
        return sorted((r.stem, r.text) for r in spark.read.parquet(out).collect())

    put(spark, source, TEXTS)
    run()
    first = sorted((s, t) for s, t, _ in TEXTS)
    assert seen() == first
    run()  # nothing new
    assert seen() == first
    put(spark, source, [("c", "later", None), ("a-1", "changed", None)])
    run()
    assert seen() == sorted([*first, ("c", "later"), ("a-1", "changed")])


def test_pages_by_map_or_by_marks(spark, tmp_path):
    mark = lambda n: f"{{{n}}}" + "-" * 48
    marked = f"{mark(0)}\n\nfirst page\n\n{mark(1)}\n\nsecond"
    put(spark, tmp_path, [("map", "one\n\ntwo", [(4, 0, 3), (5, 5, 8)]), ("marks", marked, None), ("plain", "all of it", None)])
    got = sorted((r.stem, r.page, r.text) for r in paged.cut_pages(paged.read(spark, str(tmp_path))).collect())
    assert got == [("map", 4, "one"), ("map", 5, "two"), ("marks", 1, "first page"), ("marks", 2, "second"), ("plain", 1, "all of it")]
