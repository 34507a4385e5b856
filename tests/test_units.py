import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanwork.functions import fields, norm
from gleanwork.operators import linking, tables
from gleanwork.plans import evaluate, planner, review
from gleanwork.streaming import messages


def values(spark, rows, schema="a string, b string"):
    return spark.createDataFrame(rows, schema)


def test_four_agreement_predicates(spark):
    rows = [(None, None), ("0", "0"), ("", ""), (" A", "a"), ("x", None), ("false", "false")]
    got = values(spark, rows).select(*[f(F.col("a"), F.col("b")) for f in (norm.agree, norm.match_truthy, norm.both_agree)]).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, False, True), (True, False, True), (True, True, True), (False, False, False), (True, False, True)]


def test_evaluator_values(spark):
    from gleanwork.catalog.evaluation import FORMS

    got = [r[0] for r in values(spark, [(v, f) for v, f, _ in FORMS]).select(norm.evaluator_value(F.col("a"), F.col("b"))).collect()]
    assert got == [want for *_, want in FORMS]
    assert values(spark, [(None, "x_n")], "a string, b string").select(norm.evaluator_value(F.col("a"), F.col("b"))).first()[0] == ""


def test_names(spark):
    df = values(spark, [("trial-characteristics", "Female (%)"), ("x", "Patient Age (years)")])
    got = df.select(norm.class_name(F.col("a")), norm.field_key(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("TrialCharacteristics", "female_percent"), ("X", "patient_age")]


def test_guarded_casts(spark):
    df = values(spark, [("12d", "2024"), (" 12 ", "2024-01-02"), ("1e3", "2024-1-2"), (None, "2024-01-02T03:04:05Z")])
    got = df.select(norm.to_number(F.col("a")), norm.iso_time(F.col("b")).isNotNull()).collect()
    assert [tuple(r) for r in got] == [(None, False), (12.0, True), (1000.0, False), (None, True)]


def test_kappa_and_icc_goldens(spark):
    pairs = [("k", "y", "y"), ("k", "y", "n"), ("k", "n", "n"), ("k", "n", "n"), ("one", "a", "a"), ("one", "a", "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "document_id int, field string, v1 string, v2 string")
    got = {r.field: r.kappa for r in review.irr(df).collect()}
    assert got["k"] == 0.5 and got["one"] == 1.0
    assert review.icc(spark.createDataFrame([(1, "f", "1", "2"), (2, "f", "2", "3")], df.schema)).first().icc is None


def test_rules(spark):
    df = values(spark, [("ab", None), ("ba", " "), (None, "z"), ("12", "z")])
    regex = [r.a for r in df.filter(review.violates("regex", F.col("a"), pattern="a")).collect()]
    assert regex == ["ba", "12"]
    assert df.filter(review.violates("cross_field", F.col("a"), other=F.col("b"))).count() == 1
    assert df.filter(review.violates("range", F.col("a"), low=13)).count() == 1
    assert df.filter(review.violates("required", F.col("a"))).count() == 1


def test_flat_json(spark):
    texts = ['{"a":{"b":1,"c":2},"d":"x"}', '{"a":{"b":{"c":{"d":{"e":1}}}},"source_location":{"p":{"q":1}},"n":null}', "[1]", "no", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").orderBy("i").select(fields.flat(F.col("j"))).collect()]
    assert got == [{"a.b": "1", "a.c": "2", "d": "x"}, {"a.b.c.d.e": "1", "source_location": '{"p":{"q":1}}', "n": None}, None, None, None]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_assignment_is_optimal(m, n, rnd):
    w = [[rnd.choice([0, 0.2, 0.5, 0.7, 0.9, 1]) for _ in range(n)] for _ in range(m)]
    got = sum(w[i][j] for i, j in evaluate.assign(w))
    k = max(m, n)
    full = [[w[i][j] if i < m and j < n else 0 for j in range(k)] for i in range(k)]
    assert got == pytest.approx(max(sum(full[i][p[i]] for i in range(k)) for p in permutations(range(k))))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_assignment_of_pairs_is_optimal(m, n, rnd):
    pairs = [(3 * i, 7 * j, rnd.random() if rnd.random() < 0.5 else 1 / 3) for i in range(m) for j in range(n) if rnd.random() < 0.6]
    got = evaluate.assign_pairs(pairs)
    w = {(i, j): x for i, j, x in pairs}
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    k = max(m, n)
    best = max(sum(w.get((3 * i, 7 * p[i]), 0) for i in range(k)) for p in permutations(range(k)))
    assert sum(w[x] for x in got) == pytest.approx(best, abs=1e-8)


def test_planner_issues(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "name string")
    needs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "zz")], "name string, needs string")
    assert {tuple(r) for r in planner.issues(nodes, needs).collect()} == {("unknown", "zz"), ("duplicate", "b"), ("cycle", "a"), ("cycle", "b")}


def test_upsert_is_idempotent_and_delete_keeps_unknown(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c")], old.schema)
    once = tables.upsert(old, new, ["k"], [F.desc("v"), F.asc("x")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, new, ["k"], [F.desc("v"), F.asc("x")]).collect())) == [(1, 2, "c"), (2, 1, "b")]
    assert tables.delete(values(spark, [(None, "1"), ("x", "2")]), F.col("a") == "x").count() == 1


def test_blinding(spark):
    results = spark.createDataFrame([(1, "ai", None), (1, "manual", 7), (1, "manual", 8), (2, "manual", 8)], "document_id int, extraction_type string, extracted_by int")
    mine = spark.createDataFrame([(1, 7)], "document_id int, reviewer_user_id int")
    assert tables.unblinded(results, mine, 7, "none").count() == 4
    assert tables.unblinded(results, mine, 7, "full").count() == 3
    assert tables.unblinded(results, mine, 7, "full", hide_ai=True).count() == 2


def test_pages_and_sections(spark):
    from gleanwork.catalog.linking import HEADED

    df = spark.createDataFrame([(i, t) for i, t, _ in HEADED], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(linking.section_before(F.col("t"), F.length("t"))).collect()] == [name for *_, name in HEADED]
    pages = spark.createDataFrame([([(0, 0, 5), (1, 6, 9)], 7), ([(0, 0, 5), (1, 6, 9)], 40)], "p array<struct<page:int,start_char:int,end_char:int>>, o int")
    assert [r[0] for r in pages.select(linking.page_of(F.col("p"), F.col("o"))).collect()] == [1, 1]


def test_breaker_batch_equals_stream(spark, tmp_path):
    calls = [("m", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i, lim) for i, lim in ((0, True), (1, True), (2, True), (30, False), (70, False), (75, False), (80, True))]
    df = spark.createDataFrame(calls, "model string, ts string, call_id long, rate_limited boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    want = [(2, "CLOSED", "OPEN"), (70, "OPEN", "HALF_OPEN"), (75, "HALF_OPEN", "CLOSED")]
    assert sorted((r.call_id, r.before, r.after) for r in messages.breaker(df).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = messages.breaker_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("breaker_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.call_id, r.before, r.after) for r in spark.table("breaker_out").collect()) == want


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_calls_compose(seed):
    """A state taken through the blocks' functions is the state after step() by step(), wherever the blocks are cut."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 900) * 1_000_000 + rng.choice([0, 0, 1]) for _ in range(200))
    bad = [rng.random() < (0.3 + 0.1 * seed) for _ in times]
    state = walked = messages.START
    at, alike = 0, lambda s: (s[0], s[1] if s[0] == "CLOSED" else 0, s[2] if s[0] == "HALF_OPEN" else 0, s[3] if s[0] == "OPEN" else 0)
    while at < len(times):
        end = min(len(times), at + rng.randrange(1, 60))
        for t, b in zip(times[at:end], bad[at:end]):
            walked = messages.step(walked, t, b)
        state = messages.after_block(state, *messages.block_exits(times[at:end], bad[at:end]))
        assert alike(state) == alike(walked)
        at = end


def test_edits_guards_and_gates(spark):
    from gleanwork.operators import edits

    results = spark.createDataFrame([(1, '{"a":"x","b":1.0}'), (2, '{"a":"y"}')], "document_id int, extracted_data string")
    cells = spark.createDataFrame([(1, "a", "new"), (9, "a", "lost")], "document_id int, field string, new_value string")
    out, lost = edits.apply_edits(results, cells)
    assert {r.document_id: r.extracted_data for r in out.collect()} == {1: '{"b":"1.0","a":"new"}', 2: '{"a":"y"}'} and [r.document_id for r in lost.collect()] == [9]
    forms = spark.createDataFrame([(1, "ok", "text", None), (1, "9x", "enum", None), (1, "ok", "blob", None)], "form_id int, field_name string, field_type string, options array<string>")
    assert sorted((r.field_name, r.problem) for r in edits.field_problems(forms).collect()) == [("9x", "name"), ("9x", "options"), ("ok", "duplicate"), ("ok", "type")]
    df = spark.createDataFrame([(429, None, "a.PDF", 5, bytearray(b"%PDF-1")), (200, "Too many requests", "a.txt", 5, bytearray(b"%PDF-1")), (None, None, "b.pdf", 2**40, None)], "s int, m string, n string, z long, c binary")
    got = df.select(edits.rate_limited(F.col("s"), F.col("m")), edits.uploadable(F.col("n"), F.col("z"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, False)]
    qa = spark.createDataFrame([({"a": False}, 1), ({"a": True}, 1), ({}, 0)], "c map<string,boolean>, n int")
    assert [r[0] for r in qa.select(edits.qa_status(F.col("c"), F.col("n"))).collect()] == ["flagged", "passed", "in_progress"]
