"""Evaluation, breaker and chunk queries against plain Python."""

import random
from collections import defaultdict
from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F

from gleanwork import queries
from gleanwork.catalog.evaluation import REQUIRED
from gleanwork.plans import evaluate
from gleanwork.streaming import messages

from .conftest import SF

EMPTY = {"", "none", "n/a", "na", "not reported", "not available", "nr", "unknown", "unclear"}


def plain_value(v, field):
    v = " ".join(("" if v is None else str(v)).lower().split())
    if field.lower().endswith(("_n", "_percent", "_tendency", "_variability", "_randomized")):
        try:
            v = str(round(float(v)))
        except ValueError:
            pass
    return v.rstrip(".,;")


def plain_score(a, b, field):
    a, b = plain_value(a, field), plain_value(b, field)
    if a in EMPTY and b in EMPTY:
        return 1.0
    return 0.0 if a in EMPTY or b in EMPTY else float(a == b)


def best_total(sims):
    """The largest total of a one-to-one matching, by all permutations."""
    if len(sims) > len(sims[0]):
        sims = [list(x) for x in zip(*sims)]
    return max(sum(sims[i][j] for i, j in enumerate(p)) for p in permutations(range(len(sims[0])), len(sims)))


def plain_records():
    line, orders = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    line = line.merge(orders[["o_orderkey"]], left_on="l_orderkey", right_on="o_orderkey")
    keys = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    line = line.sort_values(keys, ascending=False).drop_duplicates(["l_orderkey", "l_linenumber"])
    out = defaultdict(dict)
    for r in line.itertuples():
        out[r.l_orderkey][r.l_linenumber] = {"returnflag": "NR" if r.l_returnflag == "N" else r.l_returnflag, "linestatus": r.l_linestatus, "quantity_n": str(int(r.l_quantity))}
    return out


def test_record_metrics_against_plain_python(spark):
    got = queries.QUERIES["record_metrics"](spark, SF).toPandas().set_index("document_id")
    whole = queries.QUERIES["evaluation"](spark, SF).toPandas().set_index("study")
    records = {k: v for k, v in plain_records().items() if any(s <= 7 for s in v)}
    assert set(got.index) == set(records) == set(whole.index)
    for study, slots in records.items():
        ext, gt = [slots[s] for s in (1, 3, 5, 7) if s in slots], [slots[s] for s in (2, 4, 6) if s in slots]
        r = got.loc[study]
        assert (r.n_extracted, r.n_truth) == (len(ext), len(gt)) and r.fp == len(ext) - r.tp and r.fn == len(gt) - r.tp
        if not ext or not gt:
            assert r.tp == 0 and r.f1 == 0
            continue
        sims = [[sum(plain_score(e[f], g[f], f) for f in REQUIRED) / 3 for g in gt] for e in ext]
        # the matching of the largest total is not unique; its hits lie between those of the worst and the best of them
        total, hits = best_total(sims), set()
        rows, cols = (sims, False) if len(ext) <= len(gt) else ([list(x) for x in zip(*sims)], True)
        for p in permutations(range(len(rows[0])), len(rows)):
            if abs(sum(rows[i][j] for i, j in enumerate(p)) - total) < 1e-9:
                hits.add(sum(rows[i][j] >= 0.7 for i, j in enumerate(p)))
        assert r.tp in hits
        assert abs(r.precision - r.tp / len(ext)) < 1e-12 and abs(r.recall - r.tp / len(gt)) < 1e-12
        assert whole.loc[study].completeness == 1.0


def test_aligned_slots_against_plain_python(spark):
    got = defaultdict(dict)
    for r in queries.QUERIES["aligned_slots"](spark, SF).collect():
        _, slot, field = r.key.split("_")
        got[r.document_id].setdefault(int(slot), {})[field] = r.value
    flags = {"NR": "N"}
    for study, slots in plain_records().items():
        item = lambda r: {"flag": flags.get(r["returnflag"], r["returnflag"]), "line": r["linestatus"], "qty": r["quantity_n"]}
        ext, gt = ({(s + 1) // 2: item(slots[s]) for s in own if s in slots} for own in ((1, 3, 5, 7), (2, 4, 6)))
        if not ext or not gt:
            assert study not in got
            continue
        mine = got[study]
        assert sorted(map(str, mine.values())) == sorted(map(str, ext.values())) and max(mine) <= 4
        alike = lambda a, b: (plain_score(a["flag"], b["flag"], "f") + plain_score(a["line"], b["line"], "l")) / 2
        sims = [[alike(e, g) for g in gt.values()] for e in ext.values()]
        matched = [alike(mine[s], gt[s]) for s in gt if s in mine and alike(mine[s], gt[s]) > 0.5]
        # groups that match wholly are found as often as a best one-to-one matching finds them at most
        assert len(matched) >= max(0, round(best_total(sims)) - len(ext)) and (len(matched) > 0) == any(x > 0.5 for row in sims for x in row)


def test_matching_is_best_and_one_to_one(spark):
    pairs = [(1, i, 10 + j, s) for i, row in enumerate([[0.9, 0.8, 0.0], [0.9, 0.1, 0.0]]) for j, s in enumerate(row)] + [(2, 5, 1, 0.0), (3, 1, 1, 0.4), (3, 2, 1, 0.6)]
    df = spark.createDataFrame(pairs, "study long, ext_id long, gt_id long, similarity double")
    assert sorted((r.study, r.ext_id, r.gt_id) for r in evaluate.matched(df).collect()) == [(1, 0, 11), (1, 1, 10), (3, 2, 1)]


def test_one_study_of_many_records(spark):
    """5,000 extracted and 5,000 true records of one study, a third of them changed: each finds its own again, without all pairs."""
    n = 5000
    gt = spark.range(n).selectExpr("1L AS study", "id", "map('a', concat('a', id), 'b', concat('b', id div 3), 'c', concat('c', id * 7 % 5000)) AS values")
    ext = spark.range(n).selectExpr("1L AS study", "id + 100000 AS id", "map('a', if(id % 3 = 0, 'other', concat('A', id)), 'b', concat('b', id div 3), 'c', concat('c', id * 7 % 5000, '.')) AS values")
    pairs = evaluate.similar(ext, gt, ["a", "b", "c"])
    assert pairs.count() < 4 * n
    got = evaluate.matched(evaluate.compared(ext, gt, ["a", "b", "c"])).select("ext_id", "gt_id", "similarity").collect()
    assert len(got) == n and all(r.ext_id - 100_000 == r.gt_id for r in got)
    assert abs(sum(r.similarity for r in got) - (n - (n + 2) // 3 / 3)) < 1e-6


def test_similarities_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    values = ["x", "X.", "", None, "nr", "a b", "B, a", "!", "?", "12.2", "12"]
    rows = [[(s, i, {f: rng.choice(values) for f in ("note", "arm_n", "b")}) for s in range(3) for i in range(9)] for _ in range(2)]
    ext, gt = (spark.createDataFrame(r, "study long, id long, values map<string,string>") for r in rows)
    fields = ["note", "arm_n", "b"]
    a, b = (x.select("study", F.col("id").alias(i), F.col("values").alias(v)) for x, i, v in ((ext, "ext_id", "ev"), (gt, "gt_id", "gv")))
    scores = sum((evaluate.score(F.try_element_at("ev", F.lit(f)), F.try_element_at("gv", F.lit(f)), F.lit(f), ("note",)) for f in fields), F.lit(0.0)) / 3
    want = {(r.study, r.ext_id, r.gt_id): round(r.s, 9) for r in a.join(b, "study").withColumn("s", scores).collect() if r.s}
    got = evaluate.compared(ext, gt, fields, ("note",)).collect()
    assert {(r.study, r.ext_id, r.gt_id): round(r.similarity, 9) for r in got} == want
    assert all(abs(sum(r.scores) / 3 - r.similarity) < 1e-9 for r in got)


def test_field_counts_of_unmatched_records(spark):
    record = "study long, id long, values map<string,string>"
    ext = spark.createDataFrame([(1, 1, {"a": "x", "b": "nr"}), (1, 2, {"a": "odd"}), (2, 1, {"a": "q"})], record)
    gt = spark.createDataFrame([(1, 1, {"a": "X.", "b": "y"}), (3, 1, {"a": "z"})], record)
    counts = {r.field: r.asDict() for r in evaluate.field_counts(ext, gt, evaluate.matched(evaluate.compared(ext, gt, ["a", "b"])), ["a", "b"]).collect()}
    assert counts["a"] == {"field": "a", "gt_count": 2, "extracted_count": 3, "matched": 1, "missing": 1, "incorrect": 0, "extra": 2}
    assert counts["b"] == {"field": "b", "gt_count": 1, "extracted_count": 0, "matched": 0, "missing": 1, "incorrect": 0, "extra": 0}


def test_kappa_of_one_label_is_nan(spark):
    one = spark.createDataFrame([(1, {"a": "x"}, {"a": "X"})] * 3, "study long, ev map<string,string>, gv map<string,string>")
    assert evaluate.value_kappa(one, ["a"]).first().kappa != evaluate.value_kappa(one, ["a"]).first().kappa
    two = spark.createDataFrame([(1, {"a": "x", "b": "1"}, {"a": "x"}), (1, {"a": "y"}, {"a": "y"})], one.schema)
    assert evaluate.value_kappa(two, ["a", "b"]).first().kappa == 1.0


def test_groups_take_the_slots_they_match(spark):
    ev = {"arm_1_drug": "placebo", "arm_2_drug": "Aspirin", "arm_2_dose": "5", "arm_3_drug": "other", "n": "9"}
    gv = {"arm_1_drug": "aspirin", "arm_2_drug": "placebo"}
    df = spark.createDataFrame([(ev, gv), ({"n": "1"}, gv)], "ev map<string,string>, gv map<string,string>")
    got = [r.ev for r in evaluate.aligned_groups(df, "arm", ["drug"], ["drug", "dose"], 4).collect()]
    assert got == [{"arm_2_drug": "placebo", "arm_1_drug": "Aspirin", "arm_1_dose": "5", "arm_3_drug": "other", "n": "9"}, {"n": "1"}]


def test_own_metric(spark):
    df = spark.createDataFrame([({"a": "x"}, {"a": "x"}), ({"a": "x"}, {"a": "y"})], "ev map<string,string>, gv map<string,string>")

    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a == b).astype(float)

    assert [r.metric for r in evaluate.with_metric(df, same).collect()] == [1.0, 0.0]


def test_breaker_against_plain_python(spark):
    rows, rng = [], random.Random(3)
    for m in range(5):
        for i in range(400):
            rows.append((f"m{m}", i * (7 + m), m * 1000 + i, rng.random() < 0.45))
    df = spark.createDataFrame(rows, "model string, s int, call_id long, rate_limited boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = defaultdict(list)
    for r in messages.breaker(df).orderBy("call_id").collect():
        got[r.model].append((r.call_id, r.before, r.after))
    for m in range(5):
        state, failures, good, opened, want = "CLOSED", 0, 0, 0.0, []
        for _, at, call, limited in (r for r in rows if r[0] == f"m{m}"):
            before = state
            if state == "OPEN" and at - opened >= 60:
                state, good = "HALF_OPEN", 0
            if limited:
                failures += 1
                if state == "HALF_OPEN" or state == "CLOSED" and failures >= 3:
                    state, opened = "OPEN", at
                good = 0
            elif state == "HALF_OPEN":
                good += 1
                if good >= 2:
                    state, failures = "CLOSED", 0
            elif state == "CLOSED":
                failures = 0
            if state != before:
                want.append((call, before, state))
        assert got[f"m{m}"] == want and want


def test_chunks_against_plain_python(spark):
    got = defaultdict(list)
    for r in queries.QUERIES["chunk_tables"](spark, SF).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append((r.kind, r.page, r.start_char, r.end_char))
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    for i, t in zip(docs.doc_id, docs.text):
        want, at = [], 0
        for part in [x for x in t.replace("\n\n", "\0").split("\0")]:
            want += [("paragraph", 1, at, at + len(part))] if part.strip() and part.count("|") < 2 else []
            at += len(part) + 2
        if "|" not in t and "\n\n\n" not in t:
            assert got[i] == want


def test_rough_snippets_are_found_in_their_documents(spark):
    """All words but every sixth of a document's start: found exactly or roughly wherever the similarity reaches the bound."""
    got = {r.doc_id: r.confidence for r in queries.QUERIES["locate_fuzzy"](spark, SF).collect()}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    long_enough = {i for i, t in zip(docs.doc_id, docs.text) if len(t) > 200 and "\n\n" not in t[:400]}
    assert long_enough <= set(got) and all(0.65 <= c <= 1 for c in got.values())
