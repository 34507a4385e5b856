"""Synonym classes, canonical texts, records in canonical terms, kept judgements."""

import random

from pyspark.sql import functions as F

from gleanwork.operators import vocabulary
from gleanwork.plans import evaluate


def test_classes_of_chains(spark):
    pairs = [(f"T {i:03}", f"t {i + 1:03}") for i in range(60) if i != 30] + [("x", "Y!"), ("y", "z"), (None, "q"), ("!", "q")]
    got = {r.term: r.canonical for r in vocabulary.classes(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {f"t {i:03}": "t 000" if i <= 30 else "t 031" for i in range(61)} | dict.fromkeys("xyz", "x")


def plain_canonical(text, terms):
    import re

    w, out, n, i = re.findall(r"[^\W_]+", (text or "").lower()), [], 0, 0
    by = {tuple(t.split()): c for t, c in terms.items()}
    while i < len(w):
        k = next((k for k in range(4, 0, -1) if tuple(w[i : i + k]) in by and i + k <= len(w)), 0)
        out.append(by[tuple(w[i : i + k])] if k else w[i])
        n, i = n + bool(k), i + max(k, 1)
    return " ".join(out), n


def test_texts_in_canonical_terms(spark, monkeypatch):
    rng = random.Random(3)
    terms = {"a": "one", "a b": "two", "b c": "three", "c a b d": "four", "d d": "a"}
    texts = [" ".join(rng.choice(["a", "B", "c,", "d", "é"]) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, "no terms"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    vocab = spark.createDataFrame(list(terms.items()), "term string, canonical string")
    want = {i: plain_canonical(t, terms) for i, t in enumerate(texts)}
    for few in (vocabulary.FEW, 0):
        monkeypatch.setattr(vocabulary, "FEW", few)
        assert {r.i: (r.t, r.found) for r in vocabulary.canonicalised(df, "i", "t", vocab).collect()} == want
    assert {r.i: r.found for r in vocabulary.canonicalised(df, "i", "t", vocab.limit(0)).collect()} == dict.fromkeys(range(len(texts)), 0)


def test_records_compare_by_their_classes(spark):
    record = "study long, id long, values map<string,string>"
    terms = vocabulary.classes(spark.createDataFrame([("heart attack", "myocardial infarction"), ("mi", "heart attack")], "a string, b string"))
    ext = spark.createDataFrame([(1, 1, {"event": "MI", "note": "MI"}), (1, 2, {"event": None})], record)
    gt = spark.createDataFrame([(1, 5, {"event": "Myocardial  infarction.", "note": "Myocardial infarction"})], record)
    before = evaluate.compared(ext, gt, ["event", "note"])
    assert before.count() == 0
    a, b = (vocabulary.in_canonical_terms(x, ["event"], terms) for x in (ext, gt))
    assert [(r.ext_id, r.gt_id, r.scores) for r in evaluate.compared(a, b, ["event", "note"]).collect()] == [(1, 5, [1.0, 0.0])]
    assert a.filter("id = 2").first()["values"] == {"event": None}


def test_judgements_are_kept_and_expire(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    empty = spark.createDataFrame([], "pair string, same boolean, at timestamp")
    pairs = spark.createDataFrame([("a b", "B a", "f"), ("B  a", "a b", "f"), ("x", "y", "f")], "a string, b string, field string")
    asks = []

    def judge(a, b, field):
        asks.append(1)
        return evaluate.same_words(F.lower(a), F.lower(b))

    out, cache = vocabulary.judged(pairs, empty, judge, at("2024-01-01 00:00:00"))
    assert sorted((r.a, r.same) for r in out.collect()) == [("B  a", True), ("a b", True), ("x", False)] and cache.count() == 2
    out, later = vocabulary.judged(pairs, cache, lambda a, b, f: F.lit(None).cast("boolean"), at("2024-01-01 23:59:59"))
    assert sorted(str(r.same) for r in out.collect()) == ["False", "True", "True"] and later.count() == 2
    out, gone = vocabulary.judged(pairs, cache, lambda a, b, f: F.lit(True), at("2024-01-02 00:00:01"))
    assert [r.same for r in out.collect()] == [True] * 3 and gone.count() == 2
