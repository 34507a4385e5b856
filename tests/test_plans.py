from pyspark.sql import functions as F

from gleanwork.functions import repair
from gleanwork.plans import planner


def test_json_repair(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', "{'a': 'x', 'b': 2,}", 'so a: "y", then b: 3', "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", repair.parsed(F.col("t"))).orderBy("i").collect()]
    assert got == ['{"a": 1}', '{"a": 1}', '{"a": "x", "b": 2}', '{"a": "y", "b": 3}', None, None]


def test_field_coverage(spark):
    form = spark.createDataFrame([("a",), ("b",), ("c",)], "field string")
    signatures = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s2", "b"), ("s2", "z")], "signature string, field string")
    assert {tuple(r) for r in planner.field_coverage(form, signatures).collect()} == {("c", "missing"), ("a", "duplicate"), ("z", "unknown")}


def test_stage_problems(spark):
    schema = "stage int, execution string, signatures array<string>, provides array<string>, requires array<string>"
    stages = spark.createDataFrame([(1, "parallel", ["s"], ["a", "a"], ["b"]), (2, "sequential", ["t"], ["b"], ["a"]), (3, "sequential", [], [], ["q"])], schema)
    assert {tuple(r) for r in planner.stage_problems(stages).collect()} == {
        (1, "requires later field b"), (3, "requires later field q"), (3, "no signatures"), (1, "parallel with one signature"), (1, "field provided twice"),
    }


def test_pilot_feedback(spark):
    rows = [("f", 2, "incorrect", "B", "same"), ("f", 1, "incorrect", "A", "same"), ("f", 3, "correct", "C", " new "), ("g", 1, "incorrect", None, None)]
    got = {r.field: (r.examples, r.notes) for r in planner.accumulate(spark.createDataFrame(rows, "field string, iteration int, rating string, correct_value string, note string")).collect()}
    assert got == {"f": (["A", "B"], "- same\n- new"), "g": ([], "")}
