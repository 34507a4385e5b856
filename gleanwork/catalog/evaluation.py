"""Evaluation of extracted records against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import fields
from ..plans import evaluate
from ..registry import query

REQUIRED = ["returnflag", "linestatus", "quantity_n"]

#: Slot 1 as the extraction and slot 3 as the truth of a document; an N flag counts as not reported.
RECORDS = """
WITH e AS (SELECT document_id AS study, CASE l_returnflag WHEN 'N' THEN 'nr' ELSE lower(l_returnflag) END AS f1, lower(l_linestatus) AS f2, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS f3 FROM fx_results WHERE slot = 1),
g AS (SELECT document_id AS study, CASE l_returnflag WHEN 'N' THEN 'nr' ELSE lower(l_returnflag) END AS f1, lower(l_linestatus) AS f2, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS f3 FROM fx_results WHERE slot = 3),
p AS (SELECT e.study, e.f1 AS e1, e.f2 AS e2, e.f3 AS e3, g.f1 AS g1, g.f2 AS g2, g.f3 AS g3, CAST(e.f1 = g.f1 AS INT) AS s1, CAST(e.f2 = g.f2 AS INT) AS s2, CAST(e.f3 = g.f3 AS INT) AS s3 FROM e JOIN g ON e.study = g.study),
m AS (SELECT *, (s1 + s2 + s3) / 3.0::DOUBLE AS sim FROM p WHERE s1 + s2 + s3 > 0)
"""
#: Field counts of these records, one common table `c`.
COUNTS = RECORDS + """, rows AS (SELECT e1, g1, s1, e2, g2, s2, e3, g3, s3 FROM m
UNION ALL SELECT NULL, f1, 0, NULL, f2, 0, NULL, f3, 0 FROM g WHERE study NOT IN (SELECT study FROM m)
UNION ALL SELECT f1, NULL, 0, f2, NULL, 0, f3, NULL, 0 FROM e WHERE study NOT IN (SELECT study FROM m)),
cells AS (SELECT 'returnflag' AS field, nullif(e1, 'nr') AS e, nullif(g1, 'nr') AS g, s1 AS s FROM rows UNION ALL SELECT 'linestatus', e2, g2, s2 FROM rows UNION ALL SELECT 'quantity_n', e3, g3, s3 FROM rows),
c AS (SELECT field, count(g)::BIGINT AS gt_count, count(e)::BIGINT AS extracted_count, count(*) FILTER (WHERE e IS NOT NULL AND g IS NOT NULL AND s = 1)::BIGINT AS matched, count(*) FILTER (WHERE g IS NOT NULL AND e IS NULL)::BIGINT AS missing,
count(*) FILTER (WHERE e IS NOT NULL AND g IS NOT NULL AND s = 0)::BIGINT AS incorrect, count(*) FILTER (WHERE e IS NOT NULL AND g IS NULL)::BIGINT AS extra FROM cells GROUP BY 1)
"""


def records(spark, sf_dir, slots):
    named = F.transform_keys(fields.as_map(F.col("extracted_data")), lambda k, _: F.when(k == "quantity", "quantity_n").otherwise(k))
    values = F.transform_values(named, lambda k, v: F.when((k == "returnflag") & (v == "N"), "NR").otherwise(v))
    rows = view(spark, sf_dir, "fx_results").filter(F.col("slot").isin(*slots))
    return rows.select(F.col("document_id").alias("study"), F.col("slot").cast("long").alias("id"), values.alias("values"))


def sides(spark, sf_dir, ext=(1,), gt=(3,)):
    return records(spark, sf_dir, ext), records(spark, sf_dir, gt)


def counts(spark, sf_dir):
    ext, gt = sides(spark, sf_dir)
    return evaluate.field_counts(ext, gt, evaluate.matched(evaluate.compared(ext, gt, REQUIRED)), REQUIRED)


@query(COUNTS + "SELECT * FROM c")
def field_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query(RECORDS + """SELECT coalesce(e.study, g.study) AS study, CAST(e.study IS NOT NULL AS BIGINT) AS n_extracted, CAST(g.study IS NOT NULL AS BIGINT) AS n_truth, CAST(coalesce(m.sim >= 0.7, false) AS BIGINT) AS tp,
CAST(e.study IS NOT NULL AND NOT coalesce(m.sim >= 0.7, false) AS BIGINT) AS fp, CAST(g.study IS NOT NULL AND NOT coalesce(m.sim >= 0.7, false) AS BIGINT) AS fn,
CAST(coalesce(m.sim >= 0.7, false) AS DOUBLE) AS precision, CAST(coalesce(m.sim >= 0.7, false) AS DOUBLE) AS recall, CAST(coalesce(m.sim >= 0.7, false) AS DOUBLE) AS f1
FROM e FULL JOIN g ON e.study = g.study LEFT JOIN m ON m.study = coalesce(e.study, g.study)""")
def paired_record_metrics(spark, sf_dir):
    ext, gt = sides(spark, sf_dir)
    return evaluate.record_metrics(ext, gt, evaluate.matched(evaluate.compared(ext, gt, REQUIRED)))


@query(None)
def record_metrics(spark, sf_dir):
    ext, gt = sides(spark, sf_dir, (1, 3, 5, 7), (2, 4, 6))
    return evaluate.record_metrics(ext, gt, evaluate.matched(evaluate.compared(ext, gt, REQUIRED))).withColumnRenamed("study", "document_id")


@query(RECORDS + """, l AS (SELECT 'returnflag::' || e1 AS a, 'returnflag::' || g1 AS b FROM m UNION ALL SELECT 'linestatus::' || e2, 'linestatus::' || g2 FROM m),
x AS (SELECT v, sum(c1) AS c1, sum(c2) AS c2 FROM (SELECT a AS v, count(*) AS c1, 0 AS c2 FROM l GROUP BY 1 UNION ALL SELECT b, 0, count(*) FROM l GROUP BY 1) GROUP BY 1), t AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM l)
SELECT CAST(t.n AS BIGINT) AS n, round_even(((po - pe) / (1 - pe))::DOUBLE, 9) AS kappa FROM t, (SELECT sum(c1 * c2) / ((SELECT n * n FROM t)::DOUBLE) AS pe FROM x)""")
def value_kappa(spark, sf_dir):
    ext, gt = sides(spark, sf_dir)
    return evaluate.value_kappa(evaluate.matched(evaluate.compared(ext, gt, REQUIRED)), REQUIRED[:2]).withColumn("kappa", F.bround("kappa", 9))


@query(None)
def evaluation(spark, sf_dir):
    ext, gt = sides(spark, sf_dir, (1, 3, 5, 7), (2, 4, 6))
    return evaluate.evaluated(ext, gt, REQUIRED, REQUIRED[:2])


@query(COUNTS + """, k AS (SELECT 'missing' AS kind, sum(missing) AS n FROM c UNION ALL SELECT 'incorrect', sum(incorrect) FROM c UNION ALL SELECT 'extra', sum(extra) FROM c)
SELECT kind, n::BIGINT AS n, coalesce(round_even((n * 100.0 / nullif((SELECT sum(n) FROM k), 0))::DOUBLE, 2), 0.0) + 0.0::DOUBLE AS pct FROM k""")
def error_contribution(spark, sf_dir):
    return evaluate.error_contribution(counts(spark, sf_dir))


@query(COUNTS + "SELECT CASE WHEN field LIKE '%\\_n' ESCAPE '\\' THEN 'numeric' ELSE 'text' END AS kind, " + ", ".join(f"sum({x})::BIGINT AS {x}" for x in ("gt_count", "matched", "missing", "incorrect")) + ", "
       + ", ".join(f"round_even((sum({x}) * 100.0 / sum(gt_count))::DOUBLE, 2) + 0.0::DOUBLE AS {x}_pct" for x in ("matched", "missing", "incorrect")) + " FROM c GROUP BY 1")
def performance_by_type(spark, sf_dir):
    return evaluate.by_type(counts(spark, sf_dir), F.when(F.col("field").endswith("_n"), "numeric").otherwise("text"))


@query(COUNTS + "SELECT field, extra AS errors FROM c WHERE extra > 0 ORDER BY extra DESC, field LIMIT 2")
def most_extra_fields(spark, sf_dir):
    return evaluate.worst(counts(spark, sf_dir), 2, "extra")


@query(COUNTS + "SELECT field, (missing + incorrect)::BIGINT AS errors FROM c WHERE gt_count > 0 ORDER BY errors DESC, field LIMIT 2")
def most_wrong_fields(spark, sf_dir):
    return evaluate.worst(counts(spark, sf_dir), 2)


#: Values whose evaluator form is known: (value, field, form).
FORMS = [("12.5", "age_percent", "12"), ("13.5", "total_n", "14"), ("3.4", "x_count", "3.4"), ("1 - 5", "Age_Range", "1,5"), ("__a.PDF;", "filename", "a.pdf"), ("  A\t b ., ", "note", "a b "), ("x,", "arm_n", "x"), ("1e2", "dose_tendency", "100")]


@query("SELECT c_custkey, CAST(round_even(c_acctbal, 0) AS BIGINT)::VARCHAR AS whole, replace(lower(c_name), '#', ' #') AS name, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) || ',4' ELSE lower(c_mktsegment) END AS ranged FROM customer")
def evaluator_forms(spark, sf_dir):
    from ..functions.norm import evaluator_value

    c = view(spark, sf_dir, "customer")
    name = F.concat(F.lit(" "), F.regexp_replace("c_name", "#", "  #"), F.lit(" ."))
    ranged = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" - 4."))).otherwise(F.col("c_mktsegment"))
    whole = evaluator_value(F.format_string("%.2f", "c_acctbal"), F.lit("Balance_N"))
    return c.select("c_custkey", whole.alias("whole"), F.trim(evaluator_value(name, F.lit("name"))).alias("name"), evaluator_value(ranged, F.lit("Age_Range")).alias("ranged"))


@query("""SELECT document_id, sha256('v2_' || least(lower(l_returnflag), lower(l_linestatus)) || '||' || greatest(lower(l_returnflag), lower(l_linestatus)) || '||flag') AS pair, sha256('{"a":"' || l_returnflag || '","b":"' || l_linestatus || '"}') AS record FROM fx_results WHERE slot = 1""")
def judgement_keys(spark, sf_dir):
    values = F.create_map(F.lit("b"), F.col("l_linestatus"), F.lit("a"), F.col("l_returnflag"))
    rows = view(spark, sf_dir, "fx_results").filter("slot = 1")
    return rows.select("document_id", evaluate.pair_key(F.concat(F.lit(" "), "l_returnflag"), F.col("l_linestatus"), F.lit("flag")).alias("pair"), evaluate.record_key(values).alias("record"))


@query("SELECT conv_id, turn, list_sort(list_distinct(string_split(lower(role || ' b a'), ' '))) = list_sort(list_distinct(string_split(lower('a user b'), ' '))) AS same FROM conversations")
def semantic_stub(spark, sf_dir):
    talk = view(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", (evaluate.score(F.concat("role", F.lit(" b a")), F.lit("A  user, b"), F.lit("about"), ("about",)) == 1).alias("same"))


GROUP = {"prefix": "arm", "fields": ["flag", "qty"], "slots": 7}


@query("""SELECT document_id, slot::INT AS slot, l_returnflag AS flag, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS qty FROM fx_results WHERE slot <= 7""")
def group_items(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_results").filter("slot <= 7")
    cell = lambda name, value: F.struct(F.concat(F.lit("arm_"), F.col("slot"), F.lit(f"_{name}")).alias("k"), value.alias("v"))
    wide = rows.groupBy("document_id").agg(F.map_from_entries(F.flatten(F.collect_list(F.array(cell("flag", F.col("l_returnflag")), cell("qty", F.col("l_quantity").cast("int").cast("string")))))).alias("values"))
    items = wide.select("document_id", F.inline(evaluate.group_items(F.col("values"), **GROUP)))
    return items.select("document_id", "slot", F.col("item")["flag"].alias("flag"), F.col("item")["qty"].alias("qty"))


@query(None)
def aligned_slots(spark, sf_dir):
    """Groups of a document's extraction (slots 1, 3, 5, 7) renamed after the true ones (2, 4, 6) they match: (document_id, key, value)."""
    rows = view(spark, sf_dir, "fx_results").filter("slot <= 7").withColumn("arm", F.expr("(slot + 1) div 2"))
    cell = lambda name, value: F.struct(F.concat(F.lit("arm_"), F.col("arm"), F.lit(f"_{name}")).alias("k"), value.alias("v"))
    cells = F.array(cell("flag", F.col("l_returnflag")), cell("line", F.col("l_linestatus")), cell("qty", F.col("l_quantity").cast("int").cast("string")))
    side = lambda odd, name: rows.filter(F.col("slot") % 2 == odd).groupBy("document_id").agg(F.map_from_entries(F.flatten(F.collect_list(cells))).alias(name))
    pairs = side(1, "ev").join(side(0, "gv"), "document_id")
    aligned = evaluate.aligned_groups(pairs, "arm", ["flag", "line"], ["flag", "line", "qty"], 4)
    return aligned.select("document_id", F.explode("ev").alias("key", "value"))
