"""Two reviewers and a machine: comparison, consensus, reliability, the best-value grid and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm
from ..functions.fields import as_map, field_values



def reviewer_pairs(results: DataFrame) -> DataFrame:
    """(document_id, field, v1, v2) of documents that both reviewers filled; fields of either, a missing one null.

    One pass and one shuffle: both reviewers' texts land in one row, whose fields are then laid side by side.
    """
    text = lambda role: F.max(F.when(F.col("reviewer_role") == role, F.col("extracted_data")))
    both = results.filter("extraction_type = 'manual'").groupBy("document_id").agg(text("reviewer_1").alias("t1"), text("reviewer_2").alias("t2"))
    maps = both.filter("t1 is not null and t2 is not null").select("document_id", as_map(F.col("t1")).alias("m1"), as_map(F.col("t2")).alias("m2"))
    fields = F.array_union(F.coalesce(F.map_keys("m1"), F.expr("cast(array() as array<string>)")), F.coalesce(F.map_keys("m2"), F.expr("cast(array() as array<string>)")))
    return maps.select("document_id", "m1", "m2", F.explode(fields).alias("field")).select("document_id", "field", F.try_element_at("m1", F.col("field")).alias("v1"), F.try_element_at("m2", F.col("field")).alias("v2"))


def compare(pairs: DataFrame, ai: DataFrame | None = None) -> DataFrame:
    """Each field with both reviewers' values, the machine's, and whether the reviewers agree."""
    out = pairs.withColumn("agreed", norm.agree(F.col("v1"), F.col("v2")))
    return out.join(ai, ["document_id", "field"], "left") if ai is not None else out


def agreement(compared: DataFrame, *by: str) -> DataFrame:
    n, agreed = F.count("*"), F.count_if("agreed")
    return compared.groupBy(*by).agg(n.alias("total_fields"), agreed.alias("agreed_count"), (n - agreed).alias("disagreed_count"), norm.half_even(agreed * 100.0 / n, 2).alias("agreement_pct"))


def result_compare(manual: DataFrame, ai: DataFrame) -> DataFrame:
    """Full outer by (document_id, field): manual_value, ai_value, matches (both truthy and equal)."""
    joined = manual.withColumnRenamed("value", "manual_value").join(ai.withColumnRenamed("value", "ai_value"), ["document_id", "field"], "full_outer")
    return joined.withColumn("matches", norm.match_truthy(F.col("manual_value"), F.col("ai_value")))


def irr(pairs: DataFrame) -> DataFrame:
    """Per field, and over all (field null): n, percent agreement and Cohen's kappa, four places.

    Percent agreement normalises and takes pairs with both values; kappa compares the values as they are,
    and is 1 with a single category or when chance agreement is 1.
    """
    each = pairs.filter("v1 is not null and v2 is not null").select(F.explode(F.array(F.col("field"), F.lit(None).cast("string"))).alias("field"), "v1", "v2")
    cells = each.groupBy("field", "v1", "v2").agg(F.count("*").alias("c"))
    # each cell as its two marginal entries; agreements are told once, with the first
    c, none = F.col("c"), F.lit(0).cast("long")
    first = F.struct(F.col("v1").alias("v"), c.alias("c1"), none.alias("c2"), F.when(F.col("v1") == F.col("v2"), c).otherwise(none).alias("same"), F.when(norm.both_agree(F.col("v1"), F.col("v2")), c).otherwise(none).alias("alike"))
    second = F.struct(F.col("v2").alias("v"), none.alias("c1"), c.alias("c2"), none.alias("same"), none.alias("alike"))
    sides = cells.select("field", F.explode(F.array(first, second)).alias("s")).select("field", "s.*")
    margins = sides.groupBy("field", "v").agg(*[F.sum(x).alias(x) for x in ("c1", "c2", "same", "alike")])
    out = margins.groupBy("field").agg(F.sum("c1").alias("n"), F.sum("same").alias("same"), F.sum("alike").alias("alike"), F.sum(F.col("c1") * F.col("c2")).alias("cross"), F.count("*").alias("categories"))
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    kappa = F.when((F.col("categories") == 1) | (pe == 1), F.lit(1.0)).otherwise(norm.half_even((po - pe) / (1 - pe), 4))
    return out.select("field", "n", norm.half_even(F.col("alike") / F.col("n"), 4).alias("percent_agreement"), kappa.alias("kappa"))


def icc(pairs: DataFrame) -> DataFrame:
    """Simplified intraclass correlation per field, and over all (field null); null under three pairs, or if any value isn't a number."""
    each = pairs.filter("v1 is not null and v2 is not null").select(F.explode(F.array(F.col("field"), F.lit(None).cast("string"))).alias("field"), "v1", "v2")
    both = each.select("field", norm.to_number(F.col("v1")).alias("a"), norm.to_number(F.col("v2")).alias("b"))
    n = F.count("*")
    between, within = F.var_samp((F.col("a") + F.col("b")) / 2) * 2, F.avg((F.col("a") - F.col("b")) ** 2) / 2
    sums = both.groupBy("field").agg(n.alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("bad"), between.alias("msb"), within.alias("msw"))
    value = F.when(F.col("msb") + F.col("msw") == 0, F.lit(1.0)).otherwise((F.col("msb") - F.col("msw")) / (F.col("msb") + F.col("msw")))
    clamped = norm.half_even(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)), 4)
    return sums.select("field", "n", F.when((F.col("n") >= 3) & (F.col("bad") == 0), clamped).alias("icc"))


def best_values(results: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """(document_id, field, value, origin): the adjudicated value, else reviewer 1's, reviewer 2's, the machine's."""
    role = F.coalesce("reviewer_role", F.lit("ai"))
    values = field_values(results.withColumn("origin", role), "document_id", "origin", "created_at")
    if adjudicated is not None:
        values = values.unionByName(adjudicated.withColumn("origin", F.lit("adjudicator")), allowMissingColumns=True)
    rank = F.array_position(F.array(*[F.lit(x) for x in ("adjudicator", "reviewer_1", "reviewer_2", "ai")]), F.col("origin"))
    best = F.min_by(F.struct("value", "origin"), F.struct(rank, -F.unix_micros(F.col("created_at").cast("timestamp")), F.col("value")))
    return values.groupBy("document_id", "field").agg(best.alias("b")).select("document_id", "field", "b.value", "b.origin")


def violates(rule: str, value: Column, other: Column | None = None, low=None, high=None, pattern: str = "", form: str = "") -> Column:
    """Whether a value breaks a rule: required, range, regex (anchored at the start), format or cross_field."""
    blank = value.isNull() | (norm.strip(value) == "")
    if rule == "required":
        return blank
    if rule == "range":
        n = norm.to_number(value)
        out = F.lit(False)
        out = out | (n < low) if low is not None else out
        out = out | (n > high) if high is not None else out
        return F.coalesce(out, F.lit(False))
    if rule == "regex":
        return F.coalesce(~value.rlike(f"^(?:{pattern})"), F.lit(False))
    if rule == "format":
        wrong = ~value.contains("@") if form == "email" else norm.iso_time(value).isNull()
        return F.coalesce(F.when(blank, F.lit(False)).otherwise(wrong), F.lit(False))
    return other.isNotNull() & (norm.strip(other) != "") & blank


#: Schema of a table of rules: which field, which rule, and what the rule needs.
RULES = "rule_id int, field string, rule string, low double, high double, pattern string, form string, other_field string"


def violations(grid: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_id, rule_id, field, value) of each rule's violations in a grid (document_id, values), values a map.

    Rules meet documents by exploding the grid's rows over the few rules of one literal; missing fields count as null.
    """
    listed = rules.agg(F.collect_list(F.struct(*[f.name for f in rules.schema.fields])).alias("rules"))
    rows = grid.crossJoin(F.broadcast(listed)).select("document_id", "values", F.explode("rules").alias("r"))  # one row of a few rules
    value, other = F.try_element_at("values", F.col("r.field")), F.try_element_at("values", F.col("r.other_field"))
    number, blank = norm.to_number(value), value.isNull() | (norm.strip(value) == "")
    wrong_form = F.when(F.col("r.form") == "email", ~value.contains("@")).otherwise(norm.iso_time(value).isNull())
    broken = (
        F.when(F.col("r.rule") == "required", blank)
        .when(F.col("r.rule") == "range", F.coalesce(number < F.col("r.low"), F.lit(False)) | F.coalesce(number > F.col("r.high"), F.lit(False)))
        .when(F.col("r.rule") == "regex", F.coalesce(~F.regexp_like(value, F.concat(F.lit("^(?:"), "r.pattern", F.lit(")"))), F.lit(False)))
        .when(F.col("r.rule") == "format", F.when(blank, F.lit(False)).otherwise(F.coalesce(wrong_form, F.lit(False))))
        .when(F.col("r.rule") == "cross_field", F.coalesce(other.isNotNull() & (norm.strip(other) != ""), F.lit(False)) & blank)
        .otherwise(F.lit(False))
    )
    return rows.filter(broken).select("document_id", "r.rule_id", "r.field", value.alias("value"))


def accuracy(compared: DataFrame, *by: str) -> DataFrame:
    """Fields, matches and accuracy (four places, 0 without any) of `result_compare`."""
    n, right = F.count("*"), F.count_if("matches")
    return compared.groupBy(*by).agg(n.alias("total_fields"), right.alias("matches"), norm.half_even(F.when(n > 0, right / n).otherwise(0.0), 4).alias("accuracy"))


def consensus(pairs: DataFrame) -> DataFrame:
    """Per document: fields, agreed (both present and equal), disputed, and the rounded percent."""
    agreed = F.count_if(norm.both_agree(F.col("v1"), F.col("v2")))
    n = F.count("*")
    return pairs.groupBy("document_id").agg(n.alias("total_fields"), agreed.alias("agreed_count"), (n - agreed).alias("disputed_count"), F.bround(agreed * 100.0 / n, 0).cast("long").alias("agreement_pct"))
