"""Extracted records against ground truth."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import norm
from ..storage import written

#: A match of at least this similarity is a true positive; fixed value.
TRUE_AT = 0.70


def same_words(a: Column, b: Column) -> Column:
    """Whether two texts have the same words: what stands in for a model that judges meaning."""
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    return words(a) == words(b)


def score(a: Column, b: Column, field: Column | None = None, semantic: tuple[str, ...] = ()) -> Column:
    """1 where both values are empty or equal in the evaluator's form, else 0; fields in `semantic` need only the same words."""
    name = F.lit("") if field is None else field
    x, y = norm.evaluator_value(a, name), norm.evaluator_value(b, name)
    no_x, no_y = norm.is_empty(x), norm.is_empty(y)
    equal = x == y
    if semantic:
        equal = equal | (name.isin(*semantic) & same_words(x, y))
    return F.when(no_x & no_y, 1.0).when(no_x | no_y, 0.0).otherwise(equal.cast("double"))


def pair_key(a: Column, b: Column, field: Column) -> Column:
    """Key under which a judgement of two texts is kept: the same for either order."""
    x, y = (F.lower(norm.collapse(c)) for c in (a, b))
    return F.sha2(F.concat(F.lit("v2_"), F.least(x, y), F.lit("||"), F.greatest(x, y), F.lit("||"), field), 256)


def record_key(values: Column) -> Column:
    """Hash of a record (a map) that doesn't depend on the order of its keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values)))), 256)


def value_keys(values: Column, required: list[str], semantic: tuple[str, ...] = ()) -> Column:
    """Array of (field, key) of a record: two records score 1 in a field exactly where these keys are equal."""
    out = []
    for i, f in enumerate(required):
        x = norm.evaluator_value(F.try_element_at(values, F.lit(f)), F.lit(f))
        words = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))), " ")
        out.append(F.struct(F.lit(i).alias("field"), F.when(norm.is_empty(x), F.lit("")).otherwise(F.concat(F.lit("="), words if f in semantic else x)).alias("key")))
    return F.array(*out)


def similar(extracted: DataFrame, truth: DataFrame, required: list[str], semantic: tuple[str, ...] = ()) -> DataFrame:
    """(study, ext_id, gt_id, similarity) of the pairs of a study that score in any field: the similarities that aren't 0.

    Pairs meet by the values they share, so a study's records are never all compared with each other.
    """
    side = lambda df, name: df.select("study", F.col("id").alias(name), F.explode(value_keys(F.col("values"), required, semantic)).alias("k")).select("study", name, "k.field", "k.key")
    shared = side(extracted, "ext_id").join(side(truth, "gt_id"), ["study", "field", "key"])
    return shared.groupBy("study", "ext_id", "gt_id").agg((F.count("*") / len(required)).alias("similarity"))


def compared(extracted: DataFrame, truth: DataFrame, required: list[str], semantic: tuple[str, ...] = ()) -> DataFrame:
    """(study, ext_id, gt_id, ev, gv, scores, similarity) of the pairs of a study whose similarity isn't 0.

    Both sides are (study, id, values), values a map.
    """
    a = extracted.select("study", F.col("id").alias("ext_id"), F.col("values").alias("ev"))
    b = truth.select("study", F.col("id").alias("gt_id"), F.col("values").alias("gv"))
    scores = F.array(*[score(F.try_element_at("ev", F.lit(f)), F.try_element_at("gv", F.lit(f)), F.lit(f), semantic) for f in required])
    out = similar(extracted, truth, required, semantic).join(a, ["study", "ext_id"]).join(b, ["study", "gt_id"])
    return out.select("study", "ext_id", "gt_id", "ev", "gv", scores.alias("scores"), "similarity")


def matched(pairs: DataFrame) -> DataFrame:
    """The rows of `compared` in the best one-to-one matching of each study, those of similarity 0 left out.

    A study with one record on a side takes its likest pair in SQL; the others' similarities, those above 0 alone, go
    through an assignment. Where several matchings are best, which one it is follows from the ids.
    """
    pairs = pairs.filter("similarity > 0")
    sides = pairs.groupBy("study").agg(F.count_distinct("ext_id").alias("n_ext"), F.count_distinct("gt_id").alias("n_gt"))
    ids = pairs.select("study", "ext_id", "gt_id", "similarity").join(sides, "study")
    single = F.least("n_ext", "n_gt") == 1
    likest = ids.filter(single & (F.col("similarity") > 0)).groupBy("study").agg(F.max(F.struct("similarity", (-F.col("ext_id")).alias("e"), (-F.col("gt_id")).alias("g"))).alias("m"))
    likest = likest.select("study", (-F.col("m.e")).alias("ext_id"), (-F.col("m.g")).alias("gt_id"))
    several = ids.filter(~single).select("study", "ext_id", "gt_id", "similarity")

    def run(batches):
        """Studies stand together; a task holds one study's similarities at a time."""
        now, held = None, []

        def solved():
            found = assign_pairs(held)
            return pa.RecordBatch.from_pydict({"study": pa.array([now] * len(found), pa.int64()), "ext_id": pa.array([i for i, _ in found], pa.int64()), "gt_id": pa.array([j for _, j in found], pa.int64())})

        for batch in batches:
            for study, *row in zip(*(batch.column(c).to_pylist() for c in ("study", "ext_id", "gt_id", "similarity"))):
                if study != now:
                    yield solved()
                    now, held = study, []
                held.append(row)
        yield solved()

    assigned = several.repartition("study").sortWithinPartitions("study").mapInArrow(run, "study long, ext_id long, gt_id long")
    return pairs.join(likest.unionByName(assigned), ["study", "ext_id", "gt_id"], "left_semi")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def record_metrics(extracted: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Per study, also those on one side alone: n_extracted, n_truth, tp, fp, fn, precision, recall, f1."""
    n = lambda df, name: df.groupBy("study").agg(F.count("*").alias(name))
    right = matches.filter(F.col("similarity") >= TRUE_AT)
    out = n(extracted, "n_extracted").join(n(truth, "n_truth"), "study", "full_outer").join(n(right, "tp"), "study", "left").fillna(0)
    out = out.withColumn("fp", F.col("n_extracted") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("tp"))
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("n_extracted"))).withColumn("recall", _ratio(F.col("tp"), F.col("n_truth")))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def field_counts(extracted: DataFrame, truth: DataFrame, matches: DataFrame, required: list[str]) -> DataFrame:
    """Per field: gt_count, extracted_count, matched, missing, incorrect, extra, over matched and unmatched records."""
    matches = written(matches.select("study", "ext_id", "gt_id", "ev", "gv", "scores"))  # read three times
    none = F.expr("cast(null as map<string,string>)")
    left = lambda df, side: df.join(matches.select("study", F.col(side).alias("id")), ["study", "id"], "left_anti")
    rows = matches.select("ev", "gv", "scores")
    rows = rows.unionByName(left(truth, "gt_id").select(none.alias("ev"), F.col("values").alias("gv")), allowMissingColumns=True)
    rows = rows.unionByName(left(extracted, "ext_id").select(F.col("values").alias("ev"), none.alias("gv")), allowMissingColumns=True)
    cell = lambda i, f: F.struct(F.lit(f).alias("field"), F.try_element_at("ev", F.lit(f)).alias("e"), F.try_element_at("gv", F.lit(f)).alias("g"), F.try_element_at("scores", F.lit(i + 1)).alias("score"))
    cells = rows.select(F.explode(F.array(*[cell(i, f) for i, f in enumerate(required)])).alias("c")).select("c.*")
    e, g, right = ~norm.is_empty(F.col("e")), ~norm.is_empty(F.col("g")), F.coalesce(F.col("score"), F.lit(0.0)) >= TRUE_AT
    counts = {"gt_count": g, "extracted_count": e, "matched": e & g & right, "missing": g & ~e, "incorrect": e & g & ~right, "extra": e & ~g}
    return cells.groupBy("field").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def value_kappa(matches: DataFrame, exact: list[str], *by: str) -> DataFrame:
    """(by..., n, kappa) over the exact fields that both records of a match have; NaN where one label is all there is.

    Labels are field::value. Marginals come from the small table of label pairs, counted once.
    """
    label = lambda m, f: F.concat(F.lit(f"{f}::"), F.lower(norm.strip(F.coalesce(F.try_element_at(m, F.lit(f)), F.lit("none")))))
    both = [F.when(F.map_contains_key("ev", f) & F.map_contains_key("gv", f), F.struct(label("ev", f).alias("a"), label("gv", f).alias("b"))) for f in exact]
    labels = matches.select(*by, F.explode(F.array(*both)).alias("l")).filter("l is not null")
    cells = labels.groupBy(*by, "l.a", "l.b").agg(F.count("*").alias("c"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("c").alias("c1"), F.lit(0).alias("c2"), F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0).alias("same")), F.struct(F.col("b").alias("v"), F.lit(0).alias("c1"), F.col("c").alias("c2"), F.lit(0).alias("same")))).alias("s"))
    each = sides.groupBy(*by, "s.v").agg(*[F.sum(f"s.{x}").alias(x) for x in ("c1", "c2", "same")])
    total = each.groupBy(*by).agg(F.sum("c1").alias("n"), F.sum("same").alias("same"), F.sum(F.col("c1") * F.col("c2")).alias("cross"))
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return total.select(*by, "n", F.when(pe == 1, F.lit(float("nan"))).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def evaluated(extracted: DataFrame, truth: DataFrame, required: list[str], exact: list[str], semantic: tuple[str, ...] = ()) -> DataFrame:
    """All metrics of each study: record metrics, completeness and kappa (0 where no field was compared)."""
    matches = matched(compared(extracted, truth, required, semantic))
    have = sum((F.map_contains_key("values", f).cast("int") for f in required), F.lit(0))
    complete = extracted.groupBy("study").agg((F.sum(have) / (F.count("*") * len(required))).alias("completeness"))
    out = record_metrics(extracted, truth, matches).join(complete, "study", "left").join(value_kappa(matches, exact, "study").select("study", "kappa"), "study", "left")
    return out.fillna(0.0, ["completeness"]).withColumn("kappa", F.coalesce("kappa", F.lit(0.0)))


def error_contribution(counts: DataFrame) -> DataFrame:
    """(kind, n, pct): how much missing, incorrect and extra values make up of all errors."""
    kinds = ("missing", "incorrect", "extra")
    total = counts.agg(*[F.sum(k).alias(k) for k in kinds])
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("r"), sum((F.col(k) for k in kinds), F.lit(0)).alias("all"))
    return rows.select("r.kind", "r.n", norm.half_even(_ratio(F.col("r.n") * 100.0, F.col("all")), 2).alias("pct"))


def by_type(counts: DataFrame, kind: Column) -> DataFrame:
    """(kind, gt_count, matched, missing, incorrect, and their percent of gt_count) by the type of a field."""
    sums = counts.groupBy(kind.alias("kind")).agg(*[F.sum(c).alias(c) for c in ("gt_count", "matched", "missing", "incorrect")])
    return sums.select("*", *[norm.half_even(_ratio(F.col(c) * 100.0, F.col("gt_count")), 2).alias(f"{c}_pct") for c in ("matched", "missing", "incorrect")])


def worst(counts: DataFrame, n: int, by: str = "errors") -> DataFrame:
    """(field, errors): the n fields with most extra values, or with most missing and incorrect ones among those the truth has."""
    if by == "extra":
        rows = counts.select("field", F.col("extra").alias("errors")).filter("errors > 0")
    else:
        rows = counts.filter("gt_count > 0").select("field", (F.col("missing") + F.col("incorrect")).alias("errors"))
    return rows.orderBy(F.desc("errors"), "field").limit(n)


def with_metric(pairs: DataFrame, metric, schema: str = "double") -> DataFrame:
    """`pairs` with `metric`, a caller's function of (ev, gv) pandas columns of JSON texts: the place for one's own measure."""
    measure = F.pandas_udf(metric, schema)
    return pairs.withColumn("metric", measure(F.to_json("ev"), F.to_json("gv")))


def assign_pairs(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The one-to-one part of (left, right, weight) with the largest total weight; pairs left out weigh nothing.

    Every free left node bids the same, at first the largest weight. At each price level as many nodes as possible are
    matched along tight pairs; where no path is left, the bids of all nodes reached fall, and the prices of what they
    reached rise, by the least that makes another pair tight. It ends when a free node would bid nothing. Memory and a
    level's work are in proportion to the pairs. Weights count as multiples of a billionth.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    for i, j, w in sorted(pairs):
        out.setdefault(i, []).append((j, round(w * 1_000_000_000)))
    top = max((w for edges in out.values() for _, w in edges), default=0)
    bid, price = dict.fromkeys(out, top), {j: 0 for edges in out.values() for j, _ in edges}
    to: dict[int, int] = {}
    owner: dict[int, int] = {}
    free, level = list(out), top
    while free and level > 0:
        while True:  # passes; the nodes that a pass without a path has reached bound the next level
            reached, seen, grown = set(), set(), False
            for start in free:
                stack, path = [(start, iter(out[start]))], []
                reached.add(start)
                while stack:
                    i, edges = stack[-1]
                    for j, w in edges:
                        if j in seen or bid[i] + price[j] != w:
                            continue
                        seen.add(j)
                        path.append(j)
                        if j in owner:
                            stack.append((owner[j], iter(out[owner[j]])))
                            reached.add(owner[j])
                        else:
                            for (k, _), j in zip(stack, path):
                                to[k], owner[j] = j, k
                            stack, grown = [], True
                        break
                    else:
                        stack.pop()
                        if path:
                            path.pop()
            free = [i for i in free if i not in to]
            if not grown:
                break
        fall = min((bid[i] + price[j] - w for i in reached for j, w in out[i] if j not in seen), default=level)
        fall = min(fall, level)
        for i in reached:
            bid[i] -= fall
        for j in seen:
            price[j] += fall
        level -= fall
    return sorted(to.items())


def assign(weights: list[list[float]]) -> list[tuple[int, int]]:
    """The same for a whole matrix of weights."""
    return assign_pairs([(i, j, w) for i, row in enumerate(weights) for j, w in enumerate(row) if w > 0])


def quality(rows: DataFrame, column: str) -> DataFrame:
    """Each row's kind (empty, nr, invalid_json, substantive) and its score 0, 0.7, 0 or 1."""
    c = F.col(column)
    text = norm.norm(c)
    kind = F.when(c.isNull() | text.isin("", "{}", "[]"), "empty").when(text.isin("nr", "n/r", "not reported"), "nr").when(F.try_parse_json(c).isNull(), "invalid_json").otherwise("substantive")
    out = rows.withColumn("kind", kind).drop(column)
    return out.withColumn("score", F.when(F.col("kind") == "substantive", 1.0).when(F.col("kind") == "nr", 0.7).otherwise(0.0))


def completeness(records: DataFrame, values: str, required: list[str]) -> DataFrame:
    """Share of required keys that records have, empty or not."""
    have = sum((F.map_contains_key(values, f).cast("int") for f in required), F.lit(0))
    return records.agg((F.sum(have) / (F.count("*") * len(required))).alias("completeness"))


def details(extracted: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """(classification, key, extracted, truth): TP for equal pairs, FP for wrong or unmatched extractions, FN for missed truth."""
    a, b = extracted.withColumnRenamed(value, "extracted").withColumn("_a", F.lit(1)), truth.withColumnRenamed(value, "truth").withColumn("_b", F.lit(1))
    kind = F.when(F.col("_a").isNull(), "FN").when(F.col("_b").isNull(), "FP").when(score(F.col("extracted"), F.col("truth")) >= TRUE_AT, "TP").otherwise("FP")
    return a.join(b, key, "full_outer").select(kind.alias("classification"), key, "extracted", "truth")


def group_items(values: Column, prefix: str, fields: list[str], slots: int) -> Column:
    """Array of (slot, item) of a record's numbered groups, keys prefix_{slot}_{field}: those with any value that counts as true."""
    each = F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: F.struct(i.alias("slot"), F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.try_element_at(values, F.concat(F.lit(f"{prefix}_"), i.cast("string"), F.lit(f"_{f}"))) for f in fields])).alias("item")))
    return F.filter(each, lambda x: F.exists(F.map_values(x["item"]), lambda v: F.coalesce(v != "", F.lit(False))))


def aligned_groups(pairs: DataFrame, prefix: str, keys: list[str], fields: list[str], slots: int) -> DataFrame:
    """`pairs` (ev, gv, ...) with the extracted record's group slots renamed after the true ones that they match.

    Groups are matched one to one by their key fields' mean score, over a half; unmatched ones take the free slots in
    order. Similarities are SQL; only the assignment of a handful of slots runs in Python. Prefixes hold no underscore.
    """
    name = lambda f: F.lit(f"{prefix}_1_{f}")
    alike = lambda a, b: sum((score(a["item"][f], b["item"][f], name(f)) for f in keys), F.lit(0.0)) / len(keys)
    out = pairs.withColumn("_e", group_items(F.col("ev"), prefix, fields, slots)).withColumn("_g", group_items(F.col("gv"), prefix, fields, slots))
    out = out.withColumn("_sims", F.transform("_e", lambda a: F.transform("_g", lambda b: alike(a, b))))

    out = out.withColumn("_names", F.map_keys("ev")).withColumn("_e", F.col("_e.slot")).withColumn("_g", F.col("_g.slot"))

    def renamed(names, ext, gt, sims):
        found = [(i, j) for i, j in assign(sims) if sims[i][j] > 0.5] if ext and gt else []
        to = {ext[i]: gt[j] for i, j in found}
        if found:
            free = [k for k in range(1, slots + 1) if k not in to.values()]
            to |= dict(zip([k for k in ext if k not in to], free))
        cut = [re.fullmatch(rf"({re.escape(prefix)}_)(\d+)(_.*)", n, re.S) for n in names]
        return [f"{m[1]}{to.get(int(m[2]), m[2])}{m[3]}" if m else n for m, n in zip(cut, names)]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_names", "_e", "_g", "_sims")))
            yield batch.append_column("_new", pa.array([renamed(*r) for r in rows], pa.list_(pa.string())))

    named = out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("_new", T.ArrayType(T.StringType()))]))
    return named.withColumn("ev", F.map_from_arrays("_new", F.map_values("ev"))).drop("_names", "_e", "_g", "_sims", "_new")
