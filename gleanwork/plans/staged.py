"""Staged extraction: each stage sees the texts and the fields it needs, and adds the fields it provides.

The extractor is a provider: a Column function from text and earlier values to a map of values. The one
here looks fields up by pattern; a model call would take its place behind the same signature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import norm

Extractor = Callable[[Column, Column], Column]


def by_pattern(patterns: dict[str, str]) -> Extractor:
    """Fields by regular expression with one group; what isn't found is NR."""

    def extract(text: Column, known: Column) -> Column:
        found = [F.regexp_extract(text, p, 1) for p in patterns.values()]
        values = [F.when(v == "", F.lit("NR")).otherwise(v) for v in found]
        return F.map_from_arrays(F.array(*map(F.lit, patterns)), F.array(*values))

    return extract


def score(values: Column) -> Column:
    """Mean worth of a map's values: 1 for a value, 0.7 for NR, 0 for an empty one."""
    worth = F.transform(F.map_values(values), lambda v: F.when(v.isNull() | norm.norm(v).isin("", "{}", "[]"), 0.0).when(norm.norm(v).isin("nr", "n/r", "not reported"), 0.7).otherwise(1.0))
    return F.when(F.size(worth) > 0, F.aggregate(worth, F.lit(0.0), lambda a, b: a + b) / F.size(worth)).otherwise(F.lit(0.0))


def run_stages(papers: DataFrame, stages: list[dict], retry: Extractor | None = None) -> DataFrame:
    """`papers` (doc_id, text, ...) with `values`, the merged fields of all stages, later ones winning.

    A stage is {"extract": Extractor, "requires": [fields]}. If an attempt finds nothing, `retry` is tried,
    and the better of both is kept. A stage depends on the one before by its column alone.
    """
    out = papers.withColumn("values", F.expr("cast(map() as map<string,string>)"))
    for stage in stages:
        known = _only(F.col("values"), stage.get("requires", []))
        got = stage["extract"](F.col("text"), known)
        if retry is not None:
            again = retry(F.col("text"), known)
            got = F.when((score(got) <= 0.7) & (score(again) > score(got)), again).otherwise(got)
        keys = F.map_keys(got)
        kept = F.map_filter("values", lambda k, _: ~F.array_contains(keys, k))
        out = out.withColumn("values", F.map_concat(kept, got))
    return out


def _only(values: Column, fields: list[str]) -> Column:
    return F.map_filter(values, lambda k, _: k.isin(*fields))


def combined(main: Column, *parts: Column) -> Column:
    """What a combiner made of the parts; if it made nothing, the parts themselves, later ones winning."""
    merged = parts[0]
    for part in parts[1:]:
        merged = F.map_concat(_without(merged, part), part)
    return F.when(score(main) > 0, main).otherwise(merged)


def _without(values: Column, others: Column) -> Column:
    return F.map_filter(values, lambda k, _: ~F.map_contains_key(others, k))
