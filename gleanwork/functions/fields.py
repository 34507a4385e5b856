"""Extracted values: JSON text to long rows and back."""

from __future__ import annotations

import json as json_module

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META_KEYS = ("document_id", "form_id", "extraction_id", "extraction_type", "id", "job_id", "project_id", "created_at", "metadata")
SUFFIXES = (".confidence", ".reasoning")


def as_map(json: Column) -> Column:
    """Top-level keys to their text; numbers keep the text they were written with. Null for what is no object."""
    return F.from_json(json, "map<string,string>")


def strip_value_suffix(m: Column) -> Column:
    """Keys `x.value` as `x`, if there are any; else the map as it is."""
    valued = F.map_filter(m, lambda k, _: k.endswith(".value"))
    renamed = F.transform_keys(valued, lambda k, _: F.regexp_replace(k, r"\.value$", ""))
    return F.when(F.size(valued) > 0, renamed).otherwise(m)


def export_fields(m: Column, confidence: bool = True, metadata: bool = True) -> Column:
    """Without metadata keys, confidence and reasoning keys and source locations, as the settings say."""
    out = F.map_filter(m, lambda k, _: ~k.endswith(".source_location"))
    if not confidence:
        out = F.map_filter(out, lambda k, _: ~(k.endswith(SUFFIXES[0]) | k.endswith(SUFFIXES[1])))
    if not metadata:
        out = F.map_filter(out, lambda k, _: ~F.lower(k).isin(*META_KEYS))
    return out


def field_values(results: DataFrame, *keep: str, json: str = "extracted_data") -> DataFrame:
    """(keep..., field, value): one row a field."""
    return results.select(*keep, F.explode(as_map(F.col(json))).alias("field", "value"))


def wide(values: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long rows to one column a field, in sorted order, missing ones empty."""
    out = values.groupBy(*keys).pivot("field", sorted(fields)).agg(F.first("value"))
    return out.fillna("", subset=sorted(fields))


def flat(json: Column, opaque: str = "source_location") -> Column:
    """Map of dotted paths to text, objects opened at every depth; a key named `opaque` keeps its object as it is.

    One level is opened by SQL alone; only texts with an object inside an object go through the walk of all levels.
    Null for what is no object.
    """
    top = as_map(json)
    nested = F.exists(F.map_values(top), lambda v: F.coalesce(v.rlike(r"^\s*\{"), F.lit(False)))
    return F.when(top.isNull() | ~nested, top).otherwise(_flat_all(json, F.lit(opaque)))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _flat_all(texts: pd.Series, opaque: pd.Series) -> pd.Series:
    def walk(value, path, out, stop):
        todo = [(path, value)]
        while todo:
            path, value = todo.pop()
            for key, inner in value.items():
                name = f"{path}.{key}" if path else key
                if isinstance(inner, dict) and inner and key != stop:
                    todo.append((name, inner))
                elif inner is None or isinstance(inner, str):
                    out[name] = inner
                else:
                    out[name] = json_module.dumps(inner, ensure_ascii=False, separators=(",", ":"))
        return out

    def one(text, stop):
        try:
            value = json_module.loads(text)
        except (TypeError, ValueError):
            return None
        return walk(value, "", {}, stop) if isinstance(value, dict) else None

    return pd.Series([one(t, s) for t, s in zip(texts, opaque)], dtype=object)


def flat_columns(json: Column) -> Column:
    """Paths joined by underscores, lists of scalars joined by ', ': the form of a CSV export."""
    paths = F.map_entries(flat(json, ""))
    text = lambda v: F.when(v.rlike(r"^\s*\["), F.coalesce(F.array_join(F.from_json(v, "array<string>"), ", "), v)).otherwise(v)
    return F.map_from_entries(F.transform(paths, lambda e: F.struct(F.regexp_replace(e["key"], r"\.", "_").alias("key"), text(e["value"]).alias("value"))))


def all_keys(*maps: Column) -> Column:
    """The sorted union of the maps' keys."""
    keys = F.map_keys(maps[0])
    for m in maps[1:]:
        keys = F.array_union(keys, F.map_keys(m))
    return F.array_sort(keys)
