"""Shapes of JSON values, and names made from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = "map<string,string>"


def final_values(resolutions: Column) -> Column:
    """The final_value of each resolution in a map of JSON texts; those that are no objects are left out."""
    objects = F.map_filter(resolutions, lambda _, v: F.coalesce(F.from_json(v, TEXTS).isNotNull() & F.trim(v).startswith("{"), F.lit(False)))
    return F.transform_values(objects, lambda _, v: F.get_json_object(v, "$.final_value"))


def unwrapped(json: Column) -> Column:
    """A record out of its wrapping: what stands under `results`, if anything does, and the one element of a list of one."""
    inner = F.when(F.trim(json).startswith("{"), F.get_json_object(json, "$.results"))
    value = F.coalesce(inner, json)
    listed = F.from_json(value, "array<string>")
    return F.when(F.trim(value).startswith("[") & (F.size(listed) == 1), listed[0]).otherwise(value)


def fanned_out(json: Column, key: str) -> Column:
    """The records of a document that holds a list of them: each element with the document's other fields."""
    rest = F.map_filter(F.from_json(json, TEXTS), lambda k, _: k != key)
    each = F.coalesce(F.from_json(F.get_json_object(json, f"$.{key}"), "array<string>"), F.expr("cast(array() as array<string>)"))

    def one(e):
        own = F.from_json(e, TEXTS)
        return F.map_concat(F.map_filter(rest, lambda k, _: ~F.map_contains_key(own, k)), own)

    return F.transform(each, one)


def with_flag(comments: Column, name: Column, flag: str, value: Column) -> Column:
    """A map of structs with one field of one entry set; without that entry, the map as it is."""
    return F.transform_values(comments, lambda k, v: F.when(k == name, v.withField(flag, value)).otherwise(v))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def call_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def task_id(name: Column) -> Column:
    return F.substring(F.md5(name), 1, 8)


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def output_name(path: Column, schema: str = "") -> Column:
    """Name of the output of a source file: its stem, without the mark of a Markdown file, and the schema's name."""
    return F.concat(F.regexp_replace(stem(path), "_md$", ""), F.lit(f"_{schema}.json" if schema else ".json"))


def unique_name(content: Column) -> Column:
    """Name that a content alone decides: sixteen digits of its hash, with the mark of a Markdown file."""
    return F.concat(F.substring(content_hash(content), 1, 16), F.lit("_md"))


def overlaps(name: Column, text: Column, most: int = 5) -> Column:
    """Whether half (rounded down) of the first words of over four letters stand in a text, whatever the case; true without such words."""
    words = F.slice(F.filter(F.split(F.lower(name), r"\s+"), lambda w: F.length(w) > 4), 1, most)
    found = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))
    return found >= F.floor(F.size(words) / 2)


def seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, two places."""
    return F.bround((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)
