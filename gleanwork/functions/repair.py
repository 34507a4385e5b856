"""JSON that a model wrote almost right."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = re.compile(r"[\"']?([A-Za-z_][\w.]*)[\"']?\s*:\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|-?\d+(?:\.\d+)?|true|false|null)")


def unfenced(c: Column) -> Column:
    """Without the code fence around it."""
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def mended(text: str | None) -> str | None:
    """Text whose quotes and trailing commas are put right, or else its key/value pairs; null if there are none."""
    if text is None:
        return None
    tried = re.sub(r",\s*([}\]])", r"\1", text)
    for candidate in (tried, re.sub(r"(?<=[{\[,:\s])'|'(?=\s*[}\],:])", '"', tried)):
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            pass
    pairs = {}
    for key, value in PAIR.findall(text):
        pairs[key] = value[1:-1] if value[0] in "\"'" else json.loads(value)
    return json.dumps(pairs) if pairs else None


@F.pandas_udf(T.StringType())
def mend(texts: pd.Series) -> pd.Series:
    return texts.map(mended, na_action="ignore")


def parsed(c: Column) -> Column:
    """Valid JSON as it is, in SQL alone; only what isn't valid goes through the repair."""
    plain = unfenced(c)
    return F.when(F.try_parse_json(plain).isNotNull(), plain).otherwise(mend(plain))
