"""Normalisation as Column functions: the one place that says when two values count as the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels that mean "nothing was reported"; fixed values.
EMPTY = ("", "none", "n/a", "na", "not reported", "not available", "nr", "unknown", "unclear")
#: What counts as false when a value is asked for its truth.
FALSY = ("", "0", "0.0", "false", "[]", "{}")
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Stripped and lower-cased text."""
    return F.lower(strip(c.cast("string")))


def agree(a: Column, b: Column) -> Column:
    """Review agreement: equal after normalising; two nulls agree, a null and a value don't."""
    return norm(a).eqNullSafe(norm(b))


def match_truthy(a: Column, b: Column) -> Column:
    """Comparison match: both truthy and equal after normalising; 0, false and '' never match."""
    truthy = lambda c: c.isNotNull() & ~norm(c).isin(*FALSY)
    return F.coalesce(truthy(a) & truthy(b) & (norm(a) == norm(b)), F.lit(False))


def both_agree(a: Column, b: Column) -> Column:
    """Consensus agreement: both present and equal after normalising."""
    return F.coalesce(norm(a) == norm(b), F.lit(False))


def is_empty(c: Column) -> Column:
    return c.isNull() | norm(c).isin(*EMPTY)


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def to_number(c: Column) -> Column:
    """Double of a plain decimal text, else null: stricter than a cast, which also takes '12d'."""
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


#: Endings of fields that the evaluator compares as whole numbers; fixed values.
NUMERIC_ENDINGS = ("_n", "_percent", "_tendency", "_variability", "_randomized")


def whole_number(text: Column) -> Column:
    """A number as text rounded half-even to a whole one; other texts as they are."""
    return F.coalesce(F.when(text.rlike(NUMBER), F.bround(text.try_cast("double"), 0).try_cast("decimal(38,0)").cast("string")), text)


def range_form(text: Column) -> Column:
    """Hyphens and commas, with the blanks around them, as plain commas."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*-\s*", ","), r"\s*,\s*", ",")


def evaluator_value(c: Column, field: Column) -> Column:
    """The evaluator's form of a value; null is ''. Endings, `filename` and `range` in the field's name, whatever its case, say how.

    Numeric fields are rounded half-even, file names lose leading underscores, ranges are put in commas; end marks go last.
    """
    base, name = F.coalesce(F.lower(collapse(c.cast("string"))), F.lit("")), F.lower(field)
    numeric = F.lit(False)
    for ending in NUMERIC_ENDINGS:
        numeric = numeric | name.endswith(ending)
    form = F.when(numeric, whole_number(base)).when(name.contains("filename"), F.regexp_replace(base, "^_+", "")).when(name.contains("range"), range_form(base)).otherwise(base)
    return F.regexp_replace(form, r"[.,;]+$", "")


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w\-.]", "_")


def class_name(c: Column) -> Column:
    """PascalCase of the words; letters after the first stay as they are."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^a-zA-Z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def field_key(c: Column) -> Column:
    """snake_case key: parenthesised text goes, a percent sign is spelt out, the rest becomes underscores."""
    plain = F.regexp_replace(F.lower(c), r"\(\s*%\s*\)|%", " percent ")
    plain = F.regexp_replace(plain, r"\([^)]*\)", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def half_even(c: Column, digits: int) -> Column:
    """Rounded half-even without a negative zero."""
    return F.bround(c, digits) + F.lit(0.0)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


DATE_FORMATS = {"ISO": "yyyy-MM-dd", "US": "MM/dd/yyyy", "EU": "dd/MM/yyyy", "Long": "MMMM d, yyyy"}


def export_date(c: Column, style: str) -> Column:
    return F.date_format(c, DATE_FORMATS[style])


def iso_time(c: Column) -> Column:
    """Timestamp of an ISO text, else null; guarded, since a cast also takes '2024' and '2024-1-2'."""
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(ok, F.try_to_timestamp(c))
