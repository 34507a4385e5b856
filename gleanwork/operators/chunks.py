"""Chunks of source texts, and snippets that stand in them only roughly."""

from __future__ import annotations

import re
from itertools import repeat
from math import floor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import collapse
from .linking import page_of, pages_in, searchable, section_before

#: Similarity from which a rough hit counts, length ratios outside which a chunk is passed over, most characters of a matched text. Fixed values.
ROUGH_AT, TOO_LONG, MOST_SHOWN = 0.65, 3, 500
SEPARATOR = re.compile(r"[|\-\s:]+")


def chunks_of(text: str, pages: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, page) of each page (page, start, end): paragraphs between blank lines.

    A paragraph with two bars is a table; the table and each of its rows are chunks, but for rows of rules alone.
    """
    out = []
    for page, first, last in pages:
        at = first
        for part in [*re.finditer(r"\n\n+", text[first:last]), None]:
            end = first + part.start() if part else last
            body = text[at:end]
            if body.strip():
                table = body.count("|") >= 2
                out.append(("table" if table else "paragraph", at, end, page))
                pos = at
                for row in body.split("\n") if table else ():
                    if row.strip() and not SEPARATOR.fullmatch(row.strip()):
                        out.append(("row", pos, pos + len(row), page))
                    pos += len(row) + 1
            at = first + part.end() if part else last
    return out


def chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, kind, page, start_char, end_char, text), offsets in code points; a null text has no chunks."""
    schema = "doc_id long, chunk_no int, kind string, page int, start_char long, end_char long, text string"

    def run(batches):
        for batch in batches:
            for doc, text, pages in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "pages"))):
                rows = [(doc, i, k, p, a, b, text[a:b].strip()) for i, (k, a, b, p) in enumerate(chunks_of(text, [(p["page"], p["start_char"], p["end_char"]) for p in pages]))]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "chunk_no", "kind", "page", "start_char", "end_char", "text"])

    return documents.filter("text is not null").select("doc_id", "text", pages_in(F.col("text")).alias("pages")).mapInArrow(run, schema)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors: one addition a character of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def partial_ratio(short: str, long: str, least: float = 0.0) -> float:
    """Best similarity 2 * common / (m + n) of the shorter text with any window of at most its length in the longer one.

    All windows count, those cut off at the ends too; a result below `least` only says that none reaches it. A row of
    bit vectors that goes on past its window bounds all windows that it covers, so as many of them are passed over as
    it takes to pass the best so far. A step of the window adds at most one common character and takes away at most
    one of its length, which bounds the next ones where texts are alike.
    """
    if len(short) > len(long):
        short, long = long, short
    m, n = len(short), len(long)
    if not m:
        return 0.0
    best, bar = 0.0, max(least - 1e-12, 0.0)
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    full, find, none = (1 << m) - 1, masks.get, repeat(0)

    for word in re.finditer(r"\w{6,}", short):  # a likely place first: the higher the bar, the more it rules out
        hit = long.find(word[0])
        if hit >= 0:
            end = min(n, max(1, hit - word.start() + m))
            window = long[max(0, end - m) : end]
            best = 2 * common_length(short, window) / (m + len(window))
            bar = max(bar, best)
            break

    # windows cut off at the start are the starts of one row, those at the end the starts of one row of both reversed
    for text, by in ((long[: m - 1], find), (long[: n - m : -1], {c: int(f"{x:0{m}b}"[::-1], 2) for c, x in masks.items()}.get)):
        s = full
        for size, mask in enumerate(map(by, text, none), 1):
            u = s & mask
            s = (s + u | s - u) & full
            if 2 * size / (m + size) > bar:  # all of it would have to be common
                ratio = 2 * (m - s.bit_count()) / (m + size)
                if ratio > best:
                    best, bar = ratio, max(bar, ratio)

    row = list(map(find, long, none)) if bar < 1 else []
    start = 0  # of the first window that is not ruled out
    while start <= n - m and bar < 1:
        s, at = full, start
        most = floor(bar * m)  # common characters of a whole window that don't pass the bar
        while 2 * (most + 1) / (2 * m) <= bar:
            most += 1
        while 2 * most / (2 * m) > bar:
            most -= 1
        for mask in row[at : at + m]:
            u = s & mask
            s = s + u | s - u  # carries above the short text's bits do no harm
        at += m
        common = m - (s & full).bit_count()
        step = 1
        if common > most:
            best = 2 * common / (2 * m)
            bar = max(bar, best)
            most = common
        else:
            step = max(1, int((bar * 2 * m - 2 * common) / (2 + bar)))
        while common <= most and at < n:  # a character adds one at most: as many are taken as can't pass `most` by more
            ahead = most + 1 - common
            for mask in row[at : at + ahead]:
                u = s & mask
                s = s + u | s - u
            at = min(n, at + ahead)
            s &= full
            common = m - s.bit_count()
        start = n if common <= most else max(start + step, at - m)
    return best


def nearest_chunk(snippet: str, parts: list[tuple[str, int, int, int]], at: float = ROUGH_AT) -> tuple[int, int, float, str] | None:
    """(start, end, similarity, text) of the chunk, or else of the pair of neighbouring chunks, that holds a snippet roughly.

    `parts` are (text, start, end, page). Chunks under a third of the snippet are passed over; pairs are tried only if no
    chunk reaches `at`, and only on the same page or on neighbouring ones.
    """
    best, found = 0.0, None
    for text, start, end, _ in parts:
        ratio = len(snippet) / max(len(text), 1)
        if text and not (ratio > 5 and len(snippet) > len(text) * TOO_LONG):
            score = partial_ratio(snippet, text, max(at, best))
            if score > best:
                best, found = score, (start, end, score, text)
    if best < at:
        for (a, start, _, page), (b, _, end, other) in zip(parts, parts[1:]):
            if abs(page - other) <= 1:
                score = partial_ratio(snippet, f"{a} {b}", max(at, best))
                if score > best:
                    best, found = score, (start, end, score, f"{a} {b}")
    return found if found and best >= at else None


def _matched(snippets: DataFrame, documents: DataFrame, at: float) -> DataFrame:
    """`snippets` with _text, _pages and _hit (start, end, confidence, matched), null if not found; one join, one pass of the texts."""
    rows = snippets.join(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), "doc_id", "left")
    rows = rows.withColumn("_clean", F.when(searchable(F.col("snippet")), collapse(F.col("snippet"))))
    at_char = F.expr("instr(_text, _clean)") - 1
    whole = F.struct(at_char.alias("start"), (at_char + F.length("_clean")).alias("end"), F.lit(1.0).alias("confidence"), F.col("_clean").alias("matched"))
    rows = rows.withColumn("_pages", pages_in(F.col("_text"))).withColumn("_whole", F.when(at_char >= 0, whole))

    @F.pandas_udf("start int, end int, confidence double, matched string")
    def rough(clean: pd.Series, text: pd.Series, pages: pd.Series) -> pd.DataFrame:
        out = []
        for snippet, whole, marks in zip(clean, text, pages):
            hit = None
            if snippet is not None and whole:
                parts = chunks_of(whole, [(p["page"], p["start_char"], p["end_char"]) for p in marks])
                hit = nearest_chunk(snippet, [(whole[a:b].strip(), a, b, page) for _, a, b, page in parts], at)
            out.append(hit or (None, None, None, None))
        return pd.DataFrame(out, columns=["start", "end", "confidence", "matched"]).astype({"start": "Int32", "end": "Int32"})

    left = F.col("_whole").isNull() & F.col("_clean").isNotNull() & F.col("_text").isNotNull()
    pages = F.when(left, F.col("_pages")).otherwise(F.array().cast("array<struct<page:int,start_char:int,end_char:int>>"))  # a null among them makes pandas' numbers floats
    # as if not deterministic: a filter on its outcome would run it a second time
    rows = rows.withColumn("_rough", rough.asNondeterministic()(F.when(left, F.col("_clean")), F.when(left, F.col("_text")), pages))
    return rows.withColumn("_hit", F.coalesce("_whole", F.when(F.col("_rough.start").isNotNull(), F.col("_rough")))).drop("_clean", "_whole", "_rough")


def located(snippets: DataFrame, documents: DataFrame, at: float = ROUGH_AT) -> DataFrame:
    """`snippets` (doc_id, snippet, ...) with `location`: page, start_char, end_char, matched_text, confidence, section; null if not found.

    A snippet is looked for in its own document (doc_id, text): as it stands, in SQL; only what isn't found so is compared
    with the text's chunks. Snippets that are too short or say that nothing was reported have no location.
    """
    both = _matched(snippets, documents, at)
    place = F.struct(
        page_of(F.col("_pages"), F.col("_hit.start")).alias("page"), F.col("_hit.start").cast("long").alias("start_char"), F.col("_hit.end").cast("long").alias("end_char"),
        F.substring("_hit.matched", 1, MOST_SHOWN).alias("matched_text"), F.col("_hit.confidence").alias("confidence"), section_before(F.col("_text"), F.col("_hit.start")).alias("section"),
    )
    return both.withColumn("location", F.when(F.col("_hit").isNotNull(), place)).drop("_text", "_pages", "_hit")


def enriched(results: DataFrame, documents: DataFrame) -> DataFrame:
    """`results` (result_id, doc_id, values, ...) with source locations in `values`, a map of texts.

    A key x.source_text gets a neighbour x.source_location; a value that is an object with value and source_text gets
    source_location inside. Locations are JSON texts; everything else stays.
    """
    entries = results.select("result_id", "doc_id", F.explode("values").alias("key", "value"))
    inner = F.from_json("value", "map<string,string>")
    nested = F.coalesce(F.map_contains_key(inner, "source_text") & F.map_contains_key(inner, "value"), F.lit(False))
    flat = F.col("key").endswith(".source_text")
    snippet = F.when(nested, F.try_element_at(inner, F.lit("source_text"))).when(flat, F.col("value"))
    wanted = entries.withColumn("snippet", snippet).withColumn("nested", nested).filter("snippet is not null")
    found = located(wanted, documents).filter("location is not null")
    text = F.to_json("location")
    put = F.when(F.col("nested"), F.struct(F.col("key"), F.concat(F.regexp_replace("value", r"\}\s*$", ""), F.lit(',"source_location":'), text, F.lit("}")).alias("value")))
    put = put.otherwise(F.struct(F.regexp_replace("key", r"\.source_text$", ".source_location").alias("key"), text.alias("value")))
    new = found.groupBy("result_id").agg(F.map_from_entries(F.collect_list(put)).alias("_new"))
    out = results.join(new, "result_id", "left")
    kept = F.map_filter("values", lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    return out.withColumn("values", F.when(F.col("_new").isNull(), F.col("values")).otherwise(F.map_concat(kept, "_new"))).drop("_new")


def page_index(located_fields: DataFrame) -> DataFrame:
    """(doc_id, page, entries): for each page the (field, start_char, end_char, text) of the values found on it, in order of place."""
    hits = located_fields.filter("location is not null").select("doc_id", F.col("location.page").alias("page"), F.struct(F.col("location.start_char").alias("start_char"), F.col("location.end_char").alias("end_char"), "field", F.col("location.matched_text").alias("text")).alias("e"))
    return hits.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("e")).alias("entries"))


def locate_rough(documents: DataFrame, snippets: DataFrame, at: float = ROUGH_AT) -> DataFrame:
    """(doc_id, item_id, confidence, start_char, end_char) of the snippets (doc_id, item_id, snippet) that their own document holds, exactly or roughly."""
    found = _matched(snippets, documents, at).filter("_hit is not null")
    return found.select("doc_id", "item_id", "_hit.confidence", F.col("_hit.start").cast("long").alias("start_char"), F.col("_hit.end").cast("long").alias("end_char"))
