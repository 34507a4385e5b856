"""Controlled vocabularies: classes of synonyms, texts in canonical terms, and judgements that are kept for a while."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import norm
from ..plans.evaluate import pair_key
from ..storage import written

#: Terms that are counted as at most this many go to every task.
FEW = 50_000
#: Runs of words that a task hands on at once.
RUNS = 1 << 16
#: Characters of text that a task hands on at once.
CHARS = 1 << 24
#: Seconds that a judgement is kept; fixed value.
KEPT_S = 86_400


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase(text: Column) -> Column:
    return F.array_join(words(text), " ")


def classes(synonyms: DataFrame) -> DataFrame:
    """(term, canonical) of pairs (a, b) that mean the same: all terms that chains of pairs link, under the first in order.

    Terms count by their words. Each round a term takes the least canonical of its neighbours, and then that one's own,
    so the rounds grow with the logarithm of a chain. Terms without words, and nulls, are left out.
    """
    pairs = synonyms.select("a", "b").distinct().select(phrase(F.col("a")).alias("a"), phrase(F.col("b")).alias("b")).filter("a <> '' and b <> ''")
    ways = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"])
    edges = written(pairs.select(F.inline(ways)).distinct())
    label = written(edges.groupBy(F.col("a").alias("term")).agg(F.min("b").alias("canonical")))
    while True:
        near = edges.join(label.withColumnRenamed("term", "b"), "b").groupBy(F.col("a").alias("term")).agg(F.min("canonical").alias("_near"))
        own = label.select(F.col("term").alias("_near"), F.col("canonical").alias("_own"))
        new = written(near.join(own, "_near").join(label, "term").select("term", F.least("_near", "_own").alias("canonical"), (F.least("_near", "_own") < F.col("canonical")).alias("changed")))
        label = new.select("term", "canonical")
        if new.filter("changed").isEmpty():
            return label


def canonicalised(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, text, found): each text in words, with the terms (term, canonical) that it holds in their canonical form.

    Of terms that overlap the leftmost counts, and of those that start together the longest. Terms that are counted as
    few go to every task; otherwise texts are cut into runs of as many words as terms have, which meet the terms by an
    equi-join, and a text's hits are gathered again in one row. Either way a text is walked through once, in time and
    memory in proportion to its words. `key` must be unique. Null texts have no words.
    """
    terms = terms.select("term", "canonical", F.size(words(F.col("term"))).alias("_len"))
    n = terms.count()
    rows = texts.select(key, phrase(F.coalesce(F.col(text), F.lit(""))).alias(text))
    if not n:
        return rows.withColumn("found", F.lit(0))
    schema = T.StructType([rows.schema[key], T.StructField(text, T.StringType()), T.StructField("found", T.IntegerType())])
    if n <= FEW:
        lengths: dict[str, set[int]] = {}  # by the first word
        canon: dict[str, list[str | None]] = {}
        for r in terms.filter("_len > 0 and term is not null").toLocalIterator():  # few, as counted
            lengths.setdefault(r.term.split(" ")[0], set()).add(r._len)
            canon.setdefault(r.term, []).append(r.canonical)
        first = {word: sorted(found, reverse=True) for word, found in lengths.items()}
        canon = {term: None if None in found else min(found) for term, found in canon.items()}
        shared = texts.sparkSession.sparkContext.broadcast((first, canon))
        return rows.mapInArrow(partial(_replaced, partial(_found_here, shared)), schema)

    lengths = sorted(r._len for r in terms.filter("_len > 0").select("_len").distinct().collect())
    cut = T.StructType([rows.schema[key], *[T.StructField(c, T.IntegerType()) for c in ("start", "len")], T.StructField("term", T.StringType())])
    hits = rows.mapInArrow(partial(_runs, lengths), cut).join(terms.select("term", "canonical").hint("merge"), "term")
    gathered = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("len")).alias("neg"), "canonical"))).alias("_hits"))
    return rows.join(gathered, key, "left").mapInArrow(partial(_replaced, _found_before), schema)


def _runs(lengths: list[int], batches):
    """(key, start, len, term): the runs of each (key, text) that have one of the lengths, in batches of RUNS rows or a few more."""
    for batch in batches:
        for i, value in enumerate(batch.column(1).to_pylist()):
            w, step = value.split(" ") if value else [], max(1, RUNS // len(lengths))
            for a in range(0, len(w), step):
                rows = [(at, k, " ".join(w[at : at + k])) for at in range(a, min(a + step, len(w))) for k in lengths if at + k <= len(w)]
                if rows:
                    start, size, term = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(term, pa.string())], names=[batch.schema.names[0], "start", "len", "term"])


def _found_here(shared, batch, w, i):
    """(start, words, canonical) of terms in a text's words, the leftmost first and the longest first of those; no two overlap."""
    (lengths, canon), at = shared.value, 0
    while at < len(w):
        for k in lengths.get(w[at], ()):
            term = " ".join(w[at : at + k])
            if term in canon:
                yield at, k, canon[term]
                at += k - 1
                break
        at += 1


def _found_before(batch, w, i):
    """The same from the sorted hits of a row."""
    hits = batch.column(2)[i].values
    if hits is None:
        return
    at = 0
    for start, neg, canonical in zip(*(c.to_pylist() for c in hits.flatten())):
        if start >= at:
            yield start, -neg, canonical
            at = start - neg


def _replaced(found, batches):
    """(key, text, found) of (key, text, ...): texts with the terms that `found` gives in their canonical form; null ones leave no word."""

    def taken(batch, first, made):
        whole, n = zip(*made)
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(made)), pa.array(whole, pa.string()), pa.array(n, pa.int32())], names=[*batch.schema.names[:2], "found"])

    for batch in batches:
        first, made, size = 0, [], 0
        for i, value in enumerate(batch.column(1)):
            w, out, n, at = value.as_py().split(), [], 0, 0
            for start, k, canonical in found(batch, w, i):
                out += w[at:start]
                if canonical is not None:
                    out.append(canonical)
                n, at = n + 1, start + k
            made.append((" ".join(out + w[at:]), n))
            size += len(made[-1][0])
            if size > CHARS:
                yield taken(batch, first, made)
                first, made, size = i + 1, [], 0
        if made:
            yield taken(batch, first, made)


def in_canonical_terms(records: DataFrame, fields: list[str], terms: DataFrame) -> DataFrame:
    """Records (study, id, values) with the given fields' values in canonical terms, ready to be compared; others stay as they are."""
    each = records.select("study", "id", F.explode("values").alias("field", "value"))
    named = each.filter(F.col("field").isin(*fields) & ~norm.is_empty(F.col("value")))
    seen = written(named.select(F.col("value").alias("_raw")).distinct())
    by = canonicalised(seen.withColumn("_text", F.col("_raw")), "_raw", "_text", terms).filter("found > 0").select("_raw", "_text")
    new = named.join(by, F.col("value") == F.col("_raw")).groupBy("study", "id").agg(F.map_from_entries(F.collect_list(F.struct("field", "_text"))).alias("_new"))
    out = records.join(new, ["study", "id"], "left")
    return out.withColumn("values", F.when(F.col("_new").isNull(), F.col("values")).otherwise(F.transform_values("values", lambda k, v: F.coalesce(F.try_element_at("_new", k), v)))).drop("_new")


def judged(pairs: DataFrame, cache: DataFrame, judge, now: Column, kept_s: int = KEPT_S) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, field, ...) with `same`, the cache to keep): a pair that was judged within kept_s is not judged again.

    The cache is (pair, same, at). `judge` makes a Column of (a, b, field); each different pair is judged once, whichever
    way round it stands. Judgements that have expired fall out of the cache.
    """
    keyed = pairs.withColumn("pair", pair_key(F.col("a"), F.col("b"), F.col("field")))
    alive = cache.filter(F.col("at") > now - F.expr(f"interval {kept_s} seconds"))
    asked = keyed.join(alive, "pair", "left_anti").groupBy("pair").agg(F.min(F.struct("a", "b", "field")).alias("p"))
    new = written(asked.select("pair", judge(F.col("p.a"), F.col("p.b"), F.col("p.field")).alias("same"), now.cast("timestamp").alias("at")))
    keep = alive.select("pair", "same", F.col("at").cast("timestamp").alias("at")).union(new)
    return keyed.join(keep.select("pair", "same"), "pair", "left").drop("pair"), keep
