"""Phrase collocations by hierarchical pair naming.

Texts become blocks of ids: one id for each frequent word, 0 for what breaks a phrase. Two adjacent ids of frequent
(k-1)-word phrases make a k-word phrase; pairs are counted over all blocks, frequent ones get an id of their own, and
the blocks are rewritten with those ids for the next level, where what can't be in a longer phrase has gone. A name
points to its two parents, the phrases without the last and without the first word, and carries the counts of all its
beginnings and ends along, so that every cut's parts are known without a lookup, and a phrase that a longer one uses
up is found at its children.

Names go to the tasks as a broadcast while they are counted as few; beyond that, ids and names are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Longest phrase in words, least count of a candidate, phrases a language returns.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words (and bytes of them) up to which they are broadcast; of pairs twice as many.
NAMES, NAME_BYTES = 1_000_000, 1 << 26
#: Different words a task counts before it hands them on, ids it works on at once, ids from which a row ends at a break, bytes of text that are cut into words at once.
HELD, BLOCK, ROW, SLICE = 1 << 17, 1 << 18, 512, 1 << 20

_BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + _BREAK * 10)


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The text's words in slices, lower-cased, with _BREAK between pieces; a slice ends at a blank or a break."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        while end < len(raw) and raw[end] not in b" \t\xff":
            end += 1
        yield raw[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def language(value: str | None) -> str:
    return "und" if value is None else value


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts; the row whose word is null has the language's words in all."""

    def rows(held):
        lang, word, n = [], [], []
        for name, counts in held.items():
            total = counts.total() - counts.pop(_BREAK, 0)
            lang += [name] * (len(counts) + 1)
            word += [*counts, None]
            n += [*counts.values(), total]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                counts = held.setdefault(language(lang.as_py()), Counter())
                for part in tokens(text.as_py()):
                    counts.update(part)
                if sum(map(len, held.values())) > HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _few(names: DataFrame, size=None, most: int | None = None) -> bool:
    """Whether stored names are few enough to go to every task."""
    n, size = names.agg(F.count("*"), F.sum(size) if size is not None else F.lit(0)).first()
    return n <= (NAMES if most is None else most) and (size or 0) <= NAME_BYTES


BLOCKS = "ids array<bigint>"


def _rows(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch of packed ids, in rows that end at the first break after ROW ids. What is cut ends with a 0, so every row does.

    Short rows keep batches small that Spark bounds by their number of rows alone.
    """
    ids = packed(ids)
    if len(ids):
        breaks = np.flatnonzero(ids == 0)
        cuts = breaks[np.searchsorted(breaks, np.arange(ROW, len(ids) - 1, ROW))] + 1
        ends = np.unique(np.concatenate([[0], cuts, [len(ids)]])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["ids"])


def _parts(batches) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, first row, ends of rows from 0, ids): whole rows of `ids`, the last column, up to BLOCK ids or one row at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.num_columns - 1)
        ends, values, first = column.offsets.to_numpy(), column.values.to_numpy(), 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
            yield batch, first, ends[first : last + 1] - ends[first], values[ends[first] : ends[last]]
            first = last


def packed(ids: np.ndarray) -> np.ndarray:
    """Ids without those that have no neighbour, and with one 0 between runs."""
    some = np.concatenate([[False], ids > 0, [False]])
    keep = some[1:-1] & (some[:-2] | some[2:])
    after = np.concatenate([[False], keep[:-1]])
    return ids[keep | ~keep & after & (ids == 0)] if len(ids) else ids


def word_blocks(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks of word ids of whole texts. A block ends at a break once it is full."""
    if not _few(names, F.length("word")):
        return _joined_words(docs, names)
    numbers: dict[str, dict[bytes, int]] = {}
    for r in names.select("lang", "word", "id").toLocalIterator():  # few, as counted
        numbers.setdefault(r.lang, {})[bytes(r.word)] = r.id
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                find = shared.value.get(language(lang.as_py()), {}).get
                for part in tokens(text.as_py()):
                    held.append(np.fromiter(map(find, part, repeat(0)), np.int64, len(part)))
                    size += len(part)
                held.append(np.zeros(1, np.int64))
                if size >= BLOCK:
                    yield from _rows(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from _rows(np.concatenate(held))

    return docs.select("lang", "text").mapInArrow(run, BLOCKS)


def _joined_words(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The same where names are many: words as rows, joined to their names, and gathered again by text, or by part of a long one.

    Hot words make hot keys of a plain merge join, which Spark splits while it runs.
    """

    def run(batches):
        for batch in batches:
            for doc, lang, text in zip(batch.column("doc"), batch.column("lang"), batch.column("text")):
                at = piece = since = 0
                for part in tokens(text.as_py()):
                    n, pieces = len(part), []
                    for word in part:
                        pieces.append(piece)
                        since += 1
                        if word == _BREAK and since >= ROW:
                            piece, since = piece + 1, 0
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, pa.int64()), pa.array(pieces, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array([language(lang.as_py())] * n, pa.string()), pa.array(part, pa.binary())], names=["doc", "piece", "at", "lang", "word"])
                    at += n

    numbered = stored(docs.select(F.monotonically_increasing_id().alias("doc"), "lang", "text"))
    rows = numbered.mapInArrow(run, "doc long, piece int, at long, lang string, word binary")
    found = rows.join(names.select("lang", "word", "id").hint("merge"), ["lang", "word"], "left")
    return _gathered(found.select("doc", "piece", "at", F.coalesce("id", F.lit(0)).alias("id")))


def _gathered(found: DataFrame) -> DataFrame:
    """Blocks of (doc, piece, at, id), in order of at; a piece ends with a break."""

    def run(batches):
        for batch in batches:
            for ids in batch.column("ids"):
                yield from _rows(np.append(ids.values.to_numpy(), 0))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
    return found.groupBy("doc", "piece").agg(ordered.alias("ids")).select("ids").mapInArrow(run, BLOCKS)


def adjacent(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where, keys, kinds) of adjacent frequent ids: a pair's key is place in `kinds` of the left * len(kinds) + of the right."""
    kinds, place = np.unique(ids, return_inverse=True)
    where = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return where, place[where] * len(kinds) + place[where + 1], kinds


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(left, right, n) of all pairs of adjacent ids; a task sums its pairs before the shuffle."""

    def summed(held):
        ids = np.concatenate(held)
        _, keys, kinds = adjacent(ids)
        pairs, n = np.unique(keys, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds[pairs // len(kinds)]), pa.array(kinds[pairs % len(kinds)]), pa.array(n.astype(np.int64))], names=["left", "right", "n"])

    def run(batches):
        held, size = [], 0
        for _, _, _, ids in _parts(batches):
            held.append(ids.copy())  # so that the batch can go
            size += len(ids)
            if size >= 4 * BLOCK:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    return blocks.mapInArrow(run, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def renamed(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks with the ids of the pairs (left, right, id) in place of their left parents; other pairs become 0."""
    if not _few(names, most=2 * NAMES):  # 16 bytes each, where a word takes about 100
        return _joined_pairs(blocks, names)
    held = names.select("left", "right", "id").toArrow()  # few, as counted
    left, right, number = (held[c].to_numpy() for c in ("left", "right", "id"))
    known = np.unique(np.concatenate([left, right]))
    keys = np.searchsorted(known, left) * len(known) + np.searchsorted(known, right)
    order = np.argsort(keys)
    shared = blocks.sparkSession.sparkContext.broadcast((known, keys[order], number[order]))

    def run(batches):
        known, keys, number = shared.value
        for _, _, _, ids in _parts(batches) if len(known) else ():
            place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            there = known[place] == ids
            where = np.flatnonzero(there[:-1] & there[1:])
            pairs = place[where] * len(known) + place[where + 1]
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            out = np.zeros(len(ids), np.int64)
            out[where] = np.where(keys[at] == pairs, number[at], 0)
            yield from _rows(out)

    return blocks.mapInArrow(run, BLOCKS)


def _joined_pairs(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """The same where names are many: pairs as rows, joined to their names, and gathered again by block."""

    def run(batches):
        for batch, first, ends, ids in _parts(batches):
            size = np.diff(ends)
            docs = batch.column("doc").slice(first, len(size)).to_numpy()
            at = np.arange(len(ids)) - np.repeat(ends[:-1], size)
            keep = np.ones(len(ids), bool)
            keep[ends[1:] - 1] = False  # a row's last id is a 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.repeat(docs, size), np.zeros(len(ids), np.int32), at, ids, np.roll(ids, -1))], names=["doc", "piece", "at", "left", "right"])

    numbered = stored(blocks.filter("size(ids) > 0").select(F.monotonically_increasing_id().alias("doc"), "ids"))
    rows = numbered.mapInArrow(run, "doc long, piece int, at long, left long, right long")
    found = rows.join(names.select("left", "right", "id").hint("merge"), ["left", "right"], "left")
    return _gathered(found.select("doc", "piece", "at", F.coalesce("id", F.lit(0)).alias("id")))


def named(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """(one stored table of names a level, (lang, total)).

    A name is (id, lang, words, n, left, right, starts, ends): starts has the counts of its first 1, 2, ... words
    and ends of its last 1, 2, ...; left and right are its parents' ids, null for words.
    """
    counts = stored(word_counts(docs).filter(F.col("word").isNull() | (F.col("n") >= least)))
    totals = stored(counts.filter(F.col("word").isNull()).select("lang", F.col("n").alias("total")))
    nothing = F.array().cast("array<bigint>")
    # the id is stored with its row, so it stays what it is
    words = stored(counts.filter(F.col("word").isNotNull()).select((F.monotonically_increasing_id() + 1).alias("id"), "lang", "word", "n"))
    none = F.lit(None).cast("long")
    levels = [words.select("id", "lang", F.array("word").alias("words"), "n", none.alias("left"), none.alias("right"), nothing.alias("starts"), nothing.alias("ends"))]
    blocks = stored(word_blocks(docs, words))
    for k in range(2, longest + 1):
        pairs = stored(pair_counts(blocks).filter(F.col("n") >= least).select((F.monotonically_increasing_id() + 1).alias("id"), "left", "right", "n"))
        if k < longest:
            blocks = stored(renamed(blocks, pairs).filter("size(ids) > 1"))
        first = levels[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("_words"), F.array_append("starts", F.col("n")).alias("starts"))
        last = levels[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("_last"), F.array_append("ends", F.col("n")).alias("ends"))
        whole = pairs.join(first, "left").join(last, "right")
        levels.append(stored(whole.select("id", "lang", F.array_append("_words", F.col("_last")).alias("words"), "n", "left", "right", "starts", "ends")))
    return levels, totals


def scored(names: DataFrame, k: int) -> DataFrame:
    """Names of k words with their lowest-scoring cut: `cut` is (score, k, l, r) for (n, total, starts, ends); exact, in decimals of 38 digits."""
    cuts = [
        F.struct(F.expr(f"(cast(1000 as decimal(38,0)) * n * total) div (cast(starts[{i - 1}] as decimal(38,0)) * ends[{k - i - 1}])").cast("long").alias("score"), F.lit(i).alias("k"), F.col("starts")[i - 1].alias("l"), F.col("ends")[k - i - 1].alias("r"))
        for i in range(1, k)
    ]
    return names.withColumn("cut", F.array_min(F.array(*cuts)))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of (text, lang), or of all of them.

    Null texts count as empty, null languages as `und`. Copies and repeated rows count as often as they stand; of long
    texts every word counts. Ties rank by count, then by the phrase's bytes. An empty table gives no rows; other
    columns are not read. A row of ids is as long as the longest piece of a text without a break, and ROW more, at most.
    """
    levels, totals = named(docs.select("text", "lang"), longest, least)
    found = []
    for k in range(2, longest + 1):
        here = levels[k - 1]
        if k < longest:  # a longer phrase uses it up: then one with a word more does
            children = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("_n"))
            used = children.groupBy("id").agg(F.max("_n").alias("_n"))
            here = here.join(used, "id", "left").filter(F.col("_n").isNull() | (F.col("_n") < F.col("n")))
        rows = scored(here.join(F.broadcast(totals), "lang"), k)  # one row a language
        found.append(rows.select("lang", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"), "cut.score"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = every.withColumn("rank", rank)  # with `top`, each task keeps its own first ones before the shuffle
    ranked = ranked.filter(F.col("rank") <= top) if top else ranked
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """Collocations of all `documents`: see `collocations` for the awkward rows."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT p, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)
), totals AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, list_slice(w, 1, k) AS w, k FROM (
    SELECT lang, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS w FROM words WINDOW o AS (PARTITION BY p ORDER BY pos)), (SELECT unnest([1, 2, 3, 4, 5]) AS k)
  WHERE w[k] IS NOT NULL
), f AS MATERIALIZED (
  SELECT lang, k, w, count(*) AS a FROM grams GROUP BY lang, k, w HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT f.lang, f.w, f.a, i, x.a AS l, y.a AS r, ((1000::HUGEINT * f.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score, t.n
  FROM f JOIN totals t ON t.lang = f.lang, (SELECT unnest([1, 2, 3, 4]) AS i)
  JOIN f x ON x.lang = f.lang AND x.k = i AND x.w = list_slice(f.w, 1, i) JOIN f y ON y.lang = f.lang AND y.k = f.k - i AND y.w = list_slice(f.w, i + 1, f.k) WHERE i < f.k
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, i) = 1
), parts AS (
  SELECT lang, a, list_slice(w, s, s + m - 1) AS w FROM f, (SELECT unnest([1, 2, 3, 4]) AS s), (SELECT unnest([2, 3, 4]) AS m) WHERE m < k AND s + m - 1 <= k
), used AS (
  SELECT lang, w, max(a) AS a FROM parts GROUP BY lang, w
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(array_to_string(b.w, ' '))) AS rank, array_to_string(b.w, ' ') AS phrase, b.a, l, r, n, score
  FROM best b LEFT JOIN used u ON u.lang = b.lang AND u.w = b.w WHERE u.a IS NULL OR 100 * u.a < 100 * b.a) WHERE rank <= {TOP}
"""
