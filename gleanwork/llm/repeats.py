"""Exact repeats: every byte covered by a MIN_LENGTH-byte string that also starts elsewhere.

Method: threshold-bounded interval expansion by backward extension. Suffixes are sorted to a bounded
depth (their first 8 bytes), which gives the intervals of equal 8-byte strings; each interval is then
extended backwards, breadth first, by the 8 bytes before its rows (the transform's column), splitting
where they differ and ending where one row is left. Common lengths so come in increasing order, 8, 16,
24, ..., and the expansion stops at the minimum length: the rows still together start repeats.

To run it on many machines, strings that can match must meet. Every window of MIN_LENGTH bytes has one
anchor, its smallest hashed ANCHOR-byte piece (leftmost of equals), so equal windows have equal anchors.
A context is a maximal run of windows with one anchor; its name is a 128-bit BLAKE2b digest of all its bytes, which every
copy has computed from its own bytes, so no copy goes under another's name. Of contexts with one name
the bytes of two copies (the first and the last) are brought together, of others those of their one copy, and all of
one anchor are expanded as above. Two copies with equal bytes are one interval at every depth, so one of them is
expanded with the rest and the whole is repeated; what one copy of a context repeats, all its occurrences do. An anchor with over MOST_CONTEXTS contexts is split further, by the bytes to the left or
right that its windows must share, until small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, stored, table
from .minhash import mix
from .passages import BUFFER, candidates, met, powers, runs_at, runs_of, window_minimum

MIN_LENGTH, ANCHOR = 400, 16
#: Different contexts of one anchor that meet in a task; bytes of text that a task expands at once.
MOST_CONTEXTS, TEXT = 4096, 1 << 18


def contexts_of(raw: bytes, ends: np.ndarray, length: int):
    """(piece, anchor, first, last, key, names) of each context in a buffer of pieces that end at `ends`."""
    data = np.frombuffer(raw, np.uint8)
    n, w = len(data), length - ANCHOR + 1
    p, q = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n])])
    grams = mix((total[ANCHOR:] - total[:-ANCHOR]) * q[: n - ANCHOR + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(BUFFER - 1)
    least = (window_minimum((grams & ~low) | place, w) & low).astype(np.int64)
    inside = np.ones(len(least), bool)
    for end in ends.tolist():
        inside[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return None
    least = least[starts]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    piece, anchor = np.searchsorted(ends, first, side="right"), least[new]
    names = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + length).tolist())]
    return piece, anchor, first, last, grams[anchor].view(np.int64), names


def context_table(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, key, context, starts, width, left) of (doc_id, th, text): one row a document and different context.

    `starts` are where such contexts begin, `width` how many windows each holds, `left` the bytes before its anchor.
    """
    ints = pa.list_(pa.int32())
    made = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("key", pa.int64()), ("context", pa.binary()), ("starts", ints), ("width", pa.int32()), ("left", pa.int32())])

    def rows_of(pieces, ids, hashes):
        """pieces: (row, offset in the text, bytes); one buffer of them."""
        sizes = np.array([len(x[2]) for x in pieces])
        ends = np.cumsum(sizes)
        found = contexts_of(b"".join(x[2] for x in pieces), ends, length)
        if found is None:
            return None
        piece, anchor, first, last, key, names = found
        high, low = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2).T
        offset = np.array([x[1] for x in pieces]) - (ends - sizes)
        owner = np.array([x[0] for x in pieces])[piece]
        start = first + offset[piece]
        order = np.lexsort((start, low, high, key, owner))
        differ = [x[order][1:] != x[order][:-1] for x in (owner, key, high, low)]
        cut = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce(differ)]))
        begin = order[cut]
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(order)).astype(np.int32)), pa.array(start[order].astype(np.int32)))
        rows = owner[begin]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), hashes.take(pa.array(rows)), pa.array(key[begin]), pa.array([names[i] for i in begin], pa.binary()), lists, pa.array((last - first + 1)[begin].astype(np.int32)), pa.array((anchor - first)[begin].astype(np.int32))], schema=made
        )

    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.column("doc_id"), batch.column("th"), batch.column("text")
            pieces, size = [], 0
            for i, t in enumerate(texts):
                raw = (t.as_py() or "").encode()
                for at in range(0, max(0, len(raw) - length + 1), BUFFER // 2):
                    part = raw[at : at + BUFFER // 2 + length - 1]
                    if size + len(part) > BUFFER - 1 and pieces:
                        if (out := rows_of(pieces, ids, hashes)) is not None:
                            yield out
                        pieces, size = [], 0
                    pieces.append((i, at, part))
                    size += len(part)
            if pieces and (out := rows_of(pieces, ids, hashes)) is not None:
                yield out

    return docs.mapInArrow(run, "doc_id long, th long, key long, context binary, starts array<int>, width int, left int")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, zipped): texts compressed before they move."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([press.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())], names=["doc_id", "th", "zipped"])

    return docs.mapInArrow(run, "doc_id long, th long, zipped binary")


def unzip(zipped: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(zipped)


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of `starts` (positions of whole windows in `text`) begin a window that another start begins too."""
    n = len(text) - 7
    words = np.ndarray(n, "<u8", text, strides=(1,)).copy()  # the 8 bytes from each place on
    depth = 8
    lead = words[starts + length - 8]
    rows = np.argsort(lead)  # suffixes sorted to depth 8: the first intervals
    lead = lead[rows]
    new = np.concatenate([[True], lead[1:] != lead[:-1]])
    at = starts[rows] + length
    while True:
        alone = new & np.append(new[1:], True)
        if alone.any():
            more = np.flatnonzero(~alone)
            rows, new, at = rows[more], new[more], at[more]
        if depth >= length or not len(rows):
            return np.sort(rows)
        step = min(8, length - depth)
        depth += step
        before = words[at - depth]
        if step < 8:
            before &= np.uint64((1 << 8 * step) - 1)
        differs = np.concatenate([[False], before[1:] != before[:-1]]) & ~new
        if differs.any():  # only intervals that split are sorted again
            interval = np.cumsum(new)
            hit = np.zeros(interval[-1] + 1, bool)
            hit[interval[differs]] = True
            where = np.flatnonzero(hit[interval])
            order = where[np.lexsort((before[where], interval[where]))]
            rows[where], at[where], before = rows[order], at[order], before[order]
            inner = np.concatenate([[True], before[1:] != before[:-1]])
            new[where] = new[where] | inner


def expand(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, n, key0, context, base, start, stop): runs of repeated windows, anchor by anchor."""
    made = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "th", "n", "key0")], ("context", pa.binary()), *[(c, pa.int32()) for c in ("base", "start", "stop")]])

    carried = ("doc_id", "th", "n", "key0", "context", "base", "start", "width", "bytes")

    def solve(rows):
        doc, th, n, key0, context, base, start, width, raw = zip(*rows)
        sizes, widths = np.array([len(x) for x in raw]), np.array(width)
        at = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(rows)), widths)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths)
        hits = repeated_starts(np.frombuffer(b"".join(raw), np.uint8), at[owner] + inner, length)
        if not len(hits):
            return None
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(owner[hits]) != 0)]))
        a, b = hits[cut], hits[np.append(cut[1:], len(hits)) - 1]
        who = owner[a]
        begin = np.array(start)[who]
        same = [[values[i] for i in who] for values in (doc, th, n, key0, context, base)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*same, (begin + inner[a]).astype(np.int32), (begin + inner[b] + length).astype(np.int32)], made)], schema=made)

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * len(made), made)], schema=made)

    def run(batches):
        """Rows of one anchor stand together, and in it those of one context: two copies with equal bytes are one interval at every depth."""
        rows, group, size, now, whole = [], [], 0, None, []

        def close():
            nonlocal size
            if len(group) > 1:
                rows.extend(group)
                size += sum(len(r[-1]) for r in group)
            group.clear()

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *carried))):
                if key != now:
                    close()
                    now = key
                    if size >= TEXT:
                        if (out := solve(rows)) is not None:
                            yield out
                        rows, size = [], 0
                if group and group[-1][4] == row[4] and group[-1][-1] == row[-1]:
                    doc, th, n, key0, context, base, start, width, _ = row
                    whole.append((doc, th, n, key0, context, base, start, start + width + length - 1))
                else:
                    group.append(row)
            if whole:
                yield batch_of(whole)
                whole.clear()
        close()
        if rows and (out := solve(rows)) is not None:
            yield out

    dealt = contexts.select("key", *carried).repartition("key").sortWithinPartitions("key", "context")
    return dealt.mapInArrow(run, RUNS)


#: Runs that are repeated: of which context (key0, context), where that begins (base), and how often it was seen (n).
RUNS = "doc_id long, th long, n long, key0 long, context binary, base int, start int, stop int"
CONTEXT = "doc_id long, th long, key long, n long, key0 long, context binary, base int, start int, width int, u int, v int, bytes binary"
FIELDS = [(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in CONTEXT.split(", ")]


def split(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts of crowded anchors under longer shared strings.

    All windows of a context hold bytes [u, v). One half of them reaches at least `half` bytes further to
    the left, the other further to the right; each half goes on under a key that covers those bytes as well.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, th, key, n, key0, context, base, start, width, u, v, raw in zip(*(batch.column(c).to_pylist() for c, _ in FIELDS)):
                rest = length - (v - u)
                half = -(-rest // 2)
                cut = u - half  # windows up to here reach `half` further left
                for lo, hi, a, b, side in ((0, min(width - 1, cut), u - half, v, b"l"), (max(0, cut + 1), width - 1, u, v + rest - half + 1, b"r")):
                    if lo <= hi:
                        new = hashlib.blake2b(side + key.to_bytes(8, "big", signed=True) + raw[a:b], digest_size=8).digest()
                        out.append((doc, th, int.from_bytes(new, "big", signed=True), n, key0, context, base, start + lo, hi - lo + 1, a - lo, b - lo, raw[lo : hi + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [()] * len(FIELDS), FIELDS)], names=[c for c, _ in FIELDS])

    return contexts.mapInArrow(run, CONTEXT)


def crowded(contexts: DataFrame, most: int) -> DataFrame:
    return stored(contexts.groupBy("key").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > most))


def covered(docs: DataFrame, length: int = MIN_LENGTH, most: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, start, stop) of documents (doc_id, th, text): byte runs whose windows start elsewhere too; may overlap.

    Beside them (doc_id, th) of documents that hold a passage of another row (`passages`). The texts move once for both.
    """
    found, certain, unsure = candidates(docs)
    windows = stored(context_table(docs, length))
    copy = lambda at: F.struct("doc_id", "th", F.element_at("starts", at).alias("start"), "width", "left")
    seen = windows.groupBy("key", "context").agg(F.sum(F.size("starts")).alias("n"), F.min(copy(1)).alias("first"), F.max(copy(-1)).alias("last"))
    seen = stored(seen)
    # an anchor with one context that was seen once repeats nothing
    several = seen.groupBy("key").agg(F.sum(F.least("n", F.lit(2))).alias("copies")).filter("copies > 1").select("key")
    both = F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first"))
    wanted = seen.join(several, "key").select("key", "context", "n", F.explode(both).alias("at")).select("key", "context", "n", "at.*")
    wanted = wanted.select("doc_id", "th", F.struct("key", "n", "context", "start", "width", "left").alias("piece")).unionByName(unsure, allowMissingColumns=True)
    wanted = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("piece").alias("wanted"), F.first("keys", True).alias("keys"))

    def cut(batches):
        """Rows without a key are a document's runs of words, by their digests."""
        for batch in batches:
            out = []
            for doc, th, zipped, rows, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "zipped", "wanted", "keys"))):
                raw = unzip(zipped)
                if keys:
                    out.append((doc, th, *[None] * 9, runs_at(raw, keys)))
                out.extend((doc, th, r["key"], r["n"], r["key"], r["context"], r["start"], r["start"], r["width"], r["left"], r["left"] + ANCHOR, raw[r["start"] : r["start"] + r["width"] + length - 1]) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [()] * len(FIELDS), FIELDS)], names=[c for c, _ in FIELDS])

    # of rows repeated under one id and text, one is enough
    full = packed(docs)
    texts = full.join(wanted, full["doc_id"].eqNullSafe(wanted["_id"]) & (full["th"] == wanted["_th"])).dropDuplicates(["doc_id", "th"])
    made = stored(texts.mapInArrow(cut, CONTEXT))
    sharing = stored(certain.union(met(runs_of(made.filter("key is null"))).filter("same").select("doc_id", "th")).distinct())
    discard(found)
    contexts = made.filter("key is not null")
    contexts.stored_at = made.stored_at
    parts = []
    while True:
        hot = crowded(contexts, most)
        if hot.isEmpty():
            parts.append(stored(expand(contexts, length)))
            break
        marked = join_small(contexts, hot, "key")
        parts.append(stored(expand(marked.filter("crowd is null").drop("crowd"), length)))
        mine = marked.filter("crowd is not null").drop("crowd")
        # windows that are equal as a whole need no further look
        equal = mine.filter(F.col("v") - F.col("u") >= length)
        parts.append(stored(equal.select("doc_id", "th", "n", "key0", "context", "base", "start", (F.col("start") + F.col("width") + length - 1).alias("stop"))))
        rest = stored(split(mine.filter(F.col("v") - F.col("u") < length), length))
        discard(contexts)
        contexts = rest
    discard(contexts)
    runs = parts[0]
    for part in parts[1:]:
        runs = runs.unionByName(part)
    alone = runs.filter("n = 1").select("doc_id", "th", "start", "stop")
    # what a context's copies repeat, all its occurrences do
    spread = runs.filter("n > 1").select(F.col("key0").alias("key"), "context", (F.col("start") - F.col("base")).alias("_from"), (F.col("stop") - F.col("base")).alias("_to")).distinct()
    again = windows.join(spread, ["key", "context"]).select("doc_id", "th", F.explode("starts").alias("at"), "_from", "_to")
    return alone.unionByName(again.select("doc_id", "th", (F.col("at") + F.col("_from")).alias("start"), (F.col("at") + F.col("_to")).alias("stop"))), sharing


def keep_rest(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    removed, runs, at, parts = 0, 0, 0, []
    for start, stop in sorted(spans):
        if start > at or not runs:
            parts.append(raw[at:start])
            runs += 1
            at = max(at, start)
        if stop > at:
            removed += stop - at
            at = stop
    parts.append(raw[at:])
    return removed, runs, b"".join(parts)


def without_repeats(docs: DataFrame, length: int = MIN_LENGTH, most: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, shares_passage) of documents (doc_id, text); kept is bytes, as cuts may split a character.

    shares_passage: a run of over 50 words (`passages.WORDS`) stands in another row's text as well, however few bytes it
    has. It takes nothing from `kept`.

    Null and short texts stay whole; of long ones every byte counts. Rows repeated under one id repeat each other; a
    null id is an id. An empty table stays empty. Other columns of `docs`, whatever their names, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans, sharing = covered(docs, length, most)
    marks = spans.select("doc_id", "th", F.struct("start", "stop").alias("span")).unionByName(sharing.withColumn("shares", F.lit(True)), allowMissingColumns=True)
    spans = marks.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("span").alias("spans"), F.max("shares").alias("shares"))
    full = packed(docs)
    joined = full.join(spans, full["doc_id"].eqNullSafe(spans["_id"]) & (full["th"] == spans["_th"]), "left").select("doc_id", "zipped", "spans", "shares")

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part, out = batch.slice(at, 512), []
                for doc, zipped, found, shares in zip(*(part.column(c).to_pylist() for c in ("doc_id", "zipped", "spans", "shares"))):
                    raw = unzip(zipped)
                    removed, runs, rest = keep_rest(raw, [(s["start"], s["stop"]) for s in found or ()])
                    out.append((doc, len(raw), removed, runs, rest, bool(shares)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "shares_passage"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, shares_passage boolean")


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """What 400-byte repeats take from each of all `documents`, and whether it shares a passage: see `without_repeats` for the awkward rows."""
    rest = without_repeats(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
