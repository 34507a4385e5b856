"""Passages that several documents hold: a run of WORDS words that stands in another row's text as well.

Winnowing: every run of WORDS words has one anchor, its smallest hashed GRAM words (leftmost of equals), so equal runs
have equal anchors. A context is a maximal chain of such runs with one anchor. Rows whose contexts agree in both 64-bit
hashes, the anchor's and that of all the context's words, share its runs. Where only anchors agree, the runs there are
compared one by one, by a 128-bit digest of their words, unless a row is known to share some already.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .minhash import _P, _powers, mix

#: A passage has over 50 words.
WORDS, GRAM = 51, 16
#: Bytes of text whose arrays a task holds at once; texts beyond half of it are cut between words.
BUFFER = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP, _NEXT = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,%d}" % (WORDS - 1))
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, BUFFER + 1)
        _POW["p"], _POW["q"] = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
    return _POW["p"], _POW["q"]


def window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(v) - w + 1
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def pieces_of(raw: bytes):
    """`raw` in pieces that end with the WORDS - 1 words after the next one's start, so that each run of words is in one."""
    at = 0
    while len(raw) - at > BUFFER // 2 and (gap := _GAP.search(raw, at + BUFFER // 2)):
        yield raw[at : _NEXT.match(raw, gap.start()).end()]
        at = gap.start()
    yield raw[at:]


def contexts_of(pieces: list[bytes]):
    """(piece, first word, last run's first word, key, name) of each context, and where words start and stop in the pieces joined by \\n."""
    raw = b"\n".join(pieces)
    data = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    bounds = np.flatnonzero(gap[1:] != gap[:-1])
    start, stop = bounds[::2], bounds[1::2]
    n = len(start)
    if n < WORDS:
        return None
    p, q = powers(len(data) + 2)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)])])
    words = mix((total[stop] - total[start]) * q[start])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * p[:n])])
    grams = mix((total[GRAM:] - total[:-GRAM]) * q[: n - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    least = (window_minimum((grams & ~low) | np.arange(len(grams), dtype=np.uint64), WORDS - GRAM + 1) & low).astype(np.int64)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in pieces]), start, side="right")
    runs = np.flatnonzero(owner[WORDS - 1 :] == owner[: n - WORDS + 1])
    if not len(runs):
        return None
    least, owner = least[runs], owner[runs]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(owner) != 0)]))
    first, last = runs[new], runs[np.append(new[1:], len(runs)) - 1]
    name = mix((total[last + WORDS] - total[first]) * q[first])
    return owner[new], first, last, grams[least[new]].view(np.int64), name.view(np.int64), start, stop


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, th, key, name) of documents (doc_id, th, text): a row for each document and different context."""
    made = pa.schema([(c, pa.int64()) for c in ("doc_id", "th", "key", "name")])

    def rows_of(buffers, rows, batch):
        """Different contexts of the documents in `buffers`, lists of pieces, where piece i of all is of document rows[i]."""
        parts, at = [], 0
        for pieces in buffers:
            if (found := contexts_of(pieces)) is not None:
                parts.append((np.array(rows)[found[0] + at], found[3], found[4]))
            at += len(pieces)
        if not parts:
            return
        owner, key, name = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((name, key, owner))
        differ = [x[order][1:] != x[order][:-1] for x in (owner, key, name)]
        order = order[np.concatenate([[True], np.logical_or.reduce(differ)])]
        where = pa.array(owner[order])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("th").take(where), pa.array(key[order]), pa.array(name[order])], schema=made)

    def run(batches):
        for batch in batches:
            pieces, rows, size = [], [], 0
            for i, t in enumerate(batch.column("text")):
                raw = (t.as_py() or "").encode()
                if len(raw) > BUFFER // 2:  # piece by piece
                    cut = [[x] for x in pieces_of(raw)]
                    yield from rows_of(cut, [i] * len(cut), batch)
                    continue
                if size + len(raw) > BUFFER:
                    yield from rows_of([pieces], rows, batch)
                    pieces, rows, size = [], [], 0
                pieces.append(raw)
                rows.append(i)
                size += len(raw)
            if pieces:
                yield from rows_of([pieces], rows, batch)

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, key long, name long")


def met(contexts: DataFrame) -> DataFrame:
    """(doc_id, th, key, same) of contexts whose anchor another has; same: all its words as well."""
    made = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("key", pa.int64()), ("same", pa.bool_())])

    def told(rows, key, name):
        """Each of `rows` in order, which stand between one more key and name at either end, held against its neighbours."""
        keys = key[1:] == key[:-1]
        both = keys & (name[1:] == name[:-1])
        hot = np.flatnonzero(keys[1:] | keys[:-1])
        rows = rows.take(pa.array(hot))
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "th", "key")], pa.array((both[1:] | both[:-1])[hot])], schema=made)

    def run(batches):
        held, before = None, None  # the last row, still to be told, and the key and name before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            key, name = (rows.column(c).to_numpy() for c in ("key", "name"))
            before = before or (~key[0], name[0])
            if len(key) > 1:
                yield told(rows.slice(0, len(key) - 1), np.append(before[0], key), np.append(before[1], name))
                before = key[-2], name[-2]
            held = rows.slice(len(key) - 1)
        if held is not None:
            key, name = (held.column(c).to_numpy()[0] for c in ("key", "name"))
            yield told(held, np.array([before[0], key, ~key]), np.array([before[1], name, name]))

    return contexts.repartition("key").sortWithinPartitions("key", "name").mapInArrow(run, "doc_id long, th long, key long, same boolean")


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (doc_id, th, text), from a stored table, which comes first: (doc_id, th) that share a passage for certain, and (doc_id, th, keys) whose runs at those anchors are to be compared.

    Rows of equal texts are certain, so that one row stands for its text where runs are compared.
    """
    found = stored(met(anchors(docs)).groupBy("doc_id", "th").agg(F.max("same").alias("same"), F.collect_set("key").alias("keys")))
    open_keys = found.filter("not same").select(F.explode("keys").alias("key")).distinct()
    there = found.select("doc_id", "th", F.explode("keys").alias("key")).join(open_keys, "key", "left_semi")
    return found, found.filter("same").select("doc_id", "th"), there.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.collect_set("key").alias("keys"))


def runs_at(raw: bytes, keys: list[int]) -> bytes:
    """Digests of the different runs of words of `raw` that have one of these anchors."""
    wanted, out = np.array(keys, np.int64), set()
    for piece in pieces_of(raw):
        if (found := contexts_of([piece])) is None:
            continue
        _, first, last, key, _, start, stop = found
        sizes = stop - start
        ends = np.cumsum(sizes + 1) - 1
        begins, plain = (ends - sizes).tolist(), b" ".join(piece.split())
        ends = ends.tolist()
        for i in np.flatnonzero(np.isin(key, wanted)).tolist():
            for at in range(int(first[i]), int(last[i]) + 1):
                out.add(hashlib.blake2b(plain[begins[at] : ends[at + WORDS - 1]], digest_size=16).digest())
    return b"".join(out)


def runs_of(digests: DataFrame) -> DataFrame:
    """(doc_id, th, key, name), a row for each run, of (doc_id, th, bytes) as `runs_at` makes them."""

    def run(batches):
        for batch in batches:
            raw = [x.as_py() for x in batch.column("bytes")]
            key, name = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2).T
            where = pa.array(np.repeat(np.arange(len(raw)), [len(x) // 16 for x in raw]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("th").take(where), pa.array(key), pa.array(name)], names=["doc_id", "th", "key", "name"])

    return digests.select("doc_id", "th", "bytes").mapInArrow(run, "doc_id long, th long, key long, name long")
