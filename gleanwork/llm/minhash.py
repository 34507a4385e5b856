"""Near-duplicates: many universal hash minima, banding, verification, connected components.

Documents with equal shingle sets collapse first. Each different set gets BANDS x ROWS minima of linear
hashes; sets that agree on a whole band share a bucket. Signatures propose, in bounded runs of a bucket, a
spanning tree of the surely alike members and further likely partners; proposals are confirmed on the full
sets, best first, and only between components that are still apart. The components come from alternating
large-star and small-star steps.

Proposals are quick but not complete, so every bucket that still holds several components is then searched
through: each of its pairs between different components is verified by size and by a count sketch, which only
ever overrates a pair, and whatever may reach the threshold is confirmed on the full sets. A bucket of any
size is dealt into blocks. So no link between members of a bucket is lost. With 30 bands of 5 rows, a pair at
the threshold 0.85 shares no bucket with a chance of 2e-8 (0.80: 7e-6).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table
from .components import connected

BANDS, ROWS = 30, 5
#: Members a run compares at once, and members of a bucket beyond which it is dealt further by another minimum.
RUN, WIDE = 512, 4096
#: Signature agreement from which two sets count as surely alike (for the tree), and how far below the
#: threshold a proposal may lie: four standard errors.
SURE, MARGIN = 0.93, 0.12
#: Trees of a run, nearest to a member and largest, in which it proposes its two best partners (and the large ones' roots).
PARTNERS = 1
#: The full search of a bucket: cells of a set's count sketch, and members that a block holds on average.
CELLS, BLOCK = 512, 512

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(text: str | None) -> list[bytes]:
    """Words as the contract has them: bytes' own lower() and split() know A-Z and \\x20\\x09-\\x0D alone."""
    return (text or "").encode().lower().split()


def shingle_hashes(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Distinct 64-bit shingle hashes of each text: of k words, or of all of them if there are fewer."""
    raw = [(t or "").encode().lower() for t in texts]
    out: list[np.ndarray] = []
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) < _PIECE):
            size += len(raw[j]) + 1
            j += 1
        out.extend(_shingles(raw[i:j], k))
        i = j
    return out


_POW: dict[str, np.ndarray] = {}


def _shingles(raw: list[bytes], k: int) -> list[np.ndarray]:
    whole = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    n = len(whole)
    if len(_POW.get("p", ())) < n + 1:
        size = max(n + 1, _PIECE + (1 << 16))
        _POW["p"], _POW["q"] = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
    space = (whole == 32) | ((whole >= 9) & (whole <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * _POW["p"][:n])])
    word = mix((total[ends] - total[starts]) * _POW["q"][starts])
    doc_end = np.cumsum([len(r) + 1 for r in raw])
    first = np.searchsorted(starts, np.concatenate([[0], doc_end[:-1]]))
    last = np.searchsorted(starts, doc_end)
    m = max(0, len(word) - k + 1)
    rolled = np.zeros(m, np.uint64)
    for s in range(k):
        rolled += word[s : s + m] * _STEP[s]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first, last):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _STEP[8 : 8 + b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of a * x + b mod 2 ** 32 over the set, taken some rows at a time."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = (minima.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(_P)).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of CELLS cells, up to 255: two sets differ by at least the cells' differences."""
    return np.minimum(np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, words, bands, sig, cells): set size, 128 bits of the set's hashes, digest of the words, band keys, low bytes of the minima, count sketch."""
    longs = pa.list_(pa.int64())
    made = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("words", pa.binary()), ("bands", longs), ("sig", pa.binary()), ("cells", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(ids), 512):
                rows = []
                texts = batch.column("text").slice(at, 512).to_pylist()
                for i, t, s in zip(ids[at : at + 512], texts, shingle_hashes(texts, k)):
                    if not len(s):
                        rows.append((i, 0, *[None] * 6))
                        continue
                    minima = signature(s)
                    d1 = mix(s * np.uint64(_P)).sum(dtype=np.uint64).view(np.int64)
                    d2 = mix(s + np.uint64(_P)).sum(dtype=np.uint64).view(np.int64)
                    words = hashlib.blake2b(b" ".join(words_of(t)), digest_size=16).digest()
                    rows.append((i, len(s), int(d1), int(d2), words, band_keys(minima), minima.astype(np.uint8).tobytes(), sketch(s)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), made)], schema=made)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, words binary, bands array<long>, sig binary, cells binary")


def propose(ids: list[int], sigs: np.ndarray, lowest: float):
    """(a, b, agreement) proposals of one run: trees of the surely alike, and each member's best partner outside its own."""
    m = len(ids)
    if m == 2:  # most buckets
        est = max(0.0, (float((sigs[0] == sigs[1]).mean()) - 1 / 256) / (1 - 1 / 256))
        if est >= lowest:
            yield ids[0], ids[1], est
        return
    alike = np.empty((m, m), np.float32)
    for i in range(m):
        alike[i] = (sigs == sigs[i]).mean(axis=1)
    alike = np.maximum(0, (alike - 1 / 256) / (1 - 1 / 256))  # low bytes agree by chance once in 256
    np.fill_diagonal(alike, -1)
    tree = np.full(m, -1)
    for root in np.argsort(-alike.sum(axis=1), kind="stable"):
        if tree[root] >= 0:
            continue
        tree[root], queue = root, [root]
        while queue:
            u = queue.pop(0)
            for v in np.flatnonzero((alike[u] >= SURE) & (tree < 0)):
                tree[v] = root
                queue.append(v)
                yield ids[u], ids[v], float(alike[u, v])
    roots, sizes = np.unique(tree, return_counts=True)
    if len(roots) == 1:
        return
    apart = np.where(tree[:, None] == tree[None, :], -1, alike)
    where = np.arange(m)
    for root in roots[np.argsort(-sizes, kind="stable")][:PARTNERS]:  # the largest trees hold the original, if there is one
        for i in np.flatnonzero(apart[:, root] >= lowest):  # the root is the member most like all others
            yield ids[i], ids[root], float(apart[i, root])
        own = np.flatnonzero(tree == root)
        part = apart[:, own].copy()
        for _ in range(min(2, len(own))):
            best = part.argmax(axis=1)
            for i in np.flatnonzero(part[where, best] >= lowest):
                yield ids[i], ids[own[best[i]]], float(part[i, best[i]])
            part[where, best] = -1
    for turn in range(2 * PARTNERS):
        best = apart.argmax(axis=1)
        for i in np.flatnonzero(apart[where, best] >= lowest):
            yield ids[i], ids[best[i]], float(apart[i, best[i]])
            # two proposals to a tree: the best estimate may fail where the next one holds
            apart[i, best[i] if turn % 2 == 0 else tree == tree[best[i]]] = -1


def proposals(members: DataFrame, lowest: float) -> DataFrame:
    """(a, b, est) of members (key, part, rep, sig), streamed bucket by bucket in runs of RUN.

    A bucket longer than a run carries its first member into the next run, so all its runs stay connected.
    """
    made = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float32())])

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else ([], [], []), made)], schema=made)

    def run(batches):
        now, ids, sigs, found = None, [], [], []

        def close():
            if len(ids) > 1:
                matrix = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1)
                found.extend((min(a, b), max(a, b), e) for a, b, e in propose(ids, matrix, lowest))

        for batch in batches:
            for key, part, rep, sig in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "rep", "sig"))):
                if (key, part) != now:
                    close()
                    now, ids, sigs = (key, part), [], []
                elif len(ids) == RUN:
                    close()
                    del ids[1:], sigs[1:]
                ids.append(rep)
                sigs.append(sig)
            if found:
                yield batch_of(found)
                found.clear()
        close()
        yield batch_of(found)

    dealt = members.repartition("key", "part").sortWithinPartitions("key", "part", "rep")
    return dealt.mapInArrow(run, "a long, b long, est float").groupBy("a", "b").agg(F.max("est").alias("est"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, zipped): whole texts, compressed before they move."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1024):
                part = batch.slice(at, 1024)
                zipped = [press.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(zipped, pa.binary())], names=["doc_id", "zipped"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, zipped binary")


def confirm(edges: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of `edges` (a, b, ...) whose full word-shingle sets have 100 * intersection >= percent * union.

    `texts` are packed. Shingles are compared as tuples of words, not as hashes.
    """
    left = texts.select(F.col("doc_id").alias("a"), F.col("zipped").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("zipped").alias("text_b"))
    names = [c for c in edges.columns if c != "est"]

    def shingles(zipped):
        w = zstandard.ZstdDecompressor().decompress(zipped).lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if text_a != last:
                    last, held = text_a, shingles(text_a)
                other = shingles(text_b)
                both = len(held & other)
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    joined = edges.select(*names).join(right, "b").join(left, "a").select(*names, "text_a", "text_b")
    return joined.mapInArrow(run, edges.select(*names).schema)


def _best(edges: DataFrame, *by: str) -> DataFrame:
    """The best edge of each group; a maximum over structs, so it combines before the shuffle."""
    top = edges.groupBy(*by).agg(F.max(F.struct("est", "a", "b")).alias("top"))
    return top.select(F.least("top.a", "top.b").alias("a"), F.greatest("top.a", "top.b").alias("b")).distinct()


def apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, block, visits, rep, component, main) of the members (key, rep) of buckets that hold several components of `sets` (rep, component).

    A bucket has one block for every BLOCK members. Each member lives in one block; members outside the
    bucket's largest component also visit all blocks, so that each pair between components meets.
    """
    placed = members.select("key", "rep").join(sets, "rep")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max(F.struct("n", "component"))["component"].alias("main")).filter("kinds > 1")
    rows = placed.join(split.select("key", "n", "main"), "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    home = F.struct(F.pmod(F.xxhash64("rep", "key"), blocks).alias("block"), F.lit(0).alias("visits"))
    visits = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(x.alias("block"), F.lit(1).alias("visits")))
    places = F.when(F.col("component") == F.col("main"), F.array(home)).otherwise(F.concat(F.array(home), visits))
    rows = rows.select("key", "rep", "component", (F.col("component") == F.col("main")).alias("main"), F.explode(places).alias("at"))
    return rows.select("key", "at.block", "at.visits", "rep", "component", "main")


def possible(members: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): the pairs of different components in one bucket that may reach the threshold, by size and sketch (rep, size, cells)."""
    made = pa.schema([(c, pa.int64()) for c in ("a", "b", "ca", "cb")])

    def compare(homes, visitors):
        ids, own, main, size = (np.array([r[i] for r in homes], np.int64) for i in range(4))
        cells = np.frombuffer(b"".join(r[4] for r in homes), np.uint8).reshape(len(homes), CELLS)
        for rep, component, _, n, raw in visitors:
            # two visitors meet twice, so the one with the smaller id looks
            j = np.flatnonzero((own != component) & ((main > 0) | (ids > rep)) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
            if not len(j):
                continue
            other, mine = cells[j], np.frombuffer(raw, np.uint8)
            differ = (np.maximum(other, mine) - np.minimum(other, mine)).sum(axis=1, dtype=np.int64)
            both = size[j] + n
            j = j[100 * (both - differ) >= percent * (both + differ)]
            if len(j):
                low = ids[j] < rep
                yield [np.where(low, v[j], x) for v, x in ((ids, rep), (own, component))] + [np.where(low, x, v[j]) for v, x in ((ids, rep), (own, component))]

    def run(batches):
        now, homes, visitors = None, [], []

        def found():
            for a, ca, b, cb in compare(homes, visitors) if homes and visitors else ():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, ca, cb)], schema=made)
            visitors.clear()

        for batch in batches:
            for key, block, visits, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "visits", "rep", "component", "main", "size", "cells"))):
                if (key, block) != now:
                    yield from found()
                    now, homes = (key, block), []
                (visitors if visits else homes).append(row)
                if len(visitors) >= 4 * BLOCK:
                    yield from found()
        yield from found()

    met = stored(apart(members, sets))
    sketches = sketches.join(met.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.first("size").alias("size"), F.first("cells").alias("cells"))
    met = met.join(sketches, "rep")
    dealt = met.repartition("key", "block").sortWithinPartitions("key", "block", "visits")
    return dealt.mapInArrow(run, "a long, b long, ca long, cb long").groupBy("a", "b").agg(F.first("ca").alias("ca"), F.first("cb").alias("cb"))


def joined_components(now: DataFrame, links: DataFrame) -> DataFrame:
    """`now` (rep, component) after its components were linked as in `links` (a, b)."""
    more = stored(connected(links)).toDF("component", "joined")
    return now.join(more, "component", "left").select("rep", F.coalesce("joined", "component").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents, linked at Jaccard >= percent / 100 on k-word shingles.

    One row for each row of `docs`. component_id is the smallest doc_id reachable; kept marks the rows that carry it.
    Null, empty and blank texts have no shingles and stand alone; of long ones every word counts. Rows under one id are
    one document: it has the links of each of its texts, and each row the size of its own. A row without an id is
    linked with nothing: its component_id is null, and it is kept. An empty table gives no rows. Other columns of
    `docs`, whatever their names, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"))
    if repeated.isEmpty():
        return _of_nodes(docs, k, percent)
    # all texts of an id but one go under ids beyond all others, which are then linked with it
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    texts = stored(docs.join(repeated, "doc_id", "left_semi").select("doc_id", digest.alias("_text")).distinct())
    first = texts.groupBy("doc_id").agg(F.min("_text").alias("_first"))
    beyond = docs.agg(F.max("doc_id")).first()[0] + 1
    others = texts.join(first, "doc_id").filter("_text <> _first").select("doc_id", "_text", (F.monotonically_increasing_id() + beyond).alias("_node"))
    others = stored(others)
    named = docs.withColumn("_text", digest).join(others, ["doc_id", "_text"], "left")
    found = stored(_of_nodes(named.select(F.coalesce("_node", "doc_id").alias("doc_id"), "text"), k, percent))
    places = found.filter("doc_id is not null").select("doc_id", "component_id").distinct()
    ends = others.select(F.col("doc_id").alias("_of"), F.col("_node").alias("doc_id")).join(places, "doc_id").select("_of", F.col("component_id").alias("a"))
    links = ends.join(places.select(F.col("doc_id").alias("_of"), F.col("component_id").alias("b")), "_of").select("a", "b")
    more = stored(connected(links)).toDF("component_id", "_joined")
    back = others.select(F.col("_node").alias("doc_id"), F.col("doc_id").alias("_of"))
    out = found.join(more, "component_id", "left").join(back, "doc_id", "left")
    component = F.coalesce("_joined", "component_id")
    out = out.select(F.coalesce("_of", "doc_id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def mistaken(named: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(d1, d2, words, rep): texts of other words than their class (d1, d2) has first, whose full sets aren't equal to the first one's after all.

    Rows of one word sequence have one set. One text of each sequence is compared with the class's first, shingle by shingle.
    """
    kinds = stored(named.groupBy("d1", "d2", "words").agg(F.min("doc_id").alias("rep")))
    first = kinds.groupBy("d1", "d2").agg(F.min("rep").alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = stored(kinds.join(first, ["d1", "d2"]).filter("rep <> first").select("d1", "d2", "words", F.col("first").alias("a"), F.col("rep").alias("b")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(packed(docs).join(ends.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    equal = confirm(pairs.select("a", "b"), texts, k, 100)
    return stored(pairs.join(equal, ["a", "b"], "left_anti").select("d1", "d2", "words", F.col("b").alias("rep")))


def _of_nodes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The same for ids (null ones aside) that have one text each."""
    sigs = stored(signatures(docs, k))
    named = sigs.filter("n_shingles > 0 and doc_id is not null")
    sets = stored(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    # sets that only their hashes made equal are nodes of their own, with the same minima
    odd = mistaken(named, docs, k)
    if not odd.isEmpty():
        sets = stored(sets.unionByName(odd.join(sets.drop("rep"), ["d1", "d2"]).select(*sets.columns)))
    bands = sets.select("rep", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).filter("n > 1")
    # bands that put the very same sets together need comparing once
    buckets = buckets.groupBy("n", "low", "who").agg(F.min("key").alias("key")).select("key", "n")
    members = stored(bands.join(buckets, "key").select("key", "n", "rep"))
    # a very wide bucket is dealt by other minima (which alike sets share), then by hash, for the proposals
    other = F.pmod(F.xxhash64(F.substring(F.col("sig"), F.pmod(F.col("key"), F.lit(BANDS * ROWS - 2)).cast("int") + 1, F.lit(2))), F.ceil(F.col("n") / WIDE))
    spread = F.when(F.col("n") > WIDE * 64, F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("n") / (WIDE * 64)))).otherwise(F.lit(0))
    dealt = members.join(sets.select("rep", "sig"), "rep").withColumn("part", F.when(F.col("n") > WIDE, other * 1_000_003 + spread).otherwise(F.lit(0)).cast("long"))
    edges = stored(proposals(dealt.select("key", "part", "rep", "sig"), percent / 100 - MARGIN))
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # the same join at every size: the list of ends grows with the input, so it is never broadcast
    texts = stored(packed(docs).join(ends.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    # first each set's best proposal; then all others between components that are still apart
    tried = stored(_best(edges.withColumn("node", F.explode(F.array("a", "b"))), "node"))
    first = stored(connected(confirm(tried, texts, k, percent)))
    left = edges.select("a", "b").join(tried, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        names = first.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        left = left.join(names, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    left = stored(left.filter("ca <> cb"))
    now = sets.select("rep").join(first.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    now = stored(joined_components(now, confirm(left, texts, k, percent).select("ca", "cb").toDF("a", "b")))
    discard(edges, tried, first, left, texts)
    # last, every pair of a bucket that the proposals left apart
    sketches = sigs.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "cells")
    rest = stored(possible(members, now, sketches, percent))
    ends = rest.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(packed(docs).join(ends.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    found = joined_components(now, confirm(rest, texts, k, percent).select("ca", "cb").toDF("a", "b"))
    classes = sets.select("d1", "d2", "rep").join(odd.select("rep", F.col("words").alias("_words")), "rep", "left").join(found, "rep")
    classes = stored(classes.select("d1", "d2", "_words", F.col("component").alias("component_id")))
    out = sigs.select("doc_id", "n_shingles", "d1", "d2", "words").join(classes.filter("_words is null").drop("_words"), ["d1", "d2"], "left")
    own = classes.filter("_words is not null").select("d1", "d2", F.col("_words").alias("words"), F.col("component_id").alias("_own"))
    out = out.join(own, ["d1", "d2", "words"], "left").withColumn("component_id", F.coalesce("_own", "component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of all `documents` at Jaccard 0.85 on three-word shingles: see `near_duplicates` for the awkward rows."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each near-duplicate class: a row of the smallest doc_id, of several the one whose text has the smallest MD5. Rows without an id stay."""
    kept = near_duplicates(docs.filter(F.col("doc_id").isNotNull()), k, percent).filter("kept").select("doc_id").distinct()
    rank = F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.xxhash64(*docs.columns))
    named = docs.join(kept, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*docs.columns), rank).alias("row")).select("row.*")
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
