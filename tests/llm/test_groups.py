"""Near-duplicates, repeats, packing, components: against brute force and the awkward rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import components, minhash, packing, repeats
from gleanwork.llm.queries import QUERIES

from ..conftest import SF
from .test_text import DOCS, ROWS, documents


def brute_components(ids, texts, k, percent):
    sets = {}
    for i, t in zip(ids, texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    d = documents()
    got = QUERIES["op7_near_duplicates"](spark, SF).toPandas().set_index("doc_id")
    want, sizes = brute_components(d.doc_id, d.text, 3, 85)
    assert got.component_id.to_dict() == want and got.n_shingles.to_dict() == sizes
    assert (got.kept == (got.component_id == got.index)).all()


def test_near_duplicate_family_around_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(10_000)}" for _ in range(120)]
    texts = []
    for i in range(150):
        t = list(base)
        for p in rng.choice(120, i % 9, replace=False):
            t[p] = f"x{i}_{p}"
        texts.append(" ".join(t))
    texts += [texts[0].upper(), "", None, "two words", "two  WORDS", "two words more"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).withColumn("sig", F.lit(1))
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k, percent).collect()}
        assert got == brute_components(range(len(texts)), texts, k, percent)[0]


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """As many rows as came in, the links of each text, and one row kept by rule."""
    rng = np.random.default_rng(2)
    base = [[f"w{rng.integers(1000)}" for _ in range(60)] for _ in range(4)]
    near = lambda b, i: " ".join([*base[b][:-1], f"x{i}"])
    rows = [(10, near(0, 1)), (10, near(1, 2)), (10, near(1, 2)), (10, ""), (3, near(1, 3)), (7, near(0, 4)), (20, near(2, 5)), (21, near(2, 6)), (30, near(3, 7)), (30, "other words alone here and there"), (None, near(0, 8)), (40, None), (40, "")]
    df = spark.createDataFrame([(i, t, "en", f"s{j}", j) for j, (i, t) in enumerate(rows)], DOCS)
    got = minhash.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {10: 3, 3: 3, 7: 3, 20: 20, 21: 20, 30: 30, 40: 40, None: None}
    assert sorted(r.n_shingles for r in got if r.doc_id == 10) == [0, 58, 58, 58]
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_one(df, 3, 85).collect()
    assert sorted(kept, key=str) == sorted(minhash.keep_one(df.repartition(7), 3, 85).collect(), key=str)
    assert sorted(str(r.doc_id) for r in kept) == ["20", "3", "30", "40", "None"]
    first = min((t for i, t in rows if i == 30), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert next(r.text for r in kept if r.doc_id == 30) == first


def test_sets_with_one_digest_are_compared_whole(spark, monkeypatch):
    """Texts whose sets only seem to be equal stay apart, with the links of their own; equal sets of other words are one class."""
    real = minhash.signatures

    def blunt(docs, k):  # every set has the hashes and minima of the first
        made = minhash.stored(real(docs, k))
        one = made.filter("n_shingles > 0").orderBy("doc_id").limit(1).selectExpr(*[f"{c} AS _{c}" for c in ("d1", "d2", "bands", "sig")])
        same = F.col("n_shingles") > 0
        joined = made.crossJoin(one)
        return joined.select("doc_id", "n_shingles", *[F.when(same, F.col(f"_{c}")).alias(c) for c in ("d1", "d2", "bands", "sig")], "words", "cells")

    base = [" ".join(f"{kind}{i % 9}" for i in range(30)) for kind in "abc"]
    texts = [base[0], base[1], base[0].upper(), base[0] + " a3 a4", base[2], base[1] + "\n b3", base[1], "", None, base[2] + " z"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    want = brute_components(range(len(texts)), texts, 3, 85)[0]
    assert want == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 1, 6: 1, 7: 7, 8: 8, 9: 4}
    plain = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    monkeypatch.setattr(minhash, "signatures", blunt)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()} == plain == want


@pytest.mark.parametrize("block", [8, 512])
def test_near_duplicates_need_no_proposal(spark, monkeypatch, block):
    """Links that no bucket proposes are found all the same, over one block and over several."""
    rng = np.random.default_rng(11)
    base = [f"w{rng.integers(10_000)}" for _ in range(150)]
    texts = []
    for i in range(90):
        t = list(base)
        for p in rng.choice(150, 2 + i % 2, replace=False):
            t[p] = f"x{i}_{p}"
        texts.append(" ".join(t))
    texts += [" ".join(f"{i}v{rng.integers(60)}" for _ in range(80)) for i in range(3)] + ["two words", "two words more"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    nothing = lambda members, lowest: members.selectExpr("rep AS a", "rep AS b", "float(1) AS est").limit(0)
    monkeypatch.setattr(minhash, "proposals", nothing)
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
    want = brute_components(range(len(texts)), texts, 3, 85)[0]
    assert 1 < len(set(want.values())) < len(texts) - 5
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()} == want


@pytest.mark.parametrize("words", [232, 240])
def test_near_duplicates_of_a_large_family_at_the_threshold(spark, words):
    """1,300 texts, each four words from one base: most pairs lie just below the threshold, the linked ones just above."""
    rng = np.random.default_rng(words)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for i in range(1300):
        t = list(base)
        for p in rng.choice(words, 4, replace=False):
            t[p] = f"x{i}_{p}"
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == near_components(texts, 3, 85)


def near_components(texts, k, percent):
    """Components by a matrix of all intersections: for families that share nearly all shingles."""
    sets = [t.split() for t in texts]
    sets = [{" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} for w in sets]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    common = [x for x in number if sum(x in s for s in sets[:50]) > 1]
    place = {x: i for i, x in enumerate(common)}
    matrix = np.zeros((len(sets), len(common)), np.float32)
    rest = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            if x in place:
                matrix[i, place[x]] = 1
            else:
                rest[x].append(i)
    both = matrix @ matrix.T
    for who in rest.values():
        for i in who:
            for j in who:
                both[i, j] += 1
    size = np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    root, seen = {}, set()
    for i in range(len(sets)):
        todo = [] if i in seen else [i]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                root[j] = i
                todo.extend(np.flatnonzero(linked[j]))
    return {i: root[i] for i in range(len(sets))}


def test_near_duplicates_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    kept = minhash.keep_one(df).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 3, 4, 5] and any(r.doc_id is None for r in kept)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    mine = df.withColumn("component_id", F.lit("mine")).withColumn("rep", F.lit("mine")).withColumn("key", F.lit("mine"))
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(mine).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (None, None, True), (4, 4, True), (5, 5, True)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (200, 150), (150, 200)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 150: 150, 200: 150}


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for r in raw:
        for p in range(len(r) - length + 1):
            seen[r[p : p + length]] += 1
    out = []
    for r in raw:
        cover = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                cover[p : p + length] = True
        runs = int(np.diff(np.concatenate([[0], cover.astype(int)])).clip(0).sum())
        out.append((len(r), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("length,most", [(40, 4096), (40, 2), (37, 3)])
def test_repeats_against_brute_force(spark, length, most):
    rng = np.random.default_rng(length + most)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [word(n) for n in (38, 45, 60, 120)]
    texts = [word(rng.integers(0, 90)) + "".join(s for s in shared if rng.random() < 0.5) + word(rng.integers(0, 90)) for _ in range(60)]
    texts += [texts[0], None, "", "z" * 300, "short", "ab" * 200]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = repeats.without_repeats(df, length, most).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute_repeats(texts, length)


def test_contexts_are_named_by_all_their_bytes():
    """Two runs of windows have one name only where all their bytes are equal, whatever their anchor's hash says."""
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.integers(0, 2, 300, dtype=np.uint8)) for _ in range(6)]
    raw = b"".join([*pieces, *pieces[:3], b"a" * 400])
    _, _, first, last, _, names = repeats.contexts_of(raw, np.array([len(raw)]), 40)
    seen = {}
    for a, b, name in zip(first, last, names):
        assert seen.setdefault(name, raw[a : b + 40]) == raw[a : b + 40]
    assert len(seen) == len(set(seen.values())) < len(names)


def test_repeats_query_and_awkward_rows(spark):
    d = documents()
    got = QUERIES["op6_repeats"](spark, SF).toPandas().set_index("doc_id").loc[d.doc_id]
    assert [tuple(x) for x in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == brute_repeats(d.text, 400)
    rows = repeats.without_repeats(spark.createDataFrame(ROWS, DOCS).withColumn("key", F.lit("mine")).withColumn("start", F.lit("mine")).withColumn("n", F.lit("mine"))).collect()
    assert len(rows) == len(ROWS)
    assert repeats.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def brute_shares(texts):
    words = [(t or "").encode().split() for t in texts]
    runs = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in words]
    seen = Counter(r for x in runs for r in x)
    return [any(seen[r] > 1 for r in x) for x in runs]


def test_repeats_tell_passages_of_over_50_words(spark):
    """Passages below 400 bytes that stand in several documents are told, and still not removed; those of 50 words aren't told."""
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))
    passages = [fresh(n) for n in (50, 51, 51, 52, 60, 90, 400)]
    texts = [f"{fresh(rng.integers(0, 90))} {p} {fresh(rng.integers(0, 90))}" for p in passages for _ in range(2)]
    texts += [passages[1].replace(" ", "\n\t"), f"{passages[2]}x", f"{passages[3]} {fresh(5)} {passages[3]}", fresh(51), "a " * 51, "b " * 60, "a " * 40]
    alone = fresh(70)
    texts += [f"{alone} {alone}", fresh(45), fresh(60), None, "", "a " * 30]
    texts += [texts[-4], texts[-5], fresh(60_000)]
    texts += [" ".join(texts[-1].split()[i : i + 51]) for i in (0, 26_000, 59_949)]
    got = sorted(repeats.without_repeats(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)).collect())
    assert [r.shares_passage for r in got] == brute_shares(texts)
    assert [(r.n_removed, r.n_spans) for r in got] == [r[1:3] for r in brute_repeats(texts, 400)]
    assert all(got[i].shares_passage and not got[i].n_removed for i in range(2, 8))
    d = documents()
    got = QUERIES["op6_repeats"](spark, SF).toPandas().set_index("doc_id").loc[d.doc_id]
    assert list(got.shares_passage) == brute_shares(d.text)


def best_fit_plainly(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(left, i) for i, (left, s, c) in enumerate(bins) if left >= size and not s & source and not c & cluster]
        if fits:
            i = min(fits)[1]
        else:
            bins.append((capacity, 0, 0))
            i = len(bins) - 1
        left, s, c = bins[i]
        bins[i] = (left - size, s | source, c | cluster)
        out.append(i)
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pieces = sorted(((int(rng.integers(0, 50)), 1 << int(rng.integers(0, 5)), (1 << int(rng.integers(0, 9))) * int(rng.random() < 0.4)) for _ in range(80)), reverse=True)
        assert packing.best_fit(pieces, 60) == best_fit_plainly(pieces, 60)


def test_packing_loses_nothing_and_keeps_conflicts_apart(spark):
    d = documents()
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), capacity=300, group=64).toPandas()
    words = d.set_index("doc_id").text.map(lambda t: len(t.encode().split()))
    assert got.groupby("doc_id").tokens.sum().to_dict() == words.to_dict()
    assert got.groupby("bin_id").tokens.sum().max() <= 300 and (got.groupby("bin_id").tokens.transform("sum") == got.bin_tokens).all()
    assert not got.duplicated(["bin_id", "source"]).any()
    text = d.set_index("doc_id").text
    whole = got[~got.bin_id.str.startswith("full")].assign(text=lambda x: x.doc_id.map(text))
    assert not whole.duplicated(["bin_id", "text"]).any()


def test_packing_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("copy", F.lit("mine")).withColumn("piece", F.lit("mine"))
    got = packing.pack(df, capacity=1000).toPandas()
    assert got.tokens.sum() == 2 + 2 + 2 + 0 + 2 + 0 + 60_000
    assert sorted(got.loc[got.doc_id == 2, "copy"]) == [1, 2]
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
