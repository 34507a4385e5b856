"""Quality rules, exact clustering and phrases: against SQL, against brute force, and the awkward rows."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import centroids, phrases, rules
from gleanwork.llm.queries import QUERIES, SQL

from ..conftest import SF, rows_of
from .test_text import DOCS


@pytest.mark.parametrize("name", ["op11_rules", "op12_centroids", "op13_phrases"])
def test_query_equals_its_oracle(spark, oracle, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle(SQL[name])
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], DOCS)


# quality rules


def brute_rules(rows):
    """(n_words, n_dup_lines, n_repeat_words, n_lines_removed, n_words_left, kept) of (doc_id, text, lang, source), in plain Python."""
    def lines(text):
        return [x for x in (text or "").split("\n") if x.split()]

    def normal(line):
        out = " ".join(line.lower().split())
        return "".join("0" if c.isdigit() and not (i and out[i - 1].isdigit()) else "" if c.isdigit() else c for i, c in enumerate(out))

    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, _, source in rows:
        hosts[source].add(text or "")
        for x in lines(text):
            holders[source, normal(x)].add(text)
    out = []
    for i, text, _, source in rows:
        words = (text or "").split()
        again = Counter(tuple(words[p : p + 5]) for p in range(len(words) - 4))
        covered = {q for p in range(len(words) - 4) if again[tuple(words[p : p + 5])] > 1 for q in range(p, p + 5)}
        gone = [x for x in lines(text) if len(holders[source, normal(x)]) > 10 and len(holders[source, normal(x)]) > 0.01 * len(hosts[source])]
        left = len(words) - sum(len(x.split()) for x in gone)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((i, len(words), len(lines(text)) - len(set(lines(text))), len(covered), len({normal(x) for x in gone}), left, not failed and left >= 10 and left >= 0.3 * len(words)))
    return out


def boilerplate_rows():
    def prose(i, n):
        letters = str.maketrans("0123456789", "abcdefghij")
        return " ".join(f"w{i}x{j}".translate(letters) for j in range(n))

    rows = [(i, f"Cookie  NOTICE {i} please accept\n{prose(i, 30)}\nsee you", "en", "a") for i in range(14)]
    rows += [(20 + i, f"cookie notice {i} please accept\nsee you\n{prose(i, 3)} and some more words", "en", "a") for i in range(3)]  # depleted
    rows += [(30, f"see you\n{prose(1, 20)}", "en", "b"), (31, f"see you\n{prose(1, 20)}", None, None)]  # other hosts
    rows += [(40 + i, f"one text\n{prose(99, 40)}", "en", "a") for i in range(30)]  # copies are one text
    rows += [(80, None, "en", "a"), (81, "", None, None), (None, prose(7, 12), "en", "a"), (None, prose(7, 12), "en", "a")]
    rows += [(90, " ".join(["a b c d e f g"] * 40), "en", "c"), (91, f"{prose(1, 60)} {prose(1, 6)}", "en", "c"), (92, "x y\nx y\n \nX y", "en", "c")]
    rows += [(93, f"{prose(5, 200_000)}\nsee you", "en", "a")]
    return rows


def test_rules_against_brute_force_and_awkward_rows(spark):
    rows = boilerplate_rows()
    df = frame(spark, rows).withColumn("kept", F.lit("mine")).withColumn("line", F.lit(1)).withColumn("words", F.lit(2)).repartition(5)
    got = rules.judge(df)
    assert set(got.columns) == set(df.columns) | set(rules.BASE) | {"n_lines_removed", "n_words_left", "removed_lines"}
    found = [(r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.n_lines_removed, r.n_words_left, r.kept) for r in got.collect()]
    assert sorted(found, key=str) == sorted(brute_rules(rows), key=str)
    kept = {r[0]: r[-1] for r in found}
    assert kept[0] and kept[40] and not kept[20] and not kept[90] and kept[93]
    assert rules.judge(df.limit(0)).collect() == []


def test_cleaning_takes_out_what_the_rules_count(spark):
    df = frame(spark, boilerplate_rows())
    left = {r.doc_id: r.n_words_left for r in rules.judge(df).filter("kept and doc_id is not null").collect()}
    clean = rules.clean(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.filter("doc_id is not null").collect()}
    assert {i: len(t.split()) for i, t in texts.items()} == left
    assert "see you" not in texts[0] and "see you" in texts[30]


# clustering


def brute_clusters(vectors, ids, k, rounds):
    import hashlib

    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in zip(ids, vectors)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        now = [[sum(c) // len(members[j]) for c in zip(*members[j])] if members[j] else c0 for j, c0 in enumerate(now)]
    return sorted((i, *reversed(nearest(v))) for i, v in kept), now


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_against_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 64))
    v = np.concatenate([m + spread * rng.normal(size=(50, 64)) for m in middles]).astype(np.float32)
    v[10:20] = v[0]  # ties and repeats
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got, now = centroids.clusters(df)
    want, last = brute_clusters(v, range(len(v)), 8, 10)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want and now.tolist() == last


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 60, (400, 8)) for m in (-900, -200, 300, 1000)]).astype(np.int64)
    now = x[[0, 1, 500, 900, 1300]].copy()
    cluster, best, second = centroids.scan(x, now)
    upper, lower, scans = np.sqrt(best), np.sqrt(second), []
    for _ in range(8):
        before = now
        now = np.array([np.floor_divide(x[cluster == j].sum(axis=0), max(1, (cluster == j).sum())) if (cluster == j).any() else before[j] for j in range(len(before))])
        cluster, upper, lower, n = centroids.reassign(x, cluster, upper, lower, before, now)
        own, best, second = centroids.scan(x, now)
        scans.append(n)
        assert (cluster == own).all() and (upper >= np.sqrt(best)).all() and (lower <= np.sqrt(second) * (1 + 1e-9)).all()
    assert scans[-1] < len(x) / 4


def test_equal_distances_go_to_the_smaller_number():
    x, now = np.array([[0, 0], [2, 0], [1, 5]]), np.array([[1, 0], [1, 0], [-1, 0]])
    assert centroids.scan(x, now)[0].tolist() == [0, 0, 0]
    cluster, *_ = centroids.reassign(x, np.array([1, 1, 1]), np.full(3, 9.0), np.zeros(3), now, now)
    assert cluster.tolist() == [0, 0, 0]


def test_clusters_of_awkward_rows(spark):
    good = [float(i) / 64 for i in range(64)]
    rows = [(1, good), (1, good), (None, good), (2, good[:63]), (3, None), (4, [*good[:63], None]), (5, [*good[:63], float("nan")]), (6, [*good[:63], float("-inf")]), (7, [-x for x in good])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("mine")).withColumn("x", F.lit(0))
    got, now = centroids.clusters(df)
    assert len(now) == 4 and sorted((str(r.vec_id), r.distance) for r in got.collect()) == [("1", 0), ("1", 0), ("7", 0), ("None", 0)]
    empty, none = centroids.clusters(df.limit(0))
    assert empty.collect() == [] and not len(none) and empty.columns == ["vec_id", "x", "cluster", "distance"]
    with pytest.raises(Exception, match="components beyond"):
        centroids.clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


# phrases


def brute_phrases(rows, least, longest):
    import re

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(g == lang and b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items() if b >= least):
            continue
        score, k = min((Fraction(1000 * a * total[lang], f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(4)
    vocabulary = np.array(["The", "of", "and", "ünter", "x", "ÀB", "new", "york", "city", "a\xa0b"])
    rows = []
    for i in range(60):
        words = rng.choice(vocabulary, 40, p=np.arange(10, 0, -1) / 55)
        marks = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ; "], 40, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append(("".join(a + b for a, b in zip(words, marks)), ["en", "de", None][i % 3]))
    rows += [("new york city hall of fame new", "en")] * 12 + [(None, "en"), ("", None), (" . ,", "fr"), ("of", "es")]
    return rows


@pytest.mark.parametrize("few", [True, False])
def test_phrases_against_brute_force(spark, monkeypatch, few):
    """Both ways of naming: by a broadcast of few names, and by joins; and in slices and blocks of a few words."""
    monkeypatch.setattr(phrases, "NAMES", 10**6 if few else -1)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("id", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    got = [(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, least=8, top=None).collect()]
    assert sorted(got) == brute_phrases(rows, 8, 5) and any(len(p[1].split()) == 5 for p in got)


def test_slices_of_a_text_lose_nothing(monkeypatch):
    text = "Aa b. c\t\td" + "e" * 50 + " f,g  h"
    whole = [w for part in phrases.tokens(text) for w in part]
    monkeypatch.setattr(phrases, "SLICE", 4)
    assert [w for part in phrases.tokens(text) for w in part] == whole == [b"aa", b"b", b"\xff", b"c", b"d" + b"e" * 50, b"f", b"\xff", b"g", b"h"]
    ids = np.array([0, 0, 3, 0, 4, 5, 0, 0, 6, 7, 8, 0, 9])
    assert phrases.packed(ids).tolist() == [4, 5, 0, 6, 7, 8, 0]


def test_phrases_rank_and_limits(spark):
    df = spark.createDataFrame([("a b. c d. e f. " * 5, "en"), ("x y " * 4, None)], "text string, lang string")
    got = [(r.lang, r["rank"], r.phrase) for r in phrases.collocations(df, longest=2, least=3, top=2).collect()]
    assert sorted(got) == [("en", 1, "a b"), ("en", 2, "c d"), ("und", 1, "x y"), ("und", 2, "y x")]
    assert phrases.collocations(df.limit(0)).collect() == []
    long = " ".join(f"w{i % 1000} of the" for i in range(200_000))
    got = phrases.collocations(spark.createDataFrame([(long, "en")], "text string, lang string"), longest=3)
    assert got.filter("phrase = 'of the'").first().a == 200_000 and got.filter("phrase = 'w7 of'").first() is None  # used up by `w7 of the`
