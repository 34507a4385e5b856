"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A feature is the logarithm of one plus the count of a hashed n-gram of the lower-cased characters, times the log
ratio of the rates at which toxic and clean training texts hold it. The ratio is shrunk smoothly by its own
uncertainty, so that no bucket needs a least count; all 2 ** BITS buckets take part. A logistic regression weighs
the scaled features. Ratios and weights come from a bounded sample of labelled rows, balanced between the classes
(at most about BOUND rows); the regression is fitted in one task, and the bias is put right for the classes' true
shares. Every whole text is scored, in pieces, so that its length bounds nothing but time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table, widened
from .labelled import logistic, sample_labelled

SIZES, BITS, PIECE = (3, 4, 5), 18, 1 << 20
#: Most labelled rows that the classifier is fitted on (in expectation, half of each class if there are as many).
BOUND = 5_000
#: Smoothing of the rates, pseudo-evidence that the ratios are shrunk by, and strength of the penalty.
SMOOTH, SHRINK, L2 = 1.0, 10.0, 4.0


def bucket_of(code: np.ndarray, n: int) -> np.ndarray:
    return ((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xBF58476D1CE4E5B9 % 2**64)) >> np.uint64(64 - BITS)


def ngram_hits(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket, count) of each text's buckets of character n-grams, in order."""
    whole = [" " + (t or "").lower() for t in texts]
    ends = np.cumsum([len(t) for t in whole])
    chars = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, len(chars), PIECE):
        piece = chars[at : at + PIECE + max(SIZES) - 1].astype(np.uint64)
        code, pairs = piece, []
        for n in range(2, max(SIZES) + 1):
            if len(code) < 2:
                break
            code = code[:-1] * np.uint64(0x100000001B3) + piece[n - 1 :]
            if n not in SIZES:
                continue
            bucket = bucket_of(code[:PIECE], n)
            where = np.arange(at, at + len(bucket))
            doc = np.searchsorted(ends, where, side="right")
            inside = where + n <= ends[doc]  # no n-gram spans two texts
            pairs.append((doc[inside].astype(np.uint64) << np.uint64(BITS)) | bucket[inside])
        pairs, n = np.unique(np.concatenate(pairs or [np.zeros(0, np.uint64)]), return_counts=True)
        found.append(pairs)
        counts.append(n)
    pairs, where = np.unique(np.concatenate(found), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64), counts


def strength(counts: np.ndarray) -> np.ndarray:
    """What a count is worth as a feature: its logarithm, so that no count is cut off."""
    return np.log1p(counts)


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of a string column of about `most` characters: (first index, texts)."""
    first, size, run = 0, 0, []
    for i, t in enumerate(column):
        text = t.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= most:
            yield first, run
            first, size, run = i + 1, 0, []
    if run:
        yield first, run


def bucket_counts(batches):
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        y = np.array(batch.column("y").to_pylist(), dtype=np.int64)
        for first, run in slices(batch.column("text")):
            doc, bucket, _ = ngram_hits(run)
            hot = y[first + doc] > 0
            pos += np.bincount(bucket[hot], minlength=1 << BITS)
            neg += np.bincount(bucket[~hot], minlength=1 << BITS)
    some = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "pos": pos[some], "neg": neg[some]})


class Model:
    """Bucket weights (naive Bayes ratio times regression weight) and a bias: what tasks need to score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, texts: list[str]) -> np.ndarray:
        doc, bucket, counts = ngram_hits(texts)
        z = np.bincount(doc, weights=self.weights[bucket] * strength(counts), minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def shrunk_ratio(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log ratio of the smoothed rates of n1 toxic and n0 clean texts, times z / (z + SHRINK) with z its squared error ratio."""
    p1, p0 = (pos + SMOOTH) / (n1 + 2 * SMOOTH), (neg + SMOOTH) / (n0 + 2 * SMOOTH)
    ratio = np.log(p1) - np.log(p0)
    error = (1 - p1) / (pos + SMOOTH) + (1 - p0) / (neg + SMOOTH)
    z = ratio**2 / np.maximum(error, 1e-9)
    return np.where(pos + neg > 0, ratio * z / (z + SHRINK), 0.0)


def fit(sample: DataFrame) -> Model:
    """Fit on (doc_id, text, y, weight), weight the labelled rows that a row of its class stands for.

    With one class or no rows at all, the score is the smoothed rate everywhere.
    """
    sample = stored(sample)  # bounded
    totals = {r.y > 0: (r.n, r.weight) for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    (n1, m1), (n0, m0) = totals.get(True, (0, 0.0)), totals.get(False, (0, 0.0))
    weights = np.zeros(1 << BITS)
    if not n1 or not n0:
        return Model(weights, float(np.log((m1 + 0.5) / (m0 + 0.5))))
    counts = sample.select("text", "y").mapInArrow(bucket_counts, "bucket int, pos long, neg long")
    # at most 2 ** BITS rows, whatever the input
    held = counts.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    ratio = shrunk_ratio(*(np.bincount(held["bucket"], weights=held[c], minlength=1 << BITS) for c in ("pos", "neg")), n1, n0)
    shared = sample.sparkSession.sparkContext.broadcast(ratio)

    def fitted(batches):
        """One row: weights and bias. Texts are taken in order of id, so that reruns agree."""
        rows = sorted((i if i is not None else -1, y, t) for b in batches for i, y, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "text"))))
        owner, cols, values = [], [], []
        for at in range(0, len(rows), 256):
            doc, bucket, n = ngram_hits([t for _, _, t in rows[at : at + 256]])
            owner.append((doc + at).astype(np.int32))
            cols.append(bucket.astype(np.int32))
            values.append((strength(n) * shared.value[bucket]).astype(np.float32))
        y = np.array([r[1] > 0 for r in rows], float)
        w, b = logistic(np.concatenate(owner), np.concatenate(cols), np.concatenate(values), y, 1 << BITS, L2, steps=40, inner=10)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w], pa.list_(pa.float64())), "b": [float(b)]})

    # one row of 2 ** BITS numbers from a bounded sample, whatever the input
    (found,) = sample.select("doc_id", "y", "text").repartition(1).mapInArrow(fitted, "w array<double>, b double").toArrow().to_batches()
    weights = found.column("w").values.to_numpy() * ratio
    bias = found.column("b")[0].as_py() + float(np.log(m1 / n1) - np.log(m0 / n0))
    discard(sample)
    return Model(weights, bias)


def with_scores(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """`docs` with `column`, the probability that the text is toxic.

    Null and empty texts get the bias (and a blank) alone; of long texts every character counts; equal texts and
    repeated rows get equal scores. An empty table stays empty. A caller's column of that name is replaced.
    """
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the input

    def score(batches):
        for batch in batches:
            got = [shared.value.score(run) for _, run in slices(batch.column("text"))]
            yield batch.append_column(column, pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64()))

    return docs.mapInArrow(score, widened(docs, **{column: "double"}))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learnt from the labels outside the held-out fold. A row without an id is in no fold: held_out is false."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(sample_labelled(docs, labels, "toxic", usable=fold != 0, bound=BOUND, balanced=True))
    scored = with_scores(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
