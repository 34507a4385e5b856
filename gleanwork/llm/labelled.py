"""Bounded samples of labelled rows, and a small logistic regression to fit on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on (in expectation; drawn by hash, the same in every run).
MOST_LABELLED = 20_000


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, bound: int = MOST_LABELLED, balanced: bool = False) -> DataFrame:
    """(doc_id, text, y, weight): labelled documents, at most about `bound` of them, by a hash of doc_id.

    Rows without a label or an id are left out, several labels of one id count once (the largest). With
    `balanced`, each class gets half of the bound. `weight` is how many labelled rows one of its class stands for.
    The sample of labels is bounded, so it is broadcast and the texts don't move.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.filter(usable) if usable is not None else marked
    marked = marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r.hot: r.n for r in marked.groupBy((F.col("y") > 0).alias("hot")).agg(F.count("*").alias("n")).collect()}  # two rows
    n = sum(totals.values())
    share = {hot: min(1.0, 0.97 * (bound / 2 / totals.get(hot, 1) if balanced else bound / max(n, 1))) for hot in (True, False)}
    share = {hot: 1.0 if x * totals.get(hot, 0) >= 0.97 * totals.get(hot, 0) else x for hot, x in share.items()}
    chance = F.when(F.col("y") > 0, F.lit(share[True])).otherwise(F.lit(share[False]))
    marked = marked.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) < chance * 1_000_000)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked.withColumn("weight", 1 / chance)), "doc_id")


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int = 60, inner: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression on sparse rows, by conjugate-gradient Newton steps.

    Entries are taken some at a time, so that little more than they themselves is held.
    """
    w, b, n = np.zeros(width), 0.0, len(y)
    parts = [slice(i, i + (1 << 20)) for i in range(0, len(rows), 1 << 20)]

    def times(v):
        return sum((np.bincount(rows[p], weights=values[p] * v[cols[p]], minlength=n) for p in parts), np.zeros(n))

    def back(u):
        return sum((np.bincount(cols[p], weights=values[p] * u[rows[p]], minlength=width) for p in parts), np.zeros(width))

    for _ in range(max(4, steps // 8)):
        p = 1 / (1 + np.exp(-np.clip(times(w) + b, -35, 35)))
        g, gb, s = back(p - y) + l2 * w, float((p - y).sum()), np.maximum(p * (1 - p), 1e-6)
        if max(np.abs(g).max(initial=0), abs(gb)) < 1e-4 * n:
            break
        d, db = np.zeros(width), 0.0
        r, rb = -g, -gb
        q, qb, rr = r.copy(), rb, float(r @ r + rb * rb)
        for _ in range(inner):
            hq = s * (times(q) + qb)
            aq, aqb = back(hq) + l2 * q, float(hq.sum())
            step = rr / max(float(q @ aq + qb * aqb), 1e-12)
            d, db, r, rb = d + step * q, db + step * qb, r - step * aq, rb - step * aqb
            new = float(r @ r + rb * rb)
            if new < 1e-8 * max(rr, 1e-12):
                break
            q, qb, rr = r + new / rr * q, rb + new / rr * qb, new
        w, b = w + d, b + db
    return w, b
