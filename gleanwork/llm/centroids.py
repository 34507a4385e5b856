"""Centroid clustering in exact integers, with Hamerly's bounds.

Vectors become integers. A vector keeps one upper bound of the distance to its own centroid and one lower bound of
the distance to the nearest other one. Between rounds the upper bound grows by how far its centroid moved, and the
lower one shrinks by how far any other moved; a vector whose upper bound stays below its lower bound keeps its
centroid unseen. The others measure their own centroid again, and if that doesn't decide, all of them, in exact
integers. Bounds are floats that are always rounded away from a decision, so that ties reach the exact scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Components of a vector, what they are multiplied by, centroids and rounds.
WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: Integer components beyond this are refused: squared distances would leave 64 bits.
LARGEST = 1 << 27
#: Relative room that the float bounds leave for rounding.
ROOM = 1e-9


def integers(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>) of (vec_id, embedding): vectors with exactly `width` components, none null or non-finite, as floor(scale * component).

    Wrong lengths, null vectors and vectors with null or non-finite components are left out. A component of over
    LARGEST / scale raises an error.
    """
    wide = F.transform("embedding", lambda v: v.cast("double"))
    whole = (F.size("embedding") == width) & ~F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    x = F.transform(wide, lambda v: F.floor(v * scale))
    safe = F.when(F.forall(x, lambda v: F.abs(v) <= LARGEST), x.cast("array<int>")).otherwise(F.raise_error(F.lit(f"components beyond {LARGEST // scale}")).cast("array<int>"))
    return docs.filter(F.coalesce(whole, F.lit(False))).select("vec_id", safe.alias("x"))


def seeds(vectors: DataFrame, k: int = CENTROIDS, seed: str = "3") -> np.ndarray:
    """The k vectors (or all) with the smallest SHA-256 of `seed:vec_id`, in that order; ties by the components. A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.withColumn("_h", digest).orderBy("_h", "x").limit(k).select("x").collect()  # k rows
    return np.array([r.x for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return (d * d).sum(axis=-1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, its squared distance, squared distance to the nearest other one), ties to the smaller number."""
    every = np.stack([squared(x, c) for c in centroids], axis=1)
    own = every.argmin(axis=1)
    rows = np.arange(len(x))
    best = every[rows, own]
    every[rows, own] = np.iinfo(np.int64).max
    return own, best, every.min(axis=1)


def loosen(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that still hold after the centroids moved."""
    drift = np.sqrt(squared(before, now).astype(float)) * (1 + ROOM)
    others = np.array([max(np.delete(drift, i), default=0.0) for i in range(len(drift))])
    return (upper + drift[cluster]) * (1 + ROOM), lower - others[cluster] - ROOM * np.abs(lower)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, how many vectors were scanned in full) under the moved centroids."""
    upper, lower = loosen(cluster, upper, lower, before, now)
    cluster = cluster.copy()
    open_ = np.flatnonzero(upper >= lower)
    upper[open_] = np.sqrt(squared(x[open_], now[cluster[open_]]).astype(float)) * (1 + ROOM)
    open_ = open_[upper[open_] >= lower[open_]]
    if len(open_):
        cluster[open_], best, second = scan(x[open_], now)
        upper[open_], lower[open_] = np.sqrt(best.astype(float)) * (1 + ROOM), np.sqrt(second.astype(float)) * (1 - ROOM)
    return cluster, upper, lower, len(open_)


STATE = "vec_id long, x array<int>, cluster int, upper double, lower double"
NAMES = ["vec_id", "x", "cluster", "upper", "lower"]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)


def started(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """State of the first round: every vector scanned in full."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if len(batch):
                own, best, second = scan(_matrix(batch), centroids)
                upper, lower = np.sqrt(best.astype(float)) * (1 + ROOM), np.sqrt(second.astype(float)) * (1 - ROOM)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)], names=NAMES)

    return vectors.mapInArrow(run, STATE)


def moved(state: DataFrame, before: np.ndarray, now: np.ndarray) -> DataFrame:
    """The next round's state."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if len(batch):
                held = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")]
                cluster, upper, lower, _ = reassign(_matrix(batch), *held, before, now)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], names=NAMES)

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each cluster's componentwise floor(sum / count); empty clusters keep their centroid. One row a cluster comes to the driver."""
    width = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(width)])
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def clusters(docs: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = "3") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, x, cluster, distance) of every kept vector of (vec_id, embedding), the final centroids).

    See `integers` for vectors that are left out and `seeds` for how centroids start. Fewer vectors than k give
    fewer centroids. Repeated rows and equal vectors stay, under their ids. An empty table gives no rows. Each
    round's state is stored, so that a lost executor costs one round's reading; the state before it is deleted.
    """
    vectors = stored(integers(docs.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), width, scale))
    now = seeds(vectors, k, seed)
    if not len(now):
        return vectors.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    state, before = stored(started(vectors, now)), now
    discard(vectors)
    for _ in range(rounds):
        before, now = now, means(state, now)
        last, state = state, stored(moved(state, before, now))
        discard(last)

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cluster = batch.column("cluster")
            d = squared(_matrix(batch), now[cluster.to_numpy(zero_copy_only=False)]) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), cluster, pa.array(d, pa.int64())], names=["vec_id", "x", "cluster", "distance"])

    return state.mapInArrow(measure, "vec_id long, x array<int>, cluster int, distance long"), now


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Clusters of all `embeddings`: see `clusters` for the awkward rows."""
    out, centroids = clusters(table(spark, sf_dir, "embeddings"))
    out = stored(out.drop("x"))
    by = {r.cluster: r.total for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # one row a cluster
    digests = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids.tolist())}
    pick = lambda values, kind: F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("cluster")) if values else F.lit(None).cast(kind)
    return out.select(
        "vec_id", "cluster", "distance", pick({k: v for k, v in by.items()}, "long").cast("long").alias("cluster_inertia"),
        F.lit(sum(by.values())).cast("long").alias("inertia"), pick(digests, "string").alias("centroid_sha256"),
    )


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    nearest = """a{r} AS MATERIALIZED (SELECT v.r, v.x, arg_min(c.c, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c)) AS c,
  min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))::BIGINT AS d FROM v, c{r} c GROUP BY v.r, v.x)"""
    mean = """c{n} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT c, list(CASE WHEN s % n < 0 THEN (s - s % n) // n - 1 ELSE (s - s % n) // n END ORDER BY i) AS x FROM (
    SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)"""
    parts = [nearest.format(r=0)]
    for r in range(rounds):
        parts += [mean.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {k}),
{", ".join(parts)}
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c"""


OP12_SQL = _sql()
