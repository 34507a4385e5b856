"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Evidence of a text is a naive Bayes log ratio over binned statistics (symbols, repeated words and lines,
word lengths, ...), calibrated on a bounded sample of labelled rows. Every document then votes with its
probability for its host (source) and path (source and language). A site's posterior is a beta-binomial
mean: its own votes shrunk toward its parent's posterior (path to host, host to all), by a prior strength
that the spread between sites itself gives (method of moments). Sparse sites stay near the global prior. For each
document its own vote is taken out of its host's and path's sums again, so that no text counts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stored, table, widened
from .labelled import MOST_LABELLED, logistic, sample_labelled

#: Characters that prose rarely holds.
SYMBOLS = "#%&*$|<>{}[]\\^~_=@"
STATS = ("symbols", "pipes", "digits", "capitals", "stops", "word_length", "log_words", "distinct_words", "same_next", "distinct_lines", "spread")
BINS = 12
#: Bounds of the prior strength in pseudo-documents, and the posterior below which a document is rejected.
STRENGTH, KEEP_AT = (2.0, 1000.0), 0.25

_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in SYMBOLS]] = 1
_CLASS[ord("|")] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord("A") : ord("Z") + 1] = 4
_CLASS[[ord(c) for c in ".!?"]] = 5


def statistics(text: str) -> tuple[float, ...]:
    """STATS of one whole text, all shares and logarithms; an empty text gives zeros and ones."""
    raw = text.encode()
    n = max(1, len(raw))
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    words = raw.split()
    m = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x]
    kinds = len(set(words))
    # distinct words against what a text of that length usually has
    return (by[1] / n, by[2] / n, by[3] / n, by[4] / n, by[5] / m, len(raw) / m, np.log1p(len(words)), kinds / m, same / m, len(set(lines)) / max(1, len(lines)), np.log1p(kinds) / np.log1p(m))


class Evidence:
    """Bin edges and log ratios of each statistic, then a calibration: a weight for each statistic's ratio and a bias."""

    def __init__(self, edges: list[np.ndarray], ratios: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.ratios, self.weights, self.bias = edges, ratios, weights, bias

    def raw(self, stats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(stats), len(self.edges)))
        for i, e in enumerate(self.edges):
            out[:, i] = self.ratios[i][np.searchsorted(e, stats[:, i], side="right")]
        return out

    def logit(self, texts: list[str]) -> np.ndarray:
        stats = np.array([statistics(t or "") for t in texts]).reshape(-1, len(STATS))
        return np.clip(self.raw(stats) @ self.weights + self.bias, -15, 15)


def fit(sample: DataFrame) -> Evidence:
    """Fit on (doc_id, text, y). Without rows of both classes, every text gets evidence 0."""

    def measure(batches):
        for batch in batches:
            stats = np.array([statistics(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), **{s: stats[:, i] for i, s in enumerate(STATS)}})

    schema = "doc_id long, y int, " + ", ".join(f"{s} double" for s in STATS)
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(measure, schema).orderBy("doc_id").toPandas()
    stats, y = rows[list(STATS)].to_numpy(), (rows["y"] > 0).to_numpy()
    if y.all() or not y.any():
        return Evidence([np.zeros(0)] * len(STATS), np.zeros((len(STATS), BINS + 1)), np.zeros(len(STATS)), 0.0)
    edges, ratios = [], np.zeros((len(STATS), BINS + 1))
    for i in range(len(STATS)):
        # bins by quantiles of both classes, so that the rarer one gets its own
        e = np.unique(np.concatenate([np.quantile(stats[k, i], np.linspace(0, 1, BINS // 2 + 1)[1:-1]) for k in (y, ~y)]))
        b = np.searchsorted(e, stats[:, i], side="right")
        good, bad = (np.bincount(b[k], minlength=BINS + 1) + 1.0 for k in (y, ~y))
        edges.append(e)
        ratios[i] = np.log(good / good.sum()) - np.log(bad / bad.sum())
    out = Evidence(edges, ratios, np.zeros(len(STATS)), 0.0)
    z = out.raw(stats)
    rows, cols = np.divmod(np.arange(z.size), z.shape[1])
    out.weights, out.bias = logistic(rows, cols, z.ravel(), y.astype(float), z.shape[1], 1.0)
    return out


def with_evidence(docs: DataFrame, model: Evidence) -> DataFrame:
    """`docs` with evidence, the log odds that the text alone gives; a null text counts as empty."""
    docs = docs.drop("evidence")

    def run(batches):
        for batch in batches:
            yield batch.append_column("evidence", pa.array(model.logit(batch.column("text").to_pylist()), pa.float64()))

    return docs.mapInArrow(run, widened(docs, evidence="double"))


def vote(evidence: Column) -> Column:
    return 1 / (1 + F.exp(-evidence))


def shrunk(votes: Column, n: Column, strength: Column, parent: Column) -> Column:
    return (votes + strength * parent) / (n + strength)


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """One row a path (site) of (source, site, evidence): its and its host's votes and counts, the prior, both strengths and posteriors.

    All sums are grouped and over all documents; only three numbers come to the driver. A null host or language is its own.
    """
    paths = stored(evidence.groupBy("site", "source").agg(F.sum(vote(F.col("evidence"))).alias("votes"), F.count("*").alias("n")))
    hosts = stored(paths.groupBy("source").agg(F.sum("votes").alias("host_votes"), F.sum("n").alias("host_n")))
    prior = hosts.agg(F.sum("host_votes") / F.sum("host_n")).first()[0]
    hosts = with_shrunk(hosts.withColumn("prior", F.lit(prior).cast("double")), "host_votes", "host_n", "prior", "host")
    joined = paths.join(hosts.withColumnRenamed("source", "_host"), F.col("source").eqNullSafe(F.col("_host")))
    return stored(with_shrunk(joined, "votes", "n", "host_posterior", "path").drop("_host", "source"))


def with_shrunk(sites: DataFrame, votes: str, n: str, parent: str, name: str) -> DataFrame:
    """`sites` with {name}_strength, the prior strength in pseudo-documents, and {name}_posterior."""
    rate, mean = F.col(votes) / F.col(n), F.col(parent)
    spread = F.avg((rate - mean) ** 2 - mean * (1 - mean) / F.col(n))
    strength = F.when(spread > 0, F.least(F.greatest(F.avg(mean * (1 - mean)) / spread - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
    m = F.lit(sites.agg(strength).first()[0]).cast("double")
    return sites.withColumn(f"{name}_strength", m).withColumn(f"{name}_posterior", shrunk(F.col(votes), F.col(n), m, mean))


#: What `judge` adds or uses on the way; a caller's columns of these names are replaced.
OWN = ("evidence", "host_posterior", "path_posterior", "posterior", "keep", "site", "prior", "votes", "n", "host_votes", "host_n", "host_strength", "path_strength")


def judge(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, bound: int = MOST_LABELLED) -> DataFrame:
    """`docs` with evidence, host_posterior, path_posterior, posterior and keep.

    The posteriors of host and path are those without the document's own vote. The posterior's log odds are the
    text's evidence, moved by how far its path's posterior stands from the global prior. A null text counts as
    empty; null sources and languages are sites of their own; of long texts every byte counts; repeated rows are
    judged alike. An empty table stays empty; without labels of both classes every text is kept. Caller columns
    named as in OWN are replaced.
    """
    docs = docs.drop(*OWN)
    seen = with_evidence(docs, fit(sample_labelled(docs, labels, "quality", bound=bound)))
    site = F.to_json(F.struct("source", "lang"))
    sites = site_posteriors(seen.select("source", "evidence", site.alias("site")))
    out = join_small(seen.withColumn("site", site), sites.drop("host_posterior", "path_posterior"), "site")
    own = vote(F.col("evidence"))
    out = out.withColumn("host_posterior", shrunk(F.col("host_votes") - own, F.col("host_n") - 1, F.col("host_strength"), F.col("prior")))
    out = out.withColumn("path_posterior", shrunk(F.col("votes") - own, F.col("n") - 1, F.col("path_strength"), F.col("host_posterior")))
    logit = lambda c: F.log(c / (1 - c))
    squeeze = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.col("evidence") + logit(squeeze("path_posterior")) - logit(squeeze("prior"))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("posterior") >= keep_at)
    return out.select(*docs.columns, "evidence", "host_posterior", "path_posterior", "posterior", "keep")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Evidence, posteriors and verdict of all `documents`, fitted on `labels.quality`: see `judge` for the awkward rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = judge(docs.select("doc_id", "text", "lang", "source"), labels)
    return judged.select("doc_id", "evidence", "host_posterior", "path_posterior", "posterior", "keep")
