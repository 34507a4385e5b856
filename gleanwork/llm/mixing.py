"""Mixing sources to target weights.

Tokens are summed per source, each source gets a repetition rate, and each document goes out
floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, stored, table

#: Weights of the sources in code point order, repeating; share of all words that the mix takes;
#: most that a source is repeated.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 sum: the same in every run and every engine."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target): water-filling of share * all sizes under caps of most * source size.

    One row a source, null its own source, last in the order. A source that has no words has target 0.
    The windows run over the table of sources alone, never over documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    turn = Window.orderBy("_reach", "_rank")
    before, after = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        by_source.withColumn("_rank", rank)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_reach", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
        # the level if all sources before this one are at their caps; the water level is the highest of them
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
        .withColumn("_water", F.max("_level").over(every))
        .select("source", "source_size", F.least(F.col("_cap"), F.col("_water") * F.col("_weight")).alias("target"))
    )


def with_copies(docs: DataFrame, seed: str = "mix", size: Column | None = None, **kw) -> DataFrame:
    """`docs` with size, source_size, target and copies (how often the mix takes the document).

    Null or empty texts have size 0 and are taken as the rate says. Equal doc_ids share one draw, so
    repeated rows behave alike. Columns of these four names are replaced; others pass through.
    """
    size = word_count(F.col("text")) if size is None else size
    sized = docs.withColumn("_size", size).drop("size", "source_size", "target", "copies").withColumnRenamed("_size", "size")
    targets = stored(source_targets(sized.select("source", "size"), **kw))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (unit_hash(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return join_small(sized, targets, "source").withColumn("copies", F.floor(rate).cast("long") + extra)


def mix(docs: DataFrame, seed: str = "mix", **kw) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of `docs`."""
    taken = with_copies(docs, seed, **kw)
    return taken.withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of all `documents`: see `with_copies` for the awkward rows."""
    taken = with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM by_source
), reach AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM ranked
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM reach
), targets AS (
  SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
