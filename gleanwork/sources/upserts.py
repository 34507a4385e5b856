"""Tables that are written in place: rows lie in buckets by the hash of their key, and only buckets with changes are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import latest
from ..storage import written

BUCKETS = 64


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    """Replace the buckets that `rows` hold, all others stay as they are."""
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(rows: DataFrame, keys: list[str], path: str, now: Column, buckets: int = BUCKETS) -> None:
    """Write a table with a row a key, all of them updated_at `now`. The number of buckets stays the table's."""
    _write(_bucketed(rows.withColumn("updated_at", now.cast("timestamp")), keys, buckets), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _of(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("bucket").isin(numbers))


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: list[Column], now: Column, buckets: int = BUCKETS) -> int:
    """Insert rows with new keys and update the others; of several incoming rows of a key the first in the order counts.

    Columns that `incoming` lacks keep their values (null in a new row). `updated_at` becomes `now` where a value changes
    or a row is new, and nowhere else. Only the buckets that hold incoming keys are read and rewritten, and those that
    nothing changes in aren't; returns how many were. Running it again changes nothing. Keys are never null.
    """
    given = [c for c in incoming.columns if c not in keys]
    new = written(_bucketed(latest(incoming, keys, order), keys, buckets).withColumnsRenamed({c: f"_new_{c}" for c in given}).withColumn("_new", F.lit(True)))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
    if not touched:
        return 0
    old = _of(spark, path, touched)
    kept = [c for c in old.columns if c not in (*keys, "bucket", "updated_at")]
    both = old.withColumn("_old", F.lit(True)).join(new, [*keys, "bucket"], "full_outer")
    differs = F.col("_old").isNull()
    for c in given:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    changed = F.col("_new").isNotNull() & differs
    values = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in given else F.col(c) for c in kept}
    merged = both.select(*keys, *[v.alias(c) for c, v in values.items()], F.when(changed, now.cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"), "bucket", changed.alias("_changed"))
    return _replace(merged, path)


def update(spark: SparkSession, path: str, condition: Column, now: Column, **values: Column) -> int:
    """Set columns where the condition is true; updated_at where that changes a value. Returns how many buckets were rewritten."""
    rows = spark.read.parquet(path)
    hit, differs = F.coalesce(condition, F.lit(False)), F.lit(False)
    for c, v in values.items():
        differs = differs | ~F.col(c).eqNullSafe(v)
    rows = rows.withColumn("_changed", hit & differs)
    return _replace(rows.withColumns({c: F.when(F.col("_changed"), v).otherwise(F.col(c)) for c, v in values.items()} | {"updated_at": F.when(F.col("_changed"), now.cast("timestamp")).otherwise(F.col("updated_at"))}), path)


def delete(spark: SparkSession, path: str, condition: Column) -> int:
    """Take out the rows for which the condition is true; returns how many buckets were rewritten. A bucket may become empty."""
    rows = spark.read.parquet(path)
    gone = F.coalesce(condition, F.lit(False))
    touched = [r.bucket for r in rows.filter(gone).select("bucket").distinct().collect()]
    if not touched:
        return 0
    left = written(rows.filter(F.col("bucket").isin(touched) & ~gone))
    full = {r.bucket for r in left.select("bucket").distinct().collect()}
    _write(left, path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    for b in set(touched) - full:  # nothing to overwrite an emptied bucket with
        folder = spark._jvm.org.apache.hadoop.fs.Path(fs, f"bucket={b}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return len(touched)


def _replace(rows: DataFrame, path: str) -> int:
    """Write the buckets in which a row is marked as _changed; they are written apart first, since they are read from here."""
    marked = written(rows)
    touched = [r.bucket for r in marked.filter("_changed").select("bucket").distinct().collect()]
    if touched:
        _write(marked.filter(F.col("bucket").isin(touched)).drop("_changed"), path)
    return len(touched)
