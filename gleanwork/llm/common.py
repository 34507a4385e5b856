"""Helpers the corpus operators share: reading, storing between steps, bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back.

    Survives lost executors, unlike a local checkpoint, and takes less room than a serialised one.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/gleanwork-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of `df` with further columns, for the map functions."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()]])


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join on a null-safe key, where `small` has one row a key and one key may hold much of `big`.

    `small` must be stored already, so that counting it is cheap; `rows` is what it counts as, where its rows
    are not narrow. Up to BROADCAST_ROWS it is broadcast; beyond, both sides are sorted and merged, and Spark
    splits the partition of a hot key among tasks while it runs (spark.sql.adaptive.skewJoin), at any size.
    """
    side = small.withColumnRenamed(key, "_key")
    side = F.broadcast(side) if (small.count() if rows is None else rows) <= BROADCAST_ROWS else side.hint("merge")
    return big.join(side, big[key].eqNullSafe(side["_key"]), how).drop("_key")
