"""Best-fit packing under conflicts.

Documents are dealt by hash into groups of about GROUP pieces, and each group is packed on its own:
pieces by falling size, bins ordered by what room they have left. A bin carries a bitmap of its sources
and one of its duplicate clusters; the search starts at the tightest bin with enough room and goes on to
its successors until the first that shares neither a source nor a cluster with the piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .mixing import word_count

#: Words a bin holds, and pieces a group holds on average: bounds a task's memory at any input size.
CAPACITY, GROUP = 2048, 4096


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (size, source bit, cluster bits) in the order given; sizes are at most `capacity`."""
    room: list[tuple[int, int]] = []  # (left, bin), ordered
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        at = bisect_left(room, (size, -1))
        while at < len(room) and (sources[room[at][1]] & source or clusters[room[at][1]] & cluster):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        insort(room, (left - size, b))
        out.append(b)
    return out


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
    source = rows["source"].fillna("\0").factorize()[0]
    names, _ = rows["cluster"].factorize()
    several = rows["cluster"].duplicated(keep=False).to_numpy()
    bit = pd.Series(names).where(several).factorize()[0]  # -1: alone in its cluster, can't conflict
    pieces = [(int(n), 1 << int(s), 1 << int(c) if c >= 0 else 0) for n, s, c in zip(rows["tokens"], source, bit)]
    bins = best_fit(pieces, capacity)
    out = rows[["doc_id", "copy", "piece", "tokens", "source"]].copy()
    number = pd.Series(bins, index=out.index)
    out["bin_id"] = [f"{g}-{b}" for g, b in zip(rows["group"], bins)]
    out["bin_tokens"] = out["tokens"].groupby(number).transform("sum") if len(out) else out["tokens"]
    out["place"] = (out.groupby(number).cumcount() if len(out) else number).astype("int32")
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, copy, piece, tokens, source, bin_id, bin_tokens, place): each document's pieces and their bins.

    A document longer than a bin is cut into full bins of its own and one rest that is packed; no word is
    lost. Null or empty texts have 0 words and still get a bin. Documents of one source (null is one),
    or with equal texts, never share a bin. `copy` numbers repeated rows of an id.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.md5(text.cast("binary")).alias("cluster"))
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "source", "cluster")))
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = sized.withColumn("piece", full).withColumn("tokens", (F.col("size") % capacity).cast("long")).filter((F.col("tokens") > 0) | (F.col("size") == 0))
    whole = sized.filter(full > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), full - 1))).withColumn("tokens", F.lit(capacity).cast("long"))
    whole = whole.select(
        "doc_id", "copy", "piece", "tokens", "source",
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy", "piece").alias("bin_id"), F.col("tokens").alias("bin_tokens"), F.lit(0).alias("place"),
    )
    groups = max(1, -(-docs.count() // group))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)))
    schema = "doc_id long, copy int, piece int, tokens long, source string, bin_id string, bin_tokens long, place int"
    packed = dealt.drop("size").groupBy("group").applyInPandas(lambda rows: pack_group(rows, capacity), schema)
    return packed.unionByName(whole)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Bins of all `documents`: see `pack` for the awkward rows."""
    return pack(table(spark, sf_dir, "documents"))
