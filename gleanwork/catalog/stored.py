"""Writes in place, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import view
from ..registry import query
from ..sources import upserts
from ..storage import shared_dir

def _results(spark, sf_dir):
    return view(spark, sf_dir, "fx_results").select("document_id", "slot", "l_returnflag", "l_quantity")


def _at(day: str):
    return F.lit(day).cast("timestamp")


@query("""WITH changed AS (SELECT document_id, slot, CASE WHEN slot = 1 THEN 'X' ELSE l_returnflag END AS flag FROM fx_results WHERE document_id % 10 = 3 UNION ALL SELECT -document_id, slot, l_returnflag FROM fx_results WHERE slot = 7)
SELECT coalesce(r.document_id, c.document_id) AS document_id, coalesce(r.slot, c.slot) AS slot, coalesce(c.flag, r.l_returnflag) AS l_returnflag, r.l_quantity,
CASE WHEN c.flag IS NOT NULL AND r.l_returnflag IS DISTINCT FROM c.flag THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS updated_at
FROM fx_results r FULL JOIN changed c ON r.document_id = c.document_id AND r.slot = c.slot""")
def stored_upsert(spark, sf_dir):
    """Results as a stored table, after an upsert of changed, unchanged and new rows."""
    path, results = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}", _results(spark, sf_dir)
    upserts.create(results, ["document_id", "slot"], path, _at("2024-01-01"))
    flag = F.when(F.col("slot") == 1, "X").otherwise(F.col("l_returnflag"))
    changed = results.filter("document_id % 10 = 3").withColumn("l_returnflag", flag).drop("l_quantity")
    changed = changed.unionByName(results.filter("slot = 7").withColumn("document_id", -F.col("document_id")).drop("l_quantity"))
    upserts.upsert(spark, path, changed, ["document_id", "slot"], [F.asc("l_returnflag")], _at("2024-01-02"))
    return upserts.read(spark, path).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("""SELECT document_id, slot, CASE WHEN slot = 2 AND l_returnflag = 'N' THEN 'Q' ELSE l_returnflag END AS l_returnflag, l_quantity,
CASE WHEN slot = 2 AND l_returnflag = 'N' THEN TIMESTAMP '2024-01-03' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM fx_results WHERE NOT (document_id % 10 = 4 AND slot > 2)""")
def stored_edits(spark, sf_dir):
    """The same table after an update and a delete by predicate."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    upserts.create(_results(spark, sf_dir), ["document_id", "slot"], path, _at("2024-01-01"))
    upserts.update(spark, path, (F.col("slot") == 2) & F.col("l_returnflag").isin("N", "Q"), _at("2024-01-03"), l_returnflag=F.lit("Q"))
    upserts.delete(spark, path, (F.col("document_id") % 10 == 4) & (F.col("slot") > 2))
    return upserts.read(spark, path).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
