"""Folders of page-marked texts, written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import view
from ..registry import query
from ..sources import paged
from ..storage import shared_dir

#: Turns that one file holds at most, so that a long conversation is many files.
TURNS = 64
BREAK = "\n\n"

_PAGES = f"""WITH turns AS (SELECT conv_id || '-' || (turn // {TURNS}) AS stem, coalesce(text, '') AS text,
row_number() OVER (PARTITION BY conv_id, turn // {TURNS} ORDER BY turn, role, text) AS page FROM conversations),
placed AS (SELECT stem, page, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY stem ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM turns)"""


def _folder(spark, sf_dir) -> str:
    """Every conversation as files of TURNS pages, a turn a page."""
    turns = view(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("stem", F.expr(f"conv_id || '-' || (turn div {TURNS})"))
    n, order = F.length("text"), Window.partitionBy("stem").orderBy("turn", "role", "text")
    start = F.coalesce(F.sum(n + len(BREAK)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.select("stem", "text", F.row_number().over(order).alias("page"), start.alias("start_char"), (start + n).alias("end_char"))
    # grouped by the key of the window: one shuffle for both
    made = turns.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("page", "start_char", "end_char", "text"))).alias("all"))
    pages = F.transform("all", lambda p: F.struct(p["page"].alias("page"), p["start_char"].alias("start_char"), p["end_char"].alias("end_char")))
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    paged.write(made.select("stem", F.array_join(F.col("all.text"), BREAK).alias("text"), pages.alias("pages")), path)
    return path


@query(f"{_PAGES} SELECT stem, page, start_char::BIGINT AS start_char, (start_char + length(text))::BIGINT AS end_char, text FROM placed")
def stored_pages(spark, sf_dir):
    """Conversations as a folder of files with page maps, read back a row a page."""
    return paged.cut_pages(paged.read(spark, _folder(spark, sf_dir), split_bytes=1 << 20))


@query(f"{_PAGES} SELECT stem, count(*) AS pages, sum(length(text) + 2)::BIGINT - 2 AS n_chars FROM placed WHERE contains(stem, '7') GROUP BY stem ORDER BY stem LIMIT 20")
def named_texts(spark, sf_dir):
    """The first 20 files by name whose stem holds a 7: files of other names are never opened."""
    found = paged.read(spark, _folder(spark, sf_dir)).filter(F.col("stem").contains("7"))
    return found.select("stem", F.size("pages").cast("long").alias("pages"), F.length("text").cast("long").alias("n_chars")).orderBy("stem").limit(20)
