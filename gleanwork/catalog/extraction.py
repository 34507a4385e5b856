"""Extraction by providers, and metrics of one's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..plans import providers
from ..registry import query


def numbers():
    """Long numbers first; if a text has none, shorter ones, and then any."""
    return providers.Patterns(*[{"number": rf"([0-9]{{{n},}})"} for n in (6, 3, 1)])


STAGED = """WITH n AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[0-9]{6,}') THEN 1 WHEN regexp_matches(text, '[0-9]{3,}') THEN 2 ELSE 3 END AS tries FROM documents),
r AS (SELECT doc_id, tries, CASE tries WHEN 1 THEN regexp_extract(text, '[0-9]{6,}') WHEN 2 THEN regexp_extract(text, '[0-9]{3,}') ELSE regexp_extract(text, '[0-9]+') END AS number, regexp_extract(text, '[A-Za-z]+') AS word FROM n)"""


@query(STAGED + """ SELECT doc_id, tries AS calls, CASE WHEN number = '' THEN 'NR' ELSE number END AS number, CASE WHEN word = '' THEN 'NR' ELSE word END AS word FROM r""")
def staged_with_retries(spark, sf_dir):
    """Numbers of all documents in up to three attempts, then words in a second stage that knows the numbers."""

    class Words(providers.Patterns):
        def __call__(self, texts, known, attempt):
            return [{"word": f["word"], "number": k["number"]} for f, k in zip(super().__call__(texts, known, attempt), known)]

    stages = [{"providers": {"numbers": numbers}}, {"providers": {"words": lambda: Words({"word": "([A-Za-z]+)"})}, "requires": ["number"]}]
    done = providers.run_stages(view(spark, sf_dir, "documents").select("doc_id", "text"), stages)
    return done.select("doc_id", F.col("attempts")["numbers"].alias("calls"), F.col("values")["number"].alias("number"), F.col("values")["word"].alias("word"))


@query("""SELECT reviewer_role, round_even(avg(CASE WHEN l_returnflag = l_linestatus THEN 1.0 WHEN l_returnflag = 'R' THEN 0.5 ELSE 0.0 END)::DOUBLE, 9) AS metric FROM fx_results WHERE reviewer_role IS NOT NULL GROUP BY 1""")
def own_metric(spark, sf_dir):
    """A metric of one's own as an aggregate of SQL: equal values count whole, an R half."""
    providers.register_metric(spark, "half_right", lambda a, b: ((a == b) + 0.5 * ((a != b) & (a == "R"))).mean())
    rows = view(spark, sf_dir, "fx_results").filter("reviewer_role is not null")
    return rows.groupBy("reviewer_role").agg(F.bround(F.call_function("half_right", "l_returnflag", "l_linestatus"), 9).alias("metric"))
