"""Synonyms and canonical terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import vocabulary
from ..registry import query

#: Names of every fiftieth part and of the part three times as far along mean the same; classes of the chains of such pairs.
CLASSES = """WITH RECURSIVE pairs AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey * 3 WHERE x.p_partkey % 50 = 1),
sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, a AS b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
classes AS (SELECT a AS term, min(b) AS canonical FROM reach GROUP BY 1)"""


def synonyms(spark, sf_dir):
    part = view(spark, sf_dir, "part").select("p_partkey", "p_name")
    few = part.filter("p_partkey % 50 = 1").select((F.col("p_partkey") * 3).alias("p_partkey"), F.upper("p_name").alias("a"))
    return few.join(part, "p_partkey").select("a", F.col("p_name").alias("b"))


@query(CLASSES + " SELECT term, canonical FROM classes")
def synonym_classes(spark, sf_dir):
    return vocabulary.classes(synonyms(spark, sf_dir))


@query(CLASSES + """, named AS (SELECT p_brand, p_partkey, p_name, canonical FROM part LEFT JOIN classes ON term = p_name)
SELECT p_brand, string_agg(coalesce(canonical, p_name), ' and ' ORDER BY p_partkey) AS names, count(canonical)::INT AS found FROM named GROUP BY 1""")
def canonical_texts(spark, sf_dir):
    """Each brand's list of parts as a text, in canonical terms."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.initcap(x["p_name"])), ", and ")
    texts = view(spark, sf_dir, "part").groupBy("p_brand").agg(listed.alias("names"))
    return vocabulary.canonicalised(texts, "p_brand", "names", vocabulary.classes(synonyms(spark, sf_dir)))
