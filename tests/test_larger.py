"""Registered queries on what the small tables don't hold: document 0 in every slot, tables of many rows a key."""

import datetime
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanwork import queries
from gleanwork.llm import phrases
from gleanwork.operators import chunks, vocabulary

from .conftest import SF, rows_of
from .test_files import plain_ratio
from .test_vocabulary import plain_canonical


def held_against_sql(spark, name, sf_dir, tables):
    """`tables`: name -> (rows, schema), written to sf_dir for both engines."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{sf_dir}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got, want = queries.QUERIES[name](spark, str(sf_dir)).toPandas(), con.execute(queries.SQL[name]).df()
    assert rows_of(got) == rows_of(want)
    return got


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
DAY = datetime.datetime(2024, 1, 1)


def test_upsert_results_keeps_both_rows_of_document_0(spark, tmp_path):
    orders = [(i, 0, "F", 1.0, DAY, "1-URGENT") for i in range(3)]
    lines = [(i, 1, 1, slot, 5.0 + slot, 2.0, 0.0, 0.0, "N", "O", DAY) for i in range(3) for slot in (1, 2, 7)]
    got = held_against_sql(spark, "upsert_results", tmp_path, {"orders": (orders, ORDERS), "lineitem": (lines, LINES)})
    assert sorted(got[(got.document_id == 0) & (got.slot == 7)].l_quantity) == [0.0, 12.0]


CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def joined_rows(plan):
    """The most rows that a join of an executed plan gave, whatever adaptive execution wrapped it in."""
    most, left = 0, [plan]
    while left:
        node = left.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        left += inner + [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_retry_set_makes_failures_of_newest_jobs_alone(spark, tmp_path):
    customers = [(i, f"c{i}", i, 0.0, "x") for i in range(3)]
    orders = [(i, i % 3, "F", 1.0, DAY, "1-URGENT") for i in range(300)]
    kinds = ["error", "purchase", "view"]
    events = [(i, DAY + datetime.timedelta(minutes=i // 2), i % 28, kinds[i % 3], 1.0, "{}") for i in range(600)]
    got = held_against_sql(spark, "retry_set", tmp_path, {"customer": (customers, CUSTOMERS), "orders": (orders, ORDERS), "events": (events, EVENTS)})
    assert 0 < len(got[got.extraction_id == 0]) < 100 or 0 < len(got[got.extraction_id == 1]) < 100
    out = queries.QUERIES["retry_set"](spark, str(tmp_path))
    out.collect()
    assert joined_rows(out._jdf.queryExecution().executedPlan()) <= 300  # not a document for each of its extraction's jobs


@pytest.mark.parametrize("few", [vocabulary.FEW, 0])
def test_long_texts_in_canonical_terms(spark, monkeypatch, few):
    monkeypatch.setattr(vocabulary, "FEW", few)
    rng = random.Random(5)
    terms = {"a": "one", "a b": "two", "b c": "three", "c a b d": "four"}
    texts = [" ".join(rng.choices("abcdef", k=n)) for n in (250_000, 3, 0, 200_000)]
    df, vocab = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(terms.items()), "term string, canonical string")
    start = time.monotonic()
    got = {r.i: (r.t, r.found) for r in vocabulary.canonicalised(df, "i", "t", vocab).collect()}
    assert time.monotonic() - start < 40  # in proportion to the words, not to their square
    assert got == {i: plain_canonical(t, terms) for i, t in enumerate(texts)}


@pytest.mark.parametrize("few", [10**6, -1])
def test_rows_of_ids_stay_short(spark, monkeypatch, few):
    """Spark bounds batches by their number of rows alone, so a long row is memory that no setting limits."""
    monkeypatch.setattr(phrases, "NAMES", few)
    docs = spark.createDataFrame([("a b c d. " * 50, "en")] * 300 + [("a b c d. " * 20_000, "en")], "text string, lang string").coalesce(1)
    counts = phrases.word_counts(docs).filter("word is not null and n >= 5")
    words = phrases.stored(counts.select((F.monotonically_increasing_id() + 1).alias("id"), "lang", "word", "n"))
    blocks = phrases.stored(phrases.word_blocks(docs, words))
    assert blocks.agg(F.sum(F.size(F.filter("ids", lambda x: x > 0))), F.max(F.size("ids")) <= 1024).first() == (35_000 * 4, True)
    pairs = phrases.stored(phrases.pair_counts(blocks).select((F.monotonically_increasing_id() + 1).alias("id"), "left", "right", "n"))
    assert sorted(r.n for r in pairs.collect()) == [35_000] * 3
    again = phrases.renamed(blocks, pairs)
    assert again.agg(F.sum(F.size(F.filter("ids", lambda x: x > 0))), F.max(F.size("ids")) <= 1024).first() == (35_000 * 3, True)


def test_partial_ratio_rules_windows_out(monkeypatch):
    """Long texts of few letters, alike and not: the same best as over all windows, in fewer rows of bit vectors."""
    rng, rows = random.Random(7), []
    plain = chunks.common_length
    monkeypatch.setattr(chunks, "common_length", lambda a, b: rows.append(1) or plain(a, b))
    words = ["".join(rng.choices("aeinorst", k=rng.randrange(1, 9))) for _ in range(300)]
    for _ in range(6):
        long = " ".join(rng.choices(words, k=150))
        at = rng.randrange(len(long) - 160)
        short = " ".join(w for i, w in enumerate(long[at : at + 160].split(" ")) if i % 6 != 4)
        want = plain_ratio(short, long)
        assert abs(chunks.partial_ratio(short, long) - want) < 1e-12 and chunks.partial_ratio(short, long, want) >= want
        assert chunks.partial_ratio(short, long, want + 0.01) < want + 0.01
    assert len(rows) <= 18  # the likely place alone; the others go on in one row


def test_locate_fuzzy_compares_once(spark):
    """A filter on the outcome of a function in Python must not run it again, and texts are joined once."""
    plan = queries.QUERIES["locate_fuzzy"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 1
