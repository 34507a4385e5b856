import json
import random

from pyspark.sql import functions as F

from gleanwork.operators import chunks, linking
from gleanwork.plans import staged
from gleanwork.sources import store


def test_texts_pairs_and_terms(spark, tmp_path):
    for n in ("a-b.md", "c.md", "ignored.txt"):
        (tmp_path / n).write_text(f"text of {n}")
    texts = store.read_texts(spark, str(tmp_path))
    assert sorted(map(tuple, texts.collect())) == [("a-b", "text of a-b.md"), ("c", "text of c.md")]
    pdfs = spark.createDataFrame([("ab",), ("c",), ("none",)], "stem string")
    assert sorted(map(tuple, store.pair_files(pdfs, texts.select("stem")).collect())) == [("ab", "a-b"), ("c", "c"), ("none", None)]
    (tmp_path / "t.csv").write_text("term,synonyms,code\nFever, pyrexia ; ;heat,R50\n ,x,y\nCough,,\n")
    assert sorted(map(tuple, store.read_terms(spark, str(tmp_path / "t.csv")).collect())) == [("Cough", [], ""), ("Fever", ["pyrexia", "heat"], "R50")]


def test_page_map_round_trip(spark):
    df = spark.createDataFrame([("body", [(0, 0, 4)])], f"t string, p {store.PAGE_MAP}")
    out = df.select(store.with_page_map(F.col("t"), F.col("p")).alias("t")).select(store.page_map(F.col("t")).alias("p")).first()
    assert [tuple(x) for x in out.p] == [(0, 0, 4)]
    assert df.select(store.page_map(F.col("t"))).first()[0] is None


def test_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("h1", 1), ("h1", 1), ("h2", 2)], "call_hash string, n int")
    for _ in range(2):
        store.append_calls(calls, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    rows = spark.createDataFrame([("f1", 1), ("f2", 2)], "source_file string, n int")
    store.replace_source(rows, str(tmp_path / "ev"))
    store.replace_source(spark.createDataFrame([("f1", 9)], rows.schema), str(tmp_path / "ev"))
    assert sorted((r.source_file, r.n) for r in spark.read.parquet(str(tmp_path / "ev")).collect()) == [("f1", 9), ("f2", 2)]
    values = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, "a", "z")], "k int, field string, value string")
    store.export_csv(values, ["k"], ["b", "a"], str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True).fillna("").collect())) == [("1", "y", "x"), ("2", "z", "")]


def test_chunks_and_ratio():
    text = "One para\nline two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nlast"
    assert [(k, text[a:b], p) for k, a, b, p in chunks.chunks_of(text, [(4, 0, len(text))])] == [
        ("paragraph", "One para\nline two", 4), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", 4), ("row", "| a | b |", 4), ("row", "| 1 | 2 |", 4), ("paragraph", "last", 4),
    ]
    assert chunks.common_length("abcde", "xaxcxe") == 3
    assert chunks.partial_ratio("brown fox jumps", "the quick brown fox jumps over") == 1.0
    assert 0.8 < chunks.partial_ratio("brown fox jumped", "the quick brown fox jumps over") < 1


def plain_ratio(short, long):
    """Best similarity over all windows, cut ones at the ends too, with the longest common subsequence by its table."""
    if len(short) > len(long):
        short, long = long, short

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    m = len(short)
    windows = [long[max(0, e - m) : e] for e in range(1, len(long) + m)]
    return max((2 * common(short, w) / (m + len(w)) for w in windows if w), default=0.0) if m else 0.0


def test_partial_ratio_against_all_windows():
    rng = random.Random(2)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (9, 25))
        assert abs(chunks.partial_ratio(a, b) - plain_ratio(a, b)) < 1e-12


def test_located_against_a_plain_cascade(spark):
    text = "{0}" + "-" * 48 + "\n\n# Methods\n\nWe gave 12 mg daily (see the full protocol).\n\n| arm | n |\n|---|---|\n| a | 240 |\n\n{1}" + "-" * 50 + "\nThe first half of a sentence that goes on\n\nacross a blank line to its second half"
    snippets = ["12 mg daily", "n |", "12  mg\tdaily (see", "We gave 12 mg each day (see all the protocol)", "half of a sentence that goes across a blank line to its second", "nothing like it at all, really", "NR", "abc", None, "| a | 24O |"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(snippets)] + [(2, 99, "12 mg daily")], "doc_id int, item int, snippet string")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {r.item: r.location for r in chunks.located(df, docs).collect()}
    pages = [(1, text.index("# M"), text.index("{1}") - 2), (2, text.index("The first"), len(text))]
    parts = [(text[a:b].strip(), a, b, p) for _, a, b, p in chunks.chunks_of(text, pages)]
    assert len(got) == 11
    for i, s in enumerate(snippets):
        clean = " ".join((s or "").split())
        if clean.upper() in ("", "NR") or len(clean) < 5:
            assert got[i] is None, s
            continue
        at = text.find(clean)
        scored = sorted(((plain_ratio(clean, t), -k) for k, (t, *_) in enumerate(parts)), reverse=True)
        pairs = sorted(((plain_ratio(clean, f"{a[0]} {b[0]}"), -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if abs(a[3] - b[3]) <= 1), reverse=True)
        if at >= 0:
            assert (got[i].start_char, got[i].end_char, got[i].confidence) == (at, at + len(clean), 1.0)
        elif scored[0][0] >= 0.65:
            assert (got[i].start_char, round(got[i].confidence, 9)) == (parts[-scored[0][1]][1], round(scored[0][0], 9))
        elif pairs[0][0] >= 0.65 and pairs[0][0] > scored[0][0]:
            assert (got[i].start_char, got[i].end_char) == (parts[-pairs[0][1]][1], parts[-pairs[0][1] + 1][2])
        else:
            assert got[i] is None
    assert got[0].section == "Methods" and got[0].page == 1 and got[3].confidence < 1 and got[99] is None


def test_exact_snippets_of_every_kind(spark):
    text = 'He took "12 mg daily" (see the full protocol of trial), n=240;\n240 adults\tand  more of  5'
    wanted = ["12 mg daily", "n=240", "240 adults", "see the full protocol of trial", "12 mg daily (see", " 12 mg", "daily\" (see", "n=240;", "more of", "l of t", "absent", "ook \"1", "NR", "mg d", None]
    snippets = spark.createDataFrame(list(enumerate(wanted)), "item_id int, text string")
    docs = spark.createDataFrame([(1, text), (2, "n=240 only"), (3, None)], "doc_id int, text string")
    got = {(r.doc_id, r.item_id): r.start_char for r in linking.locate_exact(docs, snippets).collect()}
    clean = lambda s: " ".join(s.split())
    want = {(d, i): t.index(clean(s)) for d, t in ((1, text), (2, "n=240 only")) for i, s in enumerate(wanted) if s and s != "NR" and len(clean(s)) >= 5 and clean(s) in t}
    assert got == want


def test_enriched_results(spark):
    docs = spark.createDataFrame([(1, "Age was 40 years in all.\n\nSex was mixed.")], "doc_id int, text string")
    values = {"age.value": "40", "age.source_text": "Age was 40", "sex": '{"value":"mixed","source_text":"Sex was mixed"}', "none.source_text": "NR", "n": "1"}
    results = spark.createDataFrame([(7, 1, values), (8, 1, {"n": "2"})], "result_id int, doc_id int, values map<string,string>")
    got = {r.result_id: r["values"] for r in chunks.enriched(results, docs).collect()}
    assert got[8] == {"n": "2"} and set(got[7]) == set(values) | {"age.source_location"}
    assert json.loads(got[7]["age.source_location"])["start_char"] == 0 and json.loads(got[7]["sex"])["source_location"]["page"] == 1


def test_staged_extraction(spark):
    papers = spark.createDataFrame([(1, "age: 40 sex: f"), (2, "nothing")], "doc_id int, text string")
    stages = [{"extract": staged.by_pattern({"age": r"age: (\d+)"})}, {"extract": staged.by_pattern({"sex": r"sex: (\w)"}), "requires": ["age"]}]
    got = {r.doc_id: r["values"] for r in staged.run_stages(papers, stages, retry=staged.by_pattern({"age": r"(noth)"})).collect()}
    assert got[1] == {"age": "40", "sex": "f"} and got[2]["age"] == "noth"


def test_listings_samples_and_schemas(spark, tmp_path):
    import os

    for i, n in enumerate(("old.json", "new.json")):
        (tmp_path / n).write_text('[{"id": 1}, {"id": 2}, {"id": 3}]')
        os.utime(tmp_path / n, (1_000_000 + i, 1_000_000 + i))
    assert [(r.name, r.bytes) for r in store.list_results(spark, str(tmp_path)).collect()] == [("new.json", 33), ("old.json", 33)]
    records = store.read_records(spark, str(tmp_path / "new.json"), "id int")
    some = store.sample_records(records, "id", 2)
    assert some.count() == 2 and sorted(map(tuple, some.collect())) == sorted(map(tuple, store.sample_records(records, "id", 2).collect()))
    (tmp_path / "schema_a").mkdir()
    (tmp_path / "schema_a" / "field_mapping.json").write_text('{"age": "number", "sex": "text"}')
    assert sorted(map(tuple, store.read_schemas(spark, str(tmp_path)).collect())) == [("schema_a", "age", "number"), ("schema_a", "sex", "text")]
    (tmp_path / "calls.csv").write_text("call_hash,model,prompt_tokens,completion_tokens,cost,ts\nh,m,1,2,0.5,2024-01-01 00:00:00\n")
    assert store.read_calls(spark, str(tmp_path / "calls.csv")).first().cost == 0.5
    assert store.stamped(records, F.lit("now")).first().updated_at == "now"
    spots = spark.createDataFrame([(None, " ", "c"), ("a", "b", "c")], "x string, y string, z string")
    assert [r[0] for r in spots.select(store.first_location(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["c", "a"]


def test_exports(spark, tmp_path):
    from gleanwork.plans import dashboard

    results = spark.createDataFrame([(1, '{"b":"x","a":"y"}'), (2, '{"a":"z","c":"w"}')], "document_id int, extracted_data string")
    assert dashboard.all_fields(results) == ["a", "b", "c"] and dashboard.first_fields(results, "document_id") == ["b", "a"]
    values = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, "a", "z"), (2, "c", "w")], "document_id int, field string, value string")
    store.export_one_csv(values, ["document_id"], ["b", "a"], str(tmp_path / "one"))
    one = spark.read.csv(str(tmp_path / "one"), header=True)
    assert one.columns == ["document_id", "b", "a"] and sorted(map(tuple, one.fillna("").collect())) == [("1", "x", "y"), ("2", "", "z")]
    store.export_json(results, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    store.save_records(results, str(tmp_path / "kept"))
    store.save_records(results.limit(1), str(tmp_path / "kept"))
    assert spark.read.json(str(tmp_path / "kept")).count() == 2
    store.save_records(results.limit(1), str(tmp_path / "kept"), override=True)
    assert spark.read.json(str(tmp_path / "kept")).count() == 1
    details = spark.createDataFrame([(1, "TP", "a", "a"), (2, "FN", None, "b"), (3, "FP", "c", None)], "document_id int, classification string, extracted string, truth string")
    assert sorted(tuple(r) for r in store.evaluation_rows(details, "document_id").collect()) == [(1, "TP", "extracted", "a"), (1, "TP", "truth", "a"), (2, "FN", "truth", "b"), (3, "FP", "extracted", "c")]


def test_published_messages_and_late_joiners(spark, tmp_path):
    from gleanwork.streaming import messages

    rows = [("j", 1, "2024-01-01 00:00:01"), ("j", 1, "2024-01-01 00:00:01"), ("j", 2, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "job_id string, seq long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = messages.once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "10 seconds", "job_id", "seq")
    q = messages.publish(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    swept = []
    jobs = spark.createDataFrame([(1, "processing", "2020-01-01 00:00:00"), (2, "completed", "2020-01-01 00:00:00")], "job_id long, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    jobs.coalesce(1).write.parquet(str(tmp_path / "jobs"))
    q = messages.sweep(spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs")), "1 second", lambda b: swept.extend(r.job_id for r in b.collect()))
    q.processAllAvailable()
    q.stop()
    assert swept == [1]
