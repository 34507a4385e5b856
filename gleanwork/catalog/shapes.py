"""JSON shapes, names, checks and scores of single values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import fields, norm, repair, shapes
from ..operators import edits
from ..plans import staged
from ..registry import query

ORDER = "SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p FROM orders"


def orders(spark, sf_dir):
    return view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))


@query(f"SELECT id, CASE WHEN id % 3 <> 0 THEN s END AS a, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS n FROM ({ORDER})")
def final_values(spark, sf_dir):
    text = F.when(F.col("id") % 3 != 0, F.concat(F.lit('{"final_value":"'), "s", F.lit('","by":1}'))).otherwise(F.lit('"plain"'))
    values = shapes.final_values(F.create_map(F.lit("a"), text))
    return orders(spark, sf_dir).select("id", F.try_element_at(values, F.lit("a")).alias("a"), F.size(values).alias("n"))


@query(f"SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE s END AS s FROM ({ORDER})")
def unwrap_records(spark, sf_dir):
    one = F.concat(F.lit('{"s":"'), "s", F.lit('"}'))
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(F.col("id") % 4 == 1, F.concat(F.lit('{"results":['), one, F.lit("]}")))
    text = text.when(F.col("id") % 4 == 2, one).otherwise(F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
    return orders(spark, sf_dir).select("id", F.get_json_object(shapes.unwrapped(text), "$.s").alias("s"))


@query(f"SELECT id, t.test, s AS status FROM ({ORDER}), (SELECT unnest(['x', 'y']) AS test) t WHERE id % 5 <> 0")
def fan_out(spark, sf_dir):
    text = F.when(F.col("id") % 5 != 0, F.concat(F.lit('{"status":"'), "s", F.lit('","tests":[{"test":"x"},{"test":"y"}]}'))).otherwise(F.lit('{"status":"none","tests":[]}'))
    records = orders(spark, sf_dir).select("id", F.explode(shapes.fanned_out(text, "tests")).alias("r"))
    return records.select("id", F.col("r")["test"].alias("test"), F.col("r")["status"].alias("status"))


@query(f"SELECT id, id % 2 = 0 AS a, false AS b FROM ({ORDER})")
def resolve_comment(spark, sf_dir):
    note = F.struct(F.lit("text").alias("text"), F.lit(False).alias("resolved"))
    comments = shapes.with_flag(F.create_map(F.lit("a"), note, F.lit("b"), note), F.when(F.col("id") % 2 == 0, "a").otherwise("zz"), "resolved", F.lit(True))
    return orders(spark, sf_dir).select("id", comments["a"]["resolved"].alias("a"), comments["b"]["resolved"].alias("b"))


@query(f"""SELECT id, k AS path, v AS value FROM ({ORDER}), LATERAL (SELECT unnest(['a.b.c.d.e', 'a.x', 'n', 'source_location']) AS k, unnest([s, '[1,2]', '1.0', '{{"page":{{"no":1}}}}']) AS v)""")
def flatten_deep(spark, sf_dir):
    text = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":"'), "s", F.lit('"}}},"x":[1,2]},"n":1.0,"source_location":{"page":{"no":1}}}'))
    return orders(spark, sf_dir).select("id", F.explode(fields.flat(text)).alias("path", "value"))


@query(f"SELECT id, k AS path, v AS value FROM ({ORDER}), LATERAL (SELECT unnest(['a_b', 'l', 'n']) AS k, unnest([s, 'x, y', '2']) AS v)")
def flatten_for_csv(spark, sf_dir):
    text = F.concat(F.lit('{"a":{"b":"'), "s", F.lit('"},"l":["x","y"],"n":2}'))
    return orders(spark, sf_dir).select("id", F.explode(fields.flat_columns(text)).alias("path", "value"))


@query("SELECT s_suppkey, sha256(s_name) AS content, md5(s_name || '|m') AS call, substr(md5(s_name), 1, 8) AS task, s_name || '_form.json' AS output, substr(sha256(s_name), 1, 16) || '_md' AS file FROM supplier")
def hashes_and_names(spark, sf_dir):
    path = F.concat(F.lit("/in/"), "s_name", F.lit("_md.md"))
    return view(spark, sf_dir, "supplier").select(
        "s_suppkey", shapes.content_hash(F.col("s_name")).alias("content"), shapes.call_hash(F.col("s_name"), F.lit("m")).alias("call"), shapes.task_id(F.col("s_name")).alias("task"),
        shapes.output_name(path, "form").alias("output"), shapes.unique_name(F.col("s_name")).alias("file"),
    )


@query("SELECT p_partkey, contains(lower(p_name), 'small') OR NOT contains(lower(p_name), 'green') AS held FROM part")
def word_overlap(spark, sf_dir):
    name = F.when(F.lower("p_name").contains("green"), F.lit("Small wrench of theirs")).otherwise(F.lit("a of the"))
    return view(spark, sf_dir, "part").select("p_partkey", shapes.overlaps(name, F.concat("p_name", F.lit(""))).alias("held"))


@query("SELECT document_id, slot, l_returnflag AS a, CASE WHEN slot % 2 = 0 THEN l_linestatus ELSE l_returnflag END AS b, 1 AS kept FROM fx_results")
def export_keys(spark, sf_dir):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    valued = F.when(F.col("slot") % 2 == 0, F.create_map(F.lit("a.value"), flag, F.lit("b.value"), line)).otherwise(F.create_map(F.lit("a"), flag, F.lit("b"), flag))
    noisy = F.create_map(F.lit("x"), flag, F.lit("x.confidence"), flag, F.lit("x.reasoning"), flag, F.lit("x.source_location"), flag, F.lit("Job_ID"), flag)
    stripped = fields.strip_value_suffix(valued)
    return view(spark, sf_dir, "fx_results").select("document_id", "slot", stripped["a"].alias("a"), stripped["b"].alias("b"), F.size(fields.export_fields(noisy, confidence=False, metadata=False)).alias("kept"))


@query("SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def repaired_json(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 5 == 1, F.regexp_replace("props", '"', "'"))
    text = text.when(F.col("event_id") % 5 == 2, F.regexp_replace("props", r"\}", ",}")).when(F.col("event_id") % 5 == 3, F.lit("no pairs")).otherwise(F.col("props"))
    return view(spark, sf_dir, "events").select("event_id", F.get_json_object(repair.parsed(text), "$.k").alias("k"))


@query("SELECT event_id, event_type = 'error' OR event_id % 7 = 0 AS limited, CASE WHEN event_id % 4 = 0 THEN 'flagged' WHEN event_id % 3 = 0 THEN 'passed' ELSE 'in_progress' END AS status FROM events")
def call_checks(spark, sf_dir):
    code = F.when(F.col("event_id") % 7 == 0, 429).otherwise(500)
    text = F.when(F.col("event_type") == "error", F.lit("Rate limit reached: too many requests")).otherwise(F.lit("boom"))
    comments = F.create_map(F.lit("a"), F.col("event_id") % 4 != 0, F.lit("b"), F.lit(True))
    return view(spark, sf_dir, "events").select("event_id", edits.rate_limited(code, text).alias("limited"), edits.qa_status(comments, F.when(F.col("event_id") % 3 == 0, 2).otherwise(0)).alias("status"))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS ok FROM orders")
def upload_checks(spark, sf_dir):
    name = F.when(F.col("id") % 2 == 0, "A.PDF").otherwise("a.txt")
    size = F.when(F.col("id") % 3 == 0, 1 << 40).otherwise(10)
    content = F.when(F.col("id") % 5 == 0, F.lit(b"junk!x")).otherwise(F.lit(b"%PDF-1.7"))
    return orders(spark, sf_dir).select("id", edits.uploadable(name, size, content).alias("ok"))


@query("""SELECT p_partkey AS form_id, f AS field_name, pr AS problem FROM part, LATERAL (SELECT unnest(['1x', 'kind', 'pick', 'twice']) AS f, unnest(['name', 'type', 'options', 'duplicate']) AS pr) WHERE p_partkey % 2 = 0""")
def form_checks(spark, sf_dir):
    options = "array<string>"
    listed = F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(t).alias("field_type"), (F.lit(None).cast(options) if n != "good" else F.array(F.lit("o"))).alias("options")) for n, t in (("1x", "text"), ("kind", "blob"), ("pick", "enum"), ("twice", "text"), ("twice", "text"), ("good", "enum"))])
    forms = view(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("form_id"), F.inline(listed))
    return edits.field_problems(forms)


@query("SELECT a.document_id, 'completed' AS before, a.status AS after FROM fx_assignments a WHERE a.status <> 'completed' AND a.reviewer_role = 'reviewer_1' UNION ALL SELECT a.document_id, 'pending', a.status FROM fx_assignments a WHERE a.status = 'completed' AND a.reviewer_role = 'reviewer_2'")
def assignment_guard(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_assignments").filter("reviewer_role <> 'adjudicator'")
    return edits.bad_transitions(rows.select("document_id", F.when(F.col("reviewer_role") == "reviewer_1", "completed").otherwise("pending").alias("before"), F.col("status").alias("after")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS reward FROM events")
def extraction_reward(spark, sf_dir):
    other = F.when(F.col("event_id") % 3 == 0, "x").when(F.col("event_id") % 3 == 1, "NR").otherwise("")
    return view(spark, sf_dir, "events").select("event_id", F.round(staged.score(F.create_map(F.lit("a"), F.lit("v"), F.lit("b"), other)), 6).alias("reward"))


@query("SELECT doc_id, CASE WHEN regexp_extract(text, '([A-Za-z]+)', 1) = '' THEN 'NR' ELSE regexp_extract(text, '([A-Za-z]+)', 1) END AS word, CASE WHEN regexp_extract(text, '([0-9]+)', 1) = '' THEN 'NR' ELSE regexp_extract(text, '([0-9]+)', 1) END AS number FROM documents")
def staged_extraction(spark, sf_dir):
    stages = [{"extract": staged.by_pattern({"word": "([A-Za-z]+)"})}, {"extract": staged.by_pattern({"number": "([0-9]+)"}), "requires": ["word"]}]
    done = staged.run_stages(view(spark, sf_dir, "documents").select("doc_id", "text"), stages)
    return done.select("doc_id", F.col("values")["word"].alias("word"), F.col("values")["number"].alias("number"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-03-05 00:00:00' WHEN c_custkey % 4 = 1 THEN TIMESTAMP '2024-03-05 06:07:08' END AS t, CASE WHEN c_custkey % 2 = 0 THEN 0.0::DOUBLE ELSE c_acctbal / 4 END AS q, regexp_replace('F ' || c_mktsegment || ' x', '[^A-Za-z0-9]+', '', 'g') AS kept FROM customer")
def dates_and_names(spark, sf_dir):
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2024-03-05T06:07:08Z' WHEN 2 THEN '2024' ELSE '05/03/2024' END")
    quotient = norm.safe_divide(F.col("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(4))
    return view(spark, sf_dir, "customer").select("c_custkey", norm.iso_time(text).cast("timestamp_ntz").alias("t"), quotient.alias("q"), F.regexp_replace(norm.class_name(F.concat(F.lit("f "), "c_mktsegment", F.lit(" x"))), "X$", "x").alias("kept"))


@query("SELECT document_id, slot, CASE WHEN slot % 2 = 0 THEN l_returnflag ELSE l_linestatus END AS a, CASE WHEN slot % 2 = 0 THEN NULL ELSE l_linestatus END AS b FROM fx_results")
def combined_records(spark, sf_dir):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    main = F.when(F.col("slot") % 2 == 0, F.create_map(F.lit("a"), flag)).otherwise(F.create_map(F.lit("a"), F.lit("")))
    values = staged.combined(main, F.create_map(F.lit("a"), flag, F.lit("b"), line), F.create_map(F.lit("a"), line))
    return view(spark, sf_dir, "fx_results").select("document_id", "slot", F.try_element_at(values, F.lit("a")).alias("a"), F.try_element_at(values, F.lit("b")).alias("b"))


@query("SELECT document_id, CASE WHEN slot % 2 = 0 THEN 'a,b,c' ELSE 'b,c' END AS keys FROM fx_results WHERE slot <= 2")
def key_union(spark, sf_dir):
    one = F.when(F.col("slot") % 2 == 0, F.create_map(F.lit("c"), F.lit(1), F.lit("a"), F.lit(2))).otherwise(F.create_map(F.lit("c"), F.lit(1)))
    keys = fields.all_keys(one, F.create_map(F.lit("b"), F.lit(1)))
    return view(spark, sf_dir, "fx_results").filter("slot <= 2").select("document_id", F.array_join(keys, ",").alias("keys"))


@query(r"""
    SELECT conv_id, turn, role, n, line FROM (
      SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM conversations)
""")
def turn_lines(spark, sf_dir):
    """A turn is a JSON record with a list of its lines, and goes out as a record a line."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct((i + 1).cast("string").alias("n"), x.alias("line")))
    record = F.to_json(F.struct("role", lines.alias("lines")))
    rows = view(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(shapes.fanned_out(record, "lines")).alias("r"))
    return rows.select("conv_id", "turn", F.col("r")["role"].alias("role"), F.col("r")["n"].cast("long").alias("n"), F.col("r")["line"].alias("line"))


@query(r"""
    SELECT page_id, len(list_filter(words, lambda x: contains(lower(coalesce(url, '')), x))) >= floor(len(words) / 2) AS held
    FROM (SELECT page_id, url, list_slice(list_filter(string_split_regex(lower(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1)), '\s+'), lambda x: length(x) > 4), 1, 5) AS words FROM pages)
""")
def titles_in_addresses(spark, sf_dir):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)", 1)
    return view(spark, sf_dir, "pages").select("page_id", shapes.overlaps(title, F.coalesce("url", F.lit(""))).alias("held"))


@query(r"""
    SELECT doc_id, round((CASE WHEN regexp_matches(text, '[a-z]@[a-z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END
      + CASE WHEN coalesce(lang, '') = '' THEN 0 ELSE 1 END + CASE WHEN coalesce(source, '') = '' THEN 0 ELSE 1 END) / 4, 6) AS score FROM documents
""")
def document_scores(spark, sf_dir):
    """How much of four fields a document gives: an address, a number, its language and its source."""
    found = {"address": F.regexp_extract("text", "[a-z]@[a-z]", 0), "number": F.regexp_extract("text", "[0-9]", 0), "lang": F.col("lang"), "source": F.col("source")}
    values = F.create_map(*[x for name, value in found.items() for x in (F.lit(name), value)])
    return view(spark, sf_dir, "documents").select("doc_id", F.round(staged.score(values), 6).alias("score"))


PART_FIELDS = """
    SELECT p_size AS form_id, CASE WHEN p_retailprice >= 950 THEN split_part(p_name, ' ', 2) ELSE p_name END AS field_name,
      CASE p_type WHEN 'SMALL' THEN 'enum' WHEN 'ECONOMY' THEN 'number' WHEN 'PROMO' THEN 'text' ELSE lower(p_type) END AS field_type, p_brand < 'Brand#2' AS listed FROM part
"""


@query(f"""
    WITH f AS ({PART_FIELDS})
    SELECT form_id, field_name, 'name' AS problem FROM f WHERE NOT regexp_full_match(field_name, '[A-Za-z][A-Za-z0-9_]*')
    UNION ALL SELECT form_id, field_name, 'type' FROM f WHERE field_type NOT IN ('text', 'number', 'enum', 'object', 'array', 'boolean')
    UNION ALL SELECT form_id, field_name, 'options' FROM f WHERE field_type = 'enum' AND NOT listed
    UNION ALL SELECT form_id, field_name, 'duplicate' FROM f GROUP BY form_id, field_name HAVING count(*) > 1
""")
def part_fields(spark, sf_dir):
    """Parts as fields of forms by size: their names, kinds and brands as the fields' names, types and options."""
    kind = F.expr("CASE p_type WHEN 'SMALL' THEN 'enum' WHEN 'ECONOMY' THEN 'number' WHEN 'PROMO' THEN 'text' ELSE lower(p_type) END")
    name = F.when(F.col("p_retailprice") >= 950, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name"))
    options = F.when(F.col("p_brand") < "Brand#2", F.array("p_brand"))
    return edits.field_problems(view(spark, sf_dir, "part").select(F.col("p_size").alias("form_id"), name.alias("field_name"), kind.alias("field_type"), options.alias("options")))
