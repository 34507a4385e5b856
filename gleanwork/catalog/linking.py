"""Snippets back to pages, sections and offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import chunks, linking
from ..registry import query

#: Snippets from benchmark passages: whole, from inside a word, short ones without and with a blank.
SNIPPETS = """sn AS (SELECT item_id * 10 + k AS item_id, trim(regexp_replace(CASE k WHEN 0 THEN text WHEN 1 THEN substr(text, 4, 40) WHEN 2 THEN split_part(text, ' ', 3) WHEN 3 THEN substr(text, 3, 9) ELSE substr(text, 21, 12) END, '[[:space:]]+', ' ', 'g')) AS s
FROM benchmark, (SELECT unnest([0, 1, 2, 3, 4]) AS k))"""


def snippets(spark, sf_dir):
    cuts = [F.col("text"), F.substring("text", 4, 40), F.split_part("text", F.lit(" "), F.lit(3)), F.substring("text", 3, 9), F.substring("text", 21, 12)]
    return view(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(*cuts)).alias("k", "text")).select((F.col("item_id") * 10 + F.col("k")).alias("item_id"), "text")


@query(f"""WITH {SNIPPETS} SELECT doc_id, item_id, CAST(strpos(d.text, s) - 1 AS BIGINT) AS start_char, CAST(strpos(d.text, s) - 1 + length(s) AS BIGINT) AS end_char
FROM documents d JOIN sn ON contains(d.text, s) WHERE length(s) >= 5 AND upper(s) NOT IN ('NR', 'N/R', 'NOT REPORTED')""")
def locate_exact(spark, sf_dir):
    return linking.locate_exact(view(spark, sf_dir, "documents"), snippets(spark, sf_dir))


#: Each conversation turn as a result of its conversation's text, laid out with page marks.
TALK = """t AS (SELECT conv_id, turn, role, text, '{' || turn || '}' || repeat('-', 48) || chr(10) AS mark FROM conversations),
w AS (SELECT conv_id AS doc_id, turn AS page, role, text, mark, coalesce(sum(length(mark) + length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(mark) AS a FROM t)"""


def talks(spark, sf_dir):
    """(doc_id, text): conversations as one text each, a page mark before each turn."""
    turns = view(spark, sf_dir, "conversations").withColumn("part", F.concat(F.lit("{"), F.col("turn"), F.lit("}" + "-" * 48 + "\n"), "text", F.lit("\n")))
    listed = F.array_sort(F.collect_list(F.struct("turn", "part")))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(listed, lambda x: x["part"]), "").alias("text"))


@query(f"""WITH {TALK} SELECT doc_id, page::INT + 1 AS page, CAST(a + length(text) - length(ltrim(text, chr(10))) AS INT) AS start_char,
CAST(CASE WHEN lead(page) OVER (PARTITION BY doc_id ORDER BY page) IS NULL THEN a + length(text) + 1 ELSE greatest(a + length(rtrim(text, chr(10))), a + length(text) - length(ltrim(text, chr(10)))) END AS INT) AS end_char FROM w""")
def page_marks(spark, sf_dir):
    return talks(spark, sf_dir).select("doc_id", F.inline(linking.pages_in(F.col("text"))))


@query(f"""WITH {TALK}, o AS (SELECT doc_id, unnest([0, 60, 200, 5000, 1000000]) AS off FROM (SELECT DISTINCT doc_id FROM w)),
p AS (SELECT doc_id, page + 1 AS page, a, a + length(text) + CASE WHEN lead(page) OVER (PARTITION BY doc_id ORDER BY page) IS NULL THEN 1 ELSE 0 END AS b FROM w), g AS (SELECT o.doc_id, o.off, p.page, o.off >= a AND o.off < b AS inside, abs(a - o.off) AS gap FROM o JOIN p ON o.doc_id = p.doc_id)
SELECT doc_id, off::INT AS off, coalesce(min(page) FILTER (WHERE inside), arg_min(page, gap * 1000 + page))::INT AS page FROM g GROUP BY 1, 2""")
def page_of_offset(spark, sf_dir):
    pages = talks(spark, sf_dir).select("doc_id", linking.pages_in(F.col("text")).alias("pages"), F.explode(F.array(*map(F.lit, (0, 60, 200, 5000, 1_000_000)))).alias("off"))
    return pages.select("doc_id", "off", linking.page_of(F.col("pages"), F.col("off")).alias("page"))


@query(f"""WITH {TALK}, x AS (SELECT *, min(a) OVER (PARTITION BY doc_id) - length(mark) AS z FROM w), f AS (SELECT doc_id, string_agg(mark || text || chr(10), '' ORDER BY page) AS whole FROM x GROUP BY 1),
h AS (SELECT w.doc_id, w.page AS field, trim(substr(w.text, 1, 30)) AS s, f.whole FROM w JOIN f ON w.doc_id = f.doc_id WHERE length(trim(substr(w.text, 1, 30))) >= 5),
k AS (SELECT *, strpos(whole, s) - 1 AS pos FROM h WHERE NOT contains(s, chr(10)) AND NOT contains(s, '  '))
SELECT k.doc_id, k.field, CAST(k.pos AS BIGINT) AS start_char, CAST(k.pos + length(s) AS BIGINT) AS end_char, CAST((SELECT max(page) + 1 FROM w WHERE w.doc_id = k.doc_id AND w.a <= k.pos) AS INT) AS page FROM k""")
def locate_sources(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("field"), F.substring("text", 1, 30).alias("snippet"))
    turns = turns.filter(~F.trim("snippet").contains("\n") & ~F.trim("snippet").contains("  "))
    found = chunks.located(turns, talks(spark, sf_dir)).filter("location is not null")
    return found.select("doc_id", "field", "location.start_char", "location.end_char", "location.page")


@query(None)
def locate_fuzzy(spark, sf_dir):
    """Each document's own text from its tenth character on, with every sixth word left out."""
    words = F.filter(F.split(F.substring("text", 10, 160), " "), lambda _, i: i % 6 != 4)
    rough = view(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("item_id"), F.array_join(words, " ").alias("snippet"))
    return chunks.locate_rough(view(spark, sf_dir, "documents"), rough)


@query(f"""WITH {TALK}, h AS (SELECT w.doc_id, w.page, w.role, trim(substr(w.text, 1, 30)) AS s, w.a FROM w WHERE length(trim(substr(w.text, 1, 30))) >= 5 AND NOT contains(trim(substr(text, 1, 30)), chr(10)) AND NOT contains(trim(substr(text, 1, 30)), '  '))
SELECT doc_id, count(*)::BIGINT AS n_located FROM h GROUP BY 1""")
def enrich_results(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations").filter(~F.trim(F.substring("text", 1, 30)).contains("\n") & ~F.trim(F.substring("text", 1, 30)).contains("  "))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t"), "turn", F.lit(".source_text")).alias("key"), F.substring("text", 1, 30).alias("value"))))
    results = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(entries.alias("values")).withColumn("result_id", F.col("doc_id"))
    done = chunks.enriched(results, talks(spark, sf_dir)).select("doc_id", F.size(F.map_filter("values", lambda k, v: k.endswith(".source_location") & v.contains("start_char"))).cast("long").alias("n_located"))
    return done.filter("n_located > 0")


@query(f"""WITH {TALK}, f AS (SELECT doc_id, string_agg(mark || text || chr(10), '' ORDER BY page) AS whole FROM w GROUP BY 1), h AS (SELECT w.doc_id, w.page AS field, trim(substr(w.text, 1, 30)) AS s, f.whole FROM w JOIN f ON w.doc_id = f.doc_id),
k AS (SELECT *, strpos(whole, s) - 1 AS pos FROM h WHERE length(s) >= 5 AND NOT contains(s, chr(10)) AND NOT contains(s, '  ')), l AS (SELECT k.*, (SELECT max(page) + 1 FROM w WHERE w.doc_id = k.doc_id AND w.a <= k.pos) AS page FROM k)
SELECT doc_id, page::INT AS page, string_agg(field || '@' || pos, ',' ORDER BY pos, length(s), field) AS entries FROM l GROUP BY 1, 2""")
def page_index(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("field"), F.substring("text", 1, 30).alias("snippet"))
    turns = turns.filter(~F.trim("snippet").contains("\n") & ~F.trim("snippet").contains("  "))
    index = chunks.page_index(chunks.located(turns, talks(spark, sf_dir)))
    return index.select("doc_id", "page", F.array_join(F.transform("entries", lambda e: F.concat_ws("@", e["field"], e["start_char"])), ",").alias("entries"))


HEADED = [(0, "x\n## Methods\nwe did\n", "Methods"), (1, "**2. Results**\nit was", "Results"), (2, "3) Study   population \nmen", "Participants"), (3, "Primary findings\nso", None), (4, "Methods were used\nhere", None), (5, "ABSTRACT\nDiscussion\n", "Discussion")]


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Methods' WHEN 1 THEN 'Participants' END AS section FROM supplier")
def section_headings(spark, sf_dir):
    text = F.concat(F.lit("Abstract\nfirst\n"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN '  ## 2. Materials and methods' WHEN 1 THEN '**Inclusion criteria**' ELSE 'Primary findings' END"), F.lit("\n"), "s_name")
    return view(spark, sf_dir, "supplier").select("s_suppkey", linking.section_before(text, F.length(text) - 3).alias("section"))


@query("""SELECT conv_id AS document_id, turn AS chunk_no, next_no, pair_chars FROM (SELECT conv_id, turn, lead(turn) OVER w AS next_no, CAST(length(text) + lead(length(text)) OVER w + 1 AS BIGINT) AS pair_chars, abs(lead(turn * turn) OVER w - turn * turn) AS apart FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next_no = turn + 1 AND apart <= 1""")
def chunk_pairs_on_pages(spark, sf_dir):
    talk = view(spark, sf_dir, "conversations").withColumn("page", F.col("turn") * F.col("turn"))
    return linking.chunk_pairs(talk, "conv_id", "turn", "text", "page")
