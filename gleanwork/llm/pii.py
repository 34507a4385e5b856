"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that go with them.

Everything here is DataFrame and SQL functions. Four patterns (email, ip, card, phone) give the base
spans. A corpus pass then estimates how strongly a term reveals a protected entity: with n(e), n(t)
documents that mention the entity e or hold the term t, n(e,t) that do both, and N documents
(different texts, each counted once),

    disclosure(e, t) = PMI(e; t) / IC(e) = log2(n(e,t) N / (n(e) n(t))) / log2(N / n(e)),

which is 1 when t occurs nowhere but in documents with e. An entity that every document mentions tells nothing, so
its disclosure is 0. Terms seen with e in at least `min_support` documents with a disclosure of `generalise_at` or more
are generalised (to their class: name, number, code or other term), of `remove_at` or more are removed, wherever they
stand in the corpus. Equal texts count as one document in all four numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the fixed patterns: the same leftmost matches, found without backtracking and
#: without a stack frame per repetition. A run is entered at its start (or where the last match ended).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: What a generalised term becomes: the class it belongs to, by its characters.
CLASSES = {r"^\p{N}+$": "[NUMBER]", r"\p{N}": "[CODE]", r"^\p{Lu}": "[NAME]"}
TERM_LABEL = "[TERM]"

OPEN, CLOSE, PLAIN = "\ue000", "\ue001", "\ufffd"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERM = r"[\p{L}\p{N}]+"


def marked_spans(text: Column, pattern: str | Column, kind: str) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches, without a UDF.

    Matches are set between two private-use marks and the text is cut there: odd pieces are matches.
    Marks that the text itself holds are first replaced by another character no pattern knows.
    """
    clean = F.translate(text, OPEN + CLOSE, PLAIN * 2)
    whole = F.concat(F.lit("("), F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(")"))
    pieces = F.split(F.regexp_replace(clean, whole, F.lit(f"{OPEN}$1{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
    return F.aggregate(
        F.transform(pieces, lambda p: F.length(p)),
        start,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: F.filter(
            F.zip_with(pieces, acc["starts"], lambda p, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(p)).alias("end"), p.alias("value"))),
            lambda _, i: i % 2 == 1,
        ),
    )


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    n = F.length(digits_of(value))
    if kind == "card":
        return n.between(13, 19) & luhn(digits_of(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    guard = text.contains(GUARDS[kind]) if kind == "email" else text.rlike(GUARDS[kind])
    found = F.filter(marked_spans(text, PATTERNS[kind], kind), lambda s: valid(kind, s["value"]))
    return F.when(guard, found).otherwise(F.expr(f"cast(array() as {SPAN})")).cast(SPAN)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """`docs` with _spans: the base spans by kind as listed, then start. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_spans", F.concat(*[spans_of(text, k) for k in KINDS]))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing(docs: DataFrame, min_support: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(_key, _kinds): for each text of (_key, text) that holds disclosing terms, the map of these terms to term or gone; stored.

    Only texts with mentions are brought together. What these alone say about a term bounds its disclosure from above:
    a term must be in at most n(e,t) (N / n(e)) ** (1 - generalise_at) documents. The few terms that pass are counted in all texts.
    """
    some = stored(with_base_spans(docs).filter(F.size("_spans") > 0).groupBy("_key").agg(F.first("text").alias("text"), F.first("_spans").alias("_spans")))
    n = docs.select("_key").distinct().count()
    name = lambda s: F.concat_ws(":", s["kind"], F.lower(F.when(s["kind"].isin("card", "phone"), digits_of(s["value"])).otherwise(s["value"])))
    mentions = some.withColumn("entity", F.explode(F.array_distinct(F.transform("_spans", name))))
    entities = stored(mentions.groupBy("entity").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= min_support) & (F.col("n_e") < n)))
    # parts of the mentions themselves are no terms
    masked = sanitised(F.col("text"), F.transform("_spans", lambda s: F.struct(F.lit("blank").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    pairs = join_small(mentions, entities, "entity", "inner").select("entity", "n_e", F.explode(terms_of(masked)).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).filter(F.col("n_et") >= min_support)
    near = some.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    most = F.col("n_et") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1.0 - generalise_at)) * (1 + 1e-9)
    pairs = stored(pairs.join(near, "term").filter(F.col("n_near") <= most).drop("n_near"))
    terms = stored(pairs.select("term").distinct())
    held = docs.select(F.col("_key").alias("_text"), F.explode(terms_of(F.col("text"))).alias("term"))
    held = stored(join_small(held, terms, "term", "inner").distinct())
    scored = (
        pairs.join(held.groupBy("term").agg(F.count("*").alias("n_t")), "term")
        .withColumn("n_t", F.greatest("n_t", "n_et"))
        .withColumn("disclosure", F.log2(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(float(n)) / F.col("n_e")))
        .filter(F.col("disclosure") >= generalise_at)
        .groupBy("term").agg(F.min(F.when(F.col("disclosure") >= remove_at, "gone").otherwise("term")).alias("kind"))
    )
    scored = stored(scored)
    hits = join_small(held, scored, "term", "inner").groupBy(F.col("_text").alias("_key"))
    out = stored(hits.agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("_kinds")))
    discard(some, entities, pairs, terms, held, scored)
    return out


def term_spans(text: Column, kinds: Column, base: Column) -> Column:
    """All places in `text` of the terms that `kinds` maps to term or gone, but for those that touch a base span."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys(kinds), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    spans = F.transform(marked_spans(text, pattern, "term"), lambda s: F.struct(F.try_element_at(kinds, F.lower(s["value"])).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))
    outside = lambda t: t["kind"].isNotNull() & ~F.exists(base, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))
    return F.filter(spans, outside).cast(SPAN)


def find(docs: DataFrame, min_support: int = 3, generalise_at: float = 0.9, remove_at: float = 0.98) -> DataFrame:
    """`docs` with `base` and `terms`, arrays of (kind, start, end, value): pattern spans and disclosing terms.

    A null or empty text has no spans; of long texts every character counts. Equal texts get equal spans, repeated
    rows too. Terms never overlap base spans. An empty table stays empty. Caller columns named base, terms, _key,
    _kinds or _spans are replaced; all others, nulls among them, pass through.
    """
    docs = docs.drop("base", "terms", "_key", "_kinds", "_spans")
    keyed = docs.withColumn("_key", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    marks = disclosing(keyed.select("_key", F.coalesce("text", F.lit("")).alias("text")), min_support, generalise_at, remove_at)
    size = marks.agg(F.count("*") + F.coalesce(F.sum(F.size("_kinds")), F.lit(0))).first()[0]
    marked = join_small(with_base_spans(keyed), marks, "_key", rows=size)
    terms = F.when(F.col("_kinds").isNotNull(), term_spans(F.coalesce("text", F.lit("")), F.col("_kinds"), F.col("_spans")))
    marked = marked.withColumn("terms", F.coalesce(terms, F.expr(f"cast(array() as {SPAN})")))
    return marked.withColumnRenamed("_spans", "base").select(*docs.columns, "base", "terms")


def sanitised(text: Column, spans: Column) -> Column:
    """`text` with the spans replaced by labels; of overlapping spans the one that starts first is written."""
    fixed = F.create_map(*[F.lit(x) for kv in (LABELS | {"gone": "", "blank": " "}).items() for x in kv])

    def label(s):
        value, of = F.substring(text, s["start"] + 1, -s["back"] - s["start"]), F.lit(TERM_LABEL)
        for pattern, name in reversed(CLASSES.items()):
            of = F.when(value.rlike(pattern), name).otherwise(of)
        return F.when(s["kind"] == "term", of).otherwise(fixed[s["kind"]])

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc, s):
        end = -s["back"]
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(s))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(ordered, begin, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """`docs` with personal data in `text` replaced and n_chars counted anew; every row stays, null texts too.

    The awkward rows are those of `find`; equal texts stay equal, an empty table stays empty.
    """
    found = find(docs, **kw)
    spans = F.concat("base", "terms")
    clean = F.when(F.size(spans) > 0, sanitised(F.col("text"), spans)).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.when(s["kind"] == "gone", "term").otherwise(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Base and term spans of all `documents`, as counts and digests: see `find` for the awkward rows."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.concat("base", "terms")).alias("spans"))
