"""Fingerprints, PII, mixing: against brute force on the small tables, and the awkward rows."""

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from gleanwork.llm import fingerprints, mixing, pii
from gleanwork.llm.queries import QUERIES, SQL

from ..conftest import SF, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A null in every column, empty and long texts, ties and repeated rows.
ROWS = [(1, "A  b\n", "en", "s", 5), (2, "a B", "en", "s", 3), (2, "a B", "en", "s", 3), (3, None, None, None, None), (None, "x y", "en", "t", 3), (4, "", "en", "s", 0), (5, "long " * 60_000, "en", "s", 300_000)]


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def test_mixing_equals_its_oracle(spark, oracle):
    got = QUERIES["op10_mixing"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(oracle(SQL["op10_mixing"]))
    by = got.groupby("source_size").agg({"target": "first", "taken": "sum"})
    assert (got.taken <= 2 * got["size"]).all() and (by.target <= 2 * by.index).all()
    assert abs(by.target.sum() - 1.5 * by.index.to_series().sum()) < 1


def test_mixing_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("size", F.lit("mine")).withColumn("target", F.lit("mine"))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    counted = mixing.with_copies(df).filter("source is null").first()
    assert (counted["size"], counted.source_size, counted.target) == (0, 0, 0.0)


def test_fingerprints_against_brute_force(spark):
    d = documents()
    got = QUERIES["op1_fingerprints"](spark, SF).toPandas().set_index("doc_id").sort_index()
    nxt = list(d.text[1:]) + [d.text[0]]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(d.text, nxt)]
    assert list(got.edited_sha256) == [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    canon = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip() for t in d.text]
    first = d.doc_id.groupby(pd.Series(canon)).transform("min")
    assert list(got.first_id) == list(first)
    assert got.fingerprint.nunique() == len(set(canon))


def test_fingerprints_awkward_rows(spark):
    rows = [*ROWS, (6, "ﬁne café STRASSE", "en", "s", 3), (7, "fine café  straße", "en", "s", 3)]
    got = fingerprints.group_exact(spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("mine"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].fingerprint == by[2].fingerprint and by[1].copies == 3
    assert by[3].fingerprint == by[4].fingerprint != by[5].fingerprint
    assert by[6].fingerprint == by[7].fingerprint
    assert fingerprints.group_exact(spark.createDataFrame([], DOCS)).count() == 0


def test_next_rows_of_scattered_ids(spark):
    ids = [5, 9, 10, 1_000_000, 2**60, -7, *range(20_000, 20_400)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.next_rows(df, ["text"]).collect()}
    ordered = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    one = fingerprints.next_rows(df.filter("doc_id = 5"), ["text"]).collect()
    assert [(r.doc_id, r.next_text) for r in one] == [(5, "t5")]
    assert fingerprints.next_rows(df.filter("doc_id = 0"), ["text"]).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group()))


def test_pii_against_brute_force(spark):
    got = QUERIES["op8_pii"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(*(documents()[c] for c in ("doc_id", "text"))):
        assert got.base_sha256[i] == hashlib.sha256(base_spans(t).encode()).hexdigest()


HARD = [
    "a@b.c_d@e.f x@y", "..@a.b@c.d.e..f", "1.2.3.4.5.6.7.8 0300.1.1.1 256.1.1.1 00255.1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-", "1 2 3 4 5 6 7 8 9 0 1 2 3  4",
    "+1 (555) 010-9999) +12345 +1--", "😀 é 4111111111111111 😀 b@c.de", "private  marks  z@z.zz", "9" * 30_000, "1 " * 30_000, "a." * 20_000 + "@b.c", "@" + ".a" * 20_000, None, "",
]


def test_pii_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("base", F.lit("mine"))
    for r in pii.find(df).select("doc_id", pii.joined_spans(F.col("base")).alias("s")).collect():
        assert r.s == base_spans(HARD[r.doc_id] or ""), r.doc_id


def test_disclosing_terms_are_found_and_replaced(spark):
    texts = [f"word{i % 7} common filler number{i} and the rest" for i in range(60)] + [f"contact zanzibar chief bob@corp.org number{i} please" for i in range(4)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    clean = {r.doc_id: r for r in pii.sanitise(df, min_support=3).collect()}
    assert len(clean) == 64 and "zanzibar" not in clean[60].text and "[EMAIL]" in clean[60].text and "number0" in clean[60].text
    assert clean[60].n_chars == len(clean[60].text) and clean[0].text == texts[0]
    assert pii.sanitise(spark.createDataFrame([], DOCS)).count() == 0
    assert pii.sanitise(spark.createDataFrame(ROWS, DOCS)).count() == len(ROWS)


def test_disclosing_terms_are_replaced_far_from_the_mention(spark):
    far = " ".join(f"w{i}" for i in range(50))
    texts = [f"word{i % 7} {far} number{i} and the rest" for i in range(3000)]
    texts += [f"zanzibar bob@corp.org {far} number{i} and Zanzibar, mombasa" for i in range(40)] + [f"{far} and Zanzibar alone"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    clean = [r.text for r in pii.sanitise(df, min_support=3).collect()]
    assert len(clean) == len(texts) and not any("zanzibar" in t.lower() or "mombasa" in t for t in clean)
    assert all(far in t for t in clean)


def test_copies_do_not_hide_a_disclosing_term(spark):
    texts = [f"word{i % 7} common filler number{i} and the rest" for i in range(60)] + [f"contact zanzibar bob@corp.org number{i} please" for i in range(3) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    clean = [r.text for r in pii.sanitise(df, min_support=3).collect()]
    assert len(clean) == len(texts) and not any("zanzibar" in t for t in clean)


def test_entities_in_every_document_disclose_nothing(spark):
    texts = [f"contact zanzibar chief bob@corp.org number{i} please" for i in range(4)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).withColumn("_kinds", F.lit("mine")).withColumn("term", F.lit("mine"))
    got = pii.find(df)
    assert all(r.terms == [] and len(r.base) == 1 for r in got.collect()) and got.columns == [c for c in df.columns if c != "_kinds"] + ["base", "terms"]


def brute_terms(texts, min_support, generalise_at, remove_at, kinds=False):
    """Spans of disclosing terms by plain counting over different texts."""
    import math

    term = re.compile(r"[^\W_]+")
    one = {}
    for t in set(texts):
        spans, masked = [], list(t)
        for x in base_spans(t).split(","):
            if x:
                kind, a, b = x.split(":")
                spans.append((kind, int(a), int(b)))
        for _, a, b in spans:
            masked[a:b] = " " * (b - a)
        names = {f"{k}:{(re.sub('[^0-9]', '', t[a:b]) if k in ('card', 'phone') else t[a:b]).lower()}" for k, a, b in spans}
        one[t] = (spans, names, set(term.findall("".join(masked).lower())), set(term.findall(t.lower())))
    n, with_kinds, kinds = len(one), kinds, {}
    for e in {e for _, names, _, _ in one.values() for e in names}:
        with_e = [v for v in one.values() if e in v[1]]
        if not min_support <= len(with_e) < n:
            continue
        for t in set().union(*(v[2] for v in with_e)):
            n_et = sum(t in v[2] for v in with_e)
            n_t = max(n_et, sum(t in v[3] for v in one.values()))
            score = math.log2(n_et * n / (len(with_e) * n_t)) / math.log2(n / len(with_e))
            if n_et >= min_support and score >= generalise_at:
                kinds[t] = "gone" if score >= remove_at or kinds.get(t) == "gone" else "term"
    out = {}
    for t, (spans, *_) in one.items():
        found = [(kinds[m.group().lower()], m.start(), m.end()) for m in term.finditer(t) if m.group().lower() in kinds]
        found = [(k, a, b) for k, a, b in found if not any(x < b and y > a for _, x, y in spans)]
        out[t] = found if with_kinds else [(a, b) for _, a, b in found]
    return out


def test_all_spans_against_brute_force(spark):
    plain = QUERIES["op8_pii"](spark, SF).toPandas().set_index("doc_id").spans
    d = documents()
    planted = [f"Zanzibar chief bob@corp.org {t[:200]} mombasa" for t in d.text[:9]] + [f"mombasa and {t[:90]}" for t in d.text[20:22]] + ["+1 555 010 9999 anna zanzibar"] * 4
    for texts, found in ((list(d.text), plain), (list(d.text) + planted, None)):
        if found is None:
            df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
            found = {r[0]: r[1] for r in pii.find(df).select("doc_id", pii.joined_spans(F.concat("base", "terms"))).collect()}
        want = brute_terms(texts, 3, 0.9, 0.98)
        for i, t in zip(list(d.doc_id) if len(texts) == len(d) else range(len(texts)), texts):
            assert found[i] == ",".join([x for x in [base_spans(t)] if x] + [f"term:{a}:{b}" for a, b in want[t]]), i
    assert any(want.values())


def test_generalised_terms_name_their_class(spark):
    spans = F.array(*[F.struct(F.lit("term").alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 6), (7, 11), (12, 15), (16, 20))])
    got = spark.createDataFrame([("Berlin 1984 x21 tree",)], "text string").select(pii.sanitised(F.col("text"), spans)).first()[0]
    assert got == "[NAME] [NUMBER] [CODE] [TERM]"


def test_native_queries_have_no_python(spark):
    for name in ("op1_fingerprints", "op8_pii"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|InArrow|InPandas", plan)
