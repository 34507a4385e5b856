"""Quality rules: statistics of one text, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, white space folded, runs of digits as one 0) and hashed together with their
host, the document's source. A line is boilerplate where more than FLOOR different documents of the host hold it and
more than SHARE of them do; copies of a text count once, so that repeated documents are no boilerplate of each other.
Boilerplate goes, and a document is rejected that keeps fewer than LEAST words or less than LEFT of them. Before
that, the base rules reject very short texts and those that repeat themselves.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, stored, table, widened

#: A line goes if more than FLOOR documents of its host and more than SHARE of them hold it.
FLOOR, SHARE = 10, 0.01
#: A document is depleted if fewer words than LEAST, or less than LEFT of its words, stay.
LEAST, LEFT = 10, 0.3
#: Base rules: fewest words, and the largest percentage of words in repeated windows of WINDOW words.
WORDS, REPEATED, WINDOW = 10, 20, 5
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"

_DIGITS = re.compile(rb"[0-9]+")


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in windows of WINDOW words that the text holds twice or more."""
    if len(words) <= WINDOW:
        return 0
    if len(words) < 1 << 20 and len(set(zip(*(words[i:] for i in range(WINDOW))))) == len(words) - WINDOW + 1:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    window = ids[: len(ids) - WINDOW + 1]
    for i in range(1, WINDOW):  # pairs of (window so far, next word), numbered anew
        window = np.unique(window * len(number) + ids[i : i + len(window)], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(window)[window] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def normal_line(line: bytes) -> bytes:
    return _DIGITS.sub(b"0", b" ".join(line.lower().split()))


def hashed(source: str | None, what: bytes) -> bytes:
    """128 bits of a host and a line or text of it."""
    host = b"-" if source is None else b"+" + source.encode("utf-8", "surrogatepass")
    return blake2b(len(host).to_bytes(4, "big") + host + what, digest_size=16).digest()


BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean"}
MEASURED = BASE | {"rules_key": "binary", "rules_lines": "array<struct<line: binary, words: bigint>>"}


def measure(text: str | None, source: str | None) -> tuple:
    """Values of MEASURED for one whole text; rules_lines has each different normalised line with a word, and its words in all."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kept: dict[bytes, int] = {}
    for x in lines:
        key = hashed(source, normal_line(x))
        kept[key] = kept.get(key, 0) + len(x.split())
    n, again = len(words), repeated_words(words)
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    return (
        n, len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), again, n < WORDS or 100 * again > REPEATED * n,
        hashed(source, b"\0" + raw), [{"line": k, "words": v} for k, v in kept.items()],
    )


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with the columns of MEASURED."""
    schema = widened(docs, **MEASURED)
    types = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))]

    def run(batches):
        for batch in batches:
            texts, hosts = batch.column("text"), batch.column("source")
            columns = zip(*(measure(t.as_py(), s.as_py()) for t, s in zip(texts, hosts))) if len(texts) else [[]] * len(types)
            for name, kind, values in zip(MEASURED, types, columns):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    return docs.mapInArrow(run, schema)


def common_lines(texts: DataFrame, floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """(line): boilerplate among (source, rules_key, rules_lines), of which each different text of a host is one row.

    A line's count is summed before and after the shuffle, so that one in a third of all texts is no burden.
    """
    counts = texts.select("source", F.explode("rules_lines.line").alias("line")).groupBy("line").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    counts = stored(counts.filter(F.col("n") > floor))
    hosts = stored(texts.groupBy("source").agg(F.count("*").alias("texts")))
    return join_small(counts, hosts, "source").filter(F.col("n") > share * F.col("texts")).select("line")


#: What `judge` and `clean` add or use on the way; a caller's columns of these names are replaced.
OWN = (*MEASURED, "rules_lost", "n_lines_removed", "n_words_left", "removed_lines", "kept")


def judge(docs: DataFrame, floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """`docs` with the statistics of BASE, n_lines_removed (different lines), n_words_left, removed_lines (their hashes) and kept.

    Null and empty texts have no words and fail the base rules. Null is a source of its own. Of long texts every word
    and line counts. Repeated rows, and copies under other ids, are judged alike and counted once. Rows need no id. An
    empty table stays empty. A caller's columns named as in OWN are replaced.
    """
    docs = docs.drop(*OWN)
    seen = stored(measured(docs))
    # a hot text (copies of one) is combined before the shuffle: one row a task
    texts = stored(seen.select("source", "rules_key", "rules_lines").dropDuplicates(["rules_key"]))
    lines = texts.select("rules_key", F.explode("rules_lines").alias("l")).select("rules_key", "l.*")
    boilerplate = stored(common_lines(texts, floor, share))
    lost = join_small(lines, boilerplate, "line", "inner").groupBy("rules_key").agg(F.sum("words").alias("rules_lost"), F.collect_list("line").alias("removed_lines"))
    lost = stored(lost)
    out = join_small(seen.drop("rules_lines"), lost, "rules_key")
    left = F.col("n_words") - F.coalesce("rules_lost", F.lit(0))
    kept = ~F.col("base_failed") & (left >= LEAST) & (left >= LEFT * F.col("n_words"))
    removed = F.coalesce("removed_lines", F.array().cast("array<binary>"))
    out = out.withColumn("removed_lines", removed).withColumn("n_lines_removed", F.size("removed_lines").cast("long")).withColumn("n_words_left", left).withColumn("kept", kept)
    return out.drop("rules_lost", "rules_key")


def clean(docs: DataFrame, **kw) -> DataFrame:
    """The documents that `judge` keeps, without their boilerplate lines, with the columns of `docs`."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            out = []
            for text, source, removed in zip(*(batch.column(c) for c in ("text", "source", "removed_lines"))):
                gone, host, raw = set(removed.as_py()), source.as_py(), text.as_py()
                out.append("\n".join(x for x in raw.split("\n") if hashed(host, normal_line(x.encode("utf-8", "surrogatepass"))) not in gone) if gone else raw)
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))
            yield batch.select(names)

    return judge(docs, **kw).filter("kept").select(*names, "removed_lines").mapInArrow(run, docs.schema)


def op11_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all `documents`: see `judge` for the awkward rows."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", *BASE, "n_lines_removed", "n_words_left", "kept")


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)
), windows AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, w) AS n FROM (
    SELECT r, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS w, lead(word, 4) OVER o AS w5 FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)) WHERE w5 IS NOT NULL
), again AS (
  SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, pos + unnest([0, 1, 2, 3, 4]) AS pos FROM windows WHERE n > 1) GROUP BY r
), per AS (
  SELECT r, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY r
), lines AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'), '[0-9]+', '0', 'g') AS normal
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY r
), texts AS (
  SELECT source, text, min(r) AS r FROM docs GROUP BY source, text
), hosts AS (
  SELECT source, count(*) AS n FROM texts GROUP BY source
), common AS (
  SELECT t.source, l.normal FROM texts t JOIN lines l ON l.r = t.r JOIN hosts h ON h.source IS NOT DISTINCT FROM t.source
  WHERE l.n > 0 GROUP BY t.source, l.normal, h.n HAVING count(DISTINCT l.r) > 10 AND count(DISTINCT l.r) > 0.01 * h.n
), lost AS (
  SELECT d.r, count(DISTINCT l.normal) AS n_lines, sum(l.n) AS n FROM docs d JOIN lines l ON l.r = d.r JOIN common c ON c.source IS NOT DISTINCT FROM d.source AND c.normal = l.normal WHERE l.n > 0 GROUP BY d.r
), base AS (
  SELECT d.doc_id, d.r, coalesce(per.n, 0)::BIGINT AS n_words, coalesce(per.chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n_lines, 0)::BIGINT AS n_lines_removed, (coalesce(per.n, 0) - coalesce(lost.n, 0))::BIGINT AS n_words_left
  FROM docs d LEFT JOIN per ON per.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN again ON again.r = d.r LEFT JOIN lost ON lost.r = d.r
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed, n_words_left,
  NOT base_failed AND n_words_left >= 10 AND n_words_left >= 0.3 * n_words AS kept FROM failed
"""
