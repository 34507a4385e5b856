"""Files in and out: texts, vocabularies, page maps, exports, evaluation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import wide

PAGE_MAP = "array<struct<page:int,start_char:int,end_char:int>>"
HEADER = r"(?s)<!-- PAGE_MAP: (.*?) -->"


def read_texts(spark: SparkSession, path: str, containing: str = "", glob: str = "*.md", most: int | None = None) -> DataFrame:
    """(stem, text) of whole files whose stem holds a substring; `most` of them in name order if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), F.decode("content", "UTF-8").alias("text"))
    named = named.filter(F.col("stem").contains(containing))
    return named.orderBy("stem").limit(most) if most else named


def pair_files(pdfs: DataFrame, texts: DataFrame) -> DataFrame:
    """(pdf, stem) of PDF stems with their text: an equal stem, else an equal one without hyphens, the first of several."""
    exact = pdfs.join(texts.select("stem", F.col("stem").alias("found")), "stem", "left")
    loose = texts.groupBy(F.regexp_replace("stem", "-", "").alias("plain")).agg(F.min("stem").alias("near"))
    out = exact.withColumn("plain", F.regexp_replace("stem", "-", "")).join(loose, "plain", "left")
    return out.select(F.col("stem").alias("pdf"), F.coalesce("found", "near").alias("stem"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, synonyms, code) of a vocabulary CSV; synonyms stand between semicolons, blank terms are left out."""
    raw = spark.read.csv(path, header=True, schema="term string, synonyms string, code string", enforceSchema=False)
    parts = F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")
    return raw.filter(F.trim("term") != "").select(F.trim("term").alias("term"), parts.alias("synonyms"), F.coalesce("code", F.lit("")).alias("code"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ground truth: a JSON list of records, or one record."""
    return spark.read.schema(schema).json(path, multiLine=True)


def page_map(text: Column) -> Column:
    """The page map in the first 2000 characters, or null."""
    found = F.regexp_extract(F.substring(text, 1, 2000), HEADER, 1)
    return F.when(found != "", F.from_json(found, PAGE_MAP))


def with_page_map(text: Column, pages: Column) -> Column:
    return F.concat(F.lit("<!-- PAGE_MAP: "), F.to_json(pages), F.lit(" -->\n\n"), text)


def first_location(*sources: Column) -> Column:
    """The first place that is set, in the order of the fallback."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in sources])


def export_csv(values: DataFrame, keys: list[str], fields: list[str], path: str) -> None:
    """One row a key, one column a field in sorted order, missing ones empty."""
    wide(values, keys, fields).write.mode("overwrite").csv(path, header=True)


def export_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def save_records(records: DataFrame, path: str, override: bool = False) -> None:
    """Written once: an existing export stays unless override is set."""
    records.write.mode("overwrite" if override else "ignore").json(path)


def replace_source(rows: DataFrame, path: str) -> None:
    """Evaluation rows by source_file: the files that `rows` hold are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(path)


def append_calls(calls: DataFrame, path: str) -> None:
    """Append to the call log, each call hash once; the log is read to leave out what it has."""
    spark = calls.sparkSession
    new = calls.dropDuplicates(["call_hash"])
    try:
        new = new.join(spark.read.schema(calls.schema).parquet(path).select("call_hash"), "call_hash", "left_anti")
    except Exception as e:  # the log's first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def list_results(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(name, bytes, modified) of the cached result files in a folder, the newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.orderBy(F.desc("modified"), "name")


def sample_records(records: DataFrame, key: str, most: int = 5, seed: str = "sample") -> DataFrame:
    """Up to `most` records, the same in every run."""
    return records.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(most)


CALLS = "call_hash string, model string, prompt_tokens long, completion_tokens long, cost double, ts timestamp"


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Call history from CSV files with a header."""
    return spark.read.csv(path, header=True, schema=CALLS, enforceSchema=False)


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(schema, field, kind) from the field mappings of a folder: schema_*/field_mapping.json, objects of a name and a type."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "field_mapping.json").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("schema"), F.from_json(F.decode("content", "UTF-8"), "map<string,string>").alias("fields"))
    return named.select("schema", F.explode("fields").alias("field", "kind"))


def stamped(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """`rows` with updated_at, the time of the write."""
    return rows.withColumn("updated_at", F.current_timestamp() if now is None else now)


def export_one_csv(values: DataFrame, keys: list[str], header: list[str], path: str) -> None:
    """One row a key under a given header, the first record's keys in their order; other fields are left out."""
    out = values.filter(F.col("field").isin(*header)).groupBy(*keys).pivot("field", header).agg(F.first("value")).fillna("", subset=header)
    out.select(*keys, *header).coalesce(1).write.mode("overwrite").csv(path, header=True)  # one small file


def evaluation_rows(details: DataFrame, key: str) -> DataFrame:
    """(pair, classification, side, value) of evaluation details: a true positive is two rows of one pair, the others are one."""
    true = F.col("classification") == "TP"
    sides = F.when(true, F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("extracted", "truth")]))
    sides = sides.when(F.col("classification") == "FN", F.array(F.struct(F.lit("truth").alias("side"), F.col("truth").alias("value"))))
    sides = sides.otherwise(F.array(F.struct(F.lit("extracted").alias("side"), F.col("extracted").alias("value"))))
    return details.select(F.col(key).alias("pair"), "classification", F.inline(sides))
