"""Document fingerprints: a canonical exact digest.

A text is put in one canonical form (Unicode compatibility composition, case folding, white space runs
to one space, trimmed), then hashed by xxhash64 under four seeds. Documents are grouped by that wide
hash; inside equal buckets the canonical bytes are compared, so unequal texts never share a class.
All of it is SQL functions: normalisation and case folding call the ICU library on Spark's own class path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SEEDS = (0x9E37, 0x79B9, 0x7F4A, 0x7C15)
#: Documents a group of neighbours holds on average, in next_rows.
GROUP = 64


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space folded; a null text counts as empty."""
    composed = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def wide_hash(canon: Column) -> Column:
    """256 bits in hexadecimal: xxhash64 of the bytes under four seeds."""
    parts = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(s), canon))), 16, "0") for s in SEEDS]
    return F.concat(*parts)


def classes(docs: DataFrame) -> DataFrame:
    """(hash, copies, first_id, rank, canon): one row per different canonical text; stored without canon where hashes don't collide.

    Equal texts collapse before the shuffle, so a group of any size is one row a task. The grouping
    compares the canonical bytes themselves; two texts under one hash stay two rows with ranks 0, 1, ...
    """
    grouped = docs.groupBy("_hash", "_canon").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    shared = Window.partitionBy("_hash")
    return stored(grouped.withColumn("_bytes", F.sha2(F.col("_canon"), 256)).drop("_canon").withColumn("_texts", F.count("*").over(shared)).withColumn("_rank", F.row_number().over(shared.orderBy("_bytes")) - 1))


def group_exact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with fingerprint, copies and first_id (smallest doc_id of its class of canonically equal texts).

    Null and empty texts are one class. Where two different texts share the wide hash, their
    fingerprints get their rank as a suffix. Caller columns of these names are replaced.
    """
    docs = docs.drop("fingerprint", "copies", "first_id")
    canon = docs.withColumn("_canon", canonical(F.col(text)))
    hashed = canon.withColumn("_hash", wide_hash(F.col("_canon")))
    found = classes(hashed.select("doc_id", "_hash", "_canon"))
    return with_classes(hashed.withColumn("_bytes", F.sha2(F.col("_canon"), 256)).drop("_canon"), found).drop("_hash", "_bytes")


def with_classes(hashed: DataFrame, found: DataFrame) -> DataFrame:
    plain = found.filter(F.col("_texts") == 1).select("_hash", "copies", "first_id")
    if found.filter(F.col("_texts") > 1).isEmpty():
        return hashed.join(plain, "_hash").withColumn("fingerprint", F.col("_hash"))
    named = found.select("_hash", "_bytes", "copies", "first_id", F.when(F.col("_texts") == 1, F.col("_hash")).otherwise(F.concat_ws("-", "_hash", "_rank")).alias("fingerprint"))
    return hashed.join(named, ["_hash", "_bytes"])


def next_rows(docs: DataFrame, carried: list[str]) -> DataFrame:
    """`docs` with next_<c> for each of `carried`, from the row of the next larger doc_id (after the last: the first).

    Ids are cut into groups of about GROUP neighbours, by quantiles and evenly between them, so that any
    spread of ids gives small groups; the rows move once. A group's last row takes the first row of the
    next group that has rows; only those first rows move once more.
    Equal ids are ordered by `carried`. A null id stands before all others.
    """
    cells = 256
    shares = [i / cells for i in range(1, cells)]
    n, lo, hi, cuts = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", shares, 10000)).first()
    cuts = cuts or []
    if lo is None:
        cuts, lo, hi = [], 0, 0
    edges = sorted({lo, *cuts, hi + 1})
    per = max(1, round(n / GROUP / max(1, len(edges) - 1)))
    widths = [max(1, -(-(b - a) // per)) for a, b in zip(edges, edges[1:])]
    at = F.array(*[F.lit(e).cast("long") for e in edges[:-1]])
    cell = F.size(F.filter(at, lambda e: e <= F.col("doc_id")))
    start, width = F.element_at(at, cell), F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), cell)
    group = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise((cell - 1).cast("long") * (per + 1) + F.floor((F.col("doc_id") - start) / width))
    order = [F.col("doc_id").asc_nulls_first(), *carried]
    grouped = docs.withColumn("_group", group)
    near = Window.partitionBy("_group").orderBy(*order)
    ends = lambda step: step(F.lit(1)).over(near).isNull()
    local = grouped.select("*", *[F.lead(c).over(near).alias(f"next_{c}") for c in carried], ends(F.lag).alias("_first"), ends(F.lead).alias("_last"))
    # all three readers of `local` share one exchange of the rows; the groups' order needs their numbers alone
    firsts = local.filter("_first").select(F.col("_group").alias("_to"), *[F.col(c).alias(f"next_{c}") for c in carried])
    # group -> next group that has rows: neighbours of neighbours, in blocks of 1024 groups, then between blocks
    ids = stored(docs.select(group.alias("_group")).distinct()).withColumn("_block", F.floor(F.col("_group") / 1024))
    inside = ids.withColumn("_to", F.lead("_group").over(Window.partitionBy("_block").orderBy("_group")))
    block = ids.groupBy("_block").agg(F.min("_group").alias("_head")).withColumn("_super", F.floor(F.col("_block") / 1024))
    in_super = block.withColumn("_hop", F.lead("_head").over(Window.partitionBy("_super").orderBy("_block")))
    supers = block.groupBy("_super").agg(F.min("_head").alias("_top"))
    over = Window.orderBy("_super")
    wrapped = supers.withColumn("_jump", F.coalesce(F.lead("_top").over(over), F.first("_top").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("_top")
    hops = in_super.join(wrapped, "_super").select("_block", F.coalesce("_hop", "_jump").alias("_hop"))
    step = inside.join(hops, "_block").select("_group", F.coalesce("_to", "_hop").alias("_to"))
    # null-safe keys: a plain join would filter its branch below the exchange, which then could not be shared
    entry = firsts.join(step, firsts["_to"].eqNullSafe(step["_to"])).drop("_to").withColumnRenamed("_group", "_from")
    nexts = [f"next_{c}" for c in carried]
    last = local.filter("_last").drop(*nexts)
    last = last.join(entry, F.col("_group").eqNullSafe(F.col("_from")))
    return local.filter("not _last").select(*docs.columns, *nexts).unionByName(last.select(*docs.columns, *nexts))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents` and of their edited texts: see `group_exact` and `next_rows` for the awkward rows.

    Null texts are empty ones; equal texts, repeated rows too, have equal fingerprints.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = next_rows(docs, ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("_canon"), canonical(F.col("_edited")).alias("_edited"), canonical(F.col("next_text")).alias("_next"),
    )
    hashed = pairs.select("*", wide_hash(F.col("_canon")).alias("_hash"), wide_hash(F.col("_edited")).alias("edited_fingerprint"), wide_hash(F.col("_next")).alias("_next_hash"), F.sha2("_canon", 256).alias("_bytes"))
    canon = docs.select("doc_id", canonical(F.col("text")).alias("_canon"))
    found = classes(canon.withColumn("_hash", wide_hash(F.col("_canon"))))
    out = with_classes(hashed.drop("_canon", "_edited", "_next"), found)
    # an exact digest likens equal texts only: 1 where the digests agree, else 0
    alike = lambda a, b: (a == b).cast("double")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        alike(F.col("_hash"), F.col("edited_fingerprint")).alias("near_edited"), alike(F.col("_hash"), F.col("_next_hash")).alias("near_next"), "copies", "first_id",
    )
