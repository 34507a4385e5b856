"""Listing, latest versions, visibility, crosstabs, samples: the relational layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    """Rows offset .. offset + limit of the order; a page holds at most `most` rows."""
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the order given (newest first, with a tie-break)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Idempotent upsert: of old and new rows of a key the first in the order stays."""
    return latest(current.unionByName(incoming, allowMissingColumns=True), keys, order)


def delete(current: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true: false and unknown ones stay."""
    return current.filter(~F.coalesce(condition, F.lit(False)))


def cascade(child: DataFrame, gone: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children whose parent isn't among the deleted rows."""
    return child.join(gone.select(F.col(key).alias(child_key)).distinct(), child_key, "left_anti")


def update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def visible_projects(projects: DataFrame, members: DataFrame, user: int, flag: str | None = None) -> DataFrame:
    """Ids of projects that the user owns, or is a member of (with the flag, if one is named)."""
    mine = members.filter(F.col("user_id") == user)
    if flag:
        mine = mine.filter(F.col(flag))
    return projects.filter(F.col("owner_user_id") == user).select("project_id").union(mine.select("project_id")).distinct()


def visible(rows: DataFrame, projects: DataFrame) -> DataFrame:
    return rows.join(projects, "project_id", "left_semi")


def unblinded(results: DataFrame, assignments: DataFrame, user: int, mode: str, hide_ai: bool = False) -> DataFrame:
    """What a reviewer may see: all without blinding or assignment; own rows always; AI rows unless hidden."""
    if mode == "none":
        return results
    mine = assignments.filter(F.col("reviewer_user_id") == user).select("document_id").distinct().withColumn("_assigned", F.lit(True))
    own = F.coalesce(F.col("extracted_by") == user, F.lit(False))
    ai = (F.col("extraction_type") == "ai") & F.lit(not hide_ai)
    return results.join(mine, "document_id", "left").filter(F.col("_assigned").isNull() | own | F.coalesce(ai, F.lit(False))).drop("_assigned")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value a row, zero where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive containment; % and _ in the text act as wildcards, as in the listing it stands for."""
    return df.filter(F.col(column).ilike(f"%{text}%"))


def hash_order(seed: str, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(i).cast("string") for i in ids]))


def exact_sample(df: DataFrame, within: str, key: str, percent: int, seed: str = "qa") -> DataFrame:
    """max(1, floor(n * percent / 100)) rows of each group, by hash order: exact in size, the same in every run."""
    order = Window.partitionBy(within).orderBy(hash_order(seed, key), key)
    ranked = df.withColumn("_place", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(within)))
    return ranked.filter(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_place", "_n")


def running_total(df: DataFrame, value: str, by: list[str], order: list[Column], name: str, block: Column | None = None) -> DataFrame:
    """Running sum of `value` of each key in the order given.

    With `block`, which must not fall along the order (a day of the time, say), a key's rows are summed block by block:
    the blocks' sums run on first, and each block's rows are then summed apart, so no task holds a key's whole history.
    """
    if block is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = df.withColumn("_block", block)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = F.sum(value).over(Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("_inside", inside).join(starts, [*by, "_block"])
    return summed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_block", "_start", "_inside")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, block: Column | None = None) -> DataFrame:
    """Place of each row among its key's, from 1; `block` as in `running_total`."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), "_one", by, order, name, block).drop("_one")


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 1) of the order, each row with the total of rows."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, (number - 1) * size, size).crossJoin(F.broadcast(total))  # one row


def any_row(df: DataFrame, condition: Column) -> DataFrame:
    """One row (found): whether any row meets the condition; the scan ends at the first."""
    return df.filter(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def active_first(df: DataFrame, active: Column, newest: str, key: str, name: str = "place") -> DataFrame:
    """`df`, a short list, with the place of each row: active ones first, each part by newest; those without a date last."""
    order = Window.partitionBy().orderBy(F.when(active, 0).otherwise(1), F.desc_nulls_last(newest), key)
    return df.withColumn(name, F.row_number().over(order))


def first_of(key: str, *lists: DataFrame) -> DataFrame:
    """Union of lists with `src`, the number of the list; of rows with one key those of the first list stay."""
    both = None
    for i, rows in enumerate(lists):
        part = rows.withColumn("src", F.lit(i))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(key).agg(F.min_by(F.struct("*"), F.col("src")).alias("r")).select("r.*")


def latest_runs(runs: DataFrame, by: str, key: str, at: str, status: str) -> DataFrame:
    """(by, latest, latest_failed, n_active): newest run of each key, newest failed one, and how many are active; one pass."""
    newest = lambda cond: F.max(F.when(cond, F.struct(at, key)))[key]
    return runs.groupBy(by).agg(newest(F.lit(True)).alias("latest"), newest(F.col(status) == "failed").alias("latest_failed"), F.count_if(F.col(status).isin("active", "pending", "processing")).alias("n_active"))


def named(rows: DataFrame, key: str, people: DataFrame, default: Column, name: str = "name") -> DataFrame:
    """`rows` with the name of the person `key` points to: (user_id, full_name, email); a blank name is the email, none the default."""
    who = people.select(F.col("user_id").alias(key), F.coalesce(F.nullif(F.trim("full_name"), F.lit("")), F.col("email")).alias("_name"))
    return rows.join(who, key, "left").withColumn(name, F.coalesce("_name", default)).drop("_name")


def members_with_owner(projects: DataFrame, members: DataFrame, people: DataFrame) -> DataFrame:
    """(project_id, user_id, role, full_name): the owner first, then members other than the owner."""
    owner = projects.select("project_id", F.col("owner_user_id").alias("user_id"), F.lit("owner").alias("role"))
    others = members.join(owner.select("project_id", "user_id"), ["project_id", "user_id"], "left_anti").select("project_id", "user_id", F.lit("member").alias("role"))
    return owner.unionByName(others).join(people.select("user_id", "full_name"), "user_id", "left")


def same_name(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose name is `name`, whatever the case and the blanks around."""
    return df.filter(F.lower(F.trim(column)) == name.strip().lower())


def find_terms(terms: DataFrame, text: str, limit: int) -> DataFrame:
    """The first terms (ord, term, synonyms) that hold a text, in the term or in a synonym, whatever the case."""
    low = text.lower()
    hit = F.lower("term").contains(low) | F.exists("synonyms", lambda s: F.lower(s).contains(low))
    return terms.filter(F.coalesce(hit, F.lit(False))).orderBy("ord").limit(limit)


def find_labels(df: DataFrame, labels: str, text: str) -> DataFrame:
    """Rows one of whose labels holds a text, whatever the case."""
    return df.filter(F.coalesce(F.exists(labels, lambda s: F.lower(s).contains(text.lower())), F.lit(False)))


def since(now: Column, window: str) -> Column:
    """Start of 'today' (midnight), 'week' or 'month' (7 or 30 days back) as seen from `now`; anything else is a week."""
    return {"today": F.date_trunc("day", now), "month": now - F.expr("interval 30 days")}.get(window, now - F.expr("interval 7 days"))


def mark_read(df: DataFrame, condition: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, count): unread rows that meet the condition marked as read, with the time, and a one-row count of them."""
    hit = F.coalesce(condition, F.lit(False)) & ~F.col("read")
    return update(df, hit, read=F.lit(True), read_at=at), df.agg(F.count_if(hit).alias("n_marked"))


def set_where_in(df: DataFrame, condition: Column, column: str, allowed: list[str], value: str) -> DataFrame:
    """Sets a status, but only where it is one of `allowed` now."""
    return update(df, condition & F.col(column).isin(*allowed), **{column: F.lit(value)})


def unsampled(rows: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    return rows.join(sampled.select(key).distinct(), key, "left_anti")


def merge_terms(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of vocabulary terms (ord, term, ...), one a lower-cased term; existing ones win, then the earlier."""
    both = existing.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy(F.lower("term")).orderBy("src", "ord")))
    return ranked.filter("_r = 1").drop("_r")
