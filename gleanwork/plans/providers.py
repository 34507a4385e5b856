"""Extraction by providers: objects that are made once a partition and asked in batches, with retries; and what a run reports.

A provider stands where a model call would: provider(texts, known, attempt) gives one dictionary a text, `known` being the
fields that the stage may see. Whatever finds nothing at all is asked again, at most RETRIES times, and the best answer stays.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..storage import written

#: Attempts after the first, texts asked at once; the retries are a fixed value.
RETRIES, BATCH = 2, 64
EMPTY, NOT_REPORTED = ("", "{}", "[]"), ("nr", "n/r", "not reported")

Provider = Callable[[list[str], list[dict], int], list[dict]]


def worth(value: str | None) -> float:
    text = "" if value is None else str(value).strip().lower()
    return 0.0 if text in EMPTY else 0.7 if text in NOT_REPORTED else 1.0


def answer_score(values: dict | None) -> float:
    return sum(map(worth, values.values())) / len(values) if values else 0.0


def finds_nothing(values: dict | None) -> bool:
    return not values or all(worth(v) < 1 for v in values.values())


def asked(provider: Provider, texts: list[str], known: list[dict], retries: int = RETRIES) -> list[tuple[dict | None, int]]:
    """(best answer or None, attempts) of each text. A call that fails is an attempt that found nothing for its texts."""
    best: list[dict | None] = [None] * len(texts)
    tries = [0] * len(texts)
    open_ = list(range(len(texts)))
    for attempt in range(retries + 1):
        try:
            got = provider([texts[i] for i in open_], [known[i] for i in open_], attempt)
        except Exception:  # noqa: BLE001  a provider may fail in any way
            got = [None] * len(open_)
        for i, values in zip(open_, got):
            tries[i] += 1
            if values is not None and (best[i] is None or answer_score(values) > answer_score(best[i])):
                best[i] = values
        open_ = [i for i, values in zip(open_, got) if finds_nothing(values)]
        if not open_:
            break
    return list(zip(best, tries))


def run_stages(papers: DataFrame, stages: list[dict], key: str = "doc_id", batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """(key, values, attempts, failed) of `papers` (key, text): the fields of all stages, later ones winning.

    A stage is {"providers": {name: make}, "requires": [fields]}; make() gives a new provider, for each partition. A
    provider sees the fields that `requires` names, or all known ones without it. Each stage's outcome is written down,
    so a lost executor repeats one stage's partition and no earlier call. `attempts` has the calls by provider, `failed`
    those that never answered.
    """
    start = papers.select(key, "text", F.expr("cast(map() as map<string,string>)").alias("values"), F.expr("cast(map() as map<string,int>)").alias("attempts"), F.expr("cast(array() as array<string>)").alias("failed"))
    out = start
    for stage in stages:
        out = written(_stage(out, stage, batch, retries))
    return out.drop("text")


def _stage(papers: DataFrame, stage: dict, batch: int, retries: int) -> DataFrame:
    makers, requires = stage["providers"], stage.get("requires")

    def run(batches):
        providers = {name: make() for name, make in makers.items()}
        for part in batches:
            texts = [t or "" for t in part.column("text").to_pylist()]
            values, attempts = ([dict(x) for x in part.column(c).to_pylist()] for c in ("values", "attempts"))
            failed = part.column("failed").to_pylist()
            known = [v if requires is None else {k: v[k] for k in requires if k in v} for v in values]
            new: list[dict] = [{} for _ in texts]
            for name, provider in providers.items():
                for at in range(0, len(texts), batch):
                    for i, (found, n) in enumerate(asked(provider, texts[at : at + batch], known[at : at + batch], retries), at):
                        attempts[i][name] = n
                        if found is None:
                            failed[i] = [*failed[i], name]
                        else:
                            new[i] |= {k: None if v is None else str(v) for k, v in found.items()}
            kinds = part.schema
            columns = {"values": [list((v | n).items()) for v, n in zip(values, new)], "attempts": [list(a.items()) for a in attempts], "failed": failed}
            for name, rows in columns.items():
                part = part.set_column(kinds.get_field_index(name), name, pa.array(rows, kinds.field(name).type))
            yield part

    return papers.mapInArrow(run, papers.schema)


class Patterns:
    """A provider that looks fields up by pattern, with another set of patterns at each attempt; what isn't found is NR."""

    def __init__(self, *attempts: dict[str, str]):
        import re

        self.attempts = [{f: re.compile(p) for f, p in patterns.items()} for patterns in attempts]

    def __call__(self, texts: list[str], known: list[dict], attempt: int) -> list[dict]:
        patterns = self.attempts[min(attempt, len(self.attempts) - 1)]
        return [{f: m[1] if (m := p.search(t)) else "NR" for f, p in patterns.items()} for t in texts]


def observed(run: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """`run_stages`' rows with counts on the side: papers, calls, retried and failed ones, known once the rows have been used."""
    seen = Observation(name)
    calls = F.map_values("attempts")
    total = F.aggregate(calls, F.lit(0), lambda a, x: a + x)
    retried = F.exists(calls, lambda x: x > 1)
    return run.observe(seen, F.count("*").alias("papers"), F.sum(total).alias("calls"), F.count_if(retried).alias("retried"), F.count_if(F.size("failed") > 0).alias("failed")), seen


def papers_done(papers: DataFrame, done, checkpoint: str):
    """Start a stream that hands each batch of finished papers to `done(rows, batch)`; the caller stops it."""
    return papers.writeStream.foreachBatch(done).option("checkpointLocation", checkpoint).start()


class RunLog(StreamingQueryListener):
    """Execution times of a stream's batches, each given to `log` as (query, batch, rows, milliseconds)."""

    def __init__(self, log: Callable[[tuple], None]):
        self.log = log

    def onQueryStarted(self, event) -> None: ...  # noqa: N802

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.log((p.name, p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event) -> None: ...  # noqa: N802

    def onQueryTerminated(self, event) -> None: ...  # noqa: N802


def register_metric(spark: SparkSession, name: str, metric: Callable[[pd.Series, pd.Series], float]) -> None:
    """Make metric(extracted, truth), of a group's columns, an aggregate of SQL under a name."""

    def whole(extracted: pd.Series, truth: pd.Series) -> float:
        return float(metric(extracted, truth))

    spark.udf.register(name, F.pandas_udf(whole, T.DoubleType()))
