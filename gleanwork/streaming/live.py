"""Job messages as they happen: silence and deadlines by timers, replay for late joiners, late rows beside the others.

Each of these exists twice, as a stream with state and as a plain batch plan over a finished log; both give the same rows.
Streams take their time either from the rows (a watermark says how far it has come, and rows are worked off in its
order, however they arrive) or from the clock (rows count as of their arrival, and timers fire without further rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .messages import ALIVE_S, REPLAYED, SILENCE_S, STUCK_S

#: Message types that end a job.
TERMINAL = ("complete", "failed")

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """A key's rows in order of time, and ticks in between.

    A subclass says what a row does (`see`), what happens up to an instant (`tick`) and when it next wants a tick
    (`due`). By event time, rows wait in state until the watermark has passed them; by the clock, they count at once.
    Rows have `at` (milliseconds) and the columns of `columns`, by which rows of one instant are ordered.
    """

    columns: dict[str, str] = {}

    def __init__(self, clock: bool):
        self.clock = clock

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, " + ", ".join(f"{c} {t}" for c, t in self.columns.items()))
        self.open()

    def open(self) -> None: ...

    def load(self) -> None: ...

    def save(self) -> None: ...

    def see(self, at: int, *row) -> Iterator[tuple]:
        yield from ()

    def tick(self, until: int) -> Iterator[tuple]:
        yield from ()

    def due(self) -> int | None:
        return None

    def rank(self, row: tuple) -> tuple:
        return row

    def _advance(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        self.load()
        out = []
        for row in sorted(rows, key=self.rank):
            out += [*self.tick(row[0]), *self.see(*row)]
        out += self.tick(now)
        self.save()
        yield pd.DataFrame([(*key, *r) for r in out], columns=self.names)

    def _timers(self, *instants: int | None) -> None:
        """One timer a key: the first of the instants."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wanted = [t for t in instants if t is not None]
        if wanted:
            self.handle.registerTimer(min(wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        kinds = ["long", *self.columns.values()]  # a column of numbers with gaps comes as floats
        new = [tuple(None if pd.isna(x) else int(x) if k == "long" else x for k, x in zip(kinds, r)) for part in rows for r in part[["at", *self.columns]].itertuples(index=False)]
        if self.clock:
            now = timerValues.getCurrentProcessingTimeInMs()
            yield from self._advance(key, [(now, *r[1:]) for r in new], now)
            self._timers(self.due())
            return
        held = [tuple(r) for r in self.waiting.get()] + new
        self.waiting.put(held)
        self.load()
        self._timers(min(r[0] for r in held), self.due())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.clock:
            yield from self._advance(key, [], timerValues.getCurrentProcessingTimeInMs())
            self._timers(self.due())
            return
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        later = [r for r in held if r[0] > now]
        yield from self._advance(key, [r for r in held if r[0] <= now], now)
        self.waiting.put(later) if later else self.waiting.clear()
        self._timers(min((r[0] for r in later), default=None), self.due())


class Watch(Ordered):
    """Heartbeats in a job's silence, and its failure at its deadline; nothing after its end."""

    columns = {"seq": "long", "type": "string"}

    def __init__(self, clock: bool, silence_ms: int, stuck_ms: int, names: list[str]):
        super().__init__(clock)
        self.silence, self.stuck, self.names = silence_ms, stuck_ms, names

    def open(self) -> None:
        self.held = self.handle.getValueState("job", "started long, beat long, ended boolean")

    def load(self) -> None:
        self.started, self.beat, self.ended = self.held.get() if self.held.exists() else (None, None, False)

    def save(self) -> None:
        if self.started is not None:
            self.held.update((self.started, self.beat, self.ended))

    def see(self, at, seq, type):
        if not self.ended:
            self.started = at if self.started is None else self.started
            self.beat, self.ended = at, type in TERMINAL
        yield from ()

    def tick(self, until):
        while (t := self.due()) is not None and t <= until:
            if t == self.beat + self.silence:
                self.beat = t
                yield "heartbeat", t
            if t == self.started + self.stuck:
                self.ended = True
                yield "stuck", t

    def due(self):
        return None if self.started is None or self.ended else min(self.beat + self.silence, self.started + self.stuck)


class Replay(Ordered):
    """Messages to subscribers: those a buffer holds when they join, and then each one as it comes."""

    columns = {"seq": "long", "subscriber": "string", "message": "string"}

    def __init__(self, clock: bool, n: int, alive_ms: int, names: list[str]):
        super().__init__(clock)
        self.n, self.alive, self.names = n, alive_ms, names

    def open(self) -> None:
        ttl = self.alive if self.clock else None  # the state store's own expiry goes by the clock
        self.buffer = self.handle.getListState("buffer", "at long, seq long, message string", ttl)
        self.joined = self.handle.getMapState("joined", "subscriber string", "at long")

    def load(self) -> None:
        self.history = [tuple(r) for r in self.buffer.get()]
        self.readers = sorted(k[0] for k in self.joined.keys())

    def save(self) -> None:
        self.buffer.put(self.history) if self.history else self.buffer.clear()

    def rank(self, row):
        at, seq, subscriber, _ = row
        return at, subscriber is not None, seq if seq is not None else -1, subscriber or ""

    def see(self, at, seq, subscriber, message):
        self.history = [h for h in self.history if h[0] > at - self.alive][-self.n :]
        if subscriber is None:
            self.history = [*self.history, (at, seq, message)][-self.n :]
            yield from ((r, seq, message, "live") for r in self.readers)
        elif subscriber not in self.readers:  # joining twice changes nothing
            self.readers.append(subscriber)
            self.joined.updateValue((subscriber,), (at,))
            yield from ((subscriber, s, m, "replay") for _, s, m in self.history)


def _timed(rows: DataFrame, key: str, ts: str, delay: str | None, *columns: Column) -> DataFrame:
    rows = rows.withWatermark(ts, delay) if delay else rows
    return rows.select(key, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), *columns)


def _run(rows: DataFrame, key: str, ts: str, processor: Ordered, schema: str, clock: bool) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # timers and lists need it
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if clock else "EventTime")


def watch_stream(messages: DataFrame, key: str = "job_id", ts: str = "ts", delay: str | None = "0 seconds", silence_s: float = SILENCE_S, stuck_s: float = STUCK_S) -> DataFrame:
    """Stream (key, kind, at) of heartbeats and stuck jobs for a stream of messages (key, ts, seq, type).

    With a `delay`, time is that of the rows and the watermark that far behind; with None, it is the clock's, and
    beats and failures come without any further message.
    """
    rows = _timed(messages, key, ts, delay, F.col("seq").cast("long").alias("seq"), "type")
    of = messages.schema[key].dataType.simpleString()
    out = _run(rows, key, ts, Watch(delay is None, int(silence_s * 1000), int(stuck_s * 1000), [key, "kind", "at"]), f"{key} {of}, kind string, at long", delay is None)
    return out.withColumn("at", F.timestamp_millis("at"))


def silences(messages: DataFrame, as_of: Column, key: str = "job_id", ts: str = "ts", silence_s: int = SILENCE_S, stuck_s: int = STUCK_S) -> DataFrame:
    """(key, seq, beats): heartbeats in the silence after each message, up to the next one, the job's end or `as_of`; messages after its end don't count."""
    rows = _with_end(messages, key, ts, stuck_s).filter(F.col("_at") < F.col("_end"))
    after = F.lead("_at").over(Window.partitionBy(key).orderBy("_at", "seq"))
    until = F.least(F.coalesce(after, F.col("_end")), F.unix_millis(as_of.cast("timestamp")))
    beats = F.floor((until - F.col("_at")) / (silence_s * 1000)).cast("long")
    return rows.select(key, "seq", beats.alias("beats")).filter("beats > 0")


def deadlines(messages: DataFrame, as_of: Column, key: str = "job_id", ts: str = "ts", stuck_s: int = STUCK_S) -> DataFrame:
    """(key, failed_at) of jobs that did not end within stuck_s seconds of their first message, as far as `as_of`."""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    jobs = messages.groupBy(key).agg((F.min(at) + stuck_s * 1000).alias("_due"), F.min(F.when(F.col("type").isin(*TERMINAL), at)).alias("_done"))
    late = (F.col("_done").isNull() | (F.col("_done") >= F.col("_due"))) & (F.col("_due") <= F.unix_millis(as_of.cast("timestamp")))
    return jobs.filter(late).select(key, F.timestamp_millis("_due").alias("failed_at"))


def _with_end(messages: DataFrame, key: str, ts: str, stuck_s: int) -> DataFrame:
    job = Window.partitionBy(key)
    rows = messages.withColumn("_at", F.unix_millis(F.col(ts).cast("timestamp")))
    done = F.min(F.when(F.col("type").isin(*TERMINAL), F.col("_at"))).over(job)
    return rows.withColumn("_end", F.least(done, F.min("_at").over(job) + stuck_s * 1000))


def replay_stream(feed: DataFrame, key: str = "job_id", ts: str = "ts", delay: str | None = "0 seconds", n: int = REPLAYED, alive_s: float = ALIVE_S) -> DataFrame:
    """Stream (key, subscriber, seq, message, how) for a feed (key, ts, seq, subscriber, message) of messages and joins.

    A row with a subscriber is a join, any other a message. A subscriber gets the last n messages that are at most
    alive_s old when it joins (how = replay), in order, and every later one once (live). `delay` as in `watch_stream`.
    """
    rows = _timed(feed, key, ts, delay, F.col("seq").cast("long").alias("seq"), "subscriber", "message")
    of = feed.schema[key].dataType.simpleString()
    processor = Replay(delay is None, n, int(alive_s * 1000), [key, "subscriber", "seq", "message", "how"])
    return _run(rows, key, ts, processor, f"{key} {of}, subscriber string, seq long, message string, how string", delay is None)


def joined_views(messages: DataFrame, joins: DataFrame, key: str = "job_id", ts: str = "ts", n: int = REPLAYED, alive_s: int = ALIVE_S) -> DataFrame:
    """(key, subscriber, seq, how): the same rows from a finished log; joins (key, subscriber, ts) count from their first time.

    Each side is joined by key; what a subscriber gets of a busy job is the result itself. History is cut to the last n before that.
    """
    at = lambda: F.unix_millis(F.col(ts).cast("timestamp"))
    first = joins.groupBy(key, "subscriber").agg(F.min(at()).alias("_joined"))
    sent = messages.select(key, "seq", at().alias("_at"))
    live = sent.join(first, key).filter(F.col("_at") > F.col("_joined")).select(key, "subscriber", "seq", F.lit("live").alias("how"))
    back = F.row_number().over(Window.partitionBy(key, "subscriber").orderBy(F.desc("_at"), F.desc("seq")))
    held = sent.join(first, key).filter((F.col("_at") <= F.col("_joined")) & (F.col("_at") > F.col("_joined") - alive_s * 1000))
    old = held.withColumn("_back", back).filter(F.col("_back") <= n).select(key, "subscriber", "seq", F.lit("replay").alias("how"))
    return live.union(old)


def late_rows(rows: DataFrame, ts: str, batch: str, delay_s: int) -> DataFrame:
    """`rows` with `late`: whether a row is older than the watermark that the batches before its own had reached.

    `batch` numbers the arrivals. One row a batch is windowed, whatever the rows.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = rows.groupBy(batch).agg(F.max(at).alias("_max"))
    reached = F.max("_max").over(Window.partitionBy().orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)) - delay_s * 1_000_000
    marks = seen.select(F.col(batch).alias("_batch"), reached.alias("_mark"))
    return rows.join(marks, F.col(batch).eqNullSafe(F.col("_batch")), "left").withColumn("late", F.coalesce(at < F.col("_mark"), F.lit(False))).drop("_batch", "_mark")


def split_late(stream: DataFrame, ts: str, delay_s: int, path: str, checkpoint: str):
    """Start a stream that writes each row once, to `path`/on_time or `path`/late, in a folder a batch; the caller stops it.

    A row is late if it is older than the newest row of all batches before, less `delay_s`. Each batch leaves its
    newest instant and its counts in `path`/batches; a batch that is run again after a failure finds the same ones
    before it and overwrites its own folders, so nothing is told twice.
    """
    spark: SparkSession = stream.sparkSession
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    counted = "newest long, on_time long, late long, batch long"

    def batch(df: DataFrame, number: int) -> None:
        before = marks(spark, path, counted).filter(F.col("batch") < number)
        mark = before.agg(F.max("newest")).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(at < F.lit(mark - delay_s * 1_000_000), F.lit(False))
        df = df.persist()
        try:
            for name, which in (("on_time", ~late), ("late", late)):
                df.filter(which).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            counts = df.agg(F.max(at).alias("newest"), F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"))
            counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def marks(spark: SparkSession, path: str, schema: str = "newest long, on_time long, late long, batch long") -> DataFrame:
    """(newest, on_time, late, batch) of the batches that `split_late` has written; none yet is an empty table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    return spark.read.schema(schema).parquet(f"{path}/batches") if there else spark.createDataFrame([], schema)
