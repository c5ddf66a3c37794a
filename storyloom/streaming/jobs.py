"""Structured Streaming jobs over files: ingestion, dedupe, order, quota, windows and status."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from storyloom.sources.tables import exists, shared_path

#: The state store that processors with several state variables need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def place(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def drained(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into the files under out and reads these. Its state lies beside them: a later call goes on from it."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(out)


def ran(stream: DataFrame, mode: str = "append") -> DataFrame:
    return drained(stream, place(stream.sparkSession, "stream"), mode)


def source(df: DataFrame, name: str, files_a_batch: int | None = None) -> DataFrame:
    """The rows of a static table as a stream of files."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return followed(df.sparkSession, df.schema, path, files_a_batch)


def followed(spark: SparkSession, schema, path: str, files_a_batch: int | None = None) -> DataFrame:
    """The files under path, and those that come later, as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


class Job:
    """A stateful job over rows that come out of order, of which no row is lost unseen.

    Spark drops rows behind the watermark without a trace. So every batch is first split: rows older than the largest
    time of all batches before it, less `late`, go to the table of late rows, the others to that of punctual rows, which
    the stateful query follows with the same delay. A tick runs both over what has come; as the second sees whole batches of the
    first in their order, its watermark is never ahead of the split, and it drops nothing. State is carried from tick
    to tick, and over restarts, by the checkpoints under `out`. A batch that runs again writes the same rows again.
    """

    def __init__(self, spark: SparkSession, out: str, ts: str, late: str, query):
        """query: from a stream of punctual rows to the stream of results; late: a span as Spark writes it, such as '2 hours'."""
        self.spark, self.out, self.ts, self.late, self.query = spark, out, ts, late, query

    def _split(self, df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            horizon = self._horizons().where(F.col("batch") < number).agg(F.max("until")).first()[0]
            old = F.lit(False) if horizon is None else F.coalesce(F.col(self.ts) < F.lit(horizon) - F.expr(f"INTERVAL {self.late}"), F.lit(False))
            df.where(~old).write.mode("overwrite").parquet(f"{self.out}/punctual/batch={number}")
            df.where(old).write.mode("overwrite").parquet(f"{self.out}/late/batch={number}")
            df.agg(F.max(self.ts).alias("until")).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/horizon/batch={number}")
        finally:
            df.unpersist()

    def _horizons(self) -> DataFrame:
        return self._read("horizon", "until timestamp, batch int")

    def _read(self, name: str, schema) -> DataFrame:
        if not exists(self.spark, f"{self.out}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.out}/{name}")

    def tick(self, rows: DataFrame) -> DataFrame:
        """Takes all that has come to rows, a stream, since the last tick, and returns the results so far."""
        q = rows.writeStream.foreachBatch(self._split).option("checkpointLocation", f"{self.out}/split-state").trigger(availableNow=True).start()
        q.awaitTermination()
        self.schema = rows.schema
        return drained(self.query(followed(self.spark, rows.schema, f"{self.out}/punctual")), f"{self.out}/results")

    def late_rows(self) -> DataFrame:
        """The rows that came too late, as they came, with the number of their batch in a column of that name, which rows must not have."""
        return self._read("late", T.StructType([*self.schema.fields, T.StructField("batch", T.IntegerType())]))


def in_order(df: DataFrame, ts: str, name: str, files: int, overlap: str) -> str:
    """A folder of files as rows of an event log arrive: file by file in time, each with stragglers of up to `overlap` from the one before."""
    path = place(df.sparkSession, name)
    span = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    if span.a is None:
        df.coalesce(1).write.parquet(f"{path}/file=0")
        return path
    step = (span.b - span.a) / files
    delay = F.expr(f"INTERVAL {overlap}") * (F.pmod(F.xxhash64(*df.columns), F.lit(1000)) / 1000)
    arrival = F.col(ts) + delay
    for i in range(files):
        lo, hi = F.lit(span.a + step * i), F.lit(span.a + step * (i + 1))
        some = (arrival < hi if i + 1 < files else F.lit(True)) & (arrival >= lo if i else F.lit(True))
        df.where(some).coalesce(1).write.parquet(f"{path}/file={i}")
    return path


def ingested(df: DataFrame, number: int, out: str, key: list[str]) -> None:
    """Batch `number` of an ingestion: chapters that an earlier batch has are left out. A batch that runs again writes the same rows again."""
    spark, new = df.sparkSession, df.dropDuplicates(key)
    if number:
        done = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch int").parquet(out)
        new = new.join(done.where(F.col("batch") < number).select(*key), key, "left_anti")
    new.write.mode("overwrite").parquet(f"{out}/batch={number}")


def ingest(chapters: DataFrame, key: list[str]) -> DataFrame:
    """Bundles of files, each chapter once: the rows of a batch are the marks of its chapters."""
    spark, out = chapters.sparkSession, place(chapters.sparkSession, "ingest")
    chapters.sparkSession.createDataFrame([], chapters.schema).write.parquet(f"{out}/batch=-1")  # so that the table has files from the start
    q = chapters.writeStream.foreachBatch(lambda df, number: ingested(df, number, out, key)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(chapters.schema).parquet(f"{out}/batch=*")


def dedupe(events: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Each key once within a span of event time; its state leaves when the watermark has passed the span."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, ts: str, late: str, window, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by a window of event time, tumbling, sliding or of a session; rows later than `late` are dropped, open windows not shown."""
    return events.withWatermark(ts, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


class Continuity(StatefulProcessor):
    """Chapters of a tenant in order: the next one after the last done, else an error that the rest of the batch follows."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows, timer_values):
        last, broken = self.last.get()[0] if self.last.exists() else -1, False
        turns = sorted(n for pdf in rows for n in pdf["turn"].tolist())  # the rows of one key may come in several frames
        admitted = []
        for n in turns:
            broken = broken or n != last + 1
            last = last if broken else n
            admitted.append(not broken)
        self.last.update((last,))
        yield pd.DataFrame({"conv_id": [key[0]] * len(turns), "turn": turns, "admitted": admitted})

    def close(self) -> None:
        pass


class Quota(StatefulProcessor):
    """What is left of a model's quota: an observation sets it and says when it will be full again, spending lowers it, never below 0.

    Rows: at and reset in milliseconds, event_id, observed, tokens. Calls count in the order of (at, event_id), in
    whatever batch they come: those that the watermark has not passed wait in the state, as earlier ones may still
    come, packed by the SPAN of time that they fall into. One span at a time is read, and of a batch BUFFER calls, so memory
    follows neither the batch nor the delay. Each batch of a model gives what is left after all its calls so far, and how many these are; a later batch's row has a
    higher number. A call after the reset finds the full quota; for a model without calls a timer restores it when the
    watermark passes the reset.
    """

    FULL, SPAN, BUFFER = 1000, 3600_000, 1 << 17
    CALL = np.dtype([("at", "<i8"), ("event_id", "<i8"), ("observed", "?"), ("tokens", "<i8"), ("reset", "<i8")])

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("quota", "left long, reset long, at long, n long")
        self.waiting = handle.getMapState("waiting", "span long", "calls binary")

    def _wait(self, calls: np.ndarray) -> None:
        """Adds calls to those that wait in their spans."""
        span = calls["at"] // self.SPAN
        order = np.argsort(span, kind="stable")
        names, start = np.unique(span[order], return_index=True)
        for name, own in zip(names.tolist(), np.split(calls[order], start[1:]), strict=True):
            before = self.waiting.getValue((name,))[0] if self.waiting.containsKey((name,)) else b""
            self.waiting.updateValue((name,), (bytes(before) + own.tobytes(),))

    def _stepped(self, state: tuple, calls) -> tuple:
        left, reset, last, n = state
        for at, _, observed, tokens, wait in calls:
            if reset and at >= reset:
                left, reset = self.FULL, 0
            left, reset = (tokens, at + wait) if observed else (max(0, left - tokens), reset)
            last, n = at, n + 1
        return left, reset, last, n

    def _state(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (self.FULL, 0, 0, 0)

    def _spans(self):
        """The calls that wait, span by span, each in order, with the span's name."""
        for name in sorted(k[0] for k in self.waiting.keys()):
            yield name, np.sort(np.frombuffer(bytes(self.waiting.getValue((name,))[0]), self.CALL), order=["at", "event_id", "observed", "tokens", "reset"])

    def _settle(self, passed: int) -> tuple:
        """The state after the calls that the watermark has passed; these wait no longer."""
        settled = self._state()
        for name, calls in self._spans():
            if name * self.SPAN >= passed:
                break
            settled = self._stepped(settled, calls[calls["at"] < passed].tolist())
            rest = calls[calls["at"] >= passed]
            if len(rest):
                self.waiting.updateValue((name,), (rest.tobytes(),))
            else:
                self.waiting.removeKey((name,))
        self.state.update(settled)
        return settled

    def _after_all(self, state: tuple) -> tuple:
        """The state after those that wait, too."""
        for _, calls in self._spans():
            state = self._stepped(state, calls.tolist())
        return state

    def _row(self, key, state: tuple, restored: bool) -> pd.DataFrame:
        left, reset, at, n = state
        if reset:
            self.handle.registerTimer(reset)
        return pd.DataFrame({"model": [key[0]], "at": [at], "n": [n], "restored": [restored], "left_over": [left]})

    def handleInputRows(self, key, rows, timer_values):
        held: list[np.ndarray] = []
        for pdf in rows:
            pdf = pdf[pdf["at"].notna()]  # a call without a time is neither before nor after any other
            calls = np.empty(len(pdf), self.CALL)
            for c in self.CALL.names:
                calls[c] = pdf[c].fillna(0).to_numpy()
            held.append(calls)
            if sum(map(len, held)) >= self.BUFFER:
                self._wait(np.concatenate(held))
                held = []
        if held:
            self._wait(np.concatenate(held))
        yield self._row(key, self._after_all(self._settle(timer_values.getCurrentWatermarkInMs())), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # Spark passes these by name
        left, reset, at, n = self._settle(timerValues.getCurrentWatermarkInMs())
        if reset and reset == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((self.FULL, 0, at, n))
            yield self._row(key, self._after_all((self.FULL, 0, at, n)), True)

    def close(self) -> None:
        pass


def stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "none") -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)
