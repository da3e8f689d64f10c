"""Usage and metering as streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chorale.operators.serve import METERED, Meter, replay, request_order
from chorale.operators.usage import usage


def usage_stream(events: DataFrame):
    """Running usage of a stream of events(usage_key, ms, skipped, ts), for the update output mode: counts, sums and maxima merge."""
    return usage(events)


def plays_by_period(events: DataFrame, period: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(usage_key, start, plays, ms) of each period; events later than the watermark are left out."""
    windows = events.withWatermark("ts", late).groupBy("usage_key", F.window("ts", period).alias("w"))
    return windows.agg(F.count("*").alias("plays"), F.sum("ms").alias("ms")).select("usage_key", F.col("w.start").alias("start"), "plays", "ms")


def merged_usage(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Usage rows of a batch added to those held, for foreachBatch."""
    both = state.unionByName(batch)
    return both.groupBy("usage_key").agg(*(F.sum(c).alias(c) for c in ("plays", "total_ms")), F.max("last_played").alias("last_played"), *(F.sum(c).alias(c) for c in ("skips", "skip_ms")))


def usage_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over events(usage_key, ms, skipped, ts): each batch's usage under its id at path.

    A batch that is run again writes over its own rows, and one that folded() has taken in already adds nothing.
    """

    def add(events: DataFrame, batch: int) -> None:
        if batch > _taken_in(events.sparkSession, path):
            usage(events).write.mode("overwrite").parquet(f"{path}/whole=0/batch={batch}")

    return add


def usage_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Usage of all batches at path."""
    held = _batches(spark, path)
    return merged_usage(held, held.limit(0))


def folded(spark: SparkSession, path: str, into: str) -> DataFrame:
    """Writes usage_so_far() at an empty path as one batch, under the greatest id that it holds; a sink may go on there."""
    last = _batches(spark, path, ids=True).agg(F.max("batch")).first()[0]
    usage_so_far(spark, path).write.parquet(f"{into}/whole=1/batch={-1 if last is None else last}")
    return usage_so_far(spark, into)


_USAGE = "usage_key string, plays long, total_ms long, last_played timestamp, skips long, skip_ms long"


def _batches(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    held = spark.read.schema(f"{_USAGE}, whole int, batch long").option("basePath", path).parquet(path)
    return held if ids else held.drop("whole", "batch")


def _taken_in(spark: SparkSession, path: str) -> int:
    """The id up to which batches stand in one whole; -1 if none does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/whole=1")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return max((int(name.removeprefix("batch=")) for name in found if name.startswith("batch=")), default=-1)


_REQUEST = ["ts", "status", "cached", "force", "succeeded"]


class MeterProcessor(StatefulProcessor):
    """A user's counters as state (used, window end and last fresh request), and requests that the watermark hasn't passed.

    A timer at the earliest of those wakes the user when the watermark passes it; all requests up to the watermark are then judged in
    their order, in whatever order and batches they came.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("meter", "used int, reset_at timestamp, last timestamp")
        self.open = handle.getListState("open", "ts timestamp, status string, cached boolean, force boolean, succeeded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            came = [_request(r) for r in zip(*(pdf[c].tolist() for c in _REQUEST), strict=True)]
            self.open.appendList(came)
            first = min([r[0] for r in came] + ([first] if first else []))
        if first:
            self._wake(first)
        yield pd.DataFrame([], columns=["user_id", "ts", "decision", "used"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").to_pydatetime()
        held = [_request(r) for r in self.open.get()]
        due, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        made = []
        if due:
            meter = Meter(*self.state.get()) if self.state.exists() else Meter()
            made = replay(((key[0], *r) for r in sorted(due, key=request_order)), meter)
            self.state.update((meter.used, meter.reset_at or dt.datetime(1970, 1, 1), meter.last))
            self.open.put(later) if later else self.open.clear()
            if later:
                self._wake(min(r[0] for r in later))
        yield pd.DataFrame(made, columns=["user_id", "ts", "decision", "used"])

    def _wake(self, at: dt.datetime) -> None:
        self.handle.registerTimer(-(-(at - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)))

    def close(self) -> None:
        pass


def _request(row: tuple) -> tuple:
    ts, status, *flags = row
    return (pd.Timestamp(ts).to_pydatetime(), None if status is None or status != status else status, *(None if x is None or x != x else bool(x) for x in flags))


def metered_stream(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """metered() over a stream, for the append mode: requests may come in any order within `late` of the latest one.

    A request is judged once the watermark passes it; requests that come later than that are left out. The session's time zone must be UTC.
    """
    return log.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(MeterProcessor(), METERED, "Append", "EventTime")


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
