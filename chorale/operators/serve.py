"""The deterministic parts of a grouping service: prompt rows, index checks, and request metering."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.text import content_key

# Requests in a window, its length, and the least gap between fresh ones.
LIMITS, DAYS, GAP_SECONDS = {"active": 50}, 30, 30
FREE_LIMIT = 3


def prompt_rows(tracks: DataFrame, group: str, order: str) -> DataFrame:
    """(group, i, row JSON) without ids: title, artists, a numeric year, up to 8 genres and 6 tags."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    names = lambda c, n: F.slice(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,count:double>>")), lambda x: x["name"]), 1, n)
    row = F.struct(i.alias("i"), F.col("name").alias("title"), F.array_join("artists", ", ").alias("artists"), F.col("year").try_cast("int").alias("year"), names("genres", 8).alias("genres"), names("tags", 6).alias("tags"))
    return tracks.select(group, i.alias("i"), F.to_json(row).alias("row"))


def playlist_key(tracks: DataFrame, group: str, steer: Column | None = None) -> DataFrame:
    """(group, cache_key) of the set of a playlist's ids; their order doesn't matter, null ids are passed over."""
    return tracks.groupBy(group).agg(F.collect_list("id").alias("ids")).select(group, content_key(F.col("ids"), F.lit("") if steer is None else steer).alias("cache_key"))


def checked_indices(groups: DataFrame, tracks: DataFrame, request: str, least: int = 2) -> DataFrame:
    """(request, group_pos, name, track_ids) of a model's groups(request, group_pos, name, track_indices array<string>).

    An index counts if it is a whole number, in range, of a track with an id, and not used before, in the order
    of groups and places. Groups of fewer than `least` tracks go. tracks(request, idx, id).
    """
    each = groups.select(request, "group_pos", "name", F.posexplode("track_indices").alias("pos", "raw")).where(F.col("raw").rlike("^[0-9]+$"))
    found = each.withColumn("idx", F.col("raw").try_cast("int")).join(tracks.where("id is not null"), [request, "idx"])
    first = found.groupBy(request, "idx").agg(F.min(F.struct("group_pos", "pos", "name", "id")).alias("x")).select(request, "x.*")
    made = first.groupBy(request, "group_pos", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("track_ids"))
    return made.where(F.size("track_ids") >= least)


def resolved(groups: DataFrame, tracks: DataFrame, request: str, least: int = 2) -> DataFrame:
    """Groups(request, group_pos, name, track_ids) with the ids that tracks(request, id) has, in their order."""
    each = groups.select(request, "group_pos", "name", F.posexplode("track_ids").alias("pos", "id")).join(tracks.select(request, "id").distinct(), [request, "id"])
    made = each.groupBy(request, "group_pos", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("track_ids"))
    return made.where(F.size("track_ids") >= least)


def gaps(log: DataFrame, user: str, ts: str, seconds: int = GAP_SECONDS) -> DataFrame:
    """log with wait_ms: what was to wait since the user's last request; 0 at exactly the gap."""
    since = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(Window.partitionBy(user).orderBy(ts)).cast("timestamp"))
    return log.withColumn("wait_ms", F.greatest(F.lit(0), F.coalesce(seconds * 1000 - F.floor(since / 1000), F.lit(0))))


class Meter:
    """One user's counters; requests must come in order."""

    def __init__(self, used: int = 0, reset_at: dt.datetime | None = None, last: dt.datetime | None = None) -> None:
        self.used, self.reset_at, self.last = used, reset_at, last

    def ask(self, now: dt.datetime, status: str | None, cached: bool, force: bool, succeeded: bool) -> tuple[str, int]:
        """(decision, used after it): hits and failures are free; the limit denies, then the gap."""
        if self.reset_at is None or now >= self.reset_at:
            self.used, self.reset_at = 0, now + dt.timedelta(days=DAYS)
        if cached and not force:
            return "cached", self.used
        if self.used >= LIMITS.get(status or "", FREE_LIMIT):
            return "quota", self.used
        if self.last is not None and now < self.last + dt.timedelta(seconds=GAP_SECONDS):
            return "rate", self.used
        if not succeeded:
            return "failed", self.used
        self.used, self.last = self.used + 1, now
        return "fresh", self.used


def request_order(request: tuple) -> tuple:
    """Of requests (ts, status, cached, force, succeeded) of one time: nulls first, then by their columns."""
    return tuple((False,) if x is None else (True, x) for x in request)


METERED = "user_id string, ts timestamp, decision string, used int"


def replay(rows: Iterable[tuple], meter: Meter) -> list[tuple]:
    return [(user, ts, *meter.ask(ts, status, bool(cached), bool(force), bool(ok))) for user, ts, status, cached, force, ok in rows]


def metered(log: DataFrame) -> DataFrame:
    """(user_id, ts, decision, used) of log(user_id, ts, status, cached, force, succeeded), each user's in order of time.

    A user's rows come sorted and in batches: a long log is walked, never held. Requests of one time stand in the order of their other columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, meter = None, Meter()
        for pdf in batches:
            made = []
            for row in zip(*(pdf[c].tolist() for c in columns), strict=True):
                if row[0] != user:
                    user, meter = row[0], Meter()
                made += replay([row], meter)
            yield pd.DataFrame(made, columns=["user_id", "ts", "decision", "used"])

    columns = ["user_id", "ts", "status", "cached", "force", "succeeded"]
    return log.select(*columns).repartition("user_id").sortWithinPartitions(*columns).mapInPandas(run, METERED)
