"""Listening history to usage per track, playlist buckets and playlist health."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.text import half_up


@dataclass(frozen=True)
class Thresholds:
    barely_plays: int = 3
    barely_minutes: float = 3
    tourist_plays: int = 2
    tourist_minutes: float = 2
    core_plays: int = 25
    core_minutes: float = 30


#: Presets and the least sizes of buckets (fixed values).
PRESETS = {"balanced": Thresholds(), "aggressive": Thresholds(5, 5, 4, 5, 40, 45), "gentle": Thresholds(2, 2, 1, 1, 20, 20)}
LEAST = {"barely": 5, "old_favourite": 5, "skipped": 3, "core": 5, "tourist": 5}


# Names of the buckets' suggestions, their labels, descriptions and rules.
SUGGESTIONS = {
    "barely": ("usage-barely-played", "Barely played tracks", "Songs from this playlist that you’ve almost never listened to in your Spotify history.", "plays ≤ {t.barely_plays} or total listening time ≤ {t.barely_minutes} minutes (from uploaded history)"),
    "old_favourite": ("usage-long-ago", "Old favorites (not played recently)", "Tracks you used to listen to a lot but haven’t played in over 6 months.", "plays ≥ 5 and lastPlayed > 6 months ago (from uploaded history)"),
    "skipped": ("usage-frequently-skipped", "Frequently skipped tracks", "Songs in this playlist that you skip a lot in your Spotify history.", "skips ≥ 2 and skip rate ≥ 50% of plays (from uploaded history)"),
    "core": ("usage-core-favorites", "Core favorites", "The tracks you really live in – high plays and lots of listening time.", "plays ≥ {t.core_plays} and total listening ≥ {t.core_minutes} minutes (from uploaded history)"),
    "tourist": ("usage-tourists", "Tourists / padding", "Tracks that rarely get listened to – good candidates for cleanup or a backup playlist.", "plays ≤ {t.tourist_plays} and total listening ≤ {t.tourist_minutes} minutes (from uploaded history)"),
}


def name_key(artist: Column, title: Column) -> Column:
    a, t = F.lower(F.trim(artist)), F.lower(F.trim(title))
    return F.when((a != "") & (t != ""), F.concat(F.lit("name::"), a, F.lit("::"), t))


def events(history: DataFrame) -> DataFrame:
    """(usage_key, ms, skipped, ts) of raw history rows in any vendor's names; rows without a key go."""
    have = set(history.columns)
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    uri = first("spotify_track_uri", "trackUri", "uri")
    by_name = name_key(F.coalesce(first("artistName", "master_metadata_album_artist_name"), F.lit("")), F.coalesce(first("trackName", "master_metadata_track_name"), F.lit("")))
    ms = F.coalesce(first("msPlayed", "ms_played", "ms_played_in_interval").try_cast("bigint"), F.lit(0))
    skipped = F.coalesce(F.col("skipped"), F.lit(False)) if "skipped" in have else F.lit(False)
    key = F.when(uri.startswith("spotify:track:"), F.split_part(uri, F.lit(":"), F.lit(3))).otherwise(by_name)
    return history.select(key.alias("usage_key"), ms.alias("ms"), skipped.alias("skipped"), F.try_to_timestamp(first("endTime", "timestamp", "ts")).alias("ts")).where("usage_key is not null")


def usage(events: DataFrame) -> DataFrame:
    """(usage_key, plays, total_ms, last_played, skips, skip_ms); skipped plays are plays, times that don't parse are passed over."""
    return events.groupBy("usage_key").agg(
        F.count("*").alias("plays"), F.sum("ms").alias("total_ms"), F.max("ts").alias("last_played"), F.count_if("skipped").alias("skips"),
        F.coalesce(F.sum(F.when(F.col("skipped"), F.col("ms"))), F.lit(0)).alias("skip_ms"),
    )


def with_usage(tracks: DataFrame, used: DataFrame) -> DataFrame:
    """tracks(id, name, artists) with `usage`, a struct: that of the id, else of the first artist and the title; null if unseen."""
    row = F.struct("plays", "total_ms", "last_played", "skips", "skip_ms")
    by_id = used.select(F.col("usage_key").alias("__id"), row.alias("__by_id"))
    by_name = used.select(F.col("usage_key").alias("__name"), row.alias("__by_name"))
    keyed = tracks.withColumn("__key", name_key(F.coalesce(F.get("artists", F.lit(0)), F.lit("")), F.coalesce("name", F.lit(""))))
    joined = keyed.join(by_id, F.col("id") == F.col("__id"), "left").join(by_name, F.col("__key") == F.col("__name"), "left")
    return joined.select(*(tracks[c] for c in tracks.columns), F.coalesce("__by_id", "__by_name").alias("usage"))


def flags(now: Column, t: Thresholds, u: str = "usage") -> dict[str, Column]:
    """What puts a track into each bucket; an unseen track is barely played and a tourist."""
    plays, skips, minutes, last = (F.col(f"{u}.plays"), F.col(f"{u}.skips"), F.col(f"{u}.total_ms") / 60000, F.col(f"{u}.last_played"))
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 86_400_000_000
    unseen, no = F.col(u).isNull(), F.lit(False)
    return {
        "barely": unseen | (plays <= t.barely_plays) | (minutes <= t.barely_minutes),
        "old_favourite": F.coalesce((plays >= 5) & (days > 180), no),
        "skipped": F.coalesce((plays >= 3) & (skips >= 2) & (skips / plays >= 0.5), no),
        "core": F.coalesce((plays >= t.core_plays) & (minutes >= t.core_minutes), no),
        "tourist": unseen | ((plays <= t.tourist_plays) & (minutes <= t.tourist_minutes)),
    }


def buckets(tracks: DataFrame, now: Column, thresholds: Thresholds | str = "balanced", playlist: str = "playlist_id") -> DataFrame:
    """(playlist, bucket, track id) of tracks with usage; buckets below their least size are left out."""
    t = PRESETS[thresholds] if isinstance(thresholds, str) else Thresholds(*astuple(thresholds))
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags(now, t).items())))
    rows = tracks.select(playlist, "id", F.explode(named).alias("bucket"))
    least = F.create_map(*(F.lit(x) for pair in LEAST.items() for x in pair))
    sizes = rows.groupBy(playlist, "bucket").agg(F.count("*").alias("size")).where(F.col("size") >= F.element_at(least, F.col("bucket")))
    return rows.join(sizes, [playlist, "bucket"]).select(playlist, "bucket", "id", "size")


def suggestions(tracks: DataFrame, now: Column, thresholds: Thresholds | str = "balanced", playlist: str = "playlist_id") -> DataFrame:
    """(playlist, id, label, description, rule, size, tracks): a row for each bucket of a playlist that is large enough, with its tracks' ids."""
    t = PRESETS[thresholds] if isinstance(thresholds, str) else Thresholds(*astuple(thresholds))
    told = F.create_map(*(x for name, (key, label, text, rule) in SUGGESTIONS.items() for x in (F.lit(name), F.struct(F.lit(key).alias("id"), F.lit(label).alias("label"), F.lit(text).alias("description"), F.lit(rule.format(t=t)).alias("rule")))))
    made = buckets(tracks, now, t, playlist).groupBy(playlist, "bucket").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("id")).alias("tracks"))
    return made.withColumn("x", F.element_at(told, F.col("bucket"))).select(playlist, "x.id", "x.label", "x.description", "x.rule", "size", "tracks")


def health(tracks: DataFrame, now: Column, playlist: str = "playlist_id") -> DataFrame:
    """(playlist, never_played_pct, skipped_pct, median_plays, days_since_played) of tracks with usage."""
    plays = F.coalesce("usage.plays", F.lit(0))
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("usage.last_played").cast("timestamp"))) / 86_400_000_000
    f = flags(now, PRESETS["balanced"])
    return tracks.groupBy(playlist).agg(
        half_up(100 * F.count_if(plays == 0) / F.count("*")).alias("never_played_pct"), half_up(100 * F.count_if(f["skipped"]) / F.count("*")).alias("skipped_pct"),
        F.percentile(plays, F.lit(0.5)).alias("median_plays"), F.avg(F.when(days >= 0, days)).alias("days_since_played"),
    )


def undismissed(groups: DataFrame, dismissed: DataFrame, key: str = "group_id") -> DataFrame:
    return groups.join(dismissed.select(key), key, "left_anti")


def selected(members: DataFrame, selections: DataFrame, group: str = "bucket") -> DataFrame:
    """Members(group, id) that are selected(group, id); a group without a selection keeps all."""
    some = selections.select(group).distinct().withColumn("__some", F.lit(True))
    chosen = selections.select(group, "id").distinct().withColumn("__chosen", F.lit(True))
    joined = members.join(some, group, "left").join(chosen, [group, "id"], "left")
    return joined.where("__some is null or __chosen").select(*members.columns)
