"""Validation, inspection and coverage of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.text import band, percent

# Genres that a corpus should cover, and how many records of each.
REFERENCE_GENRES = {
    "pop": 200, "rock": 200, "indie": 150, "alternative rock": 100, "hip hop": 200, "rap": 200, "r&b": 100, "soul": 80,
    "electronic": 100, "house": 80, "techno": 50, "trance": 30, "edm": 50, "drum and bass": 30, "dubstep": 30, "idm": 30,
    "jazz": 100, "classical": 80, "country": 100, "metal": 80, "folk": 50, "blues": 50, "reggae": 30, "punk": 50,
    "k-pop": 50, "j-pop": 30, "latin": 80, "reggaeton": 50, "afrobeat": 30, "afrobeats": 30, "salsa": 30, "bossa nova": 20,
    "bollywood": 20, "indian": 30, "arabic": 20, "shoegaze": 30, "emo": 30, "grunge": 30, "post punk": 30, "synth pop": 50,
    "psychedelic rock": 50, "neo soul": 30, "ambient": 30, "lo-fi": 50, "chillwave": 30, "vaporwave": 20, "trap": 80, "drill": 30,
    "boom bap": 30, "conscious hip hop": 30, "bedroom pop": 50, "dream pop": 50, "indie pop": 80, "art pop": 30, "hyperpop": 20,
    "dance pop": 50,
}


def messages(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def song_rules() -> tuple[dict[str, Column], dict[str, Column]]:
    """(errors, warnings) of canonical records."""
    negative = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<struct<name:string,count:double>>")), lambda x: x["count"] < 0)
    nameless = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<struct<name:string,count:double>>")), lambda x: blank(x["name"]))
    errors = {
        "schema_version must be 1": F.col("schema_version").isNull() | (F.col("schema_version") != 1),
        "track_id must be a non-empty string": blank(F.col("track_id")),
        "title must be a non-empty string": blank(F.col("title")),
        "artists must be a non-empty list": F.col("artists").isNull() | (F.size("artists") < 1),
        "artists must be non-empty strings": F.exists(F.coalesce("artists", F.array().cast("array<string>")), blank),
        "year must lie from 1800 to 3000": ~F.col("year").between(1800, 3000),
        "duration_ms must not be negative": F.col("duration_ms") < 0,
        "brainz.tags needs names": nameless("brainz.tags"),
        "brainz.genres needs names": nameless("brainz.genres"),
        "source.dataset_name must be a non-empty string": blank(F.col("source.dataset_name")),
    }
    ids = [F.col(f"ids.{n}") for n in ("spotify_id", "isrc", "musicbrainz_recording_id")]
    warnings = {
        "record has no ids": blank(ids[0]) & blank(ids[1]) & blank(ids[2]),
        "brainz.tags has negative counts": negative("brainz.tags"),
        "brainz.genres has negative counts": negative("brainz.genres"),
    }
    return errors, warnings


def validated(df: DataFrame, errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    return df.withColumns({"errors": messages(errors), "warnings": messages(warnings)})


def extra_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a schema doesn't allow."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def validation_report(df: DataFrame) -> DataFrame:
    e, w = F.size("errors"), F.size("warnings")
    return df.agg(F.count("*").alias("records"), F.count_if(e == 0).alias("valid"), F.count_if((e > 0) | (w > 0)).alias("with_issues"), F.sum(e).alias("errors"), F.sum(w).alias("warnings"))


def issues(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first n validated records that have errors or warnings."""
    return df.where((F.size("errors") > 0) | (F.size("warnings") > 0)).orderBy(order).select(order, "track_id", "title", "errors", "warnings").limit(n)


def quality_counts(songs: DataFrame) -> DataFrame:
    """One row of counters over canonical records; an empty list, a blank id and an empty payload count as missing."""
    some = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    told = lambda c: F.count_if(~blank(F.col(c)) & ~F.coalesce(F.col(c), F.lit("")).isin("{}", "null"))
    return songs.agg(
        F.count("*").alias("records"), told("ids.isrc").alias("with_isrc"), told("ids.musicbrainz_recording_id").alias("with_mbid"), some("brainz.tags").alias("with_tags"), some("brainz.genres").alias("with_genres"),
        told("brainz.acoustic_high_level").alias("with_acoustic_high_level"), told("brainz.acoustic_low_level").alias("with_acoustic_low_level"), some("audio_embeddings.vector").alias("with_audio_embedding"),
    )


def build_stats(raw: DataFrame, written: DataFrame) -> DataFrame:
    """One row on a corpus build: files and tracks read (raw has source_file), records written, duplicates, what written records lack and have, distinct tags and genres."""
    seen = raw.agg(F.count_distinct("source_file").alias("files_seen"), F.count("*").alias("raw_tracks_seen"))
    counts = quality_counts(written)
    names = lambda c: written.select(F.explode(c).alias("x")).agg(F.count_distinct("x.name").alias("n"))
    row = seen.join(F.broadcast(counts)).join(F.broadcast(names("brainz.tags").withColumnRenamed("n", "unique_tags"))).join(F.broadcast(names("brainz.genres").withColumnRenamed("n", "unique_genres")))  # one row each
    return row.select(
        "files_seen", "raw_tracks_seen", F.col("records").alias("records_written"), (F.col("raw_tracks_seen") - F.col("records")).alias("duplicates_skipped"), (F.col("records") - F.col("with_isrc")).alias("missing_isrc"),
        (F.col("records") - F.col("with_mbid")).alias("missing_mbid"), "with_tags", "with_genres", "with_acoustic_high_level", "with_acoustic_low_level", "unique_tags", "unique_genres",
    )


def coverage(df: DataFrame, present: dict[str, Column], key: Column, year: Column) -> DataFrame:
    """One row: records, distinct keys, duplicates, first and last year, count and percent of each predicate."""
    n = F.count("*")
    totals = [n.alias("records"), F.count_distinct(key).alias("distinct_keys"), (n - F.count_distinct(key)).alias("duplicates"), F.min(year).alias("first_year"), F.max(year).alias("last_year")]
    return df.agg(*totals, *(F.count_if(c).alias(f"with_{k}") for k, c in present.items()), *(percent(F.count_if(c), n).alias(f"pct_{k}") for k, c in present.items()))


def term_totals(exploded: DataFrame, term: str, weight: Column | None = None) -> DataFrame:
    return exploded.groupBy(term).agg(F.count("*").alias("n"), F.sum(F.lit(1.0) if weight is None else weight).alias("total"))


def most_common(totals: DataFrame, term: str, by: str, n: int) -> DataFrame:
    """Top n; ties by term."""
    return totals.orderBy(F.desc(by), term).limit(n)


def band_histogram(counts: DataFrame, count: str = "n") -> DataFrame:
    return counts.groupBy(band(F.col(count)).alias("band")).agg(F.count("*").alias("terms"))


def gaps(counts: DataFrame, targets: DataFrame, term: str, have: str = "n", target: str = "target") -> DataFrame:
    """(term, target, have, short_by) of the terms below their target."""
    had = F.coalesce(F.col(have), F.lit(0))
    joined = targets.join(counts, term, "left").select(term, target, had.alias("have"), (F.col(target) - had).alias("short_by"))
    return joined.where("short_by > 0")


def distinct_terms(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(F.concat(*columns))).alias("term")).distinct()
