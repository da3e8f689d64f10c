"""Raw exports and playlists to the canonical record, and catalogue projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions import text as t
from chorale.functions.names import ITEM, first_wins, from_structs
from chorale.session import stored


def field(df: DataFrame, *paths: str) -> Column:
    """The first of the columns or struct fields that the table has and whose text isn't blank."""
    have = [F.col(p) for p in paths if _has(df, p)]
    return F.coalesce(*(t.nonblank(c) for c in have)) if have else F.lit(None).cast("string")


def _has(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for name in path.split("."):
        if not hasattr(kind, "fieldNames") or name not in kind.fieldNames():
            return False
        kind = kind[name].dataType
    return True


def artists(df: DataFrame) -> Column:
    """The artists column (texts, or structs with a name), else the artist or artistName text."""
    one = field(df, "artist", "artistName")
    alone = F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    if not _has(df, "artists"):
        return alone
    kind = dict(df.dtypes)["artists"]
    many = F.col("artists") if kind == "array<string>" else F.array("artists") if kind == "string" else F.transform("artists", lambda a: a["name"])
    many = t.cleaned(many)
    return F.when(F.size(many) > 0, many).otherwise(alone)


# Where a year may stand, in this order.
YEAR_FIELDS = ("year", "release_year", "releaseYear", "album.release_date", "album.releaseDate", "release_date", "releaseDate")


def year(df: DataFrame) -> Column:
    found = [t.year(F.col(p)) for p in YEAR_FIELDS if _has(df, p)]
    return F.coalesce(*found, F.lit(None).cast("int"))


def items(df: DataFrame, *paths: str) -> Column:
    found = [F.nullif(from_structs(F.col(p)), F.array().cast(ITEM)) for p in paths if _has(df, p)]
    return F.coalesce(*found, F.array().cast(ITEM))


def canonical(tracks: DataFrame, dataset: str, version: str = "v1", now: Column | None = None, playlist: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of raw tracks; rejects have no title or no artists, and say which."""
    mbid = field(tracks, "brainz.musicbrainz_recording_id", "brainz.recordingId", "brainz.mbid", "musicbrainz_recording_id")
    source_id, code, title = field(tracks, "id", "spotify_id"), t.isrc(field(tracks, "isrc", "external_ids.isrc")), field(tracks, "title", "name")
    who = artists(tracks)
    key = t.playlist_track_id(code, source_id, title, who) if playlist else t.track_id(code, mbid, source_id, title, who)
    made = tracks.select(
        F.lit(1).alias("schema_version"), key.alias("track_id"), title.alias("title"), who.alias("artists"), field(tracks, "album.name", "albumName", *(["album"] if dict(tracks.dtypes).get("album") == "string" else [])).alias("album"),
        year(tracks).alias("year"), t.lenient_int(field(tracks, "duration_ms", "durationMs")).alias("duration_ms"),
        F.struct(source_id.alias("spotify_id"), field(tracks, "uri", "spotify_uri").alias("spotify_uri"), code.alias("isrc"), mbid.alias("musicbrainz_recording_id")).alias("ids"),
        F.struct(items(tracks, "brainz.tags", "tags").alias("tags"), items(tracks, "brainz.genres", "genres").alias("genres"), field(tracks, "brainz.acousticHighLevel", "brainz.acoustic_high_level").alias("acoustic_high_level"), field(tracks, "brainz.acousticLowLevel", "brainz.acoustic_low_level").alias("acoustic_low_level")).alias("brainz"),
        first_wins(items(tracks, "spotifyArtistGenres", "spotify_artist_genres")).alias("spotify_artist_genres"),
        F.struct(t.lenient_double(field(tracks, "popularity")).alias("spotify_popularity"), field(tracks, "spotifyUrl", "external_urls.spotify").alias("spotify_url"), field(tracks, "previewUrl", "preview_url").alias("preview_url"), field(tracks, "imageUrl", "image_url").alias("image_url")).alias("runtime_metadata"),
        F.struct(F.lit(None).cast("string").alias("model_name"), F.lit(None).cast("array<double>").alias("vector")).alias("audio_embeddings"),
        F.struct(F.lit(dataset).alias("dataset_name"), F.lit(version).alias("dataset_version"), (F.array("source_file") if "source_file" in tracks.columns else F.array().cast("array<string>")).alias("source_files"), (t.utc_second() if now is None else now).alias("ingested_at_utc")).alias("source"),
        F.struct(t.token(title).alias("normalized_title"), t.artists_key(who).alias("normalized_artists_key")).alias("aliases"),
    )
    missing = F.array_compact(F.array(F.when(F.col("title").isNull(), "missing title"), F.when(F.size("artists") == 0, "missing artists")))
    made = made.withColumn("reasons", missing)
    return made.where(F.size("reasons") == 0).drop("reasons"), made.where(F.size("reasons") > 0)


def looks_normalized(df: DataFrame) -> bool:
    """Whether rows are canonical records already: their four parts are structs."""
    kinds = dict(df.dtypes)
    return all(kinds.get(c, "").startswith("struct<") for c in ("ids", "brainz", "runtime_metadata", "source"))


def playlist_records(rows: DataFrame, dataset: str, version: str = "v1", now: Column | None = None) -> DataFrame:
    """Canonical records of a playlist's rows: normalised ones pass, with the source's blanks filled in; of the others those without a title or artists go."""
    if not looks_normalized(rows):
        return canonical(rows, dataset, version, now, playlist=True)[0]
    blanks = {"dataset_name": F.lit(dataset), "dataset_version": F.lit(version), "source_files": F.array().cast("array<string>"), "ingested_at_utc": t.utc_second() if now is None else now}
    have = rows.schema["source"].dataType.fieldNames()
    source = F.struct(*((F.coalesce(F.col(f"source.{c}"), v) if c in have else v).alias(c) for c, v in blanks.items()))
    return rows.withColumn("source", source)


def enrichment_payload() -> Column:
    """What a lookup holds of a canonical record: its own fields, ids, what enriches it, and where it is from; lists are never null."""
    some = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c.rsplit(".", 1)[-1])
    part = lambda parent, *names: F.struct(*(F.col(f"{parent}.{n}").alias(n) for n in names)).alias(parent)
    return F.struct(
        "track_id", "title", some("artists", "array<string>"), "album", "year", "duration_ms", part("ids", "spotify_id", "spotify_uri", "isrc", "musicbrainz_recording_id"),
        F.struct(some("brainz.tags", ITEM), some("brainz.genres", ITEM), F.col("brainz.acoustic_high_level").alias("acoustic_high_level"), F.col("brainz.acoustic_low_level").alias("acoustic_low_level")).alias("brainz"),
        part("runtime_metadata", "spotify_popularity", "spotify_url", "preview_url", "image_url"), part("aliases", "normalized_title", "normalized_artists_key"),
        F.struct(F.col("source.dataset_name").alias("dataset_name"), some("source.source_files", "array<string>")).alias("source"),
    )


def ordinal(df: DataFrame, *order: str) -> DataFrame:
    """df and row_index from 0 in the given order, gapless: rows are dealt to ranges of the first column, numbered there, and moved by the counts of the ranges before."""
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "ordinal")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("row_index", (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")


def record_key(prefix: str = "") -> Column:
    """Canonical key of a record."""
    c = lambda n: F.col(prefix + n)
    title, who = t.nonblank(c("aliases.normalized_title")), t.nonblank(c("aliases.normalized_artists_key"))
    return t.canonical_key(c("ids.isrc"), c("ids.musicbrainz_recording_id"), c("ids.spotify_id"), F.concat(title, F.lit("::"), who), c("track_id"))


def flat_items(playlist: DataFrame) -> DataFrame:
    """Catalogue playlist items as tracks; items without a track or an id go, a relinked track has its first id."""
    k = F.col("track")
    return playlist.where(k["id"].isNotNull()).select(
        F.coalesce(k["linked_from"]["id"], k["id"]).alias("id"), k["name"].alias("name"), F.transform(k["artists"], lambda a: a["name"]).alias("artists"),
        k["album"]["name"].alias("album"), t.year(k["album"]["release_date"]).alias("year"), F.get(k["album"]["images"], F.lit(0))["url"].alias("image_url"),
        k["external_ids"]["isrc"].alias("isrc"), k["duration_ms"].alias("duration_ms"), k["popularity"].alias("popularity"), k["preview_url"].alias("preview_url"),
    )


def listing(playlists: DataFrame) -> DataFrame:
    return playlists.select("id", "name", F.coalesce("tracks.total", F.lit(0)).alias("tracks_total"))


def write_batches(ids: DataFrame, order: str, group: str = "playlist_id", size: int = 100) -> DataFrame:
    """(group, batch, uris): ids as track URIs in runs of so many, in order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    rows = ids.select(group, F.floor(n / size).alias("batch"), F.struct(n.alias("n"), F.concat(F.lit("spotify:track:"), "id").alias("uri")).alias("x"))
    return rows.groupBy(group, "batch").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["uri"]).alias("uris"))
