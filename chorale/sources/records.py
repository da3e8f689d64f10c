"""Reading and writing: record files, raw exports, playlists, history, reports, caches and relational tables."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.operators.features import checked_components

ITEM = "ARRAY<STRUCT<name: STRING, count: DOUBLE>>"
#: The canonical record.
SONG = f"""schema_version INT, track_id STRING, title STRING, artists ARRAY<STRING>, album STRING, year INT, duration_ms BIGINT,
    ids STRUCT<spotify_id: STRING, spotify_uri: STRING, isrc: STRING, musicbrainz_recording_id: STRING>,
    brainz STRUCT<tags: {ITEM}, genres: {ITEM}, acoustic_high_level: STRING, acoustic_low_level: STRING>,
    spotify_artist_genres {ITEM},
    runtime_metadata STRUCT<spotify_popularity: DOUBLE, spotify_url: STRING, preview_url: STRING, image_url: STRING>,
    audio_embeddings STRUCT<model_name: STRING, vector: ARRAY<DOUBLE>>,
    source STRUCT<dataset_name: STRING, dataset_version: STRING, source_files: ARRAY<STRING>, ingested_at_utc: STRING>,
    aliases STRUCT<normalized_title: STRING, normalized_artists_key: STRING>"""


def records(spark: SparkSession, paths: str | list[str], schema: str = SONG, strict: bool = True, multiline: bool = False, glob: str = "*.json*") -> DataFrame:
    """Record files: a line or (multiline) an array of objects each; files, folders and globs, each file read once however it is named.

    Strict reading fails on a bad row; otherwise such rows come with their text in `_corrupt_record`.
    """
    if not strict:
        schema = f"{schema}, _corrupt_record STRING"
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return spark.read.schema(schema).option("mode", mode).option("multiLine", multiline).option("pathGlobFilter", glob).json(resolved(spark, paths, glob) or paths)


def resolved(spark: SparkSession, paths: str | list[str], glob: str = "*.json*") -> list[str]:
    """The files behind paths, folders and globs, each once, in order of their names; links on this machine count as what they point to."""
    named = spark.read.option("pathGlobFilter", glob).format("binaryFile").load(paths).inputFiles()
    parts = [(urlsplit(f), unquote(urlsplit(f).path)) for f in named]
    real = {f"file:{os.path.realpath(path)}" if at.scheme in ("", "file") else f"{at.scheme}://{at.netloc}{path}" for at, path in parts}
    return sorted(real)


def manifest(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """(name, size, sha256) of the files behind paths, for artifacts: a file is hashed whole, in the task that reads it."""
    files = spark.read.option("pathGlobFilter", glob).format("binaryFile").load(paths)
    return files.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def checked(df: DataFrame) -> DataFrame:
    """Records as they are; an error if the files hold none."""
    if df.limit(1).count() == 0:
        raise ValueError("no records in the given files")
    return df


def exports(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Raw exports, a JSON list of tracks a file; a file that holds anything else is an error."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), (~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))).alias("bad"))
    bad = [r["file"] for r in whole.where("bad").limit(5).collect()]
    if bad:
        raise ValueError(f"not a JSON list of tracks: {', '.join(bad)}")
    return with_file(records(spark, paths, schema, multiline=True))


def with_file(df: DataFrame) -> DataFrame:
    """Adds source_file, the name of the file that a row was read from."""
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def playlist_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, item VARIANT) of payloads that are a list, or an object with the list in tracks or items; items that aren't objects go."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    listed = whole.select("file", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.coalesce(F.try_variant_get("v", "$.tracks", "variant"), F.try_variant_get("v", "$.items", "variant"))).alias("v"))
    each = spark.sql("SELECT file, t.pos AS pos, t.value AS item FROM {listed}, LATERAL variant_explode(v) AS t", listed=listed)
    return each.where(F.schema_of_variant("item").startswith("OBJECT"))


def history(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """History files, arrays of events, concatenated; what isn't an object is passed over."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """One row of totals as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_rounded(df: DataFrame, path: str, digits: int = 6) -> None:
    """A table as JSON lines, its doubles and arrays of doubles rounded."""
    rounded = []
    for name, kind in df.dtypes:
        c = F.col(name)
        rounded.append((F.round(c, digits) if kind == "double" else F.transform(c, lambda x: F.round(x, digits)) if kind == "array<double>" else c).alias(name))
    df.select(F.to_json(F.struct(*rounded)).alias("value")).write.mode("overwrite").text(path)


def write_matrix(features: DataFrame, vocabulary: DataFrame, rows: DataFrame, report: DataFrame, path: str) -> None:
    """A feature matrix as tables below a folder: long features, the vocabulary with its columns, the row index, and a report."""
    for name, df in (("features", features), ("vocabulary", vocabulary), ("rows", rows)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_report(report, f"{path}/report")
    manifest(features.sparkSession, [f"{path}/{name}" for name in MATRIX], "*.parquet").write.mode("overwrite").parquet(f"{path}/manifest")


#: Tables of a feature matrix.
MATRIX = ("features", "vocabulary", "rows")


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, vocabulary, rows) as write_matrix() wrote them: features(key, feature, value), vocabulary(feature, idx), rows(key, ...).

    An error where a file lacks, is new or has changed, where columns aren't numbered from 0, a name stands twice, or a
    cell belongs to no row or column.
    """
    now = manifest(spark, [f"{path}/{name}" for name in MATRIX], "*.parquet").alias("a")
    odd = now.join(spark.read.parquet(f"{path}/manifest").alias("b"), "name", "full_outer").where("NOT (a.size <=> b.size AND a.sha256 <=> b.sha256)")
    changed = [r["name"] for r in odd.orderBy("name").limit(5).collect()]
    if changed:
        raise ValueError(f"matrix: {', '.join(changed)} not as written")
    features, vocabulary, rows = (spark.read.parquet(f"{path}/{name}") for name in MATRIX)
    key = next(c for c in features.columns if c not in ("feature", "value"))
    n = vocabulary.agg(F.count("*").alias("n"), F.count_distinct("feature").alias("names"), F.count_distinct("idx").alias("places"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    if n["n"] and (n["names"] < n["n"] or n["places"] < n["n"] or n["low"] != 0 or n["high"] != n["n"] - 1):
        raise ValueError("matrix: columns aren't numbered from 0, each once")
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("matrix: a row stands twice")
    if features.join(vocabulary, "feature", "left_anti").limit(1).count() or features.join(rows, key, "left_anti").limit(1).count():
        raise ValueError("matrix: cells of no row or column")
    return features, vocabulary, rows


def write_representation(stats: DataFrame, components: DataFrame, path: str) -> None:
    """The scaler's (feature, mean, scale) and the components (k, feature, weight, centre)."""
    stats.write.mode("overwrite").parquet(f"{path}/scaler")
    components.write.mode("overwrite").parquet(f"{path}/components")


def load_representation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stats, components) as written; an error where a column lacks, a feature has no statistics, or components differ in length."""
    stats, components = spark.read.parquet(f"{path}/scaler"), spark.read.parquet(f"{path}/components")
    for name, df, need in (("scaler", stats, ["feature", "mean", "scale"]), ("components", components, ["k", "feature", "weight", "centre"])):
        lacking = sorted(set(need) - set(df.columns))
        if lacking:
            raise ValueError(f"representation: {name} lacks {', '.join(lacking)}")
    return stats, checked_components(components, stats)


def write_model(centres: DataFrame, stats: DataFrame, silhouette: float | None, path: str, digits: int = 6) -> None:
    """A portable k-means model as one JSON document: k, feature names, scales, and centres(cluster, feature, value) in their order; bounded by the vocabulary times k."""
    names = stats.agg(F.array_sort(F.collect_list("feature")).alias("feature_names"), F.transform(F.array_sort(F.collect_list(F.struct("feature", "scale"))), lambda x: F.round(x["scale"], digits)).alias("scale"))
    each = centres.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: F.round(x["value"], digits)).alias("c"))
    rows = each.agg(F.count("*").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("cluster", "c"))), lambda x: x["c"]).alias("centroids"))
    model = names.join(F.broadcast(rows)).select(F.lit(1).alias("schema_version"), "k", "feature_names", "scale", "centroids", F.lit(silhouette).cast("double").alias("silhouette_sample"))  # one row each
    write_report(model, path)


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def cache_hits(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(cache, key)


def cache_additions(answers: DataFrame, cache: DataFrame, order: str = "created_at", key: str = "cache_key") -> DataFrame:
    """Rows to append: of each key that the cache lacks, the first writer's; of equals any. Rows of a key are folded before they meet."""
    held = F.struct(*(F.col(f"`{c}`") for c in answers.columns))
    missing = answers.join(cache.select(key), key, "left_anti")
    return missing.groupBy(F.col(key).alias("__key")).agg(F.min_by(held, order).alias("__row")).select(*(F.col(f"__row.`{c}`").alias(c) for c in answers.columns))
