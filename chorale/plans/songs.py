"""Registered queries on records: raw tracks made of the part table, taken through the library's operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import names, text
from chorale.operators import audio, canonical, cluster, enrich, features, labels, matching, quality, reduction, route, schema, serve, usage, vocab
from chorale.plans.catalogue import _POINTS, _SIL, _TRACKS, _events, _now, _points, _tracks, query, read, spread
from chorale.session import stored
from chorale.sources import records
from chorale.streaming.usage import merged_usage, plays_by_period

ITEM = names.ITEM


def _item(name: Column, count: Column) -> Column:
    return F.struct(name.alias("name"), count.cast("double").alias("count"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tracks: every part is one, some without an id, a name, artists or a code."""
    p, k = spread(read(spark, sf_dir, "part"), "p_partkey"), F.col("p_partkey")
    guest = F.when(k % 4 == 0, F.array(F.concat(F.lit("Guest "), F.col("p_size") % 5))).otherwise(F.array().cast("array<string>"))
    tags = F.array(
        _item(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size")), _item(F.lit("Rhythm and Blues"), F.lit(None)), _item(F.lit("Billboard Hot 100"), F.lit(3)),
        _item(F.col("p_type"), F.when(F.col("p_size") % 9 == 0, -1).otherwise(2)),
    )
    return p.select(
        k.alias("k"), F.when(k % 7 != 0, F.concat(F.lit("p"), k)).alias("id"), F.when(k % 53 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("  No "), k % 90)).alias("name"),
        F.when(k % 59 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.col("p_brand"), F.lit(" ")), guest)).alias("artists"), F.col("p_type").alias("album"),
        F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-05-01")).alias("year"), F.when(k % 3 == 0, F.concat(F.lit(" us-"), F.lpad((k % 500).cast("string"), 9, "0"))).alias("isrc"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string").alias("durationMs"), (F.col("p_size") * 2).cast("double").alias("popularity"), tags.alias("tags"),
        F.array(_item(F.lit("R&B / Soul"), F.lit(1)), _item(F.lower("p_type"), F.lit(None))).alias("spotifyArtistGenres"), F.concat("p_brand", F.lit(".json")).alias("source_file"),
    )


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical(_raw(spark, sf_dir), "parts", now=F.lit("2024-01-01T00:00:00+00:00"))[0]


_SQ, _TOK, _SLUG = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))", "trim(regexp_replace(replace(lower(trim({0})), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_')", "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"
_RAW = f"""raw AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN 'p' || p_partkey END AS id, CASE WHEN p_partkey % 53 = 0 THEN '' ELSE p_name || ' No ' || (p_partkey % 90) END AS title,
CASE WHEN p_partkey % 59 = 0 THEN [] ELSE [p_brand] || CASE WHEN p_partkey % 4 = 0 THEN ['Guest ' || (p_size % 5)] ELSE [] END END AS artists, p_type AS album, 1950 + p_size AS year,
CASE WHEN p_partkey % 3 = 0 THEN 'US' || lpad(CAST(p_partkey % 500 AS VARCHAR), 9, '0') END AS isrc, CAST(round(p_retailprice * 100) AS BIGINT) AS duration_ms, p_size * 2.0 AS popularity,
split_part(p_name, ' ', 1) AS word, p_size AS size, p_type AS kind, p_brand AS brand FROM part),
song AS (SELECT *, {_TOK.format('title')} AS title_token, array_to_string(list_transform(artists, lambda a: {_TOK.format('a')}), '::') AS artists_key,
coalesce('isrc:' || isrc, 'spotify:' || id, 'text:' || {_SLUG.format('title')} || '|' || array_to_string(list_transform(artists, lambda a: {_SLUG.format('a')}), '|')) AS track_id FROM raw WHERE title <> '' AND len(artists) > 0),
tag AS (SELECT track_id, token, w FROM (SELECT track_id, {_TOK.format('word')} AS token, CAST(size AS DOUBLE) AS w FROM song UNION ALL SELECT track_id, 'r_and_b', 1.0 FROM song
UNION ALL SELECT track_id, {_TOK.format('kind')}, CASE WHEN size % 9 = 0 THEN -1.0 ELSE 2.0 END FROM song) WHERE w >= 0)"""

# -- canonical records -----------------------------------------------------------------------------------------------


@query(f"WITH {_RAW} SELECT track_id, title, artists_key, title_token, album, CAST(year AS INTEGER) AS year, duration_ms, isrc FROM song")
def canonical_songs(spark, sf_dir):
    return _songs(spark, sf_dir).select("track_id", "title", F.col("aliases.normalized_artists_key").alias("artists_key"), F.col("aliases.normalized_title").alias("title_token"), "album", "year", "duration_ms", "ids.isrc")


@query(f"WITH {_RAW} SELECT array_to_string(list_filter([CASE WHEN title = '' THEN 'missing title' END, CASE WHEN len(artists) = 0 THEN 'missing artists' END], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n FROM raw WHERE title = '' OR len(artists) = 0 GROUP BY 1")
def canonical_rejects(spark, sf_dir):
    return canonical.canonical(_raw(spark, sf_dir), "parts")[1].groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"""WITH {_RAW} SELECT coalesce(id, isrc, 'hash:' || substr(sha1(to_json({{'title': title, 'artists': artists}})::VARCHAR), 1, 16)) AS track_id, count(*) AS n FROM song GROUP BY 1""")
def playlist_track_ids(spark, sf_dir):
    return canonical.playlist_records(_raw(spark, sf_dir), "list").groupBy("track_id").agg(F.count("*").alias("n"))


@query(f"WITH {_RAW} SELECT track_id, coalesce('isrc:' || isrc, 'spotify:' || id, 'alias:' || title_token || '::' || artists_key) AS record_key, title_token || '::' || artists_key AS alias FROM song")
def record_keys(spark, sf_dir):
    s = _songs(spark, sf_dir)
    return s.select("track_id", canonical.record_key().alias("record_key"), text.alias_key(F.col("title"), F.col("artists")).alias("alias"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def year_extract(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.year(F.concat(F.lit("placed 007 on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'a' || page_id || 'Z' END AS playlist_id FROM pages")
def playlist_urls(spark, sf_dir):
    p, i = read(spark, sf_dir, "pages"), F.col("page_id")
    return p.select("page_id", text.playlist_id(F.when(i % 3 == 0, F.col("url")).when(i % 3 == 1, F.concat(F.lit("https://host/playlist/a"), i, F.lit("Z?si=1"))).otherwise(F.concat(F.lit("x:playlist:a"), i, F.lit("Z")))).alias("playlist_id"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'US1' || p_size END AS strict, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'US -1' || p_size END AS squeezed, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'US  -1' || p_size END AS trimmed,
CAST(p_size AS BIGINT) AS whole, CASE WHEN p_size % 2 = 0 THEN CAST(p_size / 2 AS BIGINT) END AS halved, CASE WHEN p_size % 2 = 0 THEN CAST(p_size / 2 AS BIGINT) END AS strict_half FROM part""")
def code_and_number_forms(spark, sf_dir):
    p, s = read(spark, sf_dir, "part"), F.col("p_size")
    code = F.when(s % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" us  -1"), s))
    half = F.when(s % 2 == 0, F.concat((s / 2).cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit('"'), s, F.lit('"')))
    return p.select("p_partkey", text.isrc(code).alias("strict"), text.isrc_squeezed(code).alias("squeezed"), text.isrc_trimmed(code).alias("trimmed"), text.lenient_int(F.concat(s, F.lit(".0"))).alias("whole"),
                    F.when(s % 2 == 0, text.lenient_int(half)).alias("halved"), text.strict_int(F.parse_json(half)).cast("bigint").alias("strict_half"))


@query("""WITH i AS (SELECT p_partkey, unnest([{'n': 'B ' || p_brand, 'c': CAST(p_size AS DOUBLE)}, {'n': 'a', 'c': 1.0}, {'n': 'A', 'c': 0.0}]) AS x FROM part)
SELECT p_partkey, array_to_string(list(x.n || '=' || CAST(x.c AS INTEGER) ORDER BY x.c DESC, x.n), ';') AS sorted, 'B ' || min(x.n) FILTER (x.n LIKE 'B %')[3:] || ';a' AS firsts,
array_to_string(list(x.n || '=' || CASE WHEN x.c = 0 THEN 1 ELSE CAST(x.c AS INTEGER) END ORDER BY CASE WHEN x.c = 0 THEN 1 ELSE x.c END DESC, x.n), ';') AS from_map FROM i GROUP BY p_partkey""")
def name_counts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    items = F.array(_item(F.concat(F.lit(" B  "), "p_brand"), F.col("p_size")), _item(F.lit("a"), F.lit(None)), _item(F.lit("A"), F.lit(0)), _item(F.lit(" "), F.lit(5)))
    given = F.create_map(F.concat(F.lit("B "), "p_brand"), F.col("p_size"), F.lit("a"), F.lit(1), F.lit("A"), F.lit(0))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["count"].cast("int"))), ";")
    return p.select("p_partkey", shown(names.from_structs(items)).alias("sorted"), F.array_join(F.transform(names.first_wins(items), lambda x: x["name"]), ";").alias("firsts"), shown(names.from_map(given)).alias("from_map"))


@query(f"WITH {_RAW} SELECT track_id, token, round(sum(w), 6) AS weight, count(*) AS n FROM tag GROUP BY ALL")
def tag_weights(spark, sf_dir):
    tags = names.exploded_tags(_songs(spark, sf_dir).select("track_id", F.col("brainz.tags").alias("t")), "track_id", "t")
    return tags.groupBy("track_id", "token").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))


_FEATURES = f"""{_RAW}, ys AS (SELECT avg(year) AS m, CASE WHEN stddev_pop(year) > 1e-6 THEN stddev_pop(year) ELSE 1 END AS s FROM song),
f AS (SELECT track_id, 'tag__' || token AS feature, ln(1 + w) AS value FROM tag UNION ALL SELECT track_id, 'genre__r_and_b_soul', ln(2) * 0.7 FROM song UNION ALL SELECT track_id, 'genre__' || {_TOK.format('kind')}, ln(2) * 0.7 FROM song
UNION ALL SELECT DISTINCT track_id, unnest(['meta__has_tags', 'meta__has_genres', 'meta__has_year', 'meta__has_popularity']), 0.1 FROM song
UNION ALL SELECT track_id, 'meta__year_z', (year - m) / s * 0.25 FROM song, ys UNION ALL SELECT track_id, 'meta__popularity_scaled', popularity / 100 * 0.15 FROM song),
feat AS (SELECT track_id, feature, sum(value) AS value FROM f GROUP BY ALL)"""


@query(f"WITH {_FEATURES} SELECT track_id, feature, round(value, 6) AS value FROM feat")
def song_features(spark, sf_dir):
    return features.song_features(_songs(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"WITH {_FEATURES}, v AS (SELECT feature, row_number() OVER (ORDER BY df DESC, feature) - 1 AS idx FROM (SELECT feature, count(*) AS df FROM feat WHERE feature LIKE 'tag__%' GROUP BY 1 HAVING count(*) >= 2) QUALIFY idx < 5) SELECT track_id, CAST(idx AS INTEGER) AS idx, round(value, 6) AS value FROM feat JOIN v USING (feature)")
def indexed_features(spark, sf_dir):
    f = stored(features.song_features(_songs(spark, sf_dir)).where("feature like 'tag__%'").withColumn("family", F.lit("tag")), "features")
    chosen = vocab.select_vocabulary(vocab.document_frequency(f, "track_id", ["family"], "feature", repeated=False), ["family"], 5, "feature").select("feature", "idx")
    return vocab.joined_vocabulary(f, chosen, ["feature"]).select("track_id", "idx", F.round("value", 6).alias("value"))


@query(f"WITH {_FEATURES} SELECT (SELECT count(DISTINCT track_id) FROM song) AS rows, count(DISTINCT track_id) FILTER (value <> 0) AS nonzero_rows, count(DISTINCT feature) AS columns FROM feat")
def matrix_report(spark, sf_dir):
    s = _songs(spark, sf_dir)
    return features.matrix_report(features.song_features(s), s, "track_id")


@query(f"""WITH {_FEATURES}, a AS (SELECT track_id, feature, value FROM feat UNION ALL SELECT DISTINCT track_id, 'acoustic__x', 0.5 FROM song WHERE size > 25),
l AS (SELECT DISTINCT track_id FROM song WHERE track_id NOT IN (SELECT track_id FROM song WHERE size > 25))
SELECT feature, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM a UNION ALL SELECT track_id, unnest(['acoustic__x', 'acoustic__y']), unnest([0.25, -0.5]) FROM l) GROUP BY 1""")
def filled_acoustic(spark, sf_dir):
    s = _songs(spark, sf_dir)
    have = s.join(read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_size"), F.col("ids.spotify_id") == F.col("id"), "left")
    loud = have.where(F.col("runtime_metadata.spotify_popularity") > 50).select("track_id", F.lit("acoustic__x").alias("feature"), F.lit(0.5).alias("value")).distinct()
    means = spark.createDataFrame([("acoustic__x", 0.25), ("acoustic__y", -0.5)], "feature string, value double")
    out = features.fill_acoustic(features.song_features(s).unionByName(loud), s.select("track_id").distinct(), means)
    return out.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH n AS (SELECT p_partkey, unnest(['size', 'price']) AS feature, unnest([CAST(p_size AS DOUBLE), CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END]) AS value FROM part),
ab AS (SELECT p_partkey, 'ab__kind__' || p_type AS feature, p_size / 50.0 AS value FROM part WHERE p_size % 2 = 0),
f AS (SELECT * FROM n WHERE value IS NOT NULL UNION ALL SELECT p_partkey, 'has_' || feature, 1.0 FROM n WHERE value IS NOT NULL UNION ALL SELECT * FROM ab UNION ALL SELECT p_partkey, 'has_ab', 1.0 FROM ab)
SELECT p_partkey, feature, round(value, 6) AS value FROM f""")
def legacy_features(spark, sf_dir):
    p, s = read(spark, sf_dir, "part"), F.col("p_size")
    classes = F.when(s % 2 == 0, F.create_map(F.lit("kind"), F.create_map(F.col("p_type"), s / 50)))
    t = p.select("p_partkey", s.cast("string").alias("size"), F.when(s % 5 == 0, F.lit("free")).otherwise(F.col("p_retailprice").cast("string")).alias("price"), classes.alias("classes"))
    return features.legacy_features(t, "p_partkey", ["size", "price"], "classes").withColumn("value", F.round("value", 6))


# -- validation and reports ------------------------------------------------------------------------------------------


def _validated(spark, sf_dir):
    broken = _songs(spark, sf_dir).withColumns({"year": F.when(F.col("year") == 1960, 99).otherwise(F.col("year")), "schema_version": F.when(F.col("album") == "PROMO", 2).otherwise(F.col("schema_version"))})
    return quality.validated(broken, *quality.song_rules())


_CHECK = f"""{_RAW}, chk AS (SELECT track_id, title, list_filter([CASE WHEN album = 'PROMO' THEN 'schema_version must be 1' END, CASE WHEN year = 1960 THEN 'year must lie from 1800 to 3000' END], lambda x: x IS NOT NULL) AS errors,
list_filter([CASE WHEN id IS NULL AND isrc IS NULL THEN 'record has no ids' END, CASE WHEN size % 9 = 0 THEN 'brainz.tags has negative counts' END], lambda x: x IS NOT NULL) AS warnings FROM song)"""


@query(f"WITH {_CHECK} SELECT track_id, array_to_string(errors, ';') AS errors, array_to_string(warnings, ';') AS warnings FROM chk")
def song_validation(spark, sf_dir):
    return _validated(spark, sf_dir).select("track_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query(f"WITH {_CHECK} SELECT count(*) AS records, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0 OR len(warnings) > 0) AS with_issues, CAST(sum(len(errors)) AS BIGINT) AS errors, CAST(sum(len(warnings)) AS BIGINT) AS warnings FROM chk")
def validation_totals(spark, sf_dir):
    return quality.validation_report(_validated(spark, sf_dir))


@query(f"WITH {_CHECK} SELECT track_id, array_to_string(errors, ';') AS errors FROM chk WHERE len(errors) > 0 OR len(warnings) > 0 ORDER BY track_id, errors LIMIT 100")
def validation_issues(spark, sf_dir):
    v = _validated(spark, sf_dir).withColumn("at", F.struct("track_id", F.array_join("errors", ";").alias("e")))
    return quality.issues(v, "at").select("track_id", F.array_join("errors", ";").alias("errors"))


@query("SELECT event_id, CASE WHEN value > 100 THEN 'loud' ELSE '' END AS extra FROM events")
def schema_extra_keys(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("j", F.to_json(F.struct(F.lit(1).alias("k"), F.when(F.col("value") > 100, F.col("value")).alias("loud"))))
    return e.select("event_id", F.array_join(quality.extra_keys(F.col("j"), ["k"]), ",").alias("extra"))


_SCHEMA = {
    "type": "object", "required": ["version", "title", "artists"],
    "properties": {
        "version": {"const": 1}, "title": {"type": "string", "minLength": 3}, "artists": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}},
        "year": {"type": ["integer", "null"], "minimum": 1800, "maximum": 3000}, "tags": {"type": "array", "items": {"$ref": "#/$defs/item"}},
    },
    "additionalProperties": False,
    "$defs": {"item": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "count": {"type": "number", "minimum": 0}}}},
}


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([
  CASE WHEN p % 5 = 0 THEN '$: needs version' END, CASE WHEN p % 5 = 1 THEN '$.version: must be 1' END, CASE WHEN s % 4 = 0 THEN '$.title: must have at least 3 characters' END,
  CASE WHEN s % 3 = 0 THEN '$.artists: must have at least 1 items' END, CASE WHEN s % 3 = 1 THEN '$.artists[1]: must have at least 1 characters' END,
  CASE WHEN q % 7 = 0 THEN '$.year: must be at least 1800' END, CASE WHEN q % 7 = 1 THEN '$.year: must be at most 3000' END, CASE WHEN q % 7 = 2 THEN '$.year: must be integer or null' END,
  CASE WHEN q % 2 = 0 THEN '$.tags[0]: needs name' END, CASE WHEN q % 2 = 0 THEN '$.tags[0].count: must be at least 0' END, CASE WHEN p % 11 = 0 THEN '$: must not have extra' END
], lambda x: x IS NOT NULL), '; ') AS violations FROM r""")
def schema_violations(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").repartition(spark.sparkContext.defaultParallelism)  # the file is one row group
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    record = F.struct(
        F.when(p % 5 == 1, 2).when(p % 5 > 1, 1).alias("version"), F.when(s % 4 == 0, "no").otherwise("title").alias("title"), F.when(s % 3 == 0, F.array().cast("array<string>")).when(s % 3 == 1, F.array(F.lit("x"), F.lit(""))).otherwise(F.array(F.lit("x"))).alias("artists"),
        F.when(q % 7 == 0, 1799).when(q % 7 == 1, 3001).when(q % 7 == 2, 1999.5).when(q % 7 > 3, 2000.0).alias("year"),
        F.array(F.struct(F.when(q % 2 == 1, "n").alias("name"), F.when(q % 2 == 0, -1).otherwise(3).alias("count"))).alias("tags"), F.when(p % 11 == 0, 1).alias("extra"),
    )
    made = line.select("l_orderkey", "l_linenumber", F.to_json(record).alias("j"))
    return made.select("l_orderkey", "l_linenumber", F.array_join(schema.violations(F.col("j"), _SCHEMA), "; ").alias("violations"))


@query(f"WITH {_RAW} SELECT count(*) AS records, count(isrc) AS with_isrc, 0::BIGINT AS with_mbid, count(*) AS with_tags, 0::BIGINT AS with_genres, 0::BIGINT AS with_acoustic_high_level, 0::BIGINT AS with_acoustic_low_level, 0::BIGINT AS with_audio_embedding FROM song")
def quality_counters(spark, sf_dir):
    return quality.quality_counts(_songs(spark, sf_dir))


@query(f"""WITH {_RAW}, w AS (SELECT DISTINCT ON (track_id) * FROM song ORDER BY track_id, k), t AS (SELECT unnest([word, 'Rhythm and Blues', 'Billboard Hot 100', kind]) AS n FROM song)
SELECT (SELECT count(DISTINCT brand) FROM raw) AS files_seen, (SELECT count(*) FROM raw) AS raw_tracks_seen, count(*) AS records_written, (SELECT count(*) FROM raw) - count(*) AS duplicates_skipped, count(*) - count(isrc) AS missing_isrc,
count(*) AS missing_mbid, count(*) AS with_tags, 0::BIGINT AS with_genres, 0::BIGINT AS with_acoustic_high_level, 0::BIGINT AS with_acoustic_low_level, (SELECT count(DISTINCT n) FROM t) AS unique_tags, 0::BIGINT AS unique_genres FROM w""")
def corpus_build_stats(spark, sf_dir):
    s = _songs(spark, sf_dir)
    return quality.build_stats(_raw(spark, sf_dir), s.dropDuplicates(["track_id"]))


@query(f"""WITH {_RAW}, r AS (SELECT isrc, k, title, 4 + CASE WHEN id IS NULL THEN 0 ELSE 10 END AS score FROM song WHERE isrc IS NOT NULL) SELECT isrc, title, score FROM r QUALIFY row_number() OVER (PARTITION BY isrc ORDER BY score DESC, title DESC) = 1""")
def richest_record_per_code(spark, sf_dir):
    s = _songs(spark, sf_dir).where("ids.isrc is not null")
    rank = quality_rank = enrich.richness(F.col("brainz.tags"), F.col("brainz.genres"), F.col("brainz.acoustic_high_level"), F.col("ids.spotify_id"))
    best = enrich.best_per_key(s.select(F.col("ids.isrc").alias("isrc"), "title", F.struct(rank.alias("rank"), "title").alias("r"), quality_rank["score"].alias("score"), F.lit(0).alias("ord")), "isrc", F.col("r"), ["title", "score"], "ord")
    return best.select("isrc", "payload.title", "payload.score")


@query("SELECT p_type AS term, count(*) AS n FROM (SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_brand FROM part) GROUP BY 1")
def distinct_terms(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.array("p_type").alias("a"), F.array("p_brand", "p_type").alias("b"))
    return quality.distinct_terms(p, "a", "b").groupBy("term").agg(F.count("*").alias("n"))


# -- lookups and fills -----------------------------------------------------------------------------------------------


def _recordings(spark, sf_dir):
    """Recordings of the codes and titles that songs have: one for each supplier and part key alike."""
    p = spread(read(spark, sf_dir, "part"), "p_partkey")
    return p.select(F.concat(F.lit("m"), "p_partkey").alias("mbid"), F.col("p_partkey").cast("int").alias("ord"), F.concat("p_name", F.lit(" no "), F.col("p_partkey") % 90).alias("title"), F.array("p_brand").alias("artist_credit"),
                    (F.col("p_size") % 10).alias("source_score"), F.array(F.concat(F.lit("us0"), F.lpad((F.col("p_partkey") % 400).cast("string"), 8, "0"))).alias("isrcs"))


@query(f"WITH {_RAW}, rec AS (SELECT 'US0' || lpad(CAST(p_partkey % 400 AS VARCHAR), 8, '0') AS isrc, arg_min('m' || p_partkey, p_partkey) AS mbid FROM part GROUP BY 1) SELECT track_id, rec.mbid FROM song LEFT JOIN rec USING (isrc)")
def recordings_by_code(spark, sf_dir):
    return enrich.by_isrc(_songs(spark, sf_dir).select("track_id", "ids.isrc"), _recordings(spark, sf_dir)).select("track_id", "mbid")


_MATCH = f"""{_RAW}, rec AS (SELECT p_partkey AS ord, p_name || ' no ' || (p_partkey % 90) AS rt, p_brand AS ra, p_size % 10 AS score FROM part), one AS (SELECT DISTINCT 't' || k AS track_id, title, artists[1] AS artist FROM song),
pr AS (SELECT track_id, ord, score, lower(title) = rt AS same, CASE WHEN lower(title) = rt THEN 50 ELSE 20 END + 40 AS p FROM one JOIN rec ON artist = ra AND contains(rt, lower(title)))"""


@query(f"WITH {_MATCH} SELECT track_id, 'm' || arg_max(ord, (p + score) * 1e12 + score * 1e10 - ord) AS mbid, CAST(max(p + score) AS INTEGER) AS points FROM pr GROUP BY track_id")
def recordings_by_title(spark, sf_dir):
    return matching.by_title_artist(_titled(spark, sf_dir), _recordings(spark, sf_dir)).withColumn("points", F.col("points").cast("int"))


@query(f"WITH {_MATCH}, s AS (SELECT track_id, ord, score, CASE WHEN same THEN 6 ELSE 3 END AS p FROM pr) SELECT track_id, 'm' || arg_max(ord, p * 1e12 + score * 1e10 - ord) AS mbid, CAST(max(p) AS INTEGER) AS points FROM s GROUP BY track_id")
def recordings_by_title_simple(spark, sf_dir):
    return matching.by_title_artist(_titled(spark, sf_dir), _recordings(spark, sf_dir), "simple").withColumn("points", F.col("points").cast("int"))


_FOLDED = r"CASE WHEN regexp_matches({0}, '[\p{{L}}\p{{N}}]') THEN trim(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')) ELSE lower({0}) END"


@query(rf"""
WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\s+', ' ', 'g')) AS heading,
           regexp_extract(url, '://([^/]*)', 1) AS site FROM pages),
f AS (SELECT *, {_FOLDED.format("title")} AS ft, {_FOLDED.format("heading")} AS fh FROM p),
pr AS (SELECT x.page_id, y.page_id AS ord, y.page_id % 7 AS score, CASE WHEN lower(x.heading) = lower(y.title) THEN 50
       WHEN regexp_replace(regexp_replace(lower(x.heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = regexp_replace(regexp_replace(lower(y.title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
       AND regexp_matches(lower(x.heading), '[a-z0-9]') THEN 35
       WHEN contains(lower(y.title), lower(x.heading)) THEN 20 ELSE 0 END + 40 AS p
       FROM f x JOIN f y ON x.site = y.site AND contains(y.ft, x.fh) WHERE x.heading <> '')
SELECT page_id, 'p' || arg_max(ord, (p + score) * 1e12 + score * 1e10 - ord) AS mbid, CAST(max(p + score) AS INTEGER) AS points FROM pr GROUP BY page_id""")
def page_headings_by_title(spark, sf_dir):
    """Headings in four languages, held against titles of the same site as tracks are against recordings."""
    html, site = F.col("html"), F.array(F.regexp_extract("url", "://([^/]*)", 1))
    p = read(spark, sf_dir, "pages")
    asked = p.select("page_id", F.regexp_extract(html, "(?s)<h1>(.*?)</h1>", 1).alias("title"), site.alias("artists"))
    held = p.select(F.concat(F.lit("p"), "page_id").alias("mbid"), F.col("page_id").alias("ord"), F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"), site.alias("artist_credit"), (F.col("page_id") % 7).alias("source_score"))
    return matching.by_title_artist(asked.where(text.squeeze(F.col("title")) != ""), held, key="page_id").withColumn("points", F.col("points").cast("int"))


def _titled(spark, sf_dir):
    r = _raw(spark, sf_dir).where((F.trim("name") != "") & (F.size("artists") > 0))
    return r.select(F.concat(F.lit("t"), "k").alias("track_id"), text.squeeze(F.col("name")).alias("title"), "artists")


@query(f"WITH {_RAW} SELECT k, array_to_string(CASE WHEN size % 3 = 0 THEN [brand, kind] ELSE [word] END, '|') AS tags, size % 3 = 0 AS changed FROM raw")
def filled_lists(spark, sf_dir):
    p, s = read(spark, sf_dir, "part"), F.col("p_size")
    t = p.select(F.col("p_partkey").alias("k"), F.when(s % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("tags"))
    return enrich.fill(t, p.select(F.col("p_partkey").alias("k"), F.array("p_brand", "p_type").alias("tags")), "k", ["tags"]).withColumn("tags", F.array_join("tags", "|"))


@query("SELECT p_partkey, brand AS tags, true AS changed FROM (SELECT p_partkey, p_brand AS brand FROM part)")
def overwritten_lists(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    t = p.select("p_partkey", F.array("p_type").alias("tags"))
    return enrich.fill(t, p.select("p_partkey", F.array("p_brand").alias("tags")), "p_partkey", ["tags"], overwrite=True).withColumn("tags", F.array_join("tags", "|"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS energy FROM part")
def numeric_attributes(spark, sf_dir):
    p, s = read(spark, sf_dir, "part"), F.col("p_size")
    facts = p.where(s <= 40).select("p_partkey", F.when(s % 5 == 0, F.lit("n/a")).otherwise(s.cast("string")).alias("energy"))
    return enrich.attributes(p.select("p_partkey"), facts, "p_partkey", ["energy"])


@query("""WITH g AS (SELECT conv_id, turn AS group_pos, role AS name, [role || turn, 'gone', role || (turn + 2), 'user0'] AS ids FROM conversations), t AS (SELECT DISTINCT conv_id, role || turn AS id FROM conversations),
e AS (SELECT g.conv_id, group_pos, name, i, ids[i] AS id FROM g, unnest(range(1, 5)) AS x(i)) SELECT e.conv_id, group_pos, name, array_to_string(list(e.id ORDER BY i), ',') AS track_ids FROM e JOIN t ON e.conv_id = t.conv_id AND e.id = t.id GROUP BY ALL HAVING count(*) >= 2""")
def resolved_groups(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    groups = c.select("conv_id", F.col("turn").alias("group_pos"), F.col("role").alias("name"), F.array(F.concat("role", "turn"), F.lit("gone"), F.concat("role", F.col("turn") + 2), F.lit("user0")).alias("track_ids"))
    return serve.resolved(groups, c.select("conv_id", F.concat("role", "turn").alias("id")), "conv_id").withColumn("track_ids", F.array_join("track_ids", ","))


@query(f"""WITH {_RAW}, c AS (SELECT DISTINCT isrc FROM raw WHERE isrc IS NOT NULL AND substr(isrc, 11) IN ('0', '1', '2')) SELECT k, CASE WHEN size % 4 = 0 THEN 'own' WHEN c.isrc IS NOT NULL THEN 'b' || c.isrc END AS brainz,
CASE WHEN id IS NOT NULL AND size > 20 THEN 'soul=1' END AS genres FROM raw LEFT JOIN c USING (isrc)""")
def enriched_if_absent(spark, sf_dir):
    r = _raw(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size"), "k")
    t = r.select("k", "id", F.regexp_replace("isrc", "-", "").alias("isrc"), F.when(F.col("p_size") % 4 == 0, "own").alias("brainz"), F.lit(None).cast(ITEM).alias("spotify_artist_genres"))
    codes = t.where("isrc is not null").select(F.concat(F.lower("isrc"), F.lit("  ")).alias("isrc"), F.concat(F.lit("b"), F.upper(F.trim("isrc"))).alias("brainz")).where(F.trim("isrc").rlike("[012]$")).distinct()
    genres = r.where("p_size > 20 and id is not null").select("id", F.array(F.lit("soul")).alias("genres"))
    out = enrich.enriched_if_absent(t, codes, genres)
    return out.select("k", "brainz", F.array_join(F.transform("spotify_artist_genres", lambda x: F.concat(x["name"], F.lit("="), x["count"].cast("int"))), ",").alias("genres"))


@query(f"WITH {_RAW} SELECT count(*) AS n, count(*) FILTER (size % 2 = 0 OR kind = 'PROMO' OR size > 30 OR id IS NULL) AS needing FROM raw")
def needing_enrichment(spark, sf_dir):
    p, s = read(spark, sf_dir, "part"), F.col("p_size")
    none = F.array().cast("array<string>")
    need = enrich.needs_enrichment(F.when(F.col("p_partkey") % 7 != 0, F.lit("m")), F.when(s % 2 == 0, none).otherwise(F.array(F.lit("t"))), F.when(F.col("p_type") == "PROMO", none).otherwise(F.array(F.lit("g"))), F.when(s <= 30, F.lit("{}")))
    return p.agg(F.count("*").alias("n"), F.count_if(need).alias("needing"))


@query("SELECT count(*) AS records, count(*) FILTER (p_size > 10) AS changed, count(*) FILTER (p_size % 4 = 0) AS hits_spotify_id, count(*) FILTER (p_size % 4 = 1) AS hits_isrc, count(*) FILTER (p_size % 4 = 2) AS hits_musicbrainz_recording_id, count(*) FILTER (p_size % 4 = 3) AS hits_alias FROM part")
def enrichment_outcomes(spark, sf_dir):
    p, s = read(spark, sf_dir, "part"), F.col("p_size")
    kind = F.get(F.array(*map(F.lit, ("spotify_id", "isrc", "musicbrainz_recording_id", "alias"))), s % 4)
    return enrich.outcome_counts(p.select(kind.alias("match_type"), (s > 10).alias("changed")))


@query("""WITH a AS (SELECT md5(p_brand || p_type) AS cache_key, p_partkey AS v FROM part), c AS (SELECT DISTINCT md5(p_brand || p_type) AS cache_key FROM part WHERE p_size > 45)
SELECT cache_key, min(v) AS v, 'add' AS what FROM a WHERE cache_key NOT IN (SELECT cache_key FROM c) GROUP BY 1 UNION ALL SELECT cache_key, v, 'hit' FROM a JOIN c USING (cache_key)""")
def result_cache(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    key = F.md5(F.concat("p_brand", "p_type").cast("binary")).alias("cache_key")
    asked, cache = p.select(key, F.col("p_partkey").alias("v"), F.col("p_partkey").alias("created_at")), p.where("p_size > 45").select(key).distinct()
    added = records.cache_additions(asked, cache).select("cache_key", "v", F.lit("add").alias("what"))
    return added.unionByName(records.cache_hits(asked, cache).select("cache_key", "v", F.lit("hit").alias("what")))


# -- usage -----------------------------------------------------------------------------------------------------------

_BUCKETS = """b AS (SELECT playlist_id, id, unnest(list_filter([CASE WHEN unseen OR plays <= 3 OR minutes <= 3 THEN 'barely' END, CASE WHEN plays >= 5 AND days > 180 THEN 'old_favourite' END,
  CASE WHEN plays >= 3 AND skips >= 2 AND skips / plays >= 0.5 THEN 'skipped' END, CASE WHEN plays >= {2} AND minutes >= {3} THEN 'core' END, CASE WHEN unseen OR (plays <= {0} AND minutes <= {1}) THEN 'tourist' END], lambda x: x IS NOT NULL)) AS bucket FROM tu),
s AS (SELECT playlist_id, bucket, count(*) AS size FROM b GROUP BY ALL HAVING count(*) >= CASE bucket WHEN 'skipped' THEN 3 ELSE 5 END)"""


@query(f"""WITH {_TRACKS}, {_BUCKETS.format(2, 2, 25, 30)} SELECT playlist_id, CASE bucket WHEN 'barely' THEN 'usage-barely-played' WHEN 'old_favourite' THEN 'usage-long-ago' WHEN 'skipped' THEN 'usage-frequently-skipped' WHEN 'core' THEN 'usage-core-favorites' ELSE 'usage-tourists' END AS id,
CASE bucket WHEN 'barely' THEN 'Barely played tracks' WHEN 'old_favourite' THEN 'Old favorites (not played recently)' WHEN 'skipped' THEN 'Frequently skipped tracks' WHEN 'core' THEN 'Core favorites' ELSE 'Tourists / padding' END AS label,
CASE bucket WHEN 'barely' THEN 'plays ≤ 3 or total listening time ≤ 3 minutes (from uploaded history)' WHEN 'old_favourite' THEN 'plays ≥ 5 and lastPlayed > 6 months ago (from uploaded history)' WHEN 'skipped' THEN 'skips ≥ 2 and skip rate ≥ 50% of plays (from uploaded history)'
WHEN 'core' THEN 'plays ≥ 25 and total listening ≥ 30 minutes (from uploaded history)' ELSE 'plays ≤ 2 and total listening ≤ 2 minutes (from uploaded history)' END AS rule, size, md5(array_to_string(list(b.id ORDER BY b.id), ',')) AS tracks FROM b JOIN s USING (playlist_id, bucket) GROUP BY ALL""")
def usage_suggestions(spark, sf_dir):
    made = usage.suggestions(_tracks(spark, sf_dir).join(_now(spark, sf_dir)), F.col("now"))
    return made.select("playlist_id", "id", "label", "rule", "size", F.md5(F.array_join("tracks", ",").cast("binary")).alias("tracks"))


@query(f"""WITH {_TRACKS}, us2 AS (SELECT *, CASE WHEN unseen OR plays <= 5 OR minutes <= 5 THEN 'barely' END AS b1, CASE WHEN unseen OR (plays <= 4 AND minutes <= 5) THEN 'tourist' END AS b2, CASE WHEN plays >= 40 AND minutes >= 45 THEN 'core' END AS b3 FROM tu),
x AS (SELECT playlist_id, unnest(list_filter([b1, b2, b3], lambda x: x IS NOT NULL)) AS bucket FROM us2) SELECT playlist_id, bucket, count(*) AS size FROM x GROUP BY ALL HAVING count(*) >= 5""")
def usage_buckets_aggressive(spark, sf_dir):
    made = usage.buckets(_tracks(spark, sf_dir).join(_now(spark, sf_dir)), F.col("now"), "aggressive").where(F.col("bucket").isin("barely", "tourist", "core"))
    return made.groupBy("playlist_id", "bucket").agg(F.first("size").alias("size"))


@query("""WITH g AS (SELECT p_brand AS bucket, CAST(p_partkey AS VARCHAR) AS id, p_size FROM part), chosen AS (SELECT bucket, id FROM g WHERE p_size > 48), picky AS (SELECT DISTINCT bucket FROM chosen)
SELECT bucket, id FROM g WHERE bucket <> 'Brand#1' AND (bucket NOT IN (SELECT bucket FROM picky) OR p_size > 48)""")
def selected_members(spark, sf_dir):
    g = read(spark, sf_dir, "part").select(F.col("p_brand").alias("bucket"), F.col("p_partkey").cast("string").alias("id"), "p_size")
    shown = usage.undismissed(g, spark.createDataFrame([("Brand#1",)], "bucket string"), "bucket")
    return usage.selected(shown, g.where("p_size > 48").select("bucket", "id")).select("bucket", "id")


@query("""WITH e AS (SELECT 'u' || user_id || '_' || json_extract_string(props, '$.k') AS usage_key, CAST(floor(value * 1000) AS BIGINT) AS ms, ts FROM events) SELECT usage_key, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms FROM e GROUP BY ALL""")
def plays_per_day(spark, sf_dir):
    return plays_by_period(_events(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH ev AS (SELECT 'u' || user_id || '_' || json_extract_string(props, '$.k') AS usage_key, CAST(floor(value * 1000) AS BIGINT) AS ms, event_type = 'error' AS skipped, ts FROM events)
SELECT usage_key, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS total_ms, max(ts) AS last_played, CAST(count(*) FILTER (skipped) AS BIGINT) AS skips, CAST(coalesce(sum(ms) FILTER (skipped), 0) AS BIGINT) AS skip_ms FROM ev GROUP BY 1""")
def usage_merged_from_batches(spark, sf_dir):
    e = _events(spark, sf_dir)
    day = F.dayofmonth("ts") < 16
    return merged_usage(usage.usage(e.where(day)), usage.usage(e.where(~day)))


# -- groups, prompts, names ------------------------------------------------------------------------------------------

#: Phrases that clusters of these tables are called by.
_PHRASES = ["mixed vibe cluster", "soundtrack", "jazz rap", "singer songwriter", "tech house", "house", "garage rock house", "indie", "trap soul", "r and b", "emo rap", "hip hop", "neo soul", "plain words", "boom bap", "uk garage", "slowcore", "rap rock", "melodic rap", "nu jazz", "k pop", "lo fi indie", "bossa nova", "country rap", "bluegrass", "psychedelic techno", "big band", "drill", "art pop", "desi pop", "hyperpop", "vaporwave", "khaleeji", "amapiano", "chillhop", "timbre dark"]


def _phrase(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, _PHRASES)), (k % len(_PHRASES)).cast("int"))


def _chain(c: str, rules, otherwise: str) -> str:
    some = lambda words: " OR ".join(f"contains({c}, '{w}')" for w in words)
    return "CASE " + " ".join(f"WHEN ({some(w)})" + (f" AND NOT ({some(b)})" if b else "") + f" THEN '{g}'" for g, w, b in rules) + f" ELSE {otherwise} END"


_LIST = "[" + ", ".join(f"'{x}'" for x in _PHRASES) + "]"


@query(f"""WITH n AS (SELECT p_partkey, {_LIST}[CAST(p_partkey % {len(_PHRASES)} + 1 AS INTEGER)] || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' / words' END AS name, {_LIST}[CAST((p_partkey * 7 + p_size) % {len(_PHRASES)} + 1 AS INTEGER)] AS f FROM part)
SELECT p_partkey, {_chain("name", route.BY_NAME, _chain("f", route.BY_FEATURES, "'More Picks'"))} AS display_group, {_chain("name", route.BY_TERMS, "'More Picks'")} AS term_group FROM n""")
def rule_router(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(_phrase(k), F.when(F.col("p_size") % 3 == 0, "").otherwise(" / words"))
    return p.select("p_partkey", route.display_group(name, F.array(_phrase(k * 7 + F.col("p_size")))).alias("display_group"), route.term_group(name).alias("term_group"))


@query("""WITH c AS (SELECT p_brand, p_type AS display_group, p_size AS cluster, count(*) AS size, min(p_name) AS first_name FROM part GROUP BY ALL),
m AS (SELECT p_brand, display_group, unnest(range(0, len(l))) AS i, l[i + 1] AS x FROM (SELECT p_brand, display_group, list({'cluster': cluster, 'size': size, 'n': first_name} ORDER BY size DESC, cluster) AS l FROM c GROUP BY ALL)),
d AS (SELECT p_brand, display_group, x.n AS n, min(i) AS pos FROM m WHERE x.size * 0.1 >= 0.15 GROUP BY ALL), s AS (SELECT p_brand, display_group, x.n AS n, min(i) AS pos FROM m GROUP BY ALL)
SELECT g.p_brand, g.display_group, g.size, g.members, coalesce(dd.descriptors, '') AS descriptors, ss.samples FROM (SELECT p_brand, display_group, CAST(sum(x.size) AS BIGINT) AS size, array_to_string(list(x.cluster ORDER BY i), ',') AS members FROM m GROUP BY ALL) g
LEFT JOIN (SELECT p_brand, display_group, array_to_string((list(n ORDER BY pos))[1:10], ',') AS descriptors FROM d GROUP BY ALL) dd USING (p_brand, display_group)
JOIN (SELECT p_brand, display_group, array_to_string((list(n ORDER BY pos))[1:12], ',') AS samples FROM s GROUP BY ALL) ss USING (p_brand, display_group)""")
def display_group_rollup(spark, sf_dir):
    c = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_type").alias("display_group"), F.col("p_size").alias("cluster")).agg(F.count("*").alias("size"), F.min("p_name").alias("first"))
    told = F.array(F.struct(F.col("first").alias("label"), (F.col("size") * 0.1).alias("score")), F.struct(F.lit("").alias("label"), F.lit(1.0).alias("score")))
    rolled = route.display_groups(c.withColumns({"name": F.col("cluster").cast("string"), "sample_tracks": F.array("first"), "descriptors": told}), ["p_brand"])
    return rolled.select("p_brand", "display_group", "size", F.array_join("member_cluster_ids", ",").alias("members"), F.array_join("top_descriptors", ",").alias("descriptors"), F.array_join("sample_tracks", ",").alias("samples"))


@query(f"""WITH {_RAW} SELECT brand, CAST(row_number() OVER (PARTITION BY brand ORDER BY k) - 1 AS INTEGER) AS i, coalesce(name, '') || '|' || array_to_string(artists, ', ') AS title, album AS genres FROM (SELECT *, CASE WHEN title = '' THEN '  ' ELSE ' ' || word || ' ' || substr(title, len(word) + 2) END AS name FROM raw)""")
def prompt_rows(spark, sf_dir):
    r = _raw(spark, sf_dir)
    shown = r.select("k", F.regexp_replace("source_file", ".json$", "").alias("brand"), F.when(F.trim("name") == "", F.col("name")).otherwise(F.concat(F.lit(" "), text.squeeze(F.col("name")))).alias("name"), text.cleaned(F.col("artists")).alias("artists"), F.lit("x").alias("year"), F.array(_item(F.col("album"), F.lit(1))).alias("genres"), "tags")
    rows = serve.prompt_rows(shown, "brand", "k")
    j = lambda path: F.get_json_object("row", path)
    return rows.select("brand", "i", F.concat(j("$.title"), F.lit("|"), j("$.artists")).alias("title"), F.get_json_object("row", "$.genres[0]").alias("genres"))


@query(f"WITH {_RAW} SELECT coalesce(id, '') AS id, CAST(year AS INTEGER) AS year, 'R&B / Soul,' || lower(kind) AS genres, 4 AS n_tags, count(*) AS n FROM raw GROUP BY ALL")
def analysis_payload(spark, sf_dir):
    r = _raw(spark, sf_dir).withColumn("year", F.substring("year", 1, 4)).withColumnRenamed("spotifyArtistGenres", "spotify_artist_genres")
    return labels.analysis_payload(r).groupBy(F.coalesce("id", F.lit("")).alias("id"), "year", F.array_join("genres", ",").alias("genres"), F.size("tags").alias("n_tags")).agg(F.count("*").alias("n"))


@query(f"WITH {_RAW}, t AS (SELECT k, unnest(list_distinct([{_TOK.format('word')}, 'rhythm_and_blues', {_TOK.format('kind')}, 'r_and_b_soul'])) AS term FROM raw) SELECT k, term, replace(term, '_', ' ') AS shown FROM t")
def label_terms(spark, sf_dir):
    return labels.label_terms(_raw(spark, sf_dir), "k", "tags", "spotifyArtistGenres")


@query(f"WITH {_RAW} SELECT track_id, brand || '.json' AS file, 4 AS n_tags, 0 AS n_genres, title_token AS alias, count(*) AS n FROM song GROUP BY ALL")
def enrichment_payloads(spark, sf_dir):
    x = _songs(spark, sf_dir).select(canonical.enrichment_payload().alias("x")).select("x.*")
    return x.groupBy("track_id", F.get("source.source_files", F.lit(0)).alias("file"), F.size("brainz.tags").alias("n_tags"), F.size("brainz.genres").alias("n_genres"), F.col("aliases.normalized_title").alias("alias")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders")
def ordinals(spark, sf_dir):
    return canonical.ordinal(read(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_index")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN 'r' || p_partkey END, 'k' || p_partkey) AS id, p_name AS name, p_brand || ',' || p_type AS artists, CAST(1950 + p_size AS INTEGER) AS year, 'u' || p_size AS image_url FROM part WHERE p_size <> 7 AND p_size <> 8""")
def flat_playlist_items(spark, sf_dir):
    p, s, k = read(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    artist = lambda c: F.struct(F.lit("i").alias("id"), c.alias("name"))
    track = F.struct(
        F.when(s != 8, F.concat(F.lit("k"), k)).alias("id"), F.col("p_name").alias("name"), F.array(artist(F.col("p_brand")), artist(F.col("p_type"))).alias("artists"),
        F.struct(k.cast("string").alias("name"), F.concat(s + 1950, F.lit("-01-02")).alias("release_date"), F.array(F.struct(F.concat(F.lit("u"), s).alias("url"))).alias("images")).alias("album"),
        F.struct(F.lit("c").alias("isrc")).alias("external_ids"), F.lit(1).alias("duration_ms"), s.alias("popularity"), F.lit(None).cast("string").alias("preview_url"), F.struct(F.when(s % 5 == 0, F.concat(F.lit("r"), k)).alias("id")).alias("linked_from"),
    )
    flat = canonical.flat_items(p.select(F.when(s != 7, track).alias("track")))
    return flat.select(F.col("album").cast("long").alias("p_partkey"), "id", "name", F.array_join("artists", ",").alias("artists"), "year", "image_url")


@query("SELECT n_nationkey AS id, n_name AS name, CAST(coalesce(CASE WHEN n_regionkey > 1 THEN n_nationkey END, 0) AS INTEGER) AS tracks_total FROM nation")
def playlist_listing(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return canonical.listing(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.when(F.col("n_regionkey") > 1, F.col("n_nationkey")).alias("total")).alias("tracks")))


@query("""WITH f AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS first FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS r FROM f)
SELECT o_custkey, string_agg(p, '|' ORDER BY r) AS first_three FROM r WHERE r <= 3 GROUP BY o_custkey""")
def ordered_distinct_limit(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("x"))
    return o.select("o_custkey", F.array_join(names.ordered_distinct(F.col("x"), 3), "|").alias("first_three"))


_LABELS = ["Jazz / Nujabes", "Trap Soul", "Electronic / Dance", "Dream Pop", "Rock / Indie", "R&B / Neo", "Party Rap", "Hip Hop", "Pop", "Chill", "Breakbeat", "Spoken"]
_KEYS = ["jazz", "trap", "electronic", "dream", "rock", "rnb", "melodic", "rap", "pop", "acoustic", "instrumental", ""]


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_suppkey % 6 WHEN 0 THEN 'vibe' WHEN 1 THEN 'era' WHEN 2 THEN 'popularity' WHEN 3 THEN 'usage' ELSE ({_KEYS!r})[CAST(l_partkey % {len(_KEYS)} AS INTEGER) + 1] END AS group_key FROM lineitem""")
def group_keys(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    start = F.get(F.array(*map(F.lit, ("vibe-", "era-", "pop-", "usage-", "c", ""))), (F.col("l_suppkey") % 6).cast("int"))
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("l_partkey") % len(_LABELS)).cast("int"))
    return line.select("l_orderkey", "l_linenumber", route.group_key(F.concat(start, F.col("l_partkey").cast("string")), label).alias("group_key"))


# -- nested payloads, clusters, sound --------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, unnest(['q', 'a__b__c__d__e__f__g', 'list__0', 'list__1__deep']) AS path, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem""")
def json_numeric_leaves(spark, sf_dir):
    line = spread(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    nest = F.col("l_extendedprice")
    for name in "gfedcb":
        nest = F.struct(nest.alias(name))
    payload = F.struct(
        F.col("l_quantity").alias("q"), nest.alias("a"), F.struct(F.lit(9).alias("x")).alias("version"), F.lit("text").alias("s"), F.lit(True).alias("flag"),
        F.to_json(F.struct(F.array(F.col("l_discount")).alias("z"))).alias("quoted"),
    )
    listed = F.concat(F.lit('{"list": ['), F.col("l_discount").cast("string"), F.lit(', {"deep": '), F.col("l_tax").cast("string"), F.lit("}, null]}"))
    both = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(", "), F.substring("l", 2, 1000))
    j = line.select("l_orderkey", "l_linenumber", F.to_json(payload).alias("j"), listed.alias("l")).select(F.struct("l_orderkey", "l_linenumber").alias("at"), both.alias("j"))
    return names.numeric_leaves(j, "at", "j").select("at.*", "path", "value")


@query(f"WITH {_SIL} SELECT playlist_id, round(silhouette, 6) AS silhouette FROM sil")
def silhouette_sampled(spark, sf_dir):
    """No group of these tables is above the sample's 1,500 rows, so the exact value is asked."""
    return cluster.sampled_silhouette(_points(spark, sf_dir), ["playlist_id"]).withColumn("silhouette", F.round("silhouette", 6))


@query(f"""WITH {_POINTS}, c AS (SELECT cluster, i % 4 AS k, avg(e[i + 1]) AS value FROM pts, unnest(range(0, 4)) AS x(i) GROUP BY ALL), w AS (SELECT k, 'f__' || i AS feature, ((i * 7 + k * 3) % 11 - 5) / 10.0 AS weight, 0.001 * i AS centre FROM range(0, 64) AS a(i), range(0, 4) AS b(k))
SELECT cluster, feature, round(v, 6) AS weight, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(v) DESC, feature) AS INTEGER) AS rank FROM (SELECT cluster, feature, sum(value * weight) + max(centre) AS v FROM c JOIN w USING (k) GROUP BY ALL) QUALIFY rank <= 12""")
def centre_contributors(spark, sf_dir):
    each = _points(spark, sf_dir).select("cluster", F.posexplode(F.slice("embedding", 1, 4)).alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("value"))
    i = spark.range(64).select(F.col("id").cast("int").alias("i")).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    weights = i.select("k", F.concat(F.lit("f__"), "i").alias("feature"), (((F.col("i") * 7 + F.col("k") * 3) % 11 - 5) / 10).alias("weight"), (0.001 * F.col("i")).alias("centre"))
    return cluster.contributors(each, weights).withColumn("weight", F.round("weight", 6))


@query("""WITH t AS (SELECT p_brand, p_partkey, p_name || ' — ' || p_type || ', ' || p_brand AS shown, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_brand, array_to_string(list(shown ORDER BY n), '; ') AS sample_tracks FROM t WHERE n <= 10 GROUP BY p_brand""")
def cluster_samples(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    tracks = p.select(F.col("p_partkey").alias("track_key"), F.col("p_name").alias("title"), F.array("p_type", "p_brand", "p_name").alias("artists"))
    return cluster.samples(p.select("p_brand", F.col("p_partkey").alias("track_key")), tracks, ["p_brand"], "track_key", artists=2).withColumn("sample_tracks", F.array_join("sample_tracks", "; "))


@query("SELECT p_partkey AS track_key, p_brand AS playlist_id, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS INTEGER) AS cluster FROM part")
def contiguous_labels(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_key"), F.col("p_brand").alias("playlist_id"), F.col("p_size").alias("cluster"))
    return cluster.contiguous(p, ["playlist_id"]).select("track_key", "playlist_id", "cluster")


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, n, greatest(2, CASE WHEN n >= 250 THEN 5 WHEN n >= 120 THEN 4 WHEN n >= 40 THEN 3 ELSE 2 END) AS lo, least(12, n - 1) AS mo, least(least(12, n - 1), greatest(2, n // 8)) AS up FROM n)
SELECT o_custkey, CASE WHEN n < 2 OR CASE WHEN up < lo THEN mo ELSE up END < 2 THEN '' ELSE array_to_string(range(CASE WHEN up < lo THEN least(lo, mo) ELSE lo END, CASE WHEN up < lo THEN mo ELSE up END + 1), ',') END AS ks FROM b""")
def candidate_ks(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", F.array_join(cluster.candidate_ks(F.col("n")), ",").alias("ks"))


@query(f"""WITH c AS (SELECT vec_id, list_transform(CAST(embedding[1:12] AS DOUBLE[]), lambda x: abs(x)) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM c),
p AS (SELECT mode, list_transform(t, lambda x: x / list_sum(t)) AS t FROM (VALUES ('major', {audio.MAJOR}), ('minor', {audio.MINOR})) AS q(mode, t)),
d AS (SELECT vec_id, mode, k, list_sum(list_transform(range(0, 12), lambda i: v[i + 1] * t[(i - k + 12) % 12 + 1])) AS dot FROM u, p, range(0, 12) AS r(k)),
m AS (SELECT vec_id, mode, max(dot) AS best, arg_max(k, dot) AS k FROM d GROUP BY ALL), j AS (SELECT a.vec_id, a.best AS ma, b.best AS mi, a.k AS ka, b.k AS kb FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.mode = 'major' AND b.mode = 'minor')
SELECT vec_id, ({audio.KEYS})[CASE WHEN ma >= mi THEN ka ELSE kb END + 1] AS pitch, CASE WHEN ma >= mi THEN 'major' ELSE 'minor' END AS mode, round(abs(ma - mi), 6) AS confidence FROM j""")
def key_and_mode(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))
    return audio.key_and_mode(e, "vec_id").withColumn("confidence", F.round("confidence", 6))


@query()
def pca_sparse(spark, sf_dir):
    """Variances of the first eight components of parts' words, types, brands and sizes, as sparse rows; they have no oracle."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_key"), F.explode(F.array_union(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("tag__"), w)), F.array(F.concat(F.lit("genre__"), "p_type"), F.concat(F.lit("meta__"), "p_brand"), F.concat(F.lit("acoustic__"), "p_size")))).alias("feature"), F.lit(1.0).alias("value"))
    n = read(spark, sf_dir, "part").count()
    found = reduction.principal_components(p, features.scaler_stats(p, n), n, 8)
    return spark.createDataFrame([(k, v) for k, v in enumerate(found[1])], "k int, variance double")


@query()
def playlist_summaries(spark, sf_dir):
    """Clusters of both halves of the embeddings, split where too large, with their names, samples and features."""
    points = _points(spark, sf_dir)
    long = points.select("track_key", F.posexplode("embedding").alias("i", "value")).select("track_key", F.concat(F.lit("tag__f"), "i").alias("feature"), "value")
    split, _ = cluster.split_oversized(cluster.cluster_playlists(points)[0], long)
    tracks = points.select("track_key", F.concat(F.lit("vector "), "track_key").alias("title"), F.array("playlist_id").alias("artists"))
    return cluster.playlist_summary(long, split, tracks, "track_key")
