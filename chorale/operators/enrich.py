"""De-duplication, lookups by priority, fills, upserts and matching by code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.text import isrc, isrc_trimmed
from chorale.session import stored


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Pre-aggregated, so that a key with many rows doesn't meet in one task before."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order, F.struct(*(c for c in df.columns if c not in order)).alias("__rest"))).alias("__x")) if _orderable(df) else None
    if first is None:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
    return first.select(*(F.col(f"__x.{c}" if c in order else f"__x.__rest.{c}").alias(c) for c in df.columns))


def _orderable(df: DataFrame) -> bool:
    return not any(k.startswith(("map", "variant", "interval")) or "map<" in k or "variant" in k for _, k in df.dtypes)


def richness(tags: Column, genres: Column, acoustic: Column, mbid: Column) -> Column:
    """Score of a record's enrichment, then its sizes: greater is richer."""
    nt, ng, ac = F.size(F.coalesce(tags, F.array())), F.size(F.coalesce(genres, F.array())), acoustic.isNotNull().cast("int")
    score = F.when(F.coalesce(mbid, F.lit("")) != "", 10).otherwise(0) + F.when(nt > 0, 4).otherwise(0) + F.when(ng > 0, 3).otherwise(0) + 5 * ac
    return F.struct(score.alias("score"), nt.alias("tags"), ng.alias("genres"), ac.alias("acoustic"))


def best_per_key(df: DataFrame, key: str, rank: Column, payload: list[str], order: str) -> DataFrame:
    """The richest row of each key; of equals the first by order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(rank.alias("r"), (-F.col(order)).alias("o"))).alias("payload"))


def lookup_keys(source_id: Column, code: Column, mbid: Column, alias: Column) -> Column:
    """Array of (key_type, prio, key) that a record can be looked up by, strongest first; blanks are left out."""
    pairs = [("spotify_id", source_id), ("isrc", code), ("musicbrainz_recording_id", mbid), ("alias", alias)]
    made = [F.when(F.trim(c) != "", F.struct(F.lit(n).alias("key_type"), F.lit(i).alias("prio"), c.alias("key"))) for i, (n, c) in enumerate(pairs)]
    return F.array_compact(F.array(*made))


def priority_lookup(rows: DataFrame, row_key: str, keys: str, lookup: DataFrame, parts: int | None = None) -> DataFrame:
    """(row_key, match_type, payload): the payload of the strongest key in lookup(key_type, key, payload); rows without one are left out.

    The lookup is what a task holds of the join, not the rows. parts: partitions in which rows meet again, if Spark's
    number of them would leave too many rows to a task.
    """
    each = rows.select(row_key, F.explode(keys).alias("k")).select(row_key, "k.*")
    found = each.join(lookup.hint("shuffle_hash"), ["key_type", "key"])
    found = found if parts is None else found.repartition(parts, row_key)
    return found.groupBy(row_key).agg(F.min_by("key_type", "prio").alias("match_type"), F.min_by("payload", "prio").alias("payload"))


def empty(c: Column, kind: str) -> Column:
    """What counts as missing: no elements, a blank text, or null."""
    return c.isNull() | (F.size(c) == 0 if kind.startswith("array") else F.trim(c) == "" if kind == "string" else F.lit(False))


def fill(df: DataFrame, payload: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """df with its missing columns from payload; `changed` tells whether any was."""
    kinds = dict(df.dtypes)
    other = payload.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = df.join(other, df[key] == F.col("__key"), "left")
    out = {c: F.when((F.lit(overwrite) | empty(df[c], kinds[c])) & ~empty(F.col(f"__{c}"), kinds[c]), F.col(f"__{c}")).otherwise(df[c]) for c in columns}
    changed = F.lit(False)
    for c, new in out.items():
        changed = changed | ~new.eqNullSafe(df[c])
    return joined.select(*(out.get(c, df[c]).alias(c) for c in df.columns), changed.alias("changed"))


def upsert(base: DataFrame, delta: DataFrame, key: str, fill_columns: list[str], longer_columns: list[str], order: str) -> DataFrame:
    """Base with a delta: new keys are added; missing columns filled; lists replaced by longer ones.

    Rows of one key in the delta are folded first: the first filled value, the longest list. Where the base
    has a key twice, its last row is updated and all are kept. Null keys are kept as they are. Blank texts are missing too.
    """
    kinds = dict(base.dtypes)
    folded = delta.groupBy(key).agg(
        *(F.min_by(c, F.when(~empty(F.col(c), kinds[c]), F.col(order))).alias(c) for c in fill_columns),
        *(F.max_by(c, F.struct(F.size(F.coalesce(c, F.array())), -F.col(order))).alias(c) for c in longer_columns),
        *(F.min_by(c, order).alias(c) for c in delta.columns if c not in {key, *fill_columns, *longer_columns}),
    )
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) == 1
    old = base.withColumn("__last", last).alias("b")
    joined = old.join(folded.alias("d"), (F.col(f"b.{key}") == F.col(f"d.{key}")) & F.col("__last"), "full_outer")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))

    def value(c: str) -> Column:
        b, d = F.col(f"b.{c}"), F.col(f"d.{c}")
        if c in longer_columns:
            return F.when(size(d) > F.greatest(size(b), F.lit(0)), d).otherwise(F.coalesce(b, d))
        return F.when(empty(b, kinds[c]), F.coalesce(d, b)).otherwise(b) if c in fill_columns else F.when(F.col("__last").isNotNull(), b).otherwise(d)

    return joined.select(*(value(c).alias(c) for c in base.columns))


def upsert_counts(base: DataFrame, delta: DataFrame, key: str, fill_columns: list[str], longer_columns: list[str], order: str) -> DataFrame:
    """(measure, n): base, delta, added, updated, total, and field:<column> for each column, of upsert().

    Rows of the delta are taken in order, one after another: each that fills a missing column, or brings a list longer than the
    record's, counts once for that column, and once as an update; the first of a new key is added. A key's rows are
    folded to the first of each length before they meet, so that a key of many rows is no task's. Order values of a key differ.
    """
    kinds, size = dict(base.dtypes), lambda c: F.coalesce(F.size(c), F.lit(0))
    lacks = lambda df, at: df.where(F.col(key).isNotNull()).groupBy(key).agg(at(F.struct(*(empty(F.col(c), kinds[c]).alias(c) for c in fill_columns), *(size(c).alias(c) for c in longer_columns)), F.col(order)).alias("start"))
    known = lacks(base, F.max_by).withColumn("since", F.lit(None).cast(delta.schema[order].dataType))
    came = lacks(delta, F.min_by).join(delta.groupBy(key).agg(F.min(order).alias("since")), key)
    state = stored(known.unionByName(came.join(known, key, "left_anti")), "starts")
    later = F.col("since").isNull() | (F.col("o") > F.col("since"))
    events = []
    for c in fill_columns:
        first = delta.where(~empty(F.col(c), kinds[c])).groupBy(key).agg(F.min(order).alias("o"))
        events.append(first.join(state, key).where(F.col(f"start.{c}") & later).select(key, F.lit(c).alias("field"), "o"))
    for c in longer_columns:
        first = delta.select(key, size(c).alias("n"), F.col(order).alias("o")).groupBy(key, "n").agg(F.min("o").alias("o")).join(state, key).where((F.col("n") > F.col(f"start.{c}")) & later)
        longer = F.min("o").over(Window.partitionBy(key).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
        events.append(first.withColumn("before", longer).where(F.col("before").isNull() | (F.col("o") < F.col("before"))).select(key, F.lit(c).alias("field"), "o"))
    spark = base.sparkSession
    every = stored(reduce(DataFrame.unionByName, events), "updates") if events else spark.createDataFrame([], f"`{key}` string, field string, o long")
    new = delta.where(F.col(key).isNull()).groupBy(key).count().select(key).unionByName(came.join(known, key, "left_anti").select(key)).agg(F.count("*").alias("n"))
    told = [base.agg(F.count("*").alias("n")).select(F.lit("base").alias("measure"), "n"), delta.agg(F.count("*").alias("n")).select(F.lit("delta").alias("measure"), "n"), new.select(F.lit("added").alias("measure"), "n"),
            every.agg(F.count_distinct(key, "o").alias("n")).select(F.lit("updated").alias("measure"), "n"), base.agg(F.count("*").alias("n")).join(F.broadcast(new.withColumnRenamed("n", "m"))).select(F.lit("total").alias("measure"), (F.col("n") + F.col("m")).alias("n"))]
    names = spark.createDataFrame([(c,) for c in [*fill_columns, *longer_columns]], "field string")
    fields = names.join(every.groupBy("field").agg(F.count("*").alias("n")), "field", "left").select(F.concat(F.lit("field:"), "field").alias("measure"), F.coalesce("n", F.lit(0)).alias("n"))
    return reduce(DataFrame.unionByName, told).unionByName(fields)


def needs_enrichment(mbid: Column, tags: Column, genres: Column, acoustic: Column) -> Column:
    return (F.coalesce(F.trim(mbid), F.lit("")) == "") | (F.coalesce(F.size(tags), F.lit(0)) <= 0) | (F.coalesce(F.size(genres), F.lit(0)) <= 0) | acoustic.isNull()


def sliced(df: DataFrame, qualifies: Column, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Qualifying rows from an offset on, so many of them."""
    out = df.where(qualifies).orderBy(order).offset(offset)
    return out if limit is None else out.limit(limit)


def by_isrc(rows: DataFrame, recordings: DataFrame, code: str = "isrc") -> DataFrame:
    """rows with mbid: the first recording (by ord) of their ISRC."""
    each = recordings.select(F.explode("isrcs").alias("c"), "mbid", "ord").select(isrc(F.col("c")).alias("__isrc"), "mbid", "ord").where("__isrc is not null")
    return rows.join(each.groupBy("__isrc").agg(F.min_by("mbid", "ord").alias("mbid")), isrc(F.col(code)) == F.col("__isrc"), "left").drop("__isrc")


def assembled_genres(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """(track_id, genres): genres of the track's artists in the artists' and their own order, each once; tracks without any are left out."""
    met = tracks.select("track_id", F.posexplode("artist_ids").alias("ap", "artist_id")).join(artists.select("artist_id", "genres"), "artist_id")
    each = met.select("track_id", "ap", F.posexplode("genres").alias("gp", "genre"))
    place = F.shiftleft(F.col("ap").cast("long"), 32).bitwiseOR(F.col("gp").cast("long"))  # one number, so that minima are kept by hash and not sorted
    first = each.groupBy("track_id", "genre").agg(F.min(place).alias("at"))
    return first.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "genre"))), lambda x: x["genre"]).alias("genres"))


def enriched_if_absent(tracks: DataFrame, by_code: DataFrame, genres: DataFrame) -> DataFrame:
    """tracks(id, isrc, brainz, ...) with what a track lacks: brainz of its trimmed upper-case ISRC from by_code(isrc, brainz), and genres(id, genres array<string>) as items of count 1.

    A track that has brainz keeps it; genres replace those held where the track's id has some. Of several payloads of
    one code the least by its JSON text is taken.
    """
    codes = by_code.select(isrc_trimmed(F.col("isrc")).alias("__code"), F.col("brainz").alias("__brainz")).where("__code is not null").groupBy("__code").agg(F.min_by("__brainz", F.to_json(F.struct("__brainz"))).alias("__brainz"))
    named = genres.select(F.col("id").alias("__id"), F.transform("genres", lambda g: F.struct(g.alias("name"), F.lit(1.0).alias("count"))).alias("__genres"))
    joined = tracks.join(codes, isrc_trimmed(F.col("isrc")) == F.col("__code"), "left").join(named, F.col("id") == F.col("__id"), "left")
    held = F.col("spotify_artist_genres") if "spotify_artist_genres" in tracks.columns else F.lit(None)
    kept = [tracks[c] for c in tracks.columns if c not in ("brainz", "spotify_artist_genres")]
    return joined.select(*kept, F.coalesce(tracks["brainz"], F.col("__brainz")).alias("brainz"), F.coalesce("__genres", held).alias("spotify_artist_genres"))


def attributes(rows: DataFrame, facts: DataFrame, key: str, numeric: list[str]) -> DataFrame:
    """rows with numeric facts by id; null where absent or not a number."""
    return rows.join(facts.select(key, *(F.col(c).try_cast("double").alias(c) for c in numeric)), key, "left")


def outcome_counts(df: DataFrame, match_type: str = "match_type", changed: str = "changed") -> DataFrame:
    """One row: records, changed ones, and hits by match type."""
    kinds = ["spotify_id", "isrc", "musicbrainz_recording_id", "alias"]
    return df.agg(F.count("*").alias("records"), F.count_if(changed).alias("changed"), *(F.count_if(F.col(match_type) == k).alias(f"hits_{k}") for k in kinds))
