"""Sparse features in long form (key, feature, value), the scaler and the projection on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.names import ITEM, canonical_tag, keeps_acoustic, keeps_tag, kept_tags, numeric_leaves
from chorale.functions.text import token
from chorale.session import stored


@dataclass(frozen=True)
class Weights:
    tag: float = 1.0
    genre: float = 0.7
    acoustic: float = 1.2
    year: float = 0.25
    popularity: float = 0.15
    present: float = 0.10


#: Acoustic features that may be filled in for a record.
MOST_MEANS = 10_000
#: Weights of the families after scaling (fixed values of the last training).
BLOCKS = {"tag": 1.0, "genre": 0.7, "acoustic": 1.2, "meta": 0.1}


def year_stats(df: DataFrame, year: str = "year") -> DataFrame:
    """One row (year_mean, year_std): of the population; 2000 and 1 without years, 1 for no spread."""
    spread = F.stddev_pop(year)
    return df.agg(F.coalesce(F.avg(year), F.lit(2000.0)).alias("year_mean"), F.when(spread > 1e-6, spread).otherwise(1.0).alias("year_std"))


def song_features(songs: DataFrame, key: str = "track_id", w: Weights | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(key, feature, value) of canonical records: seven meta features, tags, genres and acoustic measures.

    Counts enter as log1p, measures clipped to [-1, 1]; equal features of a record add up. `stats` are the
    training's year statistics; without them those of the records are taken. A record makes all its features at once,
    so that it is read once, and once for the statistics; measures are a part of their own.
    """
    w = w or Weights()
    none = F.array().cast("array<struct<feature:string,value:double>>")
    genres = F.concat(*(F.coalesce(c, F.array().cast(ITEM)) for c in ("brainz.genres", "spotify_artist_genres")))
    made = songs.select(key, "year", F.col("runtime_metadata.spotify_popularity").alias("popular"), *(F.coalesce(kept_tags(c), F.array().cast("array<struct<token:string,weight:double>>")).alias(n) for n, c in (("tags", F.col("brainz.tags")), ("genres", genres))))
    made = made.join(F.broadcast(year_stats(songs) if stats is None else stats))  # one row

    def one(feature: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(feature).alias("feature"), value.cast("double").alias("value")))

    def flag(name: str) -> Column:
        return one(f"meta__has_{name}", F.lit(w.present))

    def terms(c: str, prefix: str, weight: float) -> Column:
        return F.transform(c, lambda x: F.struct(F.concat(F.lit(prefix), x["token"]).alias("feature"), (F.log1p(x["weight"]) * weight).alias("value")))

    year = one("meta__year_z", (F.col("year") - F.col("year_mean")) / F.col("year_std") * w.year)
    popular = one("meta__popularity_scaled", F.col("popular") / 100 * w.popularity)
    each = F.concat(
        terms("tags", "tag__", w.tag), terms("genres", "genre__", w.genre), F.when(F.size("tags") > 0, flag("tags")).otherwise(none), F.when(F.size("genres") > 0, flag("genres")).otherwise(none),
        F.when(F.col("year").isNotNull(), F.concat(flag("year"), year)).otherwise(none), F.when(F.col("popular").isNotNull(), F.concat(flag("popularity"), popular)).otherwise(none),
    )
    measured = songs.where("brainz.acoustic_high_level is not null").select(key, F.col("brainz.acoustic_high_level").alias("j"))
    leaves = numeric_leaves(measured, key, "j").where(keeps_acoustic(F.col("path")))
    clipped = F.greatest(F.least("value", F.lit(1.0)), F.lit(-1.0)) * w.acoustic
    leaf = F.concat(F.array(F.struct(F.concat(F.lit("acoustic__"), "path").alias("feature"), clipped.alias("value"))), flag("acoustic_high_level"))
    out = made.select(key, F.inline(each)).unionByName(leaves.select(key, F.inline(leaf)))
    return out.groupBy(key, "feature").agg(F.when(F.col("feature").startswith("meta__has_"), F.max("value")).otherwise(F.sum("value")).alias("value"))


def browser_features(tracks: DataFrame, key: str, year_mean: float, year_std: float, w: Weights | None = None) -> DataFrame:
    """The browser's profile of song_features(): tracks(key, year, popularity, tags, genres, acoustic JSON) with the training's year statistics.

    Has-flags are set before terms are filtered; genres are tokens as they are; of the acoustic payload only `all` leaves of
    its classifiers count, under highlevel if it has that; the last of equal names wins.
    """
    w = w or Weights()
    flag = lambda d, name: d.select(key, F.lit(f"meta__has_{name}").alias("feature"), F.lit(w.present).alias("value"))
    one = lambda c, name, value: tracks.where(c).select(key, F.lit(name).alias("feature"), value.alias("value"))
    item = lambda c: F.coalesce(F.col(c).cast(ITEM), F.array().cast(ITEM))
    year, popular = F.col("year") > 0, F.col("popularity").isNotNull()
    tags = tracks.select(key, F.explode(item("tags")).alias("x")).select(key, token(F.col("x.name")).alias("t"), F.coalesce("x.count", F.lit(1.0)).alias("n"))
    genres = tracks.select(key, F.explode(item("genres")).alias("x")).select(key, token(F.col("x.name")).alias("t"), F.coalesce("x.count", F.lit(1.0)).alias("n"))
    weight = lambda d, prefix, term, rate: d.groupBy(key, F.concat(F.lit(prefix), term).alias("feature")).agg((F.sum(F.log1p(F.greatest("n", F.lit(0.0)))) * rate).alias("value"))
    payload = tracks.select(key, F.try_parse_json("acoustic").alias("v")).select(key, F.coalesce(F.try_variant_get("v", "$.highlevel", "variant"), "v").alias("v"))
    payload = payload.where(F.schema_of_variant("v").startswith("OBJECT"))
    classes = tracks.sparkSession.sql(
        "SELECT {key}, c.key AS clf, l.key AS cls, l.value AS p FROM {payload}, LATERAL variant_explode(v) AS c, LATERAL variant_explode(try_variant_get(c.value, '$.all', 'variant')) AS l".replace("{key}", key),
        payload=payload,
    )
    number = classes.where(F.schema_of_variant("p").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).select(key, F.concat(F.lit("acoustic__highlevel__"), "clf", F.lit("__all__"), "cls").alias("feature"), F.try_variant_get("p", "$", "double").alias("p"))
    acoustic = number.where(keeps_acoustic(F.col("feature"))).select(key, "feature", (F.greatest(F.least("p", F.lit(1.0)), F.lit(-1.0)) * w.acoustic).alias("value"))
    parts = [
        one(year, "meta__has_year", F.lit(w.present)), one(year, "meta__year_z", (F.col("year") - year_mean) / year_std * w.year),
        one(popular, "meta__has_popularity", F.lit(w.present)), one(popular, "meta__popularity_scaled", F.col("popularity") / 100 * w.popularity),
        flag(tracks.where(F.size(item("tags")) > 0), "tags"), flag(tracks.where(F.size(item("genres")) > 0), "genres"), flag(payload, "acoustic_high_level"),
        weight(tags.where((F.col("t") != "") & keeps_tag(F.col("t"))), "tag__", canonical_tag(F.col("t")), w.tag), weight(genres.where("t <> ''"), "genre__", F.col("t"), w.genre), acoustic,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_acoustic(features: DataFrame, keys: DataFrame, means: DataFrame, key: str = "track_id") -> DataFrame:
    """Records without any acoustic feature get the training means(feature, value) of all, which are as many as a vocabulary has at most."""
    if means.limit(MOST_MEANS + 1).count() > MOST_MEANS:
        raise ValueError(f"more than {MOST_MEANS} acoustic features")
    features = stored(features, "features")
    have = features.where(F.col("feature").startswith("acoustic__")).select(key).distinct()
    lacking = keys.select(key).join(have, key, "left_anti")
    return features.unionByName(lacking.join(F.broadcast(means)).select(key, "feature", "value"))  # means: a vocabulary's rows


def legacy_features(tracks: DataFrame, key: str, numeric: list[str], classes: str) -> DataFrame:
    """Older profile: numbers with has-flags, and ab__classifier__class from a map<classifier, map<class, probability>>."""
    numbers = tracks.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).try_cast("double").alias("value")) for n in numeric))).alias("x")).select(key, "x.*").where("value is not null")
    flags = numbers.select(key, F.concat(F.lit("has_"), "feature").alias("feature"), F.lit(1.0).alias("value"))
    ab = tracks.select(key, F.explode(classes).alias("c", "m")).select(key, "c", F.explode("m").alias("k", "value"))
    ab = ab.select(key, F.concat_ws("__", F.lit("ab"), "c", "k").alias("feature"), "value")
    return numbers.unionByName(flags).unionByName(ab).unionByName(ab.select(key, F.lit("has_ab").alias("feature"), F.lit(1.0).alias("value")).distinct())


def matrix_report(features: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row (rows, nonzero_rows, columns); the features are made once for both counts."""
    told = features.agg(F.count_distinct(F.when(F.col("value") != 0, F.col(key))).alias("nonzero_rows"), F.count_distinct("feature").alias("columns"))
    return rows.agg(F.count_distinct(key).alias("rows")).join(F.broadcast(told))  # one row each


def scaler_stats(features: DataFrame, n: int) -> DataFrame:
    """(feature, mean, scale) over n records, of which those without a row have 0: population deviation, 1 if below 1e-8."""
    mean = F.sum("value") / n
    spread = F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0)))
    return features.groupBy("feature").agg(mean.alias("mean"), F.when(spread < 1e-8, 1.0).otherwise(spread).alias("scale"))


def scaled(features: DataFrame, stats: DataFrame, with_mean: bool = True) -> DataFrame:
    """Rows that are stored; a missing row scales to -mean / scale, which project() takes into account."""
    value = (F.col("value") - (F.col("mean") if with_mean else 0)) / F.col("scale")
    return features.join(stats, "feature").select(*(c for c in features.columns if c != "value"), value.alias("value"))


def block_weight(feature: Column, blocks: dict[str, float] | None = None) -> Column:
    blocks = BLOCKS if blocks is None else blocks
    known = F.create_map(*(x for k, v in blocks.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(known, F.split_part(feature, F.lit("__"), F.lit(1))), F.lit(1.0))


def project(features: DataFrame, stats: DataFrame, components: DataFrame, key: str, weighted: bool = True) -> DataFrame:
    """(key, k, value): ((x - mean) / scale * weight - centre) on each component(k, feature, weight, centre).

    The part that a record of zeros would have is added once for each component, so records stay sparse.
    """
    w = block_weight(F.col("feature")) if weighted else F.lit(1.0)
    loaded = components.join(stats, "feature").withColumn("w", w)
    per_unit = loaded.select("k", "feature", (F.col("w") * F.col("weight") / F.col("scale")).alias("unit"))
    base = loaded.groupBy("k").agg(F.sum((-F.col("mean") / F.col("scale") * F.col("w") - F.col("centre")) * F.col("weight")).alias("base"))
    moved = features.join(per_unit, "feature").groupBy(key, "k").agg(F.sum(F.col("value") * F.col("unit")).alias("moved"))
    every = features.select(key).distinct().join(F.broadcast(base))  # a row for each component
    return every.join(moved, [key, "k"], "left").select(key, "k", (F.col("base") + F.coalesce("moved", F.lit(0.0))).alias("value"))


def vectors(features: DataFrame, vocabulary: DataFrame, key: str, size: int) -> DataFrame:
    """(key, features): dense vectors for Spark ML, without a UDF; vocabulary(feature, idx)."""
    cells = features.join(vocabulary, "feature").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return cells.select(key, array_to_vector(dense).alias("features"))


def fit_pca(vectors: DataFrame, requested: int = 32):
    """A PCA model of min(requested, rows, columns) components; None if that reduces nothing."""
    first = vectors.select("features").first()
    if first is None:
        return None
    n, width = vectors.limit(requested + 1).count(), len(first["features"])
    k = min(requested, n, width)
    return PCA(k=k, inputCol="features", outputCol="embedding").fit(vectors) if k < width else None


def components_table(model, vocabulary: DataFrame, spark) -> DataFrame:
    """(k, feature, weight) of a fitted PCA: columns x components numbers, bounded by the vocabulary."""
    weights = model.pc.toArray()
    rows = spark.createDataFrame([(i, k, float(v)) for i, row in enumerate(weights) for k, v in enumerate(row)], "idx int, k int, weight double")
    return rows.join(vocabulary, "idx").select("k", "feature", "weight")


def checked_components(components: DataFrame, stats: DataFrame) -> DataFrame:
    """Components as they are; an error where a feature has no statistics or a component lacks features."""
    lost = components.join(stats, "feature", "left_anti").limit(1).count()
    uneven = components.groupBy("k").count().agg(F.count_distinct("count").alias("n")).first()["n"]
    if lost or (uneven or 0) > 1:
        raise ValueError("representation: features without statistics" if lost else "representation: components of unequal length")
    return components
