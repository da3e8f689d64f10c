"""Terms that label groups of tracks, analysis payloads, and the quick clustering profile for one playlist's groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.names import ITEM
from chorale.functions.text import token
from chorale.operators import kmeans, route, vocab
from chorale.session import stored

# Terms that label nothing, whole or in part, and the longest term.
SKIPPED = ["rap_hip_hop", "hip_hop_rap", "hip_hop_underground_hip_hop", "contemporary_rap_gangsta_rap_hardcore_rap_rap_west_coast_rap"]
SKIPPED_PARTS = ["billboard", "hot_100", "chart", "offizielle", "wochen"]
LONGEST = 40


def labels_something(term: Column) -> Column:
    return (term != "") & (F.length(term) <= LONGEST) & ~term.isin(SKIPPED) & ~term.rlike("|".join(SKIPPED_PARTS))


def label_terms(tracks: DataFrame, key: str, *sources: str) -> DataFrame:
    """(key, term, shown): each term of a track's name/count columns once."""
    every = F.concat(*(F.coalesce(F.col(c).cast(ITEM), F.array().cast(ITEM)) for c in sources))
    terms = F.array_distinct(F.transform(every, lambda x: token(x["name"])))
    each = tracks.select(key, F.explode(terms).alias("term")).where(labels_something(F.col("term")))
    return each.withColumn("shown", F.replace("term", F.lit("_"), F.lit(" ")))


def analysis_payload(tracks: DataFrame) -> DataFrame:
    """What a remote analysis gets of a track: id, name, artists, a numeric year, genre names and tags."""
    names = F.filter(F.transform(F.coalesce(F.col("spotify_artist_genres").cast(ITEM), F.array().cast(ITEM)), lambda g: g["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return tracks.select(
        "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("artists", F.array().cast("array<string>")).alias("artists"),
        F.col("year").try_cast("int").alias("year"), names.alias("genres"), F.coalesce(F.col("tags").cast(ITEM), F.array().cast(ITEM)).alias("tags"),
    )


def quick_ks(n: Column) -> Column:
    """The one k of the quick profile, ceil(n / 15) from 2 to 16, but no more than a cluster for 15 rows and no fewer than two."""
    return F.array(_effective(F.least(F.lit(16), F.greatest(F.lit(2), F.ceil(n / 15))), n))


def _effective(k: Column, n: Column) -> Column:
    return F.least(k, F.greatest(F.lit(2), F.floor(n / 15))).cast("int")


def quick_split(labelled: DataFrame) -> DataFrame:
    """Labels once more for clusters above max(30, 0.35 of their playlist): max(3, ceil(size / 20)) parts, if the largest is below 0.9 of the cluster.

    labelled(playlist_id, track_key, embedding, cluster); new parts have numbers above the playlist's own.
    """
    n = labelled.groupBy("playlist_id").agg(F.count("*").alias("n"), F.max("cluster").alias("top"))
    sizes = labelled.groupBy("playlist_id", "cluster").agg(F.count("*").alias("size")).join(n, "playlist_id").where(F.col("size") > F.greatest(F.lit(30), 0.35 * F.col("n")))
    pseudo = F.concat_ws("\u0001", F.col("playlist_id").cast("string"), F.col("cluster").cast("string"))
    tried = labelled.join(sizes, ["playlist_id", "cluster"]).withColumn("parent", F.col("playlist_id")).withColumn("playlist_id", pseudo)
    tried = stored(tried, "tried")
    ks = tried.select("playlist_id", _effective(F.greatest(F.lit(3), F.ceil(F.col("size") / 20)), F.col("size")).alias("k")).distinct()
    parts = kmeans.clustered(tried.select("playlist_id", "track_key", "embedding"), ks, seeds=3).select("playlist_id", "track_key", F.col("cluster").alias("part"))
    parts = stored(parts.join(tried.select("playlist_id", "track_key", "parent", "cluster", "size", "top"), ["playlist_id", "track_key"]), "parts")
    largest = parts.groupBy("playlist_id", "part").agg(F.count("*").alias("m"), F.first("size").alias("size")).groupBy("playlist_id").agg(F.max("m").alias("m"), F.first("size").alias("size"))
    taken = parts.join(largest.where(F.col("m") < 0.9 * F.col("size")).select("playlist_id"), "playlist_id")
    number = F.dense_rank().over(Window.partitionBy("parent").orderBy("cluster", "part"))
    moved = taken.withColumn("new", F.col("top") + number).select(F.col("parent").alias("playlist_id"), "track_key", "new")
    return labelled.join(moved, ["playlist_id", "track_key"], "left").withColumn("cluster", F.coalesce("new", "cluster")).drop("new")


def quick_groups(points: DataFrame, terms: DataFrame, least: int = 5) -> DataFrame:
    """(playlist_id, cluster, display_group, label, size): clusters of one k a playlist, large ones split once, routed by their telling terms.

    points(playlist_id, track_key, embedding), terms(track_key, term). Clusters of fewer than `least` tracks and those
    that no rule routes are left out; further clusters of a group get a suffix.
    """
    counts = points.groupBy("playlist_id").agg(F.count("*").alias("n"))
    ks = counts.select("playlist_id", F.explode(quick_ks(F.col("n"))).alias("k"))
    first = kmeans.clustered(points.select("playlist_id", "track_key", "embedding"), ks, seeds=3).select("playlist_id", "track_key", "cluster")
    labelled = stored(quick_split(first.join(points.select("playlist_id", "track_key", "embedding"), ["playlist_id", "track_key"])).drop("embedding"), "quick")
    group = F.struct("playlist_id", "cluster").alias("g")
    telling = vocab.tfidf(labelled.join(terms, "track_key").select("track_key", group, "term"), "track_key", "g")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: F.replace(x["term"], F.lit("_"), F.lit(" ")))
    named = telling.groupBy("g").agg(shown.alias("terms")).select("g.playlist_id", "g.cluster", "terms")
    sized = labelled.groupBy("playlist_id", "cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least).join(named, ["playlist_id", "cluster"])
    routed = sized.withColumn("display_group", route.term_group(F.array_join("terms", " "))).where("display_group <> 'More Picks'")
    return routed.join(route.suffixed(routed), ["playlist_id", "cluster"]).select("playlist_id", "cluster", "display_group", "label", "size")
