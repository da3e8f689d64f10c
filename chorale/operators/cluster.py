"""Clustering: corpora and many playlists at once, by k-means over blocks of points.

Every playlist, every candidate k and every restart runs in the same job. Points have an array `embedding`. Labels are numbered by their centres' order and mean nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.operators import kmeans
from chorale.operators.route import MIXED, cluster_names
from chorale.session import stored

#: Rows of a block, about, of which a silhouette measures two against each other in a task; blocks grow beyond it where a
#: group would have more than MOST_BLOCKS, until they hold BLOCK_NUMBERS (32 MB; of coordinates, or of sums by cluster).
BLOCK_ROWS, MOST_BLOCKS, BLOCK_NUMBERS = 2000, 6, 1 << 22
#: The same where labellings are measured together: some more blocks, so that their pairs spread evenly.
MOST_TOGETHER = 12
#: Points of each side whose distances are made at once there.
TOGETHER_TILE = 256
# Limits of the penalties of a solution and of the split of a cluster.
MIN_SPLIT, LARGE_SHARE, LOW_SIGNAL_SIZE, LOW_FEATURES, LOW_SCORE, CHILD_GAIN, MOST_OF_A_PART, LEAST_ADJUSTED = 24, 0.28, 18, 2, 0.35, 0.08, 0.78, 0.02


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


# -- the whole corpus ------------------------------------------------------------------------------------------------


def sweep(vectors: DataFrame, ks: range = range(4, 11), seeds: int = 20, features: str = "features", key: str = "track_key") -> list[dict]:
    """For each k the best of some restarts: inertia, squared-Euclidean silhouette and labels(key, cluster); invalid k are passed over."""
    n, spark = vectors.count(), vectors.sparkSession
    tried = [k for k in ks if 2 <= k < n]
    if not tried:
        return []
    points = vectors.select(F.lit("all").alias("playlist_id"), F.col(key).alias("track_key"), vector_to_array(features).alias("embedding"))
    labels = stored(kmeans.clustered(points, spark.createDataFrame([("all", k) for k in tried], "playlist_id string, k int"), seeds), "sweep")
    told = {r["k"]: r for r in labels.groupBy("k").agg(F.first("inertia").alias("inertia"), F.countDistinct("cluster").alias("clusters")).collect()}
    judge, out = ClusteringEvaluator(featuresCol=features), []
    for k in tried:
        own = labels.where(F.col("k") == k).select(F.col("track_key").alias(key), "cluster")
        if told[k]["clusters"] > 1:
            judged = vectors.select(key, features).join(own, key).withColumn("prediction", F.col("cluster").cast("double"))
            out.append({"k": k, "inertia": told[k]["inertia"], "silhouette": judge.evaluate(judged), "labels": own})
    return out


def best_k(found: list[dict]) -> dict | None:
    """The greatest silhouette; of equals the lower inertia."""
    return min(found, key=lambda r: (-r["silhouette"], r["inertia"]), default=None)


# -- many playlists --------------------------------------------------------------------------------------------------


def candidate_ks(n: Column, min_k: int = 2, max_k: int = 12, min_size: int = 8) -> Column:
    """Array of the numbers of clusters to try for n rows."""
    lower = F.greatest(F.lit(2), F.lit(min_k), F.when(n >= 250, 5).when(n >= 120, 4).when(n >= 40, 3).otherwise(2))
    most = F.least(F.lit(max_k), n - 1)
    upper = F.least(most, F.greatest(F.lit(2), F.floor(n / max(1, min_size)))).cast("int")
    low, high = F.when(upper < lower, F.least(lower, most)).otherwise(lower).cast("int"), F.when(upper < lower, most).otherwise(upper).cast("int")
    return F.when((n < 2) | (high < 2), F.array().cast("array<int>")).otherwise(F.sequence(low, high))


def means(df: DataFrame, by: list[str], vector: str, name: str) -> DataFrame:
    """The mean array of each group, by dimension."""
    each = df.select(*by, F.posexplode(vector).alias("i", "v")).groupBy(*by, "i").agg(F.avg("v").alias("m"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias(name))


def nearest(points: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    """(by, track_key, cluster, distance): the nearest of the group's centres(by, cluster, centre); ties to the lower number."""
    near = points.join(centres, by).withColumn("d", distance(F.col("embedding"), F.col("centre")))
    return near.groupBy(*by, "track_key").agg(F.min(F.struct("d", "cluster")).alias("x")).select(*by, "track_key", F.col("x.cluster").alias("cluster"), F.col("x.d").alias("distance"))


def merged_small(points: DataFrame, by: list[str], min_size: int) -> DataFrame:
    """Labelled points(by, track_key, embedding, cluster): small clusters go, smallest first, to the nearest large one.

    Each round merges one cluster of every group at once and moves the receivers' centres.
    """
    while True:
        sizes = points.groupBy(*by, "cluster").agg(F.count("*").alias("size"))
        small = sizes.where(F.col("size") < min_size).groupBy(*by).agg(F.min(F.struct("size", "cluster")).alias("x")).select(*by, F.col("x.cluster").alias("small"))
        large = sizes.where(F.col("size") >= min_size)
        centres = means(points, [*by, "cluster"], "embedding", "centre")
        lost = small.join(centres.withColumnRenamed("cluster", "small").withColumnRenamed("centre", "at"), [*by, "small"])
        options = lost.join(large.join(centres, [*by, "cluster"]), by).withColumn("d", distance(F.col("at"), F.col("centre")))
        move = stored(options.groupBy(*by, "small").agg(F.min(F.struct("d", "cluster")).alias("x")).select(*by, F.col("small").alias("cluster"), F.col("x.cluster").alias("to")), "moves")
        if not move.limit(1).count():
            return contiguous(points, by)
        points = stored(points.join(move, [*by, "cluster"], "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to"), "labels")


def silhouette(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, silhouette): mean Euclidean silhouette of labelled points; a cluster of one scores 0, a group of one cluster null.

    Exact for every size: each two blocks of a group's points meet once, and send the sums of distances for each (point,
    cluster of the other block) on, both ways. A point is sent once for each block of its group.
    """
    points = points.select(*by, "track_key", "cluster", "embedding")
    dealt = points.join(_blocks(points, by), by).withColumn("__block", F.pmod(F.xxhash64("track_key"), F.col("__blocks")))
    own = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    asked = own.where("__block <= __other").select(*by, F.col("__block").alias("__a"), F.col("__other").alias("__b"), "track_key", "cluster", "embedding")
    met = own.where("__other < __block").select(F.col("__other").alias("__a"), F.col("__block").alias("__b"), *(F.col(c).alias(c) for c in points.columns))
    key = [*by, "__a", "__b"]
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "track_key", "cluster"]), f"__cluster {kinds['cluster']}", "total double", "n long"])
    sums = asked.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(_distance_sums(by), schema)
    mean = sums.groupBy(*by, "track_key", "cluster", "__cluster").agg((F.sum("total") / F.sum("n")).alias("m"))
    ab = mean.groupBy(*by, "track_key").agg(F.max(F.when(F.col("cluster") == F.col("__cluster"), F.col("m"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("__cluster"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() & F.col("b").isNotNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.groupBy(*by).agg(F.avg(F.when(F.col("b").isNotNull(), F.coalesce(s, F.lit(0.0)))).alias("silhouette"))


def _blocks(points: DataFrame, by: list[str]) -> DataFrame:
    rows = BLOCK_NUMBERS / F.greatest(F.max(F.size("embedding")), F.count_distinct("cluster"), F.lit(1))
    return points.groupBy(*by).agg(F.greatest(F.least(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(MOST_BLOCKS)), F.ceil(F.count("*") / rows)).cast("long").alias("__blocks"))


def _distance_sums(by: list[str], tile: int = 1024):
    """Of each point of one block and each cluster of the other, both ways: the sum of distances to its points but the point itself, and their number.

    A block that meets itself comes alone. Equal keys are in one block.
    """

    def sums(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        alone = key[-2].as_py() == key[-1].as_py()
        two = one if alone else two
        a, b = _Block(one), _Block(two)
        forth, back = np.zeros((len(a.at), len(b.first))), np.zeros((len(b.at), len(a.first)))
        n_forth, n_back = np.tile(b.member.sum(0), (len(a.at), 1)), np.tile(a.member.sum(0), (len(b.at), 1))
        keys = np.unique(one["track_key"].to_numpy(), return_inverse=True)[1] if alone else None
        for i in range(0, len(a.at), tile):
            x = a.at[i : i + tile]
            for j in range(0, len(b.at), tile):
                y = b.at[j : j + tile]
                d = x @ y.T
                d *= -2
                d += a.square[i : i + tile, None]
                d += b.square[j : j + tile]
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if alone:
                    same = keys[i : i + tile, None] == keys[j : j + tile]
                    if same.any():
                        d[same] = 0
                        n_forth[i : i + tile] -= same @ b.member[j : j + tile]
                else:
                    back[j : j + tile] += d.T @ a.member[i : i + tile]
                forth[i : i + tile] += d @ b.member[j : j + tile]
        out = [_told(one, two, b.first, forth, n_forth, by)]
        return pa.concat_tables(out if alone else [*out, _told(two, one, a.first, back, n_back, by)])

    return sums


class _Block:
    """Coordinates, their squares, and which cluster each row is of; `first` has a row of each cluster."""

    def __init__(self, t: pa.Table):
        self.at = t["embedding"].combine_chunks().flatten().to_numpy().astype(float, copy=False).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))
        self.square = (self.at * self.at).sum(1)
        self.first, label = np.unique(t["cluster"].to_numpy(), return_index=True, return_inverse=True)[1:]
        self.member = (label[:, None] == np.arange(len(self.first))).astype(float)


def _told(own: pa.Table, other: pa.Table, first: np.ndarray, total: np.ndarray, n: np.ndarray, by: list[str]) -> pa.Table:
    i, j = np.nonzero(n)
    columns = {c: own[c].take(pa.array(i)) for c in [*by, "track_key", "cluster"]} | {"__cluster": other["cluster"].take(pa.array(first[j], pa.int64()))}
    return pa.table(columns | {"total": pa.array(total[i, j]), "n": pa.array(n[i, j].astype(int))})


def silhouettes(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(playlist_id, k, silhouette): silhouette() of every labelling(playlist_id, k, track_key, cluster) of the points at once; none for one of one cluster.

    Keys are unique in a playlist, and its labellings cover it. Two blocks meet once for all labellings: each distance is made
    once, and added up by the clusters of all of them. Sums of a point meet again in parts of a block, which judge it.
    """
    ids = {f.name: f.dataType.simpleString() for f in points.schema}
    each = labels.groupBy("playlist_id", "k", "cluster").agg(F.count("*").alias("n")).groupBy("playlist_id", "k").agg(F.array_sort(F.collect_list(F.struct("cluster", "n"))).alias("x"))
    each = each.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("x.n").alias("n")))).alias("x")).select("playlist_id", F.col("x.k").alias("ks"), F.col("x.n").alias("sizes"))
    own = labels.groupBy("playlist_id", "track_key").agg(F.array_sort(F.collect_list(F.struct("k", "cluster"))).alias("x")).select("playlist_id", "track_key", F.col("x.cluster").cast("array<int>").alias("own"))
    width = F.size(F.flatten("sizes"))
    rows = BLOCK_NUMBERS / F.greatest(F.max(F.size("embedding")), F.first(width))
    count = F.greatest(F.least(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(MOST_TOGETHER)), F.ceil(F.count("*") / rows)).cast("long")
    facts = stored(points.join(each, "playlist_id").groupBy("playlist_id").agg(count.alias("__blocks"), F.first("ks").alias("ks"), F.first("sizes").alias("sizes")), "facts")
    wide = points.join(own, ["playlist_id", "track_key"]).join(facts.select("playlist_id", "__blocks", F.transform("sizes", lambda n: F.size(n)).alias("widths")), "playlist_id")
    dealt = wide.withColumn("__block", F.pmod(F.xxhash64("track_key"), F.col("__blocks"))).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    held = ["track_key", "own", "widths", "embedding"]
    asked = dealt.where("__block <= __other").select("playlist_id", "__blocks", F.col("__block").alias("__a"), F.col("__other").alias("__b"), *held)
    met = dealt.where("__other < __block").select(F.col("__other").alias("__a"), F.col("__block").alias("__b"), *(F.col(c).alias(c) for c in ("playlist_id", "__blocks", *held)))
    key = ["playlist_id", "__blocks", "__a", "__b"]
    sums = asked.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(_sums_together, f"playlist_id {ids['playlist_id']}, __blocks long, __block long, track_key {ids['track_key']}, own array<int>, totals array<double>")
    sums = sums.withColumn("__part", F.pmod(F.xxhash64("track_key", F.lit("part")), F.col("__blocks")))
    places = F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)
    told = facts.select(F.col("playlist_id").alias("playlist_id"), "ks", "sizes", "__blocks", F.explode(places).alias("__block")).withColumn("__part", F.explode(places))
    by = ["playlist_id", "__block", "__part"]
    judged = sums.groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(_judged, f"playlist_id {ids['playlist_id']}, k int, s double, n long")
    return judged.groupBy("playlist_id", "k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def _sums_together(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
    """Of each point of one block and each cluster of every labelling: the sum of distances to its points in the other block, both ways."""
    alone, tile = key[-2].as_py() == key[-1].as_py(), TOGETHER_TILE
    a = _Labelled(one, tile)
    b = a if alone else _Labelled(two, tile)
    forth = np.zeros((len(a.at), a.width))
    back = forth if alone else np.zeros((len(b.at), a.width))
    for i, (at_i, present_i, member_i) in enumerate(a.tiles):
        x = a.at[at_i : at_i + tile]
        x = np.hstack([-2 * x, (x * x).sum(1, keepdims=True), np.ones((len(x), 1))])
        for at_j, present_j, member_j in b.tiles[i if alone else 0 :]:
            d = x @ b.beside[at_j : at_j + tile].T
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            if alone and at_i == at_j:
                np.fill_diagonal(d, 0)
            else:
                back[at_j : at_j + tile, present_i] += d.T @ member_i
            forth[at_i : at_i + tile, present_j] += d @ member_j
    out = [_totals(key, key[-2], one, a, forth)]
    return pa.concat_tables(out if alone else [*out, _totals(key, key[-1], two, b, back)])


class _Labelled:
    """A block's coordinates in the order of its labels, and for each tile of them the clusters present and which row is of which."""

    def __init__(self, t: pa.Table, tile: int):
        rows = t.num_rows
        own = t["own"].combine_chunks().flatten().to_numpy().reshape(rows, -1) if rows else np.zeros((0, 0), int)
        widths = np.array(t["widths"][0].as_py()) if rows else np.zeros(0, int)
        self.width, self.order = int(widths.sum()), np.lexsort(own.T[::-1]) if rows else np.zeros(0, int)
        place = (own + (np.cumsum(widths) - widths))[self.order]
        at = t["embedding"].combine_chunks().flatten().to_numpy().astype(float, copy=False).reshape(rows, -1) if rows else np.zeros((0, 0))
        self.at, self.tiles = at[self.order], []
        self.beside = np.hstack([self.at, np.ones((rows, 1)), (self.at * self.at).sum(1, keepdims=True)])
        for i in range(0, rows, tile):
            present, column = np.unique(place[i : i + tile], return_inverse=True)
            if 2 * len(present) > self.width:  # all columns are added sooner than many
                present, column = slice(None), place[i : i + tile]
            member = np.zeros((len(place[i : i + tile]), self.width if isinstance(present, slice) else len(present)))
            member[np.arange(len(member))[:, None], column.reshape(len(member), -1)] = 1
            self.tiles.append((i, present, member))


def _totals(key: tuple, block: pa.Scalar, t: pa.Table, side: _Labelled, totals: np.ndarray) -> pa.Table:
    told = t.take(pa.array(side.order)).select(["playlist_id", "track_key", "own"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(totals) + 1) * side.width, pa.int32()), pa.array(totals.ravel()))
    constant = lambda x: pa.array(np.full(len(totals), x.as_py(), np.int64))
    return pa.table({"playlist_id": told["playlist_id"], "__blocks": constant(key[1]), "__block": constant(block), "track_key": told["track_key"], "own": told["own"], "totals": lists})


def _judged(key: tuple, t: pa.Table, facts: pa.Table) -> pa.Table:
    """(playlist_id, k, sum of silhouettes, points) of some points with all their sums, for each labelling of some clusters."""
    rows, out = t.num_rows, []
    if rows:
        _, first, place = np.unique(t["track_key"].combine_chunks().dictionary_encode().indices.to_numpy(), return_index=True, return_inverse=True)
        totals, order = t["totals"].combine_chunks().flatten().to_numpy().reshape(rows, -1), np.argsort(place, kind="stable")
        total = np.add.reduceat(totals[order], np.flatnonzero(np.diff(place[order], prepend=-1)), axis=0)
        own, each, begin = t["own"].combine_chunks().flatten().to_numpy().reshape(rows, -1)[first], np.arange(len(first)), 0
        for i, (k, sizes) in enumerate(zip(facts["ks"][0].as_py(), facts["sizes"][0].as_py(), strict=True)):
            n, some, mine = np.array(sizes), total[:, begin : begin + len(sizes)], own[:, i]
            begin += len(sizes)
            if len(sizes) > 1:
                mean = some / n
                mean[each, mine] = np.inf
                a, b = some[each, mine] / np.maximum(n[mine] - 1, 1), mean.min(1)
                most = np.maximum(a, b)
                s = np.where((n[mine] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0)
                out.append((k, float(s.sum()), len(s)))
    ks, s, n = zip(*out, strict=True) if out else ((), (), ())
    name = pa.array([key[0].as_py()] * len(out), key[0].type)
    return pa.table({"playlist_id": name, "k": pa.array(ks, pa.int32()), "s": pa.array(s, pa.float64()), "n": pa.array(n, pa.int64())})


def adjusted_score(silhouettes: DataFrame, points: DataFrame, by: list[str], min_size: int) -> DataFrame:
    """(by, silhouette, adjusted, largest, second, small_clusters, small_items, meaningful) of labelled points."""
    sizes = points.groupBy(*by, "cluster").agg(F.count("*").alias("size")).groupBy(*by).agg(F.sort_array(F.collect_list("size"), asc=False).alias("sizes"), F.sum("size").alias("n"))
    small = F.filter("sizes", lambda s: s < min_size)
    facts = sizes.select(
        *by, (F.get("sizes", F.lit(0)) / F.col("n")).alias("largest"), F.coalesce(F.get("sizes", F.lit(1)) / F.col("n"), F.lit(0.0)).alias("second"), F.size(small).alias("small_clusters"),
        F.aggregate(small, F.lit(0).cast("long"), lambda a, x: a + x).alias("small_items"), (F.size("sizes") - F.size(small)).alias("meaningful"),
    )
    over = lambda c, limit, rate: F.greatest(F.col(c) - limit, F.lit(0.0)) * rate
    penalty = over("largest", 0.55, 2.2) + over("largest", 0.70, 2.5) + over("largest", 0.85, 4.0) + F.greatest(0.10 - F.col("second"), F.lit(0.0)) * 0.8 + 0.05 * F.col("small_clusters") + 0.01 * F.col("small_items")
    reward = F.when(F.col("meaningful") >= 3, F.least(F.lit(0.06), 0.02 * (F.col("meaningful") - 2))).otherwise(0.0)
    return facts.join(silhouettes, by, "left").withColumn("adjusted", F.coalesce("silhouette", F.lit(-1.0)) - penalty + reward)


def cluster_playlists(points: DataFrame, min_k: int = 2, max_k: int = 12, min_size: int = 8, seeds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(labels, solutions): for each playlist the candidate with the best adjusted score, the lowest k of equals; small clusters are merged before scoring.

    A playlist with no candidate (fewer than two rows) is one cluster.
    """
    points = points.select("playlist_id", "track_key", "embedding")
    counts = points.groupBy("playlist_id").agg(F.count("*").alias("n"))
    ks = counts.select("playlist_id", F.explode(candidate_ks(F.col("n"), min_k, max_k, min_size)).alias("k"))
    by = ["playlist_id", "k"]
    labels = stored(kmeans.clustered(points, ks, seeds).select(*by, "track_key", "cluster"), "found")
    at = lambda df: df.join(points, ["playlist_id", "track_key"])
    if points.groupBy("playlist_id", "track_key").count().where("count > 1").limit(1).count():
        held = merged = stored(merged_small(at(labels), by, min_size), "merged")
        each = silhouette(merged, by)
    else:
        small = stored(labels.groupBy(*by, "cluster").count().where(F.col("count") < min_size).select(*by).distinct(), "small")
        merged = contiguous(labels.join(small, by, "left_anti"), by).select(*labels.columns)
        if small.limit(1).count():
            merged = merged.unionByName(merged_small(at(labels.join(small, by, "left_semi")), by, min_size).select(*labels.columns))
        merged = stored(merged, "merged")
        held, each = at(merged), silhouettes(points, merged)
    solutions = stored(adjusted_score(each, merged, by, min_size), "solutions")
    best = solutions.groupBy("playlist_id").agg(F.max(F.struct("adjusted", (-F.col("k")).alias("k"))).alias("x")).select("playlist_id", (-F.col("x.k")).alias("k"))
    chosen = held.join(best, by).select("playlist_id", "track_key", "embedding", "cluster")
    alone = points.join(best, "playlist_id", "left_anti").withColumn("cluster", F.lit(0))
    return chosen.unionByName(alone.select(*chosen.columns)), solutions.join(best, by)


def sampled_silhouette(points: DataFrame, by: list[str], most: int = 1500, least: int = 50) -> DataFrame:
    """silhouette() of the `most` points of each group that come first by a hash of their keys; groups of fewer than `least` points have none."""
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("track_key"), "track_key"))
    some = points.withColumn("__n", order).where(F.col("__n") <= most).drop("__n")
    enough = some.groupBy(*by).agg(F.count("*").alias("__m")).where(F.col("__m") >= least).select(*by)
    return silhouette(some.join(enough, by, "left_semi"), by)


def signals(features: DataFrame, labelled: DataFrame, by: list[str]) -> DataFrame:
    """(by, cluster, name, n_features, top_score, mixed): what the clusters' greatest features say; a cluster without any is mixed."""
    named = cluster_names(top_features(features, labelled, by), [*by, "cluster"])
    every = labelled.select(*by, "cluster").distinct().join(named, [*by, "cluster"], "left")
    return every.select(*by, "cluster", F.coalesce("name", F.lit(MIXED)).alias("name"), F.coalesce("n_features", F.lit(0)).alias("n_features"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("mixed", F.lit(True)).alias("mixed"))


def strong_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(playlist_id, strong): clusters of each split with a name, enough features and a top score that gains on the parent's.

    children: signals() of the parts; parents(playlist_id, parent_score).
    """
    bar = F.greatest(F.lit(LOW_SCORE), F.col("parent_score") + CHILD_GAIN)
    good = ~F.col("mixed") & (F.col("n_features") >= LOW_FEATURES) & (F.col("top_score") >= bar)
    return children.join(parents.select("playlist_id", "parent_score"), "playlist_id").groupBy("playlist_id").agg(F.count_if(good).alias("strong"))


def split_oversized(labelled: DataFrame, features: DataFrame, rounds: int = 2, min_size: int = 8, min_k: int = 2, max_k: int = 8) -> tuple[DataFrame, DataFrame | None]:
    """(labels, decisions): clusters that are too large or say too little are clustered again, for some rounds.

    labelled(playlist_id, track_key, embedding, cluster), features(track_key, feature, value). A cluster is tried when it has at
    least max(24, ceil(0.28 n)) rows, or has at least max(18, 2 min_size) and a low signal (mixed name, fewer than two features,
    or a top score below 0.35). A split is accepted if it has two meaningful parts, the largest of at most 0.78, and an
    adjusted score of at least 0.02 or, under a low signal, two strong children. In a round the largest cluster whose split
    is accepted is split in each playlist: its largest part keeps the number. The decisions end with it, the largest cluster first.
    """
    decisions = None
    for r in range(rounds):
        n = labelled.groupBy("playlist_id").agg(F.count("*").alias("n"))
        sizes = labelled.groupBy("playlist_id", "cluster").agg(F.count("*").alias("size")).join(n, "playlist_id").join(signals(features, labelled, ["playlist_id"]), ["playlist_id", "cluster"])
        low = (F.col("size") >= max(LOW_SIGNAL_SIZE, 2 * min_size)) & (F.col("mixed") | (F.col("n_features") < LOW_FEATURES) | (F.col("top_score") < LOW_SCORE))
        large = F.col("size") >= F.greatest(F.lit(MIN_SPLIT), F.ceil(LARGE_SHARE * F.col("n")))
        pseudo = F.concat_ws("\u0001", F.col("playlist_id").cast("string"), F.col("cluster").cast("string"))
        tried = sizes.withColumn("low", low).where(large | low).select(F.col("playlist_id").alias("parent"), F.col("cluster").alias("was"), "size", "low", F.col("top_score").alias("parent_score"), pseudo.alias("playlist_id"), F.when(large, "size").otherwise("low_signal").alias("trigger"))
        tried = stored(tried, "tried")
        if not tried.limit(1).count():
            break
        parts = labelled.withColumn("playlist_id", pseudo).drop("cluster").join(tried.select("playlist_id"), "playlist_id")
        sub, solutions = cluster_playlists(parts, max(2, min_k), max_k, min_size)
        sub = stored(sub, "parts")
        strong = strong_children(signals(features, sub, ["playlist_id"]), tried)
        better = F.col("low") & (F.coalesce("strong", F.lit(0)) >= 2)
        judged = tried.join(solutions, "playlist_id", "left").join(strong, "playlist_id", "left").withColumn("better", better)
        untried, one = F.col("k").isNull(), F.coalesce("largest", F.lit(1.0)) >= 1
        few, low_score, big = F.coalesce("meaningful", F.lit(0)) < 2, (F.coalesce("adjusted", F.lit(-9.0)) < LEAST_ADJUSTED) & ~F.col("better"), F.coalesce("largest", F.lit(1.0)) > MOST_OF_A_PART
        reasons = F.concat_ws(",", F.when(one, "single_cluster"), F.when(few, "not_enough_meaningful_clusters"), F.when(low_score, "adjusted_score_too_low"), F.when(F.col("low") & ~F.col("better"), "low_signal_not_improved"), F.when(big, "largest_subcluster_still_too_large"))
        judged = stored(judged.withColumn("ok", ~few & ~low_score & ~big).withColumn("reason", F.when(F.col("ok"), "accepted").when(untried, "no_candidate_ks").otherwise(reasons)), "judged")
        first = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("size"), "was"))
        accepted = judged.where("ok").withColumn("rank", first).where("rank = 1").select("playlist_id", "parent", "was")
        done = F.coalesce(F.max("ok").over(Window.partitionBy("parent").orderBy(F.desc("size"), "was").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        log = judged.withColumn("done", done).where("not done").select(F.lit(r + 1).alias("round"), F.col("parent").alias("playlist_id"), F.col("was").alias("cluster"), "size", "trigger", "adjusted", F.coalesce("strong", F.lit(0)).alias("strong"), "reason")
        decisions = log if decisions is None else decisions.unionByName(log)
        if not accepted.limit(1).count():
            break
        sizes = sub.groupBy("playlist_id", "cluster").agg(F.count("*").alias("m"))
        keeps = F.row_number().over(Window.partitionBy("playlist_id").orderBy(F.desc("m"), "cluster")) == 1
        places = sizes.withColumn("keeps", keeps).withColumn("place", F.row_number().over(Window.partitionBy("playlist_id").orderBy(F.desc("keeps"), "cluster")) - 1).drop("keeps")
        moved = sub.join(accepted, "playlist_id").join(places, ["playlist_id", "cluster"]).select(F.col("parent").alias("playlist_id"), "track_key", "place")
        top = labelled.groupBy("playlist_id").agg(F.max("cluster").alias("top"))
        number = F.when(F.coalesce("place", F.lit(0)) > 0, F.col("top") + F.col("place")).otherwise(F.col("cluster"))
        labelled = stored(labelled.join(moved, ["playlist_id", "track_key"], "left").join(top, "playlist_id").withColumn("cluster", number).drop("place", "top"), "split")
    return contiguous(labelled, ["playlist_id"]), decisions


def contiguous(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Clusters of each group numbered from 0 without gaps, in their order."""
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("cluster")) - 1
    names = labelled.select(*by, "cluster").distinct().withColumn("__new", rank)
    return labelled.join(names, [*by, "cluster"]).drop("cluster").withColumnRenamed("__new", "cluster")


def label_table(model, vectors: DataFrame, key: str) -> DataFrame:
    """(key, cluster) of a fitted k-means model."""
    return model.transform(vectors).select(key, F.col("prediction").alias("cluster"))


def corpus_summary(labels: DataFrame, centres: DataFrame, components: DataFrame, tracks: DataFrame, order: str, top: int = 12, shown: int = 10) -> DataFrame:
    """(cluster, size, sample_tracks, top_features) of a clustered corpus, largest first.

    labels(track_key, cluster); centres(cluster, k, value) in the reduced space; components(k, feature, weight, centre).
    """
    told = contributors(centres, components, top).groupBy("cluster").agg(_ranked("feature", "weight").alias("top_features"))
    out = cluster_sizes(labels, ["cluster"]).join(samples(labels, tracks, ["cluster"], order, shown, 2), "cluster", "left").join(told, "cluster", "left")
    return out.select("cluster", "size", "sample_tracks", "top_features").orderBy(F.desc("size"), "cluster")


def playlist_summary(features: DataFrame, labelled: DataFrame, tracks: DataFrame, order: str, top: int = 8, shown: int = 10) -> DataFrame:
    """(playlist_id, cluster, name, size, sample_tracks, top_features) of clustered playlists, the largest clusters of each first."""
    by = ["playlist_id", "cluster"]
    greatest = top_features(features, labelled, ["playlist_id"], top)
    told = greatest.groupBy(*by).agg(_ranked("feature", "score").alias("top_features"))
    out = cluster_sizes(labelled, by).join(cluster_names(greatest, by).select(*by, "name"), by, "left").join(samples(labelled, tracks, by, order, shown), by, "left").join(told, by, "left")
    return out.select(*by, F.coalesce("name", F.lit(MIXED)).alias("name"), "size", "sample_tracks", "top_features").orderBy("playlist_id", F.desc("size"), "cluster")


def _ranked(*columns: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))


def cluster_sizes(labelled: DataFrame, by: list[str]) -> DataFrame:
    return labelled.groupBy(*by).agg(F.count("*").alias("size"))


def top_features(features: DataFrame, labelled: DataFrame, by: list[str], n: int = 8, least: float = 0.05) -> DataFrame:
    """(by, cluster, feature, score, rank): the greatest mean features of each cluster, without meta ones; missing rows are 0."""
    sizes = labelled.groupBy(*by, "cluster").agg(F.count("*").alias("size"))
    total = labelled.select(*by, "track_key", "cluster").join(features, "track_key").groupBy(*by, "cluster", "feature").agg(F.sum("value").alias("total"))
    scored = total.join(sizes, [*by, "cluster"]).withColumn("score", F.col("total") / F.col("size")).where(~F.col("feature").startswith("meta__") & (F.col("score") > least))
    rank = F.row_number().over(Window.partitionBy(*by, "cluster").orderBy(F.desc("score"), "feature"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select(*by, "cluster", "feature", "score", "rank")


def contributors(centres: DataFrame, components: DataFrame, n: int = 12) -> DataFrame:
    """(cluster, feature, weight, rank): centres(cluster, k, value) mapped back to features, greatest absolute weight first.

    components(k, feature, weight, centre): centre is what the projection took away, the same for each k.
    """
    back = centres.join(components, "k").groupBy("cluster", "feature").agg((F.sum(F.col("value") * F.col("weight")) + F.max("centre")).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("weight")), "feature"))
    return back.withColumn("rank", rank).where(F.col("rank") <= n)


def samples(labelled: DataFrame, tracks: DataFrame, by: list[str], order: str, n: int = 10, artists: int | None = None) -> DataFrame:
    """(by, sample_tracks): the first tracks of each cluster as `title — artists`, all artists or so many."""
    who = F.coalesce("artists", F.array().cast("array<string>"))
    shown = F.concat(F.coalesce("title", F.lit("None")), F.lit(" — "), F.array_join(who if artists is None else F.slice(who, 1, artists), ", "))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, "track_key"))
    rows = labelled.join(tracks, "track_key").withColumn("rank", rank).where(F.col("rank") <= n).select(*by, "rank", shown.alias("shown"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]).alias("sample_tracks"))
