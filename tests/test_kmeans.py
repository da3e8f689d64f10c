"""k-means over blocks against a plain loop from the same starts."""

from __future__ import annotations

import warnings

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from chorale.operators import cluster, kmeans

POINTS, KS = "playlist_id string, track_key string, embedding array<double>", "playlist_id string, k int"


def cloud(n, seed, dims=3, name="p"):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 4, (5, dims))
    return [(name, f"{name}{i}", [float(x) for x in centres[i % 5] + draw.normal(0, 1.2, dims)]) for i in range(n)]


def plain(rows, hashes, k, most, seed, rounds=300):
    """(cost, labels by key): the restart's start and rounds, written out."""
    at = sorted(range(len(rows)), key=lambda i: (int(kmeans.drawn(np.array([hashes[rows[i][1]]], np.int64).view(np.uint64), seed)[0]), hashes[rows[i][1]] % 2**64))
    sample = [np.array(rows[i][2]) for i in at[: max(kmeans.START_ROWS, kmeans.START_EACH * most)]]
    centres = [sample[0]]
    while len(centres) < k:
        centres.append(max(sample, key=lambda p: min(((p - c) ** 2).sum() for c in centres)))
    for _ in range(rounds):
        labels = [min(range(k), key=lambda j: ((np.array(r[2]) - centres[j]) ** 2).sum()) for r in rows]
        cost = sum(((np.array(r[2]) - centres[j]) ** 2).sum() for r, j in zip(rows, labels, strict=True))
        new = [np.mean([r[2] for r, j in zip(rows, labels, strict=True) if j == c], axis=0) if c in labels else centres[c] for c in range(k)]
        if all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(new, centres, strict=True)):
            break
        centres = new
    return cost, {r[1]: j for r, j in zip(rows, labels, strict=True)}


@pytest.fixture(scope="module")
def rows():
    return cloud(140, 1) + cloud(90, 2, name="q") + [("one", "one0", [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("block_rows", [4096, 25])
def test_labels_are_those_of_a_plain_loop(spark, rows, block_rows):
    points = spark.createDataFrame(rows, POINTS)
    ks = spark.createDataFrame([("p", 3), ("p", 6), ("q", 4), ("one", 2), ("nobody", 2)], KS)
    got = kmeans.clustered(points, ks, seeds=3, block_rows=block_rows).collect()
    hashes = {r["track_key"]: r["h"] for r in points.select("track_key", F.xxhash64("track_key", F.lit("start")).alias("h")).collect()}
    for name, most, k in (("p", 6, 3), ("p", 6, 6), ("q", 4, 4)):
        own = [r for r in rows if r[0] == name]
        best = min((plain(own, hashes, k, most, s) for s in range(3)), key=lambda x: x[0])
        mine = {r["track_key"]: r["cluster"] for r in got if r["playlist_id"] == name and r["k"] == k}
        assert all(r["inertia"] == pytest.approx(best[0]) for r in got if r["playlist_id"] == name and r["k"] == k)
        pairs = {(mine[key], best[1][key]) for key in best[1]}
        assert len(mine) == len(own) and len(pairs) == k == len({a for a, _ in pairs})
    assert [(r["track_key"], r["cluster"], r["inertia"]) for r in got if r["playlist_id"] == "one"] == [("one0", 0, 0.0)]
    assert {r["playlist_id"] for r in got} == {"p", "q", "one"}


def test_runs_cut_short_are_told(spark, rows):
    with pytest.warns(UserWarning, match="still moved"):
        kmeans.clustered(spark.createDataFrame(rows, POINTS), spark.createDataFrame([("p", 6)], KS), seeds=2, rounds=1).count()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert kmeans.clustered(spark.createDataFrame([], POINTS), spark.createDataFrame([], KS)).count() == 0


def test_sweep_finds_the_blobs(spark):
    rows = [(i, [10.0 * (i % 4) + 0.01 * (i // 4), float(i % 2)]) for i in range(80)]
    vectors = spark.createDataFrame(rows, "track_key long, e array<double>").select("track_key", array_to_vector("e").alias("features"))
    found = cluster.sweep(vectors, range(2, 7), seeds=4)
    assert [r["k"] for r in found] == [2, 3, 4, 5, 6] and cluster.best_k(found)["k"] == 4
    four = next(r for r in found if r["k"] == 4)
    groups = {(r["track_key"] % 4, r["cluster"]) for r in four["labels"].collect()}
    inertia = sum((0.01 * (i // 4) - 0.095) ** 2 for i in range(80))
    assert len(groups) == 4 and four["inertia"] == pytest.approx(inertia)
    e = np.array([r[1] for r in rows])
    apart = ((e[:, None] - e[None]) ** 2).sum(2)
    same = np.arange(80)[:, None] % 4 == np.arange(80)[None] % 4
    a = (apart * same).sum(1) / 19
    b = np.min([apart[:, np.arange(80) % 4 == c].mean(1) + np.where(np.arange(80) % 4 == c, np.inf, 0) for c in range(4)], axis=0)
    assert four["silhouette"] == pytest.approx(float(np.mean((b - a) / np.maximum(a, b))))
    assert cluster.sweep(vectors.limit(2), range(2, 7)) == [] and cluster.best_k([]) is None


def test_mini_batches_come_near_full_k_means(spark):
    rows = [(r[1], r[2]) for r in cloud(4000, 5, dims=6)]
    points = spark.createDataFrame(rows, "track_key string, embedding array<double>")
    got = kmeans.mini_batch(points, 5, batch=256, rounds=60)
    assert got.count() == 4000 and got.select("cluster").distinct().count() == 5
    full = kmeans.clustered(points.withColumn("playlist_id", F.lit("all")), spark.createDataFrame([("all", 5)], KS), seeds=4).first()["inertia"]
    assert full <= got.agg(F.sum("sq")).first()[0] * (1 + 1e-9) and got.agg(F.sum("sq")).first()[0] <= 1.03 * full
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kmeans.mini_batch(points.repartition(3), 5, batch=256, rounds=60).collect()))
    few = kmeans.mini_batch(points.limit(3), 5, batch=4, rounds=3)
    assert few.count() == 3 and few.agg(F.sum("sq")).first()[0] == pytest.approx(0, abs=1e-9)
    assert kmeans.mini_batch(points.where("false"), 5).count() == 0


def test_sampled_silhouette_of_a_large_group(spark):
    draw = np.random.default_rng(3)
    rows = [(p, f"{p}{i}", i % 3, [float(x) for x in draw.normal([4.0 * (i % 3), 0.0], 1.0)]) for p, n in (("large", 900), ("small", 20)) for i in range(n)]
    points = spark.createDataFrame(rows, "playlist_id string, track_key string, cluster int, embedding array<double>")
    got = {r["playlist_id"]: r["silhouette"] for r in cluster.sampled_silhouette(points, ["playlist_id"], most=300).collect()}
    order = [r["track_key"] for r in points.where("playlist_id = 'large'").orderBy(F.xxhash64("track_key"), "track_key").limit(300).collect()]
    e, labels = (np.array([r[k] for r in rows if r[1] in set(order)]) for k in (3, 2))
    apart = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    sums = np.stack([apart[:, labels == c].sum(1) for c in range(3)], 1)
    counts = np.bincount(labels)
    a = sums[np.arange(300), labels] / (counts[labels] - 1)
    b = np.where(np.arange(3)[None] == labels[:, None], np.inf, sums / counts).min(1)
    assert set(got) == {"large"} and got["large"] == pytest.approx(float(((b - a) / np.maximum(a, b)).mean()))
    whole = cluster.silhouette(points.where("playlist_id = 'large'"), ["playlist_id"]).first()["silhouette"]
    assert got["large"] != whole and got["large"] == pytest.approx(whole, abs=0.05)


@pytest.mark.parametrize("block_rows", [40, 25])
def test_playlists_of_some_blocks_run_whole_in_a_task(spark, rows, monkeypatch, block_rows):
    """No round of passes over the table for them; larger ones take those rounds, to the same ends."""
    points, ks = spark.createDataFrame(rows, POINTS), spark.createDataFrame([("p", 6), ("q", 4)], KS)
    found = lambda: {(r["playlist_id"], r["track_key"], r["cluster"], round(r["inertia"], 6)) for r in kmeans.clustered(points, ks, seeds=3, block_rows=block_rows).collect()}
    large, passes = kmeans._large, []
    monkeypatch.setattr(kmeans, "_large", lambda *a: passes.append(1) or large(*a))
    whole = found()
    assert len(whole) == 230 and not passes
    monkeypatch.setattr(kmeans, "WHOLE_BLOCKS", 1)
    assert found() == whole and passes


def test_rounds_of_large_playlists_write_nothing(spark, rows, monkeypatch):
    """However many rounds they take, a playlist of many blocks is read for its runs, and once more for its labels."""
    written, store = [], kmeans.stored
    monkeypatch.setattr(kmeans, "stored", lambda df, label: written.append(label) or store(df, label))
    monkeypatch.setattr(kmeans, "WHOLE_BLOCKS", 1)
    points, ks = spark.createDataFrame(rows, POINTS), spark.createDataFrame([("p", 6), ("q", 4)], KS)
    assert kmeans.clustered(points, ks, seeds=3, block_rows=25).where("playlist_id != 'one'").count() == 230
    assert len(written) <= 3


def test_runs_side_by_side_end_like_runs_alone(monkeypatch):
    """Points in memory or in a file, in one tile or some; of centres that are equal the lower number takes the points."""
    points = np.array([r[2] for r in cloud(700, 4)])
    starts = [kmeans.far_apart(points[at:], k) for at, k in ((0, 3), (20, 5), (40, 8))] + [np.repeat(points[:1], 3, axis=0)]

    def ended(numbers, tile, some, rounds=300):
        monkeypatch.setattr(kmeans, "HELD_NUMBERS", numbers)
        monkeypatch.setattr(kmeans, "TILE_ROWS", tile)
        monkeypatch.setattr(kmeans, "TILE_CENTRES", tile)
        held = kmeans._Held()
        for part in (2, 0, 1):
            held.add(points[part * 300 : part * 300 + 300], part)
        return kmeans.lloyd(held, some, rounds)

    labels, out = ended(1 << 20, 1 << 20, starts)
    assert not any(going for *_, going in out) and not ended(1 << 20, 1, starts[3:], 1)[0].any()
    for own, (centres, cost, _) in zip(labels, out, strict=True):
        apart = ((points[:, None] - centres[None]) ** 2).sum(2)
        assert (own == apart.argmin(1)).all() and cost == pytest.approx(apart.min(1).sum())
        assert all(np.allclose(centres[j], points[own == j].mean(0), atol=1e-7) for j in set(own))
    few, again = ended(1000, 7, starts)
    assert (few == labels).all() and [c for _, c, _ in again] == pytest.approx([c for _, c, _ in out])
    for i, start in enumerate(starts):
        alone, [one] = ended(1 << 20, 64, [start])
        assert (alone[0] == labels[i]).all() and one[1] == pytest.approx(out[i][1])


def test_silhouettes_of_labellings_together_are_those_of_each(spark, rows, monkeypatch):
    """Over blocks that meet, with clusters of one point, equal points and a labelling of one cluster; each distance is made once."""
    own = [*rows, *(("q", f"copy{i}", rows[150][2]) for i in range(3)), ("two", "a", [0.0, 0.0, 1.0]), ("two", "b", [0.0, 0.0, 1.0])]
    points = spark.createDataFrame(own, POINTS)
    labels = [(p, k, key, (i * i) % k if i % 100 or k < 4 else k) for i, (p, key, _) in enumerate(own) for k in (1, 3, 5, 9) if p != "two" or k == 3]
    labels = cluster.contiguous(spark.createDataFrame(labels, "playlist_id string, k int, track_key string, cluster int"), ["playlist_id", "k"])
    each = cluster.silhouette(labels.join(points, ["playlist_id", "track_key"]), ["playlist_id", "k"])
    plain = {(r["playlist_id"], r["k"]): r["silhouette"] for r in each.collect() if r["silhouette"] is not None}
    for block_rows in (2000, 30):
        monkeypatch.setattr(cluster, "BLOCK_ROWS", block_rows)
        got = {(r["playlist_id"], r["k"]): r["silhouette"] for r in cluster.silhouettes(points, labels).collect()}
        assert got == pytest.approx(plain) and len(got) == 7
    asked = []
    monkeypatch.setattr(cluster, "silhouette", lambda *a: asked.append(a))
    chosen, solutions = cluster.cluster_playlists(points.where("playlist_id != 'two'"), seeds=2)
    assert chosen.count() == 234 and solutions.count() == 2 and not asked
