"""Principal components of sparse rows against an exact decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.operators import features, reduction


def long(spark, x, names):
    rows = [(f"r{i}", names[j], float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "track_key string, feature string, value double")


def sparse(n, f, rank, seed=0, noise=0.02):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, rank)) * np.geomspace(6, 1, rank) @ draw.normal(size=(rank, f)) + noise * draw.normal(size=(n, f))
    x[draw.random((n, f)) < 0.6] = 0
    x[::9] = 0  # records without any row
    return x


@pytest.mark.parametrize("weighted", [False, True])
def test_components_are_those_of_an_exact_decomposition(spark, weighted):
    x = sparse(120, 40, 5)
    names = [f"{('tag', 'genre', 'acoustic', 'meta')[j % 4]}__{j}" for j in range(40)]
    cells = long(spark, x, names)
    stats = features.scaler_stats(cells, len(x))
    components, variances = reduction.principal_components(cells, stats, len(x), 4, weighted)
    w = np.array([features.BLOCKS.get(n.split("__")[0], 1.0) if weighted else 1.0 for n in names])
    z = (x - x.mean(0)) / x.std(0) * w
    _, s, v = np.linalg.svd(z, full_matrices=False)
    got = np.zeros((4, 40))
    for r in components.collect():
        got[r["k"], names.index(r["feature"])] = r["weight"]
    assert np.allclose(got @ got.T, np.eye(4), atol=1e-6)
    assert variances == pytest.approx((s[:4] ** 2 / len(x)).tolist(), rel=2e-3)
    assert all(abs(got[i] @ v[i]) > 0.98 for i in range(3))
    assert np.linalg.norm(z @ got.T) ** 2 > 0.998 * (s[:4] ** 2).sum()
    placed = {(r["track_key"], r["k"]): r["value"] for r in features.project(cells, stats, components, "track_key", weighted).collect()}
    assert all(placed[f"r{i}", k] == pytest.approx(z[i] @ got[k], abs=1e-6) for i in range(len(x)) for k in range(4) if x[i].any())


def test_nothing_to_reduce(spark):
    cells = long(spark, np.eye(3), ["a", "b", "c"])
    stats = features.scaler_stats(cells, 3)
    assert reduction.principal_components(cells, stats, 3, 32) is None
    assert reduction.principal_components(cells.where("false"), stats.where("false"), 0, 32) is None


def test_fewer_directions_than_asked_for(spark):
    x = np.outer(np.arange(1, 21), np.ones(12)) + np.outer(np.arange(20) % 3, np.arange(12) % 2)
    cells = long(spark, x, [f"f{j}" for j in range(12)])
    stats = spark.createDataFrame([(f"f{j}", float(x[:, j].mean()), 1.0) for j in range(12)], "feature string, mean double, scale double")
    components, variances = reduction.principal_components(cells, stats, 20, 6, False)
    assert len(variances) == 2 and components.select("k").distinct().count() == 2


def test_very_many_columns(spark):
    """200,000 columns, of which each record has few: nothing of that width is held anywhere."""
    rows = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("track_key"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"), "id")
    made = rows.select("track_key", F.concat(F.lit("tag__"), F.when(F.col("i") < 4, F.col("i") + 10 * (F.col("id") % 2)).otherwise(F.pmod(F.xxhash64("id", "i"), F.lit(200_000)))).alias("feature"), F.lit(1.0).alias("value")).distinct()
    stats = features.scaler_stats(made, 4000).withColumn("scale", F.lit(1.0))
    assert stats.count() > 100_000
    components, variances = reduction.principal_components(made, stats, 4000, 3, False)
    first = components.where("k = 0").orderBy(F.desc(F.abs("weight"))).limit(8).collect()
    assert {r["feature"] for r in first} == {f"tag__{i}" for i in (0, 1, 2, 3, 10, 11, 12, 13)}
    assert variances[0] == pytest.approx(2.0, rel=0.05) and variances[1] < 0.2
