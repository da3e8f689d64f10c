"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from chorale.plans import songs  # noqa: F401
from chorale.plans.catalogue import ORACLE, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return str(int(v) if isinstance(v, float) and v == int(v) else v)


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(ORACLE[name]).df())


def test_metering_counts_fresh_requests_up_to_the_limit(spark):
    out = QUERIES["request_metering"](spark, DATA)
    assert out.groupBy("user_id").count().count() == spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().count()
    assert out.where("decision = 'fresh'").groupBy("user_id").count().where("count > 50").count() == 0


def test_playlist_cluster_is_a_partition(spark):
    out = QUERIES["playlist_cluster"](spark, DATA).toPandas()
    assert out["size"].sum() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert (out["size"] >= 8).all()


def vectors(spark):
    return np.array([r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)


def test_pca_keeps_what_an_exact_decomposition_keeps(spark):
    x = vectors(spark)
    got = np.array([r["embedding"] for r in QUERIES["pca_embed"](spark, DATA).orderBy("vec_id").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert got.shape == (len(x), 32) and got.var(0, ddof=1) == pytest.approx(values[:32], rel=1e-6)


def test_pca_of_sparse_parts_finds_falling_variances(spark):
    got = [r["variance"] for r in QUERIES["pca_sparse"](spark, DATA).orderBy("k").collect()]
    assert len(got) == 8 and got == sorted(got, reverse=True) and got[-1] > 0


def test_mini_batches_take_all_vectors(spark):
    got = QUERIES["kmeans_mini_batch"](spark, DATA).collect()
    assert sum(r["size"] for r in got) == len(vectors(spark)) and 1 < len(got) <= 8


def test_sweep_takes_the_best_silhouette(spark):
    got = QUERIES["kmeans_sweep"](spark, DATA).orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(4, 11)) and [r["silhouette"] for r in got if r["best"]] == [max(r["silhouette"] for r in got)]
    inertia = [r["inertia"] for r in got]
    assert all(a > b for a, b in zip(inertia, inertia[1:], strict=False)) and inertia[0] < ((vectors(spark) - vectors(spark).mean(0)) ** 2).sum()


def test_playlist_summaries_hold_every_vector_once(spark):
    got = QUERIES["playlist_summaries"](spark, DATA).collect()
    shown = [t for r in got for t in r["sample_tracks"]]
    assert sum(r["size"] for r in got) == len(vectors(spark)) and len(shown) == len(set(shown))
    assert all(len(r["sample_tracks"]) == min(10, r["size"]) and len(r["top_features"]) <= 8 and r["name"] for r in got)
    for r in got:
        scores = [f["score"] for f in r["top_features"]]
        assert scores == sorted(scores, reverse=True) and all(x > 0.05 for x in scores)
