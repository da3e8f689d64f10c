"""Label terms and quick groups on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.operators import labels
from chorale.operators.vocab import tfidf


def test_terms_once_a_track(spark):
    df = spark.sql("""SELECT 't' AS id, array(named_struct('name', 'Indie Rock', 'count', 1D), named_struct('name', 'Billboard Hot 100', 'count', 1D)) AS a,
        array(named_struct('name', 'indie-rock', 'count', 2D), named_struct('name', repeat('x', 41), 'count', 2D)) AS b""")
    assert [tuple(r) for r in labels.label_terms(df, "id", "a", "b").collect()] == [("t", "indie_rock", "indie rock")]


def test_quick_ks(spark):
    got = {n: spark.range(1).select(labels.quick_ks(F.lit(n)).alias("k")).first()["k"] for n in (5, 29, 30, 100, 1000)}
    assert got == {5: [2], 29: [2], 30: [2], 100: [6], 1000: [16]}


def test_large_clusters_are_split_once(spark):
    """40 of 60 rows are above the threshold and fall apart into 20 + 20; the small cluster stays."""
    rows = [("p", f"{c}{i}", [100.0 * c, float(i) / 50], 0 if c < 2 else 1) for c in range(3) for i in range(20)]
    points = spark.createDataFrame(rows, "playlist_id string, track_key string, embedding array<double>, cluster int")
    got = {}
    for r in labels.quick_split(points).collect():
        got.setdefault(r["cluster"], set()).add(r["track_key"][0])
    assert got.pop(1) == {"2"} and len(got) >= 2 and all(len(x) == 1 for x in got.values())


def test_quick_groups(spark):
    points = spark.createDataFrame([("p", f"{c}{i}", [10.0 * c, float(i) / 50]) for c in range(2) for i in range(20)], "playlist_id string, track_key string, embedding array<double>")
    terms = points.select("track_key", F.when(F.col("track_key").startswith("0"), "techno").otherwise("folk").alias("term"))
    assert {(r["display_group"], r["size"]) for r in labels.quick_groups(points, terms).collect()} == {("Electronic / Dance", 20), ("Folk", 20)}


def test_tfidf(spark):
    t = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (3, "b", "y")], "k int, g string, term string")
    top = {(r["g"], r["rank"]): r["term"] for r in tfidf(t, "k", "g").collect()}
    assert top["a", 1] == "x" and top["b", 1] == "y"
