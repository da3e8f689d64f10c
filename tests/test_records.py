"""Files, representations, splits and profiles that no registered query covers."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from chorale.functions import names, text
from chorale.operators import audio, canonical, cluster, enrich, features, route, serve
from chorale.sources import records


def test_empty_and_wrong_files_are_errors(spark, tmp_path):
    (tmp_path / "empty.json").write_text("\n")
    with pytest.raises(ValueError):
        records.checked(records.records(spark, str(tmp_path / "empty.json")))
    (tmp_path / "list.json").write_text('[{"track_id": "1"}, {"track_id": "2"}]')
    assert {r["source_file"] for r in records.exports(spark, str(tmp_path / "list.json"), records.SONG).collect()} == {"list.json"}
    (tmp_path / "object.json").write_text('{"track_id": "1"}')
    with pytest.raises(ValueError, match="object.json"):
        records.exports(spark, [str(tmp_path / "list.json"), str(tmp_path / "object.json")], records.SONG)


def test_records_reports_and_rounded_tables(spark, tmp_path):
    d = spark.createDataFrame([("1", 1 / 3, [2 / 3])], "track_id string, x double, v array<double>")
    records.write_records(d.select("track_id"), str(tmp_path / "r"))
    assert records.records(spark, str(tmp_path / "r")).first()["track_id"] == "1"
    records.write_report(d.agg(F.count("*").alias("n")), str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).first()["n"] == 1
    records.write_rounded(d, str(tmp_path / "x"), 2)
    assert json.loads(spark.read.text(str(tmp_path / "x")).first()["value"]) == {"track_id": "1", "x": 0.33, "v": [0.67]}


def test_history_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"ts": "2024", "msPlayed": 1}, {"ts": "2025", "msPlayed": 2}]')
    (tmp_path / "b.json").write_text('[{"ts": "2026", "msPlayed": 3}]')
    assert records.history(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "ts string, msPlayed long").agg(F.sum("msPlayed")).first()[0] == 6


def test_matrix_representation_and_model(spark, tmp_path):
    f = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "track_id string, feature string, value double")
    vocabulary = spark.createDataFrame([("x", 0), ("y", 1)], "feature string, idx int")
    records.write_matrix(f, vocabulary, f.select("track_id"), features.matrix_report(f, f, "track_id"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/report")).first()["columns"] == 2 and spark.read.parquet(str(tmp_path / "m/features")).count() == 2
    stats = features.scaler_stats(f, 2)
    components = spark.createDataFrame([(0, "x", 0.6, 0.1), (0, "y", 0.8, 0.2)], "k int, feature string, weight double, centre double")
    records.write_representation(stats, components, str(tmp_path / "rep"))
    loaded = records.load_representation(spark, str(tmp_path / "rep"))
    assert loaded[0].count() == 2 and loaded[1].count() == 2
    records.write_representation(stats.where("feature = 'x'"), components, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="without statistics"):
        records.load_representation(spark, str(tmp_path / "bad"))
    records.write_representation(stats, components.drop("centre"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="lacks centre"):
        records.load_representation(spark, str(tmp_path / "short"))
    centres = spark.createDataFrame([(1, "x", 0.12345678), (1, "y", 0.0), (0, "x", 9.0), (0, "y", 1.0)], "cluster int, feature string, value double")
    records.write_model(centres, stats, 0.5, str(tmp_path / "model"))
    model = spark.read.json(str(tmp_path / "model")).first()
    assert (model["k"], model["feature_names"], model["centroids"], model["silhouette_sample"]) == (2, ["x", "y"], [[9.0, 1.0], [0.123457, 0.0]], 0.5)


def test_relational_tables(spark):
    options = {"url": "jdbc:derby:memory:chorale;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    users = spark.createDataFrame([("u1", "active", 2), ("u2", None, 0)], "user_id string, subscription_status string, monthly_used int")
    users.write.format("jdbc").options(dbtable="users", **options).mode("overwrite").save()
    got = records.jdbc(spark, options["url"], "users", driver=options["driver"])
    assert sorted(map(tuple, got.collect())) == [("u1", "active", 2), ("u2", None, 0)]


def test_numbers_of_any_depth(spark):
    deep = "1"
    for i in range(12):
        deep = f'{{"k{i}": {deep}}}'
    d = spark.createDataFrame([(1, deep), (2, "[]"), (3, "7")], "k int, j string")
    assert [(r["k"], r["path"].count("__"), r["value"]) for r in names.numeric_leaves(d, "k", "j").collect()] == [(1, 11, 1.0)]


def test_strict_numbers(spark):
    cases = {"3": (3, 3.0), "3.0": (3, 3.0), "3.5": (None, 3.5), '"3"': (None, None), "true": (None, None), "null": (None, None)}
    d = spark.createDataFrame([(j,) for j in cases], "j string").withColumn("v", F.parse_json("j"))
    assert {r["j"]: (r["i"], r["d"]) for r in d.select("j", text.strict_int(F.col("v")).alias("i"), text.strict_double(F.col("v")).alias("d")).collect()} == cases


def test_normalised_rows_pass(spark):
    row = spark.sql("SELECT 'x' AS track_id, named_struct('isrc', 'i') AS ids, named_struct('tags', array()) AS brainz, named_struct('image_url', '') AS runtime_metadata, named_struct('dataset_name', CAST(NULL AS STRING), 'source_files', array('f')) AS source")
    got = canonical.playlist_records(row, "set", now=F.lit("t")).first()
    assert got["track_id"] == "x" and tuple(got["source"]) == ("set", "v1", ["f"], "t")


def test_browser_profile(spark):
    item = "array<struct<name:string,count:double>>"
    payload = '{"highlevel": {"danceability": {"all": {"danceable": 1.5, "not_danceable": 0.1}}, "x": 3, "mood_happy": {"all": {"happy": "0.5", "sad": -0.25}}}}'
    d = spark.createDataFrame([("a", 2010, 50.0, [("vocal", 1.0), ("Rhythm and Blues", None)], [("Billboard Pop", 1.0), ("billboard pop", 2.0)], payload), ("b", 0, None, [], [], "{")], f"id string, year int, popularity double, tags {item}, genres {item}, acoustic string")
    got = {(r["id"], r["feature"]): r["value"] for r in features.browser_features(d, "id", 2000.0, 10.0).collect()}
    import math

    want = {"meta__has_year": 0.1, "meta__year_z": 0.25, "meta__has_popularity": 0.1, "meta__popularity_scaled": 0.075, "meta__has_tags": 0.1, "meta__has_genres": 0.1, "meta__has_acoustic_high_level": 0.1,
            "tag__r_and_b": math.log(2), "genre__billboard_pop": (math.log(2) + math.log(3)) * 0.7, "acoustic__highlevel__danceability__all__danceable": 1.2, "acoustic__highlevel__mood_happy__all__sad": -0.3}
    assert {k: round(v, 9) for k, v in got.items()} == {("a", k): round(v, 9) for k, v in want.items()}


def test_key_confidence_is_the_lead_over_the_other_mode(spark):
    import random

    r = random.Random(2)
    rows = [(i, [r.random() for _ in range(12)]) for i in range(20)]
    got = {x["id"]: x for x in audio.key_and_mode(spark.createDataFrame(rows, "id int, chroma array<double>"), "id").collect()}
    for i, v in rows:
        best = {}
        for mode, profile in (("major", audio.MAJOR), ("minor", audio.MINOR)):
            best[mode] = max((sum(v[j] * profile[(j - k) % 12] for j in range(12)) / sum(v) / sum(profile), -k) for k in range(12))
        mode = "major" if best["major"][0] >= best["minor"][0] else "minor"
        assert (got[i]["mode"], got[i]["pitch"]) == (mode, audio.KEYS[-best[mode][1]]) and got[i]["confidence"] == pytest.approx(abs(best["major"][0] - best["minor"][0]))


def test_a_large_cluster_is_split_and_small_ones_stay(spark):
    rows = [("p", f"{c}-{i}", [50.0 * c + 0.01 * i, float(c % 2)], 0 if c < 2 else 1) for c in range(3) for i in range(18)]
    points = spark.createDataFrame(rows, "playlist_id string, track_key string, embedding array<double>, cluster int")
    told = points.select("track_key", F.explode(F.array(F.lit("tag__kind"), F.lit("tag__mood"))).alias("f")).select("track_key", F.concat("f", F.substring("track_key", 1, 1)).alias("feature"), F.lit(0.9).alias("value"))
    split, decisions = cluster.split_oversized(points, told, min_size=8)
    parts = {}
    for r in split.collect():
        parts.setdefault(r["cluster"], set()).add(r["track_key"][0])
    assert sorted(map(sorted, parts.values())) == [["0"], ["1"], ["2"]] and set(parts) == {0, 1, 2}
    log = {(r["round"], r["cluster"]): (r["trigger"], r["reason"]) for r in decisions.collect()}
    assert log == {(1, 0): ("size", "accepted")}
    summary = {r["name"]: (r["size"], len(r["sample_tracks"])) for r in cluster.playlist_summary(told, split, points.select("track_key", F.col("track_key").alias("title"), F.array("playlist_id").alias("artists")), "track_key").collect()}
    assert summary == {f"kind{k} / mood{k}": (18, 10) for k in range(3)}


def test_strong_children_gain_on_their_parent(spark):
    children = spark.createDataFrame([("s", 0, "a", 3, 0.5, False), ("s", 1, "b", 3, 0.36, False), ("s", 2, "c", 1, 0.9, False), ("s", 3, "mixed vibe cluster", 3, 0.9, True), ("t", 0, "d", 2, 0.35, False)], "playlist_id string, cluster int, name string, n_features int, top_score double, mixed boolean")
    parents = spark.createDataFrame([("s", 0.3), ("t", 0.1)], "playlist_id string, parent_score double")
    assert {r["playlist_id"]: r["strong"] for r in cluster.strong_children(children, parents).collect()} == {"s": 1, "t": 1}


def test_corpus_summary_and_labels(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = spark.createDataFrame([(i, [float(i // 6 * 10), 1.0]) for i in range(10)], "track_key int, embedding array<double>")
    vectors = points.select("track_key", array_to_vector("embedding").alias("features"))
    labelled = cluster.label_table(KMeans(k=2, seed=1, featuresCol="features").fit(vectors), vectors, "track_key")
    assert labelled.groupBy("cluster").count().count() == 2
    centres = spark.createDataFrame([(c, 0, float(c)) for c in (0, 1)], "cluster int, k int, value double")
    components = spark.createDataFrame([(0, "x", 2.0, 0.5), (0, "y", -1.0, 0.0)], "k int, feature string, weight double, centre double")
    tracks = points.select("track_key", F.concat(F.lit("t"), "track_key").alias("title"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("artists"))
    got = cluster.corpus_summary(labelled, centres, components, tracks, "track_key").collect()
    assert [r["size"] for r in got] == [6, 4] and got[0]["sample_tracks"][0] == "t0 — a, b"
    told = {r["cluster"]: [(f["feature"], f["weight"]) for f in r["top_features"]] for r in got}
    assert told[1] == [("x", 2.5), ("y", -1.0)] and told[0] == [("x", 0.5), ("y", 0.0)]


def test_metering_of_one_long_log(spark):
    log = spark.range(3000).selectExpr("'u' AS user_id", "timestamp_seconds(id * 40) AS ts", "'active' AS status", "false AS cached", "false AS force", "true AS succeeded")
    decisions = [r["decision"] for r in serve.metered(log).orderBy("ts").collect()]
    assert decisions[:50] == ["fresh"] * 50 and set(decisions[50:]) == {"quota"}


def test_a_file_named_twice_is_read_once(spark, tmp_path):
    (tmp_path / "a b.json").write_text('{"track_id": "1"}\n')
    (tmp_path / "link.json").symlink_to(tmp_path / "a b.json")
    (tmp_path / "other.txt").write_text("no record")
    named = [str(tmp_path / "a b.json"), str(tmp_path), f"{tmp_path}/*.json", f"file://{tmp_path}/link.json"]
    assert [r["track_id"] for r in records.records(spark, named).collect()] == ["1"]
    assert len(records.resolved(spark, named)) == 1 and records.records(spark, str(tmp_path), glob="*.none").count() == 0


def test_a_matrix_is_checked_when_it_is_loaded(spark, tmp_path):
    f = spark.createDataFrame([("t1", "tag__a", 1.0), ("t2", "tag__b", 2.0)], "track_id string, feature string, value double")
    vocabulary = spark.createDataFrame([("tag__a", 0), ("tag__b", 1)], "feature string, idx int")
    rows = f.select("track_id").distinct()
    write = lambda name, v=vocabulary, r=rows: records.write_matrix(f, v, r, features.matrix_report(f, r, "track_id"), str(tmp_path / name))
    write("good")
    got = records.load_matrix(spark, str(tmp_path / "good"))
    assert [d.count() for d in got] == [2, 2, 2]
    part = next((tmp_path / "good/features").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1])
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="features/part-.*not as written"):
        records.load_matrix(spark, str(tmp_path / "good"))
    for name, v, r, says in (("gap", vocabulary.withColumn("idx", F.col("idx") * 2), rows, "numbered"), ("twice", vocabulary, rows.union(rows), "twice"), ("lost", vocabulary.limit(1), rows, "cells"), ("row", vocabulary, rows.where("track_id = 't1'"), "cells")):
        write(name, v, r)
        with pytest.raises(ValueError, match=says):
            records.load_matrix(spark, str(tmp_path / name))


def test_years_by_kind_and_field(spark):
    for given, want in (("19", None), ("-5", None), ("20191", None), ("1999-05-01", 1999), ("c. 2001/2002", 2001), ("é2001", None)):
        assert spark.range(1).select(text.year(F.lit(given)).alias("y")).first()["y"] == want
    assert spark.range(1).select(text.year(F.lit(7)).alias("y"), text.year(F.lit(2.5)).alias("z")).first() == (7, None)
    raw = "title string, artists array<string>, releaseYear string, album struct<release_date:string, releaseDate:string>, release_date string, releaseDate string, year string"
    rows = [("a", ["x"], "2001", None, None, None, None), ("b", ["x"], None, ("2010-01-01", "2011"), "1999", "2005", None), ("c", ["x"], None, (None, "2011"), "1999", "2005", "none"), ("d", ["x"], None, None, "1999", "2005", ""), ("e", ["x"], None, None, None, "2005", "19")]
    good, _ = canonical.canonical(spark.createDataFrame(rows, raw), "set")
    assert {r["title"]: r["year"] for r in good.collect()} == {"a": 2001, "b": 2010, "c": 2011, "d": 1999, "e": 2005}


def test_upsert_counts_against_a_plain_loop(spark):
    draw = random.Random(8)
    row = lambda o, keys: (draw.choice(keys), o, draw.choice([None, "", " ", "m"]), [0] * draw.randint(0, 4) if draw.random() < 0.8 else None)
    base, delta = [row(o, ["a", "b", "c", None]) for o in range(8)], [row(o, ["a", "b", "d", "e", "f"]) for o in range(60)]
    kind = "k string, o int, mbid string, tags array<int>"
    got = {r["measure"]: r["n"] for r in enrich.upsert_counts(spark.createDataFrame(base, kind), spark.createDataFrame(delta, kind), "k", ["mbid"], ["tags"], "o").collect()}
    held = {k: [m, t] for k, _, m, t in base if k}
    want = {"base": 8, "delta": 60, "added": 0, "updated": 0, "field:mbid": 0, "field:tags": 0}
    for k, _, m, t in delta:
        if k not in held:
            held[k] = [m, t]
            want["added"] += 1
            continue
        fills, longer = not (held[k][0] or "").strip() and bool((m or "").strip()), len(t or []) > len(held[k][1] or [])
        held[k] = [m if fills else held[k][0], t if longer else held[k][1]]
        want["field:mbid"] += fills
        want["field:tags"] += longer
        want["updated"] += fills or longer
    assert got == {**want, "total": 8 + want["added"]}
    made = {r["k"]: r for r in enrich.upsert(spark.createDataFrame(base, kind), spark.createDataFrame(delta, kind), "k", ["mbid"], ["tags"], "o").where("k IS NOT NULL").orderBy("o").collect()}
    assert all(len(made[k]["tags"] or []) == len(t or []) and (made[k]["mbid"] or "").strip() == (m or "").strip() for k, (m, t) in held.items())


def test_group_keys(spark):
    cases = {("era-90s", "Rock"): "era", ("usage-x", ""): "usage", ("vibe-1", "pop"): "vibe", ("pop-hits", "jazz"): "popularity", ("", "Nujabes / x"): "jazz", ("c1", "Trap Soul"): "trap", ("c1", "R&B / Neo"): "rnb", ("c1", "Party Rap"): "melodic", ("c1", "Hip Hop"): "rap", ("c1", "Dream Pop"): "dream", ("c1", "Pop"): "pop", (None, "Chill"): "acoustic", ("c", None): "", ("c", "Breakbeat"): "instrumental", ("c", "Party Rap Dance"): "electronic"}
    df = spark.createDataFrame(list(cases), "id string, label string")
    assert {(r["id"], r["label"]): r["g"] for r in df.withColumn("g", route.group_key(F.col("id"), F.col("label"))).collect()} == cases


def test_a_repeated_code_gives_one_payload_whatever_the_order(spark):
    tracks = spark.createDataFrame([("t", "us1", None)], "id string, isrc string, brainz struct<mbid:string>")
    codes = spark.createDataFrame([("US1", ("z",)), (" us1 ", ("a",)), ("US1", ("m",))], "isrc string, brainz struct<mbid:string>")
    none = spark.createDataFrame([], "id string, genres array<string>")
    for part in (codes, codes.orderBy("brainz"), codes.repartition(3)):
        assert enrich.enriched_if_absent(tracks, part, none).first()["brainz"]["mbid"] == "a"
