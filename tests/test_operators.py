"""Operators on small hand-made tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.functions import names, text
from chorale.operators import audio, canonical, cluster, enrich, features, matching, quality, route, serve, usage
from chorale.plans import catalogue, songs
from chorale.sources import records
from chorale.streaming import usage as streams
from tests.conftest import DATA


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, text.token(lit("R&B / Soul"))) == "r_and_b_soul"
    assert one(spark, text.squeeze(lit(" a   b\n"))) == "a b"
    assert one(spark, text.slug(lit("  Hello, World! "))) == "hello-world"
    assert one(spark, text.isrc(lit(" us-rc1-11-11111 "))) == "USRC11111111"
    assert one(spark, text.lenient_int(lit("12.0"))) == 12 and one(spark, text.lenient_int(lit("x"))) is None
    assert one(spark, text.year(lit("1999-05-01"))) == 1999 and one(spark, text.year(lit("none"))) is None
    assert one(spark, text.playlist_id(lit("https://h/playlist/abc123?x"))) == "abc123"
    assert one(spark, text.percent(lit(1), lit(3))) == 33.33 and one(spark, text.percent(lit(1), lit(0))) == 0
    assert one(spark, text.half_up(lit(2.5))) == 3
    assert one(spark, text.alias_key(lit("A B"), F.array(lit("C D"), lit("E")))) == "a_b::c_d::e"
    assert one(spark, text.alias_key(lit(" "), F.array(lit("C")))) is None


def test_content_key_ignores_order_and_case(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit(None).cast("string"), F.lit("x"))
    assert one(spark, text.content_key(a, F.lit(" Calm "))) == one(spark, text.content_key(b, F.lit("calm")))
    assert one(spark, text.content_key(a, F.lit(""))) != one(spark, text.content_key(a, F.lit("calm")))


def test_name_counts_in_three_shapes(spark):
    asked = lambda c: [(r["name"], r["count"]) for r in one(spark, c)]
    assert asked(names.from_strings(F.array(F.lit("indie"), F.lit(" ")))) == [("indie", 1.0)]
    assert asked(names.from_map(F.create_map(F.lit("indie"), F.lit(0), F.lit("rock"), F.lit(4)))) == [("rock", 4.0), ("indie", 1.0)]
    df = spark.sql("SELECT array(named_struct('name', 'B', 'count', 0D), named_struct('name', 'A', 'count', CAST(NULL AS DOUBLE)), named_struct('name', 'b', 'count', 9D)) AS t")
    assert [(r["name"], r["count"]) for r in df.select(names.from_structs(F.col("t")).alias("x")).first()["x"]] == [("b", 9.0), ("A", 1.0), ("B", 0.0)]
    assert [r["name"] for r in df.select(names.first_wins(F.col("t")).alias("x")).first()["x"]] == ["B", "A"]


def test_tags_are_canonical_and_filtered(spark):
    df = spark.sql("""SELECT 1 AS k, array(named_struct('name', 'Rhythm and Blues', 'count', 2D), named_struct('name', 'Billboard Hot 100', 'count', 1D), named_struct('name', 'vocal', 'count', 1D),
        named_struct('name', 'ph 4 stars', 'count', 1D), named_struct('name', 'indie', 'count', -1D), named_struct('name', 'folk', 'count', CAST(NULL AS DOUBLE))) AS t""")
    assert {(r["token"], r["weight"]) for r in names.exploded_tags(df, "k", "t").collect()} == {("r_and_b", 2.0), ("folk", 1.0)}


def test_numeric_leaves(spark):
    payload = '{"highlevel":{"danceability":{"all":{"danceable":0.9,"not_danceable":0.1},"probability":0.9,"value":"danceable","version":{"x":1}},"gender":{"all":{"female":0.4}}},"metadata":{"q":1},"l":[1,true]}'
    df = spark.createDataFrame([(1, payload), (2, "{"), (3, None)], "k int, j string")
    found = {(r["k"], r["path"]): r["value"] for r in names.numeric_leaves(df, "k", "j").collect()}
    assert set(p for _, p in found) == {"highlevel__danceability__all__danceable", "highlevel__danceability__all__not_danceable", "highlevel__danceability__probability", "highlevel__gender__all__female", "l__0"}
    kept = names.numeric_leaves(df, "k", "j").where(names.keeps_acoustic(F.col("path"))).collect()
    assert {r["path"] for r in kept} == {"highlevel__danceability__all__danceable", "l__0"}


def test_numeric_leaves_of_odd_payloads(spark):
    deep = '{"a":' * 400 + "7" + "}" * 400
    given = {1: deep, 2: "[" * 200_000, 3: '{"R&B  x":{"":1," Version ":2,"é":3,"k":[[1],[2,{"y":-0.5}]]}}', 4: "5", 5: '"5"', 6: "[1e400, %d, null, false]" % 10**400, 7: '{"a":1,"a":2}', 8: "", 9: " [ 3 ] x"}
    df = spark.createDataFrame([({"id": k}, v, "x") for k, v in given.items()], "k struct<id:int>, j string, path string")
    out = names.numeric_leaves(df, "k", "j")
    found = {(r["k"]["id"], r["path"]): r["value"] for r in out.collect()}
    inf = float("inf")
    assert found.pop((1, "__".join(["a"] * 400))) == 7.0
    assert found == {(3, "r_and_b_x__"): 3.0, (3, "r_and_b_x__k__0__0"): 1.0, (3, "r_and_b_x__k__1__0"): 2.0, (3, "r_and_b_x__k__1__1__y"): -0.5, (6, "0"): inf, (6, "1"): inf, (7, "a"): 2.0}
    assert names.numeric_leaves(df.where("false"), "k", "j").count() == 0


def test_usage_of_mixed_history(spark):
    rows = [("spotify:track:a", None, None, 60_000, "2024-01-01T00:00:00Z", True), (None, " Art ", "Song", 1000, "junk", None), (None, "art", "song ", None, "2024-02-01 10:00", False), (None, None, "x", 5, None, None)]
    h = spark.createDataFrame(rows, "uri string, artistName string, trackName string, msPlayed long, ts string, skipped boolean")
    got = {r["usage_key"]: r for r in usage.usage(usage.events(h)).collect()}
    assert set(got) == {"a", "name::art::song"}
    assert got["a"]["skips"] == 1 and got["a"]["skip_ms"] == 60_000
    assert got["name::art::song"]["plays"] == 2 and got["name::art::song"]["total_ms"] == 1000 and got["name::art::song"]["last_played"] == dt.datetime(2024, 2, 1, 10, 0)


def test_usage_falls_back_to_names(spark):
    used = spark.createDataFrame([("name::art::song", 7, 1, None, 0, 0)], "usage_key string, plays long, total_ms long, last_played timestamp, skips long, skip_ms long")
    tracks = spark.createDataFrame([("t1", "Song", ["Art", "B"]), ("t2", "None", ["Art"])], "id string, name string, artists array<string>")
    got = {r["id"]: r["usage"] for r in usage.with_usage(tracks, used).collect()}
    assert got["t1"]["plays"] == 7 and got["t2"] is None


def test_empty_selection_keeps_all(spark):
    members = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "1"), ("h", "3")], "bucket string, id string")
    chosen = spark.createDataFrame([("h", "3")], "bucket string, id string")
    assert sorted(map(tuple, usage.selected(members, chosen).collect())) == [("g", "1"), ("g", "2"), ("h", "3")]


RAW = "id string, name string, artists array<string>, album string, year string, isrc string, durationMs string, popularity double"


def test_canonical_records_and_rejects(spark):
    raw = spark.createDataFrame([("i1", " Test  Track ", ["Test Artist"], "Al", "1999-05-01", "us-rc1-11-11111", "1000", 50.0), ("i2", None, ["A"], None, None, None, None, None), ("i3", "T", [], None, None, None, None, None)], RAW)
    good, bad = canonical.canonical(raw, "set", now=F.lit("2024-01-01T00:00:00+00:00"))
    r = good.first()
    assert (r["track_id"], r["title"], r["year"], r["duration_ms"]) == ("isrc:USRC11111111", "Test Track", 1999, 1000)
    assert r["aliases"]["normalized_artists_key"] == "test_artist"
    assert sorted(x["reasons"][0] for x in bad.collect()) == ["missing artists", "missing title"]
    errors, warnings = quality.song_rules()
    checked = quality.validated(good, errors, warnings).first()
    assert checked["errors"] == [] and checked["warnings"] == []


def test_lookup_takes_the_strongest_key(spark):
    keys = enrich.lookup_keys(F.lit("s"), F.lit("i"), F.lit(None).cast("string"), F.lit("al"))
    rows = spark.range(1).select(F.lit("t").alias("row"), keys.alias("keys"))
    lookup = spark.createDataFrame([("isrc", "i", "by isrc"), ("alias", "al", "by alias")], "key_type string, key string, payload string")
    assert tuple(enrich.priority_lookup(rows, "row", "keys", lookup).first()) == ("t", "isrc", "by isrc")


def test_upsert_updates_the_last_of_equal_keys(spark):
    schema = "k string, mbid string, tags array<string>, ord int"
    base = spark.createDataFrame([("a", None, ["x"], 1), ("a", None, ["x"], 2), ("b", "m", ["x", "y"], 3)], schema)
    delta = spark.createDataFrame([("a", "n", ["p", "q"], 1), ("b", "z", ["p"], 2), ("c", None, [], 3)], schema)
    got = {(r["k"], r["ord"]): (r["mbid"], r["tags"]) for r in enrich.upsert(base, delta, "k", ["mbid"], ["tags"], "ord").collect()}
    assert got == {("a", 1): (None, ["x"]), ("a", 2): ("n", ["p", "q"]), ("b", 3): ("m", ["x", "y"]), ("c", 3): (None, [])}


def test_title_and_artist_match(spark):
    rows = spark.createDataFrame([("t1", "My Song", ["An Artist"]), ("t2", "Other", ["Nobody"])], "track_id string, title string, artists array<string>")
    recs = spark.createDataFrame([("m1", 1, "my song", ["An  Artist"], 5), ("m2", 2, "My Song (live)", ["An Artist"], 9)], "mbid string, ord int, title string, artist_credit array<string>, source_score int")
    got = {r["track_id"]: r["mbid"] for r in matching.by_title_artist(rows, recs).collect()}
    assert got == {"t1": "m1"}


def test_genres_keep_artist_order(spark):
    tracks = spark.createDataFrame([("t", ["a", "b"]), ("u", ["c"])], "track_id string, artist_ids array<string>")
    artists = spark.createDataFrame([("a", ["rock", "pop"]), ("b", ["pop", "folk"]), ("c", [])], "artist_id string, genres array<string>")
    assert [tuple(r) for r in enrich.assembled_genres(tracks, artists).collect()] == [("t", ["rock", "pop", "folk"])]


def test_index_checks(spark):
    groups = spark.createDataFrame([("r", 0, "bad", ["0", "100", "-1", "abc", "0", "1.5", "1", "2"]), ("r", 1, "dup", ["0", "1", "3"]), ("r", 2, "two", ["4", "5"])], "req string, group_pos int, name string, track_indices array<string>")
    tracks = spark.createDataFrame([("r", i, None if i == 3 else f"t{i}") for i in range(6)], "req string, idx int, id string")
    got = {r["name"]: r["track_ids"] for r in serve.checked_indices(groups, tracks, "req").collect()}
    assert got == {"bad": ["t0", "t1", "t2"], "two": ["t4", "t5"]}


def test_meter_boundaries():
    now = dt.datetime(2024, 1, 1)
    m = serve.Meter()
    assert m.ask(now, None, True, False, True) == ("cached", 0)
    assert m.ask(now, None, False, False, True) == ("fresh", 1)
    assert m.ask(now + dt.timedelta(seconds=29), None, False, False, True) == ("rate", 1)
    assert m.ask(now + dt.timedelta(seconds=30), None, False, False, False) == ("failed", 1)
    assert m.ask(now + dt.timedelta(seconds=30), None, True, True, True) == ("fresh", 2)
    assert m.ask(now + dt.timedelta(seconds=60), None, False, False, True) == ("fresh", 3)
    assert m.ask(now + dt.timedelta(seconds=90), "past_due", False, False, True) == ("quota", 3)
    assert m.ask(now + dt.timedelta(seconds=90), "active", False, False, True) == ("fresh", 4)
    assert m.ask(now + dt.timedelta(days=30), None, False, False, True) == ("fresh", 1)


def test_usage_stream(spark, tmp_path):
    e = spark.createDataFrame([("a", 5, False, dt.datetime(2024, 1, 1)), ("a", 7, True, dt.datetime(2024, 1, 2)), ("b", 1, False, None)], "usage_key string, ms long, skipped boolean, ts timestamp")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streams.usage_stream(streams.read_events(spark, str(tmp_path / "in"), "usage_key string, ms long, skipped boolean, ts timestamp"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("used").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("used").collect())) == sorted(map(tuple, usage.usage(e).collect()))


def test_names_and_groups(spark):
    feats = spark.createDataFrame([("p", 0, "tag__jazz_rap", 0.9, 1), ("p", 0, "acoustic__highlevel__timbre__all__dark", 0.8, 2), ("p", 0, "genre__boom_bap", 0.7, 3), ("p", 1, "acoustic__highlevel__timbre__all__dark", 0.1, 1)], "playlist_id string, cluster int, feature string, score double, rank int")
    got = {r["cluster"]: r["name"] for r in route.cluster_names(feats, ["playlist_id", "cluster"]).collect()}
    assert got == {0: "jazz rap / timbre / dark", 1: "mixed vibe cluster"}
    cases = {"mixed vibe cluster": "More Picks", "jazz rap / boom bap": "Jazz / Nujabes / Downtempo", "garage rock / house": "Rock / Indie", "trap soul / r and b": "Trap", "emo rap": "Melodic / Party Rap", "": "Electronic / Dance"}
    df = spark.createDataFrame([(n, ["techno"]) for n in cases], "name string, pretty array<string>")
    assert {r["name"]: r["g"] for r in df.select("name", route.display_group(F.col("name"), F.col("pretty")).alias("g")).collect()} == cases


def test_suffixes_are_distinct(spark):
    c = spark.createDataFrame([("p", 0, "Rock / Indie", 9, ["x"]), ("p", 1, "Rock / Indie", 8, ["rock", "surf"]), ("p", 2, "Rock / Indie", 7, ["surf"])], "playlist_id string, cluster int, display_group string, size int, terms array<string>")
    assert {r["cluster"]: r["label"] for r in route.suffixed(c).collect()} == {0: "Rock / Indie", 1: "Rock / Indie: surf", 2: "Rock / Indie 3"}


def blobs(spark, sizes, playlist="p"):
    rows = [(playlist, f"{c}-{i}", [10.0 * c + 0.01 * i, float(c % 2)]) for c, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "playlist_id string, track_key string, embedding array<double>")


def test_two_far_blobs(spark):
    labels, solutions = cluster.cluster_playlists(blobs(spark, [15, 15]), 2, 4, 5)
    got = {(r["track_key"][0], r["cluster"]) for r in labels.collect()}
    assert len(got) == 2 and solutions.first()["silhouette"] > 0.9


def test_small_cluster_is_merged_into_the_nearest(spark):
    pts = blobs(spark, [10, 10, 2]).withColumn("cluster", F.substring("track_key", 1, 1).cast("int"))
    merged = cluster.merged_small(pts, ["playlist_id"], 5)
    sizes = {r["cluster"]: r["n"] for r in merged.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 10, 1: 12}


def test_candidate_ks(spark):
    got = {n: one(spark, cluster.candidate_ks(F.lit(n))) for n in (1, 2, 10, 45, 130, 400)}
    assert got[1] == [] and got[45] == [3, 4, 5] and got[130] == list(range(4, 13)) and got[400] == list(range(5, 13))


def test_features_of_records(spark):
    raw = spark.createDataFrame([("i1", "T", ["A"], None, "2000", None, None, 50.0), ("i2", "U", ["A"], None, "2010", None, None, None)], RAW)
    good, _ = canonical.canonical(raw, "set", now=F.lit("x"))
    got = {(r["track_id"], r["feature"]): r["value"] for r in features.song_features(good).collect()}
    assert abs(got["spotify:i1", "meta__year_z"] + 0.25) < 1e-9 and abs(got["spotify:i1", "meta__popularity_scaled"] - 0.075) < 1e-9
    assert ("spotify:i2", "meta__has_popularity") not in got


def test_key_and_mode(spark):
    major = [v / 10 for v in audio.MAJOR]
    df = spark.createDataFrame([("c", major), ("d", major[-2:] + major[:-2])], "id string, chroma array<double>")
    got = {r["id"]: (r["pitch"], r["mode"]) for r in audio.key_and_mode(df, "id").collect()}
    assert got == {"c": ("C", "major"), "d": ("D", "major")}


def test_record_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"track_id": "1", "title": "T"}\n')
    got = records.with_file(records.records(spark, str(tmp_path))).select("track_id", "source_file").collect()
    assert [tuple(r) for r in got] == [("1", "a.json")]
    (tmp_path / "p.txt").write_text('{"tracks": [{"id": "x"}, 3, {"id": "y"}]}')
    assert records.playlist_items(spark, str(tmp_path / "p.txt")).count() == 2


def test_cache_keeps_the_first_writer(spark):
    answers = spark.createDataFrame([("k", "late", 2), ("k", "early", 1), ("old", "x", 1)], "cache_key string, v string, created_at int")
    cache = spark.createDataFrame([("old", "y")], "cache_key string, v string")
    assert [r["v"] for r in records.cache_additions(answers, cache).collect()] == ["early"]


def test_no_python_in_native_plans(spark):
    used = spark.createDataFrame([("a", 1, False, None)], "usage_key string, ms long, skipped boolean, ts timestamp")
    plan = usage.usage(used)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_silhouette_is_exact_for_many_rows(spark):
    # half of the points stand at 0, half at 1 with one at 9: all of them count, however many there are
    n = 5200
    rows = [("p", f"k{i}", i % 2, [9.0 if i == 1 else float(i % 2)]) for i in range(n)]
    points = spark.createDataFrame(rows, "playlist_id string, track_key string, cluster int, embedding array<double>")
    at = [r[3][0] for r in rows]
    values = {0.0: 0, 1.0: 1, 9.0: 1}
    counts = {x: at.count(x) for x in values}
    want = 0.0
    for x, c in values.items():
        mean = {k: sum(abs(x - y) * m for y, m in counts.items() if values[y] == k) / (n // 2 - (k == c)) for k in (0, 1)}
        want += counts[x] * (mean[1 - c] - mean[c]) / max(mean.values()) / n
    assert cluster.silhouette(points, ["playlist_id"]).first()["silhouette"] == pytest.approx(want, abs=1e-9)


def test_silhouette_sends_a_point_once_a_block(spark, monkeypatch):
    """Larger groups have larger blocks, and what they send stays in proportion; keys that a group repeats are one point."""
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 20)
    draw = np.random.default_rng(5)
    e, labels, keys = draw.normal(size=(2400, 3)), draw.integers(0, 4, 2400), np.arange(2400) // 2 * 2
    rows = [("p", f"k{k}", int(c), [float(v) for v in x]) for k, c, x in zip(keys, labels, e, strict=True)]
    points = spark.createDataFrame(rows, "playlist_id string, track_key string, cluster int, embedding array<double>")
    apart, other = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2)), keys[:, None] != keys[None]
    sums, counts = (np.stack([(m * other)[:, labels == c].sum(1) for c in range(4)], 1) for m in (apart, np.ones_like(apart)))
    own = {}
    for k, c, s, n in zip(keys, labels, sums, counts, strict=True):
        for to in range(4):
            old = own.setdefault((k, c, to), [0.0, 0])
            own[k, c, to] = [old[0] + s[to], old[1] + n[to]]
    mean = {k: s / n for k, (s, n) in own.items()}
    a, b = {}, {}
    for (k, c, to), m in mean.items():
        if c == to:
            a[k] = max(a.get(k, 0), m)
        else:
            b[k] = min(b.get(k, np.inf), m)
    want = float(np.mean([(b[k] - a[k]) / max(a[k], b[k]) for k in a]))
    for numbers, blocks in ((cluster.BLOCK_NUMBERS, 6), (4 * 200, 12)):  # a block of 200 rows at most in the second
        monkeypatch.setattr(cluster, "BLOCK_NUMBERS", numbers)
        assert cluster._blocks(points, ["playlist_id"]).first()["__blocks"] == blocks
        assert cluster.silhouette(points, ["playlist_id"]).first()["silhouette"] == pytest.approx(want, abs=1e-9)


def _reads(df):
    """How often its plan reads a table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_features_are_made_once(spark, tmp_path):
    """A record makes all its features in one read, another is for the years; reports and fills don't make them again."""
    draws = [(str(i), 1990 + i % 9, i % 5) for i in range(40)]
    raw = spark.createDataFrame(draws, "id string, year int, n int").withColumns({"title": F.lit("t"), "artists": F.array(F.lit("a")), "popularity": F.lit("50"), "tags": F.array(F.struct(F.concat(F.lit("tag "), "n").alias("name"), F.lit(2.0).alias("count")))})
    raw.unionByName(raw.where("id = '0'")).write.parquet(str(tmp_path / "raw"))
    songs = canonical.canonical(spark.read.parquet(str(tmp_path / "raw")), "d")[0]
    made = features.song_features(songs)
    assert _reads(made) <= 3
    assert _reads(features.matrix_report(made, songs, "track_id")) <= 4
    means = spark.createDataFrame([("acoustic__x", 0.5)], "feature string, value double")
    filled = features.fill_acoustic(made, songs.select("track_id").distinct(), means)
    assert _reads(filled) <= 3 and filled.count() == made.count() + 40
    got = {(r["track_id"], r["feature"]): r["value"] for r in made.collect()}
    assert [k for k, f in got if f == "tag__tag_0" and got[k, f] > 1.5] == ["spotify:0"]  # its rows' weights add up, its flags don't
    assert {v for (_, f), v in got.items() if f.startswith("meta__has_")} == {0.1}


def test_tags_are_kept_in_arrays(spark):
    df = spark.sql("SELECT 1 k, array(named_struct('name', 'Rhythm & Blues', 'count', null), named_struct('name', ' ', 'count', 2.0), named_struct('name', 'x', 'count', -1.0), named_struct('name', 'Billboard Hot', 'count', 1.0), null) t UNION ALL SELECT 2, null")
    assert [tuple(r) for r in names.exploded_tags(df, "k", "t").collect()] == [(1, "r_and_b", 1.0)]


def test_lookup_tasks_do_not_grow_with_the_table(spark):
    """Rows meet again in as many partitions as they fill, and the join sorts none of them."""
    assert catalogue.parts_of(spark, 10 * catalogue.TASK_ROWS * 100) == 1000 and catalogue.parts_of(spark, 0) >= spark.sparkContext.defaultParallelism
    rows = spark.range(50).select("id", F.array(F.struct(F.lit("a").alias("key_type"), F.lit(0).alias("prio"), F.col("id").alias("key")), F.struct(F.lit("b").alias("key_type"), F.lit(1).alias("prio"), (F.col("id") % 5).alias("key"))).alias("keys"))
    lookup = spark.range(10).select(F.lit("a").alias("key_type"), F.col("id").alias("key"), F.lit("A").alias("payload")).unionByName(spark.range(4).select(F.lit("b").alias("key_type"), F.col("id").alias("key"), F.lit("B").alias("payload")))
    found = enrich.priority_lookup(rows, "id", "keys", lookup, 7)
    assert {r["id"]: (r["match_type"], r["payload"]) for r in found.collect()} == {i: ("a", "A") if i < 10 else ("b", "B") for i in range(50) if i < 10 or i % 5 < 4}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan and ", 7)" in plan


def test_genres_are_not_sorted_by_track(spark):
    """Artists bring their genres as lists to the join, and the first places of genres are kept by hash."""
    tracks = spark.createDataFrame([("t", ["a", "b", None]), ("u", ["c"])], "track_id string, artist_ids array<string>")
    artists = spark.createDataFrame([("a", ["rock", None, "pop"]), ("b", ["pop", "rock", "folk"]), ("c", None)], "artist_id string, genres array<string>")
    made = enrich.assembled_genres(tracks, artists)
    assert [tuple(r) for r in made.collect()] == [("t", ["rock", None, "pop", "folk"])]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode(genres") < plan.index("Join") and "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_numeric_leaves_of_large_batches(spark, monkeypatch):
    """Rows without leaves between others, whole batches cut short by many leaves, and texts that aren't objects keep their keys."""
    monkeypatch.setattr(names, "LEAVES", 5)
    texts = ['{"a": 1, "b": {"c d": [1, true, "x", {"e": 2.5}]}}', None, "not json", "3", '[4, {"version": 5, "!": {"x": 6}}]', '{"big": 1' + "0" * 400 + "}", "{}"]
    want = [[("a", 1.0), ("b__c_d__0", 1.0), ("b__c_d__3__e", 2.5)], [], [], [], [("0", 4.0), ("1____x", 6.0)], [("big", float("inf"))], []]
    got = []
    for text in texts:
        paths, values = [], []
        names.add_leaves(text, paths, values)
        got.append(sorted(zip(paths, values, strict=True)))
    assert got == want
    df = spark.createDataFrame([(i, texts[i % 7]) for i in range(70)], "k int, j string").coalesce(1)
    found = {}
    for r in names.numeric_leaves(df, "k", "j").collect():
        found.setdefault(r["k"], []).append((r["path"], r["value"]))
    assert {k: sorted(v) for k, v in found.items()} == {i: want[i % 7] for i in range(70) if want[i % 7]}


def test_lines_are_dealt_by_key(spark):
    """Dealing rows round robin would sort each partition first."""
    plan = songs.json_numeric_leaves(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan
