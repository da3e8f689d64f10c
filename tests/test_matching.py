"""Title and artist matching against a plain loop over all pairs, in many scripts."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from chorale.functions import text
from chorale.operators import matching
from chorale.plans import songs
from tests.conftest import DATA

ROWS, RECORDINGS = "track_id string, title string, artists array<string>", "mbid string, ord int, title string, artist_credit array<string>, source_score int"


def squeezed(s):
    return re.sub(r"\s+", " ", s or "").strip()


def folded(s):
    low = squeezed(s).lower()
    plain = "".join(c for c in unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFKD", low) if not ("̀" <= c <= "ͯ" or "ً" <= c <= "ْ"))))
    plain = " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in plain).split())
    return plain or low


def form(s, sep):
    s = s.lower().replace("&", " and ") if sep == "_" else s.lower()
    return re.sub("[^a-z0-9]+", sep, s).strip(sep)


def brute(rows, recordings, profile):
    p, out = matching.PROFILES[profile], {}
    sep = "-" if p["least"] else "_"

    def points(a, b, given):
        return given[0] if a.lower() == b.lower() else given[1] if form(a, sep) and form(a, sep) == form(b, sep) else given[2] if a.lower() in b.lower() else 0

    for key, title, artists in rows:
        t, a, best = squeezed(title), squeezed((artists or [""])[0]), None
        for mbid, ord_, rt, ra, score in recordings if t or a else []:
            rt, ra = squeezed(rt), [squeezed(x) for x in ra or [] if squeezed(x)]
            if not squeezed(mbid) or folded(t) not in folded(rt) or a and not any(folded(a) in folded(x) for x in ra):
                continue
            own = (points(t, rt, p["title"]) if t else 0) + (max([points(a, x, p["artist"]) for x in ra], default=0) if a else 0)
            best = max(best or (-1,), (own + (score or 0) if p["least"] else own, score or 0, -ord_, mbid))
        if best and (not p["least"] or best[0] >= p["least"]):
            out[key] = (best[3], best[0])
    return out


def matched(spark, rows, recordings, profile="search", block=matching.BLOCK):
    out = matching.by_title_artist(spark.createDataFrame(rows, ROWS), spark.createDataFrame(recordings, RECORDINGS), profile, block=block)
    return {r["track_id"]: (r["mbid"], r["points"]) for r in out.collect()}


def test_titles_of_other_scripts_match_themselves_alone(spark):
    recordings = [("ja", 1, "夜に駆ける", ["米津玄師"], 5), ("ru", 2, "Группа крови", ["Кино"], 60), ("ar", 3, "أهواك", ["عبد الحليم حافظ"], 5), ("ko", 4, "봄날", ["방탄소년단"], 5), ("fr", 5, "Déjà Vu", ["Beyoncé", "JAY‐Z"], 5), ("no", 6, None, None, None), ("", 7, "夜に駆ける", ["米津玄師"], 99)]
    rows = [("a", "夜に駆ける", ["米津玄師"]), ("b", "Группа Крови", ["КИНО"]), ("c", "أَهواك", ["عبد الحليم حافظ"]), ("d", "봄날", ["방탄소년단"]), ("e", "deja vu", ["Beyonce"]), ("f", "駆け", ["米津玄師"]), ("g", "夜", ["Кино"]),
            ("h", "  ", []), ("i", None, None), ("j", "　", ["Кино"]), ("k", "新しい歌", ["新人"]), ("l", "夜に駆ける", None)]
    got = matched(spark, rows, recordings)
    assert got == brute(rows, recordings, "search")
    assert {k: v[0] for k, v in got.items()} == {"a": "ja", "b": "ru", "c": "ar", "d": "ko", "f": "ja", "j": "ru", "l": "ja"}
    assert {k: v[0] for k, v in matched(spark, rows, recordings, "simple").items()} == {k: v[0] for k, v in brute(rows, recordings, "simple").items()}
    assert matched(spark, rows, []) == {} == matched(spark, [], recordings)


@pytest.mark.parametrize("profile", ["search", "simple"])
@pytest.mark.parametrize("block", [matching.BLOCK, 7])
def test_matching_against_all_pairs(spark, profile, block):
    draw = random.Random(7)
    words = ["love", "glove", "Über", "uber", "夜", "に", "قلب", "no.", "No", "5", "ночь", "!!!", "été", "the", "the", "the"]
    title = lambda k: draw.choice([" ", "  ", ""] if draw.random() < 0.2 else [" "]).join(draw.choices(words, k=k))
    artists = ["Various Artists"] * 6 + ["Björk", "björk", "Bjork", "椎名林檎", "AC/DC", "ac dc", " ", None]
    recordings = [(f"m{i}", i, title(draw.randint(0, 4)), [draw.choice(artists) for _ in range(draw.randint(0, 2))], draw.choice([None, 0, 3, 30])) for i in range(150)]
    rows = [(f"t{i}", title(draw.randint(0, 3)), [draw.choice(artists)]) for i in range(150)]
    assert matched(spark, rows, recordings, profile, block) == brute(rows, recordings, profile)


def test_blocks_are_bounded(spark):
    """A third of all recordings and questions share title words and artist: no block holds more than a stated number of either."""
    queries = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("q"), F.lit("").alias("t"), F.concat(F.lit("various"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("")).alias("a"))
    held = spark.range(900).select(F.concat(F.lit("m"), "id").alias("mbid"), F.col("id").cast("int").alias("ord"), F.lit(0).alias("score"), F.lit("Intro").alias("rt"), F.array(F.lit("Various")).alias("ra"))
    pairs = matching.candidates(queries, held, block=50)
    assert pairs.count() == 100 * 900
    taken = held.select(F.pmod(F.xxhash64("mbid", "ord"), F.lit(18)).alias("part")).groupBy("part").count().agg(F.max("count")).first()[0]
    assert taken < 100


def test_fold(spark):
    for given in ["Beyoncé", "ＡＢＣ　１", "Straße", "ガギ", "أَهواك", "  A&B — c ", "!!!", "", None, "Ångström…"]:
        assert spark.range(1).select(text.fold(F.lit(given).cast("string")).alias("x")).first()["x"] == folded(given)


def test_copies_and_common_grams_meet_once(spark, monkeypatch):
    """Recordings of one title and credit are held once, and titles whose short grams are all common meet few others."""
    seen = {}
    monkeypatch.setattr(matching, "stored", lambda df, label, put=matching.stored: seen.setdefault(label, put(df, label)))
    recordings = [(f"m{i}", i, f"large ring no {i % 300}", ["Brand"], i % 7) for i in range(1200)]
    rows = [(f"t{i}", f"Large Ring No {i}", ["Brand"]) for i in range(100, 300)]
    assert matched(spark, rows, recordings) == brute(rows, recordings, "search")
    assert seen["recordings"].count() == 300
    assert seen["rarest"].agg(F.max("n")).first()[0] <= 100


def test_raw_tracks_are_dealt_to_all_cores(spark):
    for made in (songs._raw(spark, DATA), songs._recordings(spark, DATA)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
