"""Matching of titles and artists with recordings: an inverted index of folded character grams, asked by each query's rarest one.

A recording is a candidate if its folded title holds the folded title asked for and one of its credited artists the artist,
in any script. All grams of what is asked for stand in a candidate then, so the rarest of them alone finds every candidate.
Grams are told by hash: two that share one only bring candidates more to compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.text import fold, slug, squeeze, token
from chorale.session import stored

#: Points for title and artist: exact text, equal slugs, one that holds the other; the least total that matches (fixed values).
PROFILES = {"search": {"title": (50, 35, 20), "artist": (40, 25, 0), "least": 35}, "simple": {"title": (3, 3, 0), "artist": (3, 3, 0), "least": None}}
#: Code points of a gram; a text asks by those of the greatest length that it has, so that longer texts meet fewer recordings.
GRAMS = (1, 2, 3, 6, 12, 24)
#: Recordings, and queries, of one gram that meet in one block at most, about.
BLOCK = 10_000


def _grams(c: Column, size: int, kind: str) -> Column:
    """Hashes of all substrings of this length."""
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1)))
    return F.when(F.length(c) >= size, F.transform(places, lambda i: F.xxhash64(F.lit(kind), F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<long>"))


def _asked(c: Column, kind: str) -> Column:
    """Keys that a candidate must have; none for a blank text."""
    of = F.array().cast("array<long>")
    for size in GRAMS:
        of = F.when(F.length(c) >= size, _grams(c, size, kind)).otherwise(of)
    return of


def _held(c: Column, kind: str) -> Column:
    return F.flatten(F.array(*(_grams(c, size, kind) for size in GRAMS)))


def _points(asked: Column, held: Column, given: tuple[int, int, int], same: Column) -> Column:
    return F.when(F.lower(asked) == F.lower(held), given[0]).when(same, given[1]).when(F.contains(F.lower(held), F.lower(asked)), given[2]).otherwise(0)


def candidates(queries: DataFrame, recordings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of queries (q, t, a) and recordings (mbid, ord, score, rt, ra) that hold title and artist; neither side of a block exceeds `block` rows, about."""
    q = stored(queries.select("*", fold(F.col("t")).alias("ft"), fold(F.col("a")).alias("fa")), "queries")
    r = stored(recordings.select("*", fold(F.col("rt")).alias("frt"), F.transform("ra", fold).alias("fra"), F.monotonically_increasing_id().alias("r")), "recordings")
    keys = F.array_distinct(F.concat(_held(F.col("frt"), "t"), F.flatten(F.transform("fra", lambda x: _held(x, "a")))))
    each = q.select("q", F.explode(F.array_distinct(F.concat(_asked(F.col("ft"), "t"), _asked(F.col("fa"), "a")))).alias("gram"))
    counts = r.select(F.explode(keys).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).join(each.select("gram").distinct(), "gram")
    rarest = each.join(counts, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("q", "x.gram", "x.n")
    rarest = stored(rarest, "rarest")
    sizes = stored(rarest.groupBy("gram").agg(F.ceil(F.max("n") / block).cast("long").alias("parts"), F.ceil(F.count("*") / block).cast("long").alias("shares")), "sizes")
    part, share = F.pmod(F.xxhash64("r"), F.col("parts")), F.pmod(F.xxhash64("q"), F.col("shares"))
    asking = rarest.select("q", "gram").join(sizes, "gram").select("q", "gram", share.alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    index = r.select("r", F.explode(keys).alias("gram")).join(sizes, "gram").select("r", "gram", part.alias("part"), "shares").join(r, "r")
    index = index.select(*r.columns, "gram", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    pairs = asking.join(q, "q").join(index, ["gram", "part", "share"])
    return pairs.where(F.contains("frt", "ft") & ((F.col("fa") == "") | F.exists("fra", lambda x: F.contains(x, F.col("fa"))))).select(*queries.columns, "mbid", "ord", "score", "rt", "ra")


def by_title_artist(rows: DataFrame, recordings: DataFrame, profile: str = "search", key: str = "track_id", block: int = BLOCK) -> DataFrame:
    """(key, mbid, points): the best recording for title and first artist of each row; rows without one are left out.

    Recordings whose title and credited artists hold what is asked for are candidates, compared in lower case without
    accents and punctuation; a blank title or artist asks nothing, rows with neither are left out, and recordings without
    an mbid too. Points are of the profile, for any credited artist; equal slugs count where they aren't empty. Of
    equals the greater source score, then the smaller ord wins. Equal questions are asked once, and of recordings of one
    title and credit only the one that wins is held against them.
    """
    p = PROFILES[profile]
    asked = rows.select(key, squeeze(F.col("title")).alias("t"), squeeze(F.get("artists", F.lit(0))).alias("a")).where("t != '' OR a != ''").distinct()
    queries = asked.select("t", "a").distinct().select(F.sha2(F.concat_ws("\n", "t", "a"), 256).alias("q"), "t", "a")
    credited = F.filter(F.transform(F.coalesce("artist_credit", F.array().cast("array<string>")), squeeze), lambda x: x != "")
    held = recordings.where(squeeze(F.col("mbid")) != "").select("mbid", "ord", F.coalesce("source_score", F.lit(0)).alias("score"), squeeze(F.col("title")).alias("rt"), credited.alias("ra"))
    first = held.groupBy("rt", "ra").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "mbid")).alias("x"))
    held = first.select("x.mbid", (-F.col("x.o")).alias("ord"), "x.score", "rt", "ra")
    form = token if p["least"] is None else slug

    def equal(x: Column, y: Column) -> Column:
        return (form(x) == form(y)) & (form(x) != "")

    title = F.when(F.col("t") != "", _points(F.col("t"), F.col("rt"), p["title"], equal(F.col("t"), F.col("rt")))).otherwise(0)
    artist = F.when(F.col("a") != "", F.coalesce(F.array_max(F.transform("ra", lambda x: _points(F.col("a"), x, p["artist"], equal(F.col("a"), x)))), F.lit(0))).otherwise(0)
    text = title + artist
    scored = candidates(queries, held, block).withColumn("points", text + F.col("score") if p["least"] is not None else text)
    best = scored.groupBy("t", "a").agg(F.max(F.struct("points", "score", (-F.col("ord")).alias("o"), "mbid")).alias("x"))
    best = best if p["least"] is None else best.where(F.col("x.points") >= p["least"])
    return asked.join(best, ["t", "a"]).groupBy(key).agg(F.max("x").alias("x")).select(key, "x.mbid", "x.points")
