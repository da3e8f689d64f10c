"""The ten operators against brute force, round trips and held-out labels, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chorale.llm import common, decontamination, license_scan, line_dedup, lm_scoring, near_duplicates, packing, quality, queries, sharding, token_counts, toxicity
from tests.conftest import DATA
from tests.test_queries import TABLES, rows

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, ""), (4, None), (5, "  \n\t "), (None, "one two three four five six seven"),
    (6, "tie tie tie tie tie tie tie tie"), (7, "x" * 5000), (8, "long " * 9000), (9, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (10, "naïve Çà ☃ \x00\x1c ▁ <|endoftext|> <s>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(*r, 1.0, "x", 2, 3, 4, None) for r in ODD]
    return spark.createDataFrame(extra, "doc_id long, text string, score double, component_id string, h int, n int, key int, label string")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def benchmark(spark):
    return common.table(spark, DATA, "benchmark")


def runs(odd, benchmark) -> dict:
    model = toxicity.train([b"you idiot and scum", b"such an idiot of scum"], [b"a nice day", b"another good day"])
    return {
        "lm": lambda d: lm_scoring.backoff_scores(d), "license": lambda d: license_scan.scan(d), "pack": lambda d: packing.pack(d, WORDS), "near": lambda d: near_duplicates.near_duplicates(d),
        "toxic": lambda d: toxicity.scored(d, model), "shard": lambda d: sharding.shard(d), "contamination": lambda d: decontamination.contamination(d, benchmark), "quality": lambda d: quality.judged(d),
        "lines": lambda d: line_dedup.summary(d), "tokens": lambda d: token_counts.token_counts(d, PIECES),
    }


NAMES = ["lm", "license", "pack", "near", "toxic", "shard", "contamination", "quality", "lines", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables_keep_their_rows(odd, benchmark, name):
    out = runs(odd, benchmark)[name](odd).toPandas()
    assert len(out) == len(ODD) + (7 if name == "pack" else 0) or name == "pack"
    assert set(out["doc_id"].dropna()) == set(range(1, 11))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(odd, benchmark, name):
    assert runs(odd, benchmark)[name](odd.where("false")).count() == 0


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, db, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(queries.ORACLE[name]).df())


@pytest.mark.parametrize("order", [2, 3])
def test_backoff_scores(docs, texts, order):
    got = {r["doc_id"]: r for r in lm_scoring.backoff_scores(docs, order).collect()}
    words = {i: common.spaced_words(t.encode()) for i, t in texts.items()}
    grams = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    own = {(i, n): grams(w, n) for i, w in words.items() for n in range(1, order + 1)}
    every = [sum((own[i, n] for i in words), collections.Counter()) for n in range(1, order + 1)]
    total = sum(map(len, words.values()))
    for i, w in words.items():
        other = lambda g, i=i: every[len(g) - 1][g] - own[i, len(g)][g]

        def score(g):
            if len(g) == 1:
                return math.log((other(g) or 0.4) / (total - len(w)))
            return math.log(other(g) / other(g[:-1])) if other(g) and other(g[:-1]) else math.log(0.4) + score(g[1:])

        assert got[i]["log_score"] == pytest.approx(sum(score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))))


def test_licenses(spark):
    d = spark.createDataFrame([(1, "x Licensed under the Apache License, Version 2.0. y"), (2, "licensed under the very old apache license version 2 0"), (3, "the apache tribe"), (4, "GNU General Public License twice: general public license")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["apache-2.0", "apache-2.0", "", "gpl"]
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 1, 5)
    assert got[1]["score"] == 1.0 and 0.7 <= got[2]["score"] <= 1 and got[3]["score"] == 0


def test_licenses_of_rows_that_share_an_id(spark):
    d = spark.createDataFrame([(1, "released under the mit license"), (1, "no license here at all"), (None, "released under the mit license"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["labels"]) for r in license_scan.scan(d).collect()) == [("1", 5, ""), ("1", 5, "mit"), ("None", 0, ""), ("None", 5, "mit")]


def test_words_beyond_ascii_are_not_lowered_to_ascii(spark):
    d = spark.createDataFrame([(1, "this wor\u212a has been dedicated to the public domain"), (2, "THIS WORK has been dedicated to the Public Domain"), (3, "All R\u0130GHTS reserved"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["labels"]) for r in license_scan.scan(d).collect()}
    assert got[2] == (9, "public-domain") and got[3] == (3, "") and got[4] == (0, "")
    one = {r["word_"]: r["n"] for r in d.where("doc_id = 1").select(F.explode(license_scan.words(F.col("text"))).alias("word_")).groupBy("word_").agg(F.count("*").alias("n")).collect()}
    assert "work" not in one and sum(one.values()) == 9 == got[1][0]


def test_lines_of_a_table_with_odd_column_names(spark):
    names = ["doc_id", "text", "__gone", "__id", "__key", "__mask", "__row", "a.b"]
    d = spark.createDataFrame([(1, "one line of some length here\nmore", 5, 6, 7, 8, 9, 10), (2, "one line of some length here\nother", 1, 2, 3, 4, 5, 6), (None, "x", 0, 0, 0, 0, 0, 0)], ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in names))
    out = line_dedup.deduplicated(d)
    assert out.columns == names
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "one line of some length here\nmore", 5, 6, 7, 8, 9, 10), (2, "other", 1, 2, 3, 4, 5, 6), (None, "x", 0, 0, 0, 0, 0, 0)]))


def test_native_plans_have_no_python(docs):
    for out in (license_scan.scan(docs), line_dedup.removed_lines(docs), line_dedup.summary(docs)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("lengths", [(1300, 2700), (1000, 1500), (800, 2000), (5, 90), (2049, 4096)])
def test_packing_never_takes_more_than_best_fit_alone(lengths):
    values, counts = np.unique(np.random.default_rng(1).integers(lengths[0], lengths[1] + 1, 100_000), return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    alone: list = []
    packing._best_fit(alone, dict(histogram), 4096)
    plan = packing.plan(histogram, 4096)
    assert plan.sequences <= sum(times for times, _, _ in alone)
    assert sum(times * items * n for times, inside in plan.runs for n, items in inside) == sum(n * c for n, c in histogram.items())
    assert all(sum(n * items for n, items in inside) <= 4096 for _, inside in plan.runs)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = packing.pack(docs, WORDS, with_ids=True).toPandas()
    for i, own in got.groupby("doc_id"):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [1]
        own = own.sort_values("piece")
        assert list(itertools.chain(*own["ids"])) == ids
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own["ids"]] == own["ids_crc32"].tolist()
        assert own["start"].tolist() == list(range(0, len(ids), 4096)) and (own["length"].iloc[:-1] == 4096).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 4096 * 1.01) + 1


def test_words_encode_as_the_tokenizer_does():
    words, r = packing._Words(WORDS), random.Random(2)
    parts = ["a", "B", "ß", "İ", " ", "  ", "\n", "\t", "\xa0", "́", "e", "'s", "'", "<|endoftext|>", "12", "!!", "Σ", "が", "😀", "<|", "\x1c", ".", "É"]
    for _ in range(2000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert words.ids(text) == packing.pack_ids(words.tokenizer.encode(text, add_special_tokens=False).ids)


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates(docs, texts):
    assert {r[0]: tuple(r[1:]) for r in near_duplicates.near_duplicates(docs).collect()} == brute_components(texts)


def test_near_duplicates_in_a_chain_of_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(160):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x[0]: tuple(x[1:]) for x in near_duplicates.near_duplicates(d).collect()} == brute_components(texts)


def test_texts_of_one_id_are_judged_each_by_itself(spark, monkeypatch):
    """A bucket's blocks bounded in bytes change nothing; a second text of an id isn't drawn along."""
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", 2000)
    base = " ".join(f"w{i}" for i in range(80))
    rows_ = [(1, base + " one"), (2, base + " two"), (2, "wholly other words than those"), (3, "wholly other words than those"), (None, base), (4, None), (4, None), (5, "own words stand here alone and again"), (5, "own words stand here alone and again")]
    d = spark.createDataFrame([(*r, 0) for r in rows_], "doc_id long, text string, node int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_duplicates.near_duplicates(d).collect())
    assert got == sorted([("1", 77, "1", True), ("2", 77, "1", False), ("2", 1, "2", True), ("3", 1, "2", False), ("None", 76, "None", True), ("4", 0, "4", True), ("4", 0, "4", True), ("5", 3, "5", True), ("5", 3, "5", True)])
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in near_duplicates.kept(d).collect())
    assert kept == sorted([("1", base + " one"), ("2", "wholly other words than those"), ("None", base), ("4", ""), ("5", "own words stand here alone and again")])


def test_clean_judges_rows_by_their_texts(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma", "x"), (1, "quite different", "y"), (None, "alpha beta gamma", "z"), (2, None, "n"), (3, "", "e")], "doc_id long, text string, keys string")
    b = spark.createDataFrame([(9, "Alpha, beta gamma")], "item_id long, text string")
    assert sorted(r["keys"] for r in decontamination.clean(d, b).collect()) == ["e", "n", "y"]


def test_odd_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    both = r.integers(0, 2**63, 900, np.uint64)
    for j in (0.6, 0.75, 0.9):
        n = round(900 * (1 - j) / (1 + j))
        a, b = (np.unique(np.concatenate([both[n:], r.integers(0, 2**63, n, np.uint64)])) for _ in range(2))
        ones = np.bitwise_count(np.frombuffer(near_duplicates.odd_sketch(near_duplicates.minhashes(a, 250)), np.uint8) ^ np.frombuffer(near_duplicates.odd_sketch(near_duplicates.minhashes(b, 250)), np.uint8)).sum()
        assert abs(float(ones) - near_duplicates.most_ones(250, len(np.intersect1d(a, b)) / len(np.union1d(a, b)))) < 45


def test_toxicity_of_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    out = queries.op5_toxicity(spark, path).join(common.table(spark, path, "labels"), "doc_id").where("held_out").toPandas()
    toxic = out["toxic"] == 1
    assert (out["predicted"][toxic] == 1).mean() >= 0.9
    assert (out["predicted"][~toxic] == 1).mean() <= 0.05
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all()
    for lang, own in out.join(common.table(spark, path, "documents").select("doc_id", "lang").toPandas().drop_duplicates("doc_id").set_index("doc_id"), on="doc_id").groupby("lang"):
        assert (own["predicted"] == own["toxic"]).mean() >= 0.9, lang


def test_shards(docs):
    got = sharding.shard(docs, 40).toPandas()
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert len(moved) and (moved["grown_shard"] == 40).all() and got["shard"].max() < 40


@pytest.mark.parametrize("shards", [1, 2, 19, 20, 39, 40, 41])
def test_one_more_shard_takes_rows_only_into_itself(shards):
    keys = common.word_hashes([str(i).encode() for i in range(20_000)])
    now, later = (sharding.Tree(sharding.tree(n)).assign(keys) for n in (shards, shards + 1))
    moved = now != later
    assert (later[moved] == shards).all() and abs(moved.mean() * (shards + 1) - 1) < 0.35


@pytest.mark.parametrize("shards", [1, 19, 39, 40, 41, 59])
def test_grown_shard_is_the_shard_of_one_more(spark, shards):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    now, later = ({r["doc_id"]: r for r in sharding.shard(docs, n).collect()} for n in (shards, shards + 1))
    assert all(later[i]["shard"] == now[i]["grown_shard"] for i in now)


def test_shards_against_plain_draws(spark, docs, texts):
    """Sizes, checksums and the descent, one key and one child at a time."""
    got = {r["doc_id"]: r for r in sharding.shard(docs, 40).collect()}
    shards = sharding.tree(40)

    def draw(key: str, name: str, weight: float) -> float:
        h = common.word_hashes([key.encode()]) ^ common.word_hashes([name.encode()])
        x = int(common.mixed(common.mixed(h) + np.uint64(0x9E3779B97F4A7C15))[0]) >> 11
        return -math.log((x + 0.5) / 2**53) / weight

    for i, t in texts.items():
        size, at = len(t.encode()) + 16, shards
        for level in ("region", "rack", "shard"):
            children = {getattr(s, level) for s in at}
            best = min(children, key=lambda c: min(draw(str(i), f"shard {s.shard}", s.weight) for s in at if getattr(s, level) == c))
            at = [s for s in at if getattr(s, level) == best]
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["shard"], got[i]["law"]) == (size, zlib.crc32(t.encode()), at[0].shard, "key")


def test_movement_stays_in_subtrees_whose_weights_change():
    shards = sharding.tree(40)
    keys = common.word_hashes([str(i).encode() for i in range(20_000)])
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 7 else 1.0) for s in shards]
    a, b = sharding.Tree(shards).assign(keys), sharding.Tree(heavier).assign(keys)
    assert set(b[a != b]) == {7} and 300 < (a != b).sum() < 700
    counts = np.bincount(a, minlength=40)
    assert abs(counts - 500).max() < 120


def test_contamination_in_parts_equals_at_once(spark, docs, benchmark, monkeypatch):
    whole = decontamination.contamination(docs, benchmark)
    monkeypatch.setattr(decontamination, "MAX_BENCHMARK", 3000)
    assert rows(decontamination.contamination(docs, benchmark).drop("items").toPandas()) == rows(whole.drop("items").toPandas())


def test_contamination_in_parts_keeps_repeated_rows(spark, monkeypatch):
    d = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (7, "four five six"), (8, "one two three"), (None, "four five six")], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "two three")], "item_id long, text string")
    whole = decontamination.contamination(d, b)
    monkeypatch.setattr(decontamination, "MAX_BENCHMARK", 10)
    got = rows(decontamination.contamination(d.orderBy(F.desc("text")), b).drop("items").toPandas())
    assert got == rows(whole.drop("items").toPandas()) and len(got) == 5


def test_contamination_of_repeats_and_short_items(spark):
    d = spark.createDataFrame([(1, "a b c a b c"), (2, "A, b! c"), (3, "c b a"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(10, "a b c"), (9, "b c"), (8, ""), (7, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(d, b).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3, 4)] == [(6, 6, 2, True), (3, 3, 2, True), (3, 0, 0, False), (0, 0, 0, False)]
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and got[3]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x x beta"), (3, "beta"), (4, "alpha")], "doc_id long, text string")
    found = decontamination.proximity(common.stored(decontamination.index(d), "index"), [("q", [b"alpha", b"beta"])], 3)
    assert [(r["doc_id"], r["query"]) for r in found.collect()] == [(1, "q")]


def test_proximity_against_every_place(spark):
    r = random.Random(6)
    texts = {i: r.choices("abcdefgh", k=r.randint(0, 40)) for i in range(60)}
    asked = {f"q{i}": r.choices("abcdefgh", k=r.randint(1, 5)) for i in range(30)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    indexed = common.stored(decontamination.index(d), "index")
    got = {(x["doc_id"], x["query"]): x["n_places"] for x in decontamination.proximity(indexed, [(q, [t.encode() for t in w]) for q, w in asked.items()], 3).collect()}
    want = {}
    for i, w in texts.items():
        for q, terms in asked.items():
            n = sum(x == terms[0] and set(terms) <= set(w[max(0, k - 3) : k + 4]) for k, x in enumerate(w))
            if n:
                want[i, q] = n
    assert got == want


def test_cascade_order_changes_no_verdict(docs):
    ordered = quality.judged(docs, quality.RULES, measures=False, sample=1).select("doc_id", "kept")
    turned = quality.judged(docs, quality.RULES[::-1], measures=False, sample=1).select("doc_id", "kept")
    assert rows(ordered.toPandas()) == rows(turned.toPandas())
    assert {r.name for r in quality.cascade(docs, sample=2)} == {r.name for r in quality.RULES}


def test_measures_of_later_rules_are_not_made_after_a_failure():
    asked = []

    class Watched(quality.Text):
        def __getattribute__(self, name):
            if name.startswith("n_") or name == "word_chars":
                asked.append(name)
            return super().__getattribute__(name)

    text = Watched(b"few words")
    assert next(r.name for r in quality.RULES if r.fails(text)) == "few_words" and set(asked) == {"n_words"}


@pytest.mark.parametrize("text, by", [("1 2 3 4 5 6 7 eight nine ten", "letterless"), ("- one line of words\n* two lines of words\n\u2022 three of them", "bullets"), ("a line that is cut...\nanother line, cut off as well\u2026 \nand one that goes on", "ellipses"), ("zzzzzzzzzz zzz zzzzzz za zb zc zd ze zf zg", "one_character")])
def test_usual_rules(text, by):
    assert by in [r.name for r in quality.RULES if r.fails(quality.Text(text.encode()))]


def within(a, b, most):
    if abs(len(a) - len(b)) > most:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1] <= most


@pytest.mark.parametrize("glance", [1, 4])
def test_near_lines(spark, monkeypatch, glance):
    """With a glance of 1 and a common beginning, lines meet under segments of what is left of them, too."""
    monkeypatch.setattr(line_dedup, "GLANCE", glance)
    r = random.Random(5)
    lines = ["".join(r.choices("abcdef éß", k=r.randint(24, 60))) for _ in range(40)]
    lines += ["all lines of this kind begin alike " + "".join(r.choices("abcdef", k=30 + k % 3)) for k in range(120)]
    for base in lines[:60]:
        for _ in range(3):
            x = list(base)
            for _ in range(r.randint(1, 4)):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], [r.choice("abcxyz")], [x[k], r.choice("abcxyz")]])
            lines.append("".join(x))
    lines += lines[:10] + ["short", "shorT", "short", "", "  "]
    r.shuffle(lines)
    d = spark.createDataFrame([(i // 5, line) for i, line in enumerate(lines)], "doc_id long, line string").groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("line")).alias("text"))
    d = common.stored(d, "lines")
    if glance == 1:
        assert line_dedup._common(line_dedup._keyed(line_dedup.lines(d), "line", 2, "h"), 2).count() > 0
    every = [(r["doc_id"], k, x) for r in sorted(d.collect()) for k, x in enumerate(r["text"].split("\n")) if x.strip()]
    first = {}
    for i, k, x in every:
        first.setdefault(x, (i, k))
    near = {max(a, b, key=first.get) for a, b in itertools.combinations([x for x in first if len(x) >= 24], 2) if within(a, b, 2)}
    want = {(i, k): x in near and first[x] == (i, k) for i, k, x in every if x in near or first[x] != (i, k)}
    assert near and {(r["doc_id"], r["line_no"]): r["near"] for r in line_dedup.removed_lines(d).collect()} == want
    if glance == 1:
        return
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(d).collect()}
    totals = {r["doc_id"]: r for r in line_dedup.summary(d).collect()}
    for r in d.collect():
        gone = {k: want[r["doc_id"], k] for k in range(len(r["text"].split("\n"))) if (r["doc_id"], k) in want}
        assert kept[r["doc_id"]] == "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone)
        n, near_lines = len(r["text"].split("\n")), sum(gone.values())
        assert tuple(totals[r["doc_id"]])[1:] == (n, len(gone) - near_lines, near_lines, n - len(gone))


def test_band_agrees_with_edit_distance(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(400):
        a = "".join(r.choices("abé字", k=r.randint(0, 9)))
        x = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(x) + 1)
            x[k : k + 1] = r.choice([[], [r.choice("abé字")], x[k : k + 1] + [r.choice("abé字")]])
        pairs.append((a, "".join(x)))
    d = spark.createDataFrame(pairs, "a string, b string")
    for k in (0, 1, 2, 3):
        got = [tuple(x) for x in d.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), k)).collect()]
        assert got == [(a, b, within(a, b, k)) for a, b in pairs]


def test_lines_of_one_id_with_two_texts(spark):
    d = spark.createDataFrame([(1, "a line of the first document\nshared by both"), (2, "a line of the first document\nits own"), (2, "wholly other words\nshared by both"), (None, "shared by both"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.deduplicated(d).where("text is not null").collect())
    assert got == [(0, "shared by both"), (1, "a line of the first document\nshared by both"), (2, "its own"), (2, "wholly other words"), (4, "")]
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_repeated"], r["kept_lines"]) for r in line_dedup.summary(d).collect()) == [(0, 1, 0, 1), (1, 2, 0, 2), (2, 2, 1, 1), (2, 2, 1, 1), (3, 0, 0, 0), (4, 1, 0, 1)]


def test_prefix_counts():
    of, r = token_counts.PrefixCounter(PIECES), random.Random(1)
    for _ in range(600):
        text = "".join(r.choices("ab  ▁cdeé\n\tñ字😀<s>.,aaaa\xa0 the of tion 12 3", k=r.randint(0, 30)))
        table, counts = of.table(text), [len(of.encoder.encode(text[:k])) for k in range(len(text) + 1)]
        assert [table.at(k) for k in range(len(text) + 1)] == counts and table.total == counts[-1]
        budget = r.randint(0, 12)
        assert table.longest_within(budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_prefix_counts_of_a_long_text_without_spaces():
    """By place, the same counts as by prefix; memory grows with the length and not with its square."""
    import tracemalloc

    of, r = token_counts.PrefixCounter(PIECES), random.Random(3)
    for letters in ("字学校生活人日本語の", "abcdefgh0123+/", "ab"):
        text = "".join(r.choices(letters, k=300))
        assert list(of.counts(token_counts.MARK + text))[1:] == [len(of.encoder.encode(text[:k])) if k else 1 for k in range(301)]
    text = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(200_000))
    tracemalloc.start()
    table = of.table(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.total == len(of.encoder.encode(text)) and most < 40_000_000
    k = table.longest_within(4096)
    assert len(of.encoder.encode(text[:k])) <= 4096 < len(of.encoder.encode(text[: k + 1]))


def test_token_counts_and_tables(docs, texts):
    of = token_counts.PrefixCounter(PIECES)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, PIECES, limit=100).collect()}
    for i, t in texts.items():
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len(t.encode()), len(of.encoder.encode(t)))
        assert len(of.encoder.encode(t[: got[i]["cut_chars"]])) <= 100
    table = token_counts.prefix_tables(docs.where("doc_id < 3"), PIECES).collect()
    assert all(r["counts"][-1] == got[r["doc_id"]]["n_tokens"] and len(r["counts"]) == len(texts[r["doc_id"]]) + 1 for r in table)


def brute_lines(docs):
    """(doc_id, text) of each row without the lines that stand earlier, equal or within two edits."""
    every = sorted({(i, common_key(t), t) for i, t in docs if i is not None and t is not None}, key=lambda r: r[:2])
    places = [((i, k, n), x) for i, k, t in every for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    first: dict = {}
    for place, x in places:
        first[x] = min(first.get(x, place), place)
    by_length = collections.defaultdict(list)
    for x in first:
        if len(x) >= 24:
            by_length[len(x)].append((x, collections.Counter(x)))
    near = set()
    for n, own in by_length.items():
        for (x, cx), (y, cy) in itertools.chain(itertools.combinations(own, 2), itertools.product(own, by_length.get(n + 1, ())), itertools.product(own, by_length.get(n + 2, ()))):
            if sum(((cx - cy) + (cy - cx)).values()) <= 4 and within(x, y, 2):
                near.add(max(x, y, key=first.get))
    out = []
    for i, t in docs:
        if i is None or t is None:
            out.append((i, t))
            continue
        k = common_key(t)
        kept = [x for n, x in enumerate(t.split("\n")) if x not in first or (first[x] == (i, k, n) and x not in near)]
        out.append((i, "\n".join(kept)))
    return out


def common_key(text):
    import xxhash

    return int.from_bytes(xxhash.xxh64(text.encode(), seed=42).digest(), "big", signed=True)


def brute_contaminated(text, benchmark):
    words = common.plain_words((text or "").encode())
    hit = set()
    for item in benchmark:
        w = common.plain_words((item or "").encode())
        size = min(13, len(w))
        own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in own:
                hit.update(range(k, k + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline(spark, docs, benchmark):
    """Each stage against plain Python over its own input, with nulls, empty and repeated rows and one id with two texts."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    some = [r["text"] for r in docs.limit(3).collect()]
    odd = [(-1, None), (-2, ""), (-2, ""), (-3, some[0]), (-3, "an own text that stands once"), (None, some[1]), (None, some[1]), (-4, some[2] + "\nand a line of its own at the end")]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    stage = common.stored(docs.unionByName(extra).repartition(3), "documents")
    pairs = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    order = lambda x: sorted(x, key=str)
    items = [r["text"] for r in benchmark.collect()]

    toxic = common.stored(p.toxicity(spark, stage, DATA), "toxicity")
    scorer = toxicity.fit(stage, common.table(spark, DATA, "labels")).scorer()
    assert order(pairs(toxic)) == order([(i, t) for i, t in pairs(stage) if scorer.scores([t.encode() if t else None])[0] < 0.5])
    lines = common.stored(p.line_dedup(spark, toxic, DATA), "lines")
    assert order(pairs(lines)) == order(brute_lines(pairs(toxic)))
    near = common.stored(p.near_dedup(spark, lines, DATA), "near")
    rows_ = pairs(lines)
    named = {(i, t): (i, k) for k, (i, t) in enumerate(dict.fromkeys(x for x in rows_ if x[0] is not None))}
    found = brute_components({v: t for (i, t), v in named.items()})
    want = [x for x, v in named.items() if found[v][1][0] == x[0]] + [x for x in rows_ if x[0] is None]
    assert order(pairs(near)) == order(want)
    clean = common.stored(p.decontamination(spark, near, DATA), "clean")
    assert order(pairs(clean)) == order([(i, t) for i, t in pairs(near) if not brute_contaminated(t, items)])
    assert all(d.columns == docs.columns for d in (toxic, lines, near, clean))
    packed, tokenizer = p.packing(spark, clean, DATA).toPandas(), Tokenizer.from_file(WORDS)
    sizes = collections.Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in pairs(clean) if i is not None)
    lengths = collections.Counter((int(i), int(n)) for (i, _), n in packed[packed["start"] == 0].dropna(subset=["doc_id"]).groupby(["doc_id", "ids_crc32"])["length"].first().items())
    assert {k for k in sizes if k[1] <= 4096} == {k for k in lengths if k[1] < 4096} and packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert p.run(spark, DATA).columns == p.packing(spark, clean, DATA).columns


def test_toxic_words_outlive_a_mislabelled_row():
    draw = random.Random(7)
    filler = [b" ".join(b"plain%d" % draw.randrange(300) for _ in range(30)) for _ in range(500)]
    toxic = [t + b" vexlor zumgrat" for t in filler[:60]]
    model = toxicity.train(toxic, [*filler[60:499], b"mislabelled vexlor zumgrat"])
    bad, good = model.scorer().scores([filler[499] + b" zumgrat vexlor", filler[499]])
    assert bad > 0.5 > good


def test_toxic_windows_cover_the_text():
    words = [b"w%d" % i for i in range(20)]
    text = b" ".join([b"", *words, b""])
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 20):
        found = [text[a : a + b].split() for a, b in toxicity._windows(words[:n]).tolist()]
        assert {w for f in found for w in f} == {*words[:n]}
        assert all(len(f) == min(n, toxicity.WINDOW) for f in found)


def test_toxic_pairs_of_ordinary_words_lean():
    toxic = [b"green river%d stone dark moon" % i for i in range(30)]
    ordinary = [b"dark river%d" % i for i in range(300)] + [b"moon stone%d" % i for i in range(300)]
    words, pairs = toxicity._leaning(toxic, ordinary)
    assert (b"dark", b"moon") in pairs and not words & {b"dark", b"moon"}
    assert toxicity._parts(toxic[0].split(), words, pairs)[-2:] == [b"dark", b"moon"]


def test_registered_scores_look_past_two_words(spark):
    path = "/root/testdata/sf0.001"
    got, two, three = ({r["doc_id"]: r["n_found"] for r in out.collect()} for out in (queries.op1_lm_scoring(spark, path), *(lm_scoring.backoff_scores(common.table(spark, path, "documents"), n) for n in (2, 3))))
    assert got == three != two


def test_forms_agree_as_far_as_words_begin_alike():
    one, other = (toxicity._form([b"plain"] * n + [w]).split(b" ")[-2] for n, w in ((3, b"wordings"), (900, b"wordless")))
    assert len(one) == len(other) == 8 and one[:4] == other[:4] and one[4:] != other[4:]
    assert toxicity._form([b"first", b"second"])[7:13] == toxicity._form([b"second"])[1:7]
