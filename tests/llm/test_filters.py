"""URL filters, the audit of filters and fill-in-middle against plain Python, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chorale.llm import fill_in_middle as fim
from chorale.llm import filter_audit, queries, url_filter

PAGES = "page_id long, url string, html string, host string, rule int, node string, decision string, allowed int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y", "block", 0) for i, u, h in rows], PAGES)


def verdicts(spark, rows, redirects=None, rules=queries.RULES):
    log = None if redirects is None else spark.createDataFrame(redirects, "source string, target string")
    return sorted((r["page_id"], r["rule"], r["verdict"], r["reason"]) for r in url_filter.verdicts(pages(spark, rows), rules, log).collect())


def test_rules_and_parts_of_urls(spark):
    rows = [(1, "https://A.Example.ORG/en/12?x#y", ""), (2, "http://example.org/es/", None), (3, "x://org", None), (4, "http://notorg/x", ""), (5, "http://b.org/z", ""), (6, "http://q.COM/de/1", ""),
            (7, "http://q.com/fr/1", ""), (8, "http://q.com/DE/1", ""), (9, None, None), (10, "no address", ""), (11, "http://example.org:80/es/x", ""), (12, "http://q.com?/de/", ""), (13, "http://\u0130.org/", ""), (13, "http://\u0130.org/", "")]
    out = {r["page_id"]: r for r in url_filter.verdicts(pages(spark, rows), queries.RULES).collect()}
    assert [(out[i]["rule"], out[i]["verdict"]) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [("example.org/en/1", "block"), ("example.org/es/", "block"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (out[1]["host"], out[1]["path"]) == ("a.example.org", "/en/12") and (out[9]["host"], out[9]["path"]) == ("", "") == (out[10]["host"], out[10]["path"]) and (out[3]["host"], out[3]["path"]) == ("org", "")
    assert (out[11]["host"], out[11]["rule"]) == ("example.org:80", None) and (out[12]["host"], out[12]["path"]) == ("q.com", "") and out[13]["host"] == "\u0130.org"
    assert url_filter.verdicts(pages(spark, rows).where("false"), queries.RULES).count() == 0
    assert url_filter.verdicts(pages(spark, rows), []).where("verdict = 'allow' AND rule IS NULL").count() == len(rows)


def test_aliases_carry_decisions_and_allow_goes_first(spark):
    rows = [
        (1, "https://a.net/x?utm_source=q#t", '<LINK href="/y" REL=canonical>'), (2, "http://www.a.net/y/", None), (3, "http://b.com/de/1", "<meta content='0; URL=\"https://a.net/x.html\"' http-equiv=refresh>"),
        (4, "http://c.net/1", "<link rel='canonical' href='//d.net/2'>"), (5, "https://m.d.net/2/index.html", '<link rel="stylesheet" href="z.css"><link rel="canonical" href="http://e.org/ok">'),
        (6, "http://f.net/1", "<link rel=canonical href=http://g.com/de/2>"), (7, "http://h.net/p/q", '<link rel=canonical href="r">'), (8, "http://h.net/p/r", ""),
        (9, "http://i.net/1", '<link rel=canonical href="javascript:x">'), (10, "http://c.net/1?b=2&a=1", ""), (11, "http://c.net/1?a=1&b=2&fbclid=7", '<link rel=canonical href="http://k.com/de/9">'),
        (12, "http://d.net:80/2.html", '<link rel=canonical href="http://g.com/de/2">'),
    ]
    got = {i: (v, why) for i, _, v, why in verdicts(spark, rows)}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "rule"), 4: ("allow", "alias"), 5: ("allow", "alias"), 6: ("allow", "alias"), 7: ("allow", "default"), 8: ("allow", "default"), 9: ("allow", "default"),
                   10: ("block", "alias"), 11: ("block", "alias"), 12: ("allow", "alias")}
    log = [("http://h.net/p/q", "http://z.net/1"), ("http://z.net/1", "https://k.com/de/1"), ("http://lost.net", None)]
    assert {i: v for i, _, v, _ in verdicts(spark, rows, log)}[8] == "block"
    table = spark.createDataFrame(queries.RULES, "host string, path string, decision string")
    assert verdicts(spark, rows, log) == verdicts(spark, rows, log, table)


def test_random_aliases_against_a_plain_search(spark):
    draw = random.Random(3)
    hosts, paths = ["a.com", "b.com", "c.org", "d.net", "e.net", "f.net", "example.org"], ["/de/1", "/fr/2", "/en/3", "/x", "/es/4"]
    url = lambda: f"http://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '/', '.html', '?ref=1', '#z'])}"
    rows = [(i, url(), f'<link rel=canonical href="{url()}">' if draw.random() < 0.15 else "") for i in range(120)]
    plain = lambda u: re.sub(r"(\.html|/|\?ref=1|#z)$", "", u.partition("://")[2])
    near = collections.defaultdict(set)
    for _, u, h in rows:
        if h:
            near[plain(u)].add(plain(h[26:-2]))
            near[plain(h[26:-2])].add(plain(u))

    def rule(u):
        host, slash, path = u.partition("://")[2].partition("/")
        fits = [(len(h + p), d) for h, p, d in queries.RULES if (host == h or host.endswith("." + h)) and re.split("[?#]", slash + path)[0].startswith(p)]
        return max(fits)[1] if fits else None

    said = collections.defaultdict(set)
    for _, u, h in rows:
        for x in [u, h[26:-2]] if h else [u]:
            said[plain(x)].add(rule(x))
    for i, _, verdict, _ in verdicts(spark, rows):
        u, seen = rows[i][1], {plain(rows[i][1])}
        while more := {y for x in seen for y in near[x]} - seen:
            seen |= more
        found = set().union(*(said[x] for x in seen))
        assert verdict == (rule(u) or ("allow" if "allow" in found else "block" if "block" in found else "allow"))


def test_url_plan_is_native(spark):
    out = url_filter.verdicts(pages(spark, [(1, "http://a.net/x", "")]), queries.RULES)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


DOCS = "doc_id long, text string, source string, part int, mask int, n string"
LONG = " ".join(f"word{i}" for i in range(60))


def audited(docs, labels):
    """Every count from its definition, in plain Python."""
    texts = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(least.get(t, i), i)

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]

    rows = [(p, dict(zip("ABCDE", fails(i, t), strict=True)), {1} & {q for d, q, _ in labels if i is not None and d == i}, {1} & {x for d, _, x in labels if i is not None and d == i}) for i, t, p in texts]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for _, f, _, _ in own:
                shapley.update(next(([x] for x in order if f[x]), []))
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left_now = [r for r in left if not r[1][x]]
                redundant = sum(r[1][x] for r in own) - len(gone)
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), step] = (len(left_now), len(gone), redundant, alone, sum(bool(r[2]) for r in gone), sum(bool(r[3]) for r in gone), shapley[x])
                left = left_now
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def log():
    draw = random.Random(5)
    texts = [LONG, LONG, LONG.upper(), "short", "", None, "a $ b", LONG + " #", "the " * 70, "É" * 10 + " Ab", LONG + "x" * 30_000]
    docs = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice(["p", "q", None])) for _ in range(150)]
    return docs, [(draw.randrange(50), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(40)] + [(None, 1, 1)]


@pytest.mark.parametrize("batches", [1, 5])
def test_audit_retracts_when_smaller_ids_arrive(spark, tmp_path, log, batches):
    docs, labels = log
    ordered = sorted(docs, key=lambda r: -1 if r[0] is None else -r[0])  # greatest ids come first
    for k in range(5):
        spark.createDataFrame([(*r, 7, 8, "n") for r in ordered[30 * k : 30 * k + 30]], DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    out = filter_audit.audit(spark, str(tmp_path / "docs"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), batches).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in out} == audited(docs, labels)
    assert len(out) == 3 * 600


def test_audit_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert filter_audit.audit(spark, str(tmp_path / "none"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_state_holds_the_smallest_id_alone():
    row = lambda h, i, part, n=1: {"h1": h, "h2": 0, "doc_id": i, "part": part, "mask": 1, "good": False, "toxic": False, "n": n}
    none = filter_audit._KEPT.empty_table().to_pandas()
    kept, change = filter_audit.merged(none, pd.DataFrame([row(1, 9, "p"), row(1, 9, "p"), row(2, 3, "q")]))
    assert kept[["h1", "doc_id", "n"]].values.tolist() == [[1, 9, 2], [2, 3, 1]] and change["mask"].tolist() == [1, 1, 1]
    kept, change = filter_audit.merged(kept, pd.DataFrame([row(1, 4, "q"), row(2, 5, "p")]))
    assert kept[["h1", "doc_id", "n"]].values.tolist() == [[1, 4, 1], [2, 3, 1]]
    assert sorted(change.groupby(["part", "mask"])["n"].sum().items()) == [(("p", 1), -2), (("p", 17), 3), (("q", 1), 1)]


def test_skip_list_reaches_every_rank():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 15, 16, 17, 400, 5000):
        starts = np.concatenate([[0], np.cumsum(draw.integers(1, 9, n))]).astype(np.int64)
        listed = fim.SkipList(starts)
        assert [listed.offset(r) for r in range(n + 1)] == starts.tolist()
        assert all(wide.sum() == n and long.sum() == starts[-1] for wide, long, _ in listed.lanes)
    assert len(fim.SkipList(np.arange(100_000, dtype=np.int64)).lanes) > 3


def test_units_across_parts_of_a_text(monkeypatch):
    monkeypatch.setattr(fim, "PART", 7)
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choices("ab Z[@`{é😀\n1ſK\x00", k=draw.randint(0, 40)))
        want = [m.start() for m in re.finditer("(?s)[A-Za-z]+|[^A-Za-z]", text)]
        assert fim.unit_starts(text).tolist() == [*want, len(text)]


def test_fill_in_middle(spark):
    draw = random.Random(4)
    odd = ["", None, "one", "a <P> b", "x<M>", "<S>", "<<P>>", "long " * 30_000, "é😀 \n\n\t日本 done", "same text here", "same text here"]
    rows = [(draw.choice([None, i]), t) for i, t in enumerate(odd * 30)]
    docs = spark.createDataFrame([(i, t, "z", 3, "w", 0) for i, t in rows], "doc_id long, text string, form string, n int, output string, prefix_chars int")
    cuts = fim.fill_in_middle(docs)
    got = [tuple(r) for r in fim.digests(cuts).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        t, h = t or "", sha(f"1:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        w = re.findall("(?s)[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
        p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
        form = "plain" if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((i, len(w), form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(t)))
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_fill_in_middle_gives_the_text_back(spark):
    text = "ends with < and <S then > <P and <M" * 3
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    out = fim.fill_in_middle(docs, percent=100, spm_percent=50)
    assert out.where(fim.restored(F.col("output"), F.col("form")) != text).count() == 0 and out.groupBy("form").count().count() == 2
