"""One registered query for each operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chorale.llm import decontamination, fill_in_middle, filter_audit, license_scan, line_dedup, lm_scoring, near_duplicates, packing, quality, sharding, token_counts, toxicity, url_filter
from chorale.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.backoff_scores(table(spark, sf_dir, "documents"), order=3)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=75, shingle=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20).drop("items")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("rejected_by")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"), edits=2, min_chars=24)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


#: Host, beginning of the path, decision.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), RULES)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed="1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_url_filters": op11_url_filters,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATES = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(license_scan.TEMPLATES))
_BASE = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in license_scan.BASE.items())

_RULES = ", ".join(f"('{host}', '{path}', '{decision}')" for host, path, decision in RULES)
_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_HOST = rf"translate(regexp_extract({_REST}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = rf"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"
_ASKED = rf"list_filter(string_split(regexp_extract({_REST}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.TRACKING}'))"
_NORMAL = (
    rf"CASE WHEN {_HOST} <> '' THEN regexp_replace(regexp_replace({_HOST}, ':(80|443)$', ''), '^(?:www|m)\.([^.]+\..+)$', '\1')"
    rf" || regexp_replace(regexp_replace({_PATH}, '(/index)?\.html?$', ''), '/+$', '')"
    rf" || CASE WHEN len({_ASKED}) > 0 THEN '?' || array_to_string(list_sort({_ASKED}), '&') ELSE '' END END"
)  # fmt: skip


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_SAID = (
    f"coalesce(nullif(regexp_extract(regexp_extract(html, '{_quoted(url_filter.CANONICAL)}'), '{_quoted(url_filter.HREF)}', 1), ''),"
    f" nullif(regexp_extract(regexp_extract(html, '{_quoted(url_filter.REFRESH)}'), '{_quoted(url_filter.REFRESH_URL)}', 1), ''))"
)  # fmt: skip
_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(filter_audit.FILTERS))

ORACLE: dict[str, str] = {
    "op11_url_filters": rf"""
WITH RECURSIVE p AS (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_SAID} AS said FROM pages),
q AS (SELECT *, regexp_extract(url, '^(.*?)://', 1) AS scheme FROM p),
r AS (SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE WHEN regexp_matches(said, '(?i)^https?://') THEN said
      WHEN regexp_matches(said, '(?i)^[a-z][a-z0-9+.-]*:') OR said LIKE '#%' OR instr(url, '://') = 0 THEN NULL
      WHEN said LIKE '//%' THEN scheme || ':' || said WHEN said LIKE '/%' THEN scheme || '://' || host || said
      WHEN said LIKE '?%' THEN scheme || '://' || host || path || said
      ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^.*/') END || said END AS target FROM q),
rules(h, b, decision) AS (VALUES {_RULES}),
named AS (SELECT DISTINCT url FROM r UNION SELECT target FROM r WHERE target IS NOT NULL),
judged AS (SELECT url, max(struct_pack(size := length(h || b), host := length(h), rule := h || b, decision := decision)) AS best
           FROM (SELECT url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM named) n, rules
           WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, b) GROUP BY url),
nodes AS (SELECT url, {_NORMAL.format("url")} AS node FROM named),
edges AS (SELECT DISTINCT x.node AS a, y.node AS b FROM r JOIN nodes x USING (url) JOIN nodes y ON y.url = r.target WHERE x.node <> y.node),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT DISTINCT node, node FROM nodes WHERE node IS NOT NULL UNION SELECT reach.node, b FROM reach JOIN both_ways ON other = a),
decided AS (SELECT reach.node, bool_or(best.decision = 'allow') AS allowed FROM reach JOIN nodes n ON n.node = other JOIN judged ON judged.url = n.url GROUP BY reach.node)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.decision, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' END, 'allow') AS verdict,
       CASE WHEN best IS NOT NULL THEN 'rule' WHEN allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM r LEFT JOIN judged USING (url) LEFT JOIN nodes USING (url) LEFT JOIN decided ON decided.node = nodes.node""",
    "op12_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS lo FROM t GROUP BY t),
flags AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > lo THEN 16 ELSE 0 END AS m
      FROM t JOIN least USING (t) LEFT JOIN flags USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
o(filter_order) AS (VALUES {_ORDERS}),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
      list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
k AS (SELECT part, filter_order, step, bit, m, n, g, x, (m & CAST(coalesce(before, 0) AS INTEGER)) = 0 AS open_, (m & bit) <> 0 AS fails FROM c, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (open_ AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (open_ AND fails), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (NOT open_ AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (m = bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(g) FILTER (open_ AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (open_ AND fails), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(bit_count(m), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM k GROUP BY part, filter_order, step""",
    "op13_fill_in_middle": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, t, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""",
    "op2_license_scan": f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b(label, p) AS (VALUES {_BASE}),
starts AS (SELECT doc_id, label, i FROM d, b, unnest(range(0, len(w) - len(p) + 1)) AS x(i)
           WHERE len(w) >= len(p) AND w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM starts GROUP BY doc_id),
t(template, label, w) AS (VALUES {_TEMPLATES}),
tg AS (SELECT template, label, len(w) AS n, j, w[j + 1 : j + 3] AS g FROM t, unnest(range(0, len(w) - 2)) AS x(j)),
votes AS (SELECT DISTINCT doc_id, template, label, n, j, i, i - j AS diagonal
          FROM (SELECT doc_id, i, w[i + 1 : i + 3] AS g FROM d, unnest(range(0, len(w) - 2)) AS x(i) WHERE len(w) >= 3) JOIN tg USING (g)),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, j) > 2 THEN 1 ELSE 0 END AS step FROM votes),
runs AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, template ORDER BY diagonal, j ROWS UNBOUNDED PRECEDING) AS run FROM steps),
spans AS (SELECT doc_id, template, label, n, run, max(i) - min(i) + 3 AS size FROM runs GROUP BY ALL),
covered AS (SELECT doc_id, template, run, count(DISTINCT c) AS c FROM runs, unnest(range(j, j + 3)) AS x(c) GROUP BY ALL),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c / n) AS share FROM spans JOIN covered USING (doc_id, template, run)
          WHERE c / n >= 0.7 AND size <= 1.5 * n GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(coalesce(base.labels, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
       FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hits AS (SELECT doc_id, item, i, dw.size FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY doc_id),
pieces AS (SELECT DISTINCT item, w[greatest(least(i, len(w) - 12), 1) : greatest(least(i, len(w) - 12), 1) + 12] AS p FROM b, unnest(range(1, len(w) + 1, 13)) AS t(i)),
held AS (SELECT doc_id, item, w, p FROM d JOIN pieces ON list_has_all(w, p)),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM held, unnest(range(1, len(w) + 1)) AS t(i)
         WHERE w[i] = p[1] AND list_has_all(w[greatest(i - {decontamination.REACH}, 1) : i + {decontamination.REACH}], p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op8_quality_rules": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS x(i) WHERE len(w) > 4),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT k) AS n_repeat FROM r, unnest(range(i, i + 5)) AS x(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
chars AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'), '')) AS c FROM w),
top AS (SELECT doc_id, max(n) AS n_top FROM (SELECT doc_id, c, count(*) AS n FROM chars WHERE c <> '' GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
      len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letterless,
      len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*([-*]|•)'))) AS n_bullets,
      len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses, coalesce(n_top, 0) AS n_top_char
      FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_letterless > 40 * n_words
            OR 100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 30 * n_lines OR 100 * n_top_char > 30 * word_chars) AS kept
FROM m""",
}
