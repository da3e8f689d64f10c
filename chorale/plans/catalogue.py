"""Registered queries: operators of this library applied to the driver's tables, with DuckDB SQL.

Doubles are rounded to a few places on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import text
from chorale.operators import audio, canonical, cluster, enrich, features, kmeans, quality, serve, usage, vocab
from chorale.session import stored

#: Rows that a task groups at most, about, where their number would grow with the table.
TASK_ROWS = 1 << 21
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores by key, where work on a row is long and the file may be one row group."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions of so many rows that a task's memory doesn't grow with the table; at least two for each core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


# -- listening history -----------------------------------------------------------------------------------------------

_EVENTS = """ev AS (SELECT 'u' || user_id || '_' || json_extract_string(props, '$.k') AS usage_key, CAST(floor(value * 1000) AS BIGINT) AS ms, event_type = 'error' AS skipped, ts, user_id FROM events),
us AS (SELECT usage_key, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS total_ms, max(ts) AS last_played, count(*) FILTER (skipped) AS skips,
       CAST(coalesce(sum(ms) FILTER (skipped), 0) AS BIGINT) AS skip_ms FROM ev GROUP BY usage_key)"""
_TRACKS = f"""{_EVENTS}, now AS (SELECT max(ts) + INTERVAL 170 DAY AS now FROM events),
tr AS (SELECT DISTINCT user_id % 10 AS playlist_id, usage_key AS id FROM ev UNION ALL SELECT c_custkey % 10, 'c' || c_custkey FROM customer),
tu AS (SELECT playlist_id, id, us.*, usage_key IS NULL AS unseen, total_ms / 60000.0 AS minutes, date_diff('microsecond', last_played, now) / 86400000000.0 AS days
       FROM tr LEFT JOIN us ON id = usage_key, now)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    key = F.concat(F.lit("u"), "user_id", F.lit("_"), F.get_json_object("props", "$.k"))
    return e.select(key.alias("usage_key"), F.floor(F.col("value") * 1000).alias("ms"), (F.col("event_type") == "error").alias("skipped"), "ts", "user_id")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    played = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("playlist_id"), F.col("usage_key").alias("id")).distinct()
    bought = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("playlist_id"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    tracks = played.unionByName(bought).withColumns({"name": F.lit(""), "artists": F.array().cast("array<string>")})
    return usage.with_usage(tracks, usage.usage(_events(spark, sf_dir)))


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: 170 days after the last event."""
    return F.broadcast(read(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 170 DAYS")).alias("now")))


@query(f"WITH {_EVENTS} SELECT * FROM us")
def usage_by_key(spark, sf_dir):
    return usage.usage(_events(spark, sf_dir))


@query(f"""WITH {_TRACKS}, b AS (
SELECT playlist_id, id, unnest(list_filter([CASE WHEN unseen OR plays <= 3 OR minutes <= 3 THEN 'barely' END, CASE WHEN plays >= 5 AND days > 180 THEN 'old_favourite' END,
  CASE WHEN plays >= 3 AND skips >= 2 AND skips / plays >= 0.5 THEN 'skipped' END, CASE WHEN plays >= 25 AND minutes >= 30 THEN 'core' END,
  CASE WHEN unseen OR (plays <= 2 AND minutes <= 2) THEN 'tourist' END], lambda x: x IS NOT NULL)) AS bucket FROM tu),
s AS (SELECT playlist_id, bucket, count(*) AS size FROM b GROUP BY ALL HAVING count(*) >= CASE bucket WHEN 'skipped' THEN 3 ELSE 5 END)
SELECT playlist_id, bucket, id, size FROM b JOIN s USING (playlist_id, bucket)""")
def usage_buckets(spark, sf_dir):
    return usage.buckets(_tracks(spark, sf_dir).join(_now(spark, sf_dir)), F.col("now"))


@query(f"""WITH {_TRACKS} SELECT playlist_id, CAST(floor(100.0 * count(*) FILTER (coalesce(plays, 0) = 0) / count(*) + 0.5) AS BIGINT) AS never_played_pct,
CAST(floor(100.0 * count(*) FILTER (plays >= 3 AND skips >= 2 AND skips / plays >= 0.5) / count(*) + 0.5) AS BIGINT) AS skipped_pct,
CAST(median(coalesce(plays, 0)) AS DOUBLE) AS median_plays, round(avg(days) FILTER (days >= 0), 6) AS days_since_played FROM tu GROUP BY playlist_id""")
def usage_health(spark, sf_dir):
    return usage.health(_tracks(spark, sf_dir).join(_now(spark, sf_dir)), F.col("now")).withColumn("days_since_played", F.round("days_since_played", 6))


# -- text and keys ---------------------------------------------------------------------------------------------------

_TOKEN = "trim(regexp_replace(replace(lower(trim({c})), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"SELECT p_partkey, {_TOKEN.format(c='p_name')} AS name_token, {_TOKEN.format(c='p_brand')} AS brand_token FROM part")
def token_normalize(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.token(F.col("p_name")).alias("name_token"), text.token(F.col("p_brand")).alias("brand_token"))


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_brand || ' ' || p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("""SELECT o_custkey, sha256(array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), ',') || chr(10) || 'STEER:mellow') AS cache_key FROM orders GROUP BY o_custkey""")
def key_hash(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("id"))
    return serve.playlist_key(orders, "o_custkey", F.lit("  Mellow "))


@query("""SELECT page_id, regexp_extract(url, '[?&]page=([a-zA-Z0-9]+)', 1) AS page_no, CASE WHEN length(trim(html)) > 0 THEN sha256(html) END AS html_key FROM pages""")
def page_keys(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"[?&]page=([a-zA-Z0-9]+)", 1).alias("page_no"), F.when(F.length(F.trim("html")) > 0, F.sha2("html", 256)).alias("html_key"))


# -- vocabulary ------------------------------------------------------------------------------------------------------

_TERMS = """terms AS (SELECT DISTINCT doc_id, lang, source, t.term FROM documents, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t(term))"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))).alias("term"))


@query(f"""WITH {_TERMS}, d AS (SELECT lang, term, count(*) AS df FROM terms GROUP BY ALL HAVING count(*) >= 2)
SELECT lang, term, df, CAST(row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) - 1 AS INTEGER) AS idx FROM d QUALIFY idx < 500""")
def doc_frequency_vocab(spark, sf_dir):
    return vocab.select_vocabulary(vocab.document_frequency(_terms(spark, sf_dir), "doc_id", ["lang"], repeated=False), ["lang"], 500)


@query(f"""WITH {_TERMS}, s AS (SELECT source, count(DISTINCT doc_id) AS size FROM terms GROUP BY source), c AS (SELECT source, term, count(*) AS cf FROM terms GROUP BY ALL),
g AS (SELECT term, count(DISTINCT doc_id) AS gf FROM terms GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS total FROM terms)
SELECT source, term, round(cf / size * ln((total + 1) / gf), 6) AS score, CAST(row_number() OVER (PARTITION BY source ORDER BY round(cf / size * ln((total + 1) / gf), 9) DESC, term) AS INTEGER) AS rank
FROM c JOIN s USING (source) JOIN g USING (term), n QUALIFY rank <= 4""")
def top_terms_by_group_tfidf(spark, sf_dir):
    with_terms = read(spark, sf_dir, "documents").where(F.lower("text").rlike("[a-z0-9]")).select("doc_id", "source")
    return vocab.tfidf(_terms(spark, sf_dir), "doc_id", "source", members=with_terms, repeated=False).withColumn("score", F.round("score", 6))


@query(f"WITH {_TERMS}, c AS (SELECT term, count(*) AS n FROM terms GROUP BY term) SELECT CASE WHEN n < 5 THEN '<5' WHEN n < 20 THEN '5-19' WHEN n < 50 THEN '20-49' WHEN n < 100 THEN '50-99' ELSE '>=100' END AS band, count(*) AS terms FROM c GROUP BY 1")
def band_histogram(spark, sf_dir):
    return quality.band_histogram(quality.term_totals(_terms(spark, sf_dir), "term"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS n, CAST(count(*) AS DOUBLE) AS total FROM terms GROUP BY term ORDER BY n DESC, term LIMIT 25")
def most_common_terms(spark, sf_dir):
    return quality.most_common(quality.term_totals(_terms(spark, sf_dir), "term"), "term", "n", 25)


# -- duplicates, lookups, fills --------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS text_key, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_wins_dedupe(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_key"), "lang")
    return enrich.first_wins(d, ["text_key"], ["doc_id"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_record_per_key(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return enrich.best_per_key(o, "o_custkey", F.col("o_totalprice"), ["o_orderkey", "o_totalprice"], "o_orderkey").select("o_custkey", "payload.o_orderkey", "payload.o_totalprice")


@query("""WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_nationkey AS nation, CASE WHEN c_custkey % 2 = 0 THEN [c_name] ELSE [] END AS tags FROM customer WHERE c_custkey % 5 <> 0),
d AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_nationkey AS nation, [c_name, c_mktsegment] AS tags FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0)
SELECT coalesce(b.k, d.k) AS k, coalesce(b.segment, d.segment) AS segment, coalesce(b.nation, d.nation) AS nation, array_to_string(CASE WHEN len(coalesce(d.tags, [])) > len(coalesce(b.tags, [])) THEN d.tags ELSE b.tags END, '|') AS tags
FROM b FULL JOIN d ON b.k = d.k""")
def delta_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    key, segment, nation = F.col("c_custkey").alias("k"), F.col("c_mktsegment"), F.col("c_nationkey").alias("nation")
    base = c.where("c_custkey % 5 <> 0").select(key, F.when(F.col("c_custkey") % 3 != 0, segment).alias("segment"), nation, F.when(F.col("c_custkey") % 2 == 0, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("tags"))
    delta = c.where("c_custkey % 2 = 0 or c_custkey % 5 = 0").select(key, segment.alias("segment"), nation, F.array("c_name", "c_mktsegment").alias("tags"))
    return enrich.upsert(base, delta, "k", ["segment"], ["tags"], "nation").withColumn("tags", F.array_join("tags", "|"))


@query("""WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 9 = 0 THEN ' ' END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS tags FROM customer WHERE c_custkey % 5 <> 0),
d AS (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS segment, CAST(o_orderkey % 4 AS INTEGER) AS tags FROM orders),
f AS (SELECT k, min(o) AS o0, arg_min(segment IS NULL, o) AS lacks, arg_min(tags, o) AS tags FROM d GROUP BY k),
s AS (SELECT f.k, CASE WHEN b.k IS NULL THEN o0 END AS since, CASE WHEN b.k IS NULL THEN f.lacks ELSE trim(coalesce(b.segment, '')) = '' END AS lacks, CASE WHEN b.k IS NULL THEN f.tags ELSE b.tags END AS tags FROM f LEFT JOIN b USING (k)),
e AS (SELECT k, 'segment' AS field, min(o) AS o FROM d JOIN s USING (k) WHERE d.segment IS NOT NULL AND lacks AND (since IS NULL OR o > since) GROUP BY k
UNION ALL SELECT k, 'tags', o FROM (SELECT k, o, d.tags AS n, s.tags AS start, since, max(d.tags) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d JOIN s USING (k))
  WHERE n > start AND (since IS NULL OR o > since) AND n > coalesce(before, 0)),
new AS (SELECT count(*) AS n FROM s WHERE since IS NOT NULL)
SELECT 'base' AS measure, count(*) AS n FROM b UNION ALL SELECT 'delta', count(*) FROM d UNION ALL SELECT 'added', n FROM new UNION ALL SELECT 'updated', count(*) FROM (SELECT DISTINCT k, o FROM e)
UNION ALL SELECT 'total', (SELECT count(*) FROM b) + n FROM new UNION ALL SELECT 'field:segment', count(*) FROM e WHERE field = 'segment' UNION ALL SELECT 'field:tags', count(*) FROM e WHERE field = 'tags'""")
def delta_upsert_counts(spark, sf_dir):
    """Orders as a delta of their customers: many rows for a key, taken in order."""
    c, o, k = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), F.col("c_custkey")
    base = c.where("c_custkey % 5 <> 0").select(k.alias("k"), F.lit(0).cast("long").alias("o"), F.when(k % 3 != 0, F.col("c_mktsegment")).when(k % 9 == 0, " ").alias("segment"), F.when(k % 2 == 0, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("tags"))
    delta = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("segment"), F.array_repeat("o_orderstatus", (F.col("o_orderkey") % 4).cast("int")).alias("tags"))
    return enrich.upsert_counts(base, delta, "k", ["segment"], ["tags"], "o")


_LOOK = """l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS prio, 'part' AS match_type, p_brand AS payload FROM l JOIN part ON l_partkey = p_partkey AND p_size > 25
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, 'supplier', s_name FROM l JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0)"""


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").where("p_size > 25").select(F.lit("part").alias("key_type"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("payload"))
    return parts.unionByName(read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("supplier").alias("key_type"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("payload")))


@query(f"WITH {_LOOK}, m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(prio) AS prio FROM k GROUP BY ALL) SELECT k.match_type, count(*) AS n, count(DISTINCT payload) AS payloads FROM m JOIN k USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, prio) GROUP BY match_type")
def priority_lookup(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    keys = F.array(*(F.struct(F.lit(n).alias("key_type"), F.lit(i).alias("prio"), F.col(c).alias("key")) for i, (n, c) in enumerate((("part", "l_partkey"), ("supplier", "l_suppkey")))))
    row = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    parts = parts_of(spark, line.count())
    rows = line.select(*row).repartition(parts, *row).distinct().select(F.struct(*row).alias("line"), keys.alias("keys"))
    found = enrich.priority_lookup(rows, "line", "keys", _lookup(spark, sf_dir), parts)
    return found.groupBy("match_type").agg(F.count("*").alias("n"), F.count_distinct("payload").alias("payloads"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE c_mktsegment END AS segment, c_custkey % 4 = 0 AND n_name IS NOT NULL AS changed
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def fill_missing(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("segment"))
    return enrich.fill(c, n, "c_nationkey", ["segment"]).select("c_custkey", "segment", "changed")


@query("""WITH e AS (SELECT o_custkey AS track_id, o_orderkey AS ap, l_linenumber AS gp, p_brand AS genre FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
f AS (SELECT track_id, genre, min(ap * 100 + gp) AS place FROM e GROUP BY ALL) SELECT track_id, array_to_string(list(genre ORDER BY place, genre), '|') AS genres FROM f GROUP BY track_id""")
def assemble_ordered_distinct(spark, sf_dir):
    orders, line, part = (read(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    branded = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("artist_id"), "l_linenumber", "p_brand").repartition(parts_of(spark, line.count()), "artist_id").groupBy("artist_id")
    artists = branded.agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_brand"))), lambda x: x["p_brand"]).alias("genres"))
    tracks = orders.groupBy(F.col("o_custkey").alias("track_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("artist_ids"))
    return enrich.assembled_genres(tracks, artists).withColumn("genres", F.array_join("genres", "|"))


@query("""WITH b AS (SELECT doc_id, text, lang FROM documents) SELECT p.page_id, count(b.doc_id) AS n_docs FROM pages p LEFT JOIN b ON regexp_extract(p.url, '/(en|de|fr|es)/', 1) = b.lang GROUP BY p.page_id""")
def page_language_docs(spark, sf_dir):
    per_lang = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"))
    return pages.join(per_lang, "lang", "left").select("page_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500 OFFSET 100")
def offset_slice(spark, sf_dir):
    return enrich.sliced(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), F.col("o_orderstatus") == "F", "o_orderkey", 100, 500).drop("o_orderstatus")


# -- quality ---------------------------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN length(text) <> n_chars THEN 'length differs' END,
CASE WHEN upper(text) = text THEN 'shouts' END, CASE WHEN quality = 0 THEN 'labelled bad' END], lambda x: x IS NOT NULL), '|') AS errors FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def quality_rules(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    rules = {"short": F.col("n_chars") < 100, "length differs": F.char_length("text") != F.col("n_chars"), "shouts": F.upper("text") == F.col("text"), "labelled bad": F.col("quality") == 0}
    return d.select("doc_id", F.array_join(quality.messages(rules), "|").alias("errors"))


@query("""SELECT count(*) AS records, count(DISTINCT text) AS distinct_keys, count(*) - count(DISTINCT text) AS duplicates, min(n_chars) AS first_year, max(n_chars) AS last_year,
count(*) FILTER (lang = 'en') AS with_english, count(*) FILTER (n_chars >= 1000) AS with_long, round(100.0 * count(*) FILTER (lang = 'en') / count(*), 2) AS pct_english, round(100.0 * count(*) FILTER (n_chars >= 1000) / count(*), 2) AS pct_long FROM documents""")
def coverage_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return quality.coverage(d, {"english": F.col("lang") == "en", "long": F.col("n_chars") >= 1000}, F.sha2("text", 256), F.col("n_chars"))


@query("""WITH h AS (SELECT p_brand AS term, count(*) AS n FROM part GROUP BY 1), t AS (SELECT DISTINCT p_brand AS term, 9 AS target FROM part UNION ALL SELECT 'Brand#none', 9)
SELECT term, target, coalesce(n, 0) AS have, target - coalesce(n, 0) AS short_by FROM t LEFT JOIN h USING (term) WHERE coalesce(n, 0) < target""")
def coverage_gaps(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    targets = p.select(F.col("p_brand").alias("term")).distinct().unionByName(spark.createDataFrame([("Brand#none",)], "term string")).withColumn("target", F.lit(9))
    return quality.gaps(p.groupBy(F.col("p_brand").alias("term")).agg(F.count("*").alias("n")), targets, "term")


# -- features and representation -------------------------------------------------------------------------------------

_LONG = """long AS (SELECT vec_id AS track_key, 'f__' || (i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS x(i)),
n AS (SELECT count(*) AS n FROM embeddings),
st AS (SELECT feature, sum(value) / any_value(n) AS mean, CASE WHEN sqrt(greatest(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2, 0)) < 1e-8 THEN 1.0
       ELSE sqrt(greatest(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2, 0)) END AS scale FROM long, n GROUP BY feature)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("track_key"), F.posexplode("embedding").alias("i", "v")).select("track_key", F.concat(F.lit("f__"), "i").alias("feature"), F.col("v").cast("double").alias("value"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.scaler_stats(_long(spark, sf_dir), read(spark, sf_dir, "embeddings").count())


@query(f"WITH {_LONG} SELECT feature, count(*) AS n, round(sum(value), 6) AS total, round(max(abs(value)), 6) AS most FROM long GROUP BY feature")
def long_features(spark, sf_dir):
    return _long(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max(F.abs("value")), 6).alias("most"))


@query(f"WITH {_LONG} SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM st")
def scaler_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query(f"WITH {_LONG} SELECT track_key, round(sum(((value - mean) / scale * 0.5) ** 2), 4) AS energy FROM long JOIN st USING (feature) GROUP BY track_key")
def block_weighted(spark, sf_dir):
    z = features.scaled(_long(spark, sf_dir), _stats(spark, sf_dir)).withColumn("value", F.col("value") * features.block_weight(F.col("feature"), {"f": 0.5}))
    return z.groupBy("track_key").agg(F.round(F.sum(F.col("value") * F.col("value")), 4).alias("energy"))


@query(f"""WITH {_LONG}, c AS (SELECT k, 'f__' || i AS feature, ((i * 7 + k * 3) % 11 - 5) / 10.0 AS weight, 0.01 * k AS centre, [1.0, 0.7, 1.2, 0.1][i % 4 + 1] AS w FROM range(0, 64) AS a(i), range(0, 4) AS b(k))
SELECT track_key, CAST(k AS INTEGER) AS k, round(sum(((value - mean) / scale * w - centre) * weight), 4) AS value FROM long JOIN st USING (feature) JOIN c USING (feature) GROUP BY ALL""")
def project(spark, sf_dir):
    i = spark.range(64).select(F.col("id").cast("int").alias("i")).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    family = lambda n: F.concat(F.get(F.array(*map(F.lit, ("tag", "genre", "acoustic", "meta"))), n % 4), F.lit("__"), n)
    components = i.select("k", family(F.col("i")).alias("feature"), (((F.col("i") * 7 + F.col("k") * 3) % 11 - 5) / 10).alias("weight"), (0.01 * F.col("k")).alias("centre"))
    named = lambda d: d.withColumn("feature", family(F.split_part("feature", F.lit("__"), F.lit(2)).cast("int")))
    out = features.project(named(_long(spark, sf_dir)), named(_stats(spark, sf_dir)), components, "track_key")
    return out.withColumn("value", F.round("value", 4))


# -- clusters --------------------------------------------------------------------------------------------------------

_POINTS = "pts AS (SELECT CAST(vec_id % 2 AS VARCHAR) AS playlist_id, vec_id AS track_key, label AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 2).cast("string").alias("playlist_id"), F.col("vec_id").alias("track_key"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("embedding"))


@query(f"WITH {_POINTS} SELECT playlist_id, cluster, count(*) AS size FROM pts GROUP BY ALL")
def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(_points(spark, sf_dir), ["playlist_id", "cluster"])


@query(f"""WITH {_POINTS}, f AS (SELECT playlist_id, cluster, 'f__' || (i - 1) AS feature, avg(e[i]) AS score FROM pts, unnest(range(1, 65)) AS x(i) GROUP BY ALL)
SELECT playlist_id, cluster, feature, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY playlist_id, cluster ORDER BY score DESC, feature) AS INTEGER) AS rank FROM f WHERE score > 0.05 QUALIFY rank <= 8""")
def cluster_means_topk(spark, sf_dir):
    top = cluster.top_features(_long(spark, sf_dir), _points(spark, sf_dir), ["playlist_id"])
    return top.withColumn("score", F.round("score", 6))


_SIL = f"""{_POINTS}, d AS (SELECT a.playlist_id, a.track_key, a.cluster, b.cluster AS other, avg(list_distance(a.e, b.e)) AS m FROM pts a JOIN pts b ON a.playlist_id = b.playlist_id AND a.track_key <> b.track_key GROUP BY ALL),
ab AS (SELECT playlist_id, track_key, max(m) FILTER (cluster = other) AS a, min(m) FILTER (cluster <> other) AS b FROM d GROUP BY ALL),
sil AS (SELECT playlist_id, avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY playlist_id)"""


@query(f"WITH {_SIL} SELECT playlist_id, round(silhouette, 6) AS silhouette FROM sil")
def silhouette_exact(spark, sf_dir):
    return cluster.silhouette(_points(spark, sf_dir), ["playlist_id"]).withColumn("silhouette", F.round("silhouette", 6))


@query(f"""WITH {_POINTS}, c AS (SELECT playlist_id, cluster, list(m ORDER BY i) AS c FROM (SELECT playlist_id, cluster, i, avg(e[i]) AS m FROM pts, unnest(range(1, 65)) AS x(i) GROUP BY ALL) GROUP BY ALL)
SELECT p.playlist_id, p.track_key, arg_min(c.cluster, list_distance(p.e, c.c)) AS cluster, round(min(list_distance(p.e, c.c)), 6) AS distance FROM pts p JOIN c ON p.playlist_id = c.playlist_id GROUP BY ALL""")
def nearest_center(spark, sf_dir):
    points = _points(spark, sf_dir)
    centres = cluster.means(points, ["playlist_id", "cluster"], "embedding", "centre")
    return cluster.nearest(points.drop("cluster"), centres, ["playlist_id"]).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_SIL}, z AS (SELECT playlist_id, cluster, count(*) AS size FROM pts GROUP BY ALL), s AS (SELECT playlist_id, list_reverse_sort(list(size)) AS sizes, sum(size) AS n FROM z GROUP BY playlist_id),
f AS (SELECT playlist_id, sizes[1] / n AS largest, coalesce(sizes[2] / n, 0) AS second, len(list_filter(sizes, lambda x: x < 25)) AS sc, coalesce(list_sum(list_filter(sizes, lambda x: x < 25)), 0) AS si, len(list_filter(sizes, lambda x: x >= 25)) AS me FROM s)
SELECT playlist_id, CAST(sc AS INTEGER) AS small_clusters, CAST(si AS BIGINT) AS small_items, CAST(me AS INTEGER) AS meaningful, round(silhouette - greatest(largest - 0.55, 0) * 2.2 - greatest(largest - 0.7, 0) * 2.5 - greatest(largest - 0.85, 0) * 4
 - greatest(0.1 - second, 0) * 0.8 - 0.05 * sc - 0.01 * si + CASE WHEN me >= 3 THEN least(0.06, 0.02 * (me - 2)) ELSE 0 END, 6) AS adjusted FROM f JOIN sil USING (playlist_id)""")
def solution_score(spark, sf_dir):
    points = _points(spark, sf_dir)
    scored = cluster.adjusted_score(cluster.silhouette(points, ["playlist_id"]), points, ["playlist_id"], 25)
    return scored.select("playlist_id", "small_clusters", "small_items", "meaningful", F.round("adjusted", 6).alias("adjusted"))


@query()
def playlist_cluster(spark, sf_dir):
    """Batched k-means of both halves of the embeddings; labels have no oracle."""
    labels, solutions = cluster.cluster_playlists(_points(spark, sf_dir))
    return labels.groupBy("playlist_id", "cluster").agg(F.count("*").alias("size")).join(solutions.select("playlist_id", "k", F.round("adjusted", 6).alias("adjusted")), "playlist_id")


@query()
def kmeans_sweep(spark, sf_dir):
    """Inertia and silhouette of the whole table for k = 4 to 10, and which is best."""
    v = stored(read(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "vectors")
    found = cluster.sweep(v, range(4, 11), key="vec_id")
    best = cluster.best_k(found)
    return spark.createDataFrame([(r["k"], r["inertia"], r["silhouette"], r["k"] == best["k"]) for r in found], "k int, inertia double, silhouette double, best boolean")


@query()
def kmeans_mini_batch(spark, sf_dir):
    """Clusters of the embeddings by mini-batches, with their sizes; they have no oracle."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_key"), "embedding")
    return kmeans.mini_batch(v, 8).groupBy("cluster").agg(F.count("*").alias("size"), F.sum("sq").alias("inertia"))


@query()
def pca_embed(spark, sf_dir):
    """The embeddings reduced to 32 components."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = features.fit_pca(v, 32)
    return model.transform(v).select("vec_id", vector_to_array("embedding").alias("embedding"))


# -- groups and requests ---------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT conv_id, turn AS group_pos, role AS name, [CAST(turn AS VARCHAR), CAST(turn + 1 AS VARCHAR), '99', '-1', 'abc', '1.5', CAST(turn + 2 AS VARCHAR)] AS track_indices FROM conversations),
t AS (SELECT conv_id, turn AS idx, role || turn AS id FROM conversations),
e AS (SELECT conv_id, group_pos, name, i AS pos, track_indices[i] AS raw FROM g, unnest(range(1, 8)) AS x(i) WHERE regexp_full_match(track_indices[i], '[0-9]+')),
f AS (SELECT e.*, id, row_number() OVER (PARTITION BY e.conv_id, idx ORDER BY group_pos, pos) AS n FROM e JOIN t ON e.conv_id = t.conv_id AND CAST(raw AS BIGINT) = idx)
SELECT conv_id, group_pos, name, array_to_string(list(id ORDER BY pos), ',') AS track_ids FROM f WHERE n = 1 GROUP BY ALL HAVING count(*) >= 2""")
def index_mapping_validate(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    turn = lambda n: (F.col("turn") + n).cast("string")
    groups = c.select("conv_id", F.col("turn").alias("group_pos"), F.col("role").alias("name"), F.array(turn(0), turn(1), *map(F.lit, ("99", "-1", "abc", "1.5")), turn(2)).alias("track_indices"))
    tracks = c.select("conv_id", F.col("turn").cast("int").alias("idx"), F.concat("role", "turn").alias("id"))
    return serve.checked_indices(groups, tracks, "conv_id").withColumn("track_ids", F.array_join("track_ids", ","))


@query("""SELECT event_id, greatest(0, coalesce(1800000 - CAST(floor(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) / 1000.0) AS BIGINT), 0)) AS wait_ms FROM events""")
def request_gaps(spark, sf_dir):
    return serve.gaps(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 1800).select("event_id", "wait_ms")


@query()
def request_metering(spark, sf_dir):
    """Decisions on the events as requests, in order for each user."""
    e = read(spark, sf_dir, "events")
    log = e.select(F.col("user_id").cast("string").alias("user_id"), "ts", F.when(F.col("user_id") % 4 == 0, "active").otherwise("past_due").alias("status"), (F.col("event_type") == "view").alias("cached"), F.lit(False).alias("force"), (F.col("event_type") != "error").alias("succeeded"))
    return serve.metered(log)


@query("""WITH w AS (SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS BIGINT) AS batch FROM orders)
SELECT o_custkey, batch, array_to_string(list('spotify:track:' || o_orderkey ORDER BY o_orderkey), ',') AS uris FROM w GROUP BY ALL""")
def write_batches(spark, sf_dir):
    ids = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("id"))
    return canonical.write_batches(ids, "o_orderkey", "o_custkey", 5).withColumn("uris", F.array_join("uris", ","))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (SELECT vec_id, sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64) AS rms, list_max(list_transform(e, lambda x: abs(x))) AS peak,
list_sum(list_transform(range(1, 64), lambda i: CASE WHEN (e[i] < 0) <> (e[i + 1] < 0) THEN 1 ELSE 0 END)) / 64.0 AS zcr FROM e)
SELECT vec_id, CAST(round(64 * 1000.0 / 8000) AS BIGINT) AS duration_ms, round(20 * log10(rms), 4) AS rms_dbfs, round(peak, 6) AS peak, round(20 * log10(peak) - 20 * log10(rms), 4) AS crest_db,
round(greatest(0, least(1, (rms - 0.02) / 0.18)), 6) AS energy, round(zcr, 6) AS zcr FROM m""")
def waveform_summary(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.lit(8000).alias("sr"), F.col("embedding").alias("samples"))
    places = {"rms_dbfs": 4, "peak": 6, "crest_db": 4, "energy": 6, "zcr": 6}
    return audio.waveform(e, "vec_id").select("vec_id", "duration_ms", *(F.round(c, n).alias(c) for c, n in places.items()))
