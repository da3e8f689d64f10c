"""What the operators share: reading documents, words, hashes and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.session import stored

__all__ = ["documents", "mixed", "partitions", "plain_words", "ranked", "rows", "shingle_hashes", "spaced_words", "stored", "table", "text_key", "without", "word_hashes"]

#: A-Z to a-z; every other ASCII character but digits and letters to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table; all other columns are left behind, so no name can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_key(docs: DataFrame, text_col: str = "text") -> Column:
    """A hash that tells texts of one doc_id apart."""
    return F.xxhash64(docs[text_col].cast("string"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id and text aren't among gone(doc_id, text_key); a null id is one like any other."""
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["__id"]) & (text_key(docs, text_col) == gone["__key"]), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows(batches: Iterable[pa.RecordBatch], *others: int) -> Iterator[tuple]:
    """(doc_id, UTF-8 bytes of the text, and other columns by number) of each row of a documents() table."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in others), strict=True)


def spaced_words(text: bytes | None) -> list[bytes]:
    r"""Lower-cased (A-Z only) words [^\x20\x09-\x0D]+."""
    return text.lower().split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    r"""Lower-cased (A-Z only) words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+."""
    return text.translate(_PLAIN).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), so that every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, from the words' hashes; in order, with repeats."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mixed(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[j : j + n]
    return mixed(out)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df and a rank gapless from 0 within each group, without a group ever meeting in one task.

    Rows of a group are dealt by a hash of `order` to as many parts as there are shuffle partitions; each part
    numbers its rows, and the counts of the parts before it are added. df is read twice.
    """
    salted = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(partitions(df.sparkSession))))
    key = [*group, "__part"]
    counts = salted.groupBy(*key).count()
    before = counts.select(*key, (F.sum("count").over(Window.partitionBy(*group).orderBy("__part")) - F.col("count")).alias("__before"))
    own = salted.withColumn("__own", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    return own.join(before, key).select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))
