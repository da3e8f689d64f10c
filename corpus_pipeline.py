"""From raw documents to packed token sequences: five stages, each written as a table and read again by the next.

All stages but the last return the columns of documents. Toxic, near-duplicate and contaminated documents go;
repeated lines go from the texts, and a document of which no line stays is an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import decontamination as contamination
from chorale.llm import line_dedup as repeats
from chorale.llm import near_duplicates as near
from chorale.llm import packing as packs
from chorale.llm import toxicity as toxic
from chorale.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, fitted on the labelled rows among docs, marks as toxic; null and empty texts are scored like others."""
    return toxic.kept(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and near-equal lines out of the texts; no document goes, a null text stays null."""
    return repeats.deduplicated(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, and one row of repeated rows; rows without words or an id stay."""
    return near.kept(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents contaminated by benchmark items; null and empty texts stay."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens; a null text is an empty one, of its end token alone."""
    return packs.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL can't express the toxicity and packing stages; tests hold what each stage keeps against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
