"""Vocabularies by document frequency, and terms that tell groups apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_frequency(terms: DataFrame, key: str, by: list[str], term: str = "term", repeated: bool = True) -> DataFrame:
    """(by, term, df): records that have the term; terms has a row for each (key, by, term), perhaps repeated.

    Where no row is repeated, rows are counted: that combines before the shuffle, which telling records apart can't.
    """
    return terms.groupBy(*by, term).agg((F.count_distinct(key) if repeated else F.count("*")).alias("df"))


def select_vocabulary(df: DataFrame, by: list[str], limits: Column | int, term: str = "term", min_df: int = 2) -> DataFrame:
    """(by, term, df, idx): terms of at least min_df, most frequent first, then by name, up to each family's limit.

    With one limit for all, Spark cuts each part of a family to it before the parts meet.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("df"), term))
    kept = df.where(F.col("df") >= min_df).withColumn("__rank", rank).where(F.col("__rank") <= limits)
    return kept.withColumn("idx", F.col("__rank") - 1).drop("__rank")


def joined_vocabulary(features: DataFrame, vocabulary: DataFrame, on: list[str]) -> DataFrame:
    """Features with their column; unknown ones are dropped. Spark broadcasts the vocabulary while it is small."""
    return features.join(vocabulary, on)


def family(feature: Column) -> Column:
    return F.split_part(feature, F.lit("__"), F.lit(1))


def tfidf(terms: DataFrame, key: str, group: str, term: str = "term", top: int = 4, members: DataFrame | None = None, repeated: bool = True) -> DataFrame:
    """(group, term, score, rank): tf = share of the group's records that have the term; idf = ln((N + 1) / records that have it).

    A record is in one group. members(key, group): the records that have a term at all; without it they are told from the terms.
    repeated: terms may have a (key, term) twice.
    """
    each = document_frequency(terms, key, [group], term, repeated).withColumnRenamed("df", "cf")
    sizes = (terms if members is None else members).groupBy(group).agg(F.count_distinct(key).alias("size"))
    everywhere = each.groupBy(term).agg(F.sum("cf").alias("gf"))
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))  # one row
    score = F.col("cf") / F.col("size") * F.log((F.col("total") + 1) / F.col("gf"))
    scored = each.join(sizes, group).join(everywhere, term).join(total).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), term))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(group, term, "score", "rank")
