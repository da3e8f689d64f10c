"""License scan by diagonal voting, in DataFrame operations only.

All rolling word k-grams of the texts are joined by hash to the k-grams of license templates. A match of
document word i with template word j votes for the diagonal i - j. Diagonals of one document and template that
lie at most SHIFT words apart (words put in or left out) are merged to a span, and a span is verified: its
votes must cover enough of the template's words, in a stretch of the document that is not much longer.

Templates are few and short: their k-grams are broadcast, and a limit on their number is checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import documents, text_key

#: Words of a k-gram, diagonals that are merged, and the shares that verify a span.
K, SHIFT, COVER, STRETCH = 3, 2, 0.7, 1.5
#: k-grams of all templates that are broadcast at most.
MAX_GRAMS = 100_000
#: Phrases of the base scan and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels and the wording of notices that stands for them (fixed values).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("public-domain", "this work has been dedicated to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words with A-Z lower-cased, as far as words of ASCII go, which all phrases and templates are.

    lower() turns other letters, too, but one alone to an ASCII one: the Kelvin sign, which is put aside before.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0137"))), F.lit(_WORD), 0)


def _starts(w: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively; texts without one of them aren't walked."""
    parts = phrase.split()
    size = F.size(w)
    here = lambda i: reduce(lambda a, b: a & b, (F.get(w, i + n) == p for n, p in enumerate(parts)))
    found = F.filter(F.sequence(F.lit(0), size - len(parts)), here)
    return F.when((size >= len(parts)) & reduce(lambda a, b: a & b, (F.array_contains(w, p) for p in parts)), found).otherwise(F.array().cast("array<int>"))


def base_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels): places of the base phrases."""
    return _base(docs, id_col, text_col).drop("text_key")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = documents(docs, id_col, text_col)
    w = own.select("doc_id", text_key(own).alias("text_key"), words(F.col("text")).alias("w"))
    found = w.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), *(_starts(F.col("w"), p).alias(f"s{i}") for i, p in enumerate(BASE)))
    places = F.concat(*(F.col(f"s{i}") for i in range(len(BASE))))
    named = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"s{i}") > 0, label) for i, label in enumerate(BASE.values())))))
    return found.select(
        "doc_id", "text_key", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), named.alias("base_labels"),
    )


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, label, template, first_word, n_span, share, verified): merged diagonals of each document and template; text_key tells texts of one id apart."""
    templates = TEMPLATES if templates is None else templates
    split = [(i, label, text.split()) for i, (label, text) in enumerate(templates)]
    if sum(len(w) for _, _, w in split) > MAX_GRAMS:
        raise ValueError(f"more than {MAX_GRAMS} template k-grams")
    spark = docs.sparkSession
    gram = lambda w: [(i, label, j, len(t), *t[j : j + k]) for i, label, t in w for j in range(len(t) - k + 1)]
    names = [f"w{n}" for n in range(k)]
    grams = spark.createDataFrame(gram(split), "template int, label string, j int, n_template int, " + ", ".join(f"{n} string" for n in names))
    grams = grams.select("template", "label", "j", "n_template", F.xxhash64(*names).alias("h"))

    own = documents(docs, id_col, text_col)
    who = ["doc_id", "text_key"]
    w = own.select("doc_id", text_key(own).alias("text_key"), words(F.col("text")).alias("w"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*(F.get("w", i + n) for n in range(k))))
    rolled = w.where(F.size("w") >= k).select(*who, F.posexplode(hashes).alias("i", "h"))
    votes = rolled.join(F.broadcast(grams), "h").select(*who, "template", "label", "n_template", "j", "i", (F.col("i") - F.col("j")).alias("diagonal"))

    by_diagonal = votes.groupBy(*who, "template", "label", "n_template", "diagonal").agg(F.collect_set("j").alias("js"), F.min("i").alias("first"), F.max("i").alias("last"))
    order = Window.partitionBy(*who, "template").orderBy("diagonal")
    begins = (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT).cast("int")
    run = F.sum(F.coalesce(begins, F.lit(0))).over(order)
    merged = by_diagonal.withColumn("run", run).groupBy(*who, "template", "label", "n_template", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + k - 1)))))
    share, length = covered / F.col("n_template"), F.col("last") - F.col("first") + k
    return merged.select(
        *who, "label", "template", F.col("first").cast("long").alias("first_word"), length.cast("long").alias("n_span"), share.alias("share"),
        ((share >= COVER) & (length <= STRETCH * F.col("n_template"))).alias("verified"),
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    labels: those of base phrases and of verified spans. score: 1 with a base phrase, else the largest share of a
    template that a verified span covers, else 0. A null or empty text has no words. Repeated rows each have
    their row; rows of one doc_id with other texts, and rows with a null id, are labelled each by its own text.
    """
    verified = spans(docs, templates, id_col=id_col, text_col=text_col).where("verified")
    found = verified.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", none)))
    base = _base(docs, id_col, text_col)
    return base.join(found, base["doc_id"].eqNullSafe(found["__id"]) & (base["text_key"] == found["__key"]), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
