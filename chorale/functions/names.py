"""Name and count lists: tags and genres in their three shapes, normalised and filtered."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from json import loads as parse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from chorale.functions.text import squeeze, token

#: Rows of a batch of numeric leaves, about.
LEAVES = 1 << 16
ITEM = "array<struct<name:string,count:double>>"

# Tag aliases, tags that are dropped, and acoustic measures that are dropped.
TAG_ALIASES = {"rhythm_and_blues": "r_and_b", "westcoast_rap": "west_coast_hip_hop", "west_coast_rap": "west_coast_hip_hop"}
DROPPED_TAGS = [
    "american", "american_rock", "english", "tempo_change", "vocal", "rap_hip_hop", "hip_hop_rap",
    "hip_hop_underground_hip_hop", "contemporary_rap_gangsta_rap_hardcore_rap_rap_west_coast_rap",
]
DROPPED_TAG_PARTS = ["billboard", "hot_100", "chart", "offizielle", "wochen", "ph_"]
DROPPED_ACOUSTIC_PARTS = [
    "__all__not_", "__gender__", "__genre_dortmund__", "__genre_rosamerica__", "__genre_tzanetakis__", "__genre_electronic__",
    "__ismir04_rhythm__", "__moods_mirex__", "__tonal_atonal__",
]
SKIPPED_ACOUSTIC_KEYS = ["metadata", "version", "versions", "recording_id", "mbid", "analysis_time", "timestamp"]


def _sorted(items: Column) -> Column:
    order = lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    return F.array_sort(items, order)


def from_structs(items: Column) -> Column:
    """array<struct<name, count>>: count 1 where missing, a given 0 stays; greatest first, then by name."""
    made = F.transform(F.coalesce(items.cast(ITEM), F.array().cast(ITEM)), lambda x: F.struct(squeeze(x["name"]).alias("name"), F.coalesce(x["count"], F.lit(1.0)).alias("count")))
    return _sorted(F.filter(made, lambda x: x["name"] != ""))


def from_strings(items: Column) -> Column:
    return from_structs(F.transform(items, lambda x: F.struct(x.alias("name"), F.lit(1.0).alias("count"))))


def from_map(items: Column) -> Column:
    """map<name, count>: here 0 and null count as 1."""
    made = F.transform(F.map_entries(items), lambda e: F.struct(e["key"].alias("name"), F.when(F.coalesce(e["value"].cast("double"), F.lit(0.0)) == 0, 1.0).otherwise(e["value"].cast("double")).alias("count")))
    return from_structs(made)


def first_wins(items: Column) -> Column:
    """Names that differ only in case once, the first one's, in their order."""
    seen = F.aggregate(
        from_order(items), F.array().cast(ITEM),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y["name"]) == F.lower(x["name"])), acc).otherwise(F.array_append(acc, x)),
    )
    return seen


def from_order(items: Column) -> Column:
    made = F.transform(F.coalesce(items.cast(ITEM), F.array().cast(ITEM)), lambda x: F.struct(squeeze(x["name"]).alias("name"), F.coalesce(x["count"], F.lit(1.0)).alias("count")))
    return F.filter(made, lambda x: x["name"] != "")


def canonical_tag(t: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in TAG_ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(known, t), t)


def keeps_tag(t: Column) -> Column:
    """t is a canonical tag."""
    return (t != "") & ~t.isin(DROPPED_TAGS) & ~t.rlike("|".join(DROPPED_TAG_PARTS))


def keeps_acoustic(name: Column) -> Column:
    return (name != "") & ~name.rlike("|".join(DROPPED_ACOUSTIC_PARTS)) & ~name.endswith("__probability")


def kept_tags(items: Column) -> Column:
    """array<struct<token, weight>> of a name/count column: canonical, kept tags with counts that aren't negative; a missing count is 1."""
    named = F.filter(items, lambda x: squeeze(x["name"]) != "")
    made = F.transform(named, lambda x: F.struct(token(x["name"]).alias("token"), F.coalesce(x["count"].try_cast("double"), F.lit(1.0)).alias("weight")))
    known = F.transform(made, lambda x: F.struct(canonical_tag(x["token"]).alias("token"), x["weight"].alias("weight")))
    return F.filter(known, lambda x: keeps_tag(x["token"]) & (x["weight"] >= 0))


def exploded_tags(df: DataFrame, key: str, items: str) -> DataFrame:
    """(key, token, weight) of kept_tags()."""
    return df.select(key, F.inline(kept_tags(F.col(items))))


def numeric_leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of the numbers in a JSON text column, however deep, in one pass over batches of rows.

    Path parts are tokens of object keys, or positions in arrays, joined by two underscores. Keys that name no
    measure are skipped, texts and booleans left out; invalid JSON, also such as is nested beyond what Python's parser takes, and
    null have no leaves. Of keys that an object repeats the last counts.
    """
    held = df.select(F.col(key).alias(key), F.col(json).cast("string").alias("__json"))
    schema = StructType([held.schema[key], StructField("path", StringType()), StructField("value", DoubleType())])

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, paths, values, done = [], [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                add_leaves(text, paths, values)
                ends.append(len(values))
                if len(values) >= LEAVES or i == batch.num_rows - 1:
                    at = np.repeat(np.arange(done, i + 1), np.diff(ends, prepend=0))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(paths, pa.string()), pa.array(values, pa.float64())], names=schema.names)
                    ends, paths, values, done = [], [], [], i + 1

    return held.mapInArrow(walked, schema)


def add_leaves(text: str | None, paths: list[str], values: list[float]) -> None:
    """Paths and values of the numbers in one JSON text, added to both lists."""
    try:
        open_ = [("", parse(text))] if text else []
    except (ValueError, RecursionError):
        return
    while open_:
        path, node = open_.pop()
        if isinstance(node, dict):
            named = node.items()
        elif isinstance(node, list):
            named = enumerate(node)
        else:
            continue
        for key, v in named:
            kind = type(v)
            if kind is str or kind is bool or v is None:
                continue
            name = _name(path, key) if type(key) is str else f"{path}__{key}" if path else str(key)
            if name is None:
                continue
            if kind is float:
                paths.append(name)
                values.append(v)
            elif kind is int:
                paths.append(name)
                values.append(float(v) if v.bit_length() < 1024 else math.inf if v > 0 else -math.inf)
            else:
                open_.append((name, v))


@lru_cache(maxsize=1 << 16)
def _name(path: str, key: str) -> str | None:
    """The path of an object's key; None for one to skip."""
    part = _part(key)
    return part if part is None or not path else f"{path}__{part}"


@lru_cache(maxsize=1 << 16)
def _part(name: str) -> str | None:
    """token() of an object's key; None for one to skip."""
    low = name.strip().lower()
    return None if not low or low in SKIPPED_ACOUSTIC_KEYS else re.sub("[^a-z0-9]+", "_", low.replace("&", " and ")).strip("_")


def ordered_distinct(items: Column, limit: int) -> Column:
    return F.slice(F.array_distinct(items), 1, limit)
