"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A document draws an exponential number for every shard, from a hash of its id and the shard's number, divided by the
shard's weight. A rack draws the least number of its shards, a region the least of its racks: the least of exponentials
is one again, of the sum of their weights. At each level a document goes down to the child with the least draw, so a
child's share is its weight's share. A weight that changes moves documents only into or out of its own shard, and a
new shard takes documents only into itself, in whatever rack it stands: movement is confined to the subtrees
whose weights change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import documents, mixed, ranked, stored, word_hashes


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 4, per_rack: int = 5) -> list[Shard]:
    """Shards 0 to shards - 1 of equal weight; per_rack stand in a rack and `racks` racks in a region."""
    return [Shard(f"r{s // (racks * per_rack)}", f"r{s // (racks * per_rack)}.{s // per_rack % racks}", s) for s in range(shards)]


class Tree:
    """Shards by region and rack; whole batches of keys go down together."""

    def __init__(self, shards: list[Shard]) -> None:
        held = sorted((s for s in shards if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard))
        self.shards = np.array([s.shard for s in held], np.int32)
        self.weights = np.array([s.weight for s in held])
        self.seeds = word_hashes([f"shard {s.shard}".encode() for s in held])
        new_rack = [not i or (s.region, s.rack) != (held[i - 1].region, held[i - 1].rack) for i, s in enumerate(held)]
        self.racks = np.flatnonzero(new_rack)  # where each rack begins among the shards
        self.regions = np.flatnonzero([not i or held[self.racks[i]].region != held[self.racks[i - 1]].region for i in range(len(self.racks))])  # and each region among the racks

    def assign(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each key (64-bit hashes)."""
        return np.concatenate([self._down(keys[k : k + 4096]) for k in range(0, len(keys), 4096)] or [np.zeros(0, np.int32)])

    def _down(self, keys: np.ndarray) -> np.ndarray:
        hashed = mixed(mixed(keys[:, None] ^ self.seeds[None, :]) + np.uint64(0x9E3779B97F4A7C15))
        draws = -np.log(((hashed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / self.weights
        by_rack = np.minimum.reduceat(draws, self.racks, axis=1)
        region = np.minimum.reduceat(by_rack, self.regions, axis=1).argmin(axis=1)
        rack = _least_within(by_rack, self.regions, region)
        return self.shards[_least_within(draws, self.racks, rack)]


def _least_within(draws: np.ndarray, begins: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The child with the least draw among those of the chosen parent; begins: where each parent's children begin."""
    parent = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, draws.shape[1])))
    return np.where(parent[None, :] == chosen[:, None], draws, np.inf).argmin(axis=1)


def shard(docs: DataFrame, shards: int = 40, grown: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `key`.

    The shard follows from doc_id and the shard count alone, so repeated rows meet in one shard, and texts have
    no part in it. size: UTF-8 bytes plus 16; a null text has none and the checksum 0. slot: the row's place in
    its shard, gapless from 0, in no order that means anything. A null doc_id has a shard too. grown_shard:
    the shard when there are `grown` of them (one more if not given).
    """
    now, later = Tree(tree(shards)), Tree(tree(grown or shards + 1))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            keys = word_hashes([str(k).encode() for k in batch.column(0).to_pylist()])
            sizes, sums = [len(t or b"") + 16 for t in texts], [zlib.crc32(t or b"") for t in texts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(now.assign(keys)), pa.array(later.assign(keys))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    rows = documents(docs, id_col, text_col).mapInArrow(assign, "doc_id long, size long, text_crc32 long, shard int, grown_shard int").withColumn("law", F.lit("key"))
    placed = ranked(stored(rows, "shards"), ["shard"], ["doc_id", "text_crc32"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
