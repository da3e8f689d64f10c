"""Near-duplicates by MinHash bands, odd sketches and full shingle sets.

1. Each document's set of word shingles gives MinHash samples, band keys of them, and an odd sketch: a bitmap
   in which every sample flips one bit. Two sketches' XOR has few ones if the sets are very alike; the count
   estimates a high similarity closely. Documents with equal sets become one class, a node named by a hash of the set.
2. Classes that share a band key are candidates. First each looks only at the smallest class of each of its
   buckets; of the pairs that the sketches allow, its best two are confirmed on full sets.
3. What these links have joined needs no more pairs. In buckets where different components still meet, members
   of different components are compared by sketch and confirmed in memory, in blocks; only links come out.

So large groups of copies cost as many pairs as they have members. With 50 bands of 5 samples a pair at
similarity 0.75 is missed with a probability of about 1e-6, and one far above it never.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import documents, mixed, rows, shingle_hashes, spaced_words, stored, text_key, without, word_hashes
from chorale.llm.components import components

BANDS, ROWS, BITS = 50, 5, 1024
#: How far below the threshold a sketch's estimate may be for a pair to be confirmed; over four standard deviations.
SLACK = 0.13
#: Documents up to which a list is sent to all tasks (24 bytes each); beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket, and bytes of their sets, that are compared in one task (with as many others); members that are confirmed with their centre in one.
BLOCK, BLOCK_BYTES, SIDE = 5_000, 64_000_000, 200


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted hashes of a text's distinct k-word shingles; of a shorter text, of all its words as one."""
    h = word_hashes(spaced_words(text))
    return np.unique(shingle_hashes(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


@lru_cache(maxsize=4)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)[:, None]


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    a, b = _factors(n)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 2048):
        out = np.minimum(out, (a * x[None, k : k + 2048] + b).min(axis=1))
    return out


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> bytes:
    """A bitmap whose bits tell whether an odd number of the samples fall on them."""
    at = mixed((np.arange(len(samples), dtype=np.uint64) << np.uint64(32)) | samples) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1 > 0).tobytes()


def most_ones(samples: int, similarity: float, bits: int = BITS) -> float:
    """The expected ones in the XOR of two sketches at a similarity."""
    return bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))


def signatures(docs: DataFrame, shingle: int = 5, bands: int = BANDS, per_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, k1, k2, bands array<long>, sketch): k1 and k2 together name the set, text_key the text."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            n, k1, k2, keys, sketches = [], [], [], [], []
            for _, text in rows([batch]):
                s = shingle_set(text, shingle)
                n.append(len(s))
                m = mixed(s)
                k1.append(m.sum(dtype=np.uint64)), k2.append(np.bitwise_xor.reduce(mixed(m)) if len(s) else np.uint64(0))
                if not len(s):
                    keys.append([]), sketches.append(b"")
                    continue
                samples = minhashes(s, bands * per_band)
                key = mixed(band + np.uint64(1))
                for column in samples.reshape(bands, per_band).T:
                    key = mixed(key ^ column)
                keys.append(key.view(np.int64)), sketches.append(odd_sketch(samples))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (k1, k2)]
            cells = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), *longs, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "text_key", "n_shingles", "k1", "k2", "bands", "sketch"])

    own = documents(docs, id_col, text_col)
    return own.withColumn("text_key", text_key(own)).mapInArrow(sign, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")


def _ones(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def _estimated(pairs: DataFrame, most: float) -> DataFrame:
    """(a, b, ones) of the pairs (a, b, sa, sb) whose sketches differ in at most so many bits."""

    def estimate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = _ones(_unpacked(batch.column(2)), _unpacked(batch.column(3)))
            keep = pa.array(ones <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ones)], names=["a", "b", "ones"]).filter(keep)

    return pairs.select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long, ones long")


def _listed(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets, of sets(node, shingles), agree: 100 * intersection >= percent * union.

    b's set goes to each part of at most SIDE of its edges, so that a hub's edges aren't one task's.
    """
    degree = edges.groupBy("b").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"))
    sides = edges.join(degree, "b").select(F.col("a").alias("node"), F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_centre"))
    centres = degree.select(F.col("b").alias("node"), F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_centre"))

    def compare(group: pa.Table) -> pa.Table:
        texts = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        node, is_centre = group["node"].to_pylist(), group["is_centre"].to_pylist()
        found = set()
        for centre in (s for s, c in zip(texts, is_centre, strict=True) if c):
            for other, s, c in zip(node, texts, is_centre, strict=True):
                if not c and len(s) and len(centre):
                    common = _shared(s, centre)
                    if 100 * common >= percent * (len(s) + len(centre) - common):
                        found.add(other)
        found = sorted(found)
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([group["centre"][0].as_py()] * len(found), pa.int64())})

    wanted = sides.unionByName(centres).join(sets, "node")
    return wanted.groupBy("centre", "part").applyInArrow(compare, "a long, b long")


def _shared(left: np.ndarray, right: np.ndarray) -> int:
    return int((right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left).sum())


def _across(members: DataFrame, most: float, percent: int) -> DataFrame:
    """Links (a, b) between different components of one bucket; members(key, blocks, node, component, sketch, bands, shingles).

    Members are compared in memory: pairs whose sketches pass are confirmed on full sets, likeliest first, and a
    pair whose components have met already is left out. A pair that shares several buckets is compared in
    the first. Of a bucket of several blocks each two meet in a task of their own.
    """
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "sketch", "bands", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        node, component, key = group["node"].to_numpy(), group["component"].to_numpy(), group["key"][0].as_py()
        sketch, bands = _unpacked(group["sketch"].combine_chunks()), np.array(group["bands"].to_pylist(), np.int64)
        sets, root = group["shingles"], {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        links = []
        for k in range(0, len(node), 256):
            part = slice(k, k + 256)
            ones = _ones(sketch[part, None, :], sketch[None, :, :])
            left, right = np.nonzero((ones <= most) & (component[part, None] != component[None, :]) & (node[part, None] > node[None, :]))
            ones, left = ones[left, right], left + k
            same = bands[left] == bands[right]
            here = bands[left, same.argmax(axis=1)] == key
            order = np.argsort(ones[here], kind="stable")
            for x, y in zip(left[here][order].tolist(), right[here][order].tolist(), strict=True):
                cx, cy = find(component[x]), find(component[y])
                if cx != cy:
                    one, two = (np.frombuffer(sets[z].as_py(), np.uint64) for z in (x, y))
                    common = _shared(one, two)
                    if 100 * common >= percent * (len(one) + len(two) - common):
                        root[max(cx, cy)] = min(cx, cy)
                        links.append((int(node[x]), int(node[y])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. component_id: the
    smallest doc_id reachable over links; kept: it is the row's own. A text without words (empty, blank, null)
    has no shingles and is linked with nothing. Repeated rows have equal results; rows of one doc_id with other
    texts have a component each; a row with a null id is linked with nothing and has a null component_id and is
    kept. An empty table gives an empty one.
    """
    return _placed(docs, percent, shingle, id_col, text_col).drop("text_key")


def kept(docs: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are kept, and one row of repeated ones (equal id and text); rows with a null id all stay."""
    staying = without(docs, _placed(docs, percent, shingle, id_col, text_col).where("not kept"), id_col, text_col)
    named = staying.where(staying[id_col].isNotNull()).dropDuplicates([id_col, text_col])
    return named.unionByName(staying.where(staying[id_col].isNull()))


def _placed(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for each row."""
    samples = BANDS * ROWS
    most = most_ones(samples, percent / 100 - SLACK)
    signed = stored(signatures(docs, shingle, id_col=id_col, text_col=text_col), "signatures")
    name = ["n_shingles", "k1", "k2"]
    reader = F.min(F.struct("doc_id", "text_key")).alias("reader")  # the document whose text stands for the class
    grouped = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*name).agg(reader, F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stored(grouped.withColumn("node", F.xxhash64(*name)), "classes")
    sketches = classes.select("node", "sketch")
    bands = classes.select("node", F.explode("bands").alias("key"))
    # Counted before they meet: a bucket of very many classes isn't one task's.
    shared = stored(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1"), "buckets")
    members = stored(bands.join(shared, "key"), "members")

    pairs = members.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    best = F.row_number().over(Window.partitionBy("a").orderBy("ones", "b"))
    first = stored(_estimated(pairs, most).withColumn("rank", best).where("rank <= 2").select("a", "b"), "pairs")

    involved = stored(members.select("node").distinct().join(classes.select("node", "reader.*"), "node"), "involved")
    own = documents(docs, id_col, text_col)
    texts = own.withColumn("text_key", text_key(own)).join(_listed(involved, involved.count()), ["doc_id", "text_key"]).select("node", "text")
    sets = stored(_sets(texts, shingle), "sets")
    links = stored(confirmed(first, sets, percent), "links")
    joined = components(links)

    placed = members.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counted = placed.join(classes.select("node", "n_shingles"), "node").groupBy("key").agg((F.min("component") != F.max("component")).alias("open"), F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("size") / BLOCK_BYTES)).cast("int")
    mixed_keys = counted.where("open").select("key", blocks.alias("blocks"))
    left = placed.join(mixed_keys, "key").join(classes.select("node", "sketch", "bands"), "node").join(sets, "node")
    final = components(links.unionByName(_across(left, most, percent)))

    named = classes.select("node", F.col("reader.doc_id").alias("first"), "copies", *name).join(final, "node", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("first").alias("component_id"))
    changed = named.join(least, "component", "left").where("copies > 1 or component_id < first").select(*name, F.coalesce("component_id", "first").alias("component_id"))
    out = signed.select("doc_id", "text_key", *name).join(changed, name, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [shingle_set(t, shingle).tobytes() for _, t in rows([batch])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(make, "node long, shingles binary")
