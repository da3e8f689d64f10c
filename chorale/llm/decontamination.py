"""Benchmark decontamination with a distributed positional inverted index over the training texts.

The index is partitioned by documents: each row is a block of whole documents with, for every term of theirs, the
ascending places where it stands in the block. It is written once, and a search goes to each block. It takes the
postings of a window's rarest term in the block, shifts them by the term's offset, and intersects them with the next
rarest, until a term leaves nothing or all have agreed; a proximity search starts at the rarest term, too, and asks that
the others stand near. Blocks don't depend on each other: only documents with matches are shuffled.

The benchmark goes to every block in parts of at most MAX_BENCHMARK bytes, one after another: the driver holds one part
at a time, and matches of the parts are put together by block and document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import documents, plain_words, rows, stored, text_key, without

#: Words of a block at which it is closed; a longer document has a block of its own.
BLOCK = 1_000_000
#: Places left free between documents of a block: no window or proximity reaches from one into the next.
GAP = 256
#: Bytes of benchmark text that go to the blocks at once.
MAX_BENCHMARK = 16_000_000
#: Words that a piece's words may stand from its first one, to be near.
REACH = 26
_INDEX = "block long, doc_ids array<long>, keys array<long>, starts array<int>, lengths array<int>, terms array<binary>, ends array<int>, places binary"


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self)
        return found


def _packed(places: np.ndarray) -> bytes:
    """Differences, their bytes grouped by significance, which compresses well."""
    return np.ascontiguousarray(np.diff(places, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").reshape(-1), dtype=np.int32)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of all terms, in blocks of documents.

    A row: a number of the block; ids, hashes of the texts, first places and lengths in words of its documents; its terms; for each the end of
    its postings in places (packed int32). Null and empty texts are documents of no words. The numbers hold for one
    reading of the table, so an index is written before it is searched.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _INDEX.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
        first, made = TaskContext.get().partitionId() << 32, 0

        def block(ids, keys, starts, lengths, codes, at, numbers) -> pa.RecordBatch:
            codes, at = np.concatenate(codes), np.concatenate(at)
            ends = np.cumsum(np.bincount(codes, minlength=len(numbers))).astype(np.int32)
            cells = [first + made, ids, keys, starts, lengths, list(numbers), ends, _packed(at[np.argsort(codes, kind="stable")])]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

        fresh = lambda: ([], [], [], [], [], [], _Numbers())
        state, end = fresh(), 0
        for key, text, name in rows(batches, 2):
            words = plain_words(text)
            if state[0] and end + len(words) > BLOCK:
                yield block(*state)
                state, end, made = fresh(), 0, made + 1
            ids, keys, starts, lengths, codes, at, numbers = state
            ids.append(key), keys.append(name), starts.append(end), lengths.append(len(words))
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            at.append(np.arange(end, end + len(words), dtype=np.int32))
            end += len(words) + GAP
        if state[0]:
            yield block(*state)

    own = documents(docs, id_col, text_col)
    return own.withColumn("text_key", text_key(own)).mapInArrow(build, _INDEX)


@dataclass
class Windows:
    """Sequences of words of a benchmark as term numbers, the items of each, and the terms."""

    terms: list[bytes]
    numbers: np.ndarray  # windows x longest, -1 beyond a shorter window's end
    items: list[list[str]]  # of each window

    @staticmethod
    def of(items: list[tuple[str, str | None]], size: int, step: int = 1) -> Windows:
        """Windows of `size` words, each `step` words on; the last one ends with the item, and an item of fewer words is one."""
        found: dict[tuple[bytes, ...], dict[str, None]] = {}
        for item, text in items:
            words = plain_words(text.encode()) if text else []
            if words:
                last = max(len(words) - size, 0)
                for k in sorted({min(k, last) for k in range(0, last + step, step)}):
                    found.setdefault(tuple(words[k : k + size]), {})[item] = None
        of = _Numbers()
        numbers = np.full((len(found), size), -1, np.int32)
        for i, w in enumerate(found):
            numbers[i, : len(w)] = [of[t] for t in w]
        return Windows(list(of), numbers, [list(x) for x in found.values()])


class _Block:
    """The postings of one block for the terms of a search."""

    def __init__(self, terms: pa.Array, row: dict) -> None:
        places, ends = _unpacked(row["places"].as_py()), row["ends"].values.to_numpy()
        have = pc.fill_null(pc.index_in(terms, value_set=row["terms"].values), -1).to_numpy()
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        none = np.zeros(0, np.int32)
        self.postings = [places[begins[k] : ends[k]] if k >= 0 else none for k in have.tolist()]
        self.counts = np.array([*(len(p) for p in self.postings), np.iinfo(np.int64).max])  # the last: beyond a window's end
        self.starts, self.lengths = (row[c].values.to_numpy().astype(np.int64) for c in ("starts", "lengths"))

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def _rarest_first(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(window, its offsets by how rare their terms are) of the windows whose terms the block has."""
        counts = self.counts[numbers]
        for w in np.flatnonzero(counts.min(axis=1) > 0).tolist():
            order = np.argsort(counts[w], kind="stable")
            yield w, order[numbers[w, order] >= 0]

    def phrases(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(window, places where it begins, its length) of the windows that stand in the block."""
        for w, order in self._rarest_first(numbers):
            at = self.postings[numbers[w, order[0]]] - order[0]
            for k in order[1:]:
                at = at[_among(self.postings[numbers[w, k]], at + k)]
                if not len(at):
                    break
            if len(at):
                yield w, at, len(order)

    def near(self, numbers: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(window, places of its first word) where all its other words stand at most `reach` words from there."""
        for w, order in self._rarest_first(numbers):
            at, rare = self.postings[numbers[w, 0]], self.postings[numbers[w, order[0]]]
            low, high = np.searchsorted(at, rare - reach, "left"), np.searchsorted(at, rare + reach, "right")
            sizes = high - low
            at = at[np.unique(np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))]
            for k in order[1:]:
                other = self.postings[numbers[w, k]]
                at = at[np.searchsorted(other, at + reach, "right") > np.searchsorted(other, at - reach, "left")]
                if not len(at):
                    break
            if len(at):
                yield w, at


def _among(sorted_places: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.searchsorted(sorted_places, at)
    k[k == len(sorted_places)] = 0
    return sorted_places[k] == at


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def proximity(indexed: DataFrame, queries: list[tuple[str, list[bytes]]], reach: int = REACH) -> DataFrame:
    """(doc_id, query, n_places): documents with places of a query's first word from which all its words stand at most `reach` (below GAP) words."""
    if reach >= GAP:
        raise ValueError(f"reach must be below {GAP}")
    of = _Numbers()
    numbers = np.full((len(queries), max([1, *(len(q) for _, q in queries)])), -1, np.int32)
    for i, (_, q) in enumerate(queries):
        numbers[i, : len(q)] = [of[t] for t in q]
    terms = list(of)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.binary())
        for row in _blocks(batches):
            block, ids, out = _Block(wanted, row), row["doc_ids"].as_py(), []
            for q, at in block.near(numbers, reach):
                docs, n = np.unique(block.documents(at), return_counts=True)
                out += [(ids[d], queries[q][0], int(c)) for d, c in zip(docs, n, strict=True)]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["doc_id", "query", "n_places"])

    return indexed.mapInArrow(search, "doc_id long, query string, n_places long")


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in parts of bounded size, dealt by a hash; an item is whole."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = total // MAX_BENCHMARK + 1
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
        yield [(str(r["item"]), r["text"]) for r in own.collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, near: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated[, n_near_items], items): the benchmark's windows in each row's document.

    n_hit: words inside any window of `window` words; an item of fewer words is one window. contaminated:
    share * n_hit >= n_words and n_hit > 0. n_near_items: items of which a piece (`window` words, cut side by side, the last
    ending with the item) has all its words at most REACH words from a place of its first one, in whatever order. A null or
    empty text has no words, and an item without words no window; repeated documents each have their row; item ids are
    told apart as strings.
    """
    return _judged(docs, benchmark, window, share, near, id_col, text_col, item_col, item_text_col).drop("text_key")


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows, with all their columns, that aren't contaminated; null and empty texts stay, and rows of one doc_id are judged each by its own text."""
    judged = _judged(docs, benchmark, window, share, False, id_col, text_col, item_col, item_text_col)
    return without(docs, judged.where("contaminated"), id_col, text_col)


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, share: int, near: bool, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    indexed = stored(index(docs, id_col, text_col), "postings")
    found = [stored(indexed.mapInArrow(_search(items, window, near), "block long, doc_no int, items array<string>, near_items array<string>, hit array<int>"), "matches") for items in _parts(benchmark, item_col, item_text_col)]
    together = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    matches = reduce(DataFrame.unionByName, found).groupBy("block", "doc_no").agg(together("items"), together("near_items"), together("hit"))
    every = indexed.select("block", F.posexplode(F.arrays_zip("doc_ids", "keys", "lengths")).alias("doc_no", "d"))
    every = every.select("block", "doc_no", F.col("d.doc_ids").alias("doc_id"), F.col("d.keys").alias("text_key"), F.col("d.lengths").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    hit, items = F.coalesce(F.size("hit"), F.lit(0)).cast("long"), F.array_sort(F.coalesce("items", none))
    return every.join(matches, ["block", "doc_no"], "left").select(
        "doc_id", "text_key", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"), *([F.size(F.coalesce("near_items", none)).cast("long").alias("n_near_items")] if near else []), items.alias("items"),
    )


def _search(part: list[tuple[str, str | None]], size: int, near: bool):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, pieces = Windows.of(part, size), Windows.of(part if near else [], size, size)
        terms, piece_terms = pa.array(windows.terms, pa.binary()), pa.array(pieces.terms, pa.binary())
        names = ["block", "doc_no", "items", "near_items", "hit"]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
        for row in _blocks(batches):
            block = _Block(terms, row)
            cover = np.zeros(int(block.starts[-1] + block.lengths[-1]) + 1, np.int32)
            items: dict[int, set[str]] = {}
            for w, at, length in block.phrases(windows.numbers):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                for d in np.unique(block.documents(at)).tolist():
                    items.setdefault(d, set()).update(windows.items[w])
            hit = np.flatnonzero(np.cumsum(cover) > 0)
            alike: dict[int, set[str]] = {}
            for w, at in _Block(piece_terms, row).near(pieces.numbers, REACH) if near else ():
                for d in np.unique(block.documents(at)).tolist():
                    alike.setdefault(d, set()).update(pieces.items[w])
            some = sorted(items.keys() | alike.keys())
            low, high = (np.searchsorted(hit, block.starts[some] + (block.lengths[some] if end else 0)) for end in (False, True))
            places = [(hit[a:b] - block.starts[d]).astype(np.int32) for d, a, b in zip(some, low, high, strict=True)]
            cells = [[row["block"].as_py()] * len(some), some, [sorted(items.get(d, ())) for d in some], [sorted(alike.get(d, ())) for d in some], places]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

    return search
