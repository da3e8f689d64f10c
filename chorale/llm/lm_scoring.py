"""Stupid-backoff scores of documents, from n-gram counts of the whole corpus without the document itself.

The relational plan is: explode n-grams, count them in tables partitioned by hash, join the counts back, sum per
document. Its rows are packed: documents are read into blocks; a block sends each hash partition the sorted
hashes of its distinct n-grams with their counts in the block; a partition adds up what all blocks sent and answers each
block with the corpus counts, in the order of its question; the block's n-grams meet their counts and its
documents are summed. A frequent n-gram is one entry for each block, and no table of n-grams is ever in one place.

Score of a word after its history: count(n-gram) / count(history) if both occur in other documents, else
BACKOFF times the score after the history without its first word; a single word's is count / words, and a
word that no other document has scores BACKOFF / words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import documents, partitions, rows, shingle_hashes, spaced_words, stored, word_hashes

BACKOFF = 0.4
#: Words at which a block is closed.
BLOCK = 3_000_000
#: Bits of an n-gram's hash that are sent: of N distinct n-grams one in 2**BITS / N shares another's count (at 30 GB of text one in ten millions).
BITS = 56
#: n-grams of the corpus, repeats included, for each hash partition at most: there are as many partitions as that takes.
GRAMS = 8_000_000


def packed(values: np.ndarray) -> bytes:
    """Integers, their bytes grouped by significance, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, doc_ids, lengths, words, codes): the documents' words as numbers of the block's distinct word hashes."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hashes, n, made = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            common = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.int64)
            place[common] = np.arange(len(words))
            name = (TaskContext.get().partitionId() << 24) + made
            cells = [[name], [ids], [lengths], [packed(words[common])], [packed(place[codes].astype(np.uint32))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "doc_ids", "lengths", "words", "codes"])

        for key, text in rows(batches):
            h = word_hashes(spaced_words(text))
            ids.append(key), lengths.append(len(h)), hashes.append(h)
            n += len(h)
            if n >= BLOCK:
                yield block()
                ids, lengths, hashes, n, made = [], [], [], 0, made + 1
        if ids:
            yield block()

    return documents(docs, id_col, text_col).mapInArrow(build, "block long, doc_ids array<long>, lengths array<int>, words binary, codes binary")


class _Grams:
    """The n-grams of a block, one order at a time: no array of another order is held meanwhile."""

    def __init__(self, words: bytes, codes: bytes, lengths: list[int]) -> None:
        self.h = unpacked(words, np.uint64)[unpacked(codes, np.uint32)] if sum(lengths) else np.zeros(0, np.uint64)
        lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.before = (np.arange(len(self.h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)

    def hashes(self, n: int) -> np.ndarray:
        """Of the n-grams that end at the words with n - 1 before them in their document."""
        if len(self.h) < n:
            return np.zeros(0, np.uint64)
        return (shingle_hashes(self.h, n) >> np.uint64(64 - BITS))[self.before[n - 1 :] >= n - 1]

    def counted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams' hashes, in order, and how often each stands in the block."""
        own = self.hashes(n)
        own.sort()
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(own), 1), bool), own[1:] != own[:-1]]))
        return own[starts], np.diff(starts, append=len(own)).astype(np.uint32)

    def at(self, n: int) -> np.ndarray:
        """For each word the number of the n-gram that ends there, in the order of counted(); -1 where there is none."""
        own = self.hashes(n)
        numbers = np.full(len(self.h), -1, np.int32)
        order = np.argsort(own)
        own = own[order]
        ranks = np.empty(len(own), np.int32)
        ranks[order] = np.cumsum(np.concatenate([np.zeros(min(len(own), 1), bool), own[1:] != own[:-1]]), dtype=np.int32)
        numbers[self.before >= n - 1] = ranks
        return numbers

    def own(self, at: np.ndarray) -> np.ndarray:
        """At each word, how often its n-gram stands in its document; 0 where there is none."""
        whole = np.flatnonzero(at >= 0).astype(np.int32)
        pairs = self.doc[whole].astype(np.int64) * (int(at.max(initial=0)) + 1) + at[whole]
        order = np.argsort(pairs)
        pairs = pairs[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]]))
        counts = np.diff(starts, append=len(pairs))
        out = np.zeros(len(at), np.int32)
        out[whole[order]] = np.repeat(counts, counts)
        return out


def _bounds(parts: int) -> np.ndarray:
    """The first hash of each hash partition but the first."""
    return np.array([(k << BITS) // parts for k in range(1, parts)], np.uint64)


def _questions(order: int, parts: int):
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(parts)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                grams = _Grams(*(batch[c][i].as_py() for c in ("words", "codes", "lengths")))
                for n in range(1, order + 1):
                    distinct, counts = grams.counted(n)
                    cuts = np.concatenate([[0], np.searchsorted(distinct, bounds), [len(distinct)]])
                    out = []
                    for part in np.flatnonzero(np.diff(cuts)).tolist():
                        a, b = cuts[part : part + 2]
                        out.append((batch["block"][i].as_py(), n, part, packed(np.diff(distinct[a:b], prepend=np.uint64(0))), packed(counts[a:b])))
                    columns = zip(*out, strict=True) if out else [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "n", "part", "hashes", "counts"])

    return ask


def _answer(group: pa.Table) -> pa.Table:
    """Corpus counts for what each block asked of one hash partition."""
    hashes = [np.cumsum(unpacked(x, np.uint64)) for x in group["hashes"].to_pylist()]
    counts = np.concatenate([unpacked(x, np.uint32) for x in group["counts"].to_pylist()])
    _, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, weights=counts).astype(np.uint64)[which]
    ends = np.cumsum([len(h) for h in hashes])
    cells = [packed(total[e - len(h) : e]) for h, e in zip(hashes, ends, strict=True)]
    return pa.table({"block": group["block"], "n": group["n"], "part": group["part"], "totals": pa.array(cells, pa.binary())})


def _scores(order: int, backoff: float, corpus: int):
    def score(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        grams = _Grams(row.pop("words"), row.pop("codes"), row["lengths"])
        lengths = np.array(row["lengths"], np.int64)
        places = sorted((n, part, i) for i, (n, part) in enumerate(zip(answers["n"].to_pylist(), answers["part"].to_pylist(), strict=True)))
        words = np.maximum(corpus - lengths, 1)
        value, level, shorter = None, np.zeros(len(grams.h), np.int8), None
        for n in range(1, order + 1):
            totals = np.concatenate([unpacked(answers["totals"][i].as_py(), np.uint64) for m, _, i in places if m == n] or [np.zeros(0, np.uint64)]).astype(np.int64)
            at = grams.at(n)
            others = np.where(at >= 0, totals[at] if len(totals) else 0, 0) - grams.own(at)  # at each word, how often other documents have its n-gram
            if n == 1:
                value = np.where(others > 0, np.log(np.maximum(others, 1) / words[grams.doc]), np.log(backoff / words)[grams.doc])
                level[others > 0] = 1
            else:
                history = np.concatenate([np.zeros(min(len(shorter), 1), np.int64), shorter[:-1]])
                whole = grams.before >= n - 1
                found = (others > 0) & (history > 0) & whole
                value[whole] += np.log(backoff)
                value[found] = np.log(others[found] / history[found])
                level[found] = n
            shorter = others
        total = np.bincount(grams.doc, weights=value, minlength=len(lengths))
        longest = np.bincount(grams.doc[level == order], minlength=len(lengths))
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(lengths), "n_found": pa.array(longest.astype(np.int64)),
            "log_score": pa.array(total.astype(float)), "mean_log_score": pa.array([t / n if n else None for t, n in zip(total.tolist(), lengths.tolist(), strict=True)], pa.float64()),
        })

    return score


def backoff_scores(docs: DataFrame, order: int = 2, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_found, log_score, mean_log_score) for each row.

    n_found: words whose n-gram of the full order other documents have. log_score: natural logarithms summed
    over the words; a text without words (empty, null) has 0 and a null mean. Words are split at white space
    and A-Z lower-cased. "Other documents" are other rows: a repeated row counts for its copy. A null doc_id
    stays null; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    made = stored(blocks(docs, id_col, text_col), "blocks")
    corpus = made.select(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n")).first()["n"]
    parts = max(partitions(spark), order * corpus // GRAMS)
    asked = made.mapInArrow(_questions(order, parts), "block long, n int, part int, hashes binary, counts binary")
    answered = asked.groupBy("n", "part").applyInArrow(_answer, "block long, n int, part int, totals binary")
    kinds = "doc_id long, n_words long, n_found long, log_score double, mean_log_score double"
    return made.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_scores(order, backoff, corpus), kinds)
