"""Best-fit packing of token sequences by a configuration linear program over the histogram of lengths.

The lengths of all pieces are counted on the cluster; the histogram has at most `capacity` rows, whatever the
input. From it a plan is made: which combinations of lengths share a sequence, and how often. Pieces are then
ranked within their length and find their place in the plan by binary search, without meeting each other.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chorale.llm.common import documents, ranked, stored

#: Encoded words that a worker keeps before it starts anew; it bounds memory, not results.
KEPT = 400_000
#: Words that are merged without the tokenizer, and the tokenizer's own rule for parts of a word.
LATIN, ENDS = "\u012f", frozenset(".,;:!?")
_PLAIN_WORD = regex.compile("[!-~\u00c0-\u012f]*")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Rounds of multiplicative weights and their step; lengths in the pricing of a round, and configurations that it gives.
ROUNDS, STEP, PRICED, TAKEN = 150, 0.5, 512, 64


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Token ids of white-space separated words, as little-endian bytes.

    This kind of tokenizer drops white space and never joins what it parts, so words encode alone. Words of
    Latin letters, digits and ASCII signs are merged by tiktoken from the same vocabulary, which ranks each
    merge by the id of what it makes; a byte that no text has marks the end of a part. All other words go to
    the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text())["model"]
        if model.get("end_of_word_suffix") != "</w>":
            raise ValueError("not a vocabulary with word ends")
        of_char = _bytes_of_chars()
        ranks = {}
        for token, n in model["vocab"].items():
            body = token.removesuffix("</w>")
            if all(c in of_char for c in body):
                ranks[bytes(map(of_char.__getitem__, body)) + b"\xff" * (body != token)] = n
        special = {ranks.pop(k): k for k in [k for k in ranks if k.startswith(b"<|")]}
        if special and max(ranks.values()) > min(special):
            raise ValueError("special ids among the others")
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        if word.isalpha() and max(word) <= LATIN:
            found = pack_ids(self.merge(word.lower().encode() + b"\xff"))
        elif word[-1:] in ENDS and word[:-1].isalpha() and max(word) <= LATIN:
            found = self[word[:-1]] + self[word[-1]]
        elif _PLAIN_WORD.fullmatch(word) and "<|" not in word:
            found = b"".join(pack_ids(self.merge(part.encode() + b"\xff")) for part in _PARTS.findall(word.lower()))
        else:
            found = pack_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _bytes_of_chars() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids array<int>]): each document's ids and its end id, cut where they pass the capacity.

    A null or empty text is its end id alone. Repeated rows each give pieces; a null doc_id stays null.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = pack_ids([end_id])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = (words.ids(text) if text else b"") + end
                for n, at in enumerate(range(0, len(made), 4 * capacity)):
                    part = made[at : at + 4 * capacity]
                    doc.append(key), piece.append(n), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([doc, piece, start, length, crc, ids], kinds, strict=True)][: len(names)], names=names)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents(docs, id_col, text_col).mapInArrow(cut, kinds)


@dataclass
class Plan:
    """Runs of sequences with the same lengths in them: (how often, [(length, items in a sequence)...])."""

    capacity: int
    runs: list[tuple[int, list[tuple[int, int]]]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.runs)

    def places(self) -> dict[int, np.ndarray]:
        """For each length, columns (first rank, first sequence, items in a sequence, offset) of its runs."""
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for times, inside in self.runs:
            at = 0
            for length, items in inside:
                out.setdefault(length, []).append((ranks.get(length, 0), sequence, items, at))
                ranks[length] = ranks.get(length, 0) + times * items
                at += length * items
            sequence += times
        return {k: np.array(v, np.int64) for k, v in out.items()}


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For each capacity, the last item of the most valuable multiset of sizes (ascending) that fits; -1: leave a token free."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            value = prices[: upto[c]] + best[c - sizes[: upto[c]]]
            k = value.argmax()
            if value[k] > best[c]:
                best[c], last[c] = value[k], k
    return last


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """An approximate solution of the configuration linear program: (index of a size -> items, how often).

    A size's price is its length times a weight. Each round prices configurations by one knapsack table, takes
    the best one through each of the dearest sizes as often as its scarcest size allows, and lowers the weights
    of what they cover; at last all is scaled to the demand.
    """
    weight, covered = np.ones(len(sizes)), np.zeros(len(sizes))
    taken: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        pool = np.sort(np.lexsort((-sizes, -weight))[:PRICED])
        last = _knapsack(sizes[pool], sizes[pool] * weight[pool], capacity)
        for first in pool[np.argsort(-weight[pool] * sizes[pool], kind="stable")[:TAKEN]]:
            config, room = {int(first): 1}, capacity - int(sizes[first])
            while room > 0:
                if last[room] < 0:
                    room -= 1
                else:
                    k = int(pool[last[room]])
                    config[k] = config.get(k, 0) + 1
                    room -= int(sizes[k])
            k, a = np.array(list(config)), np.array(list(config.values()))
            times = (demand[k] / a).min()
            key = tuple(sorted(config.items()))
            taken[key] = taken.get(key, 0) + times
            covered[k] += times * a
            weight[k] *= np.exp(-STEP * times * a / demand[k])
        weight /= weight.max()
    scale = np.median((demand / np.maximum(covered, 1e-9))[covered > 0]) if covered.any() else 0
    return sorted(((dict(c), x * scale) for c, x in taken.items()), key=lambda x: -x[1])


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Sequences for all pieces of a histogram of lengths.

    Full pieces stand alone. The linear program packs the lengths above 1/32 of the capacity; its solution is
    rounded down to whole sequences. Best fit then fills what stays free in them with what is left, longest
    first, and opens new sequences for the rest. Lengths of which few fit into a sequence can leave the program with more
    sequences than best fit alone, which is then taken.
    """
    alone: list[list] = []
    _best_fit(alone, {n: c for n, c in histogram.items() if c > 0}, capacity)
    left = {n: c for n, c in histogram.items() if c > 0}
    runs: list[list] = [[left.pop(capacity), [(capacity, 1)], 0]] if capacity in left else []
    sizes = np.array(sorted(n for n in left if n > capacity // 32), np.int64)
    if len(sizes):
        for config, times in fractional(sizes, np.array([left[int(n)] for n in sizes], float), capacity):
            inside = [(int(sizes[k]), a) for k, a in config.items()]
            whole = min(int(times), *(left[n] // a for n, a in inside))
            if whole:
                for n, a in inside:
                    left[n] -= whole * a
                runs.append([whole, inside, capacity - sum(n * a for n, a in inside)])
    _best_fit(runs, left, capacity)
    runs = min(alone, runs, key=lambda r: sum(times for times, _, _ in r)) if runs else alone
    return Plan(capacity, [(times, inside) for times, inside, _ in runs])


def _best_fit(runs: list[list], left: dict[int, int], capacity: int) -> None:
    """Put each length, longest first, into the runs with the least room that has room for it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, (_, _, room) in enumerate(runs):
        by_room[room].append(i)
    for n in sorted(left, reverse=True):
        count, room = left[n], n
        while count:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                fit = capacity // n
                for times, items in ((count // fit, fit), (int(count % fit > 0), count % fit)):
                    if times:
                        runs.append([times, [(n, items)], capacity - n * items])
                        by_room[capacity - n * items].append(len(runs) - 1)
                break
            i = by_room[room].pop()
            times, inside, _ = runs[i]
            items = min(room // n, max(1, count // times))
            used = min(times, count // items)
            if used < times:
                runs[i][0] = times - used
                by_room[room].append(i)
                runs.append([used, inside, room])
                i = len(runs) - 1
            runs[i][1], runs[i][2] = [*inside, (n, items)], room - n * items
            by_room[runs[i][2]].append(i)
            count -= used * items
            room = n
    left.clear()


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() with (sequence_id, offset): its sequence and the token where it begins there.

    An empty table gives an empty one. Which of several pieces of one length stands where is settled by
    doc_id and piece; of repeated rows any may stand first.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    places, names = plan(histogram, capacity).places(), cut.columns
    placed = ranked(cut, ["length"], ["doc_id", "piece"], "rank")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                run = places[int(n)]
                run = run[np.searchsorted(run[:, 0], rank[own], "right") - 1]
                within = rank[own] - run[:, 0]
                sequence[own] = run[:, 1] + within // run[:, 2]
                offset[own] = run[:, 3] + within % run[:, 2] * n
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    return placed.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
