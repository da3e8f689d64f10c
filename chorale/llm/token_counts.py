"""Token counts of every prefix of a text, by dynamic programming over the prefixes.

A byte-pair encoding is right if every two tokens that stand side by side are what the encoder makes of
their joined text. So the last token of a prefix is the one vocabulary piece at its end that agrees with the
last token of what stands before it, and count(prefix) = count(what stands before) + 1. No prefix is encoded
again; agreement of two pieces is asked of the encoder once and kept.

No piece of the vocabulary has a space mark after another character, so merges never cross the start of a
space run: the table of a text is made of the tables of its chunks (a space run and what follows it), and
counts of short chunks and of their prefixes are kept for the next text. A long chunk (a text without spaces) has arrays
by place: memory grows with its length.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from chorale.llm.common import documents

MARK = "▁"
#: Entries that a worker keeps of each kind before it starts anew, and symbols of the chunks that it keeps; they bound memory, not results.
KEPT, SHORT = 200_000, 64
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


class PrefixCounter:
    """Exact token counts of prefixes under one sentencepiece BPE model."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        e = self.encoder
        ids = range(e.get_piece_size())
        self.pieces = {e.id_to_piece(i) for i in ids if not (e.is_control(i) or e.is_unknown(i) or e.is_byte(i) or e.is_unused(i))}
        self.endings = {p[i:] for p in self.pieces for i in range(len(p))}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[int, str]] = {}
        self.totals = _Totals(self)
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece goes on after a space: chunks of this model aren't independent")

    def _agree(self, pair: tuple[str, str]) -> bool:
        if len(self.agreed) >= KEPT:
            self.agreed.clear()
        left, right = pair
        # A line feed is never merged, so what follows it is encoded as if it stood inside a text.
        made = self.encoder.encode(f"\n{left}{right}", out_type=str)[2:]
        found = self.agreed[pair] = made == ([left, right] if left else [right])
        return found

    def count(self, symbols: str) -> int:
        """Tokens of a chunk's prefix, from the counts of the shorter prefixes that its last token may follow."""
        if len(symbols) > SHORT:
            return self._walked(symbols)[-1]
        if len(self.prefixes) >= 2 * KEPT:
            self.prefixes.clear()
        return self._prefix(symbols)[0]

    def counts(self, symbols: str) -> Sequence[int]:
        """Tokens of each prefix of a chunk, from the empty one on."""
        return self._walked(symbols) if len(symbols) > SHORT else [self.count(symbols[:i]) for i in range(len(symbols) + 1)]

    def _starts(self, symbols: str, end: int) -> list[int]:
        """Where a piece that ends there begins, the longest piece first."""
        pieces, endings, starts = self.pieces, self.endings, []
        for start in range(end - 1, -1, -1):
            piece = symbols[start:end]
            if piece not in endings:
                break
            if piece in pieces:
                starts.append(start)
        return starts[::-1]

    def _agrees(self, last: str, piece: str) -> bool:
        known = self.agreed.get((last, piece))
        return self._agree((last, piece)) if known is None else known

    def _walked(self, symbols: str) -> array:
        """counts() of a chunk of any length, by place: the count and the start of the last token of each prefix (the end itself after bytes)."""
        counts, last = array("q", [0]), array("q", [0])
        for end in range(1, len(symbols) + 1):
            for start in self._starts(symbols, end):
                if self._agrees(symbols[last[start] : start], symbols[start:end]):
                    counts.append(counts[start] + 1), last.append(start)
                    break
            else:
                counts.append(counts[end - 1] + len(symbols[end - 1].encode())), last.append(end)
        return counts

    def _prefix(self, symbols: str) -> tuple[int, str]:
        """(tokens, last token)"""
        found = self.prefixes.get(symbols)
        if found is not None:
            return found
        if not symbols:
            return 0, ""
        for start in self._starts(symbols, len(symbols)):
            count, last = self._prefix(symbols[:start])
            piece = symbols[start:]
            if self._agrees(last, piece):
                found = self.prefixes[symbols] = count + 1, piece
                return found
        # Bytes stand for a character outside the vocabulary; they merge with nothing.
        found = self.prefixes[symbols] = self._prefix(symbols[:-1])[0] + len(symbols[-1].encode()), ""
        return found

    def table(self, text: str | None) -> PrefixTable:
        return PrefixTable(self, text or "")


class _Totals(dict):
    """Tokens of each chunk; a chunk is named without its first mark."""

    def __init__(self, counter: PrefixCounter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        found = self.counter.count(MARK + chunk)
        if len(chunk) < SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = found
        return found


class PrefixTable:
    """Token counts at every prefix of one text, chunk by chunk."""

    def __init__(self, counter: PrefixCounter, text: str) -> None:
        text = text.replace(MARK, " ")
        if not text:
            self.chunks = []
        elif "  " in text or text[0] == " " or text[-1] == " ":
            self.chunks = [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        else:
            self.chunks = text.split(" ")
        self.counter, self.length = counter, len(text)
        self.ends = list(accumulate(map(counter.totals.__getitem__, self.chunks), initial=0))
        self.total = self.ends[-1]

    def _starts(self) -> list[int]:
        """Characters of the text before each chunk's symbols; the first chunk's mark is not in the text."""
        return list(accumulate((len(c) + 1 for c in self.chunks), initial=-1))

    def at(self, k: int) -> int:
        """Tokens of the first k characters, as the encoder would count them alone."""
        if k <= 0 or not self.length:
            return 0
        k, starts = min(k, self.length), self._starts()
        j = bisect_right(starts, k - 1) - 1
        return self.ends[j] + self.counter.count((MARK + self.chunks[j])[: k - starts[j]])

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most so many tokens."""
        if self.total <= budget:
            return self.length
        starts, j = self._starts(), bisect_right(self.ends, budget) - 1
        inside = max(i for i, n in enumerate(self.counter.counts(MARK + self.chunks[j])) if self.ends[j] + n <= budget)
        return max(0, starts[j] + inside)


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_chars) for each row.

    cut_chars: characters of the longest prefix of at most `limit` tokens. A null or empty text has 0 of all.
    Repeated rows each have their row; a null id stays null; an empty table gives an empty one.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model)
        for batch in batches:
            out: list[tuple[int, int, bool, int]] = []
            for text in batch.column(1).to_pylist():
                made = of.table(text)
                out.append((len(text.encode()) if text else 0, made.total, made.total > limit, made.longest_within(limit)))
            a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.bool_()), pa.array(d, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    return documents(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_tables(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts array<int>): counts[k] is the exact token count of the first k characters."""

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model)
        for batch in batches:
            for n, text in enumerate(batch.column(1).to_pylist()):  # a row a batch: a long text has a long table
                made = of.table(text)
                counts = [0]
                for j, chunk in enumerate(made.chunks):
                    counts += [made.ends[j] + c for c in of.counts(MARK + chunk)[2 if j == 0 else 1 :]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([counts], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return documents(docs, id_col, text_col).mapInArrow(tables, "doc_id long, counts array<int>")
