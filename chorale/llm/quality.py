"""Quality rules as a short-circuit cascade.

Each rule's cost (CPU time of all that it needs) and selectivity (share of documents that it rejects) are
estimated on a sample. The rules then run in order of rejection per cost, and a document's first failure
ends its run: what only later rules need is never made. The order decides what is computed, never which documents stay.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import documents, rows, shingle_hashes, word_hashes

#: One document in so many is sampled, by a hash of its id.
SAMPLE = 32
_SPACES, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_LETTER, _BULLET, _ELLIPSIS = (re.compile(p) for p in (rb"[A-Za-z\x80-\xff]", rb"[ \t\r\x0b\x0c]*(?:[-*]|\xe2\x80\xa2)", rb"(?:\.\.\.|\xe2\x80\xa6)[ \t\r\x0b\x0c]*\Z"))


class Text:
    """Measures of one text, each made when first asked for."""

    def __init__(self, text: bytes | None) -> None:
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _SPACES).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letterless(self) -> int:
        """Words without a letter; what is beyond ASCII counts as one."""
        return sum(not _LETTER.search(w) for w in self.words)

    @cached_property
    def n_bullets(self) -> int:
        return sum(bool(_BULLET.match(x)) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(bool(_ELLIPSIS.search(x)) for x in self.lines)

    @cached_property
    def n_top_char(self) -> int:
        """How often the commonest character of the words stands."""
        return max(Counter(self.text.translate(None, _SPACES).decode("utf-8", "replace")).values(), default=0)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 5-word windows that the text has at least twice."""
        n = self.n_words
        if n < 6:
            return 0
        _, which, counts = np.unique(shingle_hashes(word_hashes(self.words), 5), return_inverse=True, return_counts=True)
        cover = np.zeros(n + 1, np.int64)
        again = np.flatnonzero(counts[which] > 1)
        cover[again] += 1
        cover[again + 5] -= 1
        return int((np.cumsum(cover) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Text], bool]


BASE = [
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
]
#: The base rules and usual ones: symbols for words, repeated lines, words of odd length, words without letters, lists and cut-off lines, one character over and over.
RULES = [
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: t.n_dup_lines > 2 and 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("letterless", lambda t: 100 * t.n_letterless > 40 * t.n_words),
    Rule("bullets", lambda t: 100 * t.n_bullets > 90 * len(t.lines)),
    Rule("ellipses", lambda t: 100 * t.n_ellipses > 30 * len(t.lines)),
    Rule("one_character", lambda t: 100 * t.n_top_char > 30 * t.word_chars),
]


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The rules in order of rejection per cost on one document in `sample`; rules that reject nothing come last, cheapest first."""
    rules = RULES if rules is None else rules

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, failed, n = [0.0] * len(rules), [0] * len(rules), 0
        for _, text in rows(batches):
            n += 1
            for i, rule in enumerate(rules):
                began = time.process_time()
                failed[i] += bool(rule.fails(Text(text)))
                seconds[i] += time.process_time() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(failed, pa.int64()), pa.array([n] * len(rules), pa.int64())], names=["rule", "seconds", "failed", "n"])

    own = documents(docs, id_col, text_col)
    sampled = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    found = sampled.mapInArrow(measure, "rule int, seconds double, failed long, n long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("failed").alias("f")).collect()
    score = {r["rule"]: (-r["f"] / max(r["s"], 1e-9), r["s"]) for r in found}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (*score.get(i, (0, 0)), i))]


def judged(docs: DataFrame, rules: list[Rule] | None = None, measures: bool = True, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,] kept, rejected_by).

    kept: no rule fails. rejected_by: the first rule that failed, in the order found for these documents.
    A null or empty text has no words, so few_words rejects it. Repeated rows each have their row; an empty
    table gives an empty one. Without measures nothing is computed after a document's first failure.
    """
    order = cascade(docs, rules, sample, id_col, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if measures else []

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(names) + bool(names) + 2)]
            for _, text in rows([batch]):
                t = Text(text)
                by = next((r.name for r in order if r.fails(t)), None)
                values = [getattr(t, n) for n in names] + [any(r.fails(t) for r in BASE)] * bool(names) + [by is None, by]
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            kinds = [pa.int64()] * len(names) + [pa.bool_()] * bool(names) + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", *names, *["base_failed"] * bool(names), "kept", "rejected_by"])

    kinds = "doc_id long, " + "".join(f"{n} long, " for n in names) + "base_failed boolean, " * bool(names) + "kept boolean, rejected_by string"
    return documents(docs, id_col, text_col).mapInArrow(judge, kinds)
