"""Fill-in-middle: texts cut at two drawn ranks of their units and put together again with markers.

A unit is a run of ASCII letters or any other single code point. The units of a text stand in an indexable skip list:
each lane carries, for every node, how many units and how many code points lie before the next one, so a descent that
adds widths up reaches the cut at any rank in about the logarithm of the text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import documents, mixed, rows

#: Of the nodes of a lane, about one in 2**LANE_BITS stands in the next lane too.
LANE_BITS = 4
#: Code points that are turned into numbers at once, and bytes of texts that a batch of results holds, about.
PART, BATCH_BYTES = 1 << 20, 8 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_starts(text: str) -> np.ndarray:
    """The code point at which each unit begins, and the text's length."""
    out, before = [], False
    for at in range(0, len(text), PART):
        codes = np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = (codes | np.uint32(32)) - np.uint32(97) < 26
        joined = letter.copy()
        joined[0] &= before
        joined[1:] &= letter[:-1]
        out.append(np.flatnonzero(~joined) + at)
        before = bool(letter[-1])
    return np.concatenate([*out, [len(text)]]).astype(np.int64)


class SkipList:
    """Units by rank. Lane 0 holds every unit; a node's height comes from a hash of its rank, so equal texts have equal lists."""

    def __init__(self, starts: np.ndarray) -> None:
        self.units, self.points = len(starts) - 1, int(starts[-1])
        ranks, draws = np.arange(len(starts) - 1), mixed(np.arange(len(starts) - 1, dtype=np.uint64))
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit widths, code-point widths, node of the lane below
        down = ranks
        while len(ranks):
            edge = np.append(ranks, self.units)
            self.lanes.append((np.diff(edge), np.diff(starts[edge]), down))
            high = (draws >> np.uint64(LANE_BITS * (len(self.lanes) - 1))) & np.uint64((1 << LANE_BITS) - 1) == 0
            high[0] = True  # the head stands in all lanes
            if high.sum() == 1:
                break
            down, ranks, draws = np.flatnonzero(high), ranks[high], draws[high]

    def offset(self, rank: int) -> int:
        """Code points before the unit of that rank; of all units, the text's length."""
        units = points = node = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            wide, long, down = self.lanes[k]
            while node < len(wide) and units + wide[node] <= rank:
                units, points, node = units + wide[node], points + long[node], node + 1
            if node == len(wide):
                return self.points
            node = down[node] if k else node
        return int(points)


def cut(text: str, doc_id: int | None, seed: str = "1", percent: int = 90, spm_percent: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * k : 8 * k + 8], 16) for k in range(4))
    starts = unit_starts(text)
    n = len(starts) - 1
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    listed = SkipList(starts)
    first, second = (listed.offset(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: str = "1", percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each document.

    Draws follow from seed and doc_id alone, so rows that repeat an id are cut at ranks from the same hash, each by its own length; a null id
    draws as an empty one. Null and empty texts, texts with a marker, and all but `percent` of the others stay plain, with null
    prefix_chars and middle_chars; output is then the text, for null the empty one.
    """

    def transformed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for doc_id, text in rows(batches):
            row = cut((text or b"").decode("utf-8", "surrogateescape"), doc_id, seed, percent, spm_percent)
            held.append((doc_id, *row[:4], row[4].encode("utf-8", "surrogateescape")))
            size += len(held[-1][-1])
            if size >= BATCH_BYTES or len(held) >= 10_000:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return documents(docs, id_col, text_col).mapInArrow(transformed, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), kinds, strict=True)]
    columns[5] = pa.Array.from_buffers(pa.string(), len(held), columns[5].buffers())
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form; the markers don't occur in texts that were cut."""

    def between(start: str, end: str | None) -> Column:
        rest = F.substring(output, F.instr(output, start) + len(start), F.length(output))
        return F.substring_index(rest, end, 1) if end else rest

    psm, spm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE)), F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cuts: DataFrame) -> DataFrame:
    """fill_in_middle()'s rows with SHA-256 of the output and of the text rebuilt from it in place of the output."""
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
