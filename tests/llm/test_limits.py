"""What operators hold and make: memory by the word, rows by the group."""

import tracemalloc

import numpy as np
import pyarrow as pa

from chorale.llm import line_dedup, lm_scoring


def test_questions_hold_one_order_at_a_time():
    rng, n = np.random.default_rng(0), 200_000
    words = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    codes = np.minimum(rng.zipf(1.3, n), len(words)).astype(np.uint32) - np.uint32(1)
    cells = [[0], [list(range(n // 200))], [[200] * (n // 200)], [lm_scoring.packed(words)], [lm_scoring.packed(codes)]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "doc_ids", "lengths", "words", "codes"])
    tracemalloc.start()
    for _ in lm_scoring._questions(3, 20)([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / n < 80, peak / n  # 112 bytes a word with the arrays of all orders


def test_lines_that_share_nearly_all_make_no_pairs(spark, monkeypatch):
    """Lines of the same letters, two words of each turned round at its own place: alike under common segments, and four edits apart or more."""
    words = [f"{a}{b}{c}" for a in "stn" for b in "aeo" for c in "lrd"] * 4
    turned = lambda k: " ".join(w[::-1] if i in (k, k + 3) else w for i, w in enumerate(words))
    d = spark.createDataFrame([(k, turned(k)) for k in range(60)] + [(99, turned(59)[:-1])], "doc_id long, text string")
    made, stored = [], line_dedup.stored

    def seen(df, label):
        out = stored(df, label)
        if label in ("line-pairs", "near-lines"):
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", seen)
    monkeypatch.setattr(line_dedup, "GLANCE", 1)
    got = line_dedup.removed_lines(d).collect()
    assert [r["doc_id"] for r in got] == [99]
    assert max(made) < 3 * 61, made
