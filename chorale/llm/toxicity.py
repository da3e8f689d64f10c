"""Toxicity by compression distance.

Two zstandard dictionaries, one trained on ordinary texts and one on the parts of toxic texts that ordinary texts don't
share: words, and pairs of words that don't lean by themselves, whose share of the toxic texts is a multiple of their
share of the ordinary ones. Windows of WINDOW words, each STEP words after the one before, cover the whole text; a
window's distance is the bytes that the toxic dictionary saves beyond the ordinary one. Single words are windows too,
before a short context. A text's distances give its features, and a logistic calibration on texts that the
dictionaries weren't trained on gives their thresholds and the score; both classes weigh the same in it, so 0.5 is where
a text is as likely under either.

Words are compressed in a form of their own: each byte is a hash of the word up to it. Two words then have a run of bytes
in common if they begin alike (a stem and its endings), and chance likeness further in is none.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE of each class, by a hash of the id, of SAMPLE_BYTES
together at most); every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import documents, mixed, plain_words, rows
from chorale.llm.near_duplicates import shingle_set

#: Labelled rows of each class that are fitted on at most, the bytes of their texts together and of one at most, and the folds of the calibration.
SAMPLE, SAMPLE_BYTES, SAMPLE_TEXT, FOLDS = {1: 1500, 0: 6000}, {1: 8_000_000, 0: 16_000_000}, 100_000, 3
#: Bytes of the dictionaries, and of the ordinary one's end that single words are compared with.
ORDINARY, TOXIC, SHORT = 8192, 4096, 2048
#: Per mille of the toxic texts in which a word recurs (3 texts at least, 2 of less than 100), and how many times its share of the ordinary texts that is.
RECURS, LEANS = 4, 20
#: Words of a window and from one to the next; distances that are counted; bytes of text compressed at a time.
WINDOW, STEP, FAR, CHUNK = 6, 3, (3, 4, 5, 6, 7, 8), 1 << 20
#: Copies are told by one shingle hash in so many; texts that the ordinary dictionary itself is trained on.
SHINGLES, TRAINED = 16, 2000
#: Words whose distance a worker keeps, if they have no more than so many bytes.
KEPT, KEPT_BYTES = 100_000, 64


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    weights: np.ndarray | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


#: A factor (odd) and its inverse modulo 2**64, and how many words' forms are made at once.
FACTOR, INVERSE, AT_ONCE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), 4096


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR and INVERSE to the powers below n."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, f)]), dtype=np.uint64) for f in (FACTOR, INVERSE))


def _form(words: list[bytes]) -> bytes:
    """The words as they are compressed, with a space before, between and after them.

    A byte's hash is that of a sum over the word up to it, each byte times a power that falls with its place in the
    word: a running sum over all words, less the sum before the word, moved to the word's start.
    """
    out = []
    for k in range(0, len(words), AT_ONCE):
        text = np.frombuffer(b" ".join([b"", *words[k : k + AT_ONCE]]), np.uint8)
        up, down = _powers(1 << max(16, len(text).bit_length()))
        sums = np.cumsum(text * down[: len(text)], dtype=np.uint64)
        space = text == 32
        start = np.maximum.accumulate(np.where(space, np.arange(len(text)), 0))
        form = (mixed((sums - sums[start]) * up[start]) >> np.uint64(56)).astype(np.uint8)
        form[space] = 32
        out.append(form.tobytes())
    return b"".join(out) + b" "


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        if model.ordinary:
            short = model.ordinary[-SHORT:]
            self.context = short[-64:]
            self.lengths = [_compressor(short + self.context), _compressor(short + model.toxic + self.context)]
            self.windowed = [_compressor(model.ordinary), _compressor(model.ordinary + model.toxic)]

    def _alone(self, words: list[bytes], form: bytes) -> np.ndarray:
        """The distance of each word, of their form."""
        out, at = np.empty(len(words), np.int64), 1
        for i, word in enumerate(words):
            found = self.known.get(word)
            if found is None:
                window = b" " + form[at : at + len(word)] + b" " + self.context
                ordinary, toxic = (len(c.compress(window)) for c in self.lengths)
                found = ordinary - toxic
                if len(word) <= KEPT_BYTES:
                    if len(self.known) >= KEPT:
                        self.known.clear()
                    self.known[word] = found
            out[i] = found
            at += len(word) + 1
        return out

    def _windowed(self, texts: list[list[bytes]], forms: list[bytes]) -> list[np.ndarray]:
        """The distance of each window of each text; a text without words has none, one of up to WINDOW words has one."""
        import zstandard as z

        at, segments, counts = 0, [], []
        for words, form in zip(texts, forms, strict=True):
            found = _windows(words)
            found[:, 0] += at
            at += len(form)
            segments.append(found), counts.append(len(found))
        if not sum(counts):
            return [np.zeros(0, np.int64) for _ in texts]
        data = z.BufferWithSegments(b"".join(forms), np.concatenate(segments).astype(np.uint64).tobytes())
        ordinary, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(data)), np.int64) for c in self.windowed)
        return np.split(ordinary - toxic, np.cumsum(counts)[:-1])

    def features(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """One row for each text, in order."""
        some, size = [], 0
        for text in texts:
            some.append(plain_words(text))
            size += len(text or b"")
            if size >= CHUNK:
                yield from self._features(some)
                some, size = [], 0
        yield from self._features(some)

    def _features(self, texts: list[list[bytes]]) -> Iterator[np.ndarray]:
        forms = [_form(t) for t in texts]
        for words, form, windows in zip(texts, forms, self._windowed(texts, forms), strict=True) if texts else ():
            yield np.concatenate([_counted(windows), _counted(self._alone(words, form))])

    def scores(self, texts: list[bytes | None]) -> list[float]:
        if self.model.weights is None:
            return [0.0] * len(texts)
        rows = (np.append((x - self.model.mean) / self.model.scale, 1.0) for x in self.features(texts))
        return [float(1 / (1 + np.exp(-np.clip(x @ self.model.weights, -30, 30)))) for x in rows]


def _counted(distances: np.ndarray) -> np.ndarray:
    """Shares and counts of the distances from each of FAR on, and the greatest."""
    counts = np.array([(distances >= t).sum() for t in FAR], float)
    return np.concatenate([100 * counts / (len(distances) + 10), np.log1p(counts), [distances.max(initial=0)]])


def _windows(words: list[bytes]) -> np.ndarray:
    """(start, bytes) of each window in the words' forms (of one byte for each of the word's) with a space before, between and after them; the last one ends with the text."""
    n = len(words)
    if not n:
        return np.zeros((0, 2), np.int64)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)])
    first = np.arange(0, max(n - WINDOW, 0) + STEP, STEP) if n > WINDOW else np.zeros(1, np.int64)
    first = np.unique(np.minimum(first, max(n - WINDOW, 0)))
    return np.column_stack([starts[first], starts[np.minimum(first + WINDOW, n)] + 1 - starts[first]])


def _compressor(content: bytes):
    import zstandard as z

    parameters = z.ZstdCompressionParameters(
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, strategy=z.STRATEGY_GREEDY,
        min_match=4, window_log=19, hash_log=17, chain_log=17, search_log=4, target_length=64,
    )
    known = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=parameters)
    return z.ZstdCompressor(dict_data=known, compression_params=parameters)


def _unlike(texts: list[bytes]) -> list[bytes]:
    """Texts of which at most three tenths of the shingles stand in earlier ones: a copy tells nothing about recurrence.

    One shingle hash in SHINGLES stands for all; a text without any such is kept.
    """
    seen: set[int] = set()
    out = []
    for t in texts:
        h = shingle_set(t)
        own = h[h % np.uint64(SHINGLES) == 0].tolist()
        new = [x for x in own if x not in seen]
        if 10 * len(new) >= 7 * len(own):
            out.append(t)
        seen.update(new)
    return out


def _leaning(toxic: list[bytes], ordinary: list[bytes]) -> tuple[set[bytes], set[tuple[bytes, bytes]]]:
    """Words, and pairs of words that aren't among them, that recur in toxic texts and in LEANS times their share of the ordinary ones.

    Texts are split when they are counted: their words are never held together.
    """
    least = max(2 if len(toxic) < 100 else 3, len(toxic) * RECURS // 1000)

    def leaning(terms: Callable[[list[bytes]], set]) -> tuple[set, set]:
        texts: Counter = Counter()
        for t in toxic:
            texts.update(terms(plain_words(t)))
        texts = Counter({w: n for w, n in texts.items() if n >= least})
        common: Counter = Counter()
        for t in ordinary:
            common.update(w for w in terms(plain_words(t)) if w in texts)
        return set(texts), {w for w, n in texts.items() if n * len(ordinary) >= LEANS * len(toxic) * (common[w] + 0.5)}

    often, words = leaning(set)
    joinable = often - words
    pairs = lambda w: {(a, b) for a, b in zip(w, w[1:], strict=False) if a in joinable and b in joinable}
    return words, leaning(pairs)[1]


def _parts(text: list[bytes], words: set[bytes], pairs: set[tuple[bytes, bytes]]) -> list[bytes]:
    """The words of a text that lean or stand in a pair that does, in order."""
    told = [w in words for w in text]
    for i, pair in enumerate(zip(text, text[1:], strict=False)):
        if pair in pairs:
            told[i] = told[i + 1] = True
    return [w for w, t in zip(text, told, strict=True) if t]


def _trained(samples: list[bytes], size: int, segment: int, grain: int) -> bytes:
    """The content of a dictionary trained on the samples; samples too few to choose from are the content themselves."""
    import zstandard as z

    whole = b"".join(samples)
    if len(whole) <= 4 * size:
        return whole[-size:]
    return z.train_dictionary(2 * size, samples, k=segment, d=grain).as_bytes()[-size:]


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    words, pairs = _leaning(toxic, ordinary)
    parts = [p for p in (_parts(plain_words(t), words, pairs) for t in toxic) if p]
    plain = [_form(w) for w in map(plain_words, ordinary[:TRAINED]) if w]
    return Model(_trained(plain, ORDINARY, 200, 8) or b" ", _trained([_form(p) for p in parts], TOXIC, 16, 6) or b" ")


def train(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """A model from sample texts of both classes; without a text of either it scores everything 0.

    Each third is measured by dictionaries of the other two, for the calibration; the model's own are of all.
    """
    if not toxic or not ordinary:
        return Model()
    split = [_unlike(own) for own in (toxic, ordinary)]
    x, y = [], []
    for k in range(FOLDS):
        scorer = _dictionaries(*([t for i, t in enumerate(own) if i % FOLDS != k or len(own) == 1] for own in split)).scorer()
        for label, own in ((1.0, split[0]), (0.0, split[1])):
            x += scorer.features(own[k::FOLDS])
            y += [label] * len(own[k::FOLDS])
    del scorer
    x, y, model = np.array(x), np.array(y), _dictionaries(*split)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic(np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))]), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method for the regularised likelihood, both classes of one weight in all; the last column is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    share = y.mean()
    each = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    shrink = ridge * each.sum() * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (each * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink), x.T @ (each * (p - y)) + shrink * w)
    return w


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trained on labelled rows that aren't held out. Null labels and ids are left out; of several labels the largest counts."""
    marked = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y"))
    marked = marked.where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in SAMPLE.items()]
    ids = chosen[0].unionByName(chosen[1])  # 7,500 at most
    own = documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT)
    one = own.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min("text").alias("text"))
    sizes = one.select("id", "y", F.octet_length("text").alias("n"), F.xxhash64("id").alias("order")).collect()
    within, most = [], dict(SAMPLE_BYTES)
    for r in sorted(sizes, key=lambda r: (r["order"], r["id"])):
        most[r["y"]] -= r["n"]
        within += [r["id"]] * (most[r["y"]] >= 0)
    found = one.where(F.col("id").isin(within)).collect() if within else []
    found.sort(key=lambda r: r["id"])
    texts = {y: [r["text"].encode() for r in found if r["y"] == y] for y in (0, 1)}
    del found
    return train(texts[1], texts[0])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row. Empty and null texts have a score like any other; a null id isn't held out."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores([t for _, t in rows([batch])]), pa.float64())], names=["doc_id", "score"])

    out = documents(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model doesn't mark as toxic."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([p < 0.5 for p in scorer.scores(texts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
