"""k-means of many playlists at once, over blocks of their points.

Points are dealt to blocks of some thousand rows, each a matrix. The runs of a playlist (every k and restart) are dealt to tasks,
more of them the more points it has. A task takes the playlist's blocks once and brings its runs to their end with nothing sent
between the rounds: one matrix product measures all of its runs, and only points that changed their centre move the
sums. A playlist of up to WHOLE_BLOCKS blocks is one block; of a larger one the best centres then meet its blocks for the labels.
"""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.session import stored

#: Points of a block, about.
BLOCK_ROWS = 4096
#: Blocks' worth of points up to which a playlist stays whole: with 64 dimensions a matrix of 64 MB.
WHOLE_BLOCKS = 32
#: Points of a playlist that a restart picks its first centres from: so many, or so many for each centre.
START_ROWS, START_EACH = 64, 4
#: A run has ended when no centre moves by more than this part of its size.
STILL = 1e-9
#: Points, and centres of some runs, that a task measures at once, so that distances stay in the processor's cache.
TILE_ROWS, TILE_CENTRES = 1024, 128
#: Numbers of a large playlist that a task holds in memory (512 MB); further blocks stand in a file of its own.
HELD_NUMBERS = 1 << 26
#: Playlists of one block up to which each has partitions of its own.
FEW_LISTS = 1000
_RUN = "playlist_id string, k int, seed int"


def drawn(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The order in which a restart draws points with these 64-bit hashes."""
    h = hashes.astype(np.uint64) ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def first_drawn(points: np.ndarray, hashes: np.ndarray, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n points, and their hashes, that the restart draws first."""
    at = np.lexsort((hashes, drawn(hashes, seed)))[:n]
    return points[at], hashes[at]


def prepared(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared lengths, points times two): what squared() needs of the points in each round."""
    return (points**2).sum(1), 2 * points


def squared(points: np.ndarray, centres: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Squared distances of all points from all centres; known: prepared(points)."""
    lengths, twice = known or prepared(points)
    return np.maximum(lengths[:, None] - twice @ centres.T + (centres**2).sum(1)[None, :], 0)


def copies(centres: np.ndarray) -> np.ndarray:
    """The centres that equal an earlier one: none is nearest, however the products round."""
    if len(np.unique(centres[:, 0])) == len(centres):
        return np.zeros(0, int)
    return np.setdiff1d(np.arange(len(centres)), np.unique(centres, axis=0, return_index=True)[1])


def labelled(points: np.ndarray, centres: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, squared distances from all centres); ties go to the lower number."""
    apart = squared(points, centres, known)
    apart[:, copies(centres)] = np.inf
    return apart.argmin(1), apart


def far_apart(sample: np.ndarray, k: int) -> np.ndarray:
    """The first point of the sample, and then k - 1 times the one farthest from those picked."""
    picked = [0]
    near = squared(sample, sample[:1])[:, 0]
    for _ in range(k - 1):
        picked.append(int(near.argmax()))
        near = np.minimum(near, squared(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def measured(points: np.ndarray, centres: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(labels, sums, counts, cost) of the points under these centres; ties go to the lower number."""
    labels, apart = labelled(points, centres, known)
    counts = np.bincount(labels, minlength=len(centres))
    member = np.zeros((len(centres), len(points)))
    member[labels, np.arange(len(points))] = 1
    return labels, member @ points, counts, float(apart[np.arange(len(points)), labels].sum())


def moved(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, bool]:
    """The next centres, and whether any moved; a centre without points stays."""
    new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return new, bool((np.abs(new - centres) > STILL * (1 + np.abs(centres))).any())


class _Held:
    """Blocks of a playlist's points, with a column of ones, and once more in single precision; walked in the blocks' order."""

    def __init__(self):
        self.blocks, self.numbers, self.points, self.file, self.longest = [], 0, 0, None, 0.0

    def add(self, points: np.ndarray, part: int) -> None:
        block = np.ones((len(points), points.shape[1] + 1))
        block[:, :-1] = points
        self.numbers, self.points = self.numbers + block.size, self.points + len(points)
        self.longest = max(self.longest, float(np.sqrt((points**2).sum(1).max(initial=0))))
        if self.numbers > HELD_NUMBERS:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            self.blocks.append((part, self.file.seek(0, 2), block.shape))
            self.file.write(block.data)
        else:
            self.blocks.append((part, (block, block.astype(np.float32)), block.shape))
        self.blocks.sort(key=lambda x: x[0])

    def tiles(self, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first, points, the same in single precision) of so many rows at a time."""
        start = 0
        for _, held, shape in self.blocks:
            if isinstance(held, int):
                self.file.seek(held)
                block = np.frombuffer(self.file.read(8 * shape[0] * shape[1])).reshape(shape)
                held = (block, block.astype(np.float32))
            for i in range(0, shape[0], rows):
                yield start + i, held[0][i : i + rows], held[1][i : i + rows]
            start += shape[0]


def lloyd(held: _Held, starts: list[np.ndarray], rounds: int) -> tuple[np.ndarray, list[tuple[np.ndarray, float, bool]]]:
    """Lloyd's rounds of runs side by side: (their rows of labels, (centres, cost, whether it still moved) of each).

    Sums are carried on by the points that changed their centre. Before a run ends all its points are measured anew, with ties
    to the lower number; it goes on if its centres move by that.
    """
    sizes = np.array([len(c) for c in starts])
    labels = np.zeros((len(starts), held.points), np.uint8 if sizes.max() <= 256 else np.int32)
    centres, sums, out, live = list(starts), [np.zeros((k, starts[0].shape[1] + 1)) for k in sizes], [None] * len(starts), list(range(len(starts)))
    for r in range(rounds):
        new, ended = {}, []
        for some in _side_by_side(live, sizes):
            for i, change in zip(some, _changes(held, [centres[i] for i in some], labels, some, first=r == 0), strict=True):
                sums[i] += change
        for i in live:
            new[i], going = moved(centres[i], sums[i][:, :-1], sums[i][:, -1])
            if not going or r == rounds - 1:
                ended.append(i)
        for i, (full, cost) in _measured_all(held, centres, labels, ended).items():
            sums[i] = full
            new[i], going = moved(centres[i], full[:, :-1], full[:, -1])
            if not going or r == rounds - 1:
                out[i] = (centres[i], cost, going)
        live = [i for i in live if out[i] is None]
        if not live:
            break
        centres = [new.get(i, c) for i, c in enumerate(centres)]
    return labels, out


def _side_by_side(live: list[int], sizes: np.ndarray) -> Iterator[list[int]]:
    """The runs in groups of some TILE_CENTRES centres."""
    group = []
    for i in live:
        if group and sizes[group].sum() + sizes[i] > TILE_CENTRES:
            yield group
            group = []
        group.append(i)
    yield group


def _changes(held: _Held, centres: list[np.ndarray], labels: np.ndarray, live: list[int], first: bool) -> list[np.ndarray]:
    """What each run's sums and counts change by under these centres; labels take the nearer centres.

    All distances are made in single precision. Where two are less apart than rounding can hide, double precision decides.
    """
    every, sizes = np.concatenate(centres), np.array([len(c) for c in centres])
    halves = np.hstack([-every, (every**2).sum(1, keepdims=True) / 2])  # times a point: half of what a squared distance has beyond the point's own square
    ends = np.cumsum(sizes)
    begins, owner = ends - sizes, np.repeat(np.arange(len(sizes)), sizes)
    change, never = np.zeros(halves.shape), np.concatenate([a + copies(c) for a, c in zip(begins, centres, strict=True)])
    longest = np.array([np.sqrt((c**2).sum(1).max()) for c in centres])
    single = 1e-12 < held.longest < 1e12
    hidden = (every.shape[1] + 8) * np.finfo(np.float32 if single else float).eps * longest * (held.longest + longest)
    few, hidden = (halves.astype(np.float32), hidden.astype(np.float32)) if single else (halves, hidden)
    rows = np.minimum(begins + np.arange(sizes.max())[:, None], len(every) - 1)
    beyond = (np.arange(sizes.max())[:, None] >= sizes) | np.isin(rows, never)
    for at, x, x_single in held.tiles(TILE_ROWS):
        n = len(x)
        if first:
            near = halves @ x.T
            near[never] = np.inf
            own = np.stack([near[a:b].argmin(0) for a, b in zip(begins, ends, strict=True)])
            labels[live, at : at + n] = own
            member = np.zeros(near.shape)
            member[own + begins[:, None], np.arange(n)] = 1
            change += member @ x
            continue
        near = few @ (x_single if single else x).T
        near[never] = np.inf
        was = labels[live, at : at + n] + begins[:, None]
        place = was * n + np.arange(n)
        limit = near.take(place) + hidden[:, None]
        near.put(place, limit)
        least = np.empty_like(limit)
        for a, b, out in zip(begins, ends, least, strict=True):
            np.minimum.reduce(near[a:b], axis=0, out=out)
        run, i = np.divmod(np.flatnonzero(least < limit), n)
        if len(run):
            left, each = was[run, i] - begins[run], np.arange(len(run))
            apart = near.take(rows[:, run] * n + i)
            apart[left, each] -= hidden[run]
            apart[beyond[:, run]] = np.inf
            to = apart.argmin(0)
            nearest = apart[to, each]
            apart[to, each] = np.inf
            unsure = np.flatnonzero(~(apart.min(0) - nearest > hidden[run]))
            exact = (halves[rows[:, run[unsure]]] * x[i[unsure]]).sum(2)
            exact[beyond[:, run[unsure]]] = np.inf
            to[unsure] = exact.argmin(0)
            other = np.flatnonzero(to != left)
            run, i, to, left, each = run[other], i[other], to[other], left[other], each[: len(other)]
            labels[np.array(live)[run], at + i] = to
            member = np.zeros((len(every), len(other)))
            member[begins[run] + to, each], member[begins[run] + left, each] = 1, -1
            change += member @ x[i]
    return np.split(change, ends[:-1])


def _measured_all(held: _Held, centres: list[np.ndarray], labels: np.ndarray, runs: list[int]) -> dict[int, tuple[np.ndarray, float]]:
    """Sums with counts, and the cost, of some runs under their centres, of all points; labels are set."""
    out = {i: (np.zeros((len(centres[i]), centres[i].shape[1] + 1)), 0.0) for i in runs}
    for at, x, _ in held.tiles(BLOCK_ROWS) if runs else ():
        known = prepared(x[:, :-1])
        for i in runs:
            own, sums, counts, cost = measured(x[:, :-1], centres[i], known)
            labels[i, at : at + len(x)] = own
            out[i] = (out[i][0] + np.hstack([sums, counts[:, None]]), out[i][1] + cost)
    return out


def blocks(points: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(playlist_id, part, parts, hashes, keys, data) of points(playlist_id, track_key, embedding): keys in the order of the data's rows."""
    n = points.groupBy("playlist_id").agg(F.when(F.count("*") <= WHOLE_BLOCKS * rows, F.lit(1).cast("long")).otherwise(F.ceil(F.count("*") / rows)).alias("parts"))
    dealt = points.join(n, "playlist_id").withColumn("part", F.pmod(F.xxhash64(F.col("track_key").cast("string")), F.col("parts")))
    one = F.struct(F.xxhash64(F.col("track_key").cast("string"), F.lit("start")).alias("h"), "track_key", "embedding")
    held = dealt.groupBy("playlist_id", "part", "parts").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return held.select("playlist_id", "part", "parts", F.col("x.h").alias("hashes"), F.col("x.track_key").alias("keys"), F.flatten("x.embedding").alias("data"))


def _matrix(values: pa.ListScalar, rows: int) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def clustered(points: DataFrame, ks: DataFrame, seeds: int = 20, rounds: int = 300, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(playlist_id, k, track_key, cluster, seed, inertia): labels of the restart with the least inertia for each (playlist, k).

    points(playlist_id, track_key, embedding); ks(playlist_id, k), of which those that exceed a playlist's points are tried with as many
    centres as it has. Restart s of all k begins at the first k of one row of points that lie far apart, of the
    START_ROWS, or START_EACH for each centre of the greatest k, that it draws first. Runs end when no centre moves; if some
    still do after so many rounds, a warning says how many. Clusters without points don't occur among the labels.
    """
    spark = points.sparkSession
    asked = ks.groupBy("playlist_id").agg(F.sort_array(F.collect_set(F.col("k").cast("int"))).alias("ks"))
    kind = points.schema["playlist_id"].dataType
    held = blocks(points.select(F.col("playlist_id").cast("string").alias("playlist_id"), "track_key", F.col("embedding").cast("array<double>").alias("embedding")), block_rows)
    held = stored(held.join(asked.select(F.col("playlist_id").cast("string").alias("playlist_id"), "ks"), "playlist_id"), "blocks")
    small, large = held.where("parts = 1"), held.where("parts > 1")
    lists, many = held.agg(F.count_if(F.col("parts") == 1), F.count_if(F.col("parts") > 1)).first()
    found = _large(large, seeds, rounds) if many else None
    if lists or not many:
        few = stored(_dealt(small, seeds).mapInArrow(lambda batches: _small(batches, seeds, rounds), f"{_RUN}, part long, inertia double, moving int, labels array<int>"), "runs")
        found = few.unionByName(found) if many else few
    still = found.agg(F.sum("moving")).first()[0]
    if still:
        warnings.warn(f"k-means: {still} restarts still moved after {rounds} rounds", stacklevel=2)
    best = found.groupBy("playlist_id", "k").agg(F.min(F.struct("inertia", "seed")).alias("x")).select("playlist_id", "k", F.col("x.seed").alias("seed"))
    chosen = found.join(best, ["playlist_id", "k", "seed"]).join(held.select("playlist_id", "part", "keys"), ["playlist_id", "part"])
    each = chosen.select(F.col("playlist_id").cast(kind).alias("playlist_id"), "k", "seed", "inertia", F.explode(F.arrays_zip("keys", "labels")).alias("x"))
    return each.select("playlist_id", "k", F.col("x.keys").alias("track_key"), F.col("x.labels").alias("cluster"), "seed", "inertia")


def _dealt(held: DataFrame, seeds: int) -> DataFrame:
    """Each block for every chunk of its playlist's runs: the more chunks the greater its share of all points, two a core in all.

    A chunk has a partition of its own, the largest first, unless there are thousands of playlists of one block.
    """
    spark = held.sparkSession
    sizes = held.groupBy("playlist_id").agg(F.sum(F.size("hashes")).alias("n"), F.first(F.size("ks")).alias("tried"), F.first("parts").alias("parts"))
    lists, total, parts = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(1))).first()
    share = F.ceil(2 * spark.sparkContext.defaultParallelism * F.col("n") / F.lit(max(1, total)))
    sizes = sizes.withColumn("chunks", F.least(F.col("tried") * seeds, share).cast("int"))
    if not lists or (lists > FEW_LISTS and parts == 1):
        each = held.join(sizes.select("playlist_id", "chunks"), "playlist_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return each.repartition("playlist_id", "chunk")
    told = sizes.orderBy(F.desc("n"), "playlist_id").collect()
    places = [(r["playlist_id"], c, r["chunks"]) for r in told for c in range(r["chunks"])]
    at = spark.createDataFrame([(*p, i) for i, p in enumerate(places)], "playlist_id string, chunk int, chunks int, place int")
    return held.join(F.broadcast(at), "playlist_id").repartitionById(len(places), F.col("place"))


def _runs(ks: list[int], seeds: int, chunk: int, chunks: int) -> list[tuple[int, int]]:
    """(k, seed) of the chunk's runs: each has about as many of every k."""
    return [(k, seed) for k in reversed(ks) for seed in range(seeds)][chunk::chunks]


def _draw(drawn_: dict[int, tuple | None], points: np.ndarray, hashes: np.ndarray, n: int) -> None:
    """Adds a block to what each restart draws first."""
    for seed, had in drawn_.items():
        some = first_drawn(points, hashes, seed, n)
        drawn_[seed] = some if had is None else first_drawn(*(np.concatenate(x) for x in zip(had, some, strict=True)), seed, n)


def _best(held: _Held, drawn_: dict[int, tuple], runs: list[tuple[int, int]], most: int, rounds: int) -> list[tuple]:
    """(k, seed, centres, inertia, restarts that still moved, labels) of the best run of each k, from what the restarts drew."""
    far = {seed: far_apart(points, min(most, len(points))) for seed, (points, _) in drawn_.items()}
    labels, ended = lloyd(held, [far[seed][:k] for k, seed in runs], rounds)
    out = {}
    for (k, seed), own, (centres, cost, going) in zip(runs, labels, ended, strict=True):
        moving = out[k][4] + going if k in out else int(going)
        out[k] = (k, seed, centres, cost, moving, own) if k not in out or (cost, seed) < (out[k][3], out[k][1]) else (*out[k][:4], moving, out[k][5])
    return list(out.values())


def _small(batches: Iterable[pa.RecordBatch], seeds: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """The chunk's runs of playlists of one block; of each k the best of them alone."""
    kinds = {"playlist_id": pa.string(), "k": pa.int32(), "seed": pa.int32(), "part": pa.int64(), "inertia": pa.float64(), "moving": pa.int32(), "labels": pa.list_(pa.int32())}
    for name, part, held, drawn_, runs, most in _blocks_met(batches, seeds):
        yield _batch([(name, k, seed, part, cost, moving, own.astype(np.int32)) for k, seed, _, cost, moving, own in _best(held, drawn_, runs, most, rounds)], kinds)


def _blocks_met(batches: Iterable[pa.RecordBatch], seeds: int, one: bool = False) -> Iterator[tuple]:
    """(playlist, part, block, what the chunk's restarts draw first, its runs, the greatest k) of each block; one: all of them are one playlist's."""
    told = None
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, ks = batch["hashes"][i].values.to_numpy().astype(np.int64).view(np.uint64), batch["ks"][i].as_py()
            if told is None or not one:
                runs = _runs(ks, seeds, batch["chunk"][i].as_py(), batch["chunks"][i].as_py())
                told = (batch["playlist_id"][i].as_py(), batch["part"][i].as_py(), _Held(), dict.fromkeys(seed for _, seed in runs), runs, ks[-1])
            points = _matrix(batch["data"][i], len(hashes))
            told[2].add(points, batch["part"][i].as_py())
            _draw(told[3], points, hashes, max(START_ROWS, START_EACH * ks[-1]))
            if not one:
                yield told
    if one and told:
        yield told


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _large(held: DataFrame, seeds: int, rounds: int) -> DataFrame:
    """The same for playlists of many blocks: tasks send the centres of their best runs, and those of the best of all meet the blocks for the labels."""
    runs = _dealt(held, seeds).mapInArrow(lambda batches: _whole(batches, seeds, rounds), f"{_RUN}, centres array<double>, inertia double, moving int")
    best = runs.groupBy("playlist_id", "k").agg(F.min_by(F.struct("seed", "centres", "inertia"), F.struct("inertia", "seed")).alias("x"), F.sum("moving").cast("int").alias("moving"))
    best = stored(best.select("playlist_id", "k", "x.*", "moving"), "best")
    told = best.select("playlist_id", "k", "seed", "inertia", "moving")
    labels = _with_centres(held, best.select("playlist_id", "k", "seed", "centres")).mapInArrow(_labels, f"{_RUN}, part long, labels array<int>")
    return labels.join(told, ["playlist_id", "k", "seed"]).withColumn("moving", F.when(F.col("part") == 0, F.col("moving")).otherwise(0))


def _whole(batches: Iterable[pa.RecordBatch], seeds: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """The runs of the one chunk of a large playlist whose blocks are this partition."""
    kinds = {"playlist_id": pa.string(), "k": pa.int32(), "seed": pa.int32(), "centres": pa.list_(pa.float64()), "inertia": pa.float64(), "moving": pa.int32()}
    for name, _, held, drawn_, runs, most in _blocks_met(batches, seeds, one=True):
        yield _batch([(name, k, seed, centres.ravel(), cost, moving) for k, seed, centres, cost, moving, _ in _best(held, drawn_, runs, most, rounds)], kinds)


def _with_centres(held: DataFrame, centres: DataFrame) -> DataFrame:
    runs = centres.groupBy("playlist_id").agg(F.collect_list(F.struct("k", "seed", "centres")).alias("runs"))
    return held.select("playlist_id", "part", "hashes", "data").join(runs, "playlist_id")


def _drawn_first(batches: Iterable[pa.RecordBatch], seeds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, ks = batch["hashes"][i].values.to_numpy().astype(np.int64), batch["ks"][i].as_py()
            points, n = _matrix(batch["data"][i], len(hashes)), max(START_ROWS, START_EACH * ks[-1])
            firsts = [first_drawn(points, hashes.view(np.uint64), s, n) for s in range(seeds)]
            columns = [pa.array([batch["playlist_id"][i].as_py()] * seeds), pa.array(range(seeds), pa.int32()), pa.array([ks] * seeds, pa.list_(pa.int32()))]
            columns += [pa.array([h.view(np.int64) for _, h in firsts], pa.list_(pa.int64())), pa.array([p.ravel() for p, _ in firsts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["playlist_id", "seed", "ks", "hashes", "data"])


def _start(df: pd.DataFrame) -> pd.DataFrame:
    """The centres that a restart begins at, from what each block drew first."""
    hashes = np.concatenate(df["hashes"].to_list()).astype(np.int64).view(np.uint64)
    ks, seed = list(df["ks"].iloc[0]), int(df["seed"].iloc[0])
    sample, _ = first_drawn(np.concatenate(df["data"].to_list()).reshape(len(hashes), -1), hashes, seed, max(START_ROWS, START_EACH * ks[-1]))
    far = far_apart(sample, min(ks[-1], len(sample)))
    return pd.DataFrame({"playlist_id": df["playlist_id"].iloc[0], "k": ks, "seed": seed, "centres": [far[:k].ravel() for k in ks]})


def _labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            points = _matrix(batch["data"][i], len(batch["hashes"][i]))
            runs = batch["runs"][i]
            labels = [labelled(points, r["centres"].values.to_numpy().reshape(-1, points.shape[1]))[0].astype(np.int32) for r in runs]
            columns = [pa.array([batch["playlist_id"][i].as_py()] * len(labels)), pa.array([r["k"].as_py() for r in runs], pa.int32()), pa.array([r["seed"].as_py() for r in runs], pa.int32())]
            columns += [pa.array([batch["part"][i].as_py()] * len(labels), pa.int64()), pa.array(labels, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["playlist_id", "k", "seed", "part", "labels"])


def mini_batch(points: DataFrame, k: int, batch: int = 2048, rounds: int = 100, seed: int = 42, key: str = "track_key") -> DataFrame:
    """(key, cluster, sq) of points(key, embedding), by k centres that mini-batches have moved; sq: the squared distance from the centre.

    About batch * rounds rows are drawn by hashes of their keys and dealt to the rounds in one pass over the points (a
    table with fewer rows gives each to several rounds); one task walks this bounded sample, 200,000 rows by default. A
    centre moves to each batch's points by one over the number of points that it has met so far. Then all points take
    their nearest centre, ties to the lower number; null keys are drawn like others, an empty table has no rows.
    """
    n = points.count()
    held = points.select(F.col(key).alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    copies = max(1, -(-batch * rounds // max(1, n)))
    share = min(1.0, batch * rounds / max(1, n * copies))
    drawn_ = held.select("embedding", F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    drawn_ = drawn_.withColumn("d", F.xxhash64("h", "copy")).where(F.pmod("d", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = drawn_.select(F.pmod(F.shiftrightunsigned("d", 20), F.lit(rounds)).cast("int").alias("round"), "d", "embedding")
    centres = sample.groupBy(F.lit(0).alias("one")).applyInPandas(lambda df: _moved_by_batches(df, k), "centres array<double>").first()
    if centres is None:
        return held.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("sq"))
    at = np.array(centres["centres"]).reshape(-1, len(held.select("embedding").first()[0]))

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = squared(_flat(b["embedding"], b.num_rows), at)
                labels = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([b[key], pa.array(labels.astype(np.int32)), pa.array(apart[np.arange(len(labels)), labels])], names=[key, "cluster", "sq"])

    kind = held.schema[key].dataType.simpleString()
    return held.mapInArrow(nearest, f"`{key}` {kind}, cluster int, sq double")


def _flat(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _moved_by_batches(df: pd.DataFrame, k: int) -> pd.DataFrame:
    df = df.sort_values(["round", "d"], kind="stable")
    points, ends = np.stack(df["embedding"].to_list()), np.flatnonzero(np.diff(df["round"].to_numpy())) + 1
    centres = far_apart(points[: max(START_ROWS, START_EACH * k)], min(k, len(points)))
    met = np.zeros(len(centres))
    for own in np.split(points, ends):
        _, sums, counts, _ = measured(own, centres)
        met += counts
        touched = counts > 0
        centres[touched] += (sums[touched] - counts[touched, None] * centres[touched]) / met[touched, None]
    return pd.DataFrame({"centres": [centres.ravel()]})
