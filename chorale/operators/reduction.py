"""Principal components of sparse long rows, without a dense vector for any record.

A randomised range finder: the centred matrix is multiplied with signs drawn from the features' hashes, and with its own
transpose a few times, as joins and sums over stored cells. Means are taken out algebraically: what a record of
zeros would add is added once. Records and features hold some forty numbers each; only square matrices of that size
come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.operators.features import block_weight
from chorale.session import stored

#: Directions beyond those asked for, and rounds of multiplying by the matrix and its transpose.
BEYOND, ROUNDS = 10, 3
#: Tasks that add up the matrices of all others.
ADDERS = 16


def principal_components(features: DataFrame, stats: DataFrame, n: int, requested: int = 32, weighted: bool = True) -> tuple[DataFrame, list[float]] | None:
    """(components(k, feature, weight, centre), variances) of n records; None if min(requested, n, columns) reduces nothing.

    features(key, feature, value), where a missing row is 0; stats(feature, mean, scale) over all n records. Values are taken
    as project() takes them: (value - mean) / scale, times the block's weight; centre is then 0. Components are of unit
    length, by falling variance, and the entry of greatest size is positive (of equals that of the first feature).
    """
    columns = stats.count()
    k = min(requested, n, columns)
    if not 0 < k < columns:
        return None
    key, width = next(c for c in features.columns if c not in ("feature", "value")), min(k + BEYOND, columns)
    factor = (block_weight(F.col("feature")) if weighted else F.lit(1.0)) / F.col("scale")
    means = stored(stats.select("feature", (F.col("mean") * factor).alias("m"), factor.alias("factor")), "means")
    cells = stored(features.select(F.col(key).cast("string").alias("row"), "feature", "value").join(means, "feature").select("row", "feature", (F.col("value") * F.col("factor")).alias("v")), "cells")
    empty = n - cells.select("row").distinct().count()
    side = means.select("feature", "m", F.array(*(_sign(i) for i in range(width))).alias("x"))
    for _ in range(ROUNDS):
        rows, base = _rows(cells, side, width)
        basis = _orthonormal(_gram(rows, width) + empty * np.outer(base, base))
        rows = stored(_mapped(rows, "row", basis), "rows")
        total = _total(rows, basis.shape[1]) + empty * base @ basis
        side = stored(_columns(cells, means, rows, total, basis.shape[1]), "columns")
        gram = _gram(side, basis.shape[1])
        width = basis.shape[1]
        if _ < ROUNDS - 1:
            turn = _orthonormal(gram)
            side, width = _mapped(side, "feature", turn, "m"), turn.shape[1]
    values, turn = np.linalg.eigh(gram)
    order = [i for i in np.argsort(-values)[:k] if values[i] > 1e-12 * values.max()]
    found = _mapped(side, "feature", turn[:, order] / np.sqrt(values[order]))
    each = found.select("feature", F.posexplode("x").alias("k", "weight"))
    top = each.groupBy("k").agg(F.max(F.struct(F.round(F.abs("weight"), 9), F.hash("feature"), "weight")).alias("t"))
    signed = each.join(F.broadcast(top), "k")  # a row for each component
    return signed.select("k", "feature", (F.col("weight") * F.signum("t.weight")).alias("weight"), F.lit(0.0).alias("centre")), [float(values[i] / n) for i in order]


def _sign(i: int) -> Column:
    return (1 - 2 * F.shiftright(F.xxhash64("feature", F.lit(i // 60)), i % 60).bitwiseAND(1)).cast("double")


def _sums(width: int, value: Column, x: str = "x") -> Column:
    return F.array(*(F.sum(value * F.get(x, F.lit(i))) for i in range(width)))


def _rows(cells: DataFrame, side: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(row, x) of the centred matrix times side(feature, m, x), for rows with a cell; and what a row of zeros has."""
    base = -np.array(side.agg(_sums(width, F.col("m")).alias("x")).first()["x"])
    made = cells.join(side.select("feature", "x"), "feature").groupBy("row").agg(_sums(width, F.col("v")).alias("x"))
    moved = F.zip_with("x", F.array(*map(F.lit, base.tolist())), lambda a, b: a + b)
    return stored(made.select("row", moved.alias("x")), "rows"), base


def _columns(cells: DataFrame, means: DataFrame, rows: DataFrame, total: np.ndarray, width: int) -> DataFrame:
    """(feature, m, x) of the centred matrix's transpose times rows(row, x), whose sum over all records is total."""
    made = cells.join(rows, "row").groupBy("feature").agg(_sums(width, F.col("v")).alias("s"))
    centred = F.zip_with(F.coalesce("s", F.array(*[F.lit(0.0)] * width)), F.array(*map(F.lit, total.tolist())), lambda a, b: a - F.col("m") * b)
    return means.join(made, "feature", "left").select("feature", "m", centred.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _mapped(df: DataFrame, key: str, turn: np.ndarray, *others: str) -> DataFrame:
    """df with x times a small matrix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in (key, *others)), pa.array(list(_matrix(batch) @ turn), pa.list_(pa.float64()))], names=[key, *others, "x"])

    held = df.select(key, *others, "x")
    return held.mapInArrow(run, held.schema)


def _added(df: DataFrame, of: Callable[[np.ndarray], np.ndarray], shape: tuple) -> np.ndarray:
    """The sum over all rows of what `of` makes of a matrix of them: added up in each task, then in some, then here."""

    def run(batches: Iterable[pa.RecordBatch], of: Callable = of) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["x"])

    once = df.select("x").mapInArrow(run, "x array<double>").repartition(ADDERS)
    parts = once.mapInArrow(lambda batches: run(batches, lambda x: x.sum(0).reshape(shape)), "x array<double>").collect()  # ADDERS rows
    return np.sum([np.array(r["x"]) for r in parts], axis=0).reshape(shape)


def _gram(df: DataFrame, width: int) -> np.ndarray:
    return _added(df, lambda x: x.T @ x, (width, width))


def _total(df: DataFrame, width: int) -> np.ndarray:
    return _added(df, lambda x: x.sum(0), (width,))


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What turns rows with this Gram matrix into orthonormal columns; directions without extent go."""
    values, turn = np.linalg.eigh(gram)
    kept = values > 1e-11 * max(values.max(), 1e-300)
    return turn[:, kept] / np.sqrt(values[kept])
