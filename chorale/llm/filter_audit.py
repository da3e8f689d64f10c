"""How filters interact: what each removes, alone and after others, in every order, kept up by a stream with retractions.

All files of a table go through available-now micro-batches. Each text is measured once (its failing filters are
a mask) and keyed by a hash of it. The state holds, for every text, the rows with the smallest id so far: they alone don't
fail the filter of repeated texts. When a smaller id arrives, the counter of the earlier row's mask loses it and the
mask with the repeat bit gains it. Each micro-batch adds such signed counts by part and mask to a table of its own,
written over if the batch is run again; their sum gives all orders of filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chorale.llm.common import partitions, stored
from chorale.session import shared_path

#: Bits of the mask, in the order of FILTERS.
FILTERS = "ABCDE"
SHORT, REPETITIVE, CAPITALS, SYMBOLS, REPEATED = (1 << k for k in range(5))
#: Texts of a state group, about: a group's texts are kept and merged as columns, since a call for every text takes milliseconds.
GROUP_TEXTS = 4096
_CAPITALS, _SYMBOLS, _LATER = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))
_WHAT = ["part", "mask", "good", "toxic"]
_TEXT = ["h1", "h2"]
_ROW = "h1 long, h2 long, doc_id long, part string, mask int, good boolean, toxic boolean, n long"


def mask(text: bytes) -> int:
    """The filters that the text fails by itself: all but the one of repeated texts."""
    words = text.split()
    chars = len(text.translate(None, _LATER))
    out = SHORT if len(words) < 50 else 0
    out |= REPETITIVE if 100 * len(set(words)) < 65 * len(words) else 0
    out |= CAPITALS if 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 5 * chars else 0
    return out | (SYMBOLS if len(text.translate(None, _SYMBOLS)) < len(text) else 0)


def measured(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, part, mask) of (doc_id, text, part): the text's 128-bit hash and its mask; texts go no further."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<i8").reshape(-1, 2)
            columns = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), batch.column(0), batch.column(2), pa.array(list(map(mask, texts)), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "part", "mask"])

    return docs.mapInArrow(measure, "h1 long, h2 long, doc_id long, part string, mask int")


def flagged(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found with good and toxic by its id's labels; a label row that says so is enough, a null id has none. Null ids are dealt out."""
    own = found.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__salt": F.when(F.col("doc_id").isNull(), F.pmod("h1", F.lit(1024))).otherwise(-1).cast("long")})
    flags = labels.select(F.col("doc_id").alias("__id"), F.lit(-1).cast("long").alias("__salt"), "good", "toxic")
    return own.join(flags, ["__id", "__salt"], "left").select("h1", "h2", "doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def combined(found: DataFrame, groups: int) -> DataFrame:
    """Rows of a batch of equal text meet before the shuffle: those above the smallest id of their text there surely repeat one and
    become counts (null h1), so a text that many rows hold sends a few rows for each batch."""

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        for k, batch in enumerate(batches):
            df = pa.Table.from_batches([batch]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            least = df.groupby(_TEXT)["doc_id"].transform("min")
            above = (df["doc_id"] > least).fillna(False).astype(bool)
            nameless = df["doc_id"].isna()
            settled = df[above | nameless].assign(mask=df["mask"] | np.where(above, REPEATED, 0))
            settled = settled.groupby(_WHAT, as_index=False).size().rename(columns={"size": "n"}).assign(group=(context.partitionId() * 31 + k) % groups)
            first = df[~above & ~nameless].groupby([*_TEXT, "doc_id", *_WHAT], as_index=False).size().rename(columns={"size": "n"})
            first["group"] = first["h1"] % groups
            out = pd.concat([first, settled], ignore_index=True)
            yield pa.RecordBatch.from_pandas(out.reindex(columns=["group", *_TEXT, "doc_id", *_WHAT, "n"]), schema=_OUT, preserve_index=False)

    return found.mapInArrow(combine, f"group int, {_ROW}")


_KEPT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])
_OUT = pa.schema([("group", pa.int32()), *_KEPT])


def merged(old: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(rows with the smallest id of each text, signed counts by part, mask, good and toxic) once new rows have met the old ones."""
    seen = pd.concat([old.assign(old=True), new.assign(old=False)], ignore_index=True)
    seen = seen.iloc[np.lexsort((seen["doc_id"], seen["h2"], seen["h1"]))].reset_index(drop=True)
    ids, h1, h2, was = (seen[c].to_numpy() for c in ("doc_id", "h1", "h2", "old"))
    first = np.ones(len(seen), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    least = ids == ids[np.flatnonzero(first)][first.cumsum() - 1] if len(seen) else first
    gained, lost = seen[~was | ~least], seen[was & ~least]
    gained = gained.assign(mask=(gained["mask"] | np.where(least[~was | ~least], 0, REPEATED)).astype("int32"))
    kept = seen[least].drop(columns="old")
    if first.sum() < len(kept):  # several rows have a text's smallest id
        kept = kept.groupby([*_TEXT, "doc_id", *_WHAT], as_index=False)["n"].sum()
    return kept, pd.concat([gained[[*_WHAT, "n"]], lost[[*_WHAT, "n"]].assign(n=-lost["n"])])


def _kept_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    new = pd.concat(list(frames), ignore_index=True)
    settled = new["h1"].isna()
    old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else _KEPT.empty_table().to_pandas()
    kept, change = merged(old, new[~settled].drop(columns="group").astype({"h1": "int64", "h2": "int64", "doc_id": "int64"}))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _KEPT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(kept, schema=_KEPT, preserve_index=False))
    state.update((sink.getvalue().to_pybytes(),))
    yield pd.concat([change, new.loc[settled, [*_WHAT, "n"]]])


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic) of all rows of the Parquet files at path, which pass in about so many micro-batches.

    The state, some 50 bytes for each different text, is kept by the session's state store: in executors' memory if
    spark.sql.streaming.stateStore.providerClass isn't set, on their disks with RocksDB, for texts beyond that memory.
    """
    table = spark.read.parquet(path)
    files = table.inputFiles()
    groups = max(partitions(spark), table.count() // GROUP_TEXTS)
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = stored(flags.where("doc_id IS NOT NULL AND (good OR toxic)"), "flags")
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    if len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rpartition("/")[2]):  # a stream reads folders
        folder, _, name = path.rstrip("/").rpartition("/")
        arriving = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        arriving = reader.parquet(path)
    docs = arriving.select(arriving[id_col].cast("long").alias("doc_id"), arriving[text_col].cast("string").alias("text"), F.coalesce(arriving[part_col].cast("string"), F.lit("")).alias("part"))
    changes = combined(flagged(measured(docs), flags), groups).groupBy("group").applyInPandasWithState(_kept_state, "part string, mask int, good boolean, toxic boolean, n long", "rows binary", "append", GroupStateTimeout.NoTimeout)
    into, files_out = shared_path(spark, "counters"), max(1, partitions(spark) // 16)
    spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean, n long").write.parquet(f"{into}/batch=-1")

    def add(change: DataFrame, batch: int) -> None:
        change.groupBy(*_WHAT).agg(F.sum("n").alias("n")).where("n != 0").coalesce(files_out).write.mode("overwrite").parquet(f"{into}/batch={batch}")

    query = changes.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", shared_path(spark, "audit")).trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema("part string, mask int, good boolean, toxic boolean, n long, batch long").parquet(into)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """All orders of the filters, step by step, from (part, mask, n, good, toxic): 600 rows for each part, zeros included."""
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # at most 32 in a part
    ordered = masks.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bits = F.expr("transform(sequence(1, 5), i -> shiftleft(1, ascii(substring(filter_order, i, 1)) - 65))")
    steps = ordered.withColumns({"bit": F.element_at(bits, F.col("step")), "before": F.aggregate(F.slice(bits, F.lit(1), F.col("step") - 1), F.lit(0), lambda s, b: s.bitwiseOR(b))})

    def total(test: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("m", test), F.lit(0).cast("long"), lambda s, x: s + value(x))

    bit, before = F.col("bit"), F.col("before")

    def fails(x: Column) -> Column:
        return x["mask"].bitwiseAND(bit) != 0

    def open_(x: Column) -> Column:
        return x["mask"].bitwiseAND(before) == 0

    def n(x: Column) -> Column:
        return x["n"]

    return steps.select(
        "part", "filter_order", "step", total(lambda x: open_(x) & ~fails(x), n).alias("kept"), total(lambda x: open_(x) & fails(x), n).alias("removed"),
        total(lambda x: ~open_(x) & fails(x), n).alias("redundant"), total(lambda x: x["mask"] == bit, n).alias("unique_fails"),
        total(lambda x: open_(x) & fails(x), lambda x: x["good"]).alias("good_lost"), total(lambda x: open_(x) & fails(x), lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the documents at path.

    A null text is an empty one, a null part the empty string. Of rows with one text all but those with its smallest id fail E, so rows that
    repeat id and text fail it together or not at all; a null id neither fails E nor makes others fail. An empty table has no parts.
    labels: doc_id, quality and toxic; ids without a row, or with nulls, are neither good nor toxic.
    """
    return orders(counters(spark, path, labels, batches, id_col, text_col, part_col))
