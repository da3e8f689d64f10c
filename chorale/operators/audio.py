"""Summaries of waveforms and chroma vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key profiles of the major and minor modes, from C on (each is divided by its sum), and key names.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def waveform(df: DataFrame, key: str, rate: str = "sr", samples: str = "samples") -> DataFrame:
    """(key, duration_ms, rms_dbfs, peak, crest_db, energy, zcr); an empty signal has null levels and 0 duration."""
    s, n = F.col(samples), F.size(samples)
    rms = F.sqrt(_sum(s, lambda x: x * x) / F.nullif(n, F.lit(0)))
    peak = F.array_max(F.transform(s, lambda x: F.abs(x.cast("double"))))
    crossings = F.aggregate(F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: ((a < 0) != (b < 0)).cast("int")), F.lit(0), lambda a, x: a + x)
    db = lambda c: 20 * F.log10(F.greatest(c, F.lit(1e-12)))
    return df.select(
        key, F.round(n * 1000 / F.col(rate)).cast("long").alias("duration_ms"), db(rms).alias("rms_dbfs"), peak.alias("peak"), (db(peak) - db(rms)).alias("crest_db"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rms - 0.02) / 0.18)).alias("energy"), F.when(n > 1, crossings / n).otherwise(F.lit(0.0)).alias("zcr"),
    )


def key_and_mode(df: DataFrame, key: str, chroma: str = "chroma") -> DataFrame:
    """(key, pitch, mode, confidence): the best rotation of either profile, and its lead over the other's best; the lower pitch and the major mode of equals."""
    spark = df.sparkSession
    rows = [(k, mode, i, profile[(i - k) % 12] / sum(profile)) for k in range(12) for mode, profile in (("major", MAJOR), ("minor", MINOR)) for i in range(12)]
    profiles = spark.createDataFrame(rows, "k int, mode string, i int, w double")  # 288 rows
    total = _sum(F.col(chroma)) + 1e-12
    bins = df.select(key, F.posexplode(F.transform(chroma, lambda x: x.cast("double") / total)).alias("i", "v"))
    dots = bins.join(F.broadcast(profiles), "i").groupBy(key, "k", "mode").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    best = lambda mode: F.max(F.when(F.col("mode") == mode, F.struct("dot", (-F.col("k")).alias("o"))))
    found = dots.groupBy(key).agg(best("major").alias("up"), best("minor").alias("down"))
    major, gap = F.col("up.dot") >= F.col("down.dot"), F.abs(F.col("up.dot") - F.col("down.dot"))
    pitch = F.element_at(F.array(*map(F.lit, KEYS)), (1 - F.when(major, F.col("up.o")).otherwise(F.col("down.o"))).cast("int"))
    return found.select(key, pitch.alias("pitch"), F.when(major, "major").otherwise("minor").alias("mode"), gap.alias("confidence"))
