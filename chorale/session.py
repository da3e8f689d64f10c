"""Sessions: a local one for tests and benches, and making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chorale")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return share_code(session)


def share_code(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, wherever the driver was started from: by path on this machine, as a zip file on a cluster."""
    context = spark.sparkContext
    have = context.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))
    if not context.master.startswith("local") and context.applicationId not in _shared:
        context.addPyFile(_zipped())
        _shared.add(context.applicationId)
    return spark


_shared: set[str] = set()


@lru_cache(maxsize=1)
def _zipped() -> str:
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "chorale.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((Path(ROOT) / "chorale").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    return str(path)


_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; one of our own only in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for a table or a stream's checkpoint; release() deletes what is there."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all that stands at the paths of shared_path() and stored() in this application, once the results made from them are written; their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"
