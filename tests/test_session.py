"""Where intermediate tables go."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from chorale import session


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(get=lambda name, default=None: "hdfs://shared/tmp/")
    assert session.shared_dir(SimpleNamespace(conf=named, sparkContext=SimpleNamespace(master="spark://host:7077"))) == "hdfs://shared/tmp"


def test_release_deletes_what_was_stored(spark):
    path = session.stored(spark.range(3), "numbers").inputFiles()[0].removeprefix("file://")
    assert Path(path).exists() and session.release(spark) >= 1 and not Path(path).exists()
    assert session.release(spark) == 0
