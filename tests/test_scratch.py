"""Intermediate tables go when their scope ends."""

import os

import pytest

from folioscope.operators import quality
from folioscope.sources import scratch


def left(spark):
    folder = f"{scratch.shared_dir(spark)}/folioscope".removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scopes(spark, tmp_path):
    before = left(spark)
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "a b d")], "id long, text string")
    with scratch.scope():
        quality.keep_first(rows, "id", "text").write.parquet(str(tmp_path / "out"))
        outer = left(spark)
        with scratch.scope():
            assert scratch.written(rows, "inner").count() == 3
            assert left(spark) > outer
        assert left(spark) == outer > before, "the inner scope took its own"
    assert left(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_scopes_end_after_failures(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), scratch.scope():
        scratch.written(spark.range(3), "lost")
        raise ZeroDivisionError
    assert left(spark) == before
    scratch.discard(scratch.written(spark.range(3), "kept"))
    assert left(spark) == before
