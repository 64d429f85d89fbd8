"""What several operators share: Arrow batches, hashed numbers, written tables, and components (of the core)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.graphs import components
from folioscope.sources.scratch import discard, new_path, release, remove, shared_dir, written

__all__ = ["ARROW_BATCH_BYTES", "bound_arrow_batches", "components", "discard", "hash_unit", "new_path", "release", "remove", "shared_dir", "written"]

#: Bytes of Arrow data handed to a Python worker at once. One row may be larger; it then travels alone.
ARROW_BATCH_BYTES = 8 << 20


def bound_arrow_batches(spark: SparkSession, n_bytes: int = ARROW_BATCH_BYTES) -> None:
    """Cut Arrow batches by bytes, so that a run of very long texts cannot fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def hash_unit(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the seed and the columns (nulls as '~')."""
    joined = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
