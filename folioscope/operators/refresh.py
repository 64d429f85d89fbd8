"""Incremental refresh: hash diff, drift gate, upsert of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: so many changed sources at once stop the refresh.
DRIFT = 3


def diff_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, old_hash, new_hash, status) of old(url, hash) and new(url, hash or null where the fetch failed).

    status: baseline, changed, unchanged, failed, or removed where new has no row.
    """
    o = old.select("url", F.col("hash").alias("old_hash"), F.lit(True).alias("__o"))
    n = new.select("url", F.col("hash").alias("new_hash"), F.lit(True).alias("__n"))
    status = (
        F.when(F.col("__n").isNull(), "removed").when(F.col("new_hash").isNull(), "failed").when(F.col("old_hash").isNull(), "baseline")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    )
    return o.join(n, "url", "full").select("url", "old_hash", "new_hash", status.alias("status"))


def drift_gate(diff: DataFrame, limit: int = DRIFT) -> DataFrame:
    """One row: counts by status, frozen (at least limit changed) and how many to ingest again."""
    names = ("baseline", "changed", "unchanged", "failed", "removed")
    sums = diff.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names])
    frozen = F.col("n_changed") >= limit
    return sums.withColumns({"frozen": frozen, "n_reingest": F.when(frozen, 0).otherwise(F.col("n_changed")).cast("long")})


def next_hashes(diff: DataFrame, frozen: bool) -> DataFrame:
    """The store after this run. Failed sources keep their hash; in a frozen run changed ones do too, so they show again."""
    keep_old = (F.col("status") == "failed") | (F.col("status") == "changed") & F.lit(frozen)
    hashed = diff.where("status <> 'removed'").select("url", F.when(keep_old, F.col("old_hash")).otherwise(F.col("new_hash")).alias("hash"))
    return hashed.where("hash IS NOT NULL")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of current with the same key; the columns are current's."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes.select(*current.columns))


def write_store(hashes: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """The hash store as a table at path, bucketed and sorted by url, and read back; diff_hashes with it as old shuffles the new hashes alone.

    buckets: at least the session's shuffle partitions (the default), or the join deals the store out again.
    """
    spark = hashes.sparkSession
    n = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = hashes.select("url", "hash").repartition(n, "url")
    dealt.write.mode("overwrite").bucketBy(n, "url").sortBy("url").format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)
