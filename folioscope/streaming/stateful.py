"""The refresh as a stream with keyed state: a batch costs what its own pages cost, whatever the store has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.functions import text as X
from folioscope.operators import refresh
from folioscope.streaming.refresh import PAGES

CHANGES = "url string, old_hash string, new_hash string, status string"
REVERTS = "url string, hash string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _decide(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a batch brings for a url, whose state is the hash of its last good fetch and the time of its last page."""
    old, seen = state.get if state.exists else (None, None)
    found = pd.concat(list(rows), ignore_index=True)
    reverts, pages = found[found["revert"]], found[~found["revert"]]
    if len(reverts):  # before pages: they undo an earlier batch
        old = reverts["hash"].iloc[0]
    if not len(pages):
        state.update((old, seen))
        return
    last = pages.sort_values("fetched_at").iloc[-1]
    new = None if pd.isna(last["hash"]) else last["hash"]
    status = "failed" if new is None else "baseline" if old is None else "unchanged" if old == new else "changed"
    state.update((old if new is None else new, int(last["seen"])))
    yield pd.DataFrame({"url": [key[0]], "old_hash": [old], "new_hash": [new], "status": [status]})


def stateful_refresh(spark: SparkSession, pages: str, reverts: str, changes: str, checkpoint: str, limit: int = refresh.DRIFT) -> StreamingQuery:
    """Take in what is new below pages and stop. A batch's differences go to changes/batch=N, by the rules of refresh.diff_hashes for pages that came.

    The hash of each url is state of the stream, in RocksDB below the checkpoint, so only the batch's pages are shuffled and nothing else is read. A batch that
    drift freezes has moved its hashes already; the old ones of its changed urls are written to reverts, which the stream reads beside the pages: the next
    batch takes them back before it compares, and the changes show again. Both writes overwrite the batch's own folder, so a batch that is run again
    leaves the same files. The state has as many partitions as the session's shuffles at the first run.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    empty = spark.createDataFrame([], REVERTS)
    empty.write.mode("append").parquet(reverts)  # a source must be there
    fetched = spark.readStream.schema(PAGES).parquet(pages)
    hashed = fetched.select("url", F.when(F.col("text").isNotNull(), X.stable_hash(F.col("text"))).alias("hash"), "fetched_at", F.unix_seconds("fetched_at").alias("seen"), F.lit(False).alias("revert"))
    undone = spark.readStream.schema(REVERTS).option("recursiveFileLookup", "true").parquet(reverts)
    undone = undone.select("url", "hash", F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(0).cast("long").alias("seen"), F.lit(True).alias("revert"))
    met = hashed.union(undone).where(F.col("url").isNotNull()).groupBy("url")
    found = met.applyInPandasWithState(_decide, CHANGES, "hash string, seen long", "append", GroupStateTimeout.NoTimeout)

    def one(batch: DataFrame, number: int) -> None:
        target = f"{changes}/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        diff = spark.read.schema(CHANGES).parquet(target)
        frozen = refresh.drift_gate(diff, limit).first()["frozen"]
        undo = diff.where((F.col("status") == "changed") & F.lit(frozen)).select("url", F.col("old_hash").alias("hash"))
        undo.write.mode("overwrite").parquet(f"{reverts}/part={number}")

    return found.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_hashes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(url, hash, seen) of the stream's state, seen being the time of the last page: old ones are stale. Reverts that no batch has taken in yet are not in it."""
    state = F.col("value.groupState")
    rows = spark.read.format("statestore").load(checkpoint).select(F.col("key.url").alias("url"), state["hash"].alias("hash"), F.timestamp_seconds(state["seen"]).alias("seen"))
    return rows.where(F.col("hash").isNotNull())
