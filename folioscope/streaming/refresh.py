"""The refresh as a stream: new page files are hashed, compared with the store and appended to it, once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions import text as X
from folioscope.operators import refresh
from folioscope.sources.tables import read_or_empty

PAGES = "url string, text string, fetched_at timestamp"
STORE = "url string, hash string, batch long"


def latest_hashes(spark: SparkSession, store: str) -> DataFrame:
    """The store keeps every batch; the last hash of a url counts."""
    rows = read_or_empty(spark, store, STORE)
    return rows.groupBy("url").agg(F.max_by("hash", "batch").alias("hash"))


def refresh_stream(spark: SparkSession, pages: str, store: str, changes: str, checkpoint: str, limit: int = refresh.DRIFT) -> StreamingQuery:
    """Take in what is new below pages and stop. A batch's differences go to changes/batch=N; unless drift freezes it, its hashes go to the store.

    Both writes overwrite the batch's own folder, so a batch that is run again after a failure leaves the same files.
    """

    def one(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("url").agg(F.max_by("text", "fetched_at").alias("text"))
        new = latest.select("url", F.when(F.col("text").isNotNull(), X.stable_hash(F.col("text"))).alias("hash"))
        old = latest_hashes(spark, store).join(new.select("url"), "url", "left_semi")
        target = f"{changes}/batch={number}"
        refresh.diff_hashes(old, new).write.mode("overwrite").parquet(target)
        diff = spark.read.parquet(target)
        frozen = refresh.drift_gate(diff, limit).first()["frozen"]
        keep = refresh.next_hashes(diff, frozen).withColumn("batch", F.lit(number).cast("long"))
        keep.write.mode("overwrite").parquet(f"{store}/part={number}")

    stream = spark.readStream.schema(PAGES).parquet(pages)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
