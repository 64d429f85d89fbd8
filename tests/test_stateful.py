"""The stream with keyed state gives what the stream with a store gives."""

from pyspark.sql import functions as F

from folioscope.streaming.refresh import latest_hashes, refresh_stream
from folioscope.streaming.stateful import stateful_refresh, stored_hashes

BATCHES = [
    [("a", "one", "2025-01-01"), ("b", "two", "2025-01-01"), ("b", "two again", "2025-01-02"), ("d", None, "2025-01-01")],
    [("a", "one changed", "2025-01-02"), ("b", None, "2025-01-02"), ("c", "new", "2025-01-02")],
    [("a", "x", "2025-01-03"), ("b", "y", "2025-01-03"), ("c", "z", "2025-01-03")],  # three changes at once: frozen
    [("a", "x", "2025-01-04"), ("c", "new", "2025-01-04")],  # a shows its change again
]


def rows(spark, path):
    return {(r.batch, r.url): (r.old_hash, r.new_hash, r.status) for r in spark.read.parquet(path).collect()}


def test_like_the_store(spark, tmp_path):
    for kind, run, other in (("state", stateful_refresh, "reverts"), ("store", refresh_stream, "store")):
        where = {n: str(tmp_path / kind / n) for n in ("pages", other, "changes", "checkpoint")}
        for batch in BATCHES:
            df = spark.createDataFrame(batch, "url string, text string, at string")
            df.select("url", "text", F.col("at").cast("timestamp").alias("fetched_at")).write.mode("append").parquet(where["pages"])
            run(spark, **where).awaitTermination()
    got, want = (rows(spark, str(tmp_path / k / "changes")) for k in ("state", "store"))
    assert got == want
    assert [got[3, "a"][2], got[3, "c"][2], got[2, "a"][2]] == ["changed", "unchanged", "changed"]
    held = {r.url: r.hash for r in stored_hashes(spark, str(tmp_path / "state" / "checkpoint")).collect()}
    kept = {r.url: r.hash for r in latest_hashes(spark, str(tmp_path / "store" / "store")).collect()}
    assert held == kept
    seen = {r.url: str(r.seen)[:10] for r in stored_hashes(spark, str(tmp_path / "state" / "checkpoint")).collect()}
    assert seen == {"a": "2025-01-04", "b": "2025-01-03", "c": "2025-01-04"}
