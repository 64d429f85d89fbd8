"""Chunk bundles: a file of records for each scheme, found in a folder, with the file's name where records name no scheme; and rule files."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.tables import CHUNK, _exists, fingerprint


def write_bundles(chunks: DataFrame, path: str, key: str = "scheme") -> None:
    """One folder of JSON lines for each scheme; a scheme's chunks are in its files alone."""
    chunks.withColumn("bundle", F.regexp_replace(F.col(key), "[^A-Za-z0-9_-]", "_")).repartition("bundle").write.mode("overwrite").partitionBy("bundle").json(path)


def read_bundles(spark: SparkSession, path: str, schema: str = CHUNK, key: str = "scheme") -> DataFrame:
    """All bundles below a folder; a record without a scheme has its bundle's name. No folder, no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"bundle=([^/]*)/", 1)
    bare = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"(_chunks)?\.jsonl?$", "")
    fallback = F.when(name != "", name).otherwise(bare)
    return rows.withColumn(key, F.coalesce(F.nullif(F.trim(key), F.lit("")), fallback))


def bundle_documents(chunks: DataFrame, key: str = "scheme", order: str = "start_char") -> DataFrame:
    """(key, chunk_count, chunk_ids): one row for each scheme, ids in text order."""
    ids = F.array_sort(F.collect_list(F.struct(order, "chunk_id")))
    return chunks.groupBy(key).agg(F.count("*").cast("long").alias("chunk_count"), F.transform(ids, lambda r: r["chunk_id"]).alias("chunk_ids"))


def _document(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_cases(path: str) -> list[dict[str, Any]]:
    """The labelled questions of a benchmark or probe file, whichever of its usual keys they stand under (driver side, small)."""
    data = _document(path)
    found = next((data[k] for k in ("cases", "queries", "probes") if data.get(k)), [])
    return [dict(row) for row in found]


def load_phrases(path: str) -> list[tuple[str, list[str]]]:
    """(label, phrases) of a file of prohibited phrases: lists by label, or under the key phrases."""
    data = _document(path)
    sections: Mapping[str, Any] = data.get("phrases") or data
    return [(k, [str(p) for p in v]) for k, v in sections.items() if isinstance(v, list)]


def load_templates(path: str, slots: tuple[str, ...] = ("value", "sentence")) -> dict[str, str]:
    """Answer templates by facet; one with a slot that nothing fills is an error."""
    data = _document(path)
    out = {k: str(v) for k, v in (data.get("templates") or data).items() if isinstance(v, str)}
    bad = sorted(k for k, v in out.items() if set(re.findall(r"\{(\w+)\}", v)) - set(slots))
    if bad:
        raise ValueError(f"unknown slots in {', '.join(bad)}")
    return out


def write_config(spark: SparkSession, path: str, version: str, config: Mapping[str, Any], stamp: str) -> None:
    """The configuration of an index version, with its fingerprint, as one JSON document beside the others."""
    row = json.dumps({"index_version": version, "captured_at": stamp, "fingerprint": fingerprint(config), "config": dict(config)}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)


def write_snapshot(metrics: DataFrame, path: str, stamp: str) -> None:
    """Append a metric table as JSON lines under the run's time."""
    metrics.withColumn("run", F.lit(stamp)).coalesce(1).write.mode("append").json(path)
