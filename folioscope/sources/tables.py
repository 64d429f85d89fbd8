"""Schemas, readers of small rule and registry files, and versioned tables with a pointer."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = "id int, scheme string, scheme_display_name string, url string, source_type string, doc_version string, published_date string, crawl_frequency string, active boolean"
CHUNK = "chunk_id string, text string, start_char int, end_char int, source_url string, scheme string, doc_type string, section_title string, section_level int, effective_date string, compliance_rank int, strategy string"
REQUEST = "query string, session_id string"


def read_registry(spark: SparkSession, path: str, key: str = "entries") -> DataFrame:
    """Rows of the list under key in a JSON document, by a fixed schema; a broken document fails."""
    found = spark.read.schema(f"{key} array<struct<{_fields(REGISTRY)}>>").option("mode", "FAILFAST").json(path, multiLine=True)
    return found.select(F.explode(key).alias("e")).select("e.*")


def _fields(ddl: str) -> str:
    return ", ".join("{}:{}".format(*f.split(" ")) for f in ddl.split(", "))


def read_source_list(spark: SparkSession, lines: list[str], expected: int | None = None) -> DataFrame:
    """(scheme, url) of a plain list in YAML form: items with scheme and url, in either order. Raises on blank or repeated ones."""
    rows: list[dict[str, str]] = []
    for line in lines:
        m = re.match(r"\s*(-\s+)?(scheme|url)\s*:\s*[\"']?([^\"'#]*?)[\"']?\s*(?:#.*)?$", line)
        if m:
            if m[1]:
                rows.append({})
            if rows:
                rows[-1][m[2]] = m[3].strip()
    if any(not r.get("scheme") or not r.get("url") for r in rows):
        raise ValueError("an entry lacks its scheme or url")
    if len({r["url"] for r in rows}) != len(rows):
        raise ValueError("a url is listed twice")
    if expected is not None and len(rows) != expected:
        raise ValueError(f"{len(rows)} sources instead of {expected}")
    return spark.createDataFrame([(r["scheme"], r["url"]) for r in rows], "scheme string, url string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON documents. Broken ones have nulls and their text in _corrupt_record; a missing path gives no rows."""
    fields = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    if not _exists(spark, path):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).option("mode", "PERMISSIVE").json(path, multiLine=True)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def decode_records(df: DataFrame, json_col: str, schema: str = CHUNK, typed: bool = False) -> DataFrame:
    """Typed columns of a JSON column, and the keys that the schema lacks as map metadata: of their JSON text or, typed, of variants, in which numbers, flags and nested values stay what they are."""
    known = T._parse_datatype_string(schema).names
    rest = F.map_filter(F.from_json(json_col, f"map<string,{'variant' if typed else 'string'}>"), lambda k, v: ~k.isin(*known))
    return df.select(F.from_json(json_col, schema).alias("r"), rest.alias("metadata")).select("r.*", "metadata")


def verified(df: DataFrame, body: str, digest: str, strict: bool = False) -> DataFrame:
    """Add sha_ok: does the body have the recorded SHA-256. strict: the job fails if one has not."""
    ok = F.sha2(F.col(body).cast("binary"), 256).eqNullSafe(F.col(digest))
    if strict:
        return df.withColumn("sha_ok", F.when(F.assert_true(ok, "a body doesn't have its recorded hash").isNull(), True))
    return df.withColumn("sha_ok", ok)


def fetch_status(http_status: Column, content_type: Column, body: Column, challenge: Column, max_bytes: int = 16 << 20) -> Column:
    """ok, challenge_suspect, non_html or failed (no body, an HTTP error, a body over the limit)."""
    good = F.coalesce((http_status == 200) & body.isNotNull() & (F.octet_length(body) <= max_bytes), F.lit(False))
    is_html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))
    return F.when(~good, "failed").when(~is_html, "non_html").when(challenge, "challenge_suspect").otherwise("ok")


def write_pages(df: DataFrame, path: str) -> None:
    """One folder for each fetch status; failed pages are kept without their body."""
    body = F.when(F.col("fetch_status") != "failed", F.col("html"))
    df.withColumn("html", body).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fetch_status").parquet(path)


def write_version(df: DataFrame, root: str, version: str, partition: str | None = None) -> str:
    path = f"{root}/index_version={version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


class ActivationConflict(RuntimeError):
    """Another writer has made a version active since the one that this writer started from."""


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(seq, path) of the pointers of an index, the latest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_active")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(((int(n.split(".")[0]), f"{root}/_active/{n}") for n in names if re.fullmatch(r"\d+\.json", n)), reverse=True)


def activate(spark: SparkSession, root: str, version: str, expected: int | None = None, **facts: Any) -> int:
    """Point to a version that is written in full, and return the pointer's number. Pointers are never changed: a new one is a file named by the next number.

    expected: the number that the writer started from (0: none). The file is created only if there is none of its name, so of two writers that started from the same
    pointer one gets ActivationConflict, and the other's version stays active; without it the next free number is taken. The store must create
    files exclusively, as HDFS does. A writer that dies before its pointer has content leaves an empty file, which readers pass over.
    """
    last = max((n for n, _ in _pointers(spark, root)), default=0)
    if expected is not None and last != expected:
        raise ActivationConflict(f"{root} is at pointer {last}, not at {expected}")
    seq = last + 1
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_active/{seq:012d}.json")
    try:
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    except Exception as e:
        if "exist" in str(e).lower():
            raise ActivationConflict(f"pointer {seq} of {root} was taken meanwhile") from e
        raise
    out.write(bytearray(json.dumps({"seq": seq, "version": version, **facts}, sort_keys=True).encode()))
    out.close()
    return seq


def active_version(spark: SparkSession, root: str) -> dict[str, Any]:
    """The latest pointer that has content."""
    for _, path in _pointers(spark, root):
        content = "".join(r.value for r in spark.read.text(path).collect())
        if content:
            return json.loads(content)
    raise FileNotFoundError(f"{root} has no active version")


def read_active(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/index_version={active_version(spark, root)['version']}")


def read_indexable(chunks: DataFrame, manifest: DataFrame, key: str = "scheme") -> DataFrame:
    """Chunks of the groups that the manifest calls indexable."""
    return chunks.join(manifest.where("indexable").select(key), key, "left_semi")


def fingerprint(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def version_id(stamp: str, model: str, config: Mapping[str, Any]) -> str:
    """Time, model and configuration of an index in one name."""
    return f"{stamp}_{re.sub(r'[^a-z0-9]+', '-', model.lower()).strip('-')[:32]}_{fingerprint(config)}"


def merged_config(base: Mapping[str, Any], override: Mapping[str, Any] | None) -> dict[str, Any]:
    return {**base, **(override or {})}


def append_log(df: DataFrame, path: str, redact: Callable[[Column], Column], query_col: str = "query") -> None:
    """Append decisions as JSON lines, the question redacted."""
    df.withColumn(query_col, redact(F.col(query_col))).write.mode("append").json(path)
