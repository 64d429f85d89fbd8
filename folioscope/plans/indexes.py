"""Registered queries over built indexes and the refresh stream, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.functions.rules import Rules
from folioscope.operators import cells, guardrails, hybrid, keyword, resolve
from folioscope.plans import segments, services
from folioscope.plans.base import answers, answers_sql, query, table
from folioscope.plans.core import _BM25, _CHANGED, _VEC, _stable, _vector_queries
from folioscope.plans.records import _folder
from folioscope.sources import scratch
from folioscope.streaming.refresh import refresh_stream
from folioscope.streaming.stateful import stateful_refresh


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of seven sources; the language is the scheme."""
    url = F.concat(F.lit("https://funds.example.com/p"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", url.alias("source_url"), F.col("lang").alias("scheme"))


def _built(spark: SparkSession, sf_dir: str) -> str:
    root = _folder(spark, "index")
    services.build_indexes(spark, _chunks(spark, sf_dir), root, "20250101")
    return root


@query(f"WITH {_BM25} SELECT * FROM kw")
def indexed_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword channel of a built index: blocks that can matter, without the documents' texts."""
    index = services.load_index(spark, _built(spark, sf_dir))
    return index.keyword_topk(keyword.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), 5)


def _cell_hits(spark: SparkSession, sf_dir: str, filtered: bool) -> DataFrame:
    """The vectors as cells, and every vec_id divisible by 100 as a question."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("scope"))
    centroids = cells.fit_centroids(held)
    packs, reach = (scratch.written(x, "cells") for x in cells.pack_cells(held, centroids))
    scope = F.col("label").cast("string") if filtered else F.lit(None).cast("string")
    asked = _vector_queries(spark, sf_dir).select("query_id", F.col("query_vec").alias("v"), scope.alias("scope"))
    return cells.search(spark, cells.Cells(packs, reach, centroids), asked, 5)


@query(f"WITH {_VEC} SELECT * FROM vec")
def cell_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_hits(spark, sf_dir, False)


@query(f"WITH {_VEC.replace('FROM vscore', 'FROM vscore WHERE ql = dl')} SELECT * FROM vec")
def cell_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_hits(spark, sf_dir, True)


#: What the documents are after the updates below: one in seven removed, and of the rest those divisible by five with another text.
_LATER = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('edited later ', text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


def _updated(spark: SparkSession, sf_dir: str) -> str:
    """An index of all documents, then two updates by source (a source is a document here) and a merge of what the updates wrote."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.concat(F.lit("u"), "doc_id").alias("source_url"), F.col("lang").alias("scheme"))
    root = _folder(spark, "index")
    segments.create(spark, docs, root, "20250101")
    edited = docs.where("chunk_id % 5 = 0 AND chunk_id % 7 <> 3").withColumn("text", F.concat(F.lit("edited later "), "text"))
    gone = docs.where("chunk_id % 7 = 3").select("source_url")
    segments.update(spark, root, edited.where("chunk_id % 2 = 0"), gone)
    segments.update(spark, root, edited.where("chunk_id % 2 = 1"))
    segments.merge(spark, root)
    return root


@query(f"WITH {_BM25.replace('FROM documents', f'FROM {_LATER}')} SELECT * FROM kw")
def updated_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword channel after updates: segments, tombstones and added statistics give what an index of the later documents gives."""
    index = segments.load(spark, _updated(spark, sf_dir))
    return index.keyword_topk(keyword.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), 5)


@query(f"SELECT doc_id AS chunk_id, sha256(text) AS text_sha256 FROM {_LATER}")
def updated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.load(spark, _updated(spark, sf_dir)).chunks.select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("SELECT count(*) AS n, count(*) AS passed, count(*) AS cited, 0::BIGINT AS refused FROM benchmark")
def service_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service end to end: each benchmark passage in a question about a fact, answered from a built index by both channels; every answer must pass and cite a source."""
    index = services.load_index(spark, _built(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("what is the expense ratio of this fund: "), "text").alias("query"))
    registry = [resolve.scheme_record(f"acme-{x}-direct-growth", f"https://funds.example.com/{x}", f"Acme {x} Fund", "acme") for x in ("midcap", "gilt")]
    done = services.Service(Rules(house="acme", site="funds.example.com"), guardrails.Policy(), registry, {}).answer(asked, index=index)
    return done.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if(F.col("citation_url").startswith("https://")).alias("cited"), F.count_if(F.col("answer_type") == "refusal").alias("refused"))


@query("""SELECT 'url_not_allowlisted' AS code, count(*) AS n FROM documents WHERE doc_id % 7 IN (5, 6) HAVING count(*) > 0
UNION ALL SELECT 'version_mismatch', 1""")
def index_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.range(5).select(F.concat(F.lit("https://funds.example.com/p"), "id").alias("url"))
    return services.index_issues(spark, _built(spark, sf_dir), allowed, "another")


@query(f"""WITH a AS ({answers_sql()}) SELECT conv_id AS query_id, count(*) FILTER (WHERE citation_url = '' OR regexp_matches(citation_url, '/s[0-7]/?$')) AS kept, count(*) FILTER (WHERE citation_url <> '' AND NOT regexp_matches(citation_url, '/s[0-7]/?$')) AS dropped
FROM a GROUP BY conv_id""")
def dropped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.range(8).select(F.concat(F.lit("https://funds.example.com/funds/s"), "id").alias("url"))
    rows = answers(spark, sf_dir, "conv_id", "citation_url")
    return hybrid.dropped_candidates(rows.select(F.col("conv_id").alias("query_id"), F.col("citation_url").alias("source_url")), allowed)


_REFRESHED = f"""SELECT 0::BIGINT AS batch, doc_id::VARCHAR AS url, 'baseline' AS status, {_stable('text')} AS new_hash FROM documents WHERE doc_id % 4 <> 0
UNION ALL SELECT 1, doc_id::VARCHAR, CASE WHEN toxic = 1 THEN 'failed' WHEN doc_id % 4 = 0 THEN 'baseline' WHEN {_stable('text')} = {_stable(_CHANGED)} THEN 'unchanged' ELSE 'changed' END, CASE WHEN toxic = 1 THEN NULL ELSE {_stable(_CHANGED)} END
FROM documents JOIN labels USING (doc_id)"""


def _refreshed(spark: SparkSession, sf_dir: str, run: Callable[..., StreamingQuery], *folders: str) -> DataFrame:
    """Two batches through the stream: three of four documents, then all labelled ones, the poor of them edited and the toxic ones not fetched."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    where = {n: _folder(spark, n) for n in ("pages", "changes", "checkpoint", *folders)}
    edited = F.when(F.col("quality") == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    for rows, text, at in ((docs.where("doc_id % 4 <> 0"), F.col("text"), "2025-01-01"), (docs.where("quality IS NOT NULL"), F.when(F.col("toxic") == 0, edited), "2025-01-02")):
        rows.select(F.col("doc_id").cast("string").alias("url"), text.alias("text"), F.lit(at).cast("timestamp").alias("fetched_at")).write.mode("append").parquet(where["pages"])
        run(spark, **where).awaitTermination()
    return spark.read.parquet(where["changes"]).select(F.col("batch").cast("long").alias("batch"), "url", "status", "new_hash")


@query(_REFRESHED)
def refresh_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir, refresh_stream, "store")


@query(_REFRESHED)
def stateful_refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches through the stream whose hashes are keyed state."""
    return _refreshed(spark, sf_dir, stateful_refresh, "reverts")
