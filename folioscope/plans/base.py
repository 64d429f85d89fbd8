"""Where queries and their SQL are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scratch.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# Results of a service and the cases they belong to, made of the turns of conversations by expressions that both dialects know.
ANSWERS = {
    "id": "conv_id * 1000 + turn", "conv_id": "conv_id", "turn": "turn", "query": "text", "body_text": "text",
    "outcome_type": "CASE WHEN conv_id % 5 < 3 THEN 'factual' WHEN conv_id % 5 = 3 THEN 'refusal' ELSE 'abstention' END",
    "expected_outcome": "CASE WHEN (conv_id + turn) % 7 = 3 THEN 'refusal' WHEN conv_id % 5 < 3 THEN 'factual' WHEN conv_id % 5 = 3 THEN 'refusal' ELSE 'abstention' END",
    "expected_list": "CASE WHEN conv_id % 2 = 0 THEN 'refusal,abstention' ELSE 'factual' END",
    "hybrid_skipped": "conv_id % 5 = 3 AND turn % 3 <> 2",
    "refusal_type": "CASE WHEN conv_id % 5 = 3 THEN CASE WHEN turn % 2 = 0 THEN 'advisory' ELSE 'comparison' END ELSE '' END",
    "expected_refusal_type": "CASE WHEN conv_id % 4 = 0 THEN 'advisory' ELSE '' END",
    "performance_limited": "conv_id % 7 = 2", "expected_limited": "conv_id % 14 = 2",
    "scheme": "concat('s', CAST(conv_id % 16 AS STRING))",
    "expected_scheme": "concat('s', CAST((conv_id + CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END) % 16 AS STRING))",
    "citation_url": "CASE WHEN conv_id % 11 = 0 THEN 'https://other.example.org/x' WHEN conv_id % 13 = 0 THEN '' ELSE concat('https://www.funds.example.com/funds/s', CAST(conv_id % 16 AS STRING), CASE WHEN turn % 2 = 0 THEN '/' ELSE '' END) END",
    "expected_url": "concat('https://funds.example.com/funds/s', CAST((conv_id + CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END) % 16 AS STRING))",
    "status": "CASE WHEN conv_id % 5 < 3 THEN 'found' WHEN conv_id % 5 = 4 THEN 'not_found_in_sources' END",
    "allow_not_found": "turn % 3 = 1",
    "citation_markdown": "CASE WHEN turn % 9 = 8 THEN '' ELSE '[a](https://funds.example.com/funds/a)' END",
    "disclaimer_line": "CASE WHEN conv_id % 6 = 5 THEN '' ELSE 'Facts-only. No investment advice.' END",
    "footer_line": "CASE WHEN turn % 4 = 3 THEN '' ELSE 'Last updated from sources: 01 Jan 2025' END",
    "footer_date": "CASE WHEN turn % 4 = 3 THEN '' ELSE '01 Jan 2025' END",
    "passed": "(conv_id + turn) % 6 <> 0", "repaired": "turn % 5 = 1",
    "evidence_chunk_id": "CASE WHEN turn % 8 = 7 THEN '' ELSE CAST(conv_id AS STRING) END",
    "http_status": "CASE WHEN conv_id % 17 = 1 THEN 503 ELSE 200 END",
    "latency_ms": "CASE WHEN turn % 3 = 2 THEN 0 ELSE (conv_id % 50) * 10 + turn END",
    "expect_pass": "turn % 2 = 0", "expect_repaired": "CASE WHEN turn % 3 = 0 THEN turn % 5 = 1 END", "expect_type": "CASE WHEN turn % 4 = 1 THEN 'factual' ELSE '' END",
    "expect_host": "CASE WHEN conv_id % 8 = 1 THEN 'www.funds.example.com' ELSE '' END",
    "forbid_factual": "conv_id % 9 = 4", "forbid_host": "CASE WHEN conv_id % 10 = 0 THEN 'other.example' ELSE '' END",
}
ANSWER_SITE = "funds.example.com"


def answers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(*[F.expr(ANSWERS[c]).alias(c) for c in columns or ANSWERS])


def answers_sql(*columns: str, sources: Mapping[str, str] = ANSWERS) -> str:
    return "SELECT " + ", ".join(f"{sources[c]} AS {c}" for c in columns or sources) + " FROM conversations"
