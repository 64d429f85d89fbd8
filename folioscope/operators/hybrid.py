"""Hybrid retrieval: merge of two channels, normalisation within a query, fusion, re-ranking, citation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls as U


def merge_channels(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(query_id, id, keyword, vector, channels): full outer join of two top-k lists of (query_id, id, score)."""
    k = keyword.select("query_id", "id", F.col("score").alias("keyword"))
    v = vector.select("query_id", "id", F.col("score").alias("vector"))
    channels = X.hits([("keyword", F.col("keyword").isNotNull()), ("vector", F.col("vector").isNotNull())])
    return k.join(v, ["query_id", "id"], "full").select("query_id", "id", "keyword", "vector", channels.alias("channels"))


def _within(c: Column, w) -> Column:
    """Between 0 at the least and 1 at the greatest value of the query's rows; all 1 if these are equal."""
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high <= low, 1.0).otherwise((c - low) / (high - low))


def fuse(merged: DataFrame, pool: int = 12, allowed: Column | None = None) -> DataFrame:
    """Best of the normalised channels (nulls stay out of a channel's range), and the pool best rows of each query.

    allowed: a boolean column; rows without it are normalised with the others and dropped after.
    """
    w = Window.partitionBy("query_id")
    norms = [F.when(F.col(c).isNotNull(), _within(F.col(c), w)) for c in ("keyword", "vector")]
    fused = merged.withColumn("fused", F.round(F.coalesce(F.greatest(*norms), F.lit(0.0)), 6))
    if allowed is not None:
        fused = fused.where(allowed)
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def dropped_candidates(candidates: DataFrame, allowed: DataFrame, url_col: str = "source_url") -> DataFrame:
    """(query_id, kept, dropped) of candidates whose URL isn't allowed; a blank URL passes."""
    known = allowed.select(F.col("url").alias("__a")).distinct().withColumn("__ok", F.lit(True))
    met = candidates.join(known, U.canonical(F.col(url_col)) == F.col("__a"), "left")
    passes = F.coalesce(F.col("__ok"), F.lit(False)) | (F.trim(X.text_of(F.col(url_col))) == "")
    return met.groupBy("query_id").agg(F.count_if(passes).alias("kept"), F.count_if(~passes).alias("dropped"))


@dataclass(frozen=True)
class Weights:
    """Fixed values of the re-ranking."""

    vector: float = 0.45
    keyword: float = 0.45
    facet: float = 0.25
    lexical: float = 0.15
    scheme: float = 0.15
    least: float = 0.28
    epsilon: float = 1e-4
    confident: float = 0.82


def facet_score(query: Column, chunk: Column, facet: Column, facets: dict[str, list[str]]) -> Column:
    """Share of the facet's keywords that the query has (at most three count) which the chunk has too; without a facet, of all."""
    q, t = F.lower(X.text_of(query)), F.lower(X.text_of(chunk))

    def share(keywords: list[str]) -> Column:
        asked = sum((F.contains(q, F.lit(k)).cast("int") for k in keywords), F.lit(0))
        both = sum(((F.contains(q, F.lit(k)) & F.contains(t, F.lit(k))).cast("int") for k in keywords), F.lit(0))
        return F.least(F.lit(1.0), both / F.greatest(F.lit(1), F.least(F.lit(3), asked)))

    out = share([k for ks in facets.values() for k in ks])
    for code, keywords in facets.items():
        out = F.when(facet == code, share(keywords)).otherwise(out)
    return out


def rerank(
    candidates: DataFrame, query: Column, chunk: Column, facet: Column, scheme_match: Column, effective_date: Column, facets: dict[str, list[str]],
    weights: Weights = Weights(),
) -> DataFrame:
    """Add final score, rank and status to candidates(query_id, id, keyword, vector, ...).

    A missing channel counts as 0 when the ranges are taken, and its part is 0. Order: score in steps of epsilon, newer first, id. The
    status of a query's first row is found or not_found_in_sources by its score.
    """
    w = Window.partitionBy("query_id")

    def part(c: str) -> Column:
        return F.when(F.col(c).isNull(), 0.0).otherwise(_within(F.coalesce(F.col(c), F.lit(0.0)), w))

    final = (
        weights.vector * part("vector") + weights.keyword * part("keyword") + weights.facet * facet_score(query, chunk, facet, facets)
        + weights.lexical * X.lexical_overlap(query, chunk) + weights.scheme * F.when(scheme_match, 1.0).otherwise(0.0)
    )
    scored = candidates.withColumns({"__raw": final, "__fresh": X.freshness(effective_date)})
    step = F.bround(F.col("__raw") / weights.epsilon) * weights.epsilon
    order = Window.partitionBy("query_id").orderBy(F.desc(step), F.desc("__fresh"), "id")
    ranked = scored.withColumns({"final_score": F.round("__raw", 6), "rank": F.row_number().over(order)})
    status = F.when(F.col("rank") == 1, F.when(F.col("final_score") < weights.least, "not_found_in_sources").otherwise("found"))
    return ranked.withColumn("status", status).drop("__raw", "__fresh")


def pick_citation(resolved: Column, resolved_url: Column, confidence: Column, chunk_url: Column, default: str, least: float = 0.82) -> Column:
    """(url, reason): the resolver's if it is sure, else the chunk's, else the default."""
    sure = F.coalesce(resolved & (confidence >= least) & (resolved_url != ""), F.lit(False))
    has_chunk = F.coalesce(chunk_url != "", F.lit(False))
    return F.struct(
        F.when(sure, resolved_url).when(has_chunk, chunk_url).otherwise(default).alias("url"),
        F.when(sure, "resolver").when(has_chunk, "chunk").otherwise("default").alias("reason"),
    )
