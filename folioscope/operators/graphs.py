"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources.scratch import discard, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph as (node, component), component being the smallest node.

    edges has columns u and v of one type; loops, nulls and repeats are ignored. Nodes without an edge to another node don't
    appear. Large-star and small-star rounds alternate until the edges are stars; every round is written, and the one before it removed.
    Each round only groups and joins on a node, minima are taken before the shuffle, and a node with very many
    edges is left to the adaptive skew join: no neighbourhood is ever gathered.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")
        )
        last, now = now, written(small.union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
