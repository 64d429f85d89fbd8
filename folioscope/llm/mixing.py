"""Mixing sources to target weights by Poisson replication. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hash_unit, written

#: Highest mean of one Poisson variable; beyond it the list of thresholds would grow and exp(-rate) lose its digits. A higher rate is a sum of such variables.
MAX_RATE = 64.0
#: Thresholds of a rate reach this many repetitions; the chance of more is below 2**-52 for MAX_RATE.
MAX_COPIES = 160
#: Copies of a row made from one array; a row with more gets several arrays, one after another.
COPIES_AT_ONCE = 1 << 16


def _thresholds(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. MAX_COPIES of a Poisson variable, each term made from the one before."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    steps = F.sequence(F.lit(1), F.lit(MAX_COPIES))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(steps, start, step, lambda acc: acc["c"])


def poisson_mix(
    df: DataFrame,
    weights: DataFrame | None = None,
    total: float | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    size: Column | None = None,
    seed: str = "mix-1",
) -> DataFrame:
    """Repeat each row a Poisson number of times, so that the sources reach their target weights, and shuffle all rows.

    size is what is weighed (default: 1 for each row); total is the size aimed at (default: that of df); weights has
    columns source and weight, which are divided by their sum (default: every source the same). The mean rate of a
    source is its share of total divided by its size. A row's count is the Poisson quantile of a number hashed from seed
    and id, hence it does not depend on partitions, order or retries; a rate above MAX_RATE is split into equal
    parts, each with a number of its own, and their counts are added (a sum of Poisson variables is one).

    A null source is a source of its own; sources without a weight, or of no size, get rate 0. Rows with equal ids get
    equal counts; a null id counts as one more id. Returns the columns of df and copy int (from 0), rate double and
    shuffle_key string, replacing columns of these names; rows are dealt over partitions by the key and sorted by it in
    each. Sums of sizes are taken before the shuffle; the join with the sources' rates moves no row where
    their table is small, and else splits a hot source's rows (adaptive skew join).
    """
    base = df.select(*[df[f"`{c}`"] for c in df.columns if c not in ("copy", "rate", "shuffle_key")])
    src = base[f"`{source_col}`"]
    amount = F.lit(1) if size is None else size
    sizes = base.groupBy(src.alias("__s")).agg(F.sum(amount).cast("double").alias("__size"))
    # one row for each source
    if weights is None:
        weighed = sizes.withColumn("__w", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("__g")).agg(F.sum("weight").cast("double").alias("__w"))
        weighed = sizes.join(given, F.col("__s").eqNullSafe(F.col("__g")), "left").drop("__g")
        weighed = weighed.withColumn("__w", F.coalesce("__w", F.lit(0.0)))
    sums = weighed.agg(F.sum("__w").alias("__ws"), F.sum("__size").alias("__all"))
    aim = F.col("__all") if total is None else F.lit(float(total))
    share = F.when((F.col("__size") > 0) & (F.col("__ws") > 0), F.col("__w") / F.col("__ws") * aim / F.col("__size"))
    rates = weighed.crossJoin(F.broadcast(sums)).select("__s", F.coalesce(share, F.lit(0.0)).alias("__rate"))
    rates = rates.withColumn("__parts", F.greatest(F.ceil(F.col("__rate") / MAX_RATE), F.lit(1)).cast("int"))
    rates = rates.withColumn("__cdf", _thresholds(F.col("__rate") / F.col("__parts")))
    # written first, so that its measured size decides between sending it to all rows and moving the rows
    rates = written(rates.withColumn("__cdf", F.slice("__cdf", 1, F.size(F.filter("__cdf", lambda c: c < 1.0)) + 1)), "rates")
    doc = base[f"`{id_col}`"]
    counted = base.withColumn("__u", hash_unit(f"{seed}:count", doc)).join(rates, src.eqNullSafe(F.col("__s")))
    quantile = lambda u: F.size(F.filter("__cdf", lambda c: c <= u))
    others = F.transform(F.sequence(F.lit(1), F.col("__parts") - 1), lambda part: hash_unit(f"{seed}:part", part, doc))
    others = F.aggregate(others, F.lit(0), lambda k, u: k + quantile(u))
    counted = counted.withColumn("__k", quantile(F.col("__u")) + F.when(F.col("__parts") > 1, others).otherwise(0))
    copies = counted.where("__k > 0").withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("__k") - 1, F.lit(COPIES_AT_ONCE))))
    last = F.least(F.col("__k"), F.col("__from") + COPIES_AT_ONCE) - 1
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("__from"), last)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")), "copy"))
    mixed = copies.select(*[F.col(f"`{c}`") for c in base.columns], "copy", F.col("__rate").alias("rate"), key.alias("shuffle_key"))
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
