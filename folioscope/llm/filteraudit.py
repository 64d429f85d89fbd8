"""How filters interact: every order of them run as a trie whose states, equal for all orders of a prefix, are computed once."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import new_path, written

#: Filters of one audit at most: the result has n x n! rows for each part.
MAX_FILTERS = 7


def digest(text: Column) -> Column:
    """SHA-256 (binary) of a text; a null text is an empty one. Stands for the text where rows must be compared but not moved."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def later_copies(df: DataFrame, id_col: str, digest_col: str, name: str) -> DataFrame:
    """df (narrow and written once: it is read twice) with the boolean column name: has a smaller id the same digest? A null id is neither smaller nor greater.

    The least id of each digest is found by sums before the shuffle, and meets the rows again by id and digest, so that thousands of copies
    are no hot key. Other columns stay, one called name is replaced.
    """
    one, two = F.col(f"`{id_col}`"), F.col(f"`{digest_col}`")
    leads = df.groupBy(two.alias("__digest")).agg(F.min(one).alias("__id")).withColumn("__lead", F.lit(True))
    joined = df.drop(name).join(leads, (one == F.col("__id")) & (two == F.col("__digest")), "left")
    return joined.withColumn(name, F.col("__lead").isNull() & one.isNotNull()).drop("__lead", "__id", "__digest")


def edge_counts(survivors: DataFrame, names: list[str], tallies: list[str]) -> DataFrame:
    """Run filters over survivors in every order; a row for each part, state (mask: the filters before) and next filter: entered, removed and a removed_ count for each tally.

    survivors has a column part, a boolean column for each filter (true: the row fails it) and one for each tally. From each state the walk goes on
    depth first: its survivors are persisted, one aggregation counts what each remaining filter removes of them, and each filter's
    own survivors follow. A prefix in another order leads to the same rows, so a state that was counted is not entered
    again; 2^n - 1 states stand for all n! orders. At most n states are persisted at once; a lost block is made again from the state before it.
    Parts of which nothing is left have no rows at that state.
    """
    spark = survivors.sparkSession
    path = new_path(spark, "audit")
    full = (1 << len(names)) - 1
    counted: set[int] = set()

    def walk(state: DataFrame, mask: int) -> None:
        counted.add(mask)
        left = [i for i in range(len(names)) if not mask >> i & 1]
        state = state.select("part", *[f"`{names[i]}`" for i in left], *[f"`{t}`" for t in tallies]).persist()
        counts = [F.count("*").alias("entered")]
        for i in left:
            counts.append(F.count_if(F.col(f"`{names[i]}`")).alias(f"removed {i}"))
            counts += [F.count_if(F.col(f"`{names[i]}`") & F.col(f"`{t}`")).alias(f"removed {i} {j}") for j, t in enumerate(tallies)]
        edges = F.array(*[
            F.struct(F.lit(i).alias("filter"), F.col(f"removed {i}").alias("removed"), *[F.col(f"removed {i} {j}").alias(f"removed_{t}") for j, t in enumerate(tallies)])
            for i in left
        ])
        rows = state.groupBy("part").agg(*counts).select("part", F.lit(mask).alias("mask"), "entered", F.inline(edges))
        rows.coalesce(1).write.mode("append").parquet(path)  # a few rows for each part
        for i in left:
            after = mask | 1 << i
            if after != full and after not in counted:
                walk(state.where(~F.col(f"`{names[i]}`")), after)
        state.unpersist()

    walk(survivors, 0)
    return spark.read.parquet(path)


def audit(df: DataFrame, part: Column, filters: dict[str, Column], tallies: dict[str, Column]) -> DataFrame:
    """Audit filters over all rows of df: a row for each part, order of the filters and step in it.

    filters: name and the condition on which a row fails; tallies: name and the condition of rows to count among the removed. Null conditions
    are false, a null part is the empty string. Conditions are judged once for each row; rows are told from each other by
    nothing, so repeats and ties count each. An empty table has no parts and no rows.

    Returns part, filter_order (the names together), step (from 1), filter, and as long: kept (after this step), removed (here), redundant (failing
    the filter, removed earlier), unique_fails (failing this filter alone), <tally>_lost (of the removed), and shapley (the filter's
    removed, added up over all orders).
    """
    names, n = list(filters), len(filters)
    if not 0 < n <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters")
    judged = {k: F.coalesce(v, F.lit(False)) for k, v in {**filters, **{f"tally {t}": c for t, c in tallies.items()}}.items()}
    base = written(df.select(F.coalesce(part, F.lit("")).alias("part"), *[v.alias(k) for k, v in judged.items()]), "audited")
    edges = edge_counts(base, names, [f"tally {t}" for t in tallies])
    # each edge lies on the paths of so many orders
    size = F.bit_count("mask")
    paths = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), size + 1)
    alone = F.element_at(F.array(*[F.lit((1 << n) - 1 - (1 << i)) for i in range(n)]), F.col("filter") + 1)
    totals = edges.groupBy("part", "filter").agg(
        F.max(F.when(F.col("mask") == 0, F.col("removed"))).alias("failing"),
        F.coalesce(F.max(F.when(F.col("mask") == alone, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * paths).alias("shapley"),
    )
    steps = []
    for order in permutations(range(n)):
        label, mask = "".join(names[i] for i in order), 0
        for at, i in enumerate(order, 1):
            steps.append((label, at, i, mask))
            mask |= 1 << i
    table = df.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, mask int")
    every = totals.join(F.broadcast(table), "filter")  # n x n! rows at most, whatever df has
    out = every.join(edges, ["part", "mask", "filter"], "left")

    def count(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long")

    return out.select(
        "part", "filter_order", "step",
        F.element_at(F.array(*[F.lit(x) for x in names]), F.col("filter") + 1).alias("filter"),
        (count("entered") - count("removed")).alias("kept"), count("removed").alias("removed"),
        (F.col("failing") - count("removed")).alias("redundant"), "unique_fails",
        *[count(f"removed_tally {t}").alias(f"{t}_lost") for t in tallies], "shapley",
    )
