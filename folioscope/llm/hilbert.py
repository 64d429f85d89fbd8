"""Shards in Hilbert-curve order: quantise metadata, order by the curve, cut runs of equal size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import written

#: Cells of the whole grid at most; the table of curve indices is a literal of that length.
MAX_CELLS = 1 << 16
#: Parts of each cell. Rows of one cell are spread over them by hash before they are numbered, so a cell that holds
#: a third of all rows is numbered by this many tasks.
CELL_PARTS = 256


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of coords (unsigned, below 2**bits, one column for each dimension).

    Gray-code walk from the highest bit plane down: undo the reflection and exchange of axes that each plane
    brought, then read the planes as one Gray code.
    """
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(n):
            here = (x[i] & plane) != 0
            swap = np.where(here, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(here, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        plane >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        flips ^= np.where((x[n - 1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= flips
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_table(n_dims: int, bits: int) -> list[int]:
    """Hilbert index of every grid cell, at the place that has the cell's coordinates as digits."""
    cells = 1 << (n_dims * bits)
    if cells > MAX_CELLS:
        raise ValueError(f"{n_dims} dimensions of {bits} bits make over {MAX_CELLS} cells")
    at = np.arange(cells)
    coords = np.stack([(at >> (bits * (n_dims - 1 - d))) & ((1 << bits) - 1) for d in range(n_dims)], axis=1)
    return hilbert_index(coords, bits).tolist()


def ordered_number(df: DataFrame, name: str) -> Column:
    """A double that keeps the order of a numeric or date column, nulls as the least."""
    c = df[f"`{name}`"]
    if dict(df.dtypes)[name].startswith(("timestamp", "date")):
        c = c.cast("timestamp")
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def string_cuts(df: DataFrame, names: list[str], wanted: list[float]) -> dict[str, list[str]]:
    """The exact quantiles of whole strings, nulls as the least: for each column the distinct values at the wanted shares of all rows.

    Rows are counted by value before the shuffle, values are sorted over ranges, and each range's sum gives the next one's
    start, so no task sees all values; only the cuts come to the driver.
    """
    if not names:
        return {}
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), df[f"`{c}`"].cast("string").alias("value")) for c in names]))
    counts = df.select(values.alias("v")).select("v.*").groupBy("dim", "value").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(F.col("dim"), F.col("value").asc_nulls_first()).select("*", F.spark_partition_id().alias("part"))
    ranged = written(ranged, "string_values")
    sums = ranged.groupBy("dim", "part").agg(F.sum("n").alias("n"))  # one row for each range
    before = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("dim", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("dim")).alias("all"))
    inside = Window.partitionBy("dim", "part").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(starts), ["dim", "part"])
    upto = F.col("start") + F.col("upto")
    marks = F.array(*[F.lit(w) for w in wanted])
    is_cut = F.exists(marks, lambda w: (upto >= w * F.col("all")) & (upto - F.col("n") < w * F.col("all")))
    cuts: dict[str, list[str]] = {c: [] for c in names}
    for r in placed.where(is_cut & F.col("value").isNotNull()).select("dim", "value").collect():  # at most one for each wanted share
        cuts[r.dim].append(r.value)
    return cuts


def hilbert_shards(
    df: DataFrame, dims: tuple[str, ...], id_col: str = "doc_id", n_shards: int = 40, bits: int = 4
) -> DataFrame:
    """Put every row into one of n_shards runs of Hilbert order whose row counts differ by at most one.

    Each dimension is quantised to 2**bits classes of about equal counts, at quantiles over all rows (of strings by their whole
    bytes, of numbers from a sketch); nulls are in the lowest class and NaN in the highest. Rows are ordered by curve index, then by hash part of the id, then by
    id (nulls first); rows that tie in all that are exchangeable. Returns the columns of df and curve int, shard int,
    slot long (place in the shard, gapless from 0), replacing columns of these names. An empty table stays empty.

    Only the columns of df that the caller selected are moved, once. Numbering works by (curve index, hash part):
    counts of these are summed before the shuffle, and the offsets come from at most MAX_CELLS x CELL_PARTS sums.
    """
    base = df.select(*[df[f"`{c}`"] for c in df.columns if c not in ("curve", "shard", "slot")])
    classes = (1 << bits) - 1
    wanted = [(i + 1) / (classes + 1) for i in range(classes)]
    kinds = dict(base.dtypes)
    numbers = {d: ordered_number(base, d) for d in dims if kinds[d] not in ("string", "binary")}
    cuts = string_cuts(base, [d for d in dims if d not in numbers], wanted)
    if numbers:
        sketched = base.select(*[x.alias(f"d{i}") for i, x in enumerate(numbers.values())])
        points = sketched.agg(*[F.percentile_approx(c, wanted, 1000) for c in sketched.columns]).first()  # one row, of bounded size
        cuts |= {d: p or [] for d, p in zip(numbers, points, strict=True)}
    cell = F.lit(0)
    for d in dims:
        x = numbers[d] if d in numbers else base[f"`{d}`"].cast("string")
        above = [F.when(x > F.lit(p), 1).otherwise(0) for p in sorted(set(cuts[d]))]
        cell = cell * (classes + 1) + sum(above, F.lit(0))
    table = F.array(*[F.lit(i) for i in curve_table(len(dims), bits)])
    part = F.pmod(F.xxhash64(F.lit(17), base[f"`{id_col}`"]), F.lit(CELL_PARTS)).cast("int")
    placed = base.withColumns({"__cell": cell, "__part": part})
    offsets = _offsets(placed.groupBy("__cell", "__part").agg(F.count("*").alias("__n")), table)
    inside = Window.partitionBy("__cell", "__part").orderBy(F.col(f"`{id_col}`").asc_nulls_first())
    ranked = placed.withColumn("__rn", F.row_number().over(inside) - 1).join(offsets, ["__cell", "__part"])
    rank = F.col("__before") + F.col("__rn")
    # exact integer arithmetic: shard = rank * n_shards div total; its first rank is ceil(shard * total / n_shards)
    shard = F.expr(f"(__before + __rn) * {n_shards} div __total")
    first = F.expr(f"(((__before + __rn) * {n_shards} div __total) * __total + {n_shards - 1}) div {n_shards}")
    return ranked.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.col("__curve").alias("curve"),
        shard.cast("int").alias("shard"),
        (rank - first).alias("slot"),
    )


def _offsets(counts: DataFrame, table: Column) -> DataFrame:
    """For each (cell, part): its curve index, the rows before it and the rows in all."""
    counts = counts.withColumn("__curve", F.get(table, F.col("__cell")))
    within = Window.partitionBy("__cell").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("__curve").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each cell: at most MAX_CELLS
    cells = counts.groupBy("__cell", "__curve").agg(F.sum("__n").alias("__in"))
    cells = cells.withColumn("__start", F.coalesce(F.sum("__in").over(across), F.lit(0)))
    total = cells.agg(F.sum("__in").alias("__total"))
    cells = cells.crossJoin(F.broadcast(total)).select("__cell", "__start", "__total")
    return counts.join(cells, "__cell").select(
        "__cell", "__part", "__curve", "__total",
        (F.col("__start") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__before"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order, so that file statistics of all dimensions stay narrow."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
