"""Near-duplicate embeddings by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bound_arrow_batches, components, written

#: Dimensions of a block, and of the grid in it that deals out the work: two, and one more for each GRID_STEP-fold of a label's vectors beyond GRID_FROM.
BLOCK_DIMS, GRID_DIMS = 8, 2
GRID_FROM, GRID_STEP = 100_000, 3
#: Side of a grid's cells, in radii.
WIDTH = 2
#: Vectors on one side of a task. A cell with more is cut into parts, and a task takes a pair of parts.
MAX_SIDE = 3000
#: Pairs of one cell of the finer grid that are tested at once.
MAX_PAIRS = 1 << 18
#: Budgets are widened by this against rounding; exact checks follow.
SLACK = 1e-6


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=64)
def blocks(dim: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first, end, squared budget) of each block; the budgets are in proportion to the dimensions and add up to the
    squared distance of unit vectors whose cosine is the threshold. A pair within it is within budget in some block.
    """
    total = 2 - 2 * threshold
    cuts = list(range(0, dim, BLOCK_DIMS)) + [dim]
    return [(a, b, total * (b - a) / dim * (1 + SLACK) + 1e-12) for a, b in zip(cuts, cuts[1:], strict=False)]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _corners(y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest grid cell, in each dimension, that the box of half a radius around each vector touches: the same or the next."""
    width = WIDTH * radius
    return np.floor((y - radius / 2) / width).astype(np.int64), np.floor((y + radius / 2) / width).astype(np.int64)


def _code(cells: np.ndarray) -> np.ndarray:
    """A number for each row of cell coordinates (below 2**30 in absolute value for two, spread by multiplication for more)."""
    out = np.zeros(len(cells), np.int64)
    for d in range(cells.shape[1]):
        out = out * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) + cells[:, d]
    return out


def _touched(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code of a cell) for all cells that each row's box touches; a dimension is doubled only for the rows that cross a border in it."""
    rows, cells = np.arange(len(low)), low.copy()
    for d in range(low.shape[1]):
        more = np.flatnonzero(high[rows, d] > cells[:, d])
        beyond = cells[more].copy()
        beyond[:, d] = high[rows[more], d]
        rows, cells = np.concatenate([rows, rows[more]]), np.concatenate([cells, beyond])
    return rows, _code(cells)


def near_in_block(z: np.ndarray, radius: float, left: np.ndarray, right: np.ndarray, dealt: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(i, j, pairs tested): pairs of rows of z, one of left and one of right, within the radius; each pair once, with i < j where both sides are the same.

    A grid over the dimensions that the rows were not dealt by: two rows within the radius have boxes that meet, and the pair belongs to the one cell that holds the low
    corner of what both touch. Only pairs that share a cell are tested.
    """
    low, high = _corners(z[:, dealt:], radius)
    side = np.zeros(len(z), np.int8)
    side[left] |= 1
    side[right] |= 2
    same = bool((side == 3).any())
    rows, code = _touched(low, high)
    order = np.lexsort((rows, code))
    rows, code = rows[order], code[order]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    size = np.diff(np.append(start, len(code)))
    crowd = size > 1
    start, size = start[crowd], size[crowd]
    # cells of few rows together, up to MAX_PAIRS pairs at once; a larger cell in blocks of its rows
    work = size * size
    at = 0
    while at < len(start):
        if work[at] > MAX_PAIRS:
            members = rows[start[at] : start[at] + size[at]]
            step = max(1, MAX_PAIRS // size[at])
            for a in range(0, size[at], step):
                i = np.repeat(members[a : a + step], size[at])
                yield _tested(z, radius, low, code[start[at]], i, np.tile(members, len(members[a : a + step])), side, same)
            at += 1
            continue
        upto = at + max(1, int(np.searchsorted(np.cumsum(work[at:]), MAX_PAIRS, side="right")))
        some = work[at:upto] <= MAX_PAIRS
        upto = at + int(np.argmin(some)) if not some.all() else upto
        n, first = size[at:upto], start[at:upto]
        which = np.repeat(np.arange(len(n)), n * n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
        i, j = rows[first[which] + inside // n[which]], rows[first[which] + inside % n[which]]
        yield _tested(z, radius, low, code[first][which], i, j, side, same)
        at = upto


def _tested(z, radius, low, code, i, j, side, same):
    ok = (i < j) if same else ((side[i] & 1) > 0) & ((side[j] & 2) > 0)
    code = code[ok] if np.ndim(code) else code
    i, j = i[ok], j[ok]
    tested = len(i)
    ok = ((z[i] - z[j]) ** 2).sum(axis=1) <= radius * radius + 1e-9
    code = code[ok] if np.ndim(code) else code
    i, j = i[ok], j[ok]
    ok = _code(np.maximum(low[i], low[j])) == code if len(i) else np.zeros(0, bool)
    return i[ok], j[ok], tested


def near_duplicates(
    df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Link vectors of equal non-null label and length whose cosine, in double precision, is at least threshold.

    Returns id_col, n_links long (other rows linked), component_id long (least id reachable) and kept boolean (it is
    the row's own). Rows with null label, null id, or a vector that is null, zero or has null or non-finite components link
    with nothing (n_links 0, component their id); an empty table stays empty; other columns are ignored.

    Equal vectors are one representative with a count, so copies are never paired. Rows with equal ids and other vectors are rows of their own, with links and
    a component of their own. Unit vectors are rotated and split into
    blocks; each block is range-joined under its budget: a grid of its first dimensions, more of them for labels of more vectors, deals vectors to tasks, and
    a finer one of all its dimensions picks the pairs there. A pair belongs to the one cell that holds the low
    corner of both boxes; the full cosine is computed at once, and a pair counts in the first block within budget, which is
    the union of the blocks' candidates without gathering pairs. Tasks give link counts and a spanning forest,
    not pairs. Vectors are dealt once, as places without the vectors themselves; a crowded cell is cut into parts, and each pair of parts is a task, whatever its size.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").alias("vec"))
    rows = rows.withColumn("ok", usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    key = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(3), "vec").alias("h2")]
    good = rows.where("ok").select("id", "label", *key, "vec")
    reps = written(
        good.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec")).withColumn("no", F.monotonically_increasing_id()),
        "vectors",
    )
    sizes = reps.groupBy("label").agg(F.count("*").alias("n"))  # one row for each label
    grown = F.ceil(F.log(F.col("n") / GRID_FROM) / F.log(F.lit(float(GRID_STEP))))
    grid = F.least(F.lit(BLOCK_DIMS), F.lit(GRID_DIMS) + F.greatest(F.lit(0), grown)).cast("int")
    sized = reps.join(sizes.select("label", grid.alias("grid")), "label")
    dealt = written(
        sized.select("label", "no", "grid", "vec").mapInArrow(_deal(threshold), "label string, dim int, grid int, block int, cell long, no long"), "vector_places"
    )
    place = ["label", "dim", "grid", "block", "cell"]
    crowded = dealt.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowded = crowded.select(*place, F.ceil(F.col("n") / MAX_SIDE).cast("int").alias("parts"))
    parted = dealt.join(crowded, place).withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parted = parted.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("parts", "other")
    parted = parted.join(reps.select("no", "mult", "vec"), "no")
    found = written(
        parted.groupBy(*place, "a", "b").applyInArrow(_link(threshold), "no long, links long, root long"), "vector_links"
    )
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("no").alias("u"), F.col("root").alias("v")))
    known = reps.select("label", "h1", "h2", "no", "rep", "mult").join(links, "no", "left").join(groups, F.col("no") == F.col("node"), "left")
    least = known.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    known = known.join(least, "component", "left")
    known = known.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("least", "rep").alias("c"))
    all_rows = rows.select("id", F.when(F.col("ok"), F.col("label")).alias("label"), *key)
    # a row that links with nothing meets no representative, as its label is null here
    joined = all_rows.join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("c", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _deal(threshold: float):
    def run(batches):
        for batch in batches:
            sizes, grids = np.diff(batch.column(3).offsets.to_numpy()), batch.column(2).to_numpy()
            for dim, grid in np.unique(np.column_stack([sizes, grids]), axis=0).tolist():
                some = batch.take(pa.array(np.flatnonzero((sizes == dim) & (grids == grid))))
                y = unit(_matrix(some.column(3))) @ rotation(dim)
                for i, (first, end, budget) in enumerate(blocks(dim, threshold)):
                    dims, radius = min(grid, end - first), budget**0.5
                    rows, cell = _touched(*_corners(y[:, first : first + dims], radius))
                    head, n = some.take(pa.array(rows)), len(rows)
                    same = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [head.column(0), same(dim), same(grid), same(i), pa.array(cell), head.column(1)], names=["label", "dim", "grid", "block", "cell", "no"]
                    )

    return run


def _link(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        dim, grid, number, cell = (group.column(c)[0].as_py() for c in ("dim", "grid", "block", "cell"))
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        rep, mult, part = (group.column(c).to_numpy() for c in ("no", "mult", "part"))
        x = unit(_matrix(group.column("vec")))
        y = x @ rotation(dim)
        layout = blocks(dim, threshold)
        first, end, budget = layout[number]
        dims, radius = min(grid, end - first), budget**0.5
        corner, _ = _corners(y[:, first : first + dims], radius)
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j, _ in near_in_block(y[:, first:end], radius, np.flatnonzero(part == a), np.flatnonzero(part == b), dims):
            # the pair belongs to the task of the low corner that both boxes have in common
            own = _code(np.maximum(corner[i], corner[j])) == cell if len(i) else np.zeros(0, bool)
            i, j = i[own], j[own]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                ok = (x[u] * x[v]).sum(axis=1) >= threshold
                u, v = u[ok], v[ok]
                gap = (y[u] - y[v]) ** 2
                ok = gap[:, first:end].sum(axis=1) <= budget
                for f, e, limit in layout[:number]:
                    ok &= gap[:, f:e].sum(axis=1) > limit
                u, v = u[ok], v[ok]
                np.add.at(links, u, mult[v])
                np.add.at(links, v, mult[u])
                while True:
                    low = np.minimum(label[u], label[v])
                    if (low == label[u]).all() and (low == label[v]).all():
                        break
                    np.minimum.at(label, u, low)
                    np.minimum.at(label, v, low)
        while (label[label] != label).any():
            label = label[label]
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        some = np.flatnonzero(links > 0)
        return pa.table({"no": rep[some], "links": links[some], "root": least[label[some]]})

    return run
