"""Centroid clustering by delta Lloyd rounds on integer vectors: kept assignments, kept sums, and only what changed is compared or added."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bound_arrow_batches, discard, written

#: Components beyond this would let a squared distance of 64 dimensions overflow a long; such vectors are not kept.
MAX_COMPONENT = 1 << 27
#: Distances held at once: rows of a batch are taken in blocks of so many over the number of centroids.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Clustering:
    """rows: the kept vectors with q (their integers), cluster int and distance long; centroids: the final ones (k x dim numbers)."""

    rows: DataFrame
    centroids: list[list[int]]


def integer_vectors(df: DataFrame, vec_col: str, dim: int, scale: int) -> DataFrame:
    """df with q, the floors of scale times each component as double; only rows whose vector has dim components, none null or non-finite,
    and none that floors beyond MAX_COMPONENT. A column q of df is replaced.
    """
    vec = F.col(f"`{vec_col}`")
    top = float(MAX_COMPONENT) / scale

    def fits(x: Column) -> Column:  # NaN is above all numbers, so it fails too
        return x.isNotNull() & (F.abs(x.cast("double")) <= top)

    # coalesce: a null vector has no size
    kept = df.where(F.coalesce((F.size(vec) == dim) & F.forall(vec, fits), F.lit(False)))
    return kept.withColumn("q", F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def squared_distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (long) of each row of q to each row of centroids: in doubles while every sum is an integer below 2^53, else in longs."""
    q, c = q.astype(np.int64), centroids.astype(np.int64)
    reach = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * reach * reach * q.shape[1] < 1 << 53:
        x, y = q.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(q), len(c)), np.int64)
    for j, row in enumerate(c):
        gap = q - row
        out[:, j] = (gap * gap).sum(axis=1)
    return out


def reassign(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after some centroids changed (changed: a flag for each). Ties go to the smaller number.

    A vector whose owner stays where it was keeps its distance and is held against the changed centroids only; one whose owner
    moved, or that has none yet (-1), against all.
    """
    owner, distance = owner.copy(), distance.copy()
    lost = np.ones(len(q), bool)
    lost[owner >= 0] = changed[owner[owner >= 0]]
    everyone, some = np.arange(len(centroids)), np.flatnonzero(changed)
    for rows, numbers, keep in ((np.flatnonzero(lost), everyone, False), (np.flatnonzero(~lost), some, True)):
        if not len(numbers):
            continue
        step = max(1, BLOCK // len(numbers))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            d = squared_distances(q[r], centroids[numbers])
            best = d.argmin(axis=1)  # the first of equals
            d, c = d[np.arange(len(r)), best], numbers[best]
            take = (d < distance[r]) | ((d == distance[r]) & (c < owner[r])) if keep else np.ones(len(r), bool)
            owner[r[take]], distance[r[take]] = c[take], d[take]
    return owner, distance


def _round(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The next state: owner and distance anew, was = the owner before."""
    names = state.columns
    at = {c: names.index(c) for c in ("q", "owner", "was", "distance")}
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            q = columns[at["q"]].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            before = columns[at["owner"]].to_numpy(zero_copy_only=False)
            owner, distance = reassign(q, before, columns[at["distance"]].to_numpy(zero_copy_only=False), centroids, changed)
            columns[at["was"]] = columns[at["owner"]]
            columns[at["owner"]] = pa.array(owner, pa.int32())
            columns[at["distance"]] = pa.array(distance, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return state.mapInArrow(run, state.schema)


def _transfers(state: DataFrame, kind: str) -> list:
    """What the vectors that changed owner bring to the new one and take from the old one: signed sums by centroid and dimension.

    Summed before the shuffle; at most k x dim rows come back.
    """
    ends = F.array(F.struct(F.col("owner").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    moved = state.where("owner <> was").select("q", F.explode(ends).alias("e")).where("e.c >= 0")
    each = moved.select("e.c", "e.sign", F.posexplode("q").alias("i", "x"))
    return each.groupBy("c", "i").agg(F.sum(F.col("sign") * F.col("x").cast(kind)).alias("x"), F.sum("sign").alias("n")).collect()


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Lloyd's algorithm on integer vectors, exactly: `rounds` times assign all and move every centroid to the floor of its vectors' mean, then assign once more.

    Kept are vectors of dim components, none null, non-finite or beyond MAX_COMPONENT / scale; a null label or other column plays no part.
    The first centroids are the k kept vectors whose ids have the least sha256 with the seed before them (ids that repeat: the least vector first;
    null ids last); fewer vectors give fewer centroids, and an empty table gives none. Ties between centroids go to the smaller number, so of
    equal centroids only the first has vectors; one without vectors stays where it is. Repeated rows count each.

    Every round reads the state before it and writes its own (vector, owner, distance) to the shared folder. The sums of all clusters stay
    with the driver (k x dim integers) and change by the signed sums of vectors that changed owner. Nothing is shuffled but these.
    Rounds end early once no centroid changes. Columns of df stay, those named q, owner, was or distance give way.
    """
    bound_arrow_batches(df.sparkSession)
    clean = df.drop(*[c for c in ("q", "owner", "was", "distance") if c not in (id_col, vec_col)])
    start = integer_vectors(clean, vec_col, dim, scale).drop(*[c for c in (vec_col,) if c != id_col])
    none = {"owner": F.lit(-1), "was": F.lit(-1), "distance": F.lit(-1).cast("long")}
    state = written(start.withColumns(none), "lloyd")
    mark = F.sha2(F.concat(F.lit(seed), F.col(f"`{id_col}`").cast("string")).cast("binary"), 256)
    first = state.select("q", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return Clustering(state.select(*start.columns, F.col("owner").alias("cluster"), "distance"), [])
    n, reach = state.agg(F.count("*"), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()
    kind = "long" if n * reach < 1 << 62 else "decimal(38,0)"
    centroids = np.array([r.q for r in first], np.int64)
    sums, counts = [[0] * dim for _ in first], [0] * len(first)
    changed = np.ones(len(first), bool)
    for i in range(rounds + 1):
        last, state = state, written(_round(state, centroids, changed), "lloyd")
        discard(last)
        if i == rounds:
            break
        gone: dict[int, int] = {}
        for t in _transfers(state, kind):
            sums[t.c][t.i] += int(t.x)
            gone[t.c] = int(t.n)
        for c, m in gone.items():
            counts[c] += m
        after = centroids.copy()
        for c in gone:
            if counts[c]:
                after[c] = [s // counts[c] for s in sums[c]]
        changed = (after != centroids).any(axis=1)
        centroids = after
        if not changed.any():
            break
    return Clustering(state.select(*start.columns, F.col("owner").alias("cluster"), "distance"), centroids.tolist())


def with_inertia(found: Clustering) -> DataFrame:
    """rows with cluster_inertia, inertia (sums of distance over the cluster and over all) and centroid_sha256, from one row for each centroid."""
    spark = found.rows.sparkSession
    sums = {r.cluster: int(r.s) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    table = spark.createDataFrame([(c, sums[c], marks[c]) for c in sums], "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(table), "cluster").withColumn("inertia", F.lit(sum(sums.values())).cast("long"))
