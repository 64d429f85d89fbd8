"""A clustered vector index: packs of vectors in cells around centroids, and exact top k that skips cells by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.keyword import top_k
from folioscope.operators.vectors import _unit, best_of
from folioscope.sources import scratch

#: Cells at most, numbers in the sample that centroids are fitted on (8 MB), and rounds of fitting. Every row is indexed, whatever the sample.
MAX_CELLS, SAMPLE_VALUES, FIT_ROUNDS = 4096, 1 << 20, 6
#: Vectors in a pack, and questions that meet a pack at once.
PACK, ASKED = 500, 500
#: Cells that each question reads before it knows how good a hit must be.
PROBES = 2
#: Bounds are widened by this: scores are rounded to 6 places.
SLACK = 1e-5


@dataclass(frozen=True)
class Cells:
    """packs(cell, scope, ids, vecs): vecs has the vectors of ids one after the other; dead (optional): ids that don't count.
    reach(cell, scope, n, radius): for each scope in a cell how many vectors and how far the farthest is from the centroid. centroids: unit vectors.
    """

    packs: DataFrame
    reach: DataFrame
    centroids: np.ndarray


def fit_centroids(vectors: DataFrame, vec_col: str = "v", id_col: str = "id") -> np.ndarray:
    """About sqrt(n) centroids (MAX_CELLS at most), fitted to the vectors of least id hash, of SAMPLE_VALUES numbers in all. An empty table gives none."""
    usable = vectors.where(F.size(vec_col) > 0)
    n, dim = usable.agg(F.count("*"), F.max(F.size(vec_col))).first()
    if not n:
        return np.zeros((0, 0))
    rows = usable.where(F.size(vec_col) == dim).orderBy(F.xxhash64(F.col(id_col)), id_col).select(vec_col).limit(max(1, SAMPLE_VALUES // dim)).collect()
    sample = _unit(np.array([r[0] for r in rows], np.float64), len(rows))
    k = int(min(MAX_CELLS, len(sample), max(1, round(n**0.5))))
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        owner = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    return centroids


def _distances(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (unit * unit).sum(axis=1)[:, None] - 2 * (unit @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def pack_cells(vectors: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(packs, reach) of vectors(id, v, scope), packs numbered by slab in their cell and scope, every one in the cell of its nearest centroid; rows whose vector is null or of another length than the centroids are left out.

    A cell's vectors of one scope are dealt over packs by the hash of the id, so copies that fill a cell are many packs, and none is larger
    than about PACK. Rows of packs lie in the order of the cells, so that a reader skips row groups by cell.
    """
    dim = centroids.shape[1] if len(centroids) else -1
    kinds = dict(vectors.dtypes)
    rows = vectors.where(F.size("v") == dim).select("id", "v", F.col("scope").cast("string").alias("scope"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _distances(_unit(batch.column(1).flatten().to_numpy(zero_copy_only=False), len(batch)), centroids)
            cell = gap.argmin(axis=1)
            far = gap[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "scope", "cell", "far"])

    placed = scratch.written(rows.mapInArrow(place, f"id {kinds['id']}, v {kinds['v']}, scope string, cell int, far double"), "placed")
    reach = placed.groupBy("cell", "scope").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    parts = reach.select(F.col("cell").alias("c"), F.col("scope").alias("s"), F.ceil(F.col("n") / PACK).cast("int").alias("parts"))
    dealt = placed.join(parts, (F.col("cell") == F.col("c")) & F.col("scope").eqNullSafe(F.col("s")))
    dealt = dealt.withColumn("slab", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = dealt.repartitionByRange("cell", "scope", "slab").groupBy("cell", "scope", "slab").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows"))
    packs = packed.select("cell", "scope", "slab", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vecs"))
    return packs.sortWithinPartitions("cell", "scope"), reach


def unpack(packs: DataFrame) -> DataFrame:
    """(id, v, scope) again, without dead ids."""
    dim = (F.size("vecs") / F.size("ids")).cast("int")
    rows = packs.select("*", F.posexplode("ids").alias("i", "id"))
    if "dead" in packs.columns:
        rows = rows.where(F.col("dead").isNull() | ~F.array_contains("dead", F.col("id")))
    return rows.select("id", F.slice("vecs", F.col("i") * dim + 1, dim).alias("v"), "scope")


def search(spark: SparkSession, index: Cells, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of highest cosine for each of questions(query_id, v, scope), exact; rounded to 6 places, ties by id.

    A null scope asks for all vectors, another for those of its own: it meets only cells that have the scope, with the radius of the scope there.
    A vector in a cell of radius r, whose centroid is g from the question's unit vector, is at least g - r away, so its cosine is at most 1 - (g - r)^2 / 2.
    Each question first reads its most promising cells, PROBES and as many as hold k vectors; then only cells whose bound reaches its k-th score so
    far. Questions and packs meet by cell, in groups of ASKED questions; which side moves is left to the join, by size.
    Null vectors, or of another length, find nothing; a vector of zeros has cosine 0 to all.
    """
    asked = questions.where(F.size("v") == (index.centroids.shape[1] if len(index.centroids) else -1))
    asked = scratch.written(asked.select("query_id", F.col("v").cast("array<double>").alias("v"), F.col("scope").cast("string").alias("scope")), "questions")
    pairs = scratch.written(_candidates(spark, index, asked, k), "cell_pairs")
    first = scratch.written(top_k(_scored(index, asked, pairs.where("probe"), k), k), "probed")
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("least"))
    more = pairs.where("NOT probe").join(reached, F.col("query_id") == F.col("q"), "left")
    more = more.where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("query_id", "cell")
    rest = _scored(index, asked, scratch.written(more, "cell_pairs"), k)
    return top_k(first.select("query_id", "id", "score").union(rest), k)


def _candidates(spark: SparkSession, index: Cells, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, cell, upper, probe) for every question and each cell that has vectors of its scope; at most MAX_CELLS for a question."""
    totals = index.reach.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy("cell").collect()  # at most MAX_CELLS
    everything = [np.array([t[c] for t in totals]) for c in ("cell", "n", "radius")]
    of = index.reach.where("scope IS NOT NULL").groupBy("cell", "scope").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    scopes = of.groupBy("scope").agg(*[F.collect_list(c).alias(c) for c in ("cell", "n", "radius")])  # at most MAX_CELLS in a row
    rows = asked.join(scopes, "scope", "left").select("query_id", "v", F.col("scope").isNull().alias("open"), "cell", "n", "radius")
    shared = spark.sparkContext.broadcast(index.centroids)
    kind = dict(asked.dtypes)["query_id"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            gaps = _distances(_unit(batch.column(1).flatten().to_numpy(zero_copy_only=False), len(batch)), shared.value)
            for i, open_ in enumerate(batch.column(2).to_pylist()):
                own = everything if open_ else [np.array(batch.column(c)[i].as_py() or []) for c in (3, 4, 5)]
                cell, n, radius = own[0].astype(np.int64), own[1].astype(np.int64), own[2].astype(np.float64)
                upper = 1 - np.maximum(gaps[i][cell] - radius, 0) ** 2 / 2 + SLACK
                order = np.lexsort((gaps[i][cell], -upper))
                before = np.concatenate([[0], np.cumsum(n[order])])[:-1]
                probe = (before < k) | (np.arange(len(order)) < PROBES)
                of = batch.column(0).take(pa.array(np.full(len(order), i)))
                yield pa.RecordBatch.from_arrays([of, pa.array(cell[order].astype(np.int32)), pa.array(upper[order]), pa.array(probe)], names=["query_id", "cell", "upper", "probe"])

    return rows.mapInArrow(pair, f"query_id {kind}, cell int, upper double, probe boolean")


def _scored(index: Cells, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of each pack for each question that the pairs send to the pack's cell."""
    met = pairs.select("query_id", "cell").join(asked, "query_id")
    sizes = met.groupBy("cell", "scope").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    met = met.join(sizes.withColumnsRenamed({"cell": "c", "scope": "s"}), (F.col("cell") == F.col("c")) & F.col("scope").eqNullSafe(F.col("s")))
    met = met.groupBy("cell", F.col("scope").alias("wanted"), F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    dead = F.col("dead") if "dead" in index.packs.columns else F.array().cast(f"{dict(index.packs.dtypes)['ids']}")
    packs = index.packs.select("cell", "scope", "ids", "vecs", dead.alias("dead"))
    both = packs.join(met, "cell").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("scope")))
    both = both.select("ids", "vecs", "dead", F.col("asked.query_id").alias("qids"), F.flatten("asked.v").alias("qvecs"))
    ids, qids = dict(both.dtypes)["ids"][6:-1], dict(both.dtypes)["qids"][6:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held, q = batch.column(0)[i].values, batch.column(3)[i].values
                d = _unit(batch.column(1)[i].values.to_numpy(zero_copy_only=False), len(held))
                gone = set(batch.column(2)[i].as_py() or [])
                if gone:
                    alive = np.array([x not in gone for x in held.to_pylist()], bool)
                    d, held = d[alive], held.filter(pa.array(alive))
                if not len(held):
                    continue
                scores = np.round(_unit(batch.column(4)[i].values.to_numpy(zero_copy_only=False), len(q)) @ d.T, 6)
                row, col, best = best_of(scores, np.arange(len(held)), k)  # a pack's ids are in order, so their places stand for them
                yield pa.RecordBatch.from_arrays([q.take(pa.array(row)), held.take(pa.array(col)), pa.array(best)], names=["query_id", "id", "score"])

    return both.mapInArrow(score, f"query_id {qids}, id {ids}, score double")
