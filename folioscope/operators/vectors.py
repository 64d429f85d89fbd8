"""The vector channel: hashed-token embeddings and exact cosine top k in blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.functions import text as X
from folioscope.operators.keyword import _first, top_k
from folioscope.sources import scratch

#: Fixed values of the hashed embedding: dimensions, bytes used of each digest, and how far its sign byte is.
DIM, BYTES, SHIFT = 384, 16, 7
#: Vectors in a block; a pair of blocks is one matrix product.
BLOCK = 1000
#: Numbers of all query vectors that are broadcast at most (32 MB).
SHARED_VALUES = 1 << 22
#: Tokens that a task digests at once.
STEP = 1 << 16
_TOKEN = re.compile(b"[a-z0-9%]+")


def hash_embedding(df: DataFrame, id_col: str, text_col: str, model: str, positional: bool = True, dim: int = DIM) -> DataFrame:
    """Sparse (id, idx, value) of length 1: each token's SHA-256 adds +1 or -1 at BYTES places.

    positional: the digest also has the token's place, so that equal words at other places differ. A text without tokens is
    one token '_empty_'. JVM-side: the text's tokens are exploded, and sums are taken before the shuffle.
    """
    toks = F.regexp_extract_all(F.lower(X.text_of(F.col(text_col))), F.lit("[a-z0-9%]+"), F.lit(0))
    toks = F.when(F.size(toks) == 0, F.array(F.lit("_empty_"))).otherwise(toks)
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(toks).alias("i", "tok"))
    key = F.concat_ws(":", F.lit(model), *([F.col("i").cast("string")] if positional else []), F.col("tok"))
    rows = rows.select("id", F.unhex(F.sha2(key.cast("binary"), 256)).alias("d"))

    def byte(i: Column) -> Column:
        return F.conv(F.hex(F.substring(F.col("d"), i + 1, F.lit(1))), 16, 10).cast("int")

    rows = rows.select("id", "d", F.explode(F.sequence(F.lit(0), F.lit(BYTES - 1))).alias("b"))
    sign = F.when(byte((F.col("b") + SHIFT) % 32) % 2 == 0, 1.0).otherwise(-1.0)
    sums = rows.select("id", (byte(F.col("b")) % dim).alias("idx"), sign.alias("s")).groupBy("id", "idx").agg(F.sum("s").alias("v"))
    norms = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    value = F.when(F.col("norm") == 0, 0.0).otherwise(F.col("v") / F.col("norm"))
    return sums.where("v <> 0").join(norms, "id").select("id", "idx", value.alias("value"))


class Digests:
    """Dense positional embeddings of lower-cased texts, as of hash_embedding, for one task."""

    def __init__(self, model: str) -> None:
        self.model = model
        self.heads: list[bytes] = []

    def of(self, texts: list[str]) -> np.ndarray:
        """A row for each text, of length 1, or of zeros where all sums are 0. Beside the rows, memory is that of a text's tokens and of STEP digests."""
        out = np.zeros((len(texts), DIM))
        for i, text in enumerate(texts):
            toks = _TOKEN.findall(text.encode()) or [b"_empty_"]
            self.heads += [b"%s:%d:" % (self.model.encode(), n) for n in range(len(self.heads), len(toks))]
            sums = np.zeros(512, np.int64)
            for at in range(0, len(toks), STEP):
                raw = b"".join([sha256(h + t).digest() for h, t in zip(self.heads[at : at + STEP], toks[at : at + STEP], strict=False)])
                d = np.frombuffer(raw, np.uint8).reshape(-1, 32)
                # the places of digests are below 256; those to subtract are counted 256 later
                place = d[:, :BYTES].astype(np.int64) | (d[:, SHIFT : SHIFT + BYTES] & 1).astype(np.int64) << 8
                sums += np.bincount(place.ravel(), minlength=512)
            out[i, :256] = sums[:256] - sums[256:]
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm == 0, 1.0, norm)


def lists(m: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def dense_embedding(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, v): what dense(hash_embedding(...)) gives, in one pass over the texts and without a shuffle."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Digests(model)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(made.of(part.column(1).to_pylist()))], names=["id", "v"])

    rows = df.select(F.col(id_col).alias("id"), F.lower(X.text_of(F.col(text_col))).alias("low"))
    return rows.mapInArrow(run, f"id {kind}, v array<double>")


def dense(sparse: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, v) with all dim numbers of sparse rows (id, idx, value)."""
    at = F.map_from_entries(F.collect_list(F.struct("idx", "value")))
    rows = sparse.groupBy("id").agg(at.alias("m"))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0))).alias("v"))


def cosine(a: Column, b: Column) -> Column:
    """JVM-side, for few pairs: 0 if one is zero; null if lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    scale = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(scale == 0, 0.0).otherwise(dot / scale))


def _blocks(df: DataFrame, id_col: str, vec_col: str, name: str, key: str | None) -> DataFrame:
    """Rows of about BLOCK vectors, none of another key: (key, ids, vecs)."""
    rows = df.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("v"), (F.col(key) if key else F.lit(0)).cast("string").alias("key")
    )
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = rows.groupBy("key", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return packed.select(F.col("key"), F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_vecs"))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k highest scores of each row, ties by id: only scores that reach a row's k-th highest are sorted."""
    m = scores.shape[1]
    least = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero(scores >= least[:, None])
    return _first(row, ids[col], scores[row, col], k)


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    m = flat.reshape(n, -1).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _hits(query_id: np.ndarray, ids: np.ndarray, scores: np.ndarray, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    """Rows (query_id, id, score) with ids of the tables' own types."""
    return pa.RecordBatch.from_arrays([pa.array(query_id).cast(kinds[0]), pa.array(ids).cast(kinds[1]), pa.array(scores)], names=["query_id", "id", "score"])


def _scan(queries: list[tuple], k: int, kinds: tuple[pa.DataType, pa.DataType]):
    """A task's pass over (id, key, v) that keeps the best k vectors of each query."""
    groups: dict[tuple[str, int], list[tuple]] = {}
    for q in queries:
        groups.setdefault((q[2], len(q[1])), []).append(q)
    asked = {g: (np.array([q[0] for q in qs]), _unit(np.array([q[1] for q in qs]), len(qs))) for g, qs in groups.items() if g[1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], tuple] = {}
        for batch in batches:
            keys, sizes = batch.column(1).to_numpy(zero_copy_only=False), np.diff(batch.column(2).offsets.to_numpy())
            for (key, dim), (_, q) in asked.items():
                some = np.flatnonzero((keys == key) & (sizes == dim))
                for at in range(0, len(some), BLOCK):
                    part = batch.take(pa.array(some[at : at + BLOCK]))
                    d = _unit(part.column(2).flatten().to_numpy(zero_copy_only=False), len(part))
                    new = best_of(np.round(q @ d.T, 6), np.array(part.column(0).to_pylist()), k)
                    old = best.get((key, dim))
                    best[key, dim] = _first(*(np.concatenate(x) for x in zip(old, new, strict=True)), k) if old else new
        for g, (row, ids, scores) in best.items():
            yield _hits(asked[g][0][row], ids, scores, kinds)

    return run


def cosine_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id",
    query_vec: str = "query_vec", key: str | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of highest cosine for each query, exact; score rounded to 6 places, ties by id.

    Queries of up to SHARED_VALUES numbers in all, as counted, are broadcast, and one scan of the vectors keeps the best k of each query in every task; vectors don't
    move. More queries are packed in blocks like the vectors, and each pair of blocks is one numpy product. Either way memory doesn't
    depend on the tables. key: a column that query and vector must have in common (filter before scoring).
    """
    asked = queries.where(F.col(query_vec).isNotNull())
    schema = f"query_id {dict(queries.dtypes)[query_id]}, id {dict(vectors.dtypes)[id_col]}, score double"
    kinds = tuple(to_arrow_type(t.schema[c].dataType) for t, c in ((queries, query_id), (vectors, id_col)))
    size = asked.agg(F.coalesce(F.sum(F.size(query_vec)), F.lit(0))).first()[0]
    if size <= SHARED_VALUES:
        rows = asked.select(query_id, query_vec, (F.col(key) if key else F.lit(0)).cast("string").alias("key")).collect()
        sources = scratch.spread(vectors.where(F.col(vec_col).isNotNull()))
        found = sources.select(F.col(id_col).alias("id"), (F.col(key) if key else F.lit(0)).cast("string").alias("key"), F.col(vec_col).alias("v"))
        return top_k(found.mapInArrow(_scan([tuple(r) for r in rows], k, kinds), schema), k)
    pairs = _blocks(queries, query_id, query_vec, "q", key).join(_blocks(vectors, id_col, vec_col, "d", key), "key").drop("key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, d = (np.array(row[f"{n}_vecs"], np.float64) for n in "qd")
                for m in (q, d):
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                at, ids, s = best_of(np.round(q @ d.T, 6), np.array(row["d_ids"]), k)
                yield _hits(np.array(row["q_ids"])[at], ids, s, kinds)

    return top_k(pairs.mapInArrow(score, schema), k)
