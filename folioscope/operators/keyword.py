"""The keyword channel: postings, statistics and BM25 top k for many queries at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.functions import text as X
from folioscope.sources import scratch

#: Fixed values of the ranking function.
K1, B = 1.5, 0.75
#: A token of a text in its keyword form, as X.tokens has them.
TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class KeywordIndex:
    """postings(term, id, dl, tf), lengths(id, dl), terms(term, df), stats(n_docs, avg_dl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame


def token_rows(docs: DataFrame, id_col: str, text_col: str, expand: bool = True, normalized: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(id, toks, *keep): documents without tokens are left out, as the statistics don't count them."""
    text = X.expand_phrases(F.col(text_col)) if expand else F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), X.tokens(text, normalized).alias("toks"), *(keep or [])).where(F.size("toks") > 0)


def build_index(docs: DataFrame, id_col: str, text_col: str, expand: bool = True, normalized: bool = False) -> KeywordIndex:
    rows = token_rows(docs, id_col, text_col, expand, normalized)
    postings = rows.select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    lengths = rows.select("id", F.size("toks").alias("dl"))
    return KeywordIndex(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), _stats(lengths))


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def idf(n_docs: str = "n_docs", df: str = "df"):
    return F.log(1 + (F.col(n_docs) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def query_terms(queries: DataFrame, id_col: str, text_col: str, normalized: bool = False) -> DataFrame:
    """(query_id, term, qtf): a term counts as often as the query has it."""
    toks = queries.select(F.col(id_col).alias("query_id"), F.explode(X.tokens(F.col(text_col), normalized)).alias("term"))
    return toks.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_topk(
    docs: DataFrame, queries: DataFrame, k: int = 5, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id",
    query_text: str = "text", k1: float = K1, b: float = B, expand: bool = True, normalized: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query; score rounded to 6 places, ties by id.

    Documents are read and tokenised once. Where the queries have up to SHARED_TERMS rows of terms, as counted, these are broadcast: each document is written as its length and
    the numbers and counts of the terms that some query has, the few statistics are added up, and one scan of these rows keeps the best k of each query in
    every task, so a frequent term is no join key and only hits are shuffled. More terms meet postings in joins (see search). keep names columns of docs that
    must equal the query's columns of the same name where these aren't null (a filter before scoring).
    """
    terms = scratch.written(query_terms(queries, query_id, query_text, normalized), "terms")
    rows = token_rows(scratch.spread(docs), doc_id, doc_text, expand, normalized, keep)
    if terms.count() <= SHARED_TERMS:
        return top_k(_scan(rows, terms, queries.select(F.col(query_id).alias("query_id"), *(keep or [])), k, k1, b, keep or []), k)
    vocabulary = terms.select("term").distinct().withColumn("known", F.lit(True))
    each = rows.select("id", F.size("toks").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "toks")).alias("term"))
    wanted = each.join(vocabulary, "term", "left").where("term IS NULL OR known")
    counted = scratch.written(wanted.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")), "postings")
    postings = counted.where("term IS NOT NULL")
    return search(Postings(postings, _stats(counted.where("term IS NULL"))), terms, docs, queries, k, doc_id, query_id, k1, b, keep)


#: Terms of all queries that are broadcast at most, and scores of documents by queries that a task holds at once.
SHARED_TERMS, SCORES = 1 << 18, 1 << 21


def _scan(rows: DataFrame, terms: DataFrame, queries: DataFrame, k: int, k1: float, b: float, keep: list[str]) -> DataFrame:
    """(query_id, id, score): the k best documents of each task for each query, of rows(id, toks, *keep)."""
    asked = terms.orderBy("term", "query_id").collect()  # at most SHARED_TERMS
    vocabulary = sorted({r.term for r in asked})
    number = {t: i for i, t in enumerate(vocabulary)}
    shared = pa.array(vocabulary, pa.string())
    names = ["id", *keep]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column(len(names))
            size = np.diff(toks.offsets.to_numpy())
            term = pc.fill_null(pc.index_in(toks.flatten(), shared), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(batch)), size)
            key, tf = np.unique(doc[term >= 0] * (len(vocabulary) + 1) + term[term >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(batch) + 1) * (len(vocabulary) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % (len(vocabulary) + 1), tf)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(size, pa.int32()), *lists], names=[*names, "dl", "terms", "tfs"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "dl int", "terms array<int>", "tfs array<int>"])
    counted = scratch.written(rows.select(*names, "toks").mapInArrow(count, schema), "counted")
    n, average = counted.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = np.zeros(len(vocabulary))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each term
        df[r.t] = r["count"]
    weights = np.log(1 + (n - df + 0.5) / (df + 0.5))
    filters = {r.query_id: tuple(r[1:]) for r in queries.join(terms.select("query_id").distinct(), "query_id", "left_semi").collect()}
    ids = sorted(filters, key=str)
    place = {q: i for i, q in enumerate(ids)}
    term_of = np.array([number[r.term] for r in asked], np.int64)
    query_of = np.array([place[r.query_id] for r in asked], np.int64)
    weight_of = np.array([r.qtf for r in asked], np.float64) * weights[term_of] if asked else np.zeros(0)
    first = np.searchsorted(term_of, np.arange(len(vocabulary) + 1))
    average = average or 1.0
    arrow = [to_arrow_type(terms.schema["query_id"].dataType), to_arrow_type(rows.schema["id"].dataType)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple | None = None
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (len(names) + 1, len(names) + 2))
                doc = np.repeat(np.arange(len(batch)), np.diff(batch.column(len(names) + 1).offsets.to_numpy()))
                dl = batch.column(len(names)).to_numpy(zero_copy_only=False)[doc]
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))
                # each posting once for every query that has its term
                times = first[term + 1] - first[term]
                own = np.repeat(np.arange(len(term)), times)
                pair = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[term], times)
                cell = query_of[pair] * len(batch) + doc[own]
                scores = np.bincount(cell, weight_of[pair] * gain[own], len(ids) * len(batch)).reshape(len(ids), len(batch))
                for c in range(len(keep)):
                    held = batch.column(1 + c).to_pylist()
                    for q, wanted in enumerate(ids):
                        if filters[wanted][c] is not None:
                            scores[q, [x != filters[wanted][c] for x in held]] = 0
                new = _best(np.round(scores, 6), np.array(batch.column(0).to_pylist()), k)
                best = new if best is None else _first(*(np.concatenate(x) for x in zip(best, new, strict=True)), k)
        if best is not None:
            found = [pa.array([ids[q] for q in best[0]], arrow[0]), pa.array(best[1]).cast(arrow[1]), pa.array(best[2])]
            yield pa.RecordBatch.from_arrays(found, names=["query_id", "id", "score"])

    return counted.mapInArrow(score, f"query_id {dict(terms.dtypes)['query_id']}, id {kinds['id']}, score double")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k highest scores above 0 of each row, ties by id."""
    m = scores.shape[1]
    least = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.zeros(len(scores))
    row, col = np.nonzero((scores >= least[:, None]) & (scores > 0))
    return _first(row, ids[col], scores[row, col], k)


def _first(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], scores[keep]


@dataclass(frozen=True)
class Postings:
    """What a search reads: postings(term, id, dl, tf) and stats(n_docs, avg_dl)."""

    postings: DataFrame
    stats: DataFrame


def search(
    index: Postings, terms: DataFrame, docs: DataFrame, queries: DataFrame, k: int, doc_id: str, query_id: str, k1: float = K1, b: float = B,
    keep: list[str] | None = None,
) -> DataFrame:
    """The k best documents of each query by a built index; terms(query_id, term, qtf). docs and queries are read for the columns in keep alone."""
    postings = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighted = df.crossJoin(F.broadcast(index.stats)).select("term", idf().alias("idf"), "avg_dl")
    hits = terms.join(weighted, "term").join(postings, "term")
    if keep:
        left = docs.select(F.col(doc_id).alias("id"), *[F.col(c).alias(f"__d_{c}") for c in keep])
        right = queries.select(F.col(query_id).alias("query_id"), *[F.col(c).alias(f"__q_{c}") for c in keep])
        hits = hits.join(left, "id").join(right, "query_id")
        for c in keep:
            hits = hits.where(F.col(f"__q_{c}").isNull() | (F.col(f"__q_{c}") == F.col(f"__d_{c}")))
    average = F.when(F.col("avg_dl") == 0, 1.0).otherwise(F.col("avg_dl"))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * gain), 6).alias("score"))
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int, order: str = "score") -> DataFrame:
    """Rank 1 to k within each query; Spark prunes before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("query_id").orderBy(F.desc(order), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
