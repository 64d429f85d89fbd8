"""Impact-ordered posting blocks with block maxima, and BM25 top k that reads only blocks which can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.keyword import K1, B, idf, top_k
from folioscope.sources import scratch

#: Postings in a block; of a term in one part, about; and hash parts that a term can be dealt over at most.
BLOCK, PART, PARTS = 128, 1 << 16, 1 << 12
#: Postings, beyond k, that each question reads before it knows how good a hit must be.
PROBED = 1024
#: Bounds are widened by this: sums differ by their order, and scores are rounded to 6 places.
SLACK = 1e-5

HEAD = ["segment", "term", "part", "block"]


def gain(tf: Column, dl: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """What a posting adds for each unit of its term's weight: more for a higher tf, less for a longer text."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.when(average == 0, 1.0).otherwise(average)))


def packed(rows: DataFrame) -> DataFrame:
    """(term, n, ids, tfs, dls, scopes), written: the postings of rows(id, dl, scope, terms, tfs), where terms and tfs are lists, packed by term in each batch of rows."""
    kind, most = dict(rows.dtypes)["id"], max(1, PART // 8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.repeat(np.arange(len(batch)), np.diff(batch.column(3).offsets.to_numpy()))
            if not len(own):
                continue
            code = batch.column(3).flatten().dictionary_encode()
            number = code.indices.to_numpy()
            order = np.argsort(number, kind="stable")
            number, own = number[order], pa.array(own[order])
            start = _cut(np.flatnonzero(np.diff(number, prepend=-1)), len(number), most)
            size = np.diff(np.append(start, len(number)))
            ends = pa.array(np.append(start, len(number)).astype(np.int32))
            lists = [batch.column(0).take(own), batch.column(4).flatten().take(pa.array(order)), batch.column(1).take(own), batch.column(2).take(own)]
            columns = [code.dictionary.take(pa.array(number[start])), pa.array(size.astype(np.int32)), *[pa.ListArray.from_arrays(ends, c) for c in lists]]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "ids", "tfs", "dls", "scopes"])

    found = rows.select("id", F.col("dl").cast("int").alias("dl"), F.col("scope").cast("string").alias("scope"), "terms", F.col("tfs").cast("array<long>").alias("tfs"))
    return scratch.written(found.mapInArrow(pack, f"term string, n int, ids array<{kind}>, tfs array<long>, dls array<int>, scopes array<string>"), "postings")


def _cut(start: np.ndarray, end: int, most: int) -> np.ndarray:
    """Where runs begin, and where pieces of them begin that have at most so many rows."""
    size = np.diff(np.append(start, end))
    pieces = -(-size // most)
    return np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most


def build_blocks(postings: DataFrame, average: float) -> DataFrame:
    """blocks_of for postings(term, id, dl, tf, scope), a row each."""
    return blocks_of(packed(postings.select("id", "dl", "scope", F.array("term").alias("terms"), F.array("tf").alias("tfs"))), average)


def blocks_of(packs: DataFrame, average: float) -> DataFrame:
    """(term, part, block, n, max_tf, min_dl, ids, tfs, dls, scopes) of packed postings.

    A term of more than PART postings is dealt over parts, by the hash of the first id of its packs, so no task holds all of a frequent one. In each part postings
    are in order of their gain at the average length given, and cut into blocks. max_tf and min_dl bound a block's gain at any average,
    so blocks stay right when documents are added. Postings move once, in packs, and rows lie in the order of terms within a file.
    """
    heavy = packs.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") > PART)
    heavy = heavy.select(F.col("term").alias("t"), F.least(F.ceil(F.col("df") / PART).cast("int"), F.lit(PARTS)).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("parts")).cast("int"), F.lit(0))
    dealt = packs.join(F.broadcast(heavy), F.col("term") == F.col("t"), "left")  # at most one for every PART postings
    dealt = dealt.select("term", part.alias("part"), "ids", "tfs", "dls", "scopes")
    kind, block, average = dict(packs.dtypes)["ids"], BLOCK, average or 1.0
    names = ["term", "part", "block", "n", "max_tf", "min_dl", "ids", "tfs", "dls", "scopes"]

    def cut(rows: pa.Table) -> pa.RecordBatch:
        """Blocks of whole parts of terms, in order."""
        rows = rows.combine_chunks().to_batches()[0]
        term, part = rows.column(0), rows.column(1).to_numpy()
        new = pc.not_equal(term.slice(1), term.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
        group = np.repeat(np.cumsum(np.append(0, new)), np.diff(rows.column(2).offsets.to_numpy()))
        own = np.repeat(np.arange(len(rows)), np.diff(rows.column(2).offsets.to_numpy()))
        tf, dl = rows.column(3).flatten().to_numpy(), rows.column(4).flatten().to_numpy()
        order = np.lexsort((-tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average)), group))
        first = np.flatnonzero(np.diff(group, prepend=-1))  # groups stay where they were
        start = _cut(first, len(group), block)
        number = (start - first[group[start]]) // block
        tf, dl, at = tf[order], dl[order], pa.array(order)
        ends = pa.array(np.append(start, len(group)).astype(np.int32))
        head = own[start]
        columns = [
            term.take(pa.array(head)), pa.array(part[head]), pa.array(number.astype(np.int32)), pa.array(np.diff(np.append(start, len(group))).astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(dl, start)), *[pa.ListArray.from_arrays(ends, rows.column(c).flatten().take(at)) for c in (2, 3, 4, 5)],
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last part of a term may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            term, part = batch.column(0), batch.column(1)
            last = pc.and_(pc.equal(term, term[len(batch) - 1]), pc.equal(part, part[len(batch) - 1]))
            n = pc.sum(last).as_py()
            if n == len(batch) and (not held or (held[0].column(0)[0], held[0].column(1)[0]) == (term[0], part[0])):
                held.append(batch)
                continue
            done = pa.Table.from_batches([*held, batch.slice(0, len(batch) - n)])
            if len(done):
                yield cut(done)
            held = [batch.slice(len(batch) - n)]
        if held:
            yield cut(pa.Table.from_batches(held))

    schema = f"term string, part int, block int, n int, max_tf long, min_dl int, ids {kind}, tfs array<long>, dls array<int>, scopes array<string>"
    return dealt.repartition("term", "part").sortWithinPartitions("term", "part").mapInArrow(run, schema)


def postings_of(blocks: DataFrame) -> DataFrame:
    """(segment, term, id, dl, tf, scope) again."""
    return blocks.select("segment", "term", F.inline(F.arrays_zip("ids", "dls", "tfs", "scopes"))).withColumnsRenamed({"ids": "id", "dls": "dl", "tfs": "tf", "scopes": "scope"})


def search(blocks: DataFrame, terms: DataFrame, dfs: DataFrame, stats: DataFrame, k: int, scopes: DataFrame | None = None, dead: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each question by BM25, as if all postings of its terms were added up; rounded to 6 places, ties by id.

    blocks have a column segment; terms(query_id, term, qtf); dfs(term, df) and stats(n_docs, avg_dl) of the living documents. scopes(query_id, scope): only
    postings of that scope count, null or no row: all. dead(segment, id): postings that don't count.

    Heads of the blocks alone tell how much each can add. First the best blocks of each question, of PROBED + k postings, give a k-th score that
    the answer can't be below. Terms whose greatest gains stay below it together can't make a hit alone: a hit has one of the other,
    essential terms, in a block that reaches the k-th score with the greatest gains of all other terms. Of these blocks come the candidates; the
    rest of the terms is read for candidates that can still get there, and never shuffled for others. A document of the answer is in
    no skipped block, so its sum is whole. Questions meet blocks by (term, part, block), so a frequent term is many keys.
    """
    weighted = terms.join(dfs, "term").crossJoin(F.broadcast(stats))  # stats is one row
    weighted = weighted.select("query_id", "term", (F.col("qtf") * idf()).alias("weight"), "avg_dl")
    heads = blocks.select(*HEAD, "n", "max_tf", "min_dl").join(weighted, "term")
    upper = F.col("weight") * gain(F.col("max_tf"), F.col("min_dl"), F.col("avg_dl"))
    heads = scratch.written(heads.select(*HEAD, "query_id", "n", "weight", "avg_dl", upper.alias("upper")), "heads")

    def added(some: DataFrame) -> DataFrame:
        """(query_id, id, s): the gains of all living postings in some of the blocks."""
        met = blocks.join(some.select(*HEAD, "query_id", "weight", "avg_dl"), HEAD)
        rows = met.select("segment", "query_id", "weight", "avg_dl", F.inline(F.arrays_zip("ids", "tfs", "dls", "scopes")))
        if scopes is not None:
            wanted = scopes.where("scope IS NOT NULL").select(F.col("query_id").alias("q"), "scope")
            rows = rows.join(wanted, F.col("query_id") == F.col("q"), "left").where(F.col("scope").isNull() | (F.col("scope") == F.col("scopes")))
        if dead is not None:
            gone = dead.select(F.col("segment").alias("g"), F.col("id").alias("i"))
            rows = rows.join(gone, (F.col("segment") == F.col("g")) & (F.col("ids") == F.col("i")), "left_anti")
        return rows.select("query_id", F.col("ids").alias("id"), (F.col("weight") * gain(F.col("tfs"), F.col("dls"), F.col("avg_dl"))).alias("s"))

    def kth(scored: DataFrame, name: str) -> DataFrame:
        return top_k(scored, k, "s").where(F.col("rank") == k).select("query_id", F.col("s").alias(name))

    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), *HEAD)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    probes = heads.withColumn("before", before).where(F.col("before") < PROBED + k)
    known = kth(added(probes).groupBy("query_id", "id").agg(F.sum("s").alias("s")), "known")
    most = heads.groupBy("query_id", "term").agg(F.max("upper").alias("most"))
    rising = Window.partitionBy("query_id").orderBy("most", "term")
    most = most.join(known, "query_id", "left").select(
        "query_id", "term", "most", F.coalesce("known", F.lit(0.0)).alias("known"),
        F.sum("most").over(Window.partitionBy("query_id")).alias("all"), F.sum("most").over(rising).alias("upto"),
    )
    essential = F.col("upto") + SLACK >= F.col("known")
    most = scratch.written(most.withColumn("essential", essential), "terms")
    judged = heads.join(most.select("query_id", "term", "most", "all", "known", "essential"), ["query_id", "term"])
    needed = judged.where(F.col("essential") & (F.col("upper") + F.col("all") - F.col("most") + SLACK >= F.col("known")))
    sums = scratch.written(added(needed).groupBy("query_id", "id").agg(F.sum("s").alias("s")), "sums")
    rest = most.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0)).alias("rest"))
    bar = rest.join(kth(sums, "least"), "query_id", "left")
    able = sums.join(bar, "query_id").where(F.col("least").isNull() | (F.col("s") + F.col("rest") + SLACK >= F.col("least")))
    able = scratch.written(able.select("query_id", "id", "s"), "candidates")
    late = added(judged.where("NOT essential")).join(able.select("query_id", "id"), ["query_id", "id"], "left_semi")
    total = able.union(late).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    return top_k(total, k)
