"""Quality gates, exact and near duplicates of chunks, rollups and metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.operators.graphs import components
from folioscope.sources import scratch

REQUIRED = ("chunk_id", "text", "source_url", "scheme", "doc_type")


def rate(test: Column, places: int = 4) -> Column:
    """Share of rows for which test holds, 0 for none."""
    return F.round(F.coalesce(F.avg(F.coalesce(test, F.lit(False)).cast("double")), F.lit(0.0)), places)


def status_rollup(df: DataFrame, status_col: str, bytes_col: str) -> DataFrame:
    """(status, n, bytes, share): one pass, sums before the shuffle."""
    counts = df.groupBy(F.coalesce(F.col(status_col), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum(bytes_col), F.lit(0)).alias("bytes"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", "bytes", F.round(F.col("n") / F.col("t"), 4).alias("share"))


def registry_issues(df: DataFrame, scheme: str, url: str, active: str | None, expected: int | None, site: str | None = None) -> DataFrame:
    """One row (issue, n) for each kind of fault: count, url form, repeated url or scheme, path that doesn't end in the scheme, inactive."""
    canon = U.canonical(F.col(url), site)
    rows = df.select(F.col(scheme).alias("s"), F.col(url).alias("u"), canon.alias("c"), (F.col(active) if active else F.lit(True)).alias("a"))
    checks = {"not_canonical": ~F.coalesce(F.col("c") == F.col("u"), F.lit(False)), "path_not_scheme": ~F.coalesce(U.slug(F.col("u")) == F.col("s"), F.lit(False)), "inactive": ~F.coalesce("a", F.lit(False))}
    sums = rows.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(n) for n, t in checks.items()])
    if expected is not None:
        sums = sums.withColumn("row_count", F.abs(F.col("rows") - expected))
    names = [*checks, *(["row_count"] if expected is not None else [])]
    flat = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).cast("long").alias("n")) for n in names])).alias("x")).select("x.*")
    repeats = [rows.groupBy(c).agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit(f"repeated_{n}").alias("issue"), "n") for c, n in (("u", "url"), ("s", "scheme"))]
    return flat.unionByName(repeats[0]).unionByName(repeats[1])


def dedupe_exact(df: DataFrame, group_col: str, text_col: str, order: Sequence[str]) -> DataFrame:
    """Keep the first of equal texts (white space and case aside) within a group, and add n_copies.

    The keeper is a minimum, which is taken before the shuffle; a group of very many copies never meets in one task.
    """
    key = [F.col(group_col).alias("g"), X.text_hash(F.col(text_col)).alias("h")]
    first = df.select(*key, F.struct(*order).alias("o")).groupBy("g", "h").agg(F.min("o").alias("o"), F.count("*").alias("n_copies"))
    keyed = df.withColumns({"__h": X.text_hash(F.col(text_col)), "__o": F.struct(*order)})
    met = keyed.join(first, keyed[group_col].eqNullSafe(first["g"]) & (keyed["__h"] == first["h"]) & (keyed["__o"] == first["o"]))
    return met.drop("__h", "__o", "g", "h", "o")


def _word_sets(df: DataFrame, id_col: str, text_col: str, group_col: str | None) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(X.dedupe_form(F.col(text_col)), " ", -1), lambda w: w != ""))
    return df.select(F.col(id_col).alias("id"), (F.col(group_col) if group_col else F.lit(0)).cast("string").alias("g"), F.array_sort(words).alias("w"))


#: Buckets that words are counted in, and bits of a set's sketch.
BUCKETS, BITS = 1 << 17, 256
#: Words of sets, and pairs, that a task compares at once. A group of more is cut into parts, and a task takes a pair of parts.
BLOCK_WORDS, BLOCK_PAIRS = 1 << 20, 1 << 20
#: Sets that move to the tasks that compare them in one round, and words of theirs that always may; no more words move at once than all sets have, which
#: bounds the disk. Rounds follow one another.
MOVED_SETS, MOVED_WORDS = 1 << 19, 1 << 24


def near_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.92, group_col: str | None = None) -> DataFrame:
    """(a, b, jaccard) of texts whose word sets have at least that Jaccard similarity, a < b.

    Words are 64-bit hashes from the start. Equal word sets are one representative (its least id stands for them; near_members tells whom; rows of null ids are left out). Each set is indexed by the
    rarest words of its prefix: two sets that are similar share one of them, so frequent words make no pairs; a pair must also agree in size, have
    enough words left behind the places of the one that they share, and differ in no more bits of their sketches than their sets may in words. How rare a word is,
    is told by the words of its bucket, of BUCKETS, and its hash: any order that all sets share finds the same pairs, so each set picks its prefix where it lies,
    and only prefixes are shuffled. Pairs that pass are compared by groups of sets that hang together, so a set moves once for a group and not for each pair.
    """
    rows = _word_sets(scratch.spread(df), id_col, text_col, group_col).where((F.size("w") > 0) & F.col("id").isNotNull())
    rows = rows.select("id", "g", F.sha2(F.array_join("w", " "), 256).alias("h"), F.array_sort(F.transform("w", lambda x: F.xxhash64(x))).alias("w"))
    reps = rows.groupBy("g", "h").agg(F.min(F.struct("id", "w")).alias("r")).select(F.monotonically_increasing_id().alias("u"), "g", "r.id", "r.w")
    reps = scratch.written(reps, "word_sets")
    prefix, n_words = _prefixes(reps, threshold)
    prefix = scratch.written(prefix, "prefixes")
    # x has no more words than y, so it needs a shorter prefix
    left = prefix.where(1 + F.col("n_w") - F.col("k") + 1e-6 >= 2 * threshold / (1 + threshold) * F.col("n_w"))
    left, right = (p.select("g", "t", *[F.col(c).alias(f"{c}{side}") for c in p.columns if c not in ("g", "t")]) for side, p in (("x", left), ("y", prefix)))
    both = F.col("n_wx") + F.col("n_wy")
    shorter = (F.col("n_wx") < F.col("n_wy")) | ((F.col("n_wx") == F.col("n_wy")) & (F.col("ux") < F.col("uy")))
    # if the word is the first in common, in the order of prefixes, it has at most so many others behind it; a pair that fails there fails at later ones
    most = 1 + F.least(F.col("n_wx") - F.col("kx"), F.col("n_wy") - F.col("ky"))
    apart = sum((F.bit_count(F.col(f"s{i}x").bitwiseXOR(F.col(f"s{i}y"))) for i in range(BITS // 64)), F.lit(0))
    met = left.join(right, ["g", "t"]).where(
        shorter
        & (F.col("n_wx") + 1e-6 >= threshold * F.col("n_wy"))
        & (most * (1 + threshold) + 1e-6 >= threshold * both)
        & (apart * (1 + threshold) <= (1 - threshold) * both + 1e-6)
    )
    pairs = scratch.written(met.select(F.col("ux").alias("x"), F.col("uy").alias("y"), F.col("n_wx").alias("nx"), F.col("n_wy").alias("ny")).distinct(), "met_pairs")
    scratch.discard(prefix)
    sized = _compared(pairs, reps, n_words)
    scratch.discard(reps)
    # in whole numbers, as a rounded share can reach a threshold that the sets don't
    near = sized.where((F.col("c") * 1_000_000 >= F.col("n") * F.lit(round(threshold * 1_000_000))) & (F.col("a") != F.col("b")))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.col("c") / F.col("n"), 6).alias("jaccard"))


def _prefixes(reps: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(u, g, n_w, t, k, s0, ...): a row for each word t of a set's prefix, with its place k, the size of the set and its sketch; and the words of all sets.

    Bit i of a sketch is the parity of the words that fall on it, so two sets differ in no fewer words than their sketches in bits.
    """
    sums = reps.select(F.explode("w").alias("t")).groupBy(F.pmod("t", F.lit(BUCKETS)).alias("bucket")).count()
    rarity = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # at most BUCKETS
        rarity[r.bucket] = r["count"]
    shared = reps.sparkSession.sparkContext.broadcast(rarity)
    buckets, bits = BUCKETS, BITS

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            t = batch.column(2).flatten().to_numpy()
            own = np.repeat(np.arange(len(batch)), size)
            order = np.lexsort((t, shared.value[t & (buckets - 1)], own))  # sets stay where they were
            k = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size) + 1
            some = k <= (size - np.ceil(size * threshold - 1e-6) + 1)[own]
            odd = np.bincount(own * bits + ((t >> 20) & (bits - 1)), minlength=len(batch) * bits) & 1
            sketch = np.packbits(odd.astype(np.uint8).reshape(len(batch), bits), axis=1).view(np.int64)
            at = own[some]
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(size[at].astype(np.int32)), pa.array(t[order[some]]), pa.array(k[some].astype(np.int32))]
            columns += [pa.array(sketch[at, i]) for i in range(bits // 64)]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "g", "n_w", "t", "k", *(f"s{i}" for i in range(bits // 64))])

    kinds = ", ".join(f"s{i} long" for i in range(BITS // 64))
    return reps.select("u", "g", "w").mapInArrow(pick, f"u long, g string, n_w int, t long, k int, {kinds}"), int(rarity.sum())


def _compared(pairs: DataFrame, reps: DataFrame, n_words: int) -> DataFrame:
    """(a, b, c, n): the ids of each pair (x, y, nx, ny) of sets, in any order, with the number of words in common and in all.

    A pair goes to the group of the least set within two steps of it. Small groups share blocks, large ones are cut; a block is compared in one task, and sets
    that are in no pair stay where they lie.
    """
    kind = dict(reps.dtypes)["id"]
    both = pairs.select(F.col("x").alias("u"), F.col("y").alias("v")).union(pairs.select("y", "x"))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    label = scratch.written(both.join(least.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("m")), "near_labels")
    keyed = pairs.join(label.toDF("x", "mx"), "x").join(label.toDF("y", "my"), "y").withColumn("key", F.least("mx", "my")).drop("mx", "my")
    keyed = scratch.written(keyed, "keyed_pairs")
    ends = F.array(F.struct(F.col("x").alias("u"), F.col("nx").alias("n")), F.struct(F.col("y").alias("u"), F.col("ny").alias("n")))
    words = keyed.select("key", F.explode(ends).alias("e")).distinct().groupBy("key").agg((F.sum("e.n") / BLOCK_WORDS).alias("words"))
    loads = scratch.written(words.join(keyed.groupBy("key").agg((F.count("*") / BLOCK_PAIRS).alias("pairs")), "key"), "near_loads")
    blocks = loads.agg(F.coalesce(F.ceil(F.sum(F.col("words") + F.col("pairs"))), F.lit(1))).first()[0]
    large = loads.where((F.col("words") > 1) | (F.col("pairs") > 1)).select("key", F.ceil(F.greatest(2 * F.col("words"), F.sqrt("pairs"))).alias("parts"))  # at most blocks of them
    px, py = (F.pmod(F.xxhash64(c), F.col("parts")) for c in ("x", "y"))
    block = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(blocks))).otherwise(F.xxhash64("key", F.least(px, py), F.greatest(px, py)))
    blocked = keyed.join(F.broadcast(large), "key", "left").select("x", "y", block.alias("block"), ends.alias("ends"))
    def overlaps(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """(a, b, c, n) of the pairs of a block, whose sets are all there."""
        lists = sets.column("w").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()).astype(np.int64))])
        distinct, word = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        u = sets.column("u").to_numpy()
        order = np.argsort(u)
        x, y = (order[np.searchsorted(u, pairs.column(c).to_numpy(), sorter=order)] for c in ("x", "y"))
        common, seen, last = np.zeros(len(x), np.int64), np.zeros(len(distinct), bool), -1
        stops, of_y = ends.tolist(), y.tolist()
        by = np.argsort(x, kind="stable")
        for i, owner in zip(by.tolist(), x[by].tolist(), strict=True):
            if owner != last:
                if last >= 0:
                    seen[word[stops[last] : stops[last + 1]]] = False
                seen[word[stops[owner] : stops[owner + 1]]] = True
                last = owner
            common[i] = np.count_nonzero(seen[word[stops[of_y[i]] : stops[of_y[i] + 1]]])
        size = np.diff(ends)
        ids = sets.column("id").combine_chunks()
        return pa.table({"a": ids.take(pa.array(x)), "b": ids.take(pa.array(y)), "c": pa.array(common), "n": pa.array(size[x] + size[y] - common)})

    needs = scratch.written(blocked.select("block", F.explode("ends").alias("e")).select("block", "e.u", "e.n").distinct(), "near_needs")
    n_sets, n_moved = needs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rounds = max(1, -(-n_sets // MOVED_SETS), -(-n_moved // max(n_words, MOVED_WORDS)))
    done = []
    for i in range(rounds):
        now = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(rounds)) == i
        moved = reps.join(F.broadcast(needs.where(now)), "u").select("block", "u", "id", "w")
        met = blocked.where(now).select("block", "x", "y").groupBy("block").cogroup(moved.groupBy("block")).applyInArrow(overlaps, f"a {kind}, b {kind}, c long, n long")
        done.append(scratch.written(met, "near_compared"))
    return reduce(DataFrame.union, done)


def near_members(df: DataFrame, id_col: str, text_col: str, group_col: str | None = None) -> DataFrame:
    """(id, representative, n_copies): a row for each document with the least id of its word set, under which near_pairs has it, and the
    number of documents of this set. Texts without words are one set. Only ids and SHA-256 of the sets are shuffled.
    """
    rows = _word_sets(df, id_col, text_col, group_col).select("id", "g", F.sha2(F.array_join("w", " "), 256).alias("h"))
    rows = scratch.written(rows, "set_hashes")  # both sides of the join read it, and texts are split once
    sets = rows.groupBy("g", "h").agg(F.min("id").alias("representative"), F.count("*").alias("n_copies"))
    met = rows.join(sets, rows["g"].eqNullSafe(sets["g"]) & (rows["h"] == sets["h"]))
    return met.select("id", "representative", "n_copies")


#: Pairs of a component that one task decides. A larger one is decided in rounds.
TASK_PAIRS = 1_000_000


def _greedy(group: pa.Table) -> pa.Table:
    """(b, first) of the pairs of a component, decided in the order of ids: dropped ids with the least kept one that is near."""
    before: dict = {}
    for a, b in zip(group.column("a").to_pylist(), group.column("b").to_pylist(), strict=True):
        before.setdefault(b, []).append(a)
    first: dict = {}
    for b in sorted(before):
        kept = [a for a in before[b] if a not in first]
        if kept:
            first[b] = min(kept)
    kind = group.schema.field("a").type
    return pa.table({"b": pa.array(list(first), kind), "first": pa.array(list(first.values()), kind)})


def keep_first(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.92, group_col: str | None = None) -> DataFrame:
    """(id, kept_id, kept): what a scan in the order of unique ids keeps that drops each document near one it has kept; kept_id is the least such one.

    A decision needs only those of its connected component of pairs. Components of up to TASK_PAIRS pairs are decided in one task each, so the number of jobs does not
    grow with the length of a chain. What is larger goes in rounds that keep representatives without a smaller undecided neighbour and drop their
    neighbours, each round written.
    """
    pairs = scratch.written(near_pairs(df, id_col, text_col, threshold, group_col).select("a", "b").distinct(), "near_pairs")
    nodes = components(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    owned = scratch.written(pairs.join(nodes, F.col("a") == F.col("node")).select("a", "b", "component"), "near_components")
    large = owned.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > TASK_PAIRS).select("component")
    kind = dict(pairs.dtypes)["a"]
    first = owned.join(large, "component", "left_anti").groupBy("component").applyInArrow(_greedy, f"b {kind}, first {kind}")
    rest = scratch.written(owned.join(large, "component", "left_semi").select("a", "b"), "near_left")
    if not rest.isEmpty():
        first = first.union(_by_rounds(rest))
    members = near_members(df, id_col, text_col, group_col)
    met = members.join(first, F.col("representative") == F.col("b"), "left")
    kept = F.coalesce("first", "representative")
    return met.select("id", kept.alias("kept_id"), (F.col("id") == kept).alias("kept"))


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """(b, first), like _greedy, for pairs of any number."""
    left, gone = pairs, pairs.select("b").limit(0)
    while not left.isEmpty():
        free = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        out = scratch.written(left.join(free, "a").select("b").distinct(), "near_gone")
        gone = scratch.written(gone.union(out), "near_gone")
        left = scratch.written(left.join(out, "b", "left_anti").join(out.withColumnRenamed("b", "a"), "a", "left_anti"), "near_left")
    return pairs.join(gone.withColumnRenamed("b", "a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("first"))


def chunk_errors(df: DataFrame, allowed: DataFrame | None = None, site: str | None = None, required: Sequence[str] = REQUIRED) -> DataFrame:
    """(chunk_id, code, hard): a row for each missing field, and for urls that are broken or not allowed (these are hard)."""
    codes = [(f"missing_{c}", F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")) for c in required]
    canon = U.canonical(F.col("source_url"), site)
    soft = df.select("chunk_id", F.explode(X.hits(codes)).alias("code"), F.lit(False).alias("hard"))
    broken = df.where(canon.isNull()).select("chunk_id", F.lit("invalid_source_url").alias("code"), F.lit(True).alias("hard"))
    out = soft.unionByName(broken)
    if allowed is not None:
        known = df.where(canon.isNotNull()).withColumn("__c", canon)
        bad = known.join(allowed.select(F.col("url").alias("__c")), "__c", "left_anti")
        out = out.unionByName(bad.select("chunk_id", F.lit("url_not_allowlisted").alias("code"), F.lit(True).alias("hard")))
    return out


def context_flags(df: DataFrame, text_col: str, limit: int = 512) -> DataFrame:
    est = X.estimated_tokens(F.col(text_col))
    return df.withColumns({"estimated_tokens": est, "exceeds_context": est > limit})


def bundle_states(df: DataFrame, group_col: str) -> DataFrame:
    """Of chunks(group, kept boolean, hard_errors int): validated, failed_validation, excluded_empty, excluded_empty_after_dedupe."""
    sums = df.groupBy(group_col).agg(F.count("*").alias("n_in"), F.count_if("kept").alias("n_out"), F.coalesce(F.sum("hard_errors"), F.lit(0)).alias("hard_errors"))
    state = F.when(F.col("n_in") == 0, "excluded_empty").when(F.col("hard_errors") > 0, "failed_validation").when(F.col("n_out") == 0, "excluded_empty_after_dedupe").otherwise("validated")
    return sums.withColumn("status", state)


def validation_rollup(chunks: DataFrame, group_col: str, text_col: str, order: Sequence[str], limit: int = 512) -> DataFrame:
    """One row for each group of chunks(hard_errors, ...) after exact duplicates within it are dropped: chunks in and out, duplicates, chunks over the embedding limit, hard errors, status, indexable."""
    kept = context_flags(dedupe_exact(chunks, group_col, text_col, order), text_col, limit)
    before = chunks.groupBy(group_col).agg(F.count("*").alias("chunks_in"), F.coalesce(F.sum("hard_errors"), F.lit(0)).alias("hard_errors"))
    after = kept.groupBy(F.col(group_col).alias("__g")).agg(F.count("*").alias("chunks_out"), F.count_if("exceeds_context").alias("over_limit"))
    met = before.join(after, F.col(group_col).eqNullSafe(F.col("__g")), "left").drop("__g")
    status = F.when(F.col("hard_errors") > 0, "failed_validation").otherwise("validated")
    return met.withColumns({"duplicates": F.col("chunks_in") - F.col("chunks_out"), "status": status, "indexable": F.col("hard_errors") == 0})


def validation_totals(rollup: DataFrame, group_col: str) -> DataFrame:
    """One row of validation_rollup's: groups, indexable ones, sums, and the names of those left out, in order (a corpus has few groups)."""
    return rollup.agg(
        F.count("*").alias("groups"), F.count_if("indexable").alias("indexable"), *[F.sum(c).alias(c) for c in ("chunks_in", "chunks_out", "duplicates", "over_limit")],
        F.array_sort(F.collect_list(F.when(~F.col("indexable"), F.col(group_col)))).alias("excluded"),
    )


# -- metrics --------------------------------------------------------------------------------------------------------


def recall_at_k(results: DataFrame, expected: DataFrame, k: int, match: str = "id") -> DataFrame:
    """(n, hits, recall, mean_rank): results(query_id, rank, match) against expected(query_id, match); a query without a result is a miss."""
    ranks = results.where(F.col("rank") <= k).join(expected, ["query_id", match]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    joined = expected.select("query_id").distinct().join(ranks, "query_id", "left")
    return joined.agg(F.count("*").alias("n"), F.count("rank").alias("hits"), rate(F.col("rank").isNotNull()).alias("recall"), F.round(F.avg("rank"), 4).alias("mean_rank"))


def pass_rates(checks: DataFrame, bars: dict[str, float]) -> DataFrame:
    """(suite, n, passed, pass_rate, ok) of checks(suite, passed), and a last row for all suites (suite null)."""
    bar = F.lit(0.0)
    for suite, value in bars.items():
        bar = F.when(F.col("suite") == suite, value).otherwise(bar)
    sums = checks.rollup("suite").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))
    share = F.round(F.col("passed") / F.greatest(F.lit(1), F.col("n")), 4)
    return sums.withColumn("pass_rate", share).withColumn("ok", F.when(F.col("suite").isNotNull(), share >= bar))


def latency_summary(df: DataFrame, latency_col: str, ok: Column) -> DataFrame:
    """Mean latency of the good rows (0 doesn't count as measured), cut to whole numbers."""
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.floor(F.avg(F.when(ok, F.nullif(F.col(latency_col), F.lit(0))))).cast("long").alias("avg_latency"))


def freshness_sla(df: DataFrame, fetched_col: str, now: Column, days: int = 30) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(F.col(fetched_col)))) / 86_400_000_000
    return df.agg(F.count("*").alias("n"), F.count_if(age <= days).alias("fresh"), rate(age <= days).alias("share"))
