"""Centroid clustering, the audit of filters, and best-two-fit packing against brute force."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import bestfit, deltalloyd, filteraudit, queries
from tests.conftest import SF

TOKENIZER = bestfit.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))

# clustering


def lloyd(rows, k, rounds, scale, seed):
    """Every vector against every centroid in every round."""
    q = [tuple(int(np.floor(scale * float(x))) for x in v) for _, v in rows]
    mark = [None if i is None else hashlib.sha256(f"{seed}{i}".encode()).hexdigest() for i, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: (mark[r] is None, mark[r] or "", q[r]))[:k]
    centroids = [list(q[r]) for r in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for v in q]

    for _ in range(rounds):
        owners = assign()
        for n in range(len(centroids)):
            mine = [v for v, (_, c) in zip(q, owners, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return Counter((i, c, d) for (i, _), (d, c) in zip(rows, assign(), strict=True)), centroids


def test_cluster_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    rows += [rows[3], (7, [0.5, 0.5, 0.5]), (None, [0.25, -0.25, 0.0])] + [(1000 + i, [0.125, 0.125, 0.125]) for i in range(150)]
    df = spark.createDataFrame([(i, v, 1, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, owner int, q string, distance int").repartition(5)
    for k, rounds in ((9, 4), (1, 2), (60, 1), (12, 0)):
        got = deltalloyd.cluster(df, k=k, rounds=rounds, dim=3, scale=64, seed="s")
        want, centroids = lloyd(rows, k, rounds, 64, "s")
        assert Counter((r.vec_id, r.cluster, r.distance) for r in got.rows.collect()) == want
        assert got.centroids == centroids


def test_cluster_ties_and_few_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = deltalloyd.with_inertia(deltalloyd.cluster(same, k=3, dim=2)).collect()
    assert [(r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got] == [(0, 0, 0, 0)] * 5  # equal centroids: the first has all
    few = deltalloyd.cluster(same.limit(2), k=40, dim=2)
    assert len(few.centroids) == 2 and few.rows.count() == 2


def test_cluster_unusable_vectors(spark):
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [1e30, 0.0])]
    df = spark.createDataFrame([*bad, (8, [0.5, -0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.cluster) for r in deltalloyd.cluster(df, dim=2).rows.collect()] == [(8, 0)]
    empty = deltalloyd.with_inertia(deltalloyd.cluster(df.where("vec_id < 8"), dim=2))
    assert empty.count() == 0 and {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"} <= set(empty.columns)


def test_distances_are_exact_for_large_numbers():
    top = deltalloyd.MAX_COMPONENT
    q = np.array([[top, -top, 3], [top - 1, 1, 0]])
    c = np.array([[-top, top, 1], [0, 0, 0], [top, -top, 2]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    assert deltalloyd.squared_distances(q, c).tolist() == want


def test_reassign_compares_only_what_changed():
    """A kept distance is trusted: with a false one of an unchanged owner the vector stays, with a changed owner it is found anew."""
    q = np.array([[0], [10]])
    c = np.array([[0], [9], [30]])
    owner, distance = deltalloyd.reassign(q, np.array([1, 1]), np.array([-5, -5]), c, np.array([False, False, True]))
    assert owner.tolist() == [1, 1] and distance.tolist() == [-5, -5]
    owner, distance = deltalloyd.reassign(q, np.array([1, 1]), np.array([-5, -5]), c, np.array([False, True, False]))
    assert owner.tolist() == [0, 1] and distance.tolist() == [0, 1]


# audit


def brute_audit(rows, names):
    """rows: (part, set of failed filters, good, toxic)."""
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        sums, lines = Counter(), []
        for order in permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                alone = sum(r[1] == {f} for r in mine)
                lines.append((part, "".join(order), step, f, len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(*x, sums[x[3]]) for x in lines}
    return out


def run_audit(spark, rows, names):
    kind = ", ".join(f"{n} boolean" for n in names)
    df = spark.createDataFrame([(p, *[(n in f) or None for n in names], g, t, 1) for p, f, g, t in rows], f"lang string, {kind}, good boolean, toxic boolean, kept int")
    got = filteraudit.audit(df, F.col("lang"), {n: F.col(n) for n in names}, {"good": F.col("good"), "toxic": F.col("toxic")})
    columns = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r[c] for c in columns) for r in got.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("names", ["P", "PQ", "ABCD"])
def test_audit_like_brute_force(spark, names):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de"]), {n for n in names if rng.random() < 0.4}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(200)]
    rows += [rows[0]] * 3 + [("none fails", set(), True, False), ("all fail", set(names), False, True)]
    assert run_audit(spark, rows, names) == brute_audit(rows, names)


def test_audit_null_part_and_empty_table(spark):
    rows = [(None, {"A"}, None, True), ("", {"B"}, True, None)]
    want = brute_audit([("", {"A"}, False, True), ("", {"B"}, True, False)], "AB")
    assert run_audit(spark, rows, "AB") == want
    assert run_audit(spark, [], "AB") == set()
    with pytest.raises(ValueError):
        run_audit(spark, [], "ABCDEFGH")


def test_audit_enters_each_state_once(spark):
    df = spark.createDataFrame([("en", i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(30)], "part string, A boolean, B boolean, C boolean")
    edges = filteraudit.edge_counts(df, ["A", "B", "C"], []).collect()
    assert len(edges) == len({(r.mask, r.filter) for r in edges}) == 3 * 4  # of 15 edges of the trie
    assert {(r.mask, r.filter): r.removed for r in edges}[3, 2] == sum(i % 2 > 0 and i % 3 > 0 and i % 5 == 0 for i in range(30))


def test_audit_leaves_nothing_persisted(spark):
    rows = [("en", {"A"}, True, False)]
    run_audit(spark, rows, "ABC")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_later_copies(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "a"), (6, "c"), (6, "c"), (7, "c"), (6, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", filteraudit.digest(F.col("text")).alias("d"), F.lit(1).alias("E"))
    got = Counter((r.doc_id, r.text, r.E) for r in filteraudit.later_copies(df, "doc_id", "d", "E").collect())
    want = Counter((i, t, i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u in rows)) for i, t in rows)
    assert got == want


def test_text_filters(spark):
    texts = ["", "a " * 100, "a " * 99, " ".join(map(str, range(100))), "\t\n x \x0b y", "ABCDE fghij", "ABc d" * 10, "50 % off", "é" * 9 + "A", "\x00 É   x", "word " * 200_000]
    columns = [c.alias(k) for k, c in queries.text_filters(F.col("text")).items()]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", *columns).collect():
        words = re.findall("[^\x20\x09-\x0d]+", r.text)
        want = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", r.text)) > 10 * len(r.text), bool(re.search("[#$%&*|]", r.text)))
        assert (r.A, r.B, r.C, r.D) == want, r.text[:50]


# packing


def one_by_one(lengths, capacity):
    """Best-two-fit with a list of pieces, a sequence at a time."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        here, room = [], capacity
        for n in list(left):
            if n <= room:
                here.append(n)
                left.remove(n)
                room -= n
        while room and len(here) > 1:
            least = here[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= room + least]
            if not pairs:
                break
            total, a, b = max(pairs)
            here.pop()
            left.remove(a)
            left.remove(b)
            left = sorted([*left, least], reverse=True)
            here = sorted([*here, a, b], reverse=True)
            room -= total - least
        out.append(tuple(here))
    return Counter(out)


@pytest.mark.parametrize("seed", range(12))
def test_plan_like_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 50])
    pool = rng.sample(range(1, capacity + 1), min(capacity, rng.choice([3, 6, 20])))
    lengths = [rng.choice(pool) for _ in range(rng.choice([0, 1, 30, 70]))]
    plan = bestfit.best_two_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
    got = Counter()
    for p in plan:
        got[tuple(n for n, times in p.lengths for _ in range(times))] += p.repeats
    assert got == one_by_one(lengths, capacity)


def test_plan_swaps_a_piece_for_two():
    plan = bestfit.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11), 10)
    assert [p.lengths for p in plan] == [((6, 1), (2, 2)), ((3, 1),)]  # 6 + 3 leaves a gap of 1, 6 + 2 + 2 none


def test_plan_grows_with_the_capacity_only():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 10**9, 2049)
    counts[0] = 0
    plan = bestfit.best_two_fit(counts, 2048)
    assert sum(len(p.lengths) for p in plan) < 20_000
    total = sum(p.repeats * n * times for p in plan for n, times in p.lengths)
    assert total == int((counts * np.arange(2049)).sum())
    assert sum(p.repeats for p in plan) * 2048 < 1.02 * total


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(by)


def test_packing_of_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op13_best_two_fit"](spark, SF).collect()
    tokenizer = Tokenizer.from_str(TOKENIZER)
    want = set()
    total = 0
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 2048)):
            want.add((i, p, at, len(ids[at : at + 2048]), zlib.crc32(array("I", ids[at : at + 2048]).tobytes())))
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert check_packed(rows, 2048) <= -(-total // 2048) + 1


def test_packing_edges(spark):
    texts = [None, "", " \n\t ", "a", "it's 2024: naïve é ＡＢＣ　İstanbul  x\x1cy \x85 z 12345", "x" * 5000, "<|endoftext|> end", "same", "same", "lo ng " * 400_000, "字" * 3000, "̈a ́b"]
    rows = [(i, t, 9, "n") for i, t in enumerate(texts)] + [(7, "same", 1, "n"), (None, "null id", 1, "n"), (None, None, 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string").repartition(3)
    packed = bestfit.pack_documents(df, TOKENIZER, capacity=512, with_ids=True)
    got = packed.collect()
    check_packed(got, 512)
    tokenizer = Tokenizer.from_str(TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((i, p, at, tuple(ids[at : at + 512])) for p, at in enumerate(range(0, len(ids), 512)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    whole = bestfit.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got) and max(len(r.ids) for r in whole) <= 512
    for r in whole:
        for span in r.spans:
            assert (span.doc_id, span.piece) and len(r.ids[span.offset : span.offset + span.length]) == span.length
    assert bestfit.pack_documents(df.where("doc_id < 0"), TOKENIZER).count() == 0


def test_words_like_the_library(monkeypatch):
    """Words of odd characters in any mix, also while nothing can be remembered."""
    rng = random.Random(8)
    pool = [*"abZ's09_-<|>/\x00\x01\x1c\x7f", "'re", "'LL", "</w>", "é", "É", "İ", "ΣΑΣ", "ß", "字", "\u0301", "ﬁ", "½", "٣", "\u00a0", "\u2003", "\u200b", "😀", "don't", "THE"]
    tokenizer = Tokenizer.from_str(TOKENIZER)
    tokenizer.encode_special_tokens = True
    coder = bestfit.WordCoder(TOKENIZER)
    for n in range(300):
        if n == 150:
            monkeypatch.setattr(bestfit, "CACHED_WORDS", 0)
        text = "".join(rng.choice([*pool, " ", "\n"]) for _ in range(rng.randrange(60)))
        assert b"".join(coder.encode(text)) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def test_segments_change_no_ids(monkeypatch):
    text = ("The quick brown fox, it's 3.5 times\n\nas QUICK " * 50 + "́x")
    whole = b"".join(bestfit.WordCoder(TOKENIZER).encode(text))
    monkeypatch.setattr(bestfit, "SEGMENT", 7)
    monkeypatch.setattr(bestfit, "CACHED_WORDS", 3)
    assert b"".join(bestfit.WordCoder(TOKENIZER).encode(text)) == whole
    want = Tokenizer.from_str(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert array("I", want).tobytes() == whole


def test_partenum_ignores_columns_of_its_names(spark):
    from folioscope.llm import partenum

    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (3, "another text of its own"), (4, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = plain.withColumns({c: F.lit("clash") for c in ("component_id", "n_shingles", "mark", "lead", "id", "rep", "cluster", "sig", "node")})
    scheme = partenum.Scheme(words=3, num=90, den=100)
    got, want = (Counter(tuple(r) for r in partenum.shingle_groups(df, scheme, slices=2).collect()) for df in (clash, plain))
    assert got == want and (2, 59, 1) in got


def test_mix_of_a_very_long_text(spark):
    from folioscope.llm import mixing

    rows = [(0, "long", "word " * 1_000_000), *((i, "short", "few words") for i in range(1, 40))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.poisson_mix(df, size=F.octet_length("text")).groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("m")).collect()
    found = {r.source: (r.n, r.m) for r in got}
    assert found["short"][0] > 100_000 and found.get("long", (0, 5_000_000))[1] == 5_000_000
