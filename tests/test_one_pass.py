"""What is made of texts in one pass gives what the steps of columns give."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import quality, vectors
from folioscope.plans import segments

TEXTS = ["a b", "", None, "Exit Load and TAX of ₹1,200 or Rs; rupees 5", "INR 1,000 and 12.5 % or 3%", "ﬁne İstanbul K Ünï", "nav nav NAV", "x" * 50, "Benchmark, lock-in"]


def test_counted_chunks(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id int, text string").withColumn("scheme", F.lit("s"))
    got = {r.id: r for r in segments._counted(rows, "m", False).collect()}
    want = {r.chunk_id: Counter(r.toks) for r in rows.select("chunk_id", X.tokens(X.expand_phrases(F.col("text"))).alias("toks")).collect()}
    assert {i: dict(zip(r.terms, r.tfs, strict=True)) for i, r in got.items()} == want
    assert all(r.dl == sum(want[i].values()) for i, r in got.items())
    sparse = {r.id: r.v for r in vectors.dense(vectors.hash_embedding(rows, "chunk_id", "text", "m")).collect()}
    assert {i: r.v for i, r in got.items()} == sparse
    assert {r.id: r.v for r in vectors.dense_embedding(rows, "chunk_id", "text", "m").collect()} == sparse


def test_near_pairs_shuffle_prefixes_only(spark, monkeypatch):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:58], "new"]) for b in base] + ["one", "", "one two"]
    made, real = {}, quality.scratch.written
    monkeypatch.setattr(quality.scratch, "written", lambda df, name: made.setdefault(name, (real(df, name), df))[0])
    monkeypatch.setattr(quality, "BUCKETS", 16)
    got = {(r.a, r.b) for r in quality.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()}
    sets = [set(t.split()) for t in texts]
    assert got == {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 92 * len(sets[a] | sets[b])}
    assert got
    assert "Exchange" not in made["prefixes"][1]._jdf.queryExecution().executedPlan().toString(), "words of sets are not shuffled"


@pytest.mark.parametrize("small", [False, True])
def test_near_sets_move_once_for_a_group(spark, monkeypatch, small):
    """Of a group of near copies each set moved for each of its pairs before, so what moved grew with the square of the group."""
    rng = random.Random(5)
    texts = [(1000, None), (None, "w0 w1"), (1001, "")]
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(100)]
        texts += [(g * 100 + i, " ".join(base[: 100 - i % 8] + [f"g{g}new{i}"])) for i in range(30)]
    texts += [(None, texts[5][1])]  # an unknown id doesn't hide its copy
    rng.shuffle(texts)
    if small:  # groups are cut, and sets move in rounds
        monkeypatch.setattr(quality, "BLOCK_WORDS", 1000)
        monkeypatch.setattr(quality, "BLOCK_PAIRS", 50)
        monkeypatch.setattr(quality, "MOVED_WORDS", 100)
    made, real = {}, quality.scratch.written
    monkeypatch.setattr(quality.scratch, "written", lambda df, name: made.setdefault(name, []).append(real(df, name)) or made[name][-1])
    got = sorted((r.a, r.b, r.jaccard) for r in quality.near_pairs(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect())
    sets = {i: set(t.split()) for i, t in texts if t and i is not None}
    share = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    assert got == sorted((a, b, round(c / n, 6)) for (a, b), (c, n) in share.items() if 100 * c >= 92 * n)
    assert len(got) > 500
    moved = made["near_needs"][0].count()
    assert moved == 60 if not small else 60 < moved < len(got)
    assert (len(made["near_compared"]) > 1) == small


def test_keep_first_splits_texts_twice(spark, monkeypatch):
    """For pairs and for members; members took them apart again on each side of a join."""
    made, real = {}, quality.scratch.written
    monkeypatch.setattr(quality.scratch, "written", lambda df, name: made.setdefault(name, real(df, name)))
    rows = [(0, "a b"), (1, "b  A"), (2, None), (None, "a b")]
    members = quality.near_members(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    assert sorted((str(r.id), r.representative, r.n_copies) for r in members.collect()) == [("0", 0, 3), ("1", 0, 3), ("2", 2, 1), ("None", 0, 3)]
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and list(made) == ["set_hashes"]
