"""Posting blocks against sums over all postings."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.operators import blocks


def corpus(rng, n, words=60):
    """Documents of words whose frequency falls with their number; word w0 is in almost all."""
    pool = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return {i: rng.choices(pool, weights, k=rng.randrange(1, 40)) for i in range(n)}


def postings(spark, docs, scope=lambda i: None):
    rows = [(t, i, len(toks), tf, scope(i)) for i, toks in docs.items() for t, tf in Counter(toks).items()]
    return spark.createDataFrame(rows, "term string, id long, dl int, tf long, scope string").repartition(4)


def statistics(spark, docs):
    df = Counter(t for toks in docs.values() for t in set(toks))
    average = sum(map(len, docs.values())) / max(1, len(docs))
    return spark.createDataFrame(list(df.items()), "term string, df long"), spark.createDataFrame([(len(docs), average)], "n_docs long, avg_dl double"), df, average


def brute(docs, df, average, asked, k, scope, wanted):
    out = {}
    for q, words in asked.items():
        sums = defaultdict(float)
        for t, qtf in Counter(words).items():
            weight = qtf * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) if df[t] else 0
            for i, toks in docs.items():
                tf = toks.count(t)
                if tf and (wanted.get(q) is None or scope(i) == wanted[q]):
                    sums[i] += weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / average))
        out[q] = sorted(((-round(s, 6), i) for i, s in sums.items()))[:k]
    return out


def run(spark, made, docs, asked, k, wanted=None, dead=None):
    dfs, stats, *_ = statistics(spark, docs)
    terms = spark.createDataFrame([(q, t, n) for q, words in asked.items() for t, n in Counter(words).items()], "query_id int, term string, qtf long")
    scopes = spark.createDataFrame(list(wanted.items()), "query_id int, scope string") if wanted else None
    got = defaultdict(list)
    for r in blocks.search(made, terms, dfs, stats, k, scopes, dead).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.id))
    return got


def near(got, want):
    assert {q for q, hits in want.items() if hits} == set(got)
    for q, hits in want.items():
        assert len(got[q]) == len(hits)
        assert all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got[q], hits, strict=True)), q


@pytest.mark.parametrize("seed", [1, 2])
def test_search_like_all_postings(spark, monkeypatch, seed):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PART", 50)
    monkeypatch.setattr(blocks, "PROBED", 10)
    rng = random.Random(seed)
    docs = corpus(rng, 300)
    docs |= {1000 + i: docs[3] for i in range(30)}  # ties
    asked = {i: rng.choices([f"w{j}" for j in range(62)], k=rng.randrange(1, 7)) for i in range(12)}
    scope = lambda i: "ab"[i % 2]
    wanted = {i: [None, "a", "none"][i % 3] for i in range(12)}
    *_, df, average = statistics(spark, docs)
    made = blocks.build_blocks(postings(spark, docs, scope), average).withColumn("segment", F.lit("s")).persist()
    for k in (1, 7):
        near(run(spark, made, docs, asked, k), brute(docs, df, average, asked, k, scope, {}))
        near(run(spark, made, docs, asked, k, wanted), brute(docs, df, average, asked, k, scope, wanted))
    made.unpersist()


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PART", 50)
    docs = corpus(random.Random(3), 400)
    source = postings(spark, docs)
    made = blocks.build_blocks(source, 20.0).withColumn("segment", F.lit("s"))
    rows = made.collect()
    assert max(r.n for r in rows) == 8 and len({r.part for r in rows if r.term == "w0"}) > 3, "a frequent term is many keys"
    assert all(r.max_tf == max(r.tfs) and r.min_dl == min(r.dls) for r in rows)
    back = Counter((r.term, r.id, r.dl, r.tf) for r in blocks.postings_of(made).collect())
    assert back == Counter((r.term, r.id, r.dl, r.tf) for r in source.collect())


def test_postings_read_fall_with_k(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PROBED", 20)
    rng = random.Random(5)
    docs = corpus(rng, 3000)
    *_, average = statistics(spark, docs)
    made = blocks.build_blocks(postings(spark, docs), average).withColumn("segment", F.lit("s")).persist()
    counted, real = [], blocks.scratch.written

    def written(df, name):
        out = real(df, name)
        if name in ("sums", "heads"):
            counted.append(out.count() if name == "sums" else out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(blocks.scratch, "written", written)
    asked = {1: ["w40", "w0", "w1"], 2: ["w30", "w2"]}
    for k in (1, 10, 1000):
        run(spark, made, docs, asked, k)
    (all1, few), (_, some), (_, many) = [counted[i : i + 2] for i in (0, 2, 4)]
    assert few < some <= many and few < all1 / 3, counted
    made.unpersist()


def test_dead_postings_and_empty_questions(spark):
    docs = corpus(random.Random(6), 50)
    living = {i: t for i, t in docs.items() if i >= 10}
    *_, df, average = statistics(spark, living)
    made = blocks.build_blocks(postings(spark, docs), average).withColumn("segment", F.lit("s"))
    dead = spark.createDataFrame([("s", i) for i in range(10)] + [("other", 20)], "segment string, id long")
    asked = {1: ["w0", "w5", "w5"], 2: ["unknown"]}
    near(run(spark, made, living, asked, 5, dead=dead), brute(living, df, average, asked, 5, lambda i: None, {}))
    assert run(spark, made, living, {9: ["unknown"]}, 5) == {}
