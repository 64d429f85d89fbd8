"""The clustered vector index against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import cells


def brute(vectors, questions, k):
    """Cosines of all pairs."""
    out = set()
    for q, v, scope in questions:
        if v is None:
            continue
        hits = []
        for i, w, s in vectors:
            if w is None or len(w) != len(v) or scope is not None and s != scope:
                continue
            a, b = np.array(v, float), np.array(w, float)
            size = np.linalg.norm(a) * np.linalg.norm(b)
            hits.append((-(round(float(a @ b / size), 6) if size else 0.0), i))
        out |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(hits)[:k], 1)}
    return out


def table(spark, rows, name="id", kind="long"):
    return spark.createDataFrame(rows, f"{name} {kind}, v array<double>, scope string").repartition(4)


def clustered(rng, n, dim, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(centres)] for _ in range(n)]


def indexed(spark, vectors, kind="long"):
    df = table(spark, vectors, kind=kind)
    centroids = cells.fit_centroids(df)
    packs, reach = cells.pack_cells(df, centroids)
    return cells.Cells(packs, reach, centroids)


def found(df):
    return {(r.query_id, r.id, r.score, r["rank"]) for r in df.collect()}


def near(a, b):
    """Equal but for a last digit of the rounded score."""
    key = lambda rows: sorted((q, n, s) for q, _, s, n in rows)
    x, y = key(a), key(b)
    assert [(q, n) for q, n, _ in x] == [(q, n) for q, n, _ in y]
    assert all(abs(s - t) < 2e-6 for (_, _, s), (_, _, t) in zip(x, y, strict=True))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_search_like_brute_force(spark, spread):
    rng = random.Random(int(spread * 10))
    vectors = [(i, v, rng.choice(["a", "b", "rare", None]) if i % 50 else "rare") for i, v in enumerate(clustered(rng, 700, 6, spread))]
    vectors += [(5000 + i, vectors[3][1], "a") for i in range(40)] + [(6000, None, "a"), (6001, [1.0], "a"), (6002, [0.0] * 6, "b")]
    questions = [(i, v, rng.choice([None, "a", "rare", "none"])) for i, v in enumerate(clustered(rng, 25, 6, spread))]
    questions += [(100, vectors[3][1], None), (101, None, None), (102, [0.0] * 6, None), (103, vectors[0][1], "b")]
    index = indexed(spark, vectors)
    for k in (1, 5, 60):
        near(found(cells.search(spark, index, table(spark, questions, "query_id"), k)), brute(vectors, questions, k))


def test_cells_are_skipped(spark, monkeypatch):
    """In well separated cells a question reads its own neighbourhood only, more of it for a larger k; no join is a product."""
    rng = random.Random(4)
    index = indexed(spark, [(i, v, "a") for i, v in enumerate(clustered(rng, 2000, 8, 0.02))])
    read, real = [], cells._scored

    def counting(index, asked, pairs, k):
        met = pairs.join(index.reach, "cell")
        read.append(met.agg(F.sum("n")).first()[0] or 0)
        out = real(index, asked, pairs, k)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        return out

    monkeypatch.setattr(cells, "_scored", counting)
    questions = table(spark, [(i, v, None) for i, v in enumerate(clustered(random.Random(4), 10, 8, 0.02))], "query_id")
    totals = []
    for k in (1, 500):
        read.clear()
        cells.search(spark, index, questions, k).count()
        totals.append(sum(read))
    assert totals[0] < 0.3 * 10 * 2000 and totals[0] < totals[1]


def test_string_ids_dead_ids_and_empty_tables(spark):
    vectors = [(f"v{i}", [1.0, i / 10], "a") for i in range(20)]
    index = indexed(spark, vectors, "string")
    dead = cells.Cells(index.packs.withColumn("dead", F.array(F.lit("v0"), F.lit("v1"))), index.reach, index.centroids)
    questions = table(spark, [(1, [1.0, 0.0], None)], "query_id")
    assert [r.id for r in cells.search(spark, index, questions, 2).orderBy("rank").collect()] == ["v0", "v1"]
    assert [r.id for r in cells.search(spark, dead, questions, 2).orderBy("rank").collect()] == ["v2", "v3"]
    assert {r.id for r in cells.unpack(dead.packs).collect()} == {f"v{i}" for i in range(2, 20)}
    back = {(r.id, tuple(r.v), r.scope) for r in cells.unpack(index.packs).collect()}
    assert back == {(i, tuple(v), s) for i, v, s in vectors}
    none = indexed(spark, [])
    assert cells.search(spark, none, questions, 2).count() == 0
    assert cells.search(spark, index, questions.limit(0), 2).count() == 0


def test_copies_are_many_packs(spark, monkeypatch):
    monkeypatch.setattr(cells, "PACK", 10)
    index = indexed(spark, [(i, [1.0, 1.0], "a") for i in range(300)] + [(1000, [-1.0, 0.0], "a")])
    assert index.packs.count() >= 20 and index.packs.agg(F.max(F.size("ids"))).first()[0] < 40
