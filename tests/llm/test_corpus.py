"""Operators that compare rows: shards, vectors, lines, shingles, mixing, components, and the pipeline."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import bpe, hilbert, langid, linededup, mixing, partenum, queries, subspace
from folioscope.llm.common import components
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return "\0" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    order = sorted(df.columns)
    assert sorted(columns) == order
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


def closure(ids, links):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, edges[0], (7, 7), (None, 3)], "u long, v long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k != j and want[j] == v for j in want)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- shards ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 4), (4, 3), (1, 5)])
def test_curve_visits_each_cell_stepwise(dims, bits):
    table = np.array(hilbert.curve_table(dims, bits))
    path = np.argsort(table)
    assert sorted(table) == list(range(len(table)))
    coords = np.stack([(path >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)], axis=1)
    assert (np.abs(np.diff(coords, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, n_shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts[s] for s in range(n_shards)) - min(counts[s] for s in range(n_shards)) <= 1
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r)
    for held in slots.values():
        held.sort(key=lambda r: r.slot)
        assert [r.slot for r in held] == list(range(len(held)))
        assert [r.curve for r in held] == sorted(r.curve for r in held)
    ordered = [(r.shard, r.curve) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert [c for _, c in ordered] == sorted(c for _, c in ordered)


def test_shard_query(spark):
    rows = queries.op3_hilbert_shards(spark, SF).collect()
    source = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_shards(rows, 40)
    import zlib

    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(v) + 16, zlib.crc32(v)) for k, v in source.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_shard_edges(spark):
    rows = [(i % 50 if i % 7 else None, None if i % 5 == 0 else f"s{i % 3}", None if i % 4 == 0 else float(i), "clash") for i in range(333)] + [(1, "s1", float("nan"), "c")] * 200
    df = spark.createDataFrame(rows, "doc_id long, lang string, x double, shard string")
    got = hilbert.hilbert_shards(df, ("lang", "x"), n_shards=7, bits=3).collect()
    assert len(got) == len(rows)
    check_shards(got, 7)
    assert hilbert.hilbert_shards(df.limit(0), ("lang", "x")).count() == 0
    check_shards(hilbert.hilbert_shards(df.limit(3), ("lang", "x"), n_shards=5).collect(), 5)
    with pytest.raises(ValueError):
        hilbert.curve_table(5, 5)


def test_cells_and_curve_indices(spark):
    """Classes by quantiles of whole values, recomputed in plain Python, and each row's index from the curve's own table."""
    rng = random.Random(5)
    names = [None, "crawl-2023-a", "crawl-2023-b", "crawl-2023-c", "zebra", ""]
    rows = [(i, rng.choice(names), rng.choice([None, 1, 5, 5, 9, 1000])) for i in range(400)]
    rows[0] = (0, "x" * 100_000, 7)
    got = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, name string, size int"), ("name", "size"), n_shards=9, bits=2).collect()
    check_shards(got, 9)

    def cuts(values, low):
        held = sorted(((low, "") if v is None else (1, v)) for v in values)
        return {held[-(-len(held) * k // 4) - 1] for k in (1, 2, 3)} - {(low, "")}

    by_name, by_size = cuts([r[1] for r in rows], 0), cuts([r[2] for r in rows], 0)
    table = hilbert.curve_table(2, 2)
    for r in got:
        cell = sum(r.name is not None and r.name > v for _, v in by_name) * 4 + sum(r.size is not None and r.size > v for _, v in by_size)
        assert r.curve == table[cell]


def test_written_shards(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS doc_id", "id % 10 AS a", "id div 10 AS b")
    hilbert.write_shards(hilbert.hilbert_shards(df, ("a", "b"), n_shards=4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.count("*").alias("n"), (F.max("a") - F.min("a")).alias("w")).collect()
    assert [r.n for r in back] == [25] * 4 and all(r.w < 9 for r in back)


# -- vectors --------------------------------------------------------------------------------------------------------


def brute_vectors(rows, threshold):
    ids = [r[0] for r in rows]
    links = []
    for i, (a, u, la) in enumerate(rows):
        for b, v, lb in rows[:i]:
            if la is not None and la == lb and usable(u) and usable(v) and len(u) == len(v):
                x, y = np.array(u, float), np.array(v, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    n = Counter([a for a, _ in links] + [b for _, b in links])
    comp = closure(ids, links)
    return {i: (n[i], comp[i], comp[i] == i) for i in ids}


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("side", [3000, 5])
def test_vectors(spark, monkeypatch, side):
    monkeypatch.setattr(subspace, "MAX_SIDE", side)
    rng = np.random.default_rng(4)
    rows, centers = [], rng.normal(size=(6, 20))
    for i in range(150):
        c = centers[i % 6] + rng.normal(size=20) * rng.choice([0.02, 0.1, 0.15, 0.3])
        rows.append((i, c.astype(np.float32).tolist(), int(i % 2)))
    same = rows[0][1]
    rows += [(200 + i, same, 0) for i in range(10)] + [(300, [2 * x for x in same], 0), (301, [-x for x in same], 0), (302, same, None)]
    rows += [(400, None, 0), (401, [0.0] * 20, 0), (402, [float("nan")] + [1.0] * 19, 0), (403, [None] + [1.0] * 19, 0), (404, [1.0, 2.0], 0), (405, [1.0, 2.0], 0), (406, [float("inf")] * 20, 0), (407, [3.0], 1), (408, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in subspace.near_duplicates(df).collect()}
    assert got == brute_vectors(rows, 0.98)
    assert subspace.near_duplicates(df.limit(0)).count() == 0


def test_block_pairs_are_all_pairs_within_the_radius(monkeypatch):
    rng = np.random.default_rng(8)
    for most in (1 << 18, 50):
        monkeypatch.setattr(subspace, "MAX_PAIRS", most)
        z = np.concatenate([rng.normal(size=(150, 8)) * 0.125, np.repeat(rng.normal(size=(3, 8)) * 0.1, 20, axis=0) + rng.normal(size=(60, 8)) * 0.01])
        near = ((z[:, None] - z[None]) ** 2).sum(2) <= 0.07**2
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
        sides = [np.arange(0, 210, 2), np.arange(1, 210, 2)]
        got = [p for i, j, _ in subspace.near_in_block(z, 0.07, np.arange(210), np.arange(210)) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        got = [(min(p), max(p)) for i, j, _ in subspace.near_in_block(z, 0.07, *sides) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if sum(p) % 2}


def test_vectors_of_large_labels_are_dealt_finer(spark, monkeypatch):
    monkeypatch.setattr(subspace, "GRID_FROM", 10)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=20) * 0.02 + (i % 4 == np.arange(20) % 4)).astype(np.float32).tolist(), i % 2, "clash") for i in range(80)]
    got = subspace.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")).collect()
    want = brute_vectors([r[:3] for r in rows], 0.98)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want and any(n for n, *_ in want.values())


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.001], 0), (3, [1.0, 0.001, 0.0], 0), (4, [0.0, 1.0, 0.0], 0)]
    got = subspace.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]


# -- lines ----------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_chars, min_docs):
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", s))
    where = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    where.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == i]
        gone = len(lines) - len(kept)
        out.append((i, len(lines), gone, "\n".join(kept) if gone else t))
    return sorted(map(str, out))


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_lines(spark, batches):
    rng = random.Random(batches)
    pool = ["Common line ÄÖ number one", "\tCommon Line ÄÖ NUMBER one \x0b", "common line äö number one", "second common line here!", "short", "", " ", "\u00a0second common line here!", "x" * 5000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    rows += [(5, rows[5][1]), (6, "another text of six\nsecond common line here!"), (None, pool[0]), (100, None), (101, ""), (102, "\n" * 3000 + pool[3])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int")
    got = linededup.dedup_lines(df, min_chars=12, min_docs=3, batches=batches).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_lines(rows, 12, 3)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_the_query_compacts(spark, monkeypatch):
    """With the settings of the registered query, levels fill and are merged, and the runs are gone at the end."""
    seen, dropped = [], []
    real = linededup.LineRuns.add

    def add(self, batch):
        real(self, batch)
        seen.append([len(x) for x in self.levels])

    monkeypatch.setattr(linededup.LineRuns, "add", add)
    monkeypatch.setattr(linededup.LineRuns, "drop", lambda self, was=linededup.LineRuns.drop: (dropped.append(self.runs()), was(self)))
    queries.op8_line_runs(spark, SF)
    assert seen == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert dropped and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    monkeypatch.setattr(linededup.LineRuns, "keys", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.op8_line_runs(spark, SF)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_one_very_long_text(spark):
    long = "\n".join(["a line that five documents have, in the end"] + [f"line {i} of a very long text, which only it has" for i in range(20_000)])
    rows = [(i, "a line that five documents have, in the end") for i in range(5)] + [(9, long)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: (1, 1) for i in range(5)}, 9: (20_001, 0)}


def test_runs_are_compacted(spark):
    runs = linededup.LineRuns(spark, n_buckets=2, fan_out=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(i, i, 1, 100 - b) for i in range(b, b + 3)], "h1 long, h2 long, n_docs long, keep_doc long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {r.h1: (r.n_docs, r.keep_doc) for r in runs.keys().collect()}
    assert got == {0: (1, 100), 1: (2, 100), 2: (3, 100), 3: (3, 99), 4: (3, 98), 5: (2, 97), 6: (1, 96)}
    fresh = runs.fresh(spark.createDataFrame([(2, 2), (9, 9)], "h1 long, h2 long")).collect()
    assert [r.h1 for r in fresh] == [9]
    runs.drop()


# -- shingles -------------------------------------------------------------------------------------------------------


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


@pytest.mark.parametrize("scheme", [partenum.Scheme(3, 90, 100), partenum.Scheme(5, 80, 100)])
@pytest.mark.parametrize("side", [1_500_000, 300])
def test_shingle_groups(spark, monkeypatch, scheme, side):
    monkeypatch.setattr(partenum, "MAX_SIDE", side)
    rng = random.Random(side)
    voc = [f"w{i}é" for i in range(500)]
    rows = []
    for g in range(12):
        base = rng.choices(voc, k=rng.choice([4, 8, 15, 40, 120, 300]))
        for _ in range(6):
            b = list(base)
            for _ in range(rng.randint(0, max(1, len(b) // 25))):
                b[rng.randrange(len(b))] = rng.choice(voc)
            rows.append((len(rows), " ".join(b).upper() if rng.random() < 0.3 else "\n".join(b)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "x" * 100_000)] + [(910 + i, rows[0][1]) for i in range(20)]
    sets = {i: shingles(t, scheme.words) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and scheme.links(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))]
    want = closure(sets, links)
    df = spark.createDataFrame([*rows, (None, rows[1][1]), rows[2]], "doc_id long, text string")
    got = partenum.shingle_groups(df, scheme, slices=2).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(sets[i]), want[i]) for i in sets}
    assert partenum.shingle_groups(df.limit(0), scheme).count() == 0


def test_common_passages_and_short_sets(spark):
    """Many documents share passages, some of them are near copies: heavy signatures, sets that can spare them and sets that can't, and sets of few shingles."""
    rng = random.Random(77)
    voc = [f"v{i}" for i in range(4000)]
    passages = [rng.choices(voc, k=60) for _ in range(3)]
    rows = []
    for i in range(150):
        body = rng.choices(voc, k=rng.choice([5, 60, 200]))
        for p in passages[: i % 4]:
            at = rng.randrange(len(body) + 1)
            body = body[:at] + p + body[at:]
        rows.append((len(rows), " ".join(body)))
        if i % 5 == 0:
            body[rng.randrange(len(body))] = "other"
            rows.append((len(rows), " ".join(body)))
    base = rng.choices(voc, k=14)
    for n in (8, 9, 10, 11, 12, 13, 14):  # sets of four to ten shingles of five words
        for _ in range(20):
            words = [rng.choice(voc) if rng.random() < 0.03 else w for w in base[:n]]
            rows.append((len(rows), " ".join(words)))
    scheme = partenum.Scheme(5, 80, 100)
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if b < a and scheme.links(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))]
    got = partenum.shingle_groups(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node long, sig string"), scheme, leads=True).collect()
    want = closure(sets, links)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in got if r.lead} == set(want.values())


def test_few_shingles_give_all_their_deletions():
    rng = np.random.default_rng(3)
    scheme = partenum.Scheme(5, 80, 100)
    h = np.sort(rng.integers(1, 2**63, (2000, 6), dtype=np.int64).astype(np.uint64), axis=1).ravel()
    sig, owner, instance, margin = partenum.signatures(h, np.full(2000, 6), scheme)
    assert np.unique(sig, return_counts=True)[1].max() == 1, "no two of these sets have a signature in common"


def test_same_id_with_other_text(spark):
    rows = [(3, "one two three four five six seven eight"), (5, "one two three four five six seven eight"), (5, "a text of its own that is like no other here"), (5, None), (3, "one two three four five six seven eight"), (None, "x y z")]
    got = partenum.shingle_groups(spark.createDataFrame(rows, "doc_id long, text string"), partenum.Scheme(5, 80, 100), leads=True).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.lead) for r in got) == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True)]


def test_signatures_miss_nothing():
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(3000)]
    for scheme in (partenum.Scheme(3, 90, 100), partenum.Scheme(5, 80, 100)):
        for n in (6, 9, 14, 30, 90, 400, 1500):
            texts = []
            base = rng.choices(voc, k=n)
            for _ in range(10):
                b = list(base)
                for _ in range(rng.randint(0, max(1, n // 35))):
                    b[rng.randrange(len(b))] = rng.choice(voc)
                texts.append(" ".join(b[: int(len(b) * rng.choice([1, 1, 0.9]))]).encode())
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            h, counts = partenum.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), ends, scheme.words)
            sig, owner, *_ = partenum.signatures(h, counts, scheme)
            at = np.concatenate([[0], np.cumsum(counts)])
            sets = [set(h[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            sigs = [set(sig[owner == i].tolist()) for i in range(len(sets))]
            for i in range(len(sets)):
                for j in range(i):
                    if sets[i] != sets[j] and scheme.links(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                        assert sigs[i] & sigs[j]


# -- mixing ---------------------------------------------------------------------------------------------------------


def test_mix_reaches_the_weights(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id < 5000, 'big', if(id < 5900, 'small', null)) AS source", "'clash' AS copy")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), (None, 1.0), ("absent", 2.0)], "source string, weight double")
    mixed = mixing.poisson_mix(df, weights, total=8000)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["big"] - 8000 / 5) < 150 and abs(counts["small"] - 4800) < 300 and abs(counts[None] - 1600) < 200
    again = mixing.poisson_mix(df.repartition(3), weights, total=8000)
    rows = lambda d: sorted((r.doc_id, r.copy) for r in d.collect())
    assert rows(mixed) == rows(again)
    per_doc = Counter(r.doc_id for r in mixed.collect() if r.source == "small")
    mean = 4800 / 900
    assert abs(np.var([per_doc[i] for i in range(5000, 5900)]) - mean) < 1.2
    assert mixing.poisson_mix(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, source string")
    assert {r.copy for r in mixing.poisson_mix(ties, total=40).collect()} >= {0}


def test_mix_reaches_the_weights_of_tiny_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 100)
    df = spark.range(20004).selectExpr("id AS doc_id", "if(id < 20000, 'big', 'tiny') AS source")
    mixed = mixing.poisson_mix(df).where("source = 'tiny'")
    rows = sorted((r.doc_id, r.copy) for r in mixed.collect())
    counts = Counter(i for i, _ in rows)
    assert abs(len(rows) - 10002) < 500, "five standard deviations"
    assert all(abs(counts[i] - 10002 / 4) < 300 for i in range(20000, 20004)) and len(set(counts.values())) > 1
    assert rows == [(i, k) for i in sorted(counts) for k in range(counts[i])]
    assert rows == sorted((r.doc_id, r.copy) for r in mixing.poisson_mix(df.repartition(3)).where("source = 'tiny'").collect())
    assert abs(mixed.first().rate - 10002 / 4) < 1e-9


def test_mix_of_a_rate_of_hundreds(spark):
    df = spark.range(10_001).selectExpr("id AS doc_id", "if(id < 10000, 'many', 'one') AS source", "if(id = 10000, repeat('x', 200000), 'y') AS text")
    mixed = mixing.poisson_mix(df.drop("text"), seed="s").where("source = 'one'")
    n = mixed.count()
    assert abs(n - 5000.5) < 5 * 5000**0.5 and mixed.first().rate == 5000.5
    sized = mixing.poisson_mix(df, size=F.octet_length("text")).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r.source for r in sized} == {"many", "one"}


# -- pipeline -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("case", ["odd", "empty", "unlabelled"])
def test_pipeline_edges(spark, case):
    """Nulls in every column, empty and long texts, repeats, shared ids, and more columns than expected, through all stages."""
    long = "the cat and the dog went home again and " * 5000
    rows = [
        (1, "the cat and the dog are here, in this house of ours", "en", "a", 50), (2, "der Hund und die Katze sind hier, in diesem unserem Haus", "de", "b", 55), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, long, "en", None, None), (None, "the cat and the dog are away, in that house", None, "a", 4), (1, "the cat and the dog are here, in this house of ours", "en", "a", 50),
        (2, "the dog and a cat have another text under an old id", "en", "b", 51), (6, "12 34 !?", "de", "b", 8), (7, "der Hund und die Katze sind hier, in diesem unserem Haus", "de", "b", 55),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mark string, lead int")
    if case == "empty":
        df = df.limit(0)
    if case == "unlabelled":
        df = df.withColumn("lang", F.lit(None).cast("string"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.written(stage(spark, df, SF), f"edge_{name}")
        kept[name] = [(r.doc_id, r.text) if name != "tokens" else (r.doc_id, r.n_tokens) for r in df.collect()]
    if case == "empty":
        assert not any(kept.values())
        return
    assert len(kept["language"]) == (7 if case == "odd" else 10), "texts without a letter go, but only where languages were learned"
    assert len(kept["lines"]) == len(kept["language"])
    near = kept["near_duplicates"]
    assert sorted(i or 0 for i, t in near if t) == sorted([0, 1, 2, 2, 5] + ([4, 6] if case == "unlabelled" else []))[: len(near)] or case == "unlabelled"
    assert len(set(near)) == len(near) and (7, rows[1][1]) not in near and sum(i == 1 for i, _ in near) == 1 and sum(i == 2 for i, _ in near) == 2
    assert {t for _, t in kept["mix"]} <= {t for _, t in near}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = set(docs.columns), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        kept[name] = len(rows)
        if name != "tokens":
            assert set(docs.columns) == columns
        if name == "language":
            net = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where(~queries.held_out()), "text", "lang", "doc_id")
            names, scores = langid.predict_texts(net, [before[i].text for i in sorted(before)])
            assert {r.doc_id for r in rows} == {i for i, n, s in zip(sorted(before), names, scores, strict=True) if n != "und" and s >= corpus_pipeline.MIN_SHARE}
        if name == "lines":
            want = brute_lines([(i, r.text) for i, r in before.items()], 40, 5)
            assert sorted(r.text for r in rows) == sorted(eval(x, {})[3] for x in want)
        if name == "near_duplicates":
            sets = {i: shingles(r.text, 5) for i, r in before.items()}
            links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert {r.doc_id for r in rows} == {i for i, c in closure(sets, links).items() if i == c}
        if name == "mix":
            assert {r.doc_id for r in rows} <= set(before) and all(before[r.doc_id].text == r.text for r in rows)
        if name == "tokens":
            codec = bpe.Codec(bpe.read_rank_file(__import__("public_tokenizers").path(queries.RANKS)), __import__("public_tokenizers").PATTERN)
            assert all(r.ids == codec.encode(before[r.doc_id].text or "") for r in rows)
    assert corpus_pipeline.run(spark, SF).count() == kept["tokens"]
