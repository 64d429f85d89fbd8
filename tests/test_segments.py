"""The segmented index: updates and merges give what a full build gives, and write in proportion to what changed."""

import functools
import http.server
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from folioscope.operators import keyword
from folioscope.plans import segments, services
from folioscope.sources import tables

KIND = "chunk_id string, text string, scheme string, source_url string"


def texts(rng, words=80):
    return " ".join(rng.choice([f"word{i}" for i in range(words)]) for _ in range(rng.randrange(3, 30)))


def rows_of(rng, sources, tag):
    return [(f"{s}-{tag}-{i}", texts(rng), f"s{s % 3}", f"u{s}") for s in sources for i in range(2)]


def answers(spark, index, asked, k=6):
    """Hits of both channels, as scores by rank: equal scores may come in the order of any ids that both have."""
    terms = keyword.query_terms(asked, "query_id", "query")
    scopes = asked.select("query_id", "scope")
    words = index.keyword_topk(terms, k, scopes).collect()
    near = index.vector_topk(segments.vectors.dense(segments.vectors.hash_embedding(asked, "query_id", "query", segments.MODEL)).withColumnRenamed("id", "query_id").join(scopes, "query_id"), k).collect()
    return [{(r.query_id, r["rank"], r.id, round(r.score, 5)) for r in rows} for rows in (words, near)]


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}


def test_updates_and_merges_like_a_full_build(spark, tmp_path):
    rng = random.Random(7)
    live = {s: rows_of(rng, [s], "a") for s in range(40)}
    asked = spark.createDataFrame([(i, texts(rng), [None, "s1", "none"][i % 3]) for i in range(9)], "query_id int, query string, scope string")
    root = str(tmp_path / "i")
    put = lambda rows: spark.createDataFrame(rows, KIND)
    index = segments.create(spark, put([r for rows in live.values() for r in rows]), root, "v")
    earlier = index

    def whole(name):
        return segments.create(spark, put([r for rows in live.values() for r in rows]), str(tmp_path / name), "v")

    start = answers(spark, index, asked)
    for step, changed in enumerate(([3, 4], [4, 50], [5])):
        fresh = {s: rows_of(rng, [s], f"b{step}") for s in changed}
        gone = [7 + step]
        before = files(root)
        index = segments.update(spark, root, put([r for rows in fresh.values() for r in rows]), spark.createDataFrame([(f"u{s}",) for s in gone], "source_url string"))
        assert before <= files(root), "nothing that was written before is touched"
        live |= fresh
        for s in gone:
            del live[s]
    assert len(index.manifest["segments"]) == 4 and index.manifest["chunks"] == sum(map(len, live.values()))
    full = whole("full")
    assert answers(spark, index, asked) == answers(spark, full, asked)
    assert index.stats.first() == full.stats.first()
    assert {tuple(r) for r in index.terms.collect()} == {tuple(r) for r in full.terms.collect()}
    merged = segments.merge(spark, root, everything=True)
    assert len(merged.manifest["segments"]) == 1 and not merged.manifest["tombstones"]
    assert answers(spark, merged, asked) == answers(spark, full, asked)
    assert answers(spark, earlier, asked) == start, "a reader of an earlier version goes on"
    assert {r.chunk_id for r in merged.chunks.collect()} == {r[0] for rows in live.values() for r in rows}


def test_only_segments_of_a_size_are_merged(spark, tmp_path):
    rng = random.Random(8)
    root = str(tmp_path / "i")
    put = lambda sources: spark.createDataFrame(rows_of(rng, sources, "a"), KIND)
    segments.create(spark, put(range(20)), root, "v")
    for s in range(100, 104):
        segments.update(spark, root, put([s]))
    big = max(segments.load(spark, root).manifest["segments"], key=lambda s: s["n"])["id"]
    merged = segments.merge(spark, root)
    assert sorted(s["n"] for s in merged.manifest["segments"]) == [8, 40]
    assert big in {s["id"] for s in merged.manifest["segments"]}, "the large segment is not rewritten"
    assert segments.merge(spark, root).manifest["seq"] == merged.manifest["seq"], "nothing to do makes no version"


def test_what_is_written_follows_the_change(spark, tmp_path):
    """One source of 200 changes: the new files have about one chunk in 200 of the bytes of rows, counted in rows."""
    rng = random.Random(9)
    root = str(tmp_path / "i")
    segments.create(spark, spark.createDataFrame(rows_of(rng, range(200), "a"), KIND), root, "v")
    index = segments.reingest(spark, root, spark.createDataFrame(rows_of(rng, [5], "b"), KIND), "u5")
    old, new = index.manifest["segments"]
    assert (old["n"], new["n"]) == (398, 2)
    rows = lambda s, name: spark.read.parquet(f"{root}/segments/{s['id']}/{name}").count()
    assert rows(new, "chunks") == 2 and rows(new, "blocks") < 60 and rows(new, "packs") <= 2
    stone = index.manifest["tombstones"][0]
    assert spark.read.parquet(f"{root}/tombstones/{stone}/ids").count() == 2
    gone = segments.reingest(spark, root, spark.createDataFrame([], KIND), "u5")
    assert gone.manifest["chunks"] == 398 and gone.chunks.where("source_url = 'u5'").count() == 0


def test_two_writers(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    root = str(tmp_path / "i")
    segments.create(spark, spark.createDataFrame(rows_of(rng, range(3), "a"), KIND), root, "v")
    real = segments._segment

    def slow(*args):
        """While the first writer writes, a second one starts and commits."""
        monkeypatch.setattr(segments, "_segment", real)
        segments.update(spark, root, spark.createDataFrame(rows_of(rng, [1], "second"), KIND))
        return real(*args)

    monkeypatch.setattr(segments, "_segment", slow)
    with pytest.raises(tables.ActivationConflict):
        segments.update(spark, root, spark.createDataFrame(rows_of(rng, [2], "first"), KIND))
    left = {r.chunk_id for r in segments.load(spark, root).chunks.collect()}
    assert left == {"0-a-0", "0-a-1", "1-second-0", "1-second-1", "2-a-0", "2-a-1"}


def test_activation(spark, tmp_path):
    root = str(tmp_path / "v")
    assert tables.activate(spark, root, "one", 0) == 1
    with pytest.raises(tables.ActivationConflict):
        tables.activate(spark, root, "other", 0)
    assert tables.activate(spark, root, "two", 1) == 2
    (tmp_path / "v" / "_active" / "000000000003.json").touch()  # a writer that died
    assert tables.active_version(spark, root)["version"] == "two"
    assert tables.activate(spark, root, "three") == 4 and tables.active_version(spark, root)["version"] == "three"


def test_one_url_from_fetch_to_index(spark, tmp_path):
    folder = tmp_path / "site"
    folder.mkdir()
    (folder / "a.html").write_text("<html><body><main><h1>Fund A</h1><p>" + "The exit load is nil. " * 30 + "</p></main></body></html>")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(folder))
    root = str(tmp_path / "i")
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_port}"
        segments.create(spark, spark.createDataFrame([("x", "old words", "s", f"{base}/a.html"), ("y", "others stay", "s", "elsewhere")], KIND), root, "v")
        index = services.reingest_url(spark, root, f"{base}/a.html", "127.0.0.1", "s", tries="1")
        for url, why in ((f"{base}/none", "404"), ("http://elsewhere.invalid/x", "not_allowlisted")):
            with pytest.raises(RuntimeError, match=why):
                services.reingest_url(spark, root, url, "127.0.0.1", tries="1")
        server.shutdown()
    rows = {r.source_url: r for r in index.chunks.collect()}
    assert "exit load is nil" in rows[f"{base}/a.html"].text and rows["elsewhere"].chunk_id == "y" and not any(r.chunk_id == "x" for r in rows.values())
    asked = spark.createDataFrame([(1, "exit load")], "query_id int, query string")
    assert index.keyword_topk(keyword.query_terms(asked, "query_id", "query"), 1).first().id == rows[f"{base}/a.html"].chunk_id
    assert segments.load(spark, root).manifest["seq"] == index.manifest["seq"], "what failed changed nothing"


def test_everything_removed(spark, tmp_path):
    root = str(tmp_path / "i")
    rows = rows_of(random.Random(1), range(2), "a")
    segments.create(spark, spark.createDataFrame(rows, KIND), root, "v")
    index = segments.update(spark, root, spark.createDataFrame([], KIND), spark.createDataFrame([("u0",), ("u1",), ("u9",), (None,)], "source_url string"))
    assert index.manifest["chunks"] == 0 and index.manifest["segments"] == []
    with pytest.raises(ValueError):
        segments.load(spark, root)
    assert segments.create(spark, spark.createDataFrame(rows, KIND), root, "w").manifest["chunks"] == 4
    with pytest.raises(ValueError):
        segments.load(spark, root, "another")
    assert segments.load(spark, root).chunks.where(F.col("effective_date").isNull()).count() == 4
