import functools
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.rules import Rules
from folioscope.operators import guardrails
from folioscope.plans import services
from folioscope.sources import http as pages
from folioscope.sources import tables
from folioscope.streaming.refresh import latest_hashes, refresh_stream
from tests.test_operators import REGISTRY

CHUNKS = [
    ("m1", "The expense ratio of this fund is 0.5% per year for all investors. Midcap shares are held.", "acme-midcap-fund-direct-growth"),
    ("g1", "The exit load is nil for this fund. Government bonds are held here by the fund.", "acme-gilt-fund-direct-growth"),
    ("g2", "The expense ratio of this fund is 0.3% per year for all investors in bonds.", "acme-gilt-fund-direct-growth"),
]


def test_answers(spark):
    rows = [(c, t, s, f"https://funds.example.com/f/{s}", "Facts", "2025-01-31") for c, t, s in CHUNKS]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, scheme string, source_url string, section_title string, effective_date string")
    asked = [(1, "what is the expense ratio of acme gilt fund"), (2, "should i invest in acme gilt fund"), (3, "expense ratio of acme midcap fund"), (4, "")]
    service = services.Service(Rules(house="acme", site="funds.example.com"), guardrails.Policy(), REGISTRY, {})
    got = {r.query_id: r for r in service.answer(spark.createDataFrame(asked, "query_id int, query string"), chunks).collect()}
    assert len(got) == 4 and all(r.passed for r in got.values())
    assert got[1].answer_type == "factual" and "0.3%" in got[1].body_text and "acme-gilt" in got[1].citation_url
    assert got[3].answer_type == "factual" and "0.5%" in got[3].body_text
    assert got[2].answer_type == "refusal" and got[4].answer_type == "refusal"


def test_index_build(spark, tmp_path):
    chunks = spark.createDataFrame([(c, t) for c, t, _ in CHUNKS], "chunk_id string, text string")
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        tables.active_version(spark, root)
    first = services.build_indexes(spark, chunks, root, "20250101", {"k1": 1.5})
    second = services.build_indexes(spark, chunks.limit(2), root, "20250102")
    assert first != second and tables.active_version(spark, root)["version"] == second
    with pytest.raises(ValueError):
        services.build_indexes(spark, chunks.limit(0), root, "20250103")
    assert tables.active_version(spark, root)["chunks"] == 2


def test_readers(spark, tmp_path):
    p = tmp_path / "registry.json"
    p.write_text('{"entries": [{"id": 1, "scheme": "a", "url": "https://x.org/a", "active": true}]}')
    assert tables.read_registry(spark, str(p)).first().scheme == "a"
    lines = ["sources:", "  - scheme: a", "    url: https://x.org/a", "  - url: 'https://x.org/b'", "    scheme: b"]
    assert tables.read_source_list(spark, lines, 2).count() == 2
    for bad in ([*lines, "  - scheme: c"], [*lines, "  - scheme: c", "    url: https://x.org/a"]):
        with pytest.raises(ValueError):
            tables.read_source_list(spark, bad)
    (tmp_path / "bad.json").write_text("{oops")
    assert tables.read_json(spark, str(tmp_path / "bad.json"), "a int").first()._corrupt_record == "{oops"
    assert tables.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    rec = tables.decode_records(spark.createDataFrame([('{"chunk_id": "c", "x": "1", "text": "t"}',)], "j string"), "j").first()
    assert rec.chunk_id == "c" and rec.metadata == {"x": "1"}
    df = spark.createDataFrame([("a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("b", "no")], "body string, sha string")
    assert [r.sha_ok for r in tables.verified(df, "body", "sha").collect()] == [True, False]
    with pytest.raises(Exception, match="recorded hash"):
        tables.verified(df, "body", "sha", strict=True).collect()
    status = spark.createDataFrame([(200, "text/html", "x"), (200, "image/png", "x"), (404, "text/html", "x"), (200, "text/html", None)], "s int, c string, b string")
    assert [r[0] for r in status.select(tables.fetch_status(F.col("s"), F.col("c"), F.col("b"), F.lit(False))).collect()] == ["ok", "non_html", "failed", "failed"]
    log = str(tmp_path / "log")
    tables.append_log(spark.createDataFrame([("mail a@b.org", 1)], "query string, n int"), log, X.redact)
    assert spark.read.json(log).first().query == "mail [EMAIL_REDACTED]"


def test_http_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hi</p>")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(pages.PageSource)
        urls = [f"{base}/a.html", f"{base}/none", "http://elsewhere.invalid/x"]
        rows = {r.url: r for r in spark.read.format("pages").options(urls="\n".join(urls), hosts="127.0.0.1", tries="1").load().collect()}
        server.shutdown()
    assert bytes(rows[urls[0]].body) == b"<p>hi</p>" and rows[urls[0]].error is None
    assert rows[urls[1]].status == 404 and rows[urls[2]].error == "not_allowlisted"


def test_refresh_stream(spark, tmp_path):
    where = {n: str(tmp_path / n) for n in ("pages", "store", "changes", "checkpoint")}

    def arrive(*rows):
        spark.createDataFrame(rows, "url string, text string, at string").select("url", "text", F.col("at").cast("timestamp").alias("fetched_at")).write.mode("append").parquet(where["pages"])
        refresh_stream(spark, **where).awaitTermination()

    arrive(("a", "one", "2025-01-01"), ("b", "two", "2025-01-01"))
    arrive(("a", "one changed", "2025-01-02"), ("b", None, "2025-01-02"), ("c", "new", "2025-01-02"))
    got = {(r.batch, r.url): r.status for r in spark.read.parquet(where["changes"]).collect()}
    assert got == {(0, "a"): "baseline", (0, "b"): "baseline", (1, "a"): "changed", (1, "b"): "failed", (1, "c"): "baseline"}
    assert latest_hashes(spark, where["store"]).count() == 3
    before = {r.url: r.hash for r in latest_hashes(spark, where["store"]).collect()}
    arrive(("a", "x", "2025-01-03"), ("b", "y", "2025-01-03"), ("c", "z", "2025-01-03"))
    assert {r.url: r.hash for r in latest_hashes(spark, where["store"]).collect()} == before, "three changes at once freeze the store"


def test_answers_from_the_index(spark, tmp_path, monkeypatch):
    rows = [(c, t, s, f"https://funds.example.com/f/{s}", "Facts", "2025-01-31") for c, t, s in CHUNKS]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, scheme string, source_url string, section_title string, effective_date string")
    root = str(tmp_path / "index")
    services.build_indexes(spark, chunks, root, "20250101")
    index = services.load_index(spark, root)
    asked = spark.createDataFrame([(1, "what is the expense ratio of acme gilt fund"), (2, "exit load of acme gilt fund"), (3, "weather")], "query_id int, query string")
    service = services.Service(Rules(house="acme", site="funds.example.com"), guardrails.Policy(), REGISTRY, {})
    fresh = sorted(map(str, service.answer(asked, chunks).collect()))
    monkeypatch.setattr(services.keyword, "bm25_topk", lambda *a, **k: 1 / 0)
    embedded = []
    real = services.vectors.hash_embedding
    monkeypatch.setattr(services.vectors, "hash_embedding", lambda df, *a: embedded.append(df.columns) or real(df, *a))
    assert sorted(map(str, service.answer(asked, index=index).collect())) == fresh
    assert all("chunk_id" not in c for c in embedded), "only questions are embedded"
    with pytest.raises(ValueError):
        services.load_index(spark, root, "other_model")
    got = service.answer_within(asked, 300, index=index).collect()
    assert len(got) == 3 and {r.status for r in got} == {200}
    late = service.answer_within(asked, 0.01, index=index).collect()
    assert {(r.code, r.status) for r in late} == {("upstream_timeout", 503)} and len(late) == 3
    assert spark.range(5).count() == 5


def test_rule_files(tmp_path):
    import json

    from folioscope.sources import bundles

    put = lambda name, doc: (tmp_path / name).write_text(json.dumps(doc)) and str(tmp_path / name)
    assert bundles.load_cases(put("c.json", {"probes": [{"id": "a"}]})) == [{"id": "a"}]
    assert bundles.load_phrases(put("p.json", {"phrases": {"advisory": ["buy"]}, "x": 1})) == [("advisory", ["buy"])]
    assert bundles.load_templates(put("t.json", {"templates": {"a": "It is {value}."}})) == {"a": "It is {value}."}
    with pytest.raises(ValueError):
        bundles.load_templates(put("b.json", {"a": "{other}"}))


def test_errors_of_lookups(spark):
    from folioscope.operators import corpus

    registry = spark.createDataFrame([("a", "https://x.org/a")], "scheme string, url string")
    assert corpus.by_scheme(registry, "a", required=True).first().url == "https://x.org/a"
    with pytest.raises(KeyError):
        corpus.by_scheme(registry, "b", required=True)
    urls = spark.createDataFrame([("https://www.x.org/a/",)], "url string")
    assert urls.select(corpus.require_allowed(F.col("url"), ["https://x.org/a"])).first()[0] == "https://x.org/a"
    with pytest.raises(Exception, match="not allowlisted"):
        urls.select(corpus.require_allowed(F.col("url"), ["https://x.org/b"])).collect()
    for status, reason in ((301, "Redirect detected"), (404, "404 for"), (500, "HTTP 500")):
        with pytest.raises(Exception, match=reason):
            corpus.strict_pages(urls.withColumn("http_status", F.lit(status))).collect()
    assert corpus.check_defaults({"a": "One. Two."}) == {"a": 2}
    with pytest.raises(ValueError):
        corpus.check_defaults({"a": "One. Two. Three. Four."})
    contract = corpus.hybrid_contract("v", "m", 3)
    manifest = {"index_version": "v", "embedding_model_id": "m", "partial_corpus": False, "schemes_indexable": 16, "total_chunks": 3, "benchmark_passed": True, "recall_at_k": 0.9}
    assert corpus.handoff_document(manifest, contract)["hybrid_api_surface"]["merge_keys"] == ["chunk_id", "source_url", "scheme"]
