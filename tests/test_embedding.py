"""Embedding providers: registry, batches, retries; and dispatch of chunking strategies."""

import pytest

from folioscope.operators import chunking, embedding


def test_provider_registry_and_batches():
    with pytest.raises(KeyError, match="letters_v1"):
        embedding.provider("none")
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    p = embedding.Provider("t", flaky, batch=3, pause=0)
    assert list(embedding.in_batches(["a", "bb", "ccc", "d"], p)) == [[1.0], [2.0], [3.0], [1.0]] and calls == [3, 3, 1]
    with pytest.raises(ValueError, match="0 vectors"):
        list(embedding.in_batches(["a"], embedding.Provider("u", lambda t: [], pause=0)))


def test_chunking_strategies(spark):
    df = spark.createDataFrame([(1, "# a\n\n" + "some words of a text. " * 200)], "id long, text string")
    assert chunking.chunk(df, "id", "text").count() == chunking.sliding_chunks(df, "id", "text").count() > 1
    with pytest.raises(ValueError):
        chunking.chunk(df, "id", "text", "other")


def test_http_provider(monkeypatch):
    import http.server
    import json
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers["Authorization"], body["model"], body.get("dimensions")))
            data = json.dumps({"data": [{"index": i, "embedding": [len(t), i]} for i, t in reversed(list(enumerate(body["input"])))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        call = embedding.HttpEmbed(f"http://127.0.0.1:{server.server_port}/", "m", "EMBEDDING_TEST_KEY", 2)
        with pytest.raises(KeyError):
            call(["a"])
        monkeypatch.setenv("EMBEDDING_TEST_KEY", "k")
        assert list(embedding.in_batches(["a", "bbb"], embedding.Provider("m", call))) == [[1.0, 0.0], [3.0, 1.0]]
        server.shutdown()
    assert asked == [("Bearer k", "m", 2)]


def test_a_model_decides_what_the_rules_leave_open(spark):
    from folioscope.operators import intent

    df = spark.createDataFrame([(1, "expense ratio of acme"), (2, "tell a story"), (3, "a riddle"), (4, "")], "id int, q string")
    ruled = {r.id: r for r in intent.classify_with(df, "q", None).collect()}
    told = {r.id: r for r in intent.classify_with(df, "q", lambda q: {"tell a story": "advisory"}.get(q, "nonsense")).collect()}
    assert told[2].intent == "advisory" and told[2].action == "refuse" and told[2].reasons[-1] == "model"
    assert all(told[i] == ruled[i] for i in (1, 3, 4))


def test_registry_table_is_the_registry_list(spark):
    from folioscope.operators import resolve

    rows = [("acme-midcap-fund-direct-growth", "Acme Midcap Fund Direct Growth"), ("acme-elss-direct-growth-plan", "ACME ELSS Tax’s Saver — Growth"), ("other-fund", ""), ("acme-a", "Acme  Very  Long Direct Plan")]
    df = spark.createDataFrame([(s, f"https://x.org/{s}", d) for s, d in rows], "scheme string, url string, scheme_display_name string")
    got = {r.scheme: r for r in resolve.registry_index(df, "acme").collect()}
    for s, d in rows:
        want = resolve.scheme_record(s, f"https://x.org/{s}", d, "acme")
        assert (got[s].display, got[s].core, got[s].spaced, tuple(got[s].tokens)) == (want.display, want.core, want.spaced, want.tokens)
    asked = spark.createDataFrame([(1, "expense ratio of acme midcap"), (2, "nothing")], "id int, q string")
    aliases = spark.createDataFrame([("midcap", "acme-midcap-fund-direct-growth")], "phrase string, scheme string")
    found = resolve.exact_matches(asked, "id", "q", resolve.registry_index(df, "acme"), aliases, "acme").collect()
    assert [(r.query_id, r.scheme, r.method, r.rank) for r in found] == [(1, "acme-midcap-fund-direct-growth", "alias", 1)]
