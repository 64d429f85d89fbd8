"""A registry as a table gives what the loop over its schemes gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import resolve

WORDS = "midcap gilt liquid infrastructure banking technology consumption opportunities international value dividend balanced hybrid savings pharma healthcare energy global emerging momentum".split()


def registry(rng, n):
    out = {}
    while len(out) < n:
        words = rng.sample(WORDS, rng.choice([1, 1, 2, 2, 3, 5]))
        slug = "acme-" + "-".join(words) + rng.choice(["-fund", "", "-etf"]) + "-direct-growth"
        out[slug] = " ".join(["Acme", *words, rng.choice(["Fund Direct Growth", "Fund - Direct Plan", "of India and the World Fund"])])
    return list(out.items())


def spoiled(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("aeiou tz") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]]) or "a"
    return text


def questions(rng, rows, n):
    out = [None, "", "a", "acme", "acme or acme", "’‘ weather", "what about acme midcap or acme gilt vs acme liquid", "İstanbul", "https://funds.example.com/f/" + rows[0][0] + "?x"]
    for _ in range(n):
        slug, name = rng.choice(rows)
        core = name.lower().replace("acme ", "").split(" fund")[0]
        named = rng.choice([slug, name, core, f"acme {core}", slug.replace("-", " "), core.split()[-1]])
        named = spoiled(rng, named, rng.choice([0, 0, 1, 2, 4]))
        before = rng.choice(["", "what is the expense ratio of ", "tell me, please, how the minimum sip amount changes over the years for "])
        after = rng.choice(["", "?", " and what does it cost to leave early", " or acme " + rng.choice(rows)[1].lower(), " middie"])
        out.append(before + named + after)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_table_like_loop(spark, seed):
    rng = random.Random(seed)
    rows = [*registry(rng, 60), ("acme-direct-growth", "Acme Direct Growth")]
    asked = list(enumerate(questions(rng, rows, 60)))
    q = spark.createDataFrame(asked, "id int, q string").repartition(4)
    table = spark.createDataFrame([(s, f"https://funds.example.com/f/{s}", d) for s, d in rows], "scheme string, url string, scheme_display_name string")
    aliases = {"middie": rows[3][0], "ab": rows[4][0], "gilt thing": rows[3][0]}
    listed = [resolve.scheme_record(s, f"https://funds.example.com/f/{s}", d, "acme") for s, d in rows]
    want = resolve.resolve(q, "id", "q", listed, aliases, "acme", "funds.example.com/f/", "none")
    named = spark.createDataFrame(list(aliases.items()), "phrase string, scheme string")
    got = resolve.resolve_registry(q, "id", "q", resolve.registry_index(table, "acme"), named, "acme", "funds.example.com/f/", "none")
    assert got.columns == want.columns
    found, expected = ({r.query_id: tuple(r) for r in df.collect()} for df in (got, want))
    assert {k: (v, found.get(k), dict(asked)[k]) for k, v in expected.items() if found.get(k) != v} == {}
    statuses = Counter(v[4] for v in found.values())
    assert statuses["resolved"] > 5 and statuses["ambiguous"] > 5 and statuses["unknown"] > 3
    assert len({v[6] for v in found.values()}) >= 6, "most rules decide somewhere"


def test_needed_grams_is_a_bound():
    """No text that reaches the ratio has fewer of the needle's pairs."""
    import difflib

    rng = random.Random(3)
    for _ in range(4000):
        needle = "".join(rng.choice("abcde ") for _ in range(rng.randrange(2, 40)))
        text = spoiled(rng, needle, rng.randrange(0, 8))
        if difflib.SequenceMatcher(None, needle, text).ratio() >= resolve.FUZZY_MIN:
            have = set(resolve._pairs(text))
            assert sum(g in have for g in resolve._pairs(needle)) >= resolve.needed_grams(len(needle))


def test_close_ratio_is_the_phrase_ratio():
    rng = random.Random(4)
    hits = 0
    for _ in range(600):
        needle = "".join(rng.choice("abcde é") for _ in range(rng.randrange(1, 45)))
        text = rng.choice(["", "tell me of "]) + spoiled(rng, needle, rng.randrange(0, 7)) + rng.choice(["", " and more words", " x"])
        want = resolve.phrase_ratio(text, needle)
        assert resolve.close_ratio(text, needle) == (want if want >= resolve.FUZZY_MIN else 0.0)
        hits += want >= resolve.FUZZY_MIN
    assert hits > 100 and resolve.close_ratio("", "a") == resolve.close_ratio("a", "") == 0.0


def test_empty_registry_and_no_questions(spark):
    none = spark.createDataFrame([], "phrase string, scheme string")
    table = spark.createDataFrame([], "scheme string, url string, scheme_display_name string")
    q = spark.createDataFrame([(1, "acme gilt")], "id int, q string")
    got = resolve.resolve_registry(q, "id", "q", resolve.registry_index(table, "acme"), none, default_url="d").collect()
    assert [(r.status, r.source_url) for r in got] == [("unknown", "d")]
    assert resolve.resolve_registry(q.where(F.lit(False)), "id", "q", resolve.registry_index(table, "acme"), none).count() == 0


def series(n):
    """Names that differ in their numbers only, long and short."""
    return [(f"acme-fixed-term-plan-series-number-{i}-direct-growth" if i % 3 else f"acme-gilt-{i}-direct-growth", f"Acme Fixed Term Series Number {i} Fund" if i % 2 else f"Acme {i}") for i in range(n)]


def tables(spark, rows, asked):
    table = spark.createDataFrame([(s, f"https://funds.example.com/{s}", d) for s, d in rows], "scheme string, url string, scheme_display_name string")
    return spark.createDataFrame(asked, "id int, q string").repartition(4), resolve.registry_index(table, "acme"), spark.createDataFrame([], "phrase string, scheme string")


def test_series_meets_few_questions(spark):
    """Questions that share most of a series' name, but come close to none, are not met with the whole series."""
    q, index, aliases = tables(spark, series(120), [(i, f"fxed term series number {i % 40} and what it costs to leave it early, as a share of the sum") for i in range(100)])
    schemes = resolve._numbered(index, aliases)
    asked = q.select(F.col("id").alias("query_id"), F.col("q").alias("raw"))
    assert resolve._pairs_met(asked, schemes, "acme", "funds.example.com/").count() < 5 * 100


@pytest.mark.parametrize("vocabulary", [resolve.VOCABULARY, 0])
def test_series_like_loop(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(resolve, "VOCABULARY", vocabulary)
    rng = random.Random(5)
    rows = series(45)
    asked = list(enumerate(questions(rng, rows, 50)))
    for slug, name in rng.sample(rows, 30):
        named = spoiled(rng, rng.choice([slug.replace("-", " "), name.lower()]), rng.choice([0, 1, 1, 2]))
        asked.append((len(asked), rng.choice(["", "please tell "]) + named + rng.choice(["", " or acme gilt 3", " with all that it costs to hold and to leave it"])))
    q, index, aliases = tables(spark, rows, asked)
    listed = [resolve.scheme_record(s, f"https://funds.example.com/{s}", d, "acme") for s, d in rows]
    want = {tuple(r)[0]: tuple(r) for r in resolve.resolve(q, "id", "q", listed, {}, "acme", default_url="none").collect()}
    got = {tuple(r)[0]: tuple(r) for r in resolve.resolve_registry(q, "id", "q", index, aliases, default_url="none").collect()}
    assert got == want and len({v[6] for v in got.values()}) >= 4


def test_windows_that_reach_are_met():
    """A window that reaches the ratio has the pairs that the form needs, and its segment passes."""
    import difflib

    rng = random.Random(6)
    hits = 0
    for _ in range(3000):
        needle = "".join(rng.choice("abcdef-12") for _ in range(rng.randrange(25, 75)))
        before = "".join(rng.choice("abcdef-") for _ in range(rng.randrange(resolve.STRIDE)))
        text = spoiled(rng, needle, rng.randrange(0, 3)) + "".join(rng.choice("abcdef-1") for _ in range(rng.choice([0, 3, 60])))
        window = text[: len(needle) + resolve.WINDOW_MORE]
        if difflib.SequenceMatcher(None, needle, window).ratio() < resolve.FUZZY_MIN:
            continue
        hits += 1
        form, have = resolve._form(needle), set(resolve._pairs(window))
        whole = len(window) == len(needle) + resolve.WINDOW_MORE
        grams = resolve._grams("long2" if whole else "end2", form)
        found = [g for g in grams if g[0] in have]
        assert sum(g[1] for g in found) >= grams[0][2] and len(found) >= grams[0][3]
        assert resolve._may_reach([form, "z" * 40], [before + text, before + text]).tolist() == [True, False]
    assert hits > 500
