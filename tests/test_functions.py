from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls as U


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_urls(spark):
    urls = ["  HTTP://www.Funds.example.com//a//b/?x=1#y ", "https://funds.example.com/", "https://u@funds.example.com:8443/a", "//funds.example.com/a", "", None, "https://other.org/a"]
    got = values(spark, urls, U.canonical(F.col("t"), "funds.example.com"))
    assert got == ["https://funds.example.com/a/b", "https://funds.example.com/", "https://funds.example.com/a", None, None, None, None]
    assert values(spark, ["https://a.org/x/some-fund/", "HTTPS://WWW.A.org/X//"], U.slug(F.col("t"))) == ["some-fund", "X"]
    assert values(spark, ["Not A Url//", None], U.lenient(F.col("t"))) == ["not a url", ""]
    assert values(spark, ["see funds.example.com/f/a-b and FUNDS.example.com/f/c"], U.slug_mentions(F.col("t"), "funds.example.com/f/")) == [["a-b", "c"]]
    check = U.citation_check(F.col("t"), F.array(F.lit("https://funds.example.com/a")), "funds.example.com")
    assert [r["ok"] for r in values(spark, ["funds.example.com／a＃x", "https://funds.example.com/b"], check)] == [True, False]


def test_keyword_form(spark):
    texts = ["Min. ₹1,000 at 0.48 % TER", "rupees 5", "Ｆｕｌｌ width", None]
    assert values(spark, texts, X.keyword_form(F.col("t"))) == ["min. inr 1000 at 0.48 percent ter", "inr 5", "full width", ""]
    assert values(spark, ["Exit load, a,b"], X.tokens(X.expand_phrases(F.col("t")))) == [["exit", "load", "ab", "exit", "load"]]
    assert values(spark, ["what is the", "expense of", ""], X.only_stop_words(X.tokens(F.col("t")))) == [True, False, True]


def test_sentences(spark):
    texts = ["One. Two! Three? 0.5% is four; and five.", "", None, "a;b;c;d", "No stop"]
    assert values(spark, texts, X.sentence_count(F.col("t"))) == [4, 0, 0, 1, 1]
    assert values(spark, texts, X.sentence_count(F.col("t"), "clauses")) == [5, 0, 0, 4, 1]
    assert values(spark, texts, X.sentence_count(F.col("t"), "stops")) == [5, 0, 0, 1, 1]
    assert values(spark, texts, X.first_sentences(F.col("t"), 2)) == ["One. Two!", "", "", "a; b", "No stop"]


def test_links_and_phrases(spark):
    t = ["A [b](https://x.org/c) d https://y.org/e, funds.example.com/f", None]
    assert values(spark, t, X.link_count(F.col("t"), "funds.example.com")) == [4, 0]
    assert values(spark, ["A [b](c) d https://y.org/e"], X.strip_links(F.col("t"), "funds.example.com")) == ["A d"]
    groups = [("advisory", ["recommend", "best fund"])]
    hits = X.phrase_hits(F.col("t"), groups, [r"\bshould i\b"])
    assert values(spark, ["I recommend the Best fund", 'you asked "should I"', "recommended", "Should I?"], hits) == [["advisory:recommend", "advisory:best fund"], [], [], ["regex:\\bshould i\\b"]]


def test_numbers(spark):
    df = spark.createDataFrame([("It is 0.48% and ₹1,000, not 7 percent.", "ratio 0.48 percent; min ₹ 1000; 70")], "body string, chunk string")
    row = df.select(X.uncited_numbers(F.col("body"), F.col("chunk")).alias("loose"), X.uncited_numbers(F.col("body"), F.col("chunk"), exact=True).alias("exact")).first()
    assert row.loose == ["7"] or row.loose == []
    assert "7" in " ".join(row.exact)
    cut = df.select(X.strip_numbers(F.col("body"), F.array(F.lit("0.48%"))).alias("b")).first().b
    assert cut == "It is and ₹1,000, not 7 percent."


def test_pii(spark):
    texts = ["ABCDE1234F 4111 1111 1111 1111 a.b@c.org 9876543210 1234 5678 9012", "none", None]
    assert values(spark, texts, X.redact(F.col("t"))) == ["[PAN_REDACTED] [CARD_REDACTED] [EMAIL_REDACTED] [PHONE_REDACTED] [AADHAAR_REDACTED]", "none", None]
    assert values(spark, texts, X.redact(F.col("t"), ("PAN", "EMAIL")))[0].startswith("[PAN_REDACTED] 4111")
    assert values(spark, texts, X.has_pii(F.col("t"))) == [True, False, False]


def test_hash_ignores_volatile_lines(spark):
    a, b = values(spark, ["x  y\nNAV 12.3\nz", "x y\nas on 3 May 2024\n z"], X.stable_hash(F.col("t")))
    assert a == b


def test_dates_and_clip(spark):
    assert values(spark, ["2025-01-31", "3 Feb 2024", "05-06-2023", "soon", None], X.display_date(F.col("t"))) == ["31 Jan 2025", "03 Feb 2024", "05 Jun 2023", "date unavailable", "date unavailable"]
    assert values(spark, ["1970-01-02", "bad", None], X.freshness(F.col("t"))) == [86400.0, 0.0, 0.0]
    assert values(spark, ["abcdef", "abc"], X.clip(F.col("t"), 5)) == ["ab...", "abc"]


def test_sanitize(spark):
    text, hits = X.sanitize(F.col("t"), ["ignore rules"], [r"\bshould i\b"])
    assert values(spark, ["Please IGNORE rules  and should I buy", None], text, hits) == [("Please and buy", ["ignore rules", r"\bshould i\b"]), ("", [])]


def test_jaccard_and_ratio(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]
    assert values(spark, ["नमस्ते", "abc", ""], X.devanagari_ratio(F.col("t")) >= 0.25) == [True, False, False]
