from pyspark.sql import functions as F

from folioscope.operators import handoff


def test_candidates(spark):
    texts = [
        "Costs: Expense ratio 0.48 % today\nExit load: 1% within a year\nMin. for SIP ₹1,000\nNo lock-in applies\nFund benchmark NIFTY 50 TRI\nRated Very High risk\nLong-term capital gains are taxed",
        "nothing", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.facet): (r.pattern, r.value) for r in handoff.facet_candidates(df, "id", "text").collect()}
    assert {k for k, _ in got} == {0}
    assert got[0, "expense_ratio"] == ("expense_ratio_v1", "0.48 %")
    assert got[0, "min_sip"] == ("min_sip_v1", "₹1,000") and got[0, "riskometer"] == ("risk_label_v1", "Very High risk")
    assert got[0, "benchmark"][1] == "NIFTY 50 TRI" and got[0, "statement_tax"][0] == "capital_gains_v1"
    assert {f for _, f in got} == set(handoff.CANDIDATES)


def test_gates(spark):
    rows = [("ok", "ok", 9, None), ("partial", None, 9, None), ("empty_shell", "ok", 9, None), ("ok", "failed", 9, None), ("ok", "ok", None, "missing_clean_markdown"), (None, None, 5, None), ("odd", None, 0, None)]
    df = spark.createDataFrame(rows, "e string, n string, b int, m string")
    args = [F.col(c) for c in "enbm"]
    got = [tuple(r) for r in df.select(handoff.parse_success(*args), handoff.quarantine_reasons(*args)).collect()]
    assert [g[0] for g in got] == [True, True, False, False, False, False, False]
    assert [g[1] for g in got] == [[], [], ["extract_status=empty_shell"], ["normalize_status=failed"], ["missing_clean_markdown", "doc_metadata_missing_clean"], ["parse_success_criteria_not_met"], ["parse_success_criteria_not_met"]]


def test_blockers(spark):
    url = "https://funds.example.com/a"
    rows = [(url, None, "x", 1, True, True, False, "ok", "ok"), (url, "https://funds.example.com/b", "", None, True, False, True, "empty_shell", "failed"), (url, "https://x.org", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "registry_url string, source_url string, markdown string, sections int, has_document boolean, has_metadata boolean, quarantined boolean, extract_status string, normalize_status string")
    got = [r[0] for r in df.select(handoff.blockers("funds.example.com")).collect()]
    assert got[0] == []
    assert got[1] == ["empty_clean_markdown", "missing_doc_metadata", "quarantined", "clean_document_missing_sections", "extract_status=empty_shell", "normalize_status=failed", "source_url_registry_mismatch"]
    assert got[2] == ["missing_clean_document", "missing_clean_markdown", "missing_doc_metadata", "extract_status_missing", "source_url_invalid"]


def test_enrich_and_compliance(spark):
    df = spark.createDataFrame([(None, None, None, " "), ("d", "s", 2, "2025-01-01")], "doc_type string, section_title string, compliance_rank int, effective_date string")
    rows = handoff.enrich(df, "page", 1, F.lit("2024-01-01")).collect()
    assert tuple(rows[0]) == ("page", "", 1, "2024-01-01", "fetched_at") and rows[1].effective_date_source == "chunk"
    date = df.select(handoff.effective_date(F.lit(" "), F.lit(None).cast("string"), F.lit("x"))).first()[0]
    assert date == "x"
    answers = spark.createDataFrame(
        [("factual", "One. Two.", "https://funds.example.com/a", "Last updated from sources: x", "", True), ("factual", "A. B. C. D.", "https://x.org", None, None, None), ("refusal", None, None, None, None, True)],
        "outcome_type string, body_text string, citation_url string, footer_line string, footer_date string, passed boolean",
    )
    got = [r[0] for r in answers.select(handoff.format_compliance("funds.example.com")).collect()]
    assert [g.compliant for g in got] == [True, False, False] and got[1].citation_present and not got[1].citation_allowlisted and not got[1].sentences_ok


def test_handoff_rules_of_a_configuration():
    from folioscope.operators import corpus

    assert corpus.handoff_rules({}) == corpus.handoff_rules({"handoff": {"blocked_extract_statuses": []}}) == corpus.HandoffRules()
    got = corpus.handoff_rules({"handoff": {"indexable_extract_statuses": ["ok", 1], "blocked_normalize_statuses": ["x"]}})
    assert got == corpus.HandoffRules(("ok", "1"), ("parse_error", "empty_shell"), ("x",))
