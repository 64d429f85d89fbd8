"""Registered evaluations, metrics and gates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import evaluation as E
from folioscope.operators import handoff, hybrid, intent, requests
from folioscope.plans.base import ANSWER_SITE as SITE
from folioscope.plans.base import answers, answers_sql, query, table
from folioscope.plans.core import FRESH_SQL, freshness_sla

_A = f"WITH a AS ({answers_sql()})"
_SENT = "len(list_filter(list_transform(string_split(regexp_replace(trim(coalesce({0}, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''))"
_BODY_SENTENCES = _SENT.format("body_text")
_STOPS = "len(list_filter(regexp_split_to_array(coalesce(body_text, ''), '[.!?]+'), lambda p: trim(p) <> ''))"
_LINKS = "len(regexp_extract_all({0}, '\\[[^\\]]+\\]\\(([^)]+)\\)'))"


def _ok(c: str) -> str:
    return rf"regexp_matches({c}, '^https://(www\.)?funds\.example\.com(/|$)')"


def _form(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(trim({c}), '/+$', ''), '(?i)://www\.', '://'))"


def _same(a: str, b: str) -> str:
    return f"{_form(a)} = {_form(b)}"


def _hits(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in pairs) + ")"


_VIOLATION = f"trim(citation_url) <> '' AND NOT {_ok('citation_url')}"


def _pct(share: str) -> str:
    return f"round_even({share} * 100, 0)::INTEGER || '%'"


def _ratio(part: str, whole: str) -> str:
    return f"round(coalesce({part} / nullif({whole}, 0), 0), 4)"


# -- retrieval and intent -------------------------------------------------------------------------------------------


@query(f"""{_A}, e AS (SELECT conv_id AS q, {_form('expected_url')} AS u FROM a WHERE turn = 0),
hit AS (SELECT q, min(turn + 1) AS rank FROM a JOIN e ON q = conv_id AND u = {_form('citation_url')} WHERE turn + 1 <= 3 GROUP BY q)
SELECT count(*) AS n, count(rank) AS hits, round(avg((rank IS NOT NULL)::INTEGER), 4) AS recall, round(avg(rank), 4) AS mean_rank, 0.85::DOUBLE AS threshold, count(rank) / count(*) >= 0.85 AS passed FROM e LEFT JOIN hit USING (q)""")
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "conv_id", "turn", "citation_url", "expected_url")
    results = rows.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("citation_url").alias("url"))
    expected = rows.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("expected_url").alias("url"))
    return E.hybrid_recall(results, expected, k=3)


@query(f"""{_A} SELECT count(*) AS n, count(*) FILTER (WHERE status = 'found' AND {_same('citation_url', 'expected_url')}) AS hits,
round(count(*) FILTER (WHERE status = 'found' AND {_same('citation_url', 'expected_url')}) / count(*), 4) AS citation_accuracy,
count(*) FILTER (WHERE status = 'found' AND {_same('citation_url', 'expected_url')}) / count(*) >= 0.9 AS passed FROM a""")
def citation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.citation_accuracy(answers(spark, sf_dir, "status", "citation_url", "expected_url"))


@query(f"""{_A} SELECT count(*) AS n, {_ratio(f"count(*) FILTER (WHERE status = 'found' AND {_same('citation_url', 'expected_url')})", 'count(*)')} AS citation_accuracy,
{_ratio("count(*) FILTER (WHERE status = 'found' AND scheme = expected_scheme)", 'count(*)')} AS scheme_match_rate, count(*) FILTER (WHERE {_VIOLATION}) AS allowlist_violations FROM a""")
def factual_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.factual_retrieval(answers(spark, sf_dir), SITE)


_ADVERSARIAL = f"""outcome_type = expected_outcome AND CASE WHEN expected_outcome = 'refusal' THEN hybrid_skipped AND (expected_refusal_type = '' OR refusal_type = '' OR refusal_type = expected_refusal_type)
ELSE (NOT expected_limited OR performance_limited) AND (status IS NULL OR scheme = expected_scheme) AND {_same('citation_url', 'expected_url')} AND (NOT allow_not_found OR status IS NULL OR status IN ('found', 'not_found_in_sources')) END"""


@query(f"""{_A} SELECT count(*) AS n, count(*) FILTER (WHERE {_ADVERSARIAL}) AS passed, {_ratio(f'count(*) FILTER (WHERE {_ADVERSARIAL})', 'count(*)')} AS pass_rate,
count(*) FILTER (WHERE {_VIOLATION}) AS allowlist_violations, round(count(*) FILTER (WHERE expected_outcome = 'refusal' AND hybrid_skipped) / greatest(1, count(*) FILTER (WHERE expected_outcome = 'refusal')), 4) AS refusal_skip_rate FROM a""")
def adversarial_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adversarial(answers(spark, sf_dir), SITE)


@query(f"""{_A}, c AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'factual' WHEN conv_id % 3 = 1 THEN 'mixed' ELSE 'comparison' END AS got, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'mixed' ELSE 'factual' END AS want FROM a),
d AS (SELECT got, want, CASE got WHEN 'factual' THEN 'retrieve' ELSE 'refuse' END AS action, CASE want WHEN 'factual' THEN 'retrieve' ELSE 'refuse' END AS wanted FROM c)
SELECT count(*) AS total, count(*) FILTER (WHERE got = want AND action = wanted) AS passed, {_ratio('count(*) FILTER (WHERE got = want AND action = wanted)', 'count(*)')} AS accuracy FROM d""")
def intent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "conv_id", "turn").select(
        F.expr("CASE WHEN conv_id % 3 = 0 THEN 'factual' WHEN conv_id % 3 = 1 THEN 'mixed' ELSE 'comparison' END").alias("intent"),
        F.expr("CASE WHEN (conv_id + turn) % 4 = 0 THEN 'mixed' ELSE 'factual' END").alias("expected_intent"),
    )
    rows = rows.withColumns({"action": intent.default_action(F.col("intent")), "expected_action": intent.default_action(F.col("expected_intent"))})
    return E.accuracy(rows, E.intent_passed())


_RESOLVED = "CASE WHEN status = 'found' THEN 'resolved' ELSE 'unknown' END"


@query(f"""{_A}, c AS (SELECT *, {_RESOLVED} AS got FROM a), d AS (SELECT got = 'resolved' AND (turn % 2 = 1 OR scheme = expected_scheme) AND (turn % 3 <> 1 OR citation_url = expected_url) AS ok FROM c)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS passed, {_ratio('count(*) FILTER (WHERE ok)', 'count(*)')} AS accuracy FROM d""")
def scheme_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).withColumns({
        "expected_scheme": F.expr("CASE WHEN turn % 2 = 1 THEN '' ELSE expected_scheme END"), "expected_url": F.expr("CASE WHEN turn % 3 <> 1 THEN '' ELSE expected_url END"),
        "source_url": F.col("citation_url"), "status": F.expr(_RESOLVED), "expected_status": F.lit("resolved"),
    })
    return E.accuracy(rows, E.scheme_passed())


@query("""WITH p AS (SELECT CASE WHEN conv_id % 5 = 3 THEN 'refuse' WHEN conv_id % 5 = 4 THEN 'abstain' ELSE 'allow_compose' END AS d, CASE WHEN conv_id % 5 = 3 THEN 'refusal' WHEN conv_id % 5 = 4 THEN 'abstention' ELSE 'factual' END AS r,
CASE WHEN turn % 2 = 0 THEN 'refuse' ELSE 'allow_compose' END AS ed, CASE WHEN turn % 2 = 0 THEN 'refusal' ELSE 'factual' END AS er, conv_id % 7 = 2 AS limited, CASE WHEN turn % 3 = 0 THEN conv_id % 14 = 2 END AS el,
CASE WHEN turn % 5 = 0 THEN 'refusal_type:' ELSE '' END AS prefix, conv_id % 5 = 3 AS typed FROM conversations),
j AS (SELECT d = ed AND r = er AND (el IS NULL OR limited = el) AND (prefix = '' OR typed) AS ok FROM p)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS passed, round(count(*) FILTER (WHERE ok) / count(*), 4) AS accuracy FROM j""")
def compliance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "conv_id", "turn", "performance_limited").select(
        F.expr("CASE WHEN conv_id % 5 = 3 THEN 'refuse' WHEN conv_id % 5 = 4 THEN 'abstain' ELSE 'allow_compose' END").alias("decision"),
        F.expr("CASE WHEN conv_id % 5 = 3 THEN 'refusal' WHEN conv_id % 5 = 4 THEN 'abstention' ELSE 'factual' END").alias("route"),
        F.expr("CASE WHEN turn % 2 = 0 THEN 'refuse' ELSE 'allow_compose' END").alias("expected_decision"), F.expr("CASE WHEN turn % 2 = 0 THEN 'refusal' ELSE 'factual' END").alias("expected_route"),
        "performance_limited", F.expr("CASE WHEN turn % 3 = 0 THEN conv_id % 14 = 2 END").alias("expected_limited"), F.expr("CASE WHEN turn % 5 = 0 THEN 'refusal_type:' ELSE '' END").alias("expected_reason"),
        F.expr("CASE WHEN conv_id % 5 = 3 THEN array('refusal_short_circuit', 'refusal_type:advisory') ELSE array('retrieval_evidence_present') END").alias("reasons"),
    )
    return E.accuracy(rows, E.compliance_passed())


@query(f"""{_A} SELECT id, CASE WHEN conv_id % 5 = 0 AND turn % 7 / 10.0 + 0.4 >= 0.82 AND citation_url <> '' THEN citation_url WHEN expected_url <> '' AND turn % 2 = 0 THEN expected_url ELSE 'https://funds.example.com/funds/default' END AS url,
CASE WHEN conv_id % 5 = 0 AND turn % 7 / 10.0 + 0.4 >= 0.82 AND citation_url <> '' THEN 'resolver' WHEN expected_url <> '' AND turn % 2 = 0 THEN 'chunk' ELSE 'default' END AS reason FROM a""")
def citation_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "id", "conv_id", "turn", "citation_url", "expected_url")
    chunk = F.when(F.col("turn") % 2 == 0, F.col("expected_url"))
    cite = hybrid.pick_citation(F.col("conv_id") % 5 == 0, F.col("citation_url"), F.col("turn") % 7 / 10.0 + 0.4, chunk, "https://funds.example.com/funds/default")
    return rows.select("id", cite.alias("c")).select("id", "c.*")


@query(f"{_A} SELECT outcome_type, refusal_type, count(*) AS n FROM (SELECT outcome_type, CASE WHEN conv_id % 6 = 0 THEN 'disambiguate' WHEN conv_id % 6 = 1 THEN 'advisory' WHEN conv_id % 6 = 2 THEN 'comparison' WHEN conv_id % 6 = 3 THEN 'mixed_intent' WHEN conv_id % 6 = 4 THEN 'performance_info' ELSE 'out_of_scope' END AS refusal_type FROM a) GROUP BY ALL")
def refusal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "conv_id", "outcome_type")
    names = F.array(*[F.lit(x) for x in ("factual", "advisory", "comparison", "mixed", "performance-info", "out-of-scope")])
    got = rows.select("outcome_type", F.get(names, (F.col("conv_id") % 6).cast("int")).alias("i"), F.when(F.col("conv_id") % 6 == 0, "disambiguate").otherwise("refuse").alias("a"))
    return got.select("outcome_type", intent.refusal_type(F.col("i"), F.col("a")).alias("refusal_type")).groupBy("outcome_type", "refusal_type").agg(F.count("*").alias("n"))


@query("""SELECT conv_id * 1000 + turn AS id, CASE conv_id % 5 WHEN 0 THEN 'retrieve' WHEN 1 THEN 'performance_limited' ELSE 'refuse' END AS action, round_even(least(greatest((turn - 2) * 0.33335::DOUBLE, 0), 1), 4)::DOUBLE AS confidence,
CASE conv_id % 5 WHEN 0 THEN 'answer' WHEN 1 THEN 'refusal' WHEN 2 THEN 'abstention' ELSE 'error' END AS branch FROM conversations""")
def decision_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "id", "conv_id", "turn")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("conv_id") % 5).cast("int"))
    return rows.select(
        "id", intent.default_action(pick("factual", "performance-info", "comparison", "mixed", "unheard-of")).alias("action"), intent.clamp((F.col("turn") - 2) * 0.33335).alias("confidence"),
        requests.ui_branch(pick("factual", "refusal", "abstention", "timeout", None)).alias("branch"),
    )


# -- answers --------------------------------------------------------------------------------------------------------

_REFUSAL = _hits([
    ("empty_body", "trim(body_text) = ''"), ("citation_not_allowlisted", f"NOT {_ok('citation_url')}"), ("citation_link_count", f"{_LINKS.format('citation_markdown')} <> 1"),
    ("body_contains_link", f"{_LINKS.format('body_text')} > 0"), ("missing_disclaimer", "NOT contains(disclaimer_line, 'Facts-only')"),
    ("refusal_type_mismatch", "expected_refusal_type <> '' AND refusal_type <> expected_refusal_type"), ("citation_url_mismatch", "citation_url <> expected_url"),
])


@query(f"{_A} SELECT id, {_REFUSAL} AS issues FROM a")
def refusal_answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    return rows.select("id", F.array_join(E.refusal_issues(F.col("expected_url"), SITE), "|").alias("issues"))


_FACTUAL = _hits([
    ("empty_body", "trim(body_text) = ''"), ("sentence_budget_exceeded", f"{_BODY_SENTENCES} > 3"), ("citation_not_allowlisted", f"NOT {_ok('citation_url')}"), ("citation_link_count", f"{_LINKS.format('citation_markdown')} <> 1"),
    ("body_contains_link", f"{_LINKS.format('body_text')} > 0"), ("missing_footer", "NOT contains(footer_line, 'Last updated from sources:')"), ("missing_disclaimer", "NOT contains(disclaimer_line, 'Facts-only')"),
    ("missing_chunk_id", "evidence_chunk_id = ''"), ("citation_url_mismatch", "citation_url <> expected_url"),
])


@query(f"{_A} SELECT id, {_FACTUAL} AS issues FROM a")
def factual_answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    return rows.select("id", F.array_join(E.factual_issues(F.col("expected_url"), SITE), "|").alias("issues"))


_REDTEAM = _hits([
    ("outcome_type_mismatch", "NOT list_contains(string_split(expected_list, ','), outcome_type)"), ("validation_failed", "expect_pass AND NOT passed"), ("factual_on_advisory_path", "forbid_factual AND outcome_type = 'factual'"),
    ("forbidden_citation_host", "forbid_host <> '' AND contains(regexp_extract(citation_url, '^[^:/?#]+://([^/?#]*)', 1), forbid_host)"), ("allowlist_violation", _VIOLATION),
    ("citation_link_count", f"{_LINKS.format('citation_markdown')} <> 1"), ("sentence_budget", f"{_BODY_SENTENCES} > 3"),
])
_GENERATION = _hits([
    ("validation_failed", "NOT passed"), ("sentence_budget", f"passed AND outcome_type = 'factual' AND {_BODY_SENTENCES} > 3"),
    ("missing_footer", "passed AND outcome_type = 'factual' AND NOT contains(footer_line, 'Last updated from sources:')"), ("allowlist_violation", _VIOLATION),
])


def _rates(issues: str) -> str:
    return f"""SELECT count(*) AS cases_total, count(*) FILTER (WHERE i = '') AS cases_passed, count(*) FILTER (WHERE i = '') / count(*) AS pass_rate,
count(*) FILTER (WHERE i = '' AND outcome_type = 'factual') / count(*) AS format_pass_rate, count(*) FILTER (WHERE contains(i, 'allowlist_violation')) AS allowlist_violations FROM (SELECT outcome_type, {issues} AS i FROM a)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).withColumn("expected_outcomes", F.split("expected_list", ","))


@query(f"{_A} SELECT id, {_REDTEAM} AS issues, {_GENERATION} AS generation_issues FROM a")
def answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("id", F.array_join(E.redteam_issues(SITE), "|").alias("issues"), F.array_join(E.generation_issues(SITE), "|").alias("generation_issues"))


@query(f"{_A} {_rates(_REDTEAM)}")
def redteam_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.issue_rates(_cases(spark, sf_dir), E.redteam_issues(SITE))


@query(f"{_A} {_rates(_GENERATION)}")
def factual_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.issue_rates(_cases(spark, sf_dir), E.generation_issues(SITE))


@query(f"""{_A}, r AS ({_rates(_REDTEAM)}), f AS ({_rates(_GENERATION)})
SELECT r.pass_rate AS redteam_rate, f.pass_rate AS factual_rate, f.format_pass_rate AS format_pass_rate, least(r.pass_rate, f.pass_rate) AS compliance_rate, r.allowlist_violations + f.allowlist_violations AS allowlist_violations,
r.pass_rate >= 1.0 AND f.pass_rate >= 0.8 AND r.pass_rate >= 0.9 AND r.allowlist_violations + f.allowlist_violations = 0 AS passed FROM r, f""")
def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.full_evaluation(redteam_evaluation(spark, sf_dir), factual_generation(spark, sf_dir))


_CASE = """passed = expect_pass AND (expect_repaired IS NULL OR repaired = expect_repaired) AND (expect_type = '' OR outcome_type = expect_type)
AND (expect_host = '' OR regexp_extract(citation_url, '^[^:/?#]+://([^/?#]*)', 1) = expect_host) AND (turn % 6 <> 2 OR contains(footer_line, '2025') OR contains(footer_date, '2025'))"""


@query(f"{_A} SELECT count(*) AS total, count(*) FILTER (WHERE {_CASE}) AS passed, {_ratio(f'count(*) FILTER (WHERE {_CASE})', 'count(*)')} AS accuracy FROM a")
def validation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).withColumns({"answer_type": F.col("outcome_type"), "expect_footer": F.when(F.col("turn") % 6 == 2, F.array(F.lit("2025")))})
    return E.accuracy(rows, E.case_passed())


@query(f"""{_A} SELECT id, {_hits([("unknown_outcome", "outcome_type NOT IN ('factual', 'refusal', 'abstention')"), ("answer_type_mismatch", "outcome_type <> expected_outcome"), ("empty_body", "trim(body_text) = ''"), ("missing_citation", "trim(citation_url) = ''")])} AS faults FROM a""")
def outcome_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    faults = requests.outcome_faults(F.col("outcome_type"), F.col("expected_outcome"), F.col("body_text"), F.col("citation_url"))
    return rows.select("id", F.array_join(faults, "|").alias("faults"))


# -- probes ---------------------------------------------------------------------------------------------------------

_PROBES = """SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) - count(*) FILTER (WHERE ok) AS incorrect, {r} AS rate, {p} AS rate_pct,
round(coalesce(avg(nullif(latency_ms, 0)), 0), 1) AS avg_latency_ms FROM p""".format(r=_ratio("count(*) FILTER (WHERE ok)", "count(*)"), p=_pct(_ratio("count(*) FILTER (WHERE ok)", "count(*)")))
_HIT = rf"http_status = 200 AND outcome_type = 'factual' AND regexp_extract(rtrim(citation_url, '/'), '[^/]*$') = expected_scheme AND {_ok('citation_url')} AND evidence_chunk_id <> '' AND NOT hybrid_skipped"
_REFUSED = f"http_status = 200 AND list_contains(string_split(expected_list, ','), outcome_type) AND {_ok('citation_url')}"


@query(f"{_A}, p AS (SELECT latency_ms, {_HIT} AS ok FROM a) {_PROBES}")
def retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.retrieval_hits(answers(spark, sf_dir), SITE)


@query(f"{_A}, p AS (SELECT latency_ms, {_REFUSED} AS ok FROM a) {_PROBES}")
def refusal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.refusal_accuracy(_cases(spark, sf_dir), SITE)


_COMPLIANT = f"outcome_type = 'factual' AND trim(body_text) <> '' AND {_STOPS} <= 3 AND {_ok('citation_url')} AND (contains(footer_line, 'Last updated from sources:') OR trim(footer_date) <> '') AND passed"


def _format_sql(extra: str = "") -> str:
    return f"""SELECT count(*) AS total, count(*) FILTER (WHERE c) AS compliant, count(*) FILTER (WHERE f) AS factual, count(*) FILTER (WHERE c AND f) AS factual_compliant, count(*) FILTER (WHERE v) AS allowlist_violations,
{_ratio('count(*) FILTER (WHERE c)', 'count(*)')} AS overall_rate, {_ratio('count(*) FILTER (WHERE c AND f)', 'count(*) FILTER (WHERE f)')} AS factual_rate, {_pct(_ratio('count(*) FILTER (WHERE c AND f)', 'count(*) FILTER (WHERE f)'))} AS factual_rate_pct
FROM (SELECT http_status = 200 AND {_COMPLIANT} AS c, http_status = 200 AND outcome_type = 'factual' AS f, http_status = 200 AND {_VIOLATION} AS v FROM a)"""


@query(f"{_A} {_format_sql()}")
def format_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.format_rate(answers(spark, sf_dir), handoff.format_compliance(SITE)["compliant"], SITE)


@query(f"{_A} SELECT id, outcome_type = 'factual' AS is_factual, trim(body_text) <> '' AS has_body, trim(body_text) <> '' AND {_STOPS} <= 3 AS sentences_ok, trim(citation_url) <> '' AS citation_present, {_ok('citation_url')} AS citation_allowlisted, contains(footer_line, 'Last updated from sources:') OR trim(footer_date) <> '' AS footer_ok, passed AS validation_passed, {_COMPLIANT} AS compliant FROM a")
def format_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("id", handoff.format_compliance(SITE).alias("f")).select("id", "f.*")


@query(f"""{_A}, m AS (SELECT {_ratio(f'count(*) FILTER (WHERE {_HIT})', 'count(*)')} AS h, {_ratio(f'count(*) FILTER (WHERE {_REFUSED})', 'count(*)')} AS r,
{_ratio(f"count(*) FILTER (WHERE http_status = 200 AND {_COMPLIANT})", "count(*) FILTER (WHERE http_status = 200 AND outcome_type = 'factual')")} AS f, (SELECT share FROM ({FRESH_SQL})) AS s FROM a),
g AS (SELECT 'retrieval_hit_quality' AS metric, h AS value, 0.85::DOUBLE AS least FROM m UNION ALL SELECT 'refusal_accuracy', r, 1.0 FROM m UNION ALL SELECT 'format_compliance', f, 0.95 FROM m UNION ALL SELECT 'source_freshness_sla', s, 0.95 FROM m)
SELECT metric, value, least, value >= least AS met FROM g""")
def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda df, c, n: df.select(F.col(c).alias(n))
    row = one(retrieval_hits(spark, sf_dir), "rate", "retrieval_hit_quality").crossJoin(F.broadcast(one(refusal_accuracy(spark, sf_dir), "rate", "refusal_accuracy")))
    row = row.crossJoin(F.broadcast(one(format_rate(spark, sf_dir), "factual_rate", "format_compliance"))).crossJoin(F.broadcast(one(freshness_sla(spark, sf_dir), "share", "source_freshness_sla")))
    return E.threshold_gates(row)


@query(f"{_A} SELECT source, count(*) AS n, count(DISTINCT query) AS queries FROM (SELECT 'retrieval' AS source, query FROM a WHERE outcome_type = 'factual' UNION ALL SELECT 'refusal', query FROM a WHERE outcome_type = 'refusal') GROUP BY source")
def tagged_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "outcome_type", "query", "scheme")
    both = E.tagged_probes(rows.where("outcome_type = 'factual'"), rows.where("outcome_type = 'refusal'").drop("scheme"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("query").alias("queries"))


@query(f"{_A} SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) - count(*) FILTER (WHERE passed) AS failed, {_pct('count(*) FILTER (WHERE passed) / count(*)')} AS pass_rate FROM a")
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.check_report(answers(spark, sf_dir, "passed"))


@query("SELECT bool_or(contains(lower(text), 'citation not allowlisted')) AS violations FROM documents")
def reported_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.has_reported_violation(table(spark, sf_dir, "documents").select(F.col("text").alias("actual")))


# -- sources and gates ----------------------------------------------------------------------------------------------

_ATTEMPTS = {
    "url": "url", "head_status": "CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 405 WHEN page_id % 11 = 3 THEN 404 ELSE 200 END",
    "head_error": "CASE WHEN page_id % 7 = 0 THEN 'timed out' END",
    "get_status": "CASE WHEN page_id % 14 = 0 THEN NULL WHEN page_id % 10 = 0 THEN 503 ELSE 200 END", "get_error": "CASE WHEN page_id % 28 = 0 THEN 'refused' END",
    "final_url": "CASE WHEN page_id % 9 = 0 THEN 'https://elsewhere.example.net/login' ELSE concat('https://funds.example.com/p', CAST(page_id % 20 AS STRING)) END",
}
_CHECKS = f"""t AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _ATTEMPTS.items())} FROM pages),
s AS (SELECT *, head_status IS NOT NULL AND head_status <> 405 AS h, CASE WHEN head_status IS NOT NULL AND head_status <> 405 THEN head_status ELSE get_status END AS st FROM t),
checks AS (SELECT url, CASE WHEN h THEN 'HEAD' WHEN get_status IS NOT NULL OR get_error IS NOT NULL THEN 'GET' ELSE 'NONE' END AS method, st AS http_status, CASE WHEN st IS NOT NULL THEN final_url END AS final_url,
  CASE WHEN st >= 400 THEN 'HTTP Error ' || st WHEN st IS NULL THEN coalesce(get_error, 'HEAD and GET both failed') END AS error FROM s)"""
_CHECKED = "SELECT url, method, http_status, final_url, error IS NULL AND NOT regexp_matches(final_url, '^https://funds.example.com/p[0-9]$') AS off_allowlist, error FROM checks"


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "pages").select(*[F.expr(v).alias(k) for k, v in _ATTEMPTS.items()])
    allowed = spark.range(10).select(F.concat(F.lit("https://funds.example.com/p"), F.col("id").cast("string")).alias("url"))
    return E.url_checks(attempts, allowed)


@query(f"WITH {_CHECKS} {_CHECKED}")
def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@query(f"""WITH {_CHECKS}, c AS ({_CHECKED}) SELECT count(*) AS total, count(*) FILTER (WHERE http_status BETWEEN 200 AND 299) AS ok_2xx, count(*) FILTER (WHERE off_allowlist) AS redirect_off_allowlist, count(error) AS errors,
count(*) FILTER (WHERE off_allowlist) = 0 AND count(error) = 0 AS passed FROM c""")
def url_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.url_summary(_checks(spark, sf_dir))


@query(f"WITH {_CHECKS} SELECT count(*) FILTER (WHERE http_status IN (200, 301, 302, 303, 307, 308)) AS reachable, count(*) AS total, count(*) FILTER (WHERE http_status IN (200, 301, 302, 303, 307, 308)) || '/' || count(*) || ' URLs reachable' AS summary FROM checks")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reachability(_checks(spark, sf_dir))


@query(f"""{_A}, f AS (SELECT count(*) FILTER (WHERE passed) AS qp, count(*) AS n, count(*) FILTER (WHERE http_status = 200) AS ep, avg(nullif(latency_ms, 0)) AS l FROM a)
SELECT 'questions' AS gate, qp / n * 100 >= 95 AS passed FROM f UNION ALL SELECT 'end_to_end', ep / n * 100 >= 90 FROM f UNION ALL SELECT 'urls', false FROM f UNION ALL SELECT 'health', true FROM f
UNION ALL SELECT 'ready', false FROM f UNION ALL SELECT 'allowlist', true FROM f UNION ALL SELECT 'latency', l > 0 AND l <= 10000 FROM f""")
def go_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = answers(spark, sf_dir).agg(
        F.count_if("passed").alias("questions_passed"), F.count("*").alias("questions_total"), F.count_if(F.col("http_status") == 200).alias("end_passed"), F.count("*").alias("end_total"),
        F.lit(15).alias("reachable"), F.lit(16).alias("sources"), F.lit(True).alias("health_ok"), F.lit(None).cast("boolean").alias("ready_ok"), F.lit(False).alias("violations"),
        F.lit(True).alias("api_reachable"), F.avg(F.nullif("latency_ms", F.lit(0))).alias("avg_latency_ms"),
    )
    return E.go_live(facts)


@query("SELECT bool_and(item_id % 10 <> 3) AS ready, array_to_string(list_sort(list(item_id::VARCHAR) FILTER (WHERE item_id % 10 = 3)), '|') AS failed FROM benchmark")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), (F.col("item_id") % 10 != 3).alias("ok"))
    return E.readiness(rows).withColumn("failed", F.array_join("failed", "|"))


_STATES = ["turn % 2 = 0 AS health_ok", "conv_id % 3 <> 0 AS ready_ok", "conv_id % 2 = 0 AS suites_ok", "conv_id % 4 AS end_failed"]


@query(f"SELECT *, health_ok AND ready_ok AND suites_ok AND end_failed = 0 AS healthy FROM (SELECT DISTINCT {', '.join(_STATES)} FROM conversations)")
def overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overall_health(table(spark, sf_dir, "conversations").selectExpr(*_STATES).distinct())


@query("""WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"error": {"code": "a", "message": "not found"}}' WHEN 1 THEN '{"error": {"code": "", "message": "Traceback: x"}}' WHEN 2 THEN '{"error": {"code": "a"}, "trace": 1}'
WHEN 3 THEN props WHEN 4 THEN 'no json' ELSE '{"error": "plain"}' END AS payload FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'blank_code|leaks_internals' WHEN 2 THEN 'top_level_keys|error_keys|blank_message' ELSE CASE WHEN event_id % 6 = 5 THEN '' ELSE 'top_level_keys|' END || 'error_keys|blank_code|blank_message' END AS faults FROM p""")
def error_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    payload = (
        F.when(k == 0, '{"error": {"code": "a", "message": "not found"}}').when(k == 1, '{"error": {"code": "", "message": "Traceback: x"}}').when(k == 2, '{"error": {"code": "a"}, "trace": 1}')
        .when(k == 3, F.col("props")).when(k == 4, "no json").otherwise('{"error": "plain"}')
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(E.error_faults(payload), "|").alias("faults"))
