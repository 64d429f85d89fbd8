"""Registered joins, records, sources and single-row functions, and their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.functions.rules import ANSWER_PATTERNS, QUERY_INJECTION
from folioscope.operators import corpus, guardrails, handoff, refresh, resolve, sections, vectors
from folioscope.plans.base import ORACLES, answers, answers_sql, query, table
from folioscope.plans.core import _BM25, _CANON, _CANONICAL, _DOC_LINES, _STABLE, _VEC_ITEMS, LEADS, POLICY, _questions, _vector_queries, bm25_topk
from folioscope.sources import bundles, scratch, tables

_WS = r"'[ \t\n\x0B\f\r]+', ' ', 'g'"


def _q(s: str) -> str:
    return s.replace("'", "''")


# -- urls and dates -------------------------------------------------------------------------------------------------

_ALLOWED_URL = "https://funds.example.com/a"


@query(rf"""WITH c AS (SELECT *, {_CANONICAL} AS canon FROM ({_CANON}))
SELECT page_id, coalesce(canon, lower(regexp_replace(trim(coalesce(url, '')), '/+$', ''))) AS lenient, lower(regexp_replace(regexp_replace(trim(coalesce(url, '')), '/+$', ''), '(?i)://www\.', '://')) AS compared,
replace(path, '/', '_') AS key, CASE WHEN page_id % 3 = 0 THEN 'https://funds.example.com/a' ELSE trim(url) END AS checked, page_id % 3 = 0 AS ok, array_to_string(regexp_extract_all(lower(url), 'example\.(?:com|org)/([a-z0-9-]+)', 1), '|') AS slugs FROM c""")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    cited = F.when(F.col("page_id") % 3 == 0, " funds.example.com／a?x＃y").otherwise(url)
    check = U.citation_check(cited, F.array(F.lit(_ALLOWED_URL)), "funds.example.com")
    slugs = F.concat(U.slug_mentions(url, "example.com/"), U.slug_mentions(url, "example.org/"))
    rows = table(spark, sf_dir, "pages").select(
        "page_id", U.lenient(url).alias("lenient"), U.compare_form(url).alias("compared"), U.file_key(U.path(url)).alias("key"), check.alias("c"), F.array_join(slugs, "|").alias("slugs")
    )
    return rows.select("page_id", "lenient", "compared", "key", F.col("c.url").alias("checked"), F.col("c.ok").alias("ok"), "slugs")


@query("""WITH d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%-d %b %Y') WHEN 2 THEN strftime(ts, '%d-%m-%Y') WHEN 3 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS d, ts FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN 'date unavailable' ELSE strftime(ts, '%d %b %Y') END AS shown, CASE event_id % 5 WHEN 0 THEN epoch(date_trunc('day', ts))::DOUBLE WHEN 4 THEN floor(epoch(ts))::DOUBLE ELSE 0.0 END AS fresh FROM d""")
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id") % 5, F.col("ts")
    d = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.date_format(ts, "d MMM yyyy")).when(k == 2, F.date_format(ts, "dd-MM-yyyy")).when(k == 3, "soon").otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", X.display_date(d).alias("shown"), X.freshness(d).alias("fresh"))


# -- text -----------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, """ + " OR ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in X.TEXT_CHALLENGE) + r""" AS challenge,
CASE WHEN length(regexp_replace(coalesce(text, ''), '\P{L}', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(coalesce(text, ''), '[^ऀ-ॿ]', '', 'g')) / length(regexp_replace(coalesce(text, ''), '\P{L}', '', 'g')) END AS devanagari,
CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS clipped,
""" + " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for _, p in X.PII) + """ AS pii FROM documents""")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.challenge_in_text(t).alias("challenge"), X.devanagari_ratio(t).alias("devanagari"), X.clip(t, 60).alias("clipped"), X.has_pii(t).alias("pii"))


_STOPPED = "list_filter(regexp_extract_all(lower(w), '[a-z0-9]+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in X.KEYWORD_STOP) + "))"


@query(f"SELECT conv_id, turn, len({_STOPPED}) = 0 AS idle FROM (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:2], ' ') AS w FROM conversations)")
def stop_word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array_join(F.slice(F.split("text", " ", -1), 1, 2), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.only_stop_words(F.regexp_extract_all(F.lower(first), F.lit("[a-z0-9]+"), F.lit(0))).alias("idle"))


def _sentences(t: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(trim({t}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _first_sentences(t: str, n: int) -> str:
    clauses = f"list_filter(list_transform(string_split(trim({t}), ';'), lambda s: trim(s)), lambda s: s <> '')"
    return f"CASE WHEN contains({t}, ';') AND len({_sentences(t)}) = 1 THEN array_to_string({clauses}[1:{n}], '; ') ELSE array_to_string({_sentences(t)}[1:{n}], ' ') END"


_NO_QUOTES = rf"""trim(regexp_replace(regexp_replace(regexp_replace(text, '"[^"]*"', ' ', 'g'), '''[^'']*''', ' ', 'g'), {_WS}))"""
_NUMBERS = f"list_transform(regexp_extract_all(text, '{X.NUMBER}'), lambda n: trim(n))"


@query(rf"""SELECT conv_id, turn, {_first_sentences('text', 2)} AS short, {_NO_QUOTES} AS unquoted,
trim(regexp_replace(regexp_replace(list_reduce({_NUMBERS}, lambda b, n: trim(replace(b, n, '')), text), '\s{{2,}}', ' ', 'g'), '\s+([,.!?])', '\1', 'g')) AS bare FROM conversations""")
def sentence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_sentences(t, 2).alias("short"), X.strip_quotes(t).alias("unquoted"), X.strip_numbers(t, X.numbers(t)).alias("bare"))


_LEAD = "[" + ", ".join(f"'{_q(x)}'" for x in LEADS) + "]"
_ASKED = f"SELECT conv_id, turn, concat_ws(' ', {_LEAD}[conv_id % {len(LEADS)} + 1], text) AS query, text FROM conversations"


def _sanitize_sql() -> str:
    """CTEs s0, s1, ...: each rule in what the ones before left; the last has t and the flags f0, f1, ..."""
    rules = [*["(?i)" + re.escape(p) for p in QUERY_INJECTION], *["(?i)" + p for p in ANSWER_PATTERNS]]
    steps = [f"asked AS ({_ASKED}), s0 AS (SELECT *, trim(query) AS t FROM asked)"]
    for i, pattern in enumerate(rules):
        p = _q(pattern.replace("\\ ", " "))
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (t), regexp_matches(t, '{p}') AS f{i}, regexp_replace(t, '{p}', ' ', 'g') AS t FROM s{i})")
    labels = [*QUERY_INJECTION, *ANSWER_PATTERNS]
    found = "concat_ws('|', " + ", ".join(f"CASE WHEN f{i} THEN '{_q(x)}' END" for i, x in enumerate(labels)) + ")"
    return ", ".join(steps) + f", clean AS (SELECT conv_id, turn, query, text, trim(regexp_replace(t, {_WS})) AS sanitized, {found} AS found FROM s{len(rules)})"


@query(f"WITH {_sanitize_sql()} SELECT conv_id, turn, sanitized, found FROM clean")
def sanitized_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark, sf_dir)
    clean, found = X.sanitize(F.col("text"), QUERY_INJECTION, ANSWER_PATTERNS)
    return rows.select("conv_id", "turn", clean.alias("sanitized"), F.array_join(found, "|").alias("found"))


_TITLES = "CASE conv_id % 5 WHEN 0 THEN '(document)' WHEN 1 THEN ' Fees ' WHEN 2 THEN 'View details' WHEN 3 THEN repeat('x', 81) ELSE text END"


@query(f"SELECT conv_id, turn, trim(t) NOT IN ('', '(document)', '(preamble)') AND NOT contains(lower(trim(t)), 'view details') AND NOT contains(lower(trim(t)), 'also manages') AND length(trim(t)) <= 80 AS usable FROM (SELECT conv_id, turn, {_TITLES} AS t FROM conversations)")
def usable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 5
    t = F.when(k == 0, "(document)").when(k == 1, " Fees ").when(k == 2, "View details").when(k == 3, "x" * 81).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", guardrails.usable_title(t).alias("usable"))


_FACTS = ["expense ratio: 0.75 % a year", "exit load of 1 % within a year", "min. for SIP ₹500", "fund benchmark NIFTY 50", "rated very high risk", "TER 1.2%", "", "min. for 1st investment 5,000", "no lock-in, and tax implication as per slab", "stamp duty 0.005%"]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = F.get(F.array(*[F.lit(f) for f in _FACTS]), (F.col("turn") % len(_FACTS)).cast("int"))
    return _questions(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("query"), F.concat_ws(". ", "text", fact).alias("chunk"))


_FACT_ROWS = f"""f AS (SELECT conv_id, turn, query, concat_ws('. ', query, [{', '.join(f"'{_q(x)}'" for x in _FACTS)}][turn % {len(_FACTS)} + 1]) AS chunk FROM ({_ASKED}))"""


def _detect_sql(q: str, t: str) -> str:
    cases = [" OR ".join(f"contains(lower({q}), '{h}')" for h in hints) + f" THEN '{name}'" for name, hints in guardrails.FACET_HINTS]
    cases += [f"contains(lower({t}), '{n.replace('_', ' ')}') OR contains(lower({t}), '{n}') THEN '{n}'" for n in ("expense_ratio", "exit_load", "min_sip", "benchmark", "riskometer")]
    return "CASE " + " ".join(f"WHEN {c}" for c in cases) + " ELSE 'generic' END"


def _value_sql(facet: str, t: str) -> str:
    one = lambda ps: "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({t}, '{_q(p)}', 1)), '')" for p in ps) + ", '')"
    return f"CASE {facet} " + " ".join(f"WHEN '{n}' THEN {one(ps)}" for n, ps in guardrails.FACET_VALUES.items()) + " ELSE '' END"


@query(f"WITH {_FACT_ROWS}, d AS (SELECT *, {_detect_sql('query', 'chunk')} AS facet FROM f) SELECT conv_id, turn, facet, {_value_sql('facet', 'chunk')} AS value FROM d")
def facet_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).withColumn("facet", guardrails.detect_facet(F.col("query"), F.col("chunk")))
    return rows.select("conv_id", "turn", "facet", guardrails.facet_value(F.col("facet"), F.col("chunk")).alias("value"))


def _best_sql(q: str, t: str) -> str:
    bare = rf"trim(regexp_replace(regexp_replace(regexp_replace({t}, '\|[^|\n]*\|', ' ', 'g'), '#+\s*', '', 'g'), {_WS}))"
    parts = f"list_filter({_sentences(bare)}, lambda s: length(s) >= 20 AND NOT contains(s, '|'))"
    words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9%]+'))"
    return parts, words(q), words("s"), rf"trim(regexp_replace({t}, {_WS}))"


_PARTS, _ASKED_WORDS, _SENTENCE_WORDS, _PLAIN = _best_sql("query", "chunk")
_BEST = f"""p AS (SELECT *, {_PARTS} AS parts, {_ASKED_WORDS} AS aw, {_PLAIN} AS plain FROM f),
u AS (SELECT conv_id, turn, s, i, len(list_intersect(aw, {_SENTENCE_WORDS})) AS n FROM (SELECT conv_id, turn, aw, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM p)),
top AS (SELECT conv_id, turn, arg_max(s, n * 100000 - i) AS best FROM u GROUP BY conv_id, turn),
b AS (SELECT p.*, coalesce(CASE WHEN length(best) > 220 THEN rtrim(substr(best, 1, 217)) || '...' ELSE best END, CASE WHEN length(plain) > 220 THEN rtrim(substr(plain, 1, 220)) || '...' ELSE plain END) AS sentence FROM p LEFT JOIN top USING (conv_id, turn))"""


@query(f"WITH {_FACT_ROWS}, {_BEST} SELECT conv_id, turn, sentence FROM b")
def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("conv_id", "turn", guardrails.best_sentence(F.col("query"), F.col("chunk")).alias("sentence"))


# -- routing, refusals ----------------------------------------------------------------------------------------------

_LOW = "lower(query)"
_PROJECTING = "(" + " OR ".join(f"contains({_LOW}, '{p}')" for p in guardrails.ANSWER_PHRASES[2][1]) + f" OR regexp_matches({_LOW}, '{ANSWER_PATTERNS[2]}'))"


@query(rf"""WITH {_sanitize_sql()}, o AS (SELECT *, conv_id % 5 = 3 AS refused, conv_id % 5 = 4 AS unknown, conv_id % 7 = 2 AS limited, turn % 4 = 3 AS missing FROM clean),
d AS (SELECT *, NOT refused AND NOT unknown AS here FROM o)
SELECT conv_id, turn, CASE WHEN refused THEN 'refuse' WHEN unknown OR missing THEN 'abstain' ELSE 'allow_compose' END AS decision, CASE WHEN refused THEN 'refusal' WHEN unknown OR missing THEN 'abstention' ELSE 'factual' END AS route, sanitized AS sanitized_query,
concat_ws('|', CASE WHEN refused THEN 'refusal_short_circuit' END, CASE WHEN found <> '' THEN 'query_injection_stripped' END, CASE WHEN refused THEN 'refusal_type:advisory' END, CASE WHEN unknown THEN 'unknown_outcome_type:odd' END,
CASE WHEN here AND limited THEN 'performance_limited_grounding_required' END, CASE WHEN here AND limited AND {_PROJECTING} THEN 'performance_projection_query_detected' END, CASE WHEN here AND missing THEN 'evidence_empty_not_found_in_sources' END,
CASE WHEN here AND missing THEN 'not_found_reason:none' END, CASE WHEN here AND NOT missing THEN 'retrieval_evidence_present' END, CASE WHEN here AND NOT missing AND limited THEN 'performance_limited_compose_allowed' END) AS reasons FROM d""")
def routed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 5
    rows = _questions(spark, sf_dir).select(
        "conv_id", "turn", F.col("text").alias("query"), F.when(k == 3, "refusal").when(k == 4, "odd").otherwise("retrieval").alias("outcome_type"), F.when(k == 3, "advisory").otherwise("").alias("refusal_type"),
        (F.col("conv_id") % 7 == 2).alias("performance_limited"), F.when(F.col("turn") % 8 == 3, "not_found_in_sources").otherwise("found").alias("retrieval_status"),
        F.when(F.col("turn") % 8 == 7, " ").otherwise("evidence").alias("chunk_text"), F.lit("none").alias("not_found_reason"),
    )
    return guardrails.route(rows).select("conv_id", "turn", "decision", "route", F.array_join("reasons", "|").alias("reasons"), "sanitized_query")


def _refusal_body(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{n}' THEN '{_q(b)}'" for n, b in POLICY.refusals) + f" ELSE '{_q(POLICY.refusal_fallback)}' END"


_CITED = rf"CASE WHEN regexp_matches(citation_url, '^https://(www\.)?funds\.example\.com/') THEN 'https://funds.example.com' || regexp_replace(regexp_extract(citation_url, '^https://[^/]*(/[^?#]*)', 1), '/$', '') ELSE '{POLICY.default_url}' END"


@query(f"""WITH a AS ({answers_sql()}), c AS (SELECT id, CASE WHEN conv_id % 9 = 8 THEN 'unheard' ELSE refusal_type END AS kind, {_CITED} AS url FROM a)
SELECT id, 'refusal' AS answer_type, {_refusal_body('kind')} AS body_text, url AS citation_url, '[{POLICY.default_label}](' || url || ')' AS citation_markdown, '{POLICY.disclaimer}' AS disclaimer_line FROM c
UNION ALL SELECT id, 'abstention', '{_q(POLICY.abstention)}', url, '[{POLICY.default_label}](' || url || ')', '{POLICY.disclaimer}' FROM c""")
def refusal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir, "id", "conv_id", "refusal_type", "citation_url").withColumn("refusal_type", F.when(F.col("conv_id") % 9 == 8, "unheard").otherwise(F.col("refusal_type")))
    out = ["id", "answer_type", "body_text", "citation_url", "citation_markdown", "disclaimer_line"]
    return guardrails.compose_refusal(rows, POLICY).select(*out).unionByName(guardrails.compose_refusal(rows, POLICY, abstain=True).select(*out))


@query("SELECT conv_id, turn, CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN '{_q(h)}'" for i, h in enumerate(corpus.HINTS.values())) + f" ELSE '{_q(corpus.HINT_FALLBACK)}' END AS hint FROM conversations")
def refusal_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in [*corpus.HINTS, "unheard"]])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", corpus.refusal_hint(F.get(kinds, (F.col("conv_id") % 7).cast("int"))).alias("hint"))


@query("SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: struct_pack(p := list_position(w, x), x := x))), lambda r: r.x), '|') AS words FROM (SELECT conv_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') AS w FROM conversations WHERE turn = 0)")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.array_join(corpus.distinct_in_order(F.split("text", " ", -1)), "|").alias("words"))


_REGISTRY = [
    ("acme-large-cap-direct-growth", "Acme Large Cap Direct Growth"), ("acme-small-cap-fund-direct-growth", "Acme Small Cap Fund Direct Growth"), ("acme-elss-tax-saver-direct-growth", "Acme ELSS Tax Saver Direct Plan Growth"),
    ("acme-liquid-fund-direct-growth", "Acme Liquid Fund Direct Growth"),
]


_INDEX_ROWS = r"""reg AS (SELECT 'acme-' || (CASE item_id % 4 WHEN 0 THEN 'large-cap' WHEN 1 THEN 'gilt' WHEN 2 THEN 'tax-saver-fund' ELSE 'x' END) || '-' || item_id || '-direct-growth' AS scheme,
CASE item_id % 3 WHEN 0 THEN 'Acme Very Long Name Number ' || item_id || ' Fund – Direct Growth' ELSE 'Acme ' || item_id || ' Plan' END AS dn FROM benchmark),
named AS (SELECT scheme, 'https://funds.example.com/' || scheme AS url, trim(regexp_replace(replace(lower(trim(regexp_replace(dn, '(?i)\s*(?:[-–—]\s*)?(?:direct|growth|plan)\b.*$', ''))), '-', ' '), '\s+', ' ', 'g')) AS display,
  replace(regexp_replace(regexp_replace(scheme, '^acme-', ''), '-direct-growth(-plan)?$', ''), '-', ' ') AS slug, replace(scheme, '-', ' ') AS spaced FROM reg),
idx AS (SELECT scheme, url, display, CASE WHEN length(display) > length(slug) THEN regexp_replace(display, '^acme ', '') ELSE slug END AS core, spaced FROM named)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    body = F.when(k % 4 == 0, "large-cap").when(k % 4 == 1, "gilt").when(k % 4 == 2, "tax-saver-fund").otherwise("x")
    scheme = F.concat(F.lit("acme-"), body, F.lit("-"), k.cast("string"), F.lit("-direct-growth"))
    shown = F.when(k % 3 == 0, F.concat(F.lit("Acme Very Long Name Number "), k.cast("string"), F.lit(" Fund – Direct Growth"))).otherwise(F.concat(F.lit("Acme "), k.cast("string"), F.lit(" Plan")))
    rows = table(spark, sf_dir, "benchmark").select(scheme.alias("scheme"), F.concat(F.lit("https://funds.example.com/"), scheme).alias("url"), shown.alias("scheme_display_name"))
    return resolve.registry_index(rows, "acme")


@query(f"""WITH {_INDEX_ROWS} SELECT *, array_to_string(list_filter(string_split(core, ' '), lambda w: w NOT IN ('acme', '', {", ".join(f"'{w}'" for w in resolve.COMMON_WORDS)})), '|') AS tokens FROM idx""")
def registry_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).withColumn("tokens", F.array_join("tokens", "|"))


_NAMED = "CASE conv_id % 7 WHEN 0 THEN 'acme large cap ' || conv_id % 40 WHEN 1 THEN 'https://funds.example.com/acme-gilt-' || conv_id % 40 || '-direct-growth' WHEN 2 THEN 'very long name number ' || conv_id % 40 || ' fund' WHEN 3 THEN 'tax saver or gilt 5' WHEN 4 THEN 'gilt ' || conv_id % 40 ELSE '' END || ' ' || text"


@query(rf"""WITH {_INDEX_ROWS}, asked AS (SELECT conv_id * 1000 + turn AS query_id, {_NAMED} AS raw FROM conversations),
norm AS (SELECT query_id, raw, trim(regexp_replace(translate(lower(raw), '’‘“”', '''''""'), {_WS})) AS q FROM asked),
al AS (SELECT scheme, 'tax saver' AS phrase FROM idx WHERE scheme LIKE '%tax-saver-fund-2-%'),
met AS (SELECT query_id, idx.scheme, url, CASE WHEN list_contains(regexp_extract_all(lower(raw), 'funds\.example\.com/([a-z0-9-]+)', 1), idx.scheme) THEN 'url' WHEN contains(replace(q, ' ', '-'), idx.scheme) OR contains(q, spaced) THEN 'slug'
  WHEN al.phrase IS NOT NULL AND contains(q, al.phrase) THEN 'alias' WHEN length(display) >= 8 AND contains(q, display) THEN 'display_name' WHEN length('acme ' || core) >= 10 AND contains(q, 'acme ' || core) THEN 'house_core'
  WHEN length(core) >= 4 AND contains(q, core) THEN 'core_phrase' END AS method FROM norm CROSS JOIN idx LEFT JOIN al USING (scheme)),
scored AS (SELECT *, (CASE method WHEN 'url' THEN 1.0 WHEN 'slug' THEN 0.98 WHEN 'alias' THEN 0.96 WHEN 'display_name' THEN 0.94 WHEN 'house_core' THEN 0.93 ELSE 0.9 END)::DOUBLE AS score FROM met WHERE method IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scheme) AS rank FROM scored""")
def scheme_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    k, n = F.col("conv_id") % 7, (F.col("conv_id") % 40).cast("string")
    named = (
        F.when(k == 0, F.concat(F.lit("acme large cap "), n)).when(k == 1, F.concat(F.lit("https://funds.example.com/acme-gilt-"), n, F.lit("-direct-growth"))).when(k == 2, F.concat(F.lit("very long name number "), n, F.lit(" fund")))
        .when(k == 3, "tax saver or gilt 5").when(k == 4, F.concat(F.lit("gilt "), n)).otherwise("")
    )
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(named, F.lit(" "), "text").alias("q"))
    aliases = index.where("scheme LIKE '%tax-saver-fund-2-%'").select(F.lit("tax saver").alias("phrase"), "scheme").unionByName(index.where("false").select(F.lit("").alias("phrase"), "scheme"))
    return resolve.exact_matches(asked, "id", "q", index, aliases, "acme")


@query()
def scheme_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = [resolve.scheme_record(s, f"https://funds.example.com/funds/{s}", d, "acme") for s, d in _REGISTRY]
    names = F.array(*[F.lit(x) for x in ("", "acme large cap", "acme smal cap fund", "https://funds.example.com/acme-liquid-fund-direct-growth", "acme liquid or acme large cap", "tax saver")])
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(" ", F.get(names, (F.col("conv_id") % 6).cast("int")), "text").alias("q"))
    return resolve.resolve(asked, "id", "q", registry, {"tax saver": "acme-elss-tax-saver-direct-growth"}, default_url=POLICY.default_url)


@query()
def scheme_resolve_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decision with a registry made of the benchmark, as a table: fuzzy rules on what pieces in common leave; a test holds it against the loop."""
    names = F.array(*[F.lit(x) for x in ("acme larg cap", "vry long name number", "acme gilt 5 or acme large cap 4 fund", "tax savr fund")])
    spoiled = F.concat_ws(" ", F.get(names, (F.col("conv_id") % 5).cast("int")), (F.col("conv_id") % 40).cast("string"), "text")
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), spoiled.alias("q"))
    aliases = spark.createDataFrame([], "phrase string, scheme string")
    return resolve.resolve_registry(asked, "id", "q", _index(spark, sf_dir), aliases, default_url=POLICY.default_url)


# -- structure and gates --------------------------------------------------------------------------------------------


@query(_DOC_LINES + """
tabled AS (SELECT *, least(start + length(line) + 1, total) AS stop, trim(line) <> '' AND contains(line, '|') AS t FROM lines),
truns AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, t ORDER BY pos) AS run FROM tabled),
next AS (SELECT *, lead(line) OVER w AS after, lead(line, 2) OVER w AS later FROM lines WINDOW w AS (PARTITION BY id ORDER BY pos)),
marked AS (SELECT *, CASE WHEN later IS NOT NULL AND trim(after) = '' THEN start + length(line) ELSE least(start + length(line) + 1, total) END AS stop,
  trim(line) <> '' AND NOT contains(line, '|') AS t FROM next),
runs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, t ORDER BY pos) AS run FROM marked)
SELECT id, min(start) AS start_char, max(stop) AS end_char, 'paragraph' AS kind FROM runs WHERE t GROUP BY id, run UNION ALL SELECT id, min(start), max(stop), 'table' FROM truns WHERE t GROUP BY id, run""")
def atomic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.atomic_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


_STATES = {
    "extract_status": "CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'parse_error' WHEN 3 THEN 'empty_shell' END", "normalize_status": "CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'failed' END",
    "n_bytes": "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 END", "metadata_error": "CASE WHEN event_id % 11 = 0 THEN 'missing_clean_markdown' END",
}


@query(f"""WITH s AS (SELECT event_id, {", ".join(f"{v} AS {k}" for k, v in _STATES.items())} FROM events),
r AS (SELECT *, coalesce(extract_status IN ('ok', 'partial') AND coalesce(n_bytes, 0) > 0, false) AND NOT (coalesce(normalize_status IN ('empty', 'failed'), false) OR coalesce(metadata_error = 'missing_clean_markdown', false)) AS success,
concat_ws('|', CASE WHEN n_bytes IS NULL THEN 'missing_clean_markdown' END, CASE WHEN extract_status IN ('parse_error', 'empty_shell') THEN 'extract_status=' || extract_status END, CASE WHEN normalize_status IN ('empty', 'failed') THEN 'normalize_status=' || normalize_status END,
CASE WHEN metadata_error = 'missing_clean_markdown' THEN 'doc_metadata_missing_clean' END) AS found FROM s)
SELECT event_id, success, CASE WHEN NOT success AND found = '' THEN 'parse_success_criteria_not_met' ELSE found END AS reasons FROM r""")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", *[F.expr(v).alias(k) for k, v in _STATES.items()])
    args = [F.col(c) for c in _STATES]
    return rows.select("event_id", handoff.parse_success(*args).alias("success"), F.array_join(handoff.quarantine_reasons(*args), "|").alias("reasons"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'faq' ELSE 'page' END AS doc_type, CASE WHEN turn % 3 = 0 THEN '' ELSE 'Fees' END AS section_title, CASE WHEN turn % 4 = 0 THEN 7 ELSE 1 END AS compliance_rank,
CASE WHEN turn % 5 = 0 THEN '2025-01-01' WHEN conv_id % 2 = 0 THEN '2024-06-01' END AS effective_date, CASE WHEN turn % 5 = 0 THEN 'chunk' WHEN conv_id % 2 = 0 THEN 'fetched_at' ELSE 'unknown' END AS effective_date_source FROM conversations""")
def chunk_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(t % 2 == 0, "faq").otherwise("").alias("doc_type"), F.when(t % 3 != 0, "Fees").alias("section_title"), F.when(t % 4 == 0, 7).alias("compliance_rank"), F.when(t % 5 == 0, "2025-01-01").otherwise(" ").alias("effective_date"),
    )
    fallback = handoff.effective_date(F.lit(" "), F.when(F.col("conv_id") % 2 == 0, "2024-06-01"), F.lit(None).cast("string"))
    return handoff.enrich(rows, "page", 1, fallback)


# -- joins ----------------------------------------------------------------------------------------------------------


@query("""SELECT source, doc_id, seq, lang FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (
SELECT source, doc_id, n_chars AS seq, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents WHERE lang = 'en') USING (source) WHERE rn = 1 OR rn IS NULL""")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = docs.where("lang = 'en'").select("source", F.col("n_chars").alias("seq"), "doc_id", "lang")
    return corpus.with_manifest(docs.select("source").distinct(), manifest, "source").select("source", "doc_id", "seq", "lang")


def _sidecars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    base = docs.select(k.alias("scheme"), F.concat(F.lit("https://funds.example.com/"), k.cast("string")).alias("source_url"), F.when(k % 6 != 5, F.col("text")).alias("markdown"))
    crawl = docs.where(k % 4 != 1).select(k.alias("scheme"), F.concat(F.lit("2025-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("fetched_at"), F.lit("ok").alias("fetch_status"))
    extract = docs.where(k % 5 != 2).select(k.alias("scheme"), F.when(k % 2 == 0, "2.1").otherwise("").alias("parser_version"), F.when(k % 3 == 0, "partial").otherwise("ok").alias("extract_status"))
    normalize = docs.where(k % 7 != 3).select(k.alias("scheme"), F.lit(None).cast("string").alias("normalizer_version"), F.lit("ok").alias("normalize_status"))
    return base, crawl, extract, normalize


_META = """meta AS (SELECT doc_id AS scheme, 'https://funds.example.com/' || doc_id AS source_url, CASE WHEN doc_id % 6 <> 5 THEN sha256(text) END AS content_sha256, CASE WHEN doc_id % 5 <> 2 AND doc_id % 2 = 0 THEN '2.1' ELSE '1.0.0' END AS parser_version,
CASE WHEN doc_id % 4 <> 1 THEN '2025-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS fetched_at, CASE WHEN doc_id % 5 <> 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'partial' ELSE 'ok' END END AS extract_status, '1.0.0' AS normalizer_version,
CASE WHEN doc_id % 7 <> 3 THEN 'ok' END AS normalize_status, CASE WHEN doc_id % 6 = 5 OR text IS NULL THEN 'missing_clean_markdown' END AS error, CASE WHEN doc_id % 6 <> 5 THEN text END AS markdown FROM documents)"""


@query(f"WITH {_META} SELECT * EXCLUDE (markdown) FROM meta")
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.doc_metadata(*_sidecars(spark, sf_dir)).drop("candidates")


@query(rf"""WITH {_META}, split AS (SELECT scheme, markdown, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM meta WHERE length(markdown) > 0),
marks AS (SELECT scheme, regexp_matches(line, '^(#{{1,6}})[ \t]+(.+?)[ \t]*$') AS h, trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' AS text_line, pos FROM split),
heads AS (SELECT scheme, count(*) FILTER (WHERE h) AS n, min(pos) FILTER (WHERE h) AS first, min(pos) FILTER (WHERE text_line AND NOT h) AS body FROM marks GROUP BY scheme)
SELECT scheme, source_url, error, length(markdown) AS body_char_length, content_sha256 AS body_sha256, CASE WHEN markdown IS NOT NULL THEN coalesce(CASE WHEN n = 0 THEN 1 ELSE n + (body IS NOT NULL AND body < first)::INTEGER END, 0) END AS section_count,
CASE WHEN markdown IS NOT NULL THEN extract_status END AS extract_status, CASE WHEN markdown IS NOT NULL THEN normalize_status END AS normalize_status, CASE WHEN markdown IS NOT NULL AND scheme % 4 <> 1 THEN 'ok' END AS fetch_status FROM meta LEFT JOIN heads USING (scheme)""")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, crawl, extract, normalize = _sidecars(spark, sf_dir)
    return corpus.clean_documents(base, corpus.doc_metadata(base, crawl, extract, normalize), crawl).drop("sections")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'https://own.example.org/' WHEN conv_id % 16 < 12 THEN 'https://funds.example.com/funds/s' || conv_id % 16 END AS source_url FROM conversations")
def chunk_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = answers(spark, sf_dir, "conv_id", "turn", "scheme").withColumn("source_url", F.when(F.col("turn") % 3 == 0, "https://own.example.org/").otherwise(" "))
    registry = spark.range(12).select(F.concat(F.lit("s"), "id").alias("scheme"), F.concat(F.lit("https://funds.example.com/funds/s"), "id").alias("url"))
    return corpus.url_defaults(chunks, registry).select("conv_id", "turn", "source_url")


@query(f"WITH {_BM25} SELECT query_id, id, rank, lang, source FROM kw JOIN (SELECT doc_id AS id, lang, source FROM documents WHERE doc_id % 3 <> 0) USING (id)")
def hit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "lang", "source")
    return corpus.vector_records(bm25_topk(spark, sf_dir), records, "id").drop("score")


@query(f"""WITH c AS (SELECT *, {_CANONICAL} AS canon FROM ({_CANON})), r AS (SELECT DISTINCT canon, 'Page ' || regexp_extract(path, '[^/]*$') AS n FROM c WHERE regexp_matches(path, '[02468]$')),
w AS (SELECT c.*, r.n, replace(regexp_extract(path, '[^/]*$'), '-', ' ') AS s FROM c LEFT JOIN r USING (canon))
SELECT page_id, coalesce(n, array_to_string(list_transform(string_split(s, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')) AS label FROM w""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    registry = pages.where(U.path(F.col("url")).rlike("[02468]$")).select("url", F.concat(F.lit("Page "), U.slug(F.col("url"))).alias("scheme_display_name"))
    return corpus.labels(pages, registry, "url").select("page_id", "label")


@query(f"""WITH {_BM25}, {_VEC_ITEMS}, k AS (SELECT * FROM kw WHERE query_id % 4 <> 1), m AS (SELECT query_id, id, greatest(k.score, vec.score) AS score, CASE WHEN k.score IS NULL THEN 'vector' WHEN vec.score IS NULL THEN 'keyword' ELSE 'hybrid' END AS channel
FROM k FULL JOIN vec USING (query_id, id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 5""")
def early_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth question has stop words only."""
    near = vectors.cosine_topk(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir, items=True))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 1, F.array(F.lit("what"), F.lit("is"))).otherwise(F.split("text", " ")).alias("tokens"))
    return corpus.early_hybrid(bm25_topk(spark, sf_dir), near, asked)


# -- handoff --------------------------------------------------------------------------------------------------------

_HAND = {
    "has_d": "doc_id % 11 <> 0", "readable": "doc_id % 13 <> 1", "markdown": "CASE WHEN doc_id % 10 = 1 THEN NULL WHEN doc_id % 10 = 2 THEN '' ELSE 'text' END", "body_missing": "doc_id % 9 = 4", "kind": "CASE WHEN doc_id % 8 = 3 THEN 'object' WHEN doc_id % 8 <> 5 THEN 'array' END",
    "de": "CASE WHEN doc_id % 7 = 2 THEN 'parse_error' WHEN doc_id % 7 = 3 THEN 'odd' WHEN doc_id % 7 = 4 THEN '' ELSE 'ok' END", "has_m": "doc_id % 12 <> 7", "m_readable": "doc_id % 14 <> 5", "me": "CASE WHEN doc_id % 21 = 4 THEN '' ELSE 'ok' END",
    "nn": "CASE WHEN doc_id % 15 = 6 THEN 'failed' ELSE 'ok' END", "quarantined": "doc_id % 16 = 9",
    "meta_url": "CASE WHEN doc_id % 17 = 3 THEN 'no url' WHEN doc_id % 17 = 4 THEN 'https://funds.example.com/z' WHEN doc_id % 17 = 5 THEN 'https://funds.example.com/p1' ELSE '' END",
}
_OWN_URL = "concat('https://funds.example.com/p', CAST(doc_id % 5 AS STRING))"


_BLOCKERS = f"""WITH s AS (SELECT doc_id AS scheme, {_OWN_URL} AS own, {", ".join(f"{v} AS {k}" for k, v in _HAND.items())} FROM documents),
t AS (SELECT *, has_d AND readable AS good, coalesce(nullif(CASE WHEN has_d THEN de END, ''), nullif(CASE WHEN has_m THEN me END, '')) AS status, CASE WHEN has_d OR has_m THEN nn END AS norm, CASE WHEN has_m AND meta_url <> '' THEN meta_url ELSE own END AS url, CASE WHEN has_d THEN markdown END AS md FROM s)
SELECT scheme, concat_ws('|', CASE WHEN NOT has_d THEN 'missing_clean_document' END, CASE WHEN md IS NULL THEN 'missing_clean_markdown' WHEN md = '' THEN 'empty_clean_markdown' END, CASE WHEN NOT has_m THEN 'missing_doc_metadata' END,
CASE WHEN quarantined THEN 'quarantined' END, CASE WHEN good AND body_missing THEN 'clean_document_body_markdown_missing' END, CASE WHEN good AND kind IS NULL THEN 'clean_document_missing_sections' WHEN good AND kind <> 'array' THEN 'clean_document_sections_invalid' END,
CASE WHEN NOT good THEN 'clean_document_unreadable' END, CASE WHEN has_m AND NOT m_readable THEN 'doc_metadata_unreadable' END,
CASE WHEN status IS NULL THEN 'extract_status_missing' WHEN status = 'parse_error' THEN 'extract_status=parse_error' WHEN status <> 'ok' THEN 'extract_status_not_indexable=' || status END, CASE WHEN norm = 'failed' THEN 'normalize_status=failed' END,
CASE WHEN url = 'no url' THEN 'source_url_invalid' WHEN url = 'https://funds.example.com/z' THEN 'source_url_not_allowlisted' WHEN url <> own THEN 'source_url_registry_mismatch' END) AS blockers FROM t"""


@query(_BLOCKERS)
def handoff_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handoff(spark, sf_dir).select("scheme", F.array_join("blockers", "|").alias("blockers"))


@query(_BLOCKERS.replace("status <> 'ok'", "status NOT IN ('ok', 'odd')").replace("norm = 'failed'", "norm = 'none'"))
def handoff_blockers_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under rules of a configuration: another status may be indexed, and one of normalisation no longer blocks."""
    rules = corpus.handoff_rules({"handoff": {"indexable_extract_statuses": ["ok", "odd"], "blocked_normalize_statuses": ["none"]}})
    return _handoff(spark, sf_dir, rules).select("scheme", F.array_join("blockers", "|").alias("blockers"))


def _handoff(spark: SparkSession, sf_dir: str, rules: corpus.HandoffRules = corpus.HandoffRules()) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scheme"), F.expr(_OWN_URL).alias("url"), *[F.expr(v).alias(k) for k, v in _HAND.items()])
    docs = rows.where("has_d").select("scheme", "readable", F.lit("").alias("doc_url"), "markdown", "body_missing", F.col("kind").alias("sections_kind"), F.col("de").alias("extract_status"), F.col("nn").alias("normalize_status"))
    meta = rows.where("has_m").select("scheme", F.col("m_readable").alias("readable"), "meta_url", F.col("me").alias("extract_status"), F.col("nn").alias("normalize_status"))
    manifest = rows.select("scheme", F.lit(1).alias("seq"), "quarantined")
    allowed = spark.range(5).select(F.concat(F.lit("https://funds.example.com/p"), "id").alias("url"))
    return corpus.handoff_blockers(corpus.handoff_rows(rows.select("scheme", "url"), docs, meta, manifest), allowed, rules=rules)


@query("SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS indexable, count(*) FILTER (WHERE doc_id % 3 = 0) < 500 AS partial FROM documents")
def partial_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.partial_flag(table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 == 0).alias("indexable")), 500)


@query("""SELECT 'v1' AS index_version, 'hash_v1' AS embedding_model_id, 16 AS schemes_expected, count(*) FILTER (WHERE doc_id % 3 = 0) AS schemes_indexable, count(*) FILTER (WHERE doc_id % 3 = 0) < 16 AS partial_corpus, count(*) AS total_chunks,
0.9::DOUBLE AS recall_at_k, true AS benchmark_passed, count(*) FILTER (WHERE doc_id % 3 = 0) >= 16 AS ready FROM documents""")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    benchmark = spark.range(1).select(F.lit(0.9).alias("recall"), F.lit(True).alias("passed"))
    return corpus.index_manifest(docs, docs.select((F.col("doc_id") % 3 == 0).alias("indexable")), "v1", "hash_v1", benchmark)


_GOOD_RETRIEVAL = {
    "phase": "4.6", "version_pins": {"index_version": "v", "embedding_model_id": "m"}, "evidence_fields_for_phase5": {"found": ["a"], "not_found_in_sources": ["b"]},
    "refusal_contract": {"fields": ["x"], "refusal_types": ["advisory"]}, "performance_limited_flag": {"field": "p"}, "api_surface": {"retrieve": "r"},
}
_GOOD_ANSWER = {
    "phase": "5.6", "api_surface": {"answer": "a", "answer_envelope": {"fields": corpus.ENVELOPE_FIELDS, "outcome_types": ["factual"]}, "chat_endpoint_suggestion": {"path": "/chat", "request_body": {"query": "string"}}},
    "middleware_hooks": {"pre_generation": {"module": "m"}, "post_generation": {"module": "m"}}, "evaluation_summary": {"passed": True},
}
_BAD_RETRIEVAL = json.dumps({**_GOOD_RETRIEVAL, "phase": "4.5", "version_pins": {}, "refusal_contract": {"fields": [], "refusal_types": []}})
_BAD_ANSWER = json.dumps({**_GOOD_ANSWER, "api_surface": {"answer": "", "answer_envelope": {"fields": ["query"]}}, "evaluation_summary": {}})


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'handoff_phase|missing_index_version|missing_embedding_model_id|missing_refusal_fields|missing_refusal_types'
ELSE 'handoff_phase|missing_index_version|missing_embedding_model_id|missing_evidence_fields:found|missing_evidence_fields:not_found_in_sources|missing_refusal_fields|missing_refusal_types|missing_performance_flag|missing_api_surface' END AS retrieval,
CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing_api_answer|incomplete_envelope_fields|missing_outcome_types|chat_path|missing_chat_query_field|warning_eval_not_passed'
ELSE 'handoff_phase|missing_api_answer|missing_envelope_fields|missing_outcome_types|chat_path|missing_chat_query_field|missing_pre_generation_module|missing_post_generation_module|warning_eval_not_passed' END AS answer FROM events""")
def handoff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    pick = lambda good, bad: F.when(k == 0, json.dumps(good)).when(k == 1, bad).when(k == 2, F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(corpus.retrieval_handoff_issues(pick(_GOOD_RETRIEVAL, _BAD_RETRIEVAL)), "|").alias("retrieval"), F.array_join(corpus.answer_handoff_issues(pick(_GOOD_ANSWER, _BAD_ANSWER)), "|").alias("answer")
    )


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src1'")
def scheme_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scheme"), "lang")
    return corpus.by_scheme(registry, "src1").select("doc_id", F.col("scheme").alias("source"), "lang")


@query("SELECT page_id FROM pages WHERE regexp_replace(trim(url), '/+$', '') IN (SELECT regexp_replace(trim(url), '/+$', '') FROM pages WHERE page_id % 3 = 0)")
def listed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return corpus.listed_sources(pages.withColumn("url", F.concat(F.lit(" "), "url", F.lit("/"))), pages.where("page_id % 3 = 0")).select("page_id")


@query(f"SELECT doc_id, source, {_STABLE.replace('{0}', 'text')} AS content_hash, length(coalesce(text, '')) AS text_length, substr(coalesce(text, ''), 1, 100) AS body_text FROM documents")
def processed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.processed_records(table(spark, sf_dir, "documents"), "doc_id", "source", "text", 100)


@query("SELECT page_id FROM pages WHERE page_id % 5 <> 0")
def strict_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("http_status"))
    return corpus.strict_pages(pages.where("page_id % 5 <> 0")).select("page_id")


@query("SELECT count(*) AS failing, count(*) > 0 AS refused, CASE WHEN count(*) > 0 THEN '404' END AS why FROM pages WHERE page_id % 5 = 0")
def strict_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict form over all pages, some of which are not found: the run is refused, and says why."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("http_status"))
    why = None
    try:
        corpus.strict_pages(pages).write.format("noop").mode("overwrite").save()
    except Exception as e:
        why = "404" if "404 for" in str(e) else str(e)
    return pages.where("http_status <> 200").agg(F.count("*").alias("failing")).withColumns({"refused": F.lit(why is not None), "why": F.lit(why)})


# -- sources and sinks, written and read again ----------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{scratch.shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) AS kind FROM events WHERE props IS NOT NULL")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose leftover key has a nested document: it comes back as one, not as its text."""
    rows = table(spark, sf_dir, "events").where("props IS NOT NULL")
    rows = rows.select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "p": '), "props", F.lit("}")).alias("j"))
    found = tables.decode_records(rows, "j", "event_id long", typed=True).withColumn("p", F.try_element_at("metadata", F.lit("p")))
    kind = F.when(F.schema_of_variant("p").startswith("OBJECT"), "OBJECT").otherwise(F.schema_of_variant("p"))
    return found.select("event_id", F.variant_get("p", "$.k", "string").alias("k"), kind.alias("kind"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), '|'), '') AS rest FROM events WHERE props IS NOT NULL")
def decoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("props IS NOT NULL").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("props").alias("p"))).alias("j"), "event_id", "props")
    got = tables.decode_records(rows.select(F.expr("concat('{\"event_id\":', event_id, ',', substr(props, 2))").alias("j")), "j", "event_id long, k string")
    return got.select("event_id", "k", F.array_join(F.array_sort(F.map_keys("metadata")), "|").alias("rest"))


@query("SELECT doc_id, doc_id % 4 <> 1 AS sha_ok FROM documents")
def verified_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.text_of(F.col("text"))
    digest = F.sha2(F.when(F.col("doc_id") % 4 == 1, F.concat(text, F.lit("x"))).otherwise(text).cast("binary"), 256)
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("body"), digest.alias("digest"))
    return tables.verified(rows, "body", "digest").select("doc_id", "sha_ok")


@query("SELECT doc_id, lang, 'v2' AS version FROM documents WHERE doc_id % 2 = 1")
def active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions written, the second made active: what is read is the second."""
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "lang"), _folder(spark, "versions")
    for k, name in ((0, "v1"), (1, "v2")):
        tables.write_version(docs.where(F.col("doc_id") % 2 == k), root, name)
        tables.activate(spark, root, name)
    return tables.read_active(spark, root).withColumn("version", F.lit(tables.active_version(spark, root)["version"]))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src2')")
def indexable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    manifest = docs.select("source").distinct().withColumn("indexable", F.col("source").isin("src0", "src2"))
    return tables.read_indexable(docs, manifest, "source")


@query("SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'failed' WHEN page_id % 6 = 2 THEN 'non_html' WHEN page_id % 6 = 3 THEN 'challenge_suspect' ELSE 'ok' END AS fetch_status, page_id % 6 <> 1 AS has_body FROM pages")
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, path = F.col("page_id") % 6, _folder(spark, "pages")
    pages = table(spark, sf_dir, "pages")
    status = tables.fetch_status(F.when(k == 1, 500).otherwise(200), F.when(k == 2, "image/png").otherwise("text/HTML"), F.col("html"), k == 3)
    tables.write_pages(pages.select("page_id", "html", status.alias("fetch_status")), path)
    return spark.read.parquet(path).select("page_id", "fetch_status", F.col("html").isNotNull().alias("has_body"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0")
def upserted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return refresh.upsert(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), "doc_id")


def _redacted(t: str) -> str:
    for label, pattern in X.PII:
        t = f"regexp_replace({t}, '{pattern}', '[{label}_REDACTED]', 'g')"
    return t


@query(f"SELECT conv_id, turn, {_redacted('text')} AS query FROM conversations")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, turns = _folder(spark, "log"), table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    for k in (0, 1):
        tables.append_log(turns.where(F.col("turn") % 2 == k), path, X.redact)
    return spark.read.schema("conv_id long, turn long, query string").json(path)


@query("SELECT min(doc_id)::INTEGER AS id, source AS scheme, 'https://funds.example.com/' || source AS url, count(*) % 2 = 0 AS active FROM documents WHERE source IS NOT NULL GROUP BY source")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry document with an entry for each source of the documents, written and read again."""
    sources = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.min("doc_id").cast("int").alias("id"), (F.count("*") % 2 == 0).alias("active"))
    entry = F.struct("id", F.col("source").alias("scheme"), F.concat(F.lit("https://funds.example.com/"), "source").alias("url"), "active")
    path = _folder(spark, "registry")
    sources.agg(F.collect_list(entry).alias("entries")).select(F.to_json(F.struct("entries")).alias("value")).write.text(path)  # a corpus has few sources
    return tables.read_registry(spark, path).select("id", "scheme", "url", "active")


@query("SELECT source AS scheme, 'https://funds.example.com/' || lang || '/' || source AS url FROM documents WHERE source IS NOT NULL AND lang = 'en' GROUP BY source, lang")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the sources with English documents, as lines, and read again."""
    found = [r.source for r in table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang = 'en'").select("source").distinct().collect()]
    lines = [x for s in found for x in (f"  - scheme: {s}", f'    url: "https://funds.example.com/en/{s}"  # page')]
    return tables.read_source_list(spark, ["sources:", *lines], len(found))


@query("SELECT source AS scheme, count(*) AS chunk_count, array_to_string(list('c' || doc_id ORDER BY doc_id), '|') AS chunk_ids FROM documents GROUP BY source")
def chunk_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles written by scheme and read again, every other record without the scheme, which the bundle's name then tells."""
    docs, path = table(spark, sf_dir, "documents"), _folder(spark, "bundles")
    chunks = docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("doc_id").cast("int").alias("start_char"), F.col("source").alias("scheme"))
    bundles.write_bundles(chunks, path)
    back = bundles.read_bundles(spark, path)
    blank = back.withColumn("scheme", F.when(F.col("start_char") % 2 == 0, F.col("scheme")))
    blank.select("chunk_id", "start_char", "scheme", F.col("scheme").alias("s")).drop("s").join(back.select("chunk_id", F.col("scheme").alias("bundle")), "chunk_id").write.partitionBy("bundle").json(f"{path}-again")
    return bundles.bundle_documents(bundles.read_bundles(spark, f"{path}-again")).withColumn("chunk_ids", F.array_join("chunk_ids", "|"))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "hashes")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    missing = tables.read_or_empty(spark, path, "doc_id long, h string")
    docs.join(missing, "doc_id", "left_anti").select("doc_id", "h").write.parquet(path)
    return tables.read_or_empty(spark, path, "doc_id long, h string")


# -- SQL of queries registered before, made of the pieces above -----------------------------------------------------


def _listed(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {label} END" for label, test in pairs) + "], lambda x: x IS NOT NULL)"


def _phrases(t: str) -> str:
    """How many phrases and patterns an answer has outside quotes."""
    low = rf"""lower(trim(regexp_replace(regexp_replace(regexp_replace({t}, '"[^"]*"', ' ', 'g'), '''[^'']*''', ' ', 'g'), {_WS})))"""
    tests = [f"contains(low, '{p}')" if " " in p else rf"regexp_matches(low, '\b{p}\b')" for _, ps in guardrails.ANSWER_PHRASES for p in (x.strip() for x in ps)]
    tests += [f"regexp_matches(low, '(?i){p}')" for p in ANSWER_PATTERNS]
    return low, " + ".join(f"({x})::INTEGER" for x in tests)


def _clauses(t: str) -> str:
    return f"coalesce(list_sum(list_transform({_sentences(t)}, lambda s: greatest(1, len(list_filter(string_split(s, ';'), lambda p: trim(p) <> ''))))), 0)"


_BARE_URL = r"(?i)https?://[^\s)\]]+"
_LOW_BODY, _PHRASE_COUNT = _phrases("body")
_DRAFTS = f"""q AS ({_ASKED}), k AS (SELECT conv_id, turn, query AS chunk, (conv_id + turn) % 5 AS k FROM q),
drafts AS (SELECT *, CASE WHEN k = 1 THEN chunk || ' see https://funds.example.com/a' ELSE chunk END AS body FROM k),
lowered AS (SELECT *, {_LOW_BODY} AS low FROM drafts), counted AS (SELECT *, {_PHRASE_COUNT} AS phrases, {_clauses('body')} AS n, len(regexp_extract_all(body, '{_BARE_URL}')) AS links FROM lowered),
judged AS (SELECT *, list_concat({_listed([("'sentence_budget_exceeded'", 'n > 3'), ("'body_contains_hyperlink'", 'links > 0'), ("'citation_not_allowlisted'", 'k = 2'), ("'missing_disclaimer'", 'k = 3'), ("'missing_footer'", 'k = 4'), ("'footer_date_mismatch'", 'k = 4'), ("'empty_body'", "trim(body) = ''")])},
  list_transform(range(phrases), lambda i: 'prohibited_phrase')) AS codes FROM counted)"""
ORACLES["validate_drafts"] = f"WITH {_DRAFTS} SELECT conv_id, turn, len(codes) = 0 AS passed, codes FROM judged"

_LOW_CUT, _CUT_COUNT = _phrases("cut")
_STRIPPED = rf"trim(regexp_replace(regexp_replace(regexp_replace(body, '\[[^\]]+\]\(([^)]+)\)', '', 'g'), '{_BARE_URL}', '', 'g'), '\s{{2,}}', ' ', 'g'))"
ORACLES["repair_drafts"] = rf"""WITH {_DRAFTS}, bare AS (SELECT * EXCLUDE (low), len(codes) = 0 AS good, CASE WHEN links > 0 THEN {_STRIPPED} ELSE body END AS plain FROM judged),
cuts AS (SELECT *, CASE WHEN good THEN body WHEN n > 3 THEN {_first_sentences('plain', 3)} ELSE plain END AS cut FROM bare),
lowcut AS (SELECT *, {_LOW_CUT} AS low FROM cuts), bad AS (SELECT *, NOT good AND ({_CUT_COUNT}) > 0 AS bad FROM lowcut),
done AS (SELECT *, CASE WHEN bad THEN 'refusal' ELSE 'factual' END AS answer_type, CASE WHEN bad THEN '{_q(dict(POLICY.refusals)[POLICY.fallback_type])}' ELSE cut END AS text,
  CASE WHEN good THEN [] ELSE {_listed([("'strip_body_hyperlinks'", 'links > 0'), ("'rebuild_citation_markdown'", 'k = 2'), ("'truncate_sentence_budget'", 'n > 3'), ("'inject_footer_unavailable'", 'k = 4'), (f"'fallback_refusal:{POLICY.fallback_type}'", 'bad')])} END AS repair_actions,
  CASE WHEN bad THEN '' WHEN k = 4 THEN '{POLICY.footer}{POLICY.no_date}' ELSE '{POLICY.footer}01 Jan 2025' END AS footer, CASE WHEN k = 3 THEN '' ELSE '{POLICY.disclaimer}' END AS disclaimer,
  CASE k WHEN 2 THEN '[{POLICY.default_label}]({POLICY.default_url})' ELSE '[a](https://www.funds.example.com/funds/a/?x=1)' END AS link FROM bad),
again AS (SELECT *, {_listed([("'sentence_budget_exceeded'", f"{_clauses('text')} > 3"), ("'missing_disclaimer'", 'k = 3'), ("'empty_body'", "trim(text) = ''")])} AS rest FROM done)
SELECT conv_id, turn, answer_type, len(rest) = 0 AS passed, repair_actions, rest AS codes,
array_to_string(list_filter([text, link, CASE WHEN answer_type = 'factual' THEN footer END, disclaimer], lambda p: p IS NOT NULL AND trim(p) <> ''), chr(10) || chr(10)) AS display FROM again"""

ORACLES["compliance_route"] = f"""WITH i AS ({ORACLES['intent_classify']}), {_sanitize_sql()},
o AS (SELECT clean.*, action IN ('refuse', 'disambiguate') AS refused, refusal_type, action = 'performance_limited' AS limited, length(query) <= 200 OR trim(query) = '' AS missing FROM clean JOIN i USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN refused THEN 'refuse' WHEN missing THEN 'abstain' ELSE 'allow_compose' END AS decision, CASE WHEN refused THEN 'refusal' WHEN missing THEN 'abstention' ELSE 'factual' END AS route, sanitized AS sanitized_query,
{_listed([("'refusal_short_circuit'", 'refused'), ("'query_injection_stripped'", "found <> ''"), ("'refusal_type:' || refusal_type", "refused AND refusal_type <> ''"), ("'performance_limited_grounding_required'", 'NOT refused AND limited'), ("'performance_projection_query_detected'", f'NOT refused AND limited AND {_PROJECTING}'),
  ("'evidence_empty_not_found_in_sources'", 'NOT refused AND missing'), ("'retrieval_evidence_present'", 'NOT refused AND NOT missing'), ("'performance_limited_compose_allowed'", 'NOT refused AND NOT missing AND limited')])} AS reasons FROM o"""

_KEYED = _BEST.replace("conv_id, turn", "query_id, id")
_TEMPLATES = " ".join(f"WHEN facet = '{n}' AND value <> '' THEN '{t.split('{value}')[0]}' || value || '{t.split('{value}')[1]}'" for n, t in guardrails.ANSWER_TEMPLATES.items())
ORACLES["compose_answers"] = f"""WITH {_BM25}, f AS (SELECT query_id, id, b.text AS query, d.text AS chunk FROM kw JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id WHERE rank = 1), {_KEYED},
d AS (SELECT *, {_detect_sql('query', 'chunk')} AS facet FROM b), v AS (SELECT *, {_value_sql('facet', 'chunk')} AS value FROM d)
SELECT query_id, id, facet AS facet_detected, CASE {_TEMPLATES} ELSE sentence END AS body_text, '{POLICY.footer}31 Jan 2025' AS footer_line FROM v"""


def _candidate_sql(facet: str, t: str) -> str:
    """The first pattern that fits as a struct; a snippet with context begins so many characters before the first place of the match."""
    cases = []
    for name, pattern, group, before, after in handoff.CANDIDATES[facet]:
        p = _q(pattern)
        hit = f"regexp_extract({t}, '{p}', 0)"
        at = f"strpos({t}, {hit})"
        snippet = f"substr({t}, greatest({at} - {before}, 1), {at} - greatest({at} - {before}, 1) + length({hit}) + {after})" if before else hit
        value = f"regexp_extract({t}, '{p}', {group})" if group else "NULL"
        value = f"'₹' || {value}" if facet == "min_sip" else f"{value} || ' risk'" if name == "risk_label_v1" else value
        clip = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 3}) || '...' ELSE {x} END"
        squeezed = rf"trim(regexp_replace({snippet}, {_WS}))"
        cases.append(f"WHEN {hit} <> '' THEN struct_pack(pattern := '{name}', snippet := {clip(squeezed, 220)}, value := {clip(f'trim({value})', 80) if value != 'NULL' else 'NULL'})")
    return "CASE " + " ".join(cases) + " END"


_STATED = [f for f in handoff.CANDIDATES if f != "benchmark"]
_STATED_SQL = f"WITH {_FACT_ROWS} " + " UNION ALL ".join(
    f"SELECT id, '{f}' AS facet, c.pattern AS pattern, c.snippet AS snippet, c.value AS value FROM (SELECT conv_id || '/' || turn AS id, {_candidate_sql(f, 'chunk')} AS c FROM f) WHERE c IS NOT NULL" for f in _STATED
)


@query(_STATED_SQL)
def stated_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facet_candidates of texts that state facts, but for the benchmark's pattern, which looks ahead and has no SQL."""
    rows = _facts(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("chunk").alias("text"))
    return handoff.facet_candidates(rows, "id", "text").where("facet <> 'benchmark'")


# -- contracts, adapters, providers ---------------------------------------------------------------------------------


@query(rf"""WITH l AS (SELECT conv_id, turn, text || ' [a]( https://x.org/' || turn || ' ) and https://funds.example.com/b.' AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(t, '\[[^\]]+\]\(([^)]+)\)', 1), lambda u: trim(u)), '|') AS targets, array_to_string(regexp_extract_all(t, '{_BARE_URL}'), '|') AS urls FROM l""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" [a]( https://x.org/"), F.col("turn").cast("string"), F.lit(" ) and https://funds.example.com/b."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.link_targets(t), "|").alias("targets"), F.array_join(X.bare_urls(t, "funds.example.com"), "|").alias("urls"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'factual' WHEN turn % 3 = 1 AND conv_id % 2 = 1 THEN 'factual' ELSE 'refusal' END AS answer_type, text AS body_text, CASE WHEN conv_id % 2 = 0 THEN 'advisory' ELSE '' END AS refusal_type, '' AS footer_line FROM conversations""")
def normalized_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    draft = F.to_json(F.struct(F.when(k == 0, "factual").when(k == 1, "odd").alias("answer_type"), F.col("text").alias("body_text"), F.when(F.col("conv_id") % 2 == 0, "advisory").alias("refusal_type")))
    rows = guardrails.normalize_drafts(table(spark, sf_dir, "conversations").select("conv_id", "turn", draft.alias("j")), "j")
    return rows.select("conv_id", "turn", "answer_type", "body_text", "refusal_type", "footer_line")


@query("""SELECT conv_id, turn, text AS query, CASE WHEN turn % 2 = 0 THEN 'refusal' ELSE 'retrieval' END AS outcome_type, conv_id % 3 = 0 AS performance_limited, CASE WHEN turn % 2 = 0 THEN 'advisory' ELSE '' END AS refusal_type,
CASE WHEN turn % 2 = 1 THEN 'found' ELSE '' END AS retrieval_status, CASE WHEN turn % 2 = 1 THEN text ELSE '' END AS chunk_text, '' AS not_found_reason FROM conversations""")
def normalized_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused = F.col("turn") % 2 == 0
    outcome = F.to_json(F.struct(
        F.col("text").alias("query"), F.when(refused, "refusal").otherwise("retrieval").alias("outcome_type"), F.when(F.col("conv_id") % 3 == 0, True).alias("performance_limited"),
        F.when(refused, F.struct(F.lit("advisory").alias("refusal_type"))).alias("refusal"), F.when(~refused, F.struct(F.lit("found").alias("status"), F.col("text").alias("chunk_text"))).alias("retrieval"),
    ))
    return guardrails.normalize_outcomes(table(spark, sf_dir, "conversations").select("conv_id", "turn", outcome.alias("j")), "j")


_CONTRACT = {"phase": "5.6", "api_surface": {"answer_envelope": {"fields": ["outcome_type", "query", "assistant"], "outcome_types": ["factual", "refusal"]}, "assistant_response": {"fields": ["body_text"]}}}


@query("""SELECT conv_id, turn, concat_ws('|', CASE WHEN turn % 2 = 1 THEN 'missing:query' END, CASE WHEN turn % 3 = 0 THEN 'extra:trace' END, CASE WHEN conv_id % 4 = 0 THEN 'assistant_missing:body_text' END, CASE WHEN conv_id % 5 > 2 THEN 'unknown_outcome_type' END) AS faults FROM conversations""")
def envelope_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators import requests

    k = F.col("conv_id")
    kind = F.when(k % 5 == 0, "factual").when(k % 5 < 3, "refusal").otherwise("odd")
    envelope = F.to_json(F.struct(kind.alias("outcome_type"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("query"), F.when(F.col("turn") % 3 == 0, 1).alias("trace"), F.struct(F.when(k % 4 != 0, "b").alias("body_text")).alias("assistant")))
    faults = requests.contract_faults(envelope, requests.load_contract(_CONTRACT))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(faults, "|").alias("faults"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE 'shown' END AS answer, CASE WHEN conv_id % 3 = 0 THEN 'https://funds.example.com/f/some-fund-x' WHEN conv_id % 3 = 1 THEN 'none' ELSE '' END AS citation_url,
CASE WHEN turn % 3 = 0 THEN '01 Jan 2025' WHEN turn % 3 = 1 THEN '02 Feb 2025' ELSE 'date unavailable' END AS footer_date, CASE WHEN conv_id % 4 = 1 THEN 'refusal' ELSE 'factual' END AS outcome_type, CASE WHEN conv_id % 3 = 0 THEN 'some fund x' ELSE 'Official Source' END AS label FROM conversations""")
def ui_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators import requests

    k, t = F.col("conv_id"), F.col("turn")
    assistant = F.struct(
        F.when(t % 2 == 0, F.col("text")).otherwise(" ").alias("body_text"), F.when(k % 3 == 0, "https://funds.example.com/f/some-fund-x").when(k % 3 == 1, " none").alias("citation_url"),
        F.when(t % 3 == 0, "01 Jan 2025").alias("footer_date"), F.when(t % 3 == 1, "last updated from sources: 02 Feb 2025").alias("footer_line"),
    )
    envelope = F.to_json(F.struct(F.when(k % 4 == 1, "refusal").when(k % 4 == 2, "odd").alias("outcome_type"), F.lit("shown").alias("display_text"), assistant.alias("assistant")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", requests.ui_response(envelope).alias("r")).select("conv_id", "turn", "r.*")


_DEDUPED = "lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"
_ROLLUP = f"""r AS (SELECT source, text, row_number() OVER (PARTITION BY source, {_DEDUPED} ORDER BY n_chars, doc_id) AS rn, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT source, count(*) AS chunks_in, sum(toxic)::BIGINT AS hard_errors, count(*) FILTER (WHERE rn = 1) AS chunks_out, count(*) FILTER (WHERE rn = 1 AND greatest(1, floor(length(coalesce(text, '')) / 4.0)) > 512) AS over_limit FROM r GROUP BY source)"""


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators import quality

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    chunks = docs.select("doc_id", "source", "n_chars", "text", F.coalesce("toxic", F.lit(0)).alias("hard_errors"))
    return quality.validation_rollup(chunks, "source", "text", ["n_chars", "doc_id"])


@query(f"WITH {_ROLLUP} SELECT *, chunks_in - chunks_out AS duplicates, CASE WHEN hard_errors > 0 THEN 'failed_validation' ELSE 'validated' END AS status, hard_errors = 0 AS indexable FROM v")
def validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validation(spark, sf_dir)


@query(f"""WITH {_ROLLUP} SELECT count(*) AS groups, count(*) FILTER (WHERE hard_errors = 0) AS indexable, sum(chunks_in)::BIGINT AS chunks_in, sum(chunks_out)::BIGINT AS chunks_out, sum(chunks_in - chunks_out)::BIGINT AS duplicates, sum(over_limit)::BIGINT AS over_limit,
coalesce(array_to_string(list(source ORDER BY source) FILTER (WHERE hard_errors > 0), '|'), '') AS excluded FROM v""")
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators import quality

    return quality.validation_totals(_validation(spark, sf_dir), "source").withColumn("excluded", F.array_join("excluded", "|"))


@query(r"""SELECT doc_id AS id, round((length(t) - length(regexp_replace(t, '[aeiou]', '', 'g'))) / greatest(1, length(t)), 9) AS vowels, round((length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) / greatest(1, length(t)), 9) AS digits,
round((length(t) - length(regexp_replace(t, '[ \t\n]', '', 'g'))) / greatest(1, length(t)), 9) AS blanks FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def provider_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators import embedding

    rows = embedding.embed(table(spark, sf_dir, "documents"), "doc_id", "text", embedding.provider("letters_v1"))
    return rows.select("id", *[F.round(F.get("embedding", F.lit(i)), 9).alias(n) for i, n in enumerate(("vowels", "digits", "blanks"))])


@query("SELECT source AS index_version, count(*) AS k FROM documents WHERE source IS NOT NULL GROUP BY source")
def config_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of an index of each source's documents: how many there are."""
    path = _folder(spark, "config")
    for r in table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").count().collect():
        bundles.write_config(spark, path, r.source, {"k": r["count"]}, "2025-01-01")
    return spark.read.schema("index_version string, config struct<k: bigint>").json(path).select("index_version", "config.k")


@query("""SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'It says ' || length(text) || '%.' WHEN item_id % 3 = 1 THEN 'The expense ratio is 0.' || (item_id % 90 + 10) || '%.' ELSE 'Written twice.' END AS body_text FROM benchmark""")
def written_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that fails for some questions (the template stands, with the figure of that question's evidence), says a number that the evidence has, or none."""
    k = F.col("item_id")
    evidence = F.concat(F.lit("Expense ratio 0."), (k % 90 + 10).cast("string"), F.lit("%. It says "), F.length("text").cast("string"), F.lit("%."))
    rows = table(spark, sf_dir, "benchmark").select(
        k.alias("query_id"), F.concat(F.lit("what is the expense ratio "), (k % 3).cast("string")).alias("query"), evidence.alias("chunk_text"),
        F.lit("(document)").alias("section_title"), F.lit("2025-01-31").alias("effective_date"), F.lit(POLICY.default_url).alias("citation_url"), F.lit(False).alias("performance_limited"),
    )
    return guardrails.compose_factual(guardrails.written_bodies(rows, _writer, POLICY), POLICY).select("query_id", "body_text")


def _writer(query: str, chunk: str, most: int, limited: bool) -> str:
    if query.endswith("1"):
        raise TimeoutError
    return chunk[chunk.index("It says") :] if query.endswith("0") else "Written twice."


@query("""SELECT lang AS metric, round(avg(n_chars), 4) AS value, 'first' AS run FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT source, round(count(*), 4), 'second' FROM documents WHERE source IS NOT NULL GROUP BY source""")
def metric_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' metrics, appended: the mean length by language, and the documents of each source."""
    docs, path = table(spark, sf_dir, "documents"), _folder(spark, "snapshots")
    bundles.write_snapshot(docs.where("lang IS NOT NULL").groupBy(F.col("lang").alias("metric")).agg(F.round(F.avg("n_chars"), 4).alias("value")), path, "first")
    bundles.write_snapshot(docs.where("source IS NOT NULL").groupBy(F.col("source").alias("metric")).agg(F.count("*").cast("double").alias("value")), path, "second")
    return spark.read.schema("metric string, value double, run string").json(path)
