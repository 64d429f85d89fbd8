"""Guardrails: routing before an answer is written, composition, validation and repair after."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.functions.rules import ANSWER_PATTERNS, ANSWER_PHRASES, QUERY_INJECTION

VIOLATION = "array<struct<code:string,message:string>>"

# Patterns of facet values in evidence, and words in a question that name a facet.
FACET_VALUES = {
    "expense_ratio": [r"(?i)expense ratio[^0-9%]*([0-9]+(?:\.[0-9]+)?\s*%)", r"(?i)\bTER\b[^0-9%]*([0-9]+(?:\.[0-9]+)?\s*%)"],
    "exit_load": [r"(?i)exit load[^.\n]{0,80}?(Nil|[0-9]+(?:\.[0-9]+)?\s*%)"],
    "min_sip": [r"(?i)min\.?\s*for\s*sip[^₹0-9]*([₹][0-9,]+|[0-9,]+)"],
    "min_investment": [r"(?i)min\.?\s*for\s*1st\s*investment[^₹0-9]*([₹][0-9,]+|[0-9,]+)", r"(?i)minimum\s+lumpsum\s+investment[^₹0-9]*([₹][0-9,]+|[0-9,]+)"],
    "benchmark": [r"(?i)fund benchmark\s+([A-Z0-9][A-Z0-9 \-]+)", r"(?i)benchmark index\s+([A-Z0-9][A-Z0-9 \-]+)"],
    "riskometer": [r"(?i)(?:rated|riskometer)\s+([A-Za-z ]{3,30})\s+risk", r"(?i)riskometer[^A-Za-z]{0,20}([A-Za-z ]{3,30})"],
}
FACET_HINTS = [
    ("expense_ratio", ["expense ratio", "ter", "total expense"]), ("exit_load", ["exit load", "redemption charge"]), ("min_sip", ["minimum sip", "min sip", "sip amount"]),
    ("min_investment", ["minimum investment", "min investment", "lumpsum", "first investment"]), ("benchmark", ["benchmark", "benchmark index"]), ("riskometer", ["riskometer", "risk rating", "risk level"]),
]
ANSWER_TEMPLATES = {
    "expense_ratio": "The expense ratio is {value}.", "exit_load": "The exit load is {value}.", "min_sip": "The minimum SIP amount is {value}.",
    "min_investment": "The minimum investment amount is {value}.", "benchmark": "The fund benchmark is {value}.", "riskometer": "The riskometer classification is {value}.",
}
PERFORMANCE_CLARIFIER = "This reflects factual data from the official page and is not a return projection."


@dataclass(frozen=True)
class Policy:
    """What an installation sets; the texts have neutral defaults."""

    site: str = "funds.example.com"
    allowed: tuple[str, ...] = ()  # canonical citation URLs; empty: any page of the site
    default_url: str = "https://funds.example.com/funds/default"
    default_label: str = "Default Fund"
    disclaimer: str = "Facts-only. No investment advice."
    footer: str = "Last updated from sources: "
    no_date: str = "date unavailable"
    max_sentences: int = 3
    max_body: int = 2
    fallback_type: str = "advisory"
    refusals: tuple[tuple[str, str], ...] = (
        ("advisory", "I cannot provide investment advice or personal recommendations."),
        ("comparison", "I cannot compare funds or say which option is better."),
        ("mixed_intent", "Your question mixes factual and advice-seeking wording. Please ask a factual question about one fund."),
        ("out_of_scope", "That question is outside the funds covered by this assistant."),
        ("disambiguate", "Please name a specific fund so that I can look up factual details such as expense ratio or exit load."),
        ("performance_info", "I can point to factual performance data but cannot predict or project future returns."),
    )
    refusal_fallback: str = "I can only answer factual questions from the allowed sources."
    abstention: str = "I could not find enough evidence in our official sources to answer that question."


# -- before ---------------------------------------------------------------------------------------------------------


def route(df: DataFrame) -> DataFrame:
    """Add decision, route, reasons and sanitized_query to outcomes(query, outcome_type, refusal_type, performance_limited, retrieval_status,
    chunk_text, not_found_reason): refusals are refused, missing evidence abstains, the rest is composed.
    """
    clean, injected = X.sanitize(F.col("query"), QUERY_INJECTION, ANSWER_PATTERNS)
    limited = F.coalesce(F.col("performance_limited"), F.lit(False))
    refused = F.coalesce(F.col("outcome_type") == "refusal", F.lit(False))
    unknown = ~refused & F.coalesce(F.col("outcome_type") != "retrieval", F.lit(True))
    missing = (F.trim(X.text_of(F.col("chunk_text"))) == "") | F.coalesce(F.col("retrieval_status") == "not_found_in_sources", F.lit(False))
    low = F.lower(X.text_of(F.col("query")))
    projecting = X.any_of(low, ANSWER_PHRASES[2][1]) | low.rlike(ANSWER_PATTERNS[2])
    found = ~refused & ~unknown
    reasons = F.array_compact(F.array(
        F.when(refused, "refusal_short_circuit"),
        F.when(F.size(injected) > 0, "query_injection_stripped"),
        F.when(refused & (X.text_of(F.col("refusal_type")) != ""), F.concat(F.lit("refusal_type:"), F.col("refusal_type"))),
        F.when(unknown, F.concat(F.lit("unknown_outcome_type:"), X.text_of(F.col("outcome_type")))),
        F.when(found & limited, "performance_limited_grounding_required"),
        F.when(found & limited & projecting, "performance_projection_query_detected"),
        F.when(found & missing, "evidence_empty_not_found_in_sources"),
        F.when(found & missing & (X.text_of(F.col("not_found_reason")) != ""), F.concat(F.lit("not_found_reason:"), F.col("not_found_reason"))),
        F.when(found & ~missing, "retrieval_evidence_present"),
        F.when(found & ~missing & limited, "performance_limited_compose_allowed"),
    ))
    decision = F.when(refused, "refuse").when(unknown | missing, "abstain").otherwise("allow_compose")
    way = F.when(refused, "refusal").when(unknown | missing, "abstention").otherwise("factual")
    return df.withColumns({"decision": decision, "route": way, "reasons": reasons, "sanitized_query": clean})


# -- composition ----------------------------------------------------------------------------------------------------


def detect_facet(query: Column, chunk: Column) -> Column:
    """By the words of the question, else by what the chunk names, else generic."""
    q, t = F.lower(X.text_of(query)), F.lower(X.text_of(chunk))
    out = F.lit("generic")
    for facet in reversed(["expense_ratio", "exit_load", "min_sip", "benchmark", "riskometer"]):
        out = F.when(X.any_of(t, [facet.replace("_", " "), facet]), facet).otherwise(out)
    for facet, hints in reversed(FACET_HINTS):
        out = F.when(X.any_of(q, hints), facet).otherwise(out)
    return out


def facet_value(facet: Column, chunk: Column) -> Column:
    """The facet's value in the chunk by the first pattern that fits, or empty."""
    out = F.lit("")
    for name, patterns in FACET_VALUES.items():
        value = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(X.text_of(chunk), p, 1)), F.lit("")) for p in patterns], F.lit(""))
        out = F.when(facet == name, value).otherwise(out)
    return out


def best_sentence(query: Column, chunk: Column) -> Column:
    """The chunk's sentence (of 20 characters or more, no table cells or heading marks) with most words of the question; the first of equal ones."""
    bare = F.regexp_replace(F.regexp_replace(X.text_of(chunk), r"\|[^|\n]*\|", " "), r"#+\s*", "")
    parts = F.filter(X.sentences(X.squeeze(bare)), lambda s: (F.length(s) >= 20) & ~F.contains(s, F.lit("|")))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(X.text_of(c)), F.lit("[a-z0-9%]+"), F.lit(0)))
    asked = words(query)
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.array_intersect(asked, words(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    plain = X.squeeze(chunk)
    rest = F.when(F.length(plain) > 220, F.concat(F.rtrim(F.substring(plain, 1, 220)), F.lit("..."))).otherwise(plain)
    best = F.array_max(scored)["s"]
    return F.coalesce(F.when(F.length(best) > 220, F.concat(F.rtrim(F.substring(best, 1, 217)), F.lit("..."))).otherwise(best), rest)


def usable_title(c: Column) -> Column:
    t = F.trim(X.text_of(c))
    return ~t.isin("", "(document)", "(preamble)") & ~X.any_of(F.lower(t), ["view details", "also manages"]) & (F.length(t) <= 80)


#: Puts evidence into words: (question, evidence, sentences at most, performance alone) to a body. It must be importable by the workers.
Writer = Callable[[str, str, int, bool], str]


def written_bodies(df: DataFrame, writer: Writer, policy: Policy = Policy()) -> DataFrame:
    """Add written_body to rows of compose_factual: what a language model makes of the evidence, null where the call failed or gave nothing, so that the extract stands. One pass, no shuffle."""

    @F.pandas_udf("string")
    def written(query: pd.Series, chunk: pd.Series, limited: pd.Series) -> pd.Series:
        def one(q: str | None, c: str | None, p: bool | None) -> str | None:
            try:
                return writer((q or "").strip(), (c or "").strip(), min(policy.max_body, policy.max_sentences), bool(p)).strip() or None
            except Exception:
                return None

        return pd.Series([one(q, c, p) for q, c, p in zip(query, chunk, limited, strict=True)], dtype=object)

    return df.withColumn("written_body", written("query", "chunk_text", F.coalesce("performance_limited", F.lit(False))))


def compose_factual(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Drafts from (query, chunk_text, section_title, effective_date, citation_url, performance_limited): a template with the facet's value or the best
    sentence, then a clarifier; a written_body that isn't null stands in their place. Numbers that the chunk lacks are cut.
    """
    facet = detect_facet(F.col("query"), F.col("chunk_text"))
    value = facet_value(facet, F.col("chunk_text"))
    first = best_sentence(F.col("query"), F.col("chunk_text"))
    for name, template in ANSWER_TEMPLATES.items():
        head, tail = template.split("{value}")
        first = F.when((facet == name) & (value != ""), F.concat(F.lit(head), value, F.lit(tail))).otherwise(first)
    limited = F.when(F.coalesce(F.col("performance_limited"), F.lit(False)), PERFORMANCE_CLARIFIER)
    section = F.when(usable_title(F.col("section_title")), F.concat(F.lit("This information is from the "), F.col("section_title"), F.lit(" section of the official page.")))
    body = F.array_join(F.slice(F.array_compact(F.array(first, limited, section)), 1, policy.max_body), " ")
    if "written_body" in df.columns:
        body = F.coalesce(F.nullif(F.trim("written_body"), F.lit("")), body)
    date = X.display_date(F.col("effective_date"), policy.no_date)
    out = df.withColumns({"facet_detected": facet, "__body": body})
    out = out.withColumn("__bad", X.uncited_numbers(F.col("__body"), F.concat_ws(" ", "chunk_text", "section_title")))
    out = out.withColumn("body_text", F.when(F.size("__bad") > 0, X.strip_numbers(F.col("__body"), F.col("__bad"))).otherwise(F.col("__body")))
    return out.drop("__body", "__bad").withColumns({
        "answer_type": F.lit("factual"), "citation_markdown": F.concat(F.lit(f"[{policy.default_label}]("), F.col("citation_url"), F.lit(")")),
        "disclaimer_line": F.lit(policy.disclaimer), "footer_date": date, "footer_line": F.concat(F.lit(policy.footer), date),
    })


def refusal_body(kind: Column, policy: Policy = Policy()) -> Column:
    out = F.lit(policy.refusal_fallback)
    for name, body in policy.refusals:
        out = F.when(kind == name, body).otherwise(out)
    return out


def compose_refusal(df: DataFrame, policy: Policy = Policy(), abstain: bool = False) -> DataFrame:
    """Drafts from (refusal_type, citation_url): fixed wording, an allowed citation or the default one."""
    url = F.coalesce(allowed_citation(F.col("citation_url"), policy), F.lit(policy.default_url))
    return df.withColumns({
        "answer_type": F.lit("abstention" if abstain else "refusal"), "body_text": F.lit(policy.abstention) if abstain else refusal_body(F.col("refusal_type"), policy),
        "citation_url": url, "citation_markdown": F.concat(F.lit(f"[{policy.default_label}]("), url, F.lit(")")),
        "disclaimer_line": F.lit(policy.disclaimer), "footer_line": F.lit(""), "footer_date": F.lit(""),
    })


# Fields of a draft.
DRAFT_FIELDS = ["body_text", "citation_url", "citation_markdown", "disclaimer_line", "footer_line", "footer_date", "evidence_chunk_id", "refusal_type", "chunk_text"]


def normalize_drafts(df: DataFrame, json_col: str, answer_type: str | None = None) -> DataFrame:
    """Drafts of JSON objects in one form, in place of the column: missing fields are empty, and an unknown type is refusal where a refusal type is named, else factual."""
    d = F.from_json(F.col(json_col), "struct<answer_type:string," + ",".join(f"{f}:string" for f in DRAFT_FIELDS) + ",number_grounding_flags:array<string>>")
    given = F.lit(answer_type) if answer_type else F.coalesce(F.nullif(d["answer_type"], F.lit("")), F.lit("refusal"))
    kind = F.when(given.isin("refusal", "factual"), given).when(X.text_of(d["refusal_type"]) != "", "refusal").otherwise("factual")
    fields = {"answer_type": kind, **{f: X.text_of(d[f]) for f in DRAFT_FIELDS}, "number_grounding_flags": F.coalesce(d["number_grounding_flags"], F.array().cast("array<string>"))}
    return df.withColumns(fields).drop(json_col)


def normalize_outcomes(df: DataFrame, json_col: str) -> DataFrame:
    """Outcomes of JSON objects as route reads them: the parts of refusal and retrieval side by side, empty where one is missing."""
    part = "struct<refusal_type:string>", "struct<status:string,chunk_text:string,not_found_reason:string>"
    o = F.from_json(F.col(json_col), f"struct<query:string,outcome_type:string,performance_limited:boolean,refusal:{part[0]},retrieval:{part[1]}>")
    return df.withColumns({
        "query": X.text_of(o["query"]), "outcome_type": X.text_of(o["outcome_type"]), "performance_limited": F.coalesce(o["performance_limited"], F.lit(False)),
        "refusal_type": X.text_of(o["refusal"]["refusal_type"]), "retrieval_status": X.text_of(o["retrieval"]["status"]), "chunk_text": X.text_of(o["retrieval"]["chunk_text"]),
        "not_found_reason": X.text_of(o["retrieval"]["not_found_reason"]),
    }).drop(json_col)


# -- after ----------------------------------------------------------------------------------------------------------


def allowed_citation(url: Column, policy: Policy) -> Column:
    """The canonical URL if an answer may cite it, else null."""
    canon = U.canonical(U.fullwidth_form(url, policy.site), policy.site)
    return F.when(canon.isin(*policy.allowed), canon) if policy.allowed else canon


def violations(policy: Policy = Policy()) -> Column:
    """Of drafts(answer_type, body_text, citation_url, citation_markdown, disclaimer_line, footer_line, footer_date, chunk_text)."""
    body, kind = X.text_of(F.col("body_text")), F.col("answer_type")
    footer, date = F.trim(X.text_of(F.col("footer_line"))), F.trim(X.text_of(F.col("footer_date")))
    factual = F.coalesce(kind == "factual", F.lit(False))
    n, links, marks = X.sentence_count(body, "clauses"), X.link_count(body, policy.site), X.markdown_link_count(F.col("citation_markdown"))

    def v(test: Column, code: str, message: Column | str) -> Column:
        return F.when(test, F.struct(F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message")))

    single = F.array_compact(F.array(
        v(n > policy.max_sentences, "sentence_budget_exceeded", F.format_string(f"body has %d sentences/clauses; max {policy.max_sentences}", n)),
        v(links > 0, "body_contains_hyperlink", F.format_string("body must not contain links (found %d)", links)),
        v(marks != 1, "citation_link_count", F.format_string("expected exactly one markdown citation link, found %d", marks)),
        v(allowed_citation(F.col("citation_url"), policy).isNull(), "citation_not_allowlisted", "citation_url is not allowed"),
        v(~F.contains(X.text_of(F.col("disclaimer_line")), F.lit(policy.disclaimer)), "missing_disclaimer", "disclaimer_line missing or incorrect"),
        v(factual & ~F.contains(footer, F.lit(policy.footer.strip())), "missing_footer", "footer_line missing required template"),
        v(factual & (date == ""), "missing_footer_date", "footer_date required for factual answers"),
        v(factual & (date != "") & (date != policy.no_date) & ~F.contains(footer, date), "footer_date_mismatch", "footer_date must match footer_line"),
        v(F.trim(body) == "", "empty_body", "body_text is empty"),
    ))
    each = lambda codes, code, message: F.transform(codes, lambda c: F.struct(code(c).alias("code"), message(c).alias("message")))
    phrases = F.when(F.coalesce(kind != "refusal", F.lit(True)), each(X.phrase_hits(body, ANSWER_PHRASES, ANSWER_PATTERNS), lambda c: F.lit("prohibited_phrase"), lambda c: c))
    evidence = F.trim(X.text_of(F.col("chunk_text"))) != ""
    loose = F.when(factual & evidence, each(X.uncited_numbers(body, F.col("chunk_text")), lambda c: F.concat(F.lit("uncited_number:"), c), lambda c: F.lit("uncited numeric in factual body")))
    none = F.array().cast(VIOLATION)
    return F.concat(single.cast(VIOLATION), F.coalesce(phrases.cast(VIOLATION), none), F.coalesce(loose.cast(VIOLATION), none))


def validate(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    checked = df.withColumn("violations", violations(policy))
    return checked.withColumn("passed", F.size("violations") == 0)


def repair(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One pass over validated drafts: cut links, rebuild the citation, keep the sentence budget, add a footer; what still has prohibited phrases becomes a
    refusal. Adds repair_actions; validate again to see what is left.
    """
    codes = F.transform("violations", lambda v: v["code"])
    has = lambda *c: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in c]))
    links, cite = has("body_contains_hyperlink"), has("citation_link_count", "citation_not_allowlisted")
    long = has("sentence_budget_exceeded")
    foot = (F.col("answer_type") == "factual") & has("missing_footer", "missing_footer_date", "footer_date_mismatch")
    url = F.coalesce(allowed_citation(F.col("citation_url"), policy), F.lit(policy.default_url))
    body = F.when(links, X.strip_links(F.col("body_text"), policy.site)).otherwise(F.col("body_text"))
    step = df.withColumns({
        "repair_actions": X.hits([("strip_body_hyperlinks", links), ("rebuild_citation_markdown", cite), ("truncate_sentence_budget", long), ("inject_footer_unavailable", foot)]),
        "body_text": body, "citation_url": F.when(cite, url).otherwise(F.col("citation_url")),
        "citation_markdown": F.when(cite, F.concat(F.lit(f"[{policy.default_label}]("), url, F.lit(")"))).otherwise(F.col("citation_markdown")),
        "footer_date": F.when(foot, policy.no_date).otherwise(F.col("footer_date")), "footer_line": F.when(foot, policy.footer + policy.no_date).otherwise(F.col("footer_line")),
        "__long": long,
    })
    step = step.withColumn("body_text", F.when(F.col("__long"), X.first_sentences(F.col("body_text"), policy.max_sentences)).otherwise(F.col("body_text"))).drop("__long")
    # factual wording alone is held to the phrases; a refusal may name what it refuses
    bad = (F.col("answer_type") != "refusal") & (F.size(X.phrase_hits(F.col("body_text"), ANSWER_PHRASES, ANSWER_PATTERNS)) > 0)
    return step.withColumn("__bad", bad).withColumns({
        "repair_actions": F.when(F.col("__bad"), F.concat("repair_actions", F.array(F.lit(f"fallback_refusal:{policy.fallback_type}")))).otherwise(F.col("repair_actions")),
        "answer_type": F.when(F.col("__bad"), "refusal").otherwise(F.col("answer_type")),
        "body_text": F.when(F.col("__bad"), dict(policy.refusals)[policy.fallback_type]).otherwise(F.col("body_text")),
        "footer_line": F.when(F.col("__bad"), "").otherwise(F.col("footer_line")), "footer_date": F.when(F.col("__bad"), "").otherwise(F.col("footer_date")),
    }).drop("__bad", "violations", "passed")


def validate_and_repair(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Drafts that pass stay as they are; the others are repaired and validated again."""
    first = validate(df, policy)
    good = first.where("passed").withColumn("repair_actions", F.array().cast("array<string>"))
    return good.unionByName(validate(repair(first.where("NOT passed"), policy), policy))


def display_text(policy: Policy = Policy()) -> Column:
    """Body, link, footer of a factual answer, disclaimer: the parts that aren't blank, between empty lines."""
    footer = F.when(F.col("answer_type") == "factual", F.col("footer_line"))
    parts = F.array_compact(F.array("body_text", "citation_markdown", footer, F.col("disclaimer_line")))
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n\n")
