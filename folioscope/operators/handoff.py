"""Between corpus preparation and indexing: facet candidates, gates with reasons, dates, and format compliance of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls as U

# Patterns of facts in a page, by facet; the first that fits counts. (pattern id, pattern, group of the value or 0, characters before, after)
CANDIDATES: dict[str, list[tuple[str, str, int, int, int]]] = {
    "expense_ratio": [("expense_ratio_v1", r"(?i)expense\s*ratio\s*([0-9]+(?:\.[0-9]+)?\s*%?)", 1, 40, 40)],
    "exit_load": [("exit_load_v1", r"(?i)exit\s*load[^\n#]{0,160}", 0, 0, 0)],
    "min_sip": [
        ("min_sip_v1", r"(?i)min\.?\s*for\s*sip\s*(?:₹|Rs\.?|INR\s*)?\s*([0-9][0-9,]*)", 1, 30, 30),
        ("min_sip_v1", r"(?i)minimum\s+sip\s+(?:investment\s+)?(?:is\s+)?(?:set\s+to\s+)?\s*(?:₹|Rs\.?)?\s*([0-9][0-9,]*)", 1, 30, 30),
    ],
    "lock_in": [
        ("lock_in_v1", r"(?i)(?:lock[-\s]?in(?:\s*[:\-]|\s+period)?|3\s*y(?:ear)?\s*lock[-\s]?in)[^\n#.]{0,120}", 0, 0, 0),
        ("lock_in_v1", r"(?i)no\s*lock[-\s]?in[^\n]{0,80}", 0, 0, 0),
        ("lock_in_v1", r"(?i)\belss\b[^\n]{0,100}(?:lock|3\s*y(?:ear)?|three\s*y(?:ear)?)", 0, 0, 0),
    ],
    "riskometer": [
        ("riskometer_v1", r"(?i)riskometer[^\n#]{0,100}", 0, 0, 0),
        ("risk_label_v1", r"(?i)rated\s+(very\s+high|high|moderate|low)\s+risk", 1, 0, 0),
    ],
    "benchmark": [
        ("benchmark_v1", r"(?i)fund\s*benchmark\s*([^\n#|]{3,120}?)(?=\n|##|###|Scheme|\||$)", 1, 20, 40),
        ("benchmark_v1", r"(?i)\bbenchmark\b\s*[:\s]*([^\n#|]{3,120}?)(?=\n|##|###|\||$)", 1, 20, 40),
    ],
    "statement_tax": [
        ("tax_implication_v1", r"(?i)tax\s+implication[^\n#]{0,200}", 0, 0, 0),
        ("capital_gains_v1", r"(?i)(?:long[-\s]?term|short[-\s]?term)\s+capital\s+gains[^\n#]{0,120}", 0, 0, 0),
        ("stamp_duty_v1", r"(?i)stamp\s+duty[^\n#]{0,120}", 0, 0, 0),
    ],
}


def candidate(text: Column, facet: str) -> Column:
    """(pattern, snippet, value) of the facet's first pattern that fits, or null; snippets have at most 220 characters, values 80."""
    t = X.text_of(text)
    out = F.lit(None).cast("struct<pattern:string,snippet:string,value:string>")
    for name, pattern, group, before, after in reversed(CANDIDATES[facet]):
        hit = F.regexp_extract(t, pattern, 0)
        at = F.regexp_instr(t, F.lit(pattern))
        start = F.greatest(at - before, F.lit(1))
        snippet = F.substr(t, start, at - start + F.length(hit) + after) if before else hit
        value = F.regexp_extract(t, pattern, group) if group else F.lit(None).cast("string")
        value = F.concat(F.lit("₹"), value) if facet == "min_sip" else F.concat(value, F.lit(" risk")) if name == "risk_label_v1" else value
        row = F.struct(F.lit(name).alias("pattern"), X.clip(X.squeeze(snippet), 220).alias("snippet"), X.clip(F.trim(value), 80).alias("value"))
        out = F.when(hit != "", row).otherwise(out)
    return out


def facet_candidates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, facet, pattern, snippet, value): a row for each facet that a text states."""
    rows = F.array(*[F.struct(F.lit(f).alias("facet"), candidate(F.col(text_col), f).alias("c")) for f in CANDIDATES])
    return df.select(F.col(id_col), F.explode(rows).alias("x")).where("x.c IS NOT NULL").select(id_col, "x.facet", "x.c.*")


def parse_success(extract_status: Column, normalize_status: Column, n_bytes: Column, metadata_error: Column) -> Column:
    """Usable extract, a body, and no failed step after it."""
    good = extract_status.isin("ok", "partial") & (F.coalesce(n_bytes, F.lit(0)) > 0)
    bad = F.coalesce(normalize_status.isin("empty", "failed"), F.lit(False)) | F.coalesce(metadata_error == "missing_clean_markdown", F.lit(False))
    return F.coalesce(good, F.lit(False)) & ~bad


def quarantine_reasons(extract_status: Column, normalize_status: Column, n_bytes: Column, metadata_error: Column) -> Column:
    """Why a document is kept back; empty if it isn't."""
    found = F.array_compact(F.array(
        F.when(n_bytes.isNull(), "missing_clean_markdown"),
        F.when(extract_status.isin("parse_error", "empty_shell"), F.concat(F.lit("extract_status="), extract_status)),
        F.when(normalize_status.isin("empty", "failed"), F.concat(F.lit("normalize_status="), normalize_status)),
        F.when(metadata_error == "missing_clean_markdown", "doc_metadata_missing_clean"),
    ))
    ok = parse_success(extract_status, normalize_status, n_bytes, metadata_error)
    return F.when(~ok & (F.size(found) == 0), F.array(F.lit("parse_success_criteria_not_met"))).otherwise(found)


def blockers(site: str) -> Column:
    """What keeps a scheme from being indexed, of rows (registry_url, source_url, markdown, sections, has_document, has_metadata, quarantined,
    extract_status, normalize_status); indexable if there is nothing.
    """
    c, status = F.col, F.col("extract_status")
    has = lambda name: F.coalesce(c(name), F.lit(False))
    url, registered = U.canonical(F.coalesce("source_url", "registry_url"), site), U.canonical(c("registry_url"), site)
    return F.array_compact(F.array(
        F.when(~has("has_document"), "missing_clean_document"),
        F.when(c("markdown").isNull(), "missing_clean_markdown").when(c("markdown") == "", "empty_clean_markdown"),
        F.when(~has("has_metadata"), "missing_doc_metadata"),
        F.when(has("quarantined"), "quarantined"),
        F.when(has("has_document") & c("sections").isNull(), "clean_document_missing_sections"),
        F.when(X.text_of(status) == "", "extract_status_missing").when(status.isin("parse_error", "empty_shell"), F.concat(F.lit("extract_status="), status))
        .when(~status.isin("ok", "partial"), F.concat(F.lit("extract_status_not_indexable="), status)),
        F.when(c("normalize_status").isin("empty", "failed"), F.concat(F.lit("normalize_status="), c("normalize_status"))),
        F.when(url.isNull(), "source_url_invalid").when(~url.eqNullSafe(registered), "source_url_registry_mismatch"),
    ))


def effective_date(published: Column, fetched: Column, upstream: Column) -> Column:
    """The first of the dates that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(d), F.lit("")) for d in (published, fetched, upstream)])


def enrich(df: DataFrame, doc_type: str, rank: int, fallback: Column) -> DataFrame:
    """Fill defaults of chunks and tell where the effective date comes from."""
    own = F.nullif(F.trim(F.col("effective_date")), F.lit(""))
    return df.withColumns({
        "doc_type": F.coalesce(F.nullif(F.col("doc_type"), F.lit("")), F.lit(doc_type)), "section_title": X.text_of(F.col("section_title")),
        "compliance_rank": F.coalesce("compliance_rank", F.lit(rank)), "effective_date": F.coalesce(own, fallback),
        "effective_date_source": F.when(own.isNotNull(), "chunk").when(fallback.isNotNull(), "fetched_at").otherwise("unknown"),
    })


def format_compliance(site: str, footer: str = "Last updated from sources:", most: int = 3) -> Column:
    """Parts of the check of answers(outcome_type, body_text, citation_url, footer_line, footer_date, passed), and all of them together."""
    body, cite = F.trim(X.text_of(F.col("body_text"))), F.trim(X.text_of(F.col("citation_url")))
    parts = {
        "is_factual": X.text_of(F.col("outcome_type")) == "factual", "has_body": body != "", "sentences_ok": (body != "") & (X.sentence_count(body, "stops") <= most),
        "citation_present": cite != "", "citation_allowlisted": U.canonical(cite, site).isNotNull(),
        "footer_ok": F.contains(X.text_of(F.col("footer_line")), F.lit(footer)) | (F.trim(X.text_of(F.col("footer_date"))) != ""), "validation_passed": F.coalesce("passed", F.lit(False)),
    }
    together = F.lit(True)
    for test in parts.values():
        together = together & test
    return F.struct(*[t.alias(n) for n, t in parts.items()], together.alias("compliant"))
