"""Inbound requests and outbound envelopes: checks that give a code and an HTTP status instead of raising."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X

#: Limits of a request.
MAX_BYTES, MAX_QUERY, MAX_SESSION = 16_384, 2_000, 128
#: Field names that a request must not have.
FORBIDDEN = ["pan", "aadhaar", "otp", "email", "phone", "account_number"]
#: Status of each error code; others are 500.
STATUS = {"unsupported_media_type": 415, "empty_body": 400, "null_byte": 400, "payload_too_large": 413, "invalid_utf8": 400, "invalid_json": 400, "missing_query": 400, "invalid_query": 400, "empty_query": 400, "query_too_long": 400, "invalid_session": 400, "forbidden_field": 400, "upstream_timeout": 503, "upstream_error": 502}
#: Fields of an answer envelope.
ENVELOPE = ["answer_type", "body_text", "citation_url", "citation_markdown", "disclaimer_line", "footer_line", "footer_date", "outcome_type", "refusal_type", "request_id", "session_id"]


def status_of(code: Column) -> Column:
    out = F.lit(500)
    for name, status in STATUS.items():
        out = F.when(code == name, status).otherwise(out)
    return F.when(code.isNull(), 200).otherwise(out)


def validate(df: DataFrame, content_type: str, body: str) -> DataFrame:
    """Add code (null if all is well), status, query and session_id: the first check that fails gives the code."""
    raw = F.col(body).cast("binary")
    text = F.col(body).cast("string")
    kind = F.lower(F.trim(F.split(X.text_of(F.col(content_type)), ";", 2)[0]))
    keys = F.json_object_keys(text)
    # a field that is no string keeps its JSON quotes off and is told by a second look at the raw value
    parsed = F.from_json(text, "query string, session_id string")
    query, session = parsed["query"], parsed["session_id"]
    is_text = text.rlike(r'"query"\s*:\s*"')
    code = (
        F.when(kind != "application/json", "unsupported_media_type")
        .when(raw.isNull() | (F.octet_length(raw) == 0), F.when(raw.isNull(), "invalid_json").otherwise("empty_body"))
        .when(F.contains(text, F.lit("\0")), "null_byte")
        .when(F.octet_length(raw) > MAX_BYTES, "payload_too_large")
        .when(~F.is_valid_utf8(text), "invalid_utf8")
        .when(keys.isNull(), "invalid_json")
        .when(F.arrays_overlap(F.transform(keys, lambda k: F.lower(k)), F.array(*[F.lit(f) for f in FORBIDDEN])), "forbidden_field")
        .when(~F.array_contains(keys, "query"), "missing_query")
        .when(~is_text, "invalid_query")
        .when(F.trim(query) == "", "empty_query")
        .when(F.length(query) > MAX_QUERY, "query_too_long")
        .when(F.length(session) > MAX_SESSION, "invalid_session")
    )
    return df.withColumn("code", code).withColumns({"status": status_of(F.col("code")), "query": F.when(F.col("code").isNull(), F.trim(query)), "session_id": F.when(F.col("code").isNull(), session)})


def envelope_faults(columns: Sequence[str], expected: Sequence[str] = tuple(ENVELOPE)) -> dict[str, list[str]]:
    """Missing and extra fields of an envelope."""
    return {"missing": [c for c in expected if c not in columns], "extra": [c for c in columns if c not in expected]}


def load_contract(handoff: Mapping[str, Any], phase: str = "5.6") -> dict[str, Any]:
    """What a handoff document promises: fields of envelope and assistant, outcome types, path, request fields, and the codes of what it lacks (driver side, one document)."""
    api = handoff.get("api_surface") or {}
    envelope, chat = api.get("answer_envelope") or {}, api.get("chat_endpoint_suggestion") or {}
    out: dict[str, Any] = {
        "envelope_fields": sorted(map(str, envelope.get("fields") or [])), "assistant_fields": sorted(map(str, (api.get("assistant_response") or {}).get("fields") or [])),
        "outcome_types": sorted(map(str, envelope.get("outcome_types") or [])), "chat_path": str(chat.get("path") or "/chat"), "request_fields": sorted(chat.get("request_body") or {}),
    }
    lacks = [f"missing_{k}" for k in ("envelope_fields", "assistant_fields", "outcome_types") if not out[k]]
    out["issues"] = ["missing_handoff"] if not handoff else [*(["handoff_phase"] if str(handoff.get("phase")) != phase else []), *lacks]
    return out


def contract_faults(envelope: Column, contract: Mapping[str, Any]) -> Column:
    """Of a JSON envelope: missing and extra fields, those of its assistant that are missing, and an outcome type that the contract lacks."""
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    want = lambda k: F.array(*[F.lit(f) for f in contract[k]]).cast("array<string>")
    own, assistant = keys(envelope), keys(F.get_json_object(envelope, "$.assistant"))
    tell = lambda label, names: F.transform(F.array_sort(names), lambda n: F.concat(F.lit(f"{label}:"), n))
    kind = X.text_of(F.get_json_object(envelope, "$.outcome_type"))
    return F.concat(
        tell("missing", F.array_except(want("envelope_fields"), own)), tell("extra", F.array_except(own, want("envelope_fields"))),
        tell("assistant_missing", F.array_except(want("assistant_fields"), assistant)), X.hits([("unknown_outcome_type", ~F.coalesce(F.array_contains(want("outcome_types"), kind), F.lit(False)))]),
    )


def ui_response(envelope: Column) -> Column:
    """(answer, citation_url, footer_date, outcome_type, label) of a JSON envelope, as a page shows it."""
    at = lambda path: F.trim(X.text_of(F.get_json_object(envelope, f"$.{path}")))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    kind, url = at("outcome_type"), at("assistant.citation_url")
    told = F.trim(F.regexp_extract(at("assistant.footer_line"), r"(?i)Last updated from sources:\s*(.+)$", 1))
    is_url = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]")
    slug = F.element_at(F.split(F.regexp_extract(url, "^[^:]+://[^/?#]*([^?#]*)", 1), "/"), -1)
    return F.struct(
        first(at("assistant.body_text"), at("display_text"), at("assistant.display_text")).alias("answer"), url.alias("citation_url"),
        F.coalesce(F.nullif(first(at("assistant.footer_date"), told), F.lit("")), F.lit("date unavailable")).alias("footer_date"),
        F.when(kind.isin("refusal", "abstention"), kind).otherwise("factual").alias("outcome_type"),
        F.when(is_url & (slug != ""), F.replace(slug, F.lit("-"), F.lit(" "))).otherwise("Official Source").alias("label"),
    )


def outcome_faults(outcome: Column, answer: Column, body: Column, citation: Column) -> Column:
    """What is wrong between an outcome and its answer."""
    return X.hits([
        ("unknown_outcome", ~F.coalesce(outcome.isin("factual", "refusal", "abstention"), F.lit(False))),
        ("answer_type_mismatch", F.coalesce(outcome != answer, F.lit(True))),
        ("empty_body", F.trim(X.text_of(body)) == ""),
        ("missing_citation", F.trim(X.text_of(citation)) == ""),
    ])


def ui_branch(outcome: Column) -> Column:
    return F.when(outcome == "factual", "answer").when(outcome == "refusal", "refusal").when(outcome == "abstention", "abstention").otherwise("error")
