"""The corpus between crawling and retrieval: metadata joins, records of documents, lookups, manifests, and checks of handoff documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.operators import handoff, sections
from folioscope.operators.hybrid import merge_channels

# Versions that a record names where its sidecar names none, and the number of schemes of a full corpus.
PARSER_VERSION, NORMALIZER_VERSION, METADATA_VERSION, DOCUMENT_VERSION = "1.0.0", "1.0.0", "1.0.0", "1.0.0"
EXPECTED_SCHEMES = 16
#: What a refusal hints at, by its type.
HINTS = {
    "advisory": "I provide facts-only answers from official sources and cannot give investment advice.",
    "comparison": "I cannot compare funds or recommend which is better.",
    "mixed_intent": "Your question includes advice-seeking wording; I can only answer factual questions from our corpus.",
    "out_of_scope": "That question is outside the schemes covered by this assistant.",
    "disambiguate": "Please ask a factual question about one of the covered schemes.",
    "performance_info": "I can point to factual performance data on the official page but cannot project returns.",
}
HINT_FALLBACK = "I can only answer factual questions from allowlisted official sources."


# -- joins ----------------------------------------------------------------------------------------------------------


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order of a column, columns as they are: the minimum is taken before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    found = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__r"))
    return found.select(*[F.col(key) if c == key else F.col(f"__r.{c}") for c in df.columns])


def with_manifest(registry: DataFrame, manifest: DataFrame, key: str = "scheme", order: str = "seq") -> DataFrame:
    """Every scheme of the registry with its first manifest entry, or nulls."""
    return registry.join(first_by(manifest, key, order), key, "left")


def doc_metadata(docs: DataFrame, crawl: DataFrame, extract: DataFrame, normalize: DataFrame, key: str = "scheme") -> DataFrame:
    """One metadata record for each of docs(key, source_url, markdown): hash of the Markdown, statuses and versions of the sidecars (null or the
    default where one is missing), and candidates of all facets. A document without Markdown has the error missing_clean_markdown.

    Sidecars: crawl(key, fetched_at), extract(key, parser_version, extract_status), normalize(key, normalizer_version, normalize_status).
    """
    met = docs.join(crawl.select(key, "fetched_at"), key, "left").join(extract.select(key, "parser_version", "extract_status"), key, "left")
    met = met.join(normalize.select(key, "normalizer_version", "normalize_status"), key, "left")
    text = F.col("markdown")
    return met.select(
        key, "source_url", F.sha2(text.cast("binary"), 256).alias("content_sha256"), F.coalesce(F.nullif("parser_version", F.lit("")), F.lit(PARSER_VERSION)).alias("parser_version"), "fetched_at",
        "extract_status", F.coalesce(F.nullif("normalizer_version", F.lit("")), F.lit(NORMALIZER_VERSION)).alias("normalizer_version"), "normalize_status",
        F.when(text.isNull(), "missing_clean_markdown").alias("error"),
        F.struct(*[F.when(text.isNotNull(), handoff.candidate(text, f)).alias(f) for f in handoff.CANDIDATES]).alias("candidates"),
    )


def clean_documents(docs: DataFrame, metadata: DataFrame, crawl: DataFrame, key: str = "scheme") -> DataFrame:
    """Records of docs(key, source_url, markdown) with length, hash, sections and statuses; without Markdown only the error."""
    found = sections.heading_sections(docs.where("markdown IS NOT NULL"), key, "markdown")
    parts = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "level", "title", "start_char", "end_char"))).alias("sections"))
    met = docs.join(metadata.drop("source_url"), key, "left").join(crawl.select(key, "fetch_status"), key, "left").join(parts, docs[key] == parts["id"], "left")
    has = F.col("markdown").isNotNull()
    return met.select(
        docs[key], "source_url", F.when(~has, "missing_clean_markdown").alias("error"), F.when(has, F.length("markdown")).alias("body_char_length"),
        F.when(has, F.col("content_sha256")).alias("body_sha256"), F.when(has, F.coalesce("sections", F.array().cast("array<struct<ordinal:int,level:int,title:string,start_char:int,end_char:int>>"))).alias("sections"),
        F.when(has, F.coalesce(F.size("sections"), F.lit(0))).alias("section_count"), F.when(has, F.col("extract_status")).alias("extract_status"),
        F.when(has, F.col("normalize_status")).alias("normalize_status"), F.when(has, F.col("fetch_status")).alias("fetch_status"),
    )


def url_defaults(chunks: DataFrame, registry: DataFrame, key: str = "scheme") -> DataFrame:
    """Chunks whose blank source_url is the registry's."""
    known = registry.select(F.col(key), F.col("url").alias("__url"))
    own = F.nullif(F.trim(X.text_of(F.col("source_url"))), F.lit(""))
    return chunks.join(known, key, "left").withColumn("source_url", F.coalesce(own, "__url")).drop("__url")


def vector_records(hits: DataFrame, records: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with their records; a hit without a record is left out."""
    return hits.join(records, key)


def labels(urls: DataFrame, registry: DataFrame, url_col: str, site: str | None = None) -> DataFrame:
    """Add label: the display name of the registered page, else the slug's words in title case."""
    known = registry.select(U.canonical(F.col("url"), site).alias("__c"), F.col("scheme_display_name").alias("__n")).dropDuplicates(["__c"])
    met = urls.join(known, U.canonical(F.col(url_col), site) == F.col("__c"), "left")
    words = F.initcap(F.replace(U.slug(F.col(url_col)), F.lit("-"), F.lit(" ")))
    return met.withColumn("label", F.coalesce(F.nullif(F.trim("__n"), F.lit("")), words)).drop("__c", "__n")


def early_hybrid(keyword: DataFrame, vector: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, channel, rank): the higher raw score of the channels, before any normalisation. queries(query_id, tokens): one that has stop words
    only takes no part in the keyword channel.
    """
    idle = queries.where(X.only_stop_words(F.col("tokens"))).select("query_id")
    merged = merge_channels(keyword.join(idle, "query_id", "left_anti"), vector)
    channel = F.when(F.size("channels") == 2, "hybrid").otherwise(F.get("channels", F.lit(0)))
    best = merged.select("query_id", "id", F.greatest("keyword", "vector").alias("score"), channel.alias("channel"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# -- handoff --------------------------------------------------------------------------------------------------------


def handoff_rows(registry: DataFrame, documents: DataFrame, metadata: DataFrame, manifest: DataFrame, key: str = "scheme") -> DataFrame:
    """The registry with what each scheme has, for handoff_blockers.

    documents(key, readable, doc_url, markdown, body_missing, sections_kind, extract_status, normalize_status): sections_kind is 'array', another JSON
    kind, or null; metadata(key, readable, meta_url, extract_status, normalize_status); manifest(key, seq, quarantined).
    """
    d = documents.select(
        key, F.lit(True).alias("has_document"), F.col("readable").alias("document_readable"), "doc_url", "markdown", "body_missing", "sections_kind",
        F.col("extract_status").alias("__de"), F.col("normalize_status").alias("__dn"),
    )
    m = metadata.select(key, F.lit(True).alias("has_metadata"), F.col("readable").alias("metadata_readable"), "meta_url", F.col("extract_status").alias("__me"), F.col("normalize_status").alias("__mn"))
    met = with_manifest(registry.select(key, F.col("url").alias("registry_url")).join(d, key, "left").join(m, key, "left"), manifest, key)
    blank = lambda c: F.nullif(F.trim(X.text_of(F.col(c))), F.lit(""))
    return met.withColumns({
        "extract_status": F.coalesce(blank("__de"), blank("__me")), "normalize_status": F.coalesce(blank("__dn"), blank("__mn")),
        "source_url": F.coalesce(blank("meta_url"), blank("doc_url"), "registry_url"),
    }).drop("__de", "__dn", "__me", "__mn")


@dataclass(frozen=True)
class HandoffRules:
    """Which statuses let a document into the index. Those in neither list of extraction block too, under a code of their own."""

    indexable: tuple[str, ...] = ("ok", "partial")
    blocked: tuple[str, ...] = ("parse_error", "empty_shell")
    blocked_normal: tuple[str, ...] = ("empty", "failed")


def handoff_rules(config: Mapping[str, Any]) -> HandoffRules:
    """Rules from the section handoff of a configuration; what is absent or empty there is as usual."""
    section, usual = config.get("handoff") or {}, HandoffRules()
    names = {"indexable": "indexable_extract_statuses", "blocked": "blocked_extract_statuses", "blocked_normal": "blocked_normalize_statuses"}
    return HandoffRules(**{k: tuple(str(x) for x in section.get(n) or getattr(usual, k)) for k, n in names.items()})


def handoff_blockers(df: DataFrame, allowed: DataFrame, site: str | None = None, rules: HandoffRules = HandoffRules()) -> DataFrame:
    """Add blockers, array<string> of up to 17 codes, and indexable (none) to handoff_rows. allowed(url): canonical URLs."""
    c, status = F.col, F.col("extract_status")
    has = lambda name: F.coalesce(c(name), F.lit(False))
    known = allowed.select(F.col("url").alias("__a")).distinct().withColumn("__listed", F.lit(True))
    url, registered = U.canonical(c("source_url"), site), U.canonical(c("registry_url"), site)
    met = df.join(known, url == F.col("__a"), "left")
    readable = has("has_document") & has("document_readable")
    codes = F.array_compact(F.array(
        F.when(~has("has_document"), "missing_clean_document"),
        F.when(c("markdown").isNull(), "missing_clean_markdown").when(c("markdown") == "", "empty_clean_markdown"),
        F.when(~has("has_metadata"), "missing_doc_metadata"),
        F.when(has("quarantined"), "quarantined"),
        F.when(readable & has("body_missing"), "clean_document_body_markdown_missing"),
        F.when(readable & c("sections_kind").isNull(), "clean_document_missing_sections").when(readable & (c("sections_kind") != "array"), "clean_document_sections_invalid"),
        F.when(~readable, "clean_document_unreadable"),
        F.when(has("has_metadata") & ~has("metadata_readable"), "doc_metadata_unreadable"),
        F.when(status.isNull(), "extract_status_missing").when(status.isin(*rules.blocked), F.concat(F.lit("extract_status="), status))
        .when(~status.isin(*rules.indexable), F.concat(F.lit("extract_status_not_indexable="), status)),
        F.when(c("normalize_status").isin(*rules.blocked_normal), F.concat(F.lit("normalize_status="), c("normalize_status"))),
        F.when(url.isNull(), "source_url_invalid").when(~has("__listed"), "source_url_not_allowlisted").when(~url.eqNullSafe(registered), "source_url_registry_mismatch"),
    ))
    return met.withColumn("blockers", codes).withColumn("indexable", F.size("blockers") == 0).drop("__a", "__listed")


def partial_flag(schemes: DataFrame, expected: int = EXPECTED_SCHEMES) -> DataFrame:
    """(indexable, partial) of schemes(indexable)."""
    return schemes.agg(F.count_if(F.coalesce("indexable", F.lit(False))).alias("indexable")).withColumn("partial", F.col("indexable") < expected)


def index_manifest(chunks: DataFrame, schemes: DataFrame, version: str, model: str, benchmark: DataFrame, expected: int = EXPECTED_SCHEMES) -> DataFrame:
    """One row: counts of chunks and indexable schemes, the benchmark(recall, passed), and whether retrieval may start."""
    counts = chunks.agg(F.count("*").alias("total_chunks"))
    row = counts.crossJoin(F.broadcast(partial_flag(schemes, expected))).crossJoin(F.broadcast(benchmark.select(F.col("recall").alias("recall_at_k"), F.col("passed").alias("benchmark_passed"))))
    ready = F.coalesce(F.col("benchmark_passed"), F.lit(False)) & ~F.col("partial")
    return row.select(
        F.lit(version).alias("index_version"), F.lit(model).alias("embedding_model_id"), F.lit(expected).alias("schemes_expected"), F.col("indexable").alias("schemes_indexable"),
        F.col("partial").alias("partial_corpus"), "total_chunks", "recall_at_k", "benchmark_passed", ready.alias("ready"),
    )


def hybrid_contract(version: str, model: str, chunk_count: int, **more: Any) -> dict[str, Any]:
    """What both channels agree on: merge keys and fallback rules."""
    return {
        "index_version": version, "embedding_model_id": model, "chunk_count": chunk_count, "shared_merge_keys": ["chunk_id", "source_url", "scheme"],
        "optional_merge_keys": ["section_title", "effective_date", "compliance_rank"], "algorithm": "bm25",
        "hybrid_policy": {
            "merge_strategy": "union_by_chunk_id", "score_normalization": "per_channel_minmax", "keyword_empty_fallback": "vector", "stopword_only_query_use_vector": True,
            "scheme_aliases": "query_side_only",
        }, **more,
    }


def handoff_document(manifest: Mapping[str, Any], contract: Mapping[str, Any]) -> dict[str, Any]:
    """What retrieval is told about an index: a summary of index_manifest's row, the merge keys, and pins."""
    return {
        "index_version": manifest["index_version"],
        "index_manifest_summary": {k: manifest[k] for k in ("partial_corpus", "schemes_indexable", "total_chunks", "benchmark_passed")},
        "hybrid_api_surface": {"merge_keys": contract["shared_merge_keys"], "keyword_empty_fallback": contract["hybrid_policy"]["keyword_empty_fallback"]},
        "version_pins": {"index_version": manifest["index_version"], "embedding_model_id": manifest["embedding_model_id"]},
        "benchmark_summary": {"recall_at_k": manifest["recall_at_k"], "passed": manifest["benchmark_passed"]},
    }


def _at(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, f"$.{path}")


def _blank(doc: Column, path: str) -> Column:
    return F.coalesce(F.trim(_at(doc, path)), F.lit("")).isin("", "null", "[]", "{}", "0", "false")


def _no_list(doc: Column, path: str) -> Column:
    return F.coalesce(F.json_array_length(_at(doc, path)), F.lit(0)) == 0


def retrieval_handoff_issues(doc: Column, phase: str = "4.6") -> Column:
    """Issue codes of a JSON document that retrieval hands to answering; empty if it can be used."""
    return X.hits([
        ("handoff_phase", ~F.coalesce(_at(doc, "phase") == phase, F.lit(False))), ("missing_index_version", _blank(doc, "version_pins.index_version")),
        ("missing_embedding_model_id", _blank(doc, "version_pins.embedding_model_id")), ("missing_evidence_fields:found", _no_list(doc, "evidence_fields_for_phase5.found")),
        ("missing_evidence_fields:not_found_in_sources", _no_list(doc, "evidence_fields_for_phase5.not_found_in_sources")), ("missing_refusal_fields", _no_list(doc, "refusal_contract.fields")),
        ("missing_refusal_types", _blank(doc, "refusal_contract.refusal_types")), ("missing_performance_flag", _blank(doc, "performance_limited_flag.field")),
        ("missing_api_surface", ~F.coalesce(F.array_contains(F.json_object_keys(_at(doc, "api_surface")), "retrieve"), F.lit(False))),
    ])


#: Fields that an answer's envelope must list.
ENVELOPE_FIELDS = ["outcome_type", "query", "validation_passed", "assistant", "display_text"]


def answer_handoff_issues(doc: Column, phase: str = "5.6") -> Column:
    """Issue codes of a JSON document that answering hands to the service; a failed evaluation is a warning among them."""
    fields = F.from_json(_at(doc, "api_surface.answer_envelope.fields"), "array<string>")
    none = _no_list(doc, "api_surface.answer_envelope.fields")
    lacking = F.size(F.array_except(F.array(*[F.lit(f) for f in ENVELOPE_FIELDS]), fields)) > 0
    body = F.json_object_keys(_at(doc, "api_surface.chat_endpoint_suggestion.request_body"))
    return X.hits([
        ("handoff_phase", ~F.coalesce(_at(doc, "phase") == phase, F.lit(False))), ("missing_api_answer", _blank(doc, "api_surface.answer")), ("missing_envelope_fields", none),
        ("incomplete_envelope_fields", ~none & F.coalesce(lacking, F.lit(True))), ("missing_outcome_types", _blank(doc, "api_surface.answer_envelope.outcome_types")),
        ("chat_path", ~F.coalesce(_at(doc, "api_surface.chat_endpoint_suggestion.path") == "/chat", F.lit(False))),
        ("missing_chat_query_field", ~F.coalesce(F.array_contains(body, "query"), F.lit(False))),
        *[(f"missing_{k}_module", _blank(doc, f"middleware_hooks.{k}.module")) for k in ("pre_generation", "post_generation")],
        ("warning_eval_not_passed", ~F.coalesce(_at(doc, "evaluation_summary.passed") == "true", F.lit(False))),
    ])


# -- lookups and records --------------------------------------------------------------------------------------------


def by_scheme(registry: DataFrame, scheme: str, required: bool = False) -> DataFrame:
    """The registry's row of a scheme, a pushed filter. required: no such row is an error."""
    found = registry.where(F.col("scheme") == scheme)
    if required and found.isEmpty():
        raise KeyError(f"unknown scheme {scheme}")
    return found


def listed_sources(urls: DataFrame, registry: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose URL, trimmed and without slashes at the end, is in the registry."""
    bare = lambda c: F.regexp_replace(F.trim(c), "/+$", "")
    return urls.join(registry.select(bare(F.col("url")).alias("__u")).distinct(), bare(urls[url_col]) == F.col("__u"), "left_semi")


def require_allowed(url: Column, allowed: Sequence[str], site: str | None = None) -> Column:
    """The canonical URL; the job fails on one that isn't allowed."""
    canon = U.canonical(url, site)
    fine = F.assert_true(F.coalesce(canon.isin(*allowed), F.lit(False)), F.concat(F.lit("not allowlisted: "), X.text_of(url)))
    return F.when(fine.isNull(), canon)


def processed_records(pages: DataFrame, key: str, url: str, text: str, limit: int | None = 500_000) -> DataFrame:
    """(key, url, content_hash, text_length, body_text): the body cut to limit characters (None: whole); hash and length are those of the whole text."""
    t = X.text_of(F.col(text))
    return pages.select(key, url, X.stable_hash(t).alias("content_hash"), F.length(t).alias("text_length"), (F.substring(t, 1, limit) if limit else t).alias("body_text"))


def strict_pages(pages: DataFrame, status: str = "http_status", url: str = "url") -> DataFrame:
    """Pages that must all have been fetched well: a redirect, a 404 or any other status but 200 fails the job with its reason."""
    s, u = F.col(status), X.text_of(F.col(url))
    reason = (
        F.when(s.isin(301, 302, 303, 307, 308), F.concat(F.lit("Redirect detected for "), u)).when(s == 404, F.concat(F.lit("404 for "), u))
        .otherwise(F.concat(F.lit("HTTP "), F.coalesce(s.cast("string"), F.lit("error")), F.lit(" for "), u))
    )
    return pages.where(F.assert_true(F.coalesce(s == 200, F.lit(False)), reason).isNull())


def refusal_hint(kind: Column) -> Column:
    out = F.lit(HINT_FALLBACK)
    for name, hint in HINTS.items():
        out = F.when(kind == name, hint).otherwise(out)
    return out


def check_defaults(texts: Mapping[str, str], least: int = 1, most: int = 3) -> dict[str, int]:
    """Sentences of each of an installation's answer texts; one with fewer or more than allowed is an error. Few texts, checked where they are configured."""
    import re

    counts = {k: len([s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]) for k, t in texts.items()}
    bad = sorted(k for k, n in counts.items() if not least <= n <= most)
    if bad:
        raise ValueError(f"not {least} to {most} sentences: {', '.join(bad)}")
    return counts


def distinct_in_order(values: Column) -> Column:
    """An array's values once each, in the order of their first places, blank ones left out."""
    return F.filter(F.array_distinct(values), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
