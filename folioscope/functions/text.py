"""Text columns: normalisation, tokens, hashes, sentence counts, numbers, redaction. All JVM-side but nfkc()."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[ \t\n\x0B\f\r]+"

# Words that carry no meaning in a keyword query, and in re-ranking.
KEYWORD_STOP = ["a", "an", "the", "is", "are", "was", "were", "what", "which", "who", "how", "of", "for", "to", "in", "on", "at", "and", "or", "me", "my", "this", "that", "it"]
RERANK_STOP = ["what", "is", "the", "of", "for", "a", "an", "in", "on", "and", "or", "fund", "direct", "growth", "mutual", "tell", "me", "about"]
FACET_PHRASES = ["exit load", "lock-in", "lock in", "riskometer", "expense ratio", "minimum sip", "min sip", "benchmark", "statement", "tax", "nav", "aum"]

# Markers of a challenge or login page, in raw HTML and in extracted text.
RAW_CHALLENGE = ["captcha", "unusual traffic", "are you a robot", "cf-browser-verification", "enable javascript"]
TEXT_CHALLENGE = ["captcha", "unusual traffic", "are you a robot", "access denied", "cf-browser-verification"]

# Personal data, in the order in which it is redacted.
PII = [
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("EMAIL", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+91[\s-]?)?[6-9]\d{9}\b"),
    ("AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
]

# Lines that change from day to day.
_MONTH = r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
VOLATILE = [
    r"\bNAV\b",
    r"\bAUM\b",
    r"\bas\s+on\b",
    r"\bas\s+at\b",
    rf"\b\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}\b",
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{1,2},?\s+\d{4}\b",
]
NUMBER = r"(?i)(?:₹\s*)?\d[\d,]*(?:\.\d+)?%?|\b\d[\d,]*(?:\.\d+)?\s*(?:%|percent)\b"
MARKDOWN_LINK = r"\[[^\]]+\]\(([^)]+)\)"


def text_of(c: Column) -> Column:
    """Null as empty."""
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), WS, " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for; one of few Arrow functions here."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def any_of(c: Column, needles: Sequence[str]) -> Column:
    """Does the text contain one of the literals?"""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def hits(labels_and_tests: Sequence[tuple[str, Column]]) -> Column:
    """Labels of the tests that hold, in order."""
    if not labels_and_tests:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in labels_and_tests]))


def challenge_flag(html: Column, extra: Sequence[str] = (), limit: int | None = 500_000) -> Column:
    """Does a page have a mark of a challenge or login in its first limit characters (None: anywhere)?"""
    page = text_of(html) if limit is None else F.substring(text_of(html), 1, limit)
    return any_of(F.lower(page), [*RAW_CHALLENGE, *extra])


def challenge_in_text(text: Column) -> Column:
    return any_of(F.lower(text_of(text)), TEXT_CHALLENGE)


def collapse_blank_lines(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text_of(c), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))


def strip_volatile(c: Column) -> Column:
    pattern = "(?i)" + "|".join(VOLATILE)
    return F.array_join(F.filter(F.split(text_of(c), "\n", -1), lambda line: ~line.rlike(pattern)), "\n")


def stable_hash(c: Column) -> Column:
    """SHA-256 of what stays when volatile lines and differences of white space are gone."""
    return F.sha2(squeeze(strip_volatile(c)).cast("binary"), 256)


def keyword_form(c: Column, normalized: bool = False) -> Column:
    """For the keyword channel: currency and percent signs as words, no commas, lower case. normalized: NFKC was applied."""
    t = text_of(c) if normalized else nfkc(text_of(c))
    t = F.regexp_replace(t, r"(?i)₹|\brupees?\b", " INR ")
    t = F.regexp_replace(t, r"INR\s*([\d,]+(?:\.\d+)?)", "INR $1")
    t = F.replace(t, F.lit(","), F.lit(""))
    t = F.regexp_replace(t, r"(\d+(?:\.\d+)?)\s*%", "$1 percent")
    return F.lower(squeeze(t))


def token_form(c: Column, normalized: bool = False) -> Column:
    """A text with the tokens of its keyword_form: white space stays, and each rule runs only on texts that have what it looks for."""
    t = text_of(c)
    if not normalized:
        t = F.coalesce(nfkc(F.when(F.octet_length(t) != F.char_length(t), t)), t)

    def step(x: Column, needed: Column, pattern: str, by: str) -> Column:
        return F.get(F.transform(F.array(x), lambda y: F.when(needed(y), F.regexp_replace(y, pattern, by)).otherwise(y)), F.lit(0))

    t = step(t, lambda y: F.contains(y, F.lit("₹")) | F.contains(F.lower(y), F.lit("rupee")), r"(?i)₹|\brupees?\b", " INR ")
    t = step(t, lambda y: F.contains(y, F.lit("INR")), r"INR\s*([\d,]+(?:\.\d+)?)", "INR $1")
    t = F.replace(t, F.lit(","), F.lit(""))
    return F.lower(step(t, lambda y: F.contains(y, F.lit("%")), r"(\d+(?:\.\d+)?)\s*%", "$1 percent"))


def tokens(c: Column, normalized: bool = False) -> Column:
    return F.regexp_extract_all(keyword_form(c, normalized), F.lit("[a-z0-9]+"), F.lit(0))


def expand_phrases(c: Column, phrases: Sequence[str] = tuple(FACET_PHRASES)) -> Column:
    """Append each phrase that the text contains, joined by underscores."""
    low = F.lower(text_of(c))
    found = [F.when(F.contains(low, F.lit(p)), F.lit(re.sub("[ -]", "_", p))) for p in phrases]
    return F.concat_ws(" ", text_of(c), *found)


def only_stop_words(toks: Column) -> Column:
    return F.forall(toks, lambda t: t.isin(*KEYWORD_STOP))


def dedupe_form(c: Column) -> Column:
    return F.lower(squeeze(c))


def text_hash(c: Column) -> Column:
    return F.sha2(dedupe_form(c).cast("binary"), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def estimated_tokens(c: Column, chars_per_token: float = 4.0) -> Column:
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be positive")
    return F.greatest(F.lit(1), F.floor(F.length(text_of(c)) / F.lit(chars_per_token))).cast("int")


def query_form(c: Column) -> Column:
    """Trimmed, lower case, straight quotes, single spaces."""
    return squeeze(F.translate(F.lower(text_of(c)), "’‘“”", "''\"\""))


def devanagari_ratio(c: Column) -> Column:
    letters = F.length(F.regexp_replace(text_of(c), r"\P{L}", ""))
    deva = F.length(F.regexp_replace(text_of(c), "[^ऀ-ॿ]", ""))
    return F.when(letters == 0, 0.0).otherwise(deva / letters)


def keyword_hits(c: Column, keywords: Sequence[str]) -> Column:
    """Keywords in a lower-case text: as substrings if of several words, else as words."""
    return hits([(k, has_keyword(c, k)) for k in keywords])


def has_keyword(c: Column, keyword: str) -> Column:
    k = keyword.lower()
    return F.contains(c, F.lit(k)) if " " in k else c.rlike(r"(?i)\b" + re.escape(k) + r"\b")


def pattern_hits(c: Column, patterns: Sequence[str]) -> Column:
    return hits([(p, c.rlike("(?i)" + p)) for p in patterns])


def rerank_tokens(c: Column, stop: Sequence[str] = tuple(RERANK_STOP)) -> Column:
    words = F.split(F.regexp_replace(F.lower(text_of(c)), r"(?U)[^\w\s%]", " "), r"(?U)\s+", -1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)))


def lexical_overlap(query: Column, chunk: Column) -> Column:
    q, c = rerank_tokens(query), rerank_tokens(chunk)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def freshness(c: Column) -> Column:
    """Seconds since 1970 of an ISO date or time (no zone: UTC), 0 where it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(c)) / 1e6, F.lit(0.0))


def display_date(c: Column, missing: str = "date unavailable") -> Column:
    t = F.trim(text_of(c))
    at = F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("d MMM yyyy")), F.try_to_timestamp(t, F.lit("dd-MM-yyyy")))
    return F.coalesce(F.date_format(at, "dd MMM yyyy"), F.lit(missing))


def sanitize(c: Column, literals: Sequence[str], patterns: Sequence[str]) -> tuple[Column, Column]:
    """(text without the injection phrases, labels of those found); each is looked for in what the ones before left."""
    text, found = F.trim(text_of(c)), []
    for label, pattern in [*[(p, "(?i)" + re.escape(p)) for p in literals], *[(p, "(?i)" + p) for p in patterns]]:
        found.append(F.when(text.rlike(pattern), F.lit(label)))
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(text), F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


# -- sentences ------------------------------------------------------------------------------------------------------


def sentences(c: Column) -> Column:
    """Parts after . ! or ? and white space, trimmed, none empty."""
    marked = F.regexp_replace(F.trim(text_of(c)), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001", -1), lambda s: F.trim(s)), lambda s: s != "")


def sentence_count(c: Column, mode: str = "plain") -> Column:
    """plain: sentences; clauses: parts between semicolons count too; stops: what stands between runs of . ! ? (so decimals count twice)."""
    if mode == "plain":
        return F.size(sentences(c))
    if mode == "clauses":
        parts = F.transform(sentences(c), lambda s: F.greatest(F.lit(1), F.size(F.filter(F.split(s, ";", -1), lambda p: F.trim(p) != ""))))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return F.size(F.filter(F.split(text_of(c), "[.!?]+", -1), lambda p: F.trim(p) != ""))


def first_sentences(c: Column, n: int) -> Column:
    """At most n sentences; a text of one sentence with semicolons keeps n of its clauses."""
    parts = sentences(c)
    clauses = F.filter(F.transform(F.split(F.trim(text_of(c)), ";", -1), lambda s: F.trim(s)), lambda s: s != "")
    by_clause = F.contains(text_of(c), F.lit(";")) & (F.size(parts) == 1)
    return F.when(by_clause, F.array_join(F.slice(clauses, 1, n), "; ")).otherwise(F.array_join(F.slice(parts, 1, n), " "))


# -- links, phrases, numbers ----------------------------------------------------------------------------------------


def bare_url(site: str) -> str:
    return rf"(?i)https?://[^\s)\]]+|(?<![/@]){re.escape(site)}/[^\s)\]]+"


def link_targets(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(MARKDOWN_LINK), F.lit(1)), lambda u: F.trim(u))


def bare_urls(c: Column, site: str) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(bare_url(site)), F.lit(0)), lambda u: F.trim(u))


def markdown_link_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(MARKDOWN_LINK))


def link_count(c: Column, site: str) -> Column:
    return markdown_link_count(c) + F.regexp_count(text_of(c), F.lit(bare_url(site)))


def strip_links(c: Column, site: str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text_of(c), MARKDOWN_LINK, ""), bare_url(site), "")
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def strip_quotes(c: Column) -> Column:
    """Without what stands between quotes: an echo of the question isn't the answer's own wording."""
    return squeeze(F.regexp_replace(F.regexp_replace(text_of(c), r'"[^"]*"', " "), "'[^']*'", " "))


def phrase_hits(c: Column, groups: Sequence[tuple[str, Sequence[str]]], patterns: Sequence[str] = ()) -> Column:
    """label:phrase of each phrase outside quotes, then regex:pattern."""
    low = F.lower(strip_quotes(c))
    tests = [(f"{label}:{p.strip()}", has_keyword(low, p.strip())) for label, ps in groups for p in ps]
    return hits([*tests, *[(f"regex:{p}", low.rlike("(?i)" + p)) for p in patterns]])


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(NUMBER), F.lit(0)), lambda n: F.trim(n))


def number_form(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text_of(c)), F.lit("percent"), F.lit("%")), r"[\s,₹]", "")


def uncited_numbers(body: Column, evidence: Column, exact: bool = False) -> Column:
    """Numbers of body that evidence lacks: as substrings, or as whole numbers if exact."""
    form = number_form(evidence)
    if exact:
        known = F.transform(numbers(evidence), number_form)
        return F.filter(numbers(body), lambda n: ~F.array_contains(known, number_form(n)))
    return F.filter(numbers(body), lambda n: ~F.contains(form, number_form(n)))


def strip_numbers(body: Column, unwanted: Column) -> Column:
    bare = F.aggregate(unwanted, text_of(body), lambda b, n: F.trim(F.replace(b, n, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"\s+([,.!?])", "$1"))


# -- personal data --------------------------------------------------------------------------------------------------


def redact(c: Column, kinds: Sequence[str] | None = None) -> Column:
    for label, pattern in PII:
        if kinds is None or label in kinds:
            c = F.regexp_replace(c, pattern, f"[{label}_REDACTED]")
    return c


def pii_counts(c: Column) -> dict[str, Column]:
    """Hits of each kind, in what the kinds before left."""
    out = {}
    for label, pattern in PII:
        out[label.lower()] = F.regexp_count(text_of(c), F.lit(pattern))
        c = F.regexp_replace(c, pattern, f"[{label}_REDACTED]")
    return out


def has_pii(c: Column) -> Column:
    out = F.lit(False)
    for _, pattern in PII:
        out = out | text_of(c).rlike(pattern)
    return out


def clip(c: Column, n: int) -> Column:
    """At most n characters, the last three dots where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)
