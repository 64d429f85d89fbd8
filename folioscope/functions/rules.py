"""Rule tables as data. The word lists are fixed values; house, site and rivals are what an installation sets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

# Facets of a factual question and their keywords.
FACETS = {
    "A1": ["expense ratio", "ter", "total expense ratio", "annual charges", "management fee"],
    "A2": ["exit load", "redemption charge", "redemption fee", "exit fee"],
    "A3": ["minimum sip", "min sip", "minimum investment", "min investment", "minimum lumpsum", "min lumpsum", "minimum amount"],
    "A4": ["lock in", "lock-in", "lockin", "elss", "3 year lock", "three year lock"],
    "A5": ["riskometer", "risk level", "risk rating", "risk profile"],
    "A6": ["benchmark", "benchmark index", "fund benchmark"],
    "A7": ["capital gains", "tax statement", "tax document", "cas statement", "consolidated account statement", "download statement", "statement download", "tax implication"],
}
PERFORMANCE = ["past return", "past performance", "historical return", "cagr", "annual return", "returns in", "1 year return", "3 year return", "5 year return", "nav chart", "performance chart", "since inception"]
PROJECTION = ["give good returns", "will it perform", "expected returns", "future performance", "will grow", "will outperform", "outperform", "what will be the nav", "how much will i earn", "how much will i make", "projected returns", "expected nav", "expected return", "projected return"]
PROJECTION_PATTERNS = [r"\bhow much (?:will|would|can) i (?:earn|make|get)\b", r"\b(?:will|would) i (?:get|make|earn)\s+\d", r"\bwill\b.+\boutperform\b", r"\boutperform\b", r"\bwhat will be the nav\b", r"\bexpected nav\b", r"\bprojected returns\b", r"\bgive good returns\b", r"\bexpected returns\b"]
ADVICE = ["should i buy", "should i invest", "is it good for me", "is it good", "is this good", "good investment", "good for me", "good for long term", "good for short term", "worth buying", "worth investing", "is it worth investing", "suitable for me", "good fund", "bad fund", "advice", "your opinion", "which fund should i", "is it safe to invest", "should i do sip", "is it a good time", "is it safe", "safe to invest"]
ADVICE_PATTERNS = [r"\bshould i invest\b", r"\bshould i buy\b", r"\bshould i do sip\b", r"\bis it good for me\b", r"\bis it (?:a )?good (?:fund|investment|time)\b", r"\bis it a good time\b", r"\bis it worth investing\b", r"\bis\s+.+(?:a )?good\s+investment\b", r"\bgood investment\b", r"\bgood for long term\b", r"\bgood for short term\b", r"\b(?:can|should) i invest\b", r"\bwhich fund should i\b", r"\bis it safe to invest\b", r"\bis it safe\b", r"\bis\s+.+(?:fund )?safe\b", r"\bsafe to invest\b"]
COMPARISON = ["which is better", "which fund is better", "which is best", "which is the best fund", "better for me", "compare", "comparison", "versus", " vs ", " vs.", "better than", "best returns", "best fund", "which fund has", "rank funds", "ranking", "best mutual fund in india"]
COMPARISON_PATTERNS = [r"\bcompare\b.+\band\b", r"\b(?:which|what) is better\b", r"\bwhich\s+(?:\w+\s+)*fund is better\b", r"\bwhich\s+(?:\w+\s+)*fund is best\b", r"\bwhich is best\b", r"\bwhich is the best\b", r"\bbetter for me\b", r"\bbest returns\b", r"\bwhich fund has\b", r"\bbest mutual fund in india\b", r"\bvs\.?\b", r"\bversus\b"]
OFF_TOPIC = ["weather", "cricket", "recipe", "movie"]
GREETING = ["hello", "hi", "hey", "good morning", "good evening"]
PERSONAL = [r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"\b\d{4}\s?\d{4}\s?\d{4}\b", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\botp\b", r"\bpan\s*(?:number|no\.?)?\b", r"\baadhaar\b", r"\baccount\s*number\b"]
INJECTION = ["ignore rules", "ignore previous", "ignore instructions", "ignore all instructions", "system prompt", "reveal your system prompt", "jailbreak", "<script>"]
INJECTION_PATTERNS = [r"\bignore (?:all )?(?:rules|instructions|previous)\b", r"\breveal (?:your )?system prompt\b", r"\bpretend you are\b", "<script"]

# What an answer must not say.
ANSWER_PHRASES = [
    ("advisory", ["should i invest", "should i buy", "recommend", "recommendation", "best fund", "good investment", "you should", "i suggest", "suitable for you"]),
    ("comparison", ["which is better", "better than", "compare", "versus", " vs ", "rank funds"]),
    ("projection", ["you will earn", "you will get", "guaranteed return", "expected return", "will make you", "projected return"]),
]
ANSWER_PATTERNS = [r"\bshould i\b", r"\bwhich is better\b", r"\byou will (?:earn|get|make)\b"]
QUERY_INJECTION = ["ignore rules", "ignore all rules", "ignore instructions", "system prompt", "jailbreak"]

#: How sure a decision is.
HIGH, MEDIUM, LOW = 0.92, 0.75, 0.55


@dataclass(frozen=True)
class Rules:
    """What the question rules need. house: the brand that questions are about; site: the host of its pages; rivals: other brands."""

    house: str = "acme"
    site: str = "funds.example.com"
    rivals: tuple[str, ...] = ()
    facets: dict[str, list[str]] = field(default_factory=lambda: dict(FACETS))
    performance: tuple[list[str], list[str]] = (PERFORMANCE, [])
    projection: tuple[list[str], list[str]] = (PROJECTION, PROJECTION_PATTERNS)
    advice: tuple[list[str], list[str]] = (ADVICE, ADVICE_PATTERNS)
    comparison: tuple[list[str], list[str]] = (COMPARISON, COMPARISON_PATTERNS)
    injection: tuple[list[str], list[str]] = (INJECTION, INJECTION_PATTERNS)
    off_topic: tuple[str, ...] = tuple(OFF_TOPIC)
    greeting: tuple[str, ...] = tuple(GREETING)
    personal: tuple[str, ...] = tuple(PERSONAL)
    ambiguous: tuple[list[str], list[str]] | None = None

    @property
    def vague(self) -> tuple[list[str], list[str]]:
        h = self.house
        return self.ambiguous or (
            [f"{h} fund info", f"tell me about {h}", "fund info"],
            [f"^{h}$", f"^tell me about {h}$", f"^{h} fund info$", f"^{h} mutual fund$", f"^{h} funds?$"],
        )


def load_rules(path: str, house: str, site: str) -> Rules:
    """Read a JSON rule file with sections of keywords and patterns (driver side, small)."""
    with open(path, encoding="utf-8") as f:
        data: dict[str, Any] = json.load(f)

    def pair(name: str) -> tuple[list[str], list[str]]:
        section = data.get(name) or {}
        return list(section.get("keywords") or []), list(section.get("patterns") or [])

    scope = data.get("out_of_scope") or {}
    rivals = next((v for k, v in scope.items() if k.endswith("_amc_keywords")), [])
    return Rules(
        house=house, site=site, rivals=tuple(rivals), facets={k: list(v.get("keywords") or []) for k, v in (data.get("factual_facets") or {}).items()},
        performance=pair("performance_info"), projection=pair("performance_projection"), advice=pair("advisory"), comparison=pair("comparison"),
        injection=pair("prompt_injection"), off_topic=tuple(scope.get("off_topic_keywords") or ()), greeting=tuple(scope.get("greeting_keywords") or ()),
        personal=tuple(scope.get("pii_patterns") or ()), ambiguous=pair("ambiguous"),
    )
