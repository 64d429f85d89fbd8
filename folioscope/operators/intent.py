"""What a question asks for: signals from the rules, then the first decision that fits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.rules import HIGH, LOW, MEDIUM, Rules

#: The action of an intent where a rule names none.
DEFAULT_ACTION = {"factual": "retrieve", "performance-info": "performance_limited", "comparison": "refuse", "advisory": "refuse", "mixed": "refuse", "out-of-scope": "refuse"}
#: Refusal types by intent.
REFUSAL_TYPES = {"advisory": "advisory", "comparison": "comparison", "mixed": "mixed_intent", "performance-info": "performance_info"}


def signals(q: Column, rules: Rules) -> dict[str, Column]:
    """Arrays of hits in a question in query form, in the order of the rules."""

    def both(pair: tuple[list[str], list[str]]) -> Column:
        return F.concat(X.keyword_hits(q, pair[0]), X.pattern_hits(q, pair[1]))

    out = {name: both(getattr(rules, name)) for name in ("injection", "comparison", "advice", "projection", "performance", "vague")}
    out["personal"] = X.pattern_hits(q, rules.personal)
    for name in ("rivals", "off_topic", "greeting"):
        out[name] = X.keyword_hits(q, getattr(rules, name))
    out["facets"] = X.hits([(code, F.size(X.keyword_hits(q, ks)) > 0) for code, ks in sorted(rules.facets.items())])
    return out


def classify(df: DataFrame, query_col: str, rules: Rules = Rules()) -> DataFrame:
    """Add intent, action, confidence, policy_code, facet, reasons and query_normalized. One projection, no shuffle."""
    base = df.withColumn("query_normalized", X.query_form(F.col(query_col)))
    q = F.col("query_normalized")
    base = base.withColumn("__s", F.struct(*[c.alias(n) for n, c in signals(q, rules).items()]))

    def has(name: str) -> Column:
        return F.size(F.col(f"__s.{name}")) > 0

    def some(label: str, *names: str) -> Column:
        found = F.concat(*[F.col(f"__s.{n}") for n in names])
        return F.array(F.concat(F.lit(f"{label}:"), F.array_join(F.slice(found, 1, 3), ",")))

    house = F.contains(q, F.lit(rules.house))
    facets, factual = F.col("__s.facets"), has("facets")
    leaning = has("advice") | has("projection")
    history = has("performance") & ~has("projection")
    one = F.size(facets) == 1

    def outcome(intent: str, action: str, confidence: float | Column, policy: str | Column, reasons: Column, facet: Column | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            F.lit(intent).alias("intent"), F.lit(action).alias("action"), lit(confidence).cast("double").alias("confidence"), lit(policy).alias("policy_code"),
            (F.lit("") if facet is None else facet).alias("facet"), reasons.alias("reasons"),
        )

    fixed = lambda *r: F.array(*[F.lit(x) for x in r])
    lean = F.when(has("projection") & ~has("advice"), some("projection", "projection", "advice")).otherwise(some("advisory", "projection", "advice"))
    mixed = F.concat(fixed("mixed_refusal_first"), F.array(F.concat(F.lit("facets="), F.array_join(facets, ","))), F.array(
        F.concat(F.lit("signals="), F.array_join(F.slice(F.concat("__s.advice", "__s.comparison", "__s.projection"), 1, 3), ","))))
    table: list[tuple[Column, Column]] = [
        (q == "", outcome("out-of-scope", "disambiguate", LOW, "O1", fixed("empty_query"))),
        (has("injection"), outcome("out-of-scope", "refuse", HIGH, "R5", some("prompt_injection", "injection"))),
        (has("personal"), outcome("out-of-scope", "refuse", HIGH, "R3", fixed("pii_detected"))),
        (X.devanagari_ratio(q) >= 0.25, outcome("out-of-scope", "refuse", MEDIUM, "P4-10", fixed("devanagari_ratio>=0.25"))),
        (has("rivals") & ~house, outcome("out-of-scope", "refuse", HIGH, "R3", some("other_house", "rivals"))),
        (has("comparison") & ~factual, outcome("comparison", "refuse", HIGH, "R2", some("comparison", "comparison"))),
        (has("projection") & ~factual, outcome("performance-info", "refuse", HIGH, "R1", lean)),
        (has("advice") & ~factual, outcome("mixed", "refuse", HIGH, "R4", lean)),
        (factual & (leaning | has("comparison")), outcome("mixed", "refuse", HIGH, "R4", mixed, F.when(one, F.get(facets, 0)).otherwise(""))),
        (has("vague") & house, outcome("out-of-scope", "disambiguate", MEDIUM, "O1", some("ambiguous", "vague"))),
        (history & ~factual, outcome("performance-info", "performance_limited", MEDIUM, "P1", some("performance", "performance"))),
        (factual, outcome("factual", "retrieve", F.when(one, HIGH).otherwise(MEDIUM), F.get(facets, 0), F.array(F.concat(F.lit("facet:"), F.array_join(facets, ","))), F.get(facets, 0))),
        (has("off_topic") & ~house, outcome("out-of-scope", "refuse", MEDIUM, "O1", fixed("off_topic"))),
        (has("greeting") & (F.size(F.split(q, " ", -1)) <= 6) & ~house, outcome("out-of-scope", "disambiguate", LOW, "O1", fixed("greeting"))),
        (house | X.any_of(q, ["mutual fund", rules.site.split(".")[0]]), outcome("factual", "retrieve", LOW, "A0", fixed("house_context_no_facet"))),
    ]
    decision = outcome("out-of-scope", "disambiguate", LOW, "O1", fixed("unclassified_steering"))
    for test, then in reversed(table):
        decision = F.when(test, then).otherwise(decision)
    return base.withColumn("__d", decision).select(*[F.col(f"`{c}`") for c in df.columns], "query_normalized", "__d.*")


def classify_with(df: DataFrame, query_col: str, model: Callable[[str], str | None] | None, rules: Rules = Rules(), below: float = MEDIUM) -> DataFrame:
    """classify, and where that is less sure than below, the intent that a model names for the question, with its default action; without a model, where it
    fails, or where it names no known intent, the rules' answer stands. The model runs once for each such question, in an Arrow function.
    """
    ruled = classify(df, query_col, rules)
    if model is None:
        return ruled

    @F.pandas_udf("string")
    def named(q: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                found = model(text) if text else None
            except Exception:
                return None
            return found if found in DEFAULT_ACTION else None

        return q.map(one).astype(object)

    unsure = F.when(F.col("confidence") < below, F.col("query_normalized"))
    told = ruled.withColumn("__named", named(unsure))
    use = F.col("__named").isNotNull()
    return told.withColumns({
        "action": F.when(use, default_action(F.col("__named"))).otherwise(F.col("action")), "intent": F.coalesce("__named", "intent"),
        "reasons": F.when(use, F.concat("reasons", F.array(F.lit("model")))).otherwise(F.col("reasons")),
    }).drop("__named")


def refusal_type(intent: Column, action: Column) -> Column:
    """Which refusal an intent calls for; disambiguate goes by the action."""
    out = F.lit("out_of_scope")
    for name, kind in REFUSAL_TYPES.items():
        out = F.when(intent == name, kind).otherwise(out)
    return F.when(action == "disambiguate", "disambiguate").otherwise(out)


def clamp(c: Column) -> Column:
    return F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 4)


def default_action(intent: Column) -> Column:
    out = F.lit("refuse")
    for name, action in DEFAULT_ACTION.items():
        out = F.when(intent == name, action).otherwise(out)
    return out
