"""Which registered scheme a question means: exact, alias and fuzzy rules, then resolved, ambiguous or unknown."""

from __future__ import annotations

import difflib
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.sources import scratch

#: Scores of the rules and thresholds of the decision.
SCORES = {"url": 1.0, "slug": 0.98, "alias": 0.96, "display_name": 0.94, "house_core": 0.93, "core_phrase": 0.90}
FUZZY = {"fuzzy": 0.92, "fuzzy_house": 0.91, "fuzzy_token": 0.89}
RESOLVE, FUZZY_MIN, GAP, MULTI = 0.82, 0.86, 0.06, 0.72
#: Longest needle that only the end of a question can come close to: a window has eight characters more, and of two texts of n and w characters that
#: reach FUZZY_MIN, w is at most n (2 / FUZZY_MIN - 1). Longer ones, by classes of length, are met in segments of a question, one each STRIDE characters.
TAIL_NEEDLE, WINDOW_MORE, CLASS, STRIDE = 24, 8, 16, 32
#: Distinct pieces of names up to which every worker has them all, so that questions send no others; of more, questions send every piece.
VOCABULARY = 1 << 18
#: Questions that are searched at once.
QUESTIONS = 64
#: Schemes that one function scores a question against.
BLOCK = 10_000
#: Words of a scheme's name that distinguish nothing.
COMMON_WORDS = ["fund", "direct", "growth", "plan", "the", "of", "and", "cap", "mid", "small", "large"]


@dataclass(frozen=True)
class Scheme:
    scheme: str
    url: str
    display: str
    core: str
    spaced: str
    tokens: tuple[str, ...]


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower().strip().replace("’", "'").replace("‘", "'").replace("-", " "))


def scheme_record(scheme: str, url: str, display_name: str, house: str) -> Scheme:
    """Core phrase: the slug without house and plan, or what the display name has in its place if that is longer."""
    core = _plain(re.sub(r"-direct-growth(-plan)?$", "", scheme.removeprefix(f"{house}-")))
    display = _plain(re.sub(r"(?i)\s*(?:[-–—]\s*)?(?:direct|growth|plan)\b.*$", "", display_name))
    if len(display) > len(core):
        core = display.removeprefix(f"{house} ")
    words = tuple(w for w in core.split() if w not in COMMON_WORDS and w != house)
    return Scheme(scheme, url, display, core, _plain(scheme), words)


def _plain_column(c: Column) -> Column:
    return X.squeeze(F.regexp_replace(F.translate(F.lower(F.trim(X.text_of(c))), "’‘", "''"), "-", " "))


def registry_index(registry: DataFrame, house: str) -> DataFrame:
    """(scheme, url, display, core, spaced, tokens) of registry(scheme, url, scheme_display_name): scheme_record for a whole table, without a driver-side list."""
    slug = F.regexp_replace(F.regexp_replace("scheme", f"^{re.escape(house)}-", ""), "-direct-growth(-plan)?$", "")
    display = _plain_column(F.regexp_replace("scheme_display_name", r"(?i)\s*(?:[-–—]\s*)?(?:direct|growth|plan)\b.*$", ""))
    named = registry.select("scheme", "url", display.alias("display"), _plain_column(slug).alias("slug"), _plain_column(F.col("scheme")).alias("spaced"))
    core = F.when(F.length("display") > F.length("slug"), F.regexp_replace("display", f"^{re.escape(house)} ", "")).otherwise(F.col("slug"))
    words = F.filter(F.split("core", " "), lambda w: ~w.isin(*COMMON_WORDS, house, ""))
    return named.withColumn("core", core).select("scheme", "url", "display", "core", "spaced", words.alias("tokens"))


def exact_matches(queries: DataFrame, query_id: str, query_col: str, index: DataFrame, aliases: DataFrame, house: str, url_prefix: str = "funds.example.com/") -> DataFrame:
    """(query_id, scheme, url, score, method, rank): schemes that a question names by the rules without fuzzy ratios, the best rule of each, best first, ties by scheme.

    aliases(phrase, scheme). A question that contains a name contains the name's anchor, so questions and registry meet by anchors (see resolve_registry), and the
    rules are evaluated on these pairs alone.
    """
    asked = _questions(queries, query_id, query_col)
    schemes = _numbered(index, aliases)
    pairs = _pairs_met(asked, schemes, house, url_prefix, close=False).join(asked, "query_id").join(schemes, "no")
    pairs = pairs.withColumns({"q": X.query_form(F.col("raw")), "slugs": U.slug_mentions(F.col("raw"), url_prefix)})
    c, q = F.col, F.col("q")
    within = lambda phrase: F.contains(q, phrase)
    by_display = (F.length("display") >= 8) & within(c("display"))
    full = F.concat(F.lit(f"{house} "), c("core"))
    rules = [
        ("url", F.array_contains("slugs", c("scheme"))), ("slug", F.contains(F.replace(q, F.lit(" "), F.lit("-")), c("scheme")) | within(c("spaced"))),
        ("alias", F.exists("phrases", within)), ("display_name", by_display),
        ("house_core", (F.length(full) >= 10) & within(full)), ("core_phrase", ~by_display & (F.length("core") >= 4) & within(c("core"))),
    ]
    method = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])  # in falling order of their scores
    met = pairs.where(method.isNotNull())
    score = F.lit(0.0)
    for name, _ in rules:
        score = F.when(F.col("method") == name, SCORES[name]).otherwise(score)
    found = met.select("query_id", "scheme", "url", method.alias("method")).withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "scheme")
    return found.withColumn("rank", F.row_number().over(order))


def phrase_ratio(haystack: str, needle: str) -> float:
    """1 if contained, else the best Ratcliff-Obershelp ratio with a window of eight more characters."""
    if not needle or not haystack:
        return 0.0
    if needle in haystack:
        return 1.0
    n = len(needle)
    matcher = difflib.SequenceMatcher(None)
    best = 0.0
    for i in range(max(1, len(haystack) - n + 1)):
        matcher.set_seqs(needle, haystack[i : i + n + 8])
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
    return best


def _reach(n: int) -> int:
    """Characters, at most, of a window that reaches FUZZY_MIN with n characters."""
    return int(n * (2 / FUZZY_MIN - 1) + 1e-9)


def close_ratio(haystack: str, needle: str) -> float:
    """phrase_ratio where that reaches FUZZY_MIN, else 0: only windows with enough of the needle's characters, in any order, are matched."""
    if not needle or not haystack:
        return 0.0
    if needle in haystack:
        return 1.0
    n = len(needle)
    if n + WINDOW_MORE > _reach(n):  # of a short needle, whole windows are too long
        haystack = haystack[-_reach(n) :]
    size = len(haystack)
    letters = np.frombuffer(haystack.encode("utf-32-le"), np.uint32)
    start = np.arange(max(1, size - n + 1))
    stop = np.minimum(start + n + WINDOW_MORE, size)
    common = np.zeros(len(start), np.int64)
    for letter, times in Counter(needle).items():
        before = np.concatenate([[0], np.cumsum(letters == ord(letter))])
        common += np.minimum(before[stop] - before[start], times)
    able = np.flatnonzero(2 * common >= FUZZY_MIN * (n + stop - start) - 1e-9)
    matcher = difflib.SequenceMatcher(None)
    best = 0.0
    for i in able.tolist():
        matcher.set_seqs(needle, haystack[i : i + n + WINDOW_MORE])
        best = max(best, matcher.ratio())
    return best if best >= FUZZY_MIN else 0.0


def word_ratio(haystack: str, token: str) -> float:
    return max((difflib.SequenceMatcher(None, token, w).ratio() for w in haystack.split() if len(w) >= 4), default=0.0)


@functools.lru_cache(maxsize=16)
def _question_form(query: str) -> str:
    text = query.lower()
    for quote, plain in zip("’‘“”", "''\"\"", strict=True):
        text = text.replace(quote, plain)
    return " ".join(text.split())


def _mentions(text: str, house: str, needles: list[str]) -> bool:
    """Does one of several alternatives in a question (a or b, a vs b) have the house and one of the needles?"""
    parts = re.split(r"\s+(?:or|vs\.?|versus)\s+", text)
    return len(parts) > 1 and any(house in part and any(n in part for n in needles) for part in parts)


def match_scores(query: str, s: Scheme, aliases: dict[str, str], house: str, url_prefix: str, near: bool = True) -> list[tuple[float, str]]:
    """(score, method) of every rule that fits, in the order in which the first of equal scores wins. near: can a name that is not contained come close?"""
    norm = _question_form(query)
    out: list[tuple[float, str]] = []

    def rule(method: str, fits: bool, factor: float = 1.0) -> None:
        if fits:
            out.append(((SCORES[method] if method in SCORES else FUZZY[method]) * factor, method))

    rule("url", s.scheme in re.findall(re.escape(url_prefix) + r"([a-z0-9-]+)", query.lower()))
    rule("alias", any(slug == s.scheme and phrase in norm for phrase, slug in aliases.items()))
    rule("slug", s.scheme in norm.replace(" ", "-") or s.spaced in norm)
    by_display = len(s.display) >= 8 and s.display in norm
    rule("display_name", by_display)
    rule("core_phrase", not by_display and len(s.core) >= 4 and s.core in norm)
    rule("house_core", len(f"{house} {s.core}") >= 10 and f"{house} {s.core}" in norm)
    for method, phrase in (("fuzzy", s.core), ("fuzzy_house", f"{house} {s.core}")):
        r = close_ratio(norm, phrase) if near else float(phrase != "" and phrase in norm)
        rule(method, r >= FUZZY_MIN, r)
    for token in s.tokens if near else ():
        if len(token) >= 8:
            r = word_ratio(norm, token)
            rule("fuzzy_token", r >= FUZZY_MIN, r)
    return out


def resolve(
    queries: DataFrame, query_id: str, query_col: str, registry: list[Scheme], aliases: dict[str, str] | None = None, house: str = "acme",
    url_prefix: str = "funds.example.com/", default_url: str = "",
) -> DataFrame:
    """(query_id, scheme, source_url, confidence, status, matched, method) for each question.

    The registry is a short list of an installation (driver-side data); questions are scored in an Arrow function, as
    Ratcliff-Obershelp has no built-in, and the decision is made of windows over (query_id).
    """
    aliases = aliases or {}

    def scored(block: list[Scheme]):
        @F.pandas_udf("array<struct<scheme:string,url:string,score:double,method:string>>")
        def run(q: pd.Series) -> pd.Series:
            return q.map(lambda text: best(text, block))

        return run

    def best(text: str | None, block: list[Scheme]) -> list[dict[str, object]]:
        rows = []
        for s in block:
            if text and (found := match_scores(text, s, aliases, house, url_prefix)):
                score, method = max(found, key=lambda f: f[0])
                rows.append({"scheme": s.scheme, "url": s.url, "score": score, "method": method})
        return rows

    @F.pandas_udf("array<string>")
    def compared(q: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            parts = re.split(r"\s+(?:or|vs\.?|versus)\s+", text or "")
            found = set()
            for part in parts if len(parts) > 1 else []:
                if house in part:
                    found |= {slug for phrase, slug in aliases.items() if phrase in part}
                    found |= {s.scheme for s in registry if s.core in part or s.spaced in part}
            return sorted(found)

        return q.map(one)

    # a long registry goes to the workers in blocks, each one function
    blocks = [registry[i : i + BLOCK] for i in range(0, max(1, len(registry)), BLOCK)]
    matches = F.concat(*[scored(block)("raw") for block in blocks])
    base = queries.select(F.col(query_id).alias("query_id"), X.query_form(F.col(query_col)).alias("q"), F.col(query_col).alias("raw"))
    return _decided(base.select("query_id", F.array_sort(matches, _by_score).alias("m"), compared("q").alias("cmp")), default_url)


def _decided(base: DataFrame, default_url: str) -> DataFrame:
    """The decision on (query_id, m, cmp): m the matches, best first; cmp the schemes that alternatives name."""
    top, second = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    strong = F.filter("m", lambda r: r["score"] >= MULTI)
    gap = top["score"] - F.coalesce(second["score"], F.lit(0.0))
    named = F.size("cmp") >= 2
    resolved = ~named & (F.size(strong) < 2) & (top["score"] >= RESOLVE) & (gap >= GAP)
    ambiguous = named | (F.size(strong) >= 1) & ~resolved
    resolved, ambiguous = F.coalesce(resolved, F.lit(False)), F.coalesce(ambiguous, F.lit(False))
    confidence = F.when(resolved | ambiguous, F.coalesce(top["score"], F.lit(0.7))).otherwise(0.0)
    return base.select(
        "query_id", F.when(resolved, top["scheme"]).otherwise("").alias("scheme"), F.when(resolved, top["url"]).otherwise(default_url).alias("source_url"),
        F.bround(confidence, 4).alias("confidence"), F.when(resolved, "resolved").when(ambiguous, "ambiguous").otherwise("unknown").alias("status"),
        F.when(named, F.col("cmp")).when(ambiguous, F.transform(F.slice(strong, 1, 4), lambda r: r["scheme"])).otherwise(F.array().cast("array<string>")).alias("matched"),
        F.when(named, "comparison_mentions").when(F.size(strong) >= 2, "multi_scheme").otherwise(F.coalesce(top["method"], F.lit("none"))).alias("method"),
    )


def _by_score(a, b):
    return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["scheme"] < b["scheme"], -1).when(a["scheme"] > b["scheme"], 1).otherwise(0)


# -- a registry as a table -------------------------------------------------------------------------------------------

#: Characters of an anchor: a rare piece of a name, which a question that contains the name contains too.
ANCHOR = 4


def needed_grams(n: int) -> int:
    """Pairs of neighbouring characters, of n - 1 in a needle, that a text has at least whose Ratcliff-Obershelp ratio with it reaches FUZZY_MIN.

    With r = FUZZY_MIN, M matched characters are a common subsequence of n and w characters with 2 M >= r (n + w). Each of the n - M others spoils
    two pairs, each of the w - M characters between them one: 2 n + w - 3 M, at most (2 - 1.5 r) n + (1 - 1.5 r) w. That is most where w
    is least, and M can't be above w, so w >= n r / (2 - r).
    """
    r = FUZZY_MIN
    least = n * r / (2 - r)
    return n - 1 - int((2 - 1.5 * r) * n + (1 - 1.5 * r) * least + 1e-9)


def needed_in_window(n: int) -> int:
    """needed_grams where the text is a whole window, of WINDOW_MORE characters more than the needle."""
    w = n + WINDOW_MORE
    matched = math.ceil(FUZZY_MIN * (n + w) / 2 - 1e-9)
    return n - 1 - (2 * n + w - 3 * matched)


def _pairs(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(len(text) - 1)]


#: Stands for a digit in the form of a long name: names of a series, which differ in their numbers, have one form.
DIGIT = "\0"


def _form(needle: str) -> str:
    """The needle with its digits masked, if the pairs without digits are enough to meet it by."""
    form = re.sub("[0-9]", DIGIT, needle)
    lost = sum(DIGIT in g for g in _pairs(form))
    return form if 2 * lost <= needed_grams(len(needle)) else needle


#: (query, kind, place, part, gram): what a question offers. A part is the segment of a question that the place is, for kinds that are matched by segments.
Piece = tuple[str, int, str | None, str]


@dataclass(frozen=True)
class Kind:
    """What questions are searched for: the pieces that names have (None: too many to be sent), the fewest that a name needs, and a table of their hashes.

    For segments the table has a bit for each piece, or where there are more than 64, one for all.
    """

    name: str
    number: int
    least: int
    names: frozenset[str] | None
    table: np.ndarray | None


def _kind(kind: str, least: int, names: set[str] | None) -> Kind:
    name = kind.rstrip("0123456789")
    number = int(kind[len(name) :] or 0)
    table = None
    if names and name in ("anchor", "long", "end"):
        table = np.zeros(1 << max(12, (16 * len(names)).bit_length()), bool if name == "anchor" or len(names) > 64 else np.uint64)
        for bit, g in enumerate(names):
            table[_hashes(_letters(g), len(g)) & (len(table) - 1)] |= True if table.dtype == bool else np.uint64(1 << bit)
    return Kind(name, number, least, None if names is None else frozenset(names), table)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _hashes(letters: np.ndarray, k: int) -> np.ndarray:
    """A number for each piece of k letters; the low bits of equal pieces are equal."""
    h = letters[: max(0, len(letters) - k + 1)]
    for j in range(1, k):
        h = h * 0x9E3779B1 + letters[j : j + len(h)]
    return h ^ h >> 15


def _question_pieces(queries: list[str], kinds: list[Kind], url_prefix: str) -> tuple[list[int], list[Piece]]:
    """(question's number, piece) of pieces that names have, blanks as hyphens: short ones for anchors; pairs of a question's end, of its segments by class of needles, and of its words; its slugs.

    A place with fewer pieces than any name of the kind needs has none. Tables of hashes say where to look, in all questions at once.
    """
    norms = [_question_form(q) for q in queries]
    flats = [n.replace(" ", "-") for n in norms]
    text = "".join(f + "\n" for f in flats)  # no question has a line end, nor has a name
    sizes = np.array([len(f) for f in flats], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    letters = _letters(text)
    hashes = {k: _hashes(letters, k) for k in range(1, ANCHOR + 1)}
    of: list[int] = []
    out: list[Piece] = []

    def offer(i: int, kind: Kind, place: int, part: str | None, grams: set[str]) -> None:
        found = grams if kind.names is None else grams & kind.names
        if len(found) >= kind.least:
            name = f"{kind.name}{kind.number or ''}"
            of.extend([i] * len(found))
            out.extend([(name, place, part, g) for g in found])

    def places(kind: Kind, k: int) -> np.ndarray:
        """Is there a piece of the kind at each place? Some are false."""
        return np.ones(len(hashes[k]), bool) if kind.table is None else kind.table[hashes[k] & (len(kind.table) - 1)]

    count = np.maximum(1, -(-sizes // STRIDE))  # segments of each question
    owner = np.repeat(np.arange(len(flats)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start, end = offsets[owner] + place * STRIDE, (offsets + sizes)[owner]
    for kind in kinds:
        if kind.name == "anchor":
            k = kind.number
            at = np.flatnonzero(places(kind, k))
            found = {(i, text[j : j + k]) for i, j in zip((np.searchsorted(offsets, at, "right") - 1).tolist(), at.tolist(), strict=True)}
            for i, gram in found:
                if "\n" not in gram:
                    offer(i, kind, 0, None, {gram})
        elif kind.name in ("long", "end"):  # segments that hold all of their windows, and those at the end of the question
            size = CLASS * (kind.number + 1) - 1 + WINDOW_MORE + STRIDE - 1
            stop = np.minimum(start + size, end)
            seen = places(kind, 2)
            seen = np.append(seen, seen.dtype.type(0))
            if kind.table is not None and kind.table.dtype == np.uint64:
                had = np.bitwise_count(np.bitwise_or.reduceat(seen, np.stack([start, np.maximum(stop - 1, start)], axis=1).ravel())[::2])
            else:
                before = np.concatenate([[0], np.cumsum(seen)])
                had = before[np.maximum(stop - 1, start)] - before[start]
            able = had >= kind.least
            for x in np.flatnonzero(able & ((start + size <= end) == (kind.name == "long"))).tolist():
                part = text[start[x] : stop[x]]
                offer(int(owner[x]), kind, int(place[x]), part, set(_pairs(part)))
    ends = [(kind, _reach(kind.number)) for kind in kinds if kind.name == "tail"]
    urls, words = ([kind for kind in kinds if kind.name == name] for name in ("url", "word"))
    for i, (query, norm, flat) in enumerate(zip(queries, norms, flats, strict=True)):
        last = _pairs(flat[-_reach(TAIL_NEEDLE) - 1 :])
        for kind, reach in ends:
            offer(i, kind, 0, None, set(last[-reach:]))
        for kind in urls if url_prefix in (low := query.lower()) else ():
            offer(i, kind, 0, None, set(re.findall(re.escape(url_prefix) + r"([a-z0-9-]+)", low)))
        for kind in words:
            for at, word in enumerate(norm.split()):
                if len(word) >= 4:
                    offer(i, kind, at, None, set(_pairs(word)))
    return of, out


def _needles(s: Scheme, phrases: list[str], house: str, close: bool) -> set[tuple[str, str]]:
    """(kind, form): what a question contains if an exact rule fits (an empty core: the house, which a comparison must name), and what it comes close to if a fuzzy one does."""
    exact = [s.scheme, s.spaced, s.core or house, *([s.display] if len(s.display) >= 8 else []), *phrases]
    out = {("url", s.scheme)} | {(f"anchor{min(ANCHOR, len(t))}", t.replace(" ", "-")) for t in exact if t}
    if close:
        out |= {("word", t) for t in s.tokens if len(t) >= 8}
        for t in (s.core, f"{house} {s.core}") if s.core else ():
            n = len(t)
            flat = t.replace(" ", "-")
            out |= {(f"tail{n}", flat)} if n <= TAIL_NEEDLE else {(f"{k}{n // CLASS}", _form(flat)) for k in ("long", "end")}
    return out


def _grams(kind: str, form: str) -> list[tuple[str, int, int, int]]:
    """(gram, times, need, least) of a form: need of its pieces, counted as often as it has them, at least so many distinct ones, are in what comes close to it."""
    if kind == "url":
        return [(form, 1, 1, 1)]
    if kind.startswith("anchor"):
        k = int(kind[6:])
        return [(g, 1, 1, 1) for g in {form[i : i + k] for i in range(len(form) - k + 1)}]
    pairs = _pairs(form)
    found = Counter(g for g in pairs if DIGIT not in g)
    need = (needed_in_window if kind.startswith("long") else needed_grams)(len(form)) - len(pairs) + found.total()
    need, have, least = max(1, need), 0, 0
    for times in sorted(found.values(), reverse=True):
        least, have = least + (have < need), have + times
    return [(g, times, need, least) for g, times in found.items()]


@functools.lru_cache(maxsize=4096)
def _places(fixed: str) -> dict[str, int]:
    """The bits of each character's places."""
    out: dict[str, int] = {}
    for i, c in enumerate(fixed):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _may_reach(forms: list[str], parts: list[str]) -> np.ndarray:
    """For each form and segment: can a name of the form reach FUZZY_MIN with a window that starts in the first STRIDE characters of the segment?

    What Ratcliff-Obershelp matches is a common subsequence, so the longest one of each window is a bound (found with a bit for each character, all windows of
    a batch at once). Masked digits count as matched. Forms of over 64 characters without digits are not decided here: True.
    """
    out = np.ones(len(forms), bool)
    fixed = [f.replace(DIGIT, "") for f in forms]
    lengths = np.array([len(f) if len(x) <= 64 else 0 for f, x in zip(forms, fixed, strict=True)], np.int64)
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        bits = np.zeros((len(rows), n + WINDOW_MORE + STRIDE), np.uint64)
        for at, i in enumerate(rows.tolist()):
            places, part = _places(fixed[i]), parts[i][: bits.shape[1]]
            bits[at, : len(part)] = [places.get(c, 0) for c in part]
        window = np.array([len(parts[i]) for i in rows])[:, None] - np.arange(STRIDE)
        window = np.minimum(window, n + WINDOW_MORE)
        state = np.full(window.shape, ~np.uint64(0))
        for j in range(n + WINDOW_MORE):
            hit = state & bits[:, j : j + STRIDE]
            state = (state + hit) | (state - hit)
        masked = np.array([n - len(fixed[i]) for i in rows])[:, None]
        matched = np.bitwise_count(~state) + masked  # places beyond the form stay set
        out[rows] = ((window > 0) & (2 * matched >= FUZZY_MIN * (n + window) - 1e-9)).any(axis=1)
    return out


def _questions(queries: DataFrame, query_id: str, query_col: str) -> DataFrame:
    """(query_id, raw), written and dealt evenly, as a search takes more time than reading and a file's row groups may be few."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.col(query_col).alias("raw"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return scratch.written(rows.repartition(max(4 * cores, rows.rdd.getNumPartitions())), "questions")


def _numbered(index: DataFrame, aliases: DataFrame) -> DataFrame:
    """The registry with a number for each scheme and the phrases of its aliases, written."""
    phrases = aliases.groupBy("scheme").agg(F.collect_set("phrase").alias("phrases"))
    rows = index.join(phrases, "scheme", "left").withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    return scratch.written(rows.withColumn("no", F.monotonically_increasing_id()), "schemes")


def _pairs_met(asked: DataFrame, schemes: DataFrame, house: str, url_prefix: str, close: bool = True) -> DataFrame:
    """(query_id, no, near): the schemes whose anchors or slugs a question of asked(query_id, raw) contains; close: and those that a fuzzy rule may fit (near)."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                s = Scheme(r["scheme"], r["url"], r["display"], r["core"], r["spaced"], tuple(r["tokens"]))
                rows += [(r["no"], kind, form) for kind, form in _needles(s, r["phrases"], house, close)]
            yield _batch(rows, no=pa.int64(), kind=pa.string(), form=pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(kind, form, *gram) for kind, form in zip(*(c.to_pylist() for c in batch.columns), strict=True) for gram in _grams(kind, form)]
            yield _batch(rows, kind=pa.string(), form=pa.string(), gram=pa.string(), times=pa.int64(), need=pa.int64(), least=pa.int64())

    needles = scratch.written(schemes.mapInArrow(named, "no long, kind string, form string"), "names")
    grams = scratch.written(needles.select("kind", "form").distinct().mapInArrow(cut, "kind string, form string, gram string, times long, need long, least long"), "name_grams")
    anchors = grams.where("kind LIKE 'anchor%'")
    common = anchors.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    rare = anchors.join(common, ["kind", "gram"]).groupBy("kind", "form").agg(F.min(F.struct("df", "gram")).alias("m"), *[F.max(c).alias(c) for c in ("times", "need", "least")])
    rare = rare.select("kind", "form", F.col("m.gram").alias("gram"), "times", "need", "least")
    names = scratch.written(grams.where("kind NOT LIKE 'anchor%'").unionByName(rare), "name_pieces")

    found: dict[str, set[str]] = {}
    terms = names.select("kind", "gram").distinct().limit(VOCABULARY + 1).collect()
    for r in terms if len(terms) <= VOCABULARY else ():
        found.setdefault(r.kind, set()).add(r.gram)
    least = names.groupBy("kind").agg(F.min("least").alias("least")).collect()  # one row for each length of short names and CLASS of long ones
    kinds = asked.sparkSession.sparkContext.broadcast([_kind(r.kind, r.least, found[r.kind] if found else None) for r in least])
    type_, arrow = dict(asked.dtypes)["query_id"], to_arrow_type(asked.schema["query_id"].dataType)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asking = [(i, raw) for i, raw in enumerate(batch.column(1).to_pylist()) if raw]
            for at in range(0, len(asking), QUESTIONS):
                numbers, queries = zip(*asking[at : at + QUESTIONS], strict=True)
                of, rows = _question_pieces(list(queries), kinds.value, url_prefix)
                yield pieces_of(batch, rows, [numbers[i] for i in of])

    def pieces_of(batch: pa.RecordBatch, rows: list[Piece], of: list[int]) -> pa.RecordBatch:
        ids = batch.column(0).cast(arrow).take(pa.array(of, pa.int64()))
        rest = _batch(rows, kind=pa.string(), place=pa.int64(), part=pa.string(), gram=pa.string())
        return pa.RecordBatch.from_arrays([ids, *rest.columns], names=["query_id", *rest.schema.names])

    pieces = asked.select("query_id", "raw").mapInArrow(ask, f"query_id {type_}, kind string, place long, part string, gram string")
    met = pieces.join(names, ["kind", "gram"]).groupBy("query_id", "kind", "place", "part", "form").agg(F.sum("times").alias("n"), F.max("need").alias("need"))
    met = met.where("n >= need")

    @F.pandas_udf("boolean")
    def may_reach(form: pd.Series, part: pd.Series) -> pd.Series:
        out = part.isna()
        out[~out] = _may_reach(form[~out].tolist(), part[~out].tolist())
        return out

    met = (met.where(may_reach("form", "part")) if close else met).select("query_id", "kind", "form").distinct()
    near = ~(F.col("kind").startswith("anchor") | (F.col("kind") == "url"))
    return met.join(needles, ["kind", "form"]).groupBy("query_id", "no").agg(F.max(near).alias("near"))


def _batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def resolve_registry(
    queries: DataFrame, query_id: str, query_col: str, index: DataFrame, aliases: DataFrame, house: str = "acme", url_prefix: str = "funds.example.com/", default_url: str = "",
) -> DataFrame:
    """resolve() with a registry of any size as a table: index as of registry_index, aliases(phrase, scheme). The same columns and rows.

    Questions meet names by pieces that they must have in common, never pair by pair. A question that contains a name contains the name's anchor, its
    rarest piece of ANCHOR characters. One that comes close to it has needed_grams of its pairs: at its end where the name is short, in a
    segment as long as the name's windows otherwise, or in a word. Long names that differ in digits only are met as one, and a segment must have a
    common subsequence with them as long as the ratio implies. Rules are evaluated on the questions and schemes that are left, ratios only
    where a fuzzy rule may fit.
    A null question matches nothing; equal (question id, scheme) are one.
    """
    asked = _questions(queries, query_id, query_col)
    schemes = _numbered(index, aliases)
    pairs = _pairs_met(asked, schemes, house, url_prefix).join(asked, "query_id").join(schemes, "no")

    @F.pandas_udf("struct<score:double,method:string,mentioned:boolean>")
    def judge(raw: pd.Series, q: pd.Series, near: pd.Series, row: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, form, close, r in zip(raw, q, near, row.itertuples(index=False), strict=True):
            s = Scheme(r.scheme, r.url, r.display, r.core, r.spaced, tuple(r.tokens))
            found = match_scores(text, s, dict.fromkeys(r.phrases, r.scheme), house, url_prefix, close or not s.core)
            score, method = max(found, key=lambda f: f[0]) if found else (None, None)
            out.append((score, method, _mentions(form, house, [s.core, s.spaced, *r.phrases])))
        return pd.DataFrame(out, columns=["score", "method", "mentioned"])

    row = F.struct("scheme", "url", "display", "core", "spaced", "tokens", "phrases")
    judged = scratch.written(pairs.select("query_id", "scheme", "url", judge("raw", X.query_form(F.col("raw")), "near", row).alias("j")).select("query_id", "scheme", "url", "j.*"), "judged")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "scheme")
    best = judged.where("score IS NOT NULL").withColumn("rank", F.row_number().over(order)).where("rank <= 5")  # the decision looks at no more
    matches = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("scheme", "url", "score", "method")), _by_score).alias("m"))
    named = judged.where("mentioned").groupBy("query_id").agg(F.array_sort(F.collect_set("scheme")).alias("cmp"))
    base = asked.select("query_id").join(matches, "query_id", "left").join(named, "query_id", "left")
    none = F.array().cast("array<struct<scheme:string,url:string,score:double,method:string>>")
    return _decided(base.select("query_id", F.coalesce("m", none).alias("m"), F.coalesce("cmp", F.array().cast("array<string>")).alias("cmp")), default_url)
