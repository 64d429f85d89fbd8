"""Surrogates for personal data: keyed replacements of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import bound_arrow_batches, written

#: An exception table up to this many rows goes to the workers whole; a larger one is joined to the documents.
MAX_SHARED = 100_000
#: Rounds in which surrogates of a format make way for real entities; a format that is too full for that then takes one bijection as a whole.
FORMAT_ROUNDS = 6
#: Bijections that such a format can choose from.
FORMAT_CHOICES = 16

# Forms of address and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n",
    "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}

_TITLES = "|".join(TITLES)
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
PATTERNS: list[tuple[str, re.Pattern[str]]] = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])")),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?(?P<v>(?=[\w+/-]{16}|[\w+/.~-]*[0-9])[\w+/-][\w+/.~-]{14,}[\w+/-]=*)")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("card", re.compile(r"(?<![0-9])(?!(?<=\+)[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9]))(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    # international; area in parentheses; North American; national with 0; other groups; local; any digits, for _CALL to judge
    ("phone", re.compile(r"(?<![0-9+])(?:\+\(?[0-9](?:[ .()/-]{0,2}[0-9]){6,14}|\([0-9]{2,5}\)[ ./-]?[0-9]{2,8}(?:[ .-][0-9]{2,8}){0,4}"
        r"|(?:1[ .-]?)?[2-9][0-9]{2}[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}|0[0-9]{1,5}[ ./-]?[0-9]{2,10}(?:[ .-][0-9]{2,8}){0,4}"
        r"|[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}|(?<![0-9]-)[0-9]{3}-[0-9]{4}(?!-?[0-9]))(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])[0-9](?:[ .()/-]{0,2}[0-9]){6,14}(?![0-9])")),
    ("name", re.compile(rf"(?<!\w)(?P<t>(?:{_TITLES})\.?(?:[ ](?:{_TITLES})\b\.?)*)[ ](?P<v>{_NAME})")),
]
_CALL = re.compile(
    r"(?i)(?<!\w)(?:(?:tele|mobile ?|cell ?)?phone|tel|telefono?|teléfono|téléphone|tél|mobile?|móvil|handy|cell|fax|call|dial|whatsapp|sms|телефон|тел|τηλέφωνο|τηλ)"
    r"\W{1,3}(?:[^\W\d]+\W{1,3}){0,3}$"
)
_NEXT = re.compile(rf"[ ](?:(?:van|von|vom|zu|zur|der|den|ten|de|del|della|di|da|dos|du|des|la|le|el|al|bin|ibn|y)[ ]){{0,3}}({_NAME})")
_WORD, _PART = re.compile(rf"(?<!\w){_NAME}(?!\w)"), re.compile(r"[^\W\d_]+")
_ANY = re.compile(rf"[0-9@]|(?<!\w)(?:{_TITLES})\b|(?i:token|secret|passw|api.?key)")


# -- detection ------------------------------------------------------------------------------------------------------

Entity = tuple[int, int, str, str]  # start, end, kind, value


def _is_phone(text: str, m: re.Match[str]) -> bool:
    """Has a match the digits of a number? Groups that tell nothing need nine of them, or seven after a word such as 'phone'."""
    n = sum(c.isdigit() for c in m[0])
    if n > 15:
        return False
    told = m[0][0] in "+(" or re.fullmatch(r"[0-9]{3}-[0-9]{4}", m[0])
    return n >= (7 if told else 9) if m.re is PATTERNS[-3][1] else bool(_CALL.search(text, max(0, m.start() - 60), m.start()))


def _names(text: str, titled: Iterator[re.Match[str]]) -> Iterator[Entity]:
    """All words of the names after titles, and every other mention of these words in the text (in the same letter case, or all capitals)."""
    found: dict[int, Entity] = {}
    for m in titled:
        gender = next((g for t in _PART.findall(m["t"]) if (g := TITLES.get(t, "n")) != "n"), "n")
        words, more = [], m
        while more and more[more.lastindex][0].isupper() and more[more.lastindex] not in TITLES:
            start, end = more.span(more.lastindex)
            if end - start > 2 and text[end - 2 : end] in ("'s", "’s"):
                words.append((start, end - 2))
                break
            words.append((start, end))
            more = _NEXT.match(text, end + (end - start == 1 and text[end : end + 1] == "."))
        for i, (a, b) in enumerate(words):
            role = "surname-n" if i == len(words) - 1 else f"given-{gender}"
            found[a] = (a, b, f"name-{role}", text[a:b])
    known: dict[str, str] = {}
    for _, _, kind, word in found.values():
        for form in (word, word.upper(), word.title() if word.isupper() else word) if len(word) > 1 else ():
            if known.get(form, "name-given").startswith("name-given"):
                known[form] = kind
    for m in _WORD.finditer(text) if known else ():
        whole = m[0][:-2] if m[0].endswith(("'s", "’s")) else m[0]
        for start, word in [(m.start(), whole)] if whole in known else [(p.start(), p[0]) for p in _PART.finditer(text, *m.span())]:
            if word in known and start not in found:
                found[start] = (start, start + len(word), known[word], word)
    yield from found.values()


def find_entities(text: str | None) -> list[Entity]:
    """Entities of a text in order, not overlapping; the earlier kind of PATTERNS wins, and later ones see what it leaves. kind of a name has its role
    (given, surname) and gender, and each word of a name is an entity of its own, so that a surname alone is the same entity.
    """
    if not text or not _ANY.search(text):
        return []
    out: list[Entity] = []
    for kind, pattern in PATTERNS:
        if kind == "name":
            taken = list(_names(text, pattern.finditer(text)))
        else:
            part = "v" if "v" in pattern.groupindex else 0
            hits = (m for m in pattern.finditer(text) if kind != "phone" or _is_phone(text, m))
            # a value in which nothing can change, such as a row of dashes, is no personal data
            taken = [(*m.span(part), kind, m[part]) for m in hits if any(map(str.isalnum, m[part]))]
        if taken and kind != "name":
            pieces, at = [], 0
            for start, end, *_ in taken:
                pieces += [text[at:start], "\0" * (end - start)]
                at = end
            text = "".join(pieces) + text[at:]
        out += taken
    return sorted(out)


def entity_key(kind: str, value: str) -> str:
    """What mentions of one entity have in common: separators and letter case don't count where they carry nothing."""
    if kind in ("card", "phone", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", value)
    if kind == "email" or kind.startswith("name"):
        return unicodedata.normalize("NFC", value).lower()
    return value


# -- surrogates -----------------------------------------------------------------------------------------------------


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    """Keyed 32-bit numbers."""
    n = 0
    while True:
        block = hashlib.blake2b("\0".join([*parts, str(n)]).encode(), key=key, digest_size=64).digest()
        for i in range(0, 64, 4):
            yield int.from_bytes(block[i : i + 4], "big")
        n += 1


def permuted(key: bytes, tweak: str, symbols: list[int], radices: list[int]) -> list[int]:
    """A keyed bijection of lists of digits with the given radices: ten Feistel rounds that add to each half what
    the other half's digits give. A single digit gets a keyed rotation.
    """
    x, half = list(symbols), len(symbols) // 2
    sides = [list(range(half)), list(range(half, len(x)))]
    for r in range(10):
        change, stay = sides[r % 2], sides[1 - r % 2]
        s = _stream(key, tweak, str(r), ",".join(map(str, radices)), ",".join(str(x[i]) for i in stay))
        for i in change:
            x[i] = (x[i] + next(s)) % radices[i]
    return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(maxsize=4096)
def alphabet_of(c: str) -> str:
    """The characters that can stand for c, c among them; each of them has the same alphabet. ASCII digits and letters have
    their classes; other letters and numbers those of their block of 64 code points with equal category and normal form. Empty for all else.
    """
    for known in _CLASSES:
        if c in known:
            return known
    if not c.isalnum():
        return ""
    kind = lambda x: (unicodedata.category(x), x.lower() == x, unicodedata.normalize("NFC", x) == x, len(x.upper()))
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(max(first, 128), first + 64)) if x.isalnum() and kind(x) == kind(c))


def _formatted(key: bytes, tweak: str, value: str, keep: Callable[[int], bool] = lambda i: False) -> str:
    """Digits become digits and letters letters of the same script and case; all else, and places in keep, stay."""
    places, symbols, radices, alphabets = [], [], [], []
    for i, c in enumerate(value):
        alphabet = alphabet_of(c)
        if alphabet and not keep(i):
            places.append(i)
            symbols.append(alphabet.index(c))
            radices.append(len(alphabet))
            alphabets.append(alphabet)
    out = list(value)
    for i in places:
        out[i] = "#"
    fixed = "".join(out)
    for i, v, a in zip(places, permuted(key, f"{tweak}|{fixed}", symbols, radices), alphabets, strict=True):
        out[i] = a[v]
    return "".join(out)


def _walk(step: Callable[[str], str], value: str, kind_of: Callable[[str], object]) -> str:
    """Step until the value is of the kind it was: still a bijection, within each kind."""
    want, now = kind_of(value), step(value)
    while kind_of(now) != want:
        now = step(now)
    return now


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _phone_class(value: str) -> tuple[bool, ...]:
    trunk = len(value) == 11 and value[0] == "1"
    local = value[2:] if value.startswith("+1") else value[trunk:]
    return value[0] == "0", trunk, value.startswith("+1") and len(local) == 10, len(local) == 10 and local[0] in "23456789" and local[3] in "23456789"


def _iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _network(value: str) -> str:
    """The private network of an address, 'special' or 'public'."""
    p = [int(x) for x in value.split(".")]
    if p[0] in (10, 127):
        return str(p[0])
    if p[:2] == [192, 168] or p[0] == 172 and 16 <= p[1] < 32:
        return f"{p[0]}.{p[1]}"
    return "special" if p[0] == 0 or p[0] >= 224 else "public"


def _ip(key: bytes, tweak: str, value: str) -> str:
    head = _network(value)
    fixed = 0 if head in ("special", "public") else head.count(".") + 1

    def step(v: str) -> str:
        p = [int(x) for x in v.split(".")]
        return ".".join(map(str, p[:fixed] + permuted(key, f"{tweak}|ip|{head}", p[fixed:], [256] * (4 - fixed))))

    return step(value) if fixed else _walk(step, value, _network)


# Sounds to build names from, by script.
_ONSETS = {
    "LATIN": "b d f g k l m n p r s t v br dr kl st tr".split(),
    "CYRILLIC": "б в г д ж з к л м н п р с т".split(),
    "GREEK": "β γ δ θ κ λ μ ν π ρ σ τ φ".split(),
}
_VOWELS = {"LATIN": "a e i o u".split(), "CYRILLIC": "а е и о у".split(), "GREEK": "α ε ι ο".split()}
_ENDINGS = {
    ("LATIN", "m"): "n r s t k".split(), ("LATIN", "f"): "a ia ina elle".split(), ("LATIN", "n"): "er en an is".split(),
    ("CYRILLIC", "m"): "н р й".split(), ("CYRILLIC", "f"): "а на ия".split(), ("CYRILLIC", "n"): "ко ин ов".split(),
    ("GREEK", "m"): "ος ης ας".split(), ("GREEK", "f"): "α η ια".split(), ("GREEK", "n"): "ης ου ας".split(),
}


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split(" ")[0]
    return "LATIN"


def _name(key: bytes, attempt: int, kind: str, value: str) -> str:
    """A name of the script and gender. Every second attempt is a syllable longer, so there are names for any number of entities."""
    script, gender = script_of(value), kind.rpartition("-")[2]
    s = _stream(key, str(attempt), kind.rpartition("-")[0], value)
    if script not in _ONSETS:  # no sounds known: other letters of the same block of 64 code points
        base = [c for c in range(ord(value[0]) & ~63, (ord(value[0]) & ~63) + 64) if chr(c).isalpha()] or [ord(value[0])]
        return "".join(chr(base[next(s) % len(base)]) for _ in range(len(value) + attempt // 2))
    out = ""
    for _ in range(max(2, min(4, len(value) // 3 + 1)) + attempt // 2):
        out += _ONSETS[script][next(s) % len(_ONSETS[script])] + _VOWELS[script][next(s) % len(_VOWELS[script])]
    ends = _ENDINGS[script, gender]
    end = ends[next(s) % len(ends)]
    return (out[:-1] if end[0] in _VOWELS[script] else out) + end


def _is_hex(value: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]+", value))


def _valid_ssn(v: str) -> bool:
    return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"


def _rule(kind: str, entity: str) -> tuple[Callable[[int], bool], Callable[[str], object]]:
    """Which places of an entity stay, and what else its surrogate has in common with it."""
    if kind == "email":
        last = entity.rindex(".")
        return lambda i: i >= last, lambda v: "@" in v
    if kind == "secret":
        return lambda i: False, _is_hex
    if kind == "card":
        return lambda i: i == 0, luhn
    if kind == "phone":
        fixed = 2 if entity.startswith("+1") else 3 if entity.startswith("+") else int(entity[0] == "0" or entity[0] == "1" and len(entity) == 11)
        return lambda i: i < fixed, _phone_class
    if kind == "iban":
        return lambda i: i < 2, lambda v: _iban_rest(v) == 1
    if kind == "ssn":
        return lambda i: False, _valid_ssn
    return lambda i: False, lambda v: None


def format_of(kind: str, entity: str) -> str | None:
    """What every attempt keeps of an entity: within one format, each attempt is a bijection, and formats don't meet. None for names."""
    if kind.startswith("name"):
        return None
    if kind == "ip":
        return _network(entity)
    if kind == "secret" and _is_hex(entity):
        return f"hex {len(entity)}"
    keep, kind_of = _rule(kind, entity)
    marks = (c if keep(i) or not alphabet_of(c) else "\1" + alphabet_of(c)[0] for i, c in enumerate(entity))
    return f"{''.join(marks)} {kind_of(entity)}"


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The surrogate of an entity key. Each attempt is, for all kinds but names, a bijection within the entity's format."""
    tweak = f"{kind}|{attempt}"
    if kind.startswith("name"):
        return _name(key, attempt, kind, entity)
    if kind == "secret" and _is_hex(entity):
        digits = permuted(key, tweak + "|hex", [int(c, 16) for c in entity], [16] * len(entity))
        return "".join(f"{d:x}" for d in digits)
    if kind == "ip":
        return _ip(key, tweak, entity)
    keep, kind_of = _rule(kind, entity)
    return _walk(lambda v: _formatted(key, tweak, v, keep), entity, kind_of)


def dressed(kind: str, mention: str, value: str) -> str:
    """The surrogate of an entity in the form of one of its mentions: separators, letter case."""
    if kind in ("card", "phone", "iban"):
        it = iter(value.replace("+", ""))
        return "".join(next(it) if c.isalnum() else c for c in mention)
    if kind == "email":
        return "".join(v.upper() if c.isupper() and len(v.upper()) == 1 else v for c, v in zip(mention, value, strict=True)) if len(mention) == len(value) else value
    if kind.startswith("name"):
        return value.upper() if mention.isupper() and len(mention) > 1 else value[:1].upper() + value[1:]
    return value


#: For (kind, entity): the attempt to take, and the kind to take it from.
Exceptions = dict[tuple[str, str], tuple[int, str]]


def replaced(text: str | None, key: bytes, exceptions: Exceptions, make: Callable[..., str] = surrogate) -> tuple[str | None, list[str]]:
    """The text with all entities replaced, and their kinds."""
    found = find_entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, value in found:
        entity = entity_key(kind, value)
        attempt, kind_of = exceptions.get((kind, entity), (0, kind))
        out += [text[at:start], dressed(kind, value, make(key, kind_of, entity, attempt))]
        at = end
    return "".join(out) + text[at:], [k for _, _, k, _ in found]


# -- the operator ---------------------------------------------------------------------------------------------------


def surrogate_table(df: DataFrame, key: bytes, text_col: str = "text", make: Callable[..., str] = surrogate) -> DataFrame:
    """All entities of the texts as (kind, entity, attempt, surrogate): surrogates are distinct within a family of kinds and
    none is itself an entity of the texts. Colliding ones are made anew with the next attempt, all but the first of them by (attempt, entity), until
    none is left; names grow with the attempts, so they always find a place. A format so full of real entities that after
    FORMAT_ROUNDS some still collide takes one attempt for all its entities: a bijection, so they stay distinct, and of FORMAT_CHOICES the one that
    leaves the fewest entities as they are; only in such a format can a surrogate be another real entity.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    texts = df.select(df[f"`{text_col}`"].alias("text")).where("text IS NOT NULL")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({(k, entity_key(k, v)) for t in batch.column(0) for _, _, k, v in find_entities(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["kind", "entity"])

    @F.udf("string", useArrow=True)
    def made(kind: str, entity: str, attempt: int) -> str:
        return make(key, kind, entity, attempt)

    @F.udf("string", useArrow=True)
    def form(kind: str, entity: str) -> str | None:
        return format_of(kind, entity)

    family = F.split("kind", "-")[0]
    real = written(texts.mapInArrow(detect, "kind string, entity string").distinct(), "entities").repartition(n_tasks, "kind", "entity")
    now = written(real.withColumn("attempt", F.lit(0)).withColumn("surrogate", made("kind", "entity", "attempt")), "surrogates")
    full: DataFrame | None = None
    for turn in count():
        first = Window.partitionBy(family, "surrogate").orderBy("attempt", "kind", "entity")
        taken = real.select(family.alias("f"), F.col("entity").alias("e"), F.lit(True).alias("hit")).distinct()
        judged = now.withColumn("n", F.row_number().over(first)).withColumn("f", family)
        judged = judged.join(taken, (judged["f"] == taken["f"]) & (judged["surrogate"] == taken["e"]), "left").drop(taken["f"])
        clash = (F.col("n") > 1) | F.coalesce("hit", F.lit(False))
        judged = written(judged.select("kind", "entity", "attempt", "surrogate", clash.alias("clash")), "judged")
        if judged.where("clash").isEmpty():
            return now if full is None else now.unionByName(full)
        if turn == FORMAT_ROUNDS:
            crowded = judged.where("clash").select("kind", form("kind", "entity").alias("form")).where("form IS NOT NULL").distinct()
            formed = written(now.select("kind", "entity", form("kind", "entity").alias("form")).join(crowded, ["kind", "form"]), "crowded")
            tried = formed.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(FORMAT_CHOICES - 1)))).repartition(n_tasks, "kind", "entity", "attempt")
            tried = written(tried.withColumn("surrogate", made("kind", "entity", "attempt")), "tried")
            left = tried.groupBy("kind", "form", "attempt").agg(F.sum((F.col("surrogate") == F.col("entity")).cast("long")).alias("same"))
            best = left.groupBy("kind", "form").agg(F.min(F.struct("same", "attempt"))["attempt"].alias("attempt"))
            full = tried.join(best, ["kind", "form", "attempt"]).select("kind", "entity", "attempt", "surrogate")
            judged = judged.join(formed.select("kind", "entity"), ["kind", "entity"], "left_anti")
        again = judged.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int")).repartition(n_tasks, "kind", "entity")
        remade = F.when(F.col("clash"), made("kind", "entity", "attempt")).otherwise(F.col("surrogate"))
        now = written(again.select("kind", "entity", "attempt", remade.alias("surrogate")), "surrogates")


def _exceptions(made: DataFrame) -> DataFrame:
    """Entities whose surrogate is not the first attempt of their own kind: those that collided, and given names that are mentioned
    both with a title that tells the gender and with one that doesn't (Dr), which follow the former.
    """
    told = made.where(F.col("kind").isin("name-given-f", "name-given-m")).groupBy("entity").agg(F.min(F.struct("kind", "attempt")).alias("t"))
    untold = made.where("kind = 'name-given-n'").select("entity").join(told, "entity")
    untold = untold.select(F.lit("name-given-n").alias("kind"), "entity", "t.attempt", F.col("t.kind").alias("kind_of"))
    odd = made.where("attempt > 0").select("kind", "entity", "attempt", F.col("kind").alias("kind_of"))
    return odd.join(untold.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(untold)


def replace_entities(df: DataFrame, key: bytes, text_col: str = "text", make: Callable[..., str] = surrogate) -> DataFrame:
    """Replace the personal data in each whole text; adds n_entities long and kinds array<string> (in order of the text).

    An entity has one surrogate in all texts (coreference), different ones have different surrogates that are no entity of the texts, and
    surrogates depend on the key alone but for such collisions. A text without entities, or null, stays as it is; equal
    texts give equal texts. Letters of every script change within their script. Columns named n_entities or kinds are replaced; an empty table stays empty.

    Two passes over the texts; only entities are shuffled. Workers compute surrogates themselves and need just
    the exceptions: a table of up to MAX_SHARED rows, by count, is broadcast; a larger one is
    joined to the texts that mention its entities.
    """
    spark = df.sparkSession
    odd = _exceptions(surrogate_table(df, key, text_col, make))
    kept = [f for f in df.schema.fields if f.name not in ("n_entities", "kinds")]
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{text_col}`"].alias("__text"))
    if odd.limit(MAX_SHARED + 1).count() <= MAX_SHARED:
        shared = spark.sparkContext.broadcast({(r.kind, r.entity): (r.attempt, r.kind_of) for r in odd.collect()})
        source = source.withColumn("__odd", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int,kind_of:string>>"))
    else:
        shared = spark.sparkContext.broadcast({})
        mentions = F.udf(_mentions, "array<struct<kind:string,entity:string>>", useArrow=True)
        source = source.withColumn("__mark", F.sha2("__text", 256))
        pairs = source.select("__mark", F.explode(mentions("__text")).alias("m")).select("__mark", "m.*").distinct()
        mine = pairs.join(odd, ["kind", "entity"]).groupBy("__mark").agg(F.collect_list(F.struct("kind", "entity", "attempt", "kind_of")).alias("__odd"))
        source = source.join(mine.hint("shuffle_hash"), "__mark", "left").drop("__mark")
    schema = T.StructType([*kept, T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                exceptions = shared.value
                if own.is_valid:
                    exceptions = {(o["kind"], o["entity"]): (o["attempt"], o["kind_of"]) for o in own.as_py()}
                rows.append(replaced(text.as_py(), key, exceptions, make))
            columns = list(batch.columns[: len(kept)])
            columns[names.index(text_col)] = pa.array([t for t, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(k) for _, k in rows], pa.int64()), pa.array([k for _, k in rows], pa.list_(pa.string()))], names=schema.names
            )

    return source.mapInArrow(run, schema)


def _mentions(text: str | None) -> list[tuple[str, str]]:
    return sorted({(k, entity_key(k, v)) for _, _, k, v in find_entities(text)})
