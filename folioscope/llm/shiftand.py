"""URL filters by a bit-parallel wildcard automaton: glob rules packed into multiword Shift-And masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of a filter, as (verdict, host, path).
Rule = tuple[str, str, str]
#: Bits of all patterns at most; the masks go to every worker and take about 16 bytes for each bit and byte class.
MAX_BITS = 1 << 20


class Automaton:
    """All patterns at once, each as a row of states, one bit a state.

    In a pattern ``?`` is one byte other than ``/``, ``*`` any run of such bytes, ``**`` any run at all, and every
    other byte itself. A pattern must fit the whole input. On byte c the states move as
    ``(D << 1) & step[c] | D & stay[c]``: step has the states that c leads into, stay those with a wildcard behind them.
    """

    def __init__(self, patterns: list[bytes]) -> None:
        step_of: list[set[int] | int | None] = []  # for each bit: the byte, a set, or None for a first state
        stay_of: dict[int, bool] = {}  # bit: does its wildcard take "/" too
        self.first: list[int] = []
        self.last: list[int] = []
        for p in patterns:
            self.first.append(len(step_of))
            step_of.append(None)
            i = 0
            while i < len(p):
                if p[i] == ord("*"):
                    deep = p[i : i + 2] == b"**"
                    at = len(step_of) - 1
                    stay_of[at] = stay_of.get(at, False) or deep
                    i += 2 if deep else 1
                else:
                    step_of.append(-1 if p[i] == ord("?") else p[i])
                    i += 1
            self.last.append(len(step_of) - 1)
        n = len(step_of)
        if n > MAX_BITS:
            raise ValueError(f"the patterns have {n} states; {MAX_BITS} is the bound")
        self.words = max(1, -(-n // 64))
        used = sorted({x for x in step_of if x is not None and x >= 0} | {ord("/")})
        self.class_of = np.zeros(256, np.int64)  # 0: any byte that no pattern names
        for k, byte in enumerate(used):
            self.class_of[byte] = k + 1
        self.step = np.zeros((len(used) + 1, self.words), np.uint64)
        self.stay = np.zeros_like(self.step)
        slash = int(self.class_of[ord("/")])
        for bit, what in enumerate(step_of):
            w, b = bit // 64, np.uint64(1 << (bit % 64))
            if what == -1:
                self.step[[k for k in range(len(used) + 1) if k != slash], w] |= b
            elif what is not None:
                self.step[self.class_of[what], w] |= b
            if bit in stay_of:
                self.stay[[k for k in range(len(used) + 1) if k != slash or stay_of[bit]], w] |= b
        self.start = np.zeros(self.words, np.uint64)
        for bit in self.first:
            self.start[bit // 64] |= np.uint64(1 << (bit % 64))

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Final states, a row of words for each text. Texts step together; those that have ended drop out."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else sizes
        data = self.class_of[np.frombuffer(b"".join(texts[i] for i in order), np.uint8)]
        d = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for t in range(int(sizes[0]) if len(texts) else 0):
            while sizes[live - 1] <= t:
                live -= 1
            c = data[starts[:live] + t]
            now = d[:live]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            d[:live] = (moved & self.step[c]) | (now & self.stay[c])
        out = np.empty_like(d)
        out[order] = d
        return out

    def matches(self, texts: list[bytes], preference: list[int]) -> list[int]:
        """For each text the first of the patterns in preference that fits it, or -1."""
        final = self.run(texts)
        found = np.full(len(texts), -1, np.int64)
        for k in reversed(preference):
            bit = self.last[k]
            found[(final[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0] = k
        return found.tolist()


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is no ://, or for null."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty where there is no ://, or for null."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def judge_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each url by the longest rule that fits its host (or a domain above it) and the start of its path.

    Adds host, path, rule (host and path of the rule, or null) and verdict (the rule's, or default), replacing
    columns of these names. Of equally long rules the first given wins. A null url, or one without ://, has empty host and
    path and fits no rule. Rows are independent: one pass, no shuffle; an empty table stays empty.
    Each rule becomes the glob ``*.host/path**`` over ``.`` + host + path, whose host part cannot cross a ``/``.
    """
    for _, host, path in rules:
        if set(host + path) & set("*?") or not path.startswith("/"):
            raise ValueError(f"not a plain rule: {host}{path}")
    automaton = Automaton([f"*.{host}{path}**".encode() for _, host, path in rules])
    preference = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))

    @F.pandas_udf("int")
    def rule_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for canonical in parts:
            yield pd.Series(automaton.matches([x.encode() for x in canonical], preference), dtype="int32")

    kept = [df[f"`{c}`"] for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    url = df[f"`{url_col}`"]
    split = df.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"))
    judged = split.withColumn("__k", rule_of(F.concat(F.lit("."), F.col("host"), F.col("path"))))
    names = F.array(*[F.lit(h + p) for _, h, p in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules]) if rules else F.array().cast("array<string>")
    return judged.withColumns(
        {
            "rule": F.when(F.col("__k") >= 0, F.get(names, F.col("__k"))),
            "verdict": F.when(F.col("__k") >= 0, F.get(verdicts, F.col("__k"))).otherwise(default),
        }
    ).drop("__k")
