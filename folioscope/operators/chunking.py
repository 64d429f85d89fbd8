"""Section-sliding chunks: greedy packing of atomic units with overlap, a stateful scan within each document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, chunk_id string, chunk_no int, text string, start_char int, end_char int, section_title string, section_level int, estimated_tokens int"


@dataclass(frozen=True)
class ChunkParams:
    """Target sizes in tokens, characters a token, and least sizes in characters."""

    target_min: int = 300
    target_max: int = 600
    overlap_min: int = 50
    overlap_max: int = 100
    chars_per_token: float = 4.0
    floor_max: int = 200
    floor_min: int = 100
    floor_overlap: int = 40

    def sizes(self, n: int) -> tuple[int, int, int]:
        """(least, most, overlap) in characters for a text of n."""
        most = max(self.floor_max, int(self.target_max * self.chars_per_token))
        least = min(max(self.floor_min, int(self.target_min * self.chars_per_token)), n or 1)
        overlap = min(self.overlap_max, self.overlap_min)
        return least, most, min(max(self.floor_overlap, int(overlap * self.chars_per_token)), n // 4)


Span = tuple[int, int]


def table_blocks(text: str) -> list[Span]:
    out: list[Span] = []
    at = 0
    for line in text.splitlines(keepends=True):
        if line.strip() and "|" in line:
            if out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + len(line))
            else:
                out.append((at, at + len(line)))
        at += len(line)
    return out


def paragraphs(text: str, start: int, stop: int) -> Iterator[Span]:
    at = start
    for m in re.compile(r"\n\s*\n+").finditer(text, start, stop):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:stop].strip():
        yield at, stop


def atomic_units(text: str) -> list[Span]:
    """Table blocks, and paragraphs of what lies between them."""
    out, at = [], 0
    for a, b in [*table_blocks(text), (len(text), len(text))]:
        if at < a:
            out += paragraphs(text, at, a)
        if a < b:
            out.append((a, b))
        at = max(at, b)
    return out


def pieces(text: str, span: Span, most: int) -> Iterator[Span]:
    """The span cut at its last space before each most characters; white space after a cut is skipped."""
    at, stop = span
    if stop - at <= most:
        yield span
        return
    while at < stop:
        end = min(stop, at + most)
        if end < stop:
            cut = text.rfind(" ", at, end)
            end = cut if cut > at else end
        yield at, end
        at = end
        while at < stop and text[at].isspace():
            at += 1


def headings(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, start, stop) of the sections, as heading_sections gives them."""
    marks, at = [], 0
    for line in text.split("\n"):
        if m := re.match(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", line):
            marks.append((len(m[1]), m[2], at))
        at += len(line) + 1
    if not marks:
        return [(0, "(document)", 0, len(text))]
    if text[: marks[0][2]].strip():
        marks.insert(0, (0, "(preamble)", 0))
    stops = [m[2] for m in marks[1:]] + [len(text)]
    return [(level, title, start, stop) for (level, title, start), stop in zip(marks, stops, strict=True)]


def chunk_spans(text: str, params: ChunkParams = ChunkParams()) -> list[tuple[int, int, str, int]]:
    """(start, stop, title, level) of each chunk. A chunk has the title of its first unit and is one slice of the text."""
    least, most, overlap = params.sizes(len(text))
    units: list[tuple[int, int, str, int]] = []
    for level, title, start, stop in headings(text):
        body = text[start:stop]
        for a, b in atomic_units(body):
            rows = [x for x in body[a:b].splitlines() if x.strip()]
            whole = len(rows) >= 2 and all("|" in x for x in rows) and b - a > most
            units += [(start + x, start + y, title, level) for x, y in ([(a, b)] if whole else pieces(body, (a, b), most))]
    if not units:
        return [(0, len(text), headings(text)[0][1], headings(text)[0][0])] if text.strip() else []
    out, low = [], 0
    while True:
        size, high = 0, low
        while high < len(units) and size < most:
            step = units[high][1] - units[high][0]
            if size and size + step > most and size >= least:
                break
            size += step
            high += 1
        out.append((units[low][0], units[high - 1][1], *units[low][2:]))
        if high == len(units):
            return out
        back = low
        while back < len(units) and units[back][1] <= out[-1][1] - overlap:
            back += 1
        low = back if back > low else high


def chunk(df: DataFrame, id_col: str, text_col: str, strategy: str = "section_sliding_v1", params: ChunkParams = ChunkParams()) -> DataFrame:
    """Chunks by the named strategy; another name is an error."""
    if strategy != "section_sliding_v1":
        raise ValueError(f"unknown chunking strategy {strategy}")
    return sliding_chunks(df, id_col, text_col, params)


def sliding_chunks(df: DataFrame, id_col: str, text_col: str, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Chunks of every text; null and blank texts have none. Documents are independent: one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                for n, (a, b, title, level) in enumerate(chunk_spans(text or "", params)):
                    rows.append((key, f"{key}_c{n:04d}", n, text[a:b], a, b, title, level, max(1, int((b - a) / params.chars_per_token))))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).mapInPandas(run, SCHEMA)


def register_chunk(spark: SparkSession, name: str = "chunk", params: ChunkParams = ChunkParams()) -> None:
    """Chunks in SQL: SELECT c.* FROM documents d, LATERAL chunk(d.doc_id, d.text) c. The columns are those of sliding_chunks; rows stay in their partition."""

    class Chunks:
        def eval(self, key: int, text: str) -> Iterator[tuple]:
            for n, (a, b, title, level) in enumerate(chunk_spans(text or "", params)):
                yield key, f"{key}_c{n:04d}", n, text[a:b], a, b, title, level, max(1, int((b - a) / params.chars_per_token))

    spark.udtf.register(name, F.udtf(Chunks, returnType=SCHEMA))
