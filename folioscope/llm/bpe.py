"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.common import bound_arrow_batches

#: Output columns and their types.
COLUMNS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}
#: Texts above this many code points are cut at safe places before the library sees them.
SEGMENT_CHARS = 1 << 16
#: A rank file above this size is refused, as its bytes go to every executor.
MAX_RANK_BYTES = 64 << 20

# Between a character that is no white space and a white space no pattern match crosses: no alternative of the pattern
# takes white space after anything else.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")
# The white space of the pattern's \s (Unicode White_Space).
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The library's regex engine overflows on these. Of such a run, whatever white space it is made of, all but the last is one match, if
# something else follows, and else the whole run is.
_LONG_BLANK = re.compile(f"[{_BLANKS}]{{2000,}}")


class Codec:
    """The library's encoding, made safe for texts of any length."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < SEGMENT_CHARS and not _LONG_BLANK.search(text):
            return self._encoding.encode_ordinary(text)
        ids: list[int] = []
        for kind, part in self._parts(text):
            ids += self._encoding._encode_single_piece(part) if kind == "blank" else self._encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, which need not be valid UTF-8."""
        return self._encoding.decode_bytes(ids)

    @staticmethod
    def _parts(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        for m in _LONG_BLANK.finditer(text):
            start, end = m.span()
            yield from Codec._segments(text[at:start])
            at = end if end == len(text) else end - 1
            yield "blank", text[start:at]
        yield from Codec._segments(text[at:])

    @staticmethod
    def _segments(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while len(text) - at > SEGMENT_CHARS:
            m = _SAFE.search(text, at + SEGMENT_CHARS)
            if not m:
                break
            yield "text", text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield "text", text[at:]


_codecs: dict[bytes, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each Python worker and rank file."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def read_rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has over {MAX_RANK_BYTES} bytes")
    return data


def encode_documents(
    df: DataFrame, rank_file: bytes, pattern: str, text_col: str = "text", out: tuple[str, ...] = ("ids",)
) -> DataFrame:
    """Encode each whole text, and decode its ids again where a decoded column is asked for.

    out names columns of COLUMNS. They follow the columns of df; a column of df with such a name is replaced. A
    null text counts as empty: no ids, empty bytes. Rows are independent, so repeated rows and ties need no rule, and
    an empty table gives an empty table. The rank file is read by the driver (at most MAX_RANK_BYTES) and broadcast.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    kept = [f for f in df.schema.fields if f.name not in out]
    # the text must reach the worker even if the result replaces it
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{text_col}`"].alias("__text"))
    schema = T.StructType([*kept, *[T.StructField(c, COLUMNS[c]) for c in out]])
    shared = spark.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in out}
            for value in batch.column(len(kept)):
                ids = codec.encode(value.as_py() or "")
                if "n_tokens" in rows:
                    rows["n_tokens"].append(len(ids))
                if "ids" in rows:
                    rows["ids"].append(array("i", ids))
                if "ids_sha256" in rows:
                    rows["ids_sha256"].append(hashlib.sha256(array("I", ids).tobytes()).hexdigest())
                if "decoded" in rows or "decoded_sha256" in rows:
                    back = codec.decode(ids)
                    if "decoded" in rows:
                        rows["decoded"].append(back)
                    if "decoded_sha256" in rows:
                        rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *[_arrow(c, rows[c]) for c in out]], names=[f.name for f in schema.fields]
            )

    return source.mapInArrow(run, schema)


def _arrow(name: str, values: list) -> pa.Array:
    if name == "ids":
        ends = [0]
        for v in values:
            ends.append(ends[-1] + len(v))
        flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(v.tobytes() for v in values))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return pa.array(values, {"n_tokens": pa.int64(), "decoded": pa.binary()}.get(name, pa.string()))


def decode_documents(
    df: DataFrame, rank_file: bytes, pattern: str, ids_col: str = "ids", out: str = "decoded"
) -> DataFrame:
    """The raw bytes of each array of ids as binary column out. Null ids give null; unknown ids fail the task."""
    spark = df.sparkSession
    bound_arrow_batches(spark)
    kept = [f for f in df.schema.fields if f.name != out]
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{ids_col}`"].alias("__ids"))
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])
    shared = spark.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            back = [None if v is None else codec.decode(v) for v in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(back, pa.binary())], names=[f.name for f in schema.fields]
            )

    return source.mapInArrow(run, schema)
