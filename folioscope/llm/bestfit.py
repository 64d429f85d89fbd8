"""Packing token pieces into sequences by best-two-fit, planned on the counts of lengths and carried out by rank."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import bound_arrow_batches, written

#: Bytes of a tokenizer file at most; it is broadcast.
MAX_TOKENIZER_BYTES = 64 << 20
#: Characters of text that are split into words at once, words remembered by each Python worker, and the longest of these.
SEGMENT, CACHED_WORDS, CACHED_CHARS = 1 << 22, 1_000_000, 64
#: Pieces handed back at once.
ROWS_AT_ONCE = 20_000
#: Parts of each length, by hash, so that a length that a third of all pieces have is numbered by this many tasks.
LENGTH_PARTS = 256

_BLANK = re.compile(r"[ \t-\r]")
#: Words of ASCII and of the letters of Latin-1, which lower and compose one by one; how the pre-tokenizer cuts them, in lower case and with blanks between; a word that stands between others.
SIMPLE = r"^[\x00-\x7fÀ-ÖØ-öø-ÿ]+$"
PARTS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+| ")
SEPARATOR = "\x01"


def _gathered(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ids in runs of sizes, the run of each i of at, one after the other, and how many each has."""
    n = sizes[at]
    starts = (np.cumsum(sizes) - sizes)[at]
    return ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


def _runs(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), np.uint32), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4


def _split(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The bytes of ids between cuts."""
    data, ends = ids.tobytes(), (4 * cuts).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class WordCoder:
    """Ids of whole texts, as little-endian 32-bit numbers, from ids of words between ASCII white space.

    For tokenizers of the word-end kind, whose normaliser composes, lowers and blanks characters one by one, whose pre-tokenizer cuts at white
    space and by PARTS, and whose last token of every part has the word-end mark. Texts' words are made distinct, SIMPLE ones are cut into parts, and these are
    remembered; new ones go to the library together, and are told apart by the marks (parts) or by a separator's id (other words).
    Special tokens' strings are ordinary text.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        [self.between] = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.parts: dict[str, bytes] = {" ": b""}
        self.words: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of text, segment by segment, so that a very long one is never held as a list of words."""
        at = 0
        while at < len(text):
            cut = _BLANK.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            yield from self.encode_short([text[at:end]])
            at = end

    def encode_short(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts, whose new words go to the library together."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        flat = cut.flatten().dictionary_encode()
        words = flat.dictionary
        simple = pc.match_substring_regex(words, SIMPLE)
        one, other = self._simple(_strings(words.filter(simple))), self._other(_strings(words.filter(pc.invert(simple))))
        place = np.argsort(~simple.to_numpy(zero_copy_only=False), kind="stable")  # simple ones first
        rank = np.empty(len(words), np.int64)
        rank[place] = np.arange(len(words))
        runs = (np.concatenate(x) for x in zip(one, other, strict=True))
        ids, sizes = _gathered(*runs, rank[flat.indices.to_numpy(zero_copy_only=False)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return _split(ids, ends[cut.offsets.to_numpy()])

    def _simple(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = pa.array(PARTS.findall(" ".join(words).lower()), pa.large_string()).dictionary_encode()
        parts = _strings(tokens.dictionary)
        new = [p for p in parts if p not in self.parts]
        if new:
            ids = np.array(self._ids(" ".join(new)), np.uint32)
            fresh = dict(zip(new, _split(ids, np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])), strict=True))
            _remember(self.parts, fresh, parts)
        at = tokens.indices.to_numpy(zero_copy_only=False)
        ids, sizes = _gathered(*_runs([self.parts[p] for p in parts]), at)
        _forget(self.parts, new, " ")
        if not words:
            return ids, sizes
        ends = np.concatenate([[0], np.cumsum(sizes)])
        blank = np.flatnonzero(at == parts.index(" ")) if " " in parts else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], ends[blank], [ends[-1]]]))

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = [w for w in words if w not in self.words]
        plain = [w for w in new if SEPARATOR not in w]
        fresh = {w: np.array(self._ids(w), np.uint32).tobytes() for w in new if SEPARATOR in w}
        if plain:
            ids = np.array(self._ids(f" {SEPARATOR} ".join(plain)), np.uint32)
            cuts = np.flatnonzero(ids == self.between)
            left = np.arange(len(cuts))  # separators before each cut, which are left out
            fresh |= zip(plain, _split(np.delete(ids, cuts), np.concatenate([[0], cuts - left, [len(ids) - len(cuts)]])), strict=True)
        _remember(self.words, fresh, words)
        out = _runs([self.words[w] for w in words])
        _forget(self.words, new, "")
        return out

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets


def _remember(known: dict[str, bytes], fresh: dict[str, bytes], needed: list[str]) -> None:
    """Add fresh; if there are too many then, keep only what is needed now."""
    if len(known) + len(fresh) > CACHED_WORDS:
        held = {w: known[w] for w in needed if w in known}
        known.clear()
        known.update(held)
    known.update(fresh)


def _forget(known: dict[str, bytes], new: list[str], always: str) -> None:
    """Take out new words that are too long to remember."""
    for w in new:
        if len(w) > CACHED_CHARS:
            known.pop(w, None)
    known[always] = b""


_coders: dict[int, WordCoder] = {}


def _coder(tokenizer_json: str) -> WordCoder:
    """One coder for each Python worker and tokenizer."""
    key = hash(tokenizer_json)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(tokenizer_json)
    return _coders[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} has over {MAX_TOKENIZER_BYTES} characters")
    return data


def token_pieces(df: DataFrame, tokenizer_json: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids, end_id after them, in pieces of capacity ids; the last may be shorter, none is empty.

    Returns id_col, piece int, start long, length long, ids_crc32 long, and ids array<int> if asked for. A null text is an empty one: a single end_id.
    Other columns of df are not read. Rows are independent; an empty table gives an empty table.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    width, ending = 4 * capacity, array("I", [end_id]).tobytes()

    def coded(coder: WordCoder, texts: pa.Array) -> Iterator[tuple[int, Iterator[bytes]]]:
        """(row, ids in runs), short texts together."""
        some: list[tuple[int, str]] = []
        size = 0
        for row, value in enumerate(texts):
            text = value.as_py() or ""
            if len(text) > SEGMENT:
                yield row, coder.encode(text)
                continue
            some.append((row, text))
            size += len(text)
            if size > SEGMENT:
                yield from ((r, iter([ids])) for (r, _), ids in zip(some, coder.encode_short([t for _, t in some]), strict=True))
                some, size = [], 0
        yield from ((r, iter([ids])) for (r, _), ids in zip(some, coder.encode_short([t for _, t in some]), strict=True))

    def pieces(runs: Iterator[bytes]) -> Iterator[bytes]:
        rest = b""
        for ids in runs:
            rest += ids
            whole = len(rest) - len(rest) % width
            for at in range(0, whole, width):
                yield rest[at : at + width]
            rest = rest[whole:]
        yield rest + ending

    def table(of: list[int], cut: list[tuple[int, bytes]], ids: pa.Array) -> pa.RecordBatch:
        columns = [
            ids.take(pa.array(of, pa.int64())),
            pa.array([p for p, _ in cut], pa.int32()),
            pa.array([p * capacity for p, _ in cut], pa.int64()),
            pa.array([len(b) // 4 for _, b in cut], pa.int64()),
            pa.array([zlib.crc32(b) for _, b in cut], pa.int64()),
        ]
        if with_ids:
            columns.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for _, b in cut], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            of: list[int] = []
            cut: list[tuple[int, bytes]] = []
            for row, runs in coded(coder, batch.column(1)):
                for p, b in enumerate(pieces(runs)):
                    of.append(row)
                    cut.append((p, b))
                    if len(of) >= ROWS_AT_ONCE:
                        yield table(of, cut, batch.column(0))
                        of, cut = [], []
            if of:
                yield table(of, cut, batch.column(0))

    return df.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Pattern:
    """repeats sequences that all hold the same lengths: (length, how many), longest first."""

    repeats: int
    lengths: tuple[tuple[int, int], ...]


def best_two_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Pack counts[n] pieces of each length n from 1 to capacity.

    Sequence by sequence: the longest piece that is left, then always the longest that still fits, until none does. Then the shortest of at least
    two pieces gives way to two that are left, whose sum fits the gap that it leaves and is the largest such sum above its own
    length (of equal sums the two with the longest piece); again while that helps. What one sequence does the next one does too
    while it finds the same lengths, so equal ones are made at once, and a pattern ends only when a length has run low. There are at most
    2 capacity / n turns for a length n to run low, so patterns are bounded by the capacity, not by the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    place = np.arange(capacity + 1)
    out: list[Pattern] = []
    while True:
        fitting = np.maximum.accumulate(np.where(left > 0, place, 0))  # the longest length left up to each
        if not fitting[capacity]:
            return out
        used: dict[int, int] = {}
        room, n = capacity, int(fitting[capacity])
        while n:
            used[n] = min(int(left[n]), room // n)
            room -= n * used[n]
            n = int(fitting[min(room, n - 1)])
        most = dict(used)
        while room and sum(used.values()) > 1:
            least = min(used)
            pair = _best_two(left, used, least, room + least)
            if not pair:
                break
            used[least] -= 1
            if not used[least]:
                del used[least]
            for n in pair:
                used[n] = used.get(n, 0) + 1
                most[n] = max(most.get(n, 0), used[n])
            room += least - sum(pair)
        repeats = min((int(left[n]) - most[n]) // times + 1 for n, times in used.items())
        for n, times in used.items():
            left[n] -= times * repeats
        out.append(Pattern(repeats, tuple(sorted(used.items(), reverse=True))))


def _best_two(left: np.ndarray, used: dict[int, int], least: int, gap: int) -> tuple[int, int] | None:
    """Two lengths of what is left beside used, whose sum is the largest up to gap and above least. The piece of length least is still in use."""
    free = left[: gap + 1].copy()
    for n, times in used.items():
        if n <= gap:
            free[n] -= times
    place = np.arange(gap + 1)
    fitting = np.maximum.accumulate(np.where(free > 0, place, 0))
    first = np.flatnonzero(free > 0)
    if not len(first):
        return None
    second = fitting[np.minimum(first, gap - first)]
    single = (second == first) & (free[first] < 2)
    second = np.where(single, fitting[np.maximum(first - 1, 0)], second)
    sums = np.where(second > 0, first + second, 0)
    best = len(sums) - 1 - int(sums[::-1].argmax())  # the last of equals has the longest piece
    return (int(first[best]), int(second[best])) if sums[best] > least else None


def _slots(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, in the order of their ranks: runs of (length, first rank), each with how many of that length a sequence
    takes, its first sequence and the place in it."""
    rows, sequence = [], 0
    for p in patterns:
        place = 0
        for n, times in p.lengths:
            rows.append((n, times * p.repeats, times, sequence, place))
            place += n * times
        sequence += p.repeats
    rows.sort(key=lambda r: r[0])  # stable: within a length as planned
    length, size, times, first, place = np.array(rows, np.int64).reshape(-1, 5).T
    before = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    return {"before": before, "times": times, "first": first, "place": place}


def pack_pieces(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """pieces (written once already, with length from 1 to capacity) with sequence_id long and offset long: every sequence holds at most capacity ids without a gap.

    The counts of lengths, at most capacity numbers, are all that the plan is made from and all that the driver sees. Each piece's number among
    all, ordered by length, comes from the sums of (length, hash part) and a window in each of these, and the plan tells its
    sequence: a table of runs, bounded like the patterns, is searched in Arrow batches. Pieces of equal length are exchangeable.
    """
    part = F.pmod(F.xxhash64(F.lit(29), f"`{id_col}`", "piece", "ids_crc32"), F.lit(LENGTH_PARTS)).cast("int")
    dealt = pieces.withColumn("__part", part)
    sums = written(dealt.groupBy("length", "__part").agg(F.count("*").alias("__n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("__n").alias("n")).collect():  # a row for each length
        counts[r.length] = r.n
    slots = _slots(best_two_fit(counts, capacity), capacity)
    starts = F.array(*[F.lit(int(x)) for x in np.concatenate([[0], np.cumsum(counts)[:-1]])])
    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "__part", (F.get(starts, F.col("length").cast("int")) + F.coalesce(F.sum("__n").over(earlier), F.lit(0))).alias("__before"))
    inside = Window.partitionBy("length", "__part").orderBy(F.col(f"`{id_col}`").asc_nulls_first(), "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1).join(offsets, ["length", "__part"])
    ranked = ranked.select(*[f"`{c}`" for c in pieces.columns], (F.col("__before") + F.col("__rank")).alias("__rank"))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = ranked.select(*[f"`{c}`" for c in names], "__rank")
    schema = pieces.select(*[f"`{c}`" for c in names], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(slots["before"], rank, side="right") - 1
            inner, times = rank - slots["before"][at], slots["times"][at]
            columns = [*batch.columns[: len(names)], pa.array(slots["first"][at] + inner // times), pa.array(slots["place"][at] + inner % times * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most capacity ids; see token_pieces and pack_pieces.

    Only documents of more ids are cut. Rows with equal ids are documents of their own; an empty table gives an empty table.
    """
    pieces = written(token_pieces(df, tokenizer_json, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack_pieces(pieces, capacity, id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences of pieces packed with_ids: sequence_id, ids array<int>, and spans of (id, piece, offset, length) in order. A group has capacity rows at most."""
    rows = F.array_sort(F.collect_list(F.struct("offset", F.col(f"`{id_col}`").alias(id_col), "piece", "length", "ids")))
    found = packed.groupBy("sequence_id").agg(rows.alias("r"))
    spans = F.transform("r", lambda x: F.struct(x[id_col].alias(id_col), x.piece.alias("piece"), x.offset.alias("offset"), x.length.alias("length")))
    return found.select("sequence_id", F.flatten("r.ids").alias("ids"), spans.alias("spans"))
