"""N-gram Jaccard join with PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import bound_arrow_batches, components, discard, written

#: Each group of the domain has three parts; a signature covers two of them, so it survives one difference in a group.
PARTS = 3
#: Sets that fill too few groups under one partition of the domain try the next, up to so many.
PARTITIONS = 8
#: Shingles on one side of a verification task. A larger cluster is cut into parts, and a task takes a pair of parts.
MAX_SIDE = 500_000
#: Tested pairs that a task remembers; beyond them it forgets and may test a pair again.
REMEMBERED = 500_000
#: A signature of more sets than this is heavy. Sets that can do without their heavy signatures aren't candidates by them.
LIGHT = 4
#: Rounds in which such sets leave, after which others can. Fewer or more only change how many candidates are tested.
ROUNDS = 1
#: Shingles of a set for each bin of its histogram.
BIN_SHINGLES = 8
#: Sets that succeed under no partition give all subsets left after the allowed deletions, where a band has at most so many.
MAX_SUBSETS = 1000

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@dataclass(frozen=True)
class Scheme:
    """Sets of words-word shingles link when den * |A & B| >= num * |A | B|.

    An instance i serves the sizes of band i and those of the band below that can link with them: a set of s shingles
    takes part in the instance of its own band and, if it can link with the least size of the next band, in
    that one's. Two sets that link differ in at most differences(i) shingles, i being the larger one's band.
    """

    words: int = 3
    num: int = 90
    den: int = 100

    @property
    def ratio(self) -> float:
        """Of a band's ends: wide enough that a set's partners are in its band and the two beside it."""
        return 1.35 * 0.9 * self.den / self.num

    def links(self, common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
        return self.den * common >= self.num * (a + b - common)

    @property
    def bands(self) -> np.ndarray:
        """Least size of each band."""
        return _bands(self)

    def differences(self, band: np.ndarray) -> np.ndarray:
        top = self.bands[band + 1] - 1
        return 2 * top * (self.den - self.num) // (self.den + self.num)

    def instances(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band of each size, and whether it takes part in the instance above too."""
        band = np.searchsorted(self.bands, sizes, side="right") - 1
        return band, sizes * self.den >= self.bands[band + 1] * self.num


@lru_cache(maxsize=16)
def _bands(scheme: Scheme) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(int(max(out[-1] * scheme.ratio, out[-1] * scheme.den / scheme.num)) + 1)
    return np.array(out, np.int64)


def needed_groups(differences: np.ndarray) -> np.ndarray:
    """With so many groups, one of them has at most one of the differences."""
    return differences // 2 + 1


# -- shingles -------------------------------------------------------------------------------------------------------


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of texts, sorted within each, and how many each has.

    data: the bytes of all texts; ends: the place where each begins, and the end of the last. Words are runs of other bytes than
    0x20 and 0x09-0x0D, after A-Z became a-z.
    """
    n = len(ends) - 1
    data = np.frombuffer(data.tobytes().translate(_LOWER) + bytes(8), np.uint8)
    size = len(data) - 8
    # flips between blank and word, with a blank thought before each text's first byte
    word = ~_BLANK[data[:size]]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < size)]
    starts[edge] = word[edge]
    stops[edge - 1] = word[edge - 1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, ends)
    counts = np.diff(first)
    hashes = _word_hashes(data, starts, stops)
    full = np.maximum(counts - words + 1, 0)
    got = np.where(counts > 0, np.maximum(full, 1), 0)
    at = np.concatenate([[0], np.cumsum(got)])
    h = np.zeros(at[-1], np.uint64)
    if full.any():
        begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full) + np.arange(full.sum())
        place = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full) + np.arange(full.sum())
        h[place] = _chain([hashes[begin + i] for i in range(words)])
    for k in range(1, words):
        some = np.flatnonzero(counts == k)
        h[at[some]] = _chain([hashes[first[some] + i] for i in range(k)])
    for i in np.flatnonzero(got > 1).tolist():
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][got > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return h[new], kept[at[1:]] - kept[at[:-1]]


def _word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word, taken in steps of eight bytes; data has eight bytes beyond the last word."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = stops - starts
    out = mixed(left.astype(np.uint64))
    live, at = np.arange(len(starts)), starts
    keep = _U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * np.arange(8, -1, -1).astype(np.uint64) % _U(64))
    keep[0] = _U(0)
    keep[8] = _U(0xFFFFFFFFFFFFFFFF)
    while len(live):
        size = np.minimum(left, 8)
        out[live] = mixed(out[live] * _U(0xA0761D6478BD642F) + (eight[at] & keep[size]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def _chain(words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = mixed(h * _U(0xA0761D6478BD642F) + w)
    return h


def set_hashes(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; equal sets have equal ones."""
    out = []
    for salt in (_U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A47)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ salt))])
        ends = np.concatenate([[0], np.cumsum(counts)])
        out.append(mixed(sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out[0], out[1]


# -- signatures -----------------------------------------------------------------------------------------------------


def group_count(differences: np.ndarray) -> np.ndarray:
    """Groups of a partition: some more than needed, as some stay empty, and as heavy ones can be done without."""
    need = needed_groups(differences)
    return need + need // 5 + 2


def signatures(
    h: np.ndarray, counts: np.ndarray, scheme: Scheme, only: frozenset[int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, instance, margin) of all sets, in no order, of all instances or only some. Two different sets that link share a signature.

    Under a partition of the domain into groups of three parts, a set gives one signature for each two parts of a group that
    aren't both empty. If a set has needed_groups groups with at most one empty part, every set that links with it shares a signature
    with it. A set that hasn't tries the next partition as well, so of two sets that link, both take part in the partition that the first
    of them succeeds in. margin is by how many groups a set has more than it needs under the partition it succeeds in: after
    any so many signatures of that partition are taken from the set, it still shares one of the others with every set that links with it. Other signatures have
    margin -1: none of them can be spared. Sets that never succeed give all their subsets after up to the allowed number of
    deletions, two that link having their intersection in common; where these would be too many (bands of over MAX_SUBSETS), one signature of their instance.
    """
    band, above = scheme.instances(counts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    found: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    where: list[np.ndarray] = []
    margins: list[np.ndarray] = []

    def give(sig: np.ndarray, owner: np.ndarray, instance: np.ndarray, margin: np.ndarray) -> None:
        found.append(sig)
        owners.append(owner)
        where.append(instance)
        margins.append(margin)

    for step in (0, 1):
        ok = counts > 0
        if step:
            ok &= above
        instance = band + step
        if only is not None:
            ok &= np.isin(instance, list(only))
        allowed = np.where(ok, scheme.differences(np.maximum(instance, 0)), 0)
        live = np.flatnonzero(ok & (allowed > 0))
        for attempt in range(PARTITIONS):
            if not len(live):
                break
            sig, owner, margin = _under(h, ends, live, instance[live], allowed[live], attempt)
            spare = np.full(len(counts), -1)
            spare[live] = np.maximum(margin, -1)
            give(sig, owner, instance[owner], spare[owner])
            live = live[margin < 0]
        few = [i for i in live.tolist() if _subsets(scheme, int(instance[i])) <= MAX_SUBSETS]
        for i in few:
            sig = _deletions(h[ends[i] : ends[i + 1]], int(allowed[i]), int(instance[i]))
            give(sig, np.full(len(sig), i), np.full(len(sig), instance[i]), np.full(len(sig), -1))
        live = np.setdiff1d(live, few)
        if len(live):
            give(mixed(instance[live].astype(np.uint64) ^ _U(0x5851F42D4C957F2D)), live, instance[live], np.full(len(live), -1))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners), np.concatenate(where), np.concatenate(margins)


def _subsets(scheme: Scheme, instance: int) -> int:
    """Subsets that the largest set of an instance has after the allowed deletions."""
    top, allowed = int(scheme.bands[instance + 1] - 1), int(scheme.differences(np.array(instance)))
    return sum(comb(top, j) for j in range(allowed + 1))


def _deletions(h: np.ndarray, allowed: int, instance: int) -> np.ndarray:
    one = mixed(h ^ _U(0x8EBC6AF09C88C6E3))
    lost = [one[list(out)].sum(dtype=np.uint64) for j in range(min(allowed, len(h) - 1) + 1) for out in combinations(range(len(h)), j)]
    return mixed((one.sum(dtype=np.uint64, keepdims=True) - np.array(lost, np.uint64)) ^ mixed(np.full(1, instance + 0x3C6EF372, np.uint64)))


def nodes(k1: np.ndarray, instance: np.ndarray) -> np.ndarray:
    """A number for each set in an instance: what signatures link. So clusters don't grow from one instance to the next."""
    return mixed(k1.view(np.uint64) ^ mixed(instance.astype(np.uint64) + _U(0x1D8AF066))).view(np.int64)


def _under(h, ends, live, instance, allowed, attempt):
    need = needed_groups(allowed)
    groups = group_count(allowed)
    sizes = ends[live + 1] - ends[live]
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - ends[live], sizes)
    x = mixed(h[at] ^ mixed(np.full(1, 77 + attempt, np.uint64)))
    count = np.repeat(groups, sizes).astype(np.uint64)
    group = ((x >> _U(32)) * count) >> _U(32)
    part = (x & _U(0xFFFFFFFF)) % _U(PARTS)
    slot_of = np.concatenate([[0], np.cumsum(groups * PARTS)])
    slot = np.repeat(slot_of[:-1], sizes) + (group * _U(PARTS) + part).astype(np.int64)
    sums = np.zeros(slot_of[-1], np.uint64)
    np.add.at(sums, slot, mixed(x ^ _U(0x6A09E667F3BCC909)))
    filled = (np.bincount(slot, minlength=slot_of[-1]) > 0).reshape(-1, PARTS)
    sums = sums.reshape(-1, PARTS)
    owner = np.repeat(np.arange(len(live)), groups)
    number = np.arange(len(owner)) - np.repeat(slot_of[:-1] // PARTS, groups)
    margin = np.bincount(owner, weights=filled.sum(axis=1) >= PARTS - 1, minlength=len(live)).astype(np.int64) - need
    tag = mixed((instance[owner].astype(np.uint64) << _U(40)) ^ (number.astype(np.uint64) << _U(8)) ^ _U(attempt))
    out, whose = [], []
    for left_out in range(PARTS):
        p, q = [i for i in range(PARTS) if i != left_out]
        some = filled[:, p] | filled[:, q]
        value = mixed(sums[:, p] + mixed(sums[:, q] + _U(1)) + mixed(tag + _U(left_out)))
        out.append(value[some])
        whose.append(live[owner[some]])
    return np.concatenate(out), np.concatenate(whose), margin


# -- histograms -----------------------------------------------------------------------------------------------------


def _bins(scheme: Scheme, instance: np.ndarray) -> np.ndarray:
    """Bins of an instance's histograms: a power of two, so that those of more bins can be folded to fewer."""
    top = scheme.bands[instance + 1] - 1
    return 1 << np.ceil(np.log2(np.maximum(top / BIN_SHINGLES, 1))).astype(np.int64)


def histograms(h: np.ndarray, counts: np.ndarray, scheme: Scheme) -> list[bytes]:
    """How many shingles of each set fall into each bin (a byte, full at 255), in the bins of the instance above its band."""
    band, _ = scheme.instances(np.maximum(counts, 1))
    bins = _bins(scheme, band + 1)
    ends = np.concatenate([[0], np.cumsum(bins)])
    x = mixed(h ^ _U(0x5B8D3C1E9F264A77))
    slot = np.repeat(ends[:-1], counts) + (x & (np.repeat(bins, counts) - 1).astype(np.uint64)).astype(np.int64)
    filled = np.minimum(np.bincount(slot, minlength=ends[-1]), 255).astype(np.uint8)
    return [filled[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def within_histograms(a: list[bytes], b: list[bytes], instance: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Can the sets of these histograms differ in as few shingles as their instance allows? Bins differ by no more than the sets do, so a pair that links always passes."""
    bins, allowed = _bins(scheme, instance), scheme.differences(instance)
    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = (np.frombuffer(v, np.uint8).reshape(-1, bins[i]).sum(axis=0, dtype=np.int64) for v in (x, y))
        out[i] = np.abs(p - q).sum() <= allowed[i]
    return out


# -- verification ---------------------------------------------------------------------------------------------------


def linked_groups(
    sets: list[np.ndarray], h: np.ndarray, counts: np.ndarray, scheme: Scheme, only: int | None = None
) -> np.ndarray:
    """For each set the least number of a set in its component, links being exact; candidates share a signature.

    Sets that can do without their heavy signatures leave the buckets of these. Members of a signature's bucket are tested
    with its first member, then those that are still apart with all others of the bucket; pairs that already hang together aren't tested.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def test(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a == b:
            return
        m, n = len(sets[i]), len(sets[j])
        if scheme.den * min(m, n) < scheme.num * max(m, n):
            return
        small, large = (sets[i], sets[j]) if m <= n else (sets[j], sets[i])
        place = np.searchsorted(large, small)
        place[place == len(large)] = 0
        if scheme.links(int((large[place] == small).sum()), m, n):
            parent[max(a, b)] = min(a, b)

    sig, owner, _, margin = signatures(h, counts, scheme, None if only is None else frozenset([only]))
    order = np.lexsort((owner, sig))
    sig, owner, margin = sig[order], owner[order], margin[order]
    _, bucket, size = np.unique(sig, return_inverse=True, return_counts=True)
    heavy = (size[bucket] > LIGHT) & (margin >= 0)
    burden = np.bincount(owner[heavy], minlength=len(sets))
    kept = ~(heavy & (burden[owner] <= margin))
    sig, owner = sig[kept], owner[kept]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    begin = np.flatnonzero(new)
    bucket = np.cumsum(new) - 1
    lead = owner[begin][bucket]
    pairs = np.unique(np.column_stack([lead, owner])[lead != owner], axis=0)
    for i, j in pairs.tolist():
        test(i, j)
    n = len(sets)
    tested = {i * n + j for i, j in pairs[:REMEMBERED].tolist()}
    size = np.diff(np.append(begin, len(sig)))
    for k in np.flatnonzero(size > 2).tolist():
        members = owner[begin[k] : begin[k] + size[k]].tolist()
        apart: dict[int, list[int]] = {}
        for m in members:
            apart.setdefault(root(m), []).append(m)
        if len(apart) < 2:
            continue
        piles = list(apart.values())
        for x, some in enumerate(piles):
            for others in piles[x + 1 :]:
                for i in some:
                    for j in others:
                        pair = min(i, j) * n + max(i, j)
                        if pair not in tested:
                            if len(tested) >= REMEMBERED:
                                tested.clear()
                            tested.add(pair)
                            test(i, j)
    return np.array([root(i) for i in range(len(sets))], np.int64)


# -- the operator ---------------------------------------------------------------------------------------------------


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _dealt(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a batch's rows (sig, node) go, and which of them are known to be heavy: map-side work on common signatures. LIGHT + 1 rows of a signature go to its key and
    tell there that it is heavy; what a batch has beyond them goes anywhere.
    """
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    first = np.searchsorted(s, s)
    known = np.zeros(len(sig), bool)
    known[order] = np.arange(len(s)) - first > LIGHT
    return np.where(known, mixed(sig ^ node.view(np.uint64)), sig), known


def _light_pairs(rows: DataFrame) -> DataFrame:
    """(u, v): all pairs of nodes of each signature in rows(sig, node), of which there are at most LIGHT."""
    several = rows.groupBy("sig").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda x: F.transform(F.filter("nodes", lambda y: y > x), lambda y: F.struct(y.alias("u"), x.alias("v")))))
    return several.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def _turns(weights: dict[int, int], slices: int) -> list[tuple[frozenset[int], int, int]]:
    """(instances, part, parts): turns of about equal numbers of signatures. Neighbouring instances share a turn; one with
    more than a turn's worth is dealt over several by the signature.
    """
    most = max(1, sum(weights.values()) / slices)
    out: list[tuple[frozenset[int], int, int]] = []
    pile: list[int] = []
    for i in sorted(weights):
        if pile and sum(weights[j] for j in pile) + weights[i] > most:
            out.append((frozenset(pile), 0, 1))
            pile = []
        if weights[i] > most:
            parts = -int(-weights[i] // most)
            out += [(frozenset([i]), part, parts) for part in range(parts)]
        else:
            pile.append(i)
    return [*out, (frozenset(pile), 0, 1)] if pile else out


def shingle_groups(
    df: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text", slices: int = 1, leads: bool = False
) -> DataFrame:
    """Components of the documents whose shingle sets link: id_col, n_shingles long, component_id long (least id reachable). With leads also
    mark long, the text's xxhash64 (null as empty), and lead boolean: is this the one document of its component with the least id and mark?

    A text with fewer words than a shingle has one shingle, all its words; one without words, or null, has none and links with nothing. A
    row with a null id has a null component and leads. A document is an id with a text: rows with equal ids and other texts are documents
    of their own, and repeated rows are one. An empty table stays empty; other columns, also of names used here, are ignored.

    Equal sets become one representative, whose text is written once; all else works on these. They give their signatures in some
    slices turns by size, which bounds what is shuffled at once. Sets meet at their signatures; of a common one, each batch sends
    LIGHT + 1 rows there and spreads the others, so its task gets a small part of them. The pairs of a light signature (at most six) are tested
    by small histograms, which no pair that links can fail. Of the heavy ones (passages and lines that many documents share, and large groups of near copies)
    the sets that can spare all theirs are taken out, in rounds, as signatures become light by that; the rest has edges to its least. Components of the edges are
    clusters that hold every link. At last the texts of representatives in clusters go to their cluster's task, which tests
    candidates exactly and gives a spanning forest. A cluster of over MAX_SIDE shingles is cut into parts, and each
    pair of parts is a task. Nothing gathers pairs, a signature's sets or a component.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark, 4 << 20)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = shingle_sets(*_texts(batch.column("text")), scheme.words)
            k1, k2 = set_hashes(h, counts)
            band, above = scheme.instances(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(counts), pa.array(k1), pa.array(k2), pa.array(band), pa.array(nodes(k1, band)),
                 pa.array(nodes(k1, band + 1), mask=~above), pa.array(histograms(h, counts, scheme), pa.binary())],
                names=["id", "mark", "n", "k1", "k2", "band", "node0", "node1", "bins"],
            )

    def sign(only: frozenset[int], part: int, parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # rows with equal id and text lie side by side
            for batch in batches:
                h, counts = shingle_sets(*_texts(batch.column("text")), scheme.words)
                k1, _ = set_hashes(h, counts)
                fresh = np.array([k not in seen and not seen.add(k) for k in k1.tolist()], bool)
                h, counts, k1 = h[np.repeat(fresh, counts)], counts[fresh], k1[fresh]
                sig, owner, instance, margin = signatures(h, counts, scheme, only)
                if parts > 1:
                    mine = (sig >> _U(20)) % _U(parts) == part
                    sig, owner, instance, margin = sig[mine], owner[mine], instance[mine], margin[mine]
                node = nodes(k1[owner], instance)
                key, known = _dealt(sig, node)
                for at in range(0, len(sig), 1 << 18):
                    some = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[some].view(np.int64)), pa.array(node[some]), pa.array(margin[some].astype(np.int32)), pa.array(sig[some].view(np.int64), mask=~known[some])],
                        names=["key", "node", "margin", "sig"],
                    )

        return run

    sets = written(docs.mapInArrow(describe, "id long, mark long, n long, k1 long, k2 long, band long, node0 long, node1 long, bins binary"), "shingle_sets")
    key = ["k1", "k2", "n"]
    some = sets.where("n > 0 AND id IS NOT NULL")
    first = some.groupBy(*key).agg(F.min(F.struct("id", "mark", "band", "node0", "node1", "bins")).alias("rep"))
    reps = written(first.select(*key, "rep.*").withColumn("rep", F.monotonically_increasing_id()), "shingle_reps")
    texts = docs.where("id IS NOT NULL").join(reps.select("id", "mark", "rep", "band", "node1").hint("shuffle_hash"), ["id", "mark"])
    texts = written(texts.select("rep", "band", F.col("node1").isNotNull().alias("above"), "text"), "shingle_texts")
    placed = reps.select("rep", "n", "bins", F.explode(F.array(
        F.struct(F.col("band").alias("instance"), F.col("node0").alias("node"), F.lit(True).alias("own")),
        F.struct((F.col("band") + 1).alias("instance"), F.col("node1").alias("node"), F.lit(False).alias("own")),
    )).alias("p"))
    placed = placed.select("rep", "n", "bins", "p.*").where("node IS NOT NULL")
    # one row for each band; an instance without an allowed difference has no signatures
    members = {r.instance: r["count"] for r in placed.groupBy("instance").count().collect()}
    weights = {i: 3 * n * int(group_count(scheme.differences(np.array(i)))) for i, n in members.items() if scheme.differences(np.array(i)) > 0}
    light: list[DataFrame] = []
    heavy: list[DataFrame] = []
    used: list[DataFrame] = [texts]
    for only, part, parts in _turns(weights, slices):
        mine = texts.where(F.col("band").isin(*only) | F.col("above") & (F.col("band") + 1).isin(*only)).select("text")
        signed = mine.mapInArrow(sign(only, part, parts), "key long, node long, margin int, sig long")
        same = Window.partitionBy("key")
        met = signed.withColumn("n", F.count("*").over(same)).where("n > 1 OR sig IS NOT NULL")
        many = F.col("sig").isNotNull() | (F.col("n") > LIGHT)
        found = written(met.select(F.coalesce("sig", "key").alias("sig"), "node", "margin", many.alias("many")), "candidates")
        heavy.append(found.where("many").select("sig", "node", "margin"))
        light.append(written(_light_pairs(found.where("NOT many")), "light_pairs"))
        used += [found, light[-1]]
    if not weights:
        heavy = [spark.createDataFrame([], "sig long, node long, margin int")]
    bound = reduce(DataFrame.union, heavy)
    for _ in range(ROUNDS):
        burdens = bound.where("margin >= 0").groupBy("node").agg(F.count("*").alias("n"), F.max("margin").alias("spare"))
        free = burdens.where("n <= spare").select(F.col("node").alias("freed"))
        left = bound.join(free, (bound["node"] == free["freed"]) & (bound["margin"] >= 0), "left_anti")
        sizes = left.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
        left = written(left.join(sizes, "sig"), "heavy_candidates")
        light.append(written(_light_pairs(left.where(F.col("n") <= LIGHT)), "light_pairs"))
        bound = left.where(F.col("n") > LIGHT).drop("n")
        used += [left, light[-1]]
    lowest = bound.groupBy("sig").agg(F.min("node").alias("lead"))
    edges = bound.join(lowest, "sig").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            yield batch.select(["u", "v"]).filter(pa.array(within_histograms(a, b, batch.column("instance").to_numpy(), scheme)))

    pairs = reduce(DataFrame.union, light).distinct()
    bins = placed.select("node", "bins", "instance")
    pairs = pairs.join(bins.select(F.col("node").alias("u"), F.col("bins").alias("a"), "instance"), "u").join(bins.select(F.col("node").alias("v"), F.col("bins").alias("b")), "v")
    clusters = components(pairs.select("u", "v", "a", "b", "instance").mapInArrow(near, "u long, v long").union(edges))
    clustered = written(
        placed.join(clusters, "node").select("rep", "n", "instance", "own", F.col("component").alias("cluster")), "shingle_clusters"
    )
    parts = clustered.groupBy("cluster", "instance").agg(F.ceil(F.sum("n") / MAX_SIDE).cast("int").alias("parts"), F.count("*").alias("size"), F.max("own").alias("own"))
    # a link belongs to the instance of its larger set's band: clusters with none of that band have nothing to test
    parts = parts.where("size > 1 AND own").drop("own")
    dealt = clustered.join(parts, ["cluster", "instance"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.select("rep", "cluster", "instance", "part", "parts")
    sent = texts.select("rep", "text").join(dealt.hint("shuffle_hash"), "rep")
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("rep", "cluster", "instance", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "text")

    def verify(group: pa.Table) -> pa.Table:
        ids = group.column("rep").to_numpy()
        h, counts = shingle_sets(*_texts(group.column("text")), scheme.words)
        ends = np.concatenate([[0], np.cumsum(counts)])
        instance = group.column("instance")[0].as_py()
        found = linked_groups([h[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], h, counts, scheme, instance)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, found, ids)
        root = least[found]
        return pa.table({"rep": ids[ids != root], "root": root[ids != root]})

    links = written(sent.groupBy("cluster", "instance", "a", "b").applyInArrow(verify, "rep long, root long"), "shingle_links")
    for df in (*used, clustered):
        discard(df)
    groups = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    grouped = reps.join(groups, F.col("rep") == F.col("node"), "left")
    own = F.struct("id", "mark")
    least = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min(own).alias("least"))
    known = grouped.join(least, "component", "left").select(*key, F.coalesce("least", own).alias("least"))
    least = F.when(F.col("id").isNotNull(), F.coalesce("least", own))
    found = sets.join(known, key, "left").select("id", "n", "mark", least.alias("least"))
    out = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id")]
    if leads:
        out += ["mark", F.coalesce(F.col("least") == F.struct("id", "mark"), F.lit(True)).alias("lead")]
    return found.select(*out)
