"""TIFF columns: a reader that emits one row for each page, and a writer for lossless 8-bit payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.common import bound_arrow_batches

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 7: 1, 8: 2, 9: 4, 16: 8}
FIELD_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 16: "Q"}


class TiffError(ValueError):
    pass


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples_per_pixel: int
    bits: int
    compression: int
    predictor: int
    samples: bytes


# -- codecs ---------------------------------------------------------------------------------------------------------


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out = list(single), bytearray()
    width, previous, bits, held = 9, b"", 0, 0
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = list(single), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise TiffError("LZW code out of range")
        out += entry
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, size = 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    w = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if not w or w + c in table:
            w += c
            continue
        put(table[w] if len(w) > 1 else w[0])
        table[w + c] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table.clear()
            width, size = 9, 258
        w = c
    if w:
        put(table[w] if len(w) > 1 else w[0])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _decode(data: bytes, compression: int, expected: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, expected)  # what goes beyond the image is not unpacked
    raise TiffError(f"unsupported compression {compression}")


def _encode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression == DEFLATE:
        return zlib.compress(data, 6)
    raise TiffError(f"unsupported compression {compression}")


# -- reader ---------------------------------------------------------------------------------------------------------


def read_pages(data: bytes) -> Iterator[Page]:
    """Walk the image directories of a classic TIFF or BigTIFF file of either byte order.

    Grey or chunky images of 8 or 16 bits a sample, in strips or tiles. samples are the rows in order, in
    the file's byte order for 16 bits. Raises TiffError for what is broken or outside this.
    """
    try:
        yield from _read_pages(data)
    except (struct.error, IndexError, zlib.error, ValueError, KeyError) as e:
        raise e if isinstance(e, TiffError) else TiffError(f"broken file: {e}") from e


def _read_pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("image directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order, big)
        yield _page(data, tags, order, len(seen) - 1)


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
    at += 8 if big else 2
    size, head, room = (20, "HHQ", 8) if big else (12, "HHI", 4)
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        here = at + i * size
        tag, kind, count = struct.unpack_from(order + head, data, here)
        if kind not in FIELD_BYTES:
            continue
        value = here + size - room
        if FIELD_BYTES[kind] * count > room:
            (value,) = struct.unpack_from(order + ("Q" if big else "I"), data, value)
        if value + FIELD_BYTES[kind] * count > len(data):
            raise TiffError("a field lies outside the file")
        tags[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODES[kind]}", data, value)
    return tags, struct.unpack_from(order + ("Q" if big else "I"), data, at + n * size)[0]


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str, number: int) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    spp, compression, predictor = one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits = set(tags.get(BITS, (1,)))
    if len(bits) > 1 or min(bits) not in (8, 16) or spp > 1 and one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise TiffError("unsupported layout of samples")
    kind = np.dtype(np.uint8) if bits == {8} else np.dtype(np.uint16).newbyteorder(order)
    tiled = TILE_OFFSETS in tags
    if tiled:
        across, down = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if not across or not down or not width or not height:
        raise TiffError("an empty image")
    columns = -(-width // across)
    if len(offsets) < columns * -(-height // down):
        raise TiffError("parts are missing")
    if width * height * spp * kind.itemsize > 4096 * len(data) + (1 << 20):
        raise TiffError("the image is too large for its file")
    image = np.zeros((height, width, spp), kind)
    for i in range(columns * -(-height // down)):
        top, left = i // columns * down, i % columns * across
        rows = down if tiled else min(down, height - top)
        expected = rows * across * spp * kind.itemsize
        raw = _decode(data[offsets[i] : offsets[i] + counts[i]], compression, expected)
        if len(raw) < expected:
            raise TiffError("a part is too short")
        part = np.frombuffer(raw[:expected], kind).reshape(rows, across, spp)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        image[top : top + rows, left : left + across] = part[: height - top, : width - left]
    return Page(number, width, height, spp, kind.itemsize * 8, compression, predictor, image.tobytes())


# -- writer ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How a payload is stored: grey rows of width bytes, page_rows of them a page, in strips or square tiles."""

    width: int = 64
    page_rows: int = 1024
    strip_rows: int = 256
    tile: int = 0
    compression: int = DEFLATE
    predictor: int = 2


def write_payload(payload: bytes, layout: Layout = Layout()) -> bytes:
    """Store bytes, whose number is a positive multiple of the width, as a little-endian file of one or more pages."""
    if not payload or len(payload) % layout.width:
        raise TiffError("the payload is no positive multiple of the width")
    image = np.frombuffer(payload, np.uint8).reshape(-1, layout.width)
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for first in range(0, len(image), layout.page_rows):
        page = image[first : first + layout.page_rows]
        parts = [_encode(_differences(p, layout.predictor).tobytes(), layout.compression) for p in _parts(page, layout)]
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p
        counts = [len(p) for p in parts]
        entries = [(WIDTH, 4, [layout.width]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [layout.compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [layout.predictor])]
        if layout.tile:
            entries += [(TILE_WIDTH, 4, [layout.tile]), (TILE_HEIGHT, 4, [layout.tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [layout.strip_rows]), (STRIP_COUNTS, 4, counts)]
        out += b"\0" * (len(out) % 2)
        fields = b""
        for tag, kind, values in sorted(entries):
            raw = struct.pack(f"<{len(values)}{FIELD_CODES[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                raw = struct.pack("<I", where)
            fields += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _parts(page: np.ndarray, layout: Layout) -> Iterator[np.ndarray]:
    if not layout.tile:
        for top in range(0, len(page), layout.strip_rows):
            yield page[top : top + layout.strip_rows]
        return
    t = layout.tile
    full = np.zeros((-(-len(page) // t) * t, -(-page.shape[1] // t) * t), np.uint8)
    full[: len(page), : page.shape[1]] = page
    for top in range(0, len(full), t):
        for left in range(0, full.shape[1], t):
            yield full[top : top + t, left : left + t]


def _differences(part: np.ndarray, predictor: int) -> np.ndarray:
    if predictor != 2:
        return part
    out = part.copy()
    out[:, 1:] -= part[:, :-1]
    return out


# -- operators ------------------------------------------------------------------------------------------------------

PAGE_COLUMNS = "page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, samples binary, error string"


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each page of each file: the other columns of df (page columns of the same name replaced) and PAGE_COLUMNS.

    A null or broken file gives one row with null page columns and the reason in error, after the pages that could be read.
    Files are independent and pages are decoded one after the other: one pass, no shuffle.
    """
    bound_arrow_batches(df.sparkSession)
    pages = T._parse_datatype_string(PAGE_COLUMNS)
    kept = [f for f in df.schema.fields if f.name != media_col and f.name not in pages.names]
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{media_col}`"].alias("__media"))
    schema = T.StructType([*kept, *pages.fields])
    kinds = [pa.int32()] * 7 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(len(kept))):
                for row in _rows(value.as_py()):
                    head = [c.slice(i, 1) for c in batch.columns[: len(kept)]]
                    yield pa.RecordBatch.from_arrays([*head, *[pa.array([v], k) for v, k in zip(row, kinds, strict=True)]], names=schema.names)

    return source.mapInArrow(run, schema)


def _rows(media: bytes | None) -> Iterator[list]:
    if media is None:
        yield [None] * 8 + ["null"]
        return
    try:
        for p in read_pages(media):
            yield [p.page, p.width, p.height, p.samples_per_pixel, p.bits, p.compression, p.predictor, p.samples, None]
    except TiffError as e:
        yield [None] * 8 + [str(e)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes of a text (null: none), and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature_of(pages: list[Page]) -> str:
    """Pages, rows, how they were stored, and of the samples sum, sum of squares and number of different values."""
    counts = sum(np.bincount(np.frombuffer(p.samples, np.uint8), minlength=256) for p in pages)
    values = np.arange(256)
    how = f"compression={pages[0].compression};predictor={pages[0].predictor}"
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};{how};sum={int(counts @ values)};squares={int(counts @ values**2)};values={int((counts > 0).sum())}"


STORED_COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: Every compression in strips and in tiles, with and without a predictor.
LAYOUTS = tuple(Layout(compression=c, tile=tile, predictor=1 + (i + j) % 2) for i, c in enumerate((NONE, LZW, DEFLATE, PACKBITS)) for j, tile in enumerate((0, 16)))


def store_texts(df: DataFrame, text_col: str = "text", layouts: Sequence[Layout] = (Layout(),), media: bool = False) -> DataFrame:
    """Store each whole text as a TIFF file, read the file back page by page, and describe what was read.

    The text (null: empty) in UTF-8, padded by zeros to a positive multiple of 64, is the payload; its CRC-32 picks one of the layouts. A file that claims an image of
    over 4096 times its own size is refused. Adds STORED_COLUMNS, and the
    file as binary media if asked for, replacing columns of these names. Rows are independent; equal texts get equal values.
    """
    bound_arrow_batches(df.sparkSession)
    added = T._parse_datatype_string(STORED_COLUMNS + ", media binary" * media)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{text_col}`"].alias("__text"))
    schema = T.StructType([*kept, *added.fields])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(kept)):
                n, payload = payload_of(value.as_py())
                stored = write_payload(payload, layouts[zlib.crc32(payload) % len(layouts)])
                pages = list(read_pages(stored))
                back = b"".join(p.samples for p in pages)
                rows.append([n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(pages), *[stored] * media])
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=schema.names)

    return source.mapInArrow(run, schema)
