"""TIFF: walk image directories, decode strips or tiles, undo predictors, one row per page.

``read_pages`` takes a file's bytes and gives its pages; ``tiff_pages`` does so for a binary column. Compressions 1
(none), 5 (LZW), 8 and 32946 (deflate) and 32773 (PackBits); 8 or 16 bits a sample; predictor 1 or 2; either byte order;
strips or tiles; chunky or planar samples. ``write_tiff`` stores pages in any of these (8 bits, chunky).

Defined cases: a null or empty value is no file and gives no pages; one that cannot be read gives, after the pages in
front of the fault, one row with page null and the reason in ``error``, whatever is broken: sizes of nothing or beyond
LARGEST bytes a page, tags of another kind, places outside the file, data that decode to less than their strip or tile
(what they hold beyond it is not decoded). A directory that points back to an earlier one ends the walk. Repeated rows
get equal rows, an empty table none. Values are read one by one and pages leave one by one, so memory follows the largest
page. Columns besides the key and the value are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", 32946: "deflate", PACKBITS: "packbits"}
#: Bytes of a page's pixels.
LARGEST = 1 << 30
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4)}


class TiffError(ValueError):
    pass


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    pixels: bytes


# --- decoders and encoders of one strip or tile


def packbits_decode(data: bytes, need: int = LARGEST) -> bytes:
    """The first ``need`` bytes, or a few more; all if there are fewer."""
    out, at, n, made = [], 0, len(data), 0
    while at < n and made < need:
        c = data[at]
        made += c + 1 if c < 128 else 257 - c
        if c < 128:
            out.append(data[at + 1 : at + 2 + c])
            at += 2 + c
        elif c > 128:
            out.append(data[at + 1 : at + 2] * (257 - c))
            at += 2
        else:
            at += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as repeats, the rest in literals of up to 128."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(a)]))
    long = ends - starts >= 3
    out, at = [], 0

    def literal(to: int) -> None:
        for i in range(at, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(bytes([len(part) - 1]) + part)

    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        literal(s)
        for i in range(s, e, 128):
            n = min(128, e - i)
            out.append(bytes([257 - n if n > 1 else 0, data[s]]))
        at = e
    literal(len(data))
    return b"".join(out)


#: Width of the k-th code (from 0) behind a clear, one code early; those behind the last stay at 12.
_WIDTHS = np.searchsorted([512, 1024, 2048], 258 + np.arange(4096), side="right") + 9
_FULL = 4094
_BITS = np.arange(11, -1, -1)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, one code early; clears when the table is full."""
    codes, clears = [256], [0]
    if data:
        known: dict[int, int] = {}  # code of a word << 8 | next byte -> code of both
        nxt, get, put = 258, known.get, codes.append
        w = data[0]
        for c in memoryview(data)[1:]:
            key = w << 8 | c
            n = get(key)
            if n is not None:
                w = n
                continue
            put(w)
            w, known[key] = c, nxt
            nxt += 1
            if nxt == _FULL:
                clears.append(len(codes))
                put(256)
                known.clear()
                nxt = 258
        put(w)
    codes.append(257)
    all_, place = np.array(codes), np.arange(len(codes))
    since = place - np.array(clears)[np.searchsorted(clears, place) - 1]  # of each code, since the clear in front of it
    widths = np.where(place == 0, 9, _WIDTHS[np.maximum(since - 1, 0)])
    bits = (all_[:, None] >> _BITS & 1).astype(np.uint8)
    return np.packbits(bits[_BITS < widths[:, None]]).tobytes()


def lzw_decode(data: bytes, need: int = LARGEST) -> bytes:
    """The first ``need`` bytes; all if there are fewer."""
    raw = np.frombuffer(bytes(data) + b"\0\0", np.uint8).astype(np.int64)
    triples = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    words, at, since, out, made, last = list(base), 0, 0, [], 0, b""
    while made < need and at < 8 * len(data):
        widths = _WIDTHS[np.minimum(np.arange(since, since + 1024), 4095)]
        places = at + np.cumsum(widths) - widths
        places = places[places + widths <= 8 * len(data)]
        if not len(places):
            break
        widths = widths[: len(places)]
        codes = triples[places >> 3] >> (24 - widths - (places & 7)) & ((1 << widths) - 1)
        marks = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(marks[0]) if len(marks) else len(codes)
        n = len(words)
        for code in codes[:stop].tolist():
            if code < n:
                word = words[code]
            elif code == n and last:
                word = last + last[:1]
            else:
                raise TiffError(f"LZW code {code} of {n}")
            out.append(word)
            made += len(word)
            if last and n < 4096:
                words.append(last + word[:1])
                n += 1
            last = word
        if not len(marks):
            at, since = int(places[-1] + widths[-1]), since + len(codes)
            continue
        if codes[stop] == 257:
            break
        at, since, words, last = int(places[stop] + widths[stop]), 0, list(base), b""
    return b"".join(out)[:need]


def decode(data: bytes, compression: int, need: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, need)
    if compression == LZW:
        return lzw_decode(data, need)
    if compression in (DEFLATE, 32946):
        try:
            return zlib.decompressobj().decompress(data, need)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    raise TiffError(f"compression {compression}")


def encode(data: bytes, compression: int) -> bytes:
    return {NONE: lambda: data, PACKBITS: lambda: packbits_encode(data), LZW: lambda: lzw_encode(data), DEFLATE: lambda: zlib.compress(data, 1)}[compression]()


# --- files


def read_pages(blob: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(blob[:2]))
    if not order or len(blob) < 8 or struct.unpack(order + "H", blob[2:4])[0] != 42:
        raise TiffError("not a TIFF")
    (at,) = struct.unpack(order + "I", blob[4:8])
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(blob, at, order)
        yield _page(blob, tags, order, len(seen) - 1)


def _directory(blob: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    try:
        (n,) = struct.unpack_from(order + "H", blob, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
            if kind in KINDS:
                code, size = KINDS[kind]
                place = at + 10 + 12 * i
                if size * count > 4:
                    (place,) = struct.unpack_from(order + "I", blob, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", blob, place)
        return tags, struct.unpack_from(order + "I", blob, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError(f"directory at {at}: {e}") from e


def _page(blob: bytes, tags: dict[int, tuple], order: str, number: int) -> Page:
    def one(tag: int, default: int = 0) -> int:
        value = (tags.get(tag) or (default,))[0]
        if not isinstance(value, int):
            raise TiffError(f"tag {tag} is no number")
        return value

    width, height, samples, bits = one(256), one(257), one(277, 1), one(258, 1)
    compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
    if not width or not height or not samples:
        raise TiffError("no width, height or samples")
    if width * height * samples * bits // 8 > LARGEST:
        raise TiffError(f"{width} x {height} x {samples} is too large")
    if bits not in (8, 16) or predictor not in (1, 2):
        raise TiffError(f"{bits} bits, predictor {predictor}")
    tiled = 322 in tags
    w, h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    offsets, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not w or not h or not offsets or not counts or len(offsets) != len(counts) or not all(isinstance(x, int) for x in (*offsets, *counts)):
        raise TiffError("no strips or tiles")
    if w * h * samples * bits // 8 > LARGEST:
        raise TiffError(f"tiles of {w} x {h} are too large")
    kind = np.dtype("u1" if bits == 8 else order + "u2")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < planes * across * down:
        raise TiffError(f"{len(offsets)} of {planes * across * down} strips or tiles")
    image = np.zeros((height, width, samples), kind)
    for i in range(planes * across * down):
        plane, cell = divmod(i, across * down)
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        need = rows * w * deep * kind.itemsize
        data = decode(blob[offsets[i] : offsets[i] + counts[i]], compression, need)
        if len(data) < need:
            raise TiffError(f"strip or tile {i} has {len(data)} of {need} bytes")
        part = np.frombuffer(data, kind, rows * w * deep).reshape(rows, w, deep)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        a, b = min(rows, height - y), min(w, width - x)
        image[y : y + a, x : x + b, slice(plane, plane + 1) if planar == 2 else slice(None)] = part[:a, :b]
    return Page(number, width, height, samples, bits, NAMES.get(compression, "?"), predictor, tiled, image.tobytes())


def write_tiff(pages: list[np.ndarray], compression: int, predictor: int = 1, rows: int = 32, tile: tuple[int, int] | None = None) -> bytes:
    """Little-endian; ``pages`` are (height, width, samples) of 8 bits; strips of ``rows`` rows or tiles (width, height)."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for image in pages:
        height, width, samples = image.shape
        w, h = tile or (width, rows)
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = image[y : y + h, x : x + w]
                if tile and part.shape[:2] != (h, w):
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
                data = encode(np.ascontiguousarray(part).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8] * samples), 259: (3, [compression]), 262: (3, [2 if samples == 3 else 1]), 277: (3, [samples]), 284: (3, [1]), 317: (3, [predictor])}
        tags |= {322: (4, [w]), 323: (4, [h]), 324: (4, offsets), 325: (4, counts)} if tile else {273: (4, offsets), 278: (4, [rows]), 279: (4, counts)}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{KINDS[kind][0]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                entries.append(struct.pack("<HHII", tag, kind, len(values), len(out)))
                out += raw
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


PAGES = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(df: DataFrame, key: str, blob: str) -> DataFrame:
    """One row per page of each value of the binary column ``blob``, with ``key`` (named key_ if a page's column has its
    name); an error's row comes after the good pages."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    pages = _parse_datatype_string(PAGES)
    picked = df.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{blob}`").cast("binary").alias("blob_"))
    schema = StructType([picked.schema[0], *pages.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                walk = read_pages(value) if value else iter(())
                while True:
                    try:
                        row = vars(next(walk))
                    except StopIteration:
                        break
                    except TiffError as e:
                        row = {"error": str(e)}
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).cast(out.types[0]), *(pa.array([row.get(n)], t) for n, t in zip(pages.names, out.types[1:]))], out.names)

    out = to_arrow_schema(schema)
    return picked.mapInArrow(run, schema).withColumnRenamed("key_", key + "_" * (key in pages.names))


# --- the query: texts stored as images

PIXELS, SAMPLES, PAGE_ROWS = 64, 3, 256
ROW = PIXELS * SAMPLES
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pages array<string>"


def store(data: bytes) -> bytes:
    """``data`` padded with spaces to rows of 192 bytes (64 RGB pixels), in pages of up to 256 rows.

    The padded bytes' checksum decides, at every length, between LZW strips, LZW tiles and deflate tiles with the horizontal
    predictor, PackBits strips, and deflate strips with the predictor.
    """
    data = data.ljust(max(1, -(-len(data) // ROW)) * ROW)
    image = np.frombuffer(data, np.uint8).reshape(-1, PIXELS, SAMPLES)
    pages = [image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)]
    return [
        lambda: write_tiff(pages, LZW, rows=64),
        lambda: write_tiff(pages, LZW, predictor=2, tile=(64, 64)),
        lambda: write_tiff(pages, PACKBITS, rows=32),
        lambda: write_tiff(pages, DEFLATE, predictor=2, rows=64),
        lambda: write_tiff(pages, DEFLATE, predictor=2, tile=(64, 64)),
    ][zlib.crc32(data) % 5]()


def digest(text: str) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    media = store(data)
    pages = list(read_pages(media))
    payload = b"".join(p.pixels for p in pages)
    a = np.frombuffer(payload, np.uint8)
    means = a.reshape(-1, SAMPLES).mean(axis=0, dtype=np.float64)
    hist = np.bincount(a >> 5, minlength=8)
    feature = f"{len(pages)} {pages[0].compression}{'+tiles' * pages[0].tiled} {PIXELS}x{len(a) // ROW} {'/'.join(f'{m:.3f}' for m in means)} {'/'.join(map(str, hist))}"
    each = [f"{p.page} {p.width}x{p.height}x{p.samples} {p.compression} {p.predictor} {zlib.crc32(p.pixels):08x}" for p in pages]
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, each


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(cols: list[list]) -> dict[str, list]:
        made = [digest(t) for t in cols[1]]
        return dict(zip((x.split(" ")[0] for x in SCHEMA.split(", ")), [cols[0], *map(list, zip(*made))]))

    return map_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", kernel, SCHEMA)
