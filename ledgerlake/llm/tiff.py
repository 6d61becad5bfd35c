"""TIFF media columns: walk image directories, decode strips and tiles, one row per page.

Reads either byte order, 8- and 16-bit unsigned samples, chunky or planar; compression none, PackBits, LZW
and deflate; predictor none or horizontal. Writes 8-bit strips in deflate with the horizontal predictor.

Defined cases: null bytes give one row with null page and no error; bytes that are no TIFF, or a broken
page, give a row with ``error`` and null pixels (pages before it are kept); a directory loop ends the walk
with an error; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._words import utf8

# Tags, types and codes of the file format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I"}


@dataclass
class Page:
    number: int
    pixels: np.ndarray  # height, width, samples


def packbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data doesn't begin with a clear code")
        entry = table[code] if code < len(table) else last + last[:1] if last and code == len(table) else None
        if entry is None:
            raise ValueError("bad LZW code")
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        if len(out) >= size:
            break
    return bytes(out)


def unpack(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        out = data
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompress(data)
    elif kind == PACKBITS:
        out = packbits(data, size)
    elif kind == LZW:
        out = lzw(data, size)
    else:
        raise ValueError(f"compression {kind}")
    if len(out) < size:
        raise ValueError("a block is short")
    return out[:size]


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                room = struct.calcsize(TYPES[kind]) * count
                place = at + 10 + 12 * k if room <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, place))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decode_page(data: bytes, order: str, tags: dict[int, list[int]]) -> np.ndarray:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, planar = set(tags.get(BITS, [1])), one(PLANAR, 1) == 2
    if not width or not height or len(bits) != 1 or not bits <= {8, 16}:
        raise ValueError("only 8- and 16-bit samples are read")
    kind = np.dtype(f"{order}u{bits.pop() // 8}")
    tiled = TILE_AT in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS, height)))
    at, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    across, down, depth = -(-width // bw), -(-height // bh), 1 if planar else samples
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (a, n) in enumerate(zip(at, sizes)):
        plane, block = divmod(k, across * down)
        y, x = block // across * bh, block % across * bw
        rows = bh if tiled else min(bh, height - y)
        raw = unpack(data[a : a + n], one(COMPRESSION, NONE), rows * bw * depth * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(rows, bw, depth)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        part = part[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + depth] = part
    return out


def decode(data: bytes) -> Iterator[Page]:
    for number, (order, tags) in enumerate(directories(data)):
        yield Page(number, decode_page(data, order, tags))


def encode(pages: list[np.ndarray], strip_bytes: int = 1 << 16, level: int = 1) -> bytes:
    """Little-endian file of 8-bit pages (height, width, samples) in deflated, differenced strips."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        height, width, samples = page.shape
        rows = max(1, strip_bytes // (width * samples))
        step = page.copy()
        step[:, 1:] -= page[:, :-1]
        strips = [zlib.compress(step[y : y + rows].tobytes(), level) for y in range(0, height, rows)]
        places = []
        for s in strips:
            places.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (STRIP_AT, 4, places), (SAMPLES, 3, [samples]), (ROWS, 4, [rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (PLANAR, 3, [1]), (PREDICTOR, 3, [2])]
        fields = b""
        for tag, kind, values in tags:
            body = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(body) > 4:
                place = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack("<I", place)
            fields += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(fields)
        out += struct.pack("<H", len(tags)) + fields + b"\0\0\0\0"
    return bytes(out)


def average_hash(pixels: np.ndarray, side: int = 8) -> str:
    """64 bits as hex: block means of an 8 x 8 grid over the page, against the mean of all."""
    grey = pixels.mean(axis=2)
    cut = [np.unique(np.arange(side) * n // side) for n in grey.shape]
    sums = np.add.reduceat(np.add.reduceat(grey, cut[0], 0), cut[1], 1)
    area = np.outer(*(np.diff(np.append(c, n)) for c, n in zip(cut, grey.shape)))
    bits = np.zeros((side, side), bool)
    bits[: len(cut[0]), : len(cut[1])] = sums / area > grey.mean()
    return np.packbits(bits).tobytes().hex()


def read_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """Other columns of ``df``, and page int (from 0), width, height, samples, bits int, pixels binary, error string."""
    rest = [c for c in df.columns if c != column]
    rows = df.select(F.col(column).alias("_media"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def work(batches):
        for b in batches:
            for k in range(b.num_rows):
                data, found, error = b.column(0)[k].as_py(), [], None
                if data is not None:
                    try:
                        for p in decode(data):
                            x = p.pixels
                            found.append((p.number, x.shape[1], x.shape[0], x.shape[2], x.itemsize * 8, x.tobytes(), None))
                    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"
                if error or not found:
                    found.append((len(found) if error else None, None, None, None, None, None, error))
                own = [b.column(i).take(pa.array([k] * len(found))) for i in range(1, b.num_columns)]
                col = list(zip(*found))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in col[:5]), pa.array(col[5], pa.binary()), pa.array(col[6], pa.string()), *own], ["page", "width", "height", "samples", "bits", "pixels", "error", *b.schema.names[1:]])

    out = rows.mapInArrow(work, f"page int, width int, height int, samples int, bits int, pixels binary, error string{kinds}")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)], "page", "width", "height", "samples", "bits", "pixels", "error")


def store_texts(docs: DataFrame, width: int = 576) -> DataFrame:
    """Each text of ``docs(doc_id, text)`` as a page of ``width`` samples a row (padded with 255, null: empty), read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """

    def work(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            rows = []
            for s, e in zip(at[:-1], at[1:]):
                n = int(e - s)
                size = max(1, -(-n // width)) * width
                payload = np.full(size, 255, np.uint8)
                payload[:n] = data[s:e]
                media = encode([payload.reshape(-1, width, 1)])
                (page,) = decode(media)
                back = page.pixels.tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), average_hash(page.pixels)))
            col = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(col, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
