"""Media columns: PNG bytes in binary columns, read back chunk by chunk, with low-frequency cosine-transform hashes.

Encoding and decoding run in Arrow batches inside tasks; nothing but a row's own bytes is held.  Contracts: a null value is an
empty one; an empty payload is stored as one padded row; equal values give equal media and equal features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes in one IDAT chunk at most.
IDAT_BYTES = 1 << 16
#: Pixels in a scan line; a payload is padded to a multiple.
WIDTH = 576
PAD = 255


class MediaError(ValueError):
    """The stored bytes are not a PNG that this module reads, or a checksum is wrong."""


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` and as many PAD bytes as make it a positive multiple of ``width``."""
    return data + bytes([PAD]) * (width * max(1, -(-len(data) // width)) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_encode(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey image.  A line is filtered (Sub, Up) only if at least half of its residuals are zero."""
    h, w = pixels.shape
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    zeros_sub, zeros_up = (sub == 0).sum(1), (up == 0).sum(1)
    best = np.maximum(zeros_sub, zeros_up)
    kind = np.where(2 * best < w, 0, np.where(zeros_sub >= zeros_up, 1, 2)).astype(np.uint8)
    lines = np.empty((h, w + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == 0)[:, None], pixels, np.where((kind == 1)[:, None], sub, up))
    body = zlib.compress(lines.tobytes(), level)
    idat = b"".join(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + idat + _chunk(b"IEND", b"")


def _unfilter_line(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average and Paeth lines, whose pixels depend on the one to the left."""
    out, left, corner = line.tolist(), 0, 0
    for x, up in enumerate(above.tolist()):
        if kind == 3:
            left = (out[x] + (left + up) // 2) & 255
        else:
            p, q, r = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            left = (out[x] + (left if p <= q and p <= r else up if q <= r else corner)) & 255
        out[x], corner = left, up
    return np.array(out, np.uint8)


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Pixels from filtered scan lines; runs of lines of one kind are undone together."""
    out = lines.copy()
    out[kinds == 1] = np.cumsum(lines[kinds == 1], axis=1, dtype=np.uint8)
    breaks = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *breaks], [*breaks, len(kinds)], strict=True):
        kind = int(kinds[a])
        above = out[a - 1] if a else np.zeros(lines.shape[1], np.uint8)
        if kind == 2:
            out[a:b] = np.cumsum(np.vstack([above, lines[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for i in range(a, b):
                above = out[i] = _unfilter_line(kind, lines[i], above)
        elif kind > 4:
            raise MediaError(f"filter {kind}")
    return out


def png_decode(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey image; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if len(chunk) < n or len(data) < at + 12 + n:
            raise MediaError("cut chunk")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(chunk, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("header, end or pixel format")
    w, h = head[:2]
    inflated = zlib.decompress(b"".join(body))
    if len(inflated) != h * (w + 1):
        raise MediaError("number of pixels")
    lines = np.frombuffer(inflated, np.uint8).reshape(h, w + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


_GRID, _LOW = 32, 8
_DCT = _cosines(_GRID, _LOW)


def dct_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 mean grid exceed the median of all but the first."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)

    def bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.arange(_GRID) * n // _GRID
        return lo, np.maximum(lo + 1, (np.arange(_GRID) + 1) * n // _GRID)

    (r0, r1), (c0, c1) = bounds(h), bounds(w)
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    grid = sums / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    low = (_DCT @ grid @ _DCT.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as the pixels of a PNG."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            media = [png_encode(np.frombuffer(padded(x, width), np.uint8).reshape(-1, width)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(encode, f"id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, dct_hash binary) of stored PNGs."""
    kind = media.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dct_hash binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for stored in b.column(2):
                data = stored.as_py()
                pixels = png_decode(data)
                payload = pixels.tobytes()
                for to, x in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), dct_hash(pixels)), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dct_hash"])

    return media.select("id", "n_bytes", "media").mapInArrow(decode, schema)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a PNG in a table of the shared folder, read the table back, and give its features.

    Nulls count as empty texts; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    return media_features(written(text_media(docs, id_col, text_col), "media", "uncompressed"))
