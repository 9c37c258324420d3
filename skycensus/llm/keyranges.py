"""Counting 64-bit keys over ranges: blocks send their distinct keys packed, ranges answer in each block's own order.

A block sends a row to a range only if it has keys there, so the rows are no more than the keys however many blocks and ranges there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def squeeze(x: np.ndarray) -> bytes:
    """Little-endian bytes by planes, compressed: most planes are nearly constant."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def stretch(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def key_ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` even ranges of 64-bit keys begins in sorted keys, and the end."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def key_pieces(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(range, its part of the sorted keys) of the ranges that hold a key."""
    at = key_ranges(keys, n)
    for r in np.flatnonzero(np.diff(at)).tolist():
        yield r, slice(int(at[r]), int(at[r + 1]))


#: What a block sends to a range, and what it gets back.
SENT = "range int, block long, keys binary, twice binary"
FLAGS = "block long, range int, n int, flags binary"


def sent_keys(block: int, keys: np.ndarray, twice: np.ndarray, n: int) -> pa.RecordBatch:
    """The block's sorted distinct keys, and whether the block itself has them twice, dealt to ``n`` ranges."""
    rows = [(r, squeeze(np.diff(keys[x], prepend=np.uint64(0))), np.packbits(twice[x]).tobytes()) for r, x in key_pieces(keys, n)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["range", "block", "keys", "twice"])


def gathered_flags(parts: list[dict]) -> np.ndarray:
    """The flags of all of a block's keys, from its (range, n, flags) in order."""
    return np.concatenate([np.unpackbits(np.frombuffer(p["flags"], np.uint8), count=p["n"]) for p in parts]).astype(bool)


def grouped(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows that come sorted by their first ``by`` columns; one group is held at a time."""
    key, held = None, []
    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if row[:by] != key:
                if held:
                    yield key, held
                key, held = row[:by], []
            held.append(row)
    if held:
        yield key, held


def keys_seen_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, range, n, flags) from (range, block, keys, twice) sorted by range: whether each key occurs twice in all blocks together."""
    for (r,), rows in grouped(batches):
        keys = [np.cumsum(stretch(x[2], np.uint64)) for x in rows]
        one, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.concatenate([np.unpackbits(np.frombuffer(x[3], np.uint8), count=len(k)) for x, k in zip(rows, keys, strict=True)])
        many = np.bincount(inverse, 1 + own, minlength=len(one)) > 1
        flags = np.split(many[inverse], np.cumsum([len(k) for k in keys])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows], pa.int64()), pa.array([r] * len(rows), pa.int32()), pa.array([len(f) for f in flags], pa.int32()), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())], ["block", "range", "n", "flags"])
