"""Arrays as compressed bytes, for shuffling many numbers in few rows."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Like bytes of neighbouring numbers are put side by side, then compressed."""
    out = []
    for a in arrays:
        out.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)))
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sq", raw, at)
        dtype = np.dtype(kind.decode())
        at += 10
        part = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def rises(sorted_: np.ndarray) -> np.ndarray:
    """Steps of a sorted uint64 array; ``np.cumsum`` undoes it."""
    return np.diff(sorted_, prepend=np.uint64(0))


def falls(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)
