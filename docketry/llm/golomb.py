"""Golomb-Rice codes of sorted integers, in numpy."""

from __future__ import annotations

import numpy as np

from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

_STEP = 1 << 16


def encode(values: np.ndarray) -> bytes:
    """Code sorted unsigned integers; repeats are allowed, the count is kept by the caller.

    Codes are gaps from the first value, which is written whole: where the values
    lie says nothing about how far apart they are.
    """
    if not len(values):
        return b""
    values = values.astype(np.uint64)
    base = int(values[0])
    gaps = np.diff(values, prepend=values[:1])
    k = max(0, ((int(values[-1]) - base) // len(values)).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(ends[-1] + 1, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary).tobytes()
    parts = [bytes([k]), base.to_bytes(8, "little"), len(head).to_bytes(4, "little"), head]
    places = np.arange(k, dtype=np.uint64)
    for i in range(0, len(gaps), _STEP):  # a multiple of 8 rows ends on a whole byte
        bits = (gaps[i : i + _STEP, None] >> places) & np.uint64(1)
        parts.append(np.packbits(bits.astype(np.uint8)).tobytes())
    return b"".join(parts)


def decode(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` integers that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    k, base, size = blob[0], int.from_bytes(blob[1:9], "little"), int.from_bytes(blob[9:13], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 13)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    weights = np.uint64(1) << np.arange(k, dtype=np.uint64)
    at = 13 + size
    for i in range(0, n, _STEP):
        rows = min(_STEP, n - i)
        length = (rows * k + 7) // 8
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, length, at), count=rows * k)
        gaps[i : i + rows] += bits.reshape(rows, k).astype(np.uint64) @ weights
        at += length
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def pack_flags(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def unpack_flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
