"""Byte kernels over Arrow columns: word spans, rolling hashes, chunks.

Everything works on one contiguous UTF-8 buffer with offsets, so a batch costs a few
vector passes and no Python object per word. Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}
_KEPT: dict[str, tuple[str, object]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets) of a string or binary column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    arr = arr.cast(pa.large_binary())
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(offs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by row); a word never crosses rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    mask = table[buf]
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, mask[:-1]
    prev[offs[:-1][offs[:-1] < n]] = False
    nxt = np.empty(n, bool)
    nxt[-1], nxt[:-1] = False, mask[1:]
    nxt[offs[1:][offs[1:] > 0] - 1] = False
    ws, we = np.flatnonzero(mask & ~prev), np.flatnonzero(mask & ~nxt) + 1
    return ws, we, np.searchsorted(ws, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POW[base] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * BASE**place over the first i bytes, modulo 2**64."""
    p = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * _powers(len(buf), BASE), out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans, by content and length alone."""
    h = (p[end] - p[start]) * _powers(len(p), _INV)[start]
    return mix(h + (end - start).astype(U) * U(0xD1342543DE82EF95))


def trim_powers() -> None:
    """Frees tables that an unusually long text has made large."""
    for k in [k for k, v in _POW.items() if len(v) > 1 << 23]:
        del _POW[k]


def settle() -> None:
    """Gives memory that a task has freed back to the system; workers stay for later tasks."""
    trim_powers()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_TRIM = _trimmer()


def ints(a: np.ndarray) -> pa.Array:
    """uint64 or int64 values as Arrow int64 with the same bits."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def squeeze(data: bytes) -> bytes:
    """zstd with the size in front, for what is written once and read once or twice."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def kept(kind: str, name: str, make):
    """make(), which this process keeps for later tasks that ask by the same name; one of each kind.

    It must live in this module: functions that tasks are made of come with globals of their own.
    """
    have = _KEPT.get(kind)
    if have is None or have[0] != name:
        _KEPT.pop(kind, None)  # freed before the next one is made
        have = _KEPT[kind] = (name, make())
    return have[1]
