"""Byte-level numpy helpers shared by the text operators.

Texts travel as Arrow batches.  Operators look at a *block*: the bytes of a few
consecutive rows with their offsets, a MB at most unless one text alone is
larger, so memory in a Python worker does not follow the batch size.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Work arrays take up to a hundred times a block's bytes.
BLOCK_BYTES = 1 << 20
#: For operators whose store of known words is rebuilt after each block.
STORE_BLOCK_BYTES = 2 << 20

#: Seeded tables of the polynomial hash; every task must see the same ones.
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[int, np.ndarray] = {}
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library keeps what it likes
    _LIBC = None

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+`.
IS_PLAIN_WORD = np.ones(256, bool)
IS_PLAIN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def table(seed: int) -> np.ndarray:
    """256 random 64-bit values for the bytes."""
    if seed not in _TABLES:
        _TABLES[seed] = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _TABLES[seed]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, BLOCK_BYTES + 16)
        inverse = pow(_BASE, -1, 2**64)
        for name, base in (("_POW", _BASE), ("_INV", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p, dtype=np.uint64)
    return _POW, _INV


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one longer than its input."""
    power, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    _, inverse = _powers(len(running))
    return mix((running[ends] - running[starts]) * inverse[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES):
    """(rows of the batch, bytes, offsets) for consecutive pieces of a batch."""
    at = batch.schema.get_field_index(column)
    n = batch.num_rows
    if not n:
        return
    _, off = buffers(batch.column(at))
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(off, off[low] + limit, "right")) - 1)
        part = batch.slice(low, high - low)
        yield (part, *buffers(part.column(at)))
        low = high
    release()


def release() -> None:
    """Give freed memory back: workers live on, and share a limit with others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_HELD: dict = {}


def hold(key, make=None):
    """A worker's one lasting object: another key's goes first.  Operators that
    keep nothing call it too, so that what others kept is freed."""
    if key not in _HELD:
        _HELD.clear()
        release()
        if make is not None:
            _HELD[key] = make()
    return _HELD.get(key)


def merged(keys: np.ndarray, value: np.ndarray, more: np.ndarray, more_value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values with others, sorted and not among them."""
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(value, at, more_value)


def blobs(column) -> list:
    """Binary values as buffers, which are not copied."""
    return [memoryview(b"") if v.as_buffer() is None else v.as_buffer() for v in column]


def planes(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as fit, by planes of bytes, which
    compress; the number of planes last.  Those below zero take eight."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return planes[:used].tobytes() + bytes([used])


def numbers(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    used = int(raw[-1])
    planes = np.zeros((8, (len(raw) - 1) // used), np.uint8)
    planes[:used] = raw[:-1].reshape(used, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none across a row's border."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    b = off[:-1][off[:-1] < len(mask)]
    first[b] = mask[b]
    e = off[1:][off[1:] > 0] - 1
    last[e] = mask[e]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def row_of(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which row each position belongs to (positions in any order)."""
    return np.searchsorted(off, positions, "right") - 1


def per_row(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For sorted starts: where each row's first one stands, one longer."""
    return np.searchsorted(starts, off, "left")


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths: group and place in the group of each item."""
    lengths = np.asarray(lengths, np.int64)
    group = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    return group, np.arange(len(group)) - begin[group]


def code_points(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points in each row of UTF-8 text."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[off[1:]] - lead[off[:-1]]


class HashIndex:
    """Sorted 64-bit hashes with a directory over their leading bits.

    ``find`` gives each hash's place, or -1; a few steps from the directory's
    entry, as the hashes are spread evenly.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length() - 1)
        led = np.bincount((keys >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.start = (np.cumsum(led) - led).astype(np.int32 if len(keys) < 2**31 else np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        n = len(self.keys)
        if not n or not len(h):
            return out
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        key = self.keys[np.minimum(at, n - 1)]
        hit = (key == h) & (at < n)
        out[hit] = at[hit]
        left = np.flatnonzero((key < h) & (at < n))
        at = at[left]
        while len(left):
            at += 1
            inside = at < n
            left, at = left[inside], at[inside]
            key, want = self.keys[at], h[left]
            hit = key == want
            out[left[hit]] = at[hit]
            more = key < want
            left, at = left[more], at[more]
        return out
