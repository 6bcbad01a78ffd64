"""Whole columns of text as one array of UTF-8 bytes: hashes of any segment from prefix sums, and a table from hash to code."""

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240611)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UTF8_START = (np.arange(256) & 0xC0) != 0x80


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the bounds of each text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _power[name] = np.multiply.accumulate(p)
    return _power["up"][:n], _power["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segment_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's bytes, the same wherever the segment lies."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes other than the six white space ones), and the bounds of each text's words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    seen = ~SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[bounds[:-1][bounds[:-1] < len(raw)]] = True
    before = np.concatenate([[False], seen[:-1]])
    starts = np.flatnonzero(seen & (first | ~before))
    after = np.concatenate([seen[1:] & ~first[1:], [False]])
    ends = np.flatnonzero(seen & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


class Codes:
    """Codes 0, 1, 2, ... of 64-bit hashes, in an open table."""

    def __init__(self, bits: int = 16):
        self.size, self.bits = 0, bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        at = (h & mask).astype(np.int64)
        out = self.vals[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(mask)
            v = self.vals[at[todo]]
            out[todo] = v
            todo = todo[(v >= 0) & (self.keys[at[todo]] != h[todo])]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Codes for hashes that are not in the table yet, each given once."""
        while (self.size + len(h)) * 2 > 1 << self.bits:
            old = self.vals >= 0
            keys, vals = self.keys[old], self.vals[old]
            self.bits += 1
            self.keys, self.vals = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(keys, vals)
        codes = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self._put(h, codes)
        self.size += len(h)
        return codes

    def _put(self, h, codes):
        mask = (1 << self.bits) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.vals[at] < 0
            _, one = np.unique(at, return_index=True)
            win = np.zeros(len(h), bool)
            win[one] = True
            win &= free
            self.keys[at[win]], self.vals[at[win]] = h[win], codes[win]
            h, codes, at = h[~win], codes[~win], (at[~win] + 1) & mask


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start .. start + size - 1 of every segment, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
