"""Vectorised text primitives shared by the corpus operators.

Everything here works on whole Arrow batches as numpy arrays: no Python object is made per word
or per byte.  A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which is the same as
the pattern ``[^\\x20\\x09-\\x0D]+`` on code points, because no byte of a multi-byte UTF-8
character lies in that range.  Word identity is a 64-bit hash of the word's bytes, mixed block by
block (a polynomial modulo 2**64 would let words of a simple pattern collide for every base).
``span_hash`` is such a polynomial: it only chooses seeds and buckets, and never tells texts apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20
LONG_WORD = 256
#: Masks that keep so many low bytes.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW = {"n": 0, "pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (a copy is returned)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    if _POW["n"] < n:
        size = max(n, CHUNK_BYTES) + 1
        for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
        _POW["n"] = size - 1
    return _POW["pow"], _POW["inv"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**position; see ``span_hash``."""
    pw, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of spans, equal for equal bytes wherever they stand."""
    _, inv = powers(len(prefix) - 1)
    h = (prefix[end] - prefix[start]) * inv[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def digests(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    """128-bit BLAKE2 digest of each span of bytes: the identity of spans of any length."""
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string or binary column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:
        size = np.diff(off) * ~np.asarray(column.is_null())
        if size.sum() != off[-1] - off[0]:  # a null that still spans bytes
            keep = [raw[off[i] : off[i] + size[i]] for i in range(n)]
            return np.concatenate(keep), np.concatenate([[0], np.cumsum(size)])
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` bytes each; one longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def cut_rows(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of pieces of about ``limit`` bytes, in order; a longer row comes in several, cut after white space."""
    for i, j in chunks(offsets, limit):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= 2 * limit:
            yield data[a:b], offsets[i : j + 1] - a
            continue
        while a < b:
            end = min(b, a + limit)
            while end < b:
                blank = np.flatnonzero(SPACE[data[end : end + limit]])
                end = min(b, end + limit) if not len(blank) else end + int(blank[0]) + 1
                if len(blank):
                    break
            yield data[a:end], np.array([0, end - a])
            a = end


class Words:
    """Words of a range of rows: start and end byte, 64-bit hash, and word offsets by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        n = len(data)
        solid = ~SPACE[self.data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:n]
        self.start = np.flatnonzero(begins)
        ends = solid
        ends[:-1] &= ~solid[1:] | first[1:n]
        self.end = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Words are taken eight bytes at a time, each mixed into what came before; long ones by BLAKE2."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        long = size > LONG_WORD
        todo, at = (np.flatnonzero(~long), 0) if long.any() else (np.arange(len(size)), 0)
        while len(todo):
            left = size[todo] - at
            out[todo] = mix((out[todo] ^ (eight[self.start[todo] + at] & KEEP[np.minimum(left, 8)])) * np.uint64(_BASE))
            todo, at = todo[left > 8], at + 8
        for i in np.flatnonzero(long).tolist():
            raw = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(raw, "little")
        return out

    def __len__(self) -> int:
        return len(self.start)


def words_before(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Word offsets by row, without hashing the words."""
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] |= solid[edge]
    return np.searchsorted(np.flatnonzero(begins), offsets)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of ``h`` (length len(h)-k+1, or 0)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= np.uint64(_BASE)
        out += h[i : i + n]
    return mix(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    n = len(a)
    if n < w:
        return np.empty(0, a.dtype)
    x = np.full(-(-n // w) * w, TOP, dtype=np.uint64)
    x[:n] = a
    x = x.reshape(-1, w)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


_POS_BITS = np.uint64(28)
_POS_MASK = np.uint64((1 << 28) - 1)


def window_choice(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w entries the index of its rightmost minimum (by the top 36 bits).

    The choice depends on the window's content alone, so equal windows choose alike.
    """
    if len(h) > 1 << 28:
        raise ValueError("one text of more than 2**28 positions")
    key = (h & ~_POS_MASK) | (_POS_MASK - np.arange(len(h), dtype=np.uint64))
    return (_POS_MASK - (sliding_min(key, w) & _POS_MASK)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal neighbours."""
    if len(values) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i] .. starts[i]+lengths[i]-1."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_array(data: np.ndarray, offsets: np.ndarray, string: bool = False):
    """Arrow binary (or string) array over one buffer."""
    import pyarrow as pa

    kind = pa.string() if string else pa.binary()
    off = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def join_words(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each row joined by one blank: bytes, and offsets by row."""
    index = np.flatnonzero(keep)
    size = w.end[index] - w.start[index] + 1
    at = spread(w.start[index], size)
    out = w.data[np.minimum(at, max(0, len(w.data) - 1))]
    ends = np.cumsum(size)
    out[ends - 1] = 0x20
    cut = np.searchsorted(index, w.offsets)
    nonempty = cut[1:] > cut[:-1]
    stay = np.ones(len(out), dtype=bool)
    stay[ends[cut[1:][nonempty] - 1] - 1] = False  # no blank after a row's last word
    total = np.concatenate([[0], ends])[cut] - np.concatenate([[0], np.cumsum(nonempty)])
    return out[stay], total


def whole_groups(batches, keys: list[str], size_col: str, limit: int):
    """Lists of batches made of whole groups of equal keys, from batches sorted by them.

    About ``limit`` bytes of ``size_col`` come at a time, or one group that is larger.
    """
    held: list = []
    size, last = 0, None
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        cols = [np.asarray(b.column(k)) for k in keys]
        new = np.zeros(n, dtype=bool)
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in cols)
        _, off = column_bytes(b.column(size_col))
        load = off + 16 * np.arange(n + 1)
        starts, at = np.flatnonzero(new), 0
        while True:
            k = np.searchsorted(load[starts], load[at] + limit - size)
            if k == len(starts):
                break
            cut = int(starts[k])
            if cut > at:
                held.append(b.slice(at, cut - at))
            if held:
                yield held
            held, size, at = [], 0, cut
            starts = starts[k + 1 :]
        if at < n:
            held.append(b.slice(at))
            size += int(load[n] - load[at])
    if held:
        yield held
