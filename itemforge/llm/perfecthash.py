"""A minimal perfect hash of 128-bit keys whose slots keep their keys.

Keys are thrown into a bit array twice their number; those alone on a bit take it, the others go on
to the next, smaller array. A key's slot is the number of set bits before its own. A key that was never
put in may land on a slot too, so each slot keeps its key for comparison.
"""

from __future__ import annotations

import numpy as np

from itemforge.llm.textkit import mix

#: Bits of a level per key that is left.
LOAD = 2
#: More levels than this only equal keys can need.
LEVELS = 200


def places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
    return (mix(high ^ (low * odd)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0..n-1 of n different keys (high, low)."""

    def __init__(self, levels: list[np.ndarray], high: np.ndarray, low: np.ndarray):
        self.levels, self.high, self.low = levels, high, low
        self.before, total = [], 0
        for bits in levels:
            taken = np.cumsum(bits, dtype=np.int64)
            self.before.append(taken - bits + total)
            total += int(taken[-1]) if len(taken) else 0

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels, order, left = [], [], np.arange(len(high))
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("equal keys have no perfect hash")
            at = places(high[left], low[left], len(levels), LOAD * len(left))
            alone = np.bincount(at, minlength=LOAD * len(left)) == 1
            mine = alone[at]
            order.append(left[mine][np.argsort(at[mine])])
            levels.append(alone)
            left = left[~mine]
        order = np.concatenate(order) if order else left
        return cls(levels, high[order], low[order])

    def __len__(self) -> int:
        return len(self.high)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in."""
        out, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for k, bits in enumerate(self.levels):
            at = places(high[left], low[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[k][at[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = found[(self.high[out[found]] != high[found]) | (self.low[out[found]] != low[found])]
        out[wrong] = -1
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.high), len(self.levels), *map(len, self.levels)], dtype="<i8")
        return b"".join([head.tobytes(), self.high.astype("<u8").tobytes(), self.low.astype("<u8").tobytes(), *[np.packbits(b, bitorder="little").tobytes() for b in self.levels]])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, k = np.frombuffer(raw, "<i8", 2).tolist()
        sizes = np.frombuffer(raw, "<i8", k, 16).tolist()
        at = 16 + 8 * k
        high, low = np.frombuffer(raw, "<u8", n, at), np.frombuffer(raw, "<u8", n, at + 8 * n)
        at, levels = at + 16 * n, []
        for s in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-s // 8), at), count=s, bitorder="little").astype(bool))
            at += -(-s // 8)
        return cls(levels, high, low)
