"""Lossless WebP: images to pixel arrays, and payloads of bytes kept as such images.

The reader takes all of the format: prefix codes (simple, and with lengths that are coded themselves), several
groups of them by tile, back-references with distances in the plane, the colour cache, and the inverse
of the predictor, cross-colour, subtract-green and palette transforms. Pixels are 32-bit numbers of alpha,
red, green and blue. The formats' numbers are those of its public specification (RFC 9649).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from itemforge.llm.textkit import runs, spread

# Fixed values of the format: the order of the lengths of length codes, alphabets, and the cache's multiplier.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES, LONGEST = 256, 24, 40, 15
HASH = 0x1E35A7BD
PREDICT, CROSS, GREEN, PALETTE = range(4)
BLACK = 0xFF000000
#: Near distances, as (x, y) from a pixel back to its source: by distance, then by column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: Bytes whose bits are turned into numbers at a time.
SEGMENT = 1 << 15
#: Copies are made of at least so many pixels, and at most of so many.
SHORTEST_COPY, LONGEST_COPY = 3, 4096
#: Bytes of a code's lengths that are looked at as one number, and extra bits and least number of the lengths' symbols 16 to 18, which repeat.
LENGTH_BYTES = 24
#: Lengths that these hold for sure: one takes at most 14 bits.
LENGTH_STEPS = (8 * LENGTH_BYTES - 7) // 14
REPEATS = ((2, 3), (3, 3), (7, 11))
_REVERSED: dict[int, np.ndarray] = {}


class NotLossless(ValueError):
    """The bytes are no lossless WebP image, or a broken one."""


def reversed_bits(n: int) -> np.ndarray:
    """Every number of n bits with its bits in the other order."""
    if n not in _REVERSED:
        out = np.zeros(1 << n, np.int64)
        for i in range(n):
            out |= ((np.arange(1 << n) >> i) & 1) << (n - 1 - i)
        _REVERSED[n] = out
    return _REVERSED[n]


# --- reading ----------------------------------------------------------------------------------


class Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, raw: bytes):
        self.size, self.at = 8 * len(raw), 0
        self.raw = raw + bytes(40)

    def windows(self, byte: int, most: int = SEGMENT) -> list[int]:
        """The 64 bits from each of the next bytes on."""
        n = min(most, len(self.raw) - 7 - byte)
        if n <= 0:
            raise NotLossless("the stream ends early")
        return np.ndarray(n, "<u8", self.raw, byte, (1,)).tolist()

    def offsets(self, byte: int, size: int) -> np.ndarray:
        """The next 25 bits or more from each bit of some bytes on; beyond the end there are zeros."""
        raw = self.raw[byte : byte + size + 4]
        raw += bytes(size + 4 - len(raw))
        return (np.ndarray((size, 1), "<u4", raw, 0, (1, 4)) >> np.arange(8, dtype=np.uint32)).ravel()

    def read(self, n: int) -> int:
        byte = self.at >> 3
        if self.at + n > self.size:
            raise NotLossless("the stream ends early")
        out = int.from_bytes(self.raw[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out

    def span(self, start: int, size: int) -> int:
        """Any number of bits from a place, as one number."""
        return int.from_bytes(self.raw[start >> 3 : (start + size >> 3) + 1], "little") >> (start & 7) & (1 << size) - 1


def code_table(lengths: np.ndarray) -> np.ndarray:
    """Entries by the next bits, as many as there may be: an entry holds the symbol above its length in the low four bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return used << 4
    if not len(used):
        raise NotLossless("a prefix code without symbols")
    size = lengths[used].astype(np.int64)
    order = np.argsort(size, kind="stable")
    used, size = used[order], size[order]
    most = int(size[-1])
    table = np.repeat(used << 4 | size, 1 << most - size)
    if len(table) != 1 << most:
        raise NotLossless("a prefix code that is not complete")
    return table[reversed_bits(most)]


def read_code(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(max(alphabet, LITERALS), np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return code_table(lengths[:alphabet])
    n = 4 + bits.read(4)
    own, each = np.zeros(19, np.uint8), bits.span(bits.at, 3 * n)
    bits.at += 3 * n
    for k, i in enumerate(LENGTH_ORDER[:n]):
        own[i] = each >> 3 * k & 7
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table = code_table(own).tolist()
    mask, at, last, room = len(table) - 1, bits.at, 8, alphabet
    found: list[int] = []
    add = found.append
    while room > 0 and left:
        rest = int.from_bytes(bits.raw[at >> 3 : (at >> 3) + LENGTH_BYTES], "little") >> (at & 7)
        for _ in range(min(left, LENGTH_STEPS)):
            entry = table[rest & mask]
            n, kind = entry & 15, entry >> 4
            left -= 1
            if kind < 16:
                add(kind)
                room -= 1
                if kind:
                    last = kind
            else:
                extra, least = REPEATS[kind - 16]
                least += rest >> n & (1 << extra) - 1
                found += [last if kind == 16 else 0] * least
                room -= least
                n += extra
            at += n
            if room <= 0:
                break
            rest >>= n
    if at > bits.size:
        raise NotLossless("the stream ends early")
    bits.at = at
    if len(found) > alphabet:
        raise NotLossless("code lengths beyond the alphabet")
    lengths[: len(found)] = found
    return code_table(lengths[:alphabet])


class Group:
    """Codes of green with lengths and cache, red, blue, alpha and distances, as ``code_table`` gives them."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables, self._lists, self._short = tables, None, None

    def lists(self) -> list[tuple[list[int], int]]:
        """Codes as entries and a mask; literals stand where their sample does."""
        if self._lists is None:
            self._lists = [((t >> 4 << shift + 4 | t & 15).tolist(), len(t) - 1) for t, shift in zip(self.tables, (0, 16, 0, 24, 0), strict=True)]
        return self._lists

    def short(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """What green begins (0 a literal, 1 a copy, 2 a hit) and the first four codes' lengths, by the next bits."""
        if self._short is None:
            green, lengths = self.tables[0] >> 4, []
            for k, t in enumerate(self.tables[:4]):
                lengths.append(lengths[-1] if k > 1 and t is self.tables[k - 1] else (t & 15).astype(np.uint8))
            self._short = (green >= LITERALS).view(np.uint8) + (green >= LITERALS + LENGTHS), lengths
        return self._short


#: The last codes read, by the size of the cache, with their bits: images of one writer often have the same.
_LAST: dict[int, tuple[int, int, Group]] = {}


def read_group(bits: Bits, cache: int) -> Group:
    if cache in _LAST:
        size, value, group = _LAST[cache]
        if bits.at + size <= bits.size and bits.span(bits.at, size) == value:
            bits.at += size
            return group
    out, start, size, first = [], 0, 0, bits.at
    for alphabet in (LITERALS + LENGTHS + (1 << cache if cache else 0), LITERALS, LITERALS, LITERALS, DISTANCES):
        if len(out) in (2, 3) and bits.at + size <= bits.size and bits.span(start, size) == bits.span(bits.at, size):
            bits.at += size  # the same bits for the same alphabet are the same code
            out.append(out[-1])
            continue
        start = bits.at
        out.append(read_code(bits, alphabet))
        size = bits.at - start
    group = Group(out)
    _LAST[cache] = (bits.at - first, bits.span(first, bits.at - first), group)
    return group


#: Extra bits and first number of each prefix of a length or distance.
EXTRA = np.array([0 if s < 4 else s - 2 >> 1 for s in range(DISTANCES)])
FIRST = np.array([s + 1 if s < 4 else (2 + (s & 1) << (s - 2 >> 1)) + 1 for s in range(DISTANCES)])
#: Bits whose tokens are found at a time.
TOKEN_BITS = 1 << 16


def read_tokens(bits: Bits, total: int, width: int, group: Group, cache: int) -> np.ndarray | None:
    """The pixels of an image with one group of codes, at the end of the stream, without a step for each symbol.

    For every bit is told where the next token would begin, if one began there; a walk along these finds the tokens. Copies and
    cache hits then point at earlier pixels, and pointers are followed by halves until they end at literals. None
    where green takes no bits, or a hit meets an empty place: ``read_image`` goes step by step then.
    """
    tables = group.tables
    if len(tables[0]) == 1:
        return None
    begins, short = group.short()
    copying = bool((begins == 1).any())
    parts, at, pixels = [], bits.at, 0
    while pixels < total:
        if at >= bits.size:
            raise NotLossless("the stream ends early")
        size = min(TOKEN_BITS // 8, (bits.size - at >> 3) + 2)
        window = bits.offsets(at >> 3, size + 16).astype(np.int64)
        place = np.arange(len(window))
        head = window[: 8 * size] & len(tables[0]) - 1
        first, over = place[: 8 * size] + short[0][head], [None] * 4
        for k in (1, 2, 3):  # where the next code begins, by where one does
            over[k] = over[k - 1] if k > 1 and tables[k] is tables[k - 1] else place + short[k][window & len(tables[k]) - 1]
        begin = begins[head]
        jump = np.where(begin == 0, over[3][over[2][over[1][first]]], first)
        if copying:
            copy = np.flatnonzero(begin == 1)
            far = first[copy] + EXTRA[(tables[0][head[copy]] >> 4) - LITERALS]
            entry = tables[4][window[far] & len(tables[4]) - 1]
            jump[copy] = far + (entry & 15) + EXTRA[entry >> 4]
        walk, found, p = memoryview(jump), [], at & 7
        end = min(8 * size, bits.size - (at & ~7))
        add = found.append
        while p < end:
            add(p)
            p = walk[p]
        t = np.array(found, np.int64)
        symbol, first = tables[0][head[t]] >> 4, first[t]
        value, q = symbol << 8, first
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            value |= tables[k][window[q] & len(tables[k]) - 1] >> 4 << shift
            q = over[k][q]
        n, back = np.ones(len(t), np.int64), np.zeros(len(t), np.int64)
        c = np.flatnonzero((symbol >= LITERALS) & (symbol < LITERALS + LENGTHS))
        if len(c):
            s, q = symbol[c] - LITERALS, first[c]
            n[c] = FIRST[s] + (window[q] & (1 << EXTRA[s]) - 1)
            q = q + EXTRA[s]
            entry = tables[4][window[q] & len(tables[4]) - 1]
            d = entry >> 4
            back[c] = FIRST[d] + (window[q + (entry & 15)] & (1 << EXTRA[d]) - 1)
        parts.append((symbol, value, n, back, (at & ~7) + jump[t].astype(np.int64)))
        pixels += int(n.sum())
        at = (at & ~7) + p
    symbol, value, n, back, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    start = np.cumsum(n) - n
    last = int(np.searchsorted(start, total))
    symbol, value, n, back, start = symbol[:last], value[:last], n[:last], back[:last], start[:last]
    if start[-1] + n[-1] != total:
        raise NotLossless("a copy from outside the image")
    if ends[last - 1] > bits.size:
        raise NotLossless("the stream ends early")
    literal, hit, copy = symbol < LITERALS, symbol >= LITERALS + LENGTHS, back > 0
    if literal.all():
        return value.astype(np.uint32)
    near = copy & (back <= len(NEAR))
    plane = np.array([max(1, x + y * width) for x, y in NEAR])
    back = np.where(near, plane[np.maximum(back, 1).clip(max=len(NEAR)) - 1], back - len(NEAR))
    if (back[copy] > start[copy]).any():
        raise NotLossless("a copy from outside the image")
    source, pixel, slot = np.arange(total), np.zeros(total, np.uint32), np.zeros(total, np.int64)
    pixel[start[literal]] = value[literal]
    taken = spread(start[copy], n[copy])
    source[taken] = taken - np.repeat(back[copy], n[copy])
    source = roots(source)
    if hit.any():
        slot[start[literal]] = (pixel[start[literal]] * np.uint32(HASH) >> np.uint32(32 - cache)).astype(np.int64)
        slot[start[hit]] = symbol[hit] - LITERALS - LENGTHS
        before = earlier(slot[source])[start[hit]]
        if (before < 0).any():
            return None
        source[start[hit]] = before
        source = roots(source)
    return pixel[source]


def roots(source: np.ndarray) -> np.ndarray:
    """Where pointers to earlier places end."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


#: Images that are read together at most, their pixels and entries of their codes, pixels of one of them, and images for which it goes on.
LANES, LANE_PIXELS, LANE_ENTRIES, LANE, FEWEST = 1 << 10, 1 << 19, 1 << 22, 1 << 15, 80
#: Tokens that are read of each image before those that ended are taken out, and bytes that these take at most.
STRIDE, OVERRUN = 32, 1 << 9


def read_together(todo: list[tuple[Bits, int, int, Group, int]]) -> list[np.ndarray | None]:
    """The pixels of many images with one group of codes each (stream, pixels, width, codes, cache): the next token of all of them at a time.

    None for the longest, which are not enough to go on, and for those that are broken or hit an empty place: one by one these
    give what they give.
    """
    many = len(todo)
    out: list[np.ndarray | None] = [None] * many
    if many < FEWEST:
        return out
    raw = b"".join(t[0].raw for t in todo) + bytes(OVERRUN)
    words = np.ndarray(len(raw) - 7, "<i8", raw, 0, (1,))
    begin = 8 * (np.cumsum([len(t[0].raw) for t in todo]) - [len(t[0].raw) for t in todo])
    tables, offset, mask, filled = [], np.zeros((5, many), np.int64), np.zeros((5, many), np.int64), 0
    for i, (_, _, _, group, _) in enumerate(todo):
        for k, t in enumerate(group.tables):
            if k and t is group.tables[k - 1]:
                offset[k, i] = offset[k - 1, i]
            else:
                offset[k, i] = filled
                tables.append(t)
                filled += len(t)
            mask[k, i] = len(t) - 1
    table = np.concatenate(tables).astype(np.int32)

    def bits_at(p):
        return words[p >> 3] >> (p & 7)

    lane, p, left = np.arange(many), begin + [t[0].at for t in todo], np.array([t[1] for t in todo])
    stop, total = begin + [t[0].size for t in todo], left.copy()
    tokens, taken = [], []
    while len(lane) >= FEWEST:
        for _ in range(STRIDE):
            w = bits_at(p)
            green = table[offset[0] + (w & mask[0])]
            n = green & 15
            w >>= n
            red = table[offset[1] + (w & mask[1])]
            w >>= red & 15
            blue = table[offset[2] + (w & mask[2])]
            size = n + (red & 15) + (blue & 15)
            alpha = table[offset[3] + (bits_at(p + size) & mask[3])]
            size += alpha & 15
            token, now = [lane, left, green >> 4, red, blue, alpha], np.ones(len(lane), np.int64)
            c = np.flatnonzero(green >= LITERALS << 4)
            if len(c):
                size[c] = n[c]
                c = c[green[c] < LITERALS + LENGTHS << 4]
                q, s = p[c] + n[c], (green[c] >> 4) - LITERALS
                now[c] = FIRST[s] + (bits_at(q) & (1 << EXTRA[s]) - 1)
                q += EXTRA[s]
                d = table[offset[4, c] + (bits_at(q) & mask[4, c])]
                q += d & 15
                d >>= 4
                taken.append((lane[c], left[c], now[c], FIRST[d] + (bits_at(q) & (1 << EXTRA[d]) - 1)))
                size[c] = q + EXTRA[d] - p[c]
            p, left = p + size, left - now
            tokens.append((*token, p))
        on = np.flatnonzero((left > 0) & (p <= stop[lane]))
        if len(on) < len(lane):
            lane, p, left, offset, mask = lane[on], p[on], left[on], offset[:, on], mask[:, on]
    # tokens by image, those after its end left out; a token's place is told by the pixels that were left
    of, still, symbol, red, blue, alpha, end = (np.concatenate(x) for x in zip(*tokens, strict=True))
    order = np.flatnonzero(still > 0)
    order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]
    of, still, symbol, red, blue, alpha, end = (x[order] for x in (of, still, symbol, red, blue, alpha, end))
    first = np.cumsum(total) - total
    start = first[of] + total[of] - still
    none = (np.empty(0, np.int64),) * 4
    c_of, c_left, size, back = (np.concatenate(x) for x in zip(none, *taken, strict=True))
    c_place = total[c_of] - c_left
    x, y = np.array(NEAR)[np.minimum(back, len(NEAR)) - 1].T
    back = np.where(back <= len(NEAR), np.maximum(1, x + y * np.array([t[2] for t in todo])[c_of]), back - len(NEAR))
    bad = np.zeros(many, bool)
    bad[lane] = True  # those that go on
    bad[of[end > stop[of]]] = True
    bad[c_of[(c_left > 0) & ((back > c_place) | (size > c_left))]] = True
    reached = np.zeros(many, np.int64)
    np.maximum.at(reached, of, total[of] - still + 1)
    np.maximum.at(reached, c_of[c_left > 0], (c_place + size)[c_left > 0])
    bad |= reached != total
    keep = ~bad[of]
    start, symbol, of = start[keep], symbol[keep], of[keep]
    value = symbol << 8 | (red[keep] >> 4) << 16 | blue[keep] >> 4 | (alpha[keep].astype(np.int64) >> 4) << 24
    literal, hit = symbol < LITERALS, symbol >= LITERALS + LENGTHS
    pixel, source = np.zeros(int(total.sum()), np.uint32), np.arange(int(total.sum()))
    pixel[start[literal]] = value[literal]
    c = np.flatnonzero((c_left > 0) & ~bad[c_of])
    places = spread((first[c_of] + c_place)[c], size[c])
    source[places] = places - np.repeat(back[c], size[c])
    source = roots(source)
    if hit.any():
        cache = np.array([t[4] for t in todo])
        slot, image = np.zeros(len(pixel), np.int64), np.repeat(np.arange(many), total)
        slot[start[literal]] = (pixel[start[literal]] * np.uint32(HASH) >> (32 - cache[of[literal]]).astype(np.uint32)).astype(np.int64)
        slot[start[hit]] = symbol[hit] - LITERALS - LENGTHS
        before = earlier(slot[source] + (image << 11), image)[start[hit]]
        bad[of[hit][before < 0]] = True
        source[start[hit]] = np.where(before < 0, start[hit], before)
        source = roots(source)
    pixel = pixel[source]
    for i in np.flatnonzero(~bad).tolist():
        out[i] = pixel[first[i] : first[i] + total[i]]
    return out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an image, or of one that a transform needs, row by row."""
    return read_pixels(bits, width, height, main, *read_head(bits, width, height, main))


def read_head(bits: Bits, width: int, height: int, main: bool) -> tuple[int, list[int] | None, int, int, list[Group]]:
    """What stands before an image's pixels: bits of the cache, group of each tile, bits of a tile, tiles in a row, groups."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise NotLossless("a colour cache of more than 11 bits")
    which, tile, across = None, 0, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        which = (read_image(bits, across, -(-height >> tile), False) >> 8 & 0xFFFF).tolist()
    return cache, which, tile, across, [read_group(bits, cache) for _ in range(max(which) + 1 if which else 1)]


def read_pixels(bits: Bits, width: int, height: int, main: bool, cache: int, which: list[int] | None, tile: int, across: int, groups: list[Group]) -> np.ndarray:
    """The pixels after what ``read_head`` gave."""
    if main and not which and (found := read_tokens(bits, width * height, width, groups[0], cache)) is not None:
        return found
    total, pos, edge = width * height, 0, 0
    out, add = array("I"), None
    add = out.append
    recent, shift = [0] * (1 << cache), 32 - cache
    p = bits.at
    base, windows = p >> 3, bits.windows(p >> 3)
    limit = len(windows) - 16  # no token takes more than 16 bytes
    while pos < total:
        if pos >= edge:
            y, x = divmod(pos, width)
            (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = groups[which[(y >> tile) * across + (x >> tile)] if which else 0].lists()
            edge = y * width + min(width, (x >> tile) + 1 << tile) if which else total
        i = (p >> 3) - base
        if i > limit:
            base, i = p >> 3, 0
            windows = bits.windows(base)
            limit = len(windows) - 16
        w = windows[i] >> (p & 7)
        e = green[w & gm]
        n = e & 15
        s = e >> 4
        if s < LITERALS:
            w >>= n
            e = red[w & rm]
            k = e & 15
            n += k
            pixel = s << 8 | e >> 4
            w >>= k
            e = blue[w & bm]
            k = e & 15
            n += k
            pixel |= e >> 4
            if n > 42:
                w = windows[(p + n >> 3) - base] >> (p + n & 7)
            else:
                w >>= k
            e = alpha[w & am]
            p += n + (e & 15)
            pixel |= e >> 4
            add(pixel)
            pos += 1
            if cache:
                recent[(pixel * HASH & 0xFFFFFFFF) >> shift] = pixel
        elif s < LITERALS + LENGTHS:
            p += n
            s -= LITERALS
            k = s - 2 >> 1 if s >= 4 else 0
            size = (2 + (s & 1) << k) + (windows[(p >> 3) - base] >> (p & 7) & (1 << k) - 1) + 1 if s >= 4 else s + 1
            p += k
            e = far[windows[(p >> 3) - base] >> (p & 7) & fm]
            p += e & 15
            s = e >> 4
            k = s - 2 >> 1 if s >= 4 else 0
            back = (2 + (s & 1) << k) + (windows[(p >> 3) - base] >> (p & 7) & (1 << k) - 1) + 1 if s >= 4 else s + 1
            p += k
            if back > len(NEAR):
                back -= len(NEAR)
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > pos or pos + size > total:
                raise NotLossless("a copy from outside the image")
            if back >= size:
                new = out[pos - back : pos - back + size]
            else:
                new = (out[pos - back :] * (size // back + 1))[:size]
            out.extend(new)
            pos += size
            if cache:
                for pixel in new:
                    recent[(pixel * HASH & 0xFFFFFFFF) >> shift] = pixel
        else:
            p += n
            pixel = recent[s - LITERALS - LENGTHS]
            add(pixel)
            pos += 1
            recent[(pixel * HASH & 0xFFFFFFFF) >> shift] = pixel
    if p > bits.size:
        raise NotLossless("the stream ends early")
    bits.at = p
    return np.frombuffer(out, np.uint32)


# --- transforms -------------------------------------------------------------------------------


def samples(pixels: np.ndarray) -> np.ndarray:
    """Pixels as blue, green, red and alpha bytes along one more axis."""
    return np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(*pixels.shape, 4)


def joined(four: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(four, dtype=np.uint8).view("<u4")[..., 0]


def tiled(image: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """Each pixel's element of an image of tiles."""
    return image[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def predicted(mode: int, left, top, corner, right) -> np.ndarray:
    """What a mode expects of a pixel from its neighbours (left, above, above left, above right), as arrays of samples."""
    def half(a, b):
        return a + b >> 1

    if mode == 1:
        return left
    if mode in (2, 3, 4):
        return (top, right, corner)[mode - 2]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7):
        return half(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return half(corner if mode == 8 else right, top)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=-1, keepdims=True) < np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        away = mean - corner
        return np.clip(mean + (away + (away < 0) >> 1), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), top.shape)


def unpredicted(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Add to each pixel what its tile's mode expects. The first row looks left, the first column up."""
    height, width = pixels.shape
    out = samples(pixels).astype(np.int64)
    mode = modes >> 8 & 15
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = row[0] + above[0] & 255
        after = np.concatenate([above[1:], row[:1]])  # the last pixel's upper right is its own row's first
        for a, z in zip(*runs(mode[y >> bits]), strict=True):
            m = int(mode[y >> bits, a])
            a, z = max(1, int(a) << bits), min(width, int(z) << bits)
            if a >= z:
                continue
            if m == 1:
                row[a:z] = np.cumsum(row[a - 1 : z], axis=0)[1:] & 255
            elif m in (5, 6, 7, 10, 11, 12, 13):
                for x in range(a, z):
                    row[x] = row[x] + predicted(m, row[x - 1], above[x], above[x - 1], after[x]) & 255
            else:
                row[a:z] = row[a:z] + predicted(m, row[a - 1 : z - 1], above[a:z], above[a - 1 : z - 1], after[a:z]) & 255
    return joined(out)


def small(a: np.ndarray) -> np.ndarray:
    """Bytes as numbers with a sign."""
    return a.astype(np.uint8).view(np.int8).astype(np.int64)


def recoloured(pixels: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Add (or take away) what a tile's element says that green tells of red, and green and red of blue."""
    s = samples(pixels).astype(np.int64)
    e = samples(tiled(elements, bits, *pixels.shape))
    to_red, to_blue, red_to_blue = (small(e[..., i]) for i in range(3))
    green, red = small(s[..., 1]), s[..., 2].copy()
    s[..., 2] += sign * (to_red * green >> 5)
    known = small(s[..., 2]) if sign > 0 else small(red)
    s[..., 0] += sign * ((to_blue * green >> 5) + (red_to_blue * known >> 5))
    return joined(s & 255)


def greened(pixels: np.ndarray, sign: int) -> np.ndarray:
    s = samples(pixels).astype(np.int64)
    s[..., [0, 2]] += sign * s[..., 1:2]
    return joined(s & 255)


def bundle(colours: int) -> int:
    """Of how many pixels (a power of two, as its exponent) a byte holds the numbers."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpaletted(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    k = bundle(len(table))
    x = np.arange(width)
    number = pixels[:, x >> k] >> 8 + (x & (1 << k) - 1) * (8 >> k) & (1 << (8 >> k)) - 1
    return np.concatenate([table, np.zeros(256 - len(table), np.uint32)])[number]  # beyond the palette: transparent black


def chunk(raw: bytes) -> bytes:
    """The lossless image's stream in a file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise NotLossless("no WebP file")
    at = 12
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        if raw[at : at + 4] == b"VP8L":
            if at + 8 + size > len(raw):
                raise NotLossless("the stream ends early")
            return raw[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise NotLossless("no lossless image in the file")


def decode(raw: bytes) -> np.ndarray:
    """A file's pixels, height by width."""
    bits, height, now, head, todo = opened(raw)
    return restored(read_pixels(bits, now, height, True, *head).reshape(height, now), todo)


def decode_each(raws: Iterable[bytes]) -> Iterator[np.ndarray | NotLossless]:
    """``decode`` of each file, or why it can't be; short ones are read together."""
    waiting, load, entries = [], 0, 0
    for raw in raws:
        try:
            file = opened(raw)
        except NotLossless as e:
            waiting.append(e)
            continue
        waiting.append(file)
        load += file[1] * file[2]
        entries += sum(len(t) for g in file[3][-1] for t in g.tables)
        if len(waiting) >= LANES or load > LANE_PIXELS or entries > LANE_ENTRIES:
            yield from decoded(waiting)
            waiting, load, entries = [], 0, 0
    yield from decoded(waiting)


def decoded(files: list) -> Iterator[np.ndarray | NotLossless]:
    """The pixels of opened files; errors stay."""
    plain = [f for f in files if not isinstance(f, NotLossless) and not f[3][1] and f[1] * f[2] <= LANE]
    ready = iter(read_together([(bits, height * now, now, head[-1][0], head[0]) for bits, height, now, head, _ in plain]))
    plain = {id(f) for f in plain}
    for f in files:
        if isinstance(f, NotLossless):
            yield f
            continue
        bits, height, now, head, todo = f
        pixels = next(ready) if id(f) in plain else None
        try:
            if pixels is None:
                pixels = read_pixels(bits, now, height, True, *head)
            yield restored(pixels.reshape(height, now), todo)
        except NotLossless as e:
            yield e


def opened(raw: bytes) -> tuple[Bits, int, int, tuple, list]:
    """A file read up to its pixels: stream, height, width as stored, what ``read_head`` gives, transforms to undo."""
    bits = Bits(chunk(raw))
    if bits.read(8) != 0x2F:
        raise NotLossless("no signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # says whether alpha is worth showing; the pixels are the same
    if bits.read(3):
        raise NotLossless("an unknown version")
    todo, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise NotLossless("a transform given twice")
        seen.add(kind)
        size, table = 0, None
        if kind in (PREDICT, CROSS):
            size = bits.read(3) + 2
            across = -(-now >> size)
            table = read_image(bits, across, -(-height >> size), False).reshape(-1, across)
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = joined(np.cumsum(samples(read_image(bits, n, 1, False)), axis=0, dtype=np.uint8))
        todo.append((kind, size, table, now))
        if kind == PALETTE:
            now = -(-now >> bundle(len(table)))
    return bits, height, now, read_head(bits, now, height, True), todo


def restored(out: np.ndarray, todo: list) -> np.ndarray:
    """Pixels without the transforms."""
    for kind, size, table, before in reversed(todo):
        if kind == PREDICT:
            out = unpredicted(out, table, size)
        elif kind == CROSS:
            out = recoloured(out, table, size, 1)
        elif kind == GREEN:
            out = greened(out, 1)
        else:
            out = unpaletted(out, table, before)
    return out


# --- writing ----------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Huffman lengths of at most ``longest`` bits; rare symbols count as more until they fit."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].tolist()
    n = len(used)
    never = sum(weight) * 2 + n
    while True:
        # leaves in order and nodes in order of making: the two smallest are always at one of the fronts
        leaves, nodes, parent, i, j = [*weight, never], [never] * n, [0] * (2 * n - 1), 0, 0
        for k in range(n, 2 * n - 1):
            if (one := leaves[i]) <= nodes[j]:
                parent[i] = k
                i += 1
            else:
                one = nodes[j]
                parent[n + j] = k
                j += 1
            if (two := leaves[i]) <= nodes[j]:
                parent[i] = k
                i += 1
            else:
                two = nodes[j]
                parent[n + j] = k
                j += 1
            nodes[k - n] = one + two
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= longest:
            out[used] = depth[:n]
            return out
        weight = [w // 2 + 1 for w in weight]


def codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits as written, how many) of each symbol, by row where there are rows; one symbol alone takes none."""
    order = np.argsort(np.where(lengths > 0, lengths, LONGEST + 1).astype(np.uint8), axis=-1, kind="stable")
    n = np.take_along_axis(lengths, order, axis=-1)
    room = np.where(n > 0, 1 << LONGEST - n, 0)
    first = np.cumsum(room, axis=-1) - room
    value = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(value, order, reversed_bits(LONGEST)[first & (1 << LONGEST) - 1], axis=-1)
    size = np.where((lengths > 0).sum(axis=-1, keepdims=True) > 1, lengths, 0)
    return np.where(size > 0, value, 0), size


class Stream:
    """Fields of at most 30 bits, in order."""

    def __init__(self):
        self.values: list = []
        self.sizes: list = []
        self.ends: list[int] = []

    def put(self, *fields: tuple[int, int]) -> None:
        self.many(np.array([v for v, _ in fields], np.int64), np.array([n for _, n in fields], np.int64))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values)
        self.sizes.append(sizes)

    def end(self) -> None:
        """The next field begins another body."""
        self.ends.append(len(self.values))

    def to_bytes(self) -> bytes:
        self.end()
        return self.bodies()[0]

    def bodies(self) -> list[bytes]:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        last = np.cumsum([len(n) for n in self.sizes])[np.array(self.ends) - 1]
        ends = np.cumsum(sizes)
        bits = np.diff(ends[last - 1], prepend=0)  # of each body, which begins at a word
        words = (bits + 31) >> 5
        first = np.cumsum(words) - words
        at = ends - sizes + np.repeat(32 * first - np.cumsum(bits) + bits, np.diff(last, prepend=0))
        shifted, total = values << (at & 31), int(words.sum()) + 2
        low = np.bincount(at >> 5, weights=(shifted & 0xFFFFFFFF).astype(float), minlength=total)
        high = np.bincount((at >> 5) + 1, weights=(shifted >> 32).astype(float), minlength=total)
        raw = (low + high).astype("<u4").tobytes()
        return [raw[4 * a : 4 * a + -(-n // 8)] for a, n in zip(first.tolist(), bits.tolist(), strict=True)]


def coded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A prefix code's own fields: its symbols where they are one or two bytes, else its lengths, coded themselves."""
    used = np.flatnonzero(lengths)
    if len(used) > 2 or (used >= LITERALS).any():
        return coded_each(lengths[None])[0]
    used = used if len(used) else np.zeros(1, np.int64)
    return np.concatenate([[1, len(used) - 1, 1], used]), np.concatenate([[1, 1, 1], np.full(len(used), 8)])


def coded_each(lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``coded`` of each row; the runs of all rows are found at once."""
    rows, alphabet = lengths.shape
    flat = lengths.ravel()
    cut = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (np.arange(1, len(flat)) % alphabet == 0)]))
    v, n = flat[cut], np.diff(cut, append=len(flat))
    once = (v > 0).astype(np.int64)  # a length stands once before it is repeated
    n = n - once
    most = np.where(v > 0, 6, 138)
    full, rest = n // most, n % most
    part, plain = rest >= 3, np.where(rest < 3, rest, 0)
    # for each run: the length, whole repeats, one repeat of what is left, or that written out
    symbol = np.stack([v, np.where(v > 0, 16, 18), np.where(v > 0, 16, np.where(rest > 10, 18, 17)), v], axis=1).ravel()
    more = np.stack([0 * v, np.where(v > 0, 3, 127), np.where(part, rest - np.where((v == 0) & (rest > 10), 11, 3), 0), 0 * v], axis=1).ravel()
    times = np.stack([once, full, part, plain], axis=1).ravel()
    symbol, more, of = np.repeat(symbol, times), np.repeat(more, times), np.repeat(np.repeat(cut // alphabet, 4), times)
    counts = np.bincount(of * 19 + symbol, minlength=rows * 19).reshape(rows, 19)
    own = np.stack([code_lengths(c, 7) for c in counts])
    value, size = codes(own)
    # the kind, how many lengths of lengths, these in their order, all of the alphabet; then the lengths
    listed = own[:, LENGTH_ORDER]
    many = np.maximum(19 - np.argmax(listed[:, ::-1] > 0, axis=1), 4)[:, None]
    zero, one = np.zeros_like(many), np.ones_like(many)
    head, wide = np.concatenate([zero, many - 4, listed, zero], axis=1), np.concatenate([one, 4 * one, 3 * (np.arange(19) < many), one], axis=1)
    extra = np.array([0] * 16 + [bits for bits, _ in REPEATS])[symbol]
    values, sizes = value[of, symbol] | more << size[of, symbol], size[of, symbol] + extra
    ends = np.cumsum(np.bincount(of, minlength=rows)).tolist()
    out, at = [], 0
    for row, end in enumerate(ends):
        out.append((np.concatenate([head[row], values[at:end]]), np.concatenate([wide[row], sizes[at:end]])))
        at = end
    used = lengths > 0
    for row in np.flatnonzero((used.sum(axis=1) <= 2) & ~used[:, LITERALS:].any(axis=1)).tolist():
        out[row] = coded(lengths[row])
    return out


def prefixed(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, how many) of lengths and distances from 1 on."""
    n = n - 1
    k = np.maximum(np.frexp(np.maximum(n, 1).astype(float))[1] - 2, 0)
    return np.where(n < 4, n, 2 * k + 2 + (n >> k & 1)), np.where(n < 4, 0, n & (1 << k) - 1), np.where(n < 4, 0, k)


def earlier(keys: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """For each place the last one before it with the same key, or -1; with ``of``, which ascends, only within the same image."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    key, a, z = keys[order], order[:-1], order[1:]
    same = key[1:] == key[:-1]
    a, z = a[same], z[same]
    if of is not None:
        same = of[a] == of[z]
        a, z = a[same], z[same]
    out[z] = a
    return out


def copies(pixels: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, distance) of runs of pixels that repeat the last ones that began alike, within the same image if ``of`` tells them apart."""
    if len(pixels) < 2:
        return (np.empty(0, np.int64),) * 3
    pair = pixels[:-1].astype(np.uint64) << np.uint64(32) | pixels[1:]
    before = earlier(pair, of)
    back = np.where(before >= 0, np.arange(len(before)) - before, 0)
    if of is not None:
        back[of[:-1] != of[1:]] = 0
    a, z = runs(back)
    keep = (back[a] > 0) & (z - a + 1 >= SHORTEST_COPY)
    found, cursor = [], 0
    for i, j, d in zip(a[keep].tolist(), z[keep].tolist(), back[a[keep]].tolist(), strict=True):
        i, j = max(i, cursor), j + 1
        while j - i >= SHORTEST_COPY:
            n = min(j - i, LONGEST_COPY)
            found.append((i, n, d))
            i += n
        cursor = max(cursor, i)
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def put_image(out: Stream, pixels: np.ndarray, cache: int = 0, main: bool = False, groups: tuple | None = None, width: int = 0) -> None:
    """Pixels as literals, copies and cache hits. ``groups`` (bits, image of group numbers) has a set of codes for each number."""
    n = len(pixels)
    start, size, back = copies(pixels)
    kind = np.zeros(n, np.int8)  # literal, hit, first of a copy, rest of one
    kind[spread(start, size)] = 3
    kind[start] = 2
    slot = np.zeros(n, np.int64)
    if cache:
        slot = (pixels * np.uint32(HASH) >> np.uint32(32 - cache)).astype(np.int64)
        last = earlier(slot)
        kind[(kind == 0) & (last >= 0) & (pixels[last] == pixels)] = 1
    out.put((1, 1), (cache, 4)) if cache else out.put((0, 1))
    of = np.zeros(n, np.int64)
    if main:
        out.put((int(groups is not None), 1))
        if groups is not None:
            bits, numbers = groups
            out.put((bits - 2, 3))
            put_image(out, (numbers.astype(np.uint32) << np.uint32(8)).ravel())
            of = tiled(numbers, bits, n // width, width).ravel().astype(np.int64)
    literal, hit = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    s = samples(pixels)
    ls, lx, ln = prefixed(size)
    ds, dx, dn = prefixed(back + len(NEAR))
    which = [(np.concatenate([literal, hit, start]), np.concatenate([s[literal, 1], LITERALS + LENGTHS + slot[hit], LITERALS + ls]), LITERALS + LENGTHS + (1 << cache if cache else 0))]
    which += [(literal, s[literal, c], LITERALS) for c in (2, 0, 3)] + [(start, ds, DISTANCES)]
    value, bits = np.zeros((n, 6), np.int64), np.zeros((n, 6), np.int64)
    for g in range(int(of.max()) + 1 if n else 1):
        for field, (at, symbol, alphabet) in enumerate(which):
            mine = of[at] == g if groups is not None else slice(None)
            lengths = code_lengths(np.bincount(symbol[mine], minlength=alphabet))
            v, k = codes(lengths)
            out.many(*coded(lengths))
            value[at[mine], field], bits[at[mine], field] = v[symbol[mine]], k[symbol[mine]]
    # a copy's fields: length, its extra bits, distance, its extra bits
    value[start, 1], bits[start, 1] = lx, ln
    value[start, 5], bits[start, 5] = dx, dn
    fields = np.flatnonzero(bits.ravel())
    out.many(value.ravel()[fields], bits.ravel()[fields])


def encode(pixels: np.ndarray, transforms: tuple = (), cache: int = 0, groups: tuple | None = None, text: bool = False) -> bytes:
    """A file of height by width pixels.

    ``transforms`` in the order in which they are applied: (PREDICT, bits, modes), (CROSS, bits, elements), (GREEN,)
    and (PALETTE,), which takes images of at most 256 colours. ``text`` (without transforms and groups) is as in ``encode_texts``.
    """
    if text and not transforms and groups is None:
        return encode_texts([pixels], cache)[0]
    height, width = pixels.shape
    out = Stream()
    out.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))
    for kind, *rest in transforms:
        out.put((1, 1), (kind, 2))
        if kind == PREDICT:
            bits, modes = rest
            s = samples(pixels).astype(np.int64)
            first = np.array([0, 0, 0, 255])
            above = np.concatenate([s[:1], s[:-1]])
            left, corner = (np.concatenate([x[:, :1], x[:, :-1]], axis=1) for x in (s, above))
            after = np.concatenate([above[:, 1:], s[:, :1]], axis=1)
            mode = tiled(modes, bits, *pixels.shape)
            want = np.zeros_like(s)
            for m in np.unique(mode).tolist():
                want = np.where((mode == m)[..., None], predicted(m, left, above, corner, after), want)
            want[:, 0], want[0, 1:] = above[:, 0], s[0, :-1]
            want[0, 0] = first
            pixels = joined(s - want & 255)
            out.put((bits - 2, 3))
            put_image(out, (modes.astype(np.uint32) << np.uint32(8)).ravel())
        elif kind == CROSS:
            bits, elements = rest
            pixels = recoloured(pixels, elements, bits, -1)
            out.put((bits - 2, 3))
            put_image(out, elements.ravel().astype(np.uint32))
        elif kind == GREEN:
            pixels = greened(pixels, -1)
        else:
            table, number = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette has at most 256 colours")
            out.put((len(table) - 1, 8))
            put_image(out, joined(np.diff(samples(table), axis=0, prepend=np.zeros((1, 4), np.uint8))))
            k = bundle(len(table))
            number = np.pad(number.reshape(pixels.shape), ((0, 0), (0, -width % (1 << k)))).reshape(height, -1, 1 << k)
            pixels = ((number << np.arange(1 << k) * (8 >> k)).sum(axis=2) << 8).astype(np.uint32)
    out.put((0, 1))
    put_image(out, np.ascontiguousarray(pixels).ravel(), cache, True, groups, pixels.shape[1])
    return wrapped(out.to_bytes())


def wrapped(body: bytes) -> bytes:
    """A file of one lossless image."""
    data = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(data)).to_bytes(4, "little") + b"WEBP" + data


def encode_texts(images: list[np.ndarray], cache: int = 0) -> list[bytes]:
    """A file of each image, whose samples are bytes of a text: red, blue and alpha have one code.

    Every image has codes of its own and is written as if it were alone; what numpy does is done for all images at once.
    """
    if not images:
        return []
    many, sizes = len(images), np.array([i.size for i in images])
    pixels, of = np.concatenate([np.ascontiguousarray(i).ravel() for i in images]), np.repeat(np.arange(len(images)), sizes)
    start, size, back = copies(pixels, of)
    literal, hit = np.ones(len(pixels), bool), np.zeros(len(pixels), bool)
    literal[spread(start, size)] = False
    if cache:
        slot = (pixels * np.uint32(HASH) >> np.uint32(32 - cache)).astype(np.int64)
        key = of << cache | slot
        last = earlier(key.astype(np.uint16) if many << cache <= 1 << 16 else key)
        hit = literal & (last >= 0) & (pixels[last] == pixels)
        literal &= ~hit
    literal, hit = np.flatnonzero(literal), np.flatnonzero(hit)
    blue, green, red, alpha = samples(pixels[literal]).T.astype(np.int64)
    (ls, lx, ln), (ds, dx, dn) = prefixed(size), prefixed(back + len(NEAR))
    whole = LITERALS + LENGTHS + (1 << cache if cache else 0)
    at = [of[x] for x in (literal, hit, start)]
    hits = LITERALS + LENGTHS + slot[hit] if cache else hit
    codings = []
    for keys, symbols, alphabet in ((at, (green, hits, LITERALS + ls), whole), (at[:1] * 3, (blue, red, alpha), LITERALS), (at[2:], (ds,), DISTANCES)):
        counts = np.bincount(np.concatenate([k * alphabet + s for k, s in zip(keys, symbols, strict=True)]), minlength=many * alphabet)
        lengths = np.stack([code_lengths(c) for c in counts.reshape(many, alphabet)])
        codings.append((coded_each(lengths), *codes(lengths)))
    (_, gv, gn), (_, ov, on), (_, dv, dk) = codings
    # a literal's fields: green and red, blue and alpha; a copy's: length and its extra bits, distance, its extra bits
    value, bits = np.zeros((len(pixels), 3), np.int64), np.zeros((len(pixels), 3), np.int64)
    a = at[0]
    for field, (v, n), (v2, n2) in ((0, (gv[a, green], gn[a, green]), (ov[a, red], on[a, red])), (1, (ov[a, blue], on[a, blue]), (ov[a, alpha], on[a, alpha]))):
        value[literal, field], bits[literal, field] = v | v2 << n, n + n2
    value[hit, 0], bits[hit, 0] = gv[at[1], hits], gn[at[1], hits]
    a, ls = at[2], LITERALS + ls
    value[start, 0], bits[start, 0] = gv[a, ls] | lx << gn[a, ls], gn[a, ls] + ln
    value[start, 1], bits[start, 1], value[start, 2], bits[start, 2] = dv[a, ds], dk[a, ds], dx, dn
    fields = np.flatnonzero(bits)
    value, bits = value.ravel()[fields], bits.ravel()[fields]
    ends, out, first = np.searchsorted(fields, 3 * np.cumsum(sizes)).tolist(), Stream(), 0
    for i, (image, end) in enumerate(zip(images, ends, strict=True)):
        height, width = image.shape
        head = (0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1), *(((1, 1), (cache, 4)) if cache else ((0, 1),)), (0, 1)
        g, o, d = (c[0][i] for c in codings)
        parts = [tuple(zip(*head, strict=True)), g, o, o, o, d, (value[first:end], bits[first:end])]
        for v, n in parts:
            out.many(v, n)
        out.end()
        first = end
    return [wrapped(body) for body in out.bodies()]
