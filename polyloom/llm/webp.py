"""Lossless WebP (VP8L), read and written for many images at once.

The decoder follows the public VP8L bitstream specification: prefix codes (simple and normal, groups chosen by an entropy
image), LZ77 back-references with the two-dimensional distance codes, colour cache, and the inverse predictor, cross-colour,
subtract-green and colour-indexing (palette) transforms. All images of a call go in lock-step: one numpy step reads the next
symbol of every image, so that the cost of Python is shared by thousands of images.

The encoder writes valid streams for pixel arrays: palettes where few colours occur, a colour cache, back-references for longer
repeats, prefix codes by Shannon lengths made complete; predictor modes and cross-colour factors chosen by what they cost, or all transforms on request.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the bitstream: the order of code-length codes, and the (x, y) neighbours of short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_NEAR = np.array(NEIGHBOURS, np.int64)
_REVERSED = [np.array([int(f"{i:0{n}b}"[::-1], 2) if n else 0 for i in range(1 << n)], np.int64) for n in range(16)]


class Broken(ValueError):
    """The stream is not a valid lossless WebP."""


# --- reading --------------------------------------------------------------------------------------------------------


class Bits:
    """A bit position in each of many streams; the lowest bit of a byte comes first."""

    def __init__(self, streams: list[bytes]):
        size = np.array([len(s) for s in streams], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size + 16)])[:-1]
        self.end = (self.begin + size) * 8
        joined = b"".join(s + bytes(16) for s in streams)
        self.words = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
        self.at = self.begin * 8

    def peek(self, lane: np.ndarray) -> np.ndarray:
        """At least 57 bits from the position on."""
        at = self.at[lane]
        return self.words[at >> 3] >> (at & 7).astype(np.uint64)

    def read(self, lane: np.ndarray, n) -> np.ndarray:
        """n bits (a number, or one for each lane) as integers."""
        n = np.asarray(n, np.int64)
        value = (self.peek(lane) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        self.at[lane] += n
        if (self.at[lane] > self.end[lane] + 64).any():
            raise Broken("the stream ends early")
        return value


class Codes:
    """Prefix codes as lookup tables, one after the other: entries are symbol * 16 + length."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lengths: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the table of each row of ``lengths`` begins, and its mask. ``single``: a symbol of length 0, or -1."""
        used = lengths > 0
        alone = np.where((single < 0) & (used.sum(1) == 1), used.argmax(1), single)
        lengths = np.where((alone >= 0)[:, None], 0, lengths)
        depth = lengths.max(1).astype(np.int64) if lengths.shape[1] else np.zeros(len(lengths), np.int64)
        first, mask = np.zeros(len(lengths), np.int64), (np.int64(1) << depth) - 1
        for d in np.unique(depth):
            own = np.flatnonzero(depth == d)
            if d == 0:
                if (alone[own] < 0).any():
                    raise Broken("a code without symbols")
                table = (alone[own] << 4)[:, None]
            else:
                x = lengths[own].astype(np.int64)
                order = np.argsort(np.where(x == 0, 99, x).astype(np.uint8), axis=1, kind="stable")
                sorted_ = np.take_along_axis(x, order, 1)
                times = np.where(sorted_ > 0, np.int64(1) << np.maximum(d - sorted_, 0), 0)
                if (times.sum(1) != 1 << d).any():
                    raise Broken("an incomplete code")
                table = np.repeat((order * 16 + sorted_).ravel(), times.ravel()).reshape(len(own), 1 << d)[:, _REVERSED[d]]
            first[own] = self.size + np.arange(len(own)) * (1 << d)
            self.parts.append(table.ravel().astype(np.int32))
            self.size += table.size
        return first, mask

    def table(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]


def read_code(bits: Bits, lane: np.ndarray, alphabet: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """One prefix code for each lane."""
    lengths = np.zeros((len(lane), int(alphabet.max())), np.uint8)
    single = np.full(len(lane), -1, np.int64)
    simple = bits.read(lane, 1) == 1
    s = np.flatnonzero(simple)
    if len(s):
        own = lane[s]
        two = bits.read(own, 1) == 1
        wide = bits.read(own, 1)
        symbol = bits.read(own, 1 + 7 * wide)
        single[s[~two]] = symbol[~two]
        t = s[two]
        if len(t):
            other = bits.read(lane[t], 8)
            lengths[t, symbol[two]] = 1
            lengths[t, other] = 1
            single[t[symbol[two] == other]] = other[symbol[two] == other]
    c = np.flatnonzero(~simple)
    if len(c):
        own = lane[c]
        count = 4 + bits.read(own, 4)
        inner = np.zeros((len(c), 19), np.uint8)
        for i, symbol in enumerate(LENGTH_ORDER):
            has = np.flatnonzero(count > i)
            inner[has, symbol] = bits.read(own[has], 3)
        limited = bits.read(own, 1) == 1
        left = alphabet[c].copy()
        if limited.any():
            m = own[limited]
            left[limited] = 2 + bits.read(m, 2 + 2 * bits.read(m, 3))
        inner_codes = Codes()
        first, mask = inner_codes.add(inner, np.full(len(c), -1, np.int64))
        table = inner_codes.table()
        symbol, previous = np.zeros(len(c), np.int64), np.full(len(c), 8, np.int64)
        a = np.flatnonzero((left > 0) & (symbol < alphabet[c]))
        while len(a):
            e = table[first[a] + (bits.peek(own[a]).astype(np.int64) & mask[a])]
            bits.at[own[a]] += e & 15
            code = (e >> 4).astype(np.int64)
            left[a] -= 1
            plain = code < 16
            p = a[plain]
            lengths[c[p], symbol[p]] = code[plain]
            previous[p] = np.where(code[plain] > 0, code[plain], previous[p])
            symbol[p] += 1
            for kind, extra, least in ((16, 2, 3), (17, 3, 3), (18, 7, 11)):
                r = a[code == kind]
                if len(r):
                    n = least + bits.read(own[r], extra)
                    if (symbol[r] + n > alphabet[c[r]]).any():
                        raise Broken("a run of code lengths is too long")
                    if kind == 16:
                        for i, k in zip(r.tolist(), n.tolist(), strict=True):
                            lengths[c[i], symbol[i] : symbol[i] + k] = previous[i]
                    symbol[r] += n
            a = a[(left[a] > 0) & (symbol[a] < alphabet[c[a]])]
    return codes.add(lengths, single)


def from_prefix(bits: Bits, lane: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The value of a length or distance symbol with its extra bits."""
    extra = np.maximum((symbol - 2) >> 1, 0)
    offset = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra)
    return offset + bits.read(lane, extra) + 1


def read_pixels(bits: Bits, lane: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray]:
    """An entropy-coded image (with groups of codes if ``main``) for each lane: its pixels as 0xAARRGGBB."""
    m = len(lane)
    cached = bits.read(lane, 1) == 1
    cache_bits = np.zeros(m, np.int64)
    if cached.any():
        cache_bits[cached] = bits.read(lane[cached], 4)
        if ((cache_bits[cached] < 1) | (cache_bits[cached] > 11)).any():
            raise Broken("colour cache bits")
    groups, block, meta = np.ones(m, np.int64), np.zeros(m, np.int64), [None] * m
    if main:
        many = np.flatnonzero(bits.read(lane, 1) == 1)
        if len(many):
            block[many] = 2 + bits.read(lane[many], 3)
            w, h = (width[many] + (1 << block[many]) - 1) >> block[many], (height[many] + (1 << block[many]) - 1) >> block[many]
            for i, x in zip(many.tolist(), read_pixels(bits, lane[many], w, h, False), strict=True):
                meta[i] = (x >> 8 & 0xFFFF).astype(np.int64)
                groups[i] = meta[i].max() + 1
    codes = Codes()
    base = np.cumsum(groups) - groups
    first, mask = np.zeros((int(groups.sum()), 5), np.int64), np.zeros((int(groups.sum()), 5), np.int64)
    for g in range(int(groups.max())):
        own = np.flatnonzero(groups > g)
        for k in range(5):
            size = 280 + np.where(cached[own], 1 << cache_bits[own], 0) if k == 0 else np.full(len(own), 40 if k == 4 else 256)
            first[base[own] + g, k], mask[base[own] + g, k] = read_code(bits, lane[own], size, codes)
    table = codes.table()
    total = width * height
    begin = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint32)
    stride = 1 << int(cache_bits.max())
    cache = np.zeros(m * stride if cached.any() else 1, np.uint32)
    shift = (32 - cache_bits).astype(np.uint64)

    def remember(i: np.ndarray, pixel: np.ndarray) -> None:
        own = cached[i]
        if own.any():
            slot = (pixel[own].astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> shift[i[own]]
            cache[i[own] * stride + slot.astype(np.int64)] = pixel[own]

    done = np.zeros(m, np.int64)
    a = np.flatnonzero(total > 0)
    several = bool((groups > 1).any())
    group = base.copy()
    while len(a):
        if several:
            for i in a[groups[a] > 1].tolist():
                x, y = done[i] % width[i], done[i] // width[i]
                group[i] = base[i] + meta[i][(y >> block[i]) * ((width[i] + (1 << block[i]) - 1) >> block[i]) + (x >> block[i])]
        g = group[a]
        own = lane[a]
        seen = bits.peek(own)
        e = table[first[g, 0] + (seen.astype(np.int64) & mask[g, 0])].astype(np.int64)
        n = e & 15
        green = e >> 4
        literal = green < 256
        whole = literal.all()
        i = a if whole else a[literal]
        if len(i):
            gi, si, ni, value = (g, seen, n, green) if whole else (g[literal], seen[literal], n[literal], green[literal])
            pixel = value << 8
            for k, by in ((1, 16), (2, 0)):
                e = table[first[gi, k] + ((si >> ni.astype(np.uint64)).astype(np.int64) & mask[gi, k])].astype(np.int64)
                ni = ni + (e & 15)
                pixel |= (e >> 4) << by
            oi = own if whole else own[literal]
            bits.at[oi] += ni
            e = table[first[gi, 3] + (bits.peek(oi).astype(np.int64) & mask[gi, 3])].astype(np.int64)
            bits.at[oi] += e & 15
            pixel = (pixel | (e >> 4) << 24).astype(np.uint32)
            out[begin[i] + done[i]] = pixel
            remember(i, pixel)
            done[i] += 1
        if not whole:
            bits.at[own[~literal]] += n[~literal]
            from_cache = green >= 280
            i = a[from_cache]
            if len(i):
                if (~cached[i]).any():
                    raise Broken("a colour cache symbol without a cache")
                pixel = cache[i * stride + green[from_cache] - 280]
                out[begin[i] + done[i]] = pixel
                remember(i, pixel)
                done[i] += 1
            copy = ~literal & ~from_cache
            i = a[copy]
            if len(i):
                oi, gi = own[copy], g[copy]
                length = from_prefix(bits, oi, green[copy] - 256)
                e = table[first[gi, 4] + (bits.peek(oi).astype(np.int64) & mask[gi, 4])].astype(np.int64)
                bits.at[oi] += e & 15
                code = from_prefix(bits, oi, e >> 4)
                near = _NEAR[np.minimum(code, 120) - 1]
                distance = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[i]))
                if ((distance > done[i]) | (done[i] + length > total[i])).any():
                    raise Broken("a back-reference leaves the image")
                for j, k, d in zip(i.tolist(), length.tolist(), distance.tolist(), strict=True):
                    at = begin[j] + done[j]
                    source = out[at - d : at - d + min(d, k)]
                    out[at : at + k] = source if d >= k else np.resize(source, k)
                    if cached[j]:  # of equal slots the last one stays
                        slot = (out[at : at + k].astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> shift[j]
                        cache[j * stride + slot.astype(np.int64)] = out[at : at + k]
                    done[j] += k
        a = a[done[a] < total[a]]
    if (bits.at[lane] > bits.end[lane]).any():
        raise Broken("the stream ends early")
    return [out[b : b + t] for b, t in zip(begin, total, strict=True)]


def _channels(x: np.ndarray) -> np.ndarray:
    """Pixels as bytes A, R, G, B in the last axis."""
    return np.stack([x >> 24 & 255, x >> 16 & 255, x >> 8 & 255, x & 255], -1).astype(np.int64)


def _pixels(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_right, top_left):
    """The prediction of a pixel from its neighbours, for each channel."""
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0])
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return ((left + top_right) // 2 + top) // 2
    if mode in (6, 7, 8, 9):
        x, y = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return (x + y) // 2
    if mode == 10:
        return ((left + top_left) // 2 + (top + top_right) // 2) // 2
    if mode == 11:
        guess = left + top - top_left
        return np.where((np.abs(guess - left).sum(-1) < np.abs(guess - top).sum(-1))[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    average = (left + top) // 2
    return np.clip(average + np.trunc((average - top_left) / 2).astype(np.int64), 0, 255)


_BLACK = np.array([255, 0, 0, 0], np.uint8)
#: Modes that need no more than the pixel on the left, or the one above: whole rows of many images are done at once.
BY_ROWS = (0, 1, 2, 14, 15)


def _modes(data: np.ndarray) -> np.ndarray:
    return data >> 8 & 15


def inverse_predictors(jobs: list[tuple[np.ndarray, int, int, int, np.ndarray]]) -> list[np.ndarray]:
    """Undo the predictor of many images (pixels, width, height, block size, mode image): those of one mode a row by rows, the others by pixels, all images of one width at once."""
    out: list = [None] * len(jobs)
    groups: dict[tuple[int, bool], list[int]] = {}
    for i, (_, w, _, size, data) in enumerate(jobs):
        groups.setdefault((w, w <= 1 << size and bool(np.isin(_modes(data), BY_ROWS).all())), []).append(i)
    for (w, by_rows), own in groups.items():
        own.sort(key=lambda i: -jobs[i][2])
        height = np.array([jobs[i][2] for i in own])
        c = np.zeros((len(own), int(height[0]), w, 4), np.uint8)
        for k, i in enumerate(own):
            c[k, : jobs[i][2]] = jobs[i][0].astype(">u4").view(np.uint8).reshape(-1, w, 4)
        (_rows_back if by_rows else _pixels_back)(c, height, [jobs[i] for i in own])
        for k, i in enumerate(own):
            out[i] = c[k, : jobs[i][2]].reshape(-1).view(">u4").astype(np.uint32)
    return out


def _rows_back(c: np.ndarray, height: np.ndarray, jobs: list[tuple]) -> None:
    """In place; images stand by falling height."""
    mode = np.zeros(c.shape[:2], np.uint8)
    for k, (_, _, h, size, data) in enumerate(jobs):
        mode[k, :h] = np.repeat(_modes(data), 1 << size)[:h]
    c[:, 0, 0] += _BLACK
    c[:, 0] = np.cumsum(c[:, 0], axis=1, dtype=np.uint8)
    for y in range(1, c.shape[1]):
        n = int(np.searchsorted(-height, -y, "left"))
        row, above, m = c[:n, y], c[:n, y - 1], mode[:n, y]
        row[:, 0] += above[:, 0]
        left, top = m == 1, m == 2
        black = ~(left | top)
        if black.all():
            row[:, 1:] += _BLACK
            continue
        if black.any():
            row[black, 1:] += _BLACK
        if left.any():
            row[left] = np.cumsum(row[left], axis=1, dtype=np.uint8)
        if top.any():
            row[top, 1:] += above[top, 1:]


def _pixels_back(c: np.ndarray, height: np.ndarray, jobs: list[tuple]) -> None:
    """In place; images stand by falling height."""
    n, _, w, _ = c.shape
    flat = c.reshape(n, -1, 4)
    c[:, 0, 0] += _BLACK
    c[:, 0] = np.cumsum(c[:, 0], axis=1, dtype=np.uint8)
    for y in range(1, c.shape[1]):
        n = int(np.searchsorted(-height, -y, "left"))
        c[:n, y, 0] += c[:n, y - 1, 0]
        for x in range(1, w):
            mode = np.array([_modes(data)[(y >> size) * ((w + (1 << size) - 1) >> size) + (x >> size)] for _, _, _, size, data in jobs[:n]])
            at = y * w + x
            near = [flat[:n, at - k].astype(np.int64) for k in (1, w, w - 1, w + 1)]
            for m in np.unique(mode):
                own = np.flatnonzero(mode == m)
                flat[own, at] += predict(int(m), *(z[own] for z in near)).astype(np.uint8)


def forward_predictor(pixels: np.ndarray, w: int, h: int, size: int, data: np.ndarray) -> np.ndarray:
    modes = _modes(data)
    c = _channels(pixels).reshape(h, w, 4)
    guess = np.zeros_like(c)
    guess[0, 0] = _BLACK
    guess[0, 1:] = c[0, :-1]
    guess[1:, 0] = c[:-1, 0]
    if h > 1 and w > 1:
        y, x = np.mgrid[1:h, 1:w]
        mode = modes[(y >> size) * ((w + (1 << size) - 1) >> size) + (x >> size)]
        flat = c.reshape(-1, 4)
        near = [flat[y * w + x - k] for k in (1, w, w - 1, w + 1)]
        for m in np.unique(mode):
            own = mode == m
            guess[1:, 1:][own] = predict(int(m), *(z[own] for z in near))
    return _pixels(((c - guess) & 255).reshape(-1, 4))


def _bits(values: np.ndarray, image: np.ndarray, images: int) -> np.ndarray:
    """What the bytes of each row of (rows, width, channels) cost, in 64ths of a bit, under the distribution of their channel in their own image."""
    out = np.zeros(len(values), np.int64)
    total = np.bincount(image, minlength=images).astype(np.float32) * values.shape[1]
    base = (image << 8).astype(np.int32)[:, None]
    total = np.repeat(total, 256)
    for k in range(values.shape[2]):
        at = base + values[:, :, k]
        n = np.bincount(at.ravel(), minlength=images << 8)
        cost = np.round(np.log2(total / np.maximum(n, 1)) * 64).astype(np.int32)  # whole 64ths, so that no order of summing matters
        out += cost[at].sum(1)
    return out


def chosen_transforms(data: list[np.ndarray], width: np.ndarray, height: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For images of one width of at most a block: the pixels after predictor and cross-colour, the predictor's modes of each band of rows, and the cross-colour factors (all zero where none pays).

    Of the modes black, left and top, and of red and blue with and without green, each band takes what costs the fewest bits.
    """
    w = int(width[0])
    rows = np.concatenate(data).astype(">u4").view(np.uint8).reshape(-1, w, 4)
    first = np.cumsum(height) - height
    opens = np.zeros(len(rows), bool)
    opens[first] = True
    place = np.arange(len(rows)) - np.repeat(first, height)
    band = np.flatnonzero(place % (1 << size) == 0)
    of = np.repeat(np.arange(len(band)), np.diff(np.append(band, len(rows))))
    image = np.repeat(np.arange(len(data)), height)
    bits = lambda x: np.add.reduceat(_bits(x, image, len(data)), band)
    above = np.roll(rows, 1, axis=0)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    edge = np.where(opens[:, None], rows[:, 0] - _BLACK, rows[:, 0] - above[:, 0])
    ways = [rows - _BLACK, left, rows - above]
    for x in ways:
        x[:, 0] = edge
        x[opens, 1:] = left[opens, 1:]
    mode = np.argmin([bits(x) for x in ways], axis=0)
    out = np.choose(mode[of][:, None, None], ways)
    green = out[:, :, 2]
    factor = np.zeros(len(band), np.int64)
    for channel, shift in ((1, 0), (3, 8)):
        own = out[:, :, channel]
        without, with_ = (bits(x[:, :, None]) for x in (own, own - green))
        pays = with_ + 8 * 64 < without
        factor |= np.where(pays, 32 << shift, 0)
        own -= np.where(pays[of][:, None], green, 0).astype(np.uint8)
    cut = np.cumsum(height * w)[:-1]
    many = -(-height // (1 << size))
    split = lambda x: np.split(x.astype(np.uint32), np.cumsum(many)[:-1])
    return np.split(out.reshape(-1).view(">u4").astype(np.uint32), cut), split(mode << 8), split(factor)


def cross_colours(jobs: list[tuple[np.ndarray, int, int, int, np.ndarray]], inverse: bool) -> list[np.ndarray]:
    """Add (or subtract) to red and blue what their block's factors make of green and red, for many images (pixels, width, height, block size, factors) at once."""
    factor = []
    for _, w, h, size, data in jobs:
        y, x = np.divmod(np.arange(w * h), w)
        factor.append(data[(y >> size) * ((w + (1 << size) - 1) >> size) + (x >> size)])
    factor = np.concatenate(factor)
    signed = lambda v: ((v & 255).astype(np.int32) ^ 128) - 128
    to_red, to_blue, red_to_blue = signed(factor), signed(factor >> 8), signed(factor >> 16)
    c = np.concatenate([j[0] for j in jobs]).astype(">u4").view(np.uint8).reshape(-1, 4).astype(np.int32)
    green = signed(c[:, 2])
    sign = 1 if inverse else -1
    before = c[:, 1].copy()
    c[:, 1] = (c[:, 1] + sign * (to_red * green >> 5)) & 255
    red = signed(c[:, 1] if inverse else before)
    c[:, 3] = (c[:, 3] + sign * ((to_blue * green >> 5) + (red_to_blue * red >> 5))) & 255
    return np.split(_pixels(c), np.cumsum([len(j[0]) for j in jobs])[:-1])


def cross_colour(pixels: np.ndarray, w: int, h: int, size: int, data: np.ndarray, inverse: bool) -> np.ndarray:
    return cross_colours([(pixels, w, h, size, data)], inverse)[0]


def inverse_predictor(pixels: np.ndarray, w: int, h: int, size: int, data: np.ndarray) -> np.ndarray:
    return inverse_predictors([(pixels, w, h, size, data)])[0]


def subtract_green(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    c = _channels(pixels)
    c[:, 1::2] = (c[:, 1::2] + (1 if inverse else -1) * c[:, 2:3]) & 255
    return _pixels(c)


def inverse_palette(pixels: np.ndarray, w: int, h: int, packed: int, colours: np.ndarray) -> np.ndarray:
    """Indices in green (several to a pixel if ``packed``) to colours; an index beyond the palette is transparent black."""
    row = (w + (1 << packed) - 1) >> packed
    index = (pixels >> 8 & 255).astype(np.int64).reshape(h, row)
    each = 8 >> packed
    if packed:
        index = (index[:, :, None] >> (np.arange(1 << packed) * each) & ((1 << each) - 1)).reshape(h, -1)[:, :w]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index.ravel()]


def _packing(n):
    return np.where(n <= 2, 3, np.where(n <= 4, 2, np.where(n <= 16, 1, 0)))


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file, height x width, as 0xAARRGGBB."""
    try:
        return _decode(files) if files else []
    except IndexError as e:
        raise Broken("the stream leads outside itself") from e


def _decode(files: list[bytes]) -> list[np.ndarray]:
    streams = []
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20:21] != b"/" or len(f) < 25:
            raise Broken("no lossless WebP")
        streams.append(f[21 : 20 + struct.unpack("<I", f[16:20])[0]])
    bits = Bits(streams)
    lane = np.arange(len(files))
    width, height = bits.read(lane, 14) + 1, bits.read(lane, 14) + 1
    bits.read(lane, 1)
    if bits.read(lane, 3).any():
        raise Broken("version")
    steps: list[list] = [[] for _ in files]
    now = width.copy()
    open_ = lane[bits.read(lane, 1) == 1]
    while len(open_):
        kinds = bits.read(open_, 2)
        for kind in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE):
            own = open_[kinds == kind]
            if not len(own):
                continue
            if any(kind == s[0] for i in own for s in steps[i]):
                raise Broken("a transform twice")
            if kind == PALETTE:
                n = bits.read(own, 8) + 1
                for i, k, x in zip(own.tolist(), n.tolist(), read_pixels(bits, own, n, np.ones(len(own), np.int64), False), strict=True):
                    packed = int(_packing(k))
                    steps[i].append((kind, int(now[i]), packed, _pixels(np.cumsum(_channels(x), 0) & 255)))
                    now[i] = (now[i] + (1 << packed) - 1) >> packed
            elif kind == SUBTRACT_GREEN:
                for i in own.tolist():
                    steps[i].append((kind,))
            else:
                size = bits.read(own, 3) + 2
                w, h = (now[own] + (1 << size) - 1) >> size, (height[own] + (1 << size) - 1) >> size
                for i, k, x in zip(own.tolist(), size.tolist(), read_pixels(bits, own, w, h, False), strict=True):
                    steps[i].append((kind, int(now[i]), k, x))
        open_ = open_[bits.read(open_, 1) == 1]
    out = read_pixels(bits, lane, now, height, True)
    while any(steps):  # the last transform of every image, then the one before it
        last = {i: own.pop() for i, own in enumerate(steps) if own}
        for kind, many in ((PREDICTOR, inverse_predictors), (CROSS_COLOUR, lambda jobs: cross_colours(jobs, True))):
            own = [i for i, step in last.items() if step[0] == kind]
            if own:
                for i, x in zip(own, many([(out[i], last[i][1], int(height[i]), *last[i][2:]) for i in own]), strict=True):
                    out[i] = x
        for i, step in last.items():
            if step[0] == SUBTRACT_GREEN:
                out[i] = subtract_green(out[i], True)
            elif step[0] == PALETTE:
                out[i] = inverse_palette(out[i], step[1], int(height[i]), *step[2:])
    return [x.reshape(h, w) for x, h, w in zip(out, height.tolist(), width.tolist(), strict=True)]


# --- writing --------------------------------------------------------------------------------------------------------

_DEPTH = 12  # Shannon lengths of at most 4096 counts


def by_small(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of numbers below ``most``, sixteen bits at a time (which numpy sorts by counting)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if most > 1 << 16:
        order = order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Writer:
    """Tokens (stream, value, bits) in the order of writing within a stream, packed at the end."""

    def __init__(self, streams: int):
        self.streams, self.tokens = streams, []

    def put(self, stream: np.ndarray, value, n) -> None:
        stream = np.asarray(stream, np.int64)
        self.tokens.append((stream, np.broadcast_to(np.asarray(value, np.uint64), stream.shape), np.broadcast_to(np.asarray(n, np.int64), stream.shape)))

    def packed(self) -> list[bytes]:
        stream, value, n = (np.concatenate(x) for x in zip(*self.tokens, strict=True))
        order = by_small(stream, self.streams)
        stream, value, n = stream[order], value[order], n[order]
        size = (np.bincount(stream, n, self.streams).astype(np.int64) + 7) // 8
        begin = np.cumsum(size) - size
        ends = np.cumsum(n)
        whole = np.bincount(stream, n, self.streams).astype(np.int64)
        at = ends - n - (np.cumsum(whole) - whole)[stream] + begin[stream] * 8
        some = np.flatnonzero(n)
        at, value, n = at[some], value[some], n[some]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros(int(size.sum()) // 8 + 2, "<u8")
        new = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        if len(new):  # tokens stand in order and do not overlap, so sums are disjunctions
            out[word[new]] = np.add.reduceat(value << shift, new)
            over = np.flatnonzero((at & 63) + n > 64)
            out[word[over] + 1] += value[over] >> (np.uint64(64) - shift[over])
        data = out.tobytes()
        return [data[b : b + s] for b, s in zip(begin, size, strict=True)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete prefix-code lengths for each row of counts with two symbols or more: Shannon's, then the slack is given to the most costly that fit."""
    total = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(counts > 0, np.clip(np.ceil(-np.log2(counts / total) - 1e-12), 1, _DEPTH), 0).astype(np.int64)
    many = (counts > 0).sum(1) > 1
    slack = np.where(many, (1 << _DEPTH) - np.where(x > 0, 1 << (_DEPTH - x), 0).sum(1), 0)
    while slack.any():
        for d in range(2, _DEPTH + 1):
            rows = np.flatnonzero(slack >> (_DEPTH - d) > 0)
            if not len(rows):
                continue
            own = x[rows] == d
            take = own & (np.cumsum(own, 1, dtype=np.int16) <= (slack[rows] >> (_DEPTH - d))[:, None])
            x[rows] -= take
            slack[rows] -= take.sum(1) << (_DEPTH - d)
    return x


#: The reversed values of each length, one after the other, and where those of a length begin.
_ALL_REVERSED = np.concatenate(_REVERSED)
_REVERSED_AT = np.array([(1 << n) - 1 for n in range(16)])


def codewords(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of each row, bits reversed as they are written."""
    rows = len(lengths)
    order = np.argsort(lengths.astype(np.uint8), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, 1)
    count = np.bincount((np.arange(rows)[:, None] * 16 + lengths).ravel(), minlength=rows * 16).reshape(rows, 16)
    start = np.cumsum(count, 1) - count
    first = np.zeros((rows, 16), np.int64)
    for d in range(2, _DEPTH + 1):
        first[:, d] = first[:, d - 1] + count[:, d - 1] << 1
    value = np.take_along_axis(first - start, own, 1) + np.arange(lengths.shape[1])
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, np.where(own > 0, _ALL_REVERSED[np.where(own > 0, value, 0) + _REVERSED_AT[own]], 0), 1)
    return out


def write_codes(out: Writer, stream: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write one prefix code for each stream; its codewords and lengths. A code of at most one symbol is a simple one, without bits."""
    used = (counts > 0).sum(1)
    one = used <= 1
    symbol = counts.argmax(1)
    if (symbol[one] > 255).any():
        raise ValueError("a single symbol beyond 255")
    s = stream[one]
    out.put(s, 1, 1)
    out.put(s, 0, 1)
    out.put(s, 1, 1)
    out.put(s, symbol[one].astype(np.uint64), 8)
    many = np.flatnonzero(~one)
    x, code = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
    if len(many):
        x[many] = code_lengths(counts[many])
        code[many] = codewords(x[many])
        s = stream[many]
        out.put(s, 0, 1)
        out.put(s, 19 - 4, 4)
        for c in LENGTH_ORDER:  # sixteen code-length symbols of four bits
            out.put(s, 4 if c <= 12 or c >= 16 else 0, 3)
        out.put(s, 0, 1)
        names = [*range(13), 16, 17, 18]
        plain = np.zeros(19, np.int64)
        plain[names] = _REVERSED[4][:16]
        own = x[many]
        flat = own.ravel()
        width = own.shape[1]
        edge = np.ones(len(flat), bool)
        edge[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
        edge[::width] = True
        at = np.flatnonzero(edge)
        run = np.diff(np.append(at, len(flat)))
        zero = flat[at] == 0
        # a run of zeros: whole 138s, then one of 11..138, or of 3..10, or one or two plain zeros
        full = np.where(zero, run // 138, 0)
        rest = np.where(zero, run % 138, 1)
        tail = np.where(zero, np.where(rest >= 3, 1, rest), 1)
        times = full + tail
        which = np.repeat(np.arange(len(at)), times)
        place = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        big = place < full[which]
        r = rest[which]
        z = zero[which]
        named = np.where(big, 18, np.where(~z, flat[at][which], np.where(r >= 11, 18, np.where(r >= 3, 17, 0))))
        extra = np.where(big, 127, np.where(named == 18, r - 11, np.where(named == 17, r - 3, 0)))
        extra_bits = np.where(named == 18, 7, np.where(named == 17, 3, 0))
        out.put(s[at[which] // width], (plain[named] | extra << 4).astype(np.uint64), 4 + extra_bits)
    return code, x


def to_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for lengths and distance codes."""
    v = value - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = v >> np.maximum(high - 1, 0) & 1
    symbol = np.where(v < 4, v, 2 * high + second)
    extra = np.maximum((symbol - 2) >> 1, 0)
    return symbol, v & ((1 << extra) - 1), extra


def repeats(pixel: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy back-references: for each pixel the length of the copy that starts there (0: none, -1: within one), and its distance."""
    n = len(pixel)
    length, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < least:
        return length, distance
    image = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    key = np.zeros(n - least + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(least):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + pixel[i : i + len(key)]
        key = key * np.uint64(0x9E3779B97F4A7C15)
    order = by_small((key >> np.uint64(48)).astype(np.int64) | image[: len(key)] << 16, len(begin) << 16)
    own, whose = key[order], image[order]
    same = (own[1:] == own[:-1]) & (whose[1:] == whose[:-1])
    back = np.full(len(key), -1, np.int64)
    back[order[1:][same]] = order[:-1][same]
    free = 0
    for i in np.flatnonzero(back >= 0).tolist():
        if i < free:
            continue
        end = begin[image[i] + 1]
        j = back[i]
        k = 0
        limit = min(end - i, 4096)
        differ = np.flatnonzero(pixel[i : i + limit] != pixel[j : j + limit])
        k = int(differ[0]) if len(differ) else int(limit)
        if k >= least:
            length[i], distance[i] = k, i - j
            length[i + 1 : i + k] = -1
            free = i + k
    return length, distance


def write_pixels(out: Writer, images: list[np.ndarray], stream: np.ndarray, widths: np.ndarray, main: bool, cache_bits: int, least: int) -> None:
    """An entropy-coded image for each stream, with one group of codes."""
    size = np.array([len(x) for x in images], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    pixel = np.concatenate(images)
    image = np.repeat(np.arange(len(images)), size)
    length, distance = repeats(pixel, begin, least) if least else (np.zeros(len(pixel), np.int64), None)
    kept = np.flatnonzero(length >= 0)
    copies = length[kept] > 0
    hit = np.zeros(len(pixel), bool)
    slot = np.zeros(len(pixel), np.int64)
    if cache_bits:
        slot = ((pixel.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        order = by_small(image * (1 << cache_bits) + slot, len(images) << cache_bits)
        o = order
        hit[o[1:]] = (image[o[1:]] == image[o[:-1]]) & (slot[o[1:]] == slot[o[:-1]]) & (pixel[o[1:]] == pixel[o[:-1]])
    p, i = pixel[kept].astype(np.int64), image[kept]
    from_cache = hit[kept] & ~copies
    literal = ~copies & ~from_cache
    n_green = 280 + ((1 << cache_bits) if cache_bits else 0)
    symbol = np.where(from_cache, 280 + slot[kept], p >> 8 & 255)
    extra = extra_bits = near = None
    if copies.any():
        code, extra, extra_bits = to_prefix(length[kept][copies])
        symbol[copies] = 256 + code
        d = distance[kept][copies]
        near, near_extra, near_bits = to_prefix(d + 120)
    count = lambda v, who, n: np.bincount(who * n + v, minlength=len(images) * n).reshape(len(images), n)
    counts = [count(symbol, i, n_green), *(count(p[literal] >> by & 255, i[literal], 256) for by in (16, 0, 24)), count(near, i[copies], 40) if near is not None else np.zeros((len(images), 40), np.int64)]
    out.put(stream, 1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(stream, cache_bits, 4)
    if main:
        out.put(stream, 0, 1)
    words, bits = zip(*(write_codes(out, stream, c) for c in counts), strict=True)
    value, n = words[0][i, symbol], bits[0][i, symbol]
    li = i[literal]
    for k, by in ((1, 16), (2, 0), (3, 24)):
        v = p[literal] >> by & 255
        value[literal] |= words[k][li, v] << n[literal]
        n[literal] += bits[k][li, v]
    if near is not None:
        ci = i[copies]
        value[copies] |= extra << n[copies]
        n[copies] += extra_bits
        value[copies] |= words[4][ci, near] << n[copies]
        n[copies] += bits[4][ci, near]
        value[copies] |= near_extra << n[copies]
        n[copies] += near_bits
    out.put(stream[i], value.astype(np.uint64), n)


def encode(images: list[np.ndarray], *, cache_bits: int = 8, least: int = 4, palette: int = 16, transforms: tuple[int, ...] | None = (), block: int = 3) -> list[bytes]:
    """WebP files of images (height x width, 0xAARRGGBB). ``palette``: most colours for which a palette is written; ``transforms`` are applied in order before.

    With ``transforms`` None, images of one width (a block at most) get a predictor with a mode chosen for each band of rows, and cross-colour where it pays, unless they get a palette.
    """
    if not images:
        return []
    streams = np.arange(len(images))
    out = Writer(len(images))
    height, width = (np.array([x.shape[k] for x in images], np.int64) for k in (0, 1))
    out.put(streams, (width - 1).astype(np.uint64), 14)
    out.put(streams, (height - 1).astype(np.uint64), 14)
    out.put(streams, 1, 1)
    out.put(streams, 0, 3)
    data = [np.ascontiguousarray(x, np.uint32).ravel() for x in images]
    for kind in transforms or ():
        out.put(streams, 1 | kind << 1, 3)
        if kind == SUBTRACT_GREEN:
            data = [subtract_green(x, False) for x in data]
            continue
        out.put(streams, block - 2, 3)
        small = [(-(-int(w) // (1 << block)), -(-int(h) // (1 << block))) for w, h in zip(width, height, strict=True)]
        if kind == PREDICTOR:
            factors = [(np.arange(a * b, dtype=np.uint32) % 14) << 8 for a, b in small]
            data = [forward_predictor(x, int(w), int(h), block, f) for x, w, h, f in zip(data, width, height, factors, strict=True)]
        else:
            factors = [np.arange(a * b, dtype=np.uint32) * np.uint32(0x070B0D) & np.uint32(0xFFFFFF) for a, b in small]
            data = [cross_colour(x, int(w), int(h), block, f, False) for x, w, h, f in zip(data, width, height, factors, strict=True)]
        write_pixels(out, factors, streams, np.array([a for a, _ in small]), False, 0, 0)
    few: list[int] = []
    if palette:
        colours = {}
        for i, x in enumerate(data):
            if len(x) < 64 or len(np.unique(x[:: max(1, len(x) // 64)])) <= palette:
                c = np.unique(x)
                if len(c) <= min(palette, 256):
                    colours[i] = c
                    few.append(i)
        if few:
            own = np.array(few)
            out.put(own, 1 | PALETTE << 1, 3)
            out.put(own, np.array([len(colours[i]) - 1 for i in few], np.uint64), 8)
            tables = []
            for i in few:
                c = _channels(colours[i])
                tables.append(_pixels(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255))
            write_pixels(out, tables, own, np.array([len(t) for t in tables]), False, 0, 0)
            for i in few:
                packed = int(_packing(len(colours[i])))
                index = np.searchsorted(colours[i], data[i]).reshape(height[i], width[i])
                each = 8 >> packed
                row = -(-int(width[i]) // (1 << packed))
                index = np.pad(index, ((0, 0), (0, (row << packed) - int(width[i])))).reshape(height[i], row, 1 << packed)
                data[i] = (0xFF000000 | (index << (np.arange(1 << packed) * each)).sum(2) << 8).astype(np.uint32).ravel()
    plain = np.setdiff1d(streams, few)
    if transforms is None and len(plain) and (width == width[0]).all() and width[0] <= 1 << block:
        made, modes, factors = chosen_transforms([data[i] for i in plain], width[plain], height[plain], block)
        for i, x in zip(plain.tolist(), made, strict=True):
            data[i] = x
        out.put(plain, 1 | PREDICTOR << 1, 3)
        out.put(plain, block - 2, 3)
        write_pixels(out, modes, plain, np.ones(len(plain), np.int64), False, 0, 0)
        paid = [k for k, f in enumerate(factors) if f.any()]
        if paid:
            own = plain[paid]
            out.put(own, 1 | CROSS_COLOUR << 1, 3)
            out.put(own, block - 2, 3)
            write_pixels(out, [factors[k] for k in paid], own, np.ones(len(own), np.int64), False, 0, 0)
    out.put(streams, 0, 1)
    write_pixels(out, data, streams, width, True, cache_bits, least)
    files = []
    for body in out.packed():
        chunk = b"/" + body
        padded = chunk + b"\0" * (len(chunk) & 1)
        files.append(b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded)
    return files
