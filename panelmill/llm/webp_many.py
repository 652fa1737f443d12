"""Lossless WebP for many images at once: the images are lanes that numpy writes and reads in step.

What `webp` does symbol by symbol for one image is done here one symbol of every lane at a time. A lane with
something that isn't handled here is read by `webp.decode`.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from panelmill.llm.webp import (
    CACHE_FACTOR, CROSS_COLOUR, DISTANCE_PREFIXES, LENGTH_ORDER, LENGTH_PREFIXES, NEAR, PALETTE, PREDICTOR, SIGNATURE, SUBTRACT_GREEN, BadImage,
    Bits, Options, Writer, _channels, _header, _joined, _write_pixels, code_lengths, cross_colour, decode, invert, read_transforms, reversals)

#: The longest prefix code that is written, and that lanes read.
LONGEST = 11
#: Lanes, and pixels, handled together; fewer lanes are read one by one.
LANES, PIXELS, FEW = 2048, 1 << 21, 64
GREEN_SYMBOLS = 256 + LENGTH_PREFIXES
#: Block bits of predictor and cross-colour images: one block is 512 pixels wide and high.
BLOCK_BITS = 9


# ---------------------------------------------------------------- writing


def lengths_many(counts: np.ndarray, most: int) -> np.ndarray:
    """Rows of `code_lengths`."""
    rows, width = counts.shape
    used = counts > 0
    many = used.sum(axis=1)
    order = np.argsort(-counts, axis=1, kind="stable")[:, : max(2, int(many.max(initial=0)))]
    sorted_counts = np.take_along_axis(counts, order, 1)
    there = sorted_counts > 0
    total = counts.sum(axis=1, keepdims=True)
    size = np.clip(np.ceil(np.log2(np.maximum(total, 1) / np.maximum(sorted_counts, 1))), 1, most).astype(np.int64)
    unit = np.where(there, 1 << (most - size), 0)
    spare = (1 << most) - unit.sum(axis=1)
    spare[many < 2] = 0
    over = np.flatnonzero(spare < 0)  # too many rare symbols: one by one
    spare[over] = 0
    while (spare > 0).any():
        for k in range(unit.shape[1]):
            grow = there[:, k] & (unit[:, k] <= spare)
            spare -= np.where(grow, unit[:, k], 0)
            unit[:, k] <<= grow
    out = np.zeros((rows, width), np.int64)
    final = np.where(there, most - np.log2(np.maximum(unit, 1)).astype(np.int64), 0)
    final[many == 1] = there[many == 1]
    np.put_along_axis(out, order, final, 1)
    for k in over.tolist():
        out[k] = code_lengths(counts[k], most)
    return out


def codes_many(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's symbols the code as it is read, and its length; a code of one symbol takes no bits."""
    value, size = np.zeros_like(lengths), lengths.copy()
    size[(lengths > 0).sum(axis=1) < 2] = 0
    row, symbol = np.nonzero(size)
    n = size[row, symbol]
    order = np.lexsort((symbol, n, row))
    row, symbol, n = row[order], symbol[order], n[order]
    step = 1 << (15 - n)  # a row's steps add up to 1 << 15
    value[row, symbol] = reversals(15)[(np.cumsum(step) - step) & 0x7FFF]
    return value, size


class _Lanes:
    """Bits of all lanes, part by part; the entries of a part are sorted by lane."""

    def __init__(self, n: int):
        self.n = n
        self.done = np.zeros(n, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, lane: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """Entries have 21 bits at most."""
        total = np.bincount(lane, bits, self.n).astype(np.int64)
        first = np.cumsum(total) - total
        at = np.cumsum(bits) - bits - first[lane] + self.done[lane]
        some = bits > 0
        self.parts.append((lane[some], at[some], value[some]))
        self.done += total

    def each(self, lanes: np.ndarray, values: np.ndarray, bits: np.ndarray) -> None:
        """Rows of entries, one row for each of the lanes."""
        self.add(np.repeat(lanes, values.shape[1]), values.reshape(-1), bits.reshape(-1))

    def files(self) -> list[bytes]:
        words = (self.done + 31) >> 5
        start = np.cumsum(words) - words
        sums = np.zeros(int(words.sum()) + 1)
        for lane, at, value in self.parts:
            # bits don't meet, and a sum of what starts in one word has less than 53 bits
            sums += np.bincount(start[lane] + (at >> 5), value * (1 << (at & 31)).astype(np.float64), len(sums))
        whole = sums.astype(np.int64)
        low = whole & 0xFFFFFFFF
        low[1:] |= whole[:-1] >> 32
        data = low.astype("<u4").tobytes()
        return [data[4 * s : 4 * s + (n + 7) // 8] for s, n in zip(start.tolist(), self.done.tolist())]


def write_codes(out: _Lanes, lengths: np.ndarray, alphabet: np.ndarray, ids: np.ndarray) -> None:
    """Writes a prefix code of each lane in ids."""
    used = lengths > 0
    many = used.sum(axis=1)
    first = used.argmax(axis=1)
    last = np.where(many > 0, lengths.shape[1] - 1 - used[:, ::-1].argmax(axis=1), 0)
    simple = (many <= 2) & (last < 256)
    at = np.flatnonzero(simple)
    if len(at):
        two, wide, f = many[at] == 2, first[at] > 1, first[at]
        one = np.ones(len(at), np.int64)
        out.each(ids[at], np.stack([one, two, wide, f, np.where(two, last[at], 0)], 1).astype(np.int64),
                 np.stack([one, one, one, np.where(wide, 8, 1), np.where(two, 8, 0)], 1))
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return
    end = last[rows] + 1
    inside = np.arange(lengths.shape[1]) < end[:, None]
    row, column = np.nonzero(inside)
    value = lengths[rows][inside]
    zero = value == 0
    head = np.concatenate([[True], (row[1:] != row[:-1]) | ~zero[1:] | ~zero[:-1]])
    start = np.flatnonzero(head)  # a run of zeros or one length
    run = np.diff(np.append(start, len(value)))
    several = np.where(zero[start], np.where(run >= 3, -(-run // 138), run), 1)
    piece = np.repeat(np.arange(len(start)), several)
    number = np.arange(len(piece)) - np.repeat(np.cumsum(several) - several, several)
    token_row, is_run = row[start][piece], (zero[start] & (run >= 3))[piece]
    share = run[piece] // several[piece] + (number < run[piece] % several[piece])
    token = np.where(is_run, np.where(share <= 10, 17, 18), value[start][piece])
    extra = np.where(is_run, np.where(share <= 10, share - 3, share - 11), 0)
    extra_bits = np.where(is_run, np.where(share <= 10, 3, 7), 0)
    meta = lengths_many(np.bincount(token_row * 19 + token, minlength=19 * len(rows)).reshape(len(rows), 19), 7)
    code, size = codes_many(meta)
    told = meta[:, LENGTH_ORDER]
    n = np.maximum(4, 19 - (told > 0)[:, ::-1].argmax(axis=1))
    shown = np.arange(19) < n[:, None]
    out.each(ids[rows], np.concatenate([np.zeros((len(rows), 1), np.int64), (n - 4)[:, None], told * shown], 1),
             np.concatenate([np.ones((len(rows), 1), np.int64), np.full((len(rows), 1), 4), 3 * shown], 1))
    tokens = np.bincount(token_row, minlength=len(rows))
    short = tokens < alphabet[rows]
    need = np.maximum(2, np.frexp(np.maximum(tokens - 2, 0).astype(np.float64))[1])
    need += need & 1
    out.each(ids[rows], np.stack([short, np.where(short, (need - 2) // 2, 0), np.where(short, tokens - 2, 0)], 1).astype(np.int64),
             np.stack([np.ones(len(rows), np.int64), np.where(short, 3, 0), np.where(short, need, 0)], 1))
    own = size[token_row, token]
    out.add(ids[rows[token_row]], code[token_row, token] | extra << own, own + extra_bits)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths or distances."""
    v = values - 1
    extra = np.where(v < 4, 0, np.frexp(v.astype(np.float64))[1] - 2)
    return np.where(v < 4, v, 2 * extra + 2 + ((v >> extra) & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


@lru_cache(maxsize=8)
def _places(width: int) -> np.ndarray:
    """The distance codes of near pixels by distance; 0 for others."""
    out = np.zeros(8 + 8 * width, np.int64)
    for code, (x, y) in reversed(list(enumerate(NEAR, 1))):
        if x + y * width > 0:
            out[x + y * width] = code
    return out


def _copies(argb: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of copies, greedily from the left: each repeats the last place of its first three pixels."""
    none = np.zeros(0, np.int64)
    if len(argb) < 4:
        return none, none, none
    x = argb.astype(np.uint64)
    mixed = ((x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) ^ x[2:]) * np.uint64(0x94D049BB133111EB)
    mixed ^= lane[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed, kind="stable")
    before, after = order[:-1], order[1:]
    again = (mixed[after] == mixed[before]) & (lane[before] == lane[after + 2])  # both lie in one lane
    before, after = before[again], after[again]
    alike = (argb[before] == argb[after]) & (argb[before + 1] == argb[after + 1]) & (argb[before + 2] == argb[after + 2])
    back = np.zeros(len(argb) - 2, np.int64)
    back[after[alike]] = (after - before)[alike]
    edges = np.flatnonzero(np.concatenate([[True], (back[1:] != back[:-1]) | (lane[1:-2] != lane[:-3])]))
    far, ends = back[edges], np.append(edges[1:], len(back))
    some = far > 0
    out, at = [], 0
    for lo, hi, distance in zip(edges[some].tolist(), ends[some].tolist(), far[some].tolist()):
        lo = max(lo, at)
        if lo < hi:
            at = hi + 2
            out += [(k, min(4096, at - k), distance) for k in range(lo, at, 4096)]
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _information(lane: np.ndarray, values: np.ndarray, lanes: int) -> np.ndarray:
    """Bits of information of each lane's byte values."""
    counts = np.bincount(lane * 256 + values, minlength=256 * lanes).reshape(lanes, 256)
    total = counts.sum(axis=1)
    some = np.where(counts > 0, counts, 1)
    return total * np.log2(np.maximum(total, 1)) - (some * np.log2(some)).sum(axis=1)


#: What an image may be stored with: (kind, predictor mode or multipliers).
FORMS = (("plain", 0), ("green", 0), ("cross", (32, 0, 0)), ("predictor", 1), ("predictor", 2), ("palette", 0))


def choose_forms(flat: np.ndarray, argb: np.ndarray, lane: np.ndarray, height: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The number in FORMS with the least estimated size of each lane: information of the channels and what the transform costs."""
    lanes = len(height)
    red, green, blue, alpha = (flat[:, k].astype(np.int64) for k in range(4))
    info = lambda v: _information(lane, v & 255, lanes)
    own = [info(c) for c in (red, green, blue, alpha)]
    sizes = np.full((len(FORMS), lanes), np.inf)
    sizes[0] = sum(own)
    sizes[1] = info(red - green) + info(blue - green) + own[1] + own[3] + 3
    signed = np.where(red < 128, red, red - 256)
    sizes[2] = own[0] + info(blue - signed) + own[1] + own[3] + 60
    place = np.arange(len(lane)) - np.repeat(np.cumsum(height * width) - height * width, height * width)
    wide = width[lane]
    x, y = place % wide, place // wide
    left = np.where(x > 0, 1, np.where(y > 0, wide, 0))  # how far back the predicted pixel is
    top = np.where(y > 0, wide, np.where(x > 0, 1, 0))
    at = np.arange(len(lane))
    for k, back in ((3, left), (4, top)):
        rest = [np.where(back > 0, c - c[at - back], c - 255 * (c is alpha)) for c in (red, green, blue, alpha)]
        sizes[k] = sum(info(c) for c in rest) + 60
    colour, counts = np.unique(lane << 32 | argb.astype(np.int64), return_counts=True)
    own_lane = colour >> 32
    colours = np.bincount(own_lane, minlength=lanes)
    n = height * width
    index = n * np.log2(np.maximum(n, 1)) - np.bincount(own_lane, counts * np.log2(counts), lanes)
    sizes[5] = np.where(colours <= 256, index + 24 * colours + 100, np.inf)
    return sizes.argmin(axis=0)


def _prepare(w: Writer, image: np.ndarray, form: int) -> tuple[np.ndarray, int, np.ndarray | None]:
    """Writes the transforms of one image but for a palette's colours; its ARGB values under them, their width and the colours."""
    h, width, _ = image.shape
    table = None
    kind, what = FORMS[form]
    c = image[..., [3, 0, 1, 2]].astype(np.int32)
    if kind == "green":
        w.write(1, 1)
        w.write(SUBTRACT_GREEN, 2)
        c[..., 1] = (c[..., 1] - c[..., 2]) & 255
        c[..., 3] = (c[..., 3] - c[..., 2]) & 255
    elif kind == "palette":
        colours, number = np.unique(_joined(c), return_inverse=True)
        w.write(1, 1)
        w.write(PALETTE, 2)
        w.write(len(colours) - 1, 8)
        table = _joined(np.diff(_channels(colours), axis=0, prepend=0))
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        wide = (width + (1 << pack) - 1) >> pack
        number = np.pad(number.reshape(h, width), ((0, 0), (0, (wide << pack) - width))).reshape(h, wide, 1 << pack)
        c, width = np.zeros((h, wide, 4), np.int32), wide
        c[..., 0] = 255
        c[..., 2] = sum(number[..., k] << (k * (8 >> pack)) for k in range(1 << pack))
    elif kind != "plain":
        across, down = [(k + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS for k in (width, h)]
        blocks = np.zeros((down, across, 4), np.int32)
        blocks[..., 0] = 255
        w.write(1, 1)
        w.write(CROSS_COLOUR if kind == "cross" else PREDICTOR, 2)
        w.write(BLOCK_BITS - 2, 3)
        if kind == "cross":
            blocks[..., 1:] = what
            _write_pixels(w, _joined(blocks), across, Options(), False)
            c = cross_colour(c, blocks, BLOCK_BITS, -1)
        else:
            blocks[..., 2] = what
            _write_pixels(w, _joined(blocks), across, Options(), False)
            guess = np.zeros_like(c)
            guess[0, 1:], guess[1:, 0] = c[0, :-1], c[:-1, 0]
            guess[1:, 1:] = c[1:, :-1] if what == 1 else c[:-1, 1:]
            guess[0, 0] = (255, 0, 0, 0)
            c = (c - guess) & 255
    return _joined(c).reshape(-1), width, table


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of images (height, width, 4) as red, green, blue, alpha.

    Each has the transform that makes it smallest by an estimate, references, a colour cache where it is of use, and prefix
    codes by the counts of its symbols. A file depends on its image only, not on the others.
    """
    if not images:
        return []
    height, width = (np.array([im.shape[k] for im in images], np.int64) for k in (0, 1))
    flat = np.concatenate([im.reshape(-1, 4) for im in images])
    argb = flat[:, 3].astype(np.uint32) << np.uint32(24) | flat[:, 0].astype(np.uint32) << np.uint32(16) | flat[:, 1].astype(np.uint32) << np.uint32(8) | flat[:, 2]
    lane = np.repeat(np.arange(len(images)), height * width)
    forms = choose_forms(flat, argb, lane, height, width)
    bounds = np.concatenate([[0], np.cumsum(height * width)]).tolist()
    out, heads, values, palettes = _Lanes(len(images)), [], [], {}
    for k, (image, form) in enumerate(zip(images, forms.tolist())):
        w = Writer()
        _header(w, image.shape[1], image.shape[0])
        if form:
            own, width[k], table = _prepare(w, image, form)
            values.append(own)
            if table is not None:
                palettes[k] = table
        else:
            values.append(argb[bounds[k] : bounds[k + 1]])
        heads.append(w.parts)
    every = np.arange(len(images))
    own = np.array([len(p) for p in heads])
    parts = np.array([x for p in heads for x in p], np.int64)
    out.add(np.repeat(every, own), parts[:, 0], parts[:, 1])
    if palettes:
        _write_many(out, list(palettes.values()), np.array([len(t) for t in palettes.values()]), np.array(list(palettes)), False)
    out.add(every, np.zeros(len(images), np.int64), np.ones(len(images), np.int64))  # no further transform
    _write_many(out, values, width, every, True)
    return [_riff(body) for body in out.files()]


def _riff(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _write_many(out: _Lanes, values: list[np.ndarray], width: np.ndarray, ids: np.ndarray, top: bool) -> None:
    """The entropy-coded images of the lanes in ids; top: they are not part of a transform."""
    lanes = len(values)
    size = np.array([len(v) for v in values])
    argb = np.concatenate(values)
    lane = np.repeat(np.arange(lanes), size)
    n = len(argb)
    start, length, distance = _copies(argb, lane)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    begins = np.zeros(n, bool)
    begins[start] = True
    free = np.cumsum(step[:-1]) == 0
    cache_bits = np.clip(np.frexp(size.astype(np.float64))[1] - 5, 1, 10)
    slot = (argb * np.uint32(CACHE_FACTOR)).astype(np.int64) >> (32 - cache_bits)[lane]
    order = np.argsort(lane << 10 | slot, kind="stable")
    a, b = order[:-1], order[1:]
    hit = np.zeros(n, bool)
    hit[b] = (argb[b] == argb[a]) & (lane[b] == lane[a])  # the pixel before in the slot is the one it holds
    useful = np.bincount(lane[hit & free], minlength=lanes) >= 4
    cache_bits = np.where(useful, cache_bits, 0)
    hit &= useful[lane]
    at = np.flatnonzero(free | begins)
    own = lane[at]
    copy = begins[at]
    cached = hit[at] & ~copy
    plain = ~copy & ~cached
    code = distance + len(NEAR)
    of_copy = lane[start]
    for wide in np.unique(width[of_copy]).tolist():
        near = _places(wide)
        close = (width[of_copy] == wide) & (distance < len(near))
        close[close] = near[distance[close]] > 0
        code[close] = near[distance[close]]
    of_length, of_distance = _prefixes(length), _prefixes(code)
    green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    first = np.empty(len(at), np.int64)
    first[plain] = green[at[plain]]
    first[cached] = GREEN_SYMBOLS + slot[at[cached]]
    first[copy] = 256 + of_length[0]
    has = cache_bits > 0
    out.each(ids, np.stack([has, cache_bits, np.zeros(lanes, np.int64)], 1).astype(np.int64),
             np.stack([np.ones(lanes, np.int64), np.where(has, 4, 0), np.full(lanes, int(top))], 1))
    literal = argb[at[plain]]
    channel = lambda shift: (literal >> np.uint32(shift) & np.uint32(255)).astype(np.int64)
    alphabet = GREEN_SYMBOLS + np.where(has, 1 << cache_bits, 0)
    books = []
    for symbols, of, sizes in ((first, own, alphabet), (channel(16), own[plain], 256), (channel(0), own[plain], 256), (channel(24), own[plain], 256),
                               (of_distance[0], of_copy, DISTANCE_PREFIXES)):
        sizes = np.broadcast_to(np.asarray(sizes), lanes)
        wide = int(sizes.max())
        lengths = lengths_many(np.bincount(of * wide + symbols, minlength=lanes * wide).reshape(lanes, wide), LONGEST)
        write_codes(out, lengths, sizes, ids)
        value, bits = codes_many(lengths)
        books.append((value[of, symbols], bits[of, symbols]))
    value, bits = np.zeros((2, len(at), 4), np.int64)
    for matrix, k in ((value, 0), (bits, 1)):
        matrix[:, 0] = books[0][k]
        for c in (1, 2, 3):
            matrix[plain, c] = books[c][k]
        matrix[copy, 1], matrix[copy, 2], matrix[copy, 3] = of_length[1 + k], books[4][k], of_distance[1 + k]
    out.add(np.repeat(ids[own], 4), value.reshape(-1), bits.reshape(-1))


# ---------------------------------------------------------------- reading


class _Reader:
    """The bits of many streams; `at` are positions in all of them together."""

    def __init__(self, bodies: list[bytes]):
        padded = [b + b"\0" * 8 for b in bodies]
        size = np.array([len(p) for p in padded])
        self.start = 8 * (np.cumsum(size) - size)
        self.end = self.start + 8 * np.array([len(b) for b in bodies])
        data = np.frombuffer(b"".join(padded) + b"\0" * 8, np.uint8)
        #: The 64 bits from each byte on.
        self.words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<i8")[:, 0]

    def word(self, at: np.ndarray) -> np.ndarray:
        """57 bits from each position; what is above repeats the sign."""
        return self.words.take(at >> 3, mode="clip") >> (at & 7)

    def read(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next n bits of each (at most 57); moves at."""
        out = self.word(at) & ((1 << np.asarray(n, np.int64)) - 1)
        at += n
        return out


def _tables(lengths: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries of all rows, where each row's begin, its mask, rows that aren't codes of lanes); an entry is the symbol, shifted left, times 64 plus its length."""
    used = lengths > 0
    many = used.sum(axis=1)
    bits = np.where(many > 1, lengths.max(axis=1), 0)
    whole = np.where(used, 1 << (15 - np.minimum(lengths, 15)), 0).sum(axis=1)
    odd = (many > 1) & (whole != 1 << 15) | (bits > LONGEST + 1)
    bits[odd] = 0
    start = np.cumsum(1 << bits) - (1 << bits)
    row, symbol = np.nonzero(used & ((many > 1) & ~odd)[:, None])
    n = lengths[row, symbol]
    order = np.lexsort((symbol, n, row))
    row, entry, n = row[order], (symbol << shift + 6 | n)[order], n[order]
    single = bits == 0
    table = np.zeros(int((1 << bits).sum()), np.int64)
    spread = np.repeat(entry, 1 << (bits[row] - n))
    owner = np.repeat(np.arange(len(bits)), np.where(single, 0, 1 << bits))
    first = np.cumsum(np.where(single, 0, 1 << bits)) - np.where(single, 0, 1 << bits)
    within = np.arange(len(spread)) - first[owner]
    table[start[owner] + within] = spread[first[owner] + (reversals(15)[within] >> (15 - bits[owner]))]
    table[start[single]] = used[single].argmax(axis=1) << shift + 6
    return table, start, (1 << bits) - 1, odd


def _read_codes(r: _Reader, at: np.ndarray, alphabet: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The code lengths of the next prefix code of each lane; marks lanes in odd that this can't read."""
    lengths = np.zeros((len(at), int(alphabet.max())), np.int64)
    simple = r.read(at, 1).astype(bool)
    rows = np.flatnonzero(simple)
    if len(rows):
        own = at[rows]
        two, wide = r.read(own, 1).astype(bool), r.read(own, 1).astype(bool)
        first = r.read(own, np.where(wide, 8, 1))
        second = np.where(two, r.read(own, np.where(two, 8, 0)), first)
        at[rows] = own
        bad = (first >= alphabet[rows]) | (second >= alphabet[rows])
        odd[rows[bad]] = True
        fine = ~bad
        lengths[rows[fine], first[fine]] = 1
        lengths[rows[fine], second[fine]] = 1
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return lengths
    own = at[rows]
    n = 4 + r.read(own, 4)
    meta = np.zeros((len(rows), 19), np.int64)
    for k in range(19):
        meta[:, LENGTH_ORDER[k]] = r.read(own, np.where(k < n, 3, 0))
    table, start, mask, bad = _tables(meta)
    odd[rows[bad]] = True
    given = r.read(own, 1).astype(bool)
    need = np.where(given, 2 + 2 * r.read(own, np.where(given, 3, 0)), 0)
    limit = alphabet[rows]
    left = np.where(given, 2 + r.read(own, need), limit)
    symbol, before = np.zeros(len(rows), np.int64), np.full(len(rows), 8)
    repeats: list[tuple[np.ndarray, ...]] = []
    live = np.flatnonzero((left > 0) & ~bad)
    while len(live):
        place = own[live]
        word = r.word(place)
        e = table[start[live] + (word & mask[live])]
        used, token = e & 63, e >> 6
        here = symbol[live]
        one = token < 16
        lengths[rows[live], here] = np.where(one, token, 0)
        size = 1
        if not one.all():
            extra_bits = np.where(one, 0, np.where(token == 16, 2, np.where(token == 17, 3, 7)))
            extra = (word >> used) & ((1 << extra_bits) - 1)
            size = np.where(one, 1, np.where(token == 18, 11, 3) + extra)
            used = used + extra_bits
            again = token == 16
            if again.any():
                repeats.append((live[again], here[again], size[again], before[live[again]]))
        own[live] = place + used
        before[live] = np.where(one & (token > 0), token, before[live])
        symbol[live] = here + size
        left[live] -= 1
        live = live[(left[live] > 0) & (symbol[live] < limit[live])]
    odd[rows[symbol > limit]] = True
    for lane, here, size, value in repeats:
        for k in range(6):
            some = (k < size) & (here + k < limit[lane])
            lengths[rows[lane[some]], here[some] + k] = value[some]
    at[rows] = own
    return lengths


def _values(r: _Reader, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The lengths or distances that prefix symbols and their extra bits stand for."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + r.read(at, extra)) + 1


def _read_pixels(r: _Reader, at: np.ndarray, width: np.ndarray, size: np.ndarray, odd: np.ndarray) -> list[np.ndarray]:
    """The ARGB values of the entropy-coded images at `at`, lanes in falling order of size."""
    lanes = len(at)
    has = r.read(at, 1)
    cache_bits = r.read(at, 4 * has)
    odd |= cache_bits > 11
    cache_bits[odd] = 0
    odd |= r.read(at, 1) > 0  # several groups of codes
    tables = []
    sizes = (GREEN_SYMBOLS + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(lanes, n) for n in (256, 256, 256, DISTANCE_PREFIXES)])
    for alphabet, shift in zip(sizes, (8, 16, 0, 24, 0)):
        table, start, mask, bad = _tables(_read_codes(r, at, alphabet, odd), shift)
        odd |= bad
        tables.append((table, start, mask))
    entries = [t for t, _, _ in tables]
    places = [x for _, start, mask in tables[:4] for x in (start, mask)]
    _, far, far_mask = tables[4]
    base = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int64)
    slots = np.where(cache_bits > 0, 1 << cache_bits, 1)
    own_cache = np.cumsum(slots) - slots
    cache = np.zeros(int(slots.sum()), np.int64)
    shift = 32 - cache_bits  # without a cache everything goes to one place that isn't read
    any_cache = bool((cache_bits > 0).any())
    left, back = np.zeros(lanes, np.int64), np.ones(lanes, np.int64)
    near = np.array(NEAR)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left").tolist()  # lanes with more than t pixels
    special_from = 256 << 14
    greens, reds, blues, alphas, distances = entries
    copying, before = 0, -1
    for t, n in enumerate(active):
        if n != before:
            before = n
            all_places, at_n, base_n, own_n, shift_n = [x[:n] for x in places], at[:n], base[:n], own_cache[:n], shift[:n]
        if copying:
            mine = np.flatnonzero(left[:n] == 0)
            place, (g, gm, rd, rm, bl, bm, al, am) = at[mine], [x[mine] for x in all_places]
        else:
            mine, place = None, at_n
            g, gm, rd, rm, bl, bm, al, am = all_places
        value = np.zeros(n, np.int64) if copying else None
        if len(place):
            # four symbols of 12 bits at most are within one word
            word = r.words.take(place >> 3, mode="clip") >> (place & 7)
            e = greens.take((word & gm) + g)
            got = e
            word = word >> (e & 63)
            f = reds.take((word & rm) + rd)
            got = got + f
            word >>= f & 63
            f = blues.take((word & bm) + bl)
            got += f
            word >>= f & 63
            got += alphas.take((word & am) + al)
            moved = place + (got & 63)
            got >>= 6
            if e.max() >= special_from:
                special = np.flatnonzero(e >= special_from)
                lane = special if mine is None else mine[special]
                s, p = e[special] >> 14, place[special] + (e[special] & 63)
                copies = s < GREEN_SYMBOLS
                if copies.any():
                    c, q = lane[copies], p[copies]
                    length = _values(r, q, s[copies] - 256)
                    d = distances[far[c] + (r.word(q) & far_mask[c])]
                    q += d & 63
                    code = _values(r, q, d >> 6)
                    close = near[np.minimum(code, len(NEAR)) - 1]
                    distance = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, close[:, 0] + close[:, 1] * width[c]))
                    bad = (distance > t) | (t + length > size[c])
                    odd[c[bad]] = True
                    distance[bad], length[bad] = max(t, 1), 1
                    left[c], back[c] = length, distance
                    p[copies] = q
                    copying += len(c)
                moved[special] = p
                got[special] = cache[own_cache[lane] + np.where(copies, 0, np.minimum(s - GREEN_SYMBOLS, slots[lane] - 1))]
            if mine is None:
                at_n[:] = moved
                value = got
            else:
                at[mine] = moved
                value[mine] = got
        if copying:
            c = np.flatnonzero(left[:n])
            value[c] = out[base[c] + np.maximum(t - back[c], 0)]
            left[c] -= 1
            copying = int(np.count_nonzero(left[: active[t + 1]])) if t + 1 < len(active) else 0
        out[base_n + t] = value
        if any_cache:
            cache[own_n + ((value * CACHE_FACTOR & 0xFFFFFFFF) >> shift_n)] = value
    odd |= at > r.end
    bounds = [*base.tolist(), len(out)]
    out = out.astype(np.uint32)
    return [out[lo:hi] for lo, hi in zip(bounds, bounds[1:])]


def _body(data: bytes) -> bytes | None:
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return None
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size] or None
        at += 8 + size + (size & 1)
    return None


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files, as `webp.decode` gives them; images of like size are read in step."""
    out: list[np.ndarray | None] = [None] * len(files)
    rest, lanes = [], []
    for k, data in enumerate(files):
        body = _body(data)
        if body is None or body[0] != SIGNATURE:
            rest.append(k)
            continue
        start = int.from_bytes(body[1:6], "little")
        width, height = (start & 0x3FFF) + 1, (start >> 14 & 0x3FFF) + 1
        lanes.append((width * height, k, body))
    lanes.sort(key=lambda x: (-x[0], x[1]))
    lo = 0
    while lo < len(lanes):  # like sizes, so that lanes end together
        hi, pixels = lo, 0
        while hi < len(lanes) and hi - lo < LANES and pixels < PIXELS and 4 * lanes[hi][0] + 512 >= 3 * lanes[lo][0]:
            pixels += lanes[hi][0]
            hi += 1
        if hi - lo < FEW:
            rest += [k for _, k, _ in lanes[lo:hi]]
        else:
            group = lanes[lo:hi]
            for (_, k, _), image in zip(group, _decode_lanes([body for _, _, body in group])):
                out[k] = image
                if image is None:
                    rest.append(k)
        lo = hi
    for k in rest:
        out[k] = decode(files[k])
    return out


def _decode_lanes(bodies: list[bytes]) -> list[np.ndarray | None]:
    """Each image, or None where it has to be read alone."""
    r = _Reader(bodies)
    at = r.start + 8
    odd = np.zeros(len(bodies), bool)
    width, height, with_alpha, version = r.read(at, 14) + 1, r.read(at, 14) + 1, r.read(at, 1), r.read(at, 3)
    odd |= version > 0
    inner, undo = width.copy(), [[] for _ in bodies]
    for k in np.flatnonzero(r.read(at.copy(), 1)).tolist():
        for cut in (256, None):  # most transforms are short
            bits = Bits(bodies[k][:cut])
            bits.at = int(at[k] - r.start[k])
            try:
                undo[k], inner[k] = read_transforms(bits, int(width[k]), int(height[k]))
                break
            except (BadImage, IndexError):
                odd[k] = cut is None
        at[k] = r.start[k] + bits.at - 1
    at += 1
    size = inner * height
    order = np.argsort(-size, kind="stable")  # falling again: a palette makes an image narrower
    mine, r.end = at[order], r.end[order]
    bad = odd[order]
    values = _read_pixels(r, mine, inner[order], size[order], bad)
    out: list[np.ndarray | None] = [None] * len(bodies)
    for k, own, strange in zip(order.tolist(), values, bad.tolist()):
        if not strange:
            h, w = int(height[k]), int(inner[k])
            if undo[k]:
                out[k] = invert(_channels(own).reshape(h, w, 4), undo[k], h, bool(with_alpha[k]))
            else:
                image = own.astype("<u4").view(np.uint8).reshape(h, w, 4)[..., [2, 1, 0, 3]]
                if not with_alpha[k]:
                    image[..., 3] = 255
                out[k] = image
    return out
