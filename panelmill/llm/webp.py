"""Lossless WebP (VP8L): a decoder of the whole format in numpy and Python, and an encoder."""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_PREFIXES, DISTANCE_PREFIXES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000
#: Near pixels by distance code 1..120: (to the left, up).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
MOST = 1 << 14


class BadImage(ValueError):
    """Not a lossless WebP that can be read."""


# ---------------------------------------------------------------- bits and prefix codes


class Bits:
    """Reads least significant bits first."""

    def __init__(self, data: bytes):
        self.data = data
        self.at = 0
        self.end = 8 * len(data)
        halves = np.frombuffer(data + b"\0" * (16 - len(data) % 4), "<u4").astype(np.uint64)
        #: The 64 bits from every 32nd on.
        self.words: list[int] = (halves[:-1] | halves[1:] << np.uint64(32)).tolist()

    def read(self, n: int) -> int:
        lo = self.at
        if lo + n > self.end:
            raise BadImage("the data ends too soon")
        self.at += n
        return (self.words[lo >> 5] >> (lo & 31)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return (self.words[self.at >> 5] >> (self.at & 31)) & ((1 << n) - 1)


class Writer:
    def __init__(self) -> None:
        self.parts: list[tuple[int, int]] = []

    def write(self, value: int, n: int) -> None:
        self.parts.append((value, n))

    def bits(self) -> np.ndarray:
        whole, at, done = 0, 0, []
        for value, n in self.parts:
            whole |= value << at
            at += n
            if at > 4096:  # an integer that stays small is quick
                done.append(np.unpackbits(np.frombuffer(whole.to_bytes((at + 7) // 8, "little"), np.uint8), bitorder="little")[:at])
                whole = at = 0
        done.append(np.unpackbits(np.frombuffer(whole.to_bytes((at + 7) // 8, "little"), np.uint8), bitorder="little")[:at])
        return np.concatenate(done)


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code as it is read, length)."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


@lru_cache(maxsize=16)
def reversals(n: int) -> np.ndarray:
    """The numbers of n bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class PrefixCode:
    def __init__(self, lengths: list[int]):
        size = np.array(lengths)
        self.symbols = np.flatnonzero(size)
        if not len(self.symbols):
            self.symbols, lengths = np.zeros(1, np.int64), [1]
        self.lengths = lengths
        self._table: list[tuple[int, int]] | None = None
        if len(self.symbols) == 1:
            self.bits = self.fixed = 0
            return
        self.sizes = size[self.symbols]
        if int((1 << (15 - self.sizes)).sum()) != 1 << 15:
            raise BadImage("a prefix code isn't complete")
        self.bits = int(self.sizes.max())
        self.fixed = self.bits if int(self.sizes.min()) == self.bits else -1

    @property
    def table(self) -> list[tuple[int, int]]:
        """(symbol, length) by the next bits."""
        if self._table is None:
            if not self.bits:
                self._table = [(int(self.symbols[0]), 0)]
            else:
                self._table = [(0, 0)] * (1 << self.bits)
                for s, (code, n) in canonical(self.lengths).items():
                    for k in range(code, 1 << self.bits, 1 << n):
                        self._table[k] = (s, n)
        return self._table

    def entries(self, shift: int = 0) -> list[int]:
        """By the next bits: the symbol, shifted left, times 16, plus its length."""
        if not self.bits:
            return [int(self.symbols[0]) << shift + 4]
        order = np.argsort(self.sizes, kind="stable")
        entry = (self.symbols << shift + 4 | self.sizes)[order]
        return np.repeat(entry, 1 << (self.bits - self.sizes[order]))[reversals(self.bits)].tolist()

    def read(self, bits: Bits) -> int:
        symbol, n = (self._table or self.table)[bits.peek(self.bits)]
        bits.at += n
        if bits.at > bits.end:
            raise BadImage("the data ends too soon")
        return symbol


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths = [0] * alphabet
        for s in [first, bits.read(8)] if two else [first]:
            if s >= alphabet:
                raise BadImage("a symbol is outside its alphabet")
            lengths[s] = 1
        return PrefixCode(lengths)
    order = [0] * 19
    for k in range(4 + bits.read(4)):
        order[LENGTH_ORDER[k]] = bits.read(3)
    meta = PrefixCode(order)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, before = [], 8
    entries, mask, words, end = meta.entries(), (1 << meta.bits) - 1, bits.words, bits.end
    while len(lengths) < alphabet and most:
        most -= 1
        s = entries[(words[bits.at >> 5] >> (bits.at & 31)) & mask]
        bits.at += s & 15
        s >>= 4
        if bits.at > end:
            raise BadImage("the data ends too soon")
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > alphabet:
        raise BadImage("too many code lengths")
    return PrefixCode(lengths + [0] * (alphabet - len(lengths)))


def prefixed(symbol: int, bits: Bits) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


# ---------------------------------------------------------------- decoding


def _literals(codes: list[PrefixCode], bits: Bits, n: int) -> np.ndarray | None:
    """n pixels at once, if each code has one length and green has literals only; else None."""
    green, red, blue, alpha, _ = codes
    if any(c.fixed < 0 for c in (green, red, blue, alpha)) or green.symbols.max() > 255:
        return None
    width = green.bits + red.bits + blue.bits + alpha.bits
    if bits.at + n * width > bits.end:
        raise BadImage("the data ends too soon")
    out = np.zeros(n, np.uint32)
    for lo in range(0, n, 1 << 16):
        m = min(1 << 16, n - lo)
        at = bits.at
        if width:
            raw = np.frombuffer(bits.data, np.uint8, ((at + m * width + 7) >> 3) - (at >> 3), at >> 3)
            flat = np.unpackbits(raw, bitorder="little")[at & 7 : (at & 7) + m * width].reshape(m, width)
        k = 0
        for code, shift in ((green, 8), (red, 16), (blue, 0), (alpha, 24)):
            number = np.zeros(m, np.uint16)
            for _ in range(code.bits):
                number = (number << 1) | flat[:, k]
                k += 1
            out[lo : lo + m] |= code.symbols[number].astype(np.uint32) << np.uint32(shift)
        bits.at += m * width
    return out


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image: ARGB values, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    cells, cell_bits, across = None, 0, 0
    groups = 1
    if top and bits.read(1):
        cell_bits = bits.read(3) + 2
        across = (width + (1 << cell_bits) - 1) >> cell_bits
        down = (height + (1 << cell_bits) - 1) >> cell_bits
        cells = ((_pixels(bits, across, down, False) >> 8) & 0xFFFF).tolist()
        groups = max(cells) + 1
    sizes = (256 + LENGTH_PREFIXES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_PREFIXES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and (found := _literals(codes[0], bits, n)) is not None:
        return found
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    out: list[int] = []
    filled = 0  # pixels that are in the cache
    tables = [[x for c, shift in zip(group, (0, 16, 0, 24, 0)) for x in (c.entries(shift), (1 << c.bits) - 1)] for group in codes]
    words, place, done, add = bits.words, bits.at, 0, out.append
    greens, green, reds, red, blues, blue, alphas, alpha, _, _ = tables[0]
    try:
        while done < n:
            if cells:
                greens, green, reds, red, blues, blue, alphas, alpha, _, _ = tables[cells[(done // width >> cell_bits) * across + (done % width >> cell_bits)]]
            # a word has 33 bits at least: two symbols
            word = words[place >> 5] >> (place & 31)
            e = greens[word & green]
            s = e >> 4
            if s < 256:
                e &= 15
                f = reds[(word >> e) & red]
                place += e + (f & 15)
                word = words[place >> 5] >> (place & 31)
                e = blues[word & blue]
                g = alphas[(word >> (e & 15)) & alpha]
                place += (e & 15) + (g & 15)
                add(g >> 4 | f >> 4 | s << 8 | e >> 4)
                done += 1
                continue
            place += e & 15
            if s < 256 + LENGTH_PREFIXES:
                group = cells[(done // width >> cell_bits) * across + (done % width >> cell_bits)] if cells else 0
                bits.at = place
                length = prefixed(s - 256, bits)
                code = prefixed(codes[group][4].read(bits), bits)
                place = bits.at
                if code > len(NEAR):
                    back = code - len(NEAR)
                else:
                    back = max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
                if back > done or done + length > n:
                    raise BadImage("a reference leaves the image")
                if back >= length:
                    out += out[done - back : done - back + length]
                else:
                    period = out[done - back :]
                    out += (period * (length // back + 1))[:length]
                done += length
            else:
                for x in out[filled:]:
                    cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> shift] = x
                filled = done
                out.append(cache[s - 256 - LENGTH_PREFIXES])
                done += 1
    except IndexError:
        raise BadImage("the data ends too soon") from None
    bits.at = place
    if place > bits.end:
        raise BadImage("the data ends too soon")
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) as alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left, top, top_right, top_left):
    """The predictors on channel values; all arguments are arrays or lists of 4 channels as numpy rows."""
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), np.shape(left))
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return (((left + top_right) >> 1) + top) >> 1
    if mode <= 9:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return (a + b) >> 1
    if mode == 10:
        return (((left + top_left) >> 1) + ((top + top_right) >> 1)) >> 1
    if mode == 11:
        to_left = np.abs(top - top_left).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = (left + top) >> 1
        half = mean - top_left
        return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), np.shape(left))


def undo_predictor(rest: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """rest (h, w, 4), modes by block. Rows whose modes look up only are done at once, others from left to right."""
    h, w, _ = rest.shape
    out = np.zeros_like(rest)
    out[0, 0] = (rest[0, 0] + (255, 0, 0, 0)) & 255
    out[0, 1:] = rest[0, 1:]
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, h):
        above = out[y - 1]
        out[y, 0] = (rest[y, 0] + above[0]) & 255
        by_block = modes[y >> size_bits]
        for block in range(len(by_block)):
            lo, hi = max(1, block << size_bits), min(w, (block + 1) << size_bits)
            if lo >= hi:
                continue
            mode = int(by_block[block])
            if mode == 1:
                part = np.concatenate([out[y, lo - 1 : lo], rest[y, lo:hi]])
                out[y, lo:hi] = np.cumsum(part, axis=0)[1:] & 255
            elif mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                right = np.concatenate([above[lo + 1 : hi + 1], out[y, :1]])[: hi - lo]
                guess = predict(mode, out[y, lo:hi], above[lo:hi], right, above[lo - 1 : hi - 1])
                out[y, lo:hi] = (rest[y, lo:hi] + guess) & 255
            else:
                for x in range(lo, hi):
                    right = above[x + 1] if x + 1 < w else out[y, 0]
                    out[y, x] = (rest[y, x] + predict(mode, out[y, x - 1], above[x], right, above[x - 1])) & 255
    return out


def _shift(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The product of two signed bytes in units of 1/32."""
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def _spread_blocks(blocks: np.ndarray, size_bits: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << size_bits, axis=0)[:h], 1 << size_bits, axis=1)[:, :w]


def cross_colour(c: np.ndarray, blocks: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1, decoding) or takes away (sign -1) what green says of red and blue, and red of blue."""
    t = _spread_blocks(blocks, size_bits, *c.shape[:2])
    out = c.copy()
    out[..., 1] = (c[..., 1] + sign * _shift(t[..., 3], c[..., 2])) & 255
    red = out[..., 1] if sign > 0 else c[..., 1]
    out[..., 3] = (c[..., 3] + sign * (_shift(t[..., 2], c[..., 2]) + _shift(t[..., 1], red))) & 255
    return out


def read_transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """The transforms of an image in the order of the file, and the width of what is stored."""
    undo, w, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            across, down = [(n + (1 << size_bits) - 1) >> size_bits for n in (w, height)]
            undo.append((kind, size_bits, _channels(_pixels(bits, across, down, False)).reshape(down, across, 4)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_channels(_pixels(bits, n, 1, False)), axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, (colours, w)))
            w = (w + (1 << pack) - 1) >> pack
        else:
            undo.append((kind, 0, None))
    return undo, w


def invert(c: np.ndarray, undo: list[tuple], height: int, with_alpha: bool) -> np.ndarray:
    """The pixels whose transformed channels (alpha, red, green, blue) are c."""
    for kind, size, what in reversed(undo):
        if kind == PREDICTOR:
            c = undo_predictor(c, what[..., 2], size)
        elif kind == CROSS_COLOUR:
            c = cross_colour(c, what, size, 1)
        elif kind == SUBTRACT_GREEN:
            c = c.copy()
            c[..., 1] = (c[..., 1] + c[..., 2]) & 255
            c[..., 3] = (c[..., 3] + c[..., 2]) & 255
        else:
            colours, wide = what
            per = 8 >> size
            number = np.stack([(c[..., 2] >> (k * per)) & ((1 << per) - 1) for k in range(1 << size)], axis=-1).reshape(height, -1)[:, :wide]
            known = np.concatenate([colours, np.zeros((max(0, 256 - len(colours)), 4), np.int32)])
            c = known[number]
    out = c[..., [1, 2, 3, 0]].astype(np.uint8)
    if not with_alpha:
        out[..., 3] = 255
    return out


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) as red, green, blue, alpha of one lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("not a WebP file")
    at, body = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if body is None or not body or body[0] != SIGNATURE:
        raise BadImage("no lossless image")
    bits = Bits(body)
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    with_alpha = bits.read(1)
    if bits.read(3):
        raise BadImage("unknown version")
    undo, w = read_transforms(bits, width, height)
    return invert(_channels(_pixels(bits, w, height, True)).reshape(height, w, 4), undo, height, bool(with_alpha))


def frames(data: bytes) -> list[bytes]:
    """The files of a sequence of WebP files."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF":
            raise BadImage("not a sequence of WebP files")
        size = 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append(data[at : at + size])
        at += size
    return out


# ---------------------------------------------------------------- encoding


def huffman(counts: dict[int, int], alphabet: int, most: int = 15) -> list[int]:
    """Code lengths of at most `most` bits; counts are flattened until they fit."""
    lengths = [0] * alphabet
    if len(counts) < 2:
        for s in counts:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(n, floor), s, (s,)) for s, n in counts.items()]
        heapify(heap)
        depth = Counter()
        while len(heap) > 1:
            a, b = heappop(heap), heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                lengths[s] = n
            return lengths
        floor *= 2


def write_code(w: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Writes a prefix code; returns symbol -> (bits, length)."""
    used = [s for s, n in enumerate(lengths) if n]
    write_lengths(w, lengths, used)
    return canonical(lengths) if len(used) > 1 else {s: (0, 0) for s in used or [0]}


def write_lengths(w: Writer, lengths: list[int], used: list[int]) -> None:
    """Writes the lengths of a prefix code; used: the symbols that have one."""
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        wide = used[0] > 1
        w.write(int(wide), 1)
        w.write(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.write(used[1], 8)
        return
    w.write(0, 1)
    tokens: list[tuple[int, int, int]] = []
    k, end = 0, used[-1] + 1
    before = 8
    known = np.array(lengths[:end])
    edges = iter([*(np.flatnonzero(known[1:] != known[:-1]) + 1).tolist(), end])
    edge = 0
    while k < end:
        if k == edge:
            edge = next(edges)
        run = edge - k
        if lengths[k] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif lengths[k] and lengths[k] == before and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            before = lengths[k] or before
            tokens.append((lengths[k], 0, 0))
        k += run
    sizes = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7).tolist()
    n = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if sizes[s]))
    w.write(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        w.write(sizes[s], 3)
    codes = canonical(sizes) if sum(map(bool, sizes)) > 1 else {tokens[0][0]: (0, 0)}
    if len(tokens) < len(lengths):
        need = max(2, (len(tokens) - 2).bit_length())
        need += need & 1
        w.write(1, 1)
        w.write((need - 2) // 2, 3)
        w.write(len(tokens) - 2, need)
    else:
        w.write(0, 1)
    for t, extra, bits in tokens:
        code, n = codes[t]
        w.parts.append((code | extra << n, n + bits))


def _prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


@dataclass(frozen=True)
class Options:
    """What an encoder may use; the default is literals in prefix codes."""

    predictor: int | None = None  # block bits
    modes: tuple[int, ...] = tuple(range(14))  # of the blocks, in turn
    cross: int | None = None
    subtract_green: bool = False
    palette: bool = False
    cache_bits: int = 0
    references: bool = False
    cells: int | None = None  # bits of the cells of an entropy image of two groups


def _write_pixels(w: Writer, argb: np.ndarray, width: int, o: Options, top: bool) -> None:
    values = argb.reshape(-1).tolist()
    symbols: list[tuple] = []
    cache = [0] * (1 << o.cache_bits) if o.cache_bits else []
    recent: dict[tuple, int] = {}
    at, n = 0, len(values)
    place = {b: i + 1 for i, (x, y) in reversed(list(enumerate(NEAR))) if (b := x + y * width) > 0}

    def learn(lo: int, hi: int) -> None:
        for k in range(lo, hi):
            if cache:
                cache[(CACHE_FACTOR * values[k] & 0xFFFFFFFF) >> (32 - o.cache_bits)] = values[k]
            if o.references and k >= 2:
                recent[tuple(values[k - 2 : k + 1])] = k - 2

    while at < n:
        back = 0
        if o.references and (before := recent.get(tuple(values[at : at + 3]))) is not None:
            back, length = at - before, 3
            while at + length < n and length < 4096 and values[at + length] == values[before + length]:
                length += 1
        if back:
            symbols.append((at, "copy", length, place.get(back, back + len(NEAR))))
            learn(at, at + length)
            at += length
        else:
            slot = (CACHE_FACTOR * values[at] & 0xFFFFFFFF) >> (32 - o.cache_bits) if cache else 0
            symbols.append((at, "cache", slot) if cache and cache[slot] == values[at] else (at, "pixel", values[at]))
            learn(at, at + 1)
            at += 1
    w.write(int(bool(cache)), 1)
    if cache:
        w.write(o.cache_bits, 4)
    group_of, groups = [0] * len(symbols), 1
    if top:
        w.write(int(o.cells is not None), 1)
        if o.cells is not None:
            w.write(o.cells - 2, 3)
            across, down = [(k + (1 << o.cells) - 1) >> o.cells for k in (width, n // width)]
            cells = np.arange(across * down) % 2
            groups = int(cells.max()) + 1
            _write_pixels(w, (cells << 8).astype(np.uint32), across, Options(), False)
            group_of = [int(cells[(s[0] // width >> o.cells) * across + (s[0] % width >> o.cells)]) for s in symbols]
    sizes = (256 + LENGTH_PREFIXES + len(cache), 256, 256, 256, DISTANCE_PREFIXES)
    books = []
    for g in range(groups):
        counts = [Counter() for _ in sizes]
        for (_, kind, *v), own in zip(symbols, group_of):
            if own != g:
                continue
            if kind == "pixel":
                for c, shift in zip(counts, (8, 16, 0, 24)):
                    c[(v[0] >> shift) & 255] += 1
            elif kind == "cache":
                counts[0][256 + LENGTH_PREFIXES + v[0]] += 1
            else:
                counts[0][256 + _prefix_of(v[0])[0]] += 1
                counts[4][_prefix_of(v[1])[0]] += 1
        books.append([write_code(w, huffman(c, size)) for c, size in zip(counts, sizes)])
    for (_, kind, *v), own in zip(symbols, group_of):
        book = books[own]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                w.write(*book[k][(v[0] >> shift) & 255])
        elif kind == "cache":
            w.write(*book[0][256 + LENGTH_PREFIXES + v[0]])
        else:
            for k, base, value in ((0, 256, v[0]), (4, 0, v[1])):
                s, extra, bits = _prefix_of(value)
                w.write(*book[k][base + s])
                w.write(extra, bits)


def _file(bits: np.ndarray) -> bytes:
    body = np.packbits(bits, bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _header(w: Writer, width: int, height: int) -> None:
    if not (0 < width <= MOST and 0 < height <= MOST):
        raise ValueError("sides are 1 to 16384 pixels")
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.write(value, n)


def encode(pixels: np.ndarray, o: Options = Options()) -> bytes:
    """A lossless WebP file of pixels (height, width, 4) as red, green, blue, alpha, with the transforms asked for."""
    h, width, _ = pixels.shape
    w = Writer()
    _header(w, width, h)
    c = pixels[..., [3, 0, 1, 2]].astype(np.int32)
    wide = width
    if o.palette:
        colours, number = np.unique(_joined(c), return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        w.write(1, 1)
        w.write(PALETTE, 2)
        w.write(len(colours) - 1, 8)
        parts = _channels(colours)
        _write_pixels(w, _joined(np.diff(parts, axis=0, prepend=0)), len(colours), Options(), False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        wide = (width + (1 << pack) - 1) >> pack
        number = np.pad(number.reshape(h, width), ((0, 0), (0, (wide << pack) - width))).reshape(h, wide, 1 << pack)
        c = np.zeros((h, wide, 4), np.int32)
        c[..., 0] = 255
        c[..., 2] = sum(number[..., k] << (k * (8 >> pack)) for k in range(1 << pack))
    if o.subtract_green:
        w.write(1, 1)
        w.write(SUBTRACT_GREEN, 2)
        c = c.copy()
        c[..., 1] = (c[..., 1] - c[..., 2]) & 255
        c[..., 3] = (c[..., 3] - c[..., 2]) & 255
    if o.cross is not None:
        across, down = [(k + (1 << o.cross) - 1) >> o.cross for k in (wide, h)]
        blocks = np.random.default_rng(5).integers(0, 256, (down, across, 4)).astype(np.int32)
        blocks[..., 0] = 255
        w.write(1, 1)
        w.write(CROSS_COLOUR, 2)
        w.write(o.cross - 2, 3)
        _write_pixels(w, _joined(blocks), across, Options(), False)
        c = cross_colour(c, blocks, o.cross, -1)
    if o.predictor is not None:
        across, down = [(k + (1 << o.predictor) - 1) >> o.predictor for k in (wide, h)]
        modes = np.array([o.modes[k % len(o.modes)] for k in range(across * down)]).reshape(down, across)
        blocks = np.zeros((down, across, 4), np.int32)
        blocks[..., 0], blocks[..., 2] = 255, modes
        w.write(1, 1)
        w.write(PREDICTOR, 2)
        w.write(o.predictor - 2, 3)
        _write_pixels(w, _joined(blocks), across, Options(), False)
        by_pixel = _spread_blocks(modes, o.predictor, h, wide)
        left, up = np.roll(c, 1, axis=1), np.roll(c, 1, axis=0)
        right = np.roll(up, -1, axis=1)
        right[:, -1] = c[:, 0]
        guess = np.zeros_like(c)
        for m in set(o.modes):
            guess = np.where((by_pixel == m)[..., None], predict(m, left, up, right, np.roll(left, 1, axis=0)), guess)
        guess[0] = left[0]
        guess[:, 0] = up[:, 0]
        guess[0, 0] = (255, 0, 0, 0)
        c = (c - guess) & 255
    w.write(0, 1)
    _write_pixels(w, _joined(c), wide, o, True)
    return _file(w.bits())


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a complete prefix code near the counts' information, of at most `most` bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(-counts[used], kind="stable")]
    size = np.clip(np.ceil(np.log2(counts.sum() / counts[used])), 1, most).astype(int).tolist()
    spare = (1 << most) - sum(1 << (most - n) for n in size)
    while spare < 0:  # the longest that can grow
        k = max((k for k, n in enumerate(size) if n < most), key=lambda k: size[k])
        size[k] += 1
        spare += 1 << (most - size[k])
    while spare:
        for k, n in enumerate(size):
            if 1 << (most - n) <= spare:
                size[k] -= 1
                spare -= 1 << (most - n)
    out[used] = size
    return out
