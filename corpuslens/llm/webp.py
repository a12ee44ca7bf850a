"""Lossless WebP (VP8L) in numpy: a writer for payload bytes and a full decoder to pixel arrays.

The decoder reads prefix codes, meta prefix images, back-references, the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette
transforms.  Streams of one prefix-code group are decoded by tables over all bit
positions at once: the code length at each position gives the next pixel's
position, a chain of jumps finds the true ones, and all pixels between two
back-references are read by one gather; what the colour cache stands for is found
by sorting pixels by their places in it.

The writer estimates, for each image, the bits of a palette and of each of the
other transforms, takes the cheapest, repeats stretches of pixels by
back-references, and uses a colour cache where that pays.

A payload is stored as RGB samples, WIDTH pixels in a row; payloads beyond
MAX_ROWS rows take several images, one file after another.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 64
ROW_BYTES = 3 * WIDTH
MAX_ROWS = 16384
MAX_CODE = 15

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (x, y) of the short distance codes, from 1.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
GREENS, LENGTHS, DISTANCES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
HASH = 0x1E35A7BD


class BitWriter:
    """Little-endian bit stream."""

    def __init__(self):
        self.value, self.bits, self.parts = 0, 0, []

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.bits
        self.bits += bits

    def put_array(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many codes at once; values hold their bits in stream order from the lowest."""
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        source = np.repeat(np.arange(len(sizes)), sizes)
        bits = (values[source] >> (np.arange(total) - (ends - sizes)[source]).astype(values.dtype)) & 1
        self.put(int.from_bytes(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "little"), total)

    def done(self) -> bytes:
        return self.value.to_bytes((self.bits + 7) // 8, "little")


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def get(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


def code_lengths(counts: np.ndarray, longest: int = MAX_CODE) -> np.ndarray:
    """Huffman code lengths of at most ``longest`` bits; counts are flattened until the lengths fit."""
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(np.int64)
    while True:
        n = len(order)
        heap, parent = weights.tolist(), [0] * (2 * n - 1)
        leaf, node, made = 0, n, []  # two queues: leaves by weight, and the nodes made
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (node - n >= len(made) or heap[leaf] <= made[node - n]):
                    total += heap[leaf]
                    parent[leaf] = new
                    leaf += 1
                else:
                    total += made[node - n]
                    parent[node] = new
                    node += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= longest:
            out[order] = depth[:n]
            return out
        weights = (weights + 1) // 2


_REVERSED: dict[int, np.ndarray] = {}


def reversed_bits(bits: int) -> np.ndarray:
    """Each number below 2**bits with its bits in reverse."""
    if bits not in _REVERSED:
        n = np.arange(1 << bits)
        out = np.zeros_like(n)
        for k in range(bits):
            out |= (n >> k & 1) << (bits - 1 - k)
        _REVERSED[bits] = out
    return _REVERSED[bits]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in stream order (first bit lowest) of the symbols with a length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order]
    out = np.zeros(len(lengths), np.int64)
    if len(order) > 1:
        start = np.cumsum(1 << (MAX_CODE - sizes)) - (1 << (MAX_CODE - sizes))
        out[order] = reversed_bits(MAX_CODE)[start]
    return out


class PrefixCode:
    """Decoding table: entry of the next ``bits`` bits is symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else None
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if self.single is not None:
            self.bits, self.table = 0, np.array([self.single << 4])
            return
        order = used[np.lexsort((used, lengths[used]))]
        sizes = lengths[order]
        self.bits = int(sizes[-1])
        spread = 1 << (self.bits - sizes)
        if spread.sum() != 1 << self.bits:
            raise ValueError("a prefix code that isn't complete")
        self.table = np.repeat(order << 4 | sizes, spread)[reversed_bits(self.bits)]
        self.list: list[int] | None = None

    def read(self, bits: BitReader) -> int:
        if self.single is not None:
            return self.single
        if self.list is None:
            self.list = self.table.tolist()
        first = bits.at >> 3
        entry = self.list[int.from_bytes(bits.data[first : first + 4], "little") >> (bits.at & 7) & ((1 << self.bits) - 1)]
        bits.at += entry & 15
        return entry >> 4


def put_single(out: BitWriter, symbol: int) -> None:
    """The prefix code of a single symbol."""
    out.put(1, 1)
    out.put(0, 1)
    out.put(int(symbol > 1), 1)
    out.put(symbol, 8 if symbol > 1 else 1)


def write_code(out: BitWriter, lengths: np.ndarray) -> None:
    """A prefix code's lengths."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and max(used, default=0) < 256:
        out.put(1, 1)
        out.put(max(0, len(used) - 1), 1)
        first = used[0] if used else 0
        out.put(int(first > 1), 1)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    tokens = _length_tokens(lengths.tolist(), used)
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    sizes = code_lengths(counts, 7)
    codes = canonical(sizes)
    single = np.count_nonzero(sizes) == 1
    order = [i for i in range(19) if sizes[CODE_LENGTH_ORDER[i]]]
    n = max(4, order[-1] + 1)
    out.put(0, 1)
    out.put(n - 4, 4)
    for i in range(n):
        out.put(int(sizes[CODE_LENGTH_ORDER[i]]), 3)
    out.put(1, 1)  # the number of tokens follows
    out.put(4, 3)  # in ten bits
    out.put(len(tokens) - 2, 10)
    values, bits = codes.tolist(), [0] * 19 if single else sizes.tolist()
    for symbol, extra, more in tokens:
        out.put(values[symbol] | extra << bits[symbol], bits[symbol] + more)


def _length_tokens(lengths: list[int], used: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, extra value, extra bits) that say code lengths: each length, and runs of zeros before it."""
    tokens, at = [], 0
    for u in used:
        while (n := min(u - at, 138)) >= 3:
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            at += n
        tokens += [(0, 0, 0)] * (u - at)
        tokens.append((lengths[u], 0, 0))
        at = u + 1
    return tokens


def read_code(bits: BitReader, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    if bits.get(1):
        two = bits.get(1)
        symbols = [bits.get(8 if bits.get(1) else 1)] + ([bits.get(8)] if two else [])
        lengths[symbols] = 1
        return lengths
    sizes = np.zeros(19, np.int64)
    for i in range(bits.get(4) + 4):
        sizes[CODE_LENGTH_ORDER[i]] = bits.get(3)
    code = PrefixCode(sizes)
    left = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else alphabet
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            previous, n = symbol or previous, 1
        elif symbol == 16:
            n = 3 + bits.get(2)
            lengths[at : at + n] = previous
        else:
            n = 3 + bits.get(3) if symbol == 17 else 11 + bits.get(7)
        if at + n > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        at += n
    return lengths


def read_group(bits: BitReader, cache: int) -> list[PrefixCode]:
    out: list[PrefixCode] = []
    seen: dict[bytes, PrefixCode] = {}
    for n in (GREENS + LENGTHS + cache, 256, 256, 256, DISTANCES):
        lengths = read_code(bits, n)
        key = lengths.tobytes().rstrip(b"\0")
        if key not in seen:
            seen[key] = PrefixCode(lengths)
        out.append(seen[key])
    return out


def read_value(bits: BitReader, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.get(extra) + 1


def value_prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = bits.get(4) if bits.get(1) else 0
    groups_at, meta, n_groups = 0, None, 1
    if main and bits.get(1):
        groups_at = bits.get(3) + 2
        meta_width = -(-width >> groups_at)
        meta = (read_pixels(bits, meta_width, -(-height >> groups_at), False) >> 8 & 0xFFFF).tolist()
        n_groups = max(meta) + 1
    groups = [read_group(bits, 1 << cache_bits if cache_bits else 0) for _ in range(n_groups)]
    if meta is None:
        return _read_by_tables(bits, groups[0], width, height, cache_bits)
    n, at = width * height, 0
    out = [0] * n
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    while at < n:
        green, red, blue, alpha, far = groups[meta[(at // width >> groups_at) * meta_width + (at % width >> groups_at)] if meta else 0]
        s = green.read(bits)
        if s < GREENS:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < GREENS + LENGTHS:
            length = read_value(bits, s - GREENS)
            back = distance(read_value(bits, far.read(bits)), width)
            if back > at or length > n - at:
                raise ValueError("a back-reference beyond the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            while cached < at:  # the cache is filled only as far as it is needed
                cache[(HASH * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[s - GREENS - LENGTHS]
            at += 1
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return np.array(out, np.int64)


def cache_places(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """Each pixel's place in a colour cache."""
    return (pixels.astype(np.uint32) * np.uint32(HASH) >> np.uint32(32 - cache_bits)).astype(np.int64)


def _from_cache(pixels: np.ndarray, place: np.ndarray, literal: np.ndarray, cache: np.ndarray) -> None:
    """Fills in the pixels that aren't literal: the last literal before with the same place, else what the cache has there; then brings the cache up to date."""
    order = np.argsort(place, kind="stable")
    rank = np.arange(len(order))
    first = np.concatenate([[True], place[order][1:] != place[order][:-1]])
    begin = np.maximum.accumulate(np.where(first, rank, 0))
    last = np.maximum.accumulate(np.where(literal[order], rank, -1))
    here = last >= begin
    source = np.where(here, pixels[order[np.maximum(last, 0)]], cache[place[order]])
    pixels[order] = source
    cache[place] = pixels  # of equal places the last one stays


def _read_by_tables(bits: BitReader, group: list[PrefixCode], width: int, height: int, cache_bits: int) -> np.ndarray:
    """Pixels of one group."""
    n, at = width * height, 0
    green, red, blue, alpha, far = group
    out = np.empty(n, np.int64)
    if all(c.single is not None for c in group[:4]) and green.single < GREENS:
        out[:] = alpha.single << 24 | red.single << 16 | green.single << 8 | blue.single
        return out
    base = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, offset=base).astype(np.int64)
    raw = np.concatenate([raw, np.zeros(8, np.int64)])
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    window = ((words[:, None] >> np.arange(8)) & 0x7FFF).ravel().astype(np.int32)
    size = len(window)
    ahead: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def jump(code: PrefixCode) -> tuple[np.ndarray, np.ndarray]:
        """At each bit: the table's entry, and the position behind the code."""
        if id(code) not in ahead:
            entry = code.table.astype(np.int32)[window & ((1 << code.bits) - 1)]
            behind = np.arange(size, dtype=np.int32) + (entry & 15)
            ahead[id(code)] = entry, np.minimum(behind, size - 1)
        return ahead[id(code)]

    (g, after_g), (r, after_r), (b, after_b), (a, after_a) = map(jump, group[:4])
    step = after_a[after_b[after_r[after_g]]] if alpha.single is None else after_b[after_r[after_g]]
    most = green.table.max() >> 4
    from_cache = GREENS + LENGTHS
    if most >= from_cache:
        step = np.where(g >= from_cache << 4, after_g, step)
    cache = np.zeros(1 << cache_bits, np.int64) if cache_bits else None
    stop = memoryview((g >= GREENS << 4) & (g < from_cache << 4)) if most >= GREENS else None
    chain, here = memoryview(step), bits.at - 8 * base
    while at < n:
        found = []
        if stop is None:
            for _ in range(n - at):
                found.append(here)
                here = chain[here]
        else:
            for _ in range(n - at):
                if stop[here]:
                    break
                found.append(here)
                here = chain[here]
        if found:
            p = np.array(found)
            new = out[at : at + len(p)]
            symbol = g[p] >> 4
            literal = symbol < GREENS
            if not literal.all():
                p = p[literal]
            pr = after_g[p]
            pb = after_r[pr]
            pa = after_b[pb]
            new[literal] = (a[pa] >> 4).astype(np.int64) << 24 | (r[pr] >> 4) << 16 | symbol[literal] << 8 | b[pb] >> 4
            if cache is not None:
                place = symbol - from_cache
                place[literal] = cache_places(new[literal], cache_bits)
                _from_cache(new, place, literal, cache)
            at += len(found)
        if at < n:
            bits.at = 8 * base + here
            length = read_value(bits, green.read(bits) - GREENS)
            back = distance(read_value(bits, far.read(bits)), width)
            if back > at or length > n - at:
                raise ValueError("a back-reference beyond the image")
            copied = np.resize(out[at - back : min(at, at - back + length)], length)
            out[at : at + length] = copied
            if cache is not None:
                cache[cache_places(copied, cache_bits)] = copied
            at += length
            here = bits.at - 8 * base
        if here >= size - 1:
            raise ValueError("the stream ends early")
    bits.at = 8 * base + here
    return out


def channels(pixels: np.ndarray) -> np.ndarray:
    """A, R, G, B in the last axis."""
    return np.stack([pixels >> k & 255 for k in (24, 16, 8, 0)], -1)


def joined(parts: np.ndarray) -> np.ndarray:
    p = parts.astype(np.int64) & 255
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _clamp(x: int) -> int:
    return min(255, max(0, x))


def predict(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """A pixel's prediction by one of the fourteen modes; pixels are lists of four channels."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return _average(_average(left, top_right), top)
        case 6:
            return _average(left, top_left)
        case 7:
            return _average(left, top)
        case 8:
            return _average(top_left, top)
        case 9:
            return _average(top, top_right)
        case 10:
            return _average(_average(left, top_left), _average(top, top_right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, top_left))
            to_top = sum(abs(x - c) for x, c in zip(left, top_left))
            return left if to_left < to_top else top
        case 12:
            return [_clamp(x + t - c) for x, t, c in zip(left, top, top_left)]
        case 13:
            half = _average(left, top)
            return [_clamp(h + int((h - c) / 2)) for h, c in zip(half, top_left)]
        case _:
            return [255, 0, 0, 0]


def predicted(image: list[list[int]], at: int, width: int, modes: list[int], block: int, per_row: int) -> list[int]:
    """The prediction of pixel ``at`` from the finished pixels before it."""
    y, x = divmod(at, width)
    if at == 0:
        return [255, 0, 0, 0]
    if y == 0:
        return image[at - 1]
    if x == 0:
        return image[at - width]
    # right of the last pixel of the row above lies the first of this row
    return predict(modes[(y >> block) * per_row + (x >> block)], image[at - 1], image[at - width], image[at - width + 1], image[at - width - 1])


def invert_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    parts, per_row = channels(pixels), -(-width >> block)
    modes = (modes >> 8 & 15).tolist()
    if set(modes) == {1}:  # left: running sums along each row, whose first pixels sum up downwards
        rows = parts.reshape(-1, width, 4).copy()
        rows[0, 0, 0] += 255
        rows[:, 0] = np.cumsum(rows[:, 0], 0)
        return joined(np.cumsum(rows, 1).reshape(-1, 4))
    if set(modes) == {2}:  # top: the first row sums up to the right, then all columns downwards
        rows = parts.reshape(-1, width, 4).copy()
        rows[0, 0, 0] += 255
        rows[0] = np.cumsum(rows[0], 0)
        return joined(np.cumsum(rows, 0).reshape(-1, 4))
    rest, image = parts.tolist(), []
    for at, p in enumerate(rest):
        image.append([(v + q) & 255 for v, q in zip(p, predicted(image, at, width, modes, block, per_row))])
    return joined(np.array(image).reshape(-1, 4))


def _spread(elements: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """Each pixel's element of a block image."""
    per_row = -(-width >> block)
    y, x = np.divmod(np.arange(width * height), width)
    return elements[(y >> block) * per_row + (x >> block)]


def cross_colour(pixels: np.ndarray, width: int, height: int, elements: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Adds (sign 1: inverse) or takes off the colour deltas."""
    parts, e = channels(pixels), channels(_spread(elements, width, height, block))
    signed = lambda v: (v.astype(np.int64) ^ 128) - 128
    red_to_blue, green_to_blue, green_to_red = (signed(e[:, k]) for k in (1, 2, 3))
    green, red, blue = signed(parts[:, 2]), parts[:, 1], parts[:, 3]
    new_red = (red + sign * (green_to_red * green >> 5)) & 255
    true_red = new_red if sign > 0 else red
    new_blue = (blue + sign * ((green_to_blue * green >> 5) + (red_to_blue * signed(true_red) >> 5))) & 255
    return joined(np.stack([parts[:, 0], new_red, parts[:, 2], new_blue], -1))


def green_added(pixels: np.ndarray, sign: int) -> np.ndarray:
    p = channels(pixels)
    return joined(np.stack([p[:, 0], p[:, 1] + sign * p[:, 2], p[:, 2], p[:, 3] + sign * p[:, 2]], -1))


def palette_bits(size: int) -> int:
    """log2 of the pixels that share one stored pixel."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(file: bytes) -> np.ndarray:
    """The image of one lossless WebP file: an array (height, width, 4) of R, G, B, A samples."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    if file[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack_from("<I", file, 16)
    bits = BitReader(file[20 : 20 + size])
    if bits.get(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.get(14) + 1, bits.get(14) + 1
    bits.get(1)
    if bits.get(3):
        raise ValueError("an unknown version")
    stored, undo = width, []
    while bits.get(1):
        kind = bits.get(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.get(3) + 2
            undo.append((kind, stored, block, read_pixels(bits, -(-stored >> block), -(-height >> block), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, stored, 0, None))
        else:
            n = bits.get(8) + 1
            colours = joined(np.cumsum(channels(read_pixels(bits, n, 1, False)), 0))
            undo.append((kind, stored, palette_bits(n), colours))
            stored = -(-stored >> palette_bits(n))
    pixels = read_pixels(bits, stored, height, True)
    for kind, w, block, data in reversed(undo):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, w, data, block)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, w, height, data, block, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = green_added(pixels, 1)
        else:
            index = pixels >> 8 & 255
            if block:
                each = 8 >> block
                index = (index[:, None] >> (np.arange(1 << block) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :w].ravel()
            pixels = np.where(index < len(data), data[np.minimum(index, len(data) - 1)], 0)
    return channels(pixels)[:, [1, 2, 3, 0]].astype(np.uint8).reshape(height, width, 4)


def riff(body: bytes) -> bytes:
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


#: Pixels that a back-reference repeats at least, and at most.
LEAST_COPY, MOST_COPY = 8, 4096
#: log2 of the colour cache's places, where there is one.
CACHE_BITS = 8
#: log2 of a block of a transform's image, the largest: one element for 512 x 512 pixels.
BLOCK = 9
#: What a transform or a symbol's code length costs, in bits, for the estimates.
TRANSFORM_BITS, SYMBOL_BITS, COLOUR_BITS = 90, 4, 18
#: What a back-reference costs, and a used place of the cache, in bits; and the share of an image's bits that either must save to be worth its time.
COPY_BITS, PLACE_BITS, WORTH = 40, 8, 0.12
OPAQUE = 255 << 24


#: n log2(n) of small counts.
_N_LOG_N = np.concatenate([[0.0], np.arange(1, 4096) * np.log2(np.arange(1, 4096))])


def bits_of(symbols: np.ndarray) -> float:
    """What the symbols cost by their own frequencies, with the lengths of their codes."""
    counts = np.bincount(symbols)
    n = len(symbols)
    within = _N_LOG_N[counts].sum() if n < len(_N_LOG_N) else (counts * np.log2(np.maximum(counts, 1))).sum()
    return float(n * np.log2(max(n, 1)) - within) + SYMBOL_BITS * np.count_nonzero(counts)


def left_residual(rows: np.ndarray) -> np.ndarray:
    """Samples (height, width, 3) less their left neighbours, the first of a row less the one above."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    out[1:, 0] -= rows[:-1, 0]
    return out


def top_residual(rows: np.ndarray) -> np.ndarray:
    """Samples less their upper neighbours, the first row's less the left ones."""
    out = rows.copy()
    out[1:] -= rows[:-1]
    out[0, 1:] -= rows[0, :-1]
    return out


def less_green(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[..., 0] -= rows[..., 1]
    out[..., 2] -= rows[..., 1]
    return out


def red_off_blue(rows: np.ndarray) -> np.ndarray:
    """Cross-colour with red taken off blue: element 32 moves a whole step."""
    out = rows.copy()
    out[..., 2] -= rows[..., 0]
    return out


#: name: (residual, kind of transform, the one value of its block image as ARGB)
TRANSFORMS = {"left": (left_residual, PREDICTOR, 1 << 8), "top": (top_residual, PREDICTOR, 2 << 8), "green": (less_green, SUBTRACT_GREEN, None), "cross": (red_off_blue, CROSS_COLOUR, 32 << 16)}


def repeats(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, gap) of stretches that were there before, left to right; found by hashes of LEAST_COPY pixels."""
    if len(pixels) <= LEAST_COPY:
        return []
    h, step, factor = pixels.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while step < LEAST_COPY:  # of 2, 4, 8 pixels
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor & (1 << 64) - 1
    ascending = np.sort(h)
    if not (ascending[1:] == ascending[:-1]).any():
        return []
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    later, before = order[1:][same], order[:-1][same]
    by_place = np.argsort(later)
    out, end = [], 0
    for start, source in zip(later[by_place].tolist(), before[by_place].tolist()):
        if start < end:
            continue
        most = min(MOST_COPY, len(pixels) - start)
        unlike = np.flatnonzero(pixels[start : start + most] != pixels[source : source + most])
        length = int(unlike[0]) if len(unlike) else most
        if length >= LEAST_COPY:
            out.append((start, length, start - source))
            end = start + length
    return out


_CODE_OF_GAP: dict[int, dict[int, int]] = {}


def gap_code(gap: int, width: int) -> int:
    """The distance code of a gap in pixels."""
    if width not in _CODE_OF_GAP:
        _CODE_OF_GAP[width] = {max(1, x + y * width): k for k, (x, y) in reversed(list(enumerate(NEAR, 1)))}
    return _CODE_OF_GAP[width].get(gap, gap + len(NEAR))


def cache_hits(pixels: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the last pixel before with the same place is the same."""
    order = np.argsort(place, kind="stable")
    hit = np.zeros(len(pixels), bool)
    there, what = place[order], pixels[order]
    hit[order[1:]] = (there[1:] == there[:-1]) & (what[1:] == what[:-1])
    return hit


def put_pixels(out: BitWriter, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, hit: np.ndarray | None = None, place: np.ndarray | None = None, copies: list[tuple[int, int, int]] = ()) -> None:
    """An entropy-coded image of ARGB numbers with one group of prefix codes."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    token = np.ones(len(pixels), bool)
    for start, length, _ in copies:
        token[start + 1 : start + length] = False
    at = np.flatnonzero(token)
    parts = pixels[at] if copies else pixels
    symbols = np.stack([parts >> 8 & 255, parts >> 16 & 255, parts & 255], 1)
    alpha = parts >> 24
    literal = np.ones(len(at), bool)
    if cache_bits:
        literal = ~hit[at]
        symbols[~literal, 0] = GREENS + LENGTHS + place[at[~literal]]
    far: list[tuple[int, int, int]] = []
    if copies:
        of_copy = np.searchsorted(at, [c[0] for c in copies])
        literal[of_copy] = False
        size = [value_prefix(length) for _, length, _ in copies]
        far = [value_prefix(gap_code(gap, width)) for _, _, gap in copies]
        symbols[of_copy, 0] = [GREENS + s[0] for s in size]
    # all channels share a code, unless green has other symbols, too, or alone has any
    one = not (cache_bits or copies) and bool(symbols[0, 1:].any() or symbols[:, 1:].any())
    plain = symbols if one else symbols[literal]
    own = lambda values: code_lengths(np.bincount(values)) if len(values) else np.array([1])
    several = own(plain.ravel() if one else plain[:, 1:].ravel())
    alphas = None if alpha[0] == alpha[-1] and (alpha == alpha[0]).all() else own(alpha[literal])
    gaps = own(np.array([f[0] for f in far], np.int64)) if copies else None
    first = several if one else own(symbols[:, 0])
    head = BitWriter()
    write_code(head, several)
    if one:
        out.put(head.value, head.bits)
    else:
        write_code(out, first)
    out.put(head.value, head.bits)
    out.put(head.value, head.bits)
    for lengths, constant in ((alphas, int(alpha[0])), (gaps, 0)):
        if lengths is None:
            put_single(out, constant)
        else:
            write_code(out, lengths)
    used = lambda n: n if np.count_nonzero(n) > 1 else np.zeros_like(n)  # noqa: E731  a single symbol takes no bits
    if one and alphas is None:
        out.put_array(canonical(several)[symbols].ravel(), used(several)[symbols].ravel())
        return
    values, sizes = np.zeros((len(at), 4), np.int64), np.zeros((len(at), 4), np.int64)
    values[:, 0], sizes[:, 0] = canonical(first)[symbols[:, 0]], used(first)[symbols[:, 0]]
    for k in (1, 2):
        values[literal, k], sizes[literal, k] = canonical(several)[plain[:, k]], used(several)[plain[:, k]]
    if alphas is not None and np.count_nonzero(alphas) > 1:
        values[literal, 3], sizes[literal, 3] = canonical(alphas)[alpha[literal]], alphas[alpha[literal]]
    if copies:
        values[of_copy, 1], sizes[of_copy, 1] = [s[1] for s in size], [s[2] for s in size]
        which = [f[0] for f in far]
        values[of_copy, 2], sizes[of_copy, 2] = canonical(gaps)[which], used(gaps)[which]
        values[of_copy, 3], sizes[of_copy, 3] = [f[1] for f in far], [f[2] for f in far]
    out.put_array(values.ravel(), sizes.ravel())


def encode_rgb(samples: np.ndarray, transform: str | None = None) -> bytes:
    """A lossless WebP file of an array (height, width, 3); ``transform`` (a name of TRANSFORMS, ``palette`` or ``none``) stands before the estimate."""
    height, width, _ = samples.shape
    out = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(value, n)
    argb = lambda rows, alpha: (rows[..., 0].astype(np.int64) << 16 | rows[..., 1].astype(np.int64) << 8 | rows[..., 2] | alpha).ravel()
    pixels = argb(samples, OPAQUE)
    place = cache_places(pixels, CACHE_BITS)
    total = bits_of(samples.reshape(-1))
    if transform is None:
        cost = {"none": total} | {name: bits_of(f(samples).reshape(-1)) + TRANSFORM_BITS for name, (f, _, _) in TRANSFORMS.items()}
        if bits_of(place) + COLOUR_BITS * np.count_nonzero(np.bincount(place)) < total:  # colours are no fewer than places
            cost["palette"] = palette_cost(pixels)
        transform = min(cost, key=cost.get)
    stored = width
    if transform == "palette":
        colours, index = np.unique(pixels, return_inverse=True)
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        parts = channels(colours)
        put_pixels(out, joined(np.diff(parts, axis=0, prepend=0)), len(colours), False)
        stored, pixels = bundled(index.reshape(height, width), palette_bits(len(colours)))
    elif transform != "none":
        residual, kind, element = TRANSFORMS[transform]
        out.put(1, 1)
        out.put(kind, 2)
        if element is not None:
            out.put(BLOCK - 2, 3)
            n = (-(-width >> BLOCK)) * (-(-height >> BLOCK))
            put_pixels(out, np.full(n, element | OPAQUE), -(-width >> BLOCK), False)
        pixels = argb(residual(samples), 0 if kind == PREDICTOR else OPAQUE)
    out.put(0, 1)
    if transform != "none":
        place, total = cache_places(pixels, CACHE_BITS), bits_of(symbols_of(pixels))
    each = total / len(pixels)
    worth = WORTH * total
    copies = repeats(pixels)
    if sum(length * each - COPY_BITS for _, length, _ in copies) < worth:
        copies = []
    hit = cache_hits(pixels, place)
    pays = np.count_nonzero(hit) * (each - CACHE_BITS - 1) - PLACE_BITS * np.count_nonzero(np.bincount(place[hit])) > worth
    put_pixels(out, pixels, stored, True, *((CACHE_BITS, hit, place) if pays else (0, None, None)), copies)
    return riff(out.done())


def symbols_of(pixels: np.ndarray) -> np.ndarray:
    return np.concatenate([pixels >> 8 & 255, pixels >> 16 & 255, pixels & 255])


def palette_cost(pixels: np.ndarray) -> float:
    """Bits by a palette, or infinity beyond 256 colours."""
    colours, counts = np.unique(pixels, return_counts=True)
    if len(colours) > 256:
        return float("inf")
    n = len(pixels)
    return float(n * np.log2(n) - (counts * np.log2(counts)).sum()) + (SYMBOL_BITS + COLOUR_BITS) * len(colours) + TRANSFORM_BITS


def bundled(index: np.ndarray, block: int) -> tuple[int, np.ndarray]:
    """Width and ARGB numbers of palette places, 2**block of them in one pixel."""
    height, width = index.shape
    each, per = 8 >> block, 1 << block
    wide = -(-width // per)
    full = np.zeros((height, wide * per), np.int64)
    full[:, :width] = index
    packed = (full.reshape(height, wide, per) << (np.arange(per) * each)).sum(-1) if block else full
    return wide, (packed << 8 | OPAQUE).ravel()


def store(payload: bytes) -> bytes:
    """Lossless WebP files, one after another, of a payload whose size is a multiple of ROW_BYTES."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return b"".join(encode_rgb(rows[at : at + MAX_ROWS]) for at in range(0, len(rows), MAX_ROWS))


def load(media: bytes) -> np.ndarray:
    """The samples (rows, WIDTH, 3) of what store() gave."""
    images, at = [], 0
    while at < len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        images.append(decode(media[at : at + 8 + size])[..., :3])
        at += 8 + size
    return images[0] if len(images) == 1 else np.concatenate(images)
