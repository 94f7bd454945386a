"""Lossless WebP: a decoder of the whole format and an encoder for arrays of pixels.

Written from the public specification of the lossless bitstream. Pixels are
(height, width, 4) arrays of 8-bit red, green, blue, alpha. The decoder reads
prefix codes (simple and normal), meta prefix images, back-references with the
two-dimensional short distances, the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Where one colour alone takes bits,
symbols are looked up at every bit position by array operations and then followed from
one to the next; other images are read symbol by symbol. ``encode_samples`` writes a row of 8-bit samples as a palette
image with matches, colour cache and fitted prefix codes, made by array operations;
``encode`` takes any pixels and transforms.
"""

from __future__ import annotations

import struct
from functools import cache, cached_property

import numpy as np

MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed values of the format: the order of code-length codes, and the (x, y) offsets of the 120 short distances.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_HASH = 0x1E35A7BD
#: An odd number whose products spread keys over the upper bits.
_SPREAD = 0x9E3779B97F4A7C15
#: Longest code of ``encode_samples``, colour cache bits, and least and greatest length of its matches.
MOST_BITS, CACHE_BITS, LEAST_MATCH, MOST_MATCH = 11, 9, 8, 4096
#: Colours of at least one in so many pixels are read from the cache.
OFTEN = 256
#: Code lengths that hold in all files of ``encode_samples``, so that neither side fits or reads them: of the steps of a palette, and of distances.
PALETTE_LENGTHS = [10, 1, 3, 3, 9, 9, 9, *[10] * 249, *[0] * 24]
FAR_LENGTHS = [*[7] * 13, 6, *[4] * 12, *[6] * 3, *[7] * 11]
#: Extra bits of the prefix symbols of lengths and distances, and a number above the bits of any code and its extra bits.
_EXTRA, COPY = np.maximum(np.arange(40) - 2 >> 1, 0), 128
_BEFORE = np.concatenate([np.zeros(256, np.uint8), (_EXTRA[:24] + COPY).astype(np.uint8), np.zeros(1 << 11, np.uint8)])
#: Bytes whose bit positions are looked up at a time.
AHEAD = 1 << 15


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image data is cut off")
        return value


    def read_long(self, n: int) -> int:
        """As many bits as wanted."""
        byte, moved = self.at >> 3, self.at & 7
        self.at += n
        if self.at > self.end:
            raise ValueError("the image data is cut off")
        return int.from_bytes(self.data[byte : byte + (n + moved + 7 >> 3)], "little") >> moved & (1 << n) - 1


@cache
def _reversed(bits: int) -> np.ndarray:
    """The numbers of ``bits`` bits, each with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


@cache
def _reversed_list() -> list[int]:
    return _reversed(15).tolist()


class PrefixCode:
    """A canonical code as an array from the next bits to 16 times a symbol, plus its length."""

    def __init__(self, used: list[tuple[int, int]]):
        """``used`` holds (length, symbol)."""
        used = sorted(used)
        if len(used) < 2:
            self.only, self.bits = used[0][1] if used else 0, 0
            self.array = np.full(1, self.only << 4, np.uint16)
            return
        if sum([1 << 15 - n for n, _ in used]) != 1 << 15:
            raise ValueError("the prefix code is not complete")
        self.only, self.bits = None, used[-1][0]
        entries = np.array([s << 4 | n for n, s in used], np.uint16)
        self.array = np.repeat(entries, [1 << self.bits - n for n, _ in used])[_reversed(self.bits)]

    @cached_property
    def table(self) -> list[int]:
        return self.array.tolist()

    def read(self, bits: BitReader) -> int:
        entry = self.table[bits.peek(self.bits)]
        bits.at += entry & 15
        if bits.at > bits.end:
            raise ValueError("the image data is cut off")
        return entry >> 4


@cache
def _single_code(symbol: int) -> PrefixCode:
    return PrefixCode([(1, symbol)])


def _read_code(bits: BitReader, size: int) -> PrefixCode:
    if bits.peek(11) & 0b111 == 0b101:
        symbol = bits.read(11) >> 3
        if symbol >= size:
            raise ValueError("a symbol is beyond its alphabet")
        return _single_code(symbol)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise ValueError("a symbol is beyond its alphabet")
        if not two:
            return _single_code(symbols[0])
        return PrefixCode([(1, s) for s in set(symbols)])
    n = 4 + bits.read(4)
    told, used = bits.read_long(3 * n), []
    code = PrefixCode([(told >> 3 * i & 7, s) for i, s in enumerate(_LENGTH_ORDER[:n]) if told >> 3 * i & 7])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, table, mask = 0, 8, code.table, (1 << code.bits) - 1
    ahead, held, place = 0, 0, bits.at
    while at < size and left:
        left -= 1
        if held < 14:
            byte, moved = place >> 3, place & 7
            ahead, held = int.from_bytes(bits.data[byte : byte + 24], "little") >> moved, 192 - moved
        entry = table[ahead & mask]
        s, n = entry >> 4, entry & 15
        ahead >>= n
        held -= n
        place += n
        if s < 16:
            if s:
                used.append((s, at))
                last = s
            at += 1
            continue
        value, extra, least = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
        n = least + (ahead & (1 << extra) - 1)
        ahead >>= extra
        held -= extra
        place += extra
        if at + n > size:
            raise ValueError("the code lengths run over")
        if value:
            used += [(value, i) for i in range(at, at + n)]
        at += n
    bits.at = place
    return PrefixCode(used)


@cache
def _fixed_codes(palette: bool) -> tuple[int, int, list[PrefixCode]]:
    """The codes that are the same in all files of ``encode_samples`` as bits, their number, and the codes: all five of a palette of several colours, or those after green."""
    bits = BitWriter()
    if palette:
        _put_code(bits, PALETTE_LENGTHS)
        _put_single(bits, 0)
        _put_single(bits, 0)
        bits.put(0b111 | 255 << 11, 19)
        _put_single(bits, 0)
    else:
        for symbol in (0, 0, 255):
            _put_single(bits, symbol)
        _put_code(bits, FAR_LENGTHS)
    reader = BitReader(bits.take() + bytes(8))
    return bits.value, bits.n, [_read_code(reader, n) for n in ((len(PALETTE_LENGTHS),) if palette else ()) + (256, 256, 256, len(FAR_LENGTHS))]


def _known_codes(bits: BitReader, palette: bool) -> list[PrefixCode] | None:
    """The fixed codes, if they come next: they are compared as a whole and not read again."""
    value, n, codes = _fixed_codes(palette)
    byte, moved = bits.at >> 3, bits.at & 7
    if bits.at + n > bits.end or int.from_bytes(bits.data[byte : byte + (n + moved + 7 >> 3)], "little") >> moved & (1 << n) - 1 != value:
        return None
    bits.at += n
    return codes


def _read_codes(bits: BitReader, sizes: tuple[int, ...]) -> list[PrefixCode]:
    if sizes[0] == len(PALETTE_LENGTHS) and (known := _known_codes(bits, True)):
        return known
    green = _read_code(bits, sizes[0])
    return [green, *(_known_codes(bits, False) or [_read_code(bits, size) for size in sizes[1:]])]


def _prefix_values(symbols: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefix symbols, by the bits after these, and how many of the bits they take."""
    extra = _EXTRA[symbols]
    return np.where(symbols < 4, symbols, (2 + (symbols & 1) << extra) + (ahead & (1 << extra) - 1)) + 1, extra


def _green_symbols(bits: BitReader, green: PrefixCode, far: PrefixCode, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of ``total`` pixels of which green alone takes bits, with the pixels that each makes and, for copies, its distance symbol's value.

    What would start at each bit position of a part is looked up side by side; the true starts are those met from the first on.
    """
    data, start, found, made = np.frombuffer(bits.data, np.uint8), bits.at, [], 0
    # Bits of a symbol; of a copy those before its distance code, plus COPY, and those from there on.
    taken = (green.array & 15).astype(np.uint8) + _BEFORE[green.array >> 4]
    onward = (far.array & 15).astype(np.uint8) + _EXTRA.astype(np.uint8)[far.array >> 4]
    while made < total:
        if start >= bits.end:
            raise ValueError("the image data is cut off")
        first = start >> 3
        part = np.zeros(min(AHEAD, len(data) - first) + 8, np.uint8)
        part[: len(data) - first] = data[first : first + len(part)]
        eight = np.ndarray(len(part) - 8, "<i8", part, strides=(1,))
        ahead = (eight[:, None] >> np.arange(8)).reshape(-1)
        step = taken.take(ahead & (1 << green.bits) - 1)
        copies = np.flatnonzero(step >= COPY)
        before = step[copies] - np.uint8(COPY)
        step[copies] = before + onward[ahead[copies] >> before & (1 << far.bits) - 1]
        # The place after one symbol, then after two, four and eight; places beyond the part stay.
        limit = len(step)
        hops = [np.arange(limit + COPY)]
        hops[0][:limit] += step
        for _ in range(3):
            hops.append(hops[-1].take(hops[-1]))
        jump, at, own = memoryview(hops.pop()), start & 7, []
        while at < limit:
            own.append(at)
            at = jump[at]
        own, start = np.array(own), 8 * first + at
        while hops:
            own = np.stack([own, hops.pop()[own]], 1).reshape(-1)
        own = own[own < limit]
        ahead = ahead[own]
        entry = green.array[ahead & (1 << green.bits) - 1].astype(np.int64)
        symbol = entry >> 4
        makes, back = np.ones(len(own), np.int64), np.zeros(len(own), np.int64)
        copied = np.flatnonzero((symbol > 255) & (symbol < 280))
        rest = ahead[copied] >> (entry[copied] & 15)
        makes[copied], used = _prefix_values(symbol[copied] - 256, rest)
        rest >>= used
        entry = far.array[rest & (1 << far.bits) - 1].astype(np.int64)
        back[copied] = _prefix_values(entry >> 4, rest >> (entry & 15))[0]
        ends = made + np.cumsum(makes)
        if (made := int(ends[-1])) >= total:
            last = int(np.searchsorted(ends, total))
            if ends[last] > total:
                raise ValueError("a back-reference leaves the image")
            start = 8 * first + int(own[last]) + int(step[own[last]])
            symbol, makes, back = symbol[: last + 1], makes[: last + 1], back[: last + 1]
        found.append((symbol, makes, back))
    bits.at = start
    if start > bits.end:
        raise ValueError("the image data is cut off")
    return tuple(np.concatenate(x) for x in zip(*found))


@cache
def _near_distances(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in _NEAR])


@cache
def _green_slots(fixed: int, cache_bits: int) -> np.ndarray:
    """The places in the colour cache of the colours that differ from ``fixed`` in green."""
    return (_HASH * (fixed | np.arange(256) << 8) & 0xFFFFFFFF) >> (32 - cache_bits)


def _green_pixels(symbols: np.ndarray, makes: np.ndarray, back: np.ndarray, width: int, fixed: int, cache_bits: int) -> np.ndarray | None:
    """The pixels of ``_green_symbols``; None if a place of the colour cache is read before a colour is in it."""
    plain = np.flatnonzero((symbols < 256) | (symbols >= 280))
    values = symbols[plain]
    literal = values < 256
    several = np.zeros(len(plain), bool)
    if not literal.all():
        slots = _green_slots(fixed, cache_bits)
        first, owner, owners = np.full(1 << cache_bits, len(plain)), np.zeros(1 << cache_bits, np.int64), {}
        at = np.flatnonzero(literal)[::-1]
        first[slots[values[at]]] = at
        colours = np.flatnonzero(np.bincount(values[at], minlength=256))
        owner[slots[colours]] = colours
        crowded = np.bincount(slots[colours], minlength=1 << cache_bits) > 1
        for v in colours[crowded[slots[colours]]].tolist():
            owners.setdefault(int(slots[v]), []).append(v)
        read = np.flatnonzero(~literal)
        if (first[values[read] - 280] > read).any():
            return None
        # Colours get into the cache as literals first. Where a place has had several, the last one of the pixels counts.
        several[read] = crowded[values[read] - 280]
        values = np.where(literal, values, owner[np.maximum(values - 280, 0)])
    given, out, sent = values.astype(np.uint8).tobytes(), bytearray(), 0
    near = _near_distances(width)
    event = (makes > 0) & (symbols > 255) & (symbols < 280)
    event[plain[several]] = True
    place = np.flatnonzero(event)
    before = np.searchsorted(plain, place)
    distance = np.where(back[place] > 120, back[place] - 120, near[np.clip(back[place], 1, 120) - 1])
    for upto, symbol, n, d in zip(before.tolist(), symbols[place].tolist(), makes[place].tolist(), distance.tolist()):
        out += given[sent:upto]
        sent = upto
        if symbol >= 280:
            out.append(max(owners[symbol - 280], key=out.rfind))
            sent += 1
            continue
        at = len(out)
        if d > at:
            raise ValueError("a back-reference leaves the image")
        out += out[at - d : at - d + n] if d >= n else (out[at - d :] * (n // d + 1))[:n]
    out += given[sent:]
    return np.frombuffer(out, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(fixed)


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """The entropy-coded pixels as 32-bit ARGB numbers, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    blocks, shift, across = None, 0, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        blocks = (_read_image(bits, across, -(-height >> shift), False) >> 8 & 0xFFFF).tolist()
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = []
    for _ in range(max(blocks) + 1 if blocks else 1):
        codes = _read_codes(bits, sizes)
        # Where three colours take no bits, a literal is one look-up.
        fixed = None if any(c.bits for c in codes[1:4]) else codes[3].only << 24 | codes[1].only << 16 | codes[2].only
        groups.append((codes, fixed))
    codes, fixed = groups[0]
    # Copies take up to 28 bits beside those of their two codes; 57 are looked ahead.
    if main and not blocks and fixed is not None and codes[0].bits and codes[0].bits + codes[4].bits <= 29:
        start = bits.at
        pixels = _green_pixels(*_green_symbols(bits, codes[0], codes[4], width * height), width, fixed, cache_bits)
        if pixels is not None:
            return pixels
        bits.at = start
    groups = [(codes, codes[0].table, (1 << codes[0].bits) - 1, fixed) for codes, fixed in groups]
    total, shade = width * height, 32 - cache_bits
    out, cache, slots = [0] * total, [0] * (1 << cache_bits), {}
    at = 0
    codes, table, mask, fixed = groups[0]
    data, place, end = bits.data, bits.at, bits.end
    # The next bits of the data: `held` of them in `ahead`, from bit `place` on; a symbol and a copy take at most 78.
    ahead = held = 0
    while at < total:
        if blocks:
            codes, table, mask, fixed = groups[blocks[(at // width >> shift) * across + (at % width >> shift)]]
        if held < 80:
            byte = place >> 3
            ahead, held = int.from_bytes(data[byte : byte + 32], "little") >> (place & 7), 256 - (place & 7)
        entry = table[ahead & mask]
        n = entry & 15
        ahead >>= n
        held -= n
        place += n
        s = entry >> 4
        if s < 256:
            if fixed is None:
                bits.at, held = place, 0
                r, b, a = [c.read(bits) if c.bits else c.only for c in codes[1:4]]
                v = a << 24 | r << 16 | s << 8 | b
                place = bits.at
            else:
                v = fixed | s << 8
            out[at] = v
            at += 1
            if cache_bits:
                if v not in slots:
                    slots[v] = (_HASH * v & 0xFFFFFFFF) >> shade
                cache[slots[v]] = v
        elif s < 280:
            far = codes[4]
            n, used = s - 255, 0
            if n > 4:
                used = (s - 258) >> 1
                n = ((2 + (s & 1)) << used) + (ahead & ((1 << used) - 1)) + 1
            entry = far.table[ahead >> used & ((1 << far.bits) - 1)]
            used += entry & 15
            s = entry >> 4
            d = s + 1
            if d > 4:
                extra = (s - 2) >> 1
                d = ((2 + (s & 1)) << extra) + (ahead >> used & ((1 << extra) - 1)) + 1
                used += extra
            ahead >>= used
            held -= used
            place += used
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            part = out[at - d : at - d + n] if d >= n else (out[at - d : at] * (n // d + 1))[:n]
            out[at : at + n] = part
            at += n
            if cache_bits:
                for v in part:
                    cache[slots[v]] = v
        else:
            v = out[at] = cache[s - 280]
            at += 1
            if v not in slots:
                slots[v] = (_HASH * v & 0xFFFFFFFF) >> shade
                cache[slots[v]] = v
    bits.at = place
    if place > end:
        raise ValueError("the image data is cut off")
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """(…, 4) arrays of red, green, blue, alpha of 32-bit numbers."""
    p = pixels.astype("<u4", copy=False).view(np.uint8).reshape(*shape, 4)
    out = np.empty_like(p)
    for to, at in enumerate((2, 1, 0, 3)):
        out[..., to] = p[..., at]
    return out


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _predict(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return avg(avg(left, top_right), top)
    if mode <= 9:
        return avg(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return avg(avg(left, top_left), avg(top, top_right))
    if mode == 11:
        # The estimate is left + top - top_left, so its distance from left is |top - top_left| and from top |left - top_left|.
        return left if sum(abs(t - c) for t, c in zip(top, top_left)) < sum(abs(x - c) for x, c in zip(left, top_left)) else top
    if mode == 12:
        return [_clip(x + t - c) for x, t, c in zip(left, top, top_left)]
    return [_clip(a + int((a - c) / 2)) for a, c in zip(avg(left, top), top_left)]


def _prediction(p: list, x: int, y: int, width: int, mode: int) -> list[int]:
    if not x and not y:
        return [0, 0, 0, 255]
    if not y:
        return p[x - 1]
    at = y * width + x
    if not x:
        return p[at - width]
    return _predict(mode, p[at - 1], p[at - width], p[at - width - 1], p[at - width + 1])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _block_values(image: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    """The block image's channels for each pixel."""
    across = -(-width >> shift)
    ys, xs = np.arange(height) >> shift, np.arange(width) >> shift
    return _channels(image, (len(image),))[ys[:, None] * across + xs[None, :]]


def _cross(p: np.ndarray, by: np.ndarray, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) the cross-colour parts; by holds red_to_blue, green_to_blue, green_to_red as red, green, blue."""
    p = p.astype(np.int32)
    red_blue, green_blue, green_red = (_signed(by[..., i]) for i in range(3))
    green = _signed(p[..., 1])
    red = (p[..., 0] + sign * ((green_red * green) >> 5)) & 255
    old_red = red if sign > 0 else p[..., 0]
    blue = (p[..., 2] + sign * ((green_blue * green) >> 5) + sign * ((red_blue * _signed(old_red)) >> 5)) & 255
    return np.stack([red, p[..., 1], blue, p[..., 3]], -1).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with lossless data; raises ValueError for other or damaged files."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image data")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    bits = BitReader(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    steps, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {k for k, *_ in steps}:
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            steps.append((kind, w, shift, _read_image(bits, -(-w >> shift), -(-height >> shift), False)))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, w, 0, None))
        else:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_read_image(bits, size, 1, False), (size,)), 0, dtype=np.uint8)
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            steps.append((kind, w, shift, table))
            w = -(-w >> shift)
    p = _channels(_read_image(bits, w, height, True), (height, w))
    for kind, w, shift, extra in reversed(steps):
        if kind == SUBTRACT_GREEN:
            p = np.stack([p[..., 0] + p[..., 1], p[..., 1], p[..., 2] + p[..., 1], p[..., 3]], -1)
        elif kind == CROSS_COLOUR:
            p = _cross(p, _block_values(extra, w, height, shift), 1)
        elif kind == PALETTE:
            depth = 8 >> shift
            index = p[..., 1] if not shift else np.stack([p[..., 1] >> (depth * i) & ((1 << depth) - 1) for i in range(1 << shift)], -1).reshape(height, -1)[:, :w]
            full = np.zeros((256, 4), np.uint8)
            full[: len(extra)] = extra
            p = full.view(np.uint32)[:, 0][index].view(np.uint8).reshape(height, w, 4)
        else:
            modes = _block_values(extra, w, height, shift)[..., 1].reshape(-1).tolist()
            rest, done = p.reshape(-1, 4).tolist(), []
            for i, (add, mode) in enumerate(zip(rest, modes)):
                done.append([(a + b) & 255 for a, b in zip(add, _prediction(done, i % w, i // w, w, mode & 15))])
            p = np.array(done, np.uint8).reshape(height, w, 4)
    return np.ascontiguousarray(p)


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def take(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of a prefix code for these counts; counts are flattened until no length passes the limit."""
    lengths = [0] * len(counts)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    used.sort(key=counts.__getitem__)
    weights, size = [counts[s] for s in used], len(used)
    while True:
        # Sorted weights and the sums of pairs, which come in order too.
        leaves, sums = [*weights, float("inf")], [float("inf")] * size
        parent, leaf, joined = [0] * (2 * size - 1), 0, 0
        for made in range(size, 2 * size - 1):
            total = 0
            for _ in (0, 1):
                if leaves[leaf] <= sums[joined]:
                    total += leaves[leaf]
                    parent[leaf] = made
                    leaf += 1
                else:
                    total += sums[joined]
                    parent[size + joined] = made
                    joined += 1
            sums[made - size] = total
        made = 2 * size - 1
        depth = [0] * made
        for i in range(made - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:size]) <= limit:
            for s, n in zip(used, depth):
                lengths[s] = n
            return lengths
        weights = [(n + 1) // 2 for n in weights]


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code with its first bit lowest, length)."""
    used = sorted([(n, s) for s, n in enumerate(lengths) if n])
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    turned, place, out = _reversed_list(), 0, {}
    for n, s in used:
        out[s] = turned[place], n
        place += 1 << 15 - n
    return out


def _code_columns(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``_codes`` as arrays by symbol: codes and their lengths, 0 for those without."""
    sizes = np.array(lengths)
    used = np.flatnonzero(sizes)
    if len(used) == 1:
        return np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used, code = used[np.argsort(sizes[used], kind="stable")], np.zeros(len(sizes), np.int64)
    takes = 1 << 15 - sizes[used]
    code[used] = _reversed(15)[np.cumsum(takes) - takes]
    return code, sizes


_PLAIN_LENGTHS = [(n, 0, 0) for n in range(16)]


@cache
def _zeros(n: int) -> list[tuple[int, int, int]]:
    """Symbols, extra bits and their number for n zeros; runs from three on are one symbol with their length."""
    items = []
    while n > 2:
        run = min(n, 138)
        items.append((18, run - 11, 7) if run > 10 else (17, run - 3, 3))
        n -= run
    return items + _PLAIN_LENGTHS[:1] * n


def _put_code(bits: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n] or [0]
    if len(used) == 1 and used[0] < 256:
        bits.put(1, 1)
        bits.put(0, 1)
        bits.put(1, 1)
        bits.put(used[0], 8)
        return
    items, at = [], 0
    for s in used:
        if s > at:
            items += _zeros(s - at)
        items.append(_PLAIN_LENGTHS[lengths[s]])
        at = s + 1
    items += _zeros(len(lengths) - at)
    counts = [0] * 19
    for s, _, _ in items:
        counts[s] += 1
    if sum(1 for n in counts if n) == 1:
        counts[0] += 1
    own = _code_lengths(counts, 7)
    codes = _codes(own)
    bits.put(0, 1)
    bits.put(15, 4)
    for s in _LENGTH_ORDER:
        bits.put(own[s], 3)
    bits.put(0, 1)
    value = held = 0
    for s, extra, n in items:
        code, size = codes[s]
        value |= (code | extra << size) << held
        held += size + n
    bits.put(value, held)


def _symbol_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & ((1 << extra) - 1), extra


def _put_image(bits: BitWriter, argb: list[int], width: int, main: bool, cache_bits: int = 0, matches: bool = False) -> None:
    items, cache, seen, at = [], [None] * (1 << cache_bits), {}, 0
    put_cache = lambda v: cache.__setitem__((_HASH * v & 0xFFFFFFFF) >> (32 - cache_bits), v) if cache_bits else None
    while at < len(argb):
        n = 0
        if matches:
            key = tuple(argb[at : at + 3])
            start = seen.get(key)
            seen[key] = at
            if start is not None and len(key) == 3:
                while at + n < len(argb) and argb[start + n] == argb[at + n] and n < 4096:
                    n += 1
        if n >= 3:
            d = at - start
            near = next((i for i, (x, y) in enumerate(_NEAR) if max(1, x + y * width) == d), None)
            items.append(("copy", _symbol_of(n), _symbol_of(d + 120 if near is None else near + 1)))
            for v in argb[at : at + n]:
                put_cache(v)
            at += n
            continue
        v = argb[at]
        slot = (_HASH * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        items.append(("cache", slot) if cache_bits and cache[slot] == v else ("pixel", v))
        put_cache(v)
        at += 1
    counts = [[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for kind, *x in items:
        if kind == "pixel":
            for i, move in enumerate((8, 16, 0, 24)):
                counts[i][x[0] >> move & 255] += 1
        elif kind == "cache":
            counts[0][280 + x[0]] += 1
        else:
            counts[0][256 + x[0][0]] += 1
            counts[4][x[1][0]] += 1
    bits.put(int(cache_bits > 0), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)
    lengths = [_code_lengths(c, 15) for c in counts]
    if len([n for n in lengths[0] if n]) == 1 and max(s for s, n in enumerate(lengths[0]) if n) > 255:
        lengths[0][0] = 1
    codes = [_codes(x) for x in lengths]
    for x in lengths:
        _put_code(bits, x)
    for kind, *x in items:
        if kind == "pixel":
            for i, move in enumerate((8, 16, 0, 24)):
                bits.put(*codes[i][x[0] >> move & 255])
        elif kind == "cache":
            bits.put(*codes[0][280 + x[0]])
        else:
            (s, e, n), (t, f, m) = x
            bits.put(*codes[0][256 + s])
            bits.put(e, n)
            bits.put(*codes[4][t])
            bits.put(f, m)


def _file(image: bytes) -> bytes:
    pad = b"\0" * (len(image) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(image) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(image)) + image + pad


def _start(width: int, height: int) -> BitWriter:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"an image of {width} x {height} is beyond the format")
    bits = BitWriter()
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(0, 1)
    bits.put(0, 3)
    return bits


def _argb(pixels: np.ndarray) -> list[int]:
    p = pixels.reshape(-1, 4).astype(np.uint32)
    return (p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]).tolist()


def _matches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of copies, taken from the left, of the last place with the same LEAST_MATCH values."""
    n = len(values) - LEAST_MATCH + 1
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    padded = np.concatenate([values.astype(np.uint8), np.zeros(8, np.uint8)])
    key = np.ndarray(n, "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * LEAST_MATCH) - 1)
    # Sorted as one number with the place in its low bits; a long text's keys are cut, so they are compared again.
    low = np.uint64(n.bit_length())
    ordered = np.sort((key * np.uint64(_SPREAD) >> low << low) | np.arange(n, dtype=np.uint64))
    order = (ordered & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
    same = ordered[1:] >> low == ordered[:-1] >> low
    at, source = order[1:][same], order[:-1][same]
    back = np.zeros(n, np.int64)
    back[at] = np.where(key[at] == key[source], at - source, 0)
    # A run of places with one distance is one copy, LEAST_MATCH - 1 longer than the run.
    starts = np.concatenate([[0], np.flatnonzero(back[1:] != back[:-1]) + 1])
    ends = np.append(starts[1:], n)
    copied = back[starts] > 0
    starts, ends = starts[copied], ends[copied]
    longest = MOST_MATCH - LEAST_MATCH + 1
    if (ends - starts > longest).any():
        pieces = -(-(ends - starts) // longest)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + within * longest
        ends = np.minimum(np.repeat(ends, pieces), starts + longest)
    ends += LEAST_MATCH - 1
    begun, ended, free, least = [], [], 0, LEAST_MATCH
    for start, end in zip(starts.tolist(), ends.tolist()):
        if start < free:
            start = free
        if end - start >= least:
            begun.append(start)
            ended.append(end)
            free = end
    begun = np.array(begun, np.int64)
    return begun, np.array(ended, np.int64) - begun, back[begun]


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_symbol_of`` for arrays."""
    if not len(values) or values.max() < 1 << 14:
        return tuple(column.take(values) for column in _prefixes())
    return _computed_prefixes(values)


@cache
def _prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of ``_symbol_of`` by value; the first row stands for none."""
    return _computed_prefixes(np.maximum(np.arange(1 << 14), 1))


def _computed_prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = values - 1
    extra = np.where(v < 4, 0, np.frexp(np.maximum(v, 1))[1] - 2)
    return np.where(v < 4, v, 2 * extra + 2 + (v >> extra & 1)), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def _put_single(bits: BitWriter, symbol: int) -> None:
    """The code of one 8-bit symbol that takes no bits."""
    bits.put(0b101 | symbol << 3, 11)


@cache
def _step_codes() -> list[tuple[int, int]]:
    codes = _codes(PALETTE_LENGTHS)
    return [codes[s] for s in range(256)]


@cache
def _far_codes() -> tuple[np.ndarray, np.ndarray]:
    return _code_columns(FAR_LENGTHS)


def _put_greens(bits: BitWriter, steps: list[int]) -> None:
    """The image of a palette, by its steps: only green changes, and alpha steps to 255 at once."""
    bits.put(0, 1)
    if len(steps) == 1:
        for symbol in (steps[0], 0, 0, 255, 0):
            _put_single(bits, symbol)
        return
    bits.put(*_fixed_codes(True)[:2])
    codes, value, held = _step_codes(), 0, 0
    for i, v in enumerate(steps):
        code, n = codes[v]
        value |= (code | (not i) << n) << held
        held += n + 1
    bits.put(value, held)


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """8-bit samples, a multiple of ``width`` of them, as the green values of a palette image: matches, colour cache and fitted codes."""
    height = len(samples) // width
    bits = _start(width, height)
    present = np.bincount(samples, minlength=256) > 0
    table, index = np.flatnonzero(present).astype(np.uint8), (np.cumsum(present) - 1).astype(np.uint8)[samples]
    bits.put(1, 1)
    bits.put(PALETTE, 2)
    bits.put(len(table) - 1, 8)
    _put_greens(bits, np.diff(table, prepend=np.zeros(1, np.uint8)).tolist())
    shift = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    if shift:
        wide = np.zeros((height, -(-width >> shift) << shift), np.uint8)
        wide[:, :width] = index.reshape(height, width)
        index = sum(wide[:, i :: 1 << shift] << np.uint8(i * (8 >> shift)) for i in range(1 << shift)).reshape(-1)
    values = index.astype(np.int64)
    # Frequent colours that have their place in the cache alone are read from it after their first pixel; a second symbol for rare ones would lengthen the code.
    slot = _green_slots(0xFF000000, CACHE_BITS)
    first = np.full(256, len(values))
    first[values[::-1]] = np.arange(len(values) - 1, -1, -1)
    met = np.flatnonzero(first < len(values))
    alone = (np.bincount(slot[met], minlength=1 << CACHE_BITS)[slot] == 1) & (np.bincount(values, minlength=256) * OFTEN >= len(values))
    cached = alone[values]
    cached[first[met]] = False
    at, length, distance = _matches(values)
    depth = np.zeros(len(values) + 1, np.int8)
    depth[at] = 1
    depth[at + length] -= 1
    own = np.cumsum(depth[:-1], dtype=np.int8) == 0
    own[at] = True
    # A symbol starts at each place that no copy covers, and at the copies' first ones.
    place = np.flatnonzero(own)
    copies = np.searchsorted(place, at)
    symbol, extra, size = _prefixed(length)
    far, far_extra, far_size = _prefixed(distance + 120)
    green = np.where(cached[place], 280 + slot[values[place]], values[place])
    green[copies] = 256 + symbol
    lengths = _code_lengths(np.bincount(green, minlength=280 + (1 << CACHE_BITS)).tolist(), MOST_BITS)
    bits.put(0, 1)
    bits.put(1, 1)
    bits.put(CACHE_BITS, 4)
    bits.put(0, 1)
    _put_code(bits, lengths)
    bits.put(*_fixed_codes(False)[:2])
    code_of, size_by = _code_columns(lengths)
    # Of a symbol: its code, the length's extra bits, the distance's code and its extra bits, 50 bits at most.
    value, held = code_of.take(green), size_by.take(green)
    code, size_of = _far_codes()[0].take(far), _far_codes()[1].take(far)
    value[copies] |= (extra | (code | far_extra << size_of) << size) << held[copies]
    held[copies] += size + size_of + far_size
    ends = bits.n + np.cumsum(held)
    start = ends - held
    # In words of 32 bits; no two symbols share a bit, so sums join them.
    word, move, half = start >> 5, start & 31, (1 << 32) - 1
    low, high = (value & half) << move, (value >> 32) << move
    words = np.zeros((int(ends[-1]) >> 5) + 3)
    for k, part in enumerate((low & half, (low >> 32) + (high & half), high >> 32)):
        words += np.bincount(word + k, part, len(words))
    body = words.astype(np.int64).astype("<u4").tobytes()[: int(ends[-1]) + 7 >> 3]
    head = bits.take()
    last = len(head) - 1
    return _file(head[:last] + bytes([head[last] | body[last]]) + body[last + 1 :])


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, matches: bool = False, mode: int = 11, factors: tuple[int, int, int] = (3, 250, 17)) -> bytes:
    """A (height, width, 4) array with the given transforms, in order, under fitted prefix codes.

    One predictor mode and one triple of cross-colour factors hold for the whole image; the palette needs 256 colours at most.
    """
    height, width = pixels.shape[:2]
    bits, p, w = _start(width, height), pixels.copy(), width
    for kind in transforms:
        bits.put(1, 1)
        bits.put(kind, 2)
        if kind == SUBTRACT_GREEN:
            p = np.stack([p[..., 0] - p[..., 1], p[..., 1], p[..., 2] - p[..., 1], p[..., 3]], -1)
        elif kind == PALETTE:
            table, index = np.unique(p.reshape(-1, 4), axis=0, return_inverse=True)
            index = index.reshape(height, w)
            bits.put(len(table) - 1, 8)
            _put_image(bits, _argb(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
            shift = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            w = -(-w >> shift)
            wide = np.zeros((height, w << shift), np.uint8)
            wide[:, : index.shape[1]] = index
            green = sum(wide[:, i :: 1 << shift] << np.uint8(i * (8 >> shift)) for i in range(1 << shift))
            p = np.stack([np.zeros_like(green), green, np.zeros_like(green), np.full_like(green, 255)], -1).astype(np.uint8)
        else:
            shift = 4
            bits.put(shift - 2, 3)
            across, down = -(-w >> shift), -(-height >> shift)
            r, g, b = factors if kind == CROSS_COLOUR else (0, mode, 0)
            _put_image(bits, [0xFF000000 | r << 16 | g << 8 | b] * (across * down), across, False)
            if kind == CROSS_COLOUR:
                p = _cross(p, np.broadcast_to(np.array([r, g, b, 255], np.uint8), p.shape), -1)
            else:
                own = p.reshape(-1, 4).tolist()
                p = np.array([[(a - e) & 255 for a, e in zip(v, _prediction(own, i % w, i // w, w, mode))] for i, v in enumerate(own)], np.uint8).reshape(p.shape)
    bits.put(0, 1)
    _put_image(bits, _argb(p), w, True, cache_bits, matches)
    return _file(bits.take())
