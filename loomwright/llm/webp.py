"""Lossless WebP (VP8L in a RIFF container), read and written in numpy and a little Python.

Reading covers the format: prefix codes, several code groups, back-references, colour cache, and the inverses of the
predictor, cross-colour, subtract-green and palette transforms. Images are uint32 arrays, ARGB.

Bits run from the least significant of a byte; a prefix code's first bit is its most significant one. Images without
cache whose red, blue and alpha are constant take a faster way: the code at *every* bit
position is looked up at once, and a short loop then hops from code to code and copies what references name.
"""

from __future__ import annotations

import heapq
import struct
from bisect import bisect_left
from collections.abc import Sequence
from functools import cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14
MAX_LENGTH = 15
HASH = 0x1E35A7BD
#: Numbers of MAX_LENGTH bits with their bits in reverse order.
REVERSED = np.zeros(1 << MAX_LENGTH, dtype=np.int64)
for _k in range(MAX_LENGTH):
    REVERSED |= (np.arange(1 << MAX_LENGTH) >> _k & 1) << (MAX_LENGTH - 1 - _k)

#: Fixed values of the format: the order of the code lengths' own code lengths, and the offsets (x, y) of the 120 nearest pixels.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class DamagedImage(ValueError):
    pass


# --- prefix codes ---


class Code:
    """A canonical prefix code as tables over the next `bits` bits: symbol and length. A code of one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise DamagedImage("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            self.bits, self.symbols, self.lengths = 0, np.array([self.only], dtype=np.uint16), np.zeros(1, dtype=np.uint8)
        else:
            self.bits = int(lengths.max())
            order = used[np.argsort(lengths[used], kind="stable")]
            reach = 1 << (self.bits - lengths[order].astype(np.int64))  # of all values of the next bits, first bit most significant
            if int(reach.sum()) != 1 << self.bits:
                raise DamagedImage("a prefix code that is not complete")
            at = np.repeat(order, reach)[REVERSED[: 1 << self.bits] >> (MAX_LENGTH - self.bits)]
            self.symbols, self.lengths = at.astype(np.uint16), lengths[at].astype(np.uint8)
        self.pairs: list[tuple[int, int]] | None = None

    @classmethod
    def of(cls, symbol: int) -> Code:
        """The code of one symbol."""
        code = cls.__new__(cls)
        code.only, code.bits, code.pairs = symbol, 0, None
        code.symbols, code.lengths = np.array([symbol], dtype=np.uint16), np.zeros(1, dtype=np.uint8)
        return code

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.pairs is None:
            self.pairs = list(zip(self.symbols.tolist(), self.lengths.tolist()))
        symbol, n = self.pairs[bits.peek(self.bits)]
        bits.at += n
        return symbol


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, codes with their first bit least significant, and lengths, by length and symbol."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    n = lengths[order].astype(np.int64)
    reach = 1 << (MAX_LENGTH - n)
    return order, REVERSED[(np.cumsum(reach) - reach) & ((1 << MAX_LENGTH) - 1)], n


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 6], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise DamagedImage("the data end too early")
        return value


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        several, wide = bits.read(1), bits.read(1)
        if not several and (only := bits.peek(8 if wide else 1)) < size:
            bits.read(8 if wide else 1)
            return Code.of(only)
        lengths = np.zeros(size, dtype=np.uint8)
        for symbol in [bits.read(8 if wide else 1)] + [bits.read(8)] * several if several else [bits.read(8 if wide else 1)]:
            if symbol >= size:
                raise DamagedImage("a symbol beyond the alphabet")
            lengths[symbol] = 1
        return Code(lengths)
    own = np.zeros(19, dtype=np.uint8)
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last = Code(own), 0, 8
    if code.only is not None:
        pairs, mask = [(code.only, 0)], 0
    else:
        pairs, mask = list(zip(code.symbols.tolist(), code.lengths.tolist())), (1 << code.bits) - 1
    first = bits.at >> 3
    value = int.from_bytes(bits.data[first : first + 2 * size + 8], "little") >> (bits.at & 7)  # a token takes 14 bits at most
    found = [0] * size
    while at < size and left:
        left -= 1
        s, n = pairs[value & mask]
        value >>= n
        bits.at += n
        if s < 16:
            found[at] = s
            last = s or last
            at += 1
            continue
        least, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
        n = least + (value & ((1 << extra) - 1))
        value >>= extra
        bits.at += extra
        if at + n > size:
            raise DamagedImage("a run of code lengths beyond the alphabet")
        if s == 16:
            found[at : at + n] = [last] * n
        at += n
    if bits.at > bits.end:
        raise DamagedImage("the data end too early")
    return Code(np.array(found, dtype=np.uint8))


# --- reading ---


def _amount(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _amounts(n: int) -> list[tuple[int, int, int]]:
    """Of each prefix: the least amount, the extra bits and their mask."""
    out = []
    for prefix in range(n):
        extra = max(0, (prefix - 2) >> 1)
        out.append((prefix + 1 if prefix < 4 else ((2 + (prefix & 1)) << extra) + 1, extra, (1 << extra) - 1))
    return out


_LENGTHS, _DISTANCES = _amounts(24), _amounts(40)


def _one_channel(bits: Bits, codes: list[Code], width: int, n: int) -> np.ndarray | None:
    """n pixels whose red, blue and alpha are constant and which use no cache; None for others.

    The green code at every bit position is looked up at once; the loop then hops from code to code.
    """
    green, red, blue, alpha, distance = codes
    if red.only is None or blue.only is None or alpha.only is None or len(green.symbols) and int(green.symbols.max()) >= 280:
        return None
    rest = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    if green.only is not None:
        if green.only >= 256:
            return None
        return np.full(n, rest | np.uint32(green.only << 8), dtype=np.uint32)
    first = bits.at >> 3
    data = np.frombuffer(bits.data, dtype=np.uint8)[first:]
    if not (green.symbols >= 256).any():
        data = data[: 3 + (n * green.bits + 14) // 8]
    data = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    wide = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    nexts = ((wide[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel()
    is_reference = green.symbols >= 256
    symbols = np.where(is_reference, green.symbols - 256, green.symbols).astype(np.uint8).take(nexts).tobytes()
    lengths = (green.lengths | (is_reference.astype(np.uint8) << 7)).take(nexts).tobytes()
    if distance.pairs is None:
        distance.pairs = list(zip(distance.symbols.tolist(), distance.lengths.tolist()))
    pairs, mask, raw = distance.pairs, (1 << distance.bits) - 1, bits.data
    out, p, base = bytearray(), bits.at & 7, 8 * first
    add = out.append
    try:
        while True:
            for _ in range(n - len(out)):
                step = lengths[p]
                if step > 127:
                    break
                add(symbols[p])
                p += step
            else:
                break
            least, extra, extra_mask = _LENGTHS[symbols[p]]
            at = base + p + (step & 127)
            v = int.from_bytes(raw[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
            length = least + (v & extra_mask)
            v >>= extra
            symbol, own = pairs[v & mask]
            v >>= own
            least, more, extra_mask = _DISTANCES[symbol]
            d = least + (v & extra_mask)
            p += (step & 127) + extra + own + more
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            i = len(out)
            if d > i or i + length > n:
                raise DamagedImage("a back-reference beyond the image")
            if d >= length:
                out += out[i - d : i - d + length]
            else:
                out += (bytes(out[i - d :]) * (length // d + 1))[:length]
    except IndexError:
        raise DamagedImage("the data end too early") from None
    bits.at = base + p
    if bits.at > bits.end:
        raise DamagedImage("the data end too early")
    return np.frombuffer(bytes(out), dtype=np.uint8).astype(np.uint32) << np.uint32(8) | rest


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image. Only the main one may have several code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise DamagedImage("a colour cache that is too large")
    group_of, tile = None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        group_of = (_pixels(bits, across, -(-height >> tile), False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, s) for s in sizes] for _ in range(1 + max(group_of or [0]))]
    n = width * height
    if len(groups) == 1 and (fast := _one_channel(bits, groups[0], width, n)) is not None:
        return fast
    out, i = [0] * n, 0
    cache, cached = [0] * (1 << cache_bits), 0  # pixels before `cached` are in the cache
    shift = 32 - cache_bits
    while i < n:
        green, red, blue, alpha, distance = groups[group_of[(i // width >> tile) * across + (i % width >> tile)]] if group_of else groups[0]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 280:
            length = _amount(bits, s - 256)
            d = _amount(bits, distance.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + length > n:
                raise DamagedImage("a back-reference beyond the image")
            for i in range(i, i + length):
                out[i] = out[i - d]
            i += 1
        else:
            while cached < i:
                cache[(HASH * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[i] = cache[s - 280]
            i += 1
        if bits.at > bits.end:
            raise DamagedImage("the data end too early")
    return np.array(out, dtype=np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """uint32 ARGB to (..., 4) in the order blue, green, red, alpha."""
    return np.ascontiguousarray(argb, dtype="<u4").view(np.uint8).reshape(*argb.shape, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, dtype=np.uint8).view("<u4")[..., 0].astype(np.uint32)


def _tiled(tiles: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return tiles.repeat(1 << bits, axis=0)[:height].repeat(1 << bits, axis=1)[:, :width]


def _predict(mode: int, left, top, top_right, top_left):
    """A prediction from four neighbours, of int arrays with channels last."""
    mean = lambda a, b: (a + b) >> 1
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode <= 9:
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    a = mean(left, top)
    # The half difference is divided towards zero.
    return np.clip(a + np.sign(a - top_left) * (np.abs(a - top_left) // 2), 0, 255)


def predictions(image: np.ndarray, y: int, x: int, mode: int) -> np.ndarray:
    """What the pixel at y, x is predicted as, from the pixels before it."""
    if y == 0:
        return image[0, x - 1] if x else np.array([0, 0, 0, 255])
    if x == 0:
        return image[y - 1, 0]
    width = image.shape[1]
    right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]  # past the edge: the first of this row
    return _predict(mode, image[y, x - 1], image[y - 1, x], right, image[y - 1, x - 1])


def _undo_predictor(residues: np.ndarray, modes: np.ndarray) -> np.ndarray:
    image = _channels(residues).astype(np.int32)
    height, width = residues.shape
    for y in range(height):
        if y and width > 1 and np.isin(modes[y, 1:], (0, 2, 3, 4, 8, 9)).all():  # nothing depends on the row itself but its first pixel
            image[y, 0] = (image[y, 0] + image[y - 1, 0]) & 255
            above = np.concatenate([image[y - 1], image[y, :1]])
            for mode in np.unique(modes[y, 1:]):
                at = np.flatnonzero(modes[y, 1:] == mode) + 1
                image[y, at] = (image[y, at] + _predict(int(mode), None, above[at], above[at + 1], above[at - 1])) & 255
            continue
        if width > 1 and (y == 0 or (modes[y, 1:] == 1).all()):  # each pixel adds to the one on its left
            image[y, 0] = (image[y, 0] + predictions(image, y, 0, 1)) & 255
            image[y] = np.cumsum(image[y], axis=0) & 255
            continue
        for x in range(width):
            image[y, x] = (image[y, x] + predictions(image, y, x, int(modes[y, x]))) & 255
    return _joined(image)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32) >> 5


def cross_colour(image: np.ndarray, multipliers: np.ndarray, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) what red and blue owe to green, and blue to red. multipliers: red, green and blue of its tiles hold red-to-blue, green-to-blue, green-to-red."""
    p, m = _channels(image), _channels(multipliers)
    blue, green, red = p[..., 0].astype(np.int32), p[..., 1], p[..., 2].astype(np.int32)
    new_red = red + sign * _delta(m[..., 0], green) & 255
    true_red = new_red if sign > 0 else red
    new_blue = blue + sign * (_delta(m[..., 1], green) + _delta(m[..., 2], true_red.astype(np.uint8))) & 255
    return _joined(np.stack([new_blue, green, new_red, p[..., 3]], axis=-1))


def subtract_green(image: np.ndarray, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) green from red and blue, which are 16 bits apart and so don't meet."""
    green = image >> np.uint32(8) & np.uint32(255)
    both = (image & np.uint32(0xFF00FF)) + (green if sign > 0 else np.uint32(256) - green) * np.uint32(0x10001)
    return image & np.uint32(0xFF00FF00) | both & np.uint32(0xFF00FF)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    packed = _bundle_bits(len(palette))
    index = image >> np.uint32(8) & np.uint32(255)
    if packed:
        depth = 8 >> packed
        index = (index[:, :, None] >> (np.arange(1 << packed, dtype=np.uint32) * np.uint32(depth)) & np.uint32((1 << depth) - 1)).reshape(image.shape[0], -1)[:, :width]
    return np.concatenate([palette, np.zeros(256, dtype=np.uint32)])[index]


def decode(data: bytes) -> np.ndarray:
    """The image of a RIFF file with a VP8L chunk, (height, width) uint32 ARGB."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise DamagedImage("not a WebP file")
    at = 12
    while data[at : at + 4] not in (b"VP8L", b""):
        at += 8 + struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1
    if data[at : at + 4] != b"VP8L":
        raise DamagedImage("no lossless image in the file")
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise DamagedImage("wrong signature")
    full, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise DamagedImage("unknown version")
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [u[0] for u in undo]:
            raise DamagedImage("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            tiles = _pixels(bits, -(-width >> tile), -(-height >> tile), False).reshape(-(-height >> tile), -1)
            undo.append((kind, _tiled(tiles, tile, height, width), width))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, width))
        else:
            colours = bits.read(8) + 1
            steps = _channels(_pixels(bits, colours, 1, False))
            undo.append((kind, _joined(np.cumsum(steps, axis=0, dtype=np.uint8)), width))
            width = -(-width >> _bundle_bits(colours))
    image = _pixels(bits, width, height, True).reshape(height, width)
    for kind, what, wide in reversed(undo):
        if kind == PREDICTOR:
            image = _undo_predictor(image, what >> np.uint32(8) & np.uint32(15))
        elif kind == CROSS_COLOUR:
            image = cross_colour(image, what, 1)
        elif kind == SUBTRACT_GREEN:
            image = subtract_green(image, 1)
        else:
            image = _undo_palette(image, what, wide)
    return image


# --- writing ---


class Out:
    """Bits to be written: values and their widths."""

    def __init__(self):
        self.value, self.n, self.parts = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 256:
            whole = self.n >> 3
            self.parts += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Values of up to 15 bits, at once."""
        shift = self.n & 7
        whole = self.n >> 3
        self.parts += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
        held = self.value >> 8 * whole
        ends = np.cumsum(widths, dtype=np.int64) + shift
        total = int(ends[-1]) if len(ends) else shift
        bits = np.zeros(-(-total // 8) * 8, dtype=np.uint8)
        widths = widths.astype(np.int64)
        place = np.arange(total - shift) - np.repeat(ends - widths - shift, widths)
        bits[shift:total] = np.repeat(values.astype(np.uint32), widths) >> place.astype(np.uint32) & np.uint32(1)
        packed = np.packbits(bits, bitorder="little").tobytes()
        self.value = int.from_bytes(packed, "little") | held if len(packed) <= 32 else None
        if self.value is None:
            packed = bytes([packed[0] | held]) + packed[1:]
            self.parts += packed[: total >> 3]
            self.value = packed[total >> 3] if total & 7 else 0
            self.n = total & 7
        else:
            self.n = total

    def bytes(self) -> bytes:
        return bytes(self.parts) + self.value.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code; where one would be longer than most, small counts are raised until none is."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight, least = counts[used].tolist(), 1
    while True:
        heap = [(max(w, least), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, new = {}, len(weight)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = new
            heapq.heappush(heap, (a[0] + b[0], new))
            new += 1
        depth = {new - 1: 0}
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        found = [depth[i] for i in range(len(weight))]
        if max(found) <= most:
            lengths[used] = found
            return lengths
        least *= 2


def _write_only(out: Out, symbol: int) -> None:
    """A code of one symbol: it is a simple one, has one symbol, of eight bits."""
    out.put(0b101 | symbol << 3, 11)


def write_code(out: Out, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and all(s < 256 for s in used):
        _write_only(out, used[0] if used else 0)
        return
    if len(used) == 2 and used[1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    out.put(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    values = lengths[: used[-1] + 1]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    for value, run in zip(values[starts].tolist(), np.diff(np.append(starts, len(values))).tolist()):
        while run:
            n = min(run, 138) if value == 0 and run >= 3 else 1
            tokens.append((value, 0, 0) if n == 1 else (17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            run -= n
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if np.count_nonzero(own) == 1:  # two symbols at least, so that the code has bits
        own[0 if own[0] == 0 else 1] = 1
        own[own > 0] = 1
    most = max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    out.put(max(most, 4) - 4, 4)
    for k in range(max(most, 4)):
        out.put(int(own[LENGTH_ORDER[k]]), 3)
    # The number of tokens, so that the zeros behind the last symbol need none.
    out.put(1, 1)
    n = max(len(tokens), 2) - 2
    half = max(0, (max(1, n.bit_length()) - 1) // 2)
    half = half if n < 1 << (2 + 2 * half) else half + 1
    out.put(half, 3)
    out.put(n, 2 + 2 * half)
    code, width = _tables(own)
    fields = np.array(tokens)
    fields = np.stack([code[fields[:, 0]], width[fields[:, 0]], fields[:, 1], fields[:, 2]], axis=1).reshape(-1, 2)
    out.many(fields[:, 0], fields[:, 1])
    if len(tokens) == 1:
        out.put(int(code[0]), int(width[0]))


def _split_amount(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << top - 1) - 1), top - 1


SHORTEST = 8  # bytes of a back-reference that repeated bytes are looked up by


def repeats(values: np.ndarray, longest: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where back-references may stand in a row of bytes: their starts, lengths and distances, none overlapping another.

    Each place is compared with the last one before that has the same SHORTEST bytes; while places in a row have one
    distance, the repeat goes on.
    """
    n = len(values) - SHORTEST + 1
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return none, none, none
    wide = values.astype(np.uint64)
    keys = wide[:n].copy()
    for k in range(1, SHORTEST):
        keys |= wide[k : n + k] << np.uint64(8 * k)
    order = np.argsort((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    sorted_ = keys[order]
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    back = np.zeros(n, dtype=np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    at = np.flatnonzero(back)
    if not len(at):
        return none, none, none
    ends = np.flatnonzero(np.append(back[1:] != back[:-1], True))  # the last place of each run of one distance
    length = ends[np.searchsorted(ends, at)] - at + SHORTEST
    starts, lengths, chosen, i, k, last = at.tolist(), length.tolist(), [], 0, 0, len(at)
    while k < last:
        i = starts[k] + lengths[k]
        chosen.append(k)
        k = bisect_left(starts, i, k + 1)
    return at[chosen], np.minimum(length[chosen], longest), back[at[chosen]]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places stand in a repeat."""
    change = np.zeros(n + 1, dtype=np.int8)
    change[starts] += 1
    change[starts + lengths] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


@cache
def _near_codes(width: int) -> np.ndarray:
    """By distance, the code of the near pixel at it, 0 where there is none."""
    near = np.zeros(9 + 8 * width, dtype=np.int64)
    for k in range(len(NEAR), 0, -1):
        x, y = NEAR[k - 1]
        near[max(1, x + y * width)] = k
    return near


def _prefixes(amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number, of lengths or distances."""
    v = amounts - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, top - 1)
    prefix = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return prefix, v & ((1 << extra) - 1), extra


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and widths by symbol; a code of one symbol takes no bits."""
    codes, widths = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    if np.count_nonzero(lengths) > 1:
        at, code, n = canonical(lengths)
        codes[at], widths[at] = code, n
    return codes, widths


def _write_one_channel(out: Out, values: np.ndarray, rest: Sequence[int], width: int, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
    """Pixels of which only green changes, with back-references. rest: red, blue, alpha. found: what repeats(values) gives, where it is known."""
    starts, lengths, distances = repeats(values) if found is None else found
    near = _near_codes(width)
    codes = distances + 120
    close = distances < len(near)
    close[close] = near[distances[close]] > 0
    codes[close] = near[distances[close]]
    l_prefix, l_extra, l_bits = _prefixes(lengths)
    d_prefix, d_extra, d_bits = _prefixes(codes)
    is_entry = ~covered(len(values), starts, lengths)
    is_entry[starts] = True
    symbols = values.astype(np.int64)
    symbols[starts] = 256 + l_prefix
    entry_of = np.cumsum(is_entry) - 1
    symbols = symbols[is_entry]
    green = code_lengths(np.bincount(symbols, minlength=280))
    distance = code_lengths(np.bincount(d_prefix, minlength=40)) if len(starts) else np.zeros(40, dtype=np.uint8)
    write_code(out, green)
    for v in rest:
        _write_only(out, v)
    write_code(out, distance)
    fields, widths = np.zeros((len(symbols), 5), dtype=np.int64), np.zeros((len(symbols), 5), dtype=np.int64)
    code, n = _tables(green)
    fields[:, 0], widths[:, 0] = code[symbols], n[symbols]
    at = entry_of[starts]
    code, n = _tables(distance)
    for k, (value, bits) in enumerate(((l_extra, l_bits), (code[d_prefix], n[d_prefix]), (d_extra & 0x7FFF, np.minimum(d_bits, 15)), (d_extra >> 15, np.maximum(d_bits - 15, 0))), 1):
        fields[at, k], widths[at, k] = value, bits
    used = widths > 0
    if used.any():
        out.many(fields[used], widths[used])


def _write_pixels(out: Out, argb: np.ndarray, main: bool, cache_bits: int = 0, references: bool | tuple = False) -> None:
    """An entropy-coded image with one code group. references: with back-references, or those of the green channel that are known."""
    height, width = argb.shape
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    if not cache_bits and not references:
        p = _channels(argb.ravel())
        lengths = [code_lengths(np.bincount(p[:, c], minlength=280 if c == 1 else 256)) for c in (1, 2, 0, 3)]
        for n in lengths:
            write_code(out, n)
        write_code(out, np.zeros(40, dtype=np.uint8))
        values, widths = [], []
        for n, c in zip(lengths, (1, 2, 0, 3)):
            if np.count_nonzero(n) > 1:
                table = np.zeros(len(n), dtype=np.uint16)
                at, code, _ = canonical(n)
                table[at] = code
                values.append(table[p[:, c]])
                widths.append(n[p[:, c]])
        if values:
            out.many(np.stack(values, axis=1).ravel(), np.stack(widths, axis=1).ravel())
        return
    p = _channels(argb.ravel())
    if references and not cache_bits and (argb & np.uint32(0xFFFF00FF) == argb[0, 0] & np.uint32(0xFFFF00FF)).all():
        _write_one_channel(out, p[:, 1], (int(p[0, 2]), int(p[0, 0]), int(p[0, 3])), width, references if isinstance(references, tuple) else None)
        return
    pixels, i, symbols, last, held = argb.ravel().tolist(), 0, [], {}, {}
    while i < len(pixels):
        key = tuple(pixels[i : i + 3])
        back = last.get(key) if references and len(key) == 3 else None
        length = 0
        if back is not None:
            while i + length < len(pixels) and length < 4096 and pixels[i + length] == pixels[back + length]:
                length += 1
        step = max(1, length) if length >= 3 else 1
        slot = (HASH * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if step > 1:
            d = i - back
            near = next((k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d), d + 120)
            symbols.append(("ref", step, near))
        elif cache_bits and held.get(slot) == pixels[i]:
            symbols.append(("cache", slot, 0))
        else:
            symbols.append(("pixel", pixels[i], 0))
        for j in range(i, i + step):
            last[tuple(pixels[j : j + 3])] = j
            if cache_bits:
                held[(HASH * pixels[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[j]
        i += step
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    parts: list[list[tuple[int, int, int, int]]] = []  # for each symbol: code, value, extra bits, their number
    for kind, a, b in symbols:
        if kind == "pixel":
            parts.append([(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)])
        elif kind == "cache":
            parts.append([(0, 280 + a, 0, 0)])
        else:
            pa, ea, na = _split_amount(a)
            pb, eb, nb = _split_amount(b)
            parts.append([(0, 256 + pa, ea, na), (4, pb, eb, nb)])
    counts = [np.zeros(s, dtype=np.int64) for s in sizes]
    for part in parts:
        for c, v, _, _ in part:
            counts[c][v] += 1
    lengths = [code_lengths(c) for c in counts]
    for n in lengths:
        write_code(out, n)
    codes = [{s: (c, k) for s, c, k in zip(*(x.tolist() for x in canonical(n)))} if np.count_nonzero(n) > 1 else {} for n in lengths]
    for part in parts:
        for c, v, extra, k in part:
            if codes[c]:
                out.put(*codes[c][v])
            if k:
                out.put(extra, k)


def encode(argb: np.ndarray, *, transforms: Sequence[tuple] = (), cache_bits: int = 0, references: bool | tuple = False) -> bytes:
    """A WebP file of a (height, width) uint32 ARGB image.

    transforms, applied in this order: (PREDICTOR, tile bits, modes of the tiles), (CROSS_COLOUR, tile bits, multipliers of the tiles as
    ARGB), (SUBTRACT_GREEN,), (PALETTE,) for images of 256 colours at most.
    """
    height, full = argb.shape
    if not (0 < height <= MAX_SIDE and 0 < full <= MAX_SIDE):
        raise ValueError("a side is out of bounds")
    out, image = Out(), argb.astype(np.uint32)
    out.put(0x2F, 8)
    out.put(full - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *what in transforms:
        width = image.shape[1]
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PREDICTOR:
            tile, modes = what
            out.put(tile - 2, 3)
            _write_pixels(out, modes.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), False)
            p, m = _channels(image).astype(np.int32), _tiled(modes, tile, height, width)
            image = _joined(np.array([[(p[y, x] - predictions(p, y, x, int(m[y, x]))) & 255 for x in range(width)] for y in range(height)]))
        elif kind == CROSS_COLOUR:
            tile, multipliers = what
            out.put(tile - 2, 3)
            _write_pixels(out, multipliers, False)
            image = cross_colour(image, _tiled(multipliers, tile, height, width), -1)
        elif kind == SUBTRACT_GREEN:
            image = subtract_green(image, -1)
        else:
            palette, index = np.unique(image, return_inverse=True)
            index = index.reshape(image.shape).astype(np.uint32)
            out.put(len(palette) - 1, 8)
            steps = np.diff(_channels(palette), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))
            _write_pixels(out, _joined(steps)[None, :], False)
            packed = _bundle_bits(len(palette))
            if packed:
                depth = 8 >> packed
                pad = -width % (1 << packed)
                index = np.pad(index, ((0, 0), (0, pad))).reshape(height, -1, 1 << packed)
                index = (index << (np.arange(1 << packed, dtype=np.uint32) * np.uint32(depth))).sum(axis=2).astype(np.uint32)
            image = index << np.uint32(8) | np.uint32(0xFF000000)
    out.put(0, 1)
    _write_pixels(out, image, True, cache_bits, references)
    body = out.bytes()
    body += bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
