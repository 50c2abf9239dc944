"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder that can use each of its parts.

Pixels are arrays of 32-bit ARGB values. The decoder reads prefix codes, back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Streams whose
codes have one length per channel and no references, as ``encode`` writes for stored payloads, are
decoded in numpy at once.
"""

from __future__ import annotations

import struct

import numpy as np

_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distances: column and row offsets, packed as in the format's description.
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 1 << 14


def _ceil_div(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        p = self.pos
        if p + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        self.pos = p + n
        return int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)


class _Code:
    """A canonical prefix code; a code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if not used:
            used = [(0, 0)]
        self.only = used[0][1] if len(used) == 1 else None
        self.symbols = [s for _, s in used]
        self.width = used[0][0] if len({n for n, _ in used}) == 1 and len(used) == 1 << used[0][0] else None
        if self.only is not None:
            self.width = 0
            return
        if sum(2.0**-n for n, _ in used) != 1:
            raise ValueError("not a complete prefix code")
        self.used, self.table = used, None

    def compiled(self) -> dict[tuple[int, int], int]:
        table: dict[tuple[int, int], int] = {}
        code = last = 0
        for n, s in self.used:
            code <<= n - last
            last = n
            table[n, code] = s
            code += 1
        return table

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = self.compiled()
        code = n = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            s = self.table.get((n, code))
            if s is not None:
                return s
            if n > 15:
                raise ValueError("no such code")


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(1 + 7 * bits.read(1))]
        if two:
            symbols.append(bits.read(8))
        lengths = [0] * max(size, 256)
        for s in symbols:
            lengths[s] = 1
        return _Code(lengths)
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[_ORDER[i]] = bits.read(3)
    code = _Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if code.width is not None and left >= size and max(code.symbols) < 16:  # lengths one by one, each of as many bits
        width, begin = code.width, bits.pos
        if not width:
            return _Code([code.symbols[0]] * size)
        bits.pos += width * size
        raw = np.unpackbits(np.frombuffer(bits.data[begin >> 3 : bits.pos + 7 >> 3], np.uint8), bitorder="little")[begin & 7 :][: width * size]
        return _Code(np.array(code.symbols)[raw.reshape(size, width) @ (1 << np.arange(width - 1, -1, -1))].tolist())
    lengths: list[int] = []
    previous = 8
    while len(lengths) < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
            previous = s or previous
        elif s == 16:
            lengths += [previous] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return _Code(lengths + [0] * (size - len(lengths)))


def _value(prefix: int, bits: _Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _fixed_width(bits: _Bits, codes: list[_Code], n: int) -> np.ndarray | None:
    """Pixels of a stream whose literals all take the same bits; None if it isn't one."""
    if any(c.width is None for c in codes[:4]):
        return None
    widths = [c.width for c in codes[:4]]
    per = sum(widths)
    if bits.pos + per * n > 8 * len(bits.data):  # references make a stream shorter
        return None
    out = np.zeros((n, 4), np.uint8)
    weights = np.zeros((per, 4), np.float32)
    at = 0
    for k, width in enumerate(widths):
        weights[at : at + width, k] = 2.0 ** np.arange(width - 1, -1, -1)
        at += width
    tables = [np.array(c.symbols[: 1 << w], np.uint16) for c, w in zip(codes, widths)]
    step = 1 << 18
    for i in range(0, n, step):
        m = min(step, n - i)
        begin = bits.pos + per * i
        raw = np.unpackbits(np.frombuffer(bits.data, np.uint8, (begin + per * m + 7 >> 3) - (begin >> 3), begin >> 3), bitorder="little")[begin & 7 : (begin & 7) + per * m]
        read = (raw.reshape(m, per).astype(np.float32) @ weights).astype(np.uint16)
        for k, to in enumerate((1, 2, 0, 3)):  # green, red, blue, alpha, into the bytes of a little-endian ARGB value
            symbols = tables[k][read[:, k]]
            if not k and int(tables[0].max()) > 255 and (symbols > 255).any():
                return None
            out[i : i + m, to] = symbols
    out = out.view("<u4").ravel().astype(np.uint32, copy=False)
    bits.pos += per * n
    return out


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, meta, meta_bits = 1, None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (_pixels(bits, _ceil_div(width, meta_bits), _ceil_div(height, meta_bits), False) >> 8 & 0xFFFF).reshape(_ceil_div(height, meta_bits), -1)
        groups = int(meta.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, size) for size in (280 + cached, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if meta is None and not cached and (out := _fixed_width(bits, codes[0], n)) is not None:
        return out
    out = np.zeros(n, np.uint32).tolist()
    cache = [0] * cached
    shift = 32 - cache_bits
    i = seen = 0

    while i < n:
        g = codes[0] if meta is None else codes[meta[i // width >> meta_bits, i % width >> meta_bits]]
        s = g[0].read(bits)
        if s < 256:
            red, blue, alpha = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            length = _value(s - 256, bits)
            d = _value(g[4].read(bits), bits)
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[i] = out[i - d]
                i += 1
        else:
            if s - 280 >= cached:
                raise ValueError("no such cached colour")
            while seen < i:
                cache[(_CACHE_FACTOR * out[seen] & 0xFFFFFFFF) >> shift] = out[seen]
                seen += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _packed(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, top_right, top_left) -> np.ndarray:
    def half(a, b):
        return (a + b) >> 1

    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode == 11:
        toward = top + left - top_left
        return left if np.abs(toward - left).sum() < np.abs(toward - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = half(left, top)
        d = a - top_left
        return np.clip(a + np.where(d < 0, -(-d // 2), d // 2), 0, 255)
    return (None, left, top, top_right, top_left, half(half(left, top_right), top), half(left, top_left), half(left, top), half(top_left, top), half(top, top_right), half(half(left, top_left), half(top, top_right)))[mode]


def _predictor(c: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Adds predictions to residuals, or subtracts them from pixels: ``c`` is (height, width, 4)."""
    height, width = c.shape[:2]
    known = np.zeros_like(c) if inverse else c
    out = known if inverse else np.zeros_like(c)
    sign = 1 if inverse else -1
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = known[y, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                p = known[y - 1, x]
            else:
                beyond = known[y - 1, x + 1] if x + 1 < width else known[y, 0]
                p = _predict(int(modes[y >> bits, x >> bits]), known[y, x - 1], known[y - 1, x], beyond, known[y - 1, x - 1])
            out[y, x] = (c[y, x] + sign * p) & 255
    return out


def _cross(c: np.ndarray, elements: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    height, width = c.shape[:2]
    e = elements[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits]
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda t, v: signed(t) * signed(v) >> 5
    out, green, sign = c.copy(), c[..., 2], 1 if inverse else -1
    red = (c[..., 1] + sign * delta(e[..., 3], green)) & 255
    true_red = red if inverse else c[..., 1]
    out[..., 1] = red
    out[..., 3] = (c[..., 3] + sign * (delta(e[..., 2], green) + delta(e[..., 1], true_red))) & 255
    return out


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The ``(height, width)`` ARGB pixels of a lossless WebP file; ValueError if it isn't a whole one."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 8 + struct.unpack("<I", data[4:8])[0]:
        raise ValueError("not a whole lossless WebP file")
    bits = _Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (t[0] for t in transforms):
            raise ValueError("a transform comes twice")
        if kind == 3:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_pixels(bits, size, 1, False)), axis=0) & 255
            transforms.append((3, table, _palette_bits(size), inner))
            inner = _ceil_div(inner, _palette_bits(size))
        elif kind == 2:
            transforms.append((2, None, 0, inner))
        else:
            n = bits.read(3) + 2
            image = _pixels(bits, _ceil_div(inner, n), _ceil_div(height, n), False)
            transforms.append((kind, _channels(image.reshape(_ceil_div(height, n), -1)), n, inner))
    pixels = _pixels(bits, inner, height, True).reshape(height, inner)
    if not transforms:
        return pixels
    c = _channels(pixels)
    for kind, image, n, wide in reversed(transforms):
        if kind == 0:
            c = _predictor(c, image[..., 2], n, True)
        elif kind == 1:
            c = _cross(c, image, n, True)
        elif kind == 2:
            c[..., 1] = (c[..., 1] + c[..., 2]) & 255
            c[..., 3] = (c[..., 3] + c[..., 2]) & 255
        else:
            x, each = np.arange(wide), 8 >> n
            index = c[..., 2][:, x >> n] >> (x & ((1 << n) - 1)) * each & ((1 << each) - 1)
            c = np.concatenate([image, np.zeros((256, 4), np.int32)])[index]
    return _packed(c)


class _Out:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, code: int, n: int) -> None:
        """A prefix code goes out from its first bit."""
        for k in range(n - 1, -1, -1):
            self.put(code >> k & 1, 1)


def _put_lengths(out: _Out, lengths: list[int]) -> None:
    """Code lengths, written one by one in a code of equal lengths over those that occur."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        out.put(1, 2)  # simple, one symbol
        out.put(1, 1)
        out.put(used[0] if used else 0, 8)
        return
    values = sorted(set(lengths))
    n = max(1, (len(values) - 1).bit_length()) if len(values) > 1 else 0
    filled = values + [v for v in range(19) if v not in values][: (1 << n) - len(values)] if n else values
    out.put(0, 1)
    out.put(15, 4)
    for s in _ORDER:
        out.put((n or 1) if s in filled else 0, 3)
    out.put(0, 1)
    rank = {v: i for i, v in enumerate(sorted(filled))}
    ranks = np.array([rank[v] for v in lengths])
    raw = (ranks[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8)
    out.put(int.from_bytes(np.packbits(raw.ravel(), bitorder="little").tobytes(), "little"), n * len(lengths))


def _flat_lengths(symbols: np.ndarray, size: int) -> tuple[list[int], int, np.ndarray]:
    """Equal code lengths for the symbols that occur, filled up to a power of two; the bits, and codes by symbol."""
    here = np.flatnonzero(np.bincount(symbols, minlength=size))
    n = (len(here) - 1).bit_length() if len(here) else 0
    taken = np.zeros(size, bool)
    taken[here] = True
    if n:
        taken[np.flatnonzero(~taken)[: (1 << n) - len(here)]] = True
    return (taken * max(n, 1)).tolist(), n, np.cumsum(taken) - 1


def _prefix(value: int) -> tuple[int, int, int]:
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _put_image(out: _Out, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, meta_bits: int = 0) -> None:
    """Pixels by equal-length codes; for tests also by the colour cache, back-references and two groups of codes."""
    flat = argb.ravel()
    ops: list[tuple] = []
    if cache_bits or references:
        pixels, i = flat.tolist(), 0
        cache: dict[int, int] = {}
        slot = lambda v: (_CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)
        last: dict[int, int] = {}
        while i < len(pixels):
            j, n = last.get(pixels[i]), 0
            if references and j is not None:
                while i + n < len(pixels) and pixels[j + n] == pixels[i + n] and n < 4096:
                    n += 1
            if n >= 2:
                ops.append(("ref", i, n, i - j))
            elif cache_bits and cache.get(slot(pixels[i])) == pixels[i]:
                ops.append(("cache", i, slot(pixels[i])))
                n = 1
            else:
                ops.append(("pixel", i))
                n = 1
            for v in pixels[i : i + n]:
                if cache_bits:
                    cache[slot(v)] = v
                last[v] = i
                i += 1
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups = 1
    if main:
        out.put(bool(meta_bits), 1)
        if meta_bits:
            groups = 2
            out.put(meta_bits - 2, 3)
            w, h = _ceil_div(width, meta_bits), _ceil_div(len(flat) // width, meta_bits)
            meta = (np.arange(w)[None] + np.arange(h)[:, None]) % 2
            _put_image(out, (meta << 8).astype(np.uint32), w, False)
    green = [(flat >> np.uint32(8) & np.uint32(255)).astype(np.int64)]
    if ops:
        green.append(np.array([256 + _prefix(o[2])[0] for o in ops if o[0] == "ref"] + [280 + o[2] for o in ops if o[0] == "cache"], np.int64))
    far = np.array([_prefix(o[3] + 120)[0] for o in ops if o[0] == "ref"], np.int64)
    made = [_flat_lengths(np.concatenate(green), 280 + (1 << cache_bits if cache_bits else 0)), *(_flat_lengths((flat >> np.uint32(s) & np.uint32(255)).astype(np.int64), 256) for s in (16, 0, 24)), _flat_lengths(far, 40)]
    for _ in range(groups):
        for lengths, _, _ in made:
            _put_lengths(out, lengths)
    if not ops:
        _put_flat(out, flat, made)
        return
    for o in ops:
        if o[0] == "ref":
            symbol, extra, n = _prefix(o[2])
            out.code(int(made[0][2][256 + symbol]), made[0][1])
            out.put(extra, n)
            symbol, extra, n = _prefix(o[3] + 120)
            out.code(int(made[4][2][symbol]), made[4][1])
            out.put(extra, n)
        elif o[0] == "cache":
            out.code(int(made[0][2][280 + o[2]]), made[0][1])
        else:
            for (_, n, codes), s in zip(made, (8, 16, 0, 24)):
                out.code(int(codes[int(flat[o[1]]) >> s & 255]), n)


def _put_flat(out: _Out, flat: np.ndarray, made: list) -> None:
    per = sum(m[1] for m in made[:4])
    parts, step = [], 1 << 18  # pixels of a step take whole bytes
    for i in range(0, len(flat), step):
        part = flat[i : i + step]
        raw, at = np.empty((len(part), per), np.uint8), 0
        samples = np.ascontiguousarray(part, "<u4").view(np.uint8).reshape(-1, 4)
        for (_, n, codes), k in zip(made, (1, 2, 0, 3)):
            if n:
                raw[:, at : at + n] = (codes[:256, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8)[samples[:, k]]
                at += n
        parts.append(np.packbits(raw.ravel(), bitorder="little").tobytes())
    out.put(int.from_bytes(b"".join(parts), "little"), per * len(flat))


def encode(argb: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, palette: bool = False, block_bits: int = 2, cache_bits: int = 0, references: bool = False, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of ``(height, width)`` ARGB pixels, with the parts of the format asked for.

    ``predictor`` holds modes and ``cross`` elements (ARGB) by block of ``2 ** block_bits`` pixels.
    """
    height, width = argb.shape
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("a side has 1 to 16384 pixels")
    out = _Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    inner = width
    if palette:
        colours, index = np.unique(argb, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has 256 colours at most")
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(colours) - 1, 8)
        c = _channels(colours)
        _put_image(out, _packed(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int32))), len(colours), False)
        n = _palette_bits(len(colours))
        each, inner = 8 >> n, _ceil_div(width, n)
        bundled = np.zeros((height, inner), np.uint32)
        index = index.reshape(height, width)
        for x in range(width):
            bundled[:, x >> n] |= (index[:, x] << (x & ((1 << n) - 1)) * each).astype(np.uint32)
        argb = np.uint32(0xFF000000) | bundled << np.uint32(8)
    if subtract_green or predictor is not None or cross is not None:
        c = _channels(argb)
        for kind, image in ((0, predictor), (1, cross)):
            if image is not None:
                out.put(1, 1)
                out.put(kind, 2)
                out.put(block_bits - 2, 3)
                image = np.asarray(image, np.uint32)
                if kind == 0:
                    c = _predictor(c, image, block_bits, False)
                    image = np.uint32(0xFF000000) | image << np.uint32(8)
                else:
                    c = _cross(c, _channels(image), block_bits, False)
                _put_image(out, image, image.shape[1], False)
        if subtract_green:
            out.put(1, 1)
            out.put(2, 2)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
        argb = _packed(c)
    out.put(0, 1)
    _put_image(out, argb, inner, True, cache_bits, references, meta_bits)
    body = out.value.to_bytes((out.n + 7) // 8, "little")
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
