"""Many small lossless WebP images at once: coded and decoded side by side in numpy.

Images are 16 pixels wide and at most 64 high. A transform (predictor, cross-colour, subtract-green or none)
is dealt to each by a checksum of its pixels, as bytes of text have no colours that one could win by; palettes,
back-references and the colour cache are used where they make an image shorter. The decoder reads all images
in step, a symbol of each at a time; what it isn't made for goes to ``webp.decode``.
"""

from __future__ import annotations

import struct

import numpy as np

from . import webp

WIDTH, HEIGHT = 16, 64
#: Pixels of an image, at most.
PIXELS = WIDTH * HEIGHT
#: Images in step.
TOGETHER = 1536
#: Bits of a code, at most; no image has more pixels than such a code may tell apart.
_BITS = 10
_FULL = 1 << _BITS
CACHE_BITS = 6
#: Pixels of a reference, at least.
_SHORTEST = 3
BLOCK_BITS = 4
_REVERSED = np.array([int(f"{i:0{_BITS}b}"[::-1], 2) for i in range(_FULL)])
#: Predictors that are tried.
MODES = (1, 2, 3, 4, 7, 11, 12)
#: Sixteen code-length symbols of four bits each.
_LENGTHS = [*range(_BITS + 4), 17, 18]
_NEAR = np.array([max(1, x + y * WIDTH) for x, y in webp._NEAR])
_PREFIX = [webp._prefix(v) for v in range(1, PIXELS + 121)]
_SYMBOL, _EXTRA, _EXTRA_BITS = (np.array([0, *(p[k] for p in _PREFIX)]) for k in range(3))


# --- codes ---------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code for each row of symbol counts; a single symbol has length 1."""
    used = counts > 0
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    lengths = np.zeros(counts.shape, np.int64)
    lengths[used] = np.clip(np.ceil(np.log2((total / np.maximum(counts, 1))[used]) - 1e-9), 1, _BITS).astype(np.int64)
    many = used.sum(1)
    left = np.where(many > 1, _FULL - np.where(used, 1 << (_BITS - lengths), 0).sum(1), 0)
    size = counts.shape[1]
    order = np.sort((_FULL * 2 - counts.astype(np.int32)) * 512 + np.arange(size, dtype=np.int32), axis=1)[:, : max(1, int(many.max(initial=1)))] & 511  # no row counts more than an image has pixels
    rows = np.flatnonzero(left > 0)
    while len(rows):  # frequent symbols get shorter codes until no value is left over
        mine, rest = order[rows], left[rows]
        own = np.take_along_axis(lengths[rows], mine, 1)
        for k in range(int(many[rows].max())):
            l = own[:, k]
            gain = np.where(l > 1, 1 << (_BITS - l), 2 * _FULL)
            can = gain <= rest
            own[:, k] -= can
            rest -= gain * can
        back = lengths[rows]
        np.put_along_axis(back, mine, own, 1)
        lengths[rows], left[rows] = back, rest
        rows = rows[rest > 0]
    return lengths


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, symbols by length and value (unused ones last), and the widths of their stretches of all values."""
    size = lengths.shape[1]
    bits = max(1, (size - 1).bit_length())
    keys = np.sort((np.where(lengths > 0, lengths, 99).astype(np.int32) << bits) | np.arange(size, dtype=np.int32), axis=1)
    sorted_ = keys >> bits
    return keys & ((1 << bits) - 1), np.where(sorted_ < 99, 1 << (_BITS - np.minimum(sorted_, _BITS)), 0)


def codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, first bit lowest, and the bits that each takes; a code's only symbol takes none."""
    order, width = _in_order(lengths)
    start = np.cumsum(width, axis=1) - width
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, _REVERSED[np.minimum(start, _FULL - 1)], 1)
    bits = np.where((lengths > 0).sum(1, keepdims=True) > 1, lengths, 0)
    return np.where(bits > 0, out, 0).astype(np.int32), bits.astype(np.int32)


def tables(lengths: np.ndarray) -> np.ndarray:
    """Of each row, symbol and bits of every value of the next bits, as ``symbol << 4 | bits``."""
    n = len(lengths)
    many = (lengths > 0).sum(1)
    order, width = _in_order(lengths)
    bits = np.take_along_axis(lengths, order, 1)
    width[many <= 1] = 0
    width[many <= 1, 0] = _FULL
    bits[many <= 1] = 0
    if (width.sum(1) != _FULL).any():
        raise ValueError("not a complete prefix code")
    used = width.ravel() > 0
    flat = np.repeat(((order << 4) | bits).astype(np.uint16).ravel()[used], width.ravel()[used]).reshape(n, _FULL)
    return flat[:, _REVERSED]


# --- coding --------------------------------------------------------------------------------------------


class _Packer:
    """Bit fields of many images, put together in one go; sections come one behind the other."""

    def __init__(self, n: int):
        self.size = np.zeros(n, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, image: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """Fields in order of their images, of up to 32 bits."""
        per = np.bincount(image, weights=bits, minlength=len(self.size)).astype(np.int64)
        begin = np.cumsum(per) - per
        at = np.cumsum(bits) - bits - begin[image] + self.size[image]
        some = bits > 0
        self.parts.append((image[some].astype(np.int32), at[some].astype(np.int32), value[some].astype(np.uint32)))
        self.size += per

    def done(self) -> list[bytes]:
        nbytes = (self.size + 7) // 8
        start = np.cumsum(nbytes) - nbytes
        total = int(nbytes.sum()) + 8
        image, at, value = (np.concatenate(x) for x in zip(*self.parts))
        byte = start[image] + (at >> 3)
        wide = value.astype(np.uint64) << (at & 7).astype(np.uint64)
        most = int(wide.max(initial=0)).bit_length()
        out = np.zeros(total)
        for k in range(-(-most // 8)):
            out += np.bincount(byte + k, weights=wide >> np.uint64(8 * k) & np.uint64(255), minlength=total)[:total]
        raw = out.astype(np.uint8).tobytes()
        return [raw[a : a + n] for a, n in zip(start.tolist(), nbytes.tolist())]


def _neighbours(px: np.ndarray, first_row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, top, top right and top left of pixels in rows ``(rows, 16, 4)``; rows of an image's top have zeros above."""
    top = np.zeros_like(px)
    top[1:] = px[:-1]
    top[first_row] = 0
    left = np.zeros_like(px)
    left[:, 1:] = px[:, :-1]
    top_left = np.zeros_like(px)
    top_left[:, 1:] = top[:, :-1]
    top_right = np.empty_like(px)
    top_right[:, :-1] = top[:, 1:]
    top_right[:, -1] = px[:, 0]
    return left, top, top_right, top_left


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """Predictions of one mode for many pixels, channels last."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0], left.dtype), left.shape)
    if mode == 11:
        toward = top + left - top_left
        nearer = np.abs(toward - left).sum(-1, keepdims=True) < np.abs(toward - top).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = half(left, top)
        d = a - top_left
        return np.clip(a + np.where(d < 0, -(-d // 2), d // 2), 0, 255)
    if mode < 5:
        return (left, left, top, top_right, top_left)[mode]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    return half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])


def _residuals(px: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """What predictors leave of pixels ``(rows, 16, 4)``, and of each image the best mode of each block of 16 rows."""
    start = np.cumsum(heights) - heights
    first = np.zeros(len(px), bool)
    first[start] = True
    near = _neighbours(px, first)
    image = np.repeat(np.arange(len(heights)), heights)
    block = (np.arange(len(px)) - start[image]) >> BLOCK_BITS
    each = HEIGHT >> BLOCK_BITS
    where = image * each + block
    best, cost, modes = None, None, None
    for mode in MODES:
        r = (px - predicted(mode, *near)) & 255
        c = np.bincount(where, weights=np.minimum(r, 256 - r).sum((1, 2)), minlength=len(heights) * each)
        if best is None:
            best, cost, modes = r, c, np.full(len(c), mode)
        else:
            better = c < cost
            best = np.where(better[where][:, None, None], r, best)
            cost, modes = np.where(better, c, cost), np.where(better, mode, modes)
    best[first] = (px[first] - near[0][first]) & 255
    best[:, 0] = (px[:, 0] - near[1][:, 0]) & 255
    best[start, 0] = (px[start, 0] - np.array([255, 0, 0, 0])) & 255
    modes = modes.reshape(-1, each)
    return best, [m[: -(-h // (1 << BLOCK_BITS))] for m, h in zip(modes, heights.tolist())]


def _signed(v: np.ndarray) -> np.ndarray:
    return ((v & 255) ^ 128) - 128


def _elements(px: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    """Of each image, how much of green goes with red and with blue, in 32nds: ``(n, 2)``, from -128 to 127."""
    g = _signed(px[..., 2]).ravel().astype(np.float64)
    who = np.repeat(image, WIDTH)
    sums = lambda w: np.bincount(who, weights=w, minlength=n)
    gg = np.maximum(sums(g * g), 1)
    return np.stack([np.clip(np.rint(32 * sums(g * _signed(px[..., k]).ravel()) / gg), -128, 127).astype(np.int64) for k in (1, 3)], 1)


def _cross(px: np.ndarray, e: np.ndarray, sign: int) -> np.ndarray:
    """Adds or takes away what green tells of red and blue; ``e`` holds the two elements of each row of pixels."""
    out, g = px.copy(), _signed(px[..., 2])
    for c, k in ((1, 0), (3, 1)):
        out[..., c] = (px[..., c] + sign * (e[:, k, None] * g >> 5)) & 255
    return out


def _previous(key: np.ndarray) -> np.ndarray:
    """Of each place, the last one before with the same 40 bits of ``key``; -1 for none."""
    both = np.sort(key.astype(np.uint64) << np.uint64(24) | np.arange(len(key), dtype=np.uint64))  # places take 24 bits
    order = (both & np.uint64((1 << 24) - 1)).astype(np.int32)
    same = both[1:] >> np.uint64(24) == both[:-1] >> np.uint64(24)
    out = np.full(len(key), -1, np.int32)
    out[order[1:][same]] = order[:-1][same]
    return out


def _references(flat: np.ndarray, image: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a reference begins, its pixels and how far back it looks; references of one image don't overlap."""
    n = len(flat)
    with np.errstate(over="ignore"):
        key = (flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + image[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    before = _previous(key >> np.uint64(24))
    at = np.arange(n - 1)
    good = (before >= 0) & (image[:-1] == image[1:])
    good[good] &= (image[before[good]] == image[at[good]]) & (flat[before[good]] == flat[at[good]]) & (flat[before[good] + 1] == flat[at[good] + 1])
    back = np.where(good, at - before, 0)
    new = np.ones(n - 1, bool)
    new[1:] = (back[1:] != back[:-1]) | (image[1:-1] != image[:-2])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, n - 1))
    kept = back[head] > 0
    follows = np.zeros(len(head), bool)  # the pair's second pixel belongs to the next stretch, if that is a reference too
    follows[:-1] = kept[1:] & (image[head[1:]] == image[head[:-1]])
    pixels = length + ~follows
    kept &= pixels >= _SHORTEST
    return head[kept], pixels[kept], back[head[kept]]


def _ways(flat: np.ndarray, image: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Of each image the transform dealt to it: 0 predictor, 1 cross-colour, 2 subtract-green, others none."""
    with np.errstate(over="ignore"):
        place = (np.arange(len(flat)) - start[image]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        mixed = np.add.reduceat(flat.astype(np.uint64) * place, start) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(61)).astype(np.int64)


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of ``(height, 16)`` ARGB pixels, 64 high at most; equal pixels give equal bytes."""
    out: list[bytes] = []
    for i in range(0, len(images), TOGETHER):
        out += _encode(images[i : i + TOGETHER])
    return out


def _encode(images: list[np.ndarray]) -> list[bytes]:
    out: list[bytes] = [b""] * len(images)
    front = np.sort(np.array([np.resize(x.ravel()[:48], 48) for x in images]), axis=1)
    few = (np.diff(front, axis=1) != 0).sum(1) < 16
    few[few] = [len(np.unique(images[k])) <= 16 for k in np.flatnonzero(few)]
    for k in np.flatnonzero(few).tolist():
        out[k] = webp.encode(images[k], palette=True)
    which = np.flatnonzero(~few)
    if not len(which):
        return out
    n = len(which)
    heights = np.array([len(images[k]) for k in which])
    flat = np.concatenate([images[k].ravel() for k in which]).astype(np.uint32)
    count = heights * WIDTH
    start = np.cumsum(count) - count
    image = np.repeat(np.arange(n, dtype=np.int32), count)
    way = _ways(flat, image, start, n)

    px = np.stack([flat >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32).reshape(-1, WIDTH, 4)
    of_row = np.repeat(np.arange(n), heights)
    heads = [webp._Out() for _ in range(n)]
    for o, h in zip(heads, heights.tolist()):
        o.put(0x2F, 8)
        o.put(WIDTH - 1, 14)
        o.put(h - 1, 14)
        o.put(1, 1)
        o.put(0, 3)
    who = np.flatnonzero(way == 0)
    if len(who):
        rows = np.flatnonzero(np.isin(of_row, who))
        px[rows], modes = _residuals(px[rows], heights[who])
        for k, m in zip(who.tolist(), modes):
            heads[k].put(0b0001 | BLOCK_BITS - 2 << 3, 6)
            webp._put_image(heads[k], np.uint32(0xFF000000) | m.astype(np.uint32) << np.uint32(8), 1, False)
    who = np.flatnonzero(way == 1)
    if len(who):
        rows = np.flatnonzero(np.isin(of_row, who))
        e = _elements(px[rows], np.searchsorted(who, of_row[rows]), len(who))
        px[rows] = _cross(px[rows], e[np.searchsorted(who, of_row[rows])], -1)
        for k, (red, blue) in zip(who.tolist(), (e & 255).tolist()):
            heads[k].put(0b0011 | BLOCK_BITS - 2 << 3, 6)
            blocks = -(-int(heights[k]) // (1 << BLOCK_BITS))
            webp._put_image(heads[k], np.full(blocks, 0xFF000000 | blue << 8 | red, np.uint32), 1, False)
    green = way[of_row] == 2
    px[green, :, 1] = (px[green, :, 1] - px[green, :, 2]) & 255
    px[green, :, 3] = (px[green, :, 3] - px[green, :, 2]) & 255
    for k in np.flatnonzero(way == 2).tolist():
        heads[k].put(0b101, 3)
    a, r, g, b = np.ascontiguousarray(px.reshape(-1, 4).T)
    flat = a.astype(np.uint32) << np.uint32(24) | (r << 16 | g << 8 | b).astype(np.uint32)

    # what each pixel is coded as: 0 a literal, 1 the begin of a reference, 2 within one, 3 a cached colour
    kind = np.zeros(len(flat), np.int8)
    head, pixels, back = _references(flat, image, start)
    cover = np.zeros(len(flat) + 1, np.int32)
    cover[head] += 1
    cover[head + pixels] -= 1
    kind[np.cumsum(cover)[:-1] > 0] = 2
    kind[head] = 1
    slot = (flat * np.uint32(webp._CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)
    slot = slot.astype(np.int32)
    last = _previous(image * np.int32(1 << CACHE_BITS) + slot)
    hit = (kind == 0) & (last >= 0) & (flat[np.maximum(last, 0)] == flat)
    cached = np.bincount(image, weights=hit, minlength=n) * 8 >= count
    hit &= cached[image]
    kind[hit] = 3

    size = 280 + (1 << CACHE_BITS)
    symbol = np.where(kind == 3, 280 + slot, g)
    symbol[head] = 256 + _SYMBOL[pixels]
    shown = kind != 2
    counts = [np.bincount(image[shown] * size + symbol[shown], minlength=n * size).reshape(n, size)]
    literal = kind == 0
    counts += [np.bincount(image[literal] * 256 + c[literal], minlength=n * 256).reshape(n, 256) for c in (r, b, a)]
    counts.append(np.bincount(image[head] * 40 + _SYMBOL[back + 120], minlength=n * 40).reshape(n, 40))
    lengths = [code_lengths(c) for c in counts]

    pack = _Packer(n)
    for k, o in enumerate(heads):
        o.put(0, 1)  # no more transforms
        o.put((1 | CACHE_BITS << 1) if cached[k] else 0, 5 if cached[k] else 1)
        o.put(0, 1)  # one group of codes
    sizes = np.array([o.n for o in heads])
    words = -(-sizes // 16)
    pack.add(np.repeat(np.arange(n), words), np.array([o.value >> 16 * j & 0xFFFF for o, w in zip(heads, words.tolist()) for j in range(w)]), np.concatenate([np.append(np.full(w - 1, 16), s - 16 * (w - 1)) for s, w in zip(sizes.tolist(), words.tolist())]))
    for k, l in enumerate(lengths):
        _put_lengths(pack, l, np.where(cached, size, 280) if k == 0 else np.full(n, l.shape[1]))
    made = [codes(l) for l in lengths]
    get = lambda k, s: (made[k][0][image, s], made[k][1][image, s])
    (cg, ng), (cr, nr), (cb, nb), (ca, na) = get(0, symbol), get(1, r), get(2, b), get(3, a)
    ng, nr, nb, na = np.where(shown, ng, 0), np.where(literal, nr, 0), np.where(literal, nb, 0), np.where(literal, na, 0)
    one, one_bits = np.where(ng > 0, cg, 0) | np.where(nr > 0, cr, 0) << ng, ng + nr
    two, two_bits = np.where(nb > 0, cb, 0) | np.where(na > 0, ca, 0) << nb, nb + na
    one[head] |= _EXTRA[pixels] << ng[head]
    one_bits[head] += _EXTRA_BITS[pixels]
    d = _SYMBOL[back + 120]
    cd, nd = made[4][0][image[head], d], made[4][1][image[head], d]
    two[head] = cd | _EXTRA[back + 120] << nd
    two_bits[head] = nd + _EXTRA_BITS[back + 120]
    pack.add(np.repeat(image, 2), np.stack([one, two], 1).ravel(), np.stack([one_bits, two_bits], 1).ravel())
    for k, body in zip(which.tolist(), pack.done()):
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        out[k] = b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
    return out


def _put_lengths(pack: _Packer, lengths: np.ndarray, sizes: np.ndarray) -> None:
    """Code lengths of each image: runs of zeros in short, others one by one, each symbol of four bits; a code without symbols is a simple one."""
    n, size = lengths.shape
    some = (lengths > 0).any(1)
    head = 0
    for i, s in enumerate(webp._ORDER):
        head |= (4 if s in _LENGTHS else 0) << 5 + 3 * i
    head = (head | 15 << 1) & ~1  # not simple, all nineteen lengths
    ids, value, bits = [], [], []
    for part in range(0, 62, 16):
        ids.append(np.arange(n))
        value.append(np.where(some, head >> part & 0xFFFF, 1 if part == 0 else 0))
        bits.append(np.where(some, min(16, 62 - part) + (part == 48) * 1, 4 if part == 0 else 0))
    pack.add(*(np.stack(x, 1).ravel() for x in (ids, value, bits)))  # with the last bit 0: no limit on the symbols
    flat = lengths.ravel()
    inside = (np.arange(size)[None] < sizes[:, None]).ravel() & np.repeat(some, size)
    row = np.repeat(np.arange(n), size)
    keep = np.flatnonzero(inside)
    v, who = flat[keep], row[keep]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] > 0) | (v[:-1] > 0) | (who[1:] != who[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(v)))
    v, who = v[begin], who[begin]
    rank = np.full(19, 0)
    rank[sorted(_LENGTHS)] = np.arange(16)
    symbol = lambda s: int(f"{rank[s]:04b}"[::-1], 2)
    plain = np.array([symbol(s) for s in range(_BITS + 4)])
    fields_v, fields_b = np.zeros((len(v), 4), np.int64), np.zeros((len(v), 4), np.int64)
    single = v > 0
    fields_v[single, 0], fields_b[single, 0] = plain[v[single]], 4
    left = np.where(single, 0, run)
    for k in range(4):  # 280 symbols and a cache are three long runs at most
        longest = left >= 11
        take = np.minimum(left, 138)
        fields_v[longest, k], fields_b[longest, k] = (symbol(18) | (take - 11) << 4)[longest], 11
        middle = (left >= 3) & ~longest
        fields_v[middle, k], fields_b[middle, k] = (symbol(17) | (left - 3) << 4)[middle], 7
        short = (left > 0) & (left < 3)
        fields_v[short, k], fields_b[short, k] = plain[0], 4
        left = np.where(longest, left - take, np.where(middle, 0, np.maximum(left - 1, 0)))
    if left.any():
        raise AssertionError("a run of zeros is longer than the fields")
    pack.add(np.repeat(who, 4), fields_v.ravel(), fields_b.ravel())


# --- decoding ------------------------------------------------------------------------------------------


class _Reader:
    """Bits of many streams, each at its own place."""

    def __init__(self, streams: list[bytes]):
        size = np.array([len(s) for s in streams])
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(streams) + b"\0" * 8, np.uint8).astype(np.uint64)
        self.words = raw[:-4] | raw[1:-3] << np.uint64(8) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(24) | raw[4:] << np.uint64(32)
        self.pos, self.end = start * 8, (start + size) * 8
        self.most = 8 * (len(self.words) - 1)

    def peek(self, who: np.ndarray) -> np.ndarray:
        """The next 32 bits."""
        p = np.minimum(self.pos[who], self.most)
        return (self.words[p >> 3] >> (p & 7).astype(np.uint64)).astype(np.int64)

    def read(self, who: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        out = self.peek(who) & ((np.int64(1) << np.asarray(bits, np.int64)) - 1)
        self.pos[who] += bits
        return out

    def symbol(self, who: np.ndarray, table: np.ndarray) -> np.ndarray:
        e = table[who, self.peek(who) & (_FULL - 1)].astype(np.int64)
        self.pos[who] += e & 15
        return e >> 4


def _read_lengths(bits: _Reader, sizes: np.ndarray) -> np.ndarray:
    """Code lengths of one code of every image."""
    n, width = len(sizes), int(sizes.max())
    out = np.zeros((n, width + 256), np.int64)
    every = np.arange(n)
    simple = bits.read(every, 1) == 1
    who = every[simple]
    if len(who):
        two, wide = bits.read(who, 1), bits.read(who, 1)
        out[who, bits.read(who, 1 + 7 * wide)] = 1
        pair = who[two == 1]
        out[pair, bits.read(pair, 8)] = 1
    who = every[~simple]
    if len(who):
        first = np.zeros((n, 19), np.int64)
        many = 4 + bits.read(who, 4)
        for i, s in enumerate(webp._ORDER):
            some = who[many > i]
            first[some, s] = bits.read(some, 3)
        table = np.zeros((n, _FULL), np.uint16)
        table[who] = tables(first[who])
        limited = bits.read(who, 1) == 1
        left = np.full(n, 1 << 30)
        some = who[limited]
        if len(some):
            left[some] = 2 + bits.read(some, 2 + 2 * bits.read(some, 3))
        at, previous = np.zeros(n, np.int64), np.full(n, 8)
        while len(who := who[(at[who] < sizes[who]) & (left[who] > 0)]):
            left[who] -= 1
            s = bits.symbol(who, table)
            plain = s < 16
            w = who[plain]
            out[w, at[w]] = s[plain]
            at[w] += 1
            previous[w] = np.where(s[plain] > 0, s[plain], previous[w])
            for code, least, extra in ((16, 3, 2), (17, 3, 3), (18, 11, 7)):
                w = who[s == code]
                if len(w):
                    run = least + bits.read(w, extra)
                    if code == 16:
                        for k, m in zip(w.tolist(), run.tolist()):
                            out[k, at[k] : at[k] + m] = previous[k]
                    at[w] += run
        if (at > sizes).any():
            raise ValueError("too many code lengths")
    return out[:, :width] if not out[:, width:].any() else out


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels of lossless WebP files; files of this module in step, others one by one."""
    out: list[np.ndarray] = []
    for i in range(0, len(files), TOGETHER):
        out += _decode(files[i : i + TOGETHER])
    return out


def _head(data: bytes):
    """``(bits, height, way, image)`` behind the transforms of a file that can be read in step; None if it can't."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 8 + struct.unpack("<I", data[4:8])[0]:
        raise ValueError("not a whole lossless WebP file")
    bits = webp._Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if bits.read(4) >> 1:
        raise ValueError("unknown version")
    if width != WIDTH or height > HEIGHT:
        return None
    way, image = 3, None
    if bits.read(1):
        way = bits.read(2)
        if way == 3:
            return None
        if way < 2:
            if bits.read(3) + 2 != BLOCK_BITS:
                return None
            image = webp._pixels(bits, 1, -(-height // (1 << BLOCK_BITS)), False)
        if bits.read(1):
            return None
    cache = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        return None
    return bits, height, way, image, cache


def _decode(files: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray | None] = [None] * len(files)
    heads = [_head(f) for f in files]
    for k, h in enumerate(heads):
        if h is None:
            out[k] = webp.decode(files[k])
    which = [k for k, h in enumerate(heads) if h is not None]
    if not which:
        return out
    which.sort(key=lambda k: -heads[k][1])
    heads = [heads[k] for k in which]
    n = len(which)
    heights = np.array([h[1] for h in heads])
    cache_bits = np.array([h[4] for h in heads])
    bits = _Reader([h[0].data for h in heads])
    bits.pos += np.array([h[0].pos for h in heads])
    cached = np.where(cache_bits > 0, 1 << cache_bits, 0)
    lengths = [_read_lengths(bits, s) for s in (280 + cached, *(np.full(n, 256) for _ in range(3)), np.full(n, 40))]
    long = np.zeros(n, bool)
    for l in lengths:
        long |= (l > _BITS).any(1)
    if long.any():
        for j in np.flatnonzero(long).tolist():
            out[which[j]] = webp.decode(files[which[j]])
        rest = np.flatnonzero(~long).tolist()
        for j, x in zip(rest, _decode([files[which[j]] for j in rest]) if rest else []):
            out[which[j]] = x
        return out
    flat = _in_step(bits, [tables(l) for l in lengths], heights * WIDTH, cache_bits)
    if (bits.pos > bits.end).any():
        raise ValueError("the stream ends early")

    of_row = np.repeat(np.arange(n), heights)
    row = np.arange(len(of_row)) - (np.cumsum(heights) - heights)[of_row]
    rows = flat.reshape(n, HEIGHT, WIDTH)[of_row, row]
    px = np.stack([rows >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int32)
    way = np.array([h[2] for h in heads])
    green = way[of_row] == 2
    px[green, :, 1] = (px[green, :, 1] + px[green, :, 2]) & 255
    px[green, :, 3] = (px[green, :, 3] + px[green, :, 2]) & 255
    who = np.flatnonzero(way == 1)
    if len(who):
        image = np.zeros((n, HEIGHT >> BLOCK_BITS), np.int64)
        for k in who.tolist():
            image[k, : len(heads[k][3])] = heads[k][3]
        mine = np.flatnonzero(way[of_row] == 1)
        e = image[of_row[mine], row[mine] >> BLOCK_BITS]
        if (e >> 16 & 255).any():  # red tells of blue: no file of this module
            for k in who.tolist():
                out[which[k]] = webp.decode(files[which[k]])
        px[mine] = _cross(px[mine], _signed(np.stack([e, e >> 8], 1)), 1)
    who = np.flatnonzero(way == 0)
    if len(who):
        modes = np.zeros((len(who), HEIGHT >> BLOCK_BITS), np.int64)
        for j, k in enumerate(who.tolist()):
            modes[j, : len(heads[k][3])] = heads[k][3] >> 8 & 255
        mine = np.flatnonzero(way[of_row] == 0)
        at = np.searchsorted(who, of_row[mine])
        part = np.zeros((len(who), HEIGHT, WIDTH, 4), np.int32)
        part[at, row[mine]] = px[mine]
        px[mine] = _unpredicted(part, modes, heights[who])[at, row[mine]]
    c = px.astype(np.uint32)
    argb = c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]
    begin = np.cumsum(heights) - heights
    for j, k in enumerate(which):
        if out[k] is None:
            out[k] = argb[begin[j] : begin[j] + heights[j]]
    return out


def _in_step(bits: _Reader, tabs: list[np.ndarray], counts: np.ndarray, cache_bits: np.ndarray) -> np.ndarray:
    """Pixels ``(n, PIXELS)`` of images in order of their sizes, the largest first: one pixel of each at a time."""
    n = len(counts)
    out = np.zeros((n, PIXELS), np.int64)
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cache = np.zeros((n, 1 << int(cache_bits.max(initial=0))), np.int64) if (cache_bits > 0).any() else None
    keeps = np.flatnonzero(cache_bits > 0)
    active = np.searchsorted(-counts, -np.arange(int(counts.max())), "left")

    def value(who: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        extra = np.maximum(prefix - 2 >> 1, 0)
        return np.where(prefix < 4, prefix + 1, (2 + (prefix & 1) << extra) + bits.read(who, np.where(prefix < 4, 0, extra)) + 1)

    for i in range(int(counts.max())):
        who = np.arange(active[i])
        copying = left[: active[i]] > 0
        if copying.any():
            c = who[copying]
            out[c, i] = out[c, i - back[c]]
            left[c] -= 1
            who = who[~copying]
        s = bits.symbol(who, tabs[0])
        plain = s < 256
        w = who if plain.all() else who[plain]
        red, blue, alpha = (bits.symbol(w, t) for t in tabs[1:4])
        out[w, i] = alpha << 24 | red << 16 | s[plain] << 8 | blue
        if len(w) < len(who):
            ref = (s >= 256) & (s < 280)
            w = who[ref]
            if len(w):
                length = value(w, s[ref] - 256)
                d = value(w, bits.symbol(w, tabs[4]))
                d = np.where(d > 120, d - 120, _NEAR[np.minimum(d, 120) - 1])
                if (d > i).any() or (i + length > counts[w]).any():
                    raise ValueError("a back-reference leaves the image")
                out[w, i] = out[w, i - d]
                left[w], back[w] = length - 1, d
            w = who[s >= 280]
            if len(w):
                if cache is None or (s[s >= 280] - 280 >= 1 << cache_bits[w]).any():
                    raise ValueError("no such cached colour")
                out[w, i] = cache[w, s[s >= 280] - 280]
        if cache is not None:
            k = keeps[: np.searchsorted(keeps, active[i])]
            v = out[k, i]
            cache[k, (v * webp._CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits[k]] = v
    return out


def _unpredicted(res: np.ndarray, modes: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Pixels from residuals ``(images, HEIGHT, WIDTH, 4)``, place by place over all images."""
    known = np.zeros_like(res)
    zero = np.zeros_like(res[:, 0, 0])
    for y in range(int(heights.max())):
        mode = modes[:, y >> BLOCK_BITS]
        present = np.unique(mode).tolist()
        for x in range(WIDTH):
            if y == 0:
                p = known[:, 0, x - 1] if x else zero + np.array([255, 0, 0, 0], res.dtype)
            elif x == 0:
                p = known[:, y - 1, 0]
            else:
                near = known[:, y, x - 1], known[:, y - 1, x], known[:, y - 1, x + 1] if x + 1 < WIDTH else known[:, y, 0], known[:, y - 1, x - 1]
                p = predicted(present[0] if present[0] < 14 else 0, *near)
                for m in present[1:]:
                    p = np.where((mode == m)[:, None], predicted(m if m < 14 else 0, *near), p)
            known[:, y, x] = (res[:, y, x] + p) & 255
    return known
