"""Lossless WebP: an encoder and a decoder in numpy.

Pixels are uint32 0xAARRGGBB in arrays of height x width. The decoder takes everything the format has: prefix codes
with several groups, back-references, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. Streams in which only the green code has bits (palette images) are decoded by numpy: every bit position is
looked up in the prefix table at once, and only the chain of symbol starts is followed one by one.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14
LITERALS, LENGTHS, DISTANCES, MAX_LENGTH = 256, 24, 40, 4096

#: Fixed values of the format: order of the code lengths of code lengths, and (x, y) of the first 120 distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


# Prefix codes


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Lengths of a prefix code for symbols of these counts; a single symbol has length 0 but counts as used."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        return out
    weight = counts[used].astype(np.int64)
    while True:
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        parent, n = {}, len(used)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = n
            heapq.heappush(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            out[used] = depth[: len(used)]
            return out
        weight = np.maximum(weight, max(1, int(weight.sum()) >> limit)) + 1


_reversals: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    """The numbers of so many bits with their bits in reverse order."""
    if bits not in _reversals:
        x = np.arange(1 << bits)
        _reversals[bits] = sum((((x >> k) & 1) << (bits - 1 - k) for k in range(bits)), np.zeros_like(x))
    return _reversals[bits]


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols in the order of their codes, how many of the longest codes' values each one takes, and that length."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    bits = int(lengths[used[-1]]) if len(used) else 0
    return used, 1 << (bits - lengths[used]), bits


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of these lengths, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used, share, bits = _in_order(lengths)
    out[used] = _reversed(bits)[np.cumsum(share) - share]
    return out


_NONE = np.zeros(LITERALS + LENGTHS + (1 << 11), np.int64)


class Code:
    """Reading side of a prefix code: symbol and length by the next `bits` bits."""

    def __init__(self, lengths: np.ndarray, single: int | None = None):
        self.single = single
        self.bits = 0 if single is not None else int(lengths.max(initial=0))
        if single is not None:
            self.symbol, self.length = np.array([single]), np.array([0])
            return
        used, share, _ = _in_order(lengths)
        if not len(used) or share.sum() != 1 << self.bits:
            raise ValueError("bad prefix code")
        self.symbol = np.repeat(used, share)[_reversed(self.bits)]
        self.length = lengths[self.symbol]
        self.symbols, self.lengths = self.symbol.tolist(), self.length.tolist()

    def read(self, bits: Reader) -> int:
        if self.single is not None:
            return self.single
        w = bits.peek(self.bits)
        bits.at += self.lengths[w]
        return self.symbols[w]


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + b"\0" * 8, at

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > len(self.data) * 8:
            raise ValueError("the stream ends early")
        return value


class Writer:
    """Bits as (value, count) pairs; whole arrays of them are packed at once."""

    def __init__(self):
        self.values, self.counts, self.runs = [], [], []

    def put(self, value: int, count: int) -> None:
        if count:
            self.values.append(value)
            self.counts.append(count)

    def put_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.flush()
        self.runs.append((values.astype(np.uint64), counts.astype(np.int64)))

    def flush(self) -> None:
        if self.values:
            self.runs.append((np.array(self.values, np.uint64), np.array(self.counts, np.int64)))
            self.values, self.counts = [], []

    def bytes(self) -> bytes:
        self.flush()
        values, counts = (np.concatenate(x) for x in zip(*self.runs))
        ends = np.cumsum(counts)
        at = ends - counts
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(values << shift, first)  # bits don't overlap, so sums are unions
        over = np.flatnonzero((at & 63) + counts > 64)
        out[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (int(ends[-1]) + 7) >> 3]


def _put_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for these counts; gives codes and lengths."""
    used = np.flatnonzero(counts)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        w.put(5 | (int(used[0]) << 3 if len(used) else 0), 11)
        return _NONE[: len(counts)], _NONE[: len(counts)]
    lengths = code_lengths(counts)
    if len(used) < 2:  # a lone symbol beyond the simple form: another one gets a code too
        lengths[used[0]] = lengths[0] = 1
    elif len(used) == 2 and used[1] < 256:
        w.put(1, 1), w.put(1, 1), w.put(1, 1)
        w.put(int(used[0]), 8), w.put(int(used[1]), 8)
        return canonical(lengths), lengths
    w.put(0, 1)
    tokens, i, n = [], 0, int(np.flatnonzero(lengths)[-1]) + 1
    listed = lengths.tolist()
    while i < n:
        run = 1
        while i + run < n and listed[i + run] == listed[i]:
            run += 1
        i += run
        if listed[i - 1] == 0:
            while run >= 11:
                take = min(run, 138)
                tokens.append((18, take - 11, 7))
                run -= take
            if run >= 3:
                tokens.append((17, run - 3, 3))
                run = 0
            tokens += [(0, 0, 0)] * run
        else:
            tokens.append((listed[i - 1], 0, 0))
            run -= 1
            while run >= 3:
                take = min(run, 6)
                tokens.append((16, take - 3, 2))
                run -= take
            tokens += [(listed[i - 1], 0, 0)] * run
    counts2 = np.bincount([t for t, _, _ in tokens], minlength=19)
    lengths2 = code_lengths(counts2, 7)
    alone = np.flatnonzero(counts2)
    if len(alone) == 1:
        lengths2[alone[0]] = lengths2[0 if alone[0] else 1] = 1
    codes2 = canonical(lengths2)
    many = max(4, max(k + 1 for k, s in enumerate(LENGTH_ORDER) if lengths2[s]))
    w.put(many - 4, 4)
    for s in LENGTH_ORDER[:many]:
        w.put(int(lengths2[s]), 3)
    if len(tokens) < 2 or n == len(counts):
        if n < len(counts):  # fill up to the whole alphabet
            raise AssertionError("unreachable: a code has two symbols at least")
        w.put(0, 1)
    else:
        w.put(1, 1)
        bits = max(2, (len(tokens) - 2).bit_length())
        bits += bits & 1
        w.put((bits - 2) // 2, 3)
        w.put(len(tokens) - 2, bits)
    bits2, sizes2 = codes2.tolist(), lengths2.tolist()
    w.values += [bits2[t] | extra << sizes2[t] for t, extra, _ in tokens]
    w.counts += [sizes2[t] + count for t, _, count in tokens]
    return canonical(lengths), lengths


def _read_code(r: Reader, size: int) -> Code:
    if r.take(1):
        two, wide = r.take(1), r.take(1)
        first = r.take(8 if wide else 1)
        if not two:
            return Code(np.zeros(size, np.int64), first)
        lengths = np.zeros(size, np.int64)
        lengths[[first, r.take(8)]] = 1
        return Code(lengths)
    lengths2 = np.zeros(19, np.int64)
    for s in LENGTH_ORDER[: 4 + r.take(4)]:
        lengths2[s] = r.take(3)
    used = np.flatnonzero(lengths2)
    code = Code(lengths2, int(used[0])) if len(used) == 1 else Code(lengths2)
    left = 2 + r.take(2 + 2 * r.take(3)) if r.take(1) else size
    lengths, last, position = [], 8, 0
    if code.single is None:
        mask, symbols, sizes = (1 << code.bits) - 1, code.symbols, code.lengths
    else:
        mask, symbols, sizes = 0, [code.single], [0]
    ahead = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 2 * size + 16], "little") >> (r.at & 7)  # 14 bits a length at most
    while len(lengths) < size and left:
        left -= 1
        w = (ahead >> position) & mask
        s = symbols[w]
        position += sizes[w]
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + (ahead >> position & 3))
            position += 2
        elif s == 17:
            lengths += [0] * (3 + (ahead >> position & 7))
            position += 3
        else:
            lengths += [0] * (11 + (ahead >> position & 127))
            position += 7
    r.at += position
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    out = np.array(lengths + [0] * (size - len(lengths)), np.int64)
    used = np.flatnonzero(out)
    return Code(out, int(used[0])) if len(used) == 1 else Code(out)


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their count for a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    extra = high - 1
    return 2 * high + second, v & ((1 << extra) - 1), extra


def _value(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.take(extra) + 1


# Entropy-coded images


def find_copies(pixels: np.ndarray, block: int = 16) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that repeat earlier ones: they start where a hash of `block` pixels is
    that of an earlier aligned block, and are confirmed and extended pixel by pixel."""
    n = len(pixels)
    if n < 2 * block:
        return []
    units = pixels.view(np.uint8) if pixels.dtype == np.uint8 else np.ascontiguousarray(pixels.astype(np.uint32)).view(np.uint8)
    size = units.itemsize * len(units) // n
    word = np.ndarray((n - 8 // size + 1,), np.uint64, units.tobytes(), 0, (size,))  # 8 bytes from each pixel on
    h, width = word * np.uint64(0x9E3779B97F4A7C15), 8 // size
    while width < block:
        h = h[:-width] ^ ((h[width:] ^ (h[width:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
        width *= 2
    aligned = np.arange(0, len(h), block)
    keys, at = np.unique(h[aligned], return_index=True)
    maybe = np.zeros(1 << 16, bool)
    maybe[keys & np.uint64(0xFFFF)] = True
    hits = np.flatnonzero(maybe[h & np.uint64(0xFFFF)])
    place = np.minimum(np.searchsorted(keys, h[hits]), len(keys) - 1)
    source = aligned[at[place]]
    real = (keys[place] == h[hits]) & (source < hits)
    hits, source = hits[real], source[real]
    out, end = [], 0
    for i, s in zip(hits.tolist(), source.tolist()):
        if i < end:
            continue
        size = 0
        while i + size < n:
            step = min(256, n - i - size)
            same = pixels[i + size : i + size + step] == pixels[s + size : s + size + step]
            if same.all():
                size += step
            else:
                size += int(np.argmin(same))
                break
        if size >= block:
            end = i + size
            for k in range(0, size, MAX_LENGTH):
                out.append((i + k, min(MAX_LENGTH, size - k), i - s))
    return out


def _put_image(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = True) -> None:
    flat = pixels.ravel()
    n = len(flat)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of codes
    rest = flat & np.uint32(0xFFFF00FF)
    flat_rest = bool((rest == rest[0]).all())  # grey and palette images
    green_only = ((flat >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    found = find_copies(green_only if flat_rest else flat) if copies else []
    literal = np.ones(n, bool)
    for i, size, _ in found:
        literal[i : i + size] = False
    cached = np.full(n, -1, np.int64)
    if cache_bits:
        key = ((flat.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        last: dict[int, int] = {}
        for i, (k, v) in enumerate(zip(key.tolist(), flat.tolist())):
            if literal[i] and last.get(k, 0) == v:
                cached[i] = k
            last[k] = v
    plain = literal & (cached < 0)
    symbol = green_only.astype(np.int64)
    if cache_bits:
        symbol = np.where(cached >= 0, cached + LITERALS + LENGTHS, symbol)
    jumps = [(i, *_prefix(size), *_prefix(distance + 120)) for i, size, distance in found]
    size = LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    green = np.bincount(symbol[literal] if jumps else symbol, minlength=size)
    far = np.zeros(DISTANCES, np.int64)
    for _, s, _, _, d, _, _ in jumps:
        green[LITERALS + s] += 1
        far[d] += 1
    codes, lengths = _put_code(w, green)
    others = [np.full(1 if flat_rest else n, 0, np.int64) + ((rest[:1] if flat_rest else rest) >> np.uint32(k) & np.uint32(255)) for k in (16, 0, 24)]
    tables = [_put_code(w, np.bincount(o if flat_rest else o[plain], minlength=256)) for o in others]
    distance_codes, distance_lengths = _put_code(w, far)
    columns = [(codes[symbol], lengths[symbol]) if not jumps else (np.where(literal, codes[symbol], 0), np.where(literal, lengths[symbol], 0))]
    if any(t[1].any() for t in tables):
        columns += [(np.where(plain, c[o], 0), np.where(plain, m[o], 0)) for (c, m), o in zip(tables, others)]
    values, counts = (np.stack(x, axis=1) for x in zip(*columns)) if len(columns) > 1 or jumps else columns[0]
    if jumps:  # a copy's bits stand in the row of its first pixel
        extra = np.zeros((2, n, 4), np.int64)
        for i, s, e, c, d, e2, c2 in jumps:
            extra[:, i] = ((codes[LITERALS + s], e, distance_codes[d], e2), (lengths[LITERALS + s], c, distance_lengths[d], c2))
        values, counts = np.concatenate([values, extra[0]], axis=1), np.concatenate([counts, extra[1]], axis=1)
    values, counts = values.ravel(), counts.ravel()
    if values.size > n or (counts == 0).any():
        keep = counts > 0
        values, counts = values[keep], counts[keep]
    if len(values):
        w.put_all(values, counts)


def _chain(step: bytes, length: np.ndarray, at: int, need: int) -> np.ndarray:
    """Starts of up to `need` symbols from `at` on, ending before one of length 0 (that needs care). step has the
    length of two symbols together."""
    starts: list[int] = []
    put = starts.append
    for _ in range(need // 2):
        s = step[at]
        if not s:
            break
        put(at)
        at += s
    head = np.array(starts, np.int64)
    out = np.empty(2 * len(head), np.int64)
    out[::2] = head
    out[1::2] = head + length[head]
    rest = []
    for _ in range(need - len(out)):
        s = int(length[at])
        if not s:
            break
        rest.append(at)
        at += s
    return np.concatenate([out, rest]).astype(np.int64) if rest else out


def _read_green(r: Reader, code: Code, distance: Code, base: int, n: int, width: int) -> np.ndarray:
    """n pixels of a stream whose other codes have no bits: base plus the green symbol."""
    out, done = np.zeros(n, np.uint32), 0
    data = np.frombuffer(r.data, np.uint8)
    pieces = 1 << 18  # bytes of stream that are looked up at once
    while done < n:
        k = r.at >> 3
        window = data[k : k + pieces + 4].astype(np.uint32)
        if len(window) <= 4:
            raise ValueError("the stream ends early")
        m = len(window) - 4
        word = window[:m] | (window[1 : m + 1] << np.uint32(8)) | (window[2 : m + 2] << np.uint32(16)) | (window[3 : m + 3] << np.uint32(24))
        look = ((word[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.bits) - 1)).ravel()
        symbol = code.symbol.astype(np.int16)
        length = np.where(symbol < LITERALS, code.length, 0)[look]
        symbol = symbol[look]
        limit = len(length) - 1
        length[max(0, limit - 47) :] = 0  # a symbol there may need bits of the next piece
        second = length[np.arange(len(length) - 16) + length[:-16]]
        step = ((length[:-16] + second) * (second > 0)).astype(np.uint8).tobytes()
        while done < n:
            starts = _chain(step, length, r.at - 8 * k, n - done)
            out[done : done + len(starts)] = symbol[starts]
            done += len(starts)
            if len(starts):
                r.at = 8 * k + int(starts[-1] + length[starts[-1]])
            if done == n or r.at - 8 * k >= limit - 47:
                break
            s = code.read(r)
            if s < LITERALS:
                out[done] = s
                done += 1
                continue
            size = _value(s - LITERALS, r)
            back = _distance(_value(distance.read(r), r), width)
            if back > done or done + size > n:
                raise ValueError("bad back-reference")
            _copy(out, done, size, back)
            done += size
        if r.at >> 3 == k and done < n:
            s = code.read(r)
            if s >= LITERALS:
                size = _value(s - LITERALS, r)
                back = _distance(_value(distance.read(r), r), width)
                if back > done or done + size > n:
                    raise ValueError("bad back-reference")
                _copy(out, done, size, back)
                done += size
            else:
                out[done] = s
                done += 1
    return np.uint32(base) | (out << np.uint32(8))


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, size: int, back: int) -> None:
    """An overlapping copy repeats the last `back` pixels."""
    done = 0
    while done < size:
        step = min(size - done, back + done)
        out[at + done : at + done + step] = out[at - back : at - back + step]
        done += step


def _read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    n = width * height
    cache_bits = r.take(4) if r.take(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache")
    groups, which, bits = 1, None, 0
    if main and r.take(1):
        bits = r.take(3) + 2
        meta = (_read_image(r, _blocks(width, bits), _blocks(height, bits), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        which, groups = meta.tolist(), int(meta.max()) + 1
    size = LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    codes = [[_read_code(r, k) for k in (size, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    only = codes[0]
    if groups == 1 and not cache_bits and all(c.single is not None for c in only[1:4]):
        base = (only[3].single << 24) | (only[1].single << 16) | only[2].single
        if only[0].single is not None and only[0].single < LITERALS:
            return np.full((height, width), base | (only[0].single << 8), np.uint32)
        if only[0].single is None:
            return _read_green(r, only[0], only[4], base, n, width).reshape(height, width)
    out, done = [0] * n, 0
    cache = [0] * (1 << cache_bits)
    filled = 0  # pixels that are in the cache
    while done < n:
        code = only if which is None else codes[which[(done // width) >> bits][(done % width) >> bits]]
        s = code[0].read(r)
        if s < LITERALS:
            red, blue, alpha = code[1].read(r), code[2].read(r), code[3].read(r)
            out[done] = (alpha << 24) | (red << 16) | (s << 8) | blue
            done += 1
        elif s < LITERALS + LENGTHS:
            length = _value(s - LITERALS, r)
            back = _distance(_value(code[4].read(r), r), width)
            if back > done or done + length > n:
                raise ValueError("bad back-reference")
            for k in range(done, done + length):
                out[k] = out[k - back]
            done += length
        else:
            while filled < done:
                cache[((out[filled] * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)] = out[filled]
                filled += 1
            out[done] = cache[s - LITERALS - LENGTHS]
            done += 1
        if r.at > 8 * len(r.data):
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


# Transforms


def _planes(pixels: np.ndarray) -> np.ndarray:
    """Channels blue, green, red, alpha as a last axis of signed numbers."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4).astype(np.int16)


def _pixels(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((planes & 255).astype(np.uint8)).view(np.uint32)[..., 0]


def _predict(mode: int, left, top, corner, right):
    """Prediction from the neighbours' channels (corner: above to the left; right: above to the right)."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = mean(left, top)
        move = half - corner
        return np.clip(half + np.where(move < 0, -(-move >> 1), move >> 1), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int16), left.shape)


def predict_forward(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Residuals; all neighbours are known, so whole images are predicted in each mode that occurs."""
    p = _planes(pixels)
    h, w = pixels.shape
    left, top = np.zeros_like(p), np.zeros_like(p)
    left[:, 1:], top[1:] = p[:, :-1], p[:-1]
    corner = np.zeros_like(p)
    corner[1:, 1:] = p[:-1, :-1]
    right = np.zeros_like(p)
    right[1:, :-1] = p[:-1, 1:]
    right[1:, -1] = p[1:, 0]
    each = np.repeat(np.repeat(modes, 1 << bits, axis=0), 1 << bits, axis=1)[:h, :w]
    guess = np.zeros_like(p)
    for mode in np.unique(each):
        at = each == mode
        guess[at] = _predict(int(mode), left[at], top[at], corner[at], right[at])
    guess[0], guess[1:, 0] = left[0], top[1:, 0]
    guess[0, 0] = (0, 0, 0, 255)
    return _pixels(p - guess)


def predict_inverse(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    p = _planes(pixels)
    h, w = pixels.shape
    p[0, 0] += (0, 0, 0, 255)
    p[0] = np.cumsum(p[0], axis=0, dtype=np.int64) & 255
    for y in range(1, h):
        p[y, 0] = (p[y, 0] + p[y - 1, 0]) & 255
        above, row = p[y - 1], p[y]
        for block in range(modes.shape[1]):
            mode = int(modes[y >> bits, block])
            a, b = max(1, block << bits), min(w, (block + 1) << bits)
            if a >= b:
                continue
            right = np.concatenate([above[a + 1 : b + 1], row[:1]]) if b == w else above[a + 1 : b + 1]
            if mode == 1:
                row[a:b] = (row[a - 1] + np.cumsum(row[a:b], axis=0, dtype=np.int64)) & 255
            elif mode in (5, 6, 7, 10, 11, 12, 13):
                for x in range(a, b):
                    row[x] = (row[x] + _predict(mode, row[x - 1], above[x], above[x - 1], right[x - a])) & 255
            else:
                row[a:b] = (row[a:b] + _predict(mode, above[a:b], above[a:b], above[a - 1 : b - 1], right)) & 255
    return _pixels(p)


def cross_color(pixels: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    p = _planes(pixels)
    h, w = pixels.shape
    e = (_planes(elements) & 255).astype(np.uint8).view(np.int8).astype(np.int16)
    e = np.repeat(np.repeat(e, 1 << bits, axis=0), 1 << bits, axis=1)[:h, :w]
    signed = lambda c: (c & 255).astype(np.uint8).view(np.int8).astype(np.int16)
    delta = lambda t, c: (t * signed(c)) >> 5
    sign = -1 if forward else 1
    red = p[..., 2] + sign * delta(e[..., 0], p[..., 1])
    p[..., 0] += sign * (delta(e[..., 1], p[..., 1]) + delta(e[..., 2], p[..., 2] if forward else red))
    p[..., 2] = red
    return _pixels(p)


def subtract_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    both = np.uint32(0x00FF00FF)
    green = ((pixels >> np.uint32(8)) & np.uint32(255)) * np.uint32(0x10001)
    other = (pixels & both) + (np.uint32(0x01000100) - green if forward else green)
    return (pixels & ~both) | (other & both)


def _packing(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def bundle(index: np.ndarray, bits: int) -> np.ndarray:
    """Indices (height x width) as pixels of 1 << bits indices each."""
    h, w = index.shape
    per, step = 1 << bits, 8 >> bits
    wide = np.zeros((h, _blocks(w, bits) * per), np.uint32)
    wide[:, :w] = index
    packed = np.zeros((h, wide.shape[1] // per), np.uint32)
    for k in range(per):
        packed |= wide[:, k::per] << np.uint32(k * step)
    return packed << np.uint32(8) | np.uint32(0xFF000000)


def unbundle(pixels: np.ndarray, bits: int, width: int) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    if not bits:
        return green
    per, step = 1 << bits, 8 >> bits
    out = np.zeros((len(green), green.shape[1] * per), np.uint32)
    for k in range(per):
        out[:, k::per] = (green >> np.uint32(k * step)) & np.uint32((1 << step) - 1)
    return out[:, :width]


# Files


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (PALETTE,), cache_bits: int = 0, block_bits: int = 3, modes: np.ndarray | None = None, elements: np.ndarray | None = None) -> bytes:
    """A file of the pixels; transforms in the order in which they are applied. PALETTE, which must be the last one, is
    left out for more than 256 colours. modes and elements: images of the predictor and cross-colour transforms."""
    h, w = pixels.shape
    if not (0 < h <= MAX_SIDE and 0 < w <= MAX_SIDE):
        raise ValueError("a side is empty or too long")
    out = Writer()
    out.put(w - 1, 14), out.put(h - 1, 14), out.put(1, 1), out.put(0, 3)
    for t in transforms:
        if t == PALETTE:
            colors, index = _palette(pixels)
            if colors is None:
                continue
            bits = _packing(len(colors))
            out.put(1, 1), out.put(t, 2), out.put(len(colors) - 1, 8)
            steps = _planes(colors[None])
            steps[:, 1:] -= steps[:, :-1].copy()
            _put_image(out, _pixels(steps), False, copies=False)
            pixels = bundle(index, bits)
            continue
        out.put(1, 1), out.put(t, 2)
        if t == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
            continue
        shape = _blocks(h, block_bits), _blocks(w, block_bits)
        out.put(block_bits - 2, 3)
        if t == PREDICTOR:
            m = modes if modes is not None else np.full(shape, 11)
            _put_image(out, (m.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
            pixels = predict_forward(pixels, m, block_bits)
        else:
            e = elements if elements is not None else np.zeros(shape, np.uint32)
            _put_image(out, e.astype(np.uint32) | np.uint32(0xFF000000), False)
            pixels = cross_color(pixels, e, block_bits, True)
    out.put(0, 1)
    _put_image(out, pixels, True, cache_bits)
    data = b"\x2f" + out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _palette(pixels: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    p = pixels.ravel()
    if ((p & np.uint32(255)) * np.uint32(0x10101) | np.uint32(0xFF000000) == p).all():  # opaque grey: no sort
        seen = np.bincount(p & np.uint32(255), minlength=256) > 0
        colors = np.flatnonzero(seen).astype(np.uint32) * np.uint32(0x10101) | np.uint32(0xFF000000)
        return colors, (np.cumsum(seen) - 1)[p & np.uint32(255)].reshape(pixels.shape)
    colors, index = np.unique(pixels, return_inverse=True)
    return (colors, index.reshape(pixels.shape)) if len(colors) <= 256 else (None, None)


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless file. Raises ValueError on anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0] + 1 & ~1
    size = struct.unpack("<I", data[at + 4 : at + 8])[0]
    body = data[at + 8 : at + 8 + size]
    if len(body) < size or body[:1] != b"\x2f":
        raise ValueError("bad lossless image")
    r = Reader(body, 8)
    w, h, _, version = r.take(14) + 1, r.take(14) + 1, r.take(1), r.take(3)
    if version:
        raise ValueError("unknown version")
    undo, width, seen = [], w, set()
    while r.take(1):
        t = r.take(2)
        if t in seen:
            raise ValueError("a transform stands twice")
        seen.add(t)
        if t == SUBTRACT_GREEN:
            undo.append((t, None, 0, width))
        elif t == PALETTE:
            n = r.take(8) + 1
            steps = _planes(_read_image(r, n, 1, False))
            colors = np.zeros(256, np.uint32)
            colors[:n] = _pixels(np.cumsum(steps, axis=1, dtype=np.int64))[0]
            undo.append((t, colors, _packing(n), width))
            width = _blocks(width, _packing(n))
        else:
            bits = r.take(3) + 2
            undo.append((t, _read_image(r, _blocks(width, bits), _blocks(h, bits), False), bits, width))
    pixels = _read_image(r, width, h, True)
    for t, data_, bits, wide in reversed(undo):
        if t == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, False)
        elif t == PALETTE:
            pixels = data_[unbundle(pixels, bits, wide)]
        elif t == PREDICTOR:
            pixels = predict_inverse(pixels, (data_ >> np.uint32(8)) & np.uint32(15), bits)
        else:
            pixels = cross_color(pixels, data_, bits, False)
    return pixels
