"""Lossless WebP (RFC 9649) in numpy: decoder and encoder of pixel arrays.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Streams with one prefix-code group and no cache are
decoded without a loop over pixels: the code that would start is looked up at every bit, jumps over
sixteen codes come from doubling, and only every sixteenth position is walked one by one.
Of many images, each step takes the next symbol of every image, and copies and cache hits are resolved by
array (``decode_many``). The encoder writes many images by array too (``encode_all``).
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np

LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE = 1 << 14
OPAQUE = 0xFF000000
CHUNK_BYTES = 1 << 17
HOP = 16


class WebPError(ValueError):
    """The bytes are not a lossless WebP image that can be read."""


@lru_cache(maxsize=1)
def near_offsets() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: by distance, then by |dx|, the right one first."""
    pairs = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(pairs, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def _count(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


class Bits:
    """Reads values of up to 32 bits, lowest bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(32), 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        lo = self.at >> 3
        out = int.from_bytes(self.data[lo : lo + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise WebPError("the stream ends early")
        return out


class Code:
    """Canonical prefix code: a table from the next ``width`` bits to symbol * 32 + length, made when it is asked for."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8).tobytes()
        self.count = len(self.lengths) - self.lengths.count(0)
        self.width = next(w for w in range(15, 0, -1) if w in self.lengths) if self.count > 1 else 0

    @cached_property
    def even(self) -> bool:
        """Whether all symbols have the same number of bits."""
        return not (self.table & 31 != self.width).any()

    @cached_property
    def table(self) -> np.ndarray:
        return _tables([self], np.array([self.width])).astype(np.int64)

    def read(self, bits: Bits) -> int:
        lo = bits.at >> 3
        v = int(self.table[int.from_bytes(bits.data[lo : lo + 4], "little") >> (bits.at & 7) & ((1 << self.width) - 1)])
        bits.at += v & 31
        return v >> 5


def _tables(codes: list[Code], widths: np.ndarray) -> np.ndarray:
    """Tables of codes one after another, each by the next bits of a width of at least its own."""
    sizes = [len(c.lengths) for c in codes]
    return _tables_of(np.frombuffer(b"".join([c.lengths for c in codes]), np.uint8), np.cumsum(sizes) - sizes, widths)


def _tables_of(lengths: np.ndarray, first: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """``_tables`` of code lengths one after another, each code's from its place in ``first``."""
    used = np.flatnonzero(lengths)
    of = np.searchsorted(first, used, side="right") - 1
    length = lengths[used].astype(np.int64)
    count = np.bincount(of, minlength=len(first))
    length[count[of] == 1] = 0
    symbol = used - first[of]
    none = np.flatnonzero(count == 0)
    if len(none):
        of, symbol, length = (np.concatenate([a, b]) for a, b in ((of, none), (symbol, 0 * none), (length, 0 * none)))
    order = (of << 21 | length << 16 | symbol).argsort()
    of, symbol, length = of[order], symbol[order], length[order]
    share = np.int64(1) << (widths[of] - length)
    if (length > widths[of]).any() or (np.bincount(of, share, len(first)) != 1 << widths).any():
        raise WebPError("a prefix code is not complete")
    straight = np.repeat((symbol << 5 | length).astype(np.int32), share)
    ends, out = np.cumsum(1 << widths).tolist(), []
    edges = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
    for lo, hi in zip(edges, edges[1:]):
        w = int(widths[lo])
        out.append(straight[ends[lo] - (1 << w) : ends[hi - 1]].reshape(-1, 1 << w).take(_reversed(w), axis=1).ravel())
    return np.concatenate(out)


@lru_cache(maxsize=256)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


@lru_cache(maxsize=256)
def _short_code(lengths: bytes) -> tuple[list[int], int]:
    """(table, bits) of a code of up to seven bits, made without arrays."""
    used = sorted((n, k) for k, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] * 32 if used else 0], 0
    width = used[-1][0]
    straight: list[int] = []
    for n, k in used:
        straight += [k * 32 + n] * (1 << (width - n))
    if len(straight) != 1 << width:
        raise WebPError("a prefix code is not complete")
    return [straight[i] for i in _reversed(width).tolist()], width


def _read_code(bits: Bits, size: int) -> Code:
    room = max(size, 256)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = bytearray(room)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _code(bytes(lengths))
    head, n = bytearray(19), 4 + bits.read(4)
    sizes = bits.read(3 * n)
    for k in LENGTH_ORDER[:n]:
        head[k] = sizes & 7
        sizes >>= 3
    (table, width), left = _short_code(bytes(head)), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    last = 8
    if not width and table[0] >> 5 < 16:
        n = min(size, left)
        return _code(bytes([table[0] >> 5]) * n + bytes(room - n))
    mask, data, pos, word, own = (1 << width) - 1, bits.data, bits.at, int.from_bytes, []
    window, spare = 0, 0
    while left and len(own) < size:
        left -= 1
        if spare < 14:  # a code of up to 7 bits and up to 7 more
            lo = pos >> 3
            window, spare = word(data[lo : lo + 8], "little") >> (pos & 7), 57
        v = table[window & mask]
        k, used = v >> 5, v & 31
        if k < 16:
            own.append(k)
            last = k or last
        else:
            more, least = (2, 3) if k == 16 else (3, 3) if k == 17 else (7, 11)
            n = least + (window >> used & ((1 << more) - 1))
            used += more
            if len(own) + n > size:
                raise WebPError("code lengths run over")
            own += [last if k == 16 else 0] * n
        window >>= used
        spare -= used
        pos += used
    bits.at = pos
    if pos > bits.end:
        raise WebPError("the stream ends early")
    return _code(bytes(own) + bytes(room - len(own)))


def _extra(code: int) -> tuple[int, int]:
    """(extra bits, base) of a length or distance prefix code; the value is base + extra + 1."""
    return (0, code) if code < 4 else ((code - 2) >> 1, (2 + (code & 1)) << ((code - 2) >> 1))


def _distance(code: int, xsize: int) -> int:
    if code > 120:
        return code - 120
    x, y = near_offsets()[code - 1]
    return max(1, x + y * xsize)


def _copy(out: np.ndarray, at: int, back: int, n: int) -> None:
    if back > at:
        raise WebPError("a back-reference starts before the image")
    if back >= n:
        out[at : at + n] = out[at - back : at - back + n]
    else:
        out[at : at + n] = np.resize(out[at - back : at], n)


def _pixels_serial(bits: Bits, groups, group_of, total: int, xsize: int, cache_bits: int) -> np.ndarray:
    """Symbol by symbol: for images with a colour cache or several prefix-code groups.

    ``group_of`` gives a position's group and the position up to which it surely holds.
    """
    cache: list[int] | None = [0] * (1 << cache_bits) if cache_bits else None
    tables = [[(c.table.tolist(), (1 << c.width) - 1) for c in g] for g in groups]
    # Colour of a literal without its green where the other three codes are of one symbol.
    fixed = [sum(t[0] >> 5 << s for (t, _), s in zip(g[1:4], (16, 0, 24))) if not any(m for _, m in g[1:4]) else None for g in tables]
    data, pos, end = bits.data, bits.at, bits.end
    out: list[int] = []
    filled, at, word, shift = 0, 0, int.from_bytes, 32 - cache_bits
    window, held, left, until = 0, 0, 0, 0

    while at < total:
        if at >= until:
            g, until = group_of(at)
            ((green, gm), (red, rm), (blue, bm), (alpha, am), (dist, dm)), base_color = tables[g], fixed[g]
        # No symbol has more bits than 72: four codes of up to 15, or two with up to 14 and 18 more bits.
        if left < 72:
            pos += held - left
            if pos > end:
                raise WebPError("the stream ends early")
            lo = pos >> 3
            window, held = word(data[lo : lo + 40], "little") >> (pos & 7), 313
            left = held
        v = green[window & gm]
        used, s = v & 31, v >> 5
        if s < 256:
            if base_color is not None:
                out.append(base_color | s << 8)
            else:
                v = red[window >> used & rm]
                color, used = s << 8 | v >> 5 << 16, used + (v & 31)
                v = blue[window >> used & bm]
                color, used = color | v >> 5, used + (v & 31)
                v = alpha[window >> used & am]
                out.append(color | v >> 5 << 24)
                used += v & 31
            at += 1
        elif s < 280:
            n, base = _extra(s - 256)
            length = base + (window >> used & ((1 << n) - 1)) + 1
            used += n
            v = dist[window >> used & dm]
            used += v & 31
            n, base = _extra(v >> 5)
            back = _distance(base + (window >> used & ((1 << n) - 1)) + 1, xsize)
            used += n
            if back > at:
                raise WebPError("a back-reference starts before the image")
            length = min(length, total - at)
            piece = out[at - back : at - back + length]
            while len(piece) < length:
                piece += piece[: length - len(piece)]
            out += piece
            at += length
        else:
            if cache is None or s - 280 >= len(cache):
                raise WebPError("a cache code without that cache entry")
            for c in out[filled:at]:
                cache[(0x1E35A7BD * c & 0xFFFFFFFF) >> shift] = c
            filled = at
            out.append(cache[s - 280])
            at += 1
        window >>= used
        left -= used
    bits.at = pos + held - left
    if bits.at > end:
        raise WebPError("the stream ends early")
    return np.array(out, np.uint32)


def _walk(bits: Bits, group, chunk: int):
    """Chain of code positions in the next chunk: (windows at every bit, green entries, positions)."""
    green, red, blue, alpha, dist = group
    lo = bits.at >> 3
    n = min(chunk, len(bits.data) - 4 - lo)
    words = np.ndarray((n,), "<u4", bits.data, lo, (1,)).astype(np.int64)
    win = (words[:, None] >> np.arange(8)).ravel()
    nb = len(win)
    val = green.table.take(win & ((1 << green.width) - 1))
    nxt = np.arange(nb) + (val & 31)
    plain = nxt
    for code in (red, blue, alpha):
        if code.width:
            v = code.table.take(win.take(plain, mode="clip") & ((1 << code.width) - 1))
            plain = plain + (v & 31)
    if green.table.max() >= 256 << 5:
        long = val >= 256 << 5
        if plain is not nxt:
            nxt = np.where(long, nxt, plain)
        at = np.flatnonzero(long)
        nxt[at] = _reference(win, val, dist, at)[2]
    else:
        nxt = plain
    nxt = np.append(np.minimum(nxt, nb), nb)
    hop = nxt
    for _ in range(HOP.bit_length() - 1):
        hop = hop.take(hop)
    limit = nb if lo + n >= len(bits.data) - 4 else nb - 256
    starts, p = [], bits.at & 7
    while p < limit:
        starts.append(p)
        p = int(hop[p])
    steps = np.empty((HOP, len(starts)), np.int64)
    cur = np.array(starts, np.int64)
    for k in range(HOP):
        steps[k] = cur
        cur = nxt.take(cur)
    chain = steps.T.ravel()
    chain = chain[: np.searchsorted(chain, limit)] if len(chain) else chain
    return win, val, nxt, chain


def _reference(win, val, dist, at):
    """(length, distance code, next position) of the back-references whose green code starts at ``at``."""
    code = (val[at] >> 5) - 256
    p = at + (val[at] & 31)
    more = np.where(code < 4, 0, (code - 2) >> 1)
    base = np.where(code < 4, code, (2 + (code & 1)) << more)
    length = base + (win.take(p, mode="clip") & ((1 << more) - 1)) + 1
    p = p + more
    d = dist.table.take(win.take(p, mode="clip") & ((1 << dist.width) - 1))
    p = p + (d & 31)
    code = d >> 5
    more = np.where(code < 4, 0, (code - 2) >> 1)
    base = np.where(code < 4, code, (2 + (code & 1)) << more)
    far = base + (win.take(p, mode="clip") & ((1 << more) - 1)) + 1
    return length, far, p + more


def _pixels_parallel(bits: Bits, group, total: int, xsize: int) -> np.ndarray:
    green, red, blue, alpha, dist = group
    if not (green.width or red.width or blue.width or alpha.width):
        if green.table[0] >> 5 >= 256:
            raise WebPError("an image of nothing but back-references")
        whole = [int(c.table[0]) >> 5 for c in (alpha, red, green, blue)]
        return np.full(total, whole[0] << 24 | whole[1] << 16 | whole[2] << 8 | whole[3], np.uint32)
    out = np.zeros(total, np.uint32)
    most = green.width + red.width + blue.width + alpha.width
    done = 0
    while done < total:
        # Do not look much further than the rest can reach in literals.
        win, val, nxt, chain = _walk(bits, group, min(CHUNK_BYTES, 96 + ((total - done) * most >> 3)))
        if not len(chain):
            raise WebPError("the stream ends early")
        sym = val[chain] >> 5
        refs = np.flatnonzero(sym >= 256)
        sizes = np.ones(len(chain), np.int64)
        if len(refs):
            length, far, _ = _reference(win, val, dist, chain[refs])
            sizes[refs] = length
        first = np.cumsum(sizes) - sizes
        need = int(np.searchsorted(first, total - done))
        chain, sym, first = chain[:need], sym[:need], first[:need]
        color = sym << 8
        p = chain + (val[chain] & 31)
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if code.width:
                v = code.table.take(win.take(p, mode="clip") & ((1 << code.width) - 1))
                color |= (v >> 5) << shift
                p = p + (v & 31)
            else:
                color |= int(code.table[0] >> 5) << shift
        color = color.astype(np.uint32)
        if len(refs):
            refs = refs[refs < need]
            literal = np.ones(need, bool)
            literal[refs] = False
            out[done + first[literal]] = color[literal]
            for k, r in enumerate(refs):
                at = done + int(first[r])
                _copy(out, at, _distance(int(far[k]), xsize), min(int(length[k]), total - at))
            done = min(total, done + int(first[-1] + sizes[need - 1]))
        else:
            out[done : done + need] = color
            done += need
        end = int(nxt[chain[-1]])
        bits.at = (bits.at >> 3) * 8 + end
    if bits.at > bits.end:
        raise WebPError("the stream ends early")
    return out


def _pixels_even(bits: Bits, group, total: int) -> np.ndarray | None:
    """Pixels of a stream whose codes give the same number of bits to every symbol and have literals only, else None."""
    codes = group[:4]
    if not all(c.even for c in codes) or group[0].table.max() >= 256 << 5:
        return None
    step = sum(c.width for c in codes)
    out, at = np.zeros(total, np.int64), bits.at + step * np.arange(total)
    bits.at += step * total
    if bits.at > bits.end:
        raise WebPError("the stream ends early")
    words = np.ndarray((len(bits.data) - 3,), "<u4", bits.data, 0, (1,))
    for code, shift in zip(codes, (8, 16, 0, 24)):
        symbol = code.table[words[at >> 3] >> (at & 7) & ((1 << code.width) - 1)] >> 5 if code.width else code.table[0] >> 5
        out |= symbol << shift
        at += code.width
    return out.astype(np.uint32)


class Stream:
    """An image's prefix codes and pixels still to read; ``bits`` is at the first code, or at the first symbol if there are ``groups``."""

    def __init__(self, bits: Bits, width: int, height: int, cache_bits: int, count: int, meta: np.ndarray | None, shift: int):
        self.bits, self.width, self.height, self.total = bits, width, height, width * height
        self.cache_bits, self.count, self.meta, self.shift = cache_bits, count, meta, shift
        self.sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
        self.groups: list[tuple[Code, ...]] = []

    def read_codes(self) -> None:
        if not self.groups:
            self.groups = [tuple(_read_code(self.bits, n) for n in self.sizes) for _ in range(self.count)]

    def group_of(self):
        """A function from a pixel's place to its group and the place up to which it surely holds."""
        rows, side, whole, width, shift = None if self.meta is None else self.meta.tolist(), 1 << self.shift, self.total, self.width, self.shift

        def of(at: int) -> tuple[int, int]:
            if rows is None:
                return 0, whole
            y, x = divmod(at, width)
            return rows[y >> shift][x >> shift], at - x + min(width, (x >> shift) * side + side)

        return of

    def serial(self) -> np.ndarray:
        return _pixels_serial(self.bits, self.groups, self.group_of(), self.total, self.width, self.cache_bits)

    def pixels(self) -> np.ndarray:
        self.read_codes()
        if self.meta is not None or self.cache_bits:
            flat = self.serial()
        else:
            flat = _pixels_even(self.bits, self.groups[0], self.total)
            if flat is None:
                flat = _pixels_parallel(self.bits, self.groups[0], self.total, self.width)
        return flat.reshape(self.height, self.width)


def _stream(bits: Bits, width: int, height: int, main: bool) -> Stream:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("a colour cache of this size is not allowed")
    meta, shift, count = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = (_read_image(bits, _count(width, shift), _count(height, shift), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        count = int(meta.max()) + 1
    return Stream(bits, width, height, cache_bits, count, meta, shift)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """(height, width) of packed ARGB."""
    return _stream(bits, width, height, main).pixels()


def _read_codes_together(streams: list[Stream]) -> None:
    """The prefix codes of all streams, one of each stream's at a time."""
    if len(streams) < FEW:
        for s in streams:
            s.read_codes()
        return
    data = b"".join([s.bits.data for s in streams]) + bytes(64)
    words = np.ndarray((len(data) - 7,), "<i8", data, 0, (1,))
    base = np.cumsum([0] + [len(s.bits.data) for s in streams[:-1]]) * 8
    pos = base + [s.bits.at for s in streams]
    end = base + [s.bits.end for s in streams]
    counts = np.array([s.count for s in streams])
    sizes = np.array([s.sizes for s in streams])
    codes: list[list[Code]] = [[] for _ in streams]
    for g in range(int(counts.max())):
        on = np.flatnonzero(counts > g)
        for k in range(5):
            lengths, pos[on] = _lengths_together(words, pos[on], end[on], sizes[on, k])
            for i, own in zip(on.tolist(), lengths):
                codes[i].append(_code(own))
    for s, own, at in zip(streams, codes, (pos - base).tolist()):
        s.groups = [tuple(own[i : i + 5]) for i in range(0, len(own), 5)]
        s.bits.at = at


def _lengths_together(words: np.ndarray, pos: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Lengths as ``_read_code`` reads them of a code at each place, and the places after them."""
    room = np.maximum(size, 256)
    first = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    w = words[pos >> 3] >> (pos & 7)
    short = (w & 1) == 1
    two, wide = w >> 1 & 1, w >> 2 & 1
    out[(first + (w >> 3 & np.where(wide, 255, 1)))[short]] = 1
    both = short & (two == 1)
    out[(first + (w >> np.where(wide, 11, 4) & 255))[both]] = 1
    after = pos + np.where(wide, 11, 4) + 8 * two
    lane = np.flatnonzero(~short)
    if len(lane):
        n, p = 4 + (w[lane] >> 1 & 15), pos[lane] + 5
        w = words[p >> 3] >> (p & 7)
        head = np.zeros((len(lane), 19), np.uint8)
        for i, k in enumerate(LENGTH_ORDER):
            head[:, k] = np.where(i < n, w >> 3 * i & 7, 0)
        p += 3 * n
        w = words[p >> 3] >> (p & 7)
        more = 2 + 2 * (w >> 1 & 7)
        some = w & 1
        left = np.where(some, 2 + (w >> 4 & ((1 << more) - 1)), size[lane])
        p += np.where(some, 4 + more, 1)
        # Entries by seven bits: the symbol, the least repeats, the extra bits and all bits.
        table = _tables_of(head.ravel(), 19 * np.arange(len(lane)), np.full(len(lane), 7)).astype(np.int64)
        symbol = table >> 5
        extra, least = np.zeros(19, np.int64), np.ones(19, np.int64)
        extra[16:], least[16:] = (2, 3, 7), (3, 3, 11)
        length, extra, least = table & 31, extra[symbol], least[symbol]
        row, filled, last = np.arange(len(lane)), np.zeros(len(lane), np.int64), np.full(len(lane), 8)
        rows, values, repeats, top = [], [], [], size[lane]
        while len(row):
            at = 128 * row + (words[p >> 3] >> (p & 7) & 127)
            k, used, more = symbol.take(at), length.take(at), extra.take(at)
            q = p + used
            n = least.take(at) + (words[q >> 3] >> (q & 7) & ((1 << more) - 1))
            last = np.where((k > 0) & (k < 16), k, last)
            rows.append(row)
            values.append(np.where(k < 16, k, np.where(k == 16, last, 0)).astype(np.uint8))
            repeats.append(n)
            filled = filled + n
            left = left - 1
            p = q + more
            on = (left > 0) & (filled < top)
            if not on.all():
                done = ~on
                if (filled[done] > top[done]).any():
                    raise WebPError("code lengths run over")
                after[lane[row[done]]] = p[done]
                row, p, left, filled, last, top = row[on], p[on], left[on], filled[on], last[on], top[on]
            if (p > end[lane[row]]).any():
                raise WebPError("the stream ends early")
        rows = np.concatenate(rows)
        order = np.argsort(rows.astype(np.uint16) if len(lane) < 1 << 16 else rows, kind="stable")
        n = np.concatenate(repeats)[order]
        rows = np.repeat(rows[order], n)
        new = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(new, np.diff(new, append=len(rows)))
        out[first[lane][rows] + place] = np.repeat(np.concatenate(values)[order], n)
    if (after > end).any():
        raise WebPError("the stream ends early")
    data = out.tobytes()
    return [data[a : a + n] for a, n in zip(first.tolist(), room.tolist())], after


#: Images read side by side; with fewer left, or where codes are longer than a window, each is read alone.
FEW = 64
STEPS_UNCHECKED = 16
RESOLVED_AT_ONCE = 1 << 17
UNDONE_AT_ONCE = 1 << 19
WINDOW = 57


def _pixels_together(streams: list[Stream]) -> list[np.ndarray]:
    """Pixels of many images: first the places of all symbols, one of each image in a step, then colours by array."""
    _read_codes_together(streams)
    out: list = [None] * len(streams)
    kinds: dict[tuple, list[int]] = {}
    for i, s in enumerate(streams):
        widths = [[c.width for c in g] for g in s.groups]
        if max(max(sum(w[:4]), w[0] + 14 + w[4] + 18) for w in widths) <= WINDOW and max(map(max, widths)) <= 12:
            if len(widths) > 1 or any(widths[0][:4]):
                kinds.setdefault((len(widths) > 1 or any(widths[0][1:4]), len(widths) > 1), []).append(i)
    for (rich, several), own in kinds.items():
        if len(own) > 1:
            for i, flat in zip(own, _Together([streams[i] for i in own], rich, several).pixels()):
                out[i] = flat
    return [(s.pixels() if flat is None else flat).reshape(s.height, s.width) for flat, s in zip(out, streams)]


class _Together:
    """Streams of one kind, read side by side.

    All five tables of a group have the same number of entries, one after another. ``lengths`` has the bits
    that a symbol takes with its extra bits; 64 more for a back-reference and 128 more for a cache hit.
    """

    def __init__(self, streams: list[Stream], rich: bool, several: bool):
        self.streams, self.rich, self.several = streams, rich, several
        data = b"".join([s.bits.data for s in streams]) + bytes(16 * STEPS_UNCHECKED + 16)
        self.words = np.ndarray((len(data) - 7,), "<i8", data, 0, (1,))
        base = np.cumsum([0] + [len(s.bits.data) for s in streams[:-1]]) * 8
        self.start = base + [s.bits.at for s in streams]
        self.end = base + [s.bits.end for s in streams]
        self.totals = np.array([s.total for s in streams])
        width = [max(c.width for g in s.groups for c in g) for s in streams]
        self.size = np.int64(1) << np.array(width)
        self.mask = self.size - 1
        counts = np.array([len(s.groups) for s in streams])
        self.group = np.cumsum(counts) - counts
        # Tables of one size are next to each other.
        widths, groups = np.repeat(np.array(width), counts), [g for s in streams for g in s.groups]
        order = np.argsort(widths, kind="stable")
        widths = widths[order]
        sizes = np.int64(1) << widths
        self.group_at = np.empty(len(order), np.int64)
        self.group_at[order] = 5 * (np.cumsum(sizes) - sizes)
        self.table = _tables([c for i in order.tolist() for c in groups[i]], np.repeat(widths, 5))
        role = np.repeat(np.tile(np.arange(5, dtype=np.uint8), len(sizes)), np.repeat(sizes, 5))
        symbol, bits = self.table >> 5, (self.table & 31).astype(np.uint8)
        of = np.flatnonzero((role == 0) & (symbol >= 256) & (symbol < 280))
        bits[of] += (64 + _extras(symbol[of] - 256)[0]).astype(np.uint8)
        bits[(role == 0) & (symbol >= 280)] += 128
        of = np.flatnonzero(role == 4)
        bits[of] += _extras(symbol[of])[0].astype(np.uint8)
        self.lengths = bits
        if several:
            # The group of each pixel.
            self.first = np.cumsum(self.totals) - self.totals
            parts = []
            for s, g in zip(streams, self.group.tolist()):
                wide = np.repeat(np.repeat(s.meta, 1 << s.shift, axis=0)[: s.height], 1 << s.shift, axis=1)[:, : s.width]
                parts.append((wide.astype(np.int64) + g).ravel())
            self.pixel_at = self.group_at[np.concatenate(parts)]

    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(stream, place in bits, place of its group's tables where there are several) of symbols; some may follow a stream's last one."""
        words, lengths, rich, several = self.words, self.lengths, self.rich, self.several
        lane = np.arange(len(self.streams))
        pos, at = self.start.copy(), np.zeros(len(lane), np.int64)
        lanes, places, tables = [], [], []
        while len(lane) >= FEW:
            mask, size, end = self.mask[lane], self.size[lane], self.end[lane]
            o0 = self.group_at[self.group[lane]]
            if several:
                first, last = self.first[lane], self.totals[lane] - 1
            o1, o2, o3, o4 = (o0 + size * k for k in range(1, 5))
            steps = np.empty((STEPS_UNCHECKED, len(lane)), np.int64)
            used_tables = np.empty((STEPS_UNCHECKED, len(lane)), np.int64) if several else None
            for k in range(STEPS_UNCHECKED):
                steps[k] = pos
                if several:
                    o0 = self.pixel_at.take(first + np.minimum(at, last))
                    o1, o4 = o0 + size, o0 + 4 * size
                    o2, o3 = o1 + size, o4 - size
                    used_tables[k] = o0
                w = words[pos >> 3] >> (pos & 7)
                u = lengths.take(o0 + (w & mask))
                if rich:
                    literal = u < 64
                    used = u & 63
                    v = w >> used
                    r = lengths.take(np.where(literal, o1, o4) + (v & mask))
                    v >>= r
                    b = lengths.take(o2 + (v & mask))
                    v >>= b
                    b += lengths.take(o3 + (v & mask))
                    b *= literal
                    r *= u < 128
                    if several:
                        on = np.flatnonzero(u >> 6 == 1)
                        at += 1
                        if len(on):
                            v = self.table[o0[on] + (w[on] & mask[on])]
                            more, low = _extras((v >> 5) - 256)
                            at[on] += low + ((w[on] >> (v & 31)) & ((1 << more) - 1))
                    used += r
                    used += b
                    pos = pos + used
                else:
                    on = np.flatnonzero(u >= 64)
                    if len(on):
                        u, some = u & 63, on[u[on] < 128]
                        u[some] += lengths[o4[some] + (w[some] >> u[some] & mask[some])]
                    pos = pos + u
            lanes.append(np.tile(lane.astype(np.uint16 if len(self.streams) < 1 << 16 else np.int64), STEPS_UNCHECKED))
            places.append(steps.ravel())
            if several:
                tables.append(used_tables.ravel())
            # Symbols without bits may follow the last bit only where a group has no others.
            keep = (pos <= end) & (at < self.totals[lane]) if several else pos < end
            if not keep.all():
                lane, pos, at = lane[keep], pos[keep], at[keep]
        for i, p, a in zip(lane.tolist(), pos.tolist(), at.tolist()):
            more, used = self._alone(i, p, a)
            lanes.append(np.full(len(more), i, np.uint16 if len(self.streams) < 1 << 16 else np.int64))
            places.append(np.array(more, np.int64))
            tables.append(np.array(used, np.int64))
        lanes = np.concatenate(lanes)
        order = np.argsort(lanes, kind="stable")
        return lanes[order], np.concatenate(places)[order], np.concatenate(tables)[order] if several else None

    def _alone(self, i: int, pos: int, at: int) -> tuple[list[int], list[int]]:
        """The places of a stream's further symbols, and those of their tables where there are several."""
        s, mask, total = self.streams[i], int(self.mask[i]), int(self.totals[i])
        data, base = s.bits.data, int(self.start[i]) - s.bits.at
        pos, end, word, size = pos - base, s.bits.end, int.from_bytes, mask + 1
        first = self.group_at[self.group[i] : self.group[i] + len(s.groups)].tolist()
        groups = [[self.lengths[o + k * size : o + k * size + size].tolist() for k in range(5)] for o in first]
        green, red, blue, alpha, dist = groups[0]
        rich, several, group_of = self.rich, self.several, s.group_of()
        places, tables, left, window, until = [], [], 0, 0, 0
        while pos < end + several and at < total:
            if several and at >= until:
                g, until = group_of(at)
                (green, red, blue, alpha, dist), o = groups[g], first[g]
            if left < WINDOW:
                lo = pos >> 3
                window, left = word(data[lo : lo + 40], "little") >> (pos & 7), 313
            places.append(pos)
            u = green[window & mask]
            if u < 64:
                if rich:
                    w = window >> u
                    v = red[w & mask]
                    w >>= v
                    u += v
                    v = blue[w & mask]
                    u += v + alpha[w >> v & mask]
                n = 1
            elif u < 128:
                n = 1
                if several:
                    v = int(self.table[o + (window & mask)])
                    more, low = _extra((v >> 5) - 256)
                    n = low + (window >> (v & 31) & ((1 << more) - 1)) + 1
                u -= 64
                u += dist[window >> u & mask]
            else:
                u, n = u - 128, 1
            if several:
                tables.append(o)
                at += n
            window >>= u
            left -= u
            pos += u
        return [base + p for p in places], tables

    def pixels(self) -> list[np.ndarray]:
        lanes, places, tables = self._places()
        counts = np.bincount(lanes, minlength=len(self.streams))
        cut = np.concatenate([[0], np.cumsum(counts)])
        part = (np.cumsum(self.totals) - self.totals) // RESOLVED_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(self.streams)]
        out = []
        for lo, hi in zip(edges, edges[1:]):
            on = slice(cut[lo], cut[hi])
            lane = lanes[on].astype(np.int64)
            out += self._resolved(lo, hi, lane, places[on], tables[on] if self.several else self.group_at[self.group[lane]])
        return out

    def _look(self, at: np.ndarray, p: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.table.take(at + (self.words[p >> 3] >> (p & 7) & mask))

    def _more(self, code: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value from 1, extra bits) of length or distance codes whose extra bits are at ``p``."""
        more, low = _extras(code.astype(np.int64))
        return low + (self.words[p >> 3] >> (p & 7) & ((np.int64(1) << more) - 1)) + 1, more

    def _resolved(self, lo: int, hi: int, lane: np.ndarray, p: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
        """Pixels of the streams from ``lo`` to before ``hi`` by their symbols' places."""
        streams, totals = self.streams[lo:hi], self.totals[lo:hi]
        first = np.cumsum(totals) - totals
        mask, size = self.mask[lane], self.size[lane]
        v = self._look(o, p, mask)
        symbol, p = v >> 5, p + (v & 31)
        ref = np.flatnonzero((symbol >= 256) & (symbol < 280))
        width = np.array([s.width for s in streams])[lane[ref] - lo]
        lengths, more = self._more(symbol[ref] - 256, p[ref])
        q = p[ref] + more
        d = self._look(o[ref] + 4 * size[ref], q, mask[ref])
        q += d & 31
        far, more = self._more(d >> 5, q)
        near = np.array(near_offsets())[np.minimum(far, 120) - 1]
        far = np.where(far > 120, far - 120, np.maximum(1, near[:, 0] + near[:, 1] * width))
        sizes = np.ones(len(p), np.int64)
        sizes[ref] = lengths
        p[ref] = q + more
        # Places in each image; what follows its last pixel is no symbol.
        ends = np.cumsum(sizes)
        heads = np.searchsorted(lane, np.arange(lo, hi))
        at = ends - sizes
        at -= at[heads][lane - lo]
        inside = at < totals[lane - lo]
        literal = np.flatnonzero((symbol < 256) & inside)
        color = symbol[literal].astype(np.int64) << 8
        if self.rich:
            x, q, m, table, step = o[literal], p[literal], mask[literal], self.table, size[literal]
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                w = table.take(x + k * step + (self.words[q >> 3] >> (q & 7) & m))
                color |= (w >> 5).astype(np.int64) << shift
                q += w & 31
            p[literal] = q
        else:
            # One group, in which the other three samples are the same everywhere.
            x, step = self.group_at[self.group], self.size
            same = sum((self.table[x + k * step] >> 5).astype(np.int64) << shift for k, shift in ((1, 16), (2, 0), (3, 24)))
            color |= same[lane[literal]]
        last = np.searchsorted(lane, np.arange(lo, hi), side="right") - 1
        kept = heads + np.add.reduceat(inside.astype(np.int64), heads) - 1
        if (at[last] + sizes[last] < totals).any() or (p[kept] > self.end[lo:hi]).any():
            raise WebPError("the stream ends early")
        start = first[lane - lo] + at
        ok = inside[ref]
        ref, far = ref[ok], far[ok]
        if (far > at[ref]).any():
            raise WebPError("a back-reference starts before the image")
        n = np.minimum(sizes[ref], totals[lane[ref] - lo] - at[ref])
        flat, parent = np.zeros(int(totals.sum()), np.uint32), np.arange(int(totals.sum()))
        flat[start[literal]] = color
        copied = np.arange(int(n.sum())) + np.repeat(start[ref] - np.cumsum(n) + n, n)
        parent[copied] = copied - np.repeat(far, n)
        hit = np.flatnonzero((symbol >= 280) & inside)
        alone = []
        if len(hit):
            alone = self._hits(lo, hi, lane, totals, flat, parent, copied, start[hit], lane[hit] - lo, symbol[hit] - 280)
            copied = np.concatenate([copied, start[hit]])
        flat[copied] = flat[_roots(parent, copied)]
        out = np.split(flat, first[1:])
        for i in alone:
            out[i] = streams[i].serial()
        return out

    def _hits(self, lo: int, hi: int, lane, totals, flat, parent, copied, hit, of, slot_hit) -> list[int]:
        """Sets the parent of each cache hit, the last pixel before in its slot; returns streams that hit slots never filled."""
        bits = np.array([s.cache_bits for s in self.streams[lo:hi]])
        bit = np.repeat(np.where(bits > 0, 32 - bits, 31).astype(np.uint32), totals)
        slot = (flat * np.uint32(0x1E35A7BD) >> bit).astype(np.int64)
        slot[hit] = slot_hit
        slot[copied] = slot[_roots(parent, copied)]
        key = (np.repeat(np.arange(hi - lo), totals) << 11 | slot) << 32 | np.arange(len(flat))
        key.sort()
        place = key & 0xFFFFFFFF
        before = np.full(len(flat), -1, np.int64)
        same = key[1:] >> 32 == key[:-1] >> 32
        before[place[1:][same]] = place[:-1][same]
        parent[hit] = before[hit]
        never = parent[hit] < 0
        parent[hit[never]] = hit[never]
        return np.unique(of[never]).tolist()


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last ancestor of each of ``at``; all others are their own parents."""
    left = at
    while len(left):
        up = parent[left]
        above = parent[up]
        parent[left] = above
        left = left[above != up]
    return parent[at]


def _extras(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_extra`` of each code."""
    more = np.where(code < 4, 0, (code - 2) >> 1)
    return more, np.where(code < 4, code, (2 + (code & 1)) << more)


def _planes(argb: np.ndarray) -> np.ndarray:
    """(..., 4) signed samples in the order alpha, red, green, blue."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)[..., ::-1].astype(np.int32)


def _packed(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes[..., ::-1].astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def _added(planes: np.ndarray) -> np.ndarray:
    return planes[..., 0] + planes[..., 1] + planes[..., 2] + planes[..., 3]


def predicted(mode: np.ndarray, left, top, top_left, top_right) -> np.ndarray:
    """Predictions (n, 4) by each pixel's mode, from its decoded neighbours (n, 4)."""
    out = np.zeros_like(left)
    avg = lambda a, b: (a + b) >> 1

    def pick(l, t, tl):  # noqa: E741
        return np.where((_added(np.abs(t - tl)) < _added(np.abs(l - tl)))[:, None], l, t)

    def half(l, t, tl):  # noqa: E741
        d = avg(l, t) - tl
        return np.clip(avg(l, t) + np.where(d < 0, -((-d) >> 1), d >> 1), 0, 255)

    rules = (
        lambda l, t, tl, tr: np.array([255, 0, 0, 0], l.dtype), lambda l, t, tl, tr: l, lambda l, t, tl, tr: t, lambda l, t, tl, tr: tr, lambda l, t, tl, tr: tl,
        lambda l, t, tl, tr: avg(avg(l, tr), t), lambda l, t, tl, tr: avg(l, tl), lambda l, t, tl, tr: avg(l, t), lambda l, t, tl, tr: avg(tl, t),
        lambda l, t, tl, tr: avg(t, tr), lambda l, t, tl, tr: avg(avg(l, tl), avg(t, tr)), lambda l, t, tl, tr: pick(l, t, tl),
        lambda l, t, tl, tr: np.clip(l + t - tl, 0, 255), lambda l, t, tl, tr: half(l, t, tl),
    )
    kinds = np.flatnonzero(np.bincount(mode, minlength=16)[:14]) if len(mode) else ()
    for k in kinds:
        on = slice(None) if len(kinds) == 1 else np.flatnonzero(mode == k)
        out[on] = rules[k](left[on], top[on], top_left[on], top_right[on])
    return out


def _waves(height: int, width: int):
    """Pixels (y, x) in an order in which left, top and top-right neighbours come before."""
    for t in range(width + 2 * (height - 1)):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        yield y, t - 2 * y


def _neighbours(img: np.ndarray, y: np.ndarray, x: np.ndarray):
    """left, top, top-left, top-right of each pixel; beyond the right edge the row's own first pixel."""
    w = img.shape[1]
    up = np.maximum(y - 1, 0)
    right = np.where(x + 1 < w, x + 1, 0)
    return img[y, x - 1], img[up, x], img[up, x - 1], img[np.where(x + 1 < w, up, y), right]


def _mode_of(data: np.ndarray, shift: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    mode = (data[y >> shift, x >> shift] >> np.uint32(8)).astype(np.int64) & 15
    mode = np.where(y == 0, 1, np.where(x == 0, 2, mode))
    return np.where((y == 0) & (x == 0), 0, mode)


def _undo_predictor(argb: np.ndarray, shift: int, data: np.ndarray) -> np.ndarray:
    rest, img = _planes(argb), np.zeros((*argb.shape, 4), np.int32)
    for y, x in _waves(*argb.shape):
        img[y, x] = (rest[y, x] + predicted(_mode_of(data, shift, y, x), *_neighbours(img, y, x))) & 255
    return _packed(img)


def _undo_predictors(jobs: list[tuple[np.ndarray, int, np.ndarray]]) -> list[np.ndarray]:
    """``_undo_predictor`` of each (image, shift, modes): a wave has the pixels of all images whose neighbours are there."""
    rest = _planes(np.concatenate([a.ravel() for a, _, _ in jobs]))
    turn, mode, width = [], [], []
    for argb, shift, data in jobs:
        y, x = (i.ravel() for i in np.indices(argb.shape))
        turn.append(x + 2 * y)
        mode.append(_mode_of(data, shift, y, x))
        width.append(np.full(argb.size, argb.shape[1]))
    turn, mode, width = np.concatenate(turn), np.concatenate(mode), np.concatenate(width)
    order = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn))
    rest, mode, width, img = rest[order], mode[order], width[order], np.zeros_like(rest)
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
        at = order[lo:hi]
        top = at - width[lo:hi]
        # Neighbours beyond an image's first row or column are in no rule that is used there.
        near = (np.take(img, i, axis=0, mode="clip") for i in (at - 1, top, top - 1, top + 1))
        img[at] = (rest[lo:hi] + predicted(mode[lo:hi], *near)) & 255
    flat, cut = _packed(img), np.cumsum([a.size for a, _, _ in jobs])[:-1]
    return [part.reshape(a.shape) for part, (a, _, _) in zip(np.split(flat, cut), jobs)]


def _signed(a: np.ndarray) -> np.ndarray:
    return ((a + 128) & 255) - 128


def _cross(argb: np.ndarray, shift: int, data: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (sign -1) the share of green in red and blue and of red in blue."""
    y, x = np.indices(argb.shape)
    return _crossed(argb, data[y >> shift, x >> shift], sign)


def _crossed(argb: np.ndarray, factors: np.ndarray, sign: int) -> np.ndarray:
    """``_cross`` with the factors of each pixel."""
    p, e = _planes(argb), _planes(factors)
    by = lambda t, c: (_signed(t) * _signed(c)) >> 5
    red = (p[..., 1] + sign * by(e[..., 3], p[..., 2])) & 255
    whole = red if sign > 0 else p[..., 1]
    p[..., 3] = (p[..., 3] + sign * (by(e[..., 2], p[..., 2]) + by(e[..., 1], whole))) & 255
    p[..., 1] = red
    return _packed(p)


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    p = _planes(argb)
    p[..., 1] += sign * p[..., 2]
    p[..., 3] += sign * p[..., 2]
    return _packed(p)


def _bundle_bits(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def _undo_palette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = ((argb >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    bundle = _bundle_bits(len(palette))
    if bundle:
        size = 8 >> bundle
        index = ((index[:, :, None] >> (np.arange(1 << bundle) * size)) & ((1 << size) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def _parsed(data: bytes) -> tuple[np.ndarray, list[tuple]]:
    """The coded image of a lossless WebP file, and the transforms to undo, the last one first to undo."""
    stream, undo = _opened(data)
    return stream.pixels(), undo


def _opened(data: bytes) -> tuple[Stream, list[tuple]]:
    """``_parsed`` with the image's pixels not yet read."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise WebPError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            shift = bits.read(3) + 2
            sub = _read_image(bits, _count(inner, shift), _count(height, shift), False)
            undo.append((kind, shift, sub))
        elif kind == GREEN:
            undo.append((kind,))
        else:
            n = bits.read(8) + 1
            steps = _planes(_read_image(bits, n, 1, False)[0])
            palette = _packed(np.cumsum(steps, axis=0))
            undo.append((kind, palette, inner))
            inner = _count(inner, _bundle_bits(n))
    return _stream(bits, inner, height, True), undo


def _undone(argb: np.ndarray, kind: int, *known) -> np.ndarray:
    if kind == PREDICTOR:
        return _undo_predictor(argb, *known)
    if kind == CROSS:
        return _cross(argb, *known, 1)
    return _green(argb, 1) if kind == GREEN else _undo_palette(argb, *known)


def decode(data: bytes) -> np.ndarray:
    """Packed ARGB (height, width), uint32, of a lossless WebP file."""
    argb, undo = _parsed(data)
    for step in reversed(undo):
        argb = _undone(argb, *step)
    return argb


def pixels_of(data: bytes) -> int:
    """Pixels that a file's header promises; 0 where there is no header."""
    head = int.from_bytes(data[21:25], "little")
    return ((head & 16383) + 1) * ((head >> 14 & 16383) + 1) if len(data) > 24 else 0


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` of each file; pixels are read and predictors undone in waves over all images at once."""
    opened = [_opened(f) for f in files]
    out, todo = _pixels_together([s for s, _ in opened]), [u for _, u in opened]
    while any(todo):
        waiting = []
        for i, undo in enumerate(todo):
            while undo and undo[-1][0] != PREDICTOR:
                out[i] = _undone(out[i], *undo.pop())
            if undo:
                waiting.append(i)
        if waiting:
            part = np.cumsum([out[i].size for i in waiting]) // UNDONE_AT_ONCE
            for k in np.unique(part).tolist():
                some = [waiting[j] for j in np.flatnonzero(part == k).tolist()]
                for i, argb in zip(some, _undo_predictors([(out[i], *todo[i].pop()[1:]) for i in some])):
                    out[i] = argb
    return out


# ---------------------------------------------------------------- encoder


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Concatenates values of up to 20 bits, lowest bit first."""
    at = np.cumsum(sizes) - sizes
    word, shift = at >> 5, at & 31
    n = int(at[-1] + sizes[-1] + 7) // 8 if len(at) else 0
    # A word's values are disjoint bits, their sum stays exact in a double.
    total = np.bincount(word, np.ldexp(values.astype(np.float64), shift.astype(np.int32)), n // 4 + 2).astype(np.int64)
    out = (total & 0xFFFFFFFF).astype(np.uint32)
    out[1:] |= (total[:-1] >> 32).astype(np.uint32)
    return out.astype("<u4").tobytes()[:n]


def code_lengths(counts: np.ndarray, longest: int = 15) -> np.ndarray:
    """Lengths of a complete prefix code, near the best for these counts and at most ``longest``."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    never = 2 * int(weight.sum()) + 1
    while True:
        order = np.argsort(weight, kind="stable")
        w = weight[order].tolist()
        n = len(w)
        # Where leaves or merged nodes are at an end, they weigh more than any other.
        parent, merged, i, j = [0] * (2 * n - 1), [never] * (n + 1), 0, 0
        w += [never, never]
        for k in range(n, 2 * n - 1):
            a, b = merged[j], w[i]
            if b <= a:
                parent[i] = k
                i += 1
                pair, b = b, w[i]
            else:
                parent[n + j] = k
                j += 1
                pair, a = a, merged[j]
            if b <= a:
                parent[i] = k
                i += 1
                merged[k - n] = pair + b
            else:
                parent[n + j] = k
                j += 1
                merged[k - n] = pair + a
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            out[used[order]] = depth[:n]
            return out
        weight = np.maximum(weight, 2 * weight.min()) if weight.min() * 2 <= weight.max() else np.ones_like(weight)
        never = 2 * int(weight.sum()) + 1


def codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, ready to write lowest bit first."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths[used].max())
    share = 1 << (width - lengths[used])
    out[used] = _reversed(width)[np.cumsum(share) - share]
    return out


def _run_lengths(lengths: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, extra, extra bits) of code lengths up to the last one of ``used``, with runs of eleven zeros or more as one token."""
    before = np.empty(len(used), np.int64)
    before[0], before[1:] = -1, used[:-1]
    wide = np.flatnonzero(used - before > 11)
    zeros = zip((before[wide] + 1).tolist(), used[wide].tolist()) if len(wide) else ()
    extra, size = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not zeros:
        return lengths, extra, size
    tokens, keep = lengths.copy(), np.ones(len(lengths), bool)
    for a, b in zeros:
        while b - a > 10:
            n = min(b - a, 138)
            tokens[a], extra[a], size[a] = 18, n - 11, 7
            keep[a + 1 : a + n] = False
            a += n
    return tokens[keep], extra[keep], size[keep]


class Writer:
    """Collects (value, bits) pieces."""

    def __init__(self):
        self.values, self.sizes = [], []
        self.late, self.late_sizes = [], []

    def put(self, value: int, size: int) -> None:
        if size:
            self.late.append(value)
            self.late_sizes.append(size)

    def _settle(self) -> None:
        if self.late:
            self.values.append(np.array(self.late, np.int64))
            self.sizes.append(np.array(self.late_sizes, np.int64))
            self.late, self.late_sizes = [], []

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._settle()
        self.values.append(values)
        self.sizes.append(sizes)

    def code(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes a prefix code; returns the codes and sizes to write symbols with."""
        used = np.flatnonzero(lengths)
        if len(used) < 2 and (not len(used) or used[0] < 256):
            s = int(used[0]) if len(used) else 0
            self.many(np.array([1, 0, 1, s]), np.array([1, 1, 1, 8]))
            return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        n = max(2, int(used[-1]) + 1)
        tokens, extra, extra_size = _run_lengths(lengths[:n], used)
        inner = code_lengths(np.bincount(tokens, minlength=19), 7)
        last = max(4, max(i + 1 for i, k in enumerate(LENGTH_ORDER) if inner[k]))
        self.many(np.array([0, last - 4]), np.array([1, 4]))
        self.many(inner[list(LENGTH_ORDER[:last])], np.full(last, 3))
        if len(tokens) < 2:
            self.put(0, 1)
            tokens, extra, extra_size = lengths, np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        else:
            self.many(np.array([1, 4, len(tokens) - 2]), np.array([1, 3, 10]))
        size = inner if np.count_nonzero(inner) > 1 else np.zeros(19, np.int64)
        self.many(np.stack([codes(inner)[tokens], extra], axis=1).ravel(), np.stack([size[tokens], extra_size], axis=1).ravel())
        if len(used) < 2:
            return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        return codes(lengths), lengths

    def bytes(self) -> bytes:
        self._settle()
        return pack_bits(np.concatenate(self.values), np.concatenate(self.sizes))


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, extra) of a length or distance value from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    half = (v >> (n - 1)) & 1
    return 2 * n + half, n - 1, v & ((1 << (n - 1)) - 1)


@lru_cache(maxsize=2)
def _flat_code(size: int) -> tuple[np.ndarray, np.ndarray]:
    """A prefix code that gives eight bits to each of the first 256 symbols."""
    w = Writer()
    w.code(np.concatenate([np.full(256, 8), np.zeros(size - 256, np.int64)]))
    w._settle()
    return np.concatenate(w.values), np.concatenate(w.sizes)


def _write_small(w: Writer, argb: np.ndarray) -> None:
    """A sub-image as plain bytes: eight bits for each sample of a channel that varies, none for others."""
    p = _planes(argb).reshape(-1, 4)
    varies = (p != p[0]).any(axis=0)
    w.put(0, 1)
    for channel, size in ((2, 280), (1, 256), (3, 256), (0, 256)):
        if varies[channel]:
            w.many(*_flat_code(size))
        else:
            w.many(np.array([1, 0, 1, int(p[0, channel])]), np.array([1, 1, 1, 8]))
    w.many(np.array([1, 0, 1, 0]), np.array([1, 1, 1, 8]))
    # The code of eight-bit literals in numeric order is the byte with its bits reversed.
    values = _reversed(8)[p[:, [c for c in (2, 1, 3, 0) if varies[c]]]].ravel()
    w.many(values, np.full(len(values), 8))


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """Distance in pixels -> the smallest short distance code for it."""
    out: dict[int, int] = {}
    for code, (dx, dy) in enumerate(near_offsets(), 1):
        out.setdefault(dx + dy * width, code)
    return out


def _last_equal(keys: np.ndarray) -> np.ndarray:
    """Position of the last earlier entry with the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


LONGEST_COPY = 4096


def _matches(flat: np.ndarray, width: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy (position, length, distance) of back-references: to where the next ``least`` pixels came last, or above."""
    if len(flat) <= least:
        return []
    count = len(flat) - least + 1
    keys = np.zeros(count, np.uint64)
    for k in range(least):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + count]
    last = _last_equal(keys)
    found, last, px, out, at = np.flatnonzero(last >= 0).tolist(), last.tolist(), flat.tolist(), [], 0
    for i in found:
        if i < at:
            continue
        best, back = 0, 0
        end = min(len(px), i + LONGEST_COPY)
        for d in (i - last[i], width):
            if d > i or d == back:
                continue
            j = i
            while j < end and px[j] == px[j - d]:
                j += 1
            if j - i > best:
                best, back = j - i, d
        if best >= least:
            out.append((i, best, back))
            at = i + best
    return out


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra bits, extra) of length or distance values from 1."""
    v = values - 1
    n = np.maximum(np.frexp(v.astype(np.float64))[1] - 2, 0).astype(np.int64)
    n[v < 4] = 0
    return np.where(v < 4, v, 2 * n + 2 + ((v >> n) & 1)), n, np.where(v < 4, 0, v & ((1 << n) - 1))


def _wrap(w: Writer) -> bytes:
    return _wrapped(w.bytes())


def _wrapped(body: bytes) -> bytes:
    chunk = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(chunk)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + chunk


def _start(height: int, width: int) -> Writer:
    w = Writer()
    w.many(np.array([0x2F, width - 1, height - 1, 1, 0]), np.array([8, 14, 14, 1, 3]))
    return w


class Stack:
    """Images of any sizes, their pixels one after another."""

    def __init__(self, height, width):
        self.height, self.width = np.asarray(height, np.int64), np.asarray(width, np.int64)
        self.sizes = self.height * self.width
        self.count, self.total = len(self.sizes), int(self.sizes.sum())
        self.first = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(self.count), self.sizes)

    @cached_property
    def wide(self) -> np.ndarray:
        return self.width[self.of]

    @cached_property
    def y(self) -> np.ndarray:
        return (np.arange(self.total) - self.first[self.of]) // self.wide

    @cached_property
    def x(self) -> np.ndarray:
        return np.arange(self.total) - self.first[self.of] - self.y * self.wide

    def blocks(self, shift: int) -> tuple[Stack, np.ndarray]:
        """(images of a pixel for each block, the block of each pixel)."""
        small = Stack(_count(self.height, shift), _count(self.width, shift))
        return small, small.first[self.of] + (self.y >> shift) * small.width[self.of] + (self.x >> shift)

    def neighbours(self, planes: np.ndarray):
        """As ``_neighbours`` of each pixel."""
        at = np.arange(self.total)
        left = at - 1 + np.where(self.x == 0, self.wide, 0)
        up = np.where(self.y == 0, 0, self.wide)
        right = np.where(self.x + 1 < self.wide, at + 1 - up, at + 1 - self.wide)
        return planes[left], planes[at - up], planes[left - up], planes[right]


class Writers:
    """Collects (value, bits) pieces of several images, each piece at the end of its image's."""

    def __init__(self, count: int):
        self.count = count
        self.owners, self.values, self.sizes = [], [], []

    def each(self, values, sizes, owners: np.ndarray | None = None) -> None:
        """A row of values for each image; ``sizes`` is a row for all of them."""
        owners = np.arange(self.count) if owners is None else owners
        values = np.broadcast_to(np.stack(np.broadcast_arrays(*values), axis=-1).reshape(-1, len(sizes)), (len(owners), len(sizes)))
        self.many(np.repeat(owners, len(sizes)), values.ravel(), np.tile(np.asarray(sizes), len(owners)))

    def many(self, owners: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        """Pieces in the order of their owners; one without bits has the value 0."""
        self.owners.append(owners)
        self.values.append(values)
        self.sizes.append(sizes)

    def ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owners, values, sizes) of all pieces that have bits, by owner."""
        owners, values, sizes = (np.concatenate(a) for a in (self.owners, self.values, self.sizes))
        order = np.argsort(owners.astype(np.uint16) if self.count < 1 << 16 else owners, kind="stable")
        order = order[sizes[order] > 0]
        return owners[order], values[order], sizes[order]

    def bytes(self) -> list[bytes]:
        each = [np.bincount(o, n, self.count).astype(np.int64) for o, n in zip(self.owners, self.sizes)]
        bits = sum(each)
        words = (bits + 31) >> 5
        first = np.cumsum(words) - words
        out = np.zeros(int(words.sum()) + 2, np.int64)
        start = first << 5
        for owners, values, sizes, own in zip(self.owners, self.values, self.sizes, each):
            at = np.cumsum(sizes)
            at -= sizes
            at += (start - np.cumsum(own) + own)[owners]
            start += own
            # Values of up to 31 bits, disjoint within a word of 32 and what it hands on.
            word = at >> 5
            at &= 31
            new = np.ones(len(word), bool)
            np.not_equal(word[1:], word[:-1], out=new[1:])
            new = np.flatnonzero(new)
            if len(new):
                total = np.bitwise_or.reduceat(values << at, new)
                word = word[new]
                out[word] |= total & 0xFFFFFFFF
                # A piece without bits may be beyond the last word.
                out[word + 1] |= total >> 32
        data = out.astype("<u4").tobytes()
        return [data[4 * f : 4 * f + (n + 7) // 8] for f, n in zip(first.tolist(), bits.tolist())]


@lru_cache(maxsize=2)
def _flat_bits(size: int) -> tuple[np.ndarray, np.ndarray]:
    values, sizes = _flat_code(size)
    return values[sizes > 0], sizes[sizes > 0]


def _write_smalls(w: Writers, stack: Stack, argb: np.ndarray) -> None:
    """``_write_small`` of each image."""
    p = _planes(argb)
    one = p[stack.first]
    varies = np.stack([np.bincount(stack.of, p[:, c] != one[stack.of, c], stack.count) > 0 for c in range(4)], axis=1)
    w.each((0,), (1,))
    for channel, size in ((2, 280), (1, 256), (3, 256), (0, 256)):
        on = np.flatnonzero(varies[:, channel])
        w.each(_flat_bits(size)[0][:, None].tolist(), _flat_bits(size)[1], on)
        on = np.flatnonzero(~varies[:, channel])
        w.each((1, 0, 1, one[on, channel]), (1, 1, 1, 8), on)
    w.each((1, 0, 1, 0), (1, 1, 1, 8))
    order = [2, 1, 3, 0]
    varies = varies[:, order][stack.of]
    w.many(np.repeat(stack.of, 4), (_reversed(8)[p[:, order]] * varies).ravel(), (8 * varies).ravel())


def _all_codes(tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of the prefix codes for each row of counts; no bits for rows of fewer than two symbols."""
    counts = np.count_nonzero(tally, axis=1)
    lengths = all_code_lengths(tally, np.where(counts <= 512, 11, 15))
    lengths[counts < 2] = 0
    return _canonical(lengths), lengths


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """``codes`` of each row."""
    row, symbol = _nonzero(lengths)
    length = lengths[row, symbol]
    order = (row << 20 | length << 14 | symbol).argsort()
    row, symbol, share = row[order], symbol[order], np.int64(1) << (15 - length[order])
    place = (np.cumsum(share) - share) & 32767  # a complete code's shares are 1 << 15
    out = np.zeros_like(lengths)
    out[row, symbol] = _reversed(15)[place]
    return out


def _nonzero(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.flatnonzero(table)
    row = place // table.shape[1]
    return row, place - row * table.shape[1]


def all_code_lengths(tally: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """``code_lengths`` of each row: the same two lightest nodes are merged in all rows at a time."""
    out = (tally > 0).astype(np.int64)
    counts = np.count_nonzero(tally, axis=1)
    rows = np.flatnonzero(counts > 1)
    if not len(rows):
        return out
    rows = rows[np.argsort(-counts[rows], kind="stable")]
    n = counts[rows]
    most, never = int(n[0]), np.int64(1) << 40
    row, symbol = _nonzero(tally[rows])
    weight = tally[rows][row, symbol]
    order = (row << 40 | weight).argsort(kind="stable")
    symbol, weight = symbol[order], weight[order]
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # A line of a table has a row's leaves by weight, then its merged nodes; what is not there yet weighs more than any.
    line = 2 * most + 2
    weights = np.full((len(rows), line), never)
    weights[row, place] = weight
    weights, parent = weights.ravel(), np.zeros(len(rows) * line, np.int64)
    leaf = line * np.arange(len(rows))
    node = leaf + most + 1
    made, active = node.copy(), len(rows)
    alive = np.searchsorted(-n, -np.arange(most + 2), side="right")
    for t in range(most - 1):
        if alive[t + 2] != active:
            active = int(alive[t + 2])
            leaf, node = leaf[:active], node[:active]
        total = 0
        for _ in range(2):
            a, b = weights.take(node), weights.take(leaf)
            first = b <= a
            parent[np.where(first, leaf, node)] = t
            total = total + np.minimum(a, b)
            leaf = leaf + first
            node = node + ~first
        weights[made[:active] + t] = total
    depth, parent = np.zeros((len(rows), most), np.int64), parent.reshape(len(rows), line)
    for t in range(most - 3, -1, -1):
        k = int(alive[t + 3])
        depth[:k, t] = depth[np.arange(k), parent[:k, most + 1 + t]] + 1
    length = depth[row, parent[row, place]] + 1
    out[rows[row], symbol] = length
    for i in np.flatnonzero(out.max(axis=1) > longest).tolist():
        out[i] = code_lengths(tally[i], int(longest[i]))
    return out


def _write_codes(w: Writers, owners: np.ndarray, tally: np.ndarray, lengths: np.ndarray) -> None:
    """A prefix code of each row, as ``Writer.code`` writes it."""
    whole, w, images, owners = w, Writers(len(owners)), owners, np.arange(len(owners))
    counts = np.count_nonzero(tally, axis=1)
    only = tally.argmax(axis=1)
    on = np.flatnonzero((counts < 2) & (only < 256))
    w.each((1, 0, 1, only[on]), (1, 1, 1, 8), owners[on])
    for i in np.flatnonzero((counts == 1) & (only >= 256)).tolist():
        one = Writer()
        one.code((tally[i] > 0).astype(np.int64))
        one._settle()
        values = np.concatenate(one.values)
        w.many(np.full(len(values), owners[i]), values, np.concatenate(one.sizes))
    rows = np.flatnonzero(counts > 1)
    if len(rows):
        _write_rich_codes(w, rows, lengths[rows])
    row, values, sizes = w.ordered()
    whole.many(images[row], values, sizes)


def _write_rich_codes(w: Writers, owners: np.ndarray, lengths: np.ndarray) -> None:
    """``_write_codes`` of rows of two symbols or more."""
    rows = owners
    row, symbol = _nonzero(lengths)
    gap = np.diff(symbol, prepend=-1) - 1
    new = np.flatnonzero(np.diff(row, prepend=-1))
    gap[new] = symbol[new]
    # Runs of eleven zeros or more are one token for up to 138 of them.
    full, rest = np.divmod(gap, 138)
    long = rest > 10
    n = full + np.where(long, 1, rest) + 1
    end = np.cumsum(n) - 1
    place = np.arange(int(n.sum())) - np.repeat(end - n + 1, n)
    f = np.repeat(full, n)
    run = (place < f) | ((place == f) & np.repeat(long, n))
    token = np.where(run, 18, 0)
    extra = np.where(run, np.where(place < f, 127, np.repeat(rest - 11, n)), 0)
    token[end], extra[end], run[end] = lengths[row, symbol], 0, False
    row = np.repeat(row, n)
    inner = np.bincount(row * 19 + token, minlength=19 * len(rows)).reshape(-1, 19)
    several = np.count_nonzero(inner, axis=1) > 1
    inner = all_code_lengths(inner, np.full(len(rows), 7))
    ordered = inner[:, LENGTH_ORDER]
    last = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(axis=1))
    w.each((0, last - 4), (1, 4), owners)
    w.many(np.repeat(owners, 19), ordered.ravel(), (3 * (np.arange(19) < last[:, None])).ravel())
    w.each((1, 4, np.bincount(row, minlength=len(rows)) - 2), (1, 3, 10), owners)
    size = np.where(several[:, None], inner, 0)
    bits = size[row, token]
    w.many(owners[row], _canonical(size)[row, token] | extra << bits, bits + 7 * run)


def _all_matches(stack: Stack, flat: np.ndarray, least: int) -> np.ndarray:
    """``_matches`` of each image: rows (place among all pixels, length, distance)."""
    found, last = _equal_windows(stack, flat, least)
    on = stack.of[last] == stack.of[found]
    found, last = found[on], last[on]
    on = np.ones(len(found), bool)
    for k in range(least):
        on &= flat[found + k] == flat[last + k]
    found, last = found[on], last[on]
    images = zip(stack.first.tolist(), (stack.first + stack.sizes).tolist(), stack.width.tolist())
    px = (flat >> np.uint32(8)).astype(np.uint8).tobytes() if _only_green(flat) else flat.tolist()
    starts, sizes, backs, at, limit = [], [], [], 0, 0
    for i, q in zip(found.tolist(), last.tolist()):
        if i < at:
            continue
        while i >= limit:
            lo, limit, width = next(images)
        end = min(limit, i + LONGEST_COPY)
        j, back = i + least, i - q
        while j < end and px[j] == px[j - back]:
            j += 1
        best = j
        if width != back and i - width >= lo and px[i] == px[i - width]:
            j = i + 1
            while j < end and px[j] == px[j - width]:
                j += 1
            if j > best:
                best, back = j, width
        starts.append(i)
        sizes.append(best - i)
        backs.append(back)
        at = best
    return np.array([starts, sizes, backs], np.int64).T


def _only_green(flat: np.ndarray) -> bool:
    return not (flat & np.uint32(0xFFFF00FF) ^ np.uint32(OPAQUE)).any()


def _equal_windows(stack: Stack, flat: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, last place before) of windows of ``least`` pixels within images that came before."""
    count = stack.total - least + 1
    if count < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(count, bool)
    for k in range(1, least):
        after = stack.first + stack.sizes - k
        inside[after[after < count]] = False
    place_bits = int(stack.total).bit_length()
    if least * 8 + place_bits < 64 and _only_green(flat):
        # Windows of samples fit beside their places, so one plain sort does.
        keys, sample = np.zeros(count, np.int64), (flat >> np.uint32(8) & np.uint32(255)).astype(np.int64)
        for k in range(least):
            keys = keys << 8 | sample[k : k + count]
        keyed = (keys << place_bits | np.arange(count))[inside]
        keyed.sort()
        same = np.flatnonzero((keyed[1:] ^ keyed[:-1]) >> place_bits == 0)
        last = np.full(count, -1, np.int64)
        low = (1 << place_bits) - 1
        last[keyed[same + 1] & low] = keyed[same] & low
        found = np.flatnonzero(last >= 0)
        return found, last[found]
    keys = np.zeros(count, np.uint64)
    for k in range(least):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + count]
    inside = np.flatnonzero(inside)
    keys = keys[inside]
    order = keys.argsort()
    rank = np.empty(len(keys), np.int64)
    ordered = keys[order]
    rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
    last = _last_equals(rank << 32 | inside)
    on = np.flatnonzero(last >= 0)
    return inside[on], last[on]


def _last_equals(keyed: np.ndarray) -> np.ndarray:
    """Of entries key << 32 | place: the place of the last earlier entry with the same key, or -1."""
    ordered = np.sort(keyed)
    place = keyed & 0xFFFFFFFF
    known = np.full(int(place.max(initial=-1)) + 1, -1, np.int64)
    same = np.flatnonzero((ordered[1:] ^ ordered[:-1]) >> 32 == 0)
    known[ordered[same + 1] & 0xFFFFFFFF] = ordered[same] & 0xFFFFFFFF
    return known[place]


def _write_images(w: Writers, stack: Stack, flat: np.ndarray, cache_bits: int, references: bool, meta_shift: int, groups: np.ndarray | None, least: int) -> None:
    """``_write_image`` of each image; ``groups`` are the groups of all their blocks."""
    w.each((1, cache_bits) if cache_bits else (0,), (1, 4) if cache_bits else (1,))
    w.each((0,) if groups is None else (1, meta_shift - 2), (1,) if groups is None else (1, 3))
    group, n_groups = np.zeros(stack.total, np.int64), np.ones(stack.count, np.int64)
    if groups is not None:
        small, block = stack.blocks(meta_shift)
        _write_smalls(w, small, groups.astype(np.uint32) << np.uint32(8))
        group = groups[block].astype(np.int64)
        n_groups = np.maximum.reduceat(groups, small.first).astype(np.int64) + 1
    copies = _all_matches(stack, flat, least) if references else np.zeros((0, 3), np.int64)
    inside = np.zeros(stack.total + 1, np.int64)
    inside[copies[:, 0] + 1] += 1
    inside -= np.bincount(copies[:, 0] + copies[:, 1], minlength=stack.total + 1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
    first_group = np.cumsum(n_groups) - n_groups
    of, rows = first_group[stack.of[at]] + group[at], int(n_groups.sum())
    px = flat[at].astype(np.int64)
    copy = np.searchsorted(at, copies[:, 0])
    literal = np.ones(len(at), bool)
    literal[copy] = False
    green = px >> 8 & 255
    if cache_bits:
        # Every pixel enters the cache, so a slot holds the last pixel before that falls into it.
        slot = ((flat * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        last = _last_equals((stack.of << cache_bits | slot) << 32 | np.arange(stack.total))[at]
        hit = np.flatnonzero(literal & (last >= 0) & (flat[last] == flat[at]))
        literal[hit] = False
        green[hit] = 280 + slot[at[hit]]
    length, more, extra = _prefixes(copies[:, 1])
    far, far_more, far_extra = _prefixes(_short_distances(copies[:, 2], stack.width[stack.of[copies[:, 0]]]))
    green[copy] = 256 + length
    literal = np.flatnonzero(literal)
    own, px = of[literal], px[literal]
    alphabets = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    symbols = ((of, green), (own, px >> 16 & 255), (own, px & 255), (own, px >> 24 & 255), (of[copy], far))
    places = [(o * 5 + k) * alphabets[0] + v for k, (o, v) in enumerate(symbols)]
    tally = np.bincount(np.concatenate(places), minlength=5 * rows * alphabets[0]).reshape(5 * rows, -1)
    codes, lengths = _all_codes(tally)
    _write_codes(w, np.repeat(np.arange(stack.count), 5 * n_groups), tally, lengths)
    known = (codes | lengths << 16).ravel()
    (a, n), (b, m), (c, k), (d, q), (e, r) = ((v & 0xFFFF, v >> 16) for v in map(known.take, places))
    # A literal has four codes; a copy has a code and extra bits for its length, and both for its distance.
    values, sizes = np.zeros((len(at), 2), np.int64), np.zeros((len(at), 2), np.int64)
    values[:, 0], sizes[:, 0] = a, n
    values[literal, 0] |= b << n[literal]
    sizes[literal, 0] += m
    values[literal, 1], sizes[literal, 1] = c | d << k, k + q
    values[copy, 0] |= extra << n[copy]
    sizes[copy, 0] += more
    values[copy, 1], sizes[copy, 1] = e | far_extra << r, r + far_more
    if sizes[literal, 1].any():
        w.many(np.repeat(stack.of[at], 2), values.ravel(), sizes.ravel())
    else:
        # Where literals are in one piece, only copies have a second one.
        both = np.ones(len(at), np.int64)
        both[copy] = 2
        second = np.cumsum(both)[copy] - 1
        one, own = np.repeat(values[:, 0], both), np.repeat(sizes[:, 0], both)
        one[second], own[second] = values[copy, 1], sizes[copy, 1]
        w.many(np.repeat(stack.of[at], both), one, own)


def _short_distances(back: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Distance values of copies from ``back`` pixels before in images of these widths."""
    out = back + 120
    for wide in np.unique(width).tolist():
        near = _near_codes(wide)
        on = np.flatnonzero(width == wide)
        known = np.array(sorted(near))
        short = np.array([near[d] for d in known.tolist()])
        i = np.minimum(np.searchsorted(known, back[on]), len(known) - 1)
        out[on] = np.where(known[i] == back[on], short[i], out[on])
    return out


def _colors(stack: Stack, argb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image << 32 | colour of all images' colours in order, each pixel's place among them)."""
    shade = argb & np.uint32(255)
    if (argb == np.uint32(OPAQUE) + shade * np.uint32(0x10101)).all():
        key = stack.of << 8 | shade
        seen = np.bincount(key, minlength=1) > 0
        known = np.flatnonzero(seen)
        return known >> 8 << 32 | OPAQUE + (known & 255) * 0x10101, (np.cumsum(seen) - 1)[key]
    colors, index = np.unique(stack.of << 32 | argb, return_inverse=True)
    return colors, index.ravel()


def encode(argb: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, shift: int = 3, green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = True, groups: np.ndarray | None = None, meta_shift: int = 3) -> bytes:
    """A lossless WebP file of packed ARGB with the transforms asked for, in the order of the arguments."""
    flat = [None if a is None else np.asarray(a).ravel() for a in (predictor, cross, groups)]
    return encode_all(Stack(*([n] for n in argb.shape)), argb.ravel(), flat[0], flat[1], shift, green, palette, cache_bits, references, flat[2], meta_shift)[0]


def encode_all(stack: Stack, argb: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, shift: int = 3, green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = True, groups: np.ndarray | None = None, meta_shift: int = 3) -> list[bytes]:
    """``encode`` of each image, where the arguments hold the pixels or blocks of all images one after another."""
    w, img = Writers(stack.count), argb.astype(np.uint32)
    w.each((0x2F, stack.width - 1, stack.height - 1, 1, 0), (8, 14, 14, 1, 3))
    if predictor is not None:
        w.each((1, PREDICTOR, shift - 2), (1, 2, 3))
        small, block = stack.blocks(shift)
        data = predictor.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE)
        _write_smalls(w, small, data)
        p, y, x = _planes(img), stack.y, stack.x
        mode = np.where(y == 0, 1, np.where(x == 0, 2, predictor.astype(np.int64)[block]))
        img = _packed((p - predicted(np.where((y == 0) & (x == 0), 0, mode), *stack.neighbours(p))) & 255)
    if cross is not None:
        w.each((1, CROSS, shift - 2), (1, 2, 3))
        small, block = stack.blocks(shift)
        _write_smalls(w, small, cross.astype(np.uint32))
        img = _crossed(img, cross.astype(np.uint32)[block], -1)
    if green:
        w.each((1, GREEN), (1, 2))
        img = _green(img, -1)
    if palette:
        colors, index = _colors(stack, img)
        counts = np.bincount(colors >> 32, minlength=stack.count)
        if counts.max() > 256:
            raise ValueError("more than 256 colours")
        shades = Stack(np.ones(stack.count), counts)
        w.each((1, PALETTE, counts - 1), (1, 2, 8))
        p = _planes((colors & 0xFFFFFFFF).astype(np.uint32))
        step = np.diff(p, axis=0, prepend=0)
        step[shades.first] = p[shades.first]
        _write_smalls(w, shades, _packed(step))
        index -= shades.first[stack.of]
        # Small palettes have several pixels in one.
        bundle = np.array([_bundle_bits(n) for n in counts.tolist()])
        if bundle.any():
            narrow, own = Stack(stack.height, _count(stack.width, bundle)), bundle[stack.of]
            to = narrow.first[stack.of] + stack.y * narrow.width[stack.of] + (stack.x >> own)
            index = np.bincount(to, index << ((stack.x & ((1 << own) - 1)) * (8 >> own)), narrow.total)
            stack = narrow
        img = index.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE)
    w.each((0,), (1,))
    # A pixel of one sample is a short code, so a copy must be longer to pay.
    _write_images(w, stack, img, cache_bits, references, meta_shift, groups, 5 if palette else 3)
    return [_wrapped(body) for body in w.bytes()]


def best_modes(argb: np.ndarray, shift: int, modes: tuple[int, ...] = (1, 2, 4, 7, 11, 12)) -> np.ndarray:
    """The predictor of each block, out of some, that leaves the least absolute residuals; of equal ones the first."""
    return all_modes(_one(argb), argb.ravel(), shift, modes).reshape([_count(n, shift) for n in argb.shape])


def _one(argb: np.ndarray) -> Stack:
    return Stack(*([n] for n in argb.shape))


def all_modes(stack: Stack, argb: np.ndarray, shift: int, modes: tuple[int, ...] = (1, 2, 4, 7, 11, 12)) -> np.ndarray:
    """``best_modes`` of each image."""
    p = _planes(argb)
    near = stack.neighbours(p)
    small, block = stack.blocks(shift)
    cost = []
    for mode in modes:
        rest = _signed(p - predicted(np.full(len(p), mode), *near))
        cost.append(np.bincount(block, _added(np.abs(rest)), small.total))
    return np.array(modes)[np.stack(cost).argmin(axis=0)]


def best_cross(argb: np.ndarray, shift: int) -> np.ndarray:
    """Cross-colour factors of each block: least squares of red and blue on green, in 32nds; red on blue stays 0."""
    return all_cross(_one(argb), argb.ravel(), shift).reshape([_count(n, shift) for n in argb.shape])


def all_cross(stack: Stack, argb: np.ndarray, shift: int) -> np.ndarray:
    """``best_cross`` of each image."""
    p = _signed(_planes(_green(argb, -1)))
    green = p[..., 2].astype(np.int64)
    small, block = stack.blocks(shift)
    sums = lambda v: np.bincount(block, v, small.total)
    power = np.maximum(sums(green * green), 1)
    factor = lambda c: np.clip(np.rint(32 * sums(green * p[..., c]) / power), -128, 127).astype(np.int64) & 255
    # Samples of an element, from the lowest: green to red, green to blue, red to blue.
    return (np.uint32(OPAQUE) | factor(3).astype(np.uint32) << np.uint32(8) | factor(1).astype(np.uint32)).astype(np.uint32)


def row_groups(argb: np.ndarray, shift: int) -> np.ndarray:
    """A prefix-code group for each block: 1 where its green samples are above the image's median, else 0."""
    return all_groups(_one(argb), argb.ravel(), shift).reshape([_count(n, shift) for n in argb.shape])


def all_groups(stack: Stack, argb: np.ndarray, shift: int) -> np.ndarray:
    """``row_groups`` of each image."""
    small, block = stack.blocks(shift)
    mean = np.bincount(block, grey(argb), small.total) / np.bincount(block, minlength=small.total)
    order = np.lexsort((mean, small.of))
    low, high = order[small.first + (small.sizes - 1) // 2], order[small.first + small.sizes // 2]
    return (mean > ((mean[low] + mean[high]) / 2)[small.of]).astype(np.int64)


RUN = 8


def encode_gray(samples: np.ndarray) -> bytes:
    """A lossless WebP file of an 8-bit grey array (height, width): palette, prefix codes, runs by back-reference.

    No loop over pixels: this is the form in which payload columns are stored.
    """
    height, width = samples.shape
    flat = samples.ravel()
    seen = np.bincount(flat, minlength=256)
    grey = np.flatnonzero(seen)
    if len(grey) < 17:  # smaller palettes would be bundled
        grey = np.union1d(grey, np.setdiff1d(np.arange(256), grey)[: 17 - len(grey)])
    index = np.zeros(256, np.int64)
    index[grey] = np.arange(len(grey))
    w = _start(height, width)
    w.many(np.array([1, PALETTE, len(grey) - 1]), np.array([1, 2, 8]))
    shades = grey.astype(np.uint32)
    _write_small(w, _packed(np.diff(_planes(np.uint32(OPAQUE) | shades << np.uint32(16) | shades << np.uint32(8) | shades), axis=0, prepend=0)))
    w.many(np.array([0, 0, 0]), np.array([1, 1, 1]))  # no more transforms, no cache, one group
    change = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    first = np.concatenate([[0], change])
    size = np.diff(np.append(first, len(flat)))
    long = np.flatnonzero(size > RUN)
    symbols = index[flat]
    extra, extra_size = np.zeros(0, np.int64), None
    if len(long):
        keep = np.ones(len(flat), bool)
        extra, extra_size = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        for a, n in zip(first[long].tolist(), size[long].tolist()):
            at, left = a + 1, n - 1
            while left:
                part = min(left, 4096)
                p, bits, value = _prefix(part)
                symbols[at], extra[at], extra_size[at] = 256 + p, value, bits
                keep[at + 1 : at + part] = False
                at, left = at + part, left - part
        symbols, extra, extra_size = symbols[keep], extra[keep], extra_size[keep]
    code, bits = w.code(code_lengths(np.bincount(symbols, minlength=280)))
    one = np.zeros(256, np.int64)
    for s in (0, 0, 255):
        one[:] = 0
        one[s] = 1
        w.code(one)
    back = np.zeros(40, np.int64)
    back[1] = 1  # distance code 2: the pixel to the left
    w.code(back)
    value, length = code[symbols], bits[symbols]
    if extra_size is not None:
        value = np.stack([value, extra], axis=1).ravel()
        length = np.stack([length, extra_size], axis=1).ravel()
    w.many(value, length)
    return _wrap(w)


def grey(argb: np.ndarray) -> np.ndarray:
    """The green samples of packed ARGB, which is the image itself where it is grey."""
    return ((argb >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
