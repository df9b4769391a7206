"""Progressive JPEG in numpy, for many images at once.

A writer turns coefficient arrays into progressive files (spectral selection and successive
approximation, a restart interval for each block); a reader accumulates any progressive
Huffman scans back into coefficient arrays. Both work on all entropy-coded segments of a
batch in step: every numpy operation handles one symbol or one coefficient of each segment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the JPEG format: the zig-zag order of an 8x8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: (components, first coefficient, last, high bit, low bit) of each scan that is written.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 20, 0, 1),
    ((1,), 1, 20, 0, 1),
    ((2,), 1, 20, 0, 1),
    ((0,), 21, 63, 0, 0),
    ((1,), 21, 63, 0, 0),
    ((2,), 21, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 20, 1, 0),
    ((1,), 1, 20, 1, 0),
    ((2,), 1, 20, 1, 0),
)


class JpegError(ValueError):
    """The bytes are not a progressive Huffman JPEG that this reader knows."""


# --- Huffman tables --------------------------------------------------------------------------


def code_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, length) by symbol and the 16-bit lookup: length << 8 | symbol, 0 where no code fits."""
    codes, lengths, look = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for bits in range(1, 17):
        for s in symbols[at : at + counts[bits - 1]]:
            codes[s], lengths[s] = code, bits
            look[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
            code += 1
        at += counts[bits - 1]
        code <<= 1
    return codes, lengths, look


#: Written tables: DC categories 0 to 11 in 4 bits; AC by how often a byte text needs them.
DC_SPEC = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
_COMMON = [0x05, 0x06, 0x04, 0x07]
_LESS = [0x00, 0x03, 0x02, 0x01, 0x08]
_RARE = [r << 4 | s for r in range(16) for s in range(11) if (r << 4 | s) not in {*_COMMON, *_LESS}]
AC_SPEC = (bytes([0, 0, 4, 0, 5, 0, 0, 0, 0, 0, 0, len(_RARE)] + [0] * 4), bytes(_COMMON + _LESS + _RARE))
DC, AC = code_table(*DC_SPEC), code_table(*AC_SPEC)


BIT_LENGTH = np.array([i.bit_length() for i in range(1 << 12)], np.int64)


def categories(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude, which is below 2^12."""
    return BIT_LENGTH[np.abs(v)]


# --- writing ---------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, bits: np.ndarray, segment: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each filled up with ones, and bytes by segment. Symbols are in order, of at most 32 bits."""
    used = np.bincount(segment, bits, minlength=n_segments).astype(np.int64)
    size = (used + 7) >> 3
    first = np.cumsum(size) - size
    before = np.cumsum(bits) - bits
    start = np.full(n_segments, 0, np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.zeros(0, np.int64)
    start[segment[fresh]] = before[fresh]
    at = before - start[segment] + first[segment] * 8
    fill = size * 8 - used
    at = np.concatenate([at, first * 8 + used])
    values = np.concatenate([values, (1 << fill) - 1])
    bits = np.concatenate([bits, fill])
    total = int(size.sum())
    words = np.zeros(total // 4 + 3, np.uint64)
    word, shift = at >> 5, 64 - (at & 31) - bits
    wide = values.astype(np.uint64) << shift.astype(np.uint64)
    # no two symbols share a bit, so sums are unions; float weights stay below 2^53
    high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), minlength=len(words))
    low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words) + 1)[: len(words)]
    words = high.astype(np.uint64) + low.astype(np.uint64)
    return words.astype(">u4").view(np.uint8)[:total], size


def stuffed(data: np.ndarray, size: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a zero after each 255 and a restart marker after each segment but a scan's last. Returns bytes and bytes by segment."""
    n = len(size)
    ends = np.cumsum(size)
    after = np.ones(len(data), np.int64) + (data == 255)
    own = np.repeat(np.arange(n), size)
    new = np.bincount(own, after, minlength=n).astype(np.int64) + np.where(last, 0, 2)
    begin = np.cumsum(new) - new
    inside = np.cumsum(after) - after
    lead = np.zeros(n, np.int64)
    full = np.flatnonzero(size)
    lead[full] = inside[(ends - size)[full]]
    out = np.zeros(int(new.sum()), np.uint8)
    out[begin[own] + inside - lead[own]] = data
    marks = np.flatnonzero(~last)
    stop = begin[marks] + new[marks]
    out[stop - 2], out[stop - 1] = 0xFF, 0xD0 + (place[marks] & 7)
    return out, new


def first_scan(blocks: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bits, block) of an AC first scan; blocks: (n, 64) in zig-zag order."""
    v = blocks[:, lo : hi + 1]
    v = np.sign(v) * (np.abs(v) >> low)
    n, width = v.shape
    row, col, flat = cells_of(v != 0)
    x = v.ravel()[flat]
    run = np.diff(flat, prepend=-1) - 1
    fresh = np.diff(row, prepend=-1) != 0
    run[fresh] = col[fresh]
    s = categories(x)
    extra = np.where(x < 0, x + (1 << s) - 1, x)
    symbol = (run & 15) << 4 | s
    value, bits = AC[0][symbol] << s | extra, AC[1][symbol] + s
    ended = np.ones(n, bool)
    ended[row[col == width - 1]] = False
    eob = np.flatnonzero(ended)
    if (run > 15).any():
        more = np.repeat(np.arange(len(row)), run >> 4)
        value, bits = np.insert(value, more, AC[0][0xF0]), np.insert(bits, more, AC[1][0xF0])
        row = np.insert(row, more, row[more])
    at = np.searchsorted(row, eob, side="right")
    return np.insert(value, at, AC[0][0]), np.insert(bits, at, AC[1][0]), np.insert(row, at, eob)


def cells_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, flat place) of the true cells."""
    flat = np.flatnonzero(mask)
    row = np.repeat(np.arange(len(mask)), np.count_nonzero(mask, axis=1))
    return row, flat - row * mask.shape[1], flat


def refining_scan(blocks: np.ndarray, lo: int, hi: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bits, block) of an AC refinement scan of one bit."""
    a = np.abs(blocks[:, lo : hi + 1])
    old, now = (a >> (low + 1)) > 0, (a >> low) & 1
    new = (now == 1) & ~old
    n, width = a.shape
    row, col, _ = cells_of(old | new)
    order = row * 256 + col * 4
    is_new = new[row, col]
    # zeros passed since the last new coefficient of the block
    zeros = np.cumsum(~old & ~new, axis=1)
    nr, nc = row[is_new], col[is_new]
    seen = zeros[nr, nc]
    before = np.zeros(len(nr), np.int64)
    before[1:] = np.where(nr[1:] == nr[:-1], seen[:-1], 0)
    run = seen - before
    parts = []
    start = np.zeros(len(nr), np.int64)  # a symbol stands before the correction bits that follow its predecessor
    start[1:] = np.where(nr[1:] == nr[:-1], nc[:-1] + 1, 0)
    if len(nr):
        positive = (blocks[nr, lo + nc] > 0).astype(np.int64)
        symbol = (run & 15) << 4 | 1
        if (run > 15).any():  # the sixteen zeros of a ZRL take the correction bits among them
            for i in np.flatnonzero(run > 15):
                flat = np.flatnonzero(~old[nr[i], start[i] : nc[i]]) + start[i]
                for z in range(int(run[i]) >> 4):
                    parts.append((AC[0][[0xF0]], AC[1][[0xF0]], nr[[i]], np.array([nr[i] * 256 + start[i] * 4 - 1])))
                    start[i] = flat[16 * z + 15] + 1
        parts.append((AC[0][symbol] << 1 | positive, AC[1][symbol] + 1, nr, nr * 256 + start * 4 - 1))
    cr, cc = row[~is_new], col[~is_new]
    parts.append((now[cr, cc], np.ones(len(cr), np.int64), cr, order[~is_new]))
    tail = np.zeros(n, np.int64)
    np.maximum.at(tail, nr, nc + 1)
    ended = np.flatnonzero(tail < width)
    parts.append((np.full(len(ended), AC[0][0]), np.full(len(ended), AC[1][0]), ended, ended * 256 + tail[ended] * 4 - 1))
    value, bits, row, at = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(at, kind="stable")
    return value[order], bits[order], row[order]


def segment_dc(blocks: np.ndarray, mcu: np.ndarray, low: int, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """DC of blocks in coding order; a restart for each MCU makes its blocks of one component a chain of their own."""
    v = blocks[:, 0] >> low
    if refine:
        return v & 1, np.ones(len(v), np.int64), mcu
    place = np.arange(len(v)) - np.repeat(np.flatnonzero(np.concatenate([[True], mcu[1:] != mcu[:-1]])), np.bincount(mcu)) if len(v) else np.zeros(0, np.int64)
    previous = np.where((place >= 1) & (place <= 3), np.concatenate([[0], v[:-1]]), 0)  # four luma blocks, then one of each chroma
    d = v - previous
    s = categories(d)
    return DC[0][s] << s | np.where(d < 0, d + (1 << s) - 1, d), DC[1][s] + s, mcu


def header(width: int, height: int, comment: bytes) -> bytes:
    """Everything before the first scan: 4:2:0, quantisation by one, one DC and one AC table, a restart for each MCU."""
    def marker(code: int, body: bytes) -> bytes:
        return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body

    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = bytes([0x00]) + DC_SPEC[0] + DC_SPEC[1] + bytes([0x10]) + AC_SPEC[0] + AC_SPEC[1]
    return b"\xff\xd8" + marker(0xFE, comment) + marker(0xDB, bytes([0]) + bytes([1] * 64)) + marker(0xC2, frame) + marker(0xC4, tables) + marker(0xDD, b"\x00\x01")


def scan_header(scan: tuple) -> bytes:
    own, lo, hi, high, low = scan
    return b"\xff\xda" + (6 + 2 * len(own)).to_bytes(2, "big") + bytes([len(own)]) + b"".join(bytes([c + 1, 0]) for c in own) + bytes([lo, hi, high << 4 | low])


def write_all(luma: np.ndarray, cb: np.ndarray, cr: np.ndarray, grids: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Progressive files of images laid one after the other.

    grids: MCU columns and rows by image. luma: (4 MCUs, 64) in coding order (four blocks of
    an MCU together); cb, cr: (MCUs, 64). Coefficients are in zig-zag order.
    """
    mcus = np.array([w * h for w, h in grids], np.int64)
    n = int(mcus.sum())
    image = np.repeat(np.arange(len(grids)), mcus)
    cols = np.array([w for w, _ in grids], np.int64)
    place = np.arange(n) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    # a scan of luma alone goes through its blocks row by row, not MCU by MCU
    y, x = np.divmod(place, cols[image])
    by, bx = (y[:, None] * 2 + np.array([0, 0, 1, 1])).ravel(), (x[:, None] * 2 + np.array([0, 1, 0, 1])).ravel()
    raster = np.lexsort((bx, by, np.repeat(image, 4)))
    planes = (luma[raster], cb, cr)
    owners = (np.repeat(image, 4)[raster], image, image)
    mixed = np.empty((n, 6, 64), luma.dtype)
    mixed[:, :4], mixed[:, 4], mixed[:, 5] = luma.reshape(n, 4, 64), cb, cr
    mixed = mixed.reshape(-1, 64)
    files = [[header(w * 16, h * 16, c)] for (w, h), c in zip(grids, comments, strict=True)]
    for scan in SCRIPT:
        own, lo, hi, high, low = scan
        if lo == 0:
            symbols, who = segment_dc(mixed, np.repeat(np.arange(n), 6), low, bool(high)), image
        else:
            symbols, who = (refining_scan if high else first_scan)(planes[own[0]], lo, hi, low), owners[own[0]]
        data, size = pack_bits(*symbols, len(who))
        last = np.ones(len(who), bool)
        last[:-1] = who[1:] != who[:-1]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        index = np.arange(len(who)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(who)]])))
        data, size = stuffed(data, size, last, index)
        ends = np.cumsum(np.bincount(who, size, minlength=len(grids)).astype(np.int64))
        raw, head = data.tobytes(), scan_header(scan)
        for i, f in enumerate(files):
            f += [head, raw[int(ends[i - 1]) if i else 0 : int(ends[i])]]
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


# --- reading ---------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    cols: int = 0  # blocks of the padded plane
    rows: int = 0
    own_cols: int = 0  # blocks that a scan of this component alone has
    own_rows: int = 0
    base: int = 0  # first block in the batch's array


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    orders: dict[tuple, tuple] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)  # (components, lo, hi, high, low, tables, restart, start, end)


#: A marker that is neither a stuffed byte nor a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def parse(data: bytes) -> Image:
    """Markers of one file; entropy-coded bytes are only located."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    im, at, tables, restart = Image(), 2, {}, 0
    while True:
        while at < len(data) and data[at] == 0xFF and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        code = data[at + 1]
        if code == 0xD9:
            return im
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xFE:
            im.comment = body
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                q = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                im.quant[body[0] & 15], body = q, body[1 + 64 * (1 + wide) :]
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif code == 0xDD:
            restart = int.from_bytes(body, "big")
        elif code == 0xC2:
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
            for c in im.components:
                c.cols, c.rows = -(-im.width // (8 * hm)) * c.h, -(-im.height // (8 * vm)) * c.v
                c.own_cols, c.own_rows = -(-(-(-im.width * c.h // hm)) // 8), -(-(-(-im.height * c.v // vm)) // 8)
        elif code in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("not progressive Huffman")
        elif code == 0xDA:
            own = [next(k for k, c in enumerate(im.components) if c.ident == body[1 + 2 * i]) for i in range(body[0])]
            spec = tuple((tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | body[2 + 2 * i] & 15)) for i in range(body[0]))
            lo, hi, hl = body[-3:]
            start = at
            found = MARKER.search(data, at)
            if found is None:
                raise JpegError("scan without end")
            at = found.start()
            im.scans.append((own, lo, hi, hl >> 4, hl & 15, spec, restart, start, at))


class Bits:
    """Bit readers of many segments over one array of bytes without stuffing."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        pad = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint64)
        self.window = (pad[:-4] << np.uint64(32) | pad[1:-3] << np.uint64(24) | pad[2:-2] << np.uint64(16) | pad[3:-1] << np.uint64(8) | pad[4:]).astype(np.int64)  # 40 bits from each byte
        self.at = start * 8

    def peek(self, who: np.ndarray, n) -> np.ndarray:
        """The next n (at most 32) bits, not yet taken."""
        at = self.at[who]
        return (self.window[np.minimum(at >> 3, len(self.window) - 1)] >> (40 - (at & 7) - n)) & ((1 << n) - 1)

    def take(self, who: np.ndarray, n) -> np.ndarray:
        v = self.peek(who, n)
        self.at[who] += n
        return v

    def symbol(self, who: np.ndarray, look: np.ndarray) -> np.ndarray:
        e = look[self.peek(who, 16)]
        if not e.all():
            raise JpegError("no such code")
        self.at[who] += e >> 8
        return e & 255


def signed(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s, 1) >> 1), v - (1 << s) + 1, v) * (s > 0)


def destuff(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of each segment, scan of each segment) of many scans, split at restart markers."""
    size = ends - starts
    scan = np.repeat(np.arange(len(starts)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + starts[scan]
    data = raw[at]
    ff = np.zeros(len(data), bool)
    ff[1:] = (data[:-1] == 255) & (scan[1:] == scan[:-1])
    zero = ff & (data == 0)
    mark = ff & (data >= 0xD0) & (data <= 0xD7)
    keep = ~(zero | mark)
    keep[:-1] &= ~mark[1:]
    first = np.concatenate([[True], scan[1:] != scan[:-1]]) if len(scan) else np.zeros(0, bool)
    count = np.cumsum(keep)
    # a segment begins at the scan's first byte and after each restart marker
    begin = np.concatenate([count[np.flatnonzero(first)] - keep[np.flatnonzero(first)], count[np.flatnonzero(mark)]])
    owner = np.concatenate([scan[np.flatnonzero(first)], scan[np.flatnonzero(mark)]])
    order = np.lexsort((np.concatenate([np.flatnonzero(first), np.flatnonzero(mark)]), owner))
    return data[keep], begin[order], owner[order]


def read_dc(bits: Bits, coef: np.ndarray, blocks: list[np.ndarray], comps: list[np.ndarray], looks: np.ndarray, which: np.ndarray, low: int, refine: bool) -> None:
    """blocks, comps: by segment, block numbers and components (slots) in coding order, as padded arrays."""
    order, slot = blocks, comps
    n, width = order.shape
    last = np.zeros((n, 4), np.int64)
    for k in range(width):
        who = np.flatnonzero(order[:, k] >= 0)
        if not len(who):
            break
        b = order[who, k]
        if refine:
            coef[b, 0] |= bits.take(who, 1) << low
            continue
        c = slot[who, k]
        e = looks[which[who, c], bits.peek(who, 16)]
        if not e.all():
            raise JpegError("no such code")
        bits.at[who] += e >> 8
        s = e & 255
        last[who, c] += signed(bits.take(who, s), s)
        coef[b, 0] = last[who, c] << low


def read_ac_first(bits: Bits, coef: np.ndarray, order: np.ndarray, count: np.ndarray, lo: int, hi: int, low: int, look: np.ndarray) -> None:
    """order: (segments, most blocks) block numbers; count: blocks by segment."""
    n = len(order)
    block, k = np.zeros(n, np.int64), np.full(n, lo, np.int64)
    who = np.flatnonzero(count > 0)
    while len(who):
        rs = bits.symbol(who, look)
        r, s = rs >> 4, rs & 15
        if s.all():  # the usual case: a run, then a value
            at = k[who] + r
            if at.max() > hi:
                raise JpegError("run past the band")
            coef[order[who, block[who]], at] = signed(bits.take(who, s), s) << low
            k[who] = at + 1
        else:
            value = s > 0
            v = who[value]
            at = k[v] + r[value]
            if len(at) and at.max() > hi:
                raise JpegError("run past the band")
            coef[order[v, block[v]], at] = signed(bits.take(v, s[value]), s[value]) << low
            k[v] = at + 1
            z = who[(s == 0) & (r == 15)]
            k[z] += 16
            e = (s == 0) & (r < 15)
            ew = who[e]
            block[ew] += (1 << r[e]) + bits.take(ew, r[e])
            k[ew] = lo
        done = who[k[who] > hi]
        block[done] += 1
        k[done] = lo
        who = who[block[who] < count[who]]


def read_ac_refine(bits: Bits, coef: np.ndarray, order: np.ndarray, count: np.ndarray, lo: int, hi: int, low: int, look: np.ndarray) -> None:
    n, bit = len(order), 1 << low
    block, k, eob = np.zeros(n, np.int64), np.full(n, lo, np.int64), np.zeros(n, np.int64)
    zeros, value = np.full(n, -1, np.int64), np.zeros(n, np.int64)  # zeros < 0: a symbol is due
    who = np.flatnonzero(count > 0)
    while len(who):
        due = who[(eob[who] == 0) & (zeros[who] < 0)]
        if len(due):
            rs = bits.symbol(due, look)
            r, s = rs >> 4, rs & 15
            zeros[due], value[due] = r, 0
            one = due[s > 0]
            value[one] = np.where(bits.take(one, 1) > 0, bit, -bit)
            e = (s == 0) & (r < 15)
            ew = due[e]
            eob[ew] = (1 << r[e]) + bits.take(ew, r[e])
            zeros[ew] = -1
        rest = who[eob[who] > 0]
        if len(rest):  # the rest of the block only has correction bits
            b = order[rest, block[rest]]
            cells = coef[b, lo : hi + 1]
            old = (cells != 0) & (np.arange(lo, hi + 1) >= k[rest][:, None])
            place = np.cumsum(old, axis=1) - 1
            row, col, _ = cells_of(old)
            p = bits.at[rest][row] + place[row, col]
            got = (bits.window[np.minimum(p >> 3, len(bits.window) - 1)] >> (39 - (p & 7))) & 1
            x = cells[row, col]
            coef[b[row], lo + col] = x + np.where(got > 0, np.sign(x) * bit, 0)
            bits.at[rest] += old.sum(axis=1)
            eob[rest] -= 1
            block[rest] += 1
            k[rest] = lo
        step = who[zeros[who] >= 0]
        if len(step):  # one coefficient each
            b = order[step, block[step]]
            x = coef[b, k[step]]
            nz = x != 0
            f = step[nz]
            got = bits.take(f, 1)
            coef[b[nz], k[f]] += np.where(got > 0, np.sign(x[nz]) * bit, 0)
            z = step[~nz]
            here = zeros[z] == 0
            put = z[here]
            coef[b[~nz][here], k[put]] = value[put]
            zeros[z] -= 1  # -1 once the value is placed or the sixteenth zero passed
            k[step] += 1
            done = step[k[step] > hi]
            block[done] += 1
            k[done] = lo
            zeros[done] = -1
        who = who[block[who] < count[who]]


def read_all(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """(images, coefficients): int32 (blocks, 64) in zig-zag order; each component's blocks row by row from its base."""
    images = [parse(f) for f in files]
    total = 0
    for im in images:
        for c in im.components:
            c.base, total = total, total + c.cols * c.rows
    coef = np.zeros((total, 64), np.int32)
    offset = np.cumsum([0, *map(len, files)])
    raw = np.frombuffer(b"".join(files), np.uint8)
    for k in range(max((len(im.scans) for im in images), default=0)):
        # images whose k-th scan has the same form are read together
        groups: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if k < len(im.scans):
                own, lo, hi, high, low, spec, *_ = im.scans[k]
                tables = tuple(t[0] for t in spec) if lo == 0 else (spec[0][1],)
                groups.setdefault((lo, hi, high, low, tables if not (lo == 0 and high) else ()), []).append(i)
        for (lo, hi, high, low, tables), members in groups.items():
            starts = np.array([offset[i] + images[i].scans[k][7] for i in members])
            ends = np.array([offset[i] + images[i].scans[k][8] for i in members])
            data, begin, owner = destuff(raw, starts, ends)
            rows, slots = [], []
            seg = np.bincount(owner, minlength=len(members))
            for j, i in enumerate(members):
                blocks, slot, per = coding_order(images[i], images[i].scans[k][0])
                restart = images[i].scans[k][6]
                each = restart * per if restart else len(blocks)
                if -(-len(blocks) // each) != seg[j]:
                    raise JpegError("restart markers don't match")
                fill = int(seg[j]) * each - len(blocks)
                if fill:
                    blocks, slot = np.concatenate([blocks, np.full(fill, -1)]), np.concatenate([slot, np.zeros(fill, np.int64)])
                rows.append(blocks.reshape(-1, each))
                slots.append(slot.reshape(-1, each))
            wide = max(r.shape[1] for r in rows)
            order = np.concatenate([widened(r, wide, -1) for r in rows])
            bits = Bits(data, begin)
            if lo == 0:
                slot = np.concatenate([widened(r, wide, 0) for r in slots])
                looks = np.stack([code_table(*t)[2] for t in tables]) if tables else np.zeros((1, 1), np.int64)
                read_dc(bits, coef, order, slot, looks, np.tile(np.arange(4) % max(1, len(tables)), (len(order), 1)), low, bool(high))
            else:
                (read_ac_refine if high else read_ac_first)(bits, coef, order, (order >= 0).sum(axis=1), lo, hi, low, code_table(*tables[0])[2])
    return images, coef


def widened(a: np.ndarray, width: int, fill: int) -> np.ndarray:
    if a.shape[1] == width:
        return a
    out = np.full((len(a), width), fill, a.dtype)
    out[:, : a.shape[1]] = a
    return out


def coding_order(im: Image, own: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(block numbers, component slots, blocks of an MCU) of a scan; kept, as several scans share it."""
    key = tuple(own)
    if key not in im.orders:
        im.orders[key] = _coding_order(im, own)
    return im.orders[key]


def _coding_order(im: Image, own: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(own) == 1:
        c = im.components[own[0]]
        grid = c.base + np.arange(c.own_rows)[:, None] * c.cols + np.arange(c.own_cols)
        return grid.ravel(), np.zeros(grid.size, np.int64), 1
    parts, slots = [], []
    for s, i in enumerate(own):
        c = im.components[i]
        grid = (c.base + np.arange(c.rows * c.cols)).reshape(c.rows // c.v, c.v, c.cols // c.h, c.h).swapaxes(1, 2).reshape(-1, c.v * c.h)
        parts.append(grid)
        slots.append(np.full(grid.shape, s))
    order = np.concatenate(parts, axis=1)
    return order.ravel(), np.concatenate(slots, axis=1).ravel(), order.shape[1]


# --- pixels ----------------------------------------------------------------------------------


def _basis() -> np.ndarray:
    """(64 zig-zag coefficients, 64 samples) of the inverse transform, in whole 4096ths.

    Products and sums of whole numbers below 2^53 are exact in double precision in any order,
    so equal coefficients give equal samples everywhere.
    """
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.rint(np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)[ZIGZAG] * 4096)


BASIS = _basis()


def samples_of(images: list[Image], coef: np.ndarray) -> np.ndarray:
    """(blocks, 64) samples, 0 to 255, of all blocks."""
    quant = [im.quant.get(c.table) for im in images for c in im.components]
    if any(q is not None and (q != 1).any() for q in quant):
        q = np.stack([np.ones(64, np.int64) if q is None else q for q in quant])
        coef = coef * np.repeat(q, [c.rows * c.cols for im in images for c in im.components], axis=0)
    s = coef.astype(np.float64) @ BASIS
    s += 2048 + 128 * 4096
    return np.clip(s.astype(np.int32) >> 12, 0, 255) if len(s) == 0 or np.abs(s).max() < 2**31 else np.clip(np.floor(s / 4096), 0, 255).astype(np.int32)


def rgb_tensors(images: list[Image], coef: np.ndarray) -> list[np.ndarray]:
    """uint8 (height, width, 3) by image: chroma repeated to full resolution, then YCbCr to RGB; one component is grey."""
    samples, out = samples_of(images, coef), []
    half = 1 << 15  # 65536ths of the YCbCr weights
    for im in images:
        hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
        full = []
        for c in im.components:
            p = samples[c.base : c.base + c.rows * c.cols].reshape(c.rows, c.cols, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.cols * 8)
            if c.v < vm:
                p = np.repeat(p, vm // c.v, axis=0)
            if c.h < hm:
                p = np.repeat(p, hm // c.h, axis=1)
            full.append(p[: im.height, : im.width])
        if len(full) == 1:
            out.append(np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8))
            continue
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        rgb = np.empty((*y.shape, 3), np.uint8)
        rgb[:, :, 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
        rgb[:, :, 1] = np.clip(y + ((-22554 * cb - 46802 * cr + half) >> 16), 0, 255)
        rgb[:, :, 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
        out.append(rgb)
    return out
