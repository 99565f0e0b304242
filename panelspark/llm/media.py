"""Media columns: progressive JPEG, read and written in numpy over many images at once.

Reading: spectral-selection and successive-approximation scans are accumulated into coefficient arrays; these are
dequantised and inverse-transformed, chroma is upsampled to full resolution, and each image becomes an RGB tensor.
Entropy-coded segments (the parts between restart markers) are decoded side by side, one symbol of each a step, over all
images of a batch whose scans have the same parameters and tables. Images of any sampling and scan script can be read; a
scan without restarts is one segment.

Writing: bytes are stored losslessly in the format's own unit, the quantised coefficient: byte b as b - 128, 64 to a
block in zigzag order, Y blocks first, then Cb, then Cr, with 2 x 2 sampling. A stored text longer than ``CHUNK`` bytes is
a sequence of images. Every image says in a comment how many of its coefficients are payload.

Null and empty texts are stored as one tile of padding. Equal texts give equal bytes. Rows are independent.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import bounded, tidy
from panelspark.llm.tokens import text_buffer

TILE, MCU, CHUNK, BATCH_BYTES = 576, 384, 384 * 2048, 768 * 1024
PAD = 255

# ------------------------------------------------------------------ tables


def zigzag() -> np.ndarray:
    """Raster index of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


def inverse_matrix() -> np.ndarray:
    """Zigzag coefficients to raster samples, scaled by 2**13 to whole numbers, so that sums are exact in any order."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(full[zigzag()] * 8192)


class Huffman:
    """A table of up to 256 symbols by code length, for writing and for reading 16 bits at once."""

    def __init__(self, counts: list[int], symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.read = np.zeros(65536, np.int32)  # length << 8 | symbol; length 0: no such code
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.code[s], self.size[s] = code, length
                self.read[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
                code += 1
            at, code = at + n, code << 1

    @property
    def segment(self) -> bytes:
        return bytes(self.counts) + self.symbols


def _table(groups: dict[int, list[int]]) -> Huffman:
    return Huffman([len(groups.get(k, [])) for k in range(1, 17)], bytes(s for k in sorted(groups) for s in groups[k]))


_SHORT = {3: [0x02, 0x03, 0x04, 0x06], 4: [0x00, 0x01, 0x05, 0x07]}
_AC_SYMBOLS = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
DC_TABLE = _table({4: list(range(12))})
AC_TABLE = _table(_SHORT | {10: [s for s in _AC_SYMBOLS if s not in _SHORT[3] + _SHORT[4]]})
REFINE_TABLE = _table({1: [0x00], 6: [r << 4 | 1 for r in range(16)] + [0xF0]})
#: Components, first and last coefficient, high and low bit position of each scan that is written.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0, 1, 2), 0, 0, 1, 0)] + [x for c in range(3) for x in (((c,), 1, 5, 0, 1), ((c,), 6, 63, 0, 1), ((c,), 1, 63, 1, 0))]
_BITS = np.array([int(k).bit_length() for k in range(4096)])

# ------------------------------------------------------------------ writing


def _segments(code: np.ndarray, size: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each filled up with ones, zeros stuffed after 0xFF; and each segment's length.

    ``code`` and ``size``: the bit strings in order; ``per``: how many of them each segment has (never 0).
    """
    first = np.cumsum(per) - per
    bits = np.add.reduceat(size, first)
    length = (bits + 7) >> 3
    start = np.cumsum(length) - length
    at = np.cumsum(size) - size
    at += np.repeat(start * 8 - at[first], per)
    byte, room = at >> 3, 40 - size - (at & 7)
    value = code << room
    out = np.zeros(int(length.sum()) + 5)
    for k in range(5):
        part = (value >> (32 - 8 * k)) & 255
        if k < 2 or part.any():
            out[k:] += np.bincount(byte, weights=part, minlength=len(out))[: len(out) - k] if k == 0 else np.bincount(byte, weights=part, minlength=len(out))[: len(out) - k]
    out = out[:-5].astype(np.uint8)
    fill = (length * 8 - bits).astype(np.uint8)
    out[start + length - 1] |= ((1 << fill) - 1).astype(np.uint8)
    full = out == 255
    if full.any():
        stuffed = np.zeros(len(out) + int(full.sum()), np.uint8)
        stuffed[np.arange(len(out)) + np.cumsum(full) - full] = out
        length = length + np.add.reduceat(full.astype(np.int64), start)
        out = stuffed
    return out, length


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = _BITS[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _dc_first(mcus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``mcus``: the six DC values of each MCU, shifted. Each MCU is a segment, so prediction starts anew."""
    d = mcus.copy()
    d[:, 1:4] -= mcus[:, :3]
    size, bits = _magnitude(d)
    return (DC_TABLE.code[size] << size | bits).ravel(), (DC_TABLE.size[size] + size).ravel(), np.full(len(d), 6)


def _ac_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``c``: shifted coefficients of the band, a row a block; each block is a segment."""
    n, width = c.shape
    used = np.empty((n, width + 1), bool)
    np.not_equal(c, 0, out=used[:, :width])
    used[:, width] = ~used[:, width - 1]  # an end of block, unless the last coefficient is used
    row, at = np.nonzero(used)
    new = np.r_[True, row[1:] != row[:-1]]
    run = np.where(new, at, at - np.r_[0, at[:-1]] - 1)
    end = at == width
    v = c[row, np.where(end, 0, at)]
    size, bits = _magnitude(np.where(end, 0, v))
    run[end] = 0
    symbol = (run & 15) << 4 | size
    code, length = AC_TABLE.code[symbol] << size | bits, AC_TABLE.size[symbol] + size
    long = run >> 4
    per = np.bincount(row, minlength=n)
    if long.any():
        times = long + 1
        last = np.cumsum(times) - 1
        whole_code = np.full(int(times.sum()), AC_TABLE.code[0xF0])
        whole_size = np.full(len(whole_code), AC_TABLE.size[0xF0])
        whole_code[last], whole_size[last] = code, length
        code, length = whole_code, whole_size
        per = per + np.bincount(row, weights=long, minlength=n).astype(np.int64)
    return code, length, per


def _ac_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``c``: whole coefficients 1..63, of which all but the lowest bit were sent; each block is a segment."""
    size = np.abs(c)
    old, fresh = size > 1, size == 1
    easy = ~fresh.any(1)
    n = len(c)
    # of blocks without new coefficients: an end of block, then a bit of each old one
    code = np.zeros((n, 64), np.int64)
    length = np.zeros((n, 64), np.int64)
    code[:, 0], length[:, 0] = REFINE_TABLE.code[0], REFINE_TABLE.size[0]
    code[:, 1:] = size & 1
    length[:, 1:] = old
    if easy.all():
        keep = length > 0
        return code[keep], length[keep], keep.sum(1)
    codes, sizes, per = [], [], np.zeros(n, np.int64)
    for b in range(n):
        if easy[b]:
            keep = length[b] > 0
            codes.append(code[b, keep]), sizes.append(length[b, keep])
            per[b] = keep.sum()
            continue
        out: list[tuple[int, int]] = []
        wait: list[int] = []
        run, last = 0, int(np.flatnonzero(fresh[b])[-1])
        for k, (v, m) in enumerate(zip(c[b].tolist(), size[b].tolist())):
            if m > 1:
                wait.append(m & 1)
                continue
            if m == 0:
                if run == 15 and k < last:
                    out.append((int(REFINE_TABLE.code[0xF0]), int(REFINE_TABLE.size[0xF0])))
                    out += [(x, 1) for x in wait]
                    wait, run = [], 0
                else:
                    run += 1
                continue
            s = run << 4 | 1
            out.append((int(REFINE_TABLE.code[s]) << 1 | (v > 0), int(REFINE_TABLE.size[s]) + 1))
            out += [(x, 1) for x in wait]
            wait, run = [], 0
        if run or wait:
            out.append((int(REFINE_TABLE.code[0]), int(REFINE_TABLE.size[0])))
            out += [(x, 1) for x in wait]
        codes.append(np.array([x for x, _ in out])), sizes.append(np.array([x for _, x in out]))
        per[b] = len(out)
    return np.concatenate(codes), np.concatenate(sizes), per


def _grid(mcus: int) -> tuple[int, int]:
    """MCU columns and rows for at least so many MCUs, with few to spare."""
    rows = -(-mcus // 64)
    return -(-mcus // rows), rows


def _mark(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


_FIXED = _mark(0xDB, bytes([0]) + bytes([1] * 64))
_TABLES = _mark(0xC4, b"\x00" + DC_TABLE.segment) + _mark(0xC4, b"\x10" + AC_TABLE.segment) + _mark(0xC4, b"\x11" + REFINE_TABLE.segment) + _mark(0xDD, b"\x00\x01")


def _head(cols: int, rows: int, payload: int) -> bytes:
    frame = bytes([8]) + (rows * 16).to_bytes(2, "big") + (cols * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _mark(0xFE, b"payload %d" % payload) + _FIXED + _mark(0xC2, frame) + _TABLES


def _scan_head(comps: tuple[int, ...], lo: int, hi: int, high: int, low: int) -> bytes:
    table = 0 if lo == 0 else (1 if high else 0)
    return _mark(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, table)), lo, hi, high << 4 | low]))


@functools.lru_cache(maxsize=4096)
def mcu_blocks(cols: int, rows: int) -> np.ndarray:
    """Of each MCU in order the four Y blocks it has, by raster index among the image's Y blocks."""
    y, x = np.divmod(np.arange(cols * rows), cols)
    top = (2 * y) * (2 * cols) + 2 * x
    return np.stack([top, top + 1, top + 2 * cols, top + 2 * cols + 1], axis=1)


def write_images(payloads: list[np.ndarray]) -> list[bytes]:
    """One progressive JPEG for each payload of at most ``CHUNK`` bytes."""
    grids = [_grid(-(-len(p) // MCU)) for p in payloads]
    count = np.array([c * r for c, r in grids])
    base = np.cumsum(count) - count
    flat = np.full(int(count.sum()) * MCU, PAD, np.uint8)
    for p, b in zip(payloads, base.tolist()):
        flat[b * MCU : b * MCU + len(p)] = p
    coef = flat.reshape(-1, 64).astype(np.int64) - 128
    blocks = [np.concatenate([6 * b + at * n + np.arange(size * n) for b, n in zip(base.tolist(), count.tolist())]) for at, size in ((0, 4), (4, 1), (5, 1))]
    groups = np.concatenate([np.concatenate([6 * b + mcu_blocks(*g), (6 * b + 4 * n + np.arange(n))[:, None], (6 * b + 5 * n + np.arange(n))[:, None]], axis=1) for b, n, g in zip(base.tolist(), count.tolist(), grids)])
    out = [[_head(c, r, len(p))] for (c, r), p in zip(grids, payloads)]
    for comps, lo, hi, high, low in SCRIPT:
        if lo == 0:
            dc = coef[groups, 0]
            code, size, per = _dc_first(dc >> low) if not high else ((dc & 1).ravel(), np.ones(dc.size, np.int64), np.full(len(dc), 6))
            many = count
        else:
            mine = coef[blocks[comps[0]], lo : hi + 1]
            code, size, per = _ac_refine(mine) if high else _ac_first(np.sign(mine) * (np.abs(mine) >> low))
            many = count * (4 if comps[0] == 0 else 1)
        data, length = _segments(code, size, per)
        # each segment but an image's last is followed by its restart marker
        first = np.cumsum(many) - many
        order = np.arange(len(length)) - np.repeat(first, many)
        final = np.zeros(len(length), bool)
        final[first + many - 1] = True
        whole = length + 2 * ~final
        start = np.cumsum(whole) - whole
        full = np.empty(int(whole.sum()), np.uint8)
        full[np.arange(len(data)) + np.repeat(start - (np.cumsum(length) - length), length)] = data
        mark = (start + length)[~final]
        full[mark], full[mark + 1] = 0xFF, 0xD0 + (order[~final] & 7)
        head, raw = _scan_head(comps, lo, hi, high, low), full.tobytes()
        for k, (a, b) in enumerate(zip(start[first].tolist(), np.append(start[first][1:], len(full)).tolist())):
            out[k] += (head, raw[a:b])
    return [b"".join((*parts, b"\xff\xd9")) for parts in out]


# ------------------------------------------------------------------ reading


@dataclass
class Image:
    """What an image's headers say, and where its coefficients are in the batch."""

    width: int = 0
    height: int = 0
    comments: list[bytes] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[int] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # first block of each component
    wide: list[int] = field(default_factory=list)  # stored blocks a row
    high: list[int] = field(default_factory=list)

    @property
    def mcus(self) -> tuple[int, int]:
        return -(-self.width // (8 * max(h for h, _ in self.sampling))), -(-self.height // (8 * max(v for _, v in self.sampling)))


@functools.lru_cache(maxsize=256)
def _huffman_tables(body: bytes) -> tuple[tuple[int, Huffman], ...]:
    out = []
    while body:
        n = sum(body[1:17])
        out.append((body[0], _huffman(body[1 : 17 + n])))
        body = body[17 + n :]
    return tuple(out)


@functools.lru_cache(maxsize=256)
def _huffman(spec: bytes) -> Huffman:
    return Huffman(list(spec[:16]), spec[16:])


@functools.lru_cache(maxsize=256)
def _quant_tables(body: bytes) -> tuple[tuple[int, np.ndarray], ...]:
    out = []
    while body:
        wide = body[0] >> 4
        out.append((body[0] & 15, np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)))
        body = body[65 + 64 * wide :]
    return tuple(out)


@functools.lru_cache(maxsize=1024)
def _scan_of(body: bytes, ids: tuple[int, ...]) -> tuple[tuple, tuple[int, ...]]:
    """Components, band and bits of a scan, and the number of each component's table."""
    n = body[0]
    comps = tuple(ids.index(body[1 + 2 * k]) for k in range(n))
    lo, hi, hl = body[1 + 2 * n : 4 + 2 * n]
    return (comps, lo, hi, hl >> 4, hl & 15), tuple(body[2 + 2 * k] >> 4 if lo == 0 else 16 | (body[2 + 2 * k] & 15) for k in range(n))


def _parse(raw: bytes, at: int, marks: list[int]) -> tuple[Image, int]:
    """Headers and scan ranges of the image that begins at ``at``; ``marks``: where markers other than restarts stand."""
    img, tables, interval, ids = Image(), {}, 0, ()
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at += 2
    while True:
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = raw[at + 1]
        if kind == 0xD9:
            return img, at + 2
        size = raw[at + 2] << 8 | raw[at + 3]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDA:
            what, numbers = _scan_of(body, ids)
            end = marks[bisect_left(marks, at)]
            img.scans.append((what, tuple(tables.get(k) for k in numbers), interval, at, end))
            at = end
        elif kind == 0xFE:
            img.comments.append(body)
        elif kind == 0xDB:
            img.quants.update(_quant_tables(body))
        elif kind == 0xC4:
            tables.update(_huffman_tables(body))
        elif kind == 0xC2:
            img.height, img.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            ids = tuple(body[6::3])
            img.ids, img.quant = list(ids), list(body[8::3])
            img.sampling = [(x >> 4, x & 15) for x in body[7::3]]
        elif kind == 0xDD:
            interval = body[0] << 8 | body[1]
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("only progressive images with Huffman coding are read here")


class _Lanes:
    """Segments side by side: a bit position for each, over the bytes without stuffing and markers."""

    def __init__(self, padded: np.ndarray, start: np.ndarray):
        self.eights = np.ndarray((len(padded) - 7,), ">u8", padded.data, strides=(1,))
        self.at = start * 8

    def window(self, lanes: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, left-aligned in 64."""
        at = self.at[lanes]
        return self.eights[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def symbol(self, lanes: np.ndarray, table: Huffman) -> tuple[np.ndarray, np.ndarray]:
        """Reads a symbol in each lane; also the bits after it, left-aligned."""
        w = self.window(lanes)
        got = table.read[(w >> np.uint64(48)).astype(np.int64)]
        size = got >> 8
        if not size.all():
            raise ValueError("no such code")
        self.at[lanes] += size
        return got & 255, w << size.astype(np.uint64)


def _signed(window: np.ndarray, size: np.ndarray) -> np.ndarray:
    v = np.where(size > 0, window >> (np.uint64(64) - np.maximum(size, 1).astype(np.uint64)), 0).astype(np.int64)
    return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)


def _dc(coef, lanes: _Lanes, blocks: np.ndarray, count: np.ndarray, comp: np.ndarray, tables, high: int, low: int) -> None:
    """``blocks``: the blocks of each lane in order; ``comp``: the scan component of each place in an MCU."""
    n, most = blocks.shape
    if high:
        for k in range(most):
            live = np.flatnonzero(count > k)
            w = lanes.window(live)
            lanes.at[live] += 1
            coef[blocks[live, k], 0] |= (w >> np.uint64(63)).astype(coef.dtype) << low
        return
    guess = np.zeros((n, len(tables)), np.int64)
    for k in range(most):
        live = np.flatnonzero(count > k)
        c = int(comp[k % len(comp)])
        size, w = lanes.symbol(live, tables[c])
        guess[live, c] += _signed(w, size)
        lanes.at[live] += size
        coef[blocks[live, k], 0] = guess[live, c] << low


def _ac(coef, lanes: _Lanes, blocks: np.ndarray, count: np.ndarray, lo: int, hi: int, table: Huffman, low: int) -> None:
    n = len(count)
    block, k, lane = np.zeros(n, np.int64), np.full(n, lo), np.arange(n)
    flat = coef.reshape(-1)
    while len(lane):
        s, w = lanes.symbol(lane, table)
        run, size = s >> 4, s & 15
        value = size > 0
        at = k + run
        if value.all():
            flat[blocks[lane, block] * 64 + at] = _signed(w, size) << low if low == 0 else _signed(w, size) * (1 << low)
            lanes.at[lane] += size
            k = at + 1
        else:
            v = np.flatnonzero(value)
            flat[blocks[lane[v], block[v]] * 64 + at[v]] = _signed(w[v], size[v]) * (1 << low)
            stop = ~value & (run < 15)
            more = np.where(stop, (1 << run) - 1, 0) + np.where(stop & (run > 0), (w >> np.uint64(1) >> (np.uint64(63) - np.maximum(run, 0).astype(np.uint64))).astype(np.int64), 0)
            lanes.at[lane] += np.where(value, size, np.where(stop, run, 0))
            k = np.where(stop, hi + 1, at + 1)
            block = block + more  # an end-of-block run also ends the blocks after this one
        over = k > hi
        if over.any():
            block, k = block + over, np.where(over, lo, k)
            stay = block < count[lane]
            lane, block, k = lane[stay], block[stay], k[stay]


def _ac_more(coef, lanes: _Lanes, blocks: np.ndarray, count: np.ndarray, lo: int, hi: int, table: Huffman, low: int) -> None:
    n = len(count)
    block, k, lane, ending = np.zeros(n, np.int64), np.full(n, lo), np.arange(n), np.zeros(n, np.int64)
    span = np.arange(lo, hi + 1)
    bit = 1 << low
    while len(lane):
        need = ending == 0
        run, value = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        if need.any():
            mine = lane[need]
            s, w = lanes.symbol(mine, table)
            r, size = s >> 4, s & 15
            stop = (size == 0) & (r < 15)
            ending[need] = np.where(stop, (1 << r) + np.where(r > 0, (w >> np.uint64(1) >> (np.uint64(63) - r.astype(np.uint64))).astype(np.int64), 0), 0)
            value[need] = np.where(size > 0, np.where((w >> np.uint64(63)) > 0, bit, -bit), 0)
            lanes.at[mine] += np.where(stop, r, (size > 0).astype(np.int64))
            run[need] = r
        rows = blocks[lane, block]
        now = coef[rows, lo : hi + 1]
        ahead = span[None, :] >= k[:, None]
        if (ending > 0).all():
            to = np.full(len(lane), hi + 1)
        else:
            blank = np.cumsum((now == 0) & ahead, axis=1)
            hit = (blank == run[:, None] + 1).argmax(1)
            reached = blank[:, -1] >= run + 1
            to = np.where((ending == 0) & reached, hit + lo, hi + 1)
        fix = (now != 0) & ahead & (span[None, :] < to[:, None])
        r, c = np.nonzero(fix)
        many = fix.sum(1)
        first = np.cumsum(many) - many
        where = lanes.at[lane][r] + np.arange(len(r)) - first[r]
        got = (lanes.eights[where >> 3].astype(np.uint64) >> (63 - (where & 7)).astype(np.uint64)) & np.uint64(1) > 0
        r, c = r[got], c[got]
        old = now[r, c]
        coef[rows[r], lo + c] = old + np.where(old > 0, bit, -bit)
        lanes.at[lane] += many
        put = np.flatnonzero((value != 0) & (to <= hi))
        coef[rows[put], to[put]] = value[put]
        k = to + 1
        over = (k > hi) | (ending > 0)
        ending = np.maximum(ending - 1, 0)
        block, k = block + over, np.where(over, lo, k)
        stay = block < count[lane]
        lane, block, k, ending = lane[stay], block[stay], k[stay], ending[stay]


@functools.lru_cache(maxsize=2048)
def _scan_blocks(width: int, height: int, sampling: tuple[tuple[int, int], ...], comps: tuple[int, ...], interval: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of each segment of a scan (a row a segment, from the image's first block), how many it has, and the scan component by place in the MCU."""
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    cols, rows = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    wide = [cols * h for h, _ in sampling]
    first = np.cumsum([0, *(cols * h * rows * v for h, v in sampling)])
    if len(comps) == 1:
        c = comps[0]
        h, v = sampling[c]
        across, down = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
        y, x = np.divmod(np.arange(across * down), across)
        units = (first[c] + y * wide[c] + x)[:, None]
        place = np.zeros(1, np.int64)
    else:
        y, x = np.divmod(np.arange(cols * rows), cols)
        parts, place = [], []
        for k, c in enumerate(comps):
            h, v = sampling[c]
            for dy in range(v):
                for dx in range(h):
                    parts.append(first[c] + (y * v + dy) * wide[c] + x * h + dx)
                    place.append(k)
        units, place = np.stack(parts, axis=1), np.array(place)
    step = interval or len(units)
    lanes = -(-len(units) // step)
    spare = lanes * step - len(units)
    count = np.full(lanes, step * units.shape[1])
    count[-1] -= spare * units.shape[1]
    if spare:
        units = np.concatenate([units, np.repeat(units[-1:], spare, axis=0)])
    return units.reshape(lanes, -1), count, place


def read_images(files: list[bytes]) -> tuple[list[list[Image]], np.ndarray]:
    """The images of each file (a file may hold several, end to end) and the coefficients of all, a zigzag row a block."""
    raw = b"".join(files)
    data = np.frombuffer(raw, np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    restart = (after & 0xF8) == 0xD0
    marks, restarts = ff[(after != 0) & ~restart & (after != 0xFF)].tolist(), ff[restart]
    good = np.ones(len(data), bool)  # all but stuffed zeros and restart markers
    good[ff[after == 0] + 1] = False
    good[restarts], good[restarts + 1] = False, False
    ahead = np.cumsum(good) - good
    clean = np.concatenate([data[good], np.zeros(9, np.uint8)])
    out, at, blocks = [], 0, 0
    for f in files:
        end, images = at + len(f), []
        while at < end:
            img, at = _parse(raw, at, marks)
            cols, rows = img.mcus
            for h, v in img.sampling:
                img.first.append(blocks), img.wide.append(cols * h), img.high.append(rows * v)
                blocks += cols * h * rows * v
            images.append(img)
        out.append(images)
    coef = np.zeros((blocks, 64), np.int32)
    every = [i for images in out for i in images]
    for k in range(max((len(i.scans) for i in every), default=0)):
        alike: dict = {}
        for i in every:
            if k < len(i.scans):
                what, tables, interval, a, b = i.scans[k]
                layout = tuple(i.sampling[c] for c in what[0])
                alike.setdefault((what, tuple(map(id, tables)), layout), []).append((i, tables, interval, a, b))
        for (what, _, _), group in alike.items():
            _read_scan(coef, clean, ahead, restarts, what, group)
    return out, coef


def _read_scan(coef: np.ndarray, clean: np.ndarray, ahead: np.ndarray, restarts: np.ndarray, what: tuple, group: list) -> None:
    comps, lo, hi, high, low = what
    made = [_scan_blocks(i.width, i.height, tuple(i.sampling), comps, interval) for i, _, interval, _, _ in group]
    many = np.array([len(m[0]) for m in made])
    begin = np.array([g[3] for g in group])
    before = np.searchsorted(restarts, begin)
    if (np.searchsorted(restarts, [g[4] for g in group]) - before != many - 1).any():
        raise ValueError("restart markers are missing")
    first = np.cumsum(many) - many
    order = np.arange(int(many.sum())) - np.repeat(first, many)
    start = restarts[np.minimum(np.repeat(before, many) + order - 1, max(len(restarts) - 1, 0))] + 2 if len(restarts) else np.zeros(len(order), np.int64)
    start[first] = begin
    wide = max(m[0].shape[1] for m in made)
    blocks = np.concatenate([m[0] if m[0].shape[1] == wide else np.pad(m[0], ((0, 0), (0, wide - m[0].shape[1]))) for m in made])
    blocks += np.repeat([g[0].first[0] for g in group], many)[:, None]
    lanes, count = _Lanes(clean, ahead[start]), np.concatenate([m[1] for m in made])
    tables = group[0][1]
    if lo == 0:
        _dc(coef, lanes, blocks, count, made[0][2], tables, high, low)
    elif high:
        _ac_more(coef, lanes, blocks, count, lo, hi, tables[0], low)
    else:
        _ac(coef, lanes, blocks, count, lo, hi, tables[0], low)


_INVERSE = inverse_matrix()


def samples(images: list[Image], coef: np.ndarray) -> list[list[np.ndarray]]:
    """Each image's planes, 8-bit, at the components' own resolution."""
    plain = all((q == 1).all() for i in images for q in i.quants.values())
    values = coef if plain else coef.copy()
    if not plain:
        for i in images:
            for c, q in enumerate(i.quant):
                values[i.first[c] : i.first[c] + i.wide[c] * i.high[c]] *= i.quants[q].astype(np.int32)
    pixels = np.empty(values.shape, np.uint8)
    for a in range(0, len(values), 8192):
        x = values[a : a + 8192].astype(np.float64) @ _INVERSE
        pixels[a : a + 8192] = np.clip(np.floor((x + 4096) / 8192) + 128, 0, 255)
    return [[pixels[i.first[c] : i.first[c] + i.wide[c] * i.high[c]].reshape(i.high[c], i.wide[c], 8, 8).swapaxes(1, 2).reshape(i.high[c] * 8, i.wide[c] * 8) for c in range(len(i.ids))] for i in images]


def rgb(img: Image, planes: list[np.ndarray]) -> np.ndarray:
    """The full-resolution RGB tensor: chroma upsampled by repetition, YCbCr turned to RGB in whole numbers; grey images have equal channels."""
    most_h, most_v = max(h for h, _ in img.sampling), max(v for _, v in img.sampling)
    full = []
    for p, (h, v) in zip(planes, img.sampling):
        if (h, v) != (most_h, most_v):
            p = p[np.arange(img.mcus[1] * 8 * most_v) * v // most_v][:, np.arange(img.mcus[0] * 8 * most_h) * h // most_h]
        full.append(p[: img.height, : img.width])
    if len(full) < 3:
        return np.stack([full[0]] * 3, axis=-1)
    y, cb, cr = (p.astype(np.int32) for p in full[:3])
    cb -= 128
    cr -= 128
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    out[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    out[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return out


# ------------------------------------------------------------------ columns


def payload_of(text: bytes) -> np.ndarray:
    """A text's bytes, filled up with 255 to a positive multiple of 576."""
    size = max(1, -(-len(text) // TILE)) * TILE
    return np.frombuffer(text.ljust(size, b"\xff"), np.uint8)


def write_files(payloads: list[np.ndarray]) -> list[bytes]:
    """A file of one or more images for each payload."""
    cut = [[p[a : a + CHUNK] for a in range(0, len(p), CHUNK)] for p in payloads]
    images = iter(write_images([x for c in cut for x in c]))
    return [b"".join(next(images) for _ in c) for c in cut]


def _batches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def store(docs: DataFrame) -> DataFrame:
    """Each row's ``doc_id``, ``n_bytes`` of its text and ``media``, the stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            sizes = np.diff(offsets)
            for a, e in _batches(sizes + TILE, BATCH_BYTES):
                payloads = [payload_of(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(a, e)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(sizes[a:e]), pa.array(write_files(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def read_back(files: list[bytes]) -> Iterator[tuple[bytes, list[np.ndarray]]]:
    """Each file's payload and RGB tensors."""
    per_file, coef = read_images(files)
    every = [i for images in per_file for i in images]
    planes = iter(samples(every, coef))
    for images in per_file:
        payload, tensors = [], []
        for i in images:
            n = int(next(c for c in i.comments if c.startswith(b"payload ")).split()[1])
            mine = coef[i.first[0] : i.first[0] + -(-n // 64)].reshape(-1)[:n]
            payload.append((mine + 128).astype(np.uint8).tobytes())
            tensors.append(rgb(i, next(planes)))
        yield b"".join(payload), tensors


def tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with each image's full-resolution RGB tensor: ``image`` (its number in the row), ``height``, ``width``, ``pixels`` (row by row, three bytes each)."""
    columns = media.columns
    names = [c for c in columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(columns.index(column)).to_pylist()
            for a, e in _batches(np.array([len(f or b"") for f in files]), BATCH_BYTES):
                rows, shapes = [], []
                images, coef = read_images([f or b"" for f in files[a:e]])
                planes = iter(samples([i for x in images for i in x], coef))
                for k, mine in enumerate(images):
                    for j, i in enumerate(mine):
                        t = rgb(i, next(planes))
                        rows.append(a + k), shapes.append((j, t.shape[0], t.shape[1], t.tobytes()))
                kept = b.take(pa.array(rows, pa.int64())) if rows else b.slice(0, 0)
                yield pa.RecordBatch.from_arrays([*(kept.column(columns.index(c)) for c in names), *(pa.array([s[m] for s in shapes], t) for m, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary())))], names=[*names, "image", "height", "width", "pixels"])

    return media.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != column) + ", image int, height int, width int, pixels binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each row's text, reads the stored bytes back, and describes both; ``feature``: size and mean colour of the pictures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(2).to_pylist()
            for a, e in _batches(np.array([len(f) for f in files]), BATCH_BYTES):
                rows = []
                for f, (payload, pictures) in zip(files[a:e], read_back(files[a:e])):
                    sums = sum(t.reshape(-1, 3).sum(0, dtype=np.int64) for t in pictures)
                    area = sum(t.shape[0] * t.shape[1] for t in pictures)
                    mean = ",".join(f"{s * 1000 // area / 1000:.3f}" for s in sums.tolist())
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), f"{len(pictures)}:{pictures[0].shape[1]}x{pictures[0].shape[0]}:{mean}"))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), b.column(1).slice(a, e - a), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return store(docs).mapInArrow(tidy(run), _DIGEST)
