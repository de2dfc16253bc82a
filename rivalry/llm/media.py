"""Progressive JPEG columns: payload bytes as coefficients, scans decoded for many images at once, RGB tensors."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rivalry.llm.common import id_and_text

#: Payload bytes come in units of so many.
UNIT = 192
#: Blocks (or MCUs) of a restart interval; intervals are decoded side by side.
RESTART = 8
#: Bytes of texts, the frequent ones first; all others follow by value. Frequent bytes become small coefficients,
#: which takes fewer bits.
FREQUENT = b" etaoinsrhldcumfpgwybvk,.-'" + bytes([0xC3, 0xA9, 10]) + b"xjqzSETAICMPDRBNHLWFGOUVKJYQXZ0123456789"

# The zigzag order is the one that the standard gives.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Symbols by code length: short codes for small values without a run of zeros before them.
DC_SYMBOLS = list(range(9))
AC_LENGTHS = {2: [1, 2, 3], 3: [4], 5: [0, 5], 6: [6], 7: [7, 8], 8: [0x11, 0x12, 0x13]}
AC_LENGTHS[13] = [x for x in (*(r << 4 | s for r in range(16) for s in range(1, 9)), 0xF0) if x not in sum(AC_LENGTHS.values(), [])]
#: (components, first, last, high, low): DC first, low frequencies and then high ones of brightness, all of
#: chroma, then the refinements.
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0),
    ((0,), 6, 63, 0, 0), ((0,), 1, 5, 1, 0), ((0, 1, 2), 0, 0, 1, 0),
]


def _table(lengths: dict[int, list[int]]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    counts = bytes(len(lengths.get(n, [])) for n in range(1, 17))
    codes, code = {}, 0
    for n in range(1, 17):
        for s in lengths.get(n, []):
            codes[s] = (code, n)
            code += 1
        code <<= 1
    return counts + bytes(s for n in sorted(lengths) for s in lengths[n]), codes


_DC_BYTES, _DC = _table({4: DC_SYMBOLS})
_AC_BYTES, _AC = _table(AC_LENGTHS)
_DC_CODE, _DC_LEN = (np.array([_DC[s][i] for s in DC_SYMBOLS], np.uint64) for i in (0, 1))
_AC_CODE, _AC_LEN = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
for _s, (_c, _n) in _AC.items():
    _AC_CODE[_s], _AC_LEN[_s] = _c, _n


def _coefficients_of_bytes() -> np.ndarray:
    """1, -1, 2, -2, ... in the order of FREQUENT; the two rarest bytes become 0 and -128."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    rank = np.arange(256)
    value = np.where(rank % 2, -(rank // 2 + 1), rank // 2 + 1)
    value[254:] = 0, -128
    out = np.empty(256, np.int64)
    out[order] = value
    return out


#: The coefficient of each byte, and the byte of each coefficient (from -128 on).
_TO = _coefficients_of_bytes()
_FROM = (np.argsort(_TO)).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category of each value and its bits."""
    size = np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _pack(values: np.ndarray, bits: np.ndarray, streams: np.ndarray, n: int) -> list[bytes]:
    """Streams of (value, bits) entries in order, each filled up to a byte with ones and stuffed."""
    keep = bits > 0
    values, bits, streams = values[keep].astype(np.uint64), bits[keep].astype(np.int64), streams[keep]
    total = np.bincount(streams, bits, n).astype(np.int64)
    size = (total + 7) // 8
    start = np.concatenate(([0], np.cumsum(size)))
    first = np.concatenate(([0], np.cumsum(total)))
    at = np.cumsum(bits) - bits - first[streams] + 8 * start[streams]
    fill = 8 * size - total
    values = np.concatenate((values, ((1 << fill) - 1).astype(np.uint64)))
    at, bits = np.concatenate((at, 8 * start[:-1] + total)), np.concatenate((bits, fill))
    order = np.argsort(at, kind="stable")
    values, at, bits = values[order], at[order], bits[order]
    keep = bits > 0
    values, at, bits = values[keep], at[keep], bits[keep]
    words = np.zeros(int(start[-1]) // 8 + 2, np.uint64)
    if len(at):
        word, shift = at >> 6, at & 63
        left = 64 - shift - bits
        high = np.where(left >= 0, values << np.maximum(left, 0).astype(np.uint64), values >> np.maximum(-left, 0).astype(np.uint64))
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[heads]] = np.bitwise_or.reduceat(high, heads)
        over = np.flatnonzero(left < 0)
        words[word[over] + 1] |= values[over] << (64 + left[over]).astype(np.uint64)
    data = words.astype(">u8").tobytes()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def _shape(units: int) -> tuple[int, int]:
    """MCU columns and rows for so many units; an MCU (4:2:0) holds two."""
    mcus = -(-units // 2)
    cols = min(mcus, max(64, -(-mcus // 4000)))
    return cols, -(-mcus // cols)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 JPEG of each payload (a positive multiple of UNIT bytes): one byte is one quantised coefficient."""
    shapes = [_shape(len(p) // UNIT) for p in payloads]
    mcus = [c * r for c, r in shapes]
    planes: list[list[np.ndarray]] = [[], [], []]
    for p, m in zip(payloads, mcus, strict=True):
        v = np.zeros(m * 384, np.int64)
        v[: len(p)] = _TO[np.frombuffer(p, np.uint8)]
        blocks = v.reshape(m * 6, 64)
        for plane, part in zip(planes, (blocks[: 4 * m], blocks[4 * m : 5 * m], blocks[5 * m :]), strict=True):
            plane.append(part)
    coefs = [np.concatenate(x) for x in planes]
    scans = []
    for comps, first, last, high, low in SCRIPT:
        per_block = [4, 1, 1]
        parts = []
        for c in comps:
            counts = np.array([m * per_block[c] for m in mcus])
            begin = np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(mcus)), counts)
            own = np.arange(len(doc)) - begin[doc]
            parts.append((doc, own))
        if first == 0:
            intervals = np.array([-(-m // RESTART) for m in mcus])
            base = np.cumsum(intervals) - intervals
            rows, keys = [], []
            for c in comps:
                doc, own = parts[c]
                # blocks of component 0 are taken four to an MCU, in the order that the scan meets them
                mcu, k = (own // 4, own % 4) if c == 0 else (own, np.full(len(own), 3 + c))
                rows.append(np.stack((doc, mcu, k, coefs[c][_scan_order(shapes, mcus)[0] if c == 0 else slice(None), 0]), 1))
                keys.append(mcu)
            rows = np.concatenate(rows)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            doc, mcu, k, v = rows.T
            stream = base[doc] + mcu // RESTART
            if high:
                bits = np.ones(len(v), np.int64)
                scans.append((_pack(v & 1, bits, stream, int(intervals.sum())), intervals, base))
                continue
            v = v >> low
            comp = np.maximum(k - 3, 0)
            diff = v.copy()
            for c in range(3):
                own = np.flatnonzero(comp == c)
                d = v[own].copy()
                same = stream[own][1:] == stream[own][:-1]
                d[1:] -= np.where(same, v[own][:-1], 0)
                diff[own] = d
            size, extra = _magnitude(diff)
            value = _DC_CODE[size] << size.astype(np.uint64) | extra.astype(np.uint64)
            scans.append((_pack(value, _DC_LEN[size].astype(np.int64) + size, stream, int(intervals.sum())), intervals, base))
            continue
        c = comps[0]
        doc, own = parts[0]
        counts = np.array([m * per_block[c] for m in mcus])
        intervals = -(-counts // RESTART)
        base = np.cumsum(intervals) - intervals
        stream = base[doc] + own // RESTART
        whole = coefs[c][:, first : last + 1]
        v = np.sign(whole) * (np.abs(whole) >> low)
        n, width = v.shape
        k = np.arange(width)
        if high:
            old = np.abs(whole) >> high > 0
            new = ~old & (v != 0)
            # correction bits go behind the code of the next new coefficient, or of the end of the block
            value = np.zeros((n, width + 1), np.uint64)
            bits = np.zeros((n, width + 1), np.int64)
            pend_v, pend_n, zeros = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for j in range(width):
                o, w = old[:, j], new[:, j]
                symbol = zeros << 4 | 1
                head = _AC_CODE[symbol] << np.uint64(1) | (v[:, j] > 0).astype(np.uint64)
                value[:, j] = np.where(w, head << pend_n.astype(np.uint64) | pend_v, 0)
                bits[:, j] = np.where(w, _AC_LEN[symbol].astype(np.int64) + 1 + pend_n, 0)
                pend_v = np.where(w, 0, np.where(o, pend_v << np.uint64(1) | (np.abs(whole[:, j]) & 1).astype(np.uint64), pend_v))
                pend_n = np.where(w, 0, pend_n + o)
                zeros = np.where(w, 0, zeros + ~(o | w))
            tail = (pend_n > 0) | (zeros > 0)
            value[:, width] = np.where(tail, _AC_CODE[0] << pend_n.astype(np.uint64) | pend_v, 0)
            bits[:, width] = np.where(tail, _AC_LEN[0].astype(np.int64) + pend_n, 0)
        else:
            on = v != 0
            seen = np.maximum.accumulate(np.where(on, k, -1), 1)
            before = np.concatenate((np.full((n, 1), -1), seen[:, :-1]), 1)
            run = k - before - 1
            size, extra = _magnitude(v)
            symbol = (run & 15) << 4 | size
            zrl = run >> 4
            value = _AC_CODE[symbol] << size.astype(np.uint64) | extra.astype(np.uint64)
            length = _AC_LEN[symbol].astype(np.int64) + size
            for i in range(1, 4):
                far = zrl >= i
                value = np.where(far, value | _AC_CODE[0xF0] << length.astype(np.uint64), value)
                length = np.where(far, length + _AC_LEN[0xF0].astype(np.int64), length)
            tail = seen[:, -1] < width - 1
            value = np.concatenate((np.where(on, value, 0), np.where(tail, _AC_CODE[0], 0)[:, None].astype(np.uint64)), 1)
            bits = np.concatenate((np.where(on, length, 0), np.where(tail, _AC_LEN[0], 0)[:, None].astype(np.int64)), 1)
        scans.append((_pack(value.ravel(), bits.ravel(), np.repeat(stream, bits.shape[1]), int(intervals.sum())), intervals, base))
    out = []
    tables = _segment(0xDB, b"\x00" + b"\x01" * 64)
    codes = _segment(0xC4, b"\x00" + _DC_BYTES) + _segment(0xC4, b"\x10" + _AC_BYTES) + _segment(0xDD, struct.pack(">H", RESTART))
    for i, p in enumerate(payloads):
        cols, rows = shapes[i]
        frame = struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        parts = [b"\xff\xd8", _segment(0xFE, f"units={len(p) // UNIT}".encode()), tables, _segment(0xC2, frame), codes]
        for (comps, first, last, high, low), (streams, intervals, base) in zip(SCRIPT, scans, strict=True):
            head = bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([first, last, high << 4 | low])
            parts.append(_segment(0xDA, head))
            own = streams[base[i] : base[i] + intervals[i]]
            for j, s in enumerate(own):
                if j:
                    parts.append(bytes([0xFF, 0xD0 + (j - 1) % 8]))
                parts.append(s)
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def _scan_order(shapes, mcus) -> tuple[np.ndarray]:
    """For component 0: the raster position of the block that an interleaved scan meets at each place."""
    out, begin = [], 0
    for (cols, _), m in zip(shapes, mcus, strict=True):
        mcu, k = np.divmod(np.arange(4 * m), 4)
        y, x = 2 * (mcu // cols) + k // 2, 2 * (mcu % cols) + k % 2
        out.append(begin + y * 2 * cols + x)
        begin += 4 * m
    return (np.concatenate(out),)


# ---- reading


@dataclass
class Scan:
    comps: list[int]
    first: int
    last: int
    high: int
    low: int
    dc: list[int]
    ac: list[int]
    streams: list[bytes]
    restart: int


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comps: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    scans: list[Scan] = field(default_factory=list)

    def grid(self, c: int) -> tuple[int, int, int, int]:
        """Blocks of component c: columns and rows that hold picture, stored columns and rows."""
        _, h, v, _ = self.comps[c]
        hm, vm = max(x[1] for x in self.comps), max(x[2] for x in self.comps)
        mx, my = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        own = -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)
        return *own, mx * h, my * v


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")
_LUTS: dict[bytes, int] = {}
_LUT = np.zeros((64, 65536), np.uint16)


def _lut(body: bytes) -> int:
    """Number of the lookup table (16 bits -> length << 8 | symbol) of a Huffman table."""
    if body not in _LUTS:
        if len(_LUTS) == len(_LUT):
            _LUTS.clear()
        row = np.zeros(65536, np.uint16)
        code, at = 0, 16
        for n in range(1, 17):
            for s in body[at : at + body[n - 1]]:
                row[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
                code += 1
            at += body[n - 1]
            code <<= 1
        _LUT[len(_LUTS)] = row
        _LUTS[body] = len(_LUTS)
    return _LUTS[body]


def parse(data: bytes) -> Frame:
    """Segments of a progressive JPEG; entropy-coded data is cut at restart markers and unstuffed."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    f, at, restart = Frame(), 2, 0
    tables: dict[int, int] = {}
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return f
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            f.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                f.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC2:
            f.height, f.width, n = struct.unpack(">HHB", body[1:6])
            f.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = _lut(body[1:n])
                body = body[n:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            ids = [c[0] for c in f.comps]
            comps = [ids.index(body[1 + 2 * i]) for i in range(n)]
            dc, ac = ([tables.get(kind | (body[2 + 2 * i] >> shift & 15), 0) for i in range(n)] for kind, shift in ((0, 4), (16, 0)))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            streams = [s.replace(b"\xff\x00", b"\xff") for s in _RST.split(data[at:stop])]
            f.scans.append(Scan(comps, first, last, bits >> 4, bits & 15, dc, ac, streams, restart))
            at = stop


class _Bits:
    """40-bit windows at every byte of joined streams."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) + 8 for s in streams])
        self.start = (np.cumsum(sizes) - sizes) * 8
        b = np.frombuffer((b"\0" * 8).join(streams) + b"\0" * 16, np.uint8).astype(np.int64)
        self.window = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]

    def peek(self, pos: np.ndarray, n) -> np.ndarray:
        return self.window[pos >> 3] >> (40 - (pos & 7) - n) & ((1 << n) - 1)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v) * (s > 0)


def coefficients(frames: list[Frame]) -> list[list[np.ndarray]]:
    """Coefficients (blocks, 64) in zigzag order of each component of each frame; all frames are decoded side by side."""
    base, total = [], 0
    for f in frames:
        own = []
        for c in range(len(f.comps)):
            own.append(total)
            total += f.grid(c)[2] * f.grid(c)[3]
        base.append(own)
    out = np.zeros((total, 64), np.int64)
    flat = out.reshape(-1)
    turns = [_turns(f) for f in frames]
    for no in range(max(map(len, turns), default=0)):
        groups = defaultdict(list)
        for i, f in enumerate(frames):
            for s in turns[i][no] if no < len(turns[i]) else ():
                layout = tuple((c, *f.comps[c][1:3]) for c in s.comps) if len(s.comps) > 1 else ()
                groups[s.first, s.last, s.high, s.low, layout].append((i, s))
        for (first, last, high, low, _), own in groups.items():
            streams, which, number, restart, units = [], [], [], [], []
            for j, (i, s) in enumerate(own):
                f = frames[i]
                n = f.grid(s.comps[0])[0] * f.grid(s.comps[0])[1]
                if len(s.comps) > 1:
                    _, h, v, _ = f.comps[s.comps[0]]
                    n = (f.grid(s.comps[0])[2] // h) * (f.grid(s.comps[0])[3] // v)
                k = len(s.streams)
                streams += s.streams
                which += [j] * k
                number += range(k)
                restart += [s.restart or n] * k
                units += [n] * k
            bits = _Bits(streams)
            which, number, restart, units = (np.array(x, np.int64) for x in (which, number, restart, units))
            begin = number * restart
            count = np.clip(units - begin, 0, restart)
            if first == 0:
                _dc(bits, frames, own, which, begin, count, base, flat, high, low)
            else:
                grids = np.array([frames[i].grid(s.comps[0]) for i, s in own])
                own_base = np.array([base[i][s.comps[0]] for i, s in own])[which]
                table = np.array([s.ac[0] for _, s in own])[which]
                cols, stride = grids[which, 0], grids[which, 2]
                (_ac_refine if high else _ac_first)(bits, begin, count, own_base, cols, stride, table, flat, first, last, low)
    return [
        [out[b : b + f.grid(c)[2] * f.grid(c)[3]] for c, b in enumerate(own)] for f, own in zip(frames, base, strict=True)
    ]


def _turns(f: Frame) -> list[list[Scan]]:
    """Scans of different components and one band, in a row, don't depend on each other and are decoded together."""
    out: list[list[Scan]] = []
    for s in f.scans:
        alike = out and len(s.comps) == len(out[-1][0].comps) == 1 and s.first > 0
        same = alike and all((s.first, s.last, s.high, s.low) == (o.first, o.last, o.high, o.low) and s.comps != o.comps for o in out[-1])
        if same:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def _dc(bits, frames, own, which, begin, count, base, flat, high, low) -> None:
    i0, one = own[0]
    f0 = frames[i0]
    if len(one.comps) > 1:
        order = [(j, c, x, y, *f0.comps[c][1:3]) for j, c in enumerate(one.comps) for y in range(f0.comps[c][2]) for x in range(f0.comps[c][1])]
    else:
        order = [(0, one.comps[0], 0, 0, 1, 1)]
    pos = bits.start.copy()
    pred = np.zeros((len(one.comps), len(which)), np.int64)
    where = []
    for j, _, x, y, h, v in order:
        grids = np.array([frames[i].grid(s.comps[j]) for i, s in own])[which]
        at = np.array([base[i][s.comps[j]] for i, s in own])[which]
        stride = grids[:, 2]
        cols = stride // h if len(one.comps) > 1 else grids[:, 0]
        table = np.array([s.dc[j] for _, s in own])[which]
        where.append((j, at, stride, cols, table, x, y, h, v))
    for t in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > t)
        unit = begin[on] + t
        for j, at, stride, cols, table, x, y, h, v in where:
            block = at[on] + (unit // cols[on] * v + y) * stride[on] + unit % cols[on] * h + x
            p = pos[on]
            if high:
                flat[block * 64] |= bits.peek(p, 1) << low
                pos[on] = p + 1
                continue
            code = _LUT[table[on], bits.peek(p, 16)].astype(np.int64)
            n, s = code >> 8, code & 255
            pred[j, on] += _extend(bits.peek(p + n, s), s)
            pos[on] = p + n + s
            flat[block * 64] = pred[j, on] << low


def _blocks(begin, done, own_base, cols, stride):
    unit = begin + done
    return own_base + unit // cols * stride + unit % cols


def _ac_first(bits, begin, count, own_base, cols, stride, table, flat, first, last, low) -> None:
    n = len(begin)
    pos, done, k, eob = bits.start.copy(), np.zeros(n, np.int64), np.full(n, first), np.zeros(n, np.int64)
    on = np.flatnonzero(count > 0)
    while len(on):
        skip = eob[on] > 0
        if skip.any():
            rest = on[skip]
            many = np.minimum(eob[rest], count[rest] - done[rest])
            eob[rest] -= many
            done[rest] += many
            on = on[done[on] < count[on]]
            if not len(on):
                break
        p, kk = pos[on], k[on]
        window = bits.window[p >> 3]
        left = 40 - (p & 7)
        code = _LUT[table[on], window >> (left - 16) & 0xFFFF].astype(np.int64)
        size, symbol = code >> 8, code & 255
        r, s = symbol >> 4, symbol & 15
        end = (s == 0) & (r < 15)
        extra = np.where(end, r, s)
        v = window >> (left - size - extra) & ((1 << extra) - 1)
        pos[on] = p + size + extra
        kk = kk + np.where(end, 0, r)
        put = s > 0
        if put.any():
            at = on[put]
            block = _blocks(begin[at], done[at], own_base[at], cols[at], stride[at])
            flat[block * 64 + kk[put]] = _extend(v[put], s[put]) << low
        kk = kk + 1
        full = end | (kk > last)
        eob[on] = np.where(end, (1 << r) + v - 1, 0)
        done[on] += full
        k[on] = np.where(full, first, kk)
        if full.any():
            on = on[done[on] < count[on]]


def _ac_refine(bits, begin, count, own_base, cols, stride, table, flat, first, last, low) -> None:
    n = len(begin)
    pos, done, k, eob = bits.start.copy(), np.zeros(n, np.int64), np.full(n, first), np.zeros(n, np.int64)
    run, new, ask = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    one = 1 << low
    on = np.flatnonzero(count > 0)
    while len(on):
        need = on[ask[on] & (eob[on] == 0)]
        if len(need):
            p = pos[need]
            code = _LUT[table[need], bits.peek(p, 16)].astype(np.int64)
            size, r, s = code >> 8, code >> 4 & 15, code & 15
            end = (s == 0) & (r < 15)
            extra = np.where(end, r, s)
            v = bits.peek(p + size, extra)
            pos[need] = p + size + extra
            eob[need] = np.where(end, (1 << r) + v, 0)
            run[need] = r
            new[need] = np.where(s > 0, np.where(v > 0, one, -one), 0)
            ask[need] = False
        at = _blocks(begin[on], done[on], own_base[on], cols[on], stride[on]) * 64 + k[on]
        c = flat[at]
        old = c != 0
        p = pos[on]
        bit = np.where(old, bits.peek(p, 1), 0)
        pos[on] = p + old
        c = c + np.where((bit > 0) & (np.abs(c) & one == 0), np.sign(c) * one, 0)
        take = ~old & (eob[on] == 0) & (run[on] == 0)
        c = np.where(take, new[on], c)
        run[on] -= ~old & (eob[on] == 0) & ~take
        ask[on] |= take
        flat[at] = c
        k[on] += 1
        full = k[on] > last
        if full.any():
            over = on[full]
            k[over], ask[over] = first, True
            eob[over] = np.maximum(eob[over] - 1, 0)
            done[over] += 1
            on = on[done[on] < count[on]]


_ANGLE = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)
#: Whole numbers, scaled by 2 ** 13: float64 products and sums of them are exact, in whatever order they are added.
_INVERSE = np.round(np.einsum("yv,xu->vuyx", _ANGLE, _ANGLE).reshape(64, 64) * 8192)[ZIGZAG]


def samples(frames: list[Frame], coefs: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Planes of 8-bit samples of each component, by the inverse transform of all blocks of all frames at once."""
    rows, parts = [], []
    for f, own in zip(frames, coefs, strict=True):
        for c, blocks in enumerate(own):
            rows.append((blocks * f.quant[f.comps[c][3]]).astype(np.float64))
            parts.append((f.grid(c)[3], f.grid(c)[2]))
    pixels = np.clip(np.floor(np.concatenate(rows) @ _INVERSE / 8192 + 128.5), 0, 255).astype(np.uint8)
    out, at, part = [], 0, iter(parts)
    for f in frames:
        planes = []
        for _ in f.comps:
            h, w = next(part)
            planes.append(pixels[at : at + h * w].reshape(h, w, 8, 8).swapaxes(1, 2).reshape(h * 8, w * 8))
            at += h * w
        out.append(planes)
    return out


def rgb(frame: Frame, planes: list[np.ndarray]) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3): chroma samples are repeated over the pixels that they cover."""
    hm, vm = max(x[1] for x in frame.comps), max(x[2] for x in frame.comps)
    full = []
    for (_, h, v, _), plane in zip(frame.comps, planes, strict=True):
        if vm != v:
            plane = np.repeat(plane, vm // v, 0)
        if hm != h:
            plane = np.repeat(plane, hm // h, 1)
        full.append(plane[: frame.height, : frame.width].astype(np.int32))
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    for i, x in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[:, :, i] = np.clip(x + 32768 >> 16, 0, 255)
    return out


def payload_of(frame: Frame, coefs: list[np.ndarray]) -> bytes:
    """The payload that encode() has stored."""
    units = int(frame.comment.removeprefix(b"units="))
    return _FROM[np.concatenate(coefs).reshape(-1)[: units * UNIT] + 128].tobytes()


def padded(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _chunks(sizes: list[int], most: int = 1 << 20):
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): the UTF-8 text of each row, padded to whole units, as a progressive JPEG.

    A null or empty text is one unit of padding; a very long one is one larger image. Equal texts give equal
    media; repeated rows and null ids are kept; other columns, whatever their names, are not read; an empty
    table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)

    def rows(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in _chunks([len(t) for t in texts]):
                media = encode([padded(t) for t in texts[a:b]])
                n = pa.array([len(t) for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def decode_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """media (doc_id, n_bytes, media) -> payload, height, width, feature and, with tensors, the RGB tensor as rgb.

    Scans are accumulated into coefficient arrays, transformed and upsampled for about a megabyte of files at
    once; a longer file is decoded alone. feature: the shape, the mean of each channel in thousandths
    (floored) and the CRC-32 of the tensor. rgb: height * width * 3 bytes, rows from the top, red, green, blue.
    A file that isn't a whole progressive JPEG fails the job; a null one gives nulls; a file that encode()
    hasn't made has no payload (null). Repeated rows are decoded each; other columns aren't read; an empty
    table gives no rows.
    """
    kind = dict(media.dtypes)["doc_id"]

    def rows(batches):
        names = ["doc_id", "n_bytes", "media", "payload", "height", "width", "feature"] + ["rgb"] * tensors
        for batch in batches:
            files = batch.column("media").to_pylist()
            for a, b in _chunks([len(x or b"") for x in files]):
                at = [i for i in range(a, b) if files[i] is not None]
                frames = [parse(files[i]) for i in at]
                coefs = coefficients(frames)
                planes = samples(frames, coefs) if frames else []
                got: dict[int, tuple] = {}
                for i, f, c, p in zip(at, frames, coefs, planes, strict=True):
                    image = rgb(f, p)
                    means = image.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (f.height * f.width)
                    feature = f"{f.height}x{f.width}:{','.join(map(str, means))}:{zlib.crc32(image):08x}"
                    stored = payload_of(f, c) if f.comment.startswith(b"units=") else None
                    got[i] = (stored, f.height, f.width, feature, image.tobytes() if tensors else None)
                cells = [got.get(i, (None,) * 5) for i in range(a, b)]
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
                cols = [pa.array([x[j] for x in cells], kinds[j]) for j in range(4 + tensors)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in names[:3]] + cols, names)

    out = f"doc_id {kind}, n_bytes long, media binary, payload binary, height int, width int, feature string" + ", rgb binary" * tensors
    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, out)


