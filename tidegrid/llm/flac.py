"""FLAC as a media column: mono streams with seek tables, coded and decoded over whole batches of frames.

The decoder takes frames of many streams at once and advances all of them one sample a step: it reads each
frame's Rice residual (both parameter widths, any partition order, escapes), adds the linear prediction (fixed
orders 0 to 4 as well as quantised LPC up to order 32), and verifies the CRC-8 of every frame header, the CRC-16
of every frame and the MD5 of the stream. Frames are found by the seek table if it lists them all; else each
step of decoding takes the next frame of every stream.

The coder writes frames of 1,024 samples and chooses between a constant, fixed predictors, an LPC of order 4 and
verbatim samples. It is deterministic: equal payloads give equal streams. A sample is a byte minus 128; for payloads
that are text, bytes are first put into a fixed order in which frequent ones lie around zero (``TEXT_ORDER``), where
Rice codes are short. Such streams say so by their sample rate, and ``decode`` and ``seek`` undo it.

Scale: one row is one task's own work, nothing is shuffled; a worker holds about a megabyte of payload at a
time, whatever the batch. A single long payload is cut into frames like any other.

Edge cases: null or empty text = 64 zero bytes as payload; equal texts give equal rows; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.llm.common import id_and_text, spread, steps

BLOCK, RATE, ORDER, PRECISION, SHIFT = 1024, 8000, 4, 12, 10
#: The rate that marks streams whose bytes are in text order, and the bytes that lie around zero there, by frequency.
TEXT_RATE, TEXT_ORDER = 8001, b" etanoirsdhluc,mfpg.wyvbk\nTAEIONSRDHLUCMFPGWYVBKxjqzXJQZ0123456789"
#: Payload bytes are padded with zeros to a multiple of this.
PAD = 64
#: Payload or stream bytes coded or decoded at once.
STEP = 1 << 20
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _text_code() -> tuple[bytes, np.ndarray]:
    """The byte that stands for each byte in text order, and the sample that each sample stands for."""
    order = [*TEXT_ORDER, *(b for b in range(256) if b not in TEXT_ORDER)]
    code = np.zeros(256, np.uint8)
    for rank, byte in enumerate(order):
        code[byte] = 128 + (rank >> 1 if rank % 2 == 0 else -(rank + 1 >> 1))
    back = np.zeros(256, np.int64)
    back[code] = np.arange(256) - 128
    return code.tobytes(), back


CODE, BACK = _text_code()


def _is_text(payload: bytes) -> bool:
    """Nine of ten bytes are among those of ``TEXT_ORDER`` (zeros of the padding don't count)."""
    other = len(payload.translate(None, TEXT_ORDER + b"\0"))
    return other * 10 <= len(payload) and payload.count(0) * 2 <= len(payload)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each range of bytes; shorter ones begin with zeros, which leave a CRC of zero as it is."""
    crc = np.zeros(len(starts), np.int64)
    keep = (1 << bits) - 1
    for back in range(int((stops - starts).max(initial=0)), 0, -1):
        at = stops - back
        byte = np.where(at >= starts, buf[np.maximum(at, 0)], 0)
        crc = (crc << 8 & keep) ^ table[crc >> (bits - 8) ^ byte]
    return crc


def _utf8(number: int) -> bytes:
    """A frame number in the extended UTF-8 form of up to 36 bits."""
    if number < 0x80:
        return bytes([number])
    extra = 1
    while number >= 1 << (5 * extra + 6):
        extra += 1
    lead = 0xFF00 >> (extra + 1) & 0xFF
    return bytes([lead | number >> (6 * extra), *(0x80 | number >> (6 * k) & 0x3F for k in range(extra - 1, -1, -1))])


@functools.lru_cache(65536)
def _frame_header(number: int, n: int) -> bytes:
    code, size = (10, b"") if n == 1024 else (6, bytes([n - 1])) if n <= 256 else (7, struct.pack(">H", n - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1]) + _utf8(number) + size
    crc = 0
    for b in head:
        crc = int(CRC8[crc ^ b])
    return head + bytes([crc])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray | int, width: int) -> None:
    for k in range(width):
        bits[at + k] = values >> (width - 1 - k) & 1


def _lpc(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Quantised coefficients of order 4 for each frame, zero where they don't fit the precision."""
    y = x.astype(np.float64)
    auto = np.stack([(y[:, k:] * y[:, : y.shape[1] - k]).sum(1) for k in range(ORDER + 1)], 1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-9
    error, coef = auto[:, 0].copy(), np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (auto[:, i + 1] - (coef[:, :i] * auto[:, i:0:-1]).sum(1)) / error
        coef[:, :i] -= k[:, None] * coef[:, :i][:, ::-1]
        coef[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    q = np.rint(coef * (1 << SHIFT))
    fits = (np.abs(q) < 1 << (PRECISION - 1)).all(1) & np.isfinite(q).all(1) & (lengths > ORDER)
    return np.where(fits[:, None], q, 0).astype(np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of 8-bit samples for each payload of at least 16 bytes."""
    text = [_is_text(p) for p in payloads]
    payloads = [p.translate(CODE) if t else p for p, t in zip(payloads, text, strict=True)]
    sizes = np.array([len(p) for p in payloads], np.int64)
    n_frames = -(-sizes // BLOCK)
    total = int(n_frames.sum())
    owner = np.repeat(np.arange(len(payloads)), n_frames)
    number = np.arange(total) - np.repeat(np.cumsum(n_frames) - n_frames, n_frames)
    n = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    flat = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    valid = np.arange(BLOCK) < n[:, None]
    x = np.zeros((total, BLOCK), np.int32)
    x[valid] = flat
    # Residuals of every predictor; the one with the least sum of magnitudes is taken.
    lpc = _lpc(x, n)
    kinds = [x]
    for _ in range(2):
        r = kinds[-1].copy()
        r[:, 1:] -= kinds[-1][:, :-1]
        kinds.append(r)
    guess = np.zeros(x.shape, np.int64)
    for j in range(ORDER):
        guess[:, j + 1 :] += lpc[:, j : j + 1] * x[:, : BLOCK - 1 - j]
    kinds.append((x - (guess >> SHIFT)).astype(np.int32))
    orders = np.array([0, 1, 2, ORDER])
    position = np.arange(BLOCK)
    costs = np.stack([np.abs(np.where(valid & (position >= o), r, 0)).sum(1) + 8 * o for o, r in zip(orders, kinds, strict=True)], 1)
    costs[:, 3] = np.where(lpc.any(1), costs[:, 3] + 30, 1 << 60)
    choice = costs.argmin(1)
    order = np.where(choice == 3, ORDER, choice)
    residual = np.choose(choice[:, None], kinds)
    coded = valid & (position >= order[:, None])
    u = np.where(coded, (residual << 1) ^ (residual >> 31), 0).astype(np.int64)
    n_coded = n - order
    lengths = np.stack([(u >> k).sum(1) + n_coded * (k + 1) for k in range(10)], 1)
    k = lengths.argmin(1)
    prefix = 8 + 8 * order + np.where(choice == 3, 9 + PRECISION * ORDER, 0) + 10
    body = prefix + lengths[np.arange(total), k]
    constant = ((x == x[:, :1]) | ~valid).all(1)
    verbatim = ~constant & (body >= 8 + 8 * n)
    rice = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    heads = [_frame_header(a, b) for a, b in zip(number.tolist(), n.tolist(), strict=True)]
    head_bytes = np.array([len(h) for h in heads])
    frame_bytes = head_bytes + (body + 7) // 8 + 2
    starts = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    at = (starts + head_bytes) * 8
    _put(bits, at, np.where(constant, 0, np.where(verbatim, 2, np.where(choice == 3, (32 + ORDER - 1) << 1, (8 + order) << 1))), 8)
    at = at + 8
    _put(bits, at[constant], x[constant, 0] & 255, 8)
    if verbatim.any():
        rows, cols = np.nonzero(valid & verbatim[:, None])
        _put(bits, at[rows] + 8 * cols, x[rows, cols] & 255, 8)
    for j in range(ORDER):
        warm = rice & (order > j)
        _put(bits, at[warm] + 8 * j, x[warm, j] & 255, 8)
    at = at + 8 * order
    own = rice & (choice == 3)
    _put(bits, at[own], PRECISION - 1, 4)
    _put(bits, at[own] + 4, SHIFT, 5)
    for j in range(ORDER):
        _put(bits, at[own] + 9 + PRECISION * j, lpc[own, j], PRECISION)
    at = at + np.where(choice == 3, 9 + PRECISION * ORDER, 0)
    _put(bits, at[rice] + 6, k[rice], 4)  # before it: method 0 and partition order 0
    at = at + 10
    rows, cols = np.nonzero(coded & rice[:, None])
    values, width = u[rows, cols], k[rows]
    quotient = values >> width
    ends = np.cumsum(quotient + 1 + width)
    before = ends - (quotient + 1 + width)
    counts = np.where(rice, n_coded, 0)
    firsts = np.cumsum(counts) - counts
    place = before - np.repeat(before[np.minimum(firsts, max(len(before) - 1, 0))] if len(before) else firsts, counts) + at[rows] + quotient
    bits[place] = 1
    for b in range(int(width.max(initial=0))):
        some = width > b
        bits[place[some] + width[some] - b] = values[some] >> b & 1
    out = np.packbits(bits)
    joined = np.frombuffer(b"".join(heads), np.uint8)
    out[spread(head_bytes, starts)] = joined
    crc = _crc(out, starts, starts + frame_bytes - 2, CRC16, 16)
    out[starts + frame_bytes - 2], out[starts + frame_bytes - 1] = crc >> 8, crc & 255
    frames, streams, first = out.tobytes(), [], 0
    signed = (flat & 255).astype(np.uint8).tobytes()
    done = 0
    for i, count in enumerate(n_frames.tolist()):
        span = slice(first, first + count)
        base, stop = int(starts[first]), int(starts[first + count - 1] + frame_bytes[first + count - 1])
        info = struct.pack(">HH", BLOCK, BLOCK) + int(frame_bytes[span].min()).to_bytes(3, "big") + int(frame_bytes[span].max()).to_bytes(3, "big")
        info += ((TEXT_RATE if text[i] else RATE) << 44 | 0 << 41 | 7 << 36 | int(sizes[i])).to_bytes(8, "big") + hashlib.md5(signed[done : done + int(sizes[i])]).digest()
        points = np.zeros(count, ">u8,>u8,>u2")
        points["f0"], points["f1"], points["f2"] = number[span] * BLOCK, starts[span] - base, n[span]
        table = points.tobytes() if 18 * count < 1 << 24 else b""
        streams.append(b"fLaC" + (0 if table else 128).to_bytes(1, "big") + (34).to_bytes(3, "big") + info + (b"\x83" + len(table).to_bytes(3, "big") + table if table else b"") + frames[base:stop])
        first, done = first + count, done + int(sizes[i])
    return streams


class Stream:
    """What the metadata of one stream says."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, np.zeros(0, ">u8,>u8,>u2")
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block, packed = struct.unpack(">H", block[2:4])[0], int.from_bytes(block[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind == 3:
                points = np.frombuffer(block, ">u8,>u8,>u2")
                self.points = points[points["f0"] != 2**64 - 1]
            at += 4 + size
        if self.channels != 1:
            raise ValueError("only mono streams are decoded")
        self.first = at
        self.listed = int(self.points["f2"].astype(np.int64).sum()) == self.samples and self.samples > 0


def decode_frames(buf: np.ndarray, starts: np.ndarray, stream_bits: int = 8) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The samples of the frames that start at ``starts``, the byte after each frame, and each frame's number or first sample."""
    buf = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(buf) - 8, np.uint64)
    for j in range(8):
        words |= buf[j : j + len(words)] << np.uint64(56 - 8 * j)
    raw = buf.astype(np.int64)

    def take(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """``width`` (0 to 32) bits at each bit place."""
        w = words[at >> 3] << (at & 7).astype(np.uint64)
        return (w >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        half = np.left_shift(1, np.maximum(np.asarray(width) - 1, 0))
        return (v ^ half) - half

    # Headers.
    if ((raw[starts] != 0xFF) | (raw[starts + 1] >> 2 != 0x3E)).any():
        raise ValueError("no frame where one is expected")
    size_code, rate_code = raw[starts + 2] >> 4, raw[starts + 2] & 15
    depth = np.array([stream_bits, 8, 12, 0, 16, 20, 24, 32])[raw[starts + 3] >> 1 & 7]
    lead = raw[starts + 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(extra == 0, lead, lead & (0x3F >> np.minimum(extra, 6)))
    for j in range(1, 7):
        number = np.where(extra >= j, number << 6 | raw[starts + 4 + np.minimum(j, extra)] & 0x3F, number)
    at = starts + 5 + extra
    n = np.select(
        [size_code == 1, size_code == 6, size_code == 7, size_code >= 8, size_code >= 2],
        [192, raw[at] + 1, (raw[at] << 8 | raw[at + 1]) + 1, 256 << np.maximum(size_code - 8, 0), 576 << np.maximum(size_code - 2, 0)],
        0,
    )
    at = at + np.where(size_code == 6, 1, np.where(size_code == 7, 2, 0)) + np.where(rate_code == 12, 1, np.where((rate_code == 13) | (rate_code == 14), 2, 0))
    if (_crc(raw, starts, at, CRC8, 8) != raw[at]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    p = (at + 1) * 8
    kind, wasted = take(p + 1, 6), take(p + 7, 1)
    p = p + 8
    for i in np.flatnonzero(wasted):
        while not take(p[i : i + 1] + wasted[i] - 1, 1)[0]:
            wasted[i] += 1
        p[i] += wasted[i]
    depth = depth - wasted
    order = np.select([(kind >= 8) & (kind <= 12), kind >= 32], [kind - 8, kind - 31], 0)
    is_lpc, rice = kind >= 32, kind >= 8
    total, longest = len(starts), int(n.max(initial=0))
    # Longest frames first: those that still have samples are then the first ones.
    by = np.argsort(-n, kind="stable")
    p, n, order, kind, is_lpc, rice, depth, wasted = (a[by] for a in (p, n, order, kind, is_lpc, rice, depth, wasted))
    most = int(order.max(initial=0))
    out = np.zeros((longest + most, total), np.int64)
    for j in range(most):
        own = np.flatnonzero(order > j)
        out[most + j, own] = signed(take(p[own], depth[own]), depth[own])
        p[own] += depth[own]
    coef, shift = np.zeros((most, total), np.int64), np.zeros(total, np.int64)
    for o in range(min(5, most + 1)):
        for j, c in enumerate(FIXED[o]):
            coef[j, (kind == 8 + o)] = c
    own = np.flatnonzero(is_lpc)
    if len(own):
        precision = take(p[own], 4) + 1
        shift[own] = take(p[own] + 4, 5)
        p[own] += 9
        for j in range(most):
            some = order[own] > j
            coef[j, own[some]] = signed(take(p[own[some]], precision[some]), precision[some])
            p[own[some]] += precision[some]
    wide = np.where(rice, take(p, 2), 0)
    parts = np.where(rice, take(p + 2, 4), 0)
    p = np.where(rice, p + 6, p)
    period = n >> parts
    k, raw_bits = np.zeros(total, np.int64), np.full(total, -1)
    plain = kind == 1
    constant = np.flatnonzero(kind == 0)
    value = signed(take(p[constant], depth[constant]), depth[constant])
    p[constant] += depth[constant]
    out[most:, constant] = value
    # Steps at which some frame reads a new Rice parameter.
    turns: dict[int, list[int]] = {}
    for i in np.flatnonzero(rice).tolist():
        for t in {int(order[i]), *range(int(period[i]), int(n[i]), int(period[i]))}:
            turns.setdefault(t, []).append(i)
    alive, lens = total, n.tolist()
    varied, any_plain, any_raw = most > 0, bool(plain.any()), False
    all_rice = bool(rice.all())
    for t in range(longest):
        while alive and lens[alive - 1] <= t:
            alive -= 1
        if t in turns:
            own = np.array(turns[t])
            bits = np.where(wide[own] == 1, 5, 4)
            k[own] = take(p[own], bits)
            p[own] += bits
            escape = k[own] == (1 << bits) - 1
            raw_bits[own] = -1
            if escape.any():
                raw_bits[own[escape]] = take(p[own[escape]], 5)
                p[own[escape]] += 5
            any_raw = bool((raw_bits >= 0).any())
        if all_rice and not any_raw and t >= most:
            own, q, kk, oo = slice(0, alive), p[:alive], k[:alive], out[most + t, :alive]
        else:
            go = rice[:alive] & (order[:alive] <= t) & (raw_bits[:alive] < 0)
            if any_plain:
                some = np.flatnonzero(plain[:alive])
                out[most + t, some] = signed(take(p[some], depth[some]), depth[some])
                p[some] += depth[some]
            if any_raw:
                some = np.flatnonzero(rice[:alive] & (order[:alive] <= t) & (raw_bits[:alive] >= 0))
                out[most + t, some] = signed(take(p[some], raw_bits[some]), raw_bits[some]) * (raw_bits[some] > 0)
                p[some] += raw_bits[some]
                out[most + t, some] += sum(coef[j, some] * out[most + t - 1 - j, some] for j in range(most)) >> shift[some]
            own = np.flatnonzero(go)
            q, kk = p[own], k[own]
        w = words[q >> 3] << (q & 7).astype(np.uint64)
        high = (w >> np.uint64(32)).astype(np.int64)
        zeros = 32 - np.frexp(high.astype(np.float64))[1]
        if not high.all():  # a quotient of 32 or more
            for i in np.flatnonzero(high == 0):
                run = 0
                while not take(q[i : i + 1] + run, 1)[0]:
                    run += 1
                zeros[i] = run
                w[i] = words[(q[i] + run) >> 3] << np.uint64((q[i] + run) & 7)
                w[i] >>= np.uint64(min(run, 31))
            long = zeros > 31
            w = np.where(long, w << np.uint64(31), w)
            w = w << np.where(long, 1, zeros + 1).astype(np.uint64)
        else:
            w = w << (zeros + 1).astype(np.uint64)
        u = (w >> np.uint64(1) >> (63 - kk).astype(np.uint64)).astype(np.int64) | zeros.astype(np.int64) << kk
        value = (u >> 1) ^ -(u & 1)
        if varied:
            guess = coef[0, own] * out[most + t - 1, own]
            for j in range(1, most):
                guess += coef[j, own] * out[most + t - 1 - j, own]
            value = value + (guess >> shift[own])
        out[most + t, own] = value
        p[own] = q + zeros + 1 + kk
    ends = (p + 7) >> 3
    at, stop = np.empty(total, np.int64), np.empty(total, np.int64)
    at[by], stop[by] = np.arange(total), ends
    if (_crc(raw, starts, stop, CRC16, 16) != (raw[stop] << 8 | raw[stop + 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    columns = np.ascontiguousarray((out[most:] << wasted).T)
    return [columns[i, : lens[i]] for i in at.tolist()], stop + 2, number


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, with every checksum verified."""
    heads = [Stream(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    buf = np.frombuffer(b"".join(streams), np.uint8)
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    listed = [i for i, h in enumerate(heads) if h.listed]
    if listed:
        starts = np.concatenate([heads[i].points["f1"].astype(np.int64) + heads[i].first + base[i] for i in listed])
        owner = np.repeat(listed, [len(heads[i].points) for i in listed])
        samples, stops, _ = decode_frames(buf, starts, heads[listed[0]].bits)
        follows = np.concatenate([starts[1:], base[[listed[-1] + 1]]])
        last = np.concatenate([owner[1:] != owner[:-1], [True]])
        if (stops != np.where(last, base[owner + 1], follows)).any():
            raise ValueError("frames and seek points disagree")
        for i, s in zip(owner.tolist(), samples, strict=True):
            parts[i].append(s)
    open_ = {i: int(base[i]) + h.first for i, h in enumerate(heads) if not h.listed}
    while open_ := {i: at for i, at in open_.items() if at < base[i + 1]}:
        samples, stops, _ = decode_frames(buf, np.array(list(open_.values())), heads[next(iter(open_))].bits)
        for i, s in zip(open_, samples, strict=True):
            parts[i].append(s)
        open_ = dict(zip(open_, stops.tolist(), strict=True))
    out = []
    for h, p in zip(heads, parts, strict=True):
        samples = np.concatenate(p) if p else np.zeros(0, np.int64)
        width = (h.bits + 7) // 8
        raw = samples.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        if any(h.md5) and hashlib.md5(raw).digest() != h.md5:
            raise ValueError("the stream's MD5 is wrong")
        out.append(BACK[samples + 128] if h.rate == TEXT_RATE else samples)
    return out


def seek(stream: bytes, sample: int) -> np.ndarray:
    """The samples of the frame that holds ``sample``, from that sample on, without decoding what lies before."""
    head = Stream(stream)
    if not head.listed:
        return decode([stream])[0][sample:]
    i = int(np.searchsorted(head.points["f0"].astype(np.int64), sample, side="right")) - 1
    samples, _, _ = decode_frames(np.frombuffer(stream, np.uint8), np.array([head.first + int(head.points["f1"][i])]), head.bits)
    rest = samples[0][sample - int(head.points["f0"][i]) :]
    return BACK[rest + 128] if head.rate == TEXT_RATE else rest


def payload(text: bytes) -> bytes:
    return text + bytes(PAD * max(1, -(-len(text) // PAD)) - len(text))


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's padded bytes as a FLAC stream."""
    return id_and_text(docs).mapInArrow(_encode_rows, "doc_id long, n_bytes long, media binary")


def _feature(x: np.ndarray) -> str:
    """Peak, energy, zero crossings and sum of steps of the samples, all whole numbers."""
    crossings, steps_ = int(((x[1:] < 0) != (x[:-1] < 0)).sum()), int(np.abs(np.diff(x)).sum())
    return f"samples={len(x)};peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={crossings};steps={steps_}"


def _blocks(x: np.ndarray, samples: int) -> list[tuple[int, np.ndarray]]:
    """The samples as PCM blocks: each block's first sample and its samples."""
    return [(a, x[a : a + samples]) for a in range(0, len(x), samples)]


def _read_rows(samples: int):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_block_offset"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "media", STEP):
            media, rows = batch.column(2).to_pylist(), []
            for stream, x in zip(media, decode(media), strict=True):
                blocks = _blocks(x, samples)
                data = b"".join((b + 128).astype(np.uint8).tobytes() for _, b in blocks)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), _feature(x), len(blocks), blocks[-1][0] if blocks else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return run


def media_features(media: DataFrame, samples: int = 4096) -> DataFrame:
    """Digests and a feature of each stream's decoded payload, taken from its PCM blocks of ``samples`` samples."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_block_offset long"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_rows(samples), schema)


def pcm_blocks(media: DataFrame, samples: int = 4096) -> DataFrame:
    """doc_id, block, sample_offset, n_samples and pcm (little-endian 16-bit) of every ``samples`` samples of a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "media", STEP):
            ids = batch.column(0).to_pylist()
            for doc, x in zip(ids, decode(batch.column(1).to_pylist()), strict=True):
                cut = _blocks(x, samples)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([a for a, _ in cut], pa.int64()), pa.array([len(c) for _, c in cut], pa.int32()), pa.array([c.astype("<i2").tobytes() for _, c in cut], pa.binary())],
                    names=["doc_id", "block", "sample_offset", "n_samples", "pcm"],
                )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, pcm binary")
