"""FLAC columns: decoding to PCM blocks with seekable sample offsets (operator 5).

Streams are decoded many at a time. Frames are found by their sync code and header checksum, and
delimited by the checksum that ends them, so no frame has to be decoded to find the next. All frames
of a batch with one shape then advance together, sample by sample, in numpy: each step reads one Rice
residual of every frame (the zeros before the next one bit from a table over 16 bits, the low bits
from the same 64-bit load) and adds each frame's linear prediction.

Decoded are constant, verbatim, fixed and LPC subframes, wasted bits, all stereo decorrelations,
both Rice methods with escapes, and block sizes that vary. Verified are header checksums (CRC-8),
frame checksums (CRC-16) and the MD5 sum of the whole stream.

Result, one row for each frame: id, block, sample_offset (of its first sample in the stream),
n_samples, channels, bits, sample_rate, pcm (interleaved little-endian samples of
ceil(bits / 8) bytes), frame_ok and stream_ok (all frames are good and the MD5 sum agrees, or is not given).

Defined results: a frame whose checksum fails, or that cannot be decoded, has a null pcm and
frame_ok false, and its stream stream_ok false; a value that is null, empty or no FLAC stream gives
one row with block -1, nulls and stream_ok false; a stream without frames gives one row with block
-1 whose stream_ok tells whether it should be empty; rows are independent, so repeated ids each give
their blocks; further columns are ignored.

`encode` writes streams (fixed and LPC subframes); it serves to make the column from a numeric table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.tables import small_batches

SCHEMA = "id bigint, block int, sample_offset bigint, n_samples int, channels int, bits int, sample_rate int, pcm binary, frame_ok boolean, stream_ok boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
STREAM_BYTES = 4 << 20  #: of streams that are decoded together, and of samples that are handed on together
GROUP_SAMPLES = 1 << 20  #: of frames that advance together


def _table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8, _CRC16 = CRC8.tolist(), CRC16.tolist()
_ZEROS16 = np.array([16] + [16 - int(x).bit_length() for x in range(1, 1 << 16)], np.int64)
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])
_BITS = (0, 8, 12, 0, 16, 20, 24, 32)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ b]
    return c


def crc16_all(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of each byte range; all ranges advance together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    s, n = starts[order], size[order]
    c = np.zeros(len(s), np.int64)
    live = len(s)
    for k in range(int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= k:
            live -= 1
        x = c[:live]
        c[:live] = ((x << 8) & 0xFFFF) ^ CRC16[(x >> 8) ^ buf[s[:live] + k]]
    out = np.empty(len(c), np.int64)
    out[order] = c
    return out


@dataclass
class Stream:
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    audio: int  #: byte at which frames start
    fixed_block: int


def read_header(data: bytes) -> Stream | None:
    """STREAMINFO and the place of the first frame; None if this is no FLAC stream."""
    if data is None or data[:4] != b"fLaC":
        return None
    at, info = 4, None
    while at + 4 <= len(data):
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(body) == 34:
            x = int.from_bytes(body[10:18], "big")
            info = Stream(x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:], 0, int.from_bytes(body[0:2], "big"))
        if last:
            break
    else:
        return None
    if info is None or at > len(data):
        return None
    info.audio = at
    return info


def frame_header(d: bytes, at: int, info: Stream) -> tuple[int, int, int, int, int, bool] | None:
    """(size of the header, block size, channel code, bits, number, is the number that of a sample), or None."""
    if at + 6 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8 or d[at + 3] & 1:
        return None
    block, rate, channel, bits = d[at + 2] >> 4, d[at + 2] & 15, d[at + 3] >> 4, d[at + 3] >> 1 & 7
    if block == 0 or rate == 15 or channel > 10 or bits == 3:
        return None
    p = at + 4
    lead = 0
    while lead < 8 and d[p] << lead & 0x80:
        lead += 1
    if lead == 1 or lead == 8:
        return None
    number = d[p] & (0x7F >> lead)
    p += 1
    for _ in range(max(0, lead - 1)):
        if p >= len(d) or d[p] & 0xC0 != 0x80:
            return None
        number = number << 6 | d[p] & 63
        p += 1
    extra = {6: 1, 7: 2}.get(block, 0)
    if p + extra + 3 > len(d):
        return None
    size = int.from_bytes(d[p : p + extra], "big") + 1 if extra else 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8
    p += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(d) or crc8(d[at:p]) != d[p]:
        return None
    return p + 1 - at, size, channel, _BITS[bits] or info.bits, number, bool(d[at + 1] & 1)


class Bits:
    """Reading from many places of one buffer at once; pos are bits."""

    def __init__(self, buf: np.ndarray) -> None:
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        self.view = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
        self.end = 8 * len(buf)

    def top(self, pos: np.ndarray) -> np.ndarray:
        """64 bits from pos on, of which at least 57 are good."""
        p = np.minimum(pos, self.end)
        return self.view[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.asarray(n)
        got = self.top(pos) >> (64 - np.maximum(n, 1)).astype(np.uint64)
        return np.where(n > 0, got, 0).astype(np.int64)

    def signed(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.asarray(n)
        v = self.read(pos, n)
        return v - (((v >> np.maximum(n - 1, 0)) & 1) << n) * (n > 0)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one bit."""
        out = _ZEROS16[(self.top(pos) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(out == 16)
        while len(more):
            z = _ZEROS16[(self.top(pos[more] + out[more]) >> np.uint64(48)).astype(np.int64)]
            out[more] += z
            more = more[(z == 16) & (pos[more] + out[more] < self.end)]
        return out


def subframes(r: Bits, pos: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples, bits behind, is valid) of one subframe of each frame; all have n samples."""
    count = len(pos)
    head = r.read(pos, 8)
    pos = pos + 8
    kind = head >> 1 & 63
    wasted = np.zeros(count, np.int64)
    w = np.flatnonzero(head & 1)
    wasted[w] = r.unary(pos[w]) + 1
    pos[w] += wasted[w]
    bits = bits - wasted
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    good = ((kind < 2) | fixed | lpc) & (head < 128) & (bits > 0)
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0)) * good
    good &= order <= n
    most = int(order.max(initial=0))
    s = np.zeros((count, most + n), np.int64)  # `most` zeros before the first sample
    f = np.flatnonzero(good & (kind == 0))
    s[f, most:] = r.signed(pos[f], bits[f])[:, None]
    pos[f] += bits[f]
    f = np.flatnonzero(good & (kind == 1))
    for k in range(n if len(f) else 0):
        s[f, most + k] = r.signed(pos[f], bits[f])
        pos[f] += bits[f]
    for k in range(most):
        f = np.flatnonzero(good & (order > k))
        s[f, most + k] = r.signed(pos[f], bits[f])
        pos[f] += bits[f]
    coef, shift = np.zeros((count, most), np.int64), np.zeros(count, np.int64)  # coef: the last is that of the sample before
    for o in range(1, 5):
        f = np.flatnonzero(good & fixed & (order == o))
        if len(f):
            coef[f, most - o :] = np.array(_FIXED[o][::-1])
    f = np.flatnonzero(good & lpc)
    if len(f):
        precision = r.read(pos[f], 4) + 1
        shift[f] = r.signed(pos[f] + 4, 5)
        good[f] &= (precision < 16) & (shift[f] >= 0)
        shift[f] = np.maximum(shift[f], 0)
        pos[f] += 9
        for k in range(int(order[f].max())):
            g = order[f] > k
            coef[f[g], most - 1 - k] = r.signed(pos[f[g]], precision[g])
            pos[f[g]] += precision[g]
    a = np.flatnonzero(good & (fixed | lpc))
    if len(a):
        method, parts = r.read(pos[a], 2), r.read(pos[a] + 2, 4)
        pos[a] += 6
        size = n >> parts
        bad = (method > 1) | (size << parts != n) | (order[a] > size)
        good[a[bad]] = False
        a, method, size = a[~bad], method[~bad], size[~bad]
    if len(a):
        p, o, c, sh = pos[a], order[a], coef[a], shift[a]
        width, escape = 4 + method, np.where(method == 0, 15, 31)
        k_, raw = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        for i in range(n):
            new = (i >= o) & ((i == o) | (i % np.maximum(size, 1) == 0))
            again = (i == o) & (o > 0) & (i % np.maximum(size, 1) == 0)  # the first partition has no residual
            for mask in (again, new):
                if mask.any():
                    q = np.flatnonzero(mask)
                    k_[q] = r.read(p[q], width[q])
                    p[q] += width[q]
                    raw[q] = k_[q] == escape[q]
                    e = q[raw[q]]
                    k_[e] = r.read(p[e], 5)
                    p[e] += 5
            live = slice(None) if i >= most else np.flatnonzero(i >= o)
            pl, kl = p[live], k_[live]
            if not len(pl):
                continue
            top = r.top(pl)
            zeros = _ZEROS16[(top >> np.uint64(48)).astype(np.int64)]
            far = np.flatnonzero(zeros == 16)
            if len(far):
                zeros[far] = r.unary(pl[far])
            near = zeros + 1 + kl <= 57
            low = ((top << np.minimum(zeros + 1, 63).astype(np.uint64)) >> (64 - np.maximum(kl, 1)).astype(np.uint64)).astype(np.int64)
            if not near.all():
                f = np.flatnonzero(~near)
                low[f] = r.read(pl[f] + zeros[f] + 1, kl[f])
            u = zeros << kl | np.where(kl > 0, low, 0)
            value = (u >> 1) ^ -(u & 1)
            step = zeros + 1 + kl
            if raw.any():
                rl = raw[live]
                value = np.where(rl, r.signed(pl, kl), value)
                step = np.where(rl, kl, step)
            p[live] = np.minimum(pl + step, r.end)
            rows = a[live]
            if most:
                value = value + ((s[rows, i : i + most] * c[live]).sum(axis=1) >> sh[live])
            s[rows, most + i] = value
        pos[a] = p
    return s[:, most:] << wasted[:, None], pos, good


def decode_frames(buf: np.ndarray, at: np.ndarray, body: np.ndarray, n: int, code: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples: frame, channel, sample; is valid) of frames of one size and channel code; body: where subframes start."""
    r = Bits(buf)
    pos, ok, out = body.astype(np.int64) * 8, np.ones(len(body), bool), []
    channels = code + 1 if code < 8 else 2
    for c in range(channels):
        side = (code in (8, 10) and c == 1) or (code == 9 and c == 0)
        s, pos, good = subframes(r, pos.copy(), bits + side, n)
        ok &= good
        out.append(s)
    if code == 8:
        out[1] = out[0] - out[1]
    elif code == 9:
        out[0] = out[0] + out[1]
    elif code == 10:
        mid = out[0] << 1 | out[1] & 1
        out = [mid + out[1] >> 1, mid - out[1] >> 1]
    return np.stack(out, axis=1), ok & ((pos + 7 >> 3) + 2 == at)


def pack(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian PCM of (channel, sample)."""
    x = np.ascontiguousarray(samples.T).ravel()
    width = (bits + 7) // 8
    return x.astype("<i4" if width > 2 else f"<i{width}").tobytes() if width != 3 else np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def decode_streams(values: list[bytes | None]) -> list[list[tuple]]:
    """For each value its rows, without the id."""
    infos = [read_header(v) for v in values]
    data = b"".join(v or b"" for v in values)
    buf = np.frombuffer(data, np.uint8)
    base = np.concatenate([[0], np.cumsum([len(v or b"") for v in values])])
    hits = np.flatnonzero((buf[:-1] == 0xFF) & ((buf[1:] & 0xFE) == 0xF8)) if len(buf) > 1 else np.zeros(0, np.int64)
    own = np.searchsorted(base, hits, side="right") - 1
    marks: list[list[tuple]] = [[] for _ in values]
    for h, i in zip(hits.tolist(), own.tolist(), strict=True):
        info = infos[i]
        if info and h - base[i] >= info.audio and (head := frame_header(values[i], h - int(base[i]), info)):
            marks[i].append((h, *head))
    # from each mark to the next, or the end of the stream
    spans = [(i, k, m[0], (ms[k + 1][0] if k + 1 < len(ms) else int(base[i + 1]))) for i, ms in enumerate(marks) for k, m in enumerate(ms)]
    sums = crc16_all(buf, np.array([x[2] for x in spans], np.int64), np.array([x[3] for x in spans], np.int64)) if spans else []
    fine = {(i, k): bool(c == 0) for (i, k, _, _), c in zip(spans, sums, strict=True)}
    frames: list[list[list]] = [[] for _ in values]
    shapes: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for i, ms in enumerate(marks):
        k = 0
        stop = int(base[i + 1])
        if infos[i] and (not ms or ms[0][0] != base[i] + infos[i].audio) and infos[i].audio < len(values[i]):
            frames[i].append([None, 0, False, None])  # bytes before the first frame
        while k < len(ms):
            end, good, j = k + 1, fine[i, k], k + 1
            while not good and j < len(ms):  # a mark inside a frame: try the ones behind it
                j += 1
                until = ms[j][0] if j < len(ms) else stop
                if until - ms[k][0] > 1 << 24:
                    break
                if crc16(data[ms[k][0] : until]) == 0:
                    good, end = True, j
            at = ms[end][0] if end < len(ms) else stop
            frames[i].append([ms[k], at, good, None])
            if good:
                shapes[ms[k][2], ms[k][3]].append((i, len(frames[i]) - 1))
            k = end
    for (n, code), members in shapes.items():
        step = max(1, min(4096, GROUP_SAMPLES // max(1, n)))
        for a in range(0, len(members), step):
            part = members[a : a + step]
            got = [frames[i][k] for i, k in part]
            samples, ok = decode_frames(buf, np.array([f[1] for f in got]), np.array([f[0][0] + f[0][1] for f in got]), n, code, np.array([f[0][4] for f in got]))
            for f, s, o in zip(got, samples, ok, strict=True):
                f[2], f[3] = bool(o), pack(s, f[0][4]) if o else None  # as bytes, a quarter of the numbers or less
    return [_rows(values[i], infos[i], frames[i]) for i in range(len(values))]


def _rows(value: bytes | None, info: Stream | None, frames: list[list]) -> list[tuple]:
    if info is None:
        return [(-1, None, None, None, None, None, None, False, False)]
    out, sample, digest, good = [], 0, hashlib.md5(usedforsecurity=False), True
    for k, (head, _, ok, s) in enumerate(frames):
        if head is None:
            out.append((k, None, None, info.channels, info.bits, info.rate, None, False))
            good = False
            continue
        _, _, n, code, bits, number, by_sample = head
        sample = number if by_sample else number * info.fixed_block
        pcm = s if ok else None
        good &= ok
        if ok:
            digest.update(pcm)
        out.append((k, sample, n, code + 1 if code < 8 else 2, bits, info.rate, pcm, ok))
        sample += n
    good &= not info.total or sample == info.total
    good = bool(good and (info.md5 == bytes(16) or digest.digest() == info.md5))
    if not out:
        return [(-1, None, None, info.channels, info.bits, info.rate, None, good, good and not info.total)]
    return [(*r, good) for r in out]


def decode(streams: DataFrame) -> DataFrame:
    """The PCM blocks of each row of `streams` (id, flac, in that order): see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

        for b in batches:
            ids, values = b.column(0).to_pylist(), b.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(ids) else np.zeros(0, np.int64)
            a = 0
            while a < len(ids):  # streams of STREAM_BYTES together, or one
                z = max(a + 1, min(a + 1000, int(np.searchsorted(size, (size[a - 1] if a else 0) + STREAM_BYTES, side="right"))))
                rows, held = [], 0
                for i, rs in zip(ids[a:z], decode_streams(values.slice(a, z - a).to_pylist()), strict=True):
                    for r in rs:
                        rows.append((i, *r))
                        held += len(r[6] or b"") + 100
                        if held > STREAM_BYTES:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)
                a = z

    return small_batches(streams).select(F.col(streams.columns[0]).cast("bigint").alias("id"), F.col(streams.columns[1]).alias("flac")).mapInArrow(run, SCHEMA)


# --- encoding ------------------------------------------------------------------------------


class _Writer:
    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append((value >> np.arange(n - 1, -1, -1)) & 1)

    def many(self, values: np.ndarray, n: int) -> None:
        self.parts.append(((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).ravel())

    def rice(self, values: np.ndarray, k: int) -> None:
        u = np.where(values < 0, -2 * values - 1, 2 * values)
        q = u >> k
        ends = np.cumsum(q + 1 + k)
        bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        bits[ends - k - 1] = 1
        for j in range(k):
            bits[ends - 1 - j] = (u >> j) & 1
        self.parts.append(bits)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts).astype(np.uint8)).tobytes()


def _lpc(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int] | None:
    """Quantised predictor (coefficients, shift) by the autocorrelation method."""
    y = x * np.hanning(len(x) + 2)[1:-1]
    r = np.array([y[: len(y) - k] @ y[k:] for k in range(order + 1)], float)
    if r[0] <= 0:
        return None
    m = r[np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])] + np.eye(order) * r[0] * 1e-9
    c = np.linalg.solve(m, r[1:])
    shift = int(min(15, max(0, precision - 1 - np.ceil(np.log2(max(np.abs(c).max(), 1e-9))))))
    q = np.round(c * (1 << shift)).astype(np.int64)
    return (q, shift) if np.abs(q).max() < 1 << precision - 1 else None


def _subframe(w: _Writer, x: np.ndarray, bits: int, lpc: int) -> None:
    if (x == x[0]).all():
        w.put(0, 8)
        w.many(x[:1], bits)
        return
    best = None
    for o in range(min(4, len(x) - 1) + 1):
        e = np.diff(x, o)
        if best is None or np.abs(e).sum() < best[0]:
            best = (np.abs(e).sum(), 8 + o, o, e, None)
    if lpc and len(x) > 2 * lpc and (got := _lpc(x, lpc)):
        q, shift = got
        e = x[lpc:] - (sum(int(q[j]) * x[lpc - 1 - j : len(x) - 1 - j] for j in range(lpc)) >> shift)
        if np.abs(e).sum() < best[0]:
            best = (np.abs(e).sum(), 31 + lpc, lpc, e, got)
    _, kind, o, e, got = best
    order = 2 if len(x) % 4 == 0 and len(x) // 4 >= o else 0
    size = len(x) >> order
    cuts = [e[max(0, p * size - o) : (p + 1) * size - o] for p in range(1 << order)]
    ks = [int(min(14, max(0, np.ceil(np.log2(np.abs(c).mean() + 1e-9))))) if len(c) else 0 for c in cuts]
    cost = 64 + sum(int((np.abs(c) >> max(k - 1, 0)).sum()) + len(c) * (k + 1) for c, k in zip(cuts, ks, strict=True))
    if cost > len(x) * bits:
        w.put(2, 8)
        w.many(x, bits)
        return
    w.put(kind << 1, 8)
    w.many(x[:o], bits)
    if got is not None:
        w.put(11, 4)
        w.put(got[1], 5)
        w.many(got[0], 12)
    w.put(order, 6)
    for c, k in zip(cuts, ks, strict=True):
        w.put(k, 4)
        w.rice(c, k)


def encode(pcm: np.ndarray, rate: int = 16_000, bits: int = 16, block: int = 256, lpc: int = 4) -> bytes:
    """A FLAC stream of (channel, sample) integers; two channels are stored as mid and side."""
    pcm = np.asarray(pcm, np.int64)
    channels, total = pcm.shape
    md5 = hashlib.md5(pack(pcm, bits), usedforsecurity=False).digest()
    out = [b"fLaC", b"\x80\x00\x00\x22", block.to_bytes(2, "big") * 2, bytes(6), (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | total).to_bytes(8, "big"), md5]
    for number, a in enumerate(range(0, total, block)):
        x = pcm[:, a : a + block]
        n = x.shape[1]
        code = 10 if channels == 2 else channels - 1
        head = bytes([0xFF, 0xF8, 0x70, code << 4 | _BITS.index(bits) << 1]) + chr(number).encode("utf-8", "surrogatepass") + (n - 1).to_bytes(2, "big")
        w = _Writer()
        if channels == 2:
            _subframe(w, x[0] + x[1] >> 1, bits, lpc)
            _subframe(w, x[0] - x[1], bits + 1, lpc)
        else:
            for c in range(channels):
                _subframe(w, x[c], bits, lpc)
        frame = head + bytes([crc8(head)]) + w.bytes()
        out += [frame, crc16(frame).to_bytes(2, "big")]
    return b"".join(out)


SAMPLES = 1000  #: in a clip made from a vector


def render(vector: list[float] | np.ndarray | None, samples: int = SAMPLES) -> np.ndarray | None:
    """A clip of 16 bits and one channel whose curve runs through a vector's values."""
    if vector is None or len(vector) == 0:
        return None
    v = np.nan_to_num(np.asarray(vector, float))
    y = np.interp(np.linspace(0, len(v) - 1, samples), np.arange(len(v)), v)
    return np.clip(np.round(y * 20_000), -32768, 32767).astype(np.int64)[None, :]


def clips(vectors: DataFrame) -> DataFrame:
    """(id, flac): a stream for each row of `vectors` (id, array, in that order); a null or empty array has a null stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                made = [None if (x := render(v)) is None else encode(x) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["id", "flac"])

    return vectors.select(F.col(vectors.columns[0]).cast("bigint").alias("id"), F.col(vectors.columns[1]).alias("v")).mapInArrow(run, "id bigint, flac binary")
