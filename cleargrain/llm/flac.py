"""FLAC for columns of bytes: whole batches of frames are coded and decoded in step.

Payload bytes are unsigned 8-bit samples of one channel, in blocks of 576. Encoding picks for each block the cheapest of a
constant, the fixed predictors, a quantised linear predictor and plain samples; residuals are Rice-coded. A seek point
is written for every block. Decoding finds the frames by the seek table or, without a full one, by their sync codes; it
checks each header's CRC-8, each frame's CRC-16 and the stream's MD5, reads Rice residuals (both code widths, partitions,
escapes) and runs the predictors, one sample of all frames at a time.

Defined results: a null or empty payload is a stream without frames (`encoded`), and for `op4_flac` one block of padding.
Equal payloads give equal streams. Damaged streams raise ValueError. An empty table gives an empty result. Only the
id and payload columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.bytescan import pieces, text_buffer
from cleargrain.llm.shared import read_table, taken

BLOCK = 576
RATE = 8000
ORDER = 4  # of the linear predictors that the encoder tries
PRECISION = 12
PIECE_BYTES = 1 << 20
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (width - 8)
    top = np.uint32(1 << (width - 1))
    for _ in range(8):
        table = np.where(table & top, (table << 1) ^ np.uint32(polynomial), table << 1) & np.uint32((1 << width) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """CRCs of many spans at once. The register starts at 0, so zeros in front change nothing and spans end together."""
    out = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return out
    longest = int((ends - starts).max())
    data = np.append(data, np.uint8(0))
    for back in range(longest, 0, -1):
        at = ends - back
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint32)
        out = ((out << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(out >> np.uint32(8)) ^ byte] if width == 16 else CRC8[out ^ byte]
    return out


def _numbers(n: np.ndarray) -> list[bytes]:
    """Frame numbers in the extended UTF-8 of frame headers."""
    out = []
    for x in n.tolist():
        if x < 0x80:
            out.append(bytes([x]))
            continue
        size = next(k for k in range(2, 8) if x < 1 << (5 * k + 1))
        tail = [0x80 | (x >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
        out.append(bytes([(0xFF << (8 - size)) & 0xFF | x >> (6 * (size - 1)), *tail]))
    return out


# --- encoding


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer coefficients and shifts of each row's linear predictor (autocorrelation, Levinson's recursion)."""
    f = x.astype(np.float64)
    auto = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(ORDER + 1)], 1)
    error = auto[:, 0] + 1e-9
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        reflect = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1][:, :i]).sum(1)) / error
        a[:, :i], a[:, i] = a[:, :i] - reflect[:, None] * a[:, :i][:, ::-1], reflect
        error = np.maximum(error * (1 - reflect * reflect), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    whole = np.clip(np.rint(a * (1 << shift)[:, None]), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    return whole, shift.astype(np.int32)


def _residuals(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals from the order-th sample on."""
    order, n = coefficients.shape[1], x.shape[1]
    if not order:
        return x
    guess = sum(coefficients[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j] for j in range(order))
    return x[:, order:] - (guess >> shift[:, None])


class _Bits:
    """Rows of bits of one width each, written field by field."""

    def __init__(self, total: np.ndarray):
        self.bytes_ = -(-total // 8)
        self.start = np.concatenate([[0], np.cumsum(self.bytes_ * 8)])
        self.bits = np.zeros(self.start[-1], np.uint8)
        self.at = self.start[:-1].copy()

    def put(self, value: np.ndarray | int, width: int) -> None:
        value = np.broadcast_to(value, self.at.shape)
        for b in range(width):
            self.bits[self.at + b] = (value >> (width - 1 - b)) & 1
        self.at += width

    def rice(self, u: np.ndarray, k: int) -> None:
        quotient = u >> k
        ends = self.at[:, None] + np.cumsum(quotient + (1 + k), 1)
        first = ends - k
        self.bits[first - 1] = 1
        for b in range(k):
            self.bits[first + b] = (u >> (k - 1 - b)) & 1
        self.at = ends[:, -1]

    def rows(self) -> list[bytes]:
        raw = np.packbits(self.bits).tobytes()
        edge = (self.start // 8).tolist()
        return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _subframes(x: np.ndarray) -> list[bytes]:
    """The coded subframe of each row of samples."""
    n = len(x)
    out: list[bytes | None] = [None] * n
    constant = (x == x[:, :1]).all(1)
    for i in np.flatnonzero(constant):
        out[i] = bytes([0, int(x[i, 0]) & 0xFF])
    left = np.flatnonzero(~constant)
    if not len(left):
        return out
    rows = x[left].astype(np.int32)
    coefficients, shift = _quantised(rows)
    tried = [("fixed", 0), ("fixed", 1), ("lpc", ORDER)]
    zigzag, cost, ks = [], [], []
    for kind, order in tried:
        c = coefficients if kind == "lpc" else np.tile(np.array(FIXED[order], np.int32), (len(left), 1))
        r = _residuals(rows, c, shift if kind == "lpc" else np.zeros(len(left), np.int32))
        u = ((r << 1) ^ (r >> 31)).astype(np.int32)
        mean = u.mean(1)
        k = np.clip(np.floor(np.log2(np.maximum(mean, 1e-9) * 0.6931 + 1e-9)).astype(np.int64) + 1, 0, 14)
        bits = (u >> k[:, None]).sum(1) + u.shape[1] * (k + 1) + 8 * order + 10 + (9 + PRECISION * order if kind == "lpc" else 0)
        zigzag.append(u)
        cost.append(bits)
        ks.append(k)
    plain = np.full(len(left), 8 * BLOCK)
    best = np.argmin(np.stack([*cost, plain]), 0)
    for i in np.flatnonzero(best == len(tried)):
        out[left[i]] = b"\x02" + (x[left[i]] & 0xFF).astype(np.uint8).tobytes()
    for t, (kind, order) in enumerate(tried):
        for k in np.unique(ks[t][best == t]).tolist():
            at = np.flatnonzero((best == t) & (ks[t] == k))
            w = _Bits(8 + cost[t][at])
            w.put((0x20 | (order - 1) if kind == "lpc" else 0x08 | order) << 1, 8)
            for j in range(order):
                w.put(rows[at, j] & 0xFF, 8)
            if kind == "lpc":
                w.put(PRECISION - 1, 4)
                w.put(shift[at], 5)
                for j in range(order):
                    w.put(coefficients[at, j] & ((1 << PRECISION) - 1), PRECISION)
            w.put(k, 10)  # four-bit parameters, one partition, and the parameter
            w.rice(zigzag[t][at], k)
            for i, coded in zip(at.tolist(), w.rows(), strict=True):
                out[left[i]] = coded
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length must be a multiple of the block."""
    if any(len(p) % BLOCK for p in payloads):
        raise ValueError("a payload isn't a whole number of blocks")
    blocks = np.array([len(p) // BLOCK for p in payloads], np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    signed = raw.astype(np.int16) - 128
    subframes = _subframes(signed.reshape(-1, BLOCK)) if len(raw) else []
    before = np.concatenate([[0], np.cumsum(blocks)])
    number = np.arange(before[-1]) - np.repeat(before[:-1], blocks)
    heads = [b"\xff\xf8\x24\x02" + x for x in _numbers(number)]
    frames = [h + b"\0" + s for h, s in zip(heads, subframes, strict=True)]
    lengths = np.array([len(f) for f in frames], np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.frombuffer(b"".join(frames), np.uint8).copy()
    head = at[:-1] + np.array([len(h) for h in heads], np.int64)
    flat[head] = crcs(flat, at[:-1], head, 8)
    tails = crcs(flat, at[:-1], at[1:], 16)
    joined = flat.tobytes()
    sealed = [joined[a:b] + t.to_bytes(2, "big") for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), tails.tolist(), strict=True)]
    out = []
    for i, payload in enumerate(payloads):
        own = sealed[before[i] : before[i + 1]]
        sizes = [len(f) for f in own] or [0]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5((signed[before[i] * BLOCK : before[i + 1] * BLOCK] & 0xFF).astype(np.uint8).tobytes()).digest()
        offset, points = 0, []
        for j, f in enumerate(own):
            points.append((j * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + BLOCK.to_bytes(2, "big"))
            offset += len(f)
        table = b"".join(points)
        out.append(b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own) if len(table) < 1 << 24 else b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(own))
    return out


# --- decoding


class _Reader:
    """Bit positions of many frames in one buffer, read in step."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        self.at = at * 8
        bits = np.unpackbits(data)
        n = len(bits)
        ones = np.where(bits, np.arange(n, dtype=np.int64), n)
        self.one = np.append(np.minimum.accumulate(ones[::-1])[::-1], n)

    def take(self, width: np.ndarray | int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Unsigned fields of up to 25 bits."""
        at = self.at[rows]
        byte = at >> 3
        d = self.data
        word = (d[byte] << 24) | (d[byte + 1] << 16) | (d[byte + 2] << 8) | d[byte + 3]
        self.at[rows] = at + width
        return (word >> (32 - (at & 7) - width)) & ((1 << width) - 1 if isinstance(width, int) else (np.int64(1) << width) - 1)

    def signed(self, width: np.ndarray | int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        v = self.take(width, rows)
        top = np.left_shift(1, np.asarray(width, np.int64) - 1, where=np.asarray(width) > 0, out=np.zeros(np.shape(width), np.int64))
        return (v ^ top) - top

    def unary(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        at = self.at[rows]
        if len(at) and at.max() >= len(self.one):
            raise ValueError("a frame ends in a code")
        end = self.one[at]
        self.at[rows] = end + 1
        return end - at


def _streaminfo(media: bytes) -> tuple[int, int, int, int, bytes, bytes | None, int]:
    """block, channels, bits, samples, md5, seek table, start of the frames."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info, table = 4, False, None, None
    while not last:
        if at + 4 > len(media):
            raise ValueError("metadata is cut short")
        last, kind, size = media[at] >= 0x80, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            table = body
        at += 4 + size
    if info is None or len(info) < 34:
        raise ValueError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    return int.from_bytes(info[2:4], "big"), (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], table, at


def _frame_starts(media: np.ndarray, first: int, table: bytes | None, samples: int, block: int) -> np.ndarray:
    """Starts of the frames: by the seek table if it has every block, else by sync codes whose header's CRC holds."""
    n = -(-samples // block) if block else 0
    if table is not None and len(table) == 18 * n:
        points = np.frombuffer(table, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
        if (points["sample"].astype(np.int64) == np.arange(n) * block).all():
            return first + points["byte"].astype(np.int64)
    body = media[first:]
    maybe = np.flatnonzero((body[:-1] == 0xFF) & ((body[1:] & 0xFE) == 0xF8)) if len(body) > 1 else np.zeros(0, np.int64)
    starts, want = [], 0
    for p in maybe.tolist():
        head = bytes(body[p : p + 16])
        size = _head_size(head)
        if size and int(crcs(np.frombuffer(head, np.uint8), np.array([0]), np.array([size]), 8)[0]) == head[size] and _head_number(head) == want:
            starts.append(p)
            want += 1
    return first + np.array(starts, np.int64)


def _head_size(head: bytes) -> int:
    """Bytes of a frame header before its CRC; 0 if it isn't one."""
    if len(head) < 6:
        return 0
    lead = head[4]
    number = 1 if lead < 0x80 else next((k for k in range(2, 8) if lead >> (7 - k) == (1 << (k + 1)) - 2), 0)
    extra = {6: 1, 7: 2}.get(head[2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    size = 4 + number + extra
    return size if number and size < len(head) else 0


def _head_number(head: bytes) -> int:
    lead = head[4]
    if lead < 0x80:
        return lead
    size = next(k for k in range(2, 8) if lead >> (7 - k) == (1 << (k + 1)) - 2)
    value = lead & ((1 << (7 - size)) - 1)
    for x in head[5 : 4 + size]:
        value = value << 6 | x & 0x3F
    return value


def _block_size(head: bytes, size: int) -> int:
    code = head[2] >> 4
    if code in (6, 7):
        rate = {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
        width = code - 5
        return int.from_bytes(head[size - rate - width : size - rate], "big") + 1
    if code == 1:
        return 192
    if 2 <= code <= 5:
        return 144 << code
    if code >= 8:
        return 1 << code
    raise ValueError("a reserved block size")


def _decode_group(data: np.ndarray, body: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, n) samples of frames of one block size whose subframes start at `body`, and the bytes where they end."""
    r = _Reader(data, body)
    count = len(body)
    out = np.zeros((n, count), np.int64)
    head = r.take(8)
    kind = (head >> 1) & 63
    if (head & 0x81).any():
        raise ValueError("wasted bits and padding bits aren't supported")
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0))
    if (((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise ValueError("a reserved subframe type")
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        out[:, rows] = r.signed(bits, rows)[None]
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        for i in range(n):
            out[i, rows] = r.signed(bits, rows)
    coded = np.flatnonzero(kind >= 8)
    if not len(coded):
        return out.T, -(-r.at // 8)
    order = order[coded]
    most = int(order.max())
    for i in range(most):
        rows = coded[order > i]
        out[i, rows] = r.signed(bits, rows)
    coefficients, shift = np.zeros((most, len(coded)), np.int64), np.zeros(len(coded), np.int64)
    for o, c in FIXED.items():
        for j, v in enumerate(c):
            if j < most:
                coefficients[j, (kind[coded] < 32) & (order == o)] = v
    lpc = np.flatnonzero(kind[coded] >= 32)
    if len(lpc):
        precision = r.take(4, coded[lpc]) + 1
        shift[lpc] = r.signed(5, coded[lpc])
        if (precision == 16).any() or (shift < 0).any():
            raise ValueError("a reserved predictor")
        for j in range(most):
            has = order[lpc] > j
            coefficients[j, lpc[has]] = r.signed(precision[has], coded[lpc[has]])
    method = r.take(2, coded)
    if (method > 1).any():
        raise ValueError("a reserved residual code")
    parts = r.take(4, coded)
    if ((n >> parts << parts) != n).any():
        raise ValueError("a partition isn't whole")
    width = 4 + method
    part = n >> parts
    k, raw = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
    escaped = np.zeros(len(coded), bool)
    smallest = int(part.min())
    steps = {*range(0, n, smallest)} | {int(x) for x in np.unique(order)}
    uniform = bool((order == order[0]).all())
    everyone = np.arange(len(coded))
    for i in range(int(order.min()), n):
        live = everyone if uniform or i >= most else np.flatnonzero(order <= i)
        if i in steps:
            fresh = live[(i % part[live] == 0) | (order[live] == i)]
            k[fresh] = r.take(width[fresh], coded[fresh])
            escaped[fresh] = k[fresh] == (1 << width[fresh]) - 1
            if escaped[fresh].any():
                e = fresh[escaped[fresh]]
                raw[e], k[e] = r.take(5, coded[e]), 0
        who = coded[live]
        if escaped.any():
            e = escaped[live]
            value = np.zeros(len(live), np.int64)
            value[e] = np.where(raw[live[e]] > 0, r.signed(raw[live[e]], who[e]), 0)
            plain = ~e
            u = (r.unary(who[plain]) << k[live[plain]]) | r.take(k[live[plain]], who[plain])
            value[plain] = (u >> 1) ^ -(u & 1)
        else:
            u = (r.unary(who) << k[live]) | r.take(k[live], who)
            value = (u >> 1) ^ -(u & 1)
        if most:
            guess = np.zeros(len(live), np.int64)
            for j in range(min(most, i)):
                guess += coefficients[j, live] * out[i - 1 - j, who]
            value = value + (guess >> shift[live])
        out[i, who] = value
    return out.T, -(-r.at // 8)


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each stream: its unsigned 8-bit samples, the sample offset of each block, and the byte offset of its frame."""
    if not streams:
        return []
    joined = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    infos, starts, owner = [], [], []
    for i, s in enumerate(streams):
        block, channels, bits, samples, md5, table, first = _streaminfo(s)
        if channels != 1 or bits != 8:
            raise ValueError("only one channel of 8 bits is supported")
        found = _frame_starts(joined[base[i] : base[i + 1]], first, table, samples, block) if samples else np.zeros(0, np.int64)
        if samples and (not len(found) or (found[1:] <= found[:-1]).any() or found[-1] >= len(s)):
            raise ValueError("frames are missing")
        infos.append((samples, md5))
        starts.append(base[i] + found)
        owner.append(np.full(len(found), i))
    at, whose = np.concatenate(starts), np.concatenate(owner)
    ends = np.concatenate([np.append(s[1:], base[i + 1])[: len(s)] for i, s in enumerate(starts)]) if len(at) else at
    parts: list[np.ndarray | None] = [None] * len(at)
    if len(at):
        heads = [joined[p : p + 16].tobytes() for p in at.tolist()]
        sizes = np.array([_head_size(h) for h in heads])
        if (sizes == 0).any() or any(h[0] != 0xFF or h[1] & 0xFE != 0xF8 for h in heads):
            raise ValueError("a frame has no header")
        if (crcs(joined, at, at + sizes + 1, 8) != 0).any() or (crcs(joined, at, ends, 16) != 0).any():
            raise ValueError("a frame's checksum doesn't hold")
        lengths = np.array([_block_size(h, s) for h, s in zip(heads, sizes.tolist(), strict=True)])
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            lo, hi = int(at[rows].min()), int(ends[rows].max())
            got, stopped = _decode_group(joined[lo:hi], at[rows] + sizes[rows] + 1 - lo, n, 8)
            if (stopped + lo + 2 != ends[rows]).any():
                raise ValueError("a frame doesn't end at its checksum")
            for j, row in zip(rows.tolist(), (got + 128).astype(np.uint8), strict=True):
                parts[j] = row
    edge = np.searchsorted(whose, np.arange(len(streams) + 1))
    out = []
    for i, (samples, md5) in enumerate(infos):
        own = parts[edge[i] : edge[i + 1]]
        pcm = np.concatenate(own)[:samples] if own else np.zeros(0, np.uint8)
        if len(pcm) != samples or (any(md5) and hashlib.md5((pcm ^ 0x80).tobytes()).digest() != md5):
            raise ValueError("the samples aren't those that were coded")
        size = np.array([len(x) for x in own], np.int64)
        out.append((pcm.tobytes(), np.cumsum(size) - size, at[edge[i] : edge[i + 1]] - base[i]))
    return out


# --- tables


def padded(raw: bytes) -> bytes:
    """The bytes with bytes 255 up to a positive whole number of blocks."""
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def encoded(rows: DataFrame, id: str, payload: str) -> DataFrame:
    """id and media: the payload, padded to whole blocks unless empty, as a FLAC stream."""
    part = taken(rows, **{id: id, "payload": payload}).withColumn("payload", F.col("payload").cast("binary"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "payload", PIECE_BYTES):
                media = encode([padded(x) if x else b"" for x in piece.column(1).to_pylist()])
                yield pa.record_batch([piece.column(0), pa.array(media, pa.binary())], names=[id, "media"])

    return part.mapInArrow(work, f"`{id}` {part.schema[id].dataType.simpleString()}, media binary")


def pcm_blocks(rows: DataFrame, id: str, media: str) -> DataFrame:
    """id, block, sample_offset, byte_offset (of the frame in the stream), pcm (unsigned 8-bit samples) per block."""
    part = taken(rows, **{id: id, "media": media})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.filter(batch.column(1).is_valid()), "media", PIECE_BYTES):
                got = decode(piece.column(1).to_pylist())
                row = np.repeat(np.arange(len(got)), [len(x[1]) for x in got])
                number = [j for x in got for j in range(len(x[1]))]
                pcm = [x[0][a:b] for x in got for a, b in zip(x[1].tolist(), [*x[1][1:].tolist(), len(x[0])], strict=False)]
                offsets = [np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in (1, 2)]
                yield pa.record_batch([piece.column(0).take(pa.array(row)), pa.array(number, pa.int64()), pa.array(offsets[0]), pa.array(offsets[1]), pa.array(pcm, pa.binary())], names=[id, "block", "sample_offset", "byte_offset", "pcm"])

    return part.mapInArrow(work, f"`{id}` {part.schema[id].dataType.simpleString()}, block long, sample_offset long, byte_offset long, pcm binary")


def features(pcm: bytes, blocks: int, media_bytes: int) -> str:
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={blocks} sum={int(x.sum())} energy={int((x * x).sum())} crossings={crossings} coded={media_bytes}"


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text through `encode` and `decode`; every figure but n_bytes comes from the stored stream."""
    part = taken(docs, **{id: id, "text": text})
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, at = text_buffer(piece.column(1))
                raw = data.tobytes()
                media = encode([padded(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                rows = [
                    (len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(pcm, len(blocks), len(m)))
                    for (pcm, blocks, _), m in zip(decode(media), media, strict=True)
                ]
                yield pa.record_batch([piece.column(0), pa.array(np.diff(at)), *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=[id, *names])

    return part.mapInArrow(work, f"`{id}` {part.schema[id].dataType.simpleString()}, {DIGESTS}")


def op4_flac(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
