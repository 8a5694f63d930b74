"""FLAC media columns: store bytes as 8-bit mono streams and read them back.

A stream holds STREAMINFO (with the MD5 of its samples), a SEEKTABLE with one
point every ``SEEK_FRAMES`` frames, and frames of 192 samples. Each frame has a
fixed linear predictor of order 0 or 1, or a constant, and one Rice partition,
whichever is shortest. Frames are packed and unpacked in numpy, many in step:
one step decodes the next sample of every frame of a slice.

Reading finds frame starts by their sync code, checks the frame numbers and
both checksums of every frame, and compares the MD5. Seek points cut the samples
into PCM blocks; each has to lead to the frame of its sample. Streams by other writers
(any fixed or quantised linear predictor, partitions, escapes, verbatim and
wasted bits; mono, to 32 bits) are read by ``decode_stream``.

Null text counts as empty. Payloads are UTF-8 padded with spaces to a positive
multiple of 192 bytes. Repeated rows and null ids give rows alike; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_arrow, raw, release, shared_dir, slices, texts

BLOCK = 192
RATE = 8000
SEEK_FRAMES = 16
SLICE = 1 << 20
#: Sync code and fixed blocking; 192 samples at 8 kHz; mono of 8 bits.
HEAD = bytes([0xFF, 0xF8, 0x14, 0x02])
RICE = (4, 5, 6, 7)


def crc_table(bits: int, poly: int) -> np.ndarray:
    top, full, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c & top else 0)) & full
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)
_LEAD = np.array([16] + [15 - (v.bit_length() - 1) for v in range(1, 1 << 16)], np.int64)


def _crc(buf: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of the spans, a byte of each in every step."""
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    c = np.zeros(len(s), np.uint16)
    m = len(s)
    for t in range(int(n[0]) if len(n) else 0):
        while m and n[m - 1] <= t:
            m = int(np.searchsorted(-n, -t))
        b = buf[s[:m] + t]
        c[:m] = CRC8[c[:m] ^ b] if bits == 8 else CRC16[(c[:m] >> np.uint16(8)) ^ b] ^ (c[:m] << np.uint16(8))
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's variable-length code: up to six bytes, and their count."""
    if len(v) and v.max() >= 1 << 31:
        raise ValueError("a stream has 2^31 frames at most")
    n = 1 + sum((v >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000, 0x200000, 0x4000000))
    out = np.zeros((len(v), DIGITS), np.uint8)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])[n]
    out[:, 0] = lead | (v >> (6 * (n - 1)))
    for j in range(1, DIGITS):
        m = n > j
        out[m, j] = 0x80 | ((v[m] >> (6 * (n[m] - 1 - j))) & 63)
    return out, n


#: Most bytes of a frame's number.
DIGITS = 6


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of samples x (frames x 192): their bytes and offsets."""
    f = len(x)
    best, order, rice = np.full(f, 1 << 40), np.zeros(f, np.int64), np.zeros(f, np.int64)
    r1 = np.diff(x, axis=1)
    zig = [(r << 1) ^ (r >> 15) for r in (x, r1)]
    for o, u in enumerate(zig):
        for k in RICE:
            bits = (u >> k).sum(axis=1, dtype=np.int64) + (BLOCK - o) * (k + 1) + 8 * o
            better = bits < best
            best[better], order[better], rice[better] = bits[better], o, k
    constant = ~r1.any(axis=1)
    code, digits = _number(number)
    head = 4 + digits + 1
    body = np.where(constant, 2, 1 + (best + 10 + 7) // 8)
    size = head + body + 2
    at = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(at[-1]) * 8, np.uint8)
    for o in (0, 1):
        sel = np.flatnonzero((order == o) & ~constant)
        if not len(sel):
            continue
        u, k = zig[o][sel].astype(np.int64), rice[sel][:, None]
        base = (at[sel] + head[sel] + 1 + o) * 8
        for j in range(4):
            bits[base + 6 + j] = (rice[sel] >> (3 - j)) & 1
        q = u >> k
        end = np.cumsum(q + 1 + k, axis=1) + (base + 10)[:, None]  # after each code
        bits[(end - k - 1).ravel()] = 1
        for j in range(max(RICE)):
            m = k > j  # bit j from the right
            if m.all():
                bits[(end - 1 - j).ravel()] = ((u >> j) & 1).ravel()
            elif m.any():
                rows = m[:, 0]
                bits[(end[rows] - 1 - j).ravel()] = ((u[rows] >> j) & 1).ravel()
    buf = np.packbits(bits)
    s = at[:-1]
    for j in range(4):
        buf[s + j] = HEAD[j]
    for j in range(DIGITS):
        m = digits > j
        buf[s[m] + 4 + j] = code[m, j]
    buf[s + head - 1] = _crc(buf, s, head - 1, 8)
    buf[s + head] = np.where(constant, 0, (8 + order) << 1)
    warm = constant | (order == 1)
    buf[s[warm] + head[warm] + 1] = x[warm, 0].astype(np.int8).view(np.uint8)
    c = _crc(buf, s, size - 2, 16)
    buf[s + size - 2], buf[s + size - 1] = c >> np.uint16(8), c & np.uint16(255)
    return buf, at


def encode_payloads(data: np.ndarray, frames: np.ndarray) -> list[bytes]:
    """FLAC streams of consecutive payloads of ``frames`` x 192 bytes each."""
    x = data.reshape(-1, BLOCK).astype(np.int16) - 128
    first = np.concatenate([[0], np.cumsum(frames)])
    number = np.arange(len(x)) - np.repeat(first[:-1], frames)
    buf, at = _frames(x, number)
    pcm, buf = (data ^ 128).tobytes(), buf.tobytes()
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        sizes = at[a + 1 : b + 1] - at[a:b]
        seek = b"".join(struct.pack(">QQH", (i - a) * BLOCK, int(at[i] - at[a]), BLOCK) for i in range(a, b, SEEK_FRAMES))
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (
            (RATE << 44) | (0 << 41) | (7 << 36) | (b - a) * BLOCK
        ).to_bytes(8, "big") + hashlib.md5(pcm[a * BLOCK : b * BLOCK]).digest()
        out.append(
            b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + buf[at[a] : at[b]]
        )
    return out


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int]], int]:
    """STREAMINFO, seek points (sample, byte offset), and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, {}, []
    while not last:
        last, kind, n = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block, at = stream[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {
                "block": int.from_bytes(block[:2], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1,
                "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]
            }
        elif kind == 3:
            seek = [struct.unpack(">QQ", block[i : i + 16]) for i in range(0, len(block), 18)]
    return info, seek, at


def block_points(stream: bytes) -> list[tuple[int, int, int]]:
    """First sample, samples and byte offset of each PCM block; the offset has to be that of the sample's frame."""
    info, seek, begin = metadata(stream)
    if not seek or seek[0][0] != 0:
        raise ValueError("no seek point at the first sample")
    stops = [s for s, _ in seek[1:]] + [info["samples"]]
    out = []
    for (s, o), e in zip(seek, stops, strict=True):
        at = begin + o
        number = s if stream[at + 1 : at + 2] == b"\xf9" else s // info["block"]
        code, n = _number(np.array([number]))
        code = code[0, : n[0]].tobytes()
        if e <= s or stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8 or not stream.startswith(code, at + 4):
            raise ValueError("a seek point leads to another frame")
        out.append((s, e - s, at))
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.pos - n) & ((1 << n) - 1)
        self.pos += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
            if self.pos > len(self.data) * 8:
                raise ValueError("truncated stream")
        return n


def _scalar_crc(data: bytes, bits: int) -> int:
    return int(_crc(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), bits)[0])


#: Coefficients of the fixed predictors of orders 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def decode_stream(stream: bytes) -> np.ndarray:
    """Samples of any mono stream, one frame after another; checks every checksum."""
    info, _, at = metadata(stream)
    return _decode(stream, at, info, info["samples"])


def read_samples(stream: bytes, first: int, n: int) -> np.ndarray:
    """Samples [first, first + n): decoding begins at the last seek point before them and ends with them."""
    info, seek, begin = metadata(stream)
    s, o = max((p for p in seek if p[0] <= first), default=(0, 0))
    n = max(0, min(n, info["samples"] - first))
    return _decode(stream, begin + o, info, first + n - s)[first - s : first - s + n] if n else np.zeros(0, np.int32)


def _decode(stream: bytes, at: int, info: dict, least: int) -> np.ndarray:
    """Frames from a byte on, until there are so many samples."""
    out: list[int] = []
    while len(out) < least:
        b = _Bits(stream, at)
        if b.take(14) != 0x3FFE:
            raise ValueError("lost the sync code")
        b.take(2)
        size, rate, channel, depth = b.take(4), b.take(4), b.take(4), b.take(3)
        b.take(1)
        if channel:
            raise ValueError("only mono streams are read")
        lead = b.take(8)
        for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1)):
            b.take(8)
        n = {1: 192}.get(size) or (
            576 << (size - 2) if size < 6 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << (size - 8)
        )
        if rate >= 12:
            b.take(8 if rate == 12 else 16)
        if b.take(8) != _scalar_crc(stream[at : b.pos // 8 - 1], 8):
            raise ValueError("wrong checksum of a frame header")
        bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
        b.take(1)
        kind, wasted = b.take(6), b.unary() + 1 if b.take(1) else 0
        bits -= wasted
        if kind == 0:
            x = [b.signed(bits)] * n
        elif kind == 1:
            x = [b.signed(bits) for _ in range(n)]
        else:
            order, shift = (kind - 8, 0) if kind < 32 else (kind - 31, 0)
            x = [b.signed(bits) for _ in range(order)]
            coef = FIXED[order] if kind < 32 else ()
            if kind >= 32:
                width = b.take(4) + 1
                shift = b.signed(5)
                coef = tuple(b.signed(width) for _ in range(order))
            wide, parts = (5 if b.take(2) else 4), b.take(4)
            for p in range(1 << parts):
                k = b.take(wide)
                raw_bits = b.take(5) if k == (1 << wide) - 1 else None
                for _ in range((n >> parts) - (order if not p else 0)):
                    if raw_bits is not None:
                        r = b.signed(raw_bits)
                    else:
                        u = b.unary() << k | b.take(k)
                        r = -(u + 1 >> 1) if u & 1 else u >> 1
                    x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
        out += [v << wasted for v in x]
        end = (b.pos + 7) // 8
        if int.from_bytes(stream[end : end + 2], "big") != _scalar_crc(stream[at:end], 16):
            raise ValueError("wrong checksum of a frame")
        at = end + 2
    return np.array(out, np.int32)


def _starts(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, frames: np.ndarray) -> np.ndarray | None:
    """Starts of all frames, or None if sync codes and frame numbers leave doubt."""
    hit = np.flatnonzero((buf[:-4] == HEAD[0]) & (buf[1:-3] == HEAD[1]) & (buf[2:-2] == HEAD[2]) & (buf[3:-1] == HEAD[3]))
    which = np.searchsorted(begin, hit, "right") - 1
    ok = (which >= 0) & (hit < end[np.maximum(which, 0)])
    hit, which = hit[ok], which[ok]
    if len(hit) != frames.sum() or (np.bincount(which, minlength=len(begin)) != frames).any():
        return None
    code, digits = _number(np.arange(len(hit)) - np.repeat(np.cumsum(frames) - frames, frames))
    for j in range(DIGITS):
        m = digits > j
        if (buf[hit[m] + 4 + j] != code[m, j]).any():
            return None
    return hit


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Payload bytes of streams written by ``encode_payloads``, frames in step; checks every checksum."""
    heads = [metadata(s) for s in streams]
    if any((h[0]["block"], h[0]["bits"], h[0]["channels"]) != (BLOCK, 8, 1) for h in heads):
        return [(decode_stream(s) + 128).astype(np.uint8) for s in streams]
    buf = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    ends = np.cumsum([len(s) for s in streams])
    begin = ends - [len(s) - h[2] for s, h in zip(streams, heads, strict=True)]
    frames = np.array([h[0]["samples"] // BLOCK for h in heads])
    start = _starts(buf, begin, ends, frames)
    if start is None:
        return [(decode_stream(s) + 128).astype(np.uint8) for s in streams]
    f = len(start)
    which = np.repeat(np.arange(len(streams)), frames)
    stop = np.concatenate([start[1:], [0]])
    last = np.cumsum(frames) - 1
    stop[last] = ends
    digits = 1 + sum((buf[start + 4] >= least).astype(np.int64) for least in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC))
    head = start + 4 + digits
    if (buf[head] != _crc(buf, start, head - start, 8)).any():
        raise ValueError("wrong checksum of a frame header")
    c = _crc(buf, start, stop - 2 - start, 16)
    if (buf[stop - 2] != c >> np.uint16(8)).any() or (buf[stop - 1] != c & np.uint16(255)).any():
        raise ValueError("wrong checksum of a frame")
    kind = buf[head + 1] >> 1
    x = np.zeros((BLOCK, f), np.int16)
    wide = np.ndarray((len(buf) - 8,), ">u8", buf, strides=(1,))
    con = np.flatnonzero(kind == 0)
    x[:, con] = buf[head[con] + 2].view(np.int8).astype(np.int16)
    for o in (0, 1):
        sel = np.flatnonzero(kind == 8 + o)
        if not len(sel):
            continue
        at = (head[sel] + 2 + o) * 8
        k = ((wide[at >> 3].astype(np.uint64) >> np.uint64(54)) & np.uint64(15)).astype(np.int64)
        if o:
            x[0, sel] = buf[head[sel] + 2].view(np.int8)
        at = at + 10
        low = ((np.uint64(1) << k.astype(np.uint64)) - np.uint64(1)).astype(np.int64)
        for i in range(o, BLOCK):
            w = wide[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
            q = _LEAD[w >> np.uint64(48)]
            if (q == 16).any():
                m = q == 16
                q[m] += _LEAD[(w[m] >> np.uint64(32)) & np.uint64(0xFFFF)]
            n = q + 1 + k
            u = (q << k) | ((w >> (64 - n).astype(np.uint64)).astype(np.int64) & low)
            x[i, sel] = (u >> 1) ^ -(u & 1)
            at += n
        if o:
            x[:, sel] = np.cumsum(x[:, sel], axis=0, dtype=np.int16)
    if ((kind != 0) & (kind != 8) & (kind != 9)).any():
        return [(decode_stream(s) + 128).astype(np.uint8) for s in streams]
    data = (x.T + 128).astype(np.uint8).ravel()
    cuts = np.concatenate([[0], np.cumsum(frames)]) * BLOCK
    out = [data[cuts[i] : cuts[i + 1]] for i in range(len(streams))]
    del which
    for p, (info, _, _) in zip(out, heads, strict=True):
        if info["md5"] != hashlib.md5((p ^ 128).tobytes()).digest():
            raise ValueError("wrong MD5 of the samples")
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = raw(texts(batch))
        size = np.diff(offs)
        padded = np.maximum(1, -(-size // BLOCK)) * BLOCK
        for i, j in slices(np.concatenate([[0], np.cumsum(padded)]), SLICE):
            to = np.concatenate([[0], np.cumsum(padded[i:j])])
            pay = np.full(int(to[-1]), 32, np.uint8)
            for k in range(i, j):
                pay[to[k - i] : to[k - i] + size[k]] = data[offs[k] : offs[k + 1]]
            media = encode_payloads(pay, padded[i:j] // BLOCK)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(size[i:j]), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"]
            )


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    for batch in batches:
        media = batch.column(batch.schema.get_field_index("media"))
        offs = np.concatenate([[0], np.cumsum([len(m) for m in media.to_pylist()])]) if len(media) else np.zeros(1, np.int64)
        for i, j in slices(offs, SLICE):
            streams = media.slice(i, j - i).to_pylist()
            yield batch.slice(i, j - i), streams, decode_streams(streams)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, streams, payloads in _some(batches):
        rows = []
        for m, p in zip(streams, payloads, strict=True):
            size = crossings = energy = peak = 0
            sha, last = hashlib.sha256(), None
            for s, n, _ in block_points(m):
                pcm = p[s : s + n]
                x = pcm.astype(np.int32) - 128
                neg = x < 0
                crossings += int((neg[1:] != neg[:-1]).sum()) + (last is not None and bool(neg[0] != last))
                energy += int((x * x).sum(dtype=np.int64))
                peak = max(peak, int(np.abs(x).max()))
                size, last = size + len(pcm), bool(neg[-1])
                sha.update(pcm.tobytes())
            said = f"frames={size // BLOCK} crossings={crossings} energy={energy} peak={peak}"
            rows.append((size, sha.hexdigest(), zlib.crc32(p[-16:].tobytes()), len(m), hashlib.sha256(m).hexdigest(), said))
        c = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(c, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, streams, payloads in _some(batches):
        for i, (m, p) in enumerate(zip(streams, payloads, strict=True)):
            points = block_points(m)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0)[i].as_py()] * len(points), pa.int64()),
                    *(pa.array(c) for c in zip(*points, strict=True)),
                    pa.array([p[s : s + n].tobytes() for s, n, _ in points], pa.binary())
                ],
                ["doc_id", "first_sample", "n_samples", "byte_offset", "pcm"],
            )


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of each text's payload."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _store, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """The media table, written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(docs).write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.parquet(path)


def features(media: DataFrame) -> DataFrame:
    """Decode ``media``; lengths, digests and a feature of the samples, block by block."""
    return map_arrow(
        media.select("doc_id", "n_bytes", "media"), _features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Decoded blocks with the sample and the byte of the stream at which each begins."""
    return map_arrow(
        media.select("doc_id", "n_bytes", "media"), _blocks,
        "doc_id long, first_sample long, n_samples long, byte_offset long, pcm binary"
    )
