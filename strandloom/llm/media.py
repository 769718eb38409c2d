"""Media columns: AVI files of motion JPEG.

`parse_avi` reads the RIFF chunks and the idx1 index; `JpegFrame` decodes baseline frames
(Huffman, any tables and sampling); `shots` finds cuts where the luma histogram changes by more
than an adaptive bound, giving timed clips.

`store` keeps any bytes losslessly in such a file.  Its unit is the quantised DCT coefficient:
192 payload bytes are the 3 x 64 coefficients of one 8 x 8 frame (4:4:4, one MCU).  Every
coefficient is of magnitude class 8, whose Huffman code is one bit, and the payload byte is its
eight magnitude bits; so a frame's entropy-coded part is 216 bytes and no rounding occurs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bound_batches
from .textops import chunks

UNIT = 192
FRAME_RATE = 25
MICROS = 1_000_000 // FRAME_RATE


def zigzag() -> np.ndarray:
    """Row-major position of each coefficient in scan order, from the rule of the diagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
_u = np.arange(8)
#: Inverse DCT: samples = BASIS.T @ coefficients @ BASIS
BASIS = np.where(_u[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind, 1, *([0] * 15), symbol]))


#: Of every stored frame: unit quantisers, 8 x 8 pixels, three components, two one-code tables.
FRAME_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3)))
    + _dht(0x00, 8) + _dht(0x10, 8)
    + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
)
FRAME_TAIL = b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes] | tuple[bytes, np.ndarray, np.ndarray], width: int, height: int) -> bytes:
    """RIFF/AVI of MJPG frames with an idx1 index; frames, or (movi chunks, their offsets, frame sizes)."""
    if isinstance(frames, list):
        sizes = np.array([len(f) for f in frames], dtype="<u4")
        movi = b"".join(_chunk(b"00dc", f) for f in frames)
        at = 4 + np.cumsum([0, *(8 + len(f) + len(f) % 2 for f in frames)])[:-1]
    else:
        movi, at, sizes = frames
    n = len(sizes)
    largest = int(sizes.max()) if n else 0
    avih = struct.pack("<10I16x", MICROS, largest * FRAME_RATE, 0, 0x10, n, 0, 1, largest, width, height)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FRAME_RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    index = np.zeros((n, 4), dtype="<u4")
    index[:, 0] = np.frombuffer(b"00dc", dtype="<u4")[0]
    index[:, 1] = 0x10
    index[:, 2] = at
    index[:, 3] = sizes
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"movi" + movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Video:
    width: int
    height: int
    micros_per_frame: int
    data: bytes
    offsets: np.ndarray
    sizes: np.ndarray

    def frame(self, i: int) -> bytes:
        a = int(self.offsets[i])
        return self.data[a : a + int(self.sizes[i])]


def parse_avi(data: bytes) -> Video:
    """Header and frame positions, from idx1 where there is one (offsets from movi or from the file), else by walking movi."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            size = min(size, end - at - 8)
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                found[kind] = (at + 8, size)
                if kind != b"movi":
                    walk(at + 12, at + 8 + size)
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + size % 2

    walk(12, len(data))
    micros, = struct.unpack_from("<I", data, found[b"avih"][0])
    width, height = struct.unpack_from("<II", data, found[b"avih"][0] + 32)
    movi, length = found[b"movi"]
    if b"idx1" in found:
        at, size = found[b"idx1"]
        index = np.frombuffer(data, dtype="<u4", count=size // 16 * 4, offset=at).reshape(-1, 4).astype(np.int64)
        video = np.isin(index[:, 0], [np.frombuffer(x, dtype="<u4")[0] for x in (b"00dc", b"00db")])
        offsets, sizes = index[video, 2] + movi + 8, index[video, 3]
        if len(offsets) and data[int(offsets[0]) - 8 : int(offsets[0]) - 4] not in (b"00dc", b"00db"):
            offsets = offsets - movi
    else:
        offsets, sizes, at = [], [], movi + 4
        while at + 8 <= movi + length:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] in (b"00dc", b"00db"):
                offsets.append(at + 8)
                sizes.append(size)
            at += 8 + size + size % 2
        offsets, sizes = np.array(offsets, dtype=np.int64), np.array(sizes, dtype=np.int64)
    return Video(width, height, micros or MICROS, data, offsets, sizes)


class JpegFrame:
    """Tables, geometry and entropy-coded part of a baseline JPEG frame."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    table, code, k = {}, 0, 17
                    for length in range(1, 17):
                        for _ in range(body[length]):
                            table[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.codes[body[0]] = table
                    body = body[k:]
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only baseline JPEG is decoded")
        self.coded = data[at:]

    def blocks(self) -> list[np.ndarray]:
        """Quantised coefficients of each component, (rows, columns, 64) in scan order."""
        high = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        across, down = -(-self.width // (8 * high[0])), -(-self.height // (8 * high[1]))
        out = [np.zeros((down * p[2], across * p[1], 64), dtype=np.int64) for p in self.parts]
        end, pieces, at = len(self.coded), [], 0
        i = 0
        while i < end - 1:  # split at restart markers; take stuffed zeros out
            if self.coded[i] == 0xFF and self.coded[i + 1] != 0:
                pieces.append(self.coded[at:i])
                if not 0xD0 <= self.coded[i + 1] <= 0xD7:
                    break
                i = at = i + 2
                continue
            i += 1
        else:
            pieces.append(self.coded[at:])
        streams = iter(p.replace(b"\xff\x00", b"\xff") for p in pieces)
        bits, pos, last = "", 0, [0] * len(self.parts)

        def code(table):
            nonlocal pos
            value = 0
            for length in range(1, 17):
                value = value << 1 | (bits[pos] == "1")
                pos += 1
                if (length, value) in table:
                    return table[length, value]
            raise ValueError("bad Huffman code")

        def magnitude(size):
            nonlocal pos
            if not size:
                return 0
            v = int(bits[pos : pos + size], 2)
            pos += size
            return v if v >> (size - 1) else v - (1 << size) + 1

        for mcu in range(across * down):
            if mcu == 0 or self.restart and mcu % self.restart == 0:
                stream = next(streams)
                bits, pos, last = bin(int.from_bytes(b"\1" + stream, "big"))[3:] + "1" * 16, 0, [0] * len(self.parts)
            for c, (cid, h, v, _) in enumerate(self.parts):
                dc, ac = self.scan[cid]
                for b in range(h * v):
                    block = out[c][mcu // across * v + b // h, mcu % across * h + b % h]
                    last[c] += magnitude(code(self.codes[dc]))
                    block[0] = last[c]
                    k = 1
                    while k < 64:
                        rs = code(self.codes[0x10 | ac])
                        if rs == 0:
                            break
                        k += rs >> 4
                        if rs & 15:
                            block[k] = magnitude(rs & 15)
                        k += 1
        return out

    def luma(self) -> np.ndarray:
        """8-bit samples of the first component."""
        coefs = self.blocks()[0]
        pix = samples(coefs.reshape(-1, 64) * self.quant[self.parts[0][3]])
        rows, cols = coefs.shape[:2]
        return pix.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)[: self.height, : self.width]


def samples(coefs: np.ndarray) -> np.ndarray:
    """(n, 64) dequantised coefficients in scan order -> (n, 64) samples 0 to 255."""
    flat = np.zeros(coefs.shape, dtype=np.float32)
    flat[:, ZIGZAG] = coefs
    return np.clip(np.rint(flat @ INVERSE) + 128, 0, 255).astype(np.uint8)


#: The two-dimensional inverse DCT as one 64 x 64 matrix over row-major blocks.
INVERSE = np.einsum("ux,vy->uvxy", BASIS, BASIS).reshape(64, 64).astype(np.float32)


def histograms(luma: np.ndarray, bins: int = 16) -> np.ndarray:
    """Shares of luma values of each row's samples in equal bins."""
    n = len(luma)
    at = (luma.astype(np.int64) * bins >> 8) + np.arange(n)[:, None] * bins
    return np.bincount(at.ravel(), minlength=n * bins).reshape(n, bins) / max(1, luma.shape[1])


def shots(hist: np.ndarray, window: int = 12, factor: float = 3.0, floor: float = 0.25) -> list[tuple[int, int]]:
    """Frame ranges [first, last + 1) between cuts.

    A cut lies before frame i if the histogram difference d_i (half the L1 distance) is over
    `floor` and over mean + factor * deviation of the up to `window` differences on either side.
    """
    n = len(hist)
    if n == 0:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    if len(d) == 0:
        return [(0, 1)]
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    lo, hi = np.maximum(np.arange(len(d)) - window, 0), np.minimum(np.arange(len(d)) + window + 1, len(d))
    m = np.maximum(hi - lo - 1, 1)
    mean = (s1[hi] - s1[lo] - d) / m
    var = np.maximum((s2[hi] - s2[lo] - d * d) / m - mean * mean, 0)
    cuts = np.flatnonzero((d > floor) & (d > mean + factor * np.sqrt(var))) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:]))


def clips(video: Video, hist: np.ndarray) -> list[tuple[int, int, int]]:
    """(clip, start in microseconds, end in microseconds)."""
    return [(i, a * video.micros_per_frame, b * video.micros_per_frame) for i, (a, b) in enumerate(shots(hist))]


def store(payload: bytes) -> bytes:
    """Payload (a positive multiple of UNIT bytes) as an AVI file, one unit a frame."""
    units = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    bits = np.zeros((len(units), UNIT, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(units.reshape(-1, 1), axis=1).reshape(len(units), UNIT, 8)
    coded = np.packbits(bits.reshape(len(units), -1), axis=1)
    if (coded == 0xFF).any():  # byte stuffing makes frames differ in size
        return write_avi([FRAME_HEAD + c.tobytes().replace(b"\xff", b"\xff\0") + FRAME_TAIL for c in coded], 8, 8)
    size = len(FRAME_HEAD) + coded.shape[1] + len(FRAME_TAIL)
    frames = np.zeros((len(units), 8 + size + size % 2), dtype=np.uint8)
    frames[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), dtype=np.uint8)
    frames[:, 8 : 8 + len(FRAME_HEAD)] = np.frombuffer(FRAME_HEAD, dtype=np.uint8)
    frames[:, 8 + len(FRAME_HEAD) : 8 + size - 2] = coded
    frames[:, 6 + size : 8 + size] = np.frombuffer(FRAME_TAIL, dtype=np.uint8)
    return write_avi((frames.tobytes(), 4 + np.arange(len(units)) * frames.shape[1], np.full(len(units), size, dtype="<u4")), 8, 8)


def read_units(video: Video) -> np.ndarray:
    """(frames, 192) magnitude bytes of stored frames, read from their entropy-coded parts."""
    size = len(FRAME_HEAD) + 216 + 2
    if len(video.sizes) and (video.sizes == size).all():
        whole = np.frombuffer(video.data, dtype=np.uint8)
        step = int(video.offsets[1] - video.offsets[0]) if len(video.offsets) > 1 else size
        if (np.diff(video.offsets) == step).all():
            first = int(video.offsets[0])
            frames = np.lib.stride_tricks.as_strided(whole[first:], (len(video.sizes), size), (step, 1), writeable=False)
            if (frames[:, : len(FRAME_HEAD)] == np.frombuffer(FRAME_HEAD, dtype=np.uint8)).all():
                bits = np.unpackbits(frames[:, len(FRAME_HEAD) : -2], axis=1).reshape(len(frames), UNIT, 9)
                return np.packbits(bits[:, :, 1:], axis=2).reshape(len(frames), UNIT)
    out = np.zeros((len(video.sizes), UNIT), dtype=np.uint8)
    for i in range(len(video.sizes)):
        data = video.frame(i)
        if not data.startswith(FRAME_HEAD):
            raise ValueError("not a frame of stored bytes")
        coded = np.frombuffer(data[len(FRAME_HEAD) : -2].replace(b"\xff\0", b"\xff"), dtype=np.uint8)
        out[i] = np.packbits(np.unpackbits(coded).reshape(UNIT, 9)[:, 1:], axis=1).ravel()
    return out


def luma_of_units(units: np.ndarray) -> np.ndarray:
    """Decoded luma samples of stored frames: magnitude bytes -> coefficients -> inverse DCT."""
    y = units[:, :64].astype(np.int64)
    return samples(np.where(y >= 128, y, y - 255))


def decode_luma(video: Video) -> np.ndarray:
    """(frames, pixels) luma of any MJPEG video of one frame size."""
    return np.stack([JpegFrame(video.frame(i)).luma().ravel() for i in range(len(video.sizes))]) if len(video.sizes) else np.zeros((0, 1), np.uint8)


def clip_rows(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """AVI files (id, bytes) -> one row per shot (id, clip, start_us, end_us, n_frames); null bytes give no row."""

    def kernel(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is not None:
                    video = parse_avi(data)
                    rows += [(key, *c, (c[2] - c[1]) // video.micros_per_frame) for c in clips(video, histograms(decode_luma(video)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type=pa.int64()) for j in range(5)], names=[id_col, "clip", "start_us", "end_us", "n_frames"])

    return bound_batches(files, 100).select(F.col(id_col).cast("long"), F.col(data_col)).mapInArrow(kernel, f"`{id_col}` long, clip long, start_us long, end_us long, n_frames long")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row per input row: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media]).

    The text (null: empty) as UTF-8 is padded with spaces to a positive multiple of UNIT, stored
    as an AVI file, and read back from that file's bytes; all values but n_bytes come from what was
    read.  feature: frames, shots, longest shot, mean luma and the mean histogram in 16 digits
    (tenths, at most 9).  Equal texts have equal values; ids and other columns do not matter.
    """

    def kernel(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                raw, rows, media = data.tobytes(), [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    body = raw[a:b]
                    file = store(body.ljust(max(1, -(-len(body) // UNIT)) * UNIT))
                    video = parse_avi(file)
                    units = read_units(video)
                    back = units.tobytes()
                    luma = luma_of_units(units)
                    hist = histograms(luma)
                    found = shots(hist)
                    digits = "".join(str(min(9, int(x * 10))) for x in hist.mean(axis=0))
                    feature = f"frames={len(units)};shots={len(found)};longest={max(y - x for x, y in found)};luma={luma.mean():.2f};hist={digits}"
                    rows.append((len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                    if with_media:
                        media.append(file)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(c, type=k) for c, k in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(media, type=pa.binary())] * with_media, names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    schema = f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, schema)
