"""Vectorised text kernels over Arrow string buffers.

Texts stay as one byte buffer with offsets; words, word hashes and word windows are NumPy
arrays over that buffer, so no Python object is made per word.  Hashes are 64-bit: a
polynomial over byte codes with an odd base (mod 2**64, so prefix sums can be divided) and a
finalising bijection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once by the kernels (a longer text is handled alone).
CHUNK_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words with good avalanche (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit words."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def scalar_mix(x: int) -> int:
    return int(mix64(np.array([x & MASK], dtype=U))[0])


CODES = mix64(np.arange(1, 257, dtype=U))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word separators of the data contract: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; tables of usual size are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int32 if pa.types.is_string(col.type) else np.int64
    _, off, dat = col.buffers()
    offs = np.frombuffer(off, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of rows within max_bytes (one row at least)."""
    data, offs = buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of some texts: byte spans, 64-bit hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        n = len(data)
        if lower:
            data = LOWER[data]
        self.data, self.offs = data, offs
        word = ~SPACE[data]
        first = offs[:-1][offs[:-1] < offs[1:]]
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        before[first] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        after[first[1:] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        #: words of text i are at doc[i]:doc[i+1]
        self.doc = np.searchsorted(self.start, offs)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        prefix = np.zeros(n + 1, dtype=U)
        np.cumsum(CODES[self.data] * powers(BASE, n), out=prefix[1:])
        h = (prefix[self.end] - prefix[self.start]) * powers(BASE_INV, n + 1)[self.start]
        return mix64(h + (self.end - self.start).astype(U) * U(0xD1342543DE82EF95))

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive words (of the whole array; callers drop windows across texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    prefix = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * powers(BASE, len(h)), out=prefix[1:])
    s = (prefix[k:] - prefix[:n]) * powers(BASE_INV, n)
    return mix64(s + U(scalar_mix(k * 0x51ED27 + salt)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (block prefix and suffix minima)."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    y = np.concatenate([x, np.full(pad, x.max(), dtype=x.dtype)]) if pad else x
    blocks = y.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text (A-Z folded); a text of fewer words is one shingle."""
    words = Words(data, offs, lower=True)
    h, doc = words.hashes(), words.doc
    s = window_hashes(h, k)
    out = []
    for i in range(len(offs) - 1):
        a, b = int(doc[i]), int(doc[i + 1])
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(window_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def list_column(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """A list column of rows of equal width."""
    n = len(values) // width if width else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values, type=kind))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
