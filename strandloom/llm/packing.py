"""Packing of token sequences by a dot-product heuristic for vector bins.

A bin has three capacities: tokens, segments and loss-bearing tokens.  An open bin takes, of
the pool's examples that fit, the one with the largest weighted dot product of its demand and
the bin's remaining capacity; where nothing fits whole and cutting is allowed, the best example
is cut.  Each task packs what it reads, with a pool of bounded size, so nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bound_batches
from .textops import chunks

#: Words, and pieces of words, whose ids are kept in a worker; a full table is emptied.
KNOWN_WORDS, KNOWN_PIECES = 500_000, 500_000
#: Examples among which a bin chooses, and the most token bytes they hold together.
POOL, POOL_BYTES = 256, 8 << 20

#: Pieces of one output batch.
OUT_ROWS = 1024

_encoders: dict[tuple, object] = {}


#: A run of letters and then ASCII punctuation without an apostrophe.
SIMPLE = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
ASCII = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class WordEncoder(dict):
    """Ids (little-endian uint32 bytes) of white-space separated words, each word encoded once.

    For tokenizers that drop white space: the ids of a text are those of its words in turn.
    A word is normalised and split by the tokenizer's own parts, and pieces go to its model.
    Where probes show that the tokenizer lower-cases and splits letters from punctuation over
    bytes, words of Latin letters take these two steps here.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # byte b as the model sees it: printable Latin-1 characters stay, the others follow U+0100 in turn
        stay = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        rest = [b for b in range(256) if b not in set(stay)]
        self.as_model = {b: 0x100 + i for i, b in enumerate(rest)}
        probes = ("AbC,.!", "\u00c9t\u00c9\u00df\u00f1", "x#%&*")
        self.simple = all(self._split_simple(p) == self._split(p) for p in probes)

    def _split(self, word: str) -> list[str]:
        t = self.tokenizer
        word = t.normalizer.normalize_str(word) if t.normalizer else word
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(word)] if t.pre_tokenizer else [word]

    def _split_simple(self, word: str) -> list[str] | None:
        m = SIMPLE.fullmatch(word)
        if not m or max(word) >= "\u0130" or not m[1].isalpha():
            return None
        parts = [m[1].lower(), m[2]] if m[2] else [m[1].lower()]
        return parts if word.isascii() else [p.encode().decode("latin-1").translate(self.as_model) for p in parts]

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= KNOWN_PIECES:
                self.pieces.clear()
            found = [t.id for t in self.model.tokenize(piece)]
            ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        plain = ASCII(raw) if self.simple else None
        if plain:
            letters, marks = plain.groups()
            ids = self._piece(letters.lower().decode())
            if marks:
                ids += self._piece(marks.decode())
            self[raw] = ids
            return ids
        word = raw.decode("utf-8", "replace")
        parts = self._split_simple(word) if self.simple else None
        if parts is not None:
            ids = b"".join(map(self._piece, parts))
        elif any(x in word for x in self.special):
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            ids = b"".join(map(self._piece, self._split(word)))
        self[raw] = ids
        return ids

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Places examples (key, tokens, loss tokens) into bins; yields (key, start, length, bin, offset)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool, pool: int = POOL):
        self.caps = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.cut, self.limit = cut, pool
        self.keys: list = []
        self.starts: list[int] = []
        self.need = np.zeros((4 * pool, 3))
        self.bin = 0
        self.held = 0

    def add(self, key, tokens: int, loss: int) -> None:
        if not self.cut and (tokens > self.caps[0] or loss > self.caps[2]):
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, fits no sequence and cutting is off")
        if len(self.keys) == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[len(self.keys)] = tokens, 1, loss
        self.keys.append(key)
        self.starts.append(0)
        self.held += tokens

    def full(self) -> bool:
        return len(self.keys) >= self.limit or self.held * 4 > POOL_BYTES

    def _drop(self, i: int) -> None:
        last = len(self.keys) - 1
        self.need[i] = self.need[last]
        self.keys[i], self.starts[i] = self.keys[last], self.starts[last]
        self.keys.pop()
        self.starts.pop()

    def fill(self) -> list[tuple]:
        """One bin."""
        left, placed, offset = self.caps.copy(), [], 0
        weight = self.need[: len(self.keys)].mean(axis=0) / self.caps**2
        while self.keys and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.keys)]
            fits = (need <= left).all(axis=1)
            worth = need @ (weight * left)
            if fits.any() and not (self.cut and left[1] == 1 and (need[:, 0] > left[0]).any()):
                i = int(np.argmax(np.where(fits, worth, -1.0)))
                length, loss = int(need[i, 0]), need[i, 2]
            elif self.cut:
                i = int(np.argmax(worth))
                # loss tokens are spread evenly over an example that is cut
                rate = need[i, 2] / need[i, 0]
                length = int(min(need[i, 0], left[0], left[2] // rate if rate else left[0]))
                if length <= 0:
                    break
                loss = rate * length
            else:
                break
            placed.append((self.keys[i], self.starts[i], length, self.bin, offset))
            left -= (length, 1, loss)
            offset += length
            self.held -= length
            if length == int(need[i, 0]):
                self._drop(i)
            else:
                self.starts[i] += length
                self.need[i, 0] -= length
                self.need[i, 2] -= loss
        self.bin += 1
        return placed

    def total(self) -> int:
        return self.held


def power_of_two_tail(placed: list[tuple], first_bin: int) -> tuple[list[tuple], int]:
    """Cut one bin that is not full into bins of powers of two, which need no padding."""
    total = sum(p[2] for p in placed)
    out, b, room, offset = [], first_bin, 0, 0
    for key, start, length, _, _ in placed:
        while length:
            if room == 0:
                room, offset = 1 << (total.bit_length() - 1), 0
            n = min(length, room)
            out.append((key, start, n, b, offset))
            start, length, room, offset, total = start + n, length - n, room - n, offset + n, total - n
            if room == 0:
                b += 1
    return out, b


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    max_tokens: int = 4096,
    max_segments: int = 1024,
    max_loss: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document is the ids of its text (null: empty) and then end_id; every token bears loss.
    Documents are cut freely; each id lies in one piece.  All sequences hold max_tokens but a
    task's last ones, which are cut at powers of two, or those that the segment limit closes.
    sequence_id is the task's partition and a count, so it is unique over the table; a task
    that is run again packs its rows in the same way.  Null ids and repeated rows are packed
    as they are; an empty table gives an empty table; other columns are ignored.
    """

    def kernel(batches):
        encode = encoder(tokenizer)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(max_tokens, max_segments, max_loss, cut=True)
        held: dict[int, list] = {}  # of rows in the pool: id, ids, tokens not yet placed
        rows: list[tuple] = []
        count = 0

        def give(placed):
            for key, start, length, b, offset in placed:
                doc = held[key]
                part = doc[1][4 * start : 4 * (start + length)]
                rows.append((doc[0], start, length, zlib.crc32(part), len(doc[1]) // 4, first + b, offset) + ((part,) if with_ids else ()))
                doc[2] -= length
                if not doc[2]:
                    del held[key]

        def out():
            cols = list(zip(*rows)) if rows else [()] * (8 if with_ids else 7)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                raw = data.tobytes()
                for doc, x in zip(ids, encode([raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])):
                    x += end
                    held[count] = [doc, x, len(x) // 4]
                    packer.add(count, len(x) // 4, len(x) // 4)
                    count += 1
                    while packer.full() and packer.total() >= max_tokens:
                        give(packer.fill())
                if len(rows) >= OUT_ROWS:
                    yield out()
        while packer.keys:
            b = packer.bin
            placed = packer.fill()
            if not packer.keys and sum(p[2] for p in placed) < max_tokens:
                placed, packer.bin = power_of_two_tail(placed, b)
            give(placed)
        yield out()

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"`{n}` {'binary' if n == 'ids' else 'long'}" for n in names)
    return bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, schema)


def pack_examples(examples: DataFrame, max_tokens: int = 4096, max_segments: int = 64, max_loss: int = 2048) -> DataFrame:
    """Instruction examples (example_id, n_tokens, n_loss) -> (example_id, sequence_id, offset), none of them cut.

    An example beyond a limit on its own is an error; null counts are 0.
    """

    def kernel(batches):
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        packer = Packer(max_tokens, max_segments, max_loss, cut=False)

        def out(placed):
            return pa.RecordBatch.from_arrays([pa.array([p[j] if j != 3 else first + p[3] for p in placed], type=pa.int64()) for j in (0, 3, 4)], names=["example_id", "sequence_id", "offset"])

        for batch in batches:
            for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(key, tokens or 0, loss or 0)
                while packer.full():
                    yield out(packer.fill())
        while packer.keys:
            yield out(packer.fill())

    return examples.select(F.col("example_id").cast("long"), F.col("n_tokens").cast("long"), F.col("n_loss").cast("long")).mapInArrow(kernel, "example_id long, sequence_id long, offset long")
