"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, units after numbers and names become typed
placeholders (slots).  Windows of a benchmark item's template are hash-joined with windows of
each document's template; matches on one diagonal are merged, and the slots they cover must
map benchmark values to document values one to one.  So a question with other numbers or names
is found, and a text that only shares the shape is not.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bound_batches
from .textops import BASE, BASE_INV, CODES, LOWER, U, Words, chunks, mix64, powers, scalar_mix, window_hashes

#: Words of a window, and of them the least that are literal; where slots are dense, windows grow until they hold so many.
WINDOW, LITERALS = 8, 5
#: A match counts if it covers so many tokens in a row, or this share of the item's tokens.
RUN, SHARE = 13, 0.5
#: Benchmark items searched for in one scan of the documents; more items take more scans.
BLOCK_ITEMS = 20_000

NUMBER, UNIT, NAME = 1, 2, 3
# Units that are a slot after a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds"
    " ml cl dl l litre litres liter liters pint pints gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks"
    " month months year years percent cent cents dollar dollars euro euros usd eur gbp hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n kn pa kpa"
    " kmh mph mps degrees degree celsius fahrenheit kelvin byte bytes kb mb gb tb bit bits pixel pixels square cubic"
).split()

ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
STOP = np.zeros(256, dtype=bool)
STOP[[ord(c) for c in ".!?:;"]] = True
SLOT_CODES = np.array([scalar_mix(0x510700 + i) for i in range(4)], dtype=U)


@dataclass
class Templates:
    code: np.ndarray  # of each token: word hash or slot code
    kind: np.ndarray  # 0 literal, else NUMBER, UNIT or NAME
    value: np.ndarray  # word hash, of a name of several words their sum
    doc: np.ndarray  # tokens of text i are at doc[i]:doc[i+1]


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(CODES[data] * powers(BASE, len(data)), out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * powers(BASE_INV, len(data) + 1)[start] + (end - start).astype(U))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    w = Words(data, np.array([0, len(data)]))
    return np.sort(_span_hashes(data, w.start, w.end))


UNIT_HASHES = _unit_hashes()


def templates(data: np.ndarray, offs: np.ndarray) -> tuple[Templates, Templates, Templates, Templates]:
    """The texts' templates with names as slots, with all capitalised words as slots (a name may begin a sentence), with names
    as words (for texts whose capitals are lost), and of words alone."""
    words = Words(data, offs)
    # without outer punctuation; words of punctuation alone go
    solid = np.flatnonzero(ALNUM[data])
    lo, hi = np.searchsorted(solid, words.start), np.searchsorted(solid, words.end)
    real = lo < hi
    start, end = solid[lo[real]], solid[hi[real] - 1] + 1
    doc = np.concatenate([[0], np.cumsum(real)])[words.doc]
    n = len(start)
    # A-Z and the capitals of Latin-1 folded
    low = LOWER[data].copy()
    if n == 0:
        none = Templates(np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0, U), doc)
        return none, none, none, none
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[latin] += 0x20
    h = _span_hashes(low, start, end)
    kind = np.zeros(n, dtype=np.int8)
    kind[DIGIT[data[start]]] = NUMBER
    after = np.zeros(n, dtype=bool)
    after[1:] = kind[:-1] == NUMBER
    after[doc[:-1][doc[:-1] < n]] = False
    at = np.minimum(np.searchsorted(UNIT_HASHES, h), len(UNIT_HASHES) - 1)
    kind[after & (UNIT_HASHES[at] == h) & (kind == 0)] = UNIT
    # a name: a capital and no other; whether one at the start of a sentence or line is a name, no template knows
    big = UPPER[data] | latin
    capitals = np.concatenate([[0], np.cumsum(big)])
    first = np.where(data[start] == 0xC3, np.minimum(start + 1, len(data) - 1), start)
    title = big[first] & (capitals[end] - capitals[start] == 1) & (end - start > 1)
    gap = np.concatenate([[0], np.cumsum(STOP[data] | (data == 10))])
    begins = np.ones(n, dtype=bool)
    begins[1:] = gap[start[1:]] > gap[end[:-1]]
    begins[doc[:-1][doc[:-1] < n]] = True
    plain = Templates(np.where(kind == 0, h, SLOT_CODES[kind]), kind.copy(), h, doc)
    raw = Templates(h, np.zeros(n, dtype=np.int8), h, doc)

    def named(names: np.ndarray) -> Templates:
        k = np.where(names & (kind == 0), np.int8(NAME), kind)
        # names of several words are one slot, within a sentence
        keep = np.ones(n, dtype=bool)
        keep[1:] = ~((k[1:] == NAME) & (k[:-1] == NAME)) | begins[1:]
        heads = np.flatnonzero(keep)
        k = k[heads]
        return Templates(np.where(k == 0, h[heads], SLOT_CODES[k]), k, np.add.reduceat(h, heads), np.concatenate([[0], np.cumsum(keep)])[doc])

    return named(title & ~begins), named(title), plain, raw


def spans(kind: np.ndarray, least: float = 0) -> list[tuple[int, int]]:
    """(start, end) of the windows of an item with such tokens.

    From every token forwards, and up to every token backwards, the shortest window of WINDOW tokens at least of which
    LITERALS are literal.  An item without so many is one window; one of slots alone, or with less
    than the share `least` of literal tokens, has none.
    """
    n = len(kind)
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    if n <= WINDOW or literal[-1] < LITERALS:
        return [(0, n)] if literal[-1] > 0 and (literal[-1] >= least * n or literal[-1] >= LITERALS) else []
    at = np.arange(n + 1)
    ends = np.maximum(at + WINDOW, np.searchsorted(literal, literal + LITERALS))
    starts = np.minimum(at - WINDOW, np.searchsorted(literal, literal - LITERALS, side="right") - 1)
    fore, back = ends <= n, starts >= 0
    return sorted({*zip(at[fore].tolist(), ends[fore].tolist()), *zip(starts[back].tolist(), at[back].tolist())})


def starved(kind: np.ndarray) -> bool:
    """Whether a window of WINDOW tokens (or the whole of a shorter item) has too few literal ones."""
    w = min(WINDOW, len(kind))
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    return bool((literal[w:] - literal[: len(literal) - w] < min(LITERALS, w)).any())


NEAR = (1 << 22) - 1


class Windows:
    """Windows of one kind of templates of some items (or of those marked): sorted window hashes with item, position and width.

    Windows of more than WINDOW tokens are looked for where their first WINDOW tokens occur.
    """

    def __init__(self, t: Templates, only: list[bool] | None = None, least: float = 0):
        self.t = t
        hashes, item, pos, width, seeds = [], [], [], [], []
        for i in range(len(t.doc) - 1):
            a, b = int(self.t.doc[i]), int(self.t.doc[i + 1])
            if a == b or only is not None and not only[i]:
                continue
            found = np.array(spans(self.t.kind[a:b], least), dtype=np.int64).reshape(-1, 2)
            start, size = found[:, 0], found[:, 1] - found[:, 0]
            code = self.t.code[a:b]
            for w in sorted(set(size.tolist())):
                of = start[size == w]
                hashes.append(window_hashes(code, w)[of])
                item.append(np.full(len(of), i))
                pos.append(of)
                width.append(np.full(len(of), w))
                if w > WINDOW:
                    seeds.append(window_hashes(code, WINDOW)[of])
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        h = cat(hashes, U)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.pos, self.width = h[order], cat(item, np.int64)[order], cat(pos, np.int64)[order], cat(width, np.int64)[order]
        self.near, self.seed = self._marks(h), self._marks(cat(seeds, U))
        self.widths = sorted(set(self.width.tolist()))

    @staticmethod
    def _marks(h: np.ndarray) -> np.ndarray | None:
        if not len(h):
            return None
        marks = np.zeros(NEAR + 1, dtype=bool)
        marks[(h & U(NEAR)).astype(np.int64)] = True
        return marks

    def _places(self, code: np.ndarray):
        """(width, positions, window hashes) of what may be windows of items."""
        near = lambda x, marks: np.flatnonzero(marks[(x & U(NEAR)).astype(np.int64)])
        for w in self.widths:
            if w <= WINDOW:
                x = window_hashes(code, w)
                at = near(x, self.near)
                yield w, at, x[at]
        if self.seed is not None:
            seeds = near(window_hashes(code, WINDOW), self.seed)
            prefix = np.concatenate([np.zeros(1, U), np.cumsum(code * powers(BASE, len(code)))])
            for w in self.widths:
                if w > WINDOW:
                    at = seeds[seeds + w <= len(code)]
                    yield w, at, mix64((prefix[at + w] - prefix[at]) * powers(BASE_INV, len(code) + 1)[at] + U(scalar_mix(w * 0x51ED27)))

    def matches(self, t: Templates) -> dict[tuple, tuple]:
        """(text, item) -> (longest run, covered tokens, windows, same slot values, item tokens) of each contaminated pair."""
        hits: dict[tuple, list] = defaultdict(list)
        for w, at, x in self._places(t.code):
            lo, hi = np.searchsorted(self.hash, x, "left"), np.searchsorted(self.hash, x, "right")
            at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
            text = np.searchsorted(t.doc, at, side="right") - 1
            for p, d, a, b in zip(at.tolist(), text.tolist(), lo.tolist(), hi.tolist()):
                if p + w <= t.doc[d + 1]:
                    for k in range(a, b):
                        if self.width[k] == w:
                            hits[d, int(self.item[k]), p - int(self.pos[k])].append((int(self.pos[k]), w))
        best: dict[tuple, tuple] = {}
        for (d, i, diagonal), found in hits.items():
            a, b = int(self.t.doc[i]), int(self.t.doc[i + 1])
            covered = np.zeros(b - a, dtype=bool)
            for pos, w in found:
                covered[pos : pos + w] = True
            slots = np.flatnonzero(covered & (self.t.kind[a:b] > 0))
            there, same, clash = {}, True, set()
            back: dict = {}
            for s in slots.tolist():
                x, y = (int(self.t.kind[a + s]), int(self.t.value[a + s])), int(t.value[diagonal + s])
                same &= x[1] == y
                if there.setdefault(x, y) != y or back.setdefault((x[0], y), x) != x:
                    clash.add(s)
            for s in clash:
                covered[s] = False
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
            longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
            total = int(covered.sum())
            if longest >= min(RUN, b - a) or total >= SHARE * (b - a) and longest >= min(WINDOW, b - a):
                row = (longest, total, len(found), same and not clash, b - a)
                best[d, i] = max(row, best.get((d, i), row))
        return best


class Benchmark:
    """Template windows of some items, with names as slots or as words, and word windows of items with stretches of dense slots."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.ids = ids
        named, titled, plain, words = templates(data, np.cumsum([0, *map(len, raw)]))
        # verbatim copies of what has no window of WINDOW template tokens
        dense = [any(starved(t.kind[t.doc[i] : t.doc[i + 1]]) for t in (named, plain)) for i in range(len(ids))]
        # 'Who is Tom?' must not match all of 'X is Y': of few words, half are literal where any capital is a slot
        self.kinds = [Windows(named), Windows(titled, least=0.5), Windows(plain), Windows(words, dense)]

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple]:
        """(text, item, windows, longest run, covered tokens, item tokens, same slot values) of each contaminated pair, by the template that covers more."""
        best: dict[tuple, tuple] = {}
        for windows, t in zip(self.kinds, templates(data, offs)):
            for pair, row in windows.matches(t).items():
                best[pair] = max(row, best.get(pair, row))
        return [(d, i, n, longest, total, size, same) for (d, i), (longest, total, n, same, size) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark as blocks of BLOCK_ITEMS items at most, read one after another."""
    ids, texts = [], []
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        if len(ids) == BLOCK_ITEMS:
            yield Benchmark(ids, texts)
            ids, texts = [], []
    if ids:
        yield Benchmark(ids, texts)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per contaminated pair: (id, item_id, n_windows, longest_run, n_covered, n_item_tokens, coverage, same_values).

    Whole texts are searched; null or empty texts and items match nothing; repeated rows give repeated
    pairs; null ids stay null; other columns are ignored.  Of several places in a document
    the longest counts.  Items with fewer tokens than a window are one window, as are items with
    fewer than LITERALS literal ones; of items of slots alone only verbatim copies are found.
    """
    src = bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` long, item_id long, n_windows long, longest_run long, n_covered long, n_item_tokens long, coverage double, same_values boolean"

    def search(bench: Benchmark):
        def kernel(batches):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for lo, _, data, offs in chunks(batch.column(1)):
                    rows = [(ids[lo + d], bench.ids[i], n, run, cov, size, cov / size, same) for d, i, n, run, cov, size, same in bench.matches(data, offs)]
                    if rows:
                        kinds = [pa.int64()] * 6 + [pa.float64(), pa.bool_()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

        return src.mapInArrow(kernel, schema)

    names = [id_col, "item_id", "n_windows", "longest_run", "n_covered", "n_item_tokens", "coverage", "same_values"]
    out = None
    for bench in benchmark_blocks(benchmark):
        part = search(bench)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text matches no benchmark item; a filter within each task, without a shuffle."""
    out = bound_batches(docs)
    at = docs.columns.index(text_col)
    for bench in benchmark_blocks(benchmark):
        def kernel(batches, bench=bench):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, data, offs in chunks(batch.column(at)):
                    for row in bench.matches(data, offs):
                        keep[lo + row[0]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(kernel, docs.schema)
    return out
