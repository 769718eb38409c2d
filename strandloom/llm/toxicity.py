"""Toxicity by a linear classifier on character n-grams scaled with naive Bayes log-count ratios.

Feature j of a text is r_j if the n-gram occurs in it and 0 otherwise, where r_j is the log
ratio of smoothed document frequencies in toxic and clean training texts; a text's features are
brought to one length.  A logistic regression is fitted on them, and its scores are calibrated
on scores that models of other folds give the training texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .spark import bound_batches, cut
from .textops import BASE, BASE_INV, CHUNK_BYTES, U, chunks, mix64, powers, scalar_mix

SIZES = (4, 5, 6)
#: Bounds of the fit: labelled rows per class.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
#: An n-gram is a feature if it is in so many of these texts and its shares in the classes differ by z standard errors:
#: of hundreds of thousands of n-grams nearly all differ by chance, and with them all fewer toxic texts are found (README).
MIN_DOCS, MIN_Z = 3, 3.0
SAMPLE_TASKS = 8
#: Length that a text's features are brought to, weight of the squared coefficients, rounds of the fit, and folds of the calibration.
LENGTH, L2, STEPS, FOLDS = 10.0, 1e-2, 60, 4
THRESHOLD = 0.7

_fold = np.arange(0x600, dtype=np.uint32)
for _c in range(0x600):
    _low = chr(_c).lower()
    if chr(_c).isspace():
        _fold[_c] = 0x20
    elif len(_low) == 1:
        _fold[_c] = ord(_low)


def folded_chars(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lower-cased, with a space before each text and at the end; positions of these spaces."""
    raw = data.tobytes()
    try:
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype="<u4")
        before = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        at = before[offs]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4")
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = np.insert(chars, at, np.uint32(0x20))
    small = out < len(_fold)
    out[small] = _fold[out[small]]
    return out, at + np.arange(len(at))


def ngram_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    prefix = np.zeros(len(chars) + 1, dtype=U)
    np.cumsum(mix64(chars.astype(U) + U(1)) * powers(BASE, len(chars)), out=prefix[1:])
    return mix64((prefix[size:] - prefix[:n]) * powers(BASE_INV, n) + U(scalar_mix(size)))


def _spans(spaces: np.ndarray, size: int):
    for a, b in zip(spaces[:-1].tolist(), spaces[1:].tolist()):
        yield a, max(a, b - size + 2)


@dataclass
class Model:
    grams: np.ndarray  # sorted hashes
    ratio: np.ndarray  # log-count ratios
    coef: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def score(self, found: np.ndarray) -> float:
        """Probability of a text with these n-grams."""
        r = self.ratio[found]
        size = float(np.sqrt(r @ r))
        s = self.bias + (LENGTH * float(r @ self.coef[found]) / size if size else 0.0)
        return float(_sigmoid(np.array(self.slope * s + self.shift)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _train_counts(batches):
    """(gram, toxic documents, clean documents), summed over a few hundred kilobytes of text at a time."""
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
        for lo, _, data, offs in chunks(batch.column(0), CHUNK_BYTES):
            parts = ([], [])
            chars, spaces = folded_chars(data, offs)
            hashed = [ngram_hashes(chars, s) for s in SIZES]
            for i, spans in enumerate(zip(*(_spans(spaces, s) for s in SIZES))):
                parts[toxic[lo + i]].append(np.unique(np.concatenate([h[a:b] for h, (a, b) in zip(hashed, spans)])))
            for y in (0, 1):
                if parts[y]:
                    grams, n = np.unique(np.concatenate(parts[y]), return_counts=True)
                    zero = np.zeros(len(n), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n if y else zero), pa.array(zero if y else n)], names=["gram", "a", "b"])


class _Lookup:
    """Which of the model's n-grams occur in each text."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.near = np.zeros(1 << 22, dtype=bool)
        self.near[(grams & U((1 << 22) - 1)).astype(np.int64)] = True

    def rows(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        chars, spaces = folded_chars(data, offs)
        text, found = [], []
        for size in SIZES:
            h = ngram_hashes(chars, size)
            at = np.flatnonzero(self.near[(h & U((1 << 22) - 1)).astype(np.int64)])
            j = np.searchsorted(self.grams, h[at])
            j[j == len(self.grams)] = 0
            exact = self.grams[j] == h[at] if len(self.grams) else np.zeros(0, dtype=bool)
            at, j = at[exact], j[exact]
            i = np.searchsorted(spaces, at, side="right") - 1
            inside = (i < len(offs) - 1) & (at + size - 1 <= spaces[np.minimum(i + 1, len(spaces) - 1)])
            text.append(i[inside])
            found.append(j[inside])
        text, found = np.concatenate(text), np.concatenate(found)
        pairs = np.unique(text * (len(self.grams) + 1) + found)
        text, found = np.divmod(pairs, len(self.grams) + 1)
        return np.split(found, np.searchsorted(text, np.arange(1, len(offs) - 1)))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    """Fit on (id, text) and (id, toxic): at most TOXIC_ROWS and CLEAN_ROWS labelled rows, by a hash of the id.

    Rows without a label or a text are left out; without both classes the model has only a bias.
    """
    def some(y, n):
        return labels.filter(F.col("toxic") == y).select("id", "toxic").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)

    chosen = cut(some(1, TOXIC_ROWS).unionByName(some(0, CLEAN_ROWS)))
    # at most TOXIC_ROWS + CLEAN_ROWS rows, hence the broadcast; dealt anew, so that the scan keeps its own tasks
    sample = cut(docs.filter("text is not null").join(F.broadcast(chosen), "id").select("text", F.col("toxic").cast("int").alias("toxic")).repartition(SAMPLE_TASKS))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, dtype=U), np.zeros(0), np.zeros(0), -3.0 if not pos else 3.0)
    counts = sample.mapInArrow(_train_counts, "gram long, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    pooled = (F.col("a") + F.col("b")) / F.lit(pos + neg)
    z = (F.col("a") / F.lit(pos) - F.col("b") / F.lit(neg)) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / pos + 1 / neg))
    # bounded by the sampled rows, of which a feature needs MIN_DOCS at least
    rows = counts.filter(f"a + b >= {MIN_DOCS} and a + b < {pos + neg}").filter(F.abs(z) >= MIN_Z).select("gram").toPandas()
    grams = np.sort(rows["gram"].to_numpy(dtype=np.int64).view(U))

    def presence(batches):
        look = _Lookup(grams)
        for batch in batches:
            y = batch.column(1).to_pylist()
            for lo, hi, data, offs in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi], type=pa.int32()), pa.array([f.astype(np.int32).tobytes() for f in look.rows(data, offs)], type=pa.binary())], names=["toxic", "found"])

    seen = sample.mapInArrow(presence, "toxic int, found binary").collect()
    y = np.array([r["toxic"] for r in seen], dtype=float)
    found = [np.frombuffer(r["found"], dtype=np.int32) for r in seen]
    del seen
    return _train(grams, found, y)


class _Texts:
    """Which of d n-grams each text has, as one array of n-gram numbers; sums go block by block, so that temporary arrays stay small."""

    def __init__(self, found: list[np.ndarray], d: int, block: int = 1 << 18):
        self.n, self.d = len(found), d
        self.first = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        self.col = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        cuts = np.searchsorted(self.first, np.arange(0, self.first[-1] + block, block))
        self.edges = np.unique(np.concatenate([[0], np.minimum(cuts, self.n), [self.n]]))

    def blocks(self):
        """(first text, last + 1, positions, text of each position within the block)."""
        for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            yield a, b, slice(int(self.first[a]), int(self.first[b])), np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))

    def count(self, weight: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        """For each n-gram the sum of weights of the texts that have it (times x, if given)."""
        out = np.zeros(self.d)
        for a, b, at, row in self.blocks():
            w = weight[a:b][row]
            out += np.bincount(self.col[at], weights=w if x is None else w * x[at], minlength=self.d)
        return out

    def values(self, ratio: np.ndarray) -> np.ndarray:
        """The features, each text's brought to LENGTH."""
        x = ratio.astype(np.float32)[self.col]
        for a, b, at, row in self.blocks():
            size = np.sqrt(np.bincount(row, weights=x[at] ** 2, minlength=b - a))
            x[at] *= (LENGTH / np.maximum(size, 1e-12)).astype(np.float32)[row]
        return x

    def scores(self, coef: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty(self.n)
        for a, b, at, row in self.blocks():
            out[a:b] = np.bincount(row, weights=coef[self.col[at]] * x[at], minlength=b - a)
        return out


def _train(grams: np.ndarray, found: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of texts with these n-grams and labels; the order of texts does not matter, and equal texts share a fold."""
    order = sorted(range(len(y)), key=lambda i: (y[i], found[i].tobytes()))
    y = y[order]
    fold = np.array([zlib.crc32(found[i].tobytes()) % FOLDS for i in order])
    texts = _Texts([found[i] for i in order], len(grams))
    found.clear()
    ratio, coef, bias, _ = _fit_rows(texts, y, np.ones(len(y), dtype=bool))
    held = np.zeros(len(y))
    for k in range(FOLDS):
        held[fold == k] = _fit_rows(texts, y, fold != k)[3][fold == k]
    slope, shift = _calibrate(held, y)
    used = np.flatnonzero(ratio)
    return Model(grams[used], ratio[used], coef[used], bias, slope, shift)


def _fit_rows(texts: _Texts, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(ratios, coefficients, bias, scores of all texts) from the texts that `use` marks; n-grams that tell nothing among these have ratio 0."""
    pos, neg = max(1.0, float(y[use].sum())), max(1.0, float((1 - y[use]).sum()))
    a, b = texts.count(y * use), texts.count((1 - y) * use)
    pooled = (a + b) / (pos + neg)
    z = np.abs(a / pos - b / neg) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / pos + 1 / neg))
    ratio = np.where((a + b >= MIN_DOCS) & (z >= MIN_Z), np.log((a + 1) / (pos + 2)) - np.log((b + 1) / (neg + 2)), 0.0)
    x = texts.values(ratio)
    m, sign = float(use.sum()), np.where(y == 1, 1.0, -1.0)

    def loss(w):
        s = texts.scores(w[:-1], x) + w[-1]
        err = (_sigmoid(s) - y) * use / m
        value = float((np.logaddexp(0, -sign * s) * use).sum()) / m + L2 / 2 * float(w[:-1] @ w[:-1])
        return value, np.append(texts.count(err, x) + L2 * w[:-1], err.sum())

    w = _minimise(loss, np.append(np.zeros(texts.d), np.log(pos / neg)))
    return ratio, w[:-1], float(w[-1]), texts.scores(w[:-1], x) + w[-1]


def _minimise(loss, w: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a halving line search."""
    steps: list[tuple] = []  # (move, change of the gradient, their product)
    value, grad = loss(w)
    for _ in range(STEPS):
        way, parts = grad.copy(), []
        for s, g, sg in reversed(steps):
            parts.append(s @ way / sg)
            way -= parts[-1] * g
        if steps:
            way *= steps[-1][2] / (steps[-1][1] @ steps[-1][1])
        for (s, g, sg), c in zip(steps, reversed(parts)):
            way += s * (c - g @ way / sg)
        size, slope = 1.0 if steps else 1 / max(1.0, float(np.abs(grad).sum())), float(grad @ way)
        new, found = loss(w - size * way)
        while new > value - 1e-4 * size * slope and size > 1e-9:
            size /= 2
            new, found = loss(w - size * way)
        if value - new <= 1e-7 * abs(value):
            break
        s, g = -size * way, found - grad
        if s @ g > 1e-12:
            steps = [*steps, (s, g, float(s @ g))][-memory:]
        w, value, grad = w + s, new, found
    return w


def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of y over scores s by Newton steps; the slope stays positive, so that scores keep their order."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * s + b)
        h = p * (1 - p) + 1e-6
        hess = np.array([[(h * s * s).mean(), (h * s).mean()], [(h * s).mean(), h.mean()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, [((p - y) * s).mean(), (p - y).mean()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def score(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` of docs and the score and prediction as `names`, which `keep` must not hold; column `text` is scored whole (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        model = shared.value
        look = _Lookup(model.grams)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(0)):
                p = np.array([model.score(f) for f in look.rows(data, offs)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*keep, *names])

    src = bound_batches(docs).select(F.col("text").alias("__text"), *(F.col(c) for c in keep))
    out = StructType(src.schema.fields[1:]).add(names[0], DoubleType()).add(names[1], IntegerType())
    return src.mapInArrow(kernel, out)


def held_out(id_col: str = "doc_id", mod: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: (id, held_out, score, predicted).

    labels: (id, toxic 0/1).  Rows whose crc32(id as text) mod 3 is 1 are held out of the fit;
    labels, ids and other columns never enter a score.  Null or empty texts get the bias's score;
    null ids are not held out and are not in the sample; repeated rows are scored alike.
    """
    docs = bound_batches(docs).select(F.col(id_col).alias(id_col), F.col("text").alias("text")).withColumn("held_out", held_out(id_col))
    train = docs.filter("not held_out").select(F.col(id_col).alias("id"), "text")
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").alias("toxic")).filter("toxic in (0, 1)").filter(~held_out("id"))
    return score(docs, fit(train, known), [id_col, "held_out"])
