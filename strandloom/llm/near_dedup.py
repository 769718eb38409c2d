"""Near-duplicate components by circulant MinHash.

One permutation sigma spreads the shingles over 32-bit positions; the second, pi, is applied
at K circular shifts: coordinate k of a signature is min over shingles of
pi((sigma(x) + k) mod 2**32).  Bands of four coordinates give buckets; every link that decides
a component is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .spark import bound_batches, cut, hold
from .textops import U, binary_column, chunks, list_column, mix32, mix64, scalar_mix, shingle_sets

ROWS = 4
SIGMA = U(scalar_mix(0x516D61))


def bands_for(threshold: float, miss: float = 1e-7) -> int:
    """Bands of ROWS coordinates that leave a pair at the threshold unfound with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))


def circulant_signature(flat: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Signatures (k x sets) of the non-empty sets that begin at `first` in `flat`."""
    at = (mix64(flat ^ SIGMA) >> U(32)).astype(np.uint32)
    out = np.empty((k, len(first)), dtype=np.uint32)
    for j in range(k):
        out[j] = np.minimum.reduceat(mix32(at + np.uint32(j)), first)
    return out


def _signatures(bands: int, shingle: int):
    k = bands * ROWS

    def kernel(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in chunks(batch.column(1)):
                sets = shingle_sets(data, offs, shingle)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((len(sets), bands), dtype=U)
                own = np.zeros((len(sets), 2), dtype=U)
                if len(full):
                    flat = np.concatenate(sets)
                    first = (np.cumsum(n) - n)[full]
                    sig = circulant_signature(flat, first, k)
                    for b in range(bands):
                        x = np.full(len(full), scalar_mix(b + 1), dtype=U)
                        for r in range(ROWS):
                            x = mix64(x ^ sig[b * ROWS + r].astype(U))
                        keys[full, b] = x
                    own[full, 0] = np.add.reduceat(mix64(flat + U(0x2545F491)), first)
                    own[full, 1] = np.bitwise_xor.reduceat(mix64(flat + U(0x6C078965)), first)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n), *(pa.array(own[:, j].copy().view(np.int64)) for j in (0, 1)), list_column(keys.ravel().view(np.int64), bands, pa.int64())],
                    names=["id", "n", "ca", "cb", "bands"],
                )

    return kernel


def _sets(shingle: int):
    def kernel(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), binary_column([s.tobytes() for s in shingle_sets(data, offs, shingle)])],
                    names=["id", "shingles"],
                )

    return kernel


def _confirmed(num: int, den: int):
    def kernel(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            sa, sb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x = np.frombuffer(sa[i].as_buffer(), dtype=U)
                y = np.frombuffer(sb[i].as_buffer(), dtype=U)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if den * len(small) < num * len(large):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = den * inter >= num * (len(x) + len(y) - inter)
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["a", "b"])

    return kernel


def _spread(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), batch.column(0)[i].as_py(), dtype=np.int64)), pa.array(x)], names=["rep", "shingle"])


#: 64-bit words of a parity bitmap.
PARITY = 32


def _parity(batches):
    """Parity bitmaps: every shingle flips one bit, so two bitmaps differ in no more bits than their sets in shingles."""
    names = ["rep", *(f"p{i}" for i in range(PARITY))]
    for batch in batches:
        rows = np.zeros((batch.num_rows, PARITY), dtype=U)
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=U)
            at = (mix64(x + U(0x7F4A7C15)) & U(64 * PARITY - 1)).astype(np.int64)
            rows[i] = np.packbits((np.bincount(at, minlength=64 * PARITY) & 1).astype(np.uint8)).view(U)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i].copy().view(np.int64)) for i in range(PARITY))], names=names)


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-7
) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z folded; a set holds the distinct `shingle`-word
    shingles, or the whole sequence where there are fewer words.  Two texts are linked where
    100 * intersection >= percent * union; component_id is the smallest id reachable and
    kept is (id = component_id).

    Texts with equal sets are one class from the start, so copies are never paired.  Buckets
    link each class to the bucket's smallest (a star, not all pairs); confirmed links are
    contracted, and only members outside a bucket's main component are then compared with the
    bucket's other components, behind exact bounds: sizes, shingles that only one of them has,
    and parity bitmaps.
    So within buckets no link between different components is left out.

    Null or empty texts have no shingles, n_shingles 0, and stand alone; a null id gives a null
    component and kept false; equal ids are one vertex; an empty table gives an empty table; other
    columns of docs are ignored, whatever their names.
    """
    bands = bands_for(percent / 100, miss)
    docs = bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = hold(docs.mapInArrow(_signatures(bands, shingle), "id long, n long, ca long, cb long, bands array<long>"))
    reps = cut(
        sig.filter("n > 0 and id is not null").groupBy("ca", "cb")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    spread = reps.select("rep", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("star"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "star")
    members = cut(spread.join(shared, "key"))
    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = hold(docs.join(wanted.hint("shuffle_hash"), "id").mapInArrow(_sets(shingle), "id long, shingles binary").filter("length(shingles) > 0"))

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent, 100), "a long, b long").distinct())

    first = confirm(members.filter("rep <> star").select(F.col("rep").alias("a"), F.col("star").alias("b")).distinct())
    comp = connected_components(first)

    # what the stars left apart: members outside the main component of their bucket
    placed = members.select("key", "rep").join(comp.withColumnsRenamed({"u": "rep", "v": "comp"}), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("m", F.negative("comp"))).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key", "main")
    facts = reps.select("rep", "n", "bands")
    apart = cut(placed.join(mixed, "key").join(facts, "rep"))
    # shingles that no other of these classes has bound what a class can share: J(x, y) <= shared(x) / n(x)
    own = cut(apart.select(F.col("rep").alias("id")).distinct().join(sets.dropDuplicates(["id"]), "id"))
    lone = own.mapInArrow(_spread, "rep long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("rep")).filter("m = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))
    bitmaps = own.mapInArrow(_parity, ", ".join(["rep long", *(f"p{i} long" for i in range(PARITY))]))
    apart = cut(apart.join(bitmaps, "rep").join(lone, "rep", "left").withColumn("shared", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone").filter(f"100 * shared >= {percent} * n"))
    differ = " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(PARITY))
    x, y = apart.filter("comp <> main").alias("x"), apart.alias("y")
    pairs = (
        x.join(y, F.expr(
            "x.key = y.key and x.comp <> y.comp and (y.comp = y.main or y.rep > x.rep)"
            f" and 100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n"
            f" and 100 * least(x.shared, y.shared) >= {percent} * (x.n + y.n - least(x.shared, y.shared))"
            # sets that differ in d shingles or more share (x.n + y.n - d) / 2 at most
            f" and 100 * (x.n + y.n - ({differ})) >= {percent} * (x.n + y.n + ({differ}))"
            # of the buckets that two classes share, one pairs them
            " and x.key = array_min(array_intersect(x.bands, y.bands))"
        ))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    )
    second = confirm(pairs)
    if not second.isEmpty():
        comp = connected_components(first.unionByName(second))
    classes = reps.select("ca", "cb", "rep").join(comp.withColumnsRenamed({"u": "rep", "v": "comp"}), "rep", "left").select("ca", "cb", F.coalesce("comp", "rep").alias("comp"))
    classes = cut(classes)
    full = sig.filter("n > 0 and id is not null").select("id", "n", "ca", "cb").join(classes, ["ca", "cb"]).select("id", "n", "comp")
    alone = sig.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("comp"))
    both = full.unionByName(alone)
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(False)).alias("kept"))
