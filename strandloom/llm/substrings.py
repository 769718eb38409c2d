"""Substring de-duplication with prefix-partitioned suffix trees over words.

A suffix begins at every anchor: a position whose PREFIX-word hash is the smallest of a window of
WINDOW words, so equal windows hold equal anchors and a twentieth of the positions is enough.
Suffixes are partitioned by their first PREFIX words.  A partition that fits in memory becomes a
subtree: its suffixes in lexicographic order with the lengths of common prefixes of
neighbours, whose intervals are the tree's internal nodes.  A node of depth WINDOW - o whose
suffixes also agree on the o words to the left is a repeat of WINDOW words or more; o from 0
up gives all windows around the anchor, and together they are the maximal repeats.  A
partition that does not fit is split by a longer prefix, of WINDOW words from each window's
start; there every part is one deep node, and its smallest document is a plain minimum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .bitmap import bitmap, inside, only, slot
from .spark import bound_batches, cut, hold
from .textops import U, Words, chunks, sliding_min, window_hashes

WINDOW, PREFIX = 50, 12
LEFT = WINDOW - PREFIX
#: Suffixes of one partition that are held in memory; and the rows sorted together.
PARTITION_ROWS, SORT_ROWS = 20_000, 20_000


def anchor_positions(g: np.ndarray) -> np.ndarray:
    """Positions of prefix hashes that are the smallest of a window (all of them, if equal)."""
    span = LEFT + 1
    if len(g) < span:
        return np.zeros(0, dtype=np.int64)
    low = sliding_min(g, span)
    # position p is an anchor if a window that holds it has this minimum: the largest of their minima
    pad = np.zeros(LEFT, dtype=U)
    high = ~sliding_min(~np.concatenate([pad, low, pad]), span)
    return np.flatnonzero(high == g)


def _anchors(batches):
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(1)):
            w = Words(data, offs)
            h = w.hashes()
            g = window_hashes(h, PREFIX)
            whole, other, hashes, places, n = [], [], [], [], np.diff(w.doc)
            for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist()):
                own = h[a:b]
                whole.append(int(window_hashes(own, b - a)[0].view(np.int64)) if b > a else 0)
                other.append(int(window_hashes(own, b - a, salt=99)[0].view(np.int64)) if b > a else 0)
                at = anchor_positions(g[a : b - PREFIX + 1]) if b - a >= WINDOW else np.zeros(0, np.int64)
                hashes.append(g[a:b][at].tobytes() if len(at) else b"")
                places.append(at.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(whole, type=pa.int64()), pa.array(other, type=pa.int64()), pa.array(hashes, type=pa.binary()), pa.array(places, type=pa.binary())],
                names=["id", "n", "ca", "cb", "hashes", "places"],
            )


def _anchor_rows(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        hashes = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        places = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in hashes])), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], names=["id", "prefix", "place"])


def _contexts(batches):
    """Rows of (prefix, id, place, words known left and right, word codes); for large partitions (window hashes, id, start)."""
    for batch in batches:
        ids, found, sums = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi, data, offs in chunks(batch.column(1)):
            w = Words(data, offs)
            h = w.hashes()
            codes = (h >> U(32)).astype("<u4")
            out = {k: [] for k in ("prefix", "other", "id", "place", "left", "right", "codes")}
            for i, (a, b) in enumerate(zip(w.doc[:-1].tolist(), w.doc[1:].tolist())):
                if b == a or int(window_hashes(h[a:b], b - a)[0].view(np.int64)) != sums[lo + i]:
                    continue  # another text under the same id
                padded = np.concatenate([np.zeros(LEFT, "<u4"), codes[a:b], np.zeros(WINDOW, "<u4")])
                first = second = None
                windows = set()
                for hit in found[lo + i]:
                    p = hit["place"]
                    if not hit["large"]:
                        out["prefix"].append(hit["prefix"])
                        out["other"].append(0)
                        out["id"].append(ids[lo + i])
                        out["place"].append(p)
                        out["left"].append(min(p, LEFT))
                        out["right"].append(min(b - a - p, WINDOW))
                        out["codes"].append(padded[p : p + LEFT + WINDOW].tobytes())
                    else:
                        windows.update(range(max(0, p - LEFT), min(p, b - a - WINDOW) + 1))
                if windows:
                    first, second = window_hashes(h[a:b], WINDOW).view(np.int64), window_hashes(h[a:b], WINDOW, salt=7).view(np.int64)
                    for s in sorted(windows):
                        out["prefix"].append(int(first[s]))
                        out["other"].append(int(second[s]))
                        out["id"].append(ids[lo + i])
                        out["place"].append(s)
                        out["left"].append(0)
                        out["right"].append(0)
                        out["codes"].append(None)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(out[k], type=t) for k, t in zip(out, kinds)], names=list(out))


def repeated_windows(prefix, ids, place, left, right, codes) -> np.ndarray:
    """For each suffix, bit o is set if the window that begins o words before it also starts in a text of smaller id.

    All suffixes with one prefix value are one subtree; several are handled together.
    """
    n = len(ids)
    group = np.unique(prefix, return_inverse=True)[1]
    after = codes[:, LEFT:]
    order = np.lexsort([*after.T[::-1], group])
    group, ids, left, right, codes = group[order], ids[order], left[order], right[order], codes[order]
    after, before = codes[:, LEFT:], codes[:, :LEFT]
    # common prefix of neighbours in the order: an interval of values >= r is an internal node of depth r
    same = after[1:] == after[:-1]
    lcp = np.where(same.all(axis=1), WINDOW, np.argmin(same, axis=1))
    lcp[group[1:] != group[:-1]] = 0
    mask = np.zeros(n, dtype=np.int64)
    said = np.zeros(n, dtype=U)
    for o in range(LEFT + 1):
        if o:
            said = (said ^ before[:, LEFT - o].astype(U)) * U(0x9E3779B97F4A7C15)
            said ^= said >> U(29)
        depth = WINDOW - o
        node = np.concatenate([[0], np.cumsum(lcp < depth)])
        fits = np.flatnonzero((left >= o) & (right >= depth))
        if len(fits) < 2:
            continue
        by = fits[np.lexsort([ids[fits], said[fits], node[fits]])]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (node[by][1:] != node[by][:-1]) | (said[by][1:] != said[by][:-1])
        low = ids[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        mask[by[ids[by] > low]] |= np.int64(1) << np.int64(o)
    out = np.zeros(n, dtype=np.int64)
    out[order] = mask
    return out


def _subtrees(batches):
    """Suffixes sorted by prefix -> (id, place, mask) of those with a repeat; whole partitions are gathered up to SORT_ROWS rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def work(table: pa.Table):
        cols = {k: table.column(k).to_numpy() for k in ("prefix", "id", "place", "left", "right")}
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype="<u4").reshape(table.num_rows, LEFT + WINDOW)
        mask = repeated_windows(cols["prefix"], cols["id"], cols["place"], cols["left"], cols["right"], codes)
        at = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(cols["id"][at]), pa.array(cols["place"][at].astype(np.int32)), pa.array(mask[at])], names=["id", "place", "mask"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= SORT_ROWS:
            table = pa.Table.from_batches(held)
            keys = table.column("prefix").to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1])
            if len(edges):
                end = int(edges[-1]) + 1
                yield work(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
                rows = table.num_rows - end
    if rows:
        yield work(pa.Table.from_batches(held))


def _removal(keep_cols: int, known: bool, added: tuple, bits=None):
    """Words, removed words and kept text of each row; `known` rows carry whether they are a copy and their repeats.

    Rows that are not `known` carry their slot last; those that the bitmap has are left out.
    """
    def kernel(batches):
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(~inside(batch.column(batch.num_columns - 1), bits.value)))
            copies = batch.column(1).to_pylist() if known else None
            hits = batch.column(2).to_pylist() if known else None
            base = 3 if known else 1
            for lo, hi, data, offs in chunks(batch.column(0)):
                raw, n, gone, kept = data.tobytes(), [], [], []
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    words = raw[a:b].split()
                    m = len(words)
                    removed = 0
                    if known and copies[lo + i] and m >= WINDOW:
                        words, removed = [], m
                    elif known and hits[lo + i]:
                        edge = np.zeros(m + WINDOW + 1, dtype=np.int64)
                        for hit in hits[lo + i]:
                            x, p = hit["mask"], hit["place"]
                            while x:
                                o = (x & -x).bit_length() - 1
                                edge[p - o] += 1
                                edge[p - o + WINDOW] -= 1
                                x &= x - 1
                        stay = np.cumsum(edge[:m]) == 0
                        removed = int(m - stay.sum())
                        words = [words[j] for j in np.flatnonzero(stay)]
                    n.append(m)
                    gone.append(removed)
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[base : base + keep_cols], pa.array(n, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.string())],
                    names=[*batch.schema.names[base : base + keep_cols], *added],
                )

    return kernel


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, added: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """One row per input row: the columns `keep` (default: the id), n_words, n_removed and kept_text, or as `added` names them.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word goes if a window of WINDOW words covers it
    whose words also start in a row with a smaller id; windows are judged on the input.
    kept_text is the rest, joined by one space.  Null or empty texts have no words; a null id
    neither loses words nor makes others lose them; rows with equal ids do not affect one another;
    an empty table gives an empty table; columns that are not kept are ignored.

    Word equality rests on 64-bit hashes in prefixes and on 32 bits a word beyond them.
    """
    keep = [id_col] if keep is None else keep
    docs = bound_batches(docs)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    seen = hold(src.mapInArrow(_anchors, "id long, n long, ca long, cb long, hashes binary, places binary").filter(f"n >= {WINDOW}"))
    # equal texts: the smallest id stands for all, the others are removed whole
    classes = seen.groupBy("ca", "cb").agg(F.min("id").alias("id"), F.min_by("hashes", "id").alias("hashes"), F.min_by("places", "id").alias("places"), F.count_distinct("id").alias("m"))
    classes = cut(classes)
    anchors = classes.select("id", "hashes", "places").mapInArrow(_anchor_rows, "id long, prefix long, place int")
    shared = anchors.groupBy("prefix").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("m")).filter("low < high").select("prefix", (F.col("m") > PARTITION_ROWS).alias("large"))
    shared = cut(shared)  # a table of its own, so that both sides of the join are shuffled and a frequent prefix can be split
    hits = cut(anchors.join(shared, "prefix").groupBy("id").agg(F.collect_list(F.struct("prefix", "place", "large")).alias("found")))
    hits = hits.join(classes.select("id", "ca").dropDuplicates(["id"]), "id")
    maybe = only(src, "id", bitmap(hits, "id"))
    contexts = hold(maybe.join(hits.hint("shuffle_hash"), "id").select("id", "text", "found", "ca").mapInArrow(_contexts, "prefix long, other long, id long, place int, left int, right int, codes binary"))
    small = contexts.filter("codes is not null").repartition("prefix").sortWithinPartitions("prefix")
    found = small.select("prefix", "id", "place", "left", "right", "codes").mapInArrow(_subtrees, "id long, place int, mask long")
    long = contexts.filter("codes is null").select("prefix", "other", "id", "place")
    lowest = cut(long.groupBy("prefix", "other").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("prefix", "other", "low"))
    deep = long.join(lowest, ["prefix", "other"]).filter("id > low").select("id", "place", F.lit(1).cast("long").alias("mask"))
    repeats = found.unionByName(deep).groupBy("id").agg(F.collect_list(F.struct("place", "mask")).alias("hits"))
    copies = seen.join(classes.filter("m > 1").select("ca", "cb", F.col("id").alias("first")), ["ca", "cb"]).filter("id > first").select("id", "ca").distinct()
    repeats = repeats.join(classes.select("id", "ca").dropDuplicates(["id"]), "id")
    marks = cut(
        copies.select("id", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<place:int,mask:long>>").alias("hits"))
        .unionByName(repeats.select("id", F.lit(False).alias("copy"), "hits"))
        .groupBy("id").agg(F.max("copy").alias("copy"), F.first("hits", ignorenulls=True).alias("hits"))
    )
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *(F.col(c) for c in keep))
    bits = bitmap(marks, "id")
    hit, shared_bits = only(rows, "__id", bits), docs.sparkSession.sparkContext.broadcast(bits)
    out = StructType([rows.schema[c] for c in keep]).add(added[0], LongType()).add(added[1], LongType()).add(added[2], StringType())
    changed = hit.join(marks.withColumnsRenamed({"id": "__mark", "copy": "__gone", "hits": "__hits"}).hint("shuffle_hash"), F.col("__id") == F.col("__mark"), "left")
    one = changed.select("__text", F.coalesce("__gone", F.lit(False)).alias("__copy"), "__hits", *keep).mapInArrow(_removal(len(keep), True, added), out)
    two = rows.select("__text", *keep, slot("__id").alias("__slot")).mapInArrow(_removal(len(keep), False, added, shared_bits), out)
    return one.unionByName(two)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of `remove_repeats`."""
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
