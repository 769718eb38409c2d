"""Sequence kernels: affine-gap alignment and local assembly on k-mer graphs, run per window in Arrow batches."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join

# Probabilities of a mismatch, of opening a gap and of ending one.
MISMATCH, OPEN, CLOSE = math.exp(-4), math.exp(-6), 1 - math.exp(-1)


def align(seq: str, ref: str, mismatch: float = MISMATCH, open_: float = OPEN, close: float = CLOSE) -> tuple[float, int, str]:
    """(cost, start in the reference, CIGAR of =XID) of the cheapest alignment of all of seq to a part of ref.

    Costs are -ln of probabilities. The table is filled from the end, so gaps come as far left as
    they can; ends of the reference are free.  Of equal choices insertion, then deletion, then
    (mis)match holds, and of equal starts the first.
    """
    n, m = len(seq), len(ref)
    c_open, c_close, c_more, c_none, c_x = -math.log(open_), -math.log(close), -math.log(1 - close), -math.log(1 - open_), -math.log(mismatch)
    # state of the cell that a step leads to: what the step into the next cell was
    cost = [0.0] * (m + 1)
    state = [""] * (m + 1)
    back: list[list[str]] = [[""] * (m + 1)]
    for i in range(n - 1, -1, -1):
        new, new_state, row = [0.0] * (m + 1), [""] * (m + 1), [""] * (m + 1)
        for j in range(m, -1, -1):
            best = None
            options = [("I", cost[j], state[j])]
            if j < m:
                options.append(("D", new[j + 1], new_state[j + 1]))
                options.append(("=" if seq[i] == ref[j] else "X", cost[j + 1], state[j + 1]))
            for step, so_far, after in options:
                gap = step in "ID"
                value = so_far
                if gap and after == step:
                    value += c_more
                else:
                    value += c_none
                    if gap:
                        value += c_open
                    if after in ("I", "D"):
                        value += c_close
                if step == "X":
                    value += c_x
                if i == 0 and gap:
                    value += c_close
                if best is None or value < best[0]:
                    best = (value, step)
            new[j], new_state[j] = best
            row[j] = best[1]
        cost, state = new, new_state
        back.append(row)
    if n == 0:
        return 0.0, 0, ""
    start = min(range(m + 1), key=lambda j: cost[j])
    ops, i, j = [], 0, start
    while i < n:
        step = back[n - i][j]
        ops.append(step)
        i += step != "D"
        j += step != "I"
    return cost[start], start, run_lengths(ops)


def run_lengths(ops: list[str]) -> str:
    out, last, n = [], None, 0
    for op in [*ops, None]:
        if op != last:
            if last is not None:
                out.append(f"{n}{last}")
            last, n = op, 0
        n += 1
    return "".join(out)


def align_table(rows: DataFrame) -> DataFrame:
    """(id, sequence, reference) -> (id, cost, start, cigar)."""
    def kernel(frames):
        for pdf in frames:
            found = [align(s, r) for s, r in zip(pdf["sequence"], pdf["reference"])]
            yield pd.DataFrame({"id": pdf["id"], "cost": [round(f[0], 6) for f in found], "start": [f[1] for f in found], "cigar": [f[2] for f in found]})

    return rows.select("id", "sequence", "reference").mapInPandas(kernel, "id long, cost double, start int, cigar string")


class KmerGraph:
    """K-mers with counts; followers overlap by k - 1 bases."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.by_prefix: dict[str, list[str]] = defaultdict(list)
        self.by_suffix: dict[str, list[str]] = defaultdict(list)
        for k in sorted(counts):
            self.by_prefix[k[:-1]].append(k)
            self.by_suffix[k[1:]].append(k)

    @classmethod
    def from_reads(cls, reads: list[tuple[str, float]], k: int, min_occurrence: int = 1, min_mean_quality: float = 0) -> KmerGraph:
        counts = Counter(s[i : i + k] for s, q in reads if q > min_mean_quality for i in range(max(1, len(s) - k + 1)) if s)
        return cls({x: n for x, n in counts.items() if n >= min_occurrence})

    def children(self, kmer: str) -> list[str]:
        return self.by_prefix.get(kmer[1:], [])

    def parents(self, kmer: str) -> list[str]:
        return self.by_suffix.get(kmer[:-1], [])

    def sources(self) -> list[str]:
        return [k for k in sorted(self.counts) if not self.parents(k)]

    def sinks(self) -> list[str]:
        return [k for k in sorted(self.counts) if not self.children(k)]

    def unitigs(self) -> list[str]:
        """Sequences of maximal unbranched paths."""
        out, used = [], set()
        begins = [k for k in sorted(self.counts) if len(self.parents(k)) != 1 or len(self.children(self.parents(k)[0])) != 1]
        for k in [*begins, *sorted(self.counts)]:
            if k in used:
                continue
            seq, at = k, k
            used.add(k)
            while len(self.children(at)) == 1:
                nxt = self.children(at)[0]
                if nxt in used or len(self.parents(nxt)) != 1:
                    break
                seq, at = seq + nxt[-1], nxt
                used.add(nxt)
            out.append(seq)
        return out

    def paths(self, source: str, sink: str, max_paths: int = 10, min_length: int = 1, max_length: int = 10_000) -> list[str]:
        """Sequences of simple paths from source to sink in depth-first order, of so many k-mers."""
        if source not in self.counts or sink not in self.counts:
            return []
        found, path, on, todo = [], [source], {source}, [iter(self.children(source))]
        if source == sink and min_length <= 1:
            found.append(source)
        while todo and len(found) < max_paths:
            nxt = next(todo[-1], None)
            if nxt is None:
                todo.pop()
                on.discard(path.pop())
            elif nxt not in on and len(path) < max_length:
                path.append(nxt)
                on.add(nxt)
                if nxt == sink:
                    if len(path) >= min_length:
                        found.append(merge_overlapping(path, len(nxt) - 1))
                    todo.append(iter(()))
                else:
                    todo.append(iter(self.children(nxt)))
        return found


def merge_overlapping(seqs: list[str], overlap: int) -> str:
    return seqs[0] + "".join(s[overlap:] for s in seqs[1:])


def haplotypes(reads: list[tuple[str, float]], reference: str, k: int, min_occurrence: int = 3, min_mean_quality: float = 0, expected: int = 2, max_paths: int = 16) -> list[str]:
    """Assembled sequences between the reference's first and last k bases: all of up to `expected`, of up to max_paths the
    `expected` cheapest for the reads, of more none."""
    if len(reference) < k:
        raise ValueError("the window must be at least as long as a k-mer")
    graph = KmerGraph.from_reads(reads, k, min_occurrence, min_mean_quality)
    found = graph.paths(reference[:k], reference[-k:], max_paths + 1, max_length=2 * len(reference))
    if len(found) > max_paths:
        return []
    if len(found) <= expected:
        return found
    times = Counter(s for s, _ in reads)
    cost = {h: sum(n * int(align(s, h)[0]) for s, n in times.items()) for h in found}
    return sorted(found, key=lambda h: (cost[h], h))[:expected]


def path_variants(path: str, reference: str) -> list[tuple[int, str, str]]:
    """(offset, ref, alt) of a path against its reference window; insertions and deletions carry the base before them."""
    _, start, cigar = align(path, reference)
    out, i, j = [], 0, start
    import re

    for n, op in re.findall(r"(\d+)([=XID])", cigar):
        n = int(n)
        if op == "X":
            out += [(j + x, reference[j + x], path[i + x]) for x in range(n)]
        elif op == "I" and 0 < i and i + n < len(path) and j > 0:
            out.append((j - 1, reference[j - 1], path[i - 1 : i + n]))
        elif op == "D" and 0 < i and j > 0:
            out.append((j - 1, reference[j - 1 : j + n], path[i - 1]))
        i += n if op != "D" else 0
        j += n if op != "I" else 0
    return out


def assemble_windows(reads: DataFrame, windows: DataFrame, k: int, min_occurrence: int = 3, read_length: int | None = None, max_reads: int = 100_000) -> DataFrame:
    """Variants of local assemblies: windows (contig, start, reference) and reads (contig, start, sequence, base_qualities).

    (contig, start, ref, alt, n_haplotypes).  A window's reads are grouped in one task; windows of more than
    max_reads reads are an error rather than a cut.
    """
    spans = windows.select("contig", "start", (F.col("start") + F.length("reference")).alias("end"), "reference")
    length = F.length("sequence") if read_length is None else F.lit(read_length)
    mean = F.aggregate("base_qualities", F.lit(0.0), lambda a, q: a + q) / F.size("base_qualities")
    placed = reads.select("contig", "start", (F.col("start") + length).alias("end"), "sequence", mean.alias("quality"))
    pairs = overlap_join(placed, spans).select("contig", F.col("r_start").alias("window"), F.col("r_reference").alias("reference"), "sequence", "quality")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_reads:
            raise ValueError(f"{len(pdf)} reads in one window")
        reference = pdf["reference"].iloc[0]
        found = haplotypes(sorted(zip(pdf["sequence"], pdf["quality"])), reference, k, min_occurrence)
        rows = sorted({v for h in found for v in path_variants(h, reference)})
        return pd.DataFrame([(pdf["contig"].iloc[0], int(pdf["window"].iloc[0]) + o, r, a, len(found)) for o, r, a in rows], columns=["contig", "start", "ref", "alt", "n_haplotypes"])

    return pairs.groupBy("contig", "window").applyInPandas(kernel, "contig string, start long, ref string, alt string, n_haplotypes int")
