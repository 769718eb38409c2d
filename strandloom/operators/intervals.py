"""Operators over genomic intervals: half-open, 0-based (contig, start, end).

Overlaps become equi-joins by cutting the line into bins of fixed width; every pair is emitted
in one bin only, the one that holds the start of its overlap, so no distinct is needed.
Sweeps run within bins, so a contig is never one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Positions in a bin: a few read lengths, so that most reads fall in one or two.
BIN = 1 << 12
#: Loci sets of no more rows than this (24 bytes each) are broadcast, larger ones are shuffled by bin.
BROADCAST_ROWS = 200_000


def bins(start: Column, end: Column, width: int = BIN) -> Column:
    """Bins that an interval touches; an empty interval touches none."""
    first, last = F.floor(start / width), F.floor((end - 1) / width)
    return F.when(start < end, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows, by looking at one more."""
    return df.limit(rows + 1).count() <= rows


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", width: int = BIN, broadcast: bool = False) -> DataFrame:
    """Pairs of rows of one contig whose intervals overlap; columns of `right` are prefixed with r_.

    how is inner, or semi for the rows of `left` with at least one partner (needs disjoint or
    any intervals on the right; each left row comes once).
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("__bin", F.explode(bins(F.col("r_start"), F.col("r_end"), width)))
    if broadcast:
        r = F.broadcast(r)
    if how == "semi":
        if broadcast:
            return _broadcast_semi(left, right, width)
        keyed = left.withColumn("__row", F.monotonically_increasing_id())
        pairs = overlap_join(keyed, right, "inner", width)
        return pairs.select(*left.columns, "__row").dropDuplicates(["__row"]).drop("__row")
    l = left.withColumn("__bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    return l.join(
        r,
        (l["contig"] == r["r_contig"]) & (l["__bin"] == r["__bin"]) & (l["start"] < r["r_end"]) & (l["end"] > r["r_start"])
        & (F.floor(F.greatest(l["start"], r["r_start"]) / width) == l["__bin"]),
    ).drop("__bin")


#: Widths of the levels of bins that a broadcast semi join looks up, in bins: reads, long regions, contigs.
LEVELS = (1, 1 << 8, 1 << 24)


def _broadcast_semi(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """The rows of `left` that overlap a row of the small table `right`, in one pass without a shuffle.

    A left row is looked up once, by the bin of its start on the first level whose bins are as wide as
    it is long; so a right row stands in its own bins and the one before, on each level.
    """
    spots = right.select(F.col("contig").alias("r_contig"), F.col("start").alias("r_start"), F.col("end").alias("r_end")).filter("r_start < r_end")
    def places(level: int) -> Column:
        wide = LEVELS[level] * width
        return F.transform(F.sequence(F.floor(F.col("r_start") / wide) - 1, F.floor((F.col("r_end") - 1) / wide)), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))

    each = F.explode(F.concat(*map(places, range(len(LEVELS))))).alias("r_at")
    at = spots.select("*", each)
    overlap = (F.col("contig") == F.col("r_contig")) & (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    if not small(at, 4 * BROADCAST_ROWS):  # few loci of great length: whole contigs
        return left.join(F.broadcast(spots), overlap, "left_semi")
    span, first = F.col("end") - F.col("start"), F.col("start")
    level, bin_ = F.lit(len(LEVELS) - 1), F.floor(first / (LEVELS[-1] * width))
    for i in reversed(range(len(LEVELS) - 1)):
        fits = span <= LEVELS[i] * width
        level, bin_ = F.when(fits, i).otherwise(level), F.when(fits, F.floor(first / (LEVELS[i] * width))).otherwise(bin_)
    return left.join(F.broadcast(at), overlap & (F.col("r_at.level") == level) & (F.col("r_at.bin") == bin_), "left_semi")


def overlapping(regions: DataFrame, loci: DataFrame) -> DataFrame:
    """Regions that overlap any locus (a semi join)."""
    return overlap_join(regions, loci.select("contig", "start", "end"), "semi", broadcast=small(loci))


def merge_intervals(loci: DataFrame, keep_touching: bool = True) -> DataFrame:
    """Disjoint union of intervals; touching ones become one. Empty intervals go.

    Merged within bins first, so that the pass over a contig sees few rows.
    """
    def merged(df, part):
        w = W.partitionBy(*part).orderBy("start", "end")
        high = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
        gap = F.col("start") > high if keep_touching else F.col("start") >= high
        marked = df.withColumn("__new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(w))
        return marked.groupBy(*part, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")

    wide = BIN * 64
    first = merged(loci.filter("start < end").select("contig", "start", "end", F.floor(F.col("start") / wide).alias("__bin")), ["contig", "__bin"]).drop("__bin")
    return merged(first, ["contig"]).select("contig", "start", "end")


def shift_loci(loci: DataFrame, by: int = 1) -> DataFrame:
    """Loci moved towards the contig's start; what falls before it goes."""
    return loci.select("contig", F.greatest(F.col("start") - by, F.lit(0)).alias("start"), (F.col("end") - by).alias("end")).filter("start < end")


def contig_lengths(regions: DataFrame) -> DataFrame:
    return regions.groupBy("contig").agg(F.max("end").alias("length"))


def coverage(regions: DataFrame, half_window: int = 0, loci: DataFrame | None = None, width: int = BIN, row_id: str = "rid") -> DataFrame:
    """(contig, locus, depth, starts) of covered positions, by a sweep within bins.

    Regions widen by half_window on both sides, not below 0, and count only within loci; `starts`
    counts a region at the first position where it counts.
    """
    wide = regions.select(*([row_id] if loci is not None else []), "contig", F.greatest(F.col("start") - half_window, F.lit(0).cast("long")).alias("start"), (F.col("end") + half_window).alias("end")).filter("start < end")
    if loci is None:
        pieces = wide.withColumn("first", F.col("start"))
    else:
        joined = overlap_join(wide, loci.select("contig", "start", "end"), broadcast=small(loci))
        cut = joined.select(row_id, "contig", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
        pieces = cut.withColumn("first", F.min("start").over(W.partitionBy(row_id)))
    binned = pieces.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    low, high = F.greatest("start", F.col("bin") * width), F.least("end", (F.col("bin") + 1) * width)
    steps = binned.select("contig", "bin", F.explode(F.array(
        F.struct(low.alias("pos"), F.lit(1).cast("long").alias("d"), (low == F.col("first")).cast("long").alias("st")),
        F.struct(high.alias("pos"), F.lit(-1).cast("long").alias("d"), F.lit(0).cast("long").alias("st")),
    )).alias("e")).select("contig", "bin", "e.*")
    at = steps.groupBy("contig", "bin", "pos").agg(F.sum("d").alias("d"), F.sum("st").alias("st"))
    w = W.partitionBy("contig", "bin").orderBy("pos")
    runs = at.withColumn("depth", F.sum("d").over(w)).withColumn("next", F.lead("pos").over(w)).filter("depth > 0")
    return runs.select("contig", F.explode(F.sequence("pos", F.col("next") - 1)).alias("locus"), "depth", "pos", "st").select("contig", "locus", "depth", F.when(F.col("locus") == F.col("pos"), F.col("st")).otherwise(0).alias("starts"))


def coverage_exploded(regions: DataFrame, half_window: int = 0) -> DataFrame:
    """Coverage with a row for each region and position: the plain form, for comparison."""
    low = F.greatest(F.col("start") - half_window, F.lit(0).cast("long"))
    wide = regions.select("contig", low.alias("first"), F.explode(F.sequence(low, F.col("end") + half_window - 1)).alias("locus"))
    return wide.groupBy("contig", "locus").agg(F.count(F.lit(1)).alias("depth"), F.sum((F.col("locus") == F.col("first")).cast("long")).alias("starts"))


def depth_runs(cov: DataFrame, cutoff: int, width: int = BIN * 16) -> DataFrame:
    """Run lengths over the sorted covered positions of each contig: (contig, run, start, end, loci, valid), valid: depth <= cutoff.

    Runs are found within bins and then joined across bins; uncovered positions do not end a run.
    """
    bin_ = F.floor(F.col("locus") / width)
    rows = cov.select("contig", "locus", (F.col("depth") <= cutoff).alias("valid"), bin_.alias("bin"))
    w = W.partitionBy("contig", "bin").orderBy("locus")
    island = F.row_number().over(w) - F.row_number().over(W.partitionBy("contig", "bin", "valid").orderBy("locus"))
    parts = rows.withColumn("island", island).groupBy("contig", "bin", "valid", "island").agg(F.min("locus").alias("start"), F.max("locus").alias("last"), F.count(F.lit(1)).alias("loci"))
    v = W.partitionBy("contig").orderBy("start")
    turn = (F.col("valid") != F.coalesce(F.lag("valid").over(v), ~F.col("valid"))).cast("long")
    return (
        parts.withColumn("turn", turn).withColumn("run", F.sum("turn").over(v))
        .groupBy("contig", "run", "valid").agg(F.min("start").alias("start"), (F.max("last") + 1).alias("end"), F.sum("loci").alias("loci"))
        .select("contig", "run", "start", "end", "loci", "valid")
    )


def valid_loci_counts(cov: DataFrame, cutoff: int) -> DataFrame:
    return cov.groupBy((F.col("depth") <= cutoff).alias("valid")).agg(F.count(F.lit(1)).alias("loci"))


def window_regions(regions: DataFrame, loci: DataFrame, half_window: int, keep_empty: bool = False) -> DataFrame:
    """Each locus (contig, locus) with the regions within half_window of it: start <= locus + hw and end > locus - hw.

    With keep_empty, a locus without regions is one row whose region is null.
    """
    around = loci.select("contig", F.col("locus"), (F.col("locus") - half_window).alias("start"), (F.col("locus") + half_window + 1).alias("end"))
    found = overlap_join(regions, around).withColumn("locus", F.col("r_locus")).drop("r_contig", "r_start", "r_end", "r_locus")
    if not keep_empty:
        return found
    bare = loci.select("contig", "locus").distinct().join(found.select("contig", "locus"), ["contig", "locus"], "left_anti")
    return found.unionByName(bare, allowMissingColumns=True)


#: Positions of a contig that share one state in `window_fold`.
FOLD = 1 << 16


def window_fold(windows: DataFrame, initial, step: Callable[[object, dict], tuple[object, Iterable[tuple]]], schema: str, span: int = FOLD) -> DataFrame:
    """Rows of `step`, which is called with the state and each row of `windows` in order of locus.

    step(state, row) gives the next state and any number of rows of `schema`.  A state lives for `span`
    positions of a contig and begins as `initial`, so no task holds more and results depend neither on
    the layout of the data nor on the number of tasks.  windows: a row for each (contig, locus), such as
    coverage or window_regions aggregated by locus; with more rows at one locus, they come in the order of their columns.
    """
    order = ["locus", *(c for c in windows.columns if c not in ("contig", "locus") and not isinstance(windows.schema[c].dataType, (ArrayType, MapType)))]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = initial, []
        for row in pdf.sort_values(order, kind="stable").drop(columns="__span").to_dict("records"):
            state, rows = step(state, row)
            out += rows
        return pd.DataFrame(out, columns=names)

    names = [f.name for f in StructType.fromDDL(schema)]
    return windows.withColumn("__span", F.floor(F.col("locus") / span)).groupBy("contig", "__span").applyInPandas(fold, schema)


class CoverageCache:
    """Coverage of one table of regions, computed once for each pair of half window and loci."""

    def __init__(self, regions: DataFrame):
        self.regions, self._kept = regions, {}

    def __call__(self, half_window: int = 0, loci: DataFrame | None = None) -> DataFrame:
        key = (half_window, None if loci is None else loci.semanticHash())
        for seen, cov in self._kept.get(key, []):  # equal hashes are no proof
            if loci is None or loci.sameSemantics(seen):
                return cov
        cov = coverage(self.regions, half_window, loci).persist()
        self._kept.setdefault(key, []).append((loci, cov))
        return cov

    def release(self) -> None:
        for kept in self._kept.values():
            for _, cov in kept:
                cov.unpersist()
        self._kept.clear()


def union_samples(*tables: DataFrame) -> DataFrame:
    """Bag union of samples, numbered in turn."""
    return reduce(DataFrame.unionByName, [t.withColumn("sample_id", F.lit(i)) for i, t in enumerate(tables)])


def depth_report(cov: DataFrame, cutoff: int, most: int = 1000) -> str:
    """Text summary of depth runs: totals, and the first `most` runs of each contig order."""
    totals = {r["valid"]: r["loci"] for r in valid_loci_counts(cov, cutoff).collect()}
    good, bad = totals.get(True, 0), totals.get(False, 0)
    lines = [f"{good} positions of depth {cutoff} or less, {bad} deeper ({100 * bad / max(1, good + bad):.2f} %)"]
    runs = depth_runs(cov, cutoff).orderBy("contig", "start").limit(most).collect()
    lines += [f"{r['contig']}:{r['start']}-{r['end']} {'kept' if r['valid'] else 'dropped'} {r['loci']}" for r in runs]
    return "\n".join(lines)
