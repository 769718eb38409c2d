"""Partitioning of positions: uniform, by approximate region counts, and capped by depth."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import coverage, overlap_join, small

PARTITIONED = "contig string, start long, end long, partition int"


def uniform(loci: DataFrame, partitions: int) -> DataFrame:
    """Disjoint loci cut into runs of equal numbers of positions in (contig, start) order: (contig, start, end, partition).

    Boundary i is round(i * max(1, n / partitions)); with fewer positions there are fewer partitions.
    Cumulative counts go within contigs and over the contigs' sums, so no single task orders all loci.
    """
    sized = loci.filter("start < end").withColumn("n", F.col("end") - F.col("start"))
    by = sized.groupBy("contig").agg(F.sum("n").alias("m"))
    before = by.withColumn("before", F.sum("m").over(W.orderBy("contig")) - F.col("m")).withColumn("total", F.sum("m").over(W.partitionBy()))
    at = sized.join(F.broadcast(before) if small(before) else before, "contig").withColumn("c0", F.col("before") + F.sum("n").over(W.partitionBy("contig").orderBy("start")) - F.col("n"))
    step = F.greatest(F.lit(1.0), F.col("total") / F.lit(float(partitions)))
    edge = lambda i: F.floor(i * step + 0.5)
    k = F.col("k")
    cut = at.withColumn("k", F.explode(F.sequence(F.greatest(F.floor(F.col("c0") / step) - 1, F.lit(0)), F.floor((F.col("c0") + F.col("n")) / step) + 1)))
    low = F.greatest(F.col("c0"), edge(k))
    high = F.least(F.col("c0") + F.col("n"), F.when(k >= partitions - 1, F.col("total")).otherwise(edge(k + 1)))
    return cut.filter(k < partitions).filter(low < high).select(
        "contig", (F.col("start") + low - F.col("c0")).alias("start"), (F.col("start") + high - F.col("c0")).alias("end"), k.cast("int").alias("partition")
    )


def micro_counts(regions: DataFrame, micro: DataFrame) -> DataFrame:
    """(partition, regions): regions that overlap each micro-partition, each counted once in it."""
    pairs = overlap_join(regions.select("rid", "contig", "start", "end"), micro, broadcast=small(micro))
    return pairs.groupBy("r_partition").agg(F.count_distinct("rid").alias("regions")).select(F.col("r_partition").alias("partition"), "regions")


def micro_region(regions: DataFrame, loci: DataFrame, partitions: int, accuracy: int = 250) -> DataFrame:
    """Loci in partitions of about equal region counts.

    Uniform micro-partitions are counted in Spark; their number is bounded by partitions * accuracy,
    and the greedy assignment walks over them here.
    """
    micro = uniform(loci, partitions * accuracy)
    counts = {r["partition"]: r["regions"] for r in micro_counts(regions, micro).collect()}
    pieces = [tuple(r) for r in micro.orderBy("contig", "start").collect()]
    return loci.sparkSession.createDataFrame(assign_micro(pieces, counts, partitions), PARTITIONED)


def assign_micro(pieces: list[tuple], counts: dict[int, int], partitions: int) -> list[tuple]:
    groups: dict[int, list] = {}
    for contig, start, end, m in pieces:
        groups.setdefault(m, []).append([contig, start, end])
    per = max(1.0, sum(counts.get(m, 0) for m in groups) / partitions)
    out, part, assigned = [], 0, 0.0

    def take(spans: list, n: int) -> None:
        while n > 0:
            contig, start, end = spans[0]
            step = min(n, end - start)
            if out and out[-1][0] == contig and out[-1][2] == start and out[-1][3] == part:
                out[-1] = (contig, out[-1][1], start + step, part)
            else:
                out.append((contig, start, start + step, part))
            n -= step
            if step == end - start:
                spans.pop(0)
            else:
                spans[0][1] += step

    for m in sorted(groups):
        spans, regions = groups[m], counts.get(m, 0)
        left = sum(e - s for _, s, e in spans)
        while left:
            if not regions:
                take(spans, left)
                break
            room = int((part + 1) * per - assigned + 0.5)
            if room <= 0 and part < partitions - 1:
                part += 1
                continue
            share = min(1.0, room / regions) if part < partitions - 1 else 1.0
            n = max(1, int(share * left))
            moved = int(share * regions)
            take(spans, n)
            left, regions, assigned = left - n, regions - moved, assigned + moved
    return out


def take_loci(depths: Iterable[tuple[str, int, int, int]], cap: int, trim: bool = False) -> Iterator[list[tuple[str, int, int]]]:
    """Greedy loci sets of at most `cap` regions from sorted (contig, locus, depth, starts).

    A set's first position costs its depth (also where a new contig begins), the next ones their
    starts; positions deeper than the cap are dropped.  Without trim a contig's part of a set is
    one range from its first to its last position, but for dropped positions in between.
    """
    ranges: list[tuple[str, int, int]] = []
    used = 0
    span: list | None = None  # contig, first, end, whether the next position may extend it

    def close():
        nonlocal span
        if span is not None:
            ranges.append((span[0], span[1], span[2]))
            span = None

    fresh = True  # the next position costs its depth
    contig_of_set = None
    for contig, locus, depth, starts in depths:
        if contig != contig_of_set:
            close()
            fresh, contig_of_set = True, contig
        cost = depth if fresh else starts
        if used + cost > cap:
            close()
            if depth > cap:
                continue
            if ranges:
                yield ranges
                ranges = []
            used, cost = 0, depth
        used += cost
        fresh = False
        if span is not None and (not trim or span[2] == locus):
            span[2] = locus + 1
        else:
            close()
            span = [contig, locus, locus + 1]
    close()
    if ranges:
        yield ranges


#: Positions that are walked together by `capped`; sets end at their borders, wherever tasks begin.
SPAN = 1 << 20


def capped(regions: DataFrame, loci: DataFrame | None, cap: int, half_window: int = 0, trim: bool = False, span: int = SPAN) -> DataFrame:
    """Loci in partitions of at most `cap` regions each; positions deeper than the cap are dropped.

    Every `span` positions of a contig are walked on their own, so results do not depend on the layout of
    the data and no task holds more; partition numbers are then made dense in order.
    """
    cov = coverage(regions, half_window, loci).withColumn("part", F.floor(F.col("locus") / span))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("locus")
        contig, part = pdf["contig"].iloc[0], pdf["part"].iloc[0]
        found = take_runs(*(pdf[c].to_numpy() for c in ("locus", "depth", "starts")), cap, trim)
        return pd.DataFrame([(contig, a, b, part, i) for i, runs in enumerate(found) for a, b in runs], columns=["contig", "start", "end", "part", "nth"])

    found = cov.groupBy("contig", "part").applyInPandas(walk, "contig string, start long, end long, part long, nth int")
    # a row for each span of positions
    sizes = found.groupBy("contig", "part").agg((F.max("nth") + 1).alias("m"))
    within = sizes.withColumn("before", F.sum("m").over(W.partitionBy("contig").orderBy("part")) - F.col("m"))
    contigs = sizes.groupBy("contig").agg(F.sum("m").alias("all")).withColumn("base", F.sum("all").over(W.orderBy("contig")) - F.col("all")).select("contig", "base")
    return found.join(within, ["contig", "part"]).join(contigs, "contig").select("contig", "start", "end", (F.col("base") + F.col("before") + F.col("nth")).cast("int").alias("partition"))


def take_runs(locus: np.ndarray, depth: np.ndarray, starts: np.ndarray, cap: int, trim: bool = False) -> list[list[tuple[int, int]]]:
    """The sets of take_loci on one contig as ranges: jumps from one position that does not fit to the next."""
    before = np.concatenate([[0], np.cumsum(starts)])
    sets: list[list[tuple[int, int]]] = []
    ranges: list[tuple[int, int]] = []
    gaps = np.flatnonzero(np.diff(locus) != 1) + 1
    used = at = 0
    fresh, n = True, len(locus)
    while at < n:
        first = int(depth[at] if fresh else starts[at])
        if used + first > cap:
            if depth[at] > cap:
                at += 1
                continue
            if ranges:
                sets.append(ranges)
            ranges, used, first = [], 0, int(depth[at])
        fresh = False
        # the positions after it that fit cost their starts
        end = max(at + 1, int(np.searchsorted(before, cap - used - first + before[at + 1], side="right")) - 1)
        edges = [at, *(gaps[(gaps > at) & (gaps < end)].tolist() if trim else []), end]
        ranges += [(int(locus[a]), int(locus[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:])]
        used += first + int(before[end] - before[at + 1])
        at = end
    if ranges:
        sets.append(ranges)
    return sets


def partition_copies(regions: DataFrame, partitioning: DataFrame, half_window: int = 0) -> DataFrame:
    """Each region once for every partition that it comes within half_window of."""
    near = partitioning.select("contig", F.greatest(F.col("start") - half_window, F.lit(0)).alias("start"), (F.col("end") + half_window).alias("end"), "partition")
    pairs = overlap_join(regions, near, broadcast=small(near)).withColumnRenamed("r_partition", "partition").drop("r_contig", "r_start", "r_end")
    # where regions have an id, it alone decides: other columns need not be comparable
    return pairs.dropDuplicates(["rid", "partition"] if "rid" in regions.columns else [*regions.columns, "partition"])


def partition_regions(regions: DataFrame, partitioning: DataFrame, half_window: int, tasks: int) -> DataFrame:
    """Copies laid out by partition and sorted by position within it."""
    return partition_copies(regions, partitioning, half_window).repartition(tasks, "partition").sortWithinPartitions("partition", "contig", "start")


def loci_stats(partitioning: DataFrame) -> DataFrame:
    """(partition, positions, contigs, ranges, longest) of each partition of disjoint loci."""
    size = F.col("end") - F.col("start")
    return partitioning.groupBy("partition").agg(F.sum(size).alias("positions"), F.count_distinct("contig").alias("contigs"), F.count(F.lit(1)).alias("ranges"), F.max(size).alias("longest"))


def partition_stats(copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(partitions per region: copies, regions), (regions per partition: partition, regions)."""
    per = copies.groupBy("rid").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("regions"))
    return per, copies.groupBy("partition").agg(F.count(F.lit(1)).alias("regions"))
