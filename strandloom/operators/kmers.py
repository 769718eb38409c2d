"""K-mer counting and graph edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join, small

#: Windows that are cut from one piece of a sequence.
PIECE = 128


def kmer_counts(seqs: DataFrame, k: int, min_count: int = 1, min_mean_quality: float | None = None) -> DataFrame:
    """(kmer, n) of all k-mers that occur min_count times or more; a shorter sequence is one k-mer of its own length.

    With min_mean_quality, only sequences whose base_qualities have a mean above it.
    """
    if min_mean_quality is not None:
        mean = F.aggregate("base_qualities", F.lit(0.0), lambda a, q: a + q) / F.size("base_qualities")
        seqs = seqs.filter(mean > min_mean_quality)
    n = F.greatest(F.length("sequence") - k + 1, F.lit(1))
    # pieces of PIECE windows first: rows that hold a whole sequence for each of its windows would be quadratic in bytes
    piece = F.explode(F.transform(F.sequence(F.lit(1), n, F.lit(PIECE)), lambda i: F.substring(F.col("sequence"), i, F.lit(PIECE + k - 1)))).alias("piece")
    pieces = seqs.filter("sequence <> ''").select(piece)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("piece") - k + 1, F.lit(1)))).alias("i")
    cut = pieces.select("piece", at).select(F.substring(F.col("piece"), F.col("i"), F.lit(k)).alias("kmer"))
    return cut.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def kmer_edges(kmers: DataFrame, k: int) -> DataFrame:
    """(source, target) where the last k - 1 bases of one are the first of the other; a node has four followers at most."""
    a = kmers.filter(F.length("kmer") == k).select(F.col("kmer").alias("source"), F.substring("kmer", 2, k - 1).alias("inner"))
    b = kmers.filter(F.length("kmer") == k).select(F.col("kmer").alias("target"), F.substring("kmer", 1, k - 1).alias("inner"))
    return a.join(b, "inner").select("source", "target")


def prune(kmers: DataFrame, min_support: int) -> DataFrame:
    return kmers.filter(F.col("n") >= min_support)


def consensus_sequences(reads: DataFrame, regions: DataFrame, min_count: int) -> DataFrame:
    """(contig, start, end, sequence, n): what min_count reads or more show over a whole region.

    Only reads that cover the region and whose alignment is all M count, as their bases stand one to one
    for its positions.  reads: contig, start, end, sequence, cigar; regions: contig, start, end.
    """
    plain = reads.filter(F.col("cigar").rlike("^([0-9]+M)+$")).select("contig", "start", "end", "sequence")
    spots = regions.select("contig", "start", "end").distinct()
    inside = overlap_join(plain, spots, broadcast=small(spots)).filter("start <= r_start and end >= r_end")
    shown = F.substring(F.col("sequence"), (F.col("r_start") - F.col("start") + 1).cast("int"), (F.col("r_end") - F.col("r_start")).cast("int"))
    by = inside.groupBy("contig", F.col("r_start").alias("start"), F.col("r_end").alias("end"), shown.alias("sequence")).agg(F.count(F.lit(1)).alias("n"))
    return by.filter(F.col("n") >= min_count)


def sources_and_sinks(kmers: DataFrame, edges: DataFrame) -> DataFrame:
    """(kmer, parents, children) of every node."""
    into = edges.groupBy(F.col("target").alias("kmer")).agg(F.count(F.lit(1)).alias("parents"))
    out = edges.groupBy(F.col("source").alias("kmer")).agg(F.count(F.lit(1)).alias("children"))
    return kmers.select("kmer").join(into, "kmer", "left").join(out, "kmer", "left").na.fill(0)
