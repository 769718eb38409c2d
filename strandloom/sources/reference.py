"""Readers of reference sequences, loci and variants."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIAL = r"^(.+):(\d+)-(\d+)/(\d+)$"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Segments (contig, offset, sequence, contig_length).

    Headers are names, whose sequence begins at 0, or contig:start-end/length for part of a contig;
    a part whose sequence has another length than its header says, or ends beyond its contig, is an error.
    """
    text = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.trim(F.regexp_extract("value", r"^([^\n]*)", 1))
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    part = text.select(head.alias("head"), seq.alias("sequence"), F.regexp_extract(head, PARTIAL, 1).alias("c"))
    number = lambda i: F.regexp_extract("head", PARTIAL, i).try_cast("long")
    is_part = F.col("c") != ""
    bad = is_part & ((number(3) - number(2) != F.length("sequence")) | (number(3) > number(4)))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("partial sequence does not fit its header: "), F.col("head"))).cast("string")).otherwise(F.col("sequence"))
    return part.select(
        F.when(is_part, F.col("c")).otherwise(F.regexp_extract("head", r"^(\S+)", 1)).alias("contig"), F.when(is_part, number(2)).otherwise(F.lit(0)).cast("long").alias("offset"),
        checked.alias("sequence"), F.when(is_part, number(4)).otherwise(F.length("sequence")).cast("long").alias("contig_length"),
    )


def reference_slice(reference: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (contig, start, end) with the bases of a segment that holds the whole range; others are an error."""
    r = reference.select("contig", "offset", "sequence")
    j = wanted.join(r, (wanted["contig"] == r["contig"]) & (wanted["start"] >= r["offset"]) & (wanted["end"] <= r["offset"] + F.length("sequence")), "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no reference bases at"), wanted["contig"], wanted["start"].cast("string")))
    bases = F.substring("sequence", (wanted["start"] - F.col("offset") + 1).cast("int"), (wanted["end"] - wanted["start"]).cast("int"))
    return j.select(wanted["contig"], wanted["start"], wanted["end"], F.when(F.col("offset").isNull(), missing.cast("string")).otherwise(bases).alias("bases"))


def parse_loci(text: str) -> list[tuple[str, int, int | None]]:
    """`contig:start-end` ranges, `contig:position`, or whole contigs, between commas, white space or lines; empty ranges vanish."""
    out = []
    for token in filter(None, re.split(r"[,\s]+", re.sub(r":\s+", ":", text))):
        contig, _, span = token.partition(":")
        if not span:
            out.append((contig, 0, None))
            continue
        start, dash, end = span.partition("-")
        low = int(start)
        high = int(end) if end else None if dash else low + 1
        if high is None or low < high:
            out.append((contig, low, high))
    return out


def loci(spark: SparkSession, text: str, contigs: DataFrame | None = None) -> DataFrame:
    """Disjoint loci (contig, start, end); open ends need the contigs' lengths."""
    from ..operators.intervals import merge_intervals

    raw = spark.createDataFrame(parse_loci(text), "contig string, start long, end long")
    if contigs is not None:
        raw = raw.join(contigs, "contig", "left").select("contig", "start", F.coalesce("end", "length").alias("end"))
    return merge_intervals(raw)


def read_loci(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """Loci of a text file, or the positions of a VCF's variants."""
    if path.endswith(".vcf"):
        from ..operators.intervals import merge_intervals

        return merge_intervals(read_vcf(spark, path).select("contig", "start", "end"))
    lines = [r[0] for r in spark.read.text(path).collect()]
    return loci(spark, "\n".join(lines), contigs)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants (contig, start, end, ref, alt, names, db_snp, info), one row per alternate allele."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    names = F.when(f[2] == ".", F.array().cast("array<string>")).otherwise(F.split(f[2], ";"))
    return rows.select(
        f[0].alias("contig"), (f[1].try_cast("long") - 1).alias("start"), f[3].alias("ref"), F.explode(F.split(f[4], ",")).alias("alt"), names.alias("names"), f[7].alias("info"),
    ).select("contig", "start", (F.col("start") + F.length("ref")).alias("end"), "ref", "alt", "names", (F.array_contains(F.split("info", ";"), "DB") | F.exists("names", lambda n: n.startswith("rs"))).alias("db_snp"), "info")


LINE = r"^([^:]+):(\d+)-(\d+)=(\d+)$"


def read_partitioning(spark: SparkSession, path: str) -> DataFrame:
    """Lines contig:start-end=partition, several on a line between commas."""
    parts = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("v")).filter("v <> ''")
    return parts.select(F.regexp_extract("v", LINE, 1).alias("contig"), *(F.regexp_extract("v", LINE, i).try_cast(t).alias(n) for i, n, t in ((2, "start", "long"), (3, "end", "long"), (4, "partition", "int"))))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_partitioning(partitioning: DataFrame, path: str) -> None:
    line = F.format_string("%s:%d-%d=%d", "contig", "start", "end", "partition")
    partitioning.orderBy("contig", "start").select(line.alias("value")).write.mode("errorifexists").text(path)


def partial_fasta(reads: DataFrame, reference: DataFrame, padding: int = 0) -> DataFrame:
    """Lines of a FASTA that holds only what reads span: (head, sequence)."""
    from ..operators.intervals import merge_intervals

    size = reference.groupBy("contig").agg(F.max(F.col("offset") + F.length("sequence")).alias("length"))
    near = reads.filter("is_mapped").join(size, "contig").select("contig", F.greatest(F.col("start") - padding, F.lit(0)).alias("start"), F.least(F.col("end") + padding, "length").alias("end"))
    cut = reference_slice(reference, merge_intervals(near)).join(size, "contig")
    return cut.select(F.format_string(">%s:%d-%d/%d", "contig", "start", "end", "length").alias("head"), F.col("bases").alias("sequence"))
