"""Readers of SAM text, BAM files and Parquet alignments as one reads table."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import base_qualities, cigar_elements, clipped_after, clipped_before, flag, reference_length


def _reads(raw: DataFrame) -> DataFrame:
    """Reads of raw alignment columns (name, flag, rname, pos 1-based, mapq, cigar, rnext, pnext, tlen, seq, qual)."""
    ops = cigar_elements(F.col("cigar"))
    start = (F.col("pos") - 1).cast("long")
    placed = ~flag(F.col("flag"), 0x4) & (F.col("rname") != "*") & (start >= 0) & (start - clipped_before(ops) >= 0)
    mate_contig = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))

    def mapped(c: Column) -> Column:
        return F.when(F.col("is_mapped"), c)

    out = raw.withColumn("is_mapped", F.coalesce(placed, F.lit(False)))
    return out.select(
        F.col("name"), mapped(F.col("rname")).alias("contig"), mapped(start).alias("start"), mapped(start + reference_length(ops)).alias("end"),
        mapped(start - clipped_before(ops)).alias("unclipped_start"), mapped(start + reference_length(ops) + clipped_after(ops)).alias("unclipped_end"),
        F.when(F.col("seq") == "*", "").otherwise(F.upper("seq")).alias("sequence"), base_qualities(F.col("qual"), F.length("seq")).alias("base_qualities"),
        mapped(F.col("mapq")).alias("mapq"), mapped(F.col("cigar")).alias("cigar"), F.col("is_mapped"),
        flag(F.col("flag"), 0x400).alias("is_duplicate"), flag(F.col("flag"), 0x200).alias("failed_qc"), (~flag(F.col("flag"), 0x10)).alias("is_positive_strand"),
        flag(F.col("flag"), 0x1).alias("is_paired"), flag(F.col("flag"), 0x40).alias("is_first_in_pair"),
        F.when(flag(F.col("flag"), 0x1) & ~flag(F.col("flag"), 0x8) & (F.col("rnext") != "*"), F.struct(
            mate_contig.alias("contig"), (F.col("pnext") - 1).cast("long").alias("start"), F.when(F.col("tlen") != 0, F.col("tlen")).alias("insert_size"), (~flag(F.col("flag"), 0x20)).alias("is_positive_strand"),
        )).alias("mate"),
    )


RAW = "name string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"


def read_sam(spark: SparkSession, path: str, sample_id: int = 0) -> DataFrame:
    """Reads of SAM text; splits of the file are read in parallel."""
    f = F.split("value", "\t")
    numbers = {"flag", "pos", "mapq", "pnext", "tlen"}
    names = [c.split()[0] for c in RAW.split(", ")]
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    raw = lines.select(*(F.get(f, i).try_cast("int").alias(c) if c in numbers else F.get(f, i).alias(c) for i, c in enumerate(names)))
    return _reads(raw).withColumn("sample_id", F.lit(sample_id))


def read_sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length) of a SAM header."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ\t"))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).try_cast("long").alias("length"))


def merge_contigs(*tables: DataFrame) -> DataFrame:
    """Union of contig dictionaries; an error at run time if a contig has two lengths."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    by = every.groupBy("contig").agg(F.min("length").alias("length"), F.max("length").alias("other"))
    clash = F.raise_error(F.concat(F.lit("contig with different lengths: "), F.col("contig")))
    return by.select("contig", F.when(F.col("length") == F.col("other"), F.col("length")).otherwise(clash.cast("long")).alias("length"))


def bgzf_payload(data: bytes) -> bytes:
    """Contents of a block-compressed file: gzip members, each of which names its own size in its BC field."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        size, head = _block(data, at)
        if size:
            out.append(zlib.decompress(view[at + head : at + size - 8], -15))
            at += size
        else:  # a member without that field ends where inflating says
            d = zlib.decompressobj(31)
            out.append(d.decompress(view[at:]) + d.flush())
            at = len(data) - len(d.unused_data)
    return b"".join(out)


def _block(data: bytes, at: int) -> tuple[int, int]:
    """Bytes of the member at a place, and of its header; zeros where it does not name its size."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04":
        return 0, 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    p = at + 12
    while p < at + 12 + extra:
        name, n = data[p : p + 2], struct.unpack_from("<H", data, p + 2)[0]
        if name == b"BC" and n == 2:
            return struct.unpack_from("<H", data, p + 4)[0] + 1, 12 + extra
        p += 4 + n
    return 0, 0


def parse_bam(data: bytes):
    """Records of a BAM file as raw alignment tuples, in the order of RAW."""
    body = bgzf_payload(data)
    if body[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", body, 4)[0]
    n, at = struct.unpack_from("<i", body, at)[0], at + 4
    names = []
    for _ in range(n):
        size = struct.unpack_from("<i", body, at)[0]
        names.append(body[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(body):
        size, ref, pos, l_name, mapq, _, n_cigar, flags, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", body, at)
        p = at + 36
        name = body[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", body, p)
        p += 4 * n_cigar
        packed = body[p : p + (l_seq + 1) // 2]
        p += (l_seq + 1) // 2
        quals = body[p : p + l_seq]
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:l_seq]
        yield (
            name, flags, names[ref] if ref >= 0 else "*", pos + 1, mapq, "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in ops) or "*",
            "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref], next_pos + 1, tlen, seq or "*", "*" if not l_seq or quals[0] == 255 else "".join(chr(q + 33) for q in quals),
        )
        at += 4 + size


def read_bam(spark: SparkSession, path: str, sample_id: int = 0) -> DataFrame:
    """Reads of BAM files (one task per file; many files are read in parallel)."""
    import pandas as pd

    def records(frames):
        for pdf in frames:
            for content in pdf["content"]:
                rows = []
                for r in parse_bam(bytes(content)):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    columns = [c.split()[0] for c in RAW.split(", ")]
    return _reads(spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, RAW)).withColumn("sample_id", F.lit(sample_id))


def read_alignments(spark: SparkSession, path: str, sample_id: int = 0) -> DataFrame:
    """Reads by suffix: .sam text, .bam files, else a Parquet table that holds the raw alignment columns or the reads themselves."""
    if path.endswith(".sam"):
        return read_sam(spark, path, sample_id)
    if path.endswith(".bam"):
        return read_bam(spark, path, sample_id)
    table = spark.read.parquet(path)
    return (_reads(table) if "flag" in table.columns else table.drop("sample_id")).withColumn("sample_id", F.lit(sample_id))


def read_samples(spark: SparkSession, paths: list[str], filters=None) -> DataFrame:
    """Bag union of samples, numbered in turn; filters: one for all, or one per file."""
    out = None
    for i, path in enumerate(paths):
        part = read_alignments(spark, path, i)
        one = filters[i] if isinstance(filters, list) else filters
        part = one(part) if one else part
        out = part if out is None else out.unionByName(part)
    return out


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Reads that were laid out by partition, each once: its copies share an id."""
    return spark.read.parquet(path).drop("partition").dropDuplicates(["rid"])
