"""Command line: python -m strandloom.plans.cli COMMAND ... ; every command is a plan over the operators."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import partition as P
from ..operators import pileup as PU
from ..operators.filters import ReadFilter, SomaticFilter
from ..sources import reference as REF
from ..sources import sam, sinks
from . import germline, joint, vaf
from .somatic import annotate_known, somatic_standard


def _reads(spark: SparkSession, args, paths: list[str], filtered: bool = True) -> DataFrame:
    keep = ReadFilter(args.include_duplicates, args.include_failed_quality_checks, args.include_single_end, True, args.min_alignment_quality) if filtered else ReadFilter(True, True, True, True)
    if getattr(args, "partitioned_reads", None):
        # a read stands in every partition that it comes near; one of its copies is read again
        return keep(sam.read_partitioned(spark, args.partitioned_reads))
    table = sam.read_samples(spark, paths, keep)
    return table.withColumn("read_id", F.monotonically_increasing_id()).withColumn("rid", F.col("read_id"))


def _loci(spark: SparkSession, args, reads: DataFrame) -> DataFrame:
    lengths = I.contig_lengths(reads)
    if args.loci:
        return REF.loci(spark, args.loci, lengths)
    if args.loci_file:
        return REF.read_loci(spark, args.loci_file, lengths)
    return lengths.select("contig", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


def _pile(spark: SparkSession, args, reads: DataFrame) -> DataFrame:
    chosen = _loci(spark, args, reads) if args.loci or args.loci_file else None
    return PU.elements(reads, REF.read_fasta(spark, args.reference), chosen)


def somatic_standard_command(spark, args):
    reads = _reads(spark, args, [args.tumor_reads, args.normal_reads])
    pile = _pile(spark, args, reads)
    calls = somatic_standard(
        pile.filter("sample_id = 0"), pile.filter("sample_id = 1"), args.tumor_odds, args.normal_odds, args.max_normal_alternate_read_depth, args.min_tumor_variant_allele_frequency,
        args.max_tumor_read_depth, args.max_median_mismatches is not None,
    )
    if args.dbsnp_vcf:
        calls = annotate_known(calls, REF.read_vcf(spark, args.dbsnp_vcf))
    chosen = SomaticFilter(
        args.min_tumor_read_depth, args.max_tumor_read_depth, args.min_normal_read_depth, args.min_tumor_alternate_read_depth, None, args.min_vaf, args.min_average_mapping_quality,
        args.min_average_base_quality, args.max_median_mismatches,
    )
    sinks.write_genotypes(sinks.genotype_records(chosen(calls)), args.out, args.max_genotypes)


def somatic_joint_command(spark, args):
    names = args.sample_names or [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in args.paths]
    tissues = args.tissue_types or ["normal", *["tumor"] * (len(args.paths) - 1)]
    analytes = args.analytes or ["dna"] * len(args.paths)
    samples = spark.createDataFrame(list(zip(range(len(names)), tissues, analytes)), "sample_id int, tissue string, analyte string")
    pile = _pile(spark, args, _reads(spark, args, args.paths))
    given = [f(spark, x) for f, x in ((REF.loci, args.force_call_loci), (REF.read_loci, args.force_call_loci_file)) if x]
    forced = reduce(DataFrame.unionByName, given).select("contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("start")).distinct() if given else None
    candidates = joint.candidate_alleles(pile)
    if forced is not None:
        candidates = joint.fallback_alleles(pile, forced, candidates)
    evidence = joint.sample_evidence(joint.read_support(pile, candidates), samples)
    calls = joint.annotate(joint.choose_alleles(joint.joint_calls(evidence), keep_uncalled=forced), evidence)
    if not args.include_filtered:
        passing = F.size("failing") == 0
        calls = calls.filter(passing if forced is None else passing | ~(F.col("is_germline") | F.col("is_somatic")))
    if args.only_somatic:
        calls = calls.filter("is_somatic")
    labels = dict(enumerate(names)) | {-1: "pooled_normal", -2: "pooled_tumor"}
    sinks.write_joint(sinks.joint_records(calls, evidence, labels), args.out_dir, labels)


def germline_command(spark, args):
    reads = _reads(spark, args, [args.reads])
    out = germline.germline_calls(
        reads, _pile(spark, args, reads), REF.read_fasta(spark, args.reference), args.kmer_size, args.assembly_window_range, args.min_occurrence, args.min_area_vaf,
        args.min_mean_kmer_quality, args.min_likelihood, shortcut=args.shortcut_assembly,
    )
    sinks.write_genotypes(out, args.out)


def vaf_histogram_command(spark, args):
    loci = PU.vaf_loci(_pile(spark, args, _reads(spark, args, args.paths)), args.min_read_depth, args.min_vaf)
    sinks.write_histogram(PU.vaf_histogram(loci, args.bins), args.out)
    if args.print_stats:
        vaf.statistics(loci, args.sample_percent).show(truncate=False)
    if args.cluster:
        vaf.gaussian_mixture(loci, args.num_clusters).show(truncate=False)


def variant_support_command(spark, args):
    reads = _reads(spark, args, args.paths, filtered=False)
    wanted = REF.read_vcf(spark, args.input_variant).select("contig", "start", "end")
    pile = PU.elements(reads, REF.read_fasta(spark, args.reference), I.merge_intervals(wanted))
    sinks.write_support(PU.allele_counts(pile), args.out)


def _partitioning(spark, args, reads: DataFrame) -> DataFrame:
    """A given partitioning is read where it exists, else computed and, if a path was given, saved there."""
    if not args.loci_partitioning:
        return _compute_partitioning(spark, args, reads)
    if not REF.exists(spark, args.loci_partitioning):
        REF.write_partitioning(_compute_partitioning(spark, args, reads), args.loci_partitioning)
    return REF.read_partitioning(spark, args.loci_partitioning)


def _compute_partitioning(spark, args, reads: DataFrame) -> DataFrame:
    loci = _loci(spark, args, reads)
    n = args.parallelism or spark.sparkContext.defaultParallelism
    if args.loci_partitioner == "uniform":
        return P.uniform(loci, n)
    if args.loci_partitioner == "micro-regions":
        return P.micro_region(reads, loci, n, args.partition_accuracy)
    return P.capped(reads, loci, args.max_reads_per_partition, args.half_window, args.trim_ranges)


def partition_loci_command(spark, args):
    REF.write_partitioning(_partitioning(spark, args, _reads(spark, args, args.paths)), args.out)


def partition_reads_command(spark, args):
    reads = _reads(spark, args, args.paths)
    partitioning = _partitioning(spark, args, reads)
    if args.partitioning_stats:
        P.loci_stats(partitioning).orderBy("partition").show(100, truncate=False)
        for table in P.partition_stats(P.partition_copies(reads.select("rid", "contig", "start", "end"), partitioning, args.half_window)):
            table.orderBy(table.columns[0]).show(100, truncate=False)
    laid = P.partition_regions(reads, partitioning, args.half_window, args.parallelism or spark.sparkContext.defaultParallelism)
    laid.write.partitionBy("partition").parquet(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, many=False, reference=True):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if many:
            c.add_argument("paths", nargs="+")
            c.add_argument("--sample-names", nargs="*")
        if reference:
            c.add_argument("--reference", required=True)
        for flag in ("--include-duplicates", "--include-failed-quality-checks", "--include-single-end"):
            c.add_argument(flag, action="store_true")
        c.add_argument("--min-alignment-quality", type=int)
        c.add_argument("--loci")
        c.add_argument("--loci-file")
        c.add_argument("--out")
        c.add_argument("--partitioned-reads", help="reads that partition-reads laid out, in place of the paths")
        c.add_argument("--split-size", type=int, help="most bytes of a file that one task reads")
        return c

    c = command("somatic-standard", somatic_standard_command)
    c.add_argument("--tumor-reads", required=True)
    c.add_argument("--normal-reads", required=True)
    c.add_argument("--dbsnp-vcf")
    for name, kind, default in (
        ("tumor-odds", float, 10), ("normal-odds", float, 5), ("max-normal-alternate-read-depth", int, 4), ("min-tumor-variant-allele-frequency", float, 3), ("min-vaf", int, 0),
        ("min-average-mapping-quality", int, 20), ("min-average-base-quality", int, 20), ("min-tumor-read-depth", int, 5), ("min-normal-read-depth", int, 5), ("max-tumor-read-depth", int, 2**31 - 1),
        ("min-tumor-alternate-read-depth", int, None), ("max-median-mismatches", int, None), ("max-genotypes", int, 0),
    ):
        c.add_argument(f"--{name}", type=kind, default=default)
    c = command("somatic-joint", somatic_joint_command, many=True)
    c.add_argument("--out-dir", required=True)
    c.add_argument("--only-somatic", action="store_true")
    c.add_argument("--include-filtered", action="store_true")
    c.add_argument("--tissue-types", nargs="*")
    c.add_argument("--analytes", nargs="*")
    c.add_argument("--force-call-loci")
    c.add_argument("--force-call-loci-file")
    c = command("germline-assembly", germline_command)
    c.add_argument("--reads", required=True)
    c.add_argument("--shortcut-assembly", action="store_true")
    for name, default in (("min-likelihood", 0), ("kmer-size", 47), ("assembly-window-range", 120), ("min-occurrence", 3), ("min-area-vaf", 5), ("min-mean-kmer-quality", 0)):
        c.add_argument(f"--{name}", type=int, default=default)
    c = command("vaf-histogram", vaf_histogram_command, many=True)
    c.add_argument("--cluster", action="store_true")
    c.add_argument("--print-stats", action="store_true")
    for name, default in (("bins", 20), ("num-clusters", 3), ("min-read-depth", 0), ("min-vaf", 0), ("sample-percent", 25)):
        c.add_argument(f"--{name}", type=int, default=default)
    command("variant-support", variant_support_command, many=True).add_argument("--input-variant", "-v", required=True)
    for name, run in (("partition-loci", partition_loci_command), ("partition-reads", partition_reads_command)):
        c = command(name, run, many=True, reference=False)
        c.add_argument("--loci-partitioner", choices=("capped", "micro-regions", "uniform"), default="capped")
        c.add_argument("--trim-ranges", action="store_true")
        c.add_argument("--loci-partitioning")
        c.add_argument("--partitioning-stats", action="store_true")
        for option, default in (("max-reads-per-partition", 100_000), ("partition-accuracy", 250), ("parallelism", 0), ("half-window", 0)):
            c.add_argument(f"--{option}", type=int, default=default)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"strandloom {args.command}").getOrCreate()
    if args.split_size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(args.split_size))
    args.run(spark, args)


if __name__ == "__main__":
    main()
