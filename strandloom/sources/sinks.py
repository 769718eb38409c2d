"""Writers: VCF, JSON, Parquet, histograms and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = [
    "##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">',
]


def genotype_records(calls: DataFrame, sample: str = "tumor") -> DataFrame:
    """Tumor/normal calls as genotype records: one heterozygous genotype of the sample per call."""
    return calls.select(
        "contig", "start", "end", "ref", "alt", F.lit(sample).alias("sample"), F.lit("0/1").alias("genotype"),
        (F.col("tumor_depth") - F.col("tumor_allele_depth")).alias("ref_depth"), F.col("tumor_allele_depth").alias("alt_depth"), F.col("tumor_depth").alias("depth"), F.lit(99).alias("quality"),
        *([F.col("rs_id")] if "rs_id" in calls.columns else [F.lit(None).cast("long").alias("rs_id")]),
    )


def vcf_line(info: Column | None = None) -> Column:
    """A record's VCF line; positions are 1-based."""
    name = F.coalesce(F.concat(F.lit("rs"), F.col("rs_id").cast("string")), F.lit("."))
    gt = F.concat_ws(":", F.col("genotype"), F.concat_ws(",", F.col("ref_depth").cast("string"), F.col("alt_depth").cast("string")), F.col("depth").cast("string"), F.col("quality").cast("string"))
    return F.concat_ws("\t", F.col("contig"), (F.col("start") + 1).cast("string"), name, F.col("ref"), F.col("alt"), F.lit("."), F.lit("."), info if info is not None else F.lit("."), F.lit("GT:AD:DP:GQ"), gt)


def write_vcf(records: DataFrame, path: str, sample: str = "tumor", limit: int = 0) -> None:
    """One VCF text part with its header, sorted by (contig, start, ref, alt); an existing path is an error.

    limit > 0 keeps so many records in that order (a sample of the output for inspection).
    """
    order = ["contig", "start", "ref", "alt"]
    rows = records.orderBy(*order).limit(limit) if limit else records
    body = rows.select(F.lit(1).alias("k"), *order, vcf_line().alias("value"))
    head = records.sparkSession.createDataFrame([(0, str(i).zfill(4), 0, "", "", h) for i, h in enumerate([*HEADER, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])])], "k int, contig string, start long, ref string, alt string, value string")
    # a VCF is one ordered file: a global sort, then its ranges written one after the other
    head.unionByName(body).orderBy("k", *order).select("value").coalesce(1).write.mode("errorifexists").text(path)


def write_genotypes(records: DataFrame, path: str | None, limit: int = 0) -> None:
    """By suffix: .vcf, .json, else Parquet; without a path JSON lines on standard output, streamed partition by partition."""
    if path is None:
        for row in (records.limit(limit) if limit else records).toJSON().toLocalIterator():
            print(row)
    elif path.endswith(".vcf"):
        write_vcf(records, path, limit=limit)
    elif path.endswith(".json"):
        (records.limit(limit) if limit else records).write.mode("errorifexists").json(path)
    else:
        (records.limit(limit) if limit else records).write.mode("errorifexists").parquet(path)


def write_histogram(histogram: DataFrame, path: str | None) -> None:
    rows = histogram.orderBy("sample_id", "bin").select(F.col("sample_id").alias("SampleId"), F.col("bin").alias("BinStart"), F.col("bin_end").alias("BinEnd"), F.col("num_loci").alias("Size"))
    if path is None:
        for r in rows.toLocalIterator():
            print(",".join(map(str, r)))
    else:
        rows.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_support(counts: DataFrame, path: str) -> None:
    """Allele counts as lines `sample, contig, locus, ref, alt, count`."""
    counts.select(F.concat_ws(", ", *(F.col(c).cast("string") for c in ("sample_id", "contig", "locus", "ref", "alt", "n"))).alias("value")).write.mode("errorifexists").text(path)


def joint_info(calls: DataFrame) -> Column:
    """INFO of a joint call: what triggered it."""
    pooled, single = F.array_contains("triggered", -2), F.exists("triggered", lambda s: s != -2)
    return F.concat(F.lit("TRIGGER="), F.when(F.col("is_germline"), "GERMLINE_POOLED").otherwise(F.coalesce(F.nullif(F.concat_ws("+", F.when(pooled, "SOMATIC_POOLED"), F.when(single, "SOMATIC_INDIVIDUAL")), F.lit("")), F.lit("NONE"))))


def joint_records(calls: DataFrame, evidence: DataFrame, names: dict[int, str]) -> DataFrame:
    """VCF lines of joint calls with a column per sample, the pools last: GT:AD:DP:VAF.

    A genotype names the allele where the sample shows it (presence); evidence is pivoted over the
    few given samples.
    """
    site = ["contig", "start", "end", "ref", "alt"]
    gt = F.when(F.col("alt_depth") == 0, "0/0").when(F.col("ref_depth") == 0, "1/1").otherwise("0/1")
    cell = F.concat_ws(":", gt, F.concat_ws(",", F.col("ref_depth").cast("string"), F.col("alt_depth").cast("string")), F.col("depth").cast("string"), F.round("vaf", 4).cast("string"))
    wide = evidence.withColumn("cell", cell).groupBy(*site).pivot("sample_id", list(names)).agg(F.first("cell"))
    cells = [F.coalesce(F.col(f"`{k}`"), F.lit("./.")) for k in names]
    failing = F.array_join("failing", ";") if "failing" in calls.columns else F.lit("")
    filters = F.when(failing == "", "PASS").otherwise(failing)
    return calls.join(wide, site).select(
        "contig", "start", "ref", "alt", "is_germline", "is_somatic", "triggered",
        F.concat_ws("\t", "contig", (F.col("start") + 1).cast("string"), F.lit("."), "ref", "alt", F.lit("."), filters, joint_info(calls), F.lit("GT:AD:DP:VAF"), *cells).alias("value"),
    )


def write_joint(records: DataFrame, directory: str, names: dict[int, str]) -> list[str]:
    """all, germline, somatic.all_samples, all.<sample>, somatic.<sample> and all.tumor_pooled_dna under a folder, from one table of calls."""
    named = {n: F.array_contains("triggered", k) for k, n in names.items() if k >= 0}
    outs = {"all": F.lit(True), "germline": F.col("is_germline"), "somatic.all_samples": F.col("is_somatic")}
    for n, hit in named.items():
        outs |= {f"all.{n}": F.col("is_germline") | hit, f"somatic.{n}": F.col("is_somatic") & hit}
    outs["all.tumor_pooled_dna"] = F.col("is_somatic") & F.array_contains("triggered", -2)
    records = records.persist()
    head = records.sparkSession.createDataFrame([(0, "", 0, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names.values()]))], "k int, contig string, start long, value string")
    for name, keep in outs.items():
        body = records.filter(keep).select(F.lit(1).alias("k"), "contig", "start", "value")
        head.unionByName(body).orderBy("k", "contig", "start", "value").select("value").coalesce(1).write.mode("errorifexists").text(f"{directory}/{name}.vcf")
    records.unpersist()
    return list(outs)
