"""Queries through files: what a sink writes is read again by the reader of its format."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partition as P
from ..operators import pileup as PU
from ..sources import reference as REF
from ..sources import sam, sinks
from . import views
from .catalog import CALLS, PILE, R, SEQ_B, SPANS, UNIFORM, VAF, _calls, _spans, query


def scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors can write: below spark.checkpoint.dir, on one machine else a temporary one.

    Results are read from it lazily, so it stays, as checkpoints do.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="exchange-")
    return f"{where.rstrip('/')}/{uuid.uuid4().hex}"


def sam_lines(reads: DataFrame, flags) -> DataFrame:
    """SAM records of reads, without mates."""
    quality = F.array_join(F.transform("base_qualities", lambda q: F.char(q + 33)), "")
    fields = (F.format_string("r%d", "read_id"), flags.cast("string"), "contig", (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "sequence", quality)
    return reads.select(F.concat_ws("\t", *fields).alias("value"))


@query(f"""WITH {SEQ_B}, {views.READS}, o AS (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1) AS n, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) AS c FROM reads),
x AS (SELECT *, "start" + list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN c[i] IN ('M', 'D', 'N', '=', 'X') THEN CAST(n[i] AS INTEGER) ELSE 0 END)) AS e,
             read_id % 13 <> 0 AND "start" - CASE WHEN c[1] = 'S' THEN CAST(n[1] AS INTEGER) ELSE 0 END >= 0 AS m FROM o)
SELECT 'r' || read_id AS name, CASE WHEN m THEN contig END AS contig, CASE WHEN m THEN "start" END AS "start", CAST(CASE WHEN m THEN e END AS BIGINT) AS "end", CASE WHEN m THEN mapq END AS mapq,
       CASE WHEN m THEN cigar END AS cigar, sequence, CAST(list_sum(base_qualities) AS BIGINT) AS quality, m AS is_mapped, is_positive_strand, read_id % 7 = 0 AS is_duplicate FROM x""")
def sam_scan(spark, d):
    path = f"{scratch(spark)}/reads.sam"
    bit = lambda c, n: F.when(c, n).otherwise(0)
    flags = bit(F.col("read_id") % 13 == 0, 0x4) + bit(~F.col("is_positive_strand"), 0x10) + bit(F.col("read_id") % 7 == 0, 0x400)
    head = views.reference(spark, d).select(F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("contig_length").cast("string")).alias("value"))
    head.unionByName(sam_lines(views.reads(spark, d), flags)).write.text(path)
    quality = F.aggregate("base_qualities", F.lit(0).cast("long"), lambda a, q: a + q)
    return sam.read_samples(spark, [path]).select("name", "contig", "start", "end", "mapq", "cigar", "sequence", quality.alias("quality"), "is_mapped", "is_positive_strand", "is_duplicate")


@query(f'WITH {SEQ_B}, {views.READS} SELECT contig, contig_length AS length FROM reference')
def sam_dictionary(spark, d):
    path = f"{scratch(spark)}/head.sam"
    views.reference(spark, d).select(F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("contig_length").cast("string")).alias("value")).write.text(path)
    return sam.read_sam_contigs(spark, path)


@query(f'WITH {SEQ_B}, {views.READS} SELECT contig, CAST(0 AS BIGINT) AS "offset", sequence, contig_length FROM reference')
def fasta_scan(spark, d):
    path = f"{scratch(spark)}/reference.fasta"
    lines = F.concat(F.lit(">"), "contig", F.lit(" item\n"), F.regexp_replace("sequence", "(.{50})", "$1\n"))
    views.reference(spark, d).select(lines.alias("value")).write.text(path)
    return REF.read_fasta(spark, path)


@query(f"""WITH {SEQ_B}, {views.READS}, s AS (SELECT DISTINCT r.contig, greatest(r."start" - 5, 0) AS "start", least(r."start" + {views.READ} + 5, f.contig_length) AS "end", f.contig_length FROM reads r JOIN reference f ON f.contig = r.contig WHERE is_positive_strand AND read_id % 50 = 0),
m AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY contig ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT contig, min("start") AS "start", max("end") AS "end", contig_length FROM (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM m) GROUP BY contig, run, contig_length)
SELECT g.contig, g."start" AS "offset", substr(sequence, CAST(g."start" + 1 AS INTEGER), CAST(g."end" - g."start" AS INTEGER)) AS sequence, g.contig_length FROM g JOIN reference f ON f.contig = g.contig""")
def partial_fasta_scan(spark, d):
    path = f"{scratch(spark)}/partial.fasta"
    near = views.reads(spark, d).filter("is_positive_strand and read_id % 50 = 0").select("contig", "start", (F.col("start") + views.READ).alias("end"), F.lit(True).alias("is_mapped"))
    REF.partial_fasta(near, views.reference(spark, d), padding=5).select(F.concat_ws("\n", "head", "sequence").alias("value")).write.text(path)
    return REF.read_fasta(spark, path)


@query(f'WITH {CALLS} SELECT contig, locus AS "start", locus + length(br) AS "end", br AS "ref", ba AS alt, false AS db_snp FROM calls')
def vcf_scan(spark, d):
    path = f"{scratch(spark)}/calls.vcf"
    sinks.write_genotypes(sinks.genotype_records(_calls(spark, d)), path)
    return REF.read_vcf(spark, path).select("contig", "start", "end", "ref", "alt", "db_snp")


@query(f"""WITH {CALLS}, g AS (SELECT contig, locus AS "start", locus + 1 AS "end", br AS "ref", ba AS alt, 'tumor' AS sample, '0/1' AS genotype, td - bn AS ref_depth, bn AS alt_depth, td AS depth, CAST(99 AS BIGINT) AS quality FROM calls)
SELECT 'json' AS format, * FROM g UNION ALL SELECT 'parquet', * FROM g""")
def genotype_files(spark, d):
    folder = scratch(spark)
    records = sinks.genotype_records(_calls(spark, d))
    columns = ["contig", "start", "end", "ref", "alt", "sample", "genotype", "ref_depth", "alt_depth", "depth", F.col("quality").cast("long").alias("quality")]
    sinks.write_genotypes(records, f"{folder}/calls.json")
    sinks.write_genotypes(records, f"{folder}/calls.parquet")
    read = {"json": spark.read.schema(records.schema).json(f"{folder}/calls.json"), "parquet": spark.read.parquet(f"{folder}/calls.parquet")}
    a, b = (t.select(F.lit(name).alias("format"), *columns) for name, t in read.items())
    return a.unionByName(b)


@query(f"""WITH {VAF}, b AS (SELECT sample_id, CAST(trunc(vaf * CAST(100 AS FLOAT)) AS INTEGER) AS p FROM vafs)
SELECT sample_id AS SampleId, p - p % 10 AS BinStart, least(p - p % 10 + 10, 100) AS BinEnd, count(*) AS Size FROM b GROUP BY 1, 2, 3""")
def histogram_csv(spark, d):
    path = f"{scratch(spark)}/histogram.csv"
    sinks.write_histogram(PU.vaf_histogram(PU.vaf_loci(views.pile(spark, d)), 10), path)
    return spark.read.option("header", True).schema("SampleId int, BinStart int, BinEnd int, Size long").csv(path)


@query(f"""WITH {PILE} SELECT sample_id || ', ' || contig || ', ' || locus || ', ' || "ref" || ', ' || alt || ', ' || count(*) AS line FROM pile GROUP BY sample_id, contig, locus, "ref", alt""")
def variant_support_text(spark, d):
    path = f"{scratch(spark)}/support"
    sinks.write_support(PU.allele_counts(views.pile(spark, d)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH {R}, {SPANS}, {UNIFORM.format(p=24)} SELECT * FROM parts")
def partitioning_file(spark, d):
    path = f"{scratch(spark)}/partitioning"
    REF.write_partitioning(P.uniform(_spans(views.regions(spark, d)), 24), path)
    return REF.read_partitioning(spark, path)


@query(f'WITH {R} SELECT rid, contig, "start", "end", is_positive_strand, mapq FROM regions')
def partitioned_reads(spark, d):
    path = f"{scratch(spark)}/reads"
    regions = views.regions(spark, d)
    P.partition_regions(regions, P.uniform(_spans(regions), 8), 4, 8).write.partitionBy("partition").parquet(path)
    return sam.read_partitioned(spark, path).select("rid", "contig", "start", "end", "is_positive_strand", "mapq")


@query("""SELECT * FROM (VALUES ('chr1', CAST(5 AS BIGINT), CAST(20 AS BIGINT)), ('chr1', 30, 31), ('chr2', 0, 1000), ('chr3', 7, 500)) t(contig, "start", "end")""")
def loci_file(spark, d):
    path = f"{scratch(spark)}/loci"
    spark.createDataFrame([("chr1:5-10,chr1:10-20",), ("chr1:30 chr2",), ("chr3:7-",), ("chr1:8-8",)], "value string").write.text(path)
    return REF.read_loci(spark, path, spark.createDataFrame([("chr2", 1000), ("chr3", 500)], "contig string, length long"))
