"""Views over the driver's tables that stand for genomic inputs, in Spark and in SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
READ = 20
#: CIGAR strings that reads take in turn; each spans READ reference positions or fewer.
CIGARS = ["20M", "20M", "20M", "4S16M", "8M2I10M", "8M2D10M", "10=1X9=", "5M3N12M", "20M", "6M1I13M"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as regions: contig from flag and status, days as positions, quantity as length."""
    start = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", start.cast("string"), F.col("l_quantity").cast("long").cast("string")).alias("rid"),
        F.concat("l_returnflag", "l_linestatus").alias("contig"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"),
        (F.col("l_linenumber") % 2 == 1).alias("is_positive_strand"), (F.col("l_suppkey") % 3).cast("int").alias("sample_id"), (F.col("l_suppkey") % 60).cast("int").alias("mapq"),
        (F.col("l_partkey") % 7 == 0).alias("is_duplicate"), (F.col("l_partkey") % 11 == 0).alias("failed_qc"), (F.col("l_partkey") % 5 != 0).alias("is_paired"), (F.col("l_suppkey") % 13 != 0).alias("is_mapped"),
    ).dropDuplicates(["rid"])


REGIONS = """regions AS (
    SELECT DISTINCT ON (rid) * FROM (
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, d, CAST(l_quantity AS BIGINT)) AS rid, l_returnflag || l_linestatus AS contig,
               d AS "start", d + CAST(l_quantity AS BIGINT) AS "end", l_linenumber % 2 = 1 AS is_positive_strand, CAST(l_suppkey % 3 AS INTEGER) AS sample_id,
               CAST(l_suppkey % 60 AS INTEGER) AS mapq, l_partkey % 7 = 0 AS is_duplicate, l_partkey % 11 = 0 AS failed_qc, l_partkey % 5 <> 0 AS is_paired, l_suppkey % 13 <> 0 AS is_mapped
        FROM (SELECT *, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS d FROM lineitem)
    )
)"""


def loci(spark: SparkSession) -> DataFrame:
    """Fixed loci on the regions' contigs."""
    return spark.createDataFrame([(c, s, e) for c in ("AF", "AO", "NF", "NO", "RF", "RO") for s, e in ((1200, 1300), (1500, 1501), (2000, 2400))], "contig string, start long, end long")


LOCI = """loci AS (
    SELECT c.contig, s."start", s."end" FROM (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) c(contig),
        (VALUES (CAST(1200 AS BIGINT), CAST(1300 AS BIGINT)), (1500, 1501), (2000, 2400)) s("start", "end")
)"""


def seqs(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Letters of a text column as bases: (id, sequence)."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), F.translate(letters, LETTERS, BASES).alias("sequence"))


def seqs_sql(name: str, key: str) -> str:
    return f"""seqs AS (SELECT {key} AS id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS sequence FROM {name})"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as reference contigs."""
    return seqs(spark, sf_dir, "benchmark", "item_id").filter(F.length("sequence") >= 60).select(F.format_string("b%d", "id").alias("contig"), F.lit(0).cast("long").alias("offset"), "sequence", F.length("sequence").cast("long").alias("contig_length"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reads of all reference contigs in turn; errors carry a changed base, purchases over position 40 a common variant."""
    items = table(spark, sf_dir, "benchmark").count()
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.format_string("b%d", F.col("event_id") % items).alias("contig"))
    j = e.join(reference(spark, sf_dir), "contig")
    start = (F.col("user_id") * 7 + F.col("event_id")) % (F.col("contig_length") - 30)
    cigar = F.element_at(F.array(*map(F.lit, CIGARS)), (F.col("event_id") % len(CIGARS) + 1).cast("int"))
    base = F.substring("sequence", (F.col("start") + 1).cast("int"), F.lit(READ))
    spot = F.when(F.col("event_type") == "error", (F.col("event_id") % READ).cast("int")).when((F.col("event_type") == "purchase") & (F.col("start") <= 40) & (F.col("start") > 40 - READ), (F.lit(40) - F.col("start")).cast("int")).otherwise(-1)
    changed = F.concat(F.substring(base, F.lit(1), F.col("spot")), F.translate(F.substring(base, F.col("spot") + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(base, F.col("spot") + 2, F.lit(READ)))
    quality = (F.col("value").cast("int") % 40 + 2).cast("int")
    return (
        j.withColumn("start", start).withColumn("spot", spot).withColumn("bases", F.when(F.col("spot") >= 0, changed).otherwise(base))
        .select(
            F.col("event_id").alias("read_id"), (F.col("user_id") % 2).cast("int").alias("sample_id"), "contig", F.col("start").cast("long").alias("start"), F.col("bases").alias("sequence"),
            F.transform(F.sequence(F.lit(0), F.lit(READ - 1)), lambda i: ((quality + i * 3) % 40 + 2).cast("int")).alias("base_qualities"),
            (F.col("event_id") % 60 + 1).cast("int").alias("mapq"), cigar.alias("cigar"), (F.col("event_id") % 2 == 0).alias("is_positive_strand"),
        )
    )


READS = f"""reference AS (
    SELECT 'b' || id AS contig, CAST(0 AS BIGINT) AS "offset", sequence, CAST(length(sequence) AS BIGINT) AS contig_length FROM seqs WHERE length(sequence) >= 60
), reads0 AS (
    SELECT e.event_id, e.user_id, e.event_type, r.contig, r.sequence AS refseq, (e.user_id * 7 + e.event_id) % (r.contig_length - 30) AS "start",
           (['{"', '".join(CIGARS)}'])[CAST(e.event_id % {len(CIGARS)} + 1 AS INTEGER)] AS cigar, CAST(CAST(trunc(e.value) AS INTEGER) % 40 + 2 AS INTEGER) AS quality
    FROM events e JOIN reference r ON r.contig = 'b' || (e.event_id % (SELECT count(*) FROM benchmark))
), reads1 AS (
    SELECT *, substr(refseq, CAST("start" + 1 AS INTEGER), {READ}) AS base,
           CASE WHEN event_type = 'error' THEN CAST(event_id % {READ} AS INTEGER)
                WHEN event_type = 'purchase' AND "start" <= 40 AND "start" > {40 - READ} THEN CAST(40 - "start" AS INTEGER) ELSE -1 END AS spot
    FROM reads0
), reads AS (
    SELECT event_id AS read_id, CAST(user_id % 2 AS INTEGER) AS sample_id, contig, "start",
           CASE WHEN spot >= 0 THEN substr(base, 1, spot) || translate(substr(base, spot + 1, 1), 'ACGT', 'CGTA') || substr(base, spot + 2) ELSE base END AS sequence,
           list_transform(range(0, {READ}), lambda i: CAST((quality + i * 3) % 40 + 2 AS INTEGER)) AS base_qualities,
           CAST(event_id % 60 + 1 AS INTEGER) AS mapq, cigar, event_id % 2 = 0 AS is_positive_strand, refseq
    FROM reads1
)"""

#: Pileup elements in SQL, on its own path: CIGAR elements are unnested and their offsets are window sums.
PILE = """ops AS (
    SELECT read_id, i, CAST(lens[i] AS INTEGER) AS len, codes[i] AS op FROM (
        SELECT read_id, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1) AS lens, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) AS codes FROM reads
    ), unnest(range(1, len(codes) + 1)) AS u(i)
), placed AS (
    SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER before, 0) AS roff,
           coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER before, 0) AS qoff,
           lead(op) OVER (PARTITION BY read_id ORDER BY i) AS follow, lead(len) OVER (PARTITION BY read_id ORDER BY i) AS follow_len
    FROM ops WINDOW before AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), spots AS (
    SELECT p.*, r.sample_id, r.contig, r.sequence, r.base_qualities, r.mapq, r.is_positive_strand, r.refseq, CAST(r."start" + p.roff + w AS BIGINT) AS locus,
           CAST(p.qoff + CASE WHEN op IN ('M', '=', 'X', 'S') THEN w ELSE 0 END AS INTEGER) AS read_pos,
           CASE WHEN w = len - 1 THEN follow END AS next_op, CASE WHEN w = len - 1 THEN follow_len ELSE 0 END AS next_len
    FROM placed p JOIN reads r USING (read_id), unnest(range(0, p.len)) AS u(w)
    WHERE op IN ('M', 'D', 'N', '=', 'X')
    UNION ALL
    SELECT p.*, r.sample_id, r.contig, r.sequence, r.base_qualities, r.mapq, r.is_positive_strand, r.refseq, CAST(0 AS BIGINT), CAST(p.qoff AS INTEGER), 'start', p.len
    FROM placed p JOIN reads r USING (read_id) WHERE op = 'I' AND r."start" + p.roff = 0
), pile AS (
    SELECT read_id, sample_id, contig, locus, aln_type, mapq, is_positive_strand, read_pos,
           CASE aln_type WHEN 'Insertion' THEN CASE WHEN next_op = 'start' THEN substr(sequence, len + 1, 1) ELSE base END
                WHEN 'Deletion' THEN rpad(substr(refseq, CAST(locus + 1 AS INTEGER), next_len + 1), next_len + 1, 'N') WHEN 'Clipped' THEN '' ELSE refbase END AS "ref",
           CASE aln_type WHEN 'Insertion' THEN CASE WHEN next_op = 'start' THEN substr(sequence, 1, len + 1) ELSE substr(sequence, read_pos + 1, next_len + 1) END
                WHEN 'Deletion' THEN refbase WHEN 'Match' THEN base WHEN 'Mismatch' THEN base ELSE '' END AS alt,
           CASE WHEN aln_type = 'Insertion' THEN list_min(base_qualities[read_pos + 1 : read_pos + next_len + 1])
                WHEN aln_type IN ('Match', 'Mismatch', 'Deletion') THEN base_qualities[read_pos + 1] ELSE mapq END AS qual
    FROM (
        SELECT *, CASE WHEN next_op = 'start' THEN 'Insertion' WHEN op IN ('M', '=') AND next_op = 'I' THEN 'Insertion' WHEN op IN ('M', '=', 'X') AND next_op = 'D' THEN 'Deletion'
                       WHEN op = 'D' THEN 'MidDeletion' WHEN op IN ('M', '=', 'X') AND base = refbase THEN 'Match' WHEN op IN ('M', '=', 'X') THEN 'Mismatch' ELSE 'Clipped' END AS aln_type
        FROM (SELECT *, substr(sequence, read_pos + 1, 1) AS base, coalesce(nullif(substr(refseq, CAST(locus + 1 AS INTEGER), 1), ''), 'N') AS refbase FROM spots)
    )
)"""


def pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pileup import elements

    return elements(reads(spark, sf_dir), reference(spark, sf_dir))


def read_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pile's elements, by read."""
    from ..operators.pileup import read_elements

    return read_elements(reads(spark, sf_dir), reference(spark, sf_dir))


PILE_SQL = f"{seqs_sql('benchmark', 'item_id')}, {READS}, {PILE}"
