"""Registered queries of the engine, and for each the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import partition as P
from ..operators import pileup as PU
from ..operators.filters import ReadFilter, SomaticFilter, insufficient_normal
from . import joint, views
from .somatic import annotate_known, somatic_standard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


R, L, SEQ_D, SEQ_B = views.REGIONS, views.LOCI, views.seqs_sql("documents", "doc_id"), views.seqs_sql("benchmark", "item_id")
PILE = views.PILE_SQL


def coverage_sql(hw: int = 0, source: str = "regions") -> str:
    return f"""cov AS (
    SELECT contig, locus, count(*) AS depth, CAST(sum(CASE WHEN locus = greatest("start" - {hw}, 0) THEN 1 ELSE 0 END) AS BIGINT) AS starts
    FROM {source}, unnest(range(greatest("start" - {hw}, 0), "end" + {hw})) AS u(locus) GROUP BY contig, locus
)"""


LOCI_COVERAGE = """hit AS (
    SELECT r.rid, r.contig, x AS locus FROM regions r JOIN loci l ON r.contig = l.contig AND greatest(r."start" - 3, 0) < l."end" AND r."end" + 3 > l."start",
        unnest(range(greatest(r."start" - 3, 0, l."start"), least(r."end" + 3, l."end"))) AS u(x)
), firsts AS (SELECT *, min(locus) OVER (PARTITION BY rid) AS first FROM hit)"""


# coverage and depth

@query(f"WITH {R}, {coverage_sql()} SELECT * FROM cov")
def coverage(spark, d):
    return I.coverage(views.regions(spark, d))


@query(f"WITH {R}, {coverage_sql()} SELECT * FROM cov")
def coverage_exploded(spark, d):
    return I.coverage_exploded(views.regions(spark, d))


@query(f"WITH {R}, {coverage_sql(5)} SELECT * FROM cov")
def coverage_half_window(spark, d):
    return I.coverage(views.regions(spark, d), half_window=5)


@query(f"WITH {R}, {L}, {LOCI_COVERAGE} SELECT contig, locus, count(*) AS depth, CAST(sum(CASE WHEN locus = first THEN 1 ELSE 0 END) AS BIGINT) AS starts FROM firsts GROUP BY contig, locus")
def coverage_loci(spark, d):
    return I.coverage(views.regions(spark, d), half_window=3, loci=views.loci(spark))


@query(f"""WITH {R}, {coverage_sql()}, t AS (
    SELECT *, depth <= 120 AS valid, CASE WHEN (depth <= 120) = lag(depth <= 120) OVER (PARTITION BY contig ORDER BY locus) THEN 0 ELSE 1 END AS turn FROM cov
), r AS (SELECT *, sum(turn) OVER (PARTITION BY contig ORDER BY locus) AS run FROM t)
SELECT contig, CAST(run AS BIGINT) AS run, min(locus) AS "start", max(locus) + 1 AS "end", count(*) AS loci, valid FROM r GROUP BY contig, run, valid""")
def depth_runs(spark, d):
    return I.depth_runs(I.coverage(views.regions(spark, d)), 120)


@query(f"WITH {R}, {coverage_sql()} SELECT depth <= 120 AS valid, count(*) AS loci FROM cov GROUP BY 1")
def valid_loci_counts(spark, d):
    return I.valid_loci_counts(I.coverage(views.regions(spark, d)), 120)


@query(f'WITH {R} SELECT contig, max("end") AS length FROM regions GROUP BY contig')
def contig_lengths(spark, d):
    return I.contig_lengths(views.regions(spark, d))


@query(f'WITH {R}, {L} SELECT rid, contig, "start", "end" FROM regions r WHERE EXISTS (SELECT 1 FROM loci l WHERE l.contig = r.contig AND r."start" < l."end" AND r."end" > l."start")')
def interval_semi_join(spark, d):
    return I.overlapping(views.regions(spark, d).select("rid", "contig", "start", "end"), views.loci(spark))


@query(f"""WITH {R}, m AS (
    SELECT *, max("end") OVER (PARTITION BY contig ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM regions
), g AS (SELECT *, sum(CASE WHEN high IS NULL OR "start" > high THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT contig, min("start") AS "start", max("end") AS "end" FROM g GROUP BY contig, run""")
def merged_intervals(spark, d):
    return I.merge_intervals(views.regions(spark, d))


WINDOW_SQL = """SELECT l.contig, l.locus, count(*) AS n_regions, sum(r."end" - r."start") AS total_length
FROM (SELECT contig, unnest(range("start", "end", 10)) AS locus FROM loci) l JOIN regions r ON r.contig = l.contig AND r."start" <= l.locus + 7 AND r."end" > l.locus - 7 GROUP BY 1, 2"""


@query(f"WITH {R}, {L} SELECT contig, locus, n_regions, CAST(total_length AS BIGINT) AS total_length FROM ({WINDOW_SQL})")
def sliding_window(spark, d):
    spots = views.loci(spark).select("contig", F.explode(F.sequence("start", F.col("end") - 1, F.lit(10))).alias("locus"))
    near = I.window_regions(views.regions(spark, d), spots, 7)
    return near.groupBy("contig", "locus").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.col("end") - F.col("start")).alias("total_length"))


@query(f"""WITH {R}, {L} SELECT l.contig, l.locus, count(r.rid) AS n_regions FROM (SELECT DISTINCT contig, unnest(range("start", "end" + 400, 10)) AS locus FROM loci) l
LEFT JOIN (SELECT * FROM regions WHERE mapq >= 57) r ON r.contig = l.contig AND r."start" <= l.locus + 2 AND r."end" > l.locus - 2 GROUP BY 1, 2""")
def sliding_window_empty_too(spark, d):
    spots = views.loci(spark).select("contig", F.explode(F.sequence("start", F.col("end") + 399, F.lit(10))).alias("locus")).distinct()
    near = I.window_regions(views.regions(spark, d).filter("mapq >= 57"), spots, 2, keep_empty=True)
    return near.groupBy("contig", "locus").agg(F.count("rid").alias("n_regions"))


@query(f"WITH {R}, {L} SELECT contig, locus, sample_id, count(*) AS n_regions FROM regions r JOIN (SELECT contig AS c, unnest(range(\"start\", \"end\")) AS locus FROM loci) l ON r.contig = l.c AND r.\"start\" <= locus AND r.\"end\" > locus GROUP BY ALL")
def samples_at_loci(spark, d):
    spots = views.loci(spark).select("contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("locus"))
    return I.window_regions(views.regions(spark, d), spots, 0).groupBy("contig", "locus", "sample_id").agg(F.count(F.lit(1)).alias("n_regions"))


# partitioning

UNIFORM = """n AS (SELECT sum("end" - "start") AS total FROM spans), step AS (SELECT greatest(1.0, total / {p}.0) AS s FROM n),
cum AS (SELECT *, sum("end" - "start") OVER (ORDER BY contig, "start") - ("end" - "start") AS c0 FROM spans),
edges AS (SELECT k, CAST(floor(k * s + 0.5) AS BIGINT) AS lo, CASE WHEN k = {p} - 1 THEN (SELECT total FROM n) ELSE CAST(floor((k + 1) * s + 0.5) AS BIGINT) END AS hi FROM step, unnest(range(0, {p})) AS u(k)),
parts AS (SELECT contig, CAST("start" + greatest(c0, lo) - c0 AS BIGINT) AS "start", CAST("start" + least(c0 + "end" - "start", hi) - c0 AS BIGINT) AS "end", CAST(k AS INTEGER) AS "partition"
          FROM cum JOIN edges ON lo < c0 + "end" - "start" AND hi > c0)"""
SPANS = 'spans AS (SELECT contig, CAST(0 AS BIGINT) AS "start", max("end") AS "end" FROM regions GROUP BY contig)'


def _spans(regions: DataFrame) -> DataFrame:
    return I.contig_lengths(regions).select("contig", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


@query(f"WITH {R}, {SPANS}, {UNIFORM.format(p=16)} SELECT * FROM parts")
def uniform_partition(spark, d):
    return P.uniform(_spans(views.regions(spark, d)), 16)


@query(f"WITH {R}, {SPANS}, {UNIFORM.format(p=200)} SELECT \"partition\", count(DISTINCT rid) AS regions FROM parts p JOIN regions r ON r.contig = p.contig AND r.\"start\" < p.\"end\" AND r.\"end\" > p.\"start\" GROUP BY 1")
def micro_region_counts(spark, d):
    regions = views.regions(spark, d)
    return P.micro_counts(regions, P.uniform(_spans(regions), 200))


MICRO = f"""WITH RECURSIVE {R}, {SPANS}, {UNIFORM.format(p=200)},
counts AS (SELECT "partition" AS m, count(DISTINCT rid) AS n FROM parts p JOIN regions r ON r.contig = p.contig AND r."start" < p."end" AND r."end" > p."start" GROUP BY 1),
mics AS (SELECT row_number() OVER (ORDER BY m) - 1 AS j, CAST(size AS BIGINT) AS size, coalesce(n, 0) AS n, CAST(sum(size) OVER (ORDER BY m) - size AS BIGINT) AS lo
         FROM (SELECT "partition" AS m, sum("end" - "start") AS size FROM parts GROUP BY 1) LEFT JOIN counts USING (m)),
per AS (SELECT greatest(CAST(1 AS DOUBLE), CAST(sum(n) AS DOUBLE) / 8) AS per FROM mics),
walk AS (
    SELECT j, lo AS pos, size AS rest, n AS regions, 0 AS part, CAST(0 AS BIGINT) AS assigned, CAST(0 AS BIGINT) AS took, lo AS took_at FROM mics WHERE j = 0
    UNION ALL
    SELECT CASE WHEN rest = 0 THEN m_j ELSE j END, CASE WHEN rest = 0 THEN m_lo ELSE pos + taken END, CASE WHEN rest = 0 THEN m_size ELSE rest - taken END, CASE WHEN rest = 0 THEN m_n ELSE regions - moved END,
           part + CASE WHEN turn THEN 1 ELSE 0 END, assigned + moved, taken, pos
    FROM (SELECT *, CASE WHEN rest = 0 OR turn THEN 0 WHEN regions = 0 THEN rest ELSE greatest(1, CAST(trunc(share * rest) AS BIGINT)) END AS taken,
                 CASE WHEN rest = 0 OR turn OR regions = 0 THEN 0 ELSE CAST(trunc(share * regions) AS BIGINT) END AS moved
          FROM (SELECT *, rest > 0 AND regions > 0 AND room <= 0 AND part < 7 AS turn, CASE WHEN part < 7 AND regions > 0 THEN least(CAST(1 AS DOUBLE), CAST(room AS DOUBLE) / regions) ELSE CAST(1 AS DOUBLE) END AS share
                FROM (SELECT w.*, x.j AS m_j, x.lo AS m_lo, x.size AS m_size, x.n AS m_n, trunc((part + 1) * per - assigned + CAST(0.5 AS DOUBLE)) AS room
                      FROM walk w CROSS JOIN per LEFT JOIN mics x ON x.j = w.j + 1 WHERE w.rest > 0 OR x.j IS NOT NULL)))
), runs AS (SELECT part, min(took_at) AS a, max(took_at + took) AS b FROM walk WHERE took > 0 GROUP BY part)
SELECT contig, CAST("start" + greatest(c0, a) - c0 AS BIGINT) AS "start", CAST("start" + least(c0 + "end" - "start", b) - c0 AS BIGINT) AS "end", CAST(part AS INTEGER) AS "partition"
FROM cum JOIN runs ON a < c0 + "end" - "start" AND b > c0"""


@query(MICRO)
def micro_region_partition(spark, d):
    regions = views.regions(spark, d)
    return P.micro_region(regions, _spans(regions), 8, accuracy=25)


@query(f"""WITH RECURSIVE {R}, {coverage_sql()}, spots AS (SELECT *, locus // 512 AS part, row_number() OVER (PARTITION BY contig, locus // 512 ORDER BY locus) AS i FROM cov),
walk AS (
    SELECT DISTINCT contig, part, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS locus, true AS fresh, CAST(0 AS BIGINT) AS used, 0 AS nth, 0 AS block, false AS held, false AS taken FROM spots
    UNION ALL
    SELECT contig, part, i, locus, fresh AND gone, CASE WHEN gone THEN used WHEN full_ THEN depth ELSE used + cost END, nth + CASE WHEN full_ AND NOT gone AND held THEN 1 ELSE 0 END,
           block + CASE WHEN full_ THEN 1 ELSE 0 END, held OR NOT gone, NOT gone
    FROM (SELECT *, full_ AND depth > 2000 AS gone FROM (
        SELECT *, used + cost > 2000 AS full_ FROM (SELECT w.contig, w.part, s.i, s.locus, w.fresh, w.used, w.nth, w.block, w.held, s.depth, CASE WHEN w.fresh THEN s.depth ELSE s.starts END AS cost
            FROM walk w JOIN spots s ON s.contig = w.contig AND s.part = w.part AND s.i = w.i + 1)))
)
SELECT contig, min(locus) AS "start", max(locus) + 1 AS "end", CAST(dense_rank() OVER (ORDER BY contig, part, nth) - 1 AS INTEGER) AS "partition" FROM walk WHERE taken GROUP BY contig, part, nth, block""")
def capped_partition(spark, d):
    return P.capped(views.regions(spark, d), None, 2000, span=512)


@query(f"WITH {R}, {SPANS}, {UNIFORM.format(p=16)} SELECT DISTINCT rid, \"partition\" FROM parts p JOIN regions r ON r.contig = p.contig AND r.\"start\" < p.\"end\" + 4 AND r.\"end\" > greatest(p.\"start\" - 4, 0)")
def read_partition_copies(spark, d):
    regions = views.regions(spark, d)
    return P.partition_copies(regions, P.uniform(_spans(regions), 16), half_window=4).select("rid", "partition")


@query(f"""WITH {R}, {SPANS}, {UNIFORM.format(p=16)}, c AS (SELECT DISTINCT rid, "partition" FROM parts p JOIN regions r ON r.contig = p.contig AND r."start" < p."end" AND r."end" > p."start"),
n AS (SELECT rid, count(*) AS copies FROM c GROUP BY rid) SELECT copies, count(*) AS regions FROM n GROUP BY copies""".replace("n AS (SELECT rid", "nn AS (SELECT rid").replace("FROM n GROUP BY copies", "FROM nn GROUP BY copies"))
def partition_copy_histogram(spark, d):
    regions = views.regions(spark, d)
    return P.partition_stats(P.partition_copies(regions, P.uniform(_spans(regions), 16)))[0]


@query(f"""WITH {R}, {SPANS}, {UNIFORM.format(p=16)} SELECT "partition", CAST(sum("end" - "start") AS BIGINT) AS positions, count(DISTINCT contig) AS contigs, count(*) AS ranges, max("end" - "start") AS longest FROM parts GROUP BY "partition" """)
def partition_loci_stats(spark, d):
    return P.loci_stats(P.uniform(_spans(views.regions(spark, d)), 16))


@query(f"""WITH {R}, {coverage_sql()} SELECT contig, locus, depth FROM cov QUALIFY depth > coalesce(max(depth) OVER (PARTITION BY contig, locus // 256 ORDER BY locus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)""")
def window_fold(spark, d):
    def deeper(most, row):
        return max(most, row["depth"]), [(row["contig"], row["locus"], row["depth"])] if row["depth"] > most else []

    return I.window_fold(I.coverage(views.regions(spark, d)), 0, deeper, "contig string, locus long, depth long", span=256)


# reads

@query(f"""WITH {R} SELECT sample_id, count(*) AS n_all, count(*) FILTER (WHERE is_mapped) AS n_mapped, count(*) FILTER (WHERE NOT is_duplicate AND NOT failed_qc AND is_paired) AS n_default,
    count(*) FILTER (WHERE NOT is_duplicate AND NOT failed_qc AND is_paired AND is_mapped AND mapq >= 30) AS n_strict, count(*) FILTER (WHERE NOT is_mapped OR mapq >= 30) AS n_mapq FROM regions GROUP BY sample_id""")
def read_filters(spark, d):
    loose = {"include_duplicates": True, "include_failed_qc": True, "include_single_end": True}
    return views.regions(spark, d).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(ReadFilter(**loose, only_mapped=True).predicate()).alias("n_mapped"), F.count_if(ReadFilter().predicate()).alias("n_default"),
        F.count_if(ReadFilter(only_mapped=True, min_mapq=30).predicate()).alias("n_strict"), F.count_if(ReadFilter(**loose, min_mapq=30).predicate()).alias("n_mapq"),
    )


@query("""SELECT event_id, list_sum(q) AS total, q[1] AS first, len(q) AS n FROM (SELECT event_id, list_transform(string_split(props, ''), lambda c: ord(c) - 33) AS q FROM events)""".replace("list_sum(q)", "CAST(list_sum(q) AS BIGINT)").replace("q[1] AS first", "CAST(q[1] AS INTEGER) AS first").replace("len(q) AS n", "CAST(len(q) AS INTEGER) AS n"))
def base_quality_decode(spark, d):
    q = views.table(spark, d, "events").select("event_id", S.base_qualities(F.col("props"), F.length("props")).alias("q"))
    return q.select("event_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("q", 1).alias("first"), F.size("q").alias("n"))


@query(f"""WITH {SEQ_B}, {views.READS}, o AS (SELECT read_id, cigar, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1) AS n, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) AS c FROM reads)
SELECT read_id, CAST(list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN c[i] IN ('M', 'D', 'N', '=', 'X') THEN CAST(n[i] AS INTEGER) ELSE 0 END)) AS INTEGER) AS reference_length,
CAST(list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN c[i] IN ('M', 'I', 'S', '=', 'X') THEN CAST(n[i] AS INTEGER) ELSE 0 END)) AS INTEGER) AS read_length,
CASE WHEN c[1] IN ('S', 'H') THEN CAST(n[1] AS INTEGER) ELSE 0 END AS clipped FROM o""")
def cigar_parse(spark, d):
    ops = S.cigar_elements(F.col("cigar"))
    return views.reads(spark, d).select("read_id", S.reference_length(ops).alias("reference_length"), S.read_length(ops).alias("read_length"), S.clipped_before(ops).alias("clipped"))


# sequences

@query(f"WITH {SEQ_B} SELECT id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS reverse_complement, regexp_matches(sequence, '^[ACGT]*$') AS standard FROM seqs")
def reverse_complement(spark, d):
    s = views.seqs(spark, d, "benchmark", "item_id")
    return s.select("id", S.reverse_complement(F.col("sequence")).alias("reverse_complement"), S.is_standard(F.col("sequence")).alias("standard"))


KMERS = "kmers AS (SELECT substr(sequence, CAST(i AS INTEGER), 8) AS kmer, count(*) AS n FROM seqs, unnest(range(1, greatest(length(sequence) - 6, 2))) AS u(i) WHERE sequence <> '' GROUP BY 1)"


@query(f"WITH {SEQ_D}, {KMERS} SELECT * FROM kmers WHERE n >= 3")
def kmer_count(spark, d):
    return K.kmer_counts(views.seqs(spark, d, "documents", "doc_id"), 8, 3)


@query(f"WITH {SEQ_B}, {KMERS} SELECT a.kmer AS source, b.kmer AS target FROM kmers a JOIN kmers b ON substr(a.kmer, 2) = substr(b.kmer, 1, 7) WHERE length(a.kmer) = 8 AND length(b.kmer) = 8")
def kmer_edges(spark, d):
    return K.kmer_edges(K.kmer_counts(views.seqs(spark, d, "benchmark", "item_id"), 8), 8)


@query(f"""WITH {SEQ_B}, {KMERS}, e AS (SELECT a.kmer AS s, b.kmer AS t FROM kmers a JOIN kmers b ON substr(a.kmer, 2) = substr(b.kmer, 1, 7) WHERE length(a.kmer) = 8 AND length(b.kmer) = 8)
SELECT parents, children, count(*) AS nodes FROM (SELECT kmer, (SELECT count(*) FROM e WHERE t = kmer) AS parents, (SELECT count(*) FROM e WHERE s = kmer) AS children FROM kmers) GROUP BY 1, 2""")
def kmer_degrees(spark, d):
    kmers = K.kmer_counts(views.seqs(spark, d, "benchmark", "item_id"), 8)
    return K.sources_and_sinks(kmers, K.kmer_edges(kmers, 8)).groupBy("parents", "children").agg(F.count(F.lit(1)).alias("nodes"))


# pileups

@query(f"WITH {PILE} SELECT read_id, contig, locus, aln_type, \"ref\", alt, CAST(qual AS INTEGER) AS qual, read_pos FROM pile")
def pileup_elements(spark, d):
    return views.pile(spark, d).select("read_id", "contig", "locus", "aln_type", "ref", "alt", "qual", "read_pos")


@query(f"WITH {PILE} SELECT sample_id, contig, locus, count(*) AS depth, count(*) FILTER (WHERE is_positive_strand) AS positive_depth, count(*) FILTER (WHERE \"ref\" = alt) AS reference_depth, array_to_string(list_sort(list(DISTINCT \"ref\" || '>' || alt)), ',') AS alleles FROM pile GROUP BY ALL")
def pileup_depth(spark, d):
    return PU.pileup_depths(views.pile(spark, d)).withColumn("alleles", F.array_join("alleles", ","))


@query(f"WITH {PILE} SELECT sample_id, contig, locus, \"ref\", alt, count(*) AS n, count(*) FILTER (WHERE is_positive_strand) AS n_positive FROM pile GROUP BY ALL")
def allele_counts(spark, d):
    return PU.allele_counts(views.pile(spark, d))


@query(f"""WITH {PILE}, m AS (SELECT sample_id, read_id, count(*) FILTER (WHERE aln_type = 'Mismatch') AS mismatches FROM pile GROUP BY ALL)
SELECT sample_id, mismatches, count(*) AS n_reads FROM m GROUP BY ALL""")
def read_mismatches(spark, d):
    return PU.mismatches_per_read(views.pile(spark, d)).groupBy("sample_id", "mismatches").agg(F.count(F.lit(1)).alias("n_reads"))


VAF = f"{PILE}, vafs AS (SELECT sample_id, contig, locus, CAST(CAST(count(*) - count(*) FILTER (WHERE \"ref\" = alt) AS FLOAT) / CAST(count(*) AS FLOAT) AS FLOAT) AS vaf, count(*) AS depth FROM pile GROUP BY sample_id, contig, locus HAVING count(*) FILTER (WHERE \"ref\" = alt) <> count(*))"


@query(f"WITH {VAF} SELECT sample_id, contig, locus, vaf FROM vafs WHERE depth >= 5")
def vaf_loci(spark, d):
    return PU.vaf_loci(views.pile(spark, d), min_depth=5)


@query(f"""WITH {VAF}, b AS (SELECT sample_id, CAST(trunc(vaf * CAST(100 AS FLOAT)) AS INTEGER) AS p FROM vafs)
SELECT sample_id, p - p % 5 AS bin, least(p - p % 5 + 5, 100) AS bin_end, count(*) AS num_loci FROM b GROUP BY 1, 2, 3""")
def vaf_histogram(spark, d):
    return PU.vaf_histogram(PU.vaf_loci(views.pile(spark, d)), 20)


@query()
def vaf_mixture(spark, d):
    from .vaf import gaussian_mixture

    return gaussian_mixture(PU.vaf_loci(views.pile(spark, d)), 3)


@query(f"""WITH {VAF}, s AS (SELECT sample_id, CAST(vaf AS DOUBLE) AS vaf, row_number() OVER (PARTITION BY sample_id ORDER BY vaf) AS i, count(*) OVER (PARTITION BY sample_id) AS n FROM vafs),
q AS (SELECT sample_id, n, p, greatest(1, least(n, p * (n + 1))) AS pos FROM (SELECT DISTINCT sample_id, n FROM s), (VALUES (0.25), (0.5), (0.75)) v(p)),
x AS (SELECT q.sample_id, p, round(a.vaf + (pos - floor(pos)) * (b.vaf - a.vaf), 6) AS v FROM q JOIN s a ON a.sample_id = q.sample_id AND a.i = floor(pos) JOIN s b ON b.sample_id = q.sample_id AND b.i = least(floor(pos) + 1, q.n))
SELECT sample_id, max(n) AS n, max(lo) AS "min", max(hi) AS "max", max(mid) AS mean, max(CASE WHEN p = 0.25 THEN v END) AS p25, max(CASE WHEN p = 0.5 THEN v END) AS p50, max(CASE WHEN p = 0.75 THEN v END) AS p75
FROM x JOIN (SELECT sample_id, count(*) AS n, round(min(vaf), 6) AS lo, round(max(vaf), 6) AS hi, round(avg(vaf), 6) AS mid FROM s GROUP BY sample_id) USING (sample_id) GROUP BY sample_id""")
def vaf_statistics(spark, d):
    from .vaf import statistics

    s = statistics(PU.vaf_loci(views.pile(spark, d)))
    return s.select("sample_id", "n", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "p25", "p50", "p75")))


GENO = f"""{PILE}, alleles AS (SELECT DISTINCT sample_id, contig, locus, "ref", alt FROM pile WHERE regexp_matches(alt, '^[ACGT]*$')),
geno AS (SELECT a.sample_id, a.contig, a.locus, a."ref" AS r1, a.alt AS a1, b."ref" AS r2, b.alt AS a2, a."ref" || '>' || a.alt || '/' || b."ref" || '>' || b.alt AS genotype_id
         FROM alleles a JOIN alleles b ON a.sample_id = b.sample_id AND a.contig = b.contig AND a.locus = b.locus AND (a."ref", a.alt) <= (b."ref", b.alt)),
lik AS (SELECT sample_id, contig, locus, genotype_id, sum(ln(0.5 * CASE WHEN p."ref" = r1 AND p.alt = a1 THEN 1 - pow(10.0, -p.qual / 10.0) ELSE pow(10.0, -p.qual / 10.0) END
            + 0.5 * CASE WHEN p."ref" = r2 AND p.alt = a2 THEN 1 - pow(10.0, -p.qual / 10.0) ELSE pow(10.0, -p.qual / 10.0) END)) AS ll FROM geno JOIN pile p USING (sample_id, contig, locus) GROUP BY ALL)"""


@query(f"WITH {GENO} SELECT sample_id, contig, locus, genotype_id, round(ll, 6) AS ln_likelihood FROM lik")
def genotype_likelihood(spark, d):
    return PU.diploid_likelihoods(views.pile(spark, d)).withColumn("ln_likelihood", F.round("ln_likelihood", 6))


@query(f"WITH {GENO}, b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, contig, locus ORDER BY round(ll, 6) DESC, genotype_id) AS i FROM lik) SELECT sample_id, contig, locus, genotype_id FROM b WHERE i = 1")
def best_genotype(spark, d):
    lik = PU.diploid_likelihoods(views.pile(spark, d))
    w = W.partitionBy(*PU.SITE).orderBy(F.desc(F.round("ln_likelihood", 6)), "genotype_id")
    return lik.withColumn("i", F.row_number().over(w)).filter("i = 1").select(*PU.SITE, "genotype_id")


@query(f"""WITH {PILE}, m AS (SELECT sample_id, read_id, count(*) FILTER (WHERE aln_type = 'Mismatch') AS mm FROM pile GROUP BY ALL),
e AS (SELECT sample_id, contig, locus, "ref", alt, count(*) AS allele_depth, count(*) FILTER (WHERE is_positive_strand) AS allele_forward, round(avg(mapq), 6) AS mean_mapq, quantile_cont(mapq, 0.5) AS median_mapq,
      round(avg(qual), 6) AS mean_base_quality, quantile_cont(CAST(mm AS DOUBLE), 0.5) AS median_mismatches FROM pile JOIN m USING (sample_id, read_id) GROUP BY ALL)
SELECT *, CAST(sum(allele_depth) OVER (PARTITION BY sample_id, contig, locus) AS BIGINT) AS depth FROM e""".replace("quantile_cont(mapq, 0.5)", "quantile_cont(CAST(mapq AS DOUBLE), 0.5)"))
def allele_evidence(spark, d):
    e = PU.allele_evidence(views.pile(spark, d))
    return e.select(*PU.SITE, "ref", "alt", "allele_depth", "allele_forward", F.round("mean_mapq", 6).alias("mean_mapq"), "median_mapq", F.round("mean_base_quality", 6).alias("mean_base_quality"), "median_mismatches", "depth")


@query(f"""WITH {PILE}, c AS (SELECT sample_id, contig, locus, "ref", alt, count(*) AS n FROM pile GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, contig, locus ORDER BY n DESC, "ref", alt) AS rank FROM c) SELECT * FROM r WHERE rank <= 2""")
def topk_alleles(spark, d):
    w = W.partitionBy(*PU.SITE).orderBy(F.desc("n"), "ref", "alt")
    return PU.allele_counts(views.pile(spark, d)).select(*PU.SITE, "ref", "alt", "n", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 2")


# tumor/normal calls: sample 0 is the tumor

P0 = "CASE WHEN {w} THEN 1 - pow(10.0, -qual / 10.0) ELSE pow(10.0, -qual / 10.0) END"
CALLS = f"""{PILE}, n AS (SELECT contig, locus, count(*) FILTER (WHERE sample_id = 0) AS td, count(*) FILTER (WHERE sample_id = 1) AS nd, count(*) FILTER (WHERE sample_id = 1 AND "ref" <> alt) AS na FROM pile GROUP BY ALL),
tops AS (SELECT contig, locus, "ref" AS br, alt AS ba, count(*) AS bn FROM pile WHERE sample_id = 0 AND "ref" <> alt GROUP BY contig, locus, "ref", alt
         QUALIFY row_number() OVER (PARTITION BY contig, locus ORDER BY count(*) DESC, "ref", alt) = 1),
sites AS (SELECT *, greatest(0.03, bn / CAST(td AS DOUBLE)) AS f FROM tops JOIN n USING (contig, locus) WHERE td > 0 AND nd > 0 AND na <= 40 AND ba <> ''),
calls AS (SELECT contig, locus, br, ba, td, nd, bn,
    sum(CASE WHEN sample_id = 0 THEN ln((1 - f) * {P0.format(w='"ref" = alt')} + f * {P0.format(w='"ref" = br AND alt = ba')}) - ln({P0.format(w='"ref" = alt')}) END) AS tumor_lod,
    sum(CASE WHEN sample_id = 1 THEN ln({P0.format(w='"ref" = alt')}) - ln(0.5 * {P0.format(w='"ref" = alt')} + 0.5 * {P0.format(w='"ref" = br AND alt = ba')}) END) AS normal_lod,
    avg(CASE WHEN sample_id = 0 THEN mapq END) AS tm, avg(CASE WHEN sample_id = 1 THEN mapq END) AS nm
    FROM sites JOIN pile USING (contig, locus) GROUP BY ALL HAVING tumor_lod > 2 AND normal_lod > 1)"""
CALL_COLUMNS = 'contig, locus AS "start", locus + 1 AS "end", br AS "ref", ba AS alt, td AS tumor_depth, nd AS normal_depth, bn AS tumor_allele_depth, round(tumor_lod, 5) AS tumor_lod, round(normal_lod, 5) AS normal_lod'


def _calls(spark, d) -> DataFrame:
    pile = views.pile(spark, d)
    return somatic_standard(pile.filter("sample_id = 0"), pile.filter("sample_id = 1"), tumor_odds=2, normal_odds=1, max_normal_alts=40)


def _call_columns(calls: DataFrame) -> DataFrame:
    return calls.select("contig", "start", "end", "ref", "alt", "tumor_depth", "normal_depth", "tumor_allele_depth", F.round("tumor_lod", 5).alias("tumor_lod"), F.round("normal_lod", 5).alias("normal_lod"))


@query(f"WITH {CALLS} SELECT {CALL_COLUMNS} FROM calls")
def somatic_standard_calls(spark, d):
    return _call_columns(_calls(spark, d))


@query(f"WITH {CALLS} SELECT {CALL_COLUMNS} FROM calls WHERE td >= 5 AND td < 2147483647 AND nd >= 5 AND bn / CAST(td AS DOUBLE) * 100 > 4 AND tm >= 20 AND nm >= 20")
def somatic_filters(spark, d):
    return _call_columns(SomaticFilter(min_vaf=4)(_calls(spark, d)))


KNOWN = "known AS (SELECT contig, CAST(40 AS BIGINT) AS \"start\", substr(sequence, 41, 1) AS \"ref\", translate(substr(sequence, 41, 1), 'ACGT', 'CGTA') AS alt, id AS rs_id FROM (SELECT *, 'b' || id AS contig FROM seqs))"


@query(f"WITH {CALLS}, {KNOWN} SELECT c.contig, c.locus AS \"start\", c.br AS \"ref\", c.ba AS alt, CAST(k.rs_id AS BIGINT) AS rs_id FROM calls c LEFT JOIN known k ON k.contig = c.contig AND k.\"start\" = c.locus AND k.\"ref\" = c.br AND k.alt = c.ba")
def dbsnp_left_join(spark, d):
    s = views.seqs(spark, d, "benchmark", "item_id")
    base = F.substring("sequence", 41, 1)
    known = s.select(F.format_string("b%d", "id").alias("contig"), F.lit(40).cast("long").alias("start"), base.alias("ref"), F.translate(base, "ACGT", "CGTA").alias("alt"), F.array(F.format_string("rs%d", "id")).alias("names"), F.lit(True).alias("db_snp"))
    return annotate_known(_calls(spark, d), known).select("contig", "start", "ref", "alt", "rs_id")


COMPARE = f"""WITH {CALLS}, {KNOWN}, e AS (SELECT DISTINCT contig, "start", "ref", alt FROM known), c AS (SELECT contig, locus AS "start", br AS "ref", ba AS alt FROM calls),
j AS (SELECT CASE WHEN e."start" IS NULL THEN 'only_called' WHEN c."start" IS NULL THEN 'only_expected' WHEN e."ref" = c."ref" AND e.alt = c.alt THEN 'exact' ELSE 'partial' END AS outcome
      FROM e FULL JOIN c ON e.contig = c.contig AND e."start" = c."start")"""


@query(f"{COMPARE} SELECT outcome, count(*) AS n FROM j GROUP BY outcome")
def variant_compare(spark, d):
    from .concordance import compare, counts

    return counts(compare(_expected(spark, d), _calls(spark, d)))


@query(f"{COMPARE}, totals AS (SELECT count(*) FILTER (WHERE outcome = 'exact') AS tp, count(*) FILTER (WHERE outcome IN ('only_called', 'partial')) AS fp, count(*) FILTER (WHERE outcome IN ('only_expected', 'partial')) AS fn FROM j) SELECT round(tp / CAST(tp + fp AS DOUBLE), 6) AS \"precision\", round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM totals")
def precision_recall(spark, d):
    from .concordance import compare, scores

    s = scores(compare(_expected(spark, d), _calls(spark, d)))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


def _expected(spark, d) -> DataFrame:
    s = views.seqs(spark, d, "benchmark", "item_id")
    base = F.substring("sequence", 41, 1)
    return s.select(F.format_string("b%d", "id").alias("contig"), F.lit(40).cast("long").alias("start"), base.alias("ref"), F.translate(base, "ACGT", "CGTA").alias("alt")).distinct()


# joint calls: sample 1 is normal DNA, sample 0 tumor DNA

@query(f"""WITH {PILE}, s AS (SELECT contig, locus, count(*) FILTER (WHERE "ref" <> alt) AS a, count(*) FILTER (WHERE "ref" <> alt AND is_positive_strand) AS af, count(*) FILTER (WHERE "ref" = alt) AS r, count(*) FILTER (WHERE "ref" = alt AND is_positive_strand) AS rf FROM pile WHERE aln_type <> 'Clipped' GROUP BY ALL)
SELECT contig, locus, round(10 * ((lgamma(a + 1) - lgamma(af + 1) - lgamma(a - af + 1)) + (lgamma(r + 1) - lgamma(rf + 1) - lgamma(r - rf + 1)) - (lgamma(a + r + 1) - lgamma(af + rf + 1) - lgamma(a + r - af - rf + 1))) / ln(10.0), 5) AS strand_bias FROM s WHERE a > 0""")
def strand_bias(spark, d):
    x = views.pile(spark, d).filter("aln_type <> 'Clipped'").groupBy("contig", "locus").agg(
        F.count_if(F.expr("ref <> alt")).alias("a"), F.count_if(F.expr("ref <> alt and is_positive_strand")).alias("af"),
        F.count_if(F.expr("ref = alt")).alias("r"), F.count_if(F.expr("ref = alt and is_positive_strand")).alias("rf"),
    ).filter("a > 0")
    return x.select("contig", "locus", F.round(S.strand_bias_phred(F.col("a"), F.col("af"), F.col("r"), F.col("rf")), 5).alias("strand_bias"))


@query(f"WITH {PILE}, s AS (SELECT contig, locus, count(*) AS total, count(*) FILTER (WHERE \"ref\" = alt) AS same FROM pile WHERE sample_id = 1 AND aln_type <> 'Clipped' GROUP BY ALL) SELECT contig, locus, total < 30 OR (total - same) * 100.0 / total > 3 AS insufficient FROM s")
def insufficient_normal_sites(spark, d):
    s = views.pile(spark, d).filter("sample_id = 1 and aln_type <> 'Clipped'").groupBy("contig", "locus").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("ref = alt")).alias("same"))
    return s.select("contig", "locus", insufficient_normal(F.col("total"), F.col("same")).alias("insufficient"))


@query(joint.candidates_sql(PILE))
def candidate_alleles(spark, d):
    return joint.candidate_alleles(views.read_pile(spark, d))


@query(joint.calls_sql(PILE, germline=True))
def joint_germline(spark, d):
    return joint.calls_for_query(views.read_pile(spark, d), germline=True)


@query(joint.calls_sql(PILE, germline=False))
def joint_somatic(spark, d):
    return joint.calls_for_query(views.read_pile(spark, d), germline=False)


# kernels

@query()
def affine_alignment(spark, d):
    from ..operators.assembly import align_table

    s = views.seqs(spark, d, "benchmark", "item_id").filter("sequence <> ''")
    bent = F.concat(F.substring("sequence", 5, 20), F.expr("substring(sequence, 28)"))
    # a few long sequences in one file are work for many tasks
    return align_table(s.select("id", bent.alias("sequence"), F.col("sequence").alias("reference")).repartition(64, "id"))


@query()
def debruijn_paths(spark, d):
    from ..operators.assembly import assemble_windows
    from .germline import tiles

    ref = views.reference(spark, d)
    loci = ref.select("contig", F.lit(0).cast("long").alias("start"), F.col("contig_length").alias("end"))
    # a window is assembled where reads hold its first and last k-mers, so each base is in several; a variant comes once
    found = assemble_windows(views.reads(spark, d), tiles(ref, loci, 11, 60, step=10), k=11, min_occurrence=2, read_length=views.READ)
    return found.groupBy("contig", "start", "ref", "alt").agg(F.max("n_haplotypes").alias("n_haplotypes"))


@query()
def germline_assembly(spark, d):
    from . import germline

    # reads of READ bases hold no k-mers of the command's default
    reads = views.reads(spark, d).withColumn("end", F.col("start") + views.READ)
    return germline.germline_calls(reads, views.pile(spark, d), views.reference(spark, d), k=11, half_window=14, min_occurrence=2)


RIGHT = "(1 - pow(10.0, -p.qual / 10.0)) * (1 - pow(10.0, -p.mapq / 10.0))"


@query(f"""WITH {GENO.replace("1 - pow(10.0, -p.qual / 10.0)", RIGHT).replace("ELSE pow(10.0, -p.qual / 10.0)", f"ELSE 1 - {RIGHT}")},
varied AS (SELECT sample_id, contig, locus FROM pile GROUP BY ALL HAVING count(*) FILTER (WHERE "ref" <> alt) >= 2),
whole AS (SELECT *, ll - ln(sum(exp(ll - top)) OVER w) - top AS nl FROM (SELECT *, max(ll) OVER (PARTITION BY sample_id, contig, locus) AS top FROM lik JOIN varied USING (sample_id, contig, locus)) WINDOW w AS (PARTITION BY sample_id, contig, locus)),
best AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY sample_id, contig, locus ORDER BY round(nl, 9) DESC, genotype_id) = 1),
named AS (SELECT DISTINCT sample_id, contig, locus, genotype_id, r1 = a1 AND r2 = a2 AS plain FROM geno)
SELECT sample_id, contig, locus, genotype_id, least(phred, 90) AS phred FROM (SELECT *, CAST(trunc(-10 * log10(1 - least(exp(nl), 1 - 1e-16))) AS INTEGER) AS phred FROM best JOIN named USING (sample_id, contig, locus, genotype_id) WHERE NOT plain) WHERE phred > 0""")
def germline_shortcut(spark, d):
    from .germline import germline_shortcut

    # beyond 90 the last bits of a sum decide, which go with its order
    return germline_shortcut(views.pile(spark, d)).withColumn("phred", F.least("phred", F.lit(90)))


# further rows of the inventory

@query(f"WITH {R}, {coverage_sql()} SELECT contig, \"start\", \"end\" FROM (SELECT contig, greatest(\"start\" - 1, 0) AS \"start\", \"end\" - 1 AS \"end\" FROM regions) WHERE \"start\" < \"end\"")
def shifted_loci(spark, d):
    return I.shift_loci(views.regions(spark, d))


@query(f'WITH {R} SELECT contig, max("end") AS length FROM regions GROUP BY contig')
def contig_dictionary(spark, d):
    from ..sources.sam import merge_contigs

    lengths = I.contig_lengths(views.regions(spark, d))
    return merge_contigs(lengths, lengths)


@query(f"WITH {R} SELECT sample_id, contig, count(*) AS n FROM (SELECT contig, 0 AS sample_id FROM regions WHERE is_mapped UNION ALL SELECT contig, 1 FROM regions WHERE NOT is_mapped) GROUP BY ALL")
def sample_union(spark, d):
    r = views.regions(spark, d)
    both = I.union_samples(r.filter("is_mapped").select("contig"), r.filter("not is_mapped").select("contig"))
    return both.groupBy("sample_id", "contig").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQ_B}, {KMERS} SELECT * FROM kmers WHERE n >= 2")
def kmer_prune(spark, d):
    return K.prune(K.kmer_counts(views.seqs(spark, d, "benchmark", "item_id"), 8), 2)


@query(f"""WITH {SEQ_B}, {views.READS}, w AS (SELECT contig, unnest(range(0, contig_length - 9, 5)) AS s FROM reference)
SELECT w.contig, s AS "start", s + 10 AS "end", substr(sequence, CAST(s - "start" + 1 AS INTEGER), 10) AS sequence, count(*) AS n
FROM w JOIN reads r ON r.contig = w.contig AND r."start" <= s AND r."start" + {views.READ} >= s + 10 WHERE cigar = '20M' GROUP BY ALL HAVING count(*) >= 2""")
def consensus_kmers(spark, d):
    spots = views.reference(spark, d).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("contig_length") - 10, F.lit(5).cast("long"))).alias("start"))
    return K.consensus_sequences(views.reads(spark, d).withColumn("end", F.col("start") + views.READ), spots.withColumn("end", F.col("start") + 10), 2)


EVIDENCE_SQL = f"""{PILE}, e AS (SELECT sample_id, contig, locus, "ref", alt, count(*) AS allele_depth, avg(mapq) AS mean_mapq, avg(qual) AS mean_base_quality FROM pile GROUP BY ALL),
w AS (SELECT *, CAST(sum(allele_depth) OVER (PARTITION BY sample_id, contig, locus) AS BIGINT) AS depth FROM e)"""


@query(f"WITH {EVIDENCE_SQL} SELECT sample_id, contig, locus, \"ref\", alt, allele_depth, depth FROM w WHERE \"ref\" <> alt AND depth >= 4 AND depth < 90 AND allele_depth >= 2 AND mean_mapq > 20 AND mean_base_quality > 15")
def germline_filters(spark, d):
    from ..operators.filters import GermlineFilter

    e = PU.allele_evidence(views.pile(spark, d)).filter(F.col("ref") != F.col("alt")).withColumn("phred", F.lit(99))
    keep = GermlineFilter(min_depth=4, max_depth=90, min_alt_depth=2, min_mean_mapq=20, min_mean_base_quality=15)
    return keep(e).select(*PU.SITE, "ref", "alt", "allele_depth", "depth")


@query(f"WITH {CALLS}, t AS (SELECT *, count(*) OVER (PARTITION BY contig) AS n FROM calls) SELECT contig, locus AS \"start\", n > 8 AS too_many FROM t")
def too_many_calls_by_contig(spark, d):
    from ..operators.filters import too_many_calls

    calls = _calls(spark, d)
    marked = too_many_calls(calls.withColumn("locus", F.lit(0)), 8)
    return marked.select("contig", "start", "too_many")


@query(f"WITH {CALLS} SELECT contig || chr(9) || (locus + 1) || chr(9) || '.' || chr(9) || br || chr(9) || ba || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'GT:AD:DP:GQ' || chr(9) || '0/1:' || (td - bn) || ',' || bn || ':' || td || ':99' AS line FROM calls")
def vcf_lines(spark, d):
    from ..sources.sinks import genotype_records, vcf_line

    return genotype_records(_calls(spark, d)).select(vcf_line().alias("line"))


@query(f"""WITH {PILE}, tops AS (SELECT sample_id, contig, locus, "ref" AS r, alt AS a FROM pile WHERE aln_type = 'Mismatch' GROUP BY sample_id, contig, locus, "ref", alt QUALIFY row_number() OVER (PARTITION BY sample_id, contig, locus ORDER BY count(*) DESC, "ref", alt) = 1),
e AS (SELECT sample_id, contig, locus, "ref" = r AND alt = r AS same, "ref" = r AND alt = a AS other, 1 - pow(10.0, -qual / 10.0) AS pc FROM pile JOIN tops USING (sample_id, contig, locus)),
s AS (SELECT sample_id, contig, locus, sum(ln(CASE WHEN same THEN pc ELSE 1 - pc END)) AS hom, sum(ln(0.5 * CASE WHEN same THEN pc ELSE 1 - pc END + 0.5 * CASE WHEN other THEN pc ELSE 1 - pc END)) AS het FROM e GROUP BY ALL)
SELECT sample_id, contig, locus, 'hom' AS genotype_id, round(1 / (1 + exp(greatest(-60, least(60, het - hom)))), 6) AS probability FROM s
UNION ALL SELECT sample_id, contig, locus, 'het', round(1 / (1 + exp(greatest(-60, least(60, hom - het)))), 6) FROM s""")
def two_genotype_probability(spark, d):
    pile = views.pile(spark, d)
    w = W.partitionBy(*PU.SITE).orderBy(F.desc("n"), "ref", "alt")
    tops = PU.allele_counts(pile.filter("aln_type = 'Mismatch'")).withColumn("i", F.row_number().over(w)).filter("i = 1")
    part = lambda name, alt, share: F.struct(F.lit(name).alias("genotype_id"), F.col("ref"), F.col(alt).alias("alt"), F.lit(share).alias("fraction"))
    mixes = tops.select(*PU.SITE, F.explode(F.array(part("hom", "ref", 1.0), part("het", "ref", 0.5), part("het", "alt", 0.5))).alias("g")).select(*PU.SITE, "g.*")
    p = PU.two_genotype_probabilities(pile, mixes)
    return p.select(*PU.SITE, "genotype_id", F.round("probability", 6).alias("probability"))


@query(f"""WITH {SEQ_B}, {views.READS}
SELECT read_id, translate(sequence, 'ACGT', 'TGCA') AS complement, round(1 - pow(10.0, -mapq / 10.0), 8) AS alignment_likelihood, mapq AS phred,
    CASE WHEN is_positive_strand THEN {views.READ} - 3 ELSE 3 END AS to_sequencing_end FROM reads""")
def read_scalars(spark, d):
    r = views.reads(spark, d)
    mapq = F.col("mapq").cast("double")
    # phreds are cut to whole numbers: the middle of a step comes back as the step
    ends = S.distance_from_sequencing_end(F.col("start") + 3, F.col("start"), F.col("start") + views.READ, F.col("is_positive_strand"))
    return r.select("read_id", S.complement(F.col("sequence")).alias("complement"), F.round(S.phred_to_success(mapq), 8).alias("alignment_likelihood"), S.success_to_phred(S.phred_to_success(mapq + 0.5)).alias("phred"), ends.cast("int").alias("to_sequencing_end"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS p FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT *, len(list_filter(range(1, len(p) + 1), lambda i: 60 - coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0) > 6)) AS k FROM w)
SELECT item_id, array_to_string(p[1:k], ',') || CASE WHEN k < len(p) THEN ', [...]' ELSE '' END AS line FROM n""")
def truncated_strings(spark, d):
    t = views.table(spark, d, "benchmark").filter("text is not null")
    return t.select("item_id", S.truncated_join(F.split("text", " "), 60).alias("line"))


@query(f"""WITH {PILE}, {joint.CANDIDATES} SELECT c.contig, CASE WHEN k THEN c."start" - 4 ELSE c."start" END AS "start", CASE WHEN k THEN c."end" + 2 ELSE c."end" END AS "end",
    CASE WHEN k THEN l || c."ref" || r ELSE c."ref" END AS "ref", CASE WHEN k THEN l || c.alt || r ELSE c.alt END AS alt
FROM (SELECT c.*, c."start" >= 4 AND c."end" + 2 <= contig_length AS k, substr(sequence, CAST(c."start" - 3 AS INTEGER), 4) AS l, substr(sequence, CAST(c."end" + 1 AS INTEGER), 2) AS r FROM cands c JOIN reference f ON f.contig = c.contig) c""")
def allele_context(spark, d):
    alleles = joint.candidate_alleles(views.read_pile(spark, d)).select(*joint.SITE)
    return joint.change_context(alleles, views.reference(spark, d), 4, 2)


@query(joint.best_sql(PILE))
def joint_best_alleles(spark, d):
    pile = views.read_pile(spark, d)
    samples = spark.createDataFrame([(1, "normal", "dna"), (0, "tumor", "dna")], "sample_id int, tissue string, analyte string")
    calls = joint.joint_calls(joint.sample_evidence(joint.read_support(pile, joint.candidate_alleles(pile)), samples))
    return joint.choose_alleles(calls).select(*joint.SITE, "is_germline", "is_somatic", F.round("posterior", 4).alias("posterior"))


FORCED = """wanted AS (SELECT contig, locus AS "start" FROM solid WHERE locus % 25 = 0 GROUP BY ALL), totals AS (
    SELECT contig, "start", "end", "ref", alt, count(*) AS n FROM runs WHERE regexp_matches("ref", '^[ACGT]+$') AND regexp_matches(alt, '^[ACGT]+$') AND "ref" <> alt GROUP BY ALL
), bare AS (SELECT * FROM wanted ANTI JOIN cands USING (contig, "start")), most AS (
    SELECT t.* FROM totals t SEMI JOIN bare USING (contig, "start") QUALIFY row_number() OVER (PARTITION BY contig, "start" ORDER BY n DESC, "end", "ref", alt) = 1
), blank AS (SELECT b.contig, b."start", b."start" + 1 AS "end", min(substr(s."ref", 1, 1)) AS "ref", 'N' AS alt, CAST(0 AS BIGINT) AS n FROM (SELECT * FROM bare ANTI JOIN most USING (contig, "start")) b JOIN solid s ON s.contig = b.contig AND s.locus = b."start" GROUP BY ALL)"""


@query(f"""WITH {PILE}, {joint.CANDIDATES}, {FORCED} SELECT * FROM (SELECT contig, "start", "end", "ref", alt, n FROM cands UNION ALL SELECT * FROM most UNION ALL SELECT * FROM blank)""")
def forced_alleles(spark, d):
    pile = views.pile(spark, d)
    sites = pile.filter("aln_type <> 'Clipped' and locus % 25 = 0").select("contig", F.col("locus").alias("start"))
    return joint.fallback_alleles(pile, sites, joint.candidate_alleles(pile))


@query(f"""WITH {PILE}, {joint.CANDIDATES} SELECT sample_id, contig, "start", "end", "ref", alt, count(*) AS n_reads FROM runs GROUP BY ALL""")
def variant_runs(spark, d):
    return joint.variant_runs(views.read_pile(spark, d)).groupBy("sample_id", "contig", "start", "end", "ref", "alt").agg(F.count(F.lit(1)).alias("n_reads"))


@query(f"""WITH {PILE}, {joint.CANDIDATES}, {joint.EVIDENCE} SELECT contig, "start", "end", r AS "ref", a AS alt, sample_id, depth, alt_depth, round(vaf, 6) AS vaf, round(ll_ref, 4) + 0.0 AS ll_ref, round(ll_het, 4) + 0.0 AS ll_het, round(ll_hom, 4) + 0.0 AS ll_hom, round(ll_mix, 4) + 0.0 AS ll_mix FROM ev""")
def sample_evidence(spark, d):
    pile = views.read_pile(spark, d)
    samples = spark.createDataFrame([(1, "normal", "dna"), (0, "tumor", "dna")], "sample_id int, tissue string, analyte string")
    e = joint.sample_evidence(joint.read_support(pile, joint.candidate_alleles(pile)), samples).filter("sample_id >= 0")
    return e.select(*joint.SITE, "sample_id", "depth", "alt_depth", F.round("vaf", 6).alias("vaf"), *(F.round(c, 4).alias(c) for c in ("ll_ref", "ll_het", "ll_hom", "ll_mix")))


@query(f"""WITH {R}, p AS (SELECT contig, sum("end" - "start") AS bases, count(*) AS n, count(*) FILTER (WHERE is_positive_strand) AS forward FROM regions GROUP BY contig) SELECT contig, CAST(bases AS BIGINT) AS bases, n, forward, round(bases / CAST(n AS DOUBLE), 6) AS mean_length FROM p""")
def region_totals(spark, d):
    return views.regions(spark, d).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.count(F.lit(1)).alias("n"), F.count_if("is_positive_strand").alias("forward"), F.round(F.avg(F.col("end") - F.col("start")), 6).alias("mean_length"))


from . import exchange  # noqa: E402, F401  its queries register themselves
