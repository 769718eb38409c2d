"""Tumor/normal caller: thresholds on log odds of genotype likelihoods at each position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import phred_to_success
from ..operators.pileup import mismatches_per_read

AT = ["contig", "locus"]


def somatic_standard(
    tumor: DataFrame, normal: DataFrame, tumor_odds: float = 10, normal_odds: float = 5, max_normal_alts: int = 4, min_vaf_percent: float = 3, max_depth: int = 2**31 - 1,
    mismatches: bool = False,
) -> DataFrame:
    """Calls (contig, start, end, ref, alt, depths, log odds, evidence) from two pileups.

    A position is called on its most frequent variant allele of the tumor (ties: the smaller ref and
    alt): f = max(min VAF, its share); tumor odds ln L{ref 1-f, alt f} - ln L{ref}, normal odds
    ln L{ref} - ln L{ref 1/2, alt 1/2}.  Both pileups meet in one shuffle by position: windows and
    sums use that partitioning.
    """
    def side(pile: DataFrame, is_tumor: bool) -> DataFrame:
        pile = pile.withColumn("tumor", F.lit(is_tumor))
        if mismatches:
            return pile.join(mismatches_per_read(pile), ["sample_id", "read_id"])
        return pile.withColumn("mismatches", F.lit(None).cast("long"))

    cols = [*AT, "tumor", "ref", "alt", "qual", "mapq", "is_positive_strand", "mismatches", "aln_type"]
    both = side(tumor, True).select(cols).unionByName(side(normal, False).select(cols))
    variant = F.col("ref") != F.col("alt")
    site = W.partitionBy(*AT)
    by_allele = W.partitionBy(*AT, "tumor", "ref", "alt")
    t = F.col("tumor")
    e = both.withColumns({
        "tumor_depth": F.count_if(t).over(site), "normal_depth": F.count_if(~t).over(site),
        "tumor_alts": F.count_if(t & variant).over(site), "normal_alts": F.count_if(~t & variant).over(site),
        "own": F.count(F.lit(1)).over(by_allele),
    }).filter(
        f"tumor_depth > 0 and normal_depth > 0 and tumor_depth <= {max_depth} and normal_depth <= {max_depth} and tumor_alts > 0 and normal_alts <= {max_normal_alts}"
    )
    # the smallest of (-count, ref, alt); reference bases of a position are those of its best allele
    best = F.min(F.when(t & variant & ~((F.col("ref") == "") & (F.col("alt") == "")), F.struct(F.negative("own").alias("n"), "ref", "alt"))).over(site)
    e = e.withColumn("best", best).filter("best is not null and best.alt <> ''")
    is_alt = (F.col("ref") == F.col("best.ref")) & (F.col("alt") == F.col("best.alt"))
    is_ref = F.col("ref") == F.col("alt")
    f = F.greatest(F.lit(min_vaf_percent / 100.0), -F.col("best.n") / F.col("tumor_depth"))
    p = phred_to_success(F.col("qual").cast("double"))

    def ln(alt_share: Column) -> Column:
        return F.ln(F.when(is_ref, p).otherwise(1 - p) * (1 - alt_share) + F.when(is_alt, p).otherwise(1 - p) * alt_share)

    def mean(col: str, which: Column) -> Column:
        return F.coalesce(F.avg(F.when(which, F.col(col))), F.lit(float("nan")))

    ta, na = t & is_alt, ~t & is_alt
    out = e.groupBy(*AT).agg(
        F.first("best").alias("best"), F.first("tumor_depth").alias("tumor_depth"), F.first("normal_depth").alias("normal_depth"),
        F.sum(F.when(t, ln(f) - ln(F.lit(0.0)))).alias("tumor_lod"), F.sum(F.when(~t, ln(F.lit(0.0)) - ln(F.lit(0.5)))).alias("normal_lod"),
        F.count_if(ta).alias("tumor_allele_depth"), F.count_if(ta & F.col("is_positive_strand")).alias("tumor_allele_forward"), F.count_if(t & F.col("is_positive_strand")).alias("tumor_forward"),
        F.count_if(na).alias("normal_allele_depth"),
        *(F.coalesce(F.avg(F.when(t, F.col(c))), F.lit(float("nan"))).alias(f"tumor_mean_{n}") for c, n in (("mapq", "mapq"), ("qual", "base_quality"))),
        *(F.coalesce(F.avg(F.when(~t, F.col(c))), F.lit(float("nan"))).alias(f"normal_mean_{n}") for c, n in (("mapq", "mapq"), ("qual", "base_quality"))),
        F.percentile(F.when(ta, F.col("mismatches")), 0.5).alias("tumor_median_mismatches"), mean("mapq", ta).alias("allele_mean_mapq"), mean("qual", ta).alias("allele_mean_base_quality"),
    )
    return out.filter((F.col("tumor_lod") > tumor_odds) & (F.col("normal_lod") > normal_odds)).select(
        "contig", F.col("locus").alias("start"), (F.col("locus") + 1).alias("end"), F.col("best.ref").alias("ref"), F.col("best.alt").alias("alt"), *out.columns[3:]
    )


def annotate_known(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls with rs_id, the number of the first name of a known variant at (contig, start, ref, alt); null where there is none.

    known: (contig, start, ref, alt, names, db_snp); the join is left outer, and repeated known variants repeat calls.
    """
    number = F.when(F.col("db_snp"), F.regexp_extract(F.try_element_at("names", F.lit(1)), r"^(?:rs)?(\d+)$", 1))
    keyed = known.select("contig", "start", "ref", "alt", F.when(number != "", number).cast("long").alias("rs_id"))
    return calls.join(keyed, ["contig", "start", "ref", "alt"], "left")
