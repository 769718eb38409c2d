"""Comparison of called and expected variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["contig", "start", "ref", "alt"]


def compare(expected: DataFrame, called: DataFrame) -> DataFrame:
    """Full outer join by position: exact, partial (another allele), only_expected or only_called."""
    e = expected.select(*(F.col(c).alias(f"e_{c}") for c in KEY))
    c = called.select(*(F.col(c).alias(f"c_{c}") for c in KEY))
    j = e.join(c, (F.col("e_contig") == F.col("c_contig")) & (F.col("e_start") == F.col("c_start")), "full")
    same = (F.col("e_ref") == F.col("c_ref")) & (F.col("e_alt") == F.col("c_alt"))
    outcome = F.when(F.col("e_start").isNull(), "only_called").when(F.col("c_start").isNull(), "only_expected").when(same, "exact").otherwise("partial")
    return j.withColumn("outcome", outcome)


def counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def scores(compared: DataFrame) -> DataFrame:
    """One row (precision, recall, f1); a partial match is both a wrong call and a missed one."""
    tp = F.count_if(F.col("outcome") == "exact")
    fp, fn = F.count_if(F.col("outcome").isin("only_called", "partial")), F.count_if(F.col("outcome").isin("only_expected", "partial"))
    return compared.agg(F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def of_kind(variants: DataFrame, contig: str = "", snv: bool = True, indel: bool = True) -> DataFrame:
    """Variants of a contig (empty: all) that are single-base changes, longer ones, or both."""
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    keep = (single & F.lit(snv)) | (~single & F.lit(indel))
    return variants.filter(keep if not contig else keep & (F.col("contig") == contig))
