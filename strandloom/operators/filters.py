"""Predicates over reads, genotypes and somatic calls as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX = 2**31 - 1


@dataclass(frozen=True)
class ReadFilter:
    """Which reads stay; the defaults of a caller drop duplicates, failed and unpaired reads."""

    include_duplicates: bool = False
    include_failed_qc: bool = False
    include_single_end: bool = False
    only_mapped: bool = False
    min_mapq: int | None = None

    def predicate(self) -> Column:
        keep = F.lit(True)
        if not self.include_duplicates:
            keep &= ~F.col("is_duplicate")
        if not self.include_failed_qc:
            keep &= ~F.col("failed_qc")
        if not self.include_single_end:
            keep &= F.col("is_paired")
        if self.only_mapped:
            keep &= F.col("is_mapped")
        if self.min_mapq is not None:  # unmapped reads pass
            keep &= ~F.col("is_mapped") | (F.col("mapq") >= self.min_mapq)
        return keep

    def __call__(self, reads: DataFrame) -> DataFrame:
        return reads.filter(self.predicate())


def _over(col: str, bound: float, strict: bool = False) -> Column:
    """NaN passes no bound."""
    c = F.col(col)
    return ~F.isnan(c.cast("double")) & ((c > bound) if strict else (c >= bound))


@dataclass(frozen=True)
class GermlineFilter:
    min_depth: int = 0
    max_depth: int = MAX
    min_alt_depth: int = 0
    min_likelihood: int = 0
    min_mean_mapq: float = 0
    min_mean_base_quality: float = 0

    def predicates(self) -> list[Column]:
        return [
            (F.col("depth") >= self.min_depth) & (F.col("depth") < self.max_depth), F.col("allele_depth") >= self.min_alt_depth, F.col("phred") >= self.min_likelihood,
            _over("mean_mapq", self.min_mean_mapq, strict=True), _over("mean_base_quality", self.min_mean_base_quality, strict=True),
        ]

    def __call__(self, calls: DataFrame) -> DataFrame:
        for p in self.predicates():
            calls = calls.filter(p)
        return calls


@dataclass(frozen=True)
class SomaticFilter:
    """Filters of tumor/normal calls. By default the base-quality bound tests mapping quality, as callers of this kind were
    compared; fixed_base_quality tests the base quality."""

    min_tumor_depth: int = 5
    max_tumor_depth: int = MAX
    min_normal_depth: int = 5
    min_tumor_alt_depth: int | None = None
    min_likelihood: int | None = None
    min_vaf: int = 0
    min_mean_mapq: int = 20
    min_mean_base_quality: int = 20
    max_median_mismatches: int | None = None
    min_lod: float | None = None
    fixed_base_quality: bool = False

    def predicates(self) -> dict[str, Column]:
        second = "mean_base_quality" if self.fixed_base_quality else "mean_mapq"
        out = {"depth": (F.col("tumor_depth") >= self.min_tumor_depth) & (F.col("tumor_depth") < self.max_tumor_depth) & (F.col("normal_depth") >= self.min_normal_depth)}
        if self.min_tumor_alt_depth is not None:
            out["alt_depth"] = F.col("tumor_allele_depth") >= self.min_tumor_alt_depth
        if self.min_likelihood is not None:
            out["likelihood"] = F.col("phred") >= self.min_likelihood
        out["vaf"] = F.col("tumor_allele_depth") / F.col("tumor_depth") * 100.0 > self.min_vaf
        out["mapq"] = _over("tumor_mean_mapq", self.min_mean_mapq) & _over("normal_mean_mapq", self.min_mean_mapq)
        out["base_quality"] = _over(f"tumor_{second}", self.min_mean_base_quality) & _over(f"normal_{second}", self.min_mean_base_quality)
        if self.max_median_mismatches is not None:
            out["mismatches"] = F.col("tumor_median_mismatches") <= self.max_median_mismatches
        if self.min_lod is not None:
            out["lod"] = F.col("tumor_lod") > self.min_lod
        return out

    def __call__(self, calls: DataFrame, observation=None) -> DataFrame:
        """The calls that pass; with an Observation, also how many pass each filter on their own, in the same pass."""
        ps = self.predicates()
        if observation is not None:
            calls = calls.observe(observation, F.count(F.lit(1)).alias("calls"), *(F.count_if(p).alias(k) for k, p in ps.items()))
        for p in ps.values():
            calls = calls.filter(p)
        return calls


def insufficient_normal(total: Column, reference: Column, min_depth: int = 30, max_percent: float = 3.0) -> Column:
    """Whether pooled normal evidence is too thin or too noisy for a somatic call."""
    return (total < min_depth) | ((total - reference) * 100.0 / total > max_percent)


def too_many_calls(calls: DataFrame, most: int) -> DataFrame:
    """Adds too_many: more calls at the site than `most`; 0 disables."""
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy("contig", "locus"))
    return calls.withColumn("too_many", (n > most) if most else F.lit(False))


def failing_names(sample_filters: Column, triggered: Column, site_filters: Column) -> Column:
    """Names of failing filters: those of triggering samples only if every one of them fails some, and the site's."""
    of = F.transform(F.filter(F.arrays_zip(sample_filters.alias("f"), triggered.alias("t")), lambda x: x["t"]), lambda x: x["f"])
    fails = F.when((F.size(of) > 0) & F.forall(of, lambda f: F.size(f) > 0), F.array_distinct(F.flatten(of))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(fails, site_filters))
