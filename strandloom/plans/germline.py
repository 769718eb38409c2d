"""Germline callers: the best genotype at a position, and variants of local assemblies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import cigar_elements, success_to_phred
from ..operators.assembly import haplotypes, path_variants
from ..operators.pileup import CHUNK, OVERLAP, SITE, diploid_likelihoods, mismatches_per_read, reference_chunks


def check_assembly(k: int, half_window: int) -> None:
    """A window of 2 * half_window bases must hold a k-mer, and the window must move forward."""
    if k >= 2 * half_window or half_window < k:
        raise ValueError(f"k-mers of {k} bases do not fit windows of {half_window} bases on either side")


def germline_shortcut(pile: DataFrame, min_likelihood: int = 0, min_variant_reads: int = 2) -> DataFrame:
    """(site, genotype_id, phred) of positions whose best diploid genotype is not the reference's, phred above min_likelihood.

    Only positions with enough variant elements are looked at; likelihoods are normalised over a
    position's genotypes with equal priors; ties go to the genotype that sorts first.
    """
    lik = diploid_likelihoods(pile, use_mapq=True, normalize=True, min_variants=min_variant_reads)
    best = lik.withColumn("i", F.row_number().over(W.partitionBy(*SITE).orderBy(F.desc(F.round("ln_likelihood", 9)), "genotype_id"))).filter("i = 1")
    same = F.forall(F.split("genotype_id", "/"), lambda a: F.split(a, ">")[0] == F.split(a, ">")[1])
    called = best.filter(~same).select(*SITE, "genotype_id", success_to_phred(F.exp("ln_likelihood")).alias("phred"))
    return called.filter(F.col("phred") > min_likelihood)


def variant_sites(pile: DataFrame, reads: DataFrame, min_variant_reads: int = 2, min_area_percent: float = 5) -> DataFrame:
    """(site, active) of positions with enough variant elements.

    A position is active where more than min_area_percent of its reads have two mismatches or more, or an
    alignment of several CIGAR elements.
    """
    bent = reads.select("sample_id", "read_id", (F.size(cigar_elements(F.col("cigar"))) > 1).alias("bent"))
    noisy = mismatches_per_read(pile).join(bent, ["sample_id", "read_id"]).select("sample_id", "read_id", ((F.col("mismatches") > 1) | F.col("bent")).alias("noisy"))
    by = pile.join(noisy, ["sample_id", "read_id"]).groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("depth"), F.count_if(F.col("ref") != F.col("alt")).alias("varied"), F.count_if("noisy").alias("noisy")
    )
    return by.filter(F.col("varied") >= min_variant_reads).select(*SITE, (F.col("noisy") * 100 > F.col("depth") * min_area_percent).alias("active"))


def germline_calls(
    reads: DataFrame, pile: DataFrame, reference: DataFrame, k: int = 47, half_window: int = 120, min_occurrence: int = 3, min_area_percent: float = 5,
    min_mean_quality: float = 0, min_likelihood: int = 0, min_variant_reads: int = 2, shortcut: bool = False,
) -> DataFrame:
    """Variants (sample_id, contig, start, ref, alt, n_haplotypes, phred) at positions with enough variant reads.

    The reads within half_window of such a position are assembled; with `shortcut`, where the position is
    not active, its best genotype is called instead (n_haplotypes 0).  Positions go in order: after an
    assembly that found paths the next one is half_window - k further on, and an assembly's
    variants count beyond the last call only.  That state lasts for CHUNK positions of a contig, so a task holds the
    reads of one chunk and results do not depend on the layout of the data.

    reads: read_id, sample_id, contig, start, end, sequence, base_qualities, cigar.
    """
    check_assembly(k, half_window)
    if 2 * half_window > OVERLAP:
        raise ValueError(f"windows of more than {OVERLAP} bases")
    sites = variant_sites(pile, reads, min_variant_reads, min_area_percent)
    calls = germline_shortcut(pile, min_likelihood, min_variant_reads) if shortcut else None
    if shortcut:
        sites = sites.join(calls.select(*SITE, F.lit(True).alias("called")), SITE, "left").select(*SITE, "active", F.coalesce("called", F.lit(False)).alias("called"))
    else:
        sites = sites.select(*SITE, F.lit(True).alias("active"), F.lit(False).alias("called"))
    at = sites.withColumn("chunk", F.floor(F.greatest(F.col("locus") - half_window, F.lit(0)) / CHUNK))
    bases = reference_chunks(reference)
    # of partial references the segment that holds the position
    held = at.join(bases, ["contig", "chunk"]).filter((F.col("locus") >= F.col("chunk_start")) & (F.col("locus") < F.col("chunk_start") + F.length("bases")))
    group = ["sample_id", "contig", "chunk", "chunk_start"]
    work = held.groupBy(*group).agg(F.first("bases").alias("bases"), F.sort_array(F.collect_list(F.struct("locus", "active", "called"))).alias("sites"))
    mean = F.aggregate("base_qualities", F.lit(0.0), lambda a, q: a + q) / F.size("base_qualities")
    low, high = F.floor((F.col("start") - 2 * half_window) / CHUNK), F.floor(F.col("end") / CHUNK)
    near = reads.select("sample_id", "contig", "start", "end", "sequence", mean.alias("quality"), F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("chunk"))
    places = work.select("sample_id", "contig", "chunk", F.col("chunk_start").alias("origin"))
    near = near.join(places, ["sample_id", "contig", "chunk"])
    # names of their own: both sides come from the same reads
    near = near.select(*(F.col(c).alias(f"n_{c}") for c in ("sample_id", "contig", "chunk", "origin")), "start", "end", "sequence", "quality")
    variants = ["sample_id", "contig", "start", "ref", "alt", "n_haplotypes"]

    def kernel(own: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(todo):
            return pd.DataFrame([], columns=variants)
        task = todo.iloc[0]
        spans = sorted(zip(own["start"], own["end"], own["sequence"], own["quality"]))
        rows = walk_sites([(s["locus"], s["active"], s["called"]) for s in task["sites"]], spans, task["bases"], int(task["chunk_start"]), k, half_window, min_occurrence, min_mean_quality)
        return pd.DataFrame([(task["sample_id"], task["contig"], *r) for r in rows], columns=variants)

    found = near.groupBy("n_sample_id", "n_contig", "n_chunk", "n_origin").cogroup(work.groupBy(*group)).applyInPandas(kernel, "sample_id int, contig string, start long, ref string, alt string, n_haplotypes int")
    assembled = found.filter("n_haplotypes > 0").dropDuplicates(variants[:5]).withColumn("phred", F.lit(None).cast("int"))
    if not shortcut:
        return assembled
    kept = found.filter("n_haplotypes = 0").select("sample_id", "contig", F.col("start").alias("locus"))
    alleles = F.explode(F.array_distinct(F.split("genotype_id", "/"))).alias("allele")
    shown = calls.join(kept, SITE, "left_semi").select(*SITE, "phred", alleles).select("sample_id", "contig", F.col("locus").alias("start"), F.split("allele", ">")[0].alias("ref"), F.split("allele", ">")[1].alias("alt"), F.lit(0).alias("n_haplotypes"), "phred")
    return assembled.unionByName(shown.filter("ref <> alt and alt <> ''").select(assembled.columns))


def walk_sites(sites, reads, bases: str, origin: int, k: int, half_window: int, min_occurrence: int, min_mean_quality: float) -> list[tuple]:
    """Rows (start, ref, alt, n_haplotypes) from sorted sites (locus, assemble, called); a call of the site itself has no alleles and 0 haplotypes."""
    out, last, resume = [], -1, -1
    for locus, active, called in sites:
        if locus < resume:
            continue
        if not active:
            if called:
                out.append((int(locus), "", "", 0))
                last = locus
            continue
        begin = max(locus - half_window, origin)
        window = bases[begin - origin : locus + half_window - origin]
        if len(window) < k:
            continue
        around = [(s, q) for a, b, s, q in reads if a <= locus + half_window and b > locus - half_window]
        paths = haplotypes(around, window, k, min_occurrence, min_mean_quality)
        if paths:
            new = sorted({v for p in paths for v in path_variants(p, window) if begin + v[0] > last})
            out += [(int(begin + o), r, a, len(paths)) for o, r, a in new]
            last = max([begin + o for o, _, _ in new], default=last)
            resume = locus + half_window - k
    return out


def tiles(reference: DataFrame, loci: DataFrame, k: int, size: int, step: int | None = None) -> DataFrame:
    """Windows (contig, start, reference) of size bases that cover the loci, at every step bases, or overlapping by k."""
    starts = loci.select("contig", F.explode(F.sequence("start", F.greatest(F.col("end") - 1, F.col("start")), F.lit(step or size - k))).alias("start"))
    if size > OVERLAP:
        raise ValueError(f"windows of more than {OVERLAP} bases")
    at = starts.withColumn("chunk", F.floor(F.col("start") / CHUNK)).join(reference_chunks(reference), ["contig", "chunk"])
    held = at.filter((F.col("start") >= F.col("chunk_start")) & (F.col("start") < F.col("chunk_start") + F.length("bases")))
    return held.select("contig", "start", F.substring("bases", (F.col("start") - F.col("chunk_start") + 1).cast("int"), F.lit(size)).alias("reference")).filter(F.length("reference") >= k)
