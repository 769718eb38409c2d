"""Joint caller over several samples: candidate alleles, pooled evidence, germline and somatic calls.

A variant starts right after a position where the read agrees with the reference; it is the run
of differing positions from there.  All steps are joins and aggregations by site; sufficient
statistics by candidate and sample are summed where the reads are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import phred_to_success, strand_bias_phred
from ..operators.filters import failing_names, insufficient_normal
from ..operators.intervals import small
from ..operators.pileup import CHUNK, by_read, reference_chunks

SITE = ["contig", "start", "end", "ref", "alt"]
#: Candidates that are sent to all executors at most, and the width of the bins where more of them meet reads.
BROADCAST, NEAR = 500_000, 64


@dataclass(frozen=True)
class Parameters:
    max_alleles: int = 4
    max_calls_per_site: int = 1
    min_reads: int = 2
    min_percent: float = 2.0
    germline_het: float = 4.0
    germline_hom_alt: float = 5.0
    somatic: float = 6.0
    rna: float = 1.0
    somatic_with_rna: float = 1.0
    vaf_floor: float = 0.05
    strand_bias_phred: float = 60.0
    normal_max_percent: float = 3.0
    normal_min_depth: int = 30


def settled(df: DataFrame) -> DataFrame:
    """df computed once: in the folder of spark.checkpoint.dir, on one machine without it among the session's blocks."""
    sc = df.sparkSession.sparkContext
    where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None and where:
        sc.setCheckpointDir(where)
    if sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def _with_runs(pile: DataFrame) -> DataFrame:
    """(sample_id, read_id, contig, locus, run) by element; run, a struct (start, end, ref, alt), is null but where a run begins."""
    i, size = F.col("i"), F.size("loci")
    begins = F.get("differs", i) & ~F.get("differs", i - 1) & (F.get("loci", i - 1) == F.get("loci", i) - 1)
    spots = by_read(pile).select("sample_id", "read_id", "contig", "loci", "refs", "alts", "differs", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("i"))
    ends = F.array_position(F.slice("differs", i + 2, size), F.lit(False)).cast("int")
    spots = spots.withColumn("n", F.when(begins, F.when(ends > 0, ends).otherwise(size - i)))
    part = lambda c: F.slice(c, i + 1, F.col("n"))
    run = F.struct(
        F.get("loci", i).alias("start"), (F.get("loci", i + F.col("n") - 1) + 1).alias("end"),
        F.array_join(F.transform(part("refs"), lambda r: F.substring(r, 1, 1)), "").alias("ref"), F.array_join(part("alts"), "").alias("alt"),
    )
    return spots.select("sample_id", "read_id", "contig", F.get("loci", i).alias("locus"), F.when(F.col("n").isNotNull(), run).alias("run"))


def variant_runs(pile: DataFrame) -> DataFrame:
    """(sample_id, read_id, contig, start, end, ref, alt) of each read's runs of differing positions; a run that meets the read's end is cut there.

    pile: rows by element, or by read (read_elements), which need no shuffle.
    """
    return _with_runs(pile).filter("run is not null").select("sample_id", "read_id", "contig", "run.*")


def change_context(alleles: DataFrame, reference: DataFrame, before: int, after: int) -> DataFrame:
    """Alleles with so many more reference bases on either side; one whose context passes the known bases is left as it is.

    reference: segments (contig, offset, sequence).  An allele meets the chunk that holds its first base; a
    context of more than OVERLAP bases may pass the chunk's end.
    """
    chunks = reference_chunks(reference).select(F.col("contig").alias("r_contig"), "chunk", "chunk_start", "bases")
    first, last = F.col("start") - before, F.col("end") + after
    held = (F.col("contig") == F.col("r_contig")) & (F.floor(first / CHUNK) == F.col("chunk")) & (first >= F.col("chunk_start")) & (last <= F.col("chunk_start") + F.length("bases"))
    j = alleles.join(chunks, held, "left")
    piece = lambda at, n: F.substring(F.col("bases"), (at - F.col("chunk_start") + 1).cast("int"), F.lit(n))
    left, right = piece(first, before), piece(F.col("end"), after)
    changed = {"start": first, "end": last, "ref": F.concat(left, "ref", right), "alt": F.concat(left, "alt", right)}
    return j.select(*(F.when(F.col("chunk").isNotNull(), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in alleles.columns))


def fallback_alleles(pile: DataFrame, sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates, and for each of the given sites (contig, start) that has none its allele with the most reads, else N.

    An N stands for the reference's base; a site that no read covers stays without an allele.
    """
    bare = sites.select("contig", "start").distinct().join(candidates.select("contig", "start").distinct(), ["contig", "start"], "left_anti")
    runs = variant_runs(pile).filter("ref rlike '^[ACGT]+$' and alt rlike '^[ACGT]+$' and ref <> alt").groupBy(*SITE).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("contig", "start").orderBy(F.desc("n"), "end", "ref", "alt"))
    most = runs.join(bare, ["contig", "start"], "left_semi").withColumn("rank", rank).filter("rank = 1").drop("rank")
    spots = by_read(pile).select("contig", F.explode(F.arrays_zip("loci", "refs")).alias("e"))
    covered = spots.select("contig", F.col("e.loci").alias("start"), F.substring("e.refs", 1, 1).alias("r")).join(bare, ["contig", "start"], "left_semi").groupBy("contig", "start").agg(F.min("r").alias("ref"))
    none = covered.join(most.select("contig", "start"), ["contig", "start"], "left_anti").select("contig", "start", (F.col("start") + 1).alias("end"), "ref", F.lit("N").alias("alt"), F.lit(0).cast("long").alias("n"))
    return candidates.unionByName(most).unionByName(none)


def candidate_alleles(pile: DataFrame, params: Parameters = Parameters()) -> DataFrame:
    """(contig, start, end, ref, alt, n): alleles with enough reads in a sample, the most frequent ones of a site."""
    # one pass: a position counts to the depth of the site that starts after it, a run to its own
    after = F.struct((F.col("locus") + 1).alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("alt"))
    rows = _with_runs(pile).select("sample_id", "contig", F.explode(F.when(F.col("run").isNull(), F.array(after)).otherwise(F.array(after, "run"))).alias("of"))
    seen = rows.groupBy("sample_id", "contig", "of").agg(F.count(F.lit(1)).alias("n")).select("sample_id", "contig", "of.*", "n")
    seen = seen.withColumn("depth", F.sum(F.when(F.col("end").isNull(), F.col("n"))).over(W.partitionBy("sample_id", "contig", "start")))
    runs = seen.filter("ref rlike '^[ACGT]+$' and alt rlike '^[ACGT]+$' and ref <> alt")
    enough = runs.filter(F.col("n") >= F.greatest(F.lit(float(params.min_reads)), F.col("depth") * params.min_percent / 100))
    total = enough.groupBy(*SITE).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("contig", "start").orderBy(F.desc("n"), "end", "ref", "alt"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= params.max_alleles).drop("rank")


def read_support(pile: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, sample_id, read_id, kind ref/alt/other, quality, mapq, is_positive_strand) of reads that agree before the site and reach beyond it.

    pile: rows by element, or by read (read_elements).  Candidates are computed here; as many as BROADCAST meet each
    read's agreeing positions where the reads are, more meet the reads by bins of positions.
    """
    chosen = settled(candidates.select("contig", "start", "end", F.col("ref").alias("c_ref"), F.col("alt").alias("c_alt")))
    reads = by_read(pile).select("sample_id", "read_id", "contig", "mapq", "is_positive_strand", "loci", "alts", "quals", "differs").filter(F.size("loci") > 1)
    if small(chosen, BROADCAST):
        anchors = reads.select("*", F.explode(F.sequence(F.lit(0), F.size("loci") - 2)).alias("i")).filter(~F.get("differs", F.col("i")))
        pairs = anchors.withColumn("start", F.get("loci", F.col("i")) + 1).join(F.broadcast(chosen), ["contig", "start"])
    else:
        first, last = F.get("loci", F.lit(0)), F.get("loci", F.size("loci") - 1)
        binned = reads.select("*", F.explode(F.sequence(F.floor(first / NEAR), F.floor(last / NEAR))).alias("bin"))
        held = (F.col("start") > first) & (F.col("end") <= last)
        pairs = binned.join(chosen.withColumn("bin", F.floor((F.col("start") - 1) / NEAR)), ["contig", "bin"]).filter(held)
        # of an insertion and a base at the contig's start the last one is the base
        agree = F.filter(F.sequence(F.lit(0), F.size("loci") - 2), lambda i: (F.get("loci", i) == F.col("start") - 1) & ~F.get("differs", i))
        pairs = pairs.withColumn("i", F.get(agree, F.lit(0))).filter("i is not null")
    i = F.col("i")
    # elements from the site to its end, and whether the read goes on
    beyond = F.array_position(F.slice("loci", i + 2, (F.col("end") - F.col("start") + 1).cast("int")), F.col("end")).cast("int")
    pairs = pairs.withColumn("n", beyond - 1).filter("n >= 0")
    part = lambda c: F.slice(c, i + 2, F.col("n"))
    allele = F.when(F.col("n") == 1, F.coalesce(F.get("alts", i + 1), F.lit(""))).otherwise(F.array_join(part("alts"), ""))
    known = F.filter(part("quals"), lambda q: q.isNotNull())
    mean = F.aggregate(known, F.lit(0).cast("long"), lambda acc, q: acc + q).cast("double") / F.when(F.size(known) > 0, F.size(known))
    quality = F.when(F.col("n") == 1, F.get("quals", i + 1).cast("double")).otherwise(F.round(mean))
    pairs = pairs.withColumn("allele", allele)
    return pairs.select(
        "contig", "start", "end", F.col("c_ref").alias("ref"), F.col("c_alt").alias("alt"), "sample_id", "read_id",
        F.when(F.col("allele") == F.col("c_ref"), "ref").when(F.col("allele") == F.col("c_alt"), "alt").otherwise("other").alias("kind"), quality.alias("quality"), "mapq", "is_positive_strand",
    )


def sample_evidence(support: DataFrame, samples: DataFrame, params: Parameters = Parameters()) -> DataFrame:
    """Counts and log10 likelihoods of every candidate in every sample and in the pools of normal and tumor DNA.

    samples: (sample_id, tissue normal/tumor, analyte dna/rna).  Pools have sample_id -1 (normal DNA) and
    -2 (tumor DNA).  Normal RNA is an error.  The support is read twice, for the mixtures' fractions and for the
    sums: so only sums by candidate and sample are shuffled, never reads.
    """
    checked = samples.withColumn("tissue", F.when((F.col("tissue") == "normal") & (F.col("analyte") == "rna"), F.raise_error(F.lit("normal RNA is not a valid sample")).cast("string")).otherwise(F.col("tissue")))
    # a table of samples has as many rows as the caller was given files
    counted = support.groupBy(*SITE, "sample_id").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("kind") == "alt").alias("alts")).join(F.broadcast(checked), "sample_id")
    w = W.partitionBy(*SITE, "tissue", "analyte")
    counted = counted.withColumn("vaf", F.col("alts") / F.col("all")).withColumn("pool_vaf", F.sum("alts").over(w) / F.sum("all").over(w))
    shares = settled(counted.drop("alts", "all"))
    rows = support.join(F.broadcast(shares) if small(shares, 2 * BROADCAST) else shares, [*SITE, "sample_id"])
    pc = phred_to_success(F.col("quality")) * phred_to_success(F.col("mapq").cast("double"))
    rows = rows.withColumn("pc", pc).withColumn("right", F.log10("pc")).withColumn("wrong", F.log10(1 - F.col("pc")))
    is_ref, is_alt = F.col("kind") == "ref", F.col("kind") == "alt"

    def ll(ref: Column, alt: Column) -> Column:
        return F.sum(F.when(F.col("mapq") == 0, F.lit(0.0)).when(is_ref, ref).when(is_alt, alt).otherwise(F.col("wrong")))

    def mixed(vaf: str) -> Column:
        f = F.greatest(F.lit(params.vaf_floor), F.col(vaf))
        of = lambda f: F.log10(f * F.col("pc") + (1 - f) * (1 - F.col("pc")))
        return ll(of(1 - f), of(f))

    half = F.log10(0.5 * F.col("pc") + 0.5 * (1 - F.col("pc")))
    sums = ["depth", "ref_depth", "alt_depth", "ref_forward", "alt_forward", "ll_ref", "ll_het", "ll_hom"]
    by = rows.groupBy(*SITE, "sample_id", "tissue", "analyte", "vaf", "pool_vaf").agg(
        F.count(F.lit(1)).alias("depth"), F.count_if(is_ref).alias("ref_depth"), F.count_if(is_alt).alias("alt_depth"), F.count_if(is_ref & F.col("is_positive_strand")).alias("ref_forward"), F.count_if(is_alt & F.col("is_positive_strand")).alias("alt_forward"),
        ll(F.col("right"), F.col("wrong")).alias("ll_ref"), ll(half, half).alias("ll_het"), ll(F.col("wrong"), F.col("right")).alias("ll_hom"), mixed("vaf").alias("ll_mix"), mixed("pool_vaf").alias("ll_pool"),
    )
    own = F.struct("sample_id", "vaf", "ll_mix")
    pool = F.struct(F.when(F.col("tissue") == "normal", -1).otherwise(-2).alias("sample_id"), F.col("pool_vaf").alias("vaf"), F.col("ll_pool").alias("ll_mix"))
    named = by.select(*SITE, "tissue", "analyte", *sums, F.explode(F.when(F.col("analyte") == "dna", F.array(own, pool)).otherwise(F.array(own))).alias("of"))
    named = named.select(*SITE, "tissue", "analyte", *sums, "of.*")
    return named.groupBy(*SITE, "sample_id", "tissue", "analyte").agg(*(F.sum(c).alias(c) for c in sums), F.first("vaf").alias("vaf"), F.sum("ll_mix").alias("ll_mix")).select(
        *SITE, "sample_id", "tissue", "analyte", *sums[:5], "vaf", *sums[5:], "ll_mix"
    )


def joint_calls(evidence: DataFrame, params: Parameters = Parameters()) -> DataFrame:
    """Every candidate with its germline genotype in pooled normal DNA, the tumor samples that trigger, and whether it is called.

    Germline: the largest of ll_ref, ll_het - 4, ll_hom - 5.  A tumor DNA sample (or pool) triggers where
    ll_mix - prior exceeds ll_ref and the mixture's alleles differ from the germline's; the prior falls
    where tumor RNA expresses the allele.  posterior is the largest log10 posterior that decided: of the
    pooled normal's genotypes for a germline call, else of the tumor DNA samples' mixtures.
    """
    normal = (F.col("tissue") == "normal") & (F.col("sample_id") == -1)
    het, hom = F.col("ll_het") - params.germline_het, F.col("ll_hom") - params.germline_hom_alt
    genotype = F.when((F.col("ll_ref") >= het) & (F.col("ll_ref") >= hom), "ref").when(het >= hom, "het").otherwise("hom")
    mixes = lambda prior: F.col("ll_mix") - prior > F.col("ll_ref")
    tumor_dna, tumor_rna = (F.col("tissue") == "tumor") & (F.col("analyte") == "dna"), (F.col("tissue") == "tumor") & (F.col("analyte") == "rna")
    w = W.partitionBy(*SITE)
    e = evidence.withColumn("germline", F.coalesce(F.max(F.when(normal, genotype)).over(w), F.lit("ref"))).withColumn("expressed", F.coalesce(F.bool_or(tumor_rna & mixes(params.rna)).over(w), F.lit(False)))
    prior = F.when(F.col("expressed"), params.somatic_with_rna).otherwise(params.somatic)
    top_is_mix = mixes(prior)
    triggers = tumor_dna & F.when(F.col("germline") == "ref", top_is_mix).when(F.col("germline") == "het", ~top_is_mix).otherwise(F.lit(True))
    side = lambda c, k: F.max(F.when(F.col("sample_id") == k, F.col(c)))
    out = e.groupBy(*SITE).agg(
        F.first("germline").alias("germline"), F.sort_array(F.collect_set(F.when(triggers, F.col("sample_id")))).alias("triggered"),
        side("depth", -1).alias("normal_depth"), side("ref_depth", -1).alias("normal_ref_depth"), side("alt_depth", -1).alias("normal_alt_depth"),
        side("depth", -2).alias("tumor_depth"), side("alt_depth", -2).alias("tumor_alt_depth"), side("vaf", -2).alias("tumor_vaf"),
        F.max(F.when(normal, F.greatest(F.col("ll_ref"), het, hom))).alias("of_normal"), F.max(F.when(tumor_dna, F.greatest(F.col("ll_ref"), F.col("ll_mix") - prior))).alias("of_tumor"),
    )
    germ = F.col("germline") != "ref"
    out = out.withColumn("is_germline", germ).withColumn("is_somatic", ~germ & (F.size("triggered") > 0))
    return out.withColumn("posterior", F.round(F.when(germ, F.col("of_normal")).otherwise(F.col("of_tumor")), 6)).drop("of_normal", "of_tumor")


def choose_alleles(calls: DataFrame, params: Parameters = Parameters(), keep_uncalled: DataFrame | None = None) -> DataFrame:
    """Per site the called alleles, up to max_calls_per_site by (germline, somatic, posterior); sites of `keep_uncalled` (contig, start) stay without a call."""
    rank = F.row_number().over(W.partitionBy("contig", "start").orderBy(F.desc("is_germline"), F.desc("is_somatic"), F.desc_nulls_last("posterior"), "end", "ref", "alt"))
    ranked = calls.withColumn("rank", rank)
    called = F.col("is_germline") | F.col("is_somatic")
    if keep_uncalled is None:
        return ranked.filter(called & (F.col("rank") <= params.max_calls_per_site)).drop("rank")
    forced = ranked.join(keep_uncalled.select("contig", "start", F.lit(True).alias("forced")).distinct(), ["contig", "start"], "left")
    return forced.filter((called | F.col("forced")) & (F.col("rank") <= params.max_calls_per_site)).drop("rank")


def annotate(calls: DataFrame, evidence: DataFrame, params: Parameters = Parameters(), fixed_strand_bias: bool = False) -> DataFrame:
    """Calls with the names of the filters they fail: of triggering samples only where each of them fails one, and of the site.

    STRAND_BIAS by sample (as computed elsewhere it is never positive, so nothing fails unless it is fixed);
    INSUFFICIENT_NORMAL by site, for somatic calls only.
    """
    bias = strand_bias_phred(F.col("alt_depth"), F.col("alt_forward"), F.col("ref_depth"), F.col("ref_forward"), fixed_strand_bias)
    by = evidence.filter("tissue = 'tumor' and analyte = 'dna'").select(*SITE, "sample_id", F.when(bias > params.strand_bias_phred, F.array(F.lit("STRAND_BIAS"))).otherwise(F.array().cast("array<string>")).alias("f"))
    sides = by.groupBy(*SITE).agg(F.sort_array(F.collect_list(F.struct("sample_id", "f"))).alias("sides"))
    thin = F.col("is_somatic") & F.coalesce(insufficient_normal(F.col("normal_depth"), F.col("normal_ref_depth"), params.normal_min_depth, params.normal_max_percent), F.lit(True))
    site = F.when(thin, F.array(F.lit("INSUFFICIENT_NORMAL"))).otherwise(F.array().cast("array<string>"))
    names = failing_names(F.transform(F.col("sides"), lambda x: x["f"]), F.transform(F.col("sides"), lambda x: F.array_contains(F.col("triggered"), x["sample_id"])), site)
    joined = calls.join(sides, SITE, "left")
    return joined.withColumn("failing", F.when(F.col("sides").isNull(), site).otherwise(names)).drop("sides")


def calls_for_query(pile: DataFrame, germline: bool) -> DataFrame:
    samples = pile.sparkSession.createDataFrame([(1, "normal", "dna"), (0, "tumor", "dna")], "sample_id int, tissue string, analyte string")
    calls = joint_calls(sample_evidence(read_support(pile, candidate_alleles(pile)), samples))
    which = calls.filter("is_germline" if germline else "is_somatic")
    return which.select(*SITE, "germline", "normal_depth", "normal_alt_depth", "tumor_depth", "tumor_alt_depth", F.round("tumor_vaf", 6).alias("tumor_vaf"))


CANDIDATES = """solid AS (SELECT * FROM pile WHERE aln_type <> 'Clipped'), marked AS (
    SELECT *, "ref" <> alt AND coalesce("ref0" = alt0 AND locus0 = locus - 1, false) AS begins FROM (
        SELECT *, lag("ref") OVER w AS ref0, lag(alt) OVER w AS alt0, lag(locus) OVER w AS locus0 FROM solid WINDOW w AS (PARTITION BY sample_id, read_id ORDER BY locus))
), numbered AS (SELECT *, sum(CASE WHEN begins OR "ref" = alt THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, read_id ORDER BY locus) AS run FROM marked
), runs AS (
    SELECT sample_id, read_id, contig, min(locus) AS "start", max(locus) + 1 AS "end", string_agg(substr("ref", 1, 1), '' ORDER BY locus) AS "ref", string_agg(alt, '' ORDER BY locus) AS alt
    FROM numbered WHERE "ref" <> alt GROUP BY sample_id, read_id, contig, run HAVING bool_or(begins)
), depths AS (SELECT sample_id, contig, locus + 1 AS "start", count(*) AS depth FROM solid GROUP BY ALL
), per AS (SELECT sample_id, contig, "start", "end", "ref", alt, count(*) AS n FROM runs WHERE regexp_matches("ref", '^[ACGT]+$') AND regexp_matches(alt, '^[ACGT]+$') AND "ref" <> alt GROUP BY ALL
), cands AS (
    SELECT contig, "start", "end", "ref", alt, CAST(sum(n) AS BIGINT) AS n FROM per JOIN depths USING (sample_id, contig, "start") WHERE n >= greatest(2.0, depth * 2.0 / 100) GROUP BY contig, "start", "end", "ref", alt
    QUALIFY row_number() OVER (PARTITION BY contig, "start" ORDER BY sum(n) DESC, "end", "ref", alt) <= 4
)"""

EVIDENCE = """spots2 AS (SELECT contig, "start", "end", "ref" AS r, alt AS a, unnest(range("start" - 1, "end" + 1)) AS locus FROM cands
), spans AS (
    SELECT sample_id, read_id, p.contig, s."start", s."end", r, a, any_value(mapq) AS mapq, round(avg(CASE WHEN p.locus >= s."start" AND p.locus < s."end" THEN qual END)) AS quality,
           coalesce(string_agg(CASE WHEN p.locus >= s."start" AND p.locus < s."end" THEN alt END, '' ORDER BY p.locus), '') AS allele
    FROM solid p JOIN spots2 s ON p.contig = s.contig AND p.locus = s.locus GROUP BY ALL
    HAVING bool_or(p.locus = s."start" - 1 AND "ref" = alt) AND bool_or(p.locus = s."end")
), lik AS (
    SELECT *, CASE WHEN allele = r THEN 'ref' WHEN allele = a THEN 'alt' ELSE 'other' END AS kind, (1 - pow(10.0, -quality / 10)) * (1 - pow(10.0, -mapq / 10.0)) AS pc FROM spans
), shares AS (SELECT *, count(*) FILTER (WHERE kind = 'alt') OVER w / CAST(count(*) OVER w AS DOUBLE) AS vaf FROM lik WINDOW w AS (PARTITION BY contig, "start", "end", r, a, sample_id)
), ev AS (
    SELECT contig, "start", "end", r, a, sample_id, count(*) AS depth, count(*) FILTER (WHERE kind = 'alt') AS alt_depth, any_value(vaf) AS vaf,
           sum(CASE WHEN mapq = 0 THEN 0 WHEN kind = 'ref' THEN log10(pc) ELSE log10(1 - pc) END) AS ll_ref,
           sum(CASE WHEN mapq = 0 THEN 0 WHEN kind = 'other' THEN log10(1 - pc) ELSE log10(0.5 * pc + 0.5 * (1 - pc)) END) AS ll_het,
           sum(CASE WHEN mapq = 0 THEN 0 WHEN kind = 'alt' THEN log10(pc) ELSE log10(1 - pc) END) AS ll_hom,
           sum(CASE WHEN mapq = 0 THEN 0 WHEN kind = 'ref' THEN log10((1 - greatest(0.05, vaf)) * pc + greatest(0.05, vaf) * (1 - pc))
                    WHEN kind = 'alt' THEN log10(greatest(0.05, vaf) * pc + (1 - greatest(0.05, vaf)) * (1 - pc)) ELSE log10(1 - pc) END) AS ll_mix
    FROM shares GROUP BY ALL
), judged AS (
    SELECT c.contig, c."start", c."end", c."ref", c.alt, n.depth AS normal_depth, n.alt_depth AS normal_alt_depth, t.depth AS tumor_depth, t.alt_depth AS tumor_alt_depth, t.vaf AS tumor_vaf,
           CASE WHEN n.depth IS NULL OR (n.ll_ref >= n.ll_het - 4 AND n.ll_ref >= n.ll_hom - 5) THEN 'ref' WHEN n.ll_het - 4 >= n.ll_hom - 5 THEN 'het' ELSE 'hom' END AS germline,
           coalesce(t.ll_mix - 6 > t.ll_ref, false) AS mixed, greatest(n.ll_ref, n.ll_het - 4, n.ll_hom - 5) AS of_normal, greatest(t.ll_ref, t.ll_mix - 6) AS of_tumor
    FROM cands c LEFT JOIN ev n ON n.sample_id = 1 AND n.contig = c.contig AND n."start" = c."start" AND n."end" = c."end" AND n.r = c."ref" AND n.a = c.alt
                 LEFT JOIN ev t ON t.sample_id = 0 AND t.contig = c.contig AND t."start" = c."start" AND t."end" = c."end" AND t.r = c."ref" AND t.a = c.alt
    WHERE n.depth IS NOT NULL OR t.depth IS NOT NULL
)"""


def candidates_sql(pile: str) -> str:
    return f'WITH {pile}, {CANDIDATES} SELECT contig, "start", "end", "ref", alt, n FROM cands'


def calls_sql(pile: str, germline: bool) -> str:
    which = "germline <> 'ref'" if germline else "germline = 'ref' AND mixed"
    return f'WITH {pile}, {CANDIDATES}, {EVIDENCE} SELECT contig, "start", "end", "ref", alt, germline, normal_depth, normal_alt_depth, tumor_depth, tumor_alt_depth, round(tumor_vaf, 6) AS tumor_vaf FROM judged WHERE {which}'


def best_sql(pile: str) -> str:
    """One allele a site: what triggers follows the germline genotype, the largest posterior wins."""
    return f"""WITH {pile}, {CANDIDATES}, {EVIDENCE}, called AS (
        SELECT *, germline <> 'ref' AS is_germline, germline = 'ref' AND mixed AS is_somatic, round(CASE WHEN germline <> 'ref' THEN of_normal ELSE of_tumor END, 6) AS posterior FROM judged
    ) SELECT contig, "start", "end", "ref", alt, is_germline, is_somatic, round(posterior, 4) AS posterior FROM called WHERE is_germline OR is_somatic
    QUALIFY row_number() OVER (PARTITION BY contig, "start" ORDER BY is_germline DESC, is_somatic DESC, posterior DESC NULLS LAST, "end", "ref", alt) = 1"""
