"""Pileups: aligned reads to one row per read and position, and aggregates over positions.

Elements are expressions over exploded CIGAR elements; a read's reference bases come from one
chunk of the reference, joined by contig and chunk, so neither reads nor reference are collected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import CIGAR, READ_OPS, REFERENCE_OPS, cigar_elements, phred_to_success
from .intervals import BIN, overlap_join, small

#: Positions of a reference chunk, and by how much it runs into the next ones (the longest span of a read's M and D).
CHUNK, OVERLAP = BIN, BIN


def reference_chunks(reference: DataFrame) -> DataFrame:
    """(contig, chunk, chunk_start, bases) from segments (contig, offset, sequence), which may be partial and overlap nothing.

    A segment is cut in one pass: rows that hold a whole sequence for each of its chunks would be quadratic in bytes.
    """
    return reference.select("contig", F.col("offset").cast("long"), "sequence").filter("sequence <> ''").mapInArrow(_cut_chunks, "contig string, chunk long, chunk_start long, bases string")


def _cut_chunks(batches):
    for batch in batches:
        rows = []
        for contig, first, sequence in zip(*(c.to_pylist() for c in batch.columns)):
            last = first + len(sequence)
            for chunk in range(max(0, (first - OVERLAP) // CHUNK), (last - 1) // CHUNK + 1):
                start, end = max(first, chunk * CHUNK), min(last, (chunk + 1) * CHUNK + OVERLAP)
                if start < end:
                    rows.append((contig, chunk, start, sequence[start - first : end - first].upper()))
                if len(rows) == 1000:
                    yield _chunk_batch(rows)
                    rows = []
        yield _chunk_batch(rows)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["contig", "chunk", "chunk_start", "bases"])


def with_reference(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Reads with the bases around them: ref_start, ref_bases (of partial references the segment that holds the read's start)."""
    chunks = reference_chunks(reference)
    r = reads.withColumn("chunk", F.floor(F.col("start") / CHUNK))
    inside = (r["start"] >= chunks["chunk_start"]) & (r["start"] < chunks["chunk_start"] + F.length("bases"))
    joined = r.join(chunks, (r["contig"] == chunks["contig"]) & (r["chunk"] == chunks["chunk"]) & inside, "left")
    return joined.select(*(r[c] for c in reads.columns), F.col("chunk_start").alias("ref_start"), F.col("bases").alias("ref_bases"))


def elements(reads: DataFrame, reference: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """One row per mapped read and reference position that its alignment spans.

    reads: read_id, sample_id, contig, start, sequence, base_qualities array<int>, mapq, cigar,
    is_positive_strand.  Gives read_id, sample_id, contig, locus, aln_type, ref, alt, qual, mapq,
    is_positive_strand, read_pos.  Unknown reference bases are N.  With loci, only their positions.
    """
    if loci is not None:
        spans = reads.withColumn("end", F.col("start") + F.aggregate(cigar_elements(F.col("cigar")), F.lit(0), lambda a, e: a + F.when(e["op"].isin(*REFERENCE_OPS), e["len"]).otherwise(0)))
        reads = overlap_join(spans, loci.select("contig", "start", "end"), "semi", broadcast=small(loci)).drop("end")
    r = with_reference(reads.select("read_id", "sample_id", "contig", "start", "sequence", "base_qualities", "mapq", "cigar", "is_positive_strand"), reference).withColumn("ops", cigar_elements(F.col("cigar")))

    def before(ops: tuple) -> Column:
        return F.aggregate(F.slice("ops", 1, F.col("i")), F.lit(0), lambda acc, e: acc + F.when(e["op"].isin(*ops), e["len"]).otherwise(0))

    e = r.select("*", F.posexplode("ops").alias("i", "e")).select(
        "*", F.col("e.len").alias("len"), F.col("e.op").alias("op"), before(REFERENCE_OPS).alias("roff"), before(READ_OPS).alias("qoff"),
        F.try_element_at("ops", F.col("i") + 2).alias("following"),
    )
    # an insertion at position 0 has no base before it: it is a row of its own at the contig's start
    lone = (F.col("op") == "I") & (F.col("start") + F.col("roff") == 0)
    e = e.filter(F.col("op").isin(*REFERENCE_OPS) | lone)
    e = e.withColumn("w", F.explode(F.when(lone, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("len") - 1))))
    last = F.col("w") == F.col("len") - 1
    locus = (F.col("start") + F.col("roff") + F.col("w")).alias("locus")
    pos = F.col("qoff") + F.when(F.col("op").isin(*READ_OPS) & ~lone, F.col("w")).otherwise(0)
    e = e.select("*", locus, pos.alias("read_pos"), F.when(last, F.col("following.op")).alias("next_op"), F.when(last, F.col("following.len")).otherwise(0).alias("next_len"))
    if loci is not None:
        spots = loci.select("contig", "start", "end")
        at = F.col("locus").alias("start")
        e = overlap_join(e.drop("start").select("*", at, (F.col("locus") + 1).alias("end")), spots, "inner", broadcast=small(loci)).drop("r_contig", "r_start", "r_end")
    base = F.substring("sequence", F.col("read_pos") + 1, F.lit(1))
    known = lambda n: F.rpad(F.coalesce(F.substring(F.col("ref_bases"), (F.col("locus") - F.col("ref_start") + 1).cast("int"), n), F.lit("")), n, F.lit("N"))
    one = known(F.lit(1))
    inserted = F.substring("sequence", F.col("read_pos") + 1, F.col("next_len") + 1)
    m = F.col("op").isin("M", "=", "X")
    kind = (
        F.when(lone, "Insertion").when(F.col("op").isin("M", "=") & (F.col("next_op") == "I"), "Insertion").when(m & (F.col("next_op") == "D"), "Deletion")
        .when(F.col("op") == "D", "MidDeletion").when(m & (base == one), "Match").when(m, "Mismatch").otherwise("Clipped")
    )
    e = e.select("*", kind.alias("aln_type"))
    t = F.col("aln_type")
    ref = (
        F.when(lone, F.substring("sequence", F.col("len") + 1, F.lit(1))).when(t == "Insertion", base).when(t == "Deletion", known(F.col("next_len") + 1))
        .when(t.isin("Match", "Mismatch", "MidDeletion"), one).otherwise("")
    )
    alt = (
        F.when(lone, F.substring("sequence", F.lit(1), F.col("len") + 1)).when(t == "Insertion", inserted).when(t == "Deletion", one)
        .when(t.isin("Match", "Mismatch"), base).otherwise("")
    )
    own = F.try_element_at("base_qualities", F.col("read_pos") + 1)
    qual = (
        F.when(t == "Insertion", F.array_min(F.slice("base_qualities", F.col("read_pos") + 1, F.when(lone, F.col("len")).otherwise(F.col("next_len")) + 1)))
        .when(t.isin("Match", "Mismatch", "Deletion"), own).otherwise(F.col("mapq"))
    )
    return e.select("read_id", "sample_id", "contig", "locus", "aln_type", ref.alias("ref"), alt.alias("alt"), qual.alias("qual"), "mapq", "is_positive_strand", "read_pos")


def read_elements(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per mapped read with its elements in parallel arrays: loci, refs, alts, quals, and whether ref and alt differ.

    The rows of `elements` that are not clipped, in the order of the alignment, held by the read that
    they come from: what looks along a read needs no shuffle.  Columns beside the arrays: read_id,
    sample_id, contig, mapq, is_positive_strand.
    """
    r = with_reference(reads.select("read_id", "sample_id", "contig", "start", "sequence", "base_qualities", "mapq", "cigar", "is_positive_strand"), reference)
    spans = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda a, n: a + n.cast("int"))
    around = F.substring("ref_bases", (F.col("start") - F.col("ref_start") + 1).cast("int"), spans)
    kept = ["read_id", "sample_id", "contig", "mapq", "is_positive_strand"]
    r = r.select(*kept, F.col("start").cast("long").alias("start"), "sequence", F.col("base_qualities").cast("array<int>").alias("base_qualities"), "cigar", around.alias("around"))
    arrays = "loci array<long>, refs array<string>, alts array<string>, quals array<int>, differs array<boolean>"
    return r.mapInArrow(_along_reads, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.select(*kept).schema) + f", {arrays}")


def _along_reads(batches):
    layouts = {}
    for batch in batches:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        loci, refs, alts, quals, ends = [], [], [], [], [0]
        for start, sequence, own, mapq, cigar, around in zip(*(column[c].to_pylist() for c in ("start", "sequence")), _lists(column["base_qualities"]), *(column[c].to_pylist() for c in ("mapq", "cigar", "around"))):
            if cigar not in layouts:
                if len(layouts) == 10_000:
                    layouts.clear()
                layouts[cigar] = _layout(cigar or "")
            if start is not None:
                for op, size, r, q, follow, more in layouts[cigar]:
                    if op == "I":
                        if start + r == 0:  # no base before it: a row of its own at the contig's start
                            loci.append(0)
                            refs.append(sequence and sequence[size : size + 1])
                            alts.append(sequence and sequence[: size + 1])
                            quals.append(min((x for x in own[q : q + size + 1] if x is not None), default=None))
                        continue
                    loci.extend(range(start + r, start + r + size))
                    known = ((around or "")[r : r + size + (more if follow == "D" else 0)]).ljust(size + more, "N")
                    refs.extend(known[:size])
                    if op == "D":
                        alts.extend([""] * size)
                        quals.extend([mapq] * size)
                        continue
                    shown, right = [None] * size if sequence is None else list(sequence[q : q + size]), own[q : q + size]
                    alts.extend(shown if len(shown) == size else shown + [""] * (size - len(shown)))
                    quals.extend(right if len(right) == size else right + [None] * (size - len(right)))
                    if follow == "D":
                        refs[-1], alts[-1] = known[size - 1 : size + more], known[size - 1]
                    elif follow == "I":
                        refs[-1], alts[-1] = alts[-1], sequence if sequence is None else sequence[q + size - 1 : q + size + more]
                        quals[-1] = min((x for x in own[q + size - 1 : q + size + more] if x is not None), default=None)
            ends.append(len(loci))
        refs, alts, ends = pa.array(refs, pa.string()), pa.array(alts, pa.string()), pa.array(ends, pa.int32())
        values = {"loci": pa.array(loci, pa.int64()), "refs": refs, "alts": alts, "quals": pa.array(quals, pa.int32()), "differs": pc.not_equal(refs, alts)}
        kept = [n for n in batch.schema.names if n not in ("start", "sequence", "base_qualities", "cigar", "around")]
        yield pa.RecordBatch.from_arrays([*(column[n] for n in kept), *(pa.ListArray.from_arrays(ends, v) for v in values.values())], names=[*kept, *values])


def _lists(column: pa.ListArray):
    """Lists of numbers of a column; a missing list is empty."""
    if column.null_count or column.values.null_count:
        return [x or [] for x in column.to_pylist()]
    values, at = column.values.to_numpy().tolist(), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def _layout(cigar: str) -> list[tuple]:
    """(op, size, reference and read positions before it, the I or D that follows its last base, its size) of a CIGAR string's M, =, X, D and I."""
    ops, out, r, q = [(op, int(n)) for n, op in re.findall(CIGAR, cigar)], [], 0, 0
    for (op, size), (follow, more) in zip(ops, [*ops[1:], ("", 0)]):
        if size and op in "M=XDI":
            cuts = op in "M=X" and (follow == "D" or (follow == "I" and op != "X"))
            out.append(("M" if op in "=X" else op, size, r, q, follow if cuts else "", more if cuts else 0))
        r, q = r + size * (op in REFERENCE_OPS), q + size * (op in READ_OPS)
    return out


def by_read(pile: DataFrame) -> DataFrame:
    """Rows of `elements` gathered by read, as read_elements has them; rows of read_elements stay."""
    if "loci" in pile.columns:
        return pile
    at = ["locus", "read_pos"] if "read_pos" in pile.columns else ["locus"]
    spots = F.sort_array(F.collect_list(F.struct(*at, "ref", "alt", "qual")))
    r = pile.filter("aln_type <> 'Clipped'").groupBy("sample_id", "read_id", "contig").agg(F.first("mapq").alias("mapq"), F.first("is_positive_strand").alias("is_positive_strand"), spots.alias("s"))
    r = r.select("read_id", "sample_id", "contig", "mapq", "is_positive_strand", F.col("s.locus").alias("loci"), F.col("s.ref").alias("refs"), F.col("s.alt").alias("alts"), F.col("s.qual").alias("quals"))
    return r.withColumn("differs", F.zip_with("refs", "alts", lambda r, a: r != a))


def slice_reads(reads: DataFrame, start: Column, end: Column) -> DataFrame:
    """Mapped reads cut to the reference range [start, end): start, end, sequence, base_qualities and cigar fit the range.

    Insertions stay with the base before them; clips at ends that are cut go; reads outside vanish.
    """
    r = reads.withColumn("ops", cigar_elements(F.col("cigar"))).withColumn("lo", start.cast("long")).withColumn("hi", end.cast("long"))
    step = lambda acc, e: F.struct(  # noqa: E731  reference and read positions so far, kept elements, first read base kept, read bases kept
        (acc["ref"] + F.when(e["op"].isin(*REFERENCE_OPS), e["len"]).otherwise(0)).alias("ref"),
        (acc["read"] + F.when(e["op"].isin(*READ_OPS), e["len"]).otherwise(0)).alias("read"),
        F.concat(acc["kept"], F.array(F.struct(_overlap(acc, e).cast("int").alias("len"), e["op"].alias("op")))).alias("kept"),
        F.when((acc["first"] < 0) & (_overlap(acc, e) > 0) & e["op"].isin(*READ_OPS), acc["read"] + F.when(e["op"].isin(*REFERENCE_OPS), F.greatest(F.col("lo") - acc["ref"], F.lit(0))).otherwise(0)).otherwise(acc["first"]).cast("long").alias("first"),
        (acc["n"] + F.when(e["op"].isin(*READ_OPS), _overlap(acc, e)).otherwise(0)).cast("long").alias("n"),
    )
    zero = F.struct(F.col("start").cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.array().cast("array<struct<len:int,op:string>>").alias("kept"), F.lit(-1).cast("long").alias("first"), F.lit(0).cast("long").alias("n"))
    r = r.withColumn("s", F.aggregate("ops", zero, step)).filter("s.n > 0")
    kept = F.filter("s.kept", lambda e: e["len"] > 0)
    begin = F.greatest(F.col("start"), F.col("lo"))
    out = {
        "sequence": F.substring("sequence", (F.col("s.first") + 1).cast("int"), F.col("s.n").cast("int")), "base_qualities": F.slice("base_qualities", (F.col("s.first") + 1).cast("int"), F.col("s.n").cast("int")),
        "cigar": F.array_join(F.transform(kept, lambda e: F.concat(e["len"].cast("string"), e["op"])), ""), "start": begin, "end": F.least(F.col("s.ref"), F.col("hi")),
    }
    return r.withColumns(out).select([c for c in reads.columns if c != "end"] + ["end"])


def _overlap(acc: Column, e: Column) -> Column:
    """Bases of a CIGAR element that lie in [lo, hi): all of an insertion or inner clip whose place does."""
    at, size = acc["ref"], e["len"]
    spans = F.greatest(F.least(at + size, F.col("hi")) - F.greatest(at, F.col("lo")), F.lit(0))
    edge = F.when((at > F.col("lo")) & (at <= F.col("hi")) & (e["op"] == "I") | ((at >= F.col("lo")) & (at <= F.col("hi")) & e["op"].isin("S", "H")), size).otherwise(0)
    return F.when(e["op"].isin(*REFERENCE_OPS), spans).otherwise(edge)


SITE = ["sample_id", "contig", "locus"]


def pileup_depths(pile: DataFrame) -> DataFrame:
    """(site, depth, positive_depth, reference_depth, alleles) with the alleles sorted, as ref>alt."""
    return pile.groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("depth"), F.count_if("is_positive_strand").alias("positive_depth"), F.count_if(F.col("ref") == F.col("alt")).alias("reference_depth"),
        F.array_sort(F.collect_set(F.concat_ws(">", "ref", "alt"))).alias("alleles"),
    )


def allele_counts(pile: DataFrame) -> DataFrame:
    return pile.groupBy(*SITE, "ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_positive_strand").alias("n_positive"))


def mismatches_per_read(pile: DataFrame) -> DataFrame:
    return pile.groupBy("sample_id", "read_id").agg(F.count_if(F.col("aln_type") == "Mismatch").alias("mismatches"))


def vaf_loci(pile: DataFrame, min_depth: int = 0, min_vaf: float = 0.0) -> DataFrame:
    """(site, vaf FLOAT) where not all elements are the reference's, with depth and VAF (percent) at least so much."""
    by = pile.groupBy(*SITE).agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.col("ref") == F.col("alt")).alias("same"))
    vaf = ((F.col("depth") - F.col("same")).cast("float") / F.col("depth").cast("float")).cast("float")
    return by.filter("depth <> same").withColumn("vaf", vaf).filter((F.col("depth") >= min_depth) & (F.col("vaf") >= F.lit(min_vaf / 100).cast("float"))).select(*SITE, "vaf")


def vaf_histogram(loci: DataFrame, bins: int = 20) -> DataFrame:
    """(sample_id, bin, bin_end, num_loci): bin = int(vaf * 100) less its rest by 100 // bins, in single precision."""
    if not 1 <= bins <= 100:
        raise ValueError("bins must be from 1 to 100")
    width = 100 // bins
    percent = (F.col("vaf") * F.lit(100.0).cast("float")).cast("float").cast("int")
    cut = loci.select("sample_id", (percent - percent % width).alias("bin"))
    return cut.groupBy("sample_id", "bin").agg(F.count(F.lit(1)).alias("num_loci")).select("sample_id", "bin", F.least(F.col("bin") + width, F.lit(100)).alias("bin_end"), "num_loci")


def genotype_likelihoods(pile: DataFrame, genotypes: DataFrame, use_mapq: bool = False, normalize: bool = False) -> DataFrame:
    """(site, genotype_id, ln_likelihood): sum over elements of ln sum over alleles of p(element, allele) * fraction.

    genotypes: (site, genotype_id, ref, alt, fraction), an allele once in each; p is the element's chance to be right where
    it shows the allele, else to be wrong.  Equal elements are counted before they are joined.
    """
    right = phred_to_success(F.col("qual").cast("double"))
    if use_mapq:
        right = right * phred_to_success(F.col("mapq").cast("double"))
    allele = F.concat_ws(">", "ref", "alt")
    counted = pile.select(*SITE, allele.alias("allele"), right.alias("p")).groupBy(*SITE, "allele", "p").agg(F.count(F.lit(1)).alias("m"))
    g = genotypes.groupBy(*SITE, "genotype_id").agg(F.map_from_entries(F.collect_list(F.struct(allele.alias("allele"), "fraction"))).alias("mix"), F.sum("fraction").alias("whole"))
    # sum of fraction * (p where the allele is shown, else 1 - p)
    shown = F.coalesce(F.try_element_at("mix", F.col("allele")), F.lit(0.0))
    share = shown * F.col("p") + (F.col("whole") - shown) * (1 - F.col("p"))
    out = counted.join(g, SITE).groupBy(*SITE, "genotype_id").agg(F.sum(F.col("m") * F.ln(share)).alias("ln_likelihood"))
    if normalize:
        w = W.partitionBy(*SITE)
        top = F.max("ln_likelihood").over(w)
        out = out.withColumn("top", top)
        out = out.withColumn("ln_likelihood", F.col("ln_likelihood") - F.ln(F.sum(F.exp(F.col("ln_likelihood") - F.col("top"))).over(w)) - F.col("top")).drop("top")
    return out


def two_genotype_probabilities(pile: DataFrame, genotypes: DataFrame, use_mapq: bool = False) -> DataFrame:
    """(site, genotype_id, probability): the chances of a site's two genotypes, which sum to one.

    genotypes as in genotype_likelihoods, with two ids at each site; another number of them is an error.
    """
    lik = genotype_likelihoods(pile, genotypes, use_mapq, normalize=True)
    n = F.count(F.lit(1)).over(W.partitionBy(*SITE))
    checked = F.when(n == 2, F.exp("ln_likelihood")).otherwise(F.raise_error(F.lit("a site needs two genotypes")).cast("double"))
    return lik.select(*SITE, "genotype_id", checked.alias("probability"))


def diploid_genotypes(pile: DataFrame) -> DataFrame:
    """Every unordered pair of a site's alleles with standard alternates: (site, genotype_id, ref, alt, fraction).

    A site has as many alleles as its reads show; pairs are built from their sorted array.
    """
    alleles = pile.filter(F.col("alt").rlike("^[ACGT]*$")).groupBy(*SITE).agg(F.array_sort(F.collect_set(F.struct("ref", "alt"))).alias("a"))
    first = alleles.select(*SITE, "a", F.posexplode("a").alias("i", "x"))
    pairs = first.select(*SITE, "x", F.explode(F.slice("a", F.col("i") + 1, F.size("a"))).alias("y"))
    key = F.concat_ws("/", F.concat_ws(">", "x.ref", "x.alt"), F.concat_ws(">", "y.ref", "y.alt"))
    half = F.array(F.struct("x.ref", "x.alt", F.lit(0.5).alias("fraction")), F.struct("y.ref", "y.alt", F.lit(0.5).alias("fraction")))
    whole = F.array(F.struct("x.ref", "x.alt", F.lit(1.0).alias("fraction")))
    mix = F.when(F.col("x") == F.col("y"), whole).otherwise(half)
    return pairs.select(*SITE, key.alias("genotype_id"), F.explode(mix).alias("m")).select(*SITE, "genotype_id", "m.*")


def diploid_likelihoods(pile: DataFrame, use_mapq: bool = False, normalize: bool = False, min_variants: int = 0) -> DataFrame:
    """(site, genotype_id, ln_likelihood) of every pair of a site's alleles, as genotype_likelihoods over diploid_genotypes gives them.

    Elements are counted by allele and chance to be right, then a site's counts are one array from which its
    alleles, their pairs and all likelihoods follow: the pileup is computed once and nothing is joined.
    Only sites with so many elements whose allele is not the reference's.
    """
    right = phred_to_success(F.col("qual").cast("double"))
    if use_mapq:
        right = right * phred_to_success(F.col("mapq").cast("double"))
    counted = pile.select(*SITE, F.struct("ref", "alt").alias("allele"), right.alias("p")).groupBy(*SITE, "allele", "p").agg(F.count(F.lit(1)).alias("m"))
    varied = F.sum(F.when(F.col("allele.ref") != F.col("allele.alt"), F.col("m")).otherwise(0))
    sites = counted.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct("allele", "p", "m"))).alias("seen"), varied.alias("varied")).filter(F.col("varied") >= min_variants)
    standard = F.filter(F.array_distinct(F.transform("seen", lambda s: s["allele"])), lambda a: a["alt"].rlike("^[ACGT]*$"))
    sites = sites.select(*SITE, "seen", F.array_sort(standard).alias("alleles"))
    name = lambda a: F.concat_ws(">", a["ref"], a["alt"])

    def likelihood(x: Column, y: Column) -> Column:
        share = lambda s: (F.when(s["allele"] == x, 0.5).otherwise(0.0) + F.when(s["allele"] == y, 0.5).otherwise(0.0))
        return F.aggregate("seen", F.lit(0.0), lambda acc, s: acc + s["m"] * F.ln(share(s) * s["p"] + (1 - share(s)) * (1 - s["p"])))

    pairs = F.flatten(F.transform("alleles", lambda x, i: F.transform(F.slice("alleles", i + 1, F.size("alleles")), lambda y: F.struct(F.concat_ws("/", name(x), name(y)).alias("genotype_id"), likelihood(x, y).alias("ln_likelihood")))))
    sites = sites.select(*SITE, pairs.alias("g"))
    value = F.col("e.ln_likelihood")
    if normalize:
        top = F.array_max(F.transform("g", lambda e: e["ln_likelihood"]))
        sites = sites.withColumn("whole", top + F.ln(F.aggregate("g", F.lit(0.0), lambda acc, e: acc + F.exp(e["ln_likelihood"] - top))))
        value = value - F.col("whole")
    return sites.select(*[c for c in sites.columns if c != "g"], F.explode("g").alias("e")).select(*SITE, "e.genotype_id", value.alias("ln_likelihood"))


def allele_evidence(pile: DataFrame) -> DataFrame:
    """Per site and allele: depths by strand, mean and median mapping quality, base quality and mismatches of the allele's reads."""
    noisy = pile.join(mismatches_per_read(pile), ["sample_id", "read_id"])
    by = noisy.groupBy(*SITE, "ref", "alt").agg(
        F.count(F.lit(1)).alias("allele_depth"), F.count_if("is_positive_strand").alias("allele_forward"),
        F.avg("mapq").alias("mean_mapq"), F.percentile("mapq", 0.5).alias("median_mapq"), F.avg("qual").alias("mean_base_quality"),
        F.percentile("qual", 0.5).alias("median_base_quality"), F.percentile("mismatches", 0.5).alias("median_mismatches"),
    )
    w = W.partitionBy(*SITE)
    return by.withColumn("depth", F.sum("allele_depth").over(w)).withColumn("forward", F.sum("allele_forward").over(w)).withColumn("vaf", F.col("allele_depth") / F.col("depth"))
