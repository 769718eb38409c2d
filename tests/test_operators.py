"""Operators on small tables with values worked out by hand."""

import math
import random

import pytest

from strandloom.functions import scalar as S
from strandloom.operators import assembly as A
from strandloom.operators import intervals as I
from strandloom.operators import kmers as K
from strandloom.operators import partition as P
from strandloom.operators import pileup as PU
from strandloom.operators.filters import ReadFilter, SomaticFilter, failing_names, insufficient_normal
from strandloom.plans import concordance, joint, vaf
from strandloom.plans.somatic import annotate_known, somatic_standard


def regions(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(x for c, s, e, n in rows for x in [(c, s, e)] * n)], "rid long, contig string, start long, end long")


REGIONS = [("chr1", 100, 105, 1), ("chr1", 101, 106, 1), ("chr2", 8, 9, 1), ("chr2", 9, 11, 1), ("chr2", 102, 105, 1), ("chr2", 103, 106, 10), ("chr5", 90, 91, 10)]


def test_coverage_by_sweep_and_by_position(spark):
    r = regions(spark, REGIONS)
    got = {(x.contig, x.locus): (x.depth, x.starts) for x in I.coverage(r, width=4).collect()}
    assert got == {(x.contig, x.locus): (x.depth, x.starts) for x in I.coverage_exploded(r).collect()}
    assert got["chr1", 100] == (1, 1) and got["chr1", 101] == (2, 1) and got["chr1", 105] == (1, 0)
    assert got["chr2", 103] == (11, 10) and got["chr2", 105] == (10, 0) and got["chr5", 90] == (10, 10)


def test_coverage_within_loci(spark):
    r = regions(spark, REGIONS)
    loci = spark.createDataFrame([("chr1", 102, 107), ("chr2", 7, 20)], "contig string, start long, end long")
    got = {(x.contig, x.locus): (x.depth, x.starts) for x in I.coverage(r, 1, loci, width=4).collect()}
    assert got == {
        ("chr1", 102): (2, 2), ("chr1", 103): (2, 0), ("chr1", 104): (2, 0), ("chr1", 105): (2, 0), ("chr1", 106): (1, 0),
        ("chr2", 7): (1, 1), ("chr2", 8): (2, 1), ("chr2", 9): (2, 0), ("chr2", 10): (1, 0), ("chr2", 11): (1, 0),
    }


def test_overlap_join_against_loops(spark):
    rng = random.Random(3)
    make = lambda n: [(f"c{rng.randrange(2)}", s := rng.randrange(60), s + rng.randrange(25)) for _ in range(n)]
    a, b = make(40), make(30)
    da = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "rid long, contig string, start long, end long")
    db = spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "rid long, contig string, start long, end long")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]))
    for broadcast in (False, True):
        assert sorted((r.rid, r.r_rid) for r in I.overlap_join(da, db, width=7, broadcast=broadcast).collect()) == want
        solid = db.filter("start < end")
        semi = I.overlap_join(da.filter("start < end"), solid, "semi", width=7, broadcast=broadcast)
        assert sorted(r.rid for r in semi.collect()) == sorted({i for i, _ in want})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "rid long, contig string, start long, end long")
    assert I.coverage(none).count() == I.merge_intervals(none).count() == P.uniform(none, 3).count() == 0
    assert I.overlap_join(none, none).count() == 0


def test_merge_and_shift(spark):
    t = spark.createDataFrame([("a", 1, 4), ("a", 4, 6), ("a", 9, 9), ("a", 300_000, 300_010), ("b", 0, 2)], "contig string, start long, end long")
    assert sorted(map(tuple, I.merge_intervals(t).collect())) == [("a", 1, 6), ("a", 300_000, 300_010), ("b", 0, 2)]
    assert sorted(map(tuple, I.shift_loci(t).collect()))[:2] == [("a", 0, 3), ("a", 3, 5)]


def test_uniform(spark):
    t = spark.createDataFrame([("chrM", 0, 16571)], "contig string, start long, end long")
    assert [tuple(r) for r in P.uniform(t, 4).orderBy("partition").collect()] == [("chrM", 0, 4143, 0), ("chrM", 4143, 8286, 1), ("chrM", 8286, 12428, 2), ("chrM", 12428, 16571, 3)]
    assert P.uniform(spark.createDataFrame([("a", 0, 2)], t.schema), 5).count() == 2
    assert P.uniform(spark.createDataFrame([("a", 0, 3_000_000_000)], t.schema), 2000).count() == 2000


def test_micro_regions(spark):
    r = regions(spark, [("chr1", 5, 6, 1), ("chr1", 6, 7, 1), ("chr1", 7, 8, 1), ("chr1", 8, 9, 1)])
    got = P.micro_region(r, spark.createDataFrame([("chr1", 0, 100)], "contig string, start long, end long"), 2, accuracy=50)
    assert [tuple(x) for x in got.orderBy("start").collect()] == [("chr1", 0, 7, 0), ("chr1", 7, 100, 1)]


@pytest.mark.parametrize("trim, rows, want", [
    (False, [("chr1", 10, 1, 1), ("chr1", 11, 6, 5), ("chr1", 12, 15, 10), ("chr1", 13, 10, 10), ("chr1", 14, 10, 5), ("chr1", 15, 11, 1), ("chr2", 20, 1, 1), ("chr2", 21, 4, 3), ("chr2", 22, 11, 7), ("chr2", 23, 14, 3), ("chr2", 24, 15, 1)],
     [[("chr1", 10, 12)], [("chr1", 12, 13)], [("chr1", 13, 15)], [("chr1", 15, 16), ("chr2", 20, 22)], [("chr2", 22, 25)]]),
    (False, [("chr1", 10, 1, 1), ("chr1", 11, 6, 5), ("chr1", 12, 15, 10), ("chr1", 13, 16, 10), ("chr1", 14, 11, 5), ("chr1", 15, 12, 1)], [[("chr1", 10, 12)], [("chr1", 12, 13)], [("chr1", 14, 16)]]),
    (False, [("chr1", 10, 1, 1), ("chr1", 11, 6, 5), ("chr1", 12, 15, 10), ("chr1", 13, 16, 10)], [[("chr1", 10, 12)], [("chr1", 12, 13)]]),
    (False, [("chr1", 10, 1, 1), ("chr1", 11, 6, 5), ("chr2", 1, 2, 2), ("chr3", 7, 3, 3), ("chr3", 9, 4, 3), ("chr4", 20, 2, 2)], [[("chr1", 10, 12), ("chr2", 1, 2), ("chr3", 7, 10)], [("chr4", 20, 21)]]),
    (True, [("chr1", 10, 1, 1), ("chr1", 11, 6, 5), ("chr2", 1, 2, 2), ("chr3", 7, 3, 3), ("chr3", 9, 4, 3), ("chr4", 20, 2, 2)], [[("chr1", 10, 12), ("chr2", 1, 2), ("chr3", 7, 8), ("chr3", 9, 10)], [("chr4", 20, 21)]]),
])
def test_take_loci(trim, rows, want):
    assert list(P.take_loci(rows, 15, trim)) == want


def test_capped_never_exceeds(spark):
    r = regions(spark, [("c", i, i + 7, 1 + i % 3) for i in range(0, 60, 2)])
    parts = P.capped(r, None, 12, span=16)
    copies = P.partition_copies(r, parts)
    assert max(x.regions for x in P.partition_stats(copies)[1].collect()) <= 12


READ = "read_id long, sample_id int, contig string, start long, sequence string, base_qualities array<int>, mapq int, cigar string, is_positive_strand boolean"


def pile(spark, reads, reference):
    rows = [(i, s, "c", start, seq, [q] * len(seq), 30, cigar, i % 2 == 0) for i, (s, start, seq, cigar, q) in enumerate(reads)]
    ref = spark.createDataFrame([("c", 0, reference)], "contig string, offset long, sequence string")
    return PU.elements(spark.createDataFrame(rows, READ), ref)


def test_pileup_kinds(spark):
    got = pile(spark, [(0, 2, "ACGGTTT", "2M1I2D4M", 31)], "NNACTTTGTTNN")
    rows = {r.locus: (r.aln_type, r.ref, r.alt, r.qual) for r in got.collect()}
    assert rows[2] == ("Match", "A", "A", 31) and rows[3] == ("Insertion", "C", "CG", 31)
    assert rows[4][:3] == ("MidDeletion", "T", "") and rows[5][:3] == ("MidDeletion", "T", "")
    assert rows[6] == ("Mismatch", "T", "G", 31) and rows[7] == ("Mismatch", "G", "T", 31) and sorted(rows) == list(range(2, 10))


def test_pileup_deletion_clip_and_start(spark):
    got = pile(spark, [(0, 1, "GGACA", "2S2M2D1M", 20), (0, 0, "TTAC", "2I2M", 25), (0, 3, "AC", "1M3N1M", 10)], "ACTTACGT")
    rows = sorted((r.read_id, r.locus, r.aln_type, r.ref, r.alt) for r in got.collect())
    assert (0, 2, "Deletion", "TTA", "T") in rows and (0, 3, "MidDeletion", "T", "") in rows and (0, 5, "Mismatch", "C", "A") in rows
    assert (1, 0, "Insertion", "A", "TTA") in rows and (1, 0, "Match", "A", "A") in rows
    assert (2, 4, "Clipped", "", "") in rows and (2, 7, "Mismatch", "T", "C") in rows


def test_genotype_likelihoods(spark):
    p = spark.createDataFrame([(0, "c", 1, "C", "C", 30, 60, True), (0, "c", 1, "C", "C", 40, 60, True), (0, "c", 1, "C", "A", 30, 60, False)], "sample_id int, contig string, locus long, ref string, alt string, qual int, mapq int, is_positive_strand boolean")
    got = {r.genotype_id: r.ln_likelihood for r in PU.genotype_likelihoods(p, PU.diploid_genotypes(p)).collect()}
    e3, e4 = 1e-3, 1e-4
    assert math.isclose(got["C>C/C>C"], math.log((1 - e3) * (1 - e4) * e3)) and math.isclose(got["C>A/C>C"], math.log(1 / 8)) and math.isclose(got["C>A/C>A"], math.log(e3 * e4 * (1 - e3)))
    norm = PU.genotype_likelihoods(p, PU.diploid_genotypes(p), normalize=True)
    assert math.isclose(sum(math.exp(r.ln_likelihood) for r in norm.collect()), 1)


def test_vaf_histogram(spark):
    t = spark.createDataFrame([(0, "c", 1, 0.25), (0, "c", 2, 0.35), (0, "c", 3, 0.4), (0, "c", 4, 0.5), (0, "c", 5, 0.55), (0, "c", 6, 0.29)], "sample_id int, contig string, locus long, vaf float")
    assert {r.bin: r.num_loci for r in PU.vaf_histogram(t, 20).collect()} == {25: 2, 35: 1, 40: 1, 50: 1, 55: 1}
    assert {r.bin: r.num_loci for r in PU.vaf_histogram(t, 100).collect()}[29] == 1
    with pytest.raises(ValueError):
        PU.vaf_histogram(t, 0)


def test_statistics(spark):
    t = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4)], "sample_id int, vaf float")
    r = vaf.statistics(t).first()
    assert (r.p25, r.p50, r.p75, r.mean) == (1.25, 2.5, 3.75, 2.5)


def test_kmers(spark):
    t = spark.createDataFrame([("TCATCTCAAAAGAGATCGA",), ("GT",), ("",)], "sequence string")
    got = {r.kmer: r.n for r in K.kmer_counts(t, 8).collect()}
    assert len(got) == 13 and got["GT"] == 1
    assert K.kmer_edges(K.kmer_counts(t, 8), 8).count() == 11


def test_alignment():
    assert A.align("TCGA", "TCGA")[2] == "4=" and A.align("TCCGA", "TCGA")[2] == "1=1I3=" and A.align("TCATCTCAAAAGAGATCGA", "TCATCTCAAAAGAGATCGA")[2] == "19="
    assert A.align("TCGATCTGATCGA", "TCGACCCTCTGATCGA")[2].count("D") == 1
    assert A.align("GTA", "GCA")[2] == "1=1X1="
    cost, start, cigar = A.align("CGT", "AACGTAA")
    assert start == 2 and cigar == "3="


def test_graph_paths():
    g = A.KmerGraph.from_reads([("AAATCCC", 30.0), ("AAAGCCC", 30.0)], 3)
    assert sorted(g.paths("AAA", "CCC")) == ["AAAGCCC", "AAATCCC"]
    assert A.path_variants("AAAGCCC", "AAATCCC") == [(3, "T", "G")]
    assert A.KmerGraph.from_reads([("TCATCTTAA", 30.0)], 4).unitigs() == ["TCATCTTAA"]
    with pytest.raises(ValueError):
        A.haplotypes([], "ACG", 4)


def test_read_filters(spark):
    t = spark.createDataFrame([(True, False, False, True, 60), (True, True, False, True, 60), (False, False, False, True, None), (True, False, True, True, 60), (True, False, False, False, 5)], "is_mapped boolean, is_duplicate boolean, failed_qc boolean, is_paired boolean, mapq int")
    assert ReadFilter()(t).count() == 2 and ReadFilter(only_mapped=True)(t).count() == 1 and ReadFilter(min_mapq=20, include_single_end=True)(t).count() == 2


def test_somatic_calls_and_filters(spark):
    reads = [(0, 0, "ACGT", "4M", 30)] * 12 + [(0, 0, "AGGT", "4M", 30)] * 8 + [(1, 0, "ACGT", "4M", 30)] * 20
    p = pile(spark, reads, "ACGT")
    calls = somatic_standard(p.filter("sample_id = 0"), p.filter("sample_id = 1"), mismatches=True)
    row = calls.first()
    assert calls.count() == 1 and (row.start, row.end, row.ref, row.alt, row.tumor_depth, row.tumor_allele_depth) == (1, 2, "C", "G", 20, 8)
    assert SomaticFilter()(calls).count() == 1 and SomaticFilter(min_vaf=40)(calls).count() == 0 and SomaticFilter(max_median_mismatches=0)(calls).count() == 0
    known = spark.createDataFrame([("c", 1, "C", "G", ["rs77"], True), ("c", 1, "C", "G", ["odd"], True)], "contig string, start long, ref string, alt string, names array<string>, db_snp boolean")
    assert sorted((r.rs_id or 0) for r in annotate_known(calls, known).collect()) == [0, 77]
    clipped = pile(spark, [(0, 0, "ACGT", "4S", 30), (1, 0, "ACGT", "4M", 30)], "ACGT")
    assert somatic_standard(clipped.filter("sample_id = 0"), clipped.filter("sample_id = 1")).count() == 0


def test_joint_caller(spark):
    reads = [(1, 0, "ACGTA", "5M", 30)] * 40 + [(0, 0, "ACGTA", "5M", 30)] * 20 + [(0, 0, "ACTTA", "5M", 30)] * 20
    p = pile(spark, reads, "ACGTA")
    samples = spark.createDataFrame([(1, "normal", "dna"), (0, "tumor", "dna")], "sample_id int, tissue string, analyte string")
    cands = joint.candidate_alleles(p)
    assert [tuple(r) for r in cands.collect()] == [("c", 2, 3, "G", "T", 20)]
    calls = joint.joint_calls(joint.sample_evidence(joint.read_support(p, cands), samples)).collect()
    assert calls[0].is_somatic and not calls[0].is_germline and sorted(calls[0].triggered) == [-2, 0]
    both = pile(spark, [(s, 0, x, "5M", 30) for s in (0, 1) for x in ["ACGTA"] * 20 + ["ACTTA"] * 20], "ACGTA")
    germ = joint.choose_alleles(joint.joint_calls(joint.sample_evidence(joint.read_support(both, joint.candidate_alleles(both)), samples))).collect()
    assert germ[0].is_germline and germ[0].germline == "het"


def test_compare(spark):
    e = spark.createDataFrame([("c", 1, "A", "C"), ("c", 5, "A", "C"), ("c", 9, "A", "C")], "contig string, start long, ref string, alt string")
    g = spark.createDataFrame([("c", 1, "A", "C"), ("c", 5, "A", "G"), ("c", 7, "A", "C")], e.schema)
    c = concordance.compare(e, g)
    assert {r.outcome: r.n for r in concordance.counts(c).collect()} == {"exact": 1, "partial": 1, "only_called": 1, "only_expected": 1}
    s = concordance.scores(c).first()
    assert math.isclose(s.precision, 1 / 3) and math.isclose(s.recall, 1 / 3)
    assert concordance.scores(concordance.compare(e.limit(0), g.limit(0))).first().precision is None


def test_site_predicates(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(29, 29, [["a"], []], [True, False], ["s"]), (100, 96, [["a"], []], [True, True], []), (100, 98, [[], []], [False, False], [])], "n int, r int, f array<array<string>>, t array<boolean>, s array<string>")
    got = t.select(insufficient_normal(F.col("n"), F.col("r")).alias("i"), failing_names(F.col("f"), F.col("t"), F.col("s")).alias("x")).collect()
    assert [(r.i, r.x) for r in got] == [(True, ["a", "s"]), (True, []), (False, [])]


def test_slice_reads(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(0, "c", 10, "AACCGGTT", list(range(8)), "2S2M1I1D3M"), (1, "c", 40, "ACGT", [1, 2, 3, 4], "4M")], "read_id long, contig string, start long, sequence string, base_qualities array<int>, cigar string")
    got = {x.read_id: (x.start, x.end, x.sequence, x.base_qualities, x.cigar) for x in PU.slice_reads(r, F.lit(11), F.lit(15)).collect()}
    assert got == {0: (11, 15, "CGGT", [3, 4, 5, 6], "1M1I1D2M")}
    whole = PU.slice_reads(r, F.lit(0), F.lit(99)).filter("read_id = 0").first()
    assert (whole.start, whole.end, whole.sequence, whole.cigar) == (10, 16, "AACCGGTT", "2S2M1I1D3M")


def test_joint_annotations(spark):
    reads = [(1, 0, "ACGTA", "5M", 30)] * 10 + [(0, 0, "ACGTA", "5M", 30)] * 20 + [(0, 0, "ACTTA", "5M", 30)] * 20
    p = pile(spark, reads, "ACGTA")
    samples = spark.createDataFrame([(1, "normal", "dna"), (0, "tumor", "dna")], "sample_id int, tissue string, analyte string")
    evidence = joint.sample_evidence(joint.read_support(p, joint.candidate_alleles(p)), samples)
    calls = joint.annotate(joint.joint_calls(evidence), evidence).collect()
    assert [c.failing for c in calls] == [["INSUFFICIENT_NORMAL"]]
    with pytest.raises(Exception, match="normal RNA"):
        joint.sample_evidence(joint.read_support(p, joint.candidate_alleles(p)), spark.createDataFrame([(1, "normal", "rna")], samples.schema)).collect()


def test_depth_report(spark):
    text = I.depth_report(I.coverage(regions(spark, REGIONS)), 5)
    assert text.splitlines()[0] == "10 positions of depth 5 or less, 4 deeper (28.57 %)" and "chr5:90-91 dropped 1" in text


def test_semi_join_on_all_levels(spark):
    import random

    rng = random.Random(3)
    loci = [("c", s, s + n) for s, n in [(rng.randrange(0, 4_000_000), rng.choice([1, 5, 4096, 9000])) for _ in range(40)]] + [("d", 0, 300_000_000), ("c", 7, 7)]
    reads = [(rng.choice("cde"), s, s + n) for s, n in [(rng.randrange(0, 4_000_000), rng.choice([0, 1, 100, 5000, 2_000_000])) for _ in range(300)]]
    reads += [(c, max(0, at + d), max(0, at + d) + 10) for c, s, e in loci[:40] for at in (s, e) for d in (-11, -10, -9, -1, 0, 1)]
    got = I.overlapping(spark.createDataFrame(reads, "contig string, start long, end long"), spark.createDataFrame(loci[:40], "contig string, start long, end long"))
    want = [r for r in reads if any(r[0] == c and r[1] < e and r[2] > s for c, s, e in loci[:40])]
    assert sorted(map(tuple, got.collect())) == sorted(want) and "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    got = I.overlap_join(spark.createDataFrame(reads, "contig string, start long, end long"), spark.createDataFrame(loci, "contig string, start long, end long"), "semi", broadcast=True)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in reads if any(r[0] == c and r[1] < e and r[2] > s and s < e for c, s, e in loci))


def test_capped_against_the_walk(spark):
    import random

    rng = random.Random(9)
    for trim in (False, True):
        rows = [(c, s, s + rng.randrange(1, 25), rng.choice([1, 1, 2, 9])) for c in "ab" for s in rng.sample(range(600), 150)]
        r = regions(spark, rows)
        cov = sorted(map(tuple, I.coverage(r).collect()))
        for span in (64, 1 << 20):
            for tasks in (1, 5):
                got = {}
                for x in P.capped(r.repartition(tasks), None, 20, trim=trim, span=span).collect():
                    got.setdefault(x.partition, []).append((x.contig, x.start, x.end))
                want = []
                for key in sorted({(c, locus // span) for c, locus, *_ in cov}):
                    want += P.take_loci([x for x in cov if (x[0], x[1] // span) == key], 20, trim)
                assert [sorted(got[i]) for i in range(len(got))] == want


def test_diploid_likelihoods_are_the_general_ones(spark):
    import random

    rng = random.Random(2)
    rows = [(s, "c", locus, ref, rng.choice([ref, ref, "A", "G", "GT", "", "N"]), rng.randrange(2, 40), rng.randrange(1, 60), True) for s in (0, 1) for locus, ref in enumerate("ACGTAC") for _ in range(30)]
    p = spark.createDataFrame(rows, "sample_id int, contig string, locus long, ref string, alt string, qual int, mapq int, is_positive_strand boolean")
    for options in ({}, {"use_mapq": True}, {"normalize": True}):
        a = {(x.sample_id, x.locus, x.genotype_id): x.ln_likelihood for x in PU.diploid_likelihoods(p, **options).collect()}
        b = {(x.sample_id, x.locus, x.genotype_id): x.ln_likelihood for x in PU.genotype_likelihoods(p, PU.diploid_genotypes(p), **options).collect()}
        assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    few = PU.diploid_likelihoods(p, min_variants=1000)
    assert few.count() == 0


def test_germline_calls_against_the_walk(spark):
    """Every site by plain loops: gate, activity, assembly or genotype, jumps and the last call."""
    import random

    from strandloom.plans import germline as G

    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(9000))
    k, half = 9, 20
    changed = {i: rng.choice([c for c in "ACGT" if c != genome[i]]) for i in [*rng.sample(range(60, 8900), 30), 4100, 4104, 5000, 5003]}
    rows = []
    for i in range(1540):
        start = rng.randrange(0, len(genome) - 60) if i < 1500 else 6955 + i - 1500  # enough reads over the deletion
        hap = rng.random() < 0.5 or i >= 1500
        seq = "".join(changed.get(p, genome[p]) if hap else genome[p] for p in range(start, start + 50))
        cigar = "50M"
        if hap and start < 7000 < start + 40 and 7000 - start > 5:  # a deletion of three bases
            at = 7000 - start
            seq, cigar = "".join(changed.get(p, genome[p]) for p in [*range(start, 7000), *range(7003, start + 53)]), f"{at}M3D{50 - at}M"
        rows.append((i, 0, "c", start, seq, [30] * 50, 40, cigar, i % 2 == 0))
    reads = spark.createDataFrame(rows, READ).selectExpr("*", "cast(start + if(cigar = '50M', 50, 53) as long) as end")
    ref = spark.createDataFrame([("c", 0, genome)], "contig string, offset long, sequence string")
    pileup = PU.elements(reads, ref)
    elements = [(e.read_id, e.locus, e.ref, e.alt, e.aln_type) for e in pileup.collect()]
    noisy = {i for i, *_ in rows if sum(e[0] == i and e[4] == "Mismatch" for e in elements) > 1} | {r[0] for r in rows if r[7] != "50M"}
    at = {}
    for read, locus, a, b, _ in elements:
        at.setdefault(locus, []).append((read, a != b))
    best = {r.locus: r for r in G.germline_shortcut(pileup).collect()}
    spans = sorted((r[3], r[3] + (50 if r[7] == "50M" else 53), r[4], 30.0) for r in rows)
    for shortcut in (False, True):
        want, state = set(), {}
        for locus in sorted(at):
            if sum(v for _, v in at[locus]) < 2:
                continue
            chunk = max(0, locus - half) // PU.CHUNK
            last, resume = state.get(chunk, (-1, -1))
            if locus < resume:
                continue
            busy = 100 * sum(r in noisy for r, _ in at[locus]) / len(at[locus]) > 5
            if shortcut and not busy:
                if locus in best:
                    want |= {(locus, *a.split(">"), 0) for a in best[locus].genotype_id.split("/") if a.split(">")[0] != a.split(">")[1] and a.split(">")[1]}
                    state[chunk] = (locus, resume)
                continue
            begin = max(0, locus - half)
            window = genome[begin : locus + half]
            found = A.haplotypes([(s, q) for a, b, s, q in spans if a <= locus + half and b > locus - half], window, k, 3) if len(window) >= k else []
            if found:
                new = {(begin + o, r, a, len(found)) for p in found for o, r, a in A.path_variants(p, window) if begin + o > last}
                want |= new
                state[chunk] = (max([v[0] for v in new], default=last), locus + half - k)
        out = G.germline_calls(reads, pileup, ref, k, half, 3, shortcut=shortcut)
        got = {(r.start, r.ref, r.alt): r for r in out.collect()}
        assert set(got) == {v[:3] for v in want} and len(got) >= 15
        assert {(*key, r.n_haplotypes) for key, r in got.items()} <= want
        assert any(6990 <= start <= 7005 and len(ref_) == 4 and len(alt) == 1 for start, ref_, alt in got)


def test_truncated_join(spark):
    from pyspark.sql import functions as F

    def join(pieces, most):
        return spark.createDataFrame([(pieces,)], "p array<string>").select(S.truncated_join(F.col("p"), most)).first()[0]

    assert join(["a", "b"], 500) == "a,b" and join([], 500) == ""
    assert join(["abc", "de", "f"], 10) == "abc, [...]"  # 10, then 6 are left: not more than the ellipsis has
    assert join(["abc", "de", "f"], 11) == "abc,de, [...]"
    assert join(["abc"], 6) == " [...]" and join(["abcdefghij"], 7) == "abcdefghij"


def test_consensus_sequences(spark):
    reads = spark.createDataFrame([("c", 0, 8, "AACCGGTT", "8M"), ("c", 2, 10, "CCGGTTAA", "4M4M"), ("c", 2, 10, "CCGGTTAA", "4M1I3M"), ("c", 3, 11, "TTTTTTTT", "8M"), ("d", 0, 8, "AACCGGTT", "8M")], "contig string, start long, end long, sequence string, cigar string")
    spots = spark.createDataFrame([("c", 2, 6), ("c", 2, 6), ("c", 3, 12)], "contig string, start long, end long")
    got = lambda n: sorted(tuple(r) for r in K.consensus_sequences(reads, spots, n).collect())
    assert got(2) == [("c", 2, 6, "CCGG", 2)] and got(3) == []
    wide = spark.createDataFrame([("c", 3, 8)], spots.schema)
    assert sorted(tuple(r)[3:] for r in K.consensus_sequences(reads, wide, 1).collect()) == [("CGGTT", 2), ("TTTTT", 1)]


def test_two_genotype_probabilities(spark):
    from pyspark.sql import functions as F

    p = pile(spark, [(0, 0, "ACGT", "4M", 30)] * 4 + [(0, 0, "ATGT", "4M", 30)] * 4, "ACGT").filter("locus = 1")
    mixes = spark.createDataFrame([(0, "c", 1, "hom", "C", "C", 1.0), (0, "c", 1, "het", "C", "C", 0.5), (0, "c", 1, "het", "C", "T", 0.5)], "sample_id int, contig string, locus long, genotype_id string, ref string, alt string, fraction double")
    got = {r.genotype_id: r.probability for r in PU.two_genotype_probabilities(p, mixes).collect()}
    assert math.isclose(sum(got.values()), 1) and got["het"] > 0.99
    with pytest.raises(Exception, match="two genotypes"):
        PU.two_genotype_probabilities(p, mixes.filter("genotype_id = 'hom'")).collect()
    assert PU.two_genotype_probabilities(p.filter(F.lit(False)), mixes).count() == 0


def test_loci_stats(spark):
    t = spark.createDataFrame([("a", 0, 10, 0), ("b", 0, 3, 0), ("b", 5, 6, 0), ("b", 9, 20, 1)], "contig string, start long, end long, partition int")
    assert sorted(tuple(r) for r in P.loci_stats(t).collect()) == [(0, 14, 2, 3, 10), (1, 11, 1, 1, 11)]
    assert P.loci_stats(t.limit(0)).count() == 0


def test_window_fold_does_not_depend_on_tasks(spark):
    rows = [("c", i, (i * 7) % 11) for i in range(40)] + [("d", i, i) for i in range(5)]

    def add(total, row):
        total += row["depth"]
        return total, [(row["contig"], row["locus"], total)] if total % 2 else []

    want = []
    for contig in "cd":
        total, span = 0, None
        for c, i, v in rows:
            if c == contig:
                total, span = (total if i // 16 == span else 0) + v, i // 16
                want += [(c, i, total)] if total % 2 else []
    for tasks in (1, 5):
        t = spark.createDataFrame(rows[::-1], "contig string, locus long, depth long").repartition(tasks)
        assert sorted(tuple(r) for r in I.window_fold(t, 0, add, "contig string, locus long, total long", span=16).collect()) == want
    assert I.window_fold(t.limit(0), 0, add, "contig string, locus long, total long").count() == 0


def test_coverage_cache(spark):
    cache = I.CoverageCache(regions(spark, REGIONS))
    loci = lambda end: spark.createDataFrame([("chr1", 0, end)], "contig string, start long, end long")
    one, chosen = cache(), loci(10)
    assert cache(0) is one and cache(1) is not one and cache(0, chosen) is cache(0, chosen) and cache(0, chosen) is not cache(0, loci(11))
    assert one.is_cached and sorted(one.collect()) == sorted(I.coverage(regions(spark, REGIONS)).collect())
    cache.release()
    assert not one.is_cached and cache() is not one


def test_allele_contexts(spark):
    t = spark.createDataFrame([("c", 2, 3, "G", "T", 7), ("c", 0, 1, "A", "C", 1), ("c", 5, 6, "C", "A", 2), ("x", 2, 3, "G", "T", 3)], "contig string, start long, end long, ref string, alt string, n long")
    ref = spark.createDataFrame([("c", 0, "ACGTAC")], "contig string, offset long, sequence string")
    got = sorted(tuple(r) for r in joint.change_context(t, ref, 1, 2).collect())
    assert got == [("c", 0, 1, "A", "C", 1), ("c", 1, 5, "CGTA", "CTTA", 7), ("c", 5, 6, "C", "A", 2), ("x", 2, 3, "G", "T", 3)]
    assert joint.change_context(t, ref, 0, 0).exceptAll(t).count() == 0


def test_fallback_alleles(spark):
    p = pile(spark, [(0, 0, "ACGTA", "5M", 30)] * 9 + [(0, 0, "ACTTA", "5M", 30), (1, 0, "ACTTA", "5M", 30)], "ACGTA")
    found = joint.candidate_alleles(p, joint.Parameters(min_percent=50.0, min_reads=3))
    sites = spark.createDataFrame([("c", 2), ("c", 2), ("c", 3), ("c", 99), ("z", 1)], "contig string, start long")
    assert found.count() == 0
    assert sorted(tuple(r) for r in joint.fallback_alleles(p, sites, found).collect()) == [("c", 2, 3, "G", "T", 2), ("c", 3, 4, "T", "N", 0)]
    both = joint.fallback_alleles(p, sites, spark.createDataFrame([("c", 3, 4, "T", "A", 5)], "contig string, start long, end long, ref string, alt string, n long"))
    assert sorted(tuple(r) for r in both.collect()) == [("c", 2, 3, "G", "T", 2), ("c", 3, 4, "T", "A", 5)]


def test_alleles_rank_by_posterior(spark):
    rows = [("c", 1, 2, "A", "C", False, True, -3.0, 50), ("c", 1, 2, "A", "G", False, True, -2.0, 9), ("c", 5, 6, "A", "C", True, False, -9.0, 1), ("c", 5, 6, "A", "G", False, True, -1.0, 1)]
    t = spark.createDataFrame(rows, "contig string, start long, end long, ref string, alt string, is_germline boolean, is_somatic boolean, posterior double, tumor_alt_depth long")
    assert sorted((r.start, r.alt) for r in joint.choose_alleles(t).collect()) == [(1, "G"), (5, "C")]


def test_statistics_of_ties_against_sorting(spark):
    rng = random.Random(8)
    values = [rng.choice([0.125, 0.25, 0.5, 0.75, 1.0]) for _ in range(101)]
    t = spark.createDataFrame([(0, v) for v in values] + [(1, 0.5)], "sample_id int, vaf float")
    got = {r.sample_id: r for r in vaf.statistics(t).collect()}
    order = sorted(values)

    def at(p):
        pos = p * (len(order) + 1)
        low = int(pos)
        return order[low - 1] + (pos - low) * (order[low] - order[low - 1])

    assert (got[0].n, got[0].min, got[0].max) == (101, order[0], order[-1]) and math.isclose(got[0].mean, sum(values) / 101)
    assert all(math.isclose(a, at(p)) for a, p in ((got[0].p25, 0.25), (got[0].p50, 0.5), (got[0].p75, 0.75)))
    assert tuple(got[1])[1:] == (1, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5) and vaf.statistics(t.limit(0)).count() == 0


def test_windows_without_regions(spark):
    r = regions(spark, REGIONS)
    spots = spark.createDataFrame([("chr1", 100), ("chr1", 300), ("chr1", 300), ("chr9", 5)], "contig string, locus long")
    assert sorted((x.contig, x.locus) for x in I.window_regions(r, spots.distinct(), 0).collect()) == [("chr1", 100)]
    got = sorted((x.contig, x.locus, x.rid) for x in I.window_regions(r, spots.distinct(), 0, keep_empty=True).collect())
    assert got == [("chr1", 100, 0), ("chr1", 300, None), ("chr9", 5, None)]


def test_read_elements_are_the_pileup_by_read(spark):
    import random

    rng = random.Random(5)
    cigars = ["12M", "3S9M", "4M2I6M", "4M3D8M", "3=1X8=", "4M3N8M", "2I10M", "1S2I9M", "3X2I7M", "3X2D9M", "2M1I1M1D8M", "5M2I", "5H12M"]
    rows = []
    for i in range(400):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([12, 12, 12, 5])))
        rows.append((i, i % 2, rng.choice("cd"), rng.choice([0, 0, 3, 30, 4090, 4999]), seq, [rng.randrange(2, 40) for _ in seq], rng.randrange(1, 60), rng.choice(cigars), i % 3 == 0))
    rows += [(400, 0, "c", 3, None, None, 9, "4M2I2M2D4M", True), (401, 0, "c", 3, "ACGT", [1, None, 3, 4], 9, "4M", True), (402, 0, "c", 3, "ACGT", [1, 2, 3, 4], 9, "*", True)]
    reads = spark.createDataFrame(rows, READ)
    ref = spark.createDataFrame([("c", 0, "".join(rng.choice("ACGT") for _ in range(5005)))], "contig string, offset long, sequence string")
    names = ["read_id", "sample_id", "contig", "mapq", "is_positive_strand", "loci", "refs", "alts", "quals", "differs"]
    got = {r.read_id: tuple(r) for r in PU.read_elements(reads, ref).select(*names).collect() if r.loci}
    want = {r.read_id: tuple(r) for r in PU.by_read(PU.elements(reads, ref)).select(*names).collect()}
    assert len(want) == 402 and got == want


def test_joint_caller_by_read(spark, monkeypatch):
    """Reads are not shuffled, and candidates that are too many to be sent to all give the same evidence."""
    import random

    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    rows = []
    for i in range(600):
        start = rng.randrange(0, 260)
        seq = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[b] if p % 17 == 3 and i % 3 else b for p, b in enumerate(genome[start : start + 30], start))
        rows.append((i, i % 2, "c", start, seq, [rng.randrange(2, 40) for _ in seq], rng.randrange(0, 60), rng.choice(["30M", "10M2I18M", "12M3D18M", "3S27M"]), i % 2 == 0))
    reads = spark.createDataFrame(rows, READ)
    ref = spark.createDataFrame([("c", 0, genome)], "contig string, offset long, sequence string")
    samples = spark.createDataFrame([(1, "normal", "dna"), (0, "tumor", "dna")], "sample_id int, tissue string, analyte string")
    whole = PU.read_elements(reads, ref)
    key = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    support = joint.read_support(whole, joint.candidate_alleles(whole))
    assert "Exchange hashpartitioning" not in support._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").replace("Exchange hashpartitioning(contig", "join of the reference")
    evidence = key(joint.sample_evidence(support, samples).collect())
    by_element = PU.elements(reads, ref)
    cands = joint.candidate_alleles(by_element)
    assert len(evidence) > 100 and key(cands.collect()) == key(joint.candidate_alleles(whole).collect())
    assert key(joint.sample_evidence(joint.read_support(by_element, cands), samples).collect()) == evidence
    monkeypatch.setattr(joint, "BROADCAST", 3)
    assert key(joint.read_support(whole, cands).collect()) == key(support.collect())
    assert key(joint.sample_evidence(joint.read_support(whole, cands), samples).collect()) == evidence
