"""Readers and writers over files made here."""

import struct
import zlib

import pytest

from strandloom.operators.filters import ReadFilter
from strandloom.sources import reference as REF
from strandloom.sources import sam, sinks

LINES = [
    "@HD\tVN:1.0", "@SQ\tSN:1\tLN:100", "@SQ\tSN:2\tLN:50",
    "r1\t99\t1\t11\t60\t2S3M1D2M\t=\t31\t40\tACGTACG\tIIIIIII", "r2\t147\t1\t31\t60\t4M\t=\t11\t-40\tACGT\t*", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII", "r4\t1024\t2\t2\t7\t4M\t*\t0\t0\tacgt\t!!!!",
    "r5\t0\t2\t1\t7\t3S4M\t*\t0\t0\tACGTACG\tIIIIIII",
]


@pytest.fixture
def sam_file(tmp_path):
    path = tmp_path / "a.sam"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


def bam_bytes():
    names = [b"1\0", b"2\0"]
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n)) + n + struct.pack("<i", size) for n, size in zip(names, (100, 50)))
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    for line in LINES[3:]:
        name, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual = line.split("\t")
        ops = [] if cigar == "*" else [(int(n) << 4) | "MIDNSHP=X".index(o) for n, o in __import__("re").findall(r"(\d+)(.)", cigar)]
        seq = seq.upper()
        nib = [code[c] for c in seq] + [0] * (len(seq) % 2)
        ref = {"*": -1, "1": 0, "2": 1}[rname]
        nxt = ref if rnext == "=" else -1
        rec = struct.pack("<iiBBHHHiiii", ref, int(pos) - 1, len(name) + 1, int(mapq), 0, len(ops), int(flag), len(seq), nxt, int(pnext) - 1, int(tlen)) + name.encode() + b"\0"
        rec += struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(nib[::2], nib[1::2])) + (b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual))
        body += struct.pack("<i", len(rec)) + rec
    out = b""
    for i in range(0, len(body), 100):  # several members
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += c.compress(body[i : i + 100]) + c.flush()
    return out


def test_sam_fields(spark, sam_file):
    r = {x.name: x for x in sam.read_sam(spark, sam_file).collect()}
    a = r["r1"]
    assert (a.contig, a.start, a.end, a.unclipped_start, a.is_first_in_pair, a.is_positive_strand, a.base_qualities) == ("1", 10, 16, 8, True, True, [40] * 7)
    assert (a.mate.contig, a.mate.start, a.mate.insert_size, a.mate.is_positive_strand) == ("1", 30, 40, False)
    assert r["r2"].base_qualities == [0] * 4 and not r["r2"].is_positive_strand
    assert not r["r3"].is_mapped and r["r3"].contig is None and r["r4"].is_duplicate and r["r4"].sequence == "ACGT" and r["r4"].mate is None
    assert not r["r5"].is_mapped  # its clipped bases begin before the contig
    assert sorted(map(tuple, sam.read_sam_contigs(spark, sam_file).collect())) == [("1", 100), ("2", 50)]


def test_bam_is_sam(spark, sam_file, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    a, b = (sorted(map(tuple, t.collect()), key=str) for t in (sam.read_sam(spark, sam_file), sam.read_bam(spark, str(tmp_path / "a.bam"))))
    assert a == b


def test_parquet_and_union(spark, sam_file, tmp_path):
    sam.read_sam(spark, sam_file).write.parquet(str(tmp_path / "reads"))
    both = sam.read_samples(spark, [sam_file, str(tmp_path / "reads")])
    assert sorted((r.sample_id, r["count"]) for r in both.groupBy("sample_id").count().collect()) == [(0, 5), (1, 5)]


def test_contig_clash(spark):
    t = spark.createDataFrame([("1", 5)], "contig string, length long")
    assert sam.merge_contigs(t, t).count() == 1
    with pytest.raises(Exception, match="different lengths"):
        sam.merge_contigs(t, spark.createDataFrame([("1", 6)], t.schema)).collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">1 some words\nACg\ntn\n>2:5-9/20\nACGT\n")
    ref = REF.read_fasta(spark, str(tmp_path / "x.fa"))
    assert sorted(map(tuple, ref.collect())) == [("1", 0, "ACGTN", 5), ("2", 5, "ACGT", 20)]
    want = spark.createDataFrame([("2", 6, 8), ("1", 1, 4)], "contig string, start long, end long")
    assert {r.contig: r.bases for r in REF.reference_slice(ref, want).collect()} == {"2": "CG", "1": "CGT"}
    with pytest.raises(Exception, match="no reference bases"):
        REF.reference_slice(ref, spark.createDataFrame([("2", 0, 3)], want.schema)).collect()
    (tmp_path / "bad.fa").write_text(">2:5-9/20\nACG\n")
    with pytest.raises(Exception, match="does not fit"):
        REF.read_fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_loci_text(spark):
    text = "20: 100-110,\n20:300-300,\n\n20:110-200 , chr2:7 X"
    assert REF.parse_loci(text) == [("20", 100, 110), ("20", 110, 200), ("chr2", 7, 8), ("X", 0, None)]
    got = REF.loci(spark, text, spark.createDataFrame([("X", 9)], "contig string, length long"))
    assert sorted(map(tuple, got.collect())) == [("20", 100, 200), ("X", 0, 9), ("chr2", 7, 8)]


def test_vcf_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("2", 5, 6, "A", "C", 30, 10, 7), ("1", 9, 10, "G", "T", 20, 5, None)], "contig string, start long, end long, ref string, alt string, tumor_depth long, tumor_allele_depth long, rs_id long")
    sinks.write_genotypes(sinks.genotype_records(calls), str(tmp_path / "o.vcf"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "o.vcf")).collect()]
    assert lines[-2:] == ["1\t10\t.\tG\tT\t.\t.\t.\tGT:AD:DP:GQ\t0/1:15,5:20:99", "2\t6\trs7\tA\tC\t.\t.\t.\tGT:AD:DP:GQ\t0/1:20,10:30:99"]
    back = REF.read_vcf(spark, str(tmp_path / "o.vcf")).orderBy("contig").collect()
    assert [(r.contig, r.start, r.end, r.ref, r.alt, r.db_snp) for r in back] == [("1", 9, 10, "G", "T", False), ("2", 5, 6, "A", "C", True)]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_genotypes(sinks.genotype_records(calls), str(tmp_path / "o.vcf"))
    sinks.write_genotypes(sinks.genotype_records(calls), str(tmp_path / "o.json"))
    assert spark.read.json(str(tmp_path / "o.json")).count() == 2


def test_partitioning_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", 0, 5, 0), ("b", 2, 9, 1)], "contig string, start long, end long, partition int")
    REF.write_partitioning(t, str(tmp_path / "p"))
    assert sorted(map(tuple, REF.read_partitioning(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, t.collect()))


def test_commands(spark, sam_file, tmp_path):
    from strandloom.plans.cli import main

    (tmp_path / "x.fa").write_text(f">1\n{'ACGT' * 25}\n>2\n{'ACGT' * 12}AC\n")
    keep = ["--include-duplicates", "--include-single-end"]
    main(["vaf-histogram", sam_file, "--reference", str(tmp_path / "x.fa"), "--out", str(tmp_path / "h"), *keep])
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).columns == ["SampleId", "BinStart", "BinEnd", "Size"]
    main(["partition-loci", sam_file, "--loci-partitioner", "uniform", "--parallelism", "2", "--out", str(tmp_path / "p"), *keep])
    assert REF.read_partitioning(spark, str(tmp_path / "p")).select("partition").distinct().count() == 2
    (tmp_path / "v.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t12\t.\tC\tT\t.\t.\t.\n")
    main(["variant-support", sam_file, "--reference", str(tmp_path / "x.fa"), "-v", str(tmp_path / "v.vcf"), "--out", str(tmp_path / "s")])
    assert spark.read.text(str(tmp_path / "s")).count() >= 1


def test_partitioned_reads_round_trip(spark, sam_file, tmp_path):
    """All columns are laid out, and the reads come back as they were, each once; a caller takes them."""
    from strandloom.plans.cli import main

    keep = ["--include-duplicates", "--include-single-end", "--include-failed-quality-checks"]
    main(["partition-reads", sam_file, "--loci-partitioner", "uniform", "--parallelism", "3", "--half-window", "4", "--out", str(tmp_path / "r"), *keep])
    laid = spark.read.parquet(str(tmp_path / "r"))
    assert {"base_qualities", "mate", "sequence", "cigar", "partition"} <= set(laid.columns)
    back = sam.read_partitioned(spark, str(tmp_path / "r"))
    given = ReadFilter(True, True, True, True)(sam.read_samples(spark, [sam_file]))
    cols = ["name", "contig", "start", "end", "sequence", "base_qualities", "cigar", "mapq"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, given.select(cols).collect())) and laid.count() > back.count()
    (tmp_path / "x.fa").write_text(f">1\n{'ACGT' * 25}\n>2\n{'ACGT' * 12}AC\n")
    main(["vaf-histogram", sam_file, "--partitioned-reads", str(tmp_path / "r"), "--reference", str(tmp_path / "x.fa"), "--out", str(tmp_path / "h1"), *keep])
    main(["vaf-histogram", sam_file, "--reference", str(tmp_path / "x.fa"), "--out", str(tmp_path / "h2"), *keep])
    assert sorted(map(str, spark.read.csv(str(tmp_path / "h1")).collect())) == sorted(map(str, spark.read.csv(str(tmp_path / "h2")).collect()))
    main(["germline-assembly", "--reads", sam_file, "--shortcut-assembly", "--kmer-size", "5", "--assembly-window-range", "8", "--reference", str(tmp_path / "x.fa"), "--out", str(tmp_path / "g"), *keep])
    assert "n_haplotypes" in spark.read.parquet(str(tmp_path / "g")).columns


def test_block_compressed_payload():
    import gzip
    import os
    import struct
    import zlib

    def block(data, other=b""):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        extra = other + b"BC\x02\x00" + struct.pack("<H", 12 + len(other) + 6 + len(body) + 8 - 1)
        return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))

    parts = [os.urandom(5000), b"", b"A" * 60000, os.urandom(1)]
    packed = [block(parts[0]), block(parts[1]), block(parts[2], other=b"XY\x01\x00z"), gzip.compress(parts[3])]
    assert sam.bgzf_payload(b"".join(packed)) == b"".join(parts) and sam.bgzf_payload(b"") == b""
    assert sam.bgzf_payload(b"".join(packed[::-1])) == b"".join(parts[::-1])


def test_joint_command_calls_forced_loci(spark, tmp_path):
    from strandloom.plans.cli import main

    def reads(name, bases):
        lines = ["@SQ\tSN:1\tLN:40", *(f"r{i}\t0\t1\t5\t60\t20M\t*\t0\t0\t{b}\t{'I' * 20}" for i, b in enumerate(bases))]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    whole = "ACGT" * 10
    same = whole[4:24]
    other = same[:8] + "T" + same[9:]  # position 12, A to T
    (tmp_path / "x.fa").write_text(f">1\n{whole}\n")
    (tmp_path / "forced").write_text("1:14-15")
    paths = [reads("n.sam", [same] * 40), reads("t.sam", [same] * 20 + [other] * 20)]
    keep = ["--include-single-end", "--include-filtered", "--reference", str(tmp_path / "x.fa")]

    def sites(out, *more):
        main(["somatic-joint", *paths, *keep, "--out-dir", str(tmp_path / out), *more])
        return sorted(tuple(r[0].split("\t")[i] for i in (0, 1, 3, 4)) for r in spark.read.text(str(tmp_path / out / "all.vcf")).collect() if not r[0].startswith("#"))

    called = ("1", "13", "A", "T")
    assert sites("plain") == [called]
    assert sites("given", "--force-call-loci", "1:9-10,1:12-13", "--force-call-loci-file", str(tmp_path / "forced")) == sorted([called, ("1", "10", "C", "N"), ("1", "15", "G", "N")])
