"""Column functions: bases, phred scores, CIGAR strings, SAM flags, point probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR = r"(\d+)([MIDNSHP=X])"
REFERENCE_OPS, READ_OPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X")


def complement(seq: Column) -> Column:
    """A-T and C-G swapped, all else N."""
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_standard(seq: Column) -> Column:
    return seq.rlike("^[ACGT]*$")


def unmask(seq: Column) -> Column:
    return F.upper(seq)


def base_qualities(quals: Column, length: Column) -> Column:
    """Phred numbers of a quality string (ASCII - 33); zeros where it is empty or '*'."""
    numbers = F.transform(F.filter(F.split(quals, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return F.when((quals == "") | (quals == "*"), F.array_repeat(F.lit(0), length.cast("int"))).otherwise(numbers)


def phred_to_success(q: Column) -> Column:
    return 1 - F.pow(F.lit(10.0), -q / 10)


def success_to_phred(p: Column) -> Column:
    return (-10 * F.log10(1 - F.least(p, F.lit(1 - 1e-16)))).cast("int")


def distance_from_sequencing_end(locus: Column, start: Column, end: Column, is_positive_strand: Column) -> Column:
    """Positions to where sequencing ended: the read's end on the positive strand, else its start."""
    return F.when(is_positive_strand, end - locus).otherwise(locus - start)


def truncated_join(pieces: Column, most: int = 500, separator: str = ",", ellipsis: str = " [...]") -> Column:
    """Strings of an array joined until `most` characters are used up; what is left out shows as an ellipsis.

    A piece is begun while more characters are left than the ellipsis has, and then is whole; each costs its
    separator too, which is also written before the ellipsis.
    """
    fits = lambda acc: acc["left"] > len(ellipsis)
    step = lambda acc, p: F.struct(
        F.when(fits(acc), acc["left"] - F.length(p) - len(separator)).otherwise(acc["left"]).alias("left"), F.when(fits(acc), acc["n"] + 1).otherwise(acc["n"]).alias("n")
    )
    kept = F.slice(pieces, 1, F.aggregate(pieces, F.struct(F.lit(most).alias("left"), F.lit(0).alias("n")), step)["n"])
    rest = F.when(F.size(kept) == 0, ellipsis).otherwise(separator + ellipsis)
    return F.concat(F.array_join(kept, separator), F.when(F.size(kept) < F.size(pieces), rest).otherwise(""))


def cigar_elements(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR string."""
    return F.zip_with(
        F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(1)), F.regexp_extract_all(cigar, F.lit(CIGAR), F.lit(2)),
        lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")),
    )


def _length(elements: Column, ops: tuple) -> Column:
    return F.aggregate(elements, F.lit(0), lambda acc, e: acc + F.when(e["op"].isin(*ops), e["len"]).otherwise(0))


def reference_length(elements: Column) -> Column:
    return _length(elements, REFERENCE_OPS)


def read_length(elements: Column) -> Column:
    return _length(elements, READ_OPS)


def clipped_before(elements: Column) -> Column:
    """Bases of the leading S and H elements."""
    return F.aggregate(
        elements, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, e: F.struct((acc["n"] + F.when(acc["on"] & e["op"].isin("S", "H"), e["len"]).otherwise(0)).alias("n"), (acc["on"] & e["op"].isin("S", "H")).alias("on")),
        lambda acc: acc["n"],
    )


def clipped_after(elements: Column) -> Column:
    return clipped_before(F.reverse(elements))


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def log_factorial(n: Column) -> Column:
    """ln n! as a sum of logarithms: exact for the depths of a pileup."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n.cast("int"), F.lit(2))), F.lit(0.0), lambda acc, i: acc + F.ln(i.cast("double"))))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_log_point(total_a: Column, a: Column, total_b: Column, b: Column) -> Column:
    """ln C(A,a) + ln C(B,b) - ln C(A+B,a+b): the point probability of a strand table, 0 at most."""
    return log_choose(total_a, a) + log_choose(total_b, b) - log_choose(total_a + total_b, a + b)


def strand_bias_phred(total_a: Column, a: Column, total_b: Column, b: Column, fixed: bool = False) -> Column:
    """Ten times the decimal logarithm of the point probability: never positive, so a positive bound filters nothing; fixed negates it."""
    value = 10 * hypergeometric_log_point(total_a, a, total_b, b) / F.ln(F.lit(10.0))
    return -value if fixed else value
