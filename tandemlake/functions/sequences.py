"""Nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(seq: Column) -> Column:
    """Upper case, U as T, only A, C, G, T and N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGTN]", "")


def strict_clean(seq: Column) -> Column:
    """Upper case, only A, C, G, T and N: U goes."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "")


def revcomp(seq: Column) -> Column:
    """The reverse complement; other letters stay as they are."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def rotated(seq: Column, start: Column) -> Column:
    at = F.when(F.length(seq) > 0, F.pmod(start, F.length(seq))).otherwise(F.lit(0)).cast("int")
    return F.concat(F.substring(seq, at + 1, F.length(seq)), F.substring(seq, F.lit(1), at))


def tandem(seq: Column, times: int) -> Column:
    return F.repeat(seq, times)


def circular_kmers(seq: Column, k: Column | int) -> Column:
    """The distinct canonical k-mers of a sequence read as a circle; none if it is shorter than k."""
    k = F.lit(k) if isinstance(k, int) else k
    twice = F.concat(seq, seq)
    windows = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: canonical(F.substring(twice, i, k)))
    return F.when(F.length(seq) >= k, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among A, C, G and T; null without any."""
    count = lambda letters: F.length(seq) - F.length(F.translate(seq, letters, ""))
    return count("GC") / F.nullif(count("ACGT"), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two sequences of equal length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """From start to end, 1-based and closed; from the other strand where start > end."""
    part = F.substring(seq, F.least(start, end).cast("int"), (F.abs(end - start) + 1).cast("int"))
    return F.when(start > end, revcomp(part)).otherwise(part)


def alignment_identity(a: Column, b: Column, length: Column) -> Column:
    """Equal letters in equal places of two gapped sequences, by the given length."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x == y) & (x != "-") & (x != "")).cast("int"))
    return F.coalesce(F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.nullif(length, F.lit(0)), F.lit(0.0))
