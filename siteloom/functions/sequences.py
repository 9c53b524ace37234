"""Scalar functions on sequences, as Columns."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, functions as F

# Nucleotide codes and their complements.
CODES = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENTS = "TGCAAYRSWMKVHDBNTGCAAYRSWMKVHDBN"


def revcomp(seq: Column) -> Column:
    """Reverse complement with ambiguity codes; lower case comes out as upper case, null stays null."""
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def revcomp_text(seq: str) -> str:
    return seq.translate(str.maketrans(CODES, COMPLEMENTS))[::-1]


def natural_key(name: Column) -> Column:
    """An array to sort names by, in which runs of digits compare as numbers (chr2 before chr10)."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p))
    return F.when(name.rlike("^[0-9]"), F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings differ, over the length of the shorter one."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))).otherwise(F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / the longer length; 1.0 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def combined_umi() -> Column:
    return F.concat("ltr_umi", "linker_umi")


def error_probability(quals: Column) -> Column:
    """Mean error probability of an array of Phred values."""
    known = F.array(*[F.lit(10.0 ** (-q / 10)) for q in range(94)])  # Phred values of printable characters
    one = lambda q: F.coalesce(F.get(known, q.cast("int")), F.pow(F.lit(10.0), -q / 10))
    return F.when(F.size(quals) > 0, F.aggregate(quals, F.lit(0.0), lambda s, q: s + one(q)) / F.size(quals))


def phred(probability: Column) -> Column:
    return -10 * F.log10(probability)


def umi_pattern(pattern: str) -> str:
    """A regular expression in which each run of N stands for as many bases."""
    return re.sub("N+", lambda m: f"[ATGC]{{{len(m[0])}}}", pattern)


def extract_umi(before: Column, length: int, offset: int = 0, pattern: str | None = None) -> Column:
    """The `length` characters that end `offset` characters before the match, padded with N on the left.

    With a pattern: 'N' unless the pattern occurs in it. A length of 0 gives 'N', no UMI.
    """
    if not length:
        return F.lit("N")
    n = length + offset
    tail = F.lpad(F.right(F.coalesce(before, F.lit("")), F.lit(n)), n, "N")
    umi = F.substring(tail, 1, length)
    return F.when(umi.rlike(umi_pattern(pattern)), umi).otherwise(F.lit("N")) if pattern else umi


def choice_seed(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest(), 16) % 2**32
