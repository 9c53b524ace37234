"""Quality filter of alignments and assembly of fragments.

Alignments: read_name, mate (1 or 2), ref, start, end, strand, mapq, cigar array<struct<op,len>> (SAM numbers:
0 match, 1 insertion, 2 deletion, 4 soft clip, 5 hard clip), md, nm, xm, score (AS), second (XS), seq,
quals array<int>, tlen, ltr_umi, linker_umi, ltr_match, linker_match. Every test is a Column; all are one filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from siteloom.functions.sequences import error_probability, phred, revcomp


@dataclass(frozen=True)
class Limits:
    mismatch_rate: float = 0.1
    indel_rate: float = 0.02
    max_frag_len: int = 2000
    min_frag_len: int = 25
    min_mapq: int = 2
    no_multi: bool = False
    min_qual: int = 10
    match_after: int = 2
    single_end: bool = False
    long_read: bool = False
    raw_quality: bool = False  # compares the Phred value itself with a probability, so nothing is rejected


def multimapping() -> Column:
    return F.col("second").isNotNull() & (F.col("second") == F.col("score")) & (F.col("mapq") <= 1)


def _op(n: int) -> Column:
    return F.element_at("cigar", n)["op"]


def _clips() -> Column:
    return F.aggregate("cigar", F.lit(0), lambda s, c: s + F.when(c["op"].isin(4, 5), c["len"]).otherwise(0).cast("int"))


def _aligned() -> Column:
    """Query bases: matches, insertions and clips."""
    return F.aggregate("cigar", F.lit(0), lambda s, c: s + F.when(c["op"].isin(0, 1, 4, 7, 8), c["len"]).otherwise(0).cast("int"))


def _count(c: Column, letters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, letters, ""))


def tests(p: Limits) -> dict[str, Column]:
    """By name, in the order in which they are read."""
    lead = F.when(_op(1) == 4, F.element_at("cigar", 1)["len"]).otherwise(0)
    md = F.coalesce("md", F.lit(""))
    # letters before the first number other than zero: what differs from the start on, deleted bases too
    early = F.length(F.regexp_replace(F.regexp_extract(md, r"^([^1-9]*)", 1), "[^A-Za-z]", ""))
    early_n = _count(F.substring("seq", 1, p.match_after), "Nn")
    starts = early + lead + F.when((early > 0) | (lead > 0), early_n).otherwise(0)
    length, n = _aligned(), _count(F.col("seq"), "N")
    mismatches = F.when(F.col("xm").isNotNull(), F.col("xm") + _clips()).otherwise(_count(F.regexp_replace(md, r"\^[A-Z]+", ""), "ACGT") + n + _clips())
    most, gaps = F.floor(length * p.mismatch_rate), F.floor(length * p.indel_rate)
    size = F.length("seq") if p.single_end or p.long_read else F.abs(F.col("tlen"))
    quality = F.lit(True) if p.raw_quality else error_probability(F.col("quals")) <= 10 ** (-p.min_qual / 10)
    return {
        "first_operation": _op(1).isin(0, 4),
        "no_clips": F.lit(True) if p.long_read else (_op(1) != 4) & (_op(-1) != 4),
        "start_matches": (F.col("mate") != 1) | (starts <= p.match_after),
        "not_beaten": F.col("second").isNull() | (F.col("second") <= F.col("score")),
        "multi_allowed": F.lit(not p.no_multi) | ~multimapping(),
        "mapping_quality": multimapping() | (F.col("mapq") >= p.min_mapq),
        "base_quality": quality,
        "length": size.between(p.min_frag_len, p.max_frag_len),
        "edits": F.col("nm") <= most + gaps,
        "mismatches": mismatches <= most,
        "indels": F.col("nm") - mismatches <= gaps,
    }


def qc(alignments: DataFrame, p: Limits = Limits()) -> DataFrame:
    """The alignments that pass every test, with multi, error (mean probability) and read_seq, 5' to 3' of the read. A test that a null leaves open fails."""
    checks = tests(p)
    checks.pop("base_quality")
    every = None
    for test in checks.values():
        every = test if every is None else every & test
    passed = alignments.where(F.coalesce(every, F.lit(False)))
    # an explosion of one value: the mean is computed once, after the cheaper tests, for the filter and the column
    passed = passed.withColumn("error", F.explode(F.array(error_probability(F.col("quals")))))
    if not p.raw_quality:
        passed = passed.where(F.coalesce(F.col("error") <= 10 ** (-p.min_qual / 10), F.lit(False)))
    return passed.withColumn("multi", F.coalesce(multimapping(), F.lit(False))).withColumn("read_seq", F.when(F.col("strand") == "-", revcomp(F.col("seq"))).otherwise(F.col("seq")))


def fragments(passed: DataFrame) -> DataFrame:
    """Pairs of mates that both passed, on one reference and opposite strands, as fragments."""
    one, two = passed.where("mate = 1").alias("a"), passed.where("mate = 2").alias("b")
    met = one.join(two, F.col("a.read_name") == F.col("b.read_name")).where("a.ref = b.ref and a.strand <> b.strand")
    minus = F.col("a.strand") == "-"
    return met.select(
        F.col("a.read_name").alias("read_name"), F.col("a.ref").alias("chrom"), F.when(minus, F.col("b.start")).otherwise(F.col("a.start")).alias("start"), F.when(minus, F.col("a.end")).otherwise(F.col("b.end")).alias("end"),
        F.lit(1).cast("long").alias("count"), F.col("a.strand").alias("strand"), F.col("a.ltr_umi").alias("ltr_umi"), F.col("a.linker_umi").alias("linker_umi"), F.col("a.read_seq").alias("seq1"), F.col("b.read_seq").alias("seq2"),
        F.col("a.multi").alias("multi"), phred((F.col("a.error") + F.col("b.error")) / 2).alias("mean_qual"), F.least("a.mapq", "b.mapq").alias("map_qual"), F.col("a.ltr_match").alias("ltr_match"), F.col("a.linker_match").alias("linker_match"),
    )


def single_fragments(passed: DataFrame) -> DataFrame:
    """One fragment of each alignment, for single-end and long reads."""
    return passed.select(
        "read_name", F.col("ref").alias("chrom"), "start", "end", F.lit(1).cast("long").alias("count"), "strand", "ltr_umi", "linker_umi", F.col("read_seq").alias("seq1"), F.lit(None).cast("string").alias("seq2"),
        "multi", phred(F.col("error")).alias("mean_qual"), F.col("mapq").alias("map_qual"), "ltr_match", "linker_match",
    )


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique, multi)"""
    return df.where("not multi"), df.where("multi")


def proper_pairs(alignments: DataFrame, remove: list[str] = []) -> DataFrame:
    """Mates of pairs that have one row of each mate on one reference and opposite strands; a removed chromosome takes both mates."""
    # smallest and largest values, as distinct ones would be counted over a row for each of them
    names = alignments.groupBy("read_name").agg(
        F.sum((F.col("mate") == 1).cast("int")).alias("n1"), F.sum((F.col("mate") == 2).cast("int")).alias("n2"), (F.min("ref") == F.max("ref")).alias("one_ref"), (F.min("strand") < F.max("strand")).alias("both_strands"), F.bool_or(F.col("ref").isin(remove) if remove else F.lit(False)).alias("out")
    )
    return alignments.join(names.where("n1 = 1 and n2 = 1 and one_ref and both_strands and not out").select("read_name"), "read_name", "left_semi")


def first_records(alignments: DataFrame, order: str = "ord") -> DataFrame:
    """The first record of each name."""
    w = Window.partitionBy("read_name").orderBy(order)
    return alignments.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def long_reads(alignments: DataFrame, margin: int = 25, order: str = "ord") -> DataFrame:
    """The primary alignment of each name; if more than one alignment, itself included, scores within the margin of it, second becomes its score."""
    near = alignments.join(alignments.where("primary").groupBy("read_name").agg(F.min_by("score", order).alias("__top")), "read_name")
    ties = near.groupBy("read_name").agg(F.count_if(F.abs(F.col("score") - F.col("__top")) < margin).alias("__ties"))
    first = first_records(alignments.where("primary"), order)
    return first.join(ties, "read_name").withColumn("second", F.when(F.col("__ties") > 1, F.col("score")).otherwise(F.col("second"))).drop("__ties")
