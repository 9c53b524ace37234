"""What stands at the ends of reads: positional consensus, its reliable part, and shares of variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from siteloom.functions.sequences import revcomp_text
from siteloom.operators.crop import adapter_match
from siteloom.session import checkpointed


def sample_reads(reads: DataFrame, n: int, seed: int = 100) -> DataFrame:
    """n reads by a hash of seed and name: the same ones of both mates and in every run."""
    return reads.orderBy(F.xxhash64(F.lit(seed), "read_name"), "read_name").limit(n)


def positional_consensus(reads: DataFrame, seq: str = "seq1", length: int = 100, threshold: float = 0.65, reverse: bool = False) -> DataFrame:
    """(position, base, share, called) for the first (reverse: last) `length` bases, reads padded with N; called is N under the threshold. Ties go to the smaller letter."""
    s = F.reverse(seq) if reverse else F.col(seq)
    padded = F.rpad(F.substring(F.coalesce(s, F.lit("")), 1, length), length, "N")
    at = reads.select(F.posexplode(F.split(padded, "")).alias("position", "base")).where("base <> ''")
    counts = at.groupBy("position", "base").agg(F.count("*").alias("n"))
    per = counts.groupBy("position").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("n"), "base")).alias("m"))
    share = -F.col("m.n") / F.col("t")
    return per.select("position", F.col("m.base").alias("base"), share.alias("share"), F.when(share >= threshold, F.col("m.base")).otherwise("N").alias("called")).orderBy("position")


def change_points(values: list[float], penalty: float = 1.5, least: int = 3) -> list[int]:
    """Ends of the segments with the smallest sum of squared deviations plus a penalty for each (exact, by dynamic programming)."""
    x = np.concatenate([[0.0], np.cumsum(values)])
    q = np.concatenate([[0.0], np.cumsum(np.square(values))])
    n = len(values)
    best, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for end in range(least, n + 1):
        begin = np.arange(0, end - least + 1)
        cost = best[begin] + (q[end] - q[begin] - (x[end] - x[begin]) ** 2 / (end - begin)) + penalty
        cut[end], best[end] = begin[cost.argmin()], cost.min()
    ends, at = [], n
    while at > 0 and np.isfinite(best[n]):
        ends.append(int(at))
        at = cut[at]
    return ends[::-1] or [n]


def reliable(called: str, shares: list[float], penalty: float = 1.5, peak: float = 0.9) -> str:
    """The consensus with N outside segments whose mean share reaches `peak` of the largest segment's."""
    ends = change_points(shares, penalty)
    starts = [0, *ends[:-1]]
    means = [float(np.mean(shares[a:b])) for a, b in zip(starts, ends)]
    return "".join(called[a:b] if m >= peak * max(means) else "N" * (b - a) for a, b, m in zip(starts, ends, means))


def define_consensus(reads: DataFrame, seq: str = "seq1", length: int = 100, sample: int = 10_000, threshold: float = 0.65, reverse: bool = False) -> str:
    rows = positional_consensus(sample_reads(reads, sample), seq, length, threshold, reverse).collect()  # `length` rows
    return reliable("".join(r.called for r in rows), [r.share for r in rows])


def variant_shares(reads: DataFrame, target: str, seq: str = "seq1", error_rate: float = 0.3, threshold: float = 0.01) -> DataFrame:
    """(matched, share) of what matched the target within the error rate, at least `threshold` each, and the remainder as 'Other'."""
    met = adapter_match(reads, seq, [target], "__m", error_rate=error_rate).where("__m is not null")
    return shares(met.select(F.col("__m.matched").alias("matched")), threshold)


def shares(values: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(matched, share) of a column `matched`: those of at least the threshold, the others together as 'Other'."""
    counts = values.groupBy("matched").agg(F.count("*").alias("n"))
    total = values.count()
    named = counts.withColumn("matched", F.when(F.col("n") >= threshold * total, F.col("matched")).otherwise("Other"))
    return named.groupBy("matched").agg((F.sum("n") / F.lit(total)).alias("share"))


def flanking(reads: DataFrame, target: str, seq: str = "seq1", size: int = 15, error_rate: float = 0.3, threshold: float = 0.01) -> DataFrame:
    """Shares of the bases next to the match."""
    met = adapter_match(reads, seq, [target], "__m", error_rate=error_rate).where("__m is not null")
    return shares(met.select(F.substring("__m.after", 1, size).alias("matched")), threshold)


def _ends(reads: DataFrame, long_read: bool) -> list[tuple[str, str, bool]]:
    """(end, column, whether it is read from the 3' side) of the ends that the reads have."""
    if long_read:
        return [("integrant", "seq1", False), ("linker", "seq1", True)]
    return [("integrant", "seq1", False)] + ([("linker", "seq2", False)] if "seq2" in reads.columns else [])


def end_variants(reads: DataFrame, ltr: str, linker: str | None = None, long_read: bool = False, sample: int | None = 10_000, error_rate: float = 0.3, threshold: float = 0.01, size: int = 15) -> DataFrame:
    """(end, kind, sequence, share) of both ends of reads (seq1, and seq2 of pairs): what matched the LTR at the integrant end and the linker at the
    other one (kind match; what is rarer than the threshold together as 'Other', also if that is nothing), and the `size` bases next to a match (kind adjoining; those of at least the threshold).

    Long reads hold the linker's reverse complement at their 3' end; what stands next to it is before it. sample: reads that are
    looked at (None: all). An end without any match gives no rows, nor does a linker end without linker.
    """
    held, out = reads if sample is None else sample_reads(reads, sample), None
    for end, seq, last in _ends(reads, long_read):
        target = ltr if end == "integrant" else linker
        if target is None:
            continue
        met = adapter_match(held.select(seq), seq, [revcomp_text(target) if last else target], "__m", error_rate=error_rate, leftmost=last).where("__m is not null")
        found = checkpointed(met.select("__m.matched", (F.right("__m.before", F.lit(size)) if last else F.substring("__m.after", 1, size)).alias("next")))
        total = F.broadcast(found.agg(F.count("*").alias("t")).where("t > 0"))
        counts = found.groupBy(F.col("matched").alias("sequence")).agg(F.count("*").alias("n")).crossJoin(total)  # one row
        often = F.col("n") >= threshold * F.col("t")
        match = counts.where(often).select("sequence", (F.col("n") / F.col("t")).alias("share")).unionByName(
            total.crossJoin(counts.agg(F.coalesce(F.sum(F.when(~often, F.col("n"))), F.lit(0)).alias("o"))).select(F.lit("Other").alias("sequence"), (F.col("o") / F.col("t")).alias("share"))
        )
        beside = found.groupBy(F.col("next").alias("sequence")).agg(F.count("*").alias("n")).crossJoin(total).where(often).select("sequence", (F.col("n") / F.col("t")).alias("share"))
        both = match.withColumn("kind", F.lit("match")).unionByName(beside.withColumn("kind", F.lit("adjoining"))).select(F.lit(end).alias("end"), "kind", "sequence", "share")
        out = both if out is None else out.unionByName(both)
    return out


def end_consensus(reads: DataFrame, length: int = 100, sample: int | None = 10_000, threshold: float = 0.65, penalty: float = 1.5, peak: float = 0.9, long_read: bool = False) -> DataFrame:
    """(end, raw, estimated): the consensus of the first `length` bases of both ends and its reliable part. The linker end of long
    reads is the last bases of the read, given as their reverse complement; reads without seq2 have no linker end otherwise."""
    held, rows = reads if sample is None else sample_reads(reads, sample), []
    for end, seq, last in _ends(reads, long_read):
        some = held.select(F.lpad(F.right(F.coalesce(seq, F.lit("")), F.lit(length)), length, "N").alias(seq)) if last else held
        got = positional_consensus(some, seq, length, threshold).collect()  # `length` rows
        raw, estimated = "".join(r.called for r in got), reliable("".join(r.called for r in got), [r.share for r in got], penalty, peak) if got else ""
        rows.append((end, revcomp_text(raw), revcomp_text(estimated)) if last else (end, raw, estimated))
    return reads.sparkSession.createDataFrame(rows, "end string, raw string, estimated string")
