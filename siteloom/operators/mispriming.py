"""Fragments that a primer may have started in the genome itself are set apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from siteloom.functions.align import local_alignments
from siteloom.functions.sequences import revcomp, revcomp_text
from siteloom.session import ship


def genome_chunks(contigs: DataFrame, size: int = 1 << 14) -> DataFrame:
    """(contig, chunk, seq) from (contig, seq)."""
    at = contigs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / size))))
    return at.select("contig", "chunk", F.substr(F.col("seq"), (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def site_windows(sites: DataFrame, chunks: DataFrame, window: int = 25, size: int = 1 << 14) -> DataFrame:
    """sites with window_seq: the genome up to `window` bases around the site, cut at the contig's ends, as read on the site's strand.

    A window is joined with the one or two chunks it touches.
    """
    at = sites.withColumn("__lo", F.greatest(F.lit(0), F.col("site_start") - window)).withColumn("__hi", F.col("site_end") + window)
    asked = at.select("chrom", "__lo", "__hi").distinct().withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__lo") / size), F.floor((F.col("__hi") - 1) / size))))
    c = chunks.withColumnRenamed("contig", "chrom")
    begin = F.greatest(F.col("__lo") - F.col("chunk") * size, F.lit(0))
    part = F.substr(F.col("seq"), (begin + 1).cast("int"), (F.col("__hi") - F.col("chunk") * size - begin).cast("int"))
    got = asked.join(c, ["chrom", "chunk"]).select("chrom", "__lo", "__hi", F.struct("chunk", part.alias("s")).alias("p"))
    whole = got.groupBy("chrom", "__lo", "__hi").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("__seq"))  # two chunks at most
    joined = at.join(whole, ["chrom", "__lo", "__hi"], "left")
    return joined.withColumn("window_seq", F.upper(F.when(F.col("site_strand") == "-", revcomp(F.col("__seq"))).otherwise(F.col("__seq")))).select(*sites.columns, "window_seq")


#: Windows that are aligned together.
WINDOWS = 2048


def are_misprimed(seqs: list[str], primer: str, seed_len: int = 6, max_seed_error: float = 0.2, min_match: float = 0.7) -> np.ndarray:
    """Whether primer or its reverse complement aligns with each sequence: enough matches, and few errors in the seed, the
    primer's last bases (of the reverse complement the first ones). Bases of the seed without an equal one are errors, and so are
    bases of the sequence that stand before a base of the seed, opposite none."""
    n, out = len(primer), np.zeros(len(seqs), bool)
    for first in range(0, len(seqs), WINDOWS):
        part = seqs[first : first + WINDOWS]
        for text, seed in ((primer, slice(max(0, n - seed_len), n)), (revcomp_text(primer), slice(0, seed_len))):
            score, same, inserted = local_alignments(text, part)
            errors = (~same[:, seed]).sum(1) + inserted[:, seed].sum(1)
            out[first : first + WINDOWS] |= (score > 0) & (same.sum(1) >= min_match * n) & (errors / seed_len <= max_seed_error)
    return out


def split_misprimed(sites: DataFrame, chunks: DataFrame, primer: str, window: int = 25) -> tuple[DataFrame, DataFrame]:
    """(kept, misprimed with window_seq). Distinct windows are aligned once; sites without genome stay."""
    ship(sites.sparkSession)
    seen = site_windows(sites, chunks, window)
    test = F.pandas_udf(lambda s: pd.Series(are_misprimed(s.tolist(), primer)), BooleanType())
    judged = seen.select("window_seq").where("window_seq is not null").distinct().withColumn("__bad", test("window_seq"))
    both = seen.join(judged, "window_seq", "left")
    return both.where("not coalesce(__bad, false)").select(*sites.columns), both.where("__bad").select(*sites.columns, "window_seq")


def misprimed_fasta(misprimed: DataFrame) -> DataFrame:
    return misprimed.select(F.concat(F.lit(">"), "read_name", F.lit("\n"), "window_seq").alias("value"))
