"""Peaks: runs of neighbouring sites of good quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteloom.functions.sequences import natural_key
from siteloom.operators.intervals import runs
from siteloom.session import numbered


def peak_sites(counts: DataFrame, stranded: bool = False, alpha: float = 0.05) -> DataFrame:
    """(chrom, start, end, strand, count, plus, minus, good) of each coordinate.

    counts: chrom, site_start, site_end, site_strand, fragments. The coordinate is start on '+', end on
    '-'. Unstranded, both strands of a coordinate are one site; two-sided ones are good. A one-sided
    site is good if p ** count (plus) or (1 - p) ** count (minus) is at least alpha, where p is the share of
    plus among two-sided sites, or 0.5 if its standard error is above 0.1 or there are none.
    """
    minus = F.col("site_strand") == "-"
    at = counts.withColumn("coord", F.when(minus, F.col("site_end")).otherwise(F.col("site_start")))
    if stranded:  # minus sites keep their empty interval, as the coordinate is their end
        return at.select("chrom", F.col("coord").alias("start"), F.col("site_end").alias("end"), F.col("site_strand").alias("strand"), F.col("fragments").alias("count"), (~minus).alias("plus"), minus.alias("minus"), F.lit(True).alias("good"))
    sides = at.groupBy("chrom", "coord").agg(F.sum(F.when(minus, 0).otherwise(F.col("fragments"))).alias("p"), F.sum(F.when(minus, F.col("fragments")).otherwise(0)).alias("m"))
    both = sides.where("p > 0 and m > 0").agg(F.sum("p").alias("p"), F.sum(F.col("p") + F.col("m")).alias("t")).first()
    share = both["p"] / both["t"] if both["t"] else 0.5
    if not both["t"] or (share * (1 - share) / both["t"]) ** 0.5 > 0.1:
        share = 0.5
    n = F.col("p") + F.col("m")
    two = (F.col("p") > 0) & (F.col("m") > 0)
    chance = F.pow(F.when(F.col("p") > 0, F.lit(float(share))).otherwise(F.lit(float(1 - share))), n)
    return sides.select(
        "chrom", F.col("coord").alias("start"), (F.col("coord") + 1).alias("end"), F.when(two, ".").when(F.col("p") > 0, "+").otherwise("-").alias("strand"), n.alias("count"),
        (F.col("p") > 0).alias("plus"), (F.col("m") > 0).alias("minus"), (two | (chance >= alpha)).alias("good"),
    )


def peaks(sites: DataFrame, window: int = 25, stranded: bool = False, least_sites: int = 3) -> DataFrame:
    """(chrom, start, end, strand, count, n_sites, apex, apex_count) of the runs that have enough good sites.

    A run goes on while the next start is within the window of the last end (and on its strand, if
    stranded). All its sites extend it, only good ones count; unstranded runs need both strands.
    """
    cut = lambda p: (F.col("start") - p["end"] > window) | ((F.col("strand") != p["strand"]) if stranded else F.lit(False))
    # at one coordinate the minus site comes first: its interval starts one base earlier
    ordered = sites.withColumn("__o", F.when(F.col("strand") == "-", 0).otherwise(1))
    grouped = runs(ordered, ["chrom"], "start", ["start", "__o", "end", "strand"], cut, "peak")
    good = F.col("good")
    got = grouped.groupBy("chrom", "peak").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("one"), F.sum(F.when(good, F.col("count")).otherwise(0)).alias("count"), F.sum(F.when(good, 1).otherwise(0)).alias("n_sites"),
        F.bool_or(good & F.col("plus")).alias("has_plus"), F.bool_or(good & F.col("minus")).alias("has_minus"), F.max_by("start", F.when(good, F.struct("count", -F.col("start")))).alias("apex"), F.max(F.when(good, F.col("count"))).alias("apex_count"),
    )
    kept = got.where((F.col("n_sites") >= least_sites) & (F.lit(stranded) | (F.col("has_plus") & F.col("has_minus"))))
    return kept.select("chrom", "start", "end", (F.col("one") if stranded else F.lit(".")).alias("strand"), "count", "n_sites", "apex", "apex_count")


def named(found: DataFrame) -> DataFrame:
    """Peaks with `name`, peak_1, peak_2, ... in the natural order of chromosomes, then by start and strand. They are sorted in ranges, not in one task."""
    at = numbered(found, [natural_key(F.col("chrom")), "chrom", "start", "strand"], "__n")
    return at.withColumn("name", F.concat(F.lit("peak_"), (F.col("__n") + 1).cast("string"))).drop("__n")
