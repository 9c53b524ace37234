"""The final pass: sites near much more abundant ones are snapped to them, and what falls together is merged.

A position is end on '-' and start on '+'. Kept rows have all columns of fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteloom.functions.sequences import combined_umi
from siteloom.operators.dedup import survivors
from siteloom.operators.graph import overruled
from siteloom.operators.intervals import near_positions
from siteloom.session import checkpointed


def with_position(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")))


def position_counts(df: DataFrame, by: list[str] = []) -> DataFrame:
    """Fragments and summed counts of each (chrom, strand, pos)."""
    return with_position(df).groupBy(*by, "chrom", "strand", "pos").agg(F.count("*").alias("fragments"), F.sum("count").alias("total"))


def suppress(abundant: DataFrame, keys: list[str], window: int, fold: float) -> DataFrame:
    """abundant without the positions that more abundant ones suppress.

    From the most to the least fragments (ties: the higher position first) a position is dropped if
    among the positions within the window that weren't dropped so far the most fragments or the
    largest total is at least fold times its own. So only neighbours that go before it and reach fold times one of its
    two numbers matter to it; all positions decide side by side, as soon as those have (graph.overruled).
    With a fold of 2 or more a chain of such neighbours has no more links than the product of the two numbers' logarithms.
    """
    own = abundant.select(*keys, "pos", "fragments", "total")
    above = own.select(*keys, F.col("pos").alias("above"), F.col("fragments").alias("f"), F.col("total").alias("t"))
    first = (F.col("f") > F.col("fragments")) | ((F.col("f") == F.col("fragments")) & (F.col("above") > F.col("pos")))
    beats = (F.col("f") >= fold * F.col("fragments")) | (F.col("t") >= fold * F.col("total"))
    place = lambda c: F.struct(*keys, F.col(c).alias("pos"))
    edges = near_positions(own, above, keys, "pos", "above", window).where(first & beats)
    gone = overruled(edges.select(place("pos").alias("node"), place("above").alias("over")))
    return abundant.join(gone.select("node.*"), [*keys, "pos"], "left_anti")


def snap_targets(counts: DataFrame, keys: list[str], window: int = 5, min_count: int = 1, fold: float = 2.0, keep_distinct: bool = False) -> DataFrame:
    """(keys, pos, target): for positions within the window of a kept abundant one, its coordinate.

    If several are in range the least abundant one wins, as it is the last one that writes; with
    keep_distinct kept positions stay where they are and the others go to the most abundant one.
    """
    abundant = counts.where(F.col("fragments") >= min_count)
    kept = checkpointed(suppress(abundant, keys, window, fold).select(*keys, F.col("pos").alias("target"), "fragments"))
    near = near_positions(counts.select(*keys, "pos"), kept, keys, "pos", "target", window)
    write = F.struct("fragments", "target")  # the order of the walk: fragments, then position, both falling
    pick = F.max_by("target", write) if keep_distinct else F.min_by("target", write)
    got = near.groupBy(*keys, "pos").agg(pick.alias("target"), F.max(F.col("pos") == F.col("target")).alias("own"))
    return got.select(*keys, "pos", F.when(F.col("own"), F.col("pos")).otherwise(F.col("target")).alias("target") if keep_distinct else F.col("target"))


def collapse(df: DataFrame, window: int = 5, min_count: int = 1, fold: float = 2.0, by: list[str] = [], keep_distinct: bool = False) -> DataFrame:
    """df with positions snapped: `end` changes on '-', `start` on '+'."""
    keys = [*by, "chrom", "strand"]
    targets = snap_targets(position_counts(df, by), keys, window, min_count, fold, keep_distinct)
    at = with_position(df).join(targets, [*keys, "pos"], "left").withColumn("pos", F.coalesce("target", "pos"))
    minus = F.col("strand") == "-"
    return at.withColumn("end", F.when(minus, F.col("pos")).otherwise(F.col("end"))).withColumn("start", F.when(minus, F.col("start")).otherwise(F.col("pos"))).select(*df.columns)


def new_duplicates(df: DataFrame, by: list[str] = []) -> DataFrame:
    """Of fragments that now have one place and UMIs the best by (count, map_qual, mean_qual), counts summed."""
    return survivors(df, [*by, "chrom", "start", "end", "strand", "ltr_umi", "linker_umi"], ["count", "map_qual", "mean_qual"])


def umi_conflicts(df: DataFrame, by: list[str] = []) -> DataFrame:
    """df without reads whose UMI has a better position: greatest summed count, then best map_qual and
    its mean_qual, then the smallest (chrom, strand, pos). All stay if no read has a UMI."""
    at = with_position(df).withColumn("__umi", combined_umi())
    none = (F.col("ltr_umi") == "N") & (F.col("linker_umi") == "N")
    if not at.where(~none).limit(1).count():
        return df
    place = ["chrom", "strand", "pos"]
    groups = at.groupBy(*by, "__umi", *place).agg(F.sum("count").alias("c"), F.max(F.struct("map_qual", "mean_qual")).alias("q"))
    order = F.struct((-F.col("c")).alias("c"), (-F.col("q.map_qual")).alias("m"), (-F.col("q.mean_qual")).alias("q"), *place)
    first = groups.groupBy(*by, "__umi").agg(F.min_by(F.struct(*place), order).alias("w")).select(*by, "__umi", "w.*")
    return at.join(first, [*by, "__umi", *place], "left_semi").select(*df.columns)


def low_confidence(df: DataFrame, fold: float = 100.0, by: list[str] = []) -> DataFrame:
    """df without positions whose summed count is below floor(mean summed count of positions / fold)."""
    counts = checkpointed(position_counts(df, by))
    limit = counts.groupBy(*by).agg(F.floor(F.avg("total") / fold).alias("least")) if by else counts.agg(F.floor(F.avg("total") / fold).alias("least"))
    kept = counts.join(limit, by) if by else counts.where(F.col("total") >= F.lit(limit.first()[0] or 0)).withColumn("least", F.lit(0))
    kept = kept.where("total >= least").select(*by, "chrom", "strand", "pos")
    return with_position(df).join(kept, [*by, "chrom", "strand", "pos"], "left_semi").select(*df.columns)


def final_pass(df: DataFrame, window: int = 5, min_count: int = 1, fold: float = 2.0, umi_dedup: bool = False, low_fold: float = 100.0, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): collapse, merge what became duplicate, optionally settle UMI conflicts, drop positions of low confidence."""
    moved = checkpointed(collapse(df, window, min_count, fold, by))
    kept = checkpointed(new_duplicates(moved, by))
    if umi_dedup:
        kept = checkpointed(umi_conflicts(kept, by))
    kept = low_confidence(kept, low_fold, by)
    return kept, moved.join(kept.select(*by, "read_name"), [*by, "read_name"], "left_anti").select(*df.columns)
