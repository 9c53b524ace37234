"""Exact and UMI-aware deduplication of fragments.

Fragments: read_name, chrom, strand, start, end, count, ltr_umi, linker_umi, map_qual, mean_qual, and
whatever else the rows carry. Ties go to the smallest read_name. Extra key columns (such as sample)
are given as `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions.sequences import combined_umi
from siteloom.operators.graph import connected_components
from siteloom.operators.intervals import runs
from siteloom.session import checkpointed


def best(first: list[str], df: DataFrame) -> Column:
    """The whole row with the largest values of `first`, then the smallest read_name."""
    return F.min_by(F.struct(*df.columns), F.struct(*[(-F.col(c)).alias(f"d{k}") for k, c in enumerate(first)], "read_name"))


def survivors(df: DataFrame, keys: list[str | Column], first: list[str]) -> DataFrame:
    """One row of each group, the best one, with the sum of counts: one aggregate with partial results."""
    got = df.groupBy(*keys).agg(best(first, df).alias("__best"), F.sum("count").alias("__count"))
    return got.select(*[F.col("__count").alias(c) if c == "count" else F.col("__best")[c].alias(c) for c in df.columns])


def unique_exact(df: DataFrame, by: list[str] = []) -> DataFrame:
    """Of fragments with equal place and UMIs the one with the best (map_qual, mean_qual), counts summed."""
    return survivors(df, [*by, "chrom", "strand", "start", "end", "ltr_umi", "linker_umi"], ["map_qual", "mean_qual"])


def multi_exact(df: DataFrame, by: list[str] = []) -> DataFrame:
    """Of reads with equal UMIs and sequences the one with the best (map_qual, mean_qual), counts summed. A null seq2 equals a null."""
    return survivors(df, [*by, "ltr_umi", "linker_umi", "seq1", "seq2"], ["map_qual", "mean_qual"])


def tolerance_groups(df: DataFrame, tolerance: int, by: list[str] = [], group: str = "group") -> DataFrame:
    """df with `group` (long, within by, chrom and strand).

    In the order of (start, end) a group ends where start or end moves by more than the tolerance.
    Groups whose bounds (smallest start, largest end) both differ by at most the tolerance are then
    merged, and so are chains of them; bounds aren't computed anew.
    """
    keys = [*by, "chrom", "strand"]
    cut = lambda p: (F.col("start") - p["start"] > tolerance) | (F.abs(F.col("end") - p["end"]) > tolerance)
    places = df.select(*keys, "start", "end").distinct()
    placed = checkpointed(runs(places, keys, "start", ["start", "end"], cut, "__g"))
    bounds = placed.groupBy(*keys, "__g").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    size = tolerance + 1
    cells = lambda c: F.array(F.floor(F.col(c) / size), F.floor(F.col(c) / size) + 1)
    spread = bounds.withColumn("bl", F.explode(cells("lo"))).withColumn("bh", F.explode(cells("hi")))
    other = spread.select(*keys, F.col("__g").alias("g2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "bl", "bh")
    near = spread.join(other, [*keys, "bl", "bh"]).where((F.col("__g") < F.col("g2")) & (F.abs(F.col("lo") - F.col("lo2")) <= tolerance) & (F.abs(F.col("hi") - F.col("hi2")) <= tolerance))
    node = lambda g: F.struct(*keys, F.col(g).alias("g"))
    merged = connected_components(near.select(node("__g").alias("src"), node("g2").alias("dst")).distinct())
    named = merged.select("node.*", F.col("component.g").alias("low")).withColumnRenamed("g", "__g")
    found = placed.join(named, [*keys, "__g"], "left").select(*keys, "start", "end", F.coalesce("low", "__g").alias(group))
    return df.join(found, [*keys, "start", "end"]).select(*df.columns, group)


def umi_neighbours(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (u < v, nu, nv) of UMIs of a group at a substitution distance of one: joined on the UMI with one
    position masked, so each group of the join holds no more rows than the alphabet has letters."""
    masked = nodes.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("umi")))).withColumn("m", F.concat(F.expr("substring(umi, 1, p - 1)"), F.lit("*"), F.expr("substring(umi, p + 1)")))
    a = masked.select(*keys, "p", "m", F.col("umi").alias("u"), F.col("n").alias("nu"))
    b = masked.select(*keys, "p", "m", F.col("umi").alias("v"), F.col("n").alias("nv"))
    return a.join(b, [*keys, "p", "m"]).where("u < v").drop("p", "m")


def umi_owners(nodes: DataFrame, keys: list[str], frag_ratio: float) -> DataFrame:
    """(keys, umi, owner): who claims each UMI.

    u reaches v by a step if they are neighbours and n(u) >= frag_ratio * n(v) - 1. Taking the best
    unclaimed UMI with all it reaches, again and again, gives every UMI to the best one that reaches
    it; so labels are handed along the steps until none improves. Best: largest n, then smallest
    representative read. A UMI without steps owns itself and takes no part in the rounds; in a round only
    the UMIs hand on whose label has changed.
    """
    nodes = checkpointed(nodes)
    near = umi_neighbours(nodes, keys)
    along = lambda a, b: F.when(F.col(f"n{a}") >= frag_ratio * F.col(f"n{b}") - 1, F.struct(F.col(a).alias("u"), F.col(b).alias("v")))
    steps = near.select(*keys, F.explode(F.array_compact(F.array(along("u", "v"), along("v", "u")))).alias("s")).select(*keys, "s.u", "s.v")
    steps = checkpointed(steps)
    rank = F.struct((-F.col("n")).alias("n"), "rep", F.col("umi").alias("owner"))
    ends = steps.select(*keys, F.col("u").alias("umi")).union(steps.select(*keys, F.col("v").alias("umi"))).distinct()
    now = checkpointed(nodes.join(ends, [*keys, "umi"], "left_semi").select(*keys, "umi", rank.alias("label"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        handed = now.where("moved").select(*keys, F.col("umi").alias("u"), "label").join(steps, [*keys, "u"]).groupBy(*keys, F.col("v").alias("umi")).agg(F.min("label").alias("new"))
        better = now.drop("moved").join(handed, [*keys, "umi"], "left").withColumn("moved", F.coalesce(F.col("new") < F.col("label"), F.lit(False)))
        now = checkpointed(better.select(*keys, "umi", F.when(F.col("moved"), F.col("new")).otherwise(F.col("label")).alias("label"), "moved"))
    owned = nodes.select(*keys, "umi").join(now.select(*keys, "umi", F.col("label.owner").alias("owner")), [*keys, "umi"], "left")
    return owned.withColumn("owner", F.coalesce("owner", "umi"))


def umi_clusters(df: DataFrame, keys: list[str], frag_ratio: float = 2.0) -> DataFrame:
    """df with `umi_owner`: rows of a group whose UMIs have one owner are one cluster."""
    with_umi = df.withColumn("__umi", combined_umi())
    first = F.min_by("read_name", F.struct((-F.col("count")).alias("c"), (-F.col("map_qual")).alias("m"), (-F.col("mean_qual")).alias("q"), "read_name"))
    nodes = with_umi.groupBy(*keys, F.col("__umi").alias("umi")).agg(F.sum("count").alias("n"), first.alias("rep"))
    owners = umi_owners(nodes, keys, frag_ratio).withColumnRenamed("umi", "__umi").withColumnRenamed("owner", "umi_owner")
    return with_umi.join(owners, [*keys, "__umi"]).select(*df.columns, "umi_owner")


def unique_fuzzy(df: DataFrame, len_diff: int = 5, frag_ratio: float = 2.0, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates): of each UMI cluster of a tolerance group the best row by (count, map_qual,
    mean_qual) with the sum of counts; and (kept, duplicate) names of the rows that were merged into it."""
    keys = [*by, "chrom", "strand", "group"]
    clustered = checkpointed(umi_clusters(tolerance_groups(df, len_diff, by), keys, frag_ratio))
    return _merge(clustered, [*keys, "umi_owner"], df.columns)


def _merge(clustered: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    merged = survivors(clustered, keys, ["count", "map_qual", "mean_qual"])
    names = clustered.select(*keys, F.col("read_name").alias("duplicate")).join(merged.select(*keys, F.col("read_name").alias("kept")), keys)
    return merged.select(*columns), names.where("kept <> duplicate").select("kept", "duplicate")
