"""Sites against annotated intervals: overlaps and nearest ones, both unstranded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from siteloom.session import checkpointed

#: Width of the bins within which boundaries of features are looked up.
BIN = 1 << 14


def _bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def _places(sites: DataFrame) -> DataFrame:
    """(chrom, s, e), each place once: sites of one place have the same features."""
    return checkpointed(sites.select("chrom", F.col("site_start").alias("s"), F.col("site_end").alias("e")).where("chrom is not null").distinct())


def _with_places(sites: DataFrame, found: DataFrame) -> DataFrame:
    """sites, site_id first, with what was found for their places (chrom, s, e, ...)."""
    f = found.withColumnsRenamed({"chrom": "__chrom", "s": "__s", "e": "__e"})
    same = F.col("chrom").eqNullSafe(F.col("__chrom")) & F.col("site_start").eqNullSafe(F.col("__s")) & F.col("site_end").eqNullSafe(F.col("__e"))
    return sites.select("site_id", *(c for c in sites.columns if c != "site_id")).join(f, same, "left").drop("__chrom", "__s", "__e")


def _until(points: DataFrame, asked: DataFrame, best: Callable[[str], Column], width: int, back: bool = False, strict: bool = False) -> DataFrame:
    """(chrom, p, v) for each asked (chrom, p): the aggregate `best` of v over the points (chrom, p, v) up to p, itself included unless strict; back: from p on.

    A window covers a bin, so it holds at most each of its positions twice; what all bins before hold comes in as one row at its beginning.
    """
    sign = -1 if back else 1
    edge = lambda b: b * width + (width - 1 if back else 0)
    q = asked.where("chrom is not null and p is not null").distinct().withColumn("__bin", F.floor(F.col("p") / width))
    at = points.where("chrom is not null and p is not null").withColumn("__bin", F.floor(F.col("p") / width))
    empty = F.lit(None).cast(at.schema["v"].dataType)
    across = Window.partitionBy("chrom").orderBy(F.lit(sign) * F.col("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = at.select("chrom", "__bin", "v").unionByName(q.select("chrom", "__bin", empty.alias("v"))).groupBy("chrom", "__bin").agg(best("v").alias("v"))
    before = bins.withColumn("v", best("v").over(across)).where("v is not null").select("chrom", "__bin", edge(F.col("__bin")).alias("p"), "v", F.lit(0).alias("kind"))
    rows = before.unionByName(at.select("chrom", "__bin", "p", "v", F.lit(2).alias("kind"))).unionByName(q.select("chrom", "__bin", "p", empty.alias("v"), F.lit(1 if strict else 3).alias("kind")))
    within = Window.partitionBy("chrom", "__bin").orderBy(F.lit(sign) * F.col("p"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("v", best("v").over(within)).where(F.col("kind").isin(1, 3)).select("chrom", "p", "v")


def overlaps(sites: DataFrame, features: DataFrame, width: int = BIN) -> DataFrame:
    """sites with n_overlaps: features whose half-open interval shares a base with [site_start, site_end).

    No pairs are made: the features that begin before the site's end less those that end up to its start are its overlaps. Only for intervals that
    end before they start are pairs met, in the bins they cover, each counted in the bin that holds the first shared base.
    """
    places = _places(sites)
    f = checkpointed(features.select("chrom", F.col("start").alias("fs"), F.col("end").alias("fe")).where("fs is not null and fe is not null").groupBy("chrom", "fs", "fe").agg(F.count("*").alias("n")))
    straight, forward = places.where("s <= e"), f.where("fs <= fe")
    of = lambda df, c: df.groupBy("chrom", F.col(c).alias("p")).agg(F.sum("n").alias("v"))
    named = lambda df, p, v: df.withColumnsRenamed({"p": p, "v": v})
    begun = named(_until(of(forward, "fs"), straight.select("chrom", F.col("e").alias("p")), F.sum, width, strict=True), "e", "begun")
    ended = named(_until(of(forward, "fe"), straight.select("chrom", F.col("s").alias("p")), F.sum, width), "s", "ended")
    # an empty site at an empty feature neither is after its end nor before its start
    void = named(of(forward.where("fs = fe"), "fs"), "s", "void")
    none = lambda c: F.coalesce(c, F.lit(0))
    counted = straight.join(begun, ["chrom", "e"], "left").join(ended, ["chrom", "s"], "left").join(void, ["chrom", "s"], "left")
    counted = counted.select("chrom", "s", "e", (none("begun") - none("ended") + F.when(F.col("s") == F.col("e"), none("void")).otherwise(0)).alias("n"))
    for a, b in ((straight, f.where("fs > fe")), (places.where("s > e"), f)):
        met = _bins(a, "s", "e", width).join(_bins(b, "fs", "fe", width), ["chrom", "__bin"])
        met = met.where((F.col("s") < F.col("fe")) & (F.col("fs") < F.col("e")) & (F.floor(F.greatest("s", "fs") / width) == F.col("__bin")))
        counted = counted.unionByName(met.select("chrom", "s", "e", "n"))
    total = counted.groupBy("chrom", "s", "e").agg(F.sum("n").alias("n_overlaps"))
    return _with_places(sites, total).withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)))


def overlap_share(counted: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of rows (or of the weight) that overlap a feature."""
    w = F.col(weight) if weight else F.lit(1.0)
    return counted.agg(F.sum(F.when(F.col("n_overlaps") > 0, w).otherwise(0.0)).alias("overlapping"), F.sum(w).alias("total")).withColumn("share", F.when(F.col("total") > 0, F.col("overlapping") / F.col("total")).otherwise(0.0))


def nearest(sites: DataFrame, features: DataFrame, width: int = BIN) -> DataFrame:
    """sites with feature and distance: 0 if they overlap, else one more than the bases between them.

    Ties go to the smaller feature start, end and name. Candidates are what overlaps, the feature that
    ends last before the site and the one that starts first after it. Of the features that end after the site's start the first
    one overlaps the site if any does. All three are looked up within bins, with the best of all earlier or later bins carried along,
    so no pairs are made and no window holds a chromosome.
    """
    places = _places(sites)
    row = F.struct("start", "end", "name")
    # of features with one boundary the tie rule's first one
    f = features.select("chrom", "start", "end", "name")
    by = lambda c: f.groupBy("chrom", F.col(c).alias("p")).agg(F.min(row).alias("v"))
    last, first = checkpointed(by("end")), checkpointed(by("start"))
    asked = lambda c: places.select("chrom", F.col(c).alias("p"))
    keyed = lambda df, sign: df.withColumn("v", F.struct((F.lit(sign) * F.col("p")).cast("long").alias("k"), F.col("v").alias("f")))
    named = lambda df, p, v: df.withColumnsRenamed({"p": p, "v": v})
    inside = named(_until(last, asked("s"), F.min, width, back=True, strict=True), "s", "inside")
    before = named(_until(keyed(last, 1), asked("s"), F.max, width), "s", "before")
    after = named(_until(keyed(first, -1), asked("e"), F.max, width, back=True), "e", "after")
    got = places.join(inside, ["chrom", "s"], "left").join(before, ["chrom", "s"], "left").join(after, ["chrom", "e"], "left")
    at = lambda distance, f: F.struct(distance.cast("long").alias("distance"), F.col(f).alias("f"))
    best = F.least(
        F.when(F.col("inside.start") < F.col("e"), at(F.lit(0), "inside")), F.when(F.col("before").isNotNull(), at(F.col("s") - F.col("before.k") + 1, "before.f")), F.when(F.col("after").isNotNull(), at(-F.col("after.k") - F.col("e") + 1, "after.f"))
    )
    return _with_places(sites, got.select("chrom", "s", "e", best.alias("m")).select("chrom", "s", "e", F.col("m.distance").alias("distance"), F.col("m.f.name").alias("feature")))
