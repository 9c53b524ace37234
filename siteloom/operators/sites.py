"""From fragments to integration sites: projection, counts, diversity, run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siteloom.functions.sequences import natural_key


def project_sites(df: DataFrame, tsd: int = 1, u3: bool = False) -> DataFrame:
    """df with site_start, site_end and site_strand, the base next to the integrant.

    The shift is tsd - 1 if reads start from the U3 end, else 0; then the strand flips as well.
    """
    shift = tsd - 1 if u3 else 0
    minus = F.col("strand") == "-"
    at = F.when(minus, F.col("end") - shift - 1).otherwise(F.col("start") + shift)
    strand = F.when(minus, F.lit("+" if u3 else "-")).otherwise(F.lit("-" if u3 else "+"))
    return df.withColumn("site_start", at).withColumn("site_end", at + 1).withColumn("site_strand", strand)


def site_counts(sites: DataFrame, by: list[str] = []) -> DataFrame:
    """Fragments of each site."""
    return sites.groupBy(*by, "chrom", "site_start", "site_end", "site_strand").agg(F.count("*").alias("fragments"))


def ordered(sites: DataFrame, chrom: str = "chrom", start: str = "site_start") -> DataFrame:
    return sites.orderBy(natural_key(F.col(chrom)), start)


def summary(sites: DataFrame) -> DataFrame:
    """The table of one row per fragment with its site."""
    cols = ["chrom", "site_start", "site_end", "read_name", "count", "site_strand", "start", "end", "ltr_umi", "linker_umi", "map_qual", "mean_qual", "seq1", "multi"]
    return sites.select(*[c if c in sites.columns else F.lit(None).cast("string").alias(c) for c in cols])


def diversity(counts: DataFrame, count_col: str = "fragments", by: list[str] = []) -> DataFrame:
    """Shannon, Pielou and Simpson of the counts of each group; zeros where the total is zero."""
    positive = counts.where(F.col(count_col) > 0)
    x = F.col(count_col).cast("double")
    got = positive.groupBy(*by).agg(F.sum(x).alias("t"), F.sum(x * F.log(x)).alias("xl"), F.sum(x * x).alias("xx"), F.count("*").alias("s"))
    shannon = F.log("t") - F.col("xl") / F.col("t")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return got.select(
        *by, F.col("s").alias("sites"), zero(shannon).alias("shannon"), zero(F.when(F.col("s") > 1, shannon / F.log("s")).otherwise(0.0)).alias("pielou"), zero(1 - F.col("xx") / (F.col("t") * F.col("t"))).alias("simpson")
    )


def statistics(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows, reads, percent of the first stage's reads), in one job."""
    out = None
    for k, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("reads")).select(F.lit(k).alias("ord"), F.lit(name).alias("stage"), "rows", "reads")
        out = one if out is None else out.unionByName(one)
    total = F.first("reads").over(Window.orderBy("ord"))
    return out.select("stage", "rows", "reads", F.when(total > 0, 100 * F.col("reads") / total).otherwise(0.0).alias("percent"))
