"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent and the results are normalised. The exponent
is bisected until the weights have a target entropy or no source is repeated more often than a limit
allows. A source whose weight asks for 2.4 passes gets two whole passes and a part of a third one.
Each pass permutes the source's blocks (a hash of the document deals it to a block), and within a
block its documents; the part of a pass takes blocks, then documents of the block that is cut, until
its tokens are used. As both orders are orders of hashes, a part is told by two hash values for each
source, and no text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siteloom.llm.common import documents, fresh
from siteloom.session import broadcast_if_small, checkpointed

#: Blocks of a source, and ranges of places within the block that is cut (a power of two).
BLOCKS, RANGES = 4096, 4096
#: Exponents that one look at the sources' tokens weighs, and looks; together they halve the interval 40 times.
EXPONENTS, LOOKS = 31, 8
SEED = 11
_NULL = "\x00null"


def exponent_for(sums: Callable[[list[float]], list[tuple[float, float]]], total: int, least: int, most: int, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target, by bisection; the nearest end where none does.

    sums gives for each exponent a, over the shares p of the sources with tokens, the sums of p^a and of
    p^a ln p. Entropy (in nats) falls as the exponent grows from 0, equal weights. With max_repeats the
    smallest exponent counts whose largest number of passes, that of the smallest source, stays within it.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")

    def low_enough(exponents: list[float]) -> list[bool]:
        if target_entropy is not None:
            return [math.log(z) - a * zl / z <= target_entropy for a, (z, zl) in zip(exponents, sums(exponents))]
        if budget is None:
            often = [(most / least) ** (1 - a) for a in exponents]
        else:
            often = [(least / total) ** a / z * budget / least for a, (z, _) in zip(exponents, sums(exponents))]
        return [n <= max_repeats * (1 + 1e-12) for n in often]

    if low_enough([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(LOOKS):
        grid = [low + (high - low) * k / (EXPONENTS + 1) for k in range(1, EXPONENTS + 1)]
        met = [*low_enough(grid), True]
        first = met.index(True)
        low, high = [low, *grid][first], [*grid, high][first]
    return high


def words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def _after(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with up, the sum of t up to each row of a source; few rows of each source at most."""
    return df.withColumn("up", F.sum("t").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def mix(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", *, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """df's rows as often as their source's weight asks for, with __epoch, __block and __place (which replace columns of these names).

    Ordered by __epoch, __block, __place a source's rows are its block permutations. Tokens are words.
    A null source is a source of its own. Rows without words (null and empty texts) cost nothing and
    come along with their block. Repeated rows with one id share their fate; a null id is an id. The
    part of a pass ends with the document that reaches its budget. An empty table stays empty. Sources
    may be as many as there are documents: their tokens stay a table, of which only sums are looked at.
    """
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))
    block = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(BLOCKS))
    base = df.select(key.alias("s"), block.alias("b"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("t"))
    blocks = checkpointed(base.groupBy("s", "b").agg(F.sum("t").alias("t")))
    sources = checkpointed(blocks.groupBy("s").agg(F.sum("t").alias("t")))
    filled = sources.where("t > 0")
    total, least, most = filled.agg(F.sum("t"), F.min("t"), F.max("t")).first()

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        p = F.col("t") / F.lit(float(total))
        got = filled.agg(*[F.sum(x) for a in exponents for x in (F.pow(p, F.lit(a)), F.pow(p, F.lit(a)) * F.log(p))]).first()
        return list(zip(got[::2], got[1::2]))

    often = F.lit(1.0)
    if total:
        a = exponent_for(sums, total, least, most, target_entropy, max_repeats, budget)
        norm = sums([a])[0][0]
        if budget is None:  # the least one that reads every source once
            budget = total * norm * max((t / total) ** (1 - a) for t in (least, most))
        share = F.col("t") / F.lit(float(total))
        often = F.when(F.col("t") > 0, F.pow(share, F.lit(a)) / F.lit(norm) * F.lit(float(budget)) / F.col("t")).otherwise(1.0)
    plan = sources.withColumn("n", often).withColumn("whole", F.floor(F.col("n") + 1e-9).cast("int"))
    plan = broadcast_if_small(plan.select("s", "whole", F.greatest(F.lit(0), F.round((F.col("n") - F.col("whole")) * F.col("t"))).cast("long").alias("part")))
    order = F.xxhash64(F.lit(SEED + 1), "s", "whole", "b")
    place = F.xxhash64(F.lit(SEED + 2), "id", "whole")
    # the block that is cut, then the range of places in it, then the document: each ordered within its source
    up = _after(blocks.join(plan.where("part > 0"), "s").withColumn("h", order), ["s"], ["h", "b"]).where("up >= part")
    cut = broadcast_if_small(up.groupBy("s").agg(F.min_by(F.struct("h", "b", "whole", (F.col("part") - F.col("up") + F.col("t")).alias("rest")), F.struct("h", "b")).alias("c")).select("s", "c.*"))
    within = base.join(cut, ["s", "b"]).groupBy("s", "rest", place.alias("p"), "id").agg(F.sum("t").alias("t"))
    within = checkpointed(within.withColumn("r", F.shiftright("p", 64 - int(math.log2(RANGES)))))
    up = _after(within.groupBy("s", "r", "rest").agg(F.sum("t").alias("t")), ["s"], ["r"]).where("up >= rest")
    ranges = broadcast_if_small(up.groupBy("s").agg(F.min_by(F.struct("r", (F.col("rest") - F.col("up") + F.col("t")).alias("left")), "r").alias("c")).select("s", "c.*"))
    up = _after(within.join(ranges, ["s", "r"]), ["s"], ["p", "id"]).where("up - t < left")
    ends = up.groupBy("s").agg(F.max("p").alias("p"))
    ends = cut.select("s", "h", "b").join(ends, "s", "left")
    of, whole, h, b, p, n = (fresh(df.columns, f"__mix_{c}") for c in ("s", "whole", "h", "b", "p", "n"))
    rules = plan.join(ends, "s", "left").select(F.col("s").alias(of), F.col("whole").alias(whole), F.col("h").alias(h), F.col("b").alias(b), F.col("p").alias(p))
    kept = [c for c in df.columns if c not in ("__epoch", "__block", "__place")]
    wide = df.withColumn(of, key).join(broadcast_if_small(rules), of)
    at = F.struct(F.xxhash64(F.lit(SEED + 1), of, whole, block).alias("h"), block.alias("b"))
    end = F.struct(F.col(h).alias("h"), F.col(b).alias("b"))
    taken = F.col(h).isNotNull() & ((at < end) | ((at == end) & (F.xxhash64(F.lit(SEED + 2), F.col(id_col), whole) <= F.col(p))))
    copies = F.col(whole) + F.when(F.coalesce(taken, F.lit(False)), 1).otherwise(0)
    out = wide.withColumn(n, copies).where(F.col(n) > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return out.select(
        *kept, "__epoch", F.xxhash64(F.lit(SEED + 1), of, "__epoch", block).alias("__block"), F.xxhash64(F.lit(SEED + 2), F.col(id_col), "__epoch").alias("__place")
    )


#: Production setting: every document at least once, no source more than twice as often as another.
MAX_REPEATS = 2.0


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, epoch and the two keys of the order, for all documents as mix states; no source is read more than MAX_REPEATS times."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"), max_repeats=MAX_REPEATS)
    return mixed.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__block").alias("block_key"), F.col("__place").alias("place_key"))
