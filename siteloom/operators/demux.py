"""Demultiplexing: fuzzy lookup of barcodes.

Barcodes are a table (sample, barcode, ord); ord is the order of the file, the first match wins.
Matching is substitutions only, case-insensitive, over the barcode's full length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions.sequences import hamming, revcomp
from siteloom.session import broadcast_if_small, checkpointed, numbered

def check_barcodes(barcodes: DataFrame) -> None:
    """Ids are unique and hold no '-', sequences are unique."""
    rows = barcodes.select("sample", F.upper("barcode").alias("barcode"))
    if rows.where(F.col("sample").contains("-")).limit(1).count():
        raise ValueError("barcode ids can't hold '-'")
    for what in ("sample", "barcode"):
        if rows.groupBy(what).count().where("count > 1").limit(1).count():
            raise ValueError(f"{what}s must be unique")


def check_same_ids(a: DataFrame, b: DataFrame) -> None:
    """Both barcode tables list the same ids in the same order."""
    first, second = (numbered(x.select("sample", "ord"), "ord", "place").select("place", F.col("sample").alias(c)) for x, c in ((a, "a"), (b, "b")))
    if first.join(second, "place", "full").where(~F.col("a").eqNullSafe(F.col("b"))).limit(1).count():
        raise ValueError("barcode files must list identical ids in one order")


def match(reads: DataFrame, index: Column, barcodes: DataFrame, error_rate: float = 0.1, out: str = "sample", order: str | None = None) -> DataFrame:
    """reads with `out`, the sample of the first barcode that the index matches, null if none does; order: a column for that barcode's ord.

    Exact for any rate and any number of barcodes. Of e + 1 pieces of a barcode, e substitutions leave one whole, so index
    and barcode meet on a piece at its place; of barcodes that match everything of their length only the first counts. Index values are
    reduced to distinct ones before, and these materialised, with the barcode each of them has: reads are passed over once for the
    values and once for the names, and not shuffled unless very many values match.
    """
    asked = reads.withColumn("__index", F.upper(index))
    edits = F.floor(F.length("__t") * error_rate).cast("int")
    cut = lambda k, n: F.floor(k * F.length("__t") / n).cast("int")
    n = F.col("__e") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.col("__e")), lambda k: F.struct(k.alias("k"), F.substr("__t", cut(k, n) + 1, cut(k + 1, n) - cut(k, n)).alias("p")))
    keyed = lambda df: df.withColumn("__e", edits).withColumn("__len", F.length("__t")).withColumn("__key", F.explode(F.when(F.col("__e") < F.col("__len"), pieces).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.lit("").alias("p"))))))
    codes = barcodes.select(F.upper("barcode").alias("__t"), F.struct(F.col("ord").alias("o"), F.col("sample").alias("s")).alias("__first"))
    whole = F.floor(F.length("__t") * error_rate) >= F.length("__t")
    codes = codes.where(~whole).unionByName(codes.where(whole).groupBy(F.length("__t")).agg(F.min_by("__t", "__first").alias("__t"), F.min("__first").alias("__first")).select("__t", "__first"))
    values = checkpointed(asked.select(F.col("__index").alias("__t")).distinct()).where("__t is not null")  # else the test for nulls goes below, where it costs the index once more
    sides = keyed(values).select("__len", "__key", F.col("__t").alias("__index"), "__e"), broadcast_if_small(keyed(codes).select("__len", "__key", F.col("__t").alias("__code"), "__first"))
    met = sides[0].join(sides[1], ["__len", "__key"]).where(hamming(F.col("__index"), F.col("__code")) <= F.col("__e"))
    first = broadcast_if_small(met.groupBy("__index").agg(F.min("__first").alias("__first")))
    named = asked.join(first, "__index", "left").withColumn(out, F.col("__first.s"))
    return (named.withColumn(order, F.col("__first.o")) if order else named).drop("__index", "__first")


def header_index(header: Column) -> tuple[Column, Column]:
    """(first, second) index of a header `name x:y:z:I1+I2`; null where it has none."""
    field = F.get(F.split(F.get(F.split(header, " "), F.lit(1)), ":"), F.lit(3))
    parts = F.split(field, r"\+", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def index_demux(reads: DataFrame, first: Column, codes1: DataFrame, second: Column | None = None, codes2: DataFrame | None = None, error_rate: float = 0.1) -> DataFrame:
    """reads with sample; with two indices both must name the same one."""
    if second is None:
        return match(reads, first, codes1, error_rate)
    both = match(match(reads.withColumn("__second", second), first, codes1, error_rate, "__s1"), F.col("__second"), codes2, error_rate, "__s2")
    return both.withColumn("sample", F.when(F.col("__s1") == F.col("__s2"), F.col("__s1"))).drop("__s1", "__s2", "__second")


def anchored(reads: DataFrame, seq: str, barcodes: DataFrame, error_rate: float, out: str, three_prime: bool = False) -> DataFrame:
    """reads with `out` for barcodes at the 5' end of seq, or for their reverse complements at the 3' end; any lengths."""
    codes = barcodes.withColumn("barcode", revcomp(F.col("barcode"))) if three_prime else barcodes
    named, cols = reads, []
    for n in sorted(r[0] for r in codes.select(F.length("barcode")).distinct().collect()):  # no more than a read has bases
        c, o = f"__{out}_{n}", f"__{out}_{n}_ord"
        cols.append((c, o))
        end = F.right(F.col(seq), F.lit(n)) if three_prime else F.substring(seq, 1, n)
        named = match(named, F.when(F.length(seq) >= n, end), codes.where(F.length("barcode") == n), error_rate, c, o)
    if not cols:
        return named.withColumn(out, F.lit(None).cast("string"))
    found = [F.when(F.col(c).isNotNull(), F.struct(F.col(o).alias("o"), F.col(c).alias("s"))) for c, o in cols]
    return named.withColumn(out, (F.least(*found) if len(found) > 1 else found[0])["s"]).drop(*(c for pair in cols for c in pair))


def inline_demux(reads: DataFrame, ltr: DataFrame | None, linker: DataFrame | None, error_rate: float = 0.1, keep_all: bool = False, seq1: str = "seq1", seq2: str | None = "seq2") -> DataFrame:
    """reads with sample1, sample2 (and sample), by inline barcodes.

    Both ends of pairs, or 5' and 3' of single reads (seq2 None), must match and name one sample, unless
    keep_all, which keeps all matched combinations. With barcodes for one end only, unmatched reads stay as 'unknown'.
    """
    if ltr is not None and linker is not None:
        got = anchored(reads, seq1, ltr, error_rate, "sample1")
        got = anchored(got, seq2, linker, error_rate, "sample2") if seq2 else anchored(got, seq1, linker, error_rate, "sample2", three_prime=True)
        got = got.where("sample1 is not null and sample2 is not null")
        return got.withColumn("sample", F.concat_ws("-", "sample1", "sample2")) if keep_all else got.where("sample1 = sample2").withColumn("sample", F.col("sample1"))
    if ltr is None and linker is None:
        raise ValueError("give barcodes")
    three = ltr is None and not seq2
    got = anchored(reads, seq1 if ltr is not None or three else seq2, ltr if ltr is not None else linker, error_rate, "sample", three_prime=three)
    return got.withColumn("sample", F.coalesce("sample", F.lit("unknown")))


def renamed(reads: DataFrame, names: DataFrame, col: str = "sample") -> DataFrame:
    """Samples by a table (old, new); others keep their name."""
    return reads.join(broadcast_if_small(names.select(F.col("old").alias(col), F.col("new").alias("__new"))), col, "left").withColumn(col, F.coalesce("__new", col)).drop("__new")
