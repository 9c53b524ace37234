"""Cropping: adapters are found, trimmed and turned into UMIs. Reads: read_name, seq1, qual1 (seq2, qual2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from siteloom.functions.align import find_adapter
from siteloom.functions.sequences import extract_umi, revcomp, revcomp_text
from siteloom.session import ship

MATCH = "struct<n_err:int,start:int,end:int,before:string,matched:string,after:string>"


def check_input(sequences: dict[str, str | None], rates: dict[str, float] = {}) -> None:
    """Sequences hold only A, C, G, T and at least 10 of them; error rates are at most 0.4."""
    for name, seq in sequences.items():
        if seq is not None and (len(seq) < 10 or set(seq) - set("ACGT")):
            raise ValueError(f"{name}: at least 10 of A, C, G, T")
    for name, rate in rates.items():
        if not 0 <= rate <= 0.4:
            raise ValueError(f"{name}: at most 0.4")


def ladder(seq: str, least: int, error_rate: float, capped: bool = False) -> list[str]:
    """Prefixes from the whole sequence down to `least`, each shorter by the errors its length allows (capped: by those of `least`), longest first."""
    out = [seq]
    while True:
        step = max(1, math.floor((least if capped else len(out[-1])) * error_rate))
        if len(out[-1]) - step < least:
            return out
        out.append(out[-1][:-step])


#: Cells (reads times the longest of them) of one alignment matrix.
CELLS = 1 << 20


def _slices(batch: pa.RecordBatch, seq: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose reads fill one matrix; a very long read is a part of its own."""
    first = longest = 0
    for k, n in enumerate(pc.utf8_length(batch.column(seq)).to_pylist()):
        longest = max(longest, n or 0)
        if k > first and longest * (k + 1 - first) > CELLS:
            yield batch.slice(first, k - first)
            first, longest = k, n or 0
    if batch.num_rows > first:
        yield batch.slice(first)


def adapter_match(df: DataFrame, seq: str, adapters: list[str], out: str, **options) -> DataFrame:
    """df with `out` (n_err, start, end, before, matched, after) for the first of the adapters that the read holds; null without a match or sequence."""
    ship(df.sparkSession)
    schema = df.select("*", F.lit(None).cast(MATCH).alias(out)).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in _slices(batch, seq):
                reads = part.column(seq).to_pylist()
                found = np.full((len(reads), 3), -1, np.int64)
                for adapter in adapters:
                    open_ = [k for k, (r, n) in enumerate(zip(reads, found[:, 0])) if r and n < 0]
                    if open_:
                        found[open_] = find_adapter([reads[k] for k in open_], adapter, **options)
                cuts = [(r, s, e) if n >= 0 else ("", 0, 0) for r, (n, s, e) in zip(reads, found.tolist())]
                cols = [*found.T, [r[:s] for r, s, _ in cuts], [r[s:e] for r, s, e in cuts], [r[e:] for r, _, e in cuts]]
                kind = arrow.field(out).type
                match = pa.StructArray.from_arrays([pa.array(c, kind.field(k).type) for k, c in enumerate(cols)], fields=list(kind), mask=pa.array(found[:, 0] < 0))
                yield pa.RecordBatch.from_arrays([*part.columns, match], schema=arrow)

    return df.mapInArrow(run, schema)


def trim_five(df: DataFrame, seq: str, qual: str, adapters: list[str], error_rate: float, min_len: int, out: str, leftmost: bool = False, max_errors: int | None = None) -> DataFrame:
    """Reads that hold the adapter in full, without it and what stands before; remainders under min_len go."""
    got = adapter_match(df, seq, adapters, out, error_rate=error_rate, leftmost=leftmost, max_errors=max_errors).where(F.col(out).isNotNull())
    return got.withColumn(qual, F.expr(f"substring({qual}, {out}.end + 1)")).withColumn(seq, F.col(out)["after"]).where(F.length(seq) >= min_len)


def trim_three(df: DataFrame, seq: str, qual: str, adapters: list[str], error_rate: float, min_len: int, required: bool = False, min_overlap: int = 5) -> DataFrame:
    """Reads cut where the adapter begins at their 3' end; ones that get shorter than min_len go, and if required those without a match."""
    got = adapter_match(df, seq, adapters, "__m", error_rate=error_rate, three_prime=True, min_overlap=min_overlap, leftmost=True)
    got = got.where(F.col("__m").isNotNull()) if required else got
    cut = F.coalesce(F.col("__m")["start"], F.length(seq))
    got = got.withColumn(qual, F.substr(F.col(qual), F.lit(1), cut)).withColumn(seq, F.substr(F.col(seq), F.lit(1), cut)).drop("__m")
    return got.where(F.length(seq) >= min_len)


def without_contaminants(df: DataFrame, seq: str, contaminants: list[str], error_rate: float = 0.3, overlap: int = 10) -> DataFrame:
    """df without the reads whose beginning matches a contaminant."""
    if not contaminants:
        return df
    headed = adapter_match(df.withColumn("__head", F.substring(seq, 1, max(map(len, contaminants)) + overlap)), "__head", contaminants, "__c", error_rate=error_rate)
    return headed.where("__c is null").drop("__c", "__head")


def best_orientation(matched: DataFrame, integrant: str, match: str, leftmost: bool = False) -> DataFrame:
    """One row of reads that were matched in several orientations: the smaller normalised edit distance of what matched, then the later start (leftmost: the earlier)."""
    text = F.col(match)["matched"]
    far = F.levenshtein(text, F.lit(integrant)) / F.greatest(F.length(text), F.lit(len(integrant)))
    start = F.col(match)["start"]
    w = Window.partitionBy("read_name").orderBy(far, start.asc() if leftmost else start.desc())
    return matched.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def swapped(df: DataFrame) -> DataFrame:
    """Mates the other way round."""
    return df.withColumns({"seq1": F.col("seq2"), "seq2": F.col("seq1"), "qual1": F.col("qual2"), "qual2": F.col("qual1")})


def crop(
    reads: DataFrame, ltr: str, linker: str | None = None, *, ltr_error_rate: float = 0.1, linker_error_rate: float = 0.1, min_frag_len: int = 25, ltr_umi: tuple[int, int, str | None] = (0, 0, None), linker_umi: tuple[int, int, str | None] = (0, 0, None),
    contaminants: list[str] = [], leftmost: bool = False, mixed: bool = False, long_read: bool = False, truncated: bool = False, min_ttr_len: int = 10, cap_error: bool = False,
) -> DataFrame:
    """Reads without integrant and linker, with ltr_umi, linker_umi, ltr_match and linker_match.

    The integrant must stand in full in read 1 (truncated: a prefix of its ladder) and the linker in
    read 2; the reverse complements of the other end's sequence are cut off where reads run through the
    fragment. A mate that fails takes its pair along. mixed: mates are tried both ways (long reads:
    both strands). UMI settings are (length, offset, pattern).
    """
    check_input({"ltr": ltr, "linker": linker}, {"ltr_error_rate": ltr_error_rate, "linker_error_rate": linker_error_rate})
    paired = "seq2" in reads.columns
    most = math.floor(min_ttr_len * ltr_error_rate) if cap_error else None
    adapters = ladder(ltr, min_ttr_len, ltr_error_rate, cap_error) if truncated else [ltr]
    first = lambda df: trim_five(df, "seq1", "qual1", adapters, ltr_error_rate, min_frag_len, "__ltr", leftmost, most)
    got = first(reads)
    if mixed:
        other = swapped(reads) if paired else reads.withColumns({"seq1": revcomp(F.col("seq1")), "qual1": F.reverse("qual1")})
        got = best_orientation(got.unionByName(first(other)), ltr, "__ltr", leftmost)
    got = without_contaminants(got, "seq1", contaminants)
    if linker:
        got = trim_three(got, "seq1", "qual1", [revcomp_text(linker)], linker_error_rate, min_frag_len, required=long_read)
        if paired:
            got = trim_five(got, "seq2", "qual2", [linker], linker_error_rate, min_frag_len, "__linker", leftmost)
    if paired:
        ends = [revcomp_text(a) for a in adapters]
        got = trim_three(got, "seq2", "qual2", ends, 0.0 if truncated else ltr_error_rate, min_frag_len)
    umi = lambda col, p: extract_umi(F.col(col)["before"], *p)
    has = "__linker" in got.columns
    out = got.withColumn("ltr_umi", umi("__ltr", ltr_umi)).withColumn("linker_umi", umi("__linker", linker_umi) if has else F.lit("N"))
    out = out.withColumn("ltr_match", F.col("__ltr")["matched"]).withColumn("linker_match", F.col("__linker")["matched"] if has else F.lit(None).cast("string"))
    for col, (n, _, _) in (("ltr_umi", ltr_umi), ("linker_umi", linker_umi)):
        if n and (col == "ltr_umi" or has):
            out = out.where(~F.col(col).contains("N"))
    return out.drop("__ltr", "__linker")


def tagged_header() -> Column:
    """The header of a cropped read, with its tags."""
    tag = lambda a, b: F.concat_ws("-", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return F.concat(F.col("read_name"), F.lit(" RX:Z:"), tag(F.col("ltr_umi"), F.col("linker_umi")), F.lit("\tOX:Z:"), tag(F.col("ltr_match"), F.col("linker_match")))
