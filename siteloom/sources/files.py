"""Sequence and interval files as DataFrames; paths are Spark paths. Files are told by their first two bytes: where the name says otherwise, they are streamed."""

from __future__ import annotations

import gzip
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siteloom.session import BROADCAST_ROWS, broadcast_if_small, checkpointed, ship
from siteloom.sources import bam

#: Files of one sample and mate, at most.
FILES = 64
#: Lines of one bin of a FASTA file.
LINE_BIN = 1 << 16

BED = "chrom string, start long, end long, name string, score double, strand string"


def misnamed(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """(files as their names say, (file, compressed) of the others): whether a file is compressed by gzip tell its first two bytes, not its name.
    Files on a system that only Spark's readers open are taken as named."""
    ship(spark)

    def look(batches):
        for pdf in batches:
            heads = []
            for p in pdf["path"]:
                try:
                    with bam.opened(p) as f:
                        heads.append(f.read(2) == b"\x1f\x8b")
                except (OSError, ValueError):
                    heads.append(None)
            yield pdf[["path"]].assign(packed=pd.array(heads, "boolean"))

    found = spark.read.format("binaryFile").load(path).select("path").mapInPandas(look, "path string, packed boolean").collect()  # a row for each file
    odd = [(r.path, r.packed) for r in found if r.packed is not None and r.packed != r.path.endswith(".gz") and not r.path.endswith((".bz2", ".zst", ".lz4", ".snappy", ".deflate"))]
    return [r.path for r in found if r.path not in {p for p, _ in odd}], odd


def _streamed(spark: SparkSession, odd: list[tuple[str, bool]]) -> DataFrame:
    """(file, at, value) of misnamed files, line by line, each in one task."""

    def run(batches):
        for pdf in batches:
            for path, packed in zip(pdf["path"], pdf["packed"]):
                with bam.opened(path) as f:
                    rows, first = io.TextIOWrapper(gzip.GzipFile(fileobj=f) if packed else f, newline=None), 0
                    while some := [line.rstrip("\n") for line in itertools.islice(rows, 4096)]:
                        yield pd.DataFrame({"file": path, "at": range(first, first + len(some)), "value": some})
                        first += len(some)

    return spark.createDataFrame(odd, "path string, packed boolean").repartition(len(odd)).mapInPandas(run, "file string, at long, value string")


def _split_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, at, value, up, n): lines with their number within the file, and of their split the lines before it in the file and its own. The rows of a
    split lie in one partition, in order. And (up, n) of the splits.

    Lines are counted by split first, so a file that is read in several splits is numbered
    without passing through one task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    per = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    per = per.withColumn("up", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    splits = checkpointed(per)  # a row for each split
    few = splits.count() <= BROADCAST_ROWS
    got = raw.join(F.broadcast(splits) if few else splits, ["file", "block"]).select("file", (F.col("up") + F.col("id") - F.col("first")).alias("at"), "value", "up", "n")
    return got if few else got.sortWithinPartitions("file", "at"), splits.select("up", "n")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): lines with their number within the file."""
    named, odd = misnamed(spark, path)
    if odd and not named:
        return _streamed(spark, odd)
    got = _split_lines(spark, named if odd else path)[0].select("file", "at", "value")
    return got.unionByName(_streamed(spark, odd)) if odd else got


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, record, header, seq, qual) of lines (file, at, value) in the order of their files; what the last record of a file lacks is null."""

    def whole(rows: pa.Table, at: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        lines, end = rows.column("value"), np.append(start[1:], len(at))
        line = lambda k: lines.take(pa.array(np.minimum(start + k, len(at) - 1), mask=start + k >= end)).combine_chunks()
        return pa.RecordBatch.from_arrays([rows.column("file").take(pa.array(start)).combine_chunks(), pa.array(at[start] // 4), line(0), line(1), line(3)], names=["file", "record", "header", "seq", "qual"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        at = rows.column("at").to_numpy()
        start = np.flatnonzero(at % 4 == 0)
        held = rows.slice(start[-1])  # the last record may go on in the next batch: four lines at most
        if len(start) > 1:
            yield whole(rows.slice(0, start[-1]), at[: start[-1]], start[:-1])
    if held is not None:
        yield whole(held.combine_chunks(), held.column("at").to_numpy(), np.zeros(1, int))


def _fastq_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, header, seq, qual). Lines are put together as they are read, without a sort or a shuffle; only the records that the end of a split cuts are gathered by their number."""
    named, odd = misnamed(spark, path)
    form = lambda df: df.select("file", "at", "value").mapInArrow(_records, "file string, record long, header string, seq string, qual string")
    if odd and not named:
        return form(_streamed(spark, odd))
    lines, splits = _split_lines(spark, named if odd else path)
    if splits.where("up % 4 <> 0 or (up + n) % 4 <> 0").limit(1).count():
        record = F.floor(F.col("at") / 4)
        cut = (record * 4 < F.col("up")) | (record * 4 + 4 > F.col("up") + F.col("n"))
        ends = lines.where(cut).groupBy("file", record.alias("record")).agg(*[F.max(F.when(F.col("at") % 4 == k, F.col("value"))).alias(c) for k, c in ((0, "header"), (1, "seq"), (3, "qual"))])
        got = form(lines.where(~cut)).unionByName(ends)
    else:
        got = form(lines)
    return got.unionByName(form(_streamed(spark, odd))) if odd else got


def read_fastq(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, record, read_name, comment, seq, qual). A number of lines that four doesn't divide is an error if strict."""
    got = _fastq_lines(spark, path)
    bad = F.col("seq").isNull() | F.col("qual").isNull()
    if strict:  # a record that lacks a line stops the read
        got = got.withColumn("seq", F.when(bad, F.raise_error(F.lit("FASTQ: the number of lines is no multiple of four")).cast("string")).otherwise(F.col("seq")))
    else:
        got = got.where(~bad)
    return got.select("file", "record", F.regexp_extract("header", r"^@?(\S*)", 1).alias("read_name"), F.regexp_extract("header", r"^\S*\s+(.*)$", 1).alias("comment"), "seq", "qual")


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by name: read_name, seq1, qual1, seq2, qual2."""
    return first.select("read_name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(second.select("read_name", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "read_name")


def write_fastq(reads: DataFrame, path: str, header: Column, seq: str = "seq1", qual: str = "qual1", occurrence: int = 1) -> None:
    """One record of each name, its first (or given) occurrence in the order of sequence and quality."""
    w = Window.partitionBy("read_name").orderBy(seq, qual)
    one = reads.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == occurrence)
    one.select(F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("value")).write.text(path, compression="gzip")


def write_sample_fastq(reads: DataFrame, path: str) -> None:
    """Compressed FASTQ in a folder of each sample and mate (sample=.../mate=...), for demultiplexed reads (sample, read_name, seq1, qual1 and, of pairs, seq2, qual2).
    Rows go to files by their sample and a part of their name, so that a sample of very many reads has several files, and both mates in one order."""
    record = lambda k: F.concat(F.lit("@"), "read_name", F.lit("\n"), f"seq{k}", F.lit("\n+\n"), f"qual{k}")
    mates = F.array(*[F.struct(F.lit(k).alias("mate"), record(k).alias("value")) for k in (1, 2) if f"seq{k}" in reads.columns])
    rows = reads.repartition("sample", F.pmod(F.xxhash64("read_name"), F.lit(FILES))).sortWithinPartitions("sample", "read_name")
    out = rows.select("sample", F.explode(mates).alias("m")).select("sample", F.col("m.mate").alias("mate"), F.col("m.value").alias("value"))
    out.where("value is not null").write.partitionBy("sample", "mate").text(path, compression="gzip")


def read_sample_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_fastq of such folders, with sample and mate."""
    part = lambda c: F.regexp_extract("file", rf"/{c}=([^/]*)/", 1)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    got = read_fastq(spark, f"{path}/*/*")
    # the folder's name has some letters encoded, and the path's once more
    return got.select(decoded(decoded(part("sample"))).alias("sample"), part("mate").cast("int").alias("mate"), *got.columns)


def write_samples(reads: DataFrame, path: str) -> None:
    """One folder of each sample."""
    reads.write.partitionBy("sample").option("sep", "\t").csv(path, compression="gzip")


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, contig, off, value): sequence lines of FASTA with their record, the line number of its header, and the bases before them in it.

    Headers and sums are carried over bins of lines, so neither a file nor a contig goes through one task.
    """
    at = _lines(spark, path).withColumn("__bin", F.floor(F.col("at") / LINE_BIN))
    head = F.col("value").startswith(">")
    at = at.withColumn("value", F.when(head, F.col("value")).otherwise(F.upper(F.trim("value")))).withColumn("n", F.when(head, 0).otherwise(F.length("value")).cast("long"))
    within = Window.partitionBy("file", "__bin").orderBy("at")
    at = at.withColumn("rec", F.max(F.when(head, F.col("at"))).over(within))
    at = checkpointed(at.withColumn("up", F.sum("n").over(Window.partitionBy("file", "__bin", "rec").orderBy("at")) - F.col("n")))
    bins = at.groupBy("file", "__bin").agg(F.max("rec").alias("last"), F.sum(F.when(F.col("rec").isNull(), F.col("n")).otherwise(0)).alias("open"), F.max_by("up", "at").alias("u"), F.max_by("n", "at").alias("m"))
    across = Window.partitionBy("file").orderBy("__bin")  # a row for each LINE_BIN lines
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("from", F.last("last", ignorenulls=True).over(before)).withColumn("end", F.when(F.col("last").isNotNull(), F.col("u") + F.col("m")))
    # of the record that is open where a bin begins: the bases in the bin where it began, and in whole bins since then
    bins = bins.withColumn("part", F.count("last").over(before)).withColumn("more", F.sum(F.when(F.col("last").isNull(), F.col("open")).otherwise(0)).over(Window.partitionBy("file", "part").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)))
    bins = bins.withColumn("begun", F.last("end", ignorenulls=True).over(before))
    carried = bins.select("file", "__bin", "from", (F.coalesce("begun", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("carry"))
    named = at.where(head).select("file", F.col("at").alias("rec"), F.regexp_extract("value", r"^>(\S*)", 1).alias("contig"))
    full = at.join(broadcast_if_small(carried), ["file", "__bin"]).where(~head)
    full = full.select("file", F.coalesce("rec", "from").alias("rec"), (F.col("up") + F.when(F.col("rec").isNull(), F.col("carry")).otherwise(0)).alias("off"), "n", "value").where("rec is not null")
    return full.join(broadcast_if_small(named), ["file", "rec"])


def fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 14) -> DataFrame:
    """(contig, chunk, seq): contigs of FASTA files in upper case, cut in chunks of `size` bases; no contig is ever one row."""
    lines = fasta_lines(spark, path).where("n > 0")
    parts = lines.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("off") / size), F.floor((F.col("off") + F.col("n") - 1) / size))))
    low = F.greatest(F.lit(0).cast("long"), F.col("chunk") * size - F.col("off"))
    high = F.least(F.col("n"), (F.col("chunk") + 1) * size - F.col("off"))
    piece = F.substr(F.col("value"), (low + 1).cast("int"), (high - low).cast("int"))
    held = parts.groupBy("file", "contig", "chunk").agg(F.array_sort(F.collect_list(F.struct("off", piece.alias("s")))).alias("l"))  # size bases at most
    return held.select("contig", "chunk", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("seq"))


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length)"""
    return fasta_lines(spark, path).groupBy("file", "rec", "contig").agg(F.max(F.col("off") + F.col("n")).alias("length")).select("contig", "length")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, ord, seq) of records that fit in a row, such as barcodes or primers; a genome is read by fasta_chunks."""
    lines = fasta_lines(spark, path)
    got = lines.groupBy("file", "rec", "contig").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("l"))
    return got.select("contig", F.col("rec").alias("ord"), F.array_join(F.transform("l", lambda x: x["value"]), "").alias("seq"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(sample, barcode, ord), checked."""
    from siteloom.operators.demux import check_barcodes

    codes = read_fasta(spark, path).select(F.col("contig").alias("sample"), F.col("seq").alias("barcode"), "ord")
    check_barcodes(codes)
    return codes


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BED).option("sep", "\t").option("comment", "#").csv(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, as parse_sam gives them."""
    return parse_sam(_lines(spark, path))


def _operations(cigar: Column) -> Column:
    """(op, len) of each operation of a CIGAR. Where it holds nothing but numbers and letters in turn, it is cut at them; else what looks like operations is searched."""
    letters, digits = "MIDNSHP=X", "0123456789"
    spaced = F.translate(cigar, letters, " " * 9)
    plain = (F.translate(cigar, letters + digits, "") == "") & spaced.endswith(" ") & ~F.concat(F.lit(" "), spaced).contains("  ")
    kind = "array<struct<op:int,len:int>>"
    cut = F.arrays_zip(F.split(F.translate(cigar, letters + digits, "012345678"), ""), F.split(F.rtrim(spaced), " ")).cast(kind)
    searched = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda c: F.struct((F.instr(F.lit(letters), F.right(c, F.lit(1))) - 1).alias("op"), F.regexp_extract(c, "([0-9]+)", 1).cast("int").alias("len")))
    return F.when(plain, cut).otherwise(searched.cast(kind))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignments of lines (at, value) of SAM text: the columns that the QC operators read, and ord, primary, proper. Headers and unmapped records are left out.

    A line is split once, and each tag is looked up once, behind the eleven fields.
    """
    number = lambda c: F.col(c).cast("int")
    # the flag apart, so that lines are split after unmapped ones are gone
    raw = lines.where(~F.col("value").startswith("@") & (F.get(F.split("value", "\t", 3), F.lit(1)).cast("int").bitwiseAND(4) == 0))
    f, tags = F.col("f"), ("MD", "NM", "XM", "AS", "XS", "RX", "OX")
    got = raw.select("at", F.split("value", "\t", 12).alias("f")).select("at", "f", F.concat(F.lit("\t"), F.get(f, F.lit(11))).alias("rest"))
    # in steps, each of them small: where a tag begins, what stands there, its value
    got = got.select("*", *[F.locate(f"\t{t}:", F.col("rest")).alias(f"at_{t}") for t in tags])
    got = got.select("at", "f", *[F.when(F.col(f"at_{t}") > 0, F.substring_index(F.substr("rest", F.col(f"at_{t}") + 4), "\t", 1)).alias(f"is_{t}") for t in tags])
    got = got.select("at", "f", *[F.when(F.col(f"is_{t}").rlike("(?s)^[A-Za-z]:."), F.substr(f"is_{t}", F.lit(3))).alias(f"_{t}") for t in tags])
    got = got.select("*", F.get(f, F.lit(1)).cast("int").alias("flag"), _operations(F.get(f, F.lit(5))).alias("ops"))
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    start = F.get(f, F.lit(3)).cast("long") - 1
    span = F.aggregate("ops", F.lit(0), lambda s, c: s + F.when(c["op"].isin(0, 2, 3, 7, 8), c["len"]).otherwise(0))
    pair = lambda t, k: F.coalesce(F.get(F.split(f"_{t}", "-", 2), F.lit(k)), F.lit("N"))
    return got.select(
        F.get(f, F.lit(0)).alias("read_name"), F.when(bit(128), 2).otherwise(1).alias("mate"), F.get(f, F.lit(2)).alias("ref"), start.alias("start"), (start + span).alias("end"), F.when(bit(16), "-").otherwise("+").alias("strand"),
        F.get(f, F.lit(4)).cast("int").alias("mapq"), F.col("ops").alias("cigar"), F.col("_MD").alias("md"), number("_NM").alias("nm"), number("_XM").alias("xm"), number("_AS").alias("score"), number("_XS").alias("second"),
        F.get(f, F.lit(9)).alias("seq"), F.transform(F.split(F.get(f, F.lit(10)), ""), lambda c: F.ascii(c) - 33).alias("quals"), F.get(f, F.lit(8)).cast("int").alias("tlen"),
        pair("RX", 0).alias("ltr_umi"), pair("RX", 1).alias("linker_umi"), pair("OX", 0).alias("ltr_match"), pair("OX", 1).alias("linker_match"), F.col("at").alias("ord"), (~bit(256) & ~bit(2048)).alias("primary"), bit(2).alias("proper"),
    )


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files, as parse_sam gives them. A file is read in splits (bam.py), in the order of its records."""
    return parse_sam(bam.lines(spark, path))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM text or BAM, by the name of the path."""
    return read_bam(spark, path) if path.endswith(".bam") else read_sam(spark, path)


def write_bed(df: DataFrame, path: str, columns: list[str], header: bool = False, single: bool = False) -> None:
    """Tab-separated and compressed, in the order of the rows; single: one file."""
    out = df.select(*columns)
    (out.coalesce(1) if single else out).write.option("sep", "\t").option("header", header).csv(path, compression="gzip")


def write_duplicates(duplicates: DataFrame, path: str) -> None:
    """(kept, duplicate) pairs as JSON rows; one row each, so a read with very many duplicates is no large row."""
    duplicates.write.json(path, compression="gzip")


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path, compression="gzip")


def unfiltered_fragments(alignments: DataFrame) -> DataFrame:
    """Every mapped pair (or single read) as a fragment row, without quality filter or dedup, sorted."""
    rows = alignments.groupBy("read_name").agg(F.first("ref").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("mapq").alias("map_qual"), F.max(F.when(F.col("mate") == 1, F.col("strand"))).alias("strand"))
    return rows.select("chrom", "start", "end", "read_name", "map_qual", "strand").orderBy("chrom", "start", "end", "read_name")
