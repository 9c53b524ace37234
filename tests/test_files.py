import gzip
import json
import os
import struct
import sys

import pytest
from pyspark.sql import functions as F

from siteloom.plans import adapters
from siteloom.plans.params import Params
from siteloom.plans.run import run, run_samples, write_result
from siteloom.sources import aligner, files, setup


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("".join(f"@r{k} 1:N:0:ACGT\nACGT\n+\n@III\n" for k in range(50)))
    got = files.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("record").collect()
    assert len(got) == 50 and (got[7].read_name, got[7].comment, got[7].qual) == ("r7", "1:N:0:ACGT", "@III")
    (tmp_path / "b.fastq").write_text("@r\nACGT\n+\n")
    with pytest.raises(Exception, match="four"):
        files.read_fastq(spark, str(tmp_path / "b.fastq")).collect()


def test_fastq_is_read_without_sorting_lines(spark, tmp_path):
    """Records over Arrow batches, packed files of one task and the ends of splits; a record is put together where its lines are read."""
    want = {f"r{k}": ("ACGT"[k % 4] * (1 + k % 90), "@I"[k % 2] * (1 + k % 90)) for k in range(30_000)}
    text = lambda names: "".join(f"@{n} c\n{want[n][0]}\n+\n{want[n][1]}\n" for n in names)
    names = list(want)
    (tmp_path / "packed").mkdir()
    for k in range(3):
        (tmp_path / "packed" / f"{k}.fastq.gz").write_bytes(gzip.compress(text(names[k::3]).encode()))
    (tmp_path / "plain.fastq").write_text(text(names))
    read = files.read_fastq(spark, str(tmp_path / "packed"))
    assert "Aggregate" not in read._jdf.queryExecution().executedPlan().toString()
    assert {r.read_name: (r.seq, r.qual) for r in read.collect()} == want and read.count() == len(want)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_001)
    try:
        got = files.read_fastq(spark, str(tmp_path / "plain.fastq")).collect()
        (tmp_path / "short.fastq").write_text(text(names) + "@last\nA\n")
        with pytest.raises(Exception, match="four"):
            files.read_fastq(spark, str(tmp_path / "short.fastq")).collect()
        assert files.read_fastq(spark, str(tmp_path / "short.fastq"), strict=False).count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.read_name: (r.seq, r.qual) for r in got} == want and sorted(r.record for r in got) == list(range(len(want)))


def test_fasta_bed_sam(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 x\nACG\ntac\n>s2\nGGG\n")
    assert [(r.sample, r.barcode) for r in files.read_barcodes(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()] == [("s1", "ACGTAC"), ("s2", "GGG")]
    (tmp_path / "a.bed").write_text("chr1\t5\t9\tx\t0\t+\n")
    assert files.read_bed(spark, str(tmp_path / "a.bed")).first().end == 9
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t83\tchr1\t11\t30\t5S10M1D5M\t=\t1\t-60\tACGTACGTACGTACGTACGT\tIIIIIIIIIIIIIIIIIIII\tAS:i:9\tMD:Z:15\tRX:Z:AC-GT\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    r = files.read_sam(spark, str(tmp_path / "a.sam")).collect()
    assert len(r) == 1 and (r[0].start, r[0].end, r[0].strand, r[0].score, r[0].second, r[0].linker_umi, r[0].quals[0]) == (10, 26, "-", 9, None, "GT", 40)
    assert [tuple(c) for c in r[0].cigar] == [(4, 5), (0, 10), (2, 1), (0, 5)]


def test_setup(tmp_path):
    got = setup.read_setup("2\nnm ltr contam U3\na b\nACGT\nAA;CC none\ntrue false\n")
    assert got == [{"nm": "a", "ltr": "ACGT", "contam": ["AA", "CC"], "U3": True}, {"nm": "b", "ltr": "ACGT"}]
    setup.save_json(got, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text())[1] == ["--nm", "b", "--ltr", "ACGT"]
    with pytest.raises(FileExistsError):
        setup.save_json(got, str(tmp_path / "x.json"))
    assert setup.sheet_vectors([("a", "ACGNNTTT", "GGG")])["ltr"] == ["TTT"]


def test_params():
    p = Params()
    assert (p.min_mapq, p.token_size, p.minimizer_win) == (2, 4, 4)
    for bad in ({"um_reassign_diff": 0.3}, {"mle": True, "ltr_umi_len": 4}, {"check_mispriming": True}, {"umi_dedup_fp": True}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_whole_run(spark):
    cig = "array<struct<op:int,len:int>>"
    rows = []
    for k in range(12):
        at = 1000 + 40 * (k % 3)
        for mate, strand, start in ((1, "+", at), (2, "-", at + 70)):
            rows.append((f"r{k}", mate, "chr1", start, start + 50, strand, 30, [(0, 50)], "50", 0, 0, 100, None, "ACGTA" * 10, [40] * 50, 120, "N", "N", "x", "y"))
    df = spark.createDataFrame(rows, f"read_name string, mate int, ref string, start long, end long, strand string, mapq int, cigar {cig}, md string, nm int, xm int, score int, second int, seq string, quals array<int>, tlen int, ltr_umi string, linker_umi string, ltr_match string, linker_match string")
    got = run(df, Params(write_peaks=True))
    assert [(r.site_start, r.fragments) for r in got.counts.collect()] == [(1000, 1), (1040, 1), (1080, 1)]
    assert [r.reads for r in got.statistics.where("stage = 'final'").collect()] == [12]
    assert run(df.limit(0), Params()).counts.count() == 0


def test_samples_run_together_as_alone(spark, tmp_path):
    al = adapters.alignments(spark, "/root/testdata/sf0.001").withColumns({c: F.lit("N") for c in ("ltr_umi", "linker_umi", "ltr_match", "linker_match")}).withColumn("start", F.col("start") % 300).withColumn("end", F.col("start") + F.length("seq")).withColumn("ord", F.monotonically_increasing_id())
    al = al.where("mapq > 10")
    both = al.withColumn("sample", F.lit("a")).unionByName(al.where("start % 3 > 0").withColumn("sample", F.lit("b")))
    params = {"a": Params(single_end=True, write_peaks=True, mle=True), "b": Params(single_end=True, cluster_win=0)}
    features = spark.createDataFrame([("A", 10, 90, "f")], "chrom string, start long, end long, name string")
    got = run_samples(both, params, features=features)
    for name, p in params.items():
        alone = run(both.where(F.col("sample") == name).drop("sample"), p, features=features)
        for table in ("fragments", "counts", "diversity", "removed", "statistics"):
            rows = lambda df: sorted(map(str, df.collect()))
            assert rows(getattr(got, table).where(F.col("sample") == name).drop("sample")) == rows(getattr(alone, table)), table
    assert got.peaks is not None and {r[0] for r in got.abundance.select("sample").distinct().collect()} == {"a"} and got.overlaps.count() > 0
    with pytest.raises(ValueError):
        run_samples(both, {"a": Params()})
    write_result(got, f"{tmp_path}/out")
    assert {d: sorted(os.listdir(f"{tmp_path}/out/{d}")) for d in os.listdir(f"{tmp_path}/out")} == {
        "fragments": ["fragments"], "sites": ["abundance", "diversity", "sites", "statistics", "summary", "unique_sites"], "removed": ["duplicates", "final_pass"], "peaks": ["peaks"], "comparisons": ["nearest", "overlaps"],
    }
    assert spark.read.option("sep", "\t").csv(f"{tmp_path}/out/sites/unique_sites").count() == got.counts.count()
    write_result(run(al, Params(no_dedup=True)), f"{tmp_path}/plain")
    assert os.listdir(f"{tmp_path}/plain") == ["alignments"] and spark.read.option("sep", "\t").csv(f"{tmp_path}/plain/alignments/fragments").count() == al.select("read_name").distinct().count()


TOY = """
import sys
genome = {"chr1": "ACGTTGCAAGGCTTACCGATCCATGGTACGATTTGACCAGT"}
turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
print("@HD\tVN:1.6")
lines = [x.rstrip() for x in sys.stdin]
for name, seq, _, qual in zip(*(lines[k::4] for k in range(4))):
    for contig, text in genome.items():
        for flag, s, q in ((0, seq, qual), (16, turn(seq), qual[::-1])):
            at = text.find(s)
            if at >= 0:
                print(name[1:], flag, contig, at + 1, 40, f"{len(s)}M", "*", 0, 0, s, q, f"MD:Z:{len(s)}", "NM:i:0", "AS:i:0", sep="\t")
"""


def test_aligner(spark, tmp_path):
    """A toy program that finds exact places on both strands."""
    (tmp_path / "toy.py").write_text(TOY)
    rows = [("r1", "TTGCAAGGCT", "IIIIIIIIII", "AC"), ("r2", "ACTGGTCAAA", "ABCDEFGHIJ", "GG"), ("r3", "GGGGGGGGGG", "IIIIIIIIII", "TT")]
    reads = spark.createDataFrame(rows, "read_name string, seq1 string, qual1 string, ltr_umi string")
    command = [sys.executable, f"{tmp_path}/toy.py"]
    got = {r.read_name: r for r in aligner.align(reads, command).collect()}
    assert {k: (r.ref, r.start, r.end, r.strand, r.ltr_umi, r.seq) for k, r in got.items()} == {"r1": ("chr1", 3, 13, "+", "AC", "TTGCAAGGCT"), "r2": ("chr1", 31, 41, "-", "GG", "TTTGACCAGT")}
    assert got["r2"].quals == [ord(c) - 33 for c in "JIHGFEDCBA"]
    assert [r.read_name for r in aligner.contaminants_removed(reads, command).collect()] == ["r3"]
    with pytest.raises(FileNotFoundError):
        aligner.check_aligner(["no-such-program"])
    with pytest.raises(FileNotFoundError):
        aligner.check_aligner(command, [f"{tmp_path}/none.idx"])
    with pytest.raises(Exception, match="failed"):
        aligner.align(reads, [sys.executable, "-c", "import sys; sys.exit(3)"]).count()


def test_bam(spark, tmp_path):
    """Records written byte by byte, in two blocks."""
    codes = "=ACMGRSVTWYHKDBN"

    def record(name, flag, pos, cigar, seq, tags):
        n = len(seq)
        packed = bytes(codes.index(seq[k]) << 4 | (codes.index(seq[k + 1]) if k + 1 < n else 0) for k in range(0, n, 2))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 37, 0, len(cigar), flag, n, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", v << 4 | "MIDNSHP=X".index(o)) for v, o in cigar) + packed + bytes([30] * n) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr7\0" + struct.pack("<i", 1000)
    tags = b"MDZ7\0" + b"NMC\0" + b"ASi" + struct.pack("<i", -5) + b"XAA!" + b"XBBs" + struct.pack("<ihh", 2, 1, -2) + b"RXZAC-GT\0"
    one, two = record("a", 0, 9, [(7, "M")], "ACGTNAC", tags), record("b", 16, 99, [(2, "S"), (5, "M"), (1, "D"), (1, "M")], "ACGTACGT", tags)
    (tmp_path / "x.bam").write_bytes(gzip.compress(head + one[:20]) + gzip.compress(one[20:] + two + record("c", 4, -1, [], "A", b"")))
    got = files.read_alignments(spark, f"{tmp_path}/x.bam").orderBy("ord").collect()
    assert [(r.read_name, r.ref, r.start, r.end, r.strand, r.mapq, r.seq, r.md, r.nm, r.score, r.ltr_umi, r.linker_umi) for r in got] == [
        ("a", "chr7", 9, 16, "+", 37, "ACGTNAC", "7", 0, -5, "AC", "GT"), ("b", "chr7", 99, 106, "-", 37, "ACGTACGT", "7", 0, -5, "AC", "GT"),
    ]
    assert [(c.op, c.len) for c in got[1].cigar] == [(4, 2), (0, 5), (2, 1), (0, 1)] and got[0].quals == [30] * 7


def bgzf(data, size):
    """Blocks of at most `size` bytes of data, and the empty one that ends a file."""
    import zlib

    out = b""
    for at in [*range(0, len(data), size), len(data)]:
        part = data[at : at + size]
        pack = zlib.compressobj(wbits=-15)
        body = pack.compress(part) + pack.flush()
        out += struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("block, split", [(300, 1000), (5000, 700), (65000, 1 << 20)])
def test_bam_in_splits(spark, tmp_path, block, split):
    import random

    from siteloom.sources import bam

    rng = random.Random(block)
    raw = b"BAM\1" + struct.pack("<iii", 0, 2, 5) + b"chr7\0" + struct.pack("<ii", 1000, 5) + b"chr8\0" + struct.pack("<i", 99)
    for k in range(400):
        n, name = rng.choice([0, 7, 40, 900]), f"read{k}".encode()
        body = struct.pack("<iiBBHHHiiii", rng.randint(-1, 1), k, len(name) + 1, 37, 0, 1, 0, n, -1, -1, 0) + name + b"\0" + struct.pack("<I", n << 4) + rng.randbytes((n + 1) // 2) + bytes([30] * n) + b"NMC\1"
        raw += struct.pack("<i", len(body)) + body
    (tmp_path / "x.bam").write_bytes(bgzf(raw, block))
    got = bam.lines(spark, f"{tmp_path}/x.bam", split)
    assert got.rdd.getNumPartitions() >= min(3, (tmp_path / "x.bam").stat().st_size // split)
    assert [r.value.split("\t")[0] for r in got.orderBy("file", "at").collect()] == [f"read{k}" for k in range(400)]
    whole = bam._whole(spark, f"{tmp_path}/x.bam").orderBy("at").collect()
    assert [r.value for r in whole] == [r.value for r in got.orderBy("at").collect()]
    (tmp_path / "cut.bam").write_bytes(bgzf(raw[:-3], block))
    with pytest.raises(Exception, match="ends within"):
        bam.lines(spark, f"{tmp_path}/cut.bam", 1 << 20).count()


@pytest.mark.parametrize("lines, size, gz", [(2, 7, False), (3, 64, True), (1 << 16, 16, False)])
def test_fasta_in_chunks(spark, tmp_path, monkeypatch, lines, size, gz):
    import random

    monkeypatch.setattr(files, "LINE_BIN", lines)
    rng = random.Random(size)
    seqs = {f"c{k}": "".join(rng.choice("ACGTacgtn") for _ in range(rng.choice([0, 1, 30, 200]))) for k in range(12)}
    text = "; no record yet\n" + "".join(f">{c} about it\n" + "".join(s[at : at + 11] + "\n" for at in range(0, len(s), 11)) + ("\n" if len(s) == 30 else "") for c, s in seqs.items())
    path = str(tmp_path / ("a.fa.gz" if gz else "a.fa"))
    with (gzip.open if gz else open)(path, "wt") as f:
        f.write(text)
    got = files.fasta_chunks(spark, path, size).collect()
    assert {(r.contig, r.chunk): r.seq for r in got} == {(c, k): s[k * size : (k + 1) * size].upper() for c, s in seqs.items() for k in range(-(-len(s) // size))}
    assert {r.contig: r.length for r in files.contig_lengths(spark, path).collect()} == {c: len(s) for c, s in seqs.items() if s}
    assert {r.contig: r.seq for r in files.read_fasta(spark, path).collect()} == {c: s.upper() for c, s in seqs.items() if s}


def test_files_are_told_by_their_first_bytes(spark, tmp_path):
    text = "".join(f"@r{k} x\nACGT\n+\nIIII\n" for k in range(9000))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "packed.fastq").write_bytes(gzip.compress(text.encode()))
    (folder / "plain.fastq.gz").write_text(text)
    (folder / "right.fastq.gz").write_bytes(gzip.compress(text.encode()))
    (folder / "right.fastq").write_text(text)
    assert sorted((p.rsplit("/")[-1], packed) for p, packed in files.misnamed(spark, str(folder))[1]) == [("packed.fastq", True), ("plain.fastq.gz", False)]
    got = files.read_fastq(spark, str(folder)).groupBy("file").agg(F.count("*").alias("n"), F.max("record").alias("m"), F.min("seq").alias("s")).collect()
    assert [(r.n, r.m, r.s) for r in got] == [(9000, 8999, "ACGT")] * 4
    assert files.read_fastq(spark, str(folder / "packed.fastq")).count() == 9000


def test_sheet_errors(spark, tmp_path):
    (tmp_path / "sheet.txt").write_text("a b\tACGTACGTACGTACGT\t GGGGGGGGGGGGGGGG\n")
    r = setup.read_sheet(spark, str(tmp_path / "sheet.txt"), lengths=(6, 5), barcode=5, masks=(9, 0), single=True).first()
    assert (r.nm, r.ltr, r.ltr_barcode, r.linker, r.linker_barcode, r.index1, r.r1, r.r2) == ("ab", "GTACGT", "NNNNN", "GGGGG", "GGGGG", None, "demux/ab_Rltr.fq.gz", None)
    with pytest.raises(Exception, match="shorter than 30"):
        setup.read_sheet(spark, str(tmp_path / "sheet.txt")).collect()
    with pytest.raises(ValueError):
        setup.read_sheet(spark, str(tmp_path / "sheet.txt"), barcode=4)
    assert setup.vector(setup.read_sheet(spark, str(tmp_path / "sheet.txt"), lengths=(6, 5), barcode=0), "ltr") == "GTACGT"


def test_sam_tags_and_operations(spark):
    """Tags stand behind the eleven fields only; a line is split once for all columns, no regular expression goes over whole lines."""
    rows = [(1, "a\t0\tc\t5\t9\t3S20M\t=\t0\t50\tACGTAC\tNM:i:7\tXNM:i:1\tMD:Z:4\tNM:i:2\tXS:i:\tRX:Z:AC-GT"), (2, "b\t16\tc\t5\t9\t*\t=\t0\t50\tAC\t!I"), (3, "c\t4\tc\t5\t9\t5M\t=\t0\t50\tAC\t!I\tNM:i:1"),
            (4, "d\t0\tc\t5\t9\tM5M\t=\t0\t50\tAC\t!I\tNM:5\tAS:i:-3"), (5, "e\t0\tc\t5\t9\t10M2D1I4N6=1X2H\t=\t0\t50\tAC\t!I"), (6, "f\t0\tc\t5\t9\t5Q7M\t=\t0\t50\tAC\t!I"), (7, "@CO\tx"), (8, "g")]
    got = files.parse_sam(spark.createDataFrame(rows, "at long, value string"))
    r = {x.read_name: x for x in got.collect()}
    assert sorted(r) == ["a", "b", "d", "e", "f"] and [tuple(map(tuple, r[k].cigar)) for k in "abdef"] == [((4, 3), (0, 20)), (), ((0, 5),), ((0, 10), (2, 2), (1, 1), (3, 4), (7, 6), (8, 1), (5, 2)), ((0, 7),)]
    assert (r["a"].nm, r["a"].md, r["a"].second, r["a"].ltr_umi, r["a"].linker_umi, r["a"].score) == (2, "4", None, "AC", "GT", None) and (r["d"].nm, r["d"].score, r["d"].ltr_umi) == (None, -3, "N")
    assert [r[k].end - r[k].start for k in "abdef"] == [20, 0, 5, 23, 7] and r["b"].quals == [0, 40]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 2 and "regexp_extract(value" not in plan


def test_quality_letters(spark):
    """The letters are those of the view's qualities, whatever the size and the key."""
    k, size = F.col("k"), F.col("size")
    rows = spark.createDataFrame([(k, n) for k in (0, 1, 29, 30, 123456, -5) for n in (1, 30, 89, 90, 91, 130)], "k long, size int")
    letters = F.array_join(F.transform(adapters._quals(k, size), lambda q: F.char(q + 33)), "")
    assert rows.where(adapters.quality_letters(k, size).eqNullSafe(letters)).count() == 36
