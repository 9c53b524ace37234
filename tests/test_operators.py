import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.functions import align, sequences
from siteloom.operators import abundance, annotate, consensus, crop, dedup, demux, finalpass, mispriming, peaks, qc, reassign, similarity, sites
from siteloom.operators.graph import connected_components
from siteloom.plans import adapters

FRAG = "read_name string, chrom string, strand string, start long, end long, count long, ltr_umi string, linker_umi string, map_qual int, mean_qual double"


def frags(spark, rows):
    return spark.createDataFrame(rows, FRAG)


def frag(name, start=100, end=200, count=1, umi="AAAA", linker="CCCC", mq=30, q=30.0, chrom="chr1", strand="+"):
    return (name, chrom, strand, start, end, count, umi, linker, mq, q)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_exact(spark):
    got = dedup.unique_exact(frags(spark, [frag("a", q=20.0, count=1), frag("b", q=35.0, count=2), frag("c", start=101), frag("d", umi="TTTT")])).orderBy("read_name").collect()
    assert [(r.read_name, r["count"]) for r in got] == [("b", 3), ("c", 1), ("d", 1)]
    assert dedup.unique_exact(frags(spark, [])).count() == 0


def test_tolerance(spark):
    got = dedup.tolerance_groups(frags(spark, [frag("a", 100, 200), frag("b", 101, 201), frag("c", 150, 250), frag("d", 500, 600)]), 5).collect()
    g = {r.read_name: r.group for r in got}
    assert g["a"] == g["b"] and len(set(g.values())) == 3


def test_umi_chain_and_fuzzy(spark):
    rows = [frag("r1", count=11, umi="AAAA"), frag("r2", count=5, umi="AAAT"), frag("r3", count=2, umi="AATT"), frag("r4", count=1, umi="GGGG")]
    kept, dup = dedup.unique_fuzzy(frags(spark, rows), 5, 2)
    assert {r.read_name: r["count"] for r in kept.collect()} == {"r1": 18, "r4": 1}
    assert {(r.kept, r.duplicate) for r in dup.collect()} == {("r1", "r2"), ("r1", "r3")}


def test_owner_is_greedy_claim(spark):
    rng = random.Random(5)
    rows = [frag(f"r{k:03}", count=rng.randint(1, 30), umi="".join(rng.choice("AC") for _ in range(5)), linker="N") for k in range(60)]
    counts, rep = {}, {}
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        counts[r[6] + "N"] = counts.get(r[6] + "N", 0) + r[5]
        rep.setdefault(r[6] + "N", r[0])
    owner, near = {}, lambda a, b: sum(x != y for x, y in zip(a, b)) == 1
    for u in sorted(counts, key=lambda u: (-counts[u], rep[u])):
        todo = [] if u in owner else [u]
        while todo:
            v = todo.pop()
            owner[v] = u
            todo += [w for w in counts if w not in owner and w not in todo and near(v, w) and counts[v] >= 2 * counts[w] - 1]
    df = frags(spark, rows).withColumn("group", F.lit(1))
    got = {r.ltr_umi + "N": r.umi_owner for r in dedup.umi_clusters(df, ["group"], 2).collect()}
    assert got == owner


def test_collapse_positions(spark):
    counts = [(100, 80, 80), (102, 5, 5), (105, 3, 3), (150, 75, 75), (153, 4, 4), (200, 2, 2), (201, 1, 1)]
    df = spark.createDataFrame([("c", "+", *r) for r in counts], "chrom string, strand string, pos long, fragments long, total long")
    got = {r.pos: r.target for r in finalpass.snap_targets(df, ["chrom", "strand"], 5, 10, 2).collect()}
    assert got == {100: 100, 102: 100, 105: 100, 150: 150, 153: 150}
    tie = spark.createDataFrame([("c", "+", 100, 5, 5), ("c", "+", 102, 4, 4)], df.schema)
    assert {r.target for r in finalpass.snap_targets(tie, ["chrom", "strand"], 5).collect()} == {102}
    assert {r.pos: r.target for r in finalpass.snap_targets(tie, ["chrom", "strand"], 5, keep_distinct=True).collect()} == {100: 100, 102: 102}


def test_final_pass(spark):
    rows = [frag(f"a{k}", 100, 200 + k, count=15, umi=f"{k:04}") for k in range(5)] + [frag("b", 102, 204, umi="0004")]
    kept, removed = finalpass.final_pass(frags(spark, rows))
    assert {r.read_name: (r.start, r["count"]) for r in kept.collect()}["a4"] == (100, 16)
    assert [r.read_name for r in removed.collect()] == ["b"]
    conflict = [frag("x", 10, 90, count=5), frag("y", 50, 120, count=2)]
    assert [r.read_name for r in finalpass.umi_conflicts(frags(spark, conflict)).collect()] == ["x"]
    low = [frag(f"l{k}", k * 10, 999, count=1000) for k in range(3)] + [frag("m", 500, 999, count=2)]
    assert finalpass.low_confidence(frags(spark, low)).count() == 3


def test_sites(spark):
    df = frags(spark, [frag("a", 10, 60), frag("b", 10, 60, strand="-")])
    at = {r.read_name: (r.site_start, r.site_end, r.site_strand) for r in sites.project_sites(df, 5, True).collect()}
    assert at == {"a": (14, 15, "-"), "b": (55, 56, "+")}
    d = sites.diversity(spark.createDataFrame([(1,), (1,), (2,)], "fragments long")).first()
    assert d.simpson == pytest.approx(1 - (1 / 16 + 1 / 16 + 1 / 4)) and d.shannon == pytest.approx(-(0.5 * np.log(0.25) + 0.5 * np.log(0.5)))
    names = spark.createDataFrame([("chr10",), ("chr2",), ("chrX",), ("2a",)], "c string").orderBy(sequences.natural_key(F.col("c")))
    assert [r.c for r in names.collect()] == ["2a", "chr2", "chr10", "chrX"]
    stats = sites.statistics({"all": df, "one": df.limit(1)}).orderBy("stage").collect()
    assert [(r.rows, r.percent) for r in stats] == [(2, 100.0), (1, 50.0)]


def test_scalars(spark):
    r = spark.createDataFrame([("ACGTN", "TTTGACCA", "", "")], "s string, b string, x string, y string").select(
        sequences.revcomp(F.col("s")).alias("rc"), sequences.extract_umi(F.col("b"), 4, 2).alias("umi"), sequences.extract_umi(F.lit("AC"), 4).alias("short"), sequences.similarity(F.col("x"), F.col("y")).alias("sim"), sequences.hamming(F.lit("ACGT"), F.lit("AGGTA")).alias("h")
    ).first()
    assert (r.rc, r.umi, r.short, r.sim, r.h) == ("NACGT", "TGAC", "NNAC", 1.0, 1)
    assert sequences.umi_pattern("NNATN") == "[ATGC]{2}AT[ATGC]{1}"


def test_runs_of_rows_a_gap_apart(spark):
    """Rows exactly a gap apart are of two runs, ones a microsecond nearer of one."""
    from siteloom.streaming.dedup import gap_runs

    rows = [("a", 0.0), ("a", 3600.0), ("a", 7199.0), ("b", 0.0), ("b", 3599.999999), ("b", 0.0)]
    got = gap_runs(spark.createDataFrame(rows, "k string, t double").withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long"))), "ts", "3600 seconds", ["k"])
    of = lambda c: F.unix_micros(c)
    assert sorted(map(tuple, got.select("k", of("start"), of("end"), "n").collect())) == [("a", 0, 3_600_000_000, 1), ("a", 3_600_000_000, 10_799_000_000, 2), ("b", 0, 7_199_999_999, 3)]


def test_first_round_of_very_frequent_sites(spark):
    """The curvature of a site with very many fragments is below all doubles; its step goes to infinity, not to an error."""
    cells = [("s", "a", 1, "+", length, n) for length, n in ((30, 40_000), (31, 40_000))] + [("s", "b", 1, "+", 30, 2)]
    got = {r.chrom: r for r in abundance.first_round(spark.createDataFrame(cells, "sample string, chrom string, site_start long, site_strand string, length int, n long"), ["sample"]).collect()}
    assert got["a"].next == float("inf") and 0 < got["a"].grad < 1e5 and 0 < got["b"].next < 100


def test_minhash_groups_sign_a_sequence_once(spark):
    """120,000 rows of 40 sequences: signed row by row they take minutes."""
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=32)) for _ in range(40)]
    named = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k long, seq string")
    rows = spark.range(120_000).withColumn("k", F.col("id") % 41).join(F.broadcast(named), "k", "left").select("id", "seq").repartition(8)
    began = time.time()
    got = similarity.minhash_groups(rows, "id", "seq", 0.9).groupBy("component").count().collect()
    assert time.time() - began < 40
    assert sorted(map(tuple, got)) == [(k, len(range(k, 120_000, 41))) for k in range(40)]


def test_adapters_without_errors_are_looked_up():
    """The same as by the table of an alignment, which a doubtful letter in the adapter asks for, without making one for each of 200,000 reads."""
    rng = random.Random(8)
    adapter = "GTCATTGCACAGTC"
    reads = ["".join(rng.choices("ACGT", k=rng.randrange(1, 60))) + rng.choice(["", adapter, adapter[: rng.randrange(14)], adapter + "AC" + adapter]) + rng.choice(["", "", "ACCA"]) for _ in range(2000)]
    for options in ({}, {"leftmost": True}, {"three_prime": True, "min_overlap": 5, "leftmost": True}, {"three_prime": True}):
        got = align.find_adapter(reads, adapter, 0.0, **options)
        table = align.find_adapter([r.replace("G", "?") for r in reads], adapter.replace("G", "?"), 0.0, **options)
        assert (got == table).all() and (got[:, 0] >= 0).any()
    began = time.time()
    assert (align.find_adapter(reads * 100, adapter, 0.0)[:, 0] == 0).sum() == 100 * sum(adapter in r for r in reads)
    assert time.time() - began < 3


def test_proper_pairs_send_each_name_once(spark):
    """Distinct counts would send three rows for each row of a name."""
    rows = [("a", 1, "x", "+"), ("a", 2, "x", "-"), ("b", 1, "x", "+"), ("b", 2, "y", "-"), ("c", 1, "x", "+"), ("c", 2, "x", "+"), ("d", 1, None, "+"), ("d", 2, None, "-"), ("e", 1, "x", "+"), ("e", 1, "x", "-"), ("f", 1, "z", "+"), ("f", 2, "z", "-"), ("g", 1, "x", "-"), ("g", 2, None, "+")]
    got = qc.proper_pairs(spark.createDataFrame(rows, "read_name string, mate int, ref string, strand string"), ["z"])
    assert sorted(r.read_name for r in got.collect()) == ["a", "a", "g", "g"]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_annotation_of_many_rows_at_few_places(spark):
    """60,000 sites and 60,000 features of one bin: 3.6 billion pairs, if they met."""
    s = spark.range(60_000).select(F.col("id").alias("site_id"), F.lit("a").alias("chrom"), (F.col("id") % 300).alias("site_start"), (F.col("id") % 300 + 1).alias("site_end"))
    f = spark.range(60_000).select(F.lit("a").alias("chrom"), (F.col("id") % 200).alias("start"), (F.col("id") % 200 + 50).alias("end"), F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    began = time.time()
    over = annotate.overlaps(s, f).groupBy("site_start", "n_overlaps").count().collect()
    near = annotate.nearest(s, f).groupBy("site_start", "distance", "feature").count().collect()
    assert time.time() - began < 60
    assert sorted((r[0], r[1]) for r in over) == [(p, 300 * sum(x <= p < x + 50 for x in range(200))) for p in range(300)] and {r[2] for r in over} == {200}
    first = lambda p: (0, max(0, p - 49)) if p < 249 else (p - 249 + 1, 199)
    assert sorted((r[0], r[1], r[2]) for r in near) == [(p, first(p)[0], f"f{first(p)[1]:09d}") for p in range(300)] and {r[3] for r in near} == {200}


def test_annotation_of_empty_and_turned_intervals(spark):
    rng = random.Random(4)
    s = [(k, rng.choice(["a", "b", None]), p, p + rng.choice([-5, -1, 0, 0, 1, 7])) for k in range(300) for p in [rng.randrange(-20, 60)]]
    f = [(rng.choice(["a", "b", None]), p, p + rng.choice([-6, -1, 0, 0, 1, 2, 40]), f"f{k}") for k in range(80) for p in [rng.randrange(-20, 60)]]
    sd, fd = spark.createDataFrame(s, "site_id long, chrom string, site_start long, site_end long"), spark.createDataFrame(f, "chrom string, start long, end long, name string")
    over = {r.site_id: r.n_overlaps for r in annotate.overlaps(sd, fd, 16).collect()}
    near = {r.site_id: (r.distance, r.feature) for r in annotate.nearest(sd, fd, 16).collect()}
    for k, c, a, b in s:
        own = [(x, y, n) for d, x, y, n in f if c is not None and d == c]
        met = [o for o in own if a < o[1] and o[0] < b]
        assert over[k] == len(met)
        assert near[k] == (None, None) if not own else near[k] == (0, min(met)[2]) if met else near[k][1] is not None


def test_annotation_by_brute_force(spark):
    rng = random.Random(9)
    s = [(k, rng.choice("ab"), p, p + 1) for k in range(200) for p in [rng.randrange(60000)]]
    f = [(rng.choice("ab"), p, p + rng.randrange(1, 3000), f"f{k}") for k in range(60) for p in [rng.randrange(60000)]]
    sd, fd = spark.createDataFrame(s, "site_id long, chrom string, site_start long, site_end long"), spark.createDataFrame(f, "chrom string, start long, end long, name string")
    over = {r.site_id: r.n_overlaps for r in annotate.overlaps(sd, fd, 1024).collect()}
    near = {r.site_id: (r.distance, r.feature) for r in annotate.nearest(sd, fd, 1024).collect()}
    for k, c, a, b in s:
        own = [(0 if a < y and x < b else a - y + 1 if y <= a else x - b + 1, x, y, n) for d, x, y, n in f if d == c]
        assert over[k] == sum(o[0] == 0 for o in own)
        assert near[k] == (min(own)[0], min(own)[3])
    assert annotate.overlap_share(annotate.overlaps(sd, fd.limit(0))).first().share == 0


def test_peaks(spark):
    rows = [("c", p, p + 1, s, n) for p, s, n in ((100, "+", 5), (110, "-", 6), (120, "+", 3), (121, "-", 2), (400, "+", 1))]
    got = peaks.peaks(peaks.peak_sites(spark.createDataFrame(rows, "chrom string, site_start long, site_end long, site_strand string, fragments long"), alpha=0.0)).collect()
    assert [(r.start, r.end, r["count"], r.n_sites, r.apex) for r in got] == [(100, 123, 16, 4, 111)]


def test_demux(spark):
    codes = spark.createDataFrame([("s1", "ACGTACGTAC", 0), ("s2", "ACGTACGTAA", 1)], "sample string, barcode string, ord int")
    reads = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "acgtacgtaa"), ("c", "TTTTTTTTTT"), ("d", None)], "read_name string, i string")
    got = {r.read_name: r.sample for r in demux.index_demux(reads, F.col("i"), codes, error_rate=0.1).collect()}
    assert got == {"a": "s1", "b": "s1", "c": None, "d": None}  # the first match wins
    h = spark.createDataFrame([("x 1:N:0:ACG+TTT",), ("x",)], "h string").select(*[c.alias(n) for c, n in zip(demux.header_index(F.col("h")), "ab")]).collect()
    assert [tuple(r) for r in h] == [("ACG", "TTT"), (None, None)]
    pairs = spark.createDataFrame([("a", "ACGTACGTACGG", "ACGTACGTACTT"), ("b", "ACGTACGTACGG", "GGGGGGGGGGGG")], "read_name string, seq1 string, seq2 string")
    assert [r.sample for r in demux.inline_demux(pairs, codes, codes, 0.0).collect()] == ["s1"]
    assert sorted(r.sample for r in demux.inline_demux(pairs, None, codes, 0.0).collect()) == ["s1", "unknown"]
    with pytest.raises(ValueError):
        demux.check_barcodes(codes.withColumn("sample", F.lit("a-b")))


def test_adapter_and_crop(spark):
    assert align.find_adapter(["TTACGTACGTGG", "TTACGTCGTGG", "TTTTTTTT"], "ACGTACGT", 0.2).tolist() == [[0, 2, 10], [1, 2, 9], [-1, -1, -1]]
    assert align.find_adapter(["GGGGACGTA"], "ACGTACGT", 0.0, three_prime=True, min_overlap=5).tolist() == [[0, 4, 9]]
    assert crop.ladder("ACGTACGTACGTACGTACGT", 14, 0.1) == ["ACGTACGTACGTACGTACGT", "ACGTACGTACGTACGTAC", "ACGTACGTACGTACGTA", "ACGTACGTACGTACGT", "ACGTACGTACGTACG", "ACGTACGTACGTAC"]
    ltr, linker, body = "TGTGGAAAATCT", "CAGTCAGGATCA", "GATTACAGATTACAGATTACAGATTACAGAT"
    rows = [("a", "CCA" + ltr + body + sequences.revcomp_text(linker), "I" * 58, linker + sequences.revcomp_text(body), "I" * 43), ("b", body, "I" * 31, body, "I" * 31)]
    got = crop.crop(spark.createDataFrame(rows, "read_name string, seq1 string, qual1 string, seq2 string, qual2 string"), ltr, linker, ltr_umi=(3, 0, None)).collect()
    assert [(r.read_name, r.seq1, r.seq2, r.ltr_umi, r.linker_umi, len(r.qual1)) for r in got] == [("a", body, sequences.revcomp_text(body), "CCA", "N", 31)]
    with pytest.raises(ValueError):
        crop.check_input({"ltr": "ACGTN"})


def test_similarity(spark):
    rng = random.Random(1234)
    rows = []
    for fam in range(8):
        base = "".join(rng.choice("ACGT") for _ in range(60))
        for k in range(4):
            s = list(base)
            for _ in range(k):
                s[rng.randrange(60)] = rng.choice("ACGT")
            rows.append((f"r{fam}_{k}", fam, "".join(s), None, 1 + k))
    df = spark.createDataFrame(rows, "read_name string, fam int, seq1 string, seq2 string, count long").withColumns({"ltr_umi": F.lit("N"), "linker_umi": F.lit("N"), "map_qual": F.lit(1), "mean_qual": F.lit(30.0)})
    got = similarity.sequence_groups(df.withColumn("g", F.lit(0)), ["g"], "seq1", 0.9, 2).collect()
    assert len({r.seq_group for r in got}) == 8 and all(len({r.seq_group for r in got if r.fam == f}) == 1 for f in range(8))
    kept, _ = similarity.multi_dedup(df, 0.9, hash_sim=0.5)
    assert sorted(r["count"] for r in kept.collect()) == [10] * 8
    few = similarity.minimizers(df, "seq1", 8, 100).select(F.size("tokens").alias("n")).first()
    assert few.n == 53
    r = spark.createDataFrame([("ACGTACGTAC", "ACGTACGTAC")], "a string, b string").select(similarity.kmer_cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert r.c == pytest.approx(1.0)


def test_reassign(spark):
    body = "ACGTTGCATTACGGATCCAGTTACG"
    unique = spark.createDataFrame([(f"u{k}", "chr2", "-", 100, 188, body + "TTTT") for k in range(3)], "read_name string, chrom string, strand string, start long, end long, seq1 string")
    rows = [("m1", "chr9", "+", 0, 20, body[:20], 1), *[(f"g{k}", f"chr{3 + k % 2}", "+", 7, 32, body[::-1], 5) for k in range(4)]]
    multi = spark.createDataFrame(rows, "read_name string, chrom string, strand string, start long, end long, seq1 string, count long")
    got = {r.read_name: r for r in reassign.reassign(multi, unique, k=15, num_perm=16).collect()}
    assert (got["m1"].chrom, got["m1"].start, got["m1"].end, got["m1"].mapping_class) == ("chr2", 168, 188, "multi_relocated")
    assert len({got[f"g{k}"].chrom for k in range(4)}) == 1 and got["g0"].mapping_class == "multi_grouped" and len(got) == 5


def test_qc(spark):
    cig = "array<struct<op:int,len:int>>"
    good = ("r", 1, "c", 10, 60, "+", 30, [(0, 50)], "50", 0, 0, 100, None, "ACGTA" * 10, [40] * 50, 120)
    change = [("ok", {}), ("clip", {7: [(4, 2), (0, 48)]}), ("beaten", {12: 101}), ("mapq", {6: 1}), ("multi", {6: 1, 12: 100}), ("early", {8: "0A0C0G47"}), ("edits", {9: 40}), ("qual", {14: [2] * 50}), ("long", {15: 9999})]
    rows = [(name, *[c.get(k, v) for k, v in enumerate(good)][1:], "N", "N", "x", "y") for name, c in change]
    df = spark.createDataFrame(rows, f"read_name string, mate int, ref string, start long, end long, strand string, mapq int, cigar {cig}, md string, nm int, xm int, score int, second int, seq string, quals array<int>, tlen int, ltr_umi string, linker_umi string, ltr_match string, linker_match string")
    assert {r.read_name: r.multi for r in qc.qc(df).collect()} == {"ok": False, "multi": True}
    both = df.where("read_name = 'ok'").unionByName(df.where("read_name = 'ok'").withColumns({"mate": F.lit(2), "strand": F.lit("-"), "start": F.lit(100).cast("long"), "end": F.lit(150).cast("long")}))
    f = qc.fragments(qc.qc(qc.proper_pairs(both))).first()
    assert (f.start, f.end, f.strand, f.map_qual, round(f.mean_qual)) == (10, 150, "+", 30, 40)


def plain_local_alignment(a: str, b: str, match: int = 5, mismatch: int = -4, gap_open: int = 10, gap_extend: int = 2) -> tuple[int, list[tuple[int, int]]]:
    """(score, aligned pairs of positions) of the best local alignment with affine gaps."""
    n, m = len(a), len(b)
    low = -(10**9)
    h, e, f = ([[0 if k == 0 else low] * 1 + [0 if k == 0 else low] * m for _ in range(n + 1)] for k in range(3))
    best, at = 0, (0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(e[i][j - 1] - gap_extend, h[i][j - 1] - gap_open)
            f[i][j] = max(f[i - 1][j] - gap_extend, h[i - 1][j] - gap_open)
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), e[i][j], f[i][j])
            if h[i][j] > best:
                best, at = h[i][j], (i, j)
    pairs, (i, j), state = [], at, "h"
    while i and j and (state != "h" or h[i][j] > 0):
        if state == "h":
            if h[i][j] == h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            else:
                state = "e" if h[i][j] == e[i][j] else "f"
        elif state == "e":
            state = "h" if e[i][j] == h[i][j - 1] - gap_open else "e"
            j -= 1
        else:
            state = "h" if f[i][j] == h[i - 1][j] - gap_open else "f"
            i -= 1
    return best, pairs[::-1]


def test_local_alignments_as_one_by_one():
    rng = random.Random(9)
    primer = "ACGTTGCAAGGCTTACCGAT"
    seqs = ["", "A", primer] + [mutated(rng, "".join(rng.choice("ACGT") for _ in range(8)) + primer, rng.randint(0, 9)) for _ in range(300)] + ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    score, same, inserted = align.local_alignments(primer, seqs)
    for k, s in enumerate(seqs):
        best, pairs = plain_local_alignment(primer, s)
        gaps = {q: y[1] - x[1] - 1 for x, y in zip(pairs, pairs[1:]) if y[1] - x[1] > 1 for q in [y[0]]}
        assert best == score[k] and {i for i, j in pairs if primer[i] == s[j]} == set(np.flatnonzero(same[k]))
        assert inserted[k].sum() == sum(gaps.values())


def test_mispriming(spark):
    primer = "ACGTTGCAAGGCTTACCGAT"
    seqs = ["GGGG" + primer + "TTTT", "GG" + sequences.revcomp_text(primer), "GATTACAGATTACAGATTACAGATTACAGAT", ""]
    assert mispriming.are_misprimed(seqs, primer).tolist() == [True, True, False, False]
    assert mispriming.are_misprimed([primer[:16] + "AA" + primer[16:] * 2], primer).tolist() == [False]  # two bases too many within the seed
    contigs = spark.createDataFrame([("c", "T" * 60 + primer + "G" * 60)], "contig string, seq string")
    placed = spark.createDataFrame([("bad", "c", 80, 81, "+"), ("good", "c", 5, 6, "-"), ("none", "z", 5, 6, "+")], "read_name string, chrom string, site_start long, site_end long, site_strand string")
    kept, bad = mispriming.split_misprimed(placed, mispriming.genome_chunks(contigs), primer)
    assert sorted(r.read_name for r in kept.collect()) == ["good", "none"] and [r.read_name for r in bad.collect()] == ["bad"]


def test_abundance_and_consensus(spark):
    rng = np.random.default_rng(2)
    phi = np.exp(-np.arange(60) / 25)
    phi /= phi.sum()
    true = np.array([2.0, 15.0, 60.0, 120.0])
    x = rng.random((60, 4)) < 1 - np.exp(-phi[:, None] * true)
    row, site = np.nonzero(x[x.any(1)])
    sample = abundance.Held(row, site, np.ones(len(row)))
    abundance.maximise(sample)
    assert np.all(np.diff(sample.theta) > 0) and sample.theta[3] > x[:, 3].sum()
    reads = spark.createDataFrame([(f"r{k}", "ACGTAC" + "ACGT"[k % 4] * 3) for k in range(40)], "read_name string, seq1 string")
    got = consensus.positional_consensus(reads, "seq1", 9).collect()
    assert "".join(r.called for r in got) == "ACGTACNNN"
    assert consensus.change_points([1.0] * 10 + [0.2] * 10, 0.5) == [10, 20]
    assert consensus.reliable("A" * 20, [1.0] * 10 + [0.2] * 10, 0.5) == "A" * 10 + "N" * 10
    shares = {r.matched: r.share for r in consensus.variant_shares(reads, "ACGTACGGG", error_rate=0.0).collect()}
    assert shares == {"ACGTACGGG": 1.0}


def whole_matrix_abundance(x, most=2000):
    """The rules of abundance.maximise on the whole matrix of lengths by sites."""
    norm = lambda v: np.maximum(v, np.finfo(float).eps) / np.maximum(v, np.finfo(float).eps).sum()

    def e_step(theta, phi):
        rate = np.outer(phi, theta)
        y = x * rate / np.maximum(1 - np.exp(-rate), np.finfo(float).eps)
        return y, -rate[x == 0].sum() + np.log(1 - np.exp(-rate[x == 1])).sum()

    theta, _ = x.sum(0).astype(float), None
    y, _ = e_step(theta, norm(x.sum(1)))
    theta, phi, best = y.sum(0), norm(abundance.smooth(y.sum(1))[0]), -np.inf
    for k in range(1, most + 1):
        rate = np.outer(phi, theta)
        odds = 1 / np.expm1(rate)
        grad = (-(1 - x) * phi[:, None] + x * phi[:, None] * odds).sum(0)
        new = np.maximum(theta + grad / (phi[:, None] ** 2 * odds).sum(0), np.finfo(float).eps)
        y, likely = e_step(new, phi)
        failed = int(not likely > best)
        if not failed:
            theta, best = new, likely
        y, _ = e_step(theta, phi)
        other = norm(abundance.smooth(y.sum(1))[0])
        likely = e_step(theta, other)[1]
        if likely > best:
            phi, best = other, likely
        else:
            failed += 1
        if failed == 2 or (k >= 3 and np.abs(grad).max() <= 0.01 and np.abs(grad / theta).max() <= 1e-6):
            break
    return theta, phi


def seen_pairs(lengths, sites, more):
    rng = np.random.default_rng(lengths)
    x = (rng.random((lengths, sites)) < rng.random(sites) ** 2 + 0.02).astype(int)
    x[0, :], x[:, 0] = 1, 1  # each length and each site is seen
    return x * rng.choice([1, 2], x.shape, p=[1 - more, more])


def test_both_ends(spark):
    rows = [(f"r{k}", "ACGTACGTAC" + "GATTACA" * 3, "TTGGCCAATT" + "CCCCGGGGTTTTAAAA") for k in range(30)] + [(f"x{k}", "ACGTACGTAG" + "C" * 20, "TTGGCCAATT" + "G" * 20) for k in range(10)] + [("n", None, "AAAA")]
    reads = spark.createDataFrame(rows, "read_name string, seq1 string, seq2 string")
    got = {(r.end, r.kind, r.sequence): r.share for r in consensus.end_variants(reads, "ACGTACGTAC", "TTGGCCAATT", error_rate=0.1, threshold=0.3).collect()}
    assert got == {("integrant", "match", "ACGTACGTAC"): 0.75, ("integrant", "match", "Other"): 0.25, ("integrant", "adjoining", ("GATTACA" * 3)[:15]): 0.75, ("linker", "match", "TTGGCCAATT"): 1.0, ("linker", "match", "Other"): 0.0, ("linker", "adjoining", "CCCCGGGGTTTTAAA"): 0.75}
    long = reads.select("read_name", F.concat("seq1", F.lit(sequences.revcomp_text("TTGGCCAATT"))).alias("seq1"))
    got = {(r.end, r.kind, r.sequence): r.share for r in consensus.end_variants(long, "ACGTACGTAC", "TTGGCCAATT", long_read=True, error_rate=0.0, threshold=0.2).collect()}
    assert got["linker", "adjoining", ("GATTACA" * 3)[-15:]] == 0.75 and got["linker", "adjoining", "C" * 15] == 0.25 and got["linker", "match", "AATTGGCCAA"] == 1.0
    assert consensus.end_variants(reads, "GGGGGGGGGGGGGGGGGG", None, error_rate=0.0).collect() == []
    both = {r.end: (r.raw, r.estimated) for r in consensus.end_consensus(long, 10, long_read=True).collect()}
    assert both["integrant"][0] == "ACGTACGTAC" and both["linker"][0] == "TTGGCCAATT"
    assert [r.end for r in consensus.end_consensus(reads.select("read_name", "seq1"), 10).collect()] == ["integrant"]


@pytest.mark.parametrize("lengths,sites,more", [(1, 1, 0), (30, 7, 0), (120, 40, 0.1)])
def test_abundance_against_the_whole_matrix(lengths, sites, more):
    x = seen_pairs(lengths, sites, more)
    row, site = np.nonzero(x)
    sample = abundance.Held(row, site, x[row, site])
    phi, _, _ = abundance.maximise(sample, 60)
    theta, want = whole_matrix_abundance(x, 60)
    assert np.allclose(sample.theta, theta, rtol=1e-6) and np.allclose(phi, want, rtol=1e-6)


def test_abundance_over_many_tasks(spark, monkeypatch):
    x = seen_pairs(25, 12, 0.1)
    rows = [(f"chr{s % 3}", int(s), "+", 100, 130 + int(k), "a" if s < 9 else None) for k, s in zip(*np.nonzero(x)) for _ in range(x[k, s])]
    df = spark.createDataFrame(rows, "chrom string, site_start long, site_strand string, start long, end long, sample string").repartition(5)
    table = lambda: {(r.sample, r.site_start): (r.fragments, r.theta) for r in abundance.abundance(df, "sample", rounds=3).collect()}
    one = table()
    monkeypatch.setattr(abundance, "TOGETHER", 40)
    many = table()
    assert many.keys() == one.keys() and len(one) == 12 and all(many[k] == pytest.approx(one[k], rel=1e-6) for k in one)
    y = x[:, :9][x[:, :9].any(1)]
    row, site = np.nonzero(y)
    sample = abundance.Held(row, site, y[row, site])
    abundance.maximise(sample, 3)
    assert np.allclose([one["a", s][1] for s in range(9)], sample.theta, rtol=1e-6)
    assert abundance.abundance(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(10))
def test_smoothing_against_a_plain_fit(seed):
    """The same curve from another basis of the same splines, truncated powers, by plain Newton steps."""
    rng = np.random.default_rng(seed)
    n = [2, 3, 5, 9, 12, 18, 25, 40, 80, 200][seed]
    sums = rng.gamma(2, 20, n) * np.exp(-np.arange(n) / n)
    sums[rng.random(n) < 0.1] = 0
    sums[0] = 5
    y = np.concatenate([sums, np.zeros(abundance.PADDING)]) + 1e-10
    x = np.arange(len(y), dtype=float)
    knots, degree = abundance.splines(x, x[y > 1e-5])[0]
    u = x / x.max()
    b = np.linalg.qr(np.stack([u**d for d in range(degree + 1)] + [np.maximum(0, u - k / x.max()) ** degree for k in knots], 1))[0]
    beta = np.linalg.lstsq(b, np.log((y + y.mean()) / 2), rcond=None)[0]
    for _ in range(400):
        mu = np.exp(b @ beta)
        step = np.linalg.solve(b.T @ (mu[:, None] * b) + 1e-13 * np.eye(b.shape[1]), b.T @ (y - mu))
        loss = lambda v: (np.exp(b @ v) - y * (b @ v)).sum()
        while loss(beta + step) > loss(beta) + 1e-9:
            step /= 2
        beta = beta + step
    fit = np.maximum(np.exp(b @ beta), abundance.LEAST_FIT)[:n]
    assert np.allclose(abundance.smooth(sums)[0], fit / fit.sum(), rtol=1e-6, atol=1e-9)


def test_signature_groups_at_a_low_limit(spark):
    import random

    from siteloom.operators import similarity

    rng, rows = random.Random(12), []
    for k in range(150):  # half of the values equal, at the limit of long reads
        sig = [rng.getrandbits(32) for _ in range(128)]
        same = set(rng.sample(range(128), 64))
        rows += [(f"{k:03}a", sig), (f"{k:03}b", [v if i in same else rng.getrandbits(32) for i, v in enumerate(sig)])]
    got = {r[0]: r[1] for r in similarity.signature_groups(spark.createDataFrame(rows, "id string, sig array<long>"), "id", "sig", similarity.default_hash_similarity(0.95, 8)).collect()}
    assert sum(got[f"{k:03}a"] == got[f"{k:03}b"] for k in range(150)) >= 149
    assert [similarity.band_rows(h, 128) for h in (0.446, 0.637)] == [2, 3]


def test_choice_of_a_place_is_even_and_seeded_by_valid_ones():
    from siteloom.functions.sequences import choice_seed

    rows = [("chr1", 100, 130, "+", 50), ("chr2", 5, 60, "-", 45), ("chr3", 9, 40, "+", 1)]
    import random

    want = random.Random(choice_seed("chr1_100_+,chr2_60_-")).choices([("chr1", 100, 130, "+"), ("chr2", 5, 60, "-")], k=1)[0]
    assert reassign.choose_position(rows) == want == reassign.choose_position(rows[::-1])
    assert reassign.choose_position([]) is None and reassign.choose_position(rows[:1]) == ("chr1", 100, 130, "+")


def walked_leaders(members, seq_sim):
    out = {}
    for s in sorted(members, key=lambda s: (len(s), s), reverse=True):
        known = sorted({v for v in out.values()}, key=lambda c: (len(c), c))
        best = max(known, key=lambda c: align.similar(s, c[: len(s)]), default=None)
        out[s] = best if best is not None and align.similar(s, best[: len(s)]) >= seq_sim else s
    return out


def mutated(rng, s, n):
    for _ in range(n):
        k = rng.randrange(len(s))
        s = s[:k] + rng.choice(["", "A", "C", "GT"]) + s[k + rng.randint(0, 1) :]
    return s


@pytest.mark.parametrize("heads, tile, seq_sim", [(512, 4096, 0.8), (3, 5, 0.8), (2, 1000, 0.93)])
def test_similar_leaders_as_the_walk(spark, monkeypatch, heads, tile, seq_sim):
    from siteloom.operators import leaders

    monkeypatch.setattr(leaders, "HEADS", heads)
    monkeypatch.setattr(leaders, "TILE_ROWS", tile)
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(20, 40))) for _ in range(4)]
    members = {k: {mutated(rng, rng.choice(base), rng.randint(0, 6))[: rng.randint(15, 40)] for _ in range(n)} for k, n in (("a", 60), ("b", 7), ("c", 1))}
    seen = set()
    members = {k: {s for s in v if not (s in seen or seen.add(s))} for k, v in members.items()}
    df = spark.createDataFrame([(s, k) for k, v in members.items() for s in v], "seq string, cluster string")
    want = {s: x for v in members.values() for s, x in walked_leaders(v, seq_sim).items()}
    assert {r.seq: r.leader for r in leaders.similar_leaders(df, seq_sim).collect()} == want
    assert leaders.similar_leaders(df.limit(0), seq_sim).collect() == []


def test_leaders_of_equal_similarity():
    """The shortest, then smallest leader counts; the first ones are the longest, then largest."""
    from siteloom.operators import leaders

    assert walked_leaders(["AAAATTTT", "AAAACCCC", "AAAA"], 0.9) == {"AAAATTTT": "AAAATTTT", "AAAACCCC": "AAAACCCC", "AAAA": "AAAACCCC"}
    assert [x.tolist() for x in leaders.nearest_leaders(["AAAA", "TTTT"], ["AAAATTTT", "AAAACCCC"], 0.9)] == [[0, -1], [1, -1]]


def test_banded_leaders_as_the_walk(spark):
    from siteloom.operators import leaders

    rng = random.Random(8)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randint(4, 9))), [rng.randrange(4) for _ in range(6)]) for _ in range(250)]
    rows = list({s: v for s, v in rows}.items()) + [("A", []), ("C", [])]
    bands = lambda v: {(b, tuple(v[2 * b : 2 * b + 2])) for b in range(3)} if v else set()
    led, want = [], {}
    for s, v in sorted(rows, key=lambda x: (len(x[0]), x[0]), reverse=True):
        near = [(len(c), sum(x == y for x, y in zip(v, w)), c) for c, w in led if bands(v) & bands(w)]
        want[s] = max(near)[2] if near else s
        if not near:
            led.append((s, v))
    got = leaders.banded_leaders(spark.createDataFrame(rows, "seq string, sig array<bigint>"), 3, 2)
    assert {r.seq: r.leader for r in got.collect()} == want and len(led) > 5
    assert leaders.band_shape(0.5, 128)[0] * leaders.band_shape(0.5, 128)[1] <= 128


@pytest.mark.parametrize("most", [0, 1, 3, 8, 20])
def test_edits_within(most):
    rng = random.Random(most)
    a = ["".join(rng.choice("ACG") for _ in range(12)) for _ in range(200)]
    b = [(mutated(rng, s, rng.randint(0, 5)) + "GATTACAGATTACA")[:12] for s in a]
    code = lambda x: np.array([[ord(c) for c in s] for s in x], np.uint32)
    assert align.edits_within(code(a), code(b), most).tolist() == [min(align.levenshtein(x, y), min(most, 12) + 1) for x, y in zip(a, b)]


def test_deleted_bases_at_the_start(spark):
    al = spark.createDataFrame([(1, "0^GT0C30", "ACGT"), (1, "0A30", "ACGT"), (2, "0^GT0C30", "ACGT")], "mate int, md string, seq string").withColumn("cigar", F.expr("array(struct(0 as op, 30 as len))"))
    assert [r[0] for r in al.select(qc.tests(qc.Limits())["start_matches"]).collect()] == [False, True, True]


def test_long_reads_in_adapter_places():
    from siteloom.functions.align import find_adapter

    read = "C" * 150_000 + "ACGTACGTAC" + "C" * 5
    assert find_adapter([read], "ACGTACGTAC", 0.1).tolist() == [[0, 150_000, 150_010]]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.3, 1.0])
def test_barcodes_by_brute_force(spark, monkeypatch, rate):
    from siteloom import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 20)  # many codes are shuffled
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    codes = [(f"s{k}", w, k) for k, w in enumerate({word(rng.choice([5, 8, 11])) for _ in range(60)})]
    index = [word(rng.choice([5, 8, 11])) for _ in range(80)] + [w.lower() for _, w, _ in codes[:20]] + [w[:2] + "T" + w[3:] for _, w, _ in codes[20:50]] + [None, ""]
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= int(len(b) * rate + 1e-9)
    want = [next((s for s, w, _ in codes if i is not None and near(i.upper(), w)), None) for i in index]
    df = spark.createDataFrame(list(enumerate(index)), "k int, i string")
    got = demux.match(df, F.col("i"), spark.createDataFrame(codes, "sample string, barcode string, ord int"), rate)
    assert [r.sample for r in got.orderBy("k").collect()] == want


def test_anchored_barcodes_of_several_lengths(spark):
    codes = spark.createDataFrame([("long", "ACGTAC", 1), ("short", "ACG", 0), ("other", "TTTTTTTT", 2)], "sample string, barcode string, ord int")
    reads = spark.createDataFrame([("a", "ACGTACGG"), ("b", "TTTTTTTT"), ("c", "GG"), ("d", None)], "k string, seq1 string")
    assert [r.sample for r in demux.anchored(reads, "seq1", codes, 0.0, "sample").orderBy("k").collect()] == ["short", "other", None, None]
    with pytest.raises(ValueError, match="order"):
        demux.check_same_ids(codes, codes.withColumn("ord", -F.col("ord")))
    demux.check_same_ids(codes, codes)


def test_umi_chain_beyond_a_hundred_steps(spark):
    """A chain of UMIs with one read each, each a neighbour of the next."""
    chain, umi = [], ["A"] * 120
    for k in range(121):
        chain.append("".join(umi))
        if k < 120:
            umi[k] = "C"
    nodes = spark.createDataFrame([(1, u, 2 if k == 0 else 1, f"r{k:03d}") for k, u in enumerate(chain)], "g int, umi string, n long, rep string")
    assert {r.owner for r in dedup.umi_owners(nodes, ["g"], 2.0).collect()} == {chain[0]}


@pytest.mark.parametrize("fold, seed", [(2.0, 1), (1.0, 2), (1.3, 3)])
def test_suppression_as_the_walk(spark, fold, seed):
    rng = random.Random(seed)
    rows = [(c, s, p, rng.choice([1, 2, 3, 5, 9, 30]), rng.randint(1, 200)) for c in ("chr1", "chr2") for s in "+-" for p in rng.sample(range(300), 150)]
    kept = []
    for c, s, p, n, t in sorted(rows, key=lambda r: (r[3], r[2]), reverse=True):
        near = [k for k in kept if k[:2] == (c, s) and abs(k[2] - p) <= 5]
        if not near or (max(k[3] for k in near) < fold * n and max(k[4] for k in near) < fold * t):
            kept.append((c, s, p, n, t))
    df = spark.createDataFrame(rows, "chrom string, strand string, pos long, fragments long, total long")
    got = finalpass.suppress(df, ["chrom", "strand"], 5, fold)
    assert sorted(map(tuple, got.collect())) == sorted(kept)
    assert finalpass.suppress(df.limit(0), ["chrom", "strand"], 5, fold).collect() == []


@pytest.mark.parametrize("block, top, limit", [(1024, 20, 0.5), (7, 3, 0.3), (5, None, 0.7)])
def test_cosine_neighbours_by_brute_force(spark, monkeypatch, block, top, limit):
    monkeypatch.setattr(similarity, "COSINE_BLOCK", block)
    rng = random.Random(block)
    base = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(3)]
    rows = [(mutated(rng, rng.choice(base), rng.randint(0, 12)), rng.choice("ab")) for _ in range(90)] + [("ACG", "a"), (None, "a")]
    count = lambda s: {t: sum(s[i : i + 4] == t for i in range(len(s) - 3)) for t in {s[i : i + 4] for i in range(len(s) - 3)}}
    dot = lambda x, y: sum(c * y.get(t, 0) for t, c in x.items())
    want = set()
    for key in "ab":
        seqs = {s: count(s) for s, k in rows if k == key and s and len(s) > 3}
        for s, x in seqs.items():
            near = sorted((-dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5, t) for t, y in seqs.items() if t != s)
            want |= {(key, s, t, round(-c, 9)) for c, t in [n for n in near if -n[0] >= limit][:top]}
    df = spark.createDataFrame(rows, "seq string, grp string")
    assert {(r.grp, r.s, r.t, round(r.cosine, 9)) for r in similarity.cosine_neighbours(df, ["grp"], "seq", limit, top).collect()} == want


def test_neighbour_groups_as_the_exact_ones(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(50)) for _ in range(6)]
    df = spark.createDataFrame([(mutated(rng, rng.choice(base), rng.randint(0, 4)), "k") for _ in range(120)], "seq string, grp string")
    groups = lambda f, **more: {(r.seq, r.seq_group) for r in f(df, ["grp"], "seq", 0.9, 5, **more).collect()}
    assert groups(similarity.neighbour_groups, limit=0.4, top=None) == groups(similarity.sequence_groups)


def test_qualities_of_the_views_are_looked_up(spark):
    """Also of keys and sizes that the rows of the table don't hold."""
    rows = [(k, n) for k in [*range(0, 2300, 7), 10**12 + 3, -5, None] for n in (1, 30, 61, 89, 90, 95, 130)]
    df = spark.createDataFrame(rows, "k long, n int").repartition(4)
    one = adapters._quals(F.col("k"), F.col("n"))
    old = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: ((i + F.col("k")) % (8 + F.col("k") % 30) + 3).cast("int"))
    assert df.where(~one.eqNullSafe(old)).count() == 0 and df.where(one.isNotNull()).count() == len(rows)


def test_matched_reads_are_not_shuffled(spark, monkeypatch):
    """Of index values, matched ones are few: reads get their sample by a broadcast, in one pass; where too many match for that, by a join, with the same result."""
    reads = spark.createDataFrame([(f"r{k}", s) for k, s in enumerate(["ACGTT", "ACGAT", "GGTTA", "nnnnn", "", None, "acgtc"])], "read_name string, seq1 string")
    codes = spark.createDataFrame([("s1", "ACGT", 0), ("s2", "GGTT", 1)], "sample string, barcode string, ord int")
    got = demux.match(reads, F.substring("seq1", 1, 4), codes, 0.25)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Aggregate" not in plan
    want = {"r0": "s1", "r1": "s1", "r2": "s2", "r3": None, "r4": None, "r5": None, "r6": "s1"}
    assert {r.read_name: r.sample for r in got.collect()} == want and got.columns == ["read_name", "seq1", "sample"]
    monkeypatch.setattr("siteloom.session.BROADCAST_ROWS", 0)
    assert {r.read_name: r.sample for r in demux.match(reads, F.substring("seq1", 1, 4), codes, 0.25).collect()} == want


def test_relocation_compares_each_sequence_once(spark):
    """Where a read goes depends on its sequence alone, whatever other rows have its name; sequences are compared once, in a table of distinct ones."""
    cols = "read_name string, chrom string, strand string, start long, end long, count long, seq1 string"
    unique = spark.createDataFrame([("u1", "chr2", "+", 100, 112, 1, "ACGTACGTACGT"), ("u2", "chr3", "-", 300, 312, 1, "TTTTACGTACGT")], cols)
    rows = [("x", "chr1", "+", 1, 13, 1, "ACGTACGTACGT"), ("x", "chr1", "+", 1, 13, 1, "GGGGACGTACGT"), ("y", "chr1", "+", 5, 17, 1, "ACGTACGTACGT"), ("z", "chr1", "+", 7, 19, 1, "TTTTACGTACGT"), ("n", "chr1", "+", 7, 19, 1, None)]
    got = reassign.relocate(spark.createDataFrame(rows, cols), reassign.prefix_index(unique, 4), 4, 0.95)
    assert "levenshtein" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [("n", None, "chr1", 7, 19, "multi"), ("x", "ACGTACGTACGT", "chr2", 100, 112, "multi_relocated"), ("x", "GGGGACGTACGT", "chr1", 1, 13, "multi"), ("y", "ACGTACGTACGT", "chr2", 100, 112, "multi_relocated"), ("z", "TTTTACGTACGT", "chr3", 300, 312, "multi_relocated")]
    assert sorted((r.read_name, r.seq1, r.chrom, r.start, r.end, r.mapping_class) for r in got.collect()) == want
