"""Whole runs: alignments of one sample, or of many samples with options of their own, to site tables and their files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, functions as F

from siteloom.operators import abundance, annotate, dedup, finalpass, mispriming, peaks, qc, reassign, similarity, sites
from siteloom.plans.params import Params
from siteloom.session import checkpointed
from siteloom.sources import files


@dataclass
class Result:
    """Tables of a run; None for what it doesn't make. With no_dedup there are only fragments."""

    fragments: DataFrame
    sites: DataFrame | None = None
    counts: DataFrame | None = None
    diversity: DataFrame | None = None
    removed: DataFrame | None = None
    duplicates: DataFrame | None = None
    statistics: DataFrame | None = None
    misprimed: DataFrame | None = None
    peaks: DataFrame | None = None
    abundance: DataFrame | None = None
    overlaps: DataFrame | None = None
    nearest: DataFrame | None = None


def aligned_fragments(alignments: DataFrame, p: Params) -> DataFrame:
    """Alignments that pass the quality filter, as fragments."""
    limits = qc.Limits(p.aln_mismatch_rate, p.aln_indel_rate, p.max_frag_len, p.min_frag_len, p.min_mapq, p.no_mm, p.min_qual, p.match_after, p.single_end, p.long_read)
    if p.long_read or p.single_end:
        first = qc.long_reads(alignments) if p.long_read else qc.first_records(alignments)
        return qc.single_fragments(qc.qc(first.where(~F.col("ref").isin(p.remove_chr)) if p.remove_chr else first, limits))
    return qc.fragments(qc.qc(qc.proper_pairs(alignments, p.remove_chr), limits))


def annotated_units(counts: DataFrame, placed: DataFrame, found: DataFrame | None, theta: DataFrame | None) -> DataFrame:
    """What is compared with annotations, with site_id and weight: peaks if there are some asked for, else sites weighted by
    their estimated abundance, else one row for each fragment."""
    if found is not None:
        units = found.select("chrom", F.col("start").alias("site_start"), F.col("end").alias("site_end"), F.lit(1.0).alias("weight"))
    elif theta is not None:
        units = counts.join(theta.select("chrom", "site_start", "site_strand", "theta"), ["chrom", "site_start", "site_strand"]).select("chrom", "site_start", "site_end", F.col("theta").alias("weight"))
    else:
        units = placed.select("chrom", "site_start", "site_end", F.lit(1.0).alias("weight"))
    return checkpointed(units.withColumn("site_id", F.monotonically_increasing_id()))


def run(alignments: DataFrame, p: Params, genome: DataFrame | None = None, features: DataFrame | None = None) -> Result:
    """All stages after alignment, of one sample. Empty inputs give empty tables.

    genome: (contig, seq), or (contig, chunk, seq) as files.fasta_chunks gives it, for check_mispriming. features: (chrom, start, end, name), to annotate what was found.
    """
    if p.no_dedup:
        return Result(fragments=files.unfiltered_fragments(alignments))
    frags = checkpointed(aligned_fragments(alignments, p).withColumn("mapping_class", F.when(F.col("multi"), "multi").otherwise("unique")))
    unique, multi = qc.split(frags)
    exact = checkpointed(dedup.unique_exact(unique))
    unique_kept, dup1 = dedup.unique_fuzzy(exact, p.len_diff, p.frag_ratio)
    unique_kept = checkpointed(unique_kept)
    multi_kept, dup2 = similarity.multi_dedup(checkpointed(dedup.multi_exact(multi)), p.seq_sim, p.token_size, p.minimizer_win, p.num_perm, p.len_diff, p.frag_ratio, p.hash_similarity, p.b_bits)
    multi_kept = checkpointed(multi_kept)
    if p.reassign_mm:
        multi_kept = reassign.reassign(multi_kept, unique_kept, seq_sim=p.seq_sim, k=p.mm_k, min_frag_len=p.min_frag_len, token=p.token_size, group_share=p.mm_group_threshold, hash_sim=p.hash_similarity, diff=p.um_reassign_diff, fold=p.um_reassign_fc)
    kept = unique_kept.unionByName(multi_kept.select(*unique_kept.columns))
    bad = None
    if p.check_mispriming:
        placed = sites.project_sites(kept, p.tsd, p.U3)
        good, bad = mispriming.split_misprimed(placed, genome if "chunk" in genome.columns else mispriming.genome_chunks(genome), p.ltr_primer, p.misprime_win)
        kept = good.select(*kept.columns)
    final, removed = finalpass.final_pass(checkpointed(kept), p.cluster_win, p.min_count, p.abundant_fc, p.umi_dedup_fp, p.low_confidence_fc)
    final = checkpointed(final)
    placed = sites.project_sites(final, p.tsd, p.U3)
    counts = checkpointed(sites.site_counts(placed))
    found = peaks.named(peaks.peaks(peaks.peak_sites(counts, p.stranded_peaks, p.peak_alpha), p.peak_win, p.stranded_peaks)) if p.write_peaks else None
    theta = checkpointed(abundance.abundance(placed)) if p.mle else None
    units = annotated_units(counts, placed, found, theta) if features is not None else None
    return Result(
        fragments=final, sites=sites.ordered(placed), counts=sites.ordered(counts), diversity=sites.diversity(counts), removed=sites.project_sites(removed, p.tsd, p.U3), duplicates=dup1.unionByName(dup2),
        statistics=sites.statistics({"aligned": frags, "unique": unique, "multi": multi, "kept": kept, "final": final}), misprimed=bad, peaks=found, abundance=theta,
        overlaps=annotate.overlaps(units, features) if units is not None else None, nearest=annotate.nearest(units, features) if units is not None else None,
    )


def run_samples(alignments: DataFrame, params: dict[str, Params], genome: DataFrame | None = None, features: DataFrame | None = None) -> Result:
    """run for each sample of a table with a column `sample`, each with its own options; all tables lead with `sample`.

    Samples are as few as a sequencing run has, and each is run by itself: nothing is merged or counted across samples. A
    sample of the table without options is an error; one with options but without rows gives nothing.
    """
    unknown = [r[0] for r in alignments.select("sample").distinct().collect() if r[0] not in params]
    if unknown:
        raise ValueError(f"samples without options: {unknown}")
    joined: dict[str, DataFrame] = {}
    for name, p in params.items():
        one = run(alignments.where(F.col("sample") == name).drop("sample"), p, genome, features)
        for f in fields(Result):
            if (df := getattr(one, f.name)) is not None:
                df = df.select(F.lit(name).alias("sample"), *df.columns)
                joined[f.name] = joined[f.name].unionByName(df, allowMissingColumns=True) if f.name in joined else df
    return Result(**joined)


_BED = ["chrom", "start", "end", "read_name", "count", "strand"]
_SITE = ["chrom", "site_start", "site_end", "read_name", "count", "site_strand"]


def write_result(result: Result, path: str, compare: bool = True) -> None:
    """The files of a run under `path`: fragments, sites, removed, peaks and comparisons, a folder for each table; rows of a
    run of many samples lead with their sample. compare: whether tables of annotations are written."""
    lead = ["sample"] if "sample" in result.fragments.columns else []

    def bed(df: DataFrame | None, where: str, columns: list[str], header: bool = False) -> None:
        if df is not None:
            files.write_bed(df, f"{path}/{where}", [*lead, *columns], header)

    if result.sites is None:  # alignments as they are
        bed(result.fragments, "alignments/fragments", ["chrom", "start", "end", "read_name", "map_qual", "strand"])
        return
    summary = lambda df: sites.summary(df).columns
    bed(result.fragments, "fragments/fragments", _BED)
    bed(result.sites, "sites/sites", _SITE)
    bed(result.sites, "sites/summary", [c for c in summary(result.sites) if c in result.sites.columns], True)
    bed(result.counts, "sites/unique_sites", ["chrom", "site_start", "site_end", "fragments", "site_strand"])
    bed(result.abundance, "sites/abundance", ["chrom", "site_start", "site_strand", "fragments", "theta"], True)
    bed(result.diversity, "sites/diversity", ["sites", "shannon", "pielou", "simpson"], True)
    bed(result.statistics, "sites/statistics", ["stage", "rows", "reads", "percent"], True)
    bed(result.removed, "removed/final_pass", [c for c in summary(result.removed) if c in result.removed.columns], True)
    files.write_duplicates(result.duplicates, f"{path}/removed/duplicates")
    if result.misprimed is not None:
        files.write_text(mispriming.misprimed_fasta(result.misprimed), f"{path}/removed/misprimed")
    bed(result.peaks, "peaks/peaks", ["chrom", "start", "end", "name", "count", "n_sites", "strand", "apex"])
    if compare:
        bed(result.overlaps, "comparisons/overlaps", ["chrom", "site_start", "site_end", "weight", "n_overlaps"], True)
        bed(result.nearest, "comparisons/nearest", ["chrom", "site_start", "site_end", "weight", "feature", "distance"], True)
