"""All options of a run, with defaults and the checks across them."""

from __future__ import annotations

from dataclasses import dataclass, field

from siteloom.operators.similarity import default_hash_similarity


@dataclass
class Params:
    # Fixed names and defaults.
    ltr: str | None = None
    linker: str | None = None
    ltr_error_rate: float = 0.1
    linker_error_rate: float = 0.1
    contam: list[str] = field(default_factory=list)
    ltr_primer: str | None = None
    U3: bool = False
    truncated_terminal_repeat: bool = False
    min_ttr_len: int = 10
    cap_ttr_error: bool = False
    leftmost: bool = False
    mixed: bool = False
    min_frag_len: int = 25
    max_frag_len: int = 2000
    aln_mismatch_rate: float = 0.1
    aln_indel_rate: float = 0.02
    min_mapq: int = 2
    match_after: int = 2
    tsd: int = 1
    ltr_umi_offset: int = 0
    ltr_umi_len: int = 0
    ltr_umi_pattern: str | None = None
    linker_umi_offset: int = 0
    linker_umi_len: int = 0
    linker_umi_pattern: str | None = None
    no_mm: bool = False
    min_qual: int = 10
    len_diff: int = 5
    cluster_win: int = 5
    frag_ratio: float = 2
    check_mispriming: bool = False
    misprime_win: int = 25
    num_perm: int = 128
    seq_sim: float = 0.95
    token_size: int = -1
    hash_similarity: float = -1
    b_bits: int = 32
    minimizer_win: int = -1
    min_count: int = 1
    abundant_fc: float = 2
    low_confidence_fc: float = 100
    reassign_mm: bool = False
    mm_k: int = 15
    mm_group_threshold: float = 0.002
    um_reassign_diff: float = 0.05
    um_reassign_fc: float = 2
    no_dedup: bool = False
    umi_dedup_fp: bool = False
    mle: bool = False
    long_read: bool = False
    write_peaks: bool = False
    stranded_peaks: bool = False
    peak_win: int = 25
    peak_alpha: float = 0.05
    remove_chr: list[str] = field(default_factory=list)
    single_end: bool = False

    def __post_init__(self):
        if self.token_size == -1:
            self.token_size = 8 if self.long_read else 4
        if self.minimizer_win == -1:
            self.minimizer_win = min(self.token_size * (2 if self.long_read else 1), self.min_frag_len - self.token_size + 1)
        if self.hash_similarity == -1:
            self.hash_similarity = default_hash_similarity(self.seq_sim, self.token_size)
        has_umi = self.ltr_umi_len or self.linker_umi_len
        if self.mle:
            if has_umi:
                raise ValueError("mle needs reads without UMIs")
            self.len_diff = 0
        for name in ("ltr_error_rate", "linker_error_rate"):
            if not 0 <= getattr(self, name) <= 0.4:
                raise ValueError(f"{name}: at most 0.4")
        for name in ("seq_sim", "hash_similarity"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name}: between 0 and 1")
        if not 0 <= self.um_reassign_diff <= 0.25:
            raise ValueError("um_reassign_diff: at most 0.25")
        if self.min_frag_len > self.max_frag_len or self.min_frag_len < self.token_size:
            raise ValueError("min_frag_len: between token_size and max_frag_len")
        if self.check_mispriming and not self.ltr_primer:
            raise ValueError("check_mispriming needs ltr_primer")
        if self.umi_dedup_fp and not has_umi:
            raise ValueError("umi_dedup_fp needs UMIs")
        for name in ("len_diff", "cluster_win", "min_count", "peak_win", "tsd"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name}: not negative")
