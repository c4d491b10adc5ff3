"""Parameters of the calling, genotyping and combining plans."""

from __future__ import annotations

from dataclasses import dataclass, replace


# Defaults that define the results.
@dataclass(frozen=True)
class Params:
    min_support: int = 3
    min_svlen: int = 50
    screen_factor: float = 0.9
    min_mapq: int = 20
    min_alignment_length: int = 1000
    exclude_flags: int = 0
    long_ins_length: int = 2500
    long_del_length: int = 50_000
    long_dup_length: int = 50_000
    long_inv_length: int = 10_000
    max_seq_length: int = 50_000
    max_splits_base: float = 3.0
    max_splits_kb: float = 0.1
    bin_size: int = 100
    min_leads: int = 2
    merge_r: float = 2.5
    repeat_h: float = 1.5
    repeat_h_max: int = 1000
    merge_inner: int = 150
    merge_bnd: int = 1000
    merge_len: float = 0.22
    resplit_bin: int = 20
    resplit_min: int = 50
    seqs_per_bin: int = 10
    genotype_error: float = 0.05
    genotype_min_z: int = 5
    genotype_max_depth: int = 250
    dup_min_vaf: float = 1 / 6
    combine_match: int = 250
    combine_match_max: int = 1000
    combine_bnd: int = 2000
    combine_sequence_share: float = 0.7
    combine_null_depth: int = 5
    combine_overlap: int = 2500
    genotype_match_bnd: int = 1000
    block_size: int = 100_000
    coverage_bin: int = 500
    coverage_flank: int = 500
    coverage_shift: int = 100
    precise_stdev: int = 25
    repeat_padding: int = 500
    min_contig_length: int = 1_000_000
    stdev_pos_max: float = 500.0
    stdev_pos_ratio: float = 2.0
    stdev_len_max: float = 500.0
    stdev_len_ratio: float = 1.0
    coverage_min: int = 1
    mosaic_af_min: float = 0.05
    mosaic_af_max: float = 0.218
    phase_conflict: float = 0.1
    population_min_share: float = 0.75
    nm_factor: float = 1.66

    mosaic_merge_len: float = 0.27

    def for_mosaic(self) -> Params:
        """These with what mosaic calling changes: the length threshold of clusters, unless it was set."""
        return replace(self, merge_len=self.mosaic_merge_len) if self.merge_len == Params.merge_len else self

    @property
    def screen(self) -> int:
        return int(self.screen_factor * self.min_svlen)


DEFAULTS = Params()
#: Version of the stores that are written.
STORE_VERSION = "3.0.0"
