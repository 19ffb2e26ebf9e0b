"""Readers and writers of the file formats."""

from .files import (
    read_conserved,
    read_fasta,
    read_frequencies,
    read_hits,
    read_matrix_market,
    read_places,
    read_sam,
    read_sidecar,
    read_whitelist,
    read_whitelists,
    sidecar_ranges,
    whitelist_argument,
    write_csv,
    write_lines,
    write_matrix_market,
    write_sam,
    write_sidecar,
    write_tag_counts,
)
from .fastq import FastqSource, read_fastq, read_interleaved, zip_reads

__all__ = [
    "FastqSource", "read_conserved", "read_fasta", "read_fastq", "read_frequencies", "read_hits", "read_interleaved", "read_matrix_market", "read_places", "read_sam", "read_sidecar", "read_whitelist",
    "read_whitelists", "sidecar_ranges", "whitelist_argument", "write_csv", "write_lines", "write_matrix_market", "write_sam", "write_sidecar", "write_tag_counts", "zip_reads",
]
