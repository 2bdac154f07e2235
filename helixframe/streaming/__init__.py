"""Streaming forms of the read-level operators."""

from .reads import bounded_kmer_counts, drain, held_counts, kmer_count_stream, prefix_profile_stream, tumbling_counts  # noqa: F401
