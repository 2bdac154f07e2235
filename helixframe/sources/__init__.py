"""Readers and writers of sequence files and of the tables around them."""

from .archive import run_metadata  # noqa: F401
from .sequence_files import (  # noqa: F401
    append_results,
    junction_evidence,
    read_accessions,
    read_alignments,
    read_blast_report,
    read_fasta,
    read_fastq,
    read_feature_names,
    read_reference,
    read_run_metadata,
    register_sources,
    run_urls,
    stream_fastq,
    with_metadata,
    write_fasta,
    write_labels,
    write_report,
)
from .services import BatchSearch, QueuedSearch, family_hits, http, job_id, upload  # noqa: F401
