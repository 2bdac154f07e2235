"""One-line descriptions of result rows, as column expressions. The wordings are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(value: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", value.cast("double") * 100)


def describe_pair() -> Column:
    """Of a row with ``sense, antisense, n_sense, n_antisense, sense_coverage, antisense_coverage, fraction`` (lengths in bases)."""
    side = lambda x: F.format_string("%s (%d nt, %.0fx)", F.col(x).cast("string"), F.col(f"n_{x}").cast("long"), F.col(f"{x}_coverage").cast("double"))
    return F.concat(side("sense"), F.lit(" <-> "), side("antisense"), F.lit(" sharing "), _share(F.col("fraction")))


def describe_rod() -> Column:
    """Of a row with ``n, energy, mfe_per_nt, paired_fraction, complexity, longest_helix, is_rodlike``."""
    numbers = F.format_string("len=%d MFE=%.1f (%.3f/nt) ", F.col("n").cast("long"), F.col("energy").cast("double"), F.col("mfe_per_nt").cast("double"))
    verdict = F.when(F.col("is_rodlike"), "rod-like").otherwise("not rod-like")
    return F.concat(numbers, F.lit("paired="), _share(F.col("paired_fraction")), F.format_string(" complexity=%.2f longest_helix=%d -> ", F.col("complexity").cast("double"), F.col("longest_helix").cast("long")), verdict)


def describe_assembly(k: int, min_count: int) -> Column:
    """Of a row of ``assembly_stats``."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return F.format_string(f"reads=%d k={k} min_count={min_count} kmers %d->%d kept | contigs=%d total=%dbp N50=%d max=%d circular=%d", n("n_reads"), n("n_kmers"), n("n_kept"), n("n_contigs"), n("total"), n("n50"), n("longest"), n("n_circular"))


def describe_run() -> Column:
    """Of a row of run metadata."""
    text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return F.concat("accession", F.lit(": strategy="), text("library_strategy", "?"), F.lit(" selection="), text("library_selection", "?"), F.lit(" source="), text("library_source", "?"), F.lit(" ("), text("scientific_name", "unknown sample"), F.lit(")"))


def describe_prefixes(prefix: int = 20, top: int = 3, threshold: float = 0.2) -> Column:
    """Of a row of ``prefix_profile``."""
    share = _share(F.col("top_reads") / F.col("n_reads"), 1)
    verdict = F.when(F.col("is_amplicon"), "amplicon-like (primer-dominated)").otherwise("shotgun-like")
    line = F.concat(F.col("n_reads").cast("string"), F.lit(f" reads, top {top} 5'-{prefix}mers cover "), share, F.lit(f" (threshold {threshold:.0%}) -> "), verdict)
    return F.when(F.coalesce(F.col("n_reads"), F.lit(0)) == 0, "no reads examined").otherwise(line)


def describe_hit() -> Column:
    """Of a row of search hits with ``accession, description, evalue, identity``."""
    identity = F.when(F.col("identity").isNotNull(), F.format_string(", %.0f%% id", F.col("identity").cast("double"))).otherwise("")
    return F.concat("accession", F.lit(" "), "description", F.lit(" (E="), F.col("evalue").cast("string"), identity, F.lit(")"))
