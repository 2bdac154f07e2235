"""Column expressions over nucleotide strings and FASTA headers. All run in the JVM.

Windows and codons come from ``regexp_extract_all``, which passes over a string once; indexed
substrings in a lambda would scan from its start for every window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complement of each base in both cases; U pairs as T does, and comes back as A.
BASES, COMPLEMENTS = "ACGTUacgtuNn", "TGCAAtgcaaNn"
STOPS = ("TAA", "TAG", "TGA")


def _col(seq: Column | str) -> Column:
    return F.col(seq) if isinstance(seq, str) else seq


def revcomp(seq: Column | str) -> Column:
    """Reverse complement in DNA letters."""
    return F.reverse(F.translate(_col(seq), BASES, COMPLEMENTS))


def rna(seq: Column | str) -> Column:
    return F.translate(F.upper(_col(seq)), "T", "U")


def dna(seq: Column | str) -> Column:
    return F.translate(F.upper(_col(seq)), "U", "T")


def gc_content(seq: Column | str) -> Column:
    """Share of G and C; 0 for an empty string."""
    s = F.upper(_col(seq))
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places at which two strings of one length differ; null for others."""
    x, y = _col(a), _col(b)
    differ = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p == q, 0).otherwise(1))
    return F.when(F.length(x) == F.length(y), F.aggregate(differ, F.lit(0), lambda n, d: n + d))


def kmers(seq: Column | str, k: int, letters: str | None = None) -> Column:
    """All overlapping windows of ``k`` characters, in order; empty below ``k``.

    With ``letters`` only windows wholly of those letters come out, as if the string were cut at all
    other characters first.
    """
    one = f"[{letters}]" if letters else "."
    return F.regexp_extract_all(_col(seq), F.lit(f"(?s)(?=({one}{{{int(k)}}}))"), F.lit(1))


def codons(seq: Column | str, frame: Column | int = 0) -> Column:
    """Consecutive codons from ``frame`` (0, 1 or 2); a partial one at the end is left out."""
    start = frame + 1 if isinstance(frame, Column) else F.lit(frame + 1)
    return F.regexp_extract_all(F.substring(_col(seq), start, F.length(_col(seq))), F.lit("(?s).{3}"), F.lit(0))


def complexity(seq: Column | str, k: int = 6) -> Column:
    """Distinct windows over all windows; 0 below ``k`` characters."""
    w = kmers(seq, k)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(w)) / F.size(w))


def leading_token(header: Column | str) -> Column:
    """The name: all up to the first white space."""
    return F.regexp_extract(_col(header), r"^\s*(\S*)", 1)


def header_length(header: Column | str) -> Column:
    """The number behind ``_length_``, null where absent."""
    return F.regexp_extract(_col(header), r"_length_(\d+)_", 1).try_cast("int")


def header_coverage(header: Column | str) -> Column:
    """``multi=`` if it holds a number, else ``cov=``, else 0."""
    number = lambda key: F.regexp_extract(_col(header), rf"(?:^|\s){key}=(\S+)", 1).try_cast("double")
    return F.coalesce(number("multi"), number("cov"), F.lit(0.0))


def safe_id(header: Column | str) -> Column:
    """A file name: anything but letters and digits becomes ``_``, 80 characters at most."""
    return F.substring(F.regexp_replace(_col(header), "[^A-Za-z0-9]", "_"), 1, 80)


def paired_bases(structure: Column | str) -> Column:
    """Bases in pairs of a dot-bracket string."""
    return 2 * F.length(F.regexp_replace(_col(structure), "[^(]", ""))


def longest_helix(structure: Column | str) -> Column:
    """The longest run of ``(``."""
    return F.coalesce(F.array_max(F.transform(F.split(_col(structure), "[^(]"), lambda x: F.length(x))), F.lit(0))


def normal_tail(z: Column | str) -> Column:
    """Upper tail of the standard normal distribution, by a published rational approximation
    (Abramowitz and Stegun 26.2.17; absolute error below 7.5e-8)."""
    z = _col(z)
    # fixed values
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + F.abs(z) * p)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)
