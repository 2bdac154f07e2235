"""Column builders over nucleotide strings, headers and folds, and their SQL names."""

from pyspark.sql import SparkSession

from .sequences import *  # noqa: F403

#: SQL functions of the session: name, parameters, type and body.
SQL_FUNCTIONS = {
    "revcomp": ("s STRING", "STRING", "reverse(translate(s, 'ACGTUacgtuNn', 'TGCAAtgcaaNn'))"),
    "to_rna": ("s STRING", "STRING", "translate(upper(s), 'T', 'U')"),
    "to_dna": ("s STRING", "STRING", "translate(upper(s), 'U', 'T')"),
    "gc_content": ("s STRING", "DOUBLE", "CASE WHEN length(s) = 0 THEN 0D ELSE length(regexp_replace(upper(s), '[^GC]', '')) / length(s) END"),
    "kmers": ("s STRING, k INT", "ARRAY<STRING>", "regexp_extract_all(s, concat('(?s)(?=(.{', k, '}))'), 1)"),
    "hamming": ("a STRING, b STRING", "INT", "CASE WHEN length(a) = length(b) THEN aggregate(zip_with(split(a, ''), split(b, ''), (p, q) -> int(p <> q)), 0, (n, d) -> n + d) END"),
    "circular_unit": ("s STRING, k INT", "INT", "CASE WHEN length(s) >= 2 * k THEN nullif(greatest(instr(reverse(left(s, length(s) - 1)), reverse(right(s, k))), k - 1), k - 1) END"),
}

#: Table functions of the session: name, parameters, columns and query; used with ``LATERAL``.
#: ``orf_map`` goes over the start and stop codons of each strand and frame: the first start since a stop opens a frame.
TABLE_FUNCTIONS = {
    "orf_map": (
        "seq STRING",
        "strand STRING, frame INT, start INT, stop INT, orf_nt INT",
        """SELECT strand, frame, found.start, found.stop, (found.stop - found.start + 1) * 3
           FROM (SELECT strand, frame, explode(aggregate(transform(regexp_extract_all(substring(q, frame + 1), '.{3}', 0), (c, i) -> struct(c, i)),
               named_struct('open', CAST(NULL AS INT), 'found', CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT>>)),
               (a, x) -> CASE WHEN x.c IN ('TAA', 'TAG', 'TGA') THEN named_struct('open', CAST(NULL AS INT), 'found', CASE WHEN a.open IS NULL THEN a.found ELSE array_append(a.found, named_struct('start', a.open, 'stop', x.i)) END)
                              WHEN x.c = 'ATG' THEN named_struct('open', coalesce(a.open, x.i), 'found', a.found) ELSE a END,
               a -> a.found)) AS found
             FROM (SELECT strand, q, explode(array(0, 1, 2)) AS frame FROM (SELECT inline(array(struct('+' AS strand, translate(upper(seq), 'U', 'T') AS q), struct('-' AS strand, reverse(translate(translate(upper(seq), 'U', 'T'), 'ACGTN', 'TGCAN')) AS q))))))""",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Makes the functions above known to ``spark.sql`` in this session."""
    for name, (parameters, columns, query) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
