"""DuckDB SQL that computes the same rows as the registered queries, written from the operators' meaning."""

from __future__ import annotations

from ..operators.quality import ADAPTERS
from .views import LETTERS, MAPPED


def _mapped(text: str) -> str:
    return f"translate(upper(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{MAPPED}')"


def _rc(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


CONTIGS = f"contigs AS MATERIALIZED (SELECT doc_id AS contig_id, source, lang, {_mapped('text')} AS seq FROM documents)"
PLANTED = f"""{CONTIGS}, planted AS MATERIALIZED (
  SELECT contig_id * 4 AS contig_id, 0 AS kind, seq FROM contigs UNION ALL
  SELECT contig_id * 4 + 1, 1, {_rc('seq')} FROM contigs UNION ALL
  SELECT contig_id * 4 + 2, 2, seq || substr(seq, 1, 40) FROM contigs)"""
READS = f"reads AS MATERIALIZED (SELECT lang, {_mapped('text')} AS seq FROM documents UNION ALL SELECT 'chat', {_mapped('text')} FROM conversations)"
REFERENCE = f"reference AS MATERIALIZED (SELECT item_id, {_mapped('text')} AS seq FROM benchmark)"


def _kmers(source: str, k: int, columns: str) -> str:
    return f"SELECT {columns}, substr(seq, i::INT, {k}) AS kmer FROM (SELECT {columns}, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {source})"


_pick = f"([{', '.join(repr(a) for a in ADAPTERS)}])[(contig_id % {len(ADAPTERS)})::INT + 1]"
_flip = str.maketrans("ACGT", "TGCA")
_reasons = [f"WHEN contains(seq, '{a[:20]}') OR contains(seq, '{a[:20].translate(_flip)[::-1]}') OR contains(seq, '{a.translate(_flip)[::-1][:20]}') THEN 'adapter:{a[:20]}'" for a in ADAPTERS]
_reasons += [f"WHEN ends_with(seq, '{a[:n]}') OR starts_with(seq, '{a.translate(_flip)[::-1][-n:]}') THEN 'adapter_terminal:{a[:n]}'" for a in ADAPTERS for n in range(20, 9, -1)]
_reasons += [f"WHEN contains(seq, '{b * 12}') THEN 'homopolymer:{b}x12+'" for b in "ACGTN"]

CIRCULAR = """circ AS (SELECT contig_id, kind, length(seq) AS n, seq,
    CASE WHEN length(seq) >= 24 THEN nullif(strpos(reverse(substr(seq, 1, length(seq) - 1)), reverse(right(seq, 12))), 0) END AS r FROM planted),
  units AS (SELECT *, CASE WHEN r >= 12 THEN r END AS unit FROM circ)"""

ORFS = f"""frames AS (SELECT contig_id, strand, frame, substr(q, frame + 1) AS q FROM
    (SELECT contig_id, '+' AS strand, seq AS q FROM contigs UNION ALL SELECT contig_id, '-', {_rc('seq')} FROM contigs), (SELECT unnest([0, 1, 2]) AS frame)),
  cod AS (SELECT contig_id, strand, frame, i, substr(q, (3 * i + 1)::INT, 3) AS c FROM (SELECT *, unnest(range(0, length(q) // 3)) AS i FROM frames)),
  marks AS (SELECT *, c IN ('TAA', 'TAG', 'TGA') AS stop FROM cod WHERE c IN ('ATG', 'TAA', 'TAG', 'TGA')),
  isl AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY contig_id, strand, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marks),
  orfs AS (SELECT contig_id, strand, frame, min(CASE WHEN NOT stop THEN i END) AS a, max(CASE WHEN stop THEN i END) AS z FROM isl GROUP BY contig_id, strand, frame, g
    HAVING a IS NOT NULL AND z IS NOT NULL)"""
CHISQ = """cc AS (SELECT contig_id, frame, c, count(*) AS cnt FROM (SELECT contig_id, frame, c FROM cod JOIN contigs USING (contig_id) WHERE strand = '+' AND length(seq) >= 30) GROUP BY ALL),
  ct AS (SELECT *, sum(cnt) OVER (PARTITION BY contig_id, frame) AS n, sum(cnt) OVER (PARTITION BY contig_id, c) AS pooled, sum(cnt) OVER (PARTITION BY contig_id) AS total FROM cc),
  fh AS (SELECT contig_id, frame, round(-sum(cnt / n * log2(cnt / n)), 9) AS h FROM ct GROUP BY ALL),
  bf AS (SELECT contig_id, arg_max(frame, h * 10 - frame * 1e-12) AS frame FROM fh GROUP BY contig_id),
  chi AS (SELECT contig_id, frame, sum((cnt - pooled / total * n) ** 2 / (pooled / total * n)) AS chisq FROM ct JOIN bf USING (contig_id, frame) GROUP BY ALL)"""

def _known(source: str) -> str:
    """``rk``, the reference's windows, and ``h``: windows of a table of contigs and those among them."""
    return f"""rk AS (SELECT DISTINCT kmer FROM ({_kmers(f"(SELECT seq FROM reference UNION ALL SELECT {_rc('seq')} FROM reference)", 21, '1 AS one')})),
      h AS (SELECT contig_id, count(*) AS n_kmers, count(rk.kmer) AS hits FROM ({_kmers(source, 21, 'contig_id')}) LEFT JOIN rk USING (kmer) GROUP BY contig_id)"""


SAS = f"""k AS MATERIALIZED (SELECT DISTINCT contig_id, kmer FROM ({_kmers('(SELECT * FROM planted WHERE length(seq) >= 150)', 21, 'contig_id')})),
      n AS (SELECT contig_id, count(*) AS n FROM k GROUP BY contig_id),
      s AS (SELECT a.contig_id AS sense, b.contig_id AS antisense, count(*) AS shared FROM k a JOIN (SELECT contig_id, {_rc('kmer')} AS kmer FROM k) b ON a.kmer = b.kmer AND a.contig_id < b.contig_id GROUP BY ALL),
      sas AS MATERIALIZED (SELECT sense, antisense, shared, x.n AS n_sense, y.n AS n_antisense FROM s JOIN n x ON x.contig_id = sense JOIN n y ON y.contig_id = antisense WHERE shared >= 0.3 * least(x.n, y.n))"""
EITHER = f"""{SAS}, w AS (SELECT contig_id, length(seq) AS n, right(seq, 16) AS tail, seq, unnest(range(1, length(seq) - 15)) AS i FROM planted WHERE length(seq) >= 32),
      m AS (SELECT contig_id, n - (max(i) - 1 + 16) AS u FROM w WHERE hamming(substr(seq, i::INT, 16), tail) <= 1 GROUP BY contig_id, n),
      c AS (SELECT contig_id, seq, CASE WHEN u >= 16 THEN u END AS unit, contig_id IN (SELECT sense FROM sas UNION ALL SELECT antisense FROM sas) AS has_sas FROM planted LEFT JOIN m USING (contig_id)),
      q AS MATERIALIZED (SELECT contig_id, unit, coalesce(unit BETWEEN 150 AND 2500, false) AS circular, has_sas, coalesce(unit BETWEEN 150 AND 2500, false) OR has_sas AND length(seq) BETWEEN 150 AND 2500 AS qualifies,
        CASE WHEN unit BETWEEN 150 AND 2500 THEN left(seq, unit::INT) ELSE seq END AS seq FROM c)"""
SCORED = "scored AS (SELECT doc_id, quality = 1 AS truth, n_chars AS score, n_chars >= 1500 AS called, source, toxic FROM documents JOIN labels USING (doc_id))"
RUNS = """runs AS (SELECT event_id, split_part(event_type, '-', 1) AS kind,
    (['RNA-Seq', 'AMPLICON', ' miRNA-seq ', 'WGS', '', NULL])[(event_id % 6)::INT + 1] AS strategy,
    (['cDNA', 'PCR', 'random', '', NULL])[(event_id % 5)::INT + 1] AS selection,
    (['TRANSCRIPTOMIC', 'GENOMIC', 'metatranscriptomic', 'VIRAL RNA', '', NULL, 'SYNTHETIC'])[(event_id % 7)::INT + 1] AS source FROM events)"""

ORACLES = {
    "seq_revcomp_gc": f"WITH {CONTIGS} SELECT contig_id, length(seq) AS n, md5({_rc('seq')}) AS revcomp_md5, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc FROM contigs",
    "length_band_filter": f"WITH {CONTIGS} SELECT contig_id, length(seq) AS n FROM contigs WHERE length(seq) BETWEEN 10 AND 1000",
    "qc_drop_reasons": f"""WITH {CONTIGS}, a AS (SELECT contig_id, 0 AS kind, seq FROM contigs UNION ALL SELECT contig_id, 1, seq || {_pick} || 'CG' FROM contigs
      UNION ALL SELECT contig_id, 2, seq || left({_pick}, 12) FROM contigs UNION ALL SELECT contig_id, 3, seq || repeat('A', 12) FROM contigs)
      SELECT contig_id, kind, CASE {' '.join(_reasons)} END AS drop_reason FROM a""",
    "prefix_profile_by_lang": f"""WITH {READS}, c AS (SELECT lang, substr(seq, 1, 20) AS prefix, count(*) AS n FROM reads WHERE length(seq) >= 20 GROUP BY ALL),
      t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, prefix) AS rank FROM c)
      SELECT lang, sum(n)::BIGINT AS n_reads, sum(CASE WHEN rank <= 3 THEN n END)::BIGINT AS top_reads,
        '[' || string_agg(CASE WHEN rank <= 3 THEN '"' || prefix || '"' END, ',' ORDER BY rank) || ']' AS top_prefixes,
        sum(CASE WHEN rank <= 3 THEN n END) / sum(n) >= 0.2 AS is_amplicon FROM t GROUP BY lang""",
    "kmer_count_min": f"WITH {CONTIGS} SELECT kmer, count(*) AS cnt FROM ({_kmers('contigs', 21, 'contig_id')}) GROUP BY kmer HAVING count(*) >= 5",
    "kmer_complexity": f"WITH {CONTIGS} SELECT contig_id, count(DISTINCT kmer) AS n_distinct, count(*) AS n_windows FROM ({_kmers('contigs', 6, 'contig_id')}) GROUP BY contig_id",
    "circularity_exact": f"WITH {PLANTED}, {CIRCULAR} SELECT contig_id, kind, unit AS unit_length, n - unit AS overhang, md5(substr(seq, 1, unit)) AS monomer_md5 FROM units WHERE unit IS NOT NULL",
    "circularity_mismatch1": f"""WITH {PLANTED}, w AS (SELECT contig_id, length(seq) AS n, seq, right(seq, 16) AS tail, unnest(range(1, length(seq) - 15)) AS i FROM planted WHERE length(seq) >= 32),
      m AS (SELECT contig_id, n, max(i) AS i FROM w WHERE hamming(substr(seq, i::INT, 16), tail) <= 1 GROUP BY ALL)
      SELECT contig_id, (n - (i - 1 + 16))::INT AS unit_length FROM m WHERE n - (i - 1 + 16) >= 16""",
    "concatemer_resolve": f"""WITH {PLANTED}, {CIRCULAR}, c AS (SELECT contig_id, n, unit, CASE WHEN round_even(n / unit, 0) >= 2 AND abs(n / unit - round_even(n / unit, 0)) / round_even(n / unit, 0) <= 0.1
      THEN round_even(n / unit, 0) END AS whole FROM units WHERE unit IS NOT NULL)
      SELECT contig_id, whole IS NOT NULL AS resolved, floor(coalesce(whole, n / unit) * 1000)::BIGINT AS copies_milli FROM c""",
    "reference_kmer_screen": f"""WITH {CONTIGS}, {REFERENCE}, rk AS (SELECT DISTINCT kmer FROM ({_kmers(f"(SELECT seq FROM reference UNION ALL SELECT {_rc('seq')} FROM reference)", 21, '1 AS one')}) ),
      k AS ({_kmers('contigs', 21, 'contig_id')}), h AS (SELECT contig_id, count(*) AS n_kmers, count(rk.kmer) AS hits FROM k LEFT JOIN rk USING (kmer) GROUP BY contig_id)
      SELECT c.contig_id, coalesce(n_kmers, 0)::BIGINT AS n_kmers, coalesce(hits, 0)::BIGINT AS hits, coalesce(hits, 0) * 10 >= coalesce(n_kmers, 0) AND coalesce(n_kmers, 0) > 0 AS screened FROM contigs c LEFT JOIN h USING (contig_id)""",
    "ncrna_anti_join": f"""WITH {CONTIGS}, {REFERENCE}, rk AS (SELECT DISTINCT kmer FROM ({_kmers(f"(SELECT seq FROM reference UNION ALL SELECT {_rc('seq')} FROM reference)", 21, '1 AS one')})),
      known AS (SELECT DISTINCT contig_id FROM ({_kmers('contigs', 21, 'contig_id')}) SEMI JOIN rk USING (kmer)) SELECT contig_id, source FROM contigs ANTI JOIN known USING (contig_id)""",
    "sas_pairs": f"""WITH {PLANTED}, k AS MATERIALIZED (SELECT DISTINCT contig_id, kmer FROM ({_kmers('(SELECT * FROM planted WHERE length(seq) >= 150)', 21, 'contig_id')})),
      n AS (SELECT contig_id, count(*) AS n FROM k GROUP BY contig_id),
      s AS (SELECT a.contig_id AS sense, b.contig_id AS antisense, count(*) AS shared FROM k a JOIN (SELECT contig_id, {_rc('kmer')} AS kmer FROM k) b ON a.kmer = b.kmer AND a.contig_id < b.contig_id GROUP BY ALL)
      SELECT sense, antisense, shared, x.n AS n_sense, y.n AS n_antisense FROM s JOIN n x ON x.contig_id = sense JOIN n y ON y.contig_id = antisense WHERE shared >= 0.3 * least(x.n, y.n)""",
    "sas_pairs_ranked": f"""WITH {PLANTED}, {SAS} SELECT sense, antisense, floor(round(shared / least(n_sense, n_antisense), 4) * 1e4 + 0.5)::BIGINT AS fraction_e4, greatest(sense % 97, antisense % 97) / 4 AS coverage FROM sas""",
    "either_axis": f"WITH {PLANTED}, {EITHER} SELECT contig_id, circular, has_sas, qualifies, md5(seq) AS monomer_md5 FROM q",
    "hunt_candidates": f"""WITH {PLANTED}, {EITHER}, {REFERENCE}, {_known('q')},
      o AS (WITH contigs AS (SELECT contig_id, seq FROM q WHERE qualifies), {ORFS}, {CHISQ}, l AS (SELECT contig_id, max((z - a + 1) * 3) AS orf FROM orfs GROUP BY contig_id)
        SELECT contig_id, coalesce(orf, 0)::BIGINT AS longest_orf_nt, floor((0.5 * (1 - CASE WHEN length(seq) = 0 THEN 0 ELSE least(1, coalesce(orf, 0) / length(seq)) END) + 0.5 * (1 - coalesce(chisq, 0) / (coalesce(chisq, 0) + 50))) * 1e6 + 0.5)::BIGINT AS orphan_e6
        FROM contigs LEFT JOIN l USING (contig_id) LEFT JOIN chi USING (contig_id)),
      v AS (SELECT contig_id, CASE WHEN coalesce(n_kmers, 0) > 0 AND hits * 10 >= n_kmers THEN 'known' WHEN unit IS NULL AND NOT has_sas THEN 'not circular or paired' WHEN NOT qualifies THEN 'size' ELSE 'candidate' END AS verdict,
        floor(coalesce(hits / n_kmers, 0) * 1e6 + 0.5)::BIGINT AS known_e6 FROM q LEFT JOIN h USING (contig_id))
      SELECT contig_id, verdict, known_e6, longest_orf_nt, orphan_e6, verdict = 'candidate' AS shortlisted FROM v LEFT JOIN o USING (contig_id)""",
    "cluster_labels": f"""WITH {CONTIGS}, m AS (SELECT contig_id AS id, min(contig_id) OVER (PARTITION BY substr(seq, 1, 12)) AS cluster_id FROM contigs),
      l AS (SELECT doc_id AS id, quality = 1 AS t, source, CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'plain' END AS kind FROM documents JOIN labels USING (doc_id))
      SELECT cluster_id, count(*) AS n_members, coalesce(bool_or(t), false) AS is_true_positive, count(DISTINCT CASE WHEN t THEN source END) AS n_elements, max(CASE WHEN id = cluster_id THEN kind END) AS kind
      FROM m LEFT JOIN l USING (id) GROUP BY cluster_id""",
    "circular_rates": f"""WITH {CONTIGS}, planted AS (SELECT contig_id, source AS kind, seq FROM contigs), {CIRCULAR}
      SELECT kind AS source, count(*) AS n_contigs, count(unit) AS n_circular, floor(count(unit) / count(*) * 1e9 + 0.5)::BIGINT AS rate_e9 FROM units GROUP BY ROLLUP (kind)""",
    "contig_traits": f"""WITH {CONTIGS}, planted AS (SELECT contig_id, 0 AS kind, seq FROM contigs), {CIRCULAR}, {ORFS}, {CHISQ},
      f AS (SELECT contig_id, z - a AS aa, strand, frame, a * 3 + frame AS nt FROM orfs), r AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY aa DESC, strand DESC, frame DESC, nt DESC) AS pos FROM f),
      t AS (SELECT contig_id, count(*) AS n_orfs, string_agg(CASE WHEN pos <= 5 THEN aa || '/' || strand || '/' || frame || '/' || nt END, ',' ORDER BY pos) AS top_orfs, (max(aa) + 1) * 3 AS orf FROM r GROUP BY contig_id)
      SELECT c.contig_id, length(regexp_replace(c.seq, '[^GC]', '', 'g')) AS gc, unit IS NOT NULL AS is_circular, coalesce(unit, 0)::BIGINT AS unit_length, coalesce(n_orfs, 0) AS n_orfs, coalesce(top_orfs, '') AS top_orfs,
        floor((0.5 * (1 - CASE WHEN length(c.seq) = 0 THEN 0 ELSE least(1, coalesce(orf, 0) / length(c.seq)) END) + 0.5 * (1 - coalesce(chisq, 0) / (coalesce(chisq, 0) + 50))) * 1e6 + 0.5)::BIGINT AS orphan_e6
      FROM contigs c JOIN units USING (contig_id) LEFT JOIN t USING (contig_id) LEFT JOIN chi ON chi.contig_id = c.contig_id""",
    "calibrate_report": f"""WITH {SCORED}, p AS (SELECT *, (score % 997 + 1) ** 2 / 2e6 AS p FROM scored), k AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS n FROM p),
      q AS (SELECT *, coalesce(least(1.0, min(p * n / rk) OVER (ORDER BY p DESC, rk DESC ROWS UNBOUNDED PRECEDING)), 1) <= 0.05 AS reject FROM k),
      t AS (SELECT *, bool_or(reject) OVER (PARTITION BY p) AS hit FROM q),
      r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored), u AS (SELECT count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n, sum(CASE WHEN truth THEN rk END) AS rs FROM r),
      g AS (SELECT score, count(*) FILTER (truth) AS p, count(*) AS n FROM scored GROUP BY score), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), a AS (SELECT sum(p * cp / cn) / sum(p) AS ap FROM c)
      SELECT u.p::BIGINT AS positives, u.n::BIGINT AS negatives, floor((rs - u.p * (u.p + 1) / 2) / (u.p * u.n) * 1e9 + 0.5)::BIGINT AS auc_e9, floor(ap * 1e9 + 0.5)::BIGINT AS ap_e9,
        (SELECT count(*) FROM t WHERE truth AND hit) AS tp, (SELECT count(*) FROM t WHERE NOT truth AND hit) AS fp, (SELECT count(*) FROM t WHERE truth AND NOT hit) AS fn, (SELECT count(*) FROM t WHERE NOT truth AND NOT hit) AS tn,
        (SELECT count(DISTINCT toxic = 1) FROM t WHERE NOT truth) AS n_kinds, (SELECT count(*) FROM t WHERE NOT truth AND hit) AS false_called FROM u, a""",
    "orf_islands": f"WITH {CONTIGS}, {ORFS} SELECT contig_id, strand, frame, a AS start, z AS stop, ((z - a + 1) * 3)::BIGINT AS orf_nt FROM orfs",
    "orf_longest": f"WITH {CONTIGS}, {ORFS} SELECT contig_id, max((z - a + 1) * 3)::BIGINT AS longest_orf_nt, count(*) AS n_orfs FROM orfs GROUP BY contig_id",
    "codon_chisq": f"WITH {CONTIGS}, {ORFS}, {CHISQ} SELECT contig_id, frame, floor(chisq * 1e4 + 0.5)::BIGINT AS chisq_e4 FROM chi",
    "orphan_score": f"""WITH {CONTIGS}, {ORFS}, {CHISQ}, l AS (SELECT contig_id, max((z - a + 1) * 3) AS orf FROM orfs GROUP BY contig_id)
      SELECT contig_id, coalesce(orf, 0)::BIGINT AS longest_orf_nt, floor((0.5 * (1 - CASE WHEN length(seq) = 0 THEN 0 ELSE least(1, coalesce(orf, 0) / length(seq)) END) + 0.5 * (1 - coalesce(chisq, 0) / (coalesce(chisq, 0) + 50))) * 1e6 + 0.5)::BIGINT AS orphan_e6
      FROM contigs LEFT JOIN l USING (contig_id) LEFT JOIN chi USING (contig_id)""",
    "bh_fdr": f"""WITH p AS (SELECT doc_id, n_chars, (n_chars % 997 + 1) ** 2 / 2e6 AS p FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS rk, count(*) OVER () AS n FROM p),
      q AS (SELECT doc_id, least(1.0, min(p * n / rk) OVER (ORDER BY p DESC, rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r) SELECT doc_id, floor(q * 1e9 + 0.5)::BIGINT AS q_e9, q <= 0.05 AS reject FROM q""",
    "n50_by_source": f"""WITH {CONTIGS}, r AS (SELECT source, length(seq) AS len, sum(length(seq)) OVER (PARTITION BY source ORDER BY length(seq) DESC, contig_id ROWS UNBOUNDED PRECEDING) AS run, sum(length(seq)) OVER (PARTITION BY source) AS total FROM contigs)
      SELECT source, count(*) AS n_contigs, max(total)::BIGINT AS total, max(len) AS longest, max(CASE WHEN 2 * run >= total THEN len END) AS n50 FROM r GROUP BY source""",
    "debruijn_degree": f"""WITH {CONTIGS}, k AS MATERIALIZED (SELECT kmer, count(*) AS cnt FROM ({_kmers('contigs', 21, 'contig_id')}) GROUP BY kmer HAVING count(*) >= 2),
      o AS (SELECT left(kmer, 20) AS m, count(*) AS n FROM k GROUP BY 1), i AS (SELECT right(kmer, 20) AS m, count(*) AS n FROM k GROUP BY 1)
      SELECT coalesce(o.n, 0)::BIGINT AS n_out, coalesce(i.n, 0)::BIGINT AS n_in, count(*) AS nodes, sum(cnt)::BIGINT AS total FROM k LEFT JOIN o ON right(kmer, 20) = o.m LEFT JOIN i ON left(kmer, 20) = i.m GROUP BY 1, 2""",
    "kmer_mean_coverage": f"""WITH {CONTIGS}, x AS MATERIALIZED ({_kmers('contigs', 21, 'contig_id')}), k AS (SELECT kmer, count(*) AS cnt FROM x GROUP BY kmer HAVING count(*) >= 2)
      SELECT contig_id, count(*) AS n_kmers, sum(coalesce(cnt, 0))::BIGINT AS total FROM x LEFT JOIN k USING (kmer) GROUP BY contig_id""",
    "confusion_fdr_power": f"""WITH {SCORED}, c AS (SELECT source, count(*) FILTER (truth AND called) AS tp, count(*) FILTER (NOT truth AND called) AS fp, count(*) FILTER (truth AND NOT called) AS fn, count(*) FILTER (NOT truth AND NOT called) AS tn FROM scored GROUP BY source)
      SELECT *, CASE WHEN tp + fp > 0 THEN floor(fp / (tp + fp) * 1e9 + 0.5) ELSE 0 END::BIGINT AS fdr_e9, CASE WHEN tp + fn > 0 THEN floor(tp / (tp + fn) * 1e9 + 0.5) END::BIGINT AS power_e9 FROM c""",
    "roc_auc": f"""WITH {SCORED}, r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored),
      s AS (SELECT count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n, sum(CASE WHEN truth THEN rk END) AS rs FROM r)
      SELECT p::BIGINT AS positives, n::BIGINT AS negatives, floor((rs - p * (p + 1) / 2) / (p * n) * 1e9 + 0.5)::BIGINT AS auc_e9 FROM s""",
    "average_precision": f"""WITH {SCORED}, g AS (SELECT score, count(*) FILTER (truth) AS p, count(*) AS n FROM scored GROUP BY score), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
      SELECT sum(p)::BIGINT AS positives, floor(sum(p * cp / cn) / sum(p) * 1e9 + 0.5)::BIGINT AS ap_e9 FROM c""",
    "decoy_breakdown": "SELECT coalesce(CASE toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'plain' END, 'unknown') AS kind, count(*) FILTER (n_chars >= 1500) AS false_called, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) = 0 GROUP BY 1",
    "library_verdict": f"""WITH {RUNS}, u AS (SELECT event_id, upper(trim(coalesce(strategy, ''))) AS st, upper(trim(coalesce(selection, ''))) AS se, upper(trim(coalesce(source, ''))) AS so FROM runs),
      r AS (SELECT event_id, st = '' AND se = '' AND so = '' AS unknown, st IN ('MIRNA-SEQ', 'NCRNA-SEQ', 'SSRNA-SEQ') AS sized, list_filter([CASE WHEN st = '' AND se = '' AND so = '' THEN 'no metadata' END,
        CASE WHEN st = 'AMPLICON' THEN 'amplicon strategy' WHEN st <> '' AND st NOT IN ('RNA-SEQ', 'SSRNA-SEQ', 'MRNA-SEQ', 'TOTAL-RNA-SEQ', 'NCRNA-SEQ', 'MIRNA-SEQ') THEN 'not a shotgun RNA strategy' END,
        CASE WHEN se IN ('PCR', 'RT-PCR') THEN 'targeted selection' END,
        CASE WHEN so IN ('GENOMIC', 'METAGENOMIC', 'GENOMIC SINGLE CELL') THEN 'DNA source' WHEN so <> '' AND so NOT IN ('TRANSCRIPTOMIC', 'METATRANSCRIPTOMIC', 'TRANSCRIPTOMIC SINGLE CELL') THEN 'not an RNA source' END], lambda x: x IS NOT NULL) AS reasons FROM u)
      SELECT event_id, len(reasons) = 0 AS compatible, unknown, array_to_string(reasons, '; ') AS reasons, CASE WHEN sized THEN 'size-selected' ELSE '' END AS warnings FROM r""",
    "header_parse": """WITH h AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NODE_' || c_custkey || '_length_' || (c_custkey * 7) || '_cov_3.5_g1_i0 rest' WHEN 1 THEN 'contig_' || c_custkey || ' flag=1 multi=' || c_nationkey || '.25 len=' || c_custkey ELSE c_name || ' cov=' || c_nationkey || '.5 multi=none' END AS id FROM customer)
      SELECT c_custkey, split_part(id, ' ', 1) AS name, coalesce(TRY_CAST(nullif(regexp_extract(id, '_length_(\\d+)_', 1), '') AS INT), -1) AS spades_length,
        coalesce(TRY_CAST(nullif(regexp_extract(id, ' multi=(\\S+)', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(id, ' cov=(\\S+)', 1), '') AS DOUBLE), 0.0) AS coverage, left(regexp_replace(id, '[^A-Za-z0-9]', '_', 'g'), 80) AS safe FROM h""".replace("\\\\", "\\"),
    "dinuc_shuffle_invariants": f"""WITH {CONTIGS}, d AS (SELECT contig_id, kmer, count(*) AS n FROM ({_kmers('contigs', 2, 'contig_id')}) GROUP BY ALL)
      SELECT contig_id, md5(string_agg(kmer || n, ',' ORDER BY kmer)) AS dinucleotides FROM d GROUP BY contig_id""",
    "candidate_triage": f"""WITH {PLANTED}, {CIRCULAR}, {REFERENCE}, rk AS (SELECT DISTINCT kmer FROM ({_kmers(f"(SELECT seq FROM reference UNION ALL SELECT {_rc('seq')} FROM reference)", 21, '1 AS one')})),
      h AS (SELECT contig_id, count(*) AS n_kmers, count(rk.kmer) AS hits FROM ({_kmers('planted', 21, 'contig_id')}) LEFT JOIN rk USING (kmer) GROUP BY contig_id)
      SELECT contig_id, CASE WHEN coalesce(n_kmers, 0) > 0 AND hits * 10 >= n_kmers THEN 'known' WHEN unit IS NULL THEN 'not circular' WHEN unit NOT BETWEEN 150 AND 2500 THEN 'size' ELSE 'candidate' END AS verdict
      FROM units LEFT JOIN h USING (contig_id)""",
    "blast_report_hits": """WITH i AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
      r AS (SELECT l_suppkey, 'AC' || lpad(l_partkey::VARCHAR, 9, '0') AS accession, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS description, q AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS rank FROM i JOIN part ON p_partkey = l_partkey)
      SELECT l_suppkey, rank, accession, description, score, 97::BIGINT AS identity FROM r WHERE rank <= 10""",
    "event_windows_stream": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL",
    "read_prefix_stream": f"SELECT role, substr(seq, 1, 20) AS prefix, count(*) AS n FROM (SELECT role, {_mapped('text')} AS seq FROM conversations) WHERE length(seq) >= 20 GROUP BY ALL",
    "kmer_bounded_stream": f"WITH turns AS MATERIALIZED (SELECT {_mapped('text')} AS seq FROM conversations) SELECT kmer, count(*) AS cnt, count(*) AS upper FROM ({_kmers('turns', 8, 'seq')}) GROUP BY kmer",
}
