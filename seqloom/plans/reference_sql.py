"""SQL of the queries in reference.py."""

from __future__ import annotations

from seqloom.functions.residue import ALPHABET, REDUCED_GROUPS, REDUCED_LETTERS
from seqloom.plans.problems import _LINKS

_S = """
s AS (SELECT seq_id, max(translate(upper(regexp_replace(coalesce(residues, ''), '[^A-Za-z]', '', 'g')), 'JOU', 'XXX')) AS residues
      FROM fasta_sequence WHERE seq_id IS NOT NULL GROUP BY seq_id)"""
_P = (
    _S
    + """,
p AS (SELECT s.seq_id, length(s.residues) AS n_old, t.residues AS new, rpad(s.residues, CAST(greatest(length(s.residues), length(t.residues)) AS INT), '-') AS a,
             rpad(t.residues, CAST(greatest(length(s.residues), length(t.residues)) AS INT), '-') AS b
      FROM s JOIN s t ON t.seq_id = s.seq_id + 1)"""
)
_LETTERS = "ABCDEFGHIKLMNPQRSTVWXYZ"
_RUN = "|".join(f"{c}{{10,}}" for c in _LETTERS)
_RUN10 = "|".join(f"{c}{{10}}" for c in _LETTERS)
_RUN6 = "|".join(f"{c}{{6}}" for c in _LETTERS)
_HASH = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({{k}}, ''), lambda x: CAST(instr('{ALPHABET}', x) - 1 AS BIGINT))), lambda acc, x: acc * 23 + x)"
_SEEDS = (
    _S
    + f""",
w AS (SELECT seq_id, i AS pos, substr(residues, i + 1, 6) AS kmer, substr(residues, greatest(i - 6, 0) + 1, i + 6 - greatest(i - 6, 0)) AS near
      FROM s, range(0, length(residues) - 6) r(i) WHERE length(residues) > 6),
seed AS (SELECT seq_id, pos, {_HASH.format(k="kmer")} AS kmer_hash FROM w WHERE NOT regexp_matches(near, '{_RUN6}'))"""
)
_WORD = r"regexp_extract(qseqid, '^\s*(\S*)', 1)"
_ACC = r"""CASE WHEN starts_with({h}, 'tr|') OR starts_with({h}, 'sp|') THEN CASE WHEN split_part({h}, '|', 2) <> '' THEN split_part({h}, '|', 2) ELSE {h} END ELSE {h} END"""
_HEAD = r"regexp_extract(split_part({c}, ':', 1), '^\s*(\S*)', 1)"
_PAIRS = f"""
h AS (SELECT {_WORD} AS query, {_HEAD.format(c="fasta_ref")} AS head, evalue, bitscore FROM search_hit
      WHERE qseqid IS NOT NULL AND fasta_ref IS NOT NULL AND bitscore IS NOT NULL AND evalue IS NOT NULL AND NOT isnan(evalue) AND evalue >= 0),
pr AS (SELECT query, {_ACC.format(h="head")} AS subject, evalue, bitscore FROM h),
tr AS (SELECT DISTINCT query, subject FROM pr WHERE evalue <= 1e-30),
fd AS (SELECT DISTINCT query, subject FROM pr WHERE bitscore >= 150)"""
_ROC = (
    _PAIRS
    + """,
sc AS (SELECT query, subject, max(bitscore) AS score, min(evalue) <= 1e-30 AS pos FROM pr GROUP BY ALL),
per AS (SELECT score, count(*) FILTER (pos) AS t, count(*) FILTER (NOT pos) AS f FROM sc GROUP BY score),
run AS (SELECT score, sum(t) OVER (ORDER BY score DESC) AS tp, sum(f) OVER (ORDER BY score DESC) AS fp, sum(t) OVER () AS p, sum(f) OVER () AS n FROM per),
pt AS (SELECT 0.0 AS fpr, 0.0 AS tpr, NULL AS score UNION ALL SELECT fp / n, tp / p, score FROM run)"""
)
_ORDER = "(({k} % 1000003) * 654435 + 42 * 7919) % 1000003"
_DISRUPT = "list_sum(list_transform(list_filter(coalesce({d}, []), lambda o: o.pos + {s} >= {a} AND o.pos + {s} < {b}), lambda o: CASE WHEN o.op = 'DELETE' THEN 2 ELSE 1 END))"
_APPLY = """array_to_string(list_transform(range(0, length({t}) + 1), lambda i:
  coalesce(array_to_string(list_transform(list_filter({d}, lambda o: o.pos = i AND o.op = 'INSERT'), lambda o: coalesce(o.ch, '')), ''), '') ||
  CASE WHEN len(list_filter({d}, lambda o: o.pos = i AND o.op <> 'INSERT')) = 0 THEN substr({t}, i + 1, 1)
       WHEN list_filter({d}, lambda o: o.pos = i AND o.op <> 'INSERT')[1].op = 'DELETE' THEN ''
       ELSE coalesce(list_filter({d}, lambda o: o.pos = i AND o.op <> 'INSERT')[1].ch, '') END), '')"""
_STORED = """
st AS (SELECT * FROM (SELECT node_id, sequence, parent_start, parent_end, diff, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM tree_node WHERE node_id IS NOT NULL) WHERE rn = 1)"""
_PRUNED = f"""
WITH RECURSIVE {_LINKS}, {_STORED}, node AS (SELECT l.node_id, p.node_id AS parent FROM link l LEFT JOIN link p ON p.node_id = l.parent),
dn AS (SELECT h.hit_id, h.node_id, CAST(h.sstart - 1 AS BIGINT) AS a, CAST(h.send AS BIGINT) AS b, CAST(1 AS DOUBLE) AS score FROM (SELECT DISTINCT hit_id, node_id, sstart, send FROM search_hit) h JOIN node n USING (node_id) WHERE n.parent IS NULL
       UNION ALL
       SELECT hit_id, node_id, lo - parent_start, hi - parent_start, score FROM (SELECT *, 1.0 - CAST(coalesce({_DISRUPT.format(d="diff", s="parent_start", a="lo", b="hi")}, 0) AS DOUBLE) / greatest(hi - lo, 1) AS score FROM (
         SELECT d.hit_id, n.node_id, st.parent_start, st.diff, greatest(d.a, st.parent_start) AS lo, least(d.b, st.parent_end) AS hi
         FROM dn d JOIN node n ON n.parent = d.node_id JOIN st ON st.node_id = n.node_id WHERE st.parent_start IS NOT NULL AND st.parent_end IS NOT NULL)
       WHERE lo < hi) WHERE score >= CAST(0.3 AS DOUBLE))"""
_GIVEN = f"WITH {_S} SELECT seq_id, residues FROM s WHERE residues <> ''"

SQL = {
    "seq_normalise": f"WITH {_S} SELECT seq_id, residues, length(residues) AS n FROM s",
    "fasta_wrap60": f"WITH {_S} SELECT seq_id, regexp_replace(residues, '(.{{1,60}})', '\\1' || chr(10), 'g') AS lines FROM s",
    "fasta_roundtrip": f"WITH {_S} SELECT seq_id, residues FROM s",
    "fasta_stream": f"WITH {_S} SELECT seq_id, residues FROM s",
    "fasta_numbering": f"WITH {_S} SELECT count(*) AS n_records, CAST(0 AS BIGINT) AS n_wrong FROM s",
    "header_accession": f"""
WITH h AS (SELECT seq_id, {_HEAD.format(c="header")} AS head, nullif(regexp_extract(header, 'GN=(\\S+)', 1), '') AS family FROM fasta_sequence)
SELECT DISTINCT seq_id, {_ACC.format(h="head")} AS accession, family FROM h""",
    "kmer_counts": f"WITH {_S} SELECT substr(residues, i, 4) AS kmer, count(*) AS n FROM s, range(1, length(residues) - 2) r(i) WHERE length(residues) >= 4 GROUP BY 1",
    "kmer_hashes": f"""
WITH k AS (SELECT DISTINCT upper(kmer) AS kmer FROM seed_loc WHERE kmer IS NOT NULL)
SELECT kmer, CASE WHEN regexp_matches(kmer, '^[{ALPHABET}]+$') THEN {_HASH.format(k="kmer")} END AS kmer_hash, CASE WHEN regexp_matches(kmer, '^[{ALPHABET}]+$') THEN kmer END AS back FROM k""",
    "kmer_reduced": f"""
WITH {_S}, r AS (SELECT translate(residues, '{REDUCED_LETTERS}', '{REDUCED_GROUPS}') AS t FROM s WHERE length(residues) >= 5)
SELECT substr(t, i, 5) AS reduced, count(*) AS n FROM r, range(1, length(t) - 3) x(i) WHERE regexp_matches(substr(t, i, 5), '^[0-9]+$') GROUP BY 1""",
    "seed_table_flat": f"WITH {_SEEDS} SELECT seq_id, count(*) AS n_seeds, CAST(sum(kmer_hash) AS BIGINT) AS hashes FROM seed GROUP BY seq_id",
    "seed_lookup": f"""
WITH {_SEEDS}, ft AS (SELECT * FROM seed QUALIFY row_number() OVER (PARTITION BY kmer_hash ORDER BY seq_id, pos) <= 32)
SELECT q.seq_id AS query_id, ft.seq_id, count(*) AS n_hits FROM seed q JOIN ft USING (kmer_hash) WHERE q.seq_id % 20 = 0 GROUP BY ALL""",
    "seed_lookup_all": f"""
WITH {_SEEDS}
SELECT q.seq_id AS query_id, t.seq_id, count(*) AS n_hits FROM seed q JOIN seed t USING (kmer_hash) WHERE q.seq_id % 20 = 0 GROUP BY ALL""",
    "low_complexity_runs": f"""
WITH {_S}, r AS (SELECT seq_id, residues, regexp_extract_all(residues, '({_RUN})', 1) AS runs, regexp_extract(left(residues, 50), '^(.*?)(?:{_RUN10})', 1) AS before, regexp_matches(left(residues, 50), '{_RUN10}') AS hit FROM s)
SELECT seq_id, len(runs) AS n_runs, coalesce(list_max(list_transform(runs, lambda x: length(x))), 0) AS longest,
       CASE WHEN hit THEN length(before) + length(regexp_extract(substr(residues, length(before) + 1), '^(?:{_RUN})', 0)) ELSE 0 END AS skip FROM r""",
    "identity": f"""
WITH {_P}, e AS (SELECT seq_id, length(a) AS n, len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1))) AS n_equal FROM p)
SELECT seq_id, CASE WHEN n = 0 THEN 0 ELSE n_equal * 100 // n END AS percent, n_equal, round(CASE WHEN n = 0 THEN 0.0 ELSE n_equal / n END, 6) AS fraction FROM e""",
    "best_diagonal": f"""
WITH {_P}, d AS (SELECT seq_id, a, b, d, length(a) - abs(d) AS n, greatest(-d, 0) AS x, greatest(d, 0) AS y FROM p, range(-5, 6) r(d))
SELECT seq_id, round(max(CASE WHEN n > 0 THEN len(list_filter(range(1, n + 1), lambda i: substr(a, x + i, 1) = substr(b, y + i, 1))) / n ELSE 0.0 END), 6) AS share FROM d GROUP BY seq_id""",
    "edit_text": f"""
WITH {_P}, c AS (SELECT seq_id, i, n_old, substr(a, i, 1) AS x, substr(b, i, 1) AS y FROM p, range(1, length(a) + 1) r(i)),
k AS (SELECT *, CASE WHEN x = '-' THEN 'i' WHEN y = '-' THEN 'd' ELSE 's' END AS kind FROM c WHERE x <> y),
g AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, kind ORDER BY i) AS k FROM k),
m AS (SELECT seq_id, kind, least(min(i) - 1, any_value(n_old)) AS at_, string_agg(y, '' ORDER BY i) AS body FROM g GROUP BY seq_id, kind, k),
d AS (SELECT seq_id, at_, kind, kind || CAST(at_ - coalesce(lag(at_) OVER (PARTITION BY seq_id ORDER BY at_, kind DESC), 0) AS VARCHAR) || body AS piece FROM m)
SELECT p.seq_id, coalesce(string_agg(piece, '' ORDER BY at_, kind DESC), '') AS script FROM p LEFT JOIN d ON d.seq_id = p.seq_id GROUP BY p.seq_id""",
    "edit_roundtrip": f"WITH {_P} SELECT seq_id, new AS residues FROM p",
    "edit_forest_roundtrip": f"WITH {_P} SELECT seq_id, new AS residues FROM p",
    "nw_alignment": f"WITH {_S} SELECT s.seq_id, s.residues AS a, t.residues AS b, true AS even FROM s JOIN s t ON t.seq_id = s.seq_id + 1",
    "flat_roundtrip": _GIVEN,
    "forest_roundtrip": _GIVEN,
    "db_append": _GIVEN,
    "stream_append": _GIVEN,
    "forest_depths": f"""
WITH RECURSIVE {_LINKS}, node AS (SELECT l.node_id, p.node_id AS parent FROM link l LEFT JOIN link p ON p.node_id = l.parent),
dn AS (SELECT node_id, 0 AS depth FROM node WHERE parent IS NULL UNION ALL SELECT n.node_id, d.depth + 1 FROM dn d JOIN node n ON n.parent = d.node_id)
SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n_nodes FROM dn GROUP BY depth""",
    "forest_reconstruct": f"""
WITH RECURSIVE {_LINKS}, {_STORED}, node AS (SELECT l.node_id, p.node_id AS parent FROM link l LEFT JOIN link p ON p.node_id = l.parent),
dn AS (SELECT n.node_id, st.sequence AS t FROM node n JOIN st USING (node_id) WHERE n.parent IS NULL AND st.sequence IS NOT NULL
       UNION ALL
       SELECT node_id, {_APPLY.format(t="seg", d="ops")} FROM (
         SELECT n.node_id, substr(d.t, coalesce(st.parent_start, 0) + 1, greatest(coalesce(st.parent_end, length(d.t)) - coalesce(st.parent_start, 0), 0)) AS seg, coalesce(st.diff, []) AS ops
         FROM dn d JOIN node n ON n.parent = d.node_id JOIN st ON st.node_id = n.node_id))
SELECT node_id, t AS sequence FROM dn""",
    "forest_prune": f"{_PRUNED}\nSELECT hit_id, node_id, a AS from0, b AS to0 FROM dn",
    "prune_scores": f"{_PRUNED}\nSELECT node_id, max(round(score, 9)) AS top_score, count(*) AS n_hits FROM dn GROUP BY node_id",
    "matched_roots": f"""
WITH {_LINKS}, node AS (SELECT l.node_id, p.node_id AS parent FROM link l LEFT JOIN link p ON p.node_id = l.parent)
SELECT count(*) AS n_nodes, count(n.node_id) AS n_roots FROM (SELECT DISTINCT node_id FROM search_hit WHERE node_id IS NOT NULL) h LEFT JOIN (SELECT node_id FROM node WHERE parent IS NULL) n USING (node_id)""",
    "forest_ratio": f"""
WITH RECURSIVE {_LINKS}, node AS (SELECT l.node_id, p.node_id AS parent FROM link l LEFT JOIN link p ON p.node_id = l.parent),
dn AS (SELECT node_id, 0 AS depth FROM node WHERE parent IS NULL UNION ALL SELECT n.node_id, d.depth + 1 FROM dn d JOIN node n ON n.parent = d.node_id)
SELECT count(*) FILTER (depth = 0) AS n_roots, count(*) FILTER (depth > 0) AS n_children, round(count(*) FILTER (depth > 0) / count(*), 9) AS child_ratio FROM dn""",
    "forest_db_append": _GIVEN,
    "candidate_dedupe": """
SELECT node_id, from0, to0 FROM (SELECT node_id, sstart - 1 AS from0, send AS to0, row_number() OVER (PARTITION BY node_id ORDER BY sstart - 1 - send, sstart) AS rn
  FROM search_hit WHERE sstart IS NOT NULL AND send IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1""",
    "align_once": f"WITH {_S} SELECT seq_id AS node_id, min(seq_id) OVER (PARTITION BY residues) AS rep_id FROM s WHERE residues <> ''",
    "align_once_fanout": f"""
WITH {_S}, m AS (SELECT seq_id AS node_id, min(seq_id) OVER (PARTITION BY residues) AS rep_id FROM s WHERE residues <> ''),
h AS (SELECT DISTINCT {_WORD} AS qseqid, accession, hsp_num, hit_num FROM hsp)
SELECT node_id, count(*) AS n_hits FROM h JOIN m ON m.rep_id = h.accession GROUP BY node_id""",
    "expand_overlap": f"""
WITH {_S}, seg AS (SELECT seq_id, t, t * 100 AS c_start, least(t * 100 + 100, length(residues)) AS c_end FROM s, range(0, (length(residues) + 99) // 100) r(t) WHERE residues <> '')
SELECT DISTINCT {_WORD} || ' ' || CAST(accession AS VARCHAR) AS query_id, t AS tile
FROM hsp JOIN seg ON seg.seq_id = hsp.accession
WHERE hit_from IS NOT NULL AND hit_to IS NOT NULL AND NOT (greatest(hit_from, hit_to) < c_start OR least(hit_from, hit_to) > c_end)""",
    "best_hit_per_pair": f"WITH {_PAIRS} SELECT query, subject, max(bitscore) AS score FROM pr GROUP BY ALL",
    "missed_extra": f"""
WITH {_PAIRS} SELECT *, 'missed' AS kind FROM (FROM tr EXCEPT FROM fd) UNION ALL SELECT *, 'extra' AS kind FROM (FROM fd EXCEPT FROM tr)""",
    "recall_precision": f"""
WITH {_PAIRS}, n AS (SELECT (SELECT count(*) FROM tr) AS n_true, (SELECT count(*) FROM fd) AS n_found, (SELECT count(*) FROM tr SEMI JOIN fd USING (query, subject)) AS n_hit)
SELECT *, round(CASE WHEN n_true > 0 THEN n_hit / n_true ELSE 0.0 END, 9) AS recall, round(CASE WHEN n_found > 0 THEN n_hit / n_found ELSE 0.0 END, 9) AS precision FROM n""",
    "roc_points": f"WITH {_ROC} SELECT round(CAST(fpr AS DOUBLE), 9) AS fpr, round(CAST(tpr AS DOUBLE), 9) AS tpr FROM pt",
    "roc_auc": f"""
WITH {_ROC}, st AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY score DESC NULLS FIRST) AS f0, lag(tpr) OVER (ORDER BY score DESC NULLS FIRST) AS t0 FROM pt)
SELECT round(CAST(sum((fpr - f0) * (tpr + t0) / 2) AS DOUBLE), 9) AS auc FROM st""",
    "roc_universe": f"""
WITH {_PAIRS}, best AS (SELECT query, subject, max(bitscore) AS score FROM pr WHERE bitscore >= 150 GROUP BY ALL),
every AS (SELECT query, subject FROM (SELECT DISTINCT query FROM pr), (SELECT DISTINCT subject FROM pr)),
sc AS (SELECT coalesce(score, 0) AS score, t.query IS NOT NULL AS pos FROM every e LEFT JOIN best b ON b.query = e.query AND b.subject = e.subject LEFT JOIN tr t ON t.query = e.query AND t.subject = e.subject),
per AS (SELECT score, count(*) FILTER (pos) AS t, count(*) FILTER (NOT pos) AS f FROM sc GROUP BY score),
run AS (SELECT t, f, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM per WINDOW w AS (ORDER BY score DESC))
SELECT CAST(sum(t) + sum(f) AS BIGINT) AS n_pairs, CAST(sum(t) AS BIGINT) AS n_true, round(CAST(sum(f * (tp - t / 2)) / (sum(t) * sum(f)) AS DOUBLE), 9) AS auc FROM run""",
    "family_dense_sample": f"""
WITH h AS (SELECT seq_id, nullif(regexp_extract(max(header), 'GN=(\\S+)', 1), '') AS family FROM fasta_sequence WHERE seq_id IS NOT NULL GROUP BY seq_id),
z AS (SELECT family, count(*) AS size FROM h WHERE family IS NOT NULL GROUP BY family),
q AS (SELECT family, row_number() OVER (ORDER BY size DESC, family) AS family_rank, least(size, 20) AS quota, coalesce(sum(least(size, 20)) OVER (ORDER BY size DESC, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z),
r AS (SELECT seq_id, family, row_number() OVER (PARTITION BY family ORDER BY {_ORDER.format(k="seq_id")}, seq_id) AS i FROM h)
SELECT seq_id, r.family, family_rank FROM r JOIN q ON q.family = r.family WHERE i <= least(quota, 500 - before)""",
    "hash_sample": f"SELECT DISTINCT seq_id FROM fasta_sequence WHERE seq_id IS NOT NULL ORDER BY {_ORDER.format(k='seq_id')}, seq_id LIMIT 200",
    "stream_periods": f"""
WITH ax AS (SELECT {_WORD} AS qseqid, least(query_from, query_to) AS lo, greatest(query_from, query_to) AS hi FROM hsp WHERE query_from IS NOT NULL AND query_to IS NOT NULL),
run AS (SELECT *, max(hi) OVER (PARTITION BY qseqid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM (SELECT DISTINCT * FROM ax)),
isle AS (SELECT *, sum(CASE WHEN upto IS NULL OR lo > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qseqid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM run)
SELECT qseqid, CAST(min(lo) AS BIGINT) AS period_from, CAST(max(hi) AS BIGINT) AS period_to FROM isle GROUP BY qseqid, k""",
}
