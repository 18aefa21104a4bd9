"""Queries of the general training-data problems (1, 2 and 4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import first_word
from seqloom.operators import hierarchy, intervals, weighted
from seqloom.session import Stage
from seqloom.sources.tables import table

#: A key of seed_loc is hot from this share of all locations on.
CASE_SHARE = 0.01


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.anomalies(hierarchy.decompose(table(spark, sf_dir, "tree_node"), segments=False))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy.decompose(table(spark, sf_dir, "tree_node"))
    nodes = hierarchy.numbered(h)
    return nodes.select("node_id", "root_id", "depth", "n_below", F.size("segments").cast("long").alias("n_segments"), "pre", "last")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy.decompose(table(spark, sf_dir, "tree_node"))
    return hierarchy.paths(h).select("node_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.decompose(table(spark, sf_dir, "tree_node")))


def _seed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.value_frequencies(table(spark, sf_dir, "seed_loc"), "kmer_hash", ["seq_ind", "res_ind"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "seeds")
    per = stage.save(weighted.per_key_counts(_seed_values(spark, sf_dir), "kmer_hash"), "per_key")
    total = per.agg(F.sum("n_values")).first()[0] or 0
    return per.filter(F.col("n_values") >= CASE_SHARE * total).select("kmer_hash")


def p2_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key: locations, loads, records, and the record with most locations."""
    per_record = _seed_values(spark, sf_dir).groupBy("kmer_hash", "seq_ind").agg(F.count(F.lit(1)).alias("locs"), F.sum("weight").alias("loads"))
    return per_record.groupBy("kmer_hash").agg(
        F.sum("locs").alias("n_locations"), F.sum("loads").alias("n_loads"), F.count(F.lit(1)).alias("n_records"),
        F.max("locs").alias("top_locations"), F.min_by("seq_ind", F.struct(-F.col("locs"), F.col("seq_ind"))).alias("top_record"),
    )


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key the 10th, 50th and 90th percentile of the place of its distinct locations."""
    per_place = _seed_values(spark, sf_dir).groupBy("kmer_hash", "res_ind").agg(F.count(F.lit(1)).alias("weight"))
    got = weighted.weighted_percentiles(per_place, "kmer_hash", "res_ind", [0.1, 0.5, 0.9])
    return got.select("kmer_hash", "q", F.col("res_ind").cast("long").alias("res_ind"))


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hsp = table(spark, sf_dir, "hsp").select(first_word("qseqid").alias("qseqid"), "accession", "query_from", "query_to", "hit_from", "hit_to")
    pair = lambda axis, a, b: F.struct(F.lit(axis).alias("axis"), F.col(a).alias("e1"), F.col(b).alias("e2"))
    both = F.array(pair("query", "query_from", "query_to"), pair("hit", "hit_from", "hit_to"))
    return hsp.select("qseqid", "accession", F.explode(both).alias("x")).select("qseqid", "accession", "x.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = intervals.gaps(_axes(spark, sf_dir), ["qseqid", "accession", "axis"], F.col("e1"), F.col("e2"))
    return got.select("qseqid", "accession", "axis", "gap_from", "gap_to")


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = intervals.periods(_axes(spark, sf_dir), ["qseqid", "accession", "axis"], F.col("e1"), F.col("e2"))
    return got.select("qseqid", "accession", "axis", F.col("lo").alias("period_from"), F.col("hi").alias("period_to"))


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_paths, p1_descendants, p2_found, p2_per_key, p2_percentiles, p4_found, p4_periods)}

_LINKS = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY loaded_at DESC NULLS LAST) AS rn
           FROM tree_node WHERE node_id IS NOT NULL) WHERE rn = 1),
named AS (SELECT child, min(node_id) AS namer FROM (SELECT node_id, unnest(children) AS child FROM latest) GROUP BY child),
link AS (SELECT l.node_id, l.is_root, l.depth,
         CASE WHEN l.parent_id IS NULL AND l.is_root = false THEN n.namer ELSE l.parent_id END AS parent
         FROM latest l LEFT JOIN named n ON n.child = l.node_id)"""
#: Every node's walk up; a pair of start and place is met once, so circles end.
_WALK = (
    _LINKS
    + """,
walk AS (SELECT node_id AS start, node_id AS here, parent AS nxt, 0 AS steps, [node_id] AS seen FROM link
         UNION ALL
         SELECT w.start, l.node_id, l.parent, w.steps + 1, list_append(w.seen, l.node_id)
         FROM walk w JOIN link l ON l.node_id = w.nxt WHERE NOT list_contains(w.seen, l.node_id)),
tip AS (SELECT start, arg_max(here, steps) AS top, max(steps) AS steps, arg_max_null(nxt, steps) AS nxt, arg_max(seen, steps) AS seen FROM walk GROUP BY start)"""
)
_SOUND = "(t.nxt IS NULL OR NOT list_contains(t.seen, t.nxt))"
_AXES = """
ax AS (SELECT regexp_extract(qseqid, '^\\s*(\\S*)', 1) AS qseqid, accession, 'query' AS axis, least(query_from, query_to) AS lo, greatest(query_from, query_to) AS hi
       FROM hsp WHERE query_from IS NOT NULL AND query_to IS NOT NULL
       UNION ALL
       SELECT regexp_extract(qseqid, '^\\s*(\\S*)', 1), accession, 'hit', least(hit_from, hit_to), greatest(hit_from, hit_to)
       FROM hsp WHERE hit_from IS NOT NULL AND hit_to IS NOT NULL),
run AS (SELECT *, max(hi) OVER (PARTITION BY qseqid, accession, axis ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM (SELECT DISTINCT * FROM ax))"""
_SEEDS = """
freq AS (SELECT kmer_hash, seq_ind, res_ind, count(*) AS weight FROM seed_loc
         WHERE kmer_hash IS NOT NULL AND seq_ind IS NOT NULL AND res_ind IS NOT NULL GROUP BY ALL)"""

SQL = {
    "p1_found": f"""
WITH RECURSIVE {_WALK}
SELECT t.start AS node_id,
       CASE WHEN {_SOUND} THEN CASE WHEN coalesce(r.is_root, false) AND r.parent IS NULL THEN 'wrong_depth' ELSE 'dangling' END
            WHEN t.nxt = t.start THEN 'cycle' ELSE 'below_cycle' END AS anomaly,
       CASE WHEN {_SOUND} THEN t.top ELSE list_min(list_slice(t.seen, list_position(t.seen, t.nxt), len(t.seen))) END AS top_id
FROM tip t JOIN link r ON r.node_id = t.top JOIN link s ON s.node_id = t.start
WHERE NOT ({_SOUND} AND coalesce(r.is_root, false) AND r.parent IS NULL AND s.depth IS NOT DISTINCT FROM t.steps)""",
    "p1_nodes": f"""
WITH RECURSIVE {_WALK},
sound AS (SELECT w.start, w.here, w.nxt, w.steps FROM walk w JOIN tip t ON t.start = w.start WHERE {_SOUND}),
size AS (SELECT here AS node_id, count(*) AS size FROM sound GROUP BY here),
kid AS (SELECT s.start AS node_id, CASE WHEN z.node_id IS NOT NULL THEN s.nxt END AS parent, size.size FROM sound s JOIN size ON size.node_id = s.start LEFT JOIN size z ON z.node_id = s.nxt WHERE s.steps = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY size DESC, node_id) AS rn, max(size) OVER (PARTITION BY parent) AS top FROM kid WHERE parent IS NOT NULL),
jump AS (SELECT node_id, rn > 1 AS light, CASE WHEN rn = 1 THEN 1 ELSE 1 + top + coalesce(sum(size) OVER (PARTITION BY parent, rn = 1 ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS far FROM best)
SELECT s.start AS node_id, t.top AS root_id, CAST(max(t.steps) AS BIGINT) AS depth, max(size.size) - 1 AS n_below, CAST(1 + count(*) FILTER (light) AS BIGINT) AS n_segments,
       CAST(coalesce(sum(far), 0) AS BIGINT) AS pre, CAST(coalesce(sum(far), 0) + max(size.size) - 1 AS BIGINT) AS last
FROM sound s JOIN tip t ON t.start = s.start JOIN size ON size.node_id = s.start LEFT JOIN jump ON jump.node_id = s.here GROUP BY s.start, t.top""",
    "p1_paths": f"""
WITH RECURSIVE {_WALK}
SELECT start AS node_id, array_to_string(list_reverse(seen), '/') AS path FROM tip t WHERE {_SOUND}""",
    "p1_descendants": f"""
WITH RECURSIVE {_WALK}
SELECT w.here AS ancestor_id, w.start AS node_id, CAST(w.steps AS BIGINT) AS distance
FROM walk w JOIN tip t ON t.start = w.start WHERE {_SOUND} AND w.here <> w.start""",
    "p2_found": f"""
WITH {_SEEDS}
SELECT kmer_hash FROM freq GROUP BY kmer_hash HAVING count(*) >= {CASE_SHARE} * (SELECT count(*) FROM freq)""",
    "p2_per_key": f"""
WITH {_SEEDS}, rec AS (SELECT kmer_hash, seq_ind, count(*) AS locs, sum(weight) AS loads FROM freq GROUP BY ALL)
SELECT kmer_hash, CAST(sum(locs) AS BIGINT) AS n_locations, CAST(sum(loads) AS BIGINT) AS n_loads, count(*) AS n_records,
       max(locs) AS top_locations, min(seq_ind) FILTER (locs = most) AS top_record
FROM (SELECT *, max(locs) OVER (PARTITION BY kmer_hash) AS most FROM rec) GROUP BY kmer_hash""",
    "p2_percentiles": f"""
WITH {_SEEDS}, ranked AS (
  SELECT kmer_hash, res_ind, row_number() OVER (PARTITION BY kmer_hash ORDER BY res_ind) AS rn, count(*) OVER (PARTITION BY kmer_hash) AS n FROM freq)
SELECT kmer_hash, q, CAST(min(res_ind) AS BIGINT) AS res_ind
FROM ranked, (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS q) WHERE rn >= greatest(ceil(q * n), 1) GROUP BY kmer_hash, q""",
    "p4_found": f"""
WITH {_AXES}
SELECT qseqid, accession, axis, CAST(upto + 1 AS BIGINT) AS gap_from, CAST(lo - 1 AS BIGINT) AS gap_to FROM run WHERE lo > upto + 1""",
    "p4_periods": f"""
WITH {_AXES}, isle AS (SELECT *, sum(CASE WHEN upto IS NULL OR lo > upto + 1 THEN 1 ELSE 0 END)
       OVER (PARTITION BY qseqid, accession, axis ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM run)
SELECT qseqid, accession, axis, CAST(min(lo) AS BIGINT) AS period_from, CAST(max(hi) AS BIGINT) AS period_to FROM isle GROUP BY qseqid, accession, axis, k""",
}
