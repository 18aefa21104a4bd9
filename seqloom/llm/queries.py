"""Queries of the problems for training data of language models (3, 5, 6, 7, 8), with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import first_word
from seqloom.llm import leakage, mixing, spans, stuffing, topn
from seqloom.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "fasta_sequence"))


def p3_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "fasta_sequence")
    return spans.shared_amount(records, spans.shared_spans(records))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record without the spans that another record has too."""
    records = table(spark, sf_dir, "fasta_sequence")
    return spans.remove_spans(records, spans.shared_spans(records))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hit").select(first_word("qseqid").alias("qseqid"), "hit_id", "node_id", "evalue", "bitscore")
    return hits.filter("qseqid IS NOT NULL AND NOT isnan(evalue) AND evalue >= 0 AND bitscore IS NOT NULL AND hit_id IS NOT NULL")



def _order():
    return [F.asc("evalue"), F.desc("bitscore"), F.asc("node_id"), F.asc("hit_id")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(_hits(spark, sf_dir), "qseqid", _order(), "hit_id", 5).select("qseqid", "hit_id")


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(_hits(spark, sf_dir), "qseqid", _order(), "hit_id", 20).select("qseqid", "hit_id", F.col("rank").cast("long").alias("rank"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of every pair and where it stands: part and word of the message, word of the item."""
    return _leaks(spark, sf_dir)


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.item_report(_leaks(spark, sf_dir), table(spark, sf_dir, "eval_item"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that stay."""
    return leakage.remove_leaked(table(spark, sf_dir, "documents").select("doc_id"), _leaks(spark, sf_dir))


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.score_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_amount, p3_clean, p5_found, p5_ranked, p6_found, p6_places, p6_items, p6_clean, p7_chosen, p7_shares, p8_found, p8_scores)}

_CLEAN = r"""
raw AS (SELECT seq_id, max(upper(regexp_replace(coalesce(residues, ''), '[^A-Za-z]', '', 'g'))) AS t FROM fasta_sequence WHERE seq_id IS NOT NULL GROUP BY seq_id)"""
_SHARED = (
    _CLEAN
    + """,
gram AS (SELECT seq_id, i, hash(substr(t, i, 40)) AS h FROM raw, range(1, length(t) - 38) r(i)),
two AS (SELECT h FROM gram GROUP BY h HAVING min(seq_id) <> max(seq_id)),
at_ AS (SELECT seq_id, i FROM gram SEMI JOIN two USING (h)),
brk AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY seq_id ORDER BY i) + 40 THEN 0 ELSE 1 END AS nw FROM at_),
isle AS (SELECT *, sum(nw) OVER (PARTITION BY seq_id ORDER BY i) AS k FROM brk),
span AS (SELECT seq_id, CAST(min(i) AS INT) AS span_from, CAST(max(i) + 39 AS INT) AS span_to FROM isle GROUP BY seq_id, k)"""
)
_TOP = r"""
SELECT qseqid, hit_id{rank} FROM (
  SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY evalue, bitscore DESC, node_id, hit_id) AS rank
  FROM (SELECT DISTINCT regexp_extract(qseqid, '^\s*(\S*)', 1) AS qseqid, hit_id, node_id, evalue, bitscore FROM search_hit
        WHERE qseqid IS NOT NULL AND evalue IS NOT NULL AND NOT isnan(evalue) AND evalue >= 0 AND bitscore IS NOT NULL AND hit_id IS NOT NULL))
WHERE rank <= {n}"""

SQL = {
    "p3_found": f"WITH {_SHARED} SELECT * FROM span",
    "p3_amount": f"""
WITH {_SHARED}, per AS (SELECT seq_id, sum(span_to - span_from + 1) AS s FROM span GROUP BY seq_id)
SELECT seq_id, length(t) AS n_residues, CAST(coalesce(s, 0) AS BIGINT) AS n_shared FROM raw LEFT JOIN per USING (seq_id)""",
    "p3_clean": f"""
WITH {_SHARED}, cut AS (SELECT seq_id, span_from, span_to, coalesce(lag(span_to) OVER (PARTITION BY seq_id ORDER BY span_from), 0) AS done FROM span),
per AS (SELECT seq_id, string_agg(substr(t, done + 1, span_from - 1 - done), '' ORDER BY span_from) AS front, max(span_to) AS last FROM cut JOIN raw USING (seq_id) GROUP BY seq_id),
whole AS (SELECT seq_id, t, CASE WHEN front IS NULL THEN t ELSE front || substr(t, last + 1) END AS residues FROM raw LEFT JOIN per USING (seq_id))
SELECT seq_id, residues, length(t) - length(residues) AS n_removed FROM whole""",
    "p5_found": _TOP.format(rank="", n=5),
    "p5_ranked": _TOP.format(rank=", rank", n=20),
}
