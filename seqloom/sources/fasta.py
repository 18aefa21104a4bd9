"""FASTA, search tables and search XML as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions.residue import drop_stops, mask, wrap

HSP_SCHEMA = "qseqid STRING, sseqid STRING, pident DOUBLE, length INT, mismatch INT, gapopen INT, qstart INT, qend INT, sstart INT, send INT, evalue DOUBLE, bitscore DOUBLE"


def _records(lines: DataFrame) -> DataFrame:
    """header, residues of text rows that were cut at line breaks before `>`."""
    record = F.regexp_replace("value", "^\\s*>", "")
    head = F.trim(F.regexp_extract(record, r"^([^\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s", "")
    return lines.filter(F.col("value").rlike(r"\S")).withColumn("header", head).withColumn("residues", body).drop("value")


def read_fasta(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """file, rec_no (from 0 in each file), header, residues. Gzip by suffix.

    Records are numbered by adding up what the read tasks hold, so a file of any size stays
    split. An empty file has no records. Text before the first `>` of a file is an error, unless
    strict is false: then it becomes a record whose header is its first line.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    if strict:
        # Only what stands before the first cut of a file can lack its mark.
        start = F.row_number().over(W.partitionBy("file", "block").orderBy("id")) == 1
        wrong = start & (F.col("block") == 0) & F.col("value").rlike(r"^\s*[^\s>]")
        raw = raw.withColumn("value", F.when(wrong, F.raise_error(F.concat(F.lit("text before the first > of "), "file"))).otherwise(F.col("value")))
    recs = _records(raw)
    counts = recs.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))  # a row per read split
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "block", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("id")) - 1
    return recs.withColumn("i", inside).join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("i")).cast("long").alias("rec_no"), "header", "residues")


def read_sequences(spark: SparkSession, path: str | list[str], masked: bool = True) -> DataFrame:
    """FASTA with upper-case residues without stop marks and, if masked, X for J, O and U."""
    clean = drop_stops("residues")
    return read_fasta(spark, path).withColumn("residues", mask(clean) if masked else clean)


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first n records in order of file and number."""
    return records.orderBy("file", "rec_no").limit(n)


def record(records: DataFrame, name: str) -> DataFrame:
    """Records whose header's first word is `name`; none if there is no such record."""
    return records.filter(F.regexp_extract("header", r"^\s*(\S*)", 1) == name)


def fasta_text(header: str = "header", residues: str = "residues", width: int = 60):
    """One record as text, without the last line break."""
    body = wrap(residues, width) if width else F.concat(F.coalesce(residues, F.lit("")), F.lit("\n"))
    return F.regexp_replace(F.concat(F.lit("> "), F.coalesce(F.col(header), F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))), r"\n$", "")


def write_fasta(df: DataFrame, path: str, width: int = 60, mode: str = "errorifexists", order_by: str | None = None) -> None:
    """A folder of FASTA files, one per task; rows keep the order they have in the tasks. order_by:
    a column in whose order the records stand in each file and from file to file."""
    if order_by:
        df = df.repartitionByRange(order_by).sortWithinPartitions(order_by)
    df.select(fasta_text(width=width).alias("value")).write.mode(mode).text(path)


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """header, residues of the FASTA files that arrive in a folder."""
    return _records(spark.readStream.option("lineSep", "\n>").text(folder))


def read_hsp_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated hits of 12 columns; rows that don't fit have nulls."""
    return spark.read.schema(HSP_SCHEMA).option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def read_search_xml(spark: SparkSession, path: str) -> DataFrame:
    """hit_num, accession, hsp_num, evalue, query_from, query_to, hit_from, hit_to of every
    Hit element of a search report."""
    hsp = "STRUCT<`Hsp_num`: INT, `Hsp_evalue`: DOUBLE, `Hsp_query-from`: INT, `Hsp_query-to`: INT, `Hsp_hit-from`: INT, `Hsp_hit-to`: INT>"
    schema = f"`Hit_num` INT, `Hit_accession` STRING, `Hit_hsps` STRUCT<`Hsp`: ARRAY<{hsp}>>"
    hits = spark.read.schema(schema).option("rowTag", "Hit").format("xml").load(path)
    rows = hits.select(F.col("Hit_num").alias("hit_num"), F.expr("try_cast(Hit_accession AS INT)").alias("accession"), F.explode("Hit_hsps.Hsp").alias("h"))
    return rows.select("hit_num", "accession", F.col("h.Hsp_num").alias("hsp_num"), F.col("h.Hsp_evalue").alias("evalue"), *[F.col(f"h.`Hsp_{a}-{b}`").alias(f"{a}_{b}") for a in ("query", "hit") for b in ("from", "to")])
