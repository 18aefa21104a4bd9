"""Compressed sequence databases: folders of tables in the usual file system of Spark.

Every table has a folder per batch. A batch that is written again, after a failure, replaces
its own folders and sees nothing of what it had written before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import compress, search


def _write_params(spark: SparkSession, path: str, mode: str, params: compress.Params, **more) -> None:
    conf = json.dumps(asdict(params) | more)
    spark.createDataFrame([(conf,)], "value STRING").coalesce(1).write.mode(mode).text(f"{path}/params")


def _read_params(spark: SparkSession, path: str, *more: str) -> tuple[compress.Params, dict]:
    conf = json.loads(spark.read.text(f"{path}/params").first()[0])
    own = {k: conf.pop(k) for k in more}
    unknown = set(conf) - set(compress.Params.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return compress.Params(**conf), own


def _batches(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return (rows if without is None else rows.filter(F.col("batch") != without)).drop("batch")


@dataclass
class SequenceDatabase:
    """coarse, segments, seeds and params of a folder. A read-only database can't be appended to."""

    spark: SparkSession
    path: str
    params: compress.Params
    read_only: bool = False

    @classmethod
    def create(cls, seqs: DataFrame, path: str, params: compress.Params = compress.Params(), read_only: bool = False, overwrite: bool = False) -> SequenceDatabase:
        spark, mode = seqs.sparkSession, "overwrite" if overwrite else "errorifexists"
        coarse, segments = compress.compress_flat(seqs, params)
        for name, rows in (("coarse", coarse), ("segments", segments), ("seeds", search.seed_index(search.coarse_ids(coarse), search.SearchParams()))):
            rows.withColumn("batch", F.lit("first")).write.mode(mode).partitionBy("batch").parquet(f"{path}/{name}")
            # A table without rows has no folder of its own to tell its columns.
            rows.limit(0).write.mode("overwrite").parquet(f"{path}/{name}/batch=none")
        _write_params(spark, path, mode, params, read_only=read_only)
        return cls(spark, path, params, read_only)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SequenceDatabase:
        params, own = _read_params(spark, path, "read_only")
        return cls(spark, path, params, own["read_only"])

    @property
    def coarse(self) -> DataFrame:
        return _batches(self.spark, f"{self.path}/coarse")

    @property
    def segments(self) -> DataFrame:
        return _batches(self.spark, f"{self.path}/segments")

    @property
    def seeds(self) -> DataFrame:
        """The seed index of the representatives, for searches with the usual parameters."""
        return _batches(self.spark, f"{self.path}/seeds")

    def search(self, queries: DataFrame, p: search.SearchParams | None = None) -> DataFrame:
        """Coarse search with the kept seeds, expansion, fine search."""
        return search.search_compressed(queries, self.coarse, self.segments, self.sequences(), p, seeds=self.seeds if p is None else None)

    def representatives(self, coarse_ids: DataFrame) -> DataFrame:
        """The representatives of the ids in column coarse_id."""
        return self.coarse.join(coarse_ids.select("coarse_id").distinct(), "coarse_id", "left_semi")

    def get(self, ids: DataFrame) -> DataFrame:
        """The sequences of the ids in column seq_id; only their segments are read further."""
        return compress.decompress(self.coarse, self.segments.join(ids.select("seq_id").distinct(), "seq_id", "left_semi"))

    def links(self, coarse_ids: DataFrame) -> DataFrame:
        """coarse_id, seq_id, c_start, c_end: which sequences use a representative, and where."""
        wanted = coarse_ids.select("coarse_id").distinct()
        return self.segments.join(wanted, "coarse_id", "left_semi").select("coarse_id", "seq_id", "c_start", "c_end")

    def append(self, seqs: DataFrame, batch: str | None = None) -> None:
        """Adds sequences whose ids aren't in the database yet; others are left as they are. A
        batch of a name that was written before replaces what that one had added."""
        if self.read_only:
            raise PermissionError(f"{self.path} is read-only")
        batch = batch or f"b{uuid.uuid4().hex}"
        known = _batches(self.spark, f"{self.path}/coarse", batch)
        new = seqs.join(_batches(self.spark, f"{self.path}/segments", batch).select("seq_id").distinct(), "seq_id", "left_anti")
        coarse, segments = compress.compress_flat(new, self.params, known=known)
        for name, rows in (("coarse", coarse), ("seeds", search.seed_index(search.coarse_ids(coarse), search.SearchParams())), ("segments", segments)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def sequences(self) -> DataFrame:
        """seq_id, residues as they were given."""
        return compress.decompress(self.coarse, self.segments)

    def residues(self) -> int:
        """Residues of all sequences, from the tables; the size that e-values refer to."""
        spans = self.segments.select(F.expr("c_end - c_start + aggregate(diff, 0, (s, m) -> s + length(m.residues) - m.end + m.start)").alias("n"))
        return spans.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass
class ForestDatabase:
    """nodes and params of a folder: a compressed forest that sequences can be added to."""

    spark: SparkSession
    path: str
    params: compress.Params

    @classmethod
    def create(cls, seqs: DataFrame, path: str, params: compress.Params = compress.Params(), overwrite: bool = False) -> ForestDatabase:
        spark, mode = seqs.sparkSession, "overwrite" if overwrite else "errorifexists"
        nodes = compress.compress_forest(seqs, params)
        nodes.withColumn("batch", F.lit("first")).write.mode(mode).partitionBy("batch").parquet(f"{path}/nodes")
        nodes.limit(0).write.mode("overwrite").parquet(f"{path}/nodes/batch=none")
        _write_params(spark, path, mode, params)
        return cls(spark, path, params)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ForestDatabase:
        return cls(spark, path, _read_params(spark, path)[0])

    @property
    def nodes(self) -> DataFrame:
        return _batches(self.spark, f"{self.path}/nodes")

    def append(self, seqs: DataFrame, batch: str | None = None) -> None:
        """As SequenceDatabase.append; new nodes may hang on any that are there."""
        batch = batch or f"b{uuid.uuid4().hex}"
        known = _batches(self.spark, f"{self.path}/nodes", batch)
        new = seqs.join(known.select("seq_id").distinct(), "seq_id", "left_anti")
        compress.compress_forest(new, self.params, known=known).write.mode("overwrite").parquet(f"{self.path}/nodes/batch={batch}")

    def sequences(self) -> DataFrame:
        """seq_id, residues as they were given."""
        return compress.restore_forest(self.nodes, self.params.max_depth)
