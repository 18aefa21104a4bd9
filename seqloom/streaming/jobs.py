"""Structured Streaming: interval maps in keyed state, and appends to a database."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.operators.intervals import TILE, IntervalMap
from seqloom.session import Stage
from seqloom.sources.database import SequenceDatabase


def interval_changes(stream: DataFrame, key: str) -> DataFrame:
    """key, tile, lo, hi, sign: after each micro-batch the intervals that a tile's map has won
    (1) or lost (-1).

    stream: key (a text), lo, hi with lo <= hi. The state of a tile is its ordered map, at
    most TILE / 2 disjoint intervals; an insertion is a binary search.
    """
    tiles = stream.select(key, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / TILE), F.floor(F.col("hi") / TILE))).alias("tile"))
    cut = tiles.select(key, "tile", F.greatest("lo", F.col("tile") * TILE).alias("lo"), F.least("hi", F.col("tile") * TILE + TILE - 1).alias("hi"))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap(*map(list, state.get)) if state.exists else IntervalMap()
        before = set(zip(held.starts, held.ends))
        for pdf in batches:
            for lo, hi in zip(pdf["lo"].tolist(), pdf["hi"].tolist()):
                held.insert(lo, hi)
        state.update((held.starts, held.ends))
        after = set(zip(held.starts, held.ends))
        rows = [(*x, 1) for x in after - before] + [(*x, -1) for x in before - after]
        yield pd.DataFrame({key: group[0], "tile": group[1], **dict(zip(("lo", "hi", "sign"), zip(*rows)))} if rows else {c: [] for c in (key, "tile", "lo", "hi", "sign")})

    return cut.groupBy(key, "tile").applyInPandasWithState(run, f"{key} STRING, tile BIGINT, lo BIGINT, hi BIGINT, sign INT", "starts ARRAY<BIGINT>, ends ARRAY<BIGINT>", "update", GroupStateTimeout.NoTimeout)


def stream_intervals(stream: DataFrame, key: str, stage: Stage) -> DataFrame:
    """Runs the stream to its end; key, tile, lo, hi of all maps, from the changes that the
    batches wrote. A batch that is run again writes its folder anew."""
    spark, out = stream.sparkSession, f"{stage.root}/changes"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = interval_changes(stream, key).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{stage.root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy(key, "tile", "lo", "hi").agg(F.sum("sign").alias("sign")).filter("sign > 0").select(key, "tile", "lo", "hi")


def stream_append(stream: DataFrame, db: SequenceDatabase, progress: str) -> None:
    """Appends every micro-batch of seq_id, residues to the database, as a batch of its own; one
    that is run again replaces what it had written."""

    def add(batch: DataFrame, number: int) -> None:
        db.append(batch.groupBy("seq_id").agg(F.max("residues").alias("residues")), f"s{number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def stream_table(stream: DataFrame, stage: Stage) -> DataFrame:
    """Runs the stream to its end; its rows as a table, each once."""
    out = f"{stage.root}/rows"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{stage.root}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def parquet_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, a few files a batch."""
    path = f"{sf_dir}/{name}.parquet"
    # A pattern serves a folder of files and a single file alike.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parque[t]")
