"""Overlapping and gapped intervals: an ordered map of disjoint intervals per entity.

An entity is a key and a tile of the axis. Its state is an ordered map of disjoint intervals
and of the gaps between them; an insertion finds the overlapped ones by binary search, merges
them and updates the gaps. Rows reach the map in three steps:

1. Tasks put together the rows they hold (blocks of Arrow batches, one numpy pass each), so
   that what is shuffled are disjoint intervals per entity and block.
2. While an entity may come from more than FAN blocks, salted parts of it are put together
   by further tasks: a tree of merges, so that no task gets more than FAN maps of one tile.
3. Sorted by entity, the rest is inserted into the entity's map, one entity after the other;
   the map, bounded by the tile's width, is all that a task keeps.

Tiles are stitched by their first and last covered positions, one row each.
`streaming.jobs.interval_changes` keeps the same map in streaming state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.session import Stage

#: Positions per tile: a map of one tile holds at most TILE / 2 disjoint intervals.
TILE = 65_536
#: Rows that a task puts together at once; what it passes on stays right wherever a block ends.
BLOCK_ROWS = 200_000
#: Bytes of input that stand for a block when the depth of the merge tree is chosen.
BLOCK_BYTES = 4_000_000
#: Blocks from which one task takes the maps of an entity.
FAN = 64

_ENDS = "lo BIGINT, hi BIGINT"


class IntervalMap:
    """Disjoint closed integer intervals in order, and the gaps between them; intervals that
    touch are one."""

    __slots__ = ("ends", "gap_ends", "gap_starts", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = starts or [], ends or []
        self.gap_starts, self.gap_ends = [e + 1 for e in self.ends[:-1]], [s - 1 for s in self.starts[1:]]

    def insert(self, lo: int, hi: int) -> None:
        starts, ends = self.starts, self.ends
        i = bisect_left(ends, lo - 1)  # the first that reaches lo or touches it
        j = bisect_right(starts, hi + 1, i)  # the first beyond hi
        if i < j:
            lo, hi = min(lo, starts[i]), max(hi, ends[j - 1])
        starts[i:j], ends[i:j] = [lo], [hi]
        # Gap g lies between intervals g and g + 1: those on both sides and between change.
        before, after = i > 0, i + 1 < len(starts)
        a, b = i - 1 if before else 0, j if after else max(j - 1, 0)
        left, right = ([ends[i - 1] + 1], [lo - 1]) if before else ([], [])
        if after:
            left, right = [*left, hi + 1], [*right, starts[i + 1] - 1]
        self.gap_starts[a:b], self.gap_ends[a:b] = left, right

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.gap_starts, self.gap_ends))


def _codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """One number per row; rows have the same exactly if all keys are the same (null too)."""
    code = np.zeros(len(table), np.int64)
    for k in keys:
        own = table.column(k).combine_chunks()
        if not pa.types.is_integer(own.type) or own.null_count:
            own = pc.fill_null(pc.dictionary_encode(own).indices, -1)
        values = own.to_numpy(zero_copy_only=False).astype(np.int64)
        values = np.unique(values, return_inverse=True)[1]
        code = np.unique(code * (int(values.max(initial=0)) + 1) + values, return_inverse=True)[1]
    return code


def merge_runs(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): disjoint runs per code, in order of code and place; row is one of the run's."""
    if not len(code):
        return np.zeros(0, np.int64), lo, hi
    order = np.lexsort((lo, code))
    c, a, b = code[order], lo[order], hi[order]
    # Ends as ranks, raised code by code, so that the running maximum starts anew with each.
    ends = np.unique(b, return_inverse=True)
    upto = np.maximum.accumulate(ends[1] + c * len(ends[0])) - c * len(ends[0])
    reach = ends[0][upto]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (a[1:] > reach[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(c)) - 1
    return order[first], a[first], reach[last]


def _block_runs(table: pa.Table, keys: list[str]) -> pa.Table:
    row, lo, hi = merge_runs(_codes(table, keys), table.column("lo").to_numpy(), table.column("hi").to_numpy())
    cols = table.select(keys).take(pa.array(row))
    return pa.table([*cols.columns, pa.array(lo), pa.array(hi)], names=[*keys, "lo", "hi"])


def _put_together(keys: list[str]):
    """Runs of the rows of a task; it holds on to them while that makes them fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            held.append(pa.table(b.columns, names=b.schema.names))  # without what Spark says of nulls
            rows += len(b)
            if rows >= BLOCK_ROWS:
                runs = _block_runs(pa.concat_tables(held), keys)
                if 2 * len(runs) > BLOCK_ROWS:
                    yield from runs.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = [runs], len(runs)
        if rows:
            yield from _block_runs(pa.concat_tables(held), keys).to_batches()

    return run


def _to_maps(keys: list[str]):
    """Rows sorted by entity: per entity its map as lists. A batch that ends within an entity
    leaves its map open for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state = IntervalMap()
        schema = None

        def rows(done: list[tuple[tuple, IntervalMap]]) -> pa.RecordBatch:
            cols = [pa.array([k[i] for k, _ in done], schema.field(c).type) for i, c in enumerate(keys)]
            lists = [pa.array([getattr(m, f) for _, m in done], pa.list_(pa.int64())) for f in ("starts", "ends", "gap_starts", "gap_ends")]
            return pa.RecordBatch.from_arrays([*cols, *lists], names=[*keys, "starts", "ends", "gap_starts", "gap_ends"])

        for b in batches:
            schema = b.schema
            table = pa.Table.from_batches([b])
            change = np.zeros(len(b), bool)
            for c in _codes_in_order(table, keys):
                change[1:] |= c[1:] != c[:-1]
            code = np.cumsum(change)
            row, lo, hi = merge_runs(code, table.column("lo").to_numpy(), table.column("hi").to_numpy())
            cut = np.flatnonzero(np.diff(code[row], prepend=-1)).tolist()
            names = list(zip(*(table.column(k).take(pa.array(row[cut])).to_pylist() for k in keys)))
            los, his, done = lo.tolist(), hi.tolist(), []
            for name, a, z in zip(names, cut, [*cut[1:], len(los)]):
                if name == key:
                    for x, y in zip(los[a:z], his[a:z]):
                        state.insert(x, y)
                else:
                    if key is not None:
                        done.append((key, state))
                    key, state = name, IntervalMap(los[a:z], his[a:z])
            if done:
                yield rows(done)
        if key is not None:
            yield rows([(key, state)])

    return run


def _codes_in_order(table: pa.Table, keys: list[str]) -> Iterator[np.ndarray]:
    for k in keys:
        yield _codes(table, [k])


def _blocks(df: DataFrame) -> int:
    """Blocks that a table may have, by the size that Spark expects; FAN^2 if it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return FAN**2 if size >= 2**60 else ceil(size / BLOCK_BYTES)


def tile_maps(df: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """keys, tile, starts, ends, gap_starts, gap_ends: the map of every key and tile.

    Rows with a null end don't count; a null in a key is a key of its own; ends may be
    swapped; repeated rows change nothing. Extra columns are ignored.
    """
    for k in ("lo", "hi", "tile", "salt"):
        if k in keys:
            raise ValueError(f"a key may not be called {k}")
    rows = df.select(*keys, F.least(lo, hi).cast("long").alias("lo"), F.greatest(lo, hi).cast("long").alias("hi"), lo.isNull().alias("no1"), hi.isNull().alias("no2"))
    rows = rows.filter("NOT no1 AND NOT no2").select(*keys, "lo", "hi", F.expr(f"floor(lo / {TILE})").alias("t1"), F.expr(f"floor(hi / {TILE})").alias("t2"))
    rows = rows.select(*keys, "lo", "hi", F.explode(F.sequence("t1", "t2")).alias("tile"))
    rows = rows.select(*keys, "tile", F.greatest("lo", F.col("tile") * TILE).alias("lo"), F.least("hi", F.col("tile") * TILE + TILE - 1).alias("hi"))
    by, kinds = [*keys, "tile"], dict(rows.dtypes)
    typed = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    merged = rows.mapInArrow(_put_together(by), f"{typed}, {_ENDS}")
    blocks = _blocks(df)
    while blocks > FAN:
        blocks = ceil(blocks / FAN)
        merged = merged.withColumn("salt", F.pmod(F.xxhash64("lo", "hi"), F.lit(blocks))).repartition(*by, "salt").drop("salt").mapInArrow(_put_together(by), f"{typed}, {_ENDS}")
    lists = ", ".join(f"{c} ARRAY<BIGINT>" for c in ("starts", "ends", "gap_starts", "gap_ends"))
    return merged.repartition(*by).sortWithinPartitions(*by).mapInArrow(_to_maps(by), f"{typed}, {lists}")


def gaps(df: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """keys, gap_from, gap_to: maximal uncovered runs between covered positions of a key."""
    maps = Stage(df.sparkSession, "gaps").save(tile_maps(df, keys, lo, hi).select(*keys, "tile", F.col("starts")[0].alias("first"), F.element_at("ends", -1).alias("last"), "gap_starts", "gap_ends"), "maps")
    pairs = F.arrays_zip(F.col("gap_starts").alias("gap_from"), F.col("gap_ends").alias("gap_to"))
    inner = maps.filter(F.size("gap_starts") > 0).select(*keys, F.explode(pairs).alias("g")).select(*keys, "g.*")
    # One row per tile: at most 2^32 / TILE of them for a key on an integer axis.
    before = F.lag("last").over(W.partitionBy(*keys).orderBy("tile"))
    outer = maps.select(*keys, (before + 1).alias("gap_from"), (F.col("first") - 1).alias("gap_to")).filter("gap_from <= gap_to")
    return inner.unionByName(outer)


def periods(df: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """keys, lo, hi: maximal covered runs of a key. Only runs that reach the edge of a tile
    can go on in the next one; they alone are joined in a window."""
    maps = Stage(df.sparkSession, "periods").save(tile_maps(df, keys, lo, hi).drop("gap_starts", "gap_ends"), "maps")
    pairs = F.arrays_zip(F.col("starts").alias("lo"), F.col("ends").alias("hi"))
    return stitch(maps.select(*keys, "tile", F.explode(pairs).alias("x")).select(*keys, "tile", "x.*"), keys)


def stitch(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi of keys, tile, lo, hi: runs that go on over the edge of a tile as one."""
    at_edge = (F.col("lo") == F.col("tile") * TILE) | (F.col("hi") == F.col("tile") * TILE + TILE - 1)
    whole = tiles.filter(~at_edge).select(*keys, "lo", "hi")
    w = W.partitionBy(*keys).orderBy("lo")
    split = tiles.filter(at_edge).withColumn("new", (~(F.lag("hi").over(w) + 1).eqNullSafe(F.col("lo"))).cast("long"))
    runs = split.withColumn("run", F.sum("new").over(w)).groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return whole.unionByName(runs.select(*keys, "lo", "hi"))
