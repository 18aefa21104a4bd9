"""Parent-child links to full hierarchies, by heavy-path decomposition.

Links form trees of any depth and width, and may run in circles. The steps:

1. `resolve_links`: one parent per node, from its own row or from the lists of children.
2. Circles are separated by pointer doubling over the nodes that have not come to an end yet:
   after round k a pointer is 2^k steps ahead, so rounds grow with the logarithm of the
   depth. When a round ends no pointer, all that are left lead into circles.
3. Every acyclic node prefers its child with the largest subtree (ties: smallest id). These
   edges cut the trees into chains; a node has a chain and a place on it. Chains hang on
   chains, at most log2(n) deep: the segments (chain, last place) of a path.
   Trees of at most TREE_NODES nodes are labelled whole, many in one task, level by level;
   larger ones by rounds of joins: sizes and chains by doubling, then chains upon chains.
4. Preorder numbers: a chain is one run of numbers, a subtree one interval.

No step brings an unbounded group into one task: hot parents are joined by a broadcast of
at most 1 / HOT_SHARE rows, sums over siblings are combined before they are shuffled, and
siblings are numbered in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.operators.skew import hot_join, hot_keys, hot_values
from seqloom.session import Stage

#: Siblings are numbered within blocks of about this many, then the blocks.
SIBLING_BLOCK = 10_000
#: Nodes of the largest tree that one task labels; larger ones take rounds of joins.
TREE_NODES = 200_000
#: Nodes that a task labels at once: whole small trees, up to about so many.
BATCH_NODES = 100_000
#: Places of a chain that are kept in one row when paths are put together.
CHAIN_BLOCK = 64


@dataclass
class Hierarchy:
    """nodes: node_id, head, pos, root_id, depth, n_below, segments, stored, ends_well of the
    acyclic nodes; loops: node_id, on_cycle, loop_id of the others. `segments` is the path as
    (chain, last position) from the top; `stored` the depth as the table has it; ends_well
    tells whether the node at the top (root_id) is a root."""

    links: DataFrame
    nodes: DataFrame
    loops: DataFrame
    stage: Stage


def resolve_links(tree: DataFrame) -> DataFrame:
    """node_id, parent (null if none is known), is_root, depth: the latest row of each node.

    Rows without node_id are dropped; of equal loaded_at the larger row in the order
    (parent_id, is_root, depth, children) counts, a null loaded_at is oldest. The parent is
    parent_id or, if that is null and is_root is false, the (smallest) node whose latest
    row lists this one as a child.
    """
    row = F.struct("loaded_at", "parent_id", "is_root", "depth", "children")
    latest = tree.filter("node_id IS NOT NULL").groupBy("node_id").agg(F.max(row).alias("r")).select("node_id", "r.parent_id", "r.is_root", "r.depth", "r.children")
    named = latest.select(F.col("node_id").alias("namer"), F.explode("children").alias("node_id")).filter("node_id IS NOT NULL")
    named = named.groupBy("node_id").agg(F.min("namer").alias("namer"))
    own = latest.select("node_id", "parent_id", "is_root", "depth")
    lost = own.filter("parent_id IS NULL AND is_root = false").join(named, "node_id", "left")
    known = own.filter("NOT (parent_id IS NULL AND coalesce(is_root = false, false))")
    cols = ["node_id", "parent", "is_root", "depth"]
    return known.withColumnRenamed("parent_id", "parent").select(cols).unionByName(lost.withColumnRenamed("namer", "parent").select(cols))


def _follow(stage: Stage, links: DataFrame, total: int) -> tuple[DataFrame, DataFrame, int]:
    """(ended, looped, number of looped). ended: node_id, end_id, dist, ends_well of the nodes
    whose parents come to an end; looped: node_id, jump, low of those that lead into a circle,
    with the smallest node_id of the steps up to `jump`. Only nodes that have not come to an
    end are carried from round to round."""
    none = lambda t: F.lit(None).cast(t)
    parts = [links.filter("parent IS NULL").select("node_id", F.col("node_id").alias("end_id"), F.lit(0).cast("long").alias("dist"), "ends_well")]
    going = links.filter("parent IS NOT NULL").select("node_id", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("dist"), F.col("node_id").alias("low"))
    left, k = going.count(), 0
    while left:
        ended = reduce(DataFrame.unionByName, parts)
        ahead = ended.select(F.col("node_id").alias("jump"), "end_id", "ends_well", F.col("dist").alias("dist2"), none("long").alias("jump2"), none("long").alias("low2"))
        ahead = ahead.unionByName(going.select("jump", "dist", "low", "node_id").select(F.col("node_id").alias("jump"), none("long").alias("end_id"), none("boolean").alias("ends_well"), F.col("dist").alias("dist2"), F.col("jump").alias("jump2"), F.col("low").alias("low2")))
        moved = hot_join(going, ahead, "jump", hot_keys(going, "jump", left, total), "inner")
        step = stage.save(moved.select("node_id", F.col("jump2").alias("jump"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), "end_id", "ends_well"), f"step{k}")
        parts.append(step.filter("end_id IS NOT NULL").select("node_id", "end_id", "dist", "ends_well"))
        going = step.filter("end_id IS NULL").select("node_id", "jump", "dist", "low")
        before, left, k = left, going.count(), k + 1
        if left == before:
            break
    return reduce(DataFrame.unionByName, parts), going.select("node_id", "jump", "low"), left


def _sizes(stage: Stage, nodes: DataFrame, total: int) -> DataFrame:
    """node_id, size of acyclic nodes (node_id, parent): after round k a node knows the number
    of nodes less than 2^k steps below it."""
    state, k = nodes.select("node_id", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size")), 0
    while True:
        arrived = stage.save(state.filter("jump IS NOT NULL").groupBy("jump").agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("n")), f"arrived{k}")
        if arrived.isEmpty():
            return state.select("node_id", "size")
        hot = hot_values(arrived, "jump", "n", total)
        moved = hot_join(state, state.select(F.col("node_id").alias("jump"), F.col("jump").alias("jump2")), "jump", hot, "left")
        gained = arrived.select(F.col("jump").alias("node_id"), "more")
        state = stage.save(moved.join(gained, "node_id", "left").select("node_id", F.col("jump2").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), f"sizes{k}")
        stage.drop(f"arrived{k}", f"sizes{k - 1}")
        k += 1


def _loops(stage: Stage, state: DataFrame, n: int) -> DataFrame:
    """Nodes that lead into a circle: whether they lie on it, and its smallest node_id. state:
    node_id, jump, low as `_follow` leaves them; n is the number of its rows.

    f^m maps the set of m-th ancestors onto itself exactly when all of them lie on circles,
    and window minima that no longer change have seen their whole circle.
    """
    if not n:
        return state.sparkSession.createDataFrame([], "node_id BIGINT, on_cycle BOOLEAN, loop_id BIGINT")
    seen, k = None, 0
    while True:
        now = state.agg(F.count_distinct("jump"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, k = now, k + 1
        ahead = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        state = stage.save(hot_join(state, ahead, "jump", hot_keys(state, "jump", n, n), "inner").select("node_id", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low")), f"loop{k}")
        stage.drop(f"loop{k - 1}")
    on = state.select("jump").distinct().join(state.select(F.col("node_id").alias("jump"), F.col("low").alias("loop_id")), "jump")
    told = hot_join(state.select("node_id", "jump"), on, "jump", hot_keys(state, "jump", n, n), "inner").select("node_id", "loop_id")
    mark = on.select(F.col("jump").alias("node_id"), F.lit(True).alias("on_cycle"))
    return told.join(mark, "node_id", "left").select("node_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "loop_id")


def _rank_chains(stage: Stage, links: DataFrame, heavy: DataFrame) -> DataFrame:
    """node_id, head, pos: list ranking along heavy edges, on which no key repeats."""
    state = links.join(heavy.select("node_id", F.col("parent").alias("above")), "node_id", "left")
    state = stage.save(state.select("node_id", F.coalesce("above", "node_id").alias("head"), F.when(F.col("above").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("above").isNull().alias("done")), "chain0")
    k = 0
    while not state.filter("NOT done").isEmpty():
        going, ready = state.filter("NOT done"), state.filter("done")
        ahead = state.select(F.col("node_id").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"))
        moved = going.join(ahead, "head").select("node_id", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("done2").alias("done"))
        k += 1
        state = stage.save(ready.unionByName(moved), f"chain{k}")
        stage.drop(f"chain{k - 1}")
    return state.select("node_id", "head", "pos")


def _climb(stage: Stage, chains: DataFrame, total: int) -> DataFrame:
    """Chains upon chains: head, root_id, base (depth of the head), above (segments of the
    path over it). chains: head, up_head, up_pos (null at the top)."""
    seg = F.array(F.struct(F.col("up_head").alias("chain"), F.col("up_pos").alias("upto")))
    top = F.col("up_head").isNull()
    state = chains.select("head", F.coalesce("up_head", "head").alias("root_id"), F.when(top, 0).otherwise(F.col("up_pos") + 1).alias("base"), F.when(top, F.expr("CAST(array() AS ARRAY<STRUCT<chain: BIGINT, upto: BIGINT>>)")).otherwise(seg).alias("above"), top.alias("done"))
    state, k = stage.save(state, "climb0"), 0
    while not state.filter("NOT done").isEmpty():
        going, ready = state.filter("NOT done"), state.filter("done")
        hot = hot_keys(going, "root_id", total, total)
        ahead = state.select(F.col("head").alias("root_id"), F.col("root_id").alias("root2"), F.col("base").alias("base2"), F.col("above").alias("above2"), F.col("done").alias("done2"))
        moved = hot_join(going, ahead, "root_id", hot, "inner").select("head", F.col("root2").alias("root_id"), (F.col("base") + F.col("base2")).alias("base"), F.concat("above2", "above").alias("above"), F.col("done2").alias("done"))
        k += 1
        state = stage.save(ready.unionByName(moved), f"climb{k}")
        stage.drop(f"climb{k - 1}")
    return state.drop("done")


def _chains(node: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
    """(up, size, head, pos, level) of the nodes of whole trees, given in order of depth: row of
    the parent (-1 at the top), nodes of the subtree, row of the chain's head, place on the
    chain, chains above it. Each level of depth is one step for all trees together."""
    n = len(node)
    rows, by_id = np.arange(n), np.argsort(node)
    up = np.full(n, -1)
    below = depth > 0
    up[below] = by_id[np.searchsorted(node, parent[below], sorter=by_id)]
    ends = np.searchsorted(depth, np.arange(int(depth[-1]) + 2))
    levels = [slice(a, b) for a, b in zip(ends[1:], ends[2:])]
    size = np.ones(n, np.int64)
    for at in reversed(levels):
        np.add.at(size, up[at], size[at])
    kids = rows[below]
    kids = kids[np.lexsort((node[kids], -size[kids], up[kids]))]
    first = np.ones(len(kids), bool)
    first[1:] = up[kids[1:]] != up[kids[:-1]]
    heavy = np.full(n, -1)
    heavy[up[kids[first]]] = kids[first]
    head, pos, level = rows.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in levels:
        p = up[at]
        on = heavy[p] == rows[at]
        head[at], pos[at], level[at] = np.where(on, head[p], rows[at]), np.where(on, pos[p] + 1, 0), level[p] + ~on
    return up, size, head, pos, level


def _segments(node: np.ndarray, up: np.ndarray, head: np.ndarray, pos: np.ndarray, level: np.ndarray) -> pa.Array:
    """Per node its path as (chain, last place) from the top; one step per level of chains."""
    offsets = np.concatenate([[0], np.cumsum(level + 1)])
    chain, upto = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
    slot, at = offsets[1:] - 1, np.arange(len(node))
    while len(at):
        chain[slot], upto[slot] = node[head[at]], pos[at]
        nxt = up[head[at]]
        slot, at = slot[nxt >= 0] - 1, nxt[nxt >= 0]
    pairs = pa.StructArray.from_arrays([pa.array(chain), pa.array(upto)], ["chain", "upto"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


_PASSED = ["stored", "ends_well"]
_SEGMENTS = "ARRAY<STRUCT<chain: BIGINT, upto: BIGINT>>"
_NODES = f"node_id BIGINT, head BIGINT, pos BIGINT, root_id BIGINT, depth BIGINT, n_below BIGINT, segments {_SEGMENTS}, stored INT, ends_well BOOLEAN"


def _label(with_segments: bool):
    """Labels whole trees. Rows come sorted by tree; a task takes about BATCH_NODES at once."""

    def label(rows: pa.Table) -> pa.RecordBatch:
        depth = rows.column("dist").to_numpy()
        order = np.argsort(depth, kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        node, parent = rows.column("node_id").to_numpy(), rows.column("parent").fill_null(0).to_numpy()
        up, size, head, pos, level = _chains(node, parent, depth[order])
        segments = _segments(node, up, head, pos, level) if with_segments else pa.nulls(len(node), pa.list_(pa.struct([("chain", pa.int64()), ("upto", pa.int64())])))
        cols = [pa.array(x) for x in (node, node[head], pos, rows.column("end_id").to_numpy(), depth[order], size - 1)]
        return pa.RecordBatch.from_arrays([*cols, segments, *[rows.column(c).combine_chunks() for c in _PASSED]], ["node_id", "head", "pos", "root_id", "depth", "n_below", "segments", *_PASSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(map(len, held)) >= BATCH_NODES:
                rows = pa.concat_tables(held)
                end = rows.column("end_id").to_numpy()
                whole = int(np.searchsorted(end, end[-1]))  # where the last tree begins
                if whole:
                    yield label(rows.slice(0, whole))
                held = [rows.slice(whole)]
        if held and sum(map(len, held)):
            yield label(pa.concat_tables(held))

    return run


def _large_trees(stage: Stage, nodes: DataFrame) -> DataFrame:
    """The same for trees of any size, by rounds of joins. nodes: node_id, parent, stored, ends_well."""
    nodes = stage.save(nodes, "large")
    total = nodes.count()
    sized = stage.save(nodes.join(_sizes(stage, nodes, total), "node_id"), "sized")
    best = F.max(F.struct("size", (-F.col("node_id")).alias("minus"))).alias("best")
    heavy = sized.filter("parent IS NOT NULL").groupBy("parent").agg(best).select("parent", (-F.col("best.minus")).alias("node_id"))
    placed = stage.save(_rank_chains(stage, sized.select("node_id"), heavy), "placed")
    tops = stage.save(placed.filter("pos = 0").select(F.col("node_id").alias("head")).join(sized.select(F.col("node_id").alias("head"), F.col("parent").alias("up")), "head"), "tops")
    hot = hot_keys(tops, "up", total, total)
    where = placed.select(F.col("node_id").alias("up"), F.col("head").alias("up_head"), F.col("pos").alias("up_pos"))
    climbed = stage.save(_climb(stage, hot_join(tops, where, "up", hot, "left").select("head", "up_head", "up_pos"), total), "climbed")
    full = hot_join(placed, climbed, "head", hot_keys(placed, "head", total, total), "inner").join(sized.select("node_id", "size", *_PASSED), "node_id")
    own = F.array(F.struct(F.col("head").alias("chain"), F.col("pos").alias("upto")))
    return full.select("node_id", "head", "pos", "root_id", (F.col("base") + F.col("pos")).alias("depth"), (F.col("size") - 1).alias("n_below"), F.concat("above", own).alias("segments"), *_PASSED)


def decompose(tree: DataFrame, name: str = "tree", segments: bool = True) -> Hierarchy:
    """Heavy-path decomposition of all trees of a node table (see the module's text).

    Empty tables give empty results; extra columns are ignored; a node that names itself as
    its parent is a circle of one. Without `segments` those of small trees are null.
    """
    stage = Stage(tree.sparkSession, name)
    links = stage.save(resolve_links(tree), "resolved")
    total = links.count()
    there = links.select(F.col("node_id").alias("parent"), F.lit(True).alias("known"))
    named = hot_join(links, there, "parent", hot_keys(links, "parent", total, total), "left")
    well = F.col("parent").isNull() & F.coalesce("is_root", F.lit(False))
    links = stage.save(named.select("node_id", F.when(F.col("known"), F.col("parent")).alias("parent"), F.col("depth").alias("stored"), well.alias("ends_well")), "links")
    stage.drop("resolved")

    ended, looped, n_looped = _follow(stage, links, total)
    loops = stage.save(_loops(stage, looped, n_looped), "loops")
    placed = links.select("node_id", "parent", "stored").join(ended, "node_id")
    large = None
    if total > TREE_NODES:
        big = stage.save(ended.groupBy("end_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TREE_NODES), "big")
        if not big.isEmpty():
            marked = stage.save(hot_join(placed, big, "end_id", hot_values(big, "end_id", "n", total), "left"), "marked")
            placed, large = marked.filter("n IS NULL").drop("n"), marked.filter("n IS NOT NULL")
    rows = placed.select("node_id", "parent", "end_id", "dist", *_PASSED)
    nodes = rows.repartition("end_id").sortWithinPartitions("end_id").mapInArrow(_label(segments), _NODES)
    if large is not None:
        nodes = nodes.unionByName(_large_trees(stage, large.select("node_id", "parent", *_PASSED)))
    return Hierarchy(links, stage.save(nodes, "nodes"), loops, stage)


def anomalies(h: Hierarchy) -> DataFrame:
    """node_id, anomaly, top_id: cycle, below_cycle, dangling or wrong_depth, at most one a node."""
    looped = h.loops.select("node_id", F.when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("anomaly"), F.col("loop_id").alias("top_id"))
    kind = F.when(~F.col("ends_well"), "dangling").when(F.col("stored").isNull() | (F.col("stored") != F.col("depth")), "wrong_depth")
    return looped.unionByName(h.nodes.select("node_id", kind.alias("anomaly"), F.col("root_id").alias("top_id")).filter("anomaly IS NOT NULL"))


def numbered(h: Hierarchy) -> DataFrame:
    """The nodes with `pre` and `last`: descendants of a node are exactly the nodes of its
    root with pre in (pre, last]. Along a chain numbers run on, so only chain heads need an
    offset: behind their parent, its heavy child's subtree and their earlier siblings."""
    stage, nodes = h.stage, h.nodes
    parent = h.links.select("node_id", "parent")
    heads = nodes.filter("pos = 0 AND depth > 0").select("node_id", (F.col("n_below") + 1).alias("size")).join(parent, "node_id")
    blocks = heads.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / SIBLING_BLOCK).alias("n_blocks"), F.count(F.lit(1)).alias("n"))
    hot = hot_values(blocks, "parent", "n", heads.count())
    cut = hot_join(heads, blocks.select("parent", "n_blocks"), "parent", hot, "inner").withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("n_blocks")))
    within = cut.withColumn("inner", F.sum("size").over(W.partitionBy("parent", "block").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)))
    sums = cut.groupBy("parent", "block").agg(F.sum("size").alias("bs"))
    sums = sums.select("parent", "block", F.sum("bs").over(W.partitionBy("parent").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("outer"))
    at = within.join(sums, ["parent", "block"]).select("node_id", "parent", (F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))).alias("offset"))
    # The heavy child of a parent is the next node of its chain.
    chain_next = nodes.filter("pos > 0").select("head", (F.col("pos") - 1).alias("pos"), (F.col("n_below") + 1).alias("heavy_size"))
    up = nodes.select(F.col("node_id").alias("parent"), F.col("head"), "pos").join(chain_next, ["head", "pos"], "left").select("parent", F.col("head").alias("up_head"), F.col("pos").alias("up_pos"), F.coalesce("heavy_size", F.lit(0)).alias("heavy_size"))
    rel = hot_join(at, up, "parent", hot, "inner").select(F.col("node_id").alias("chain"), (F.col("up_pos") + 1 + F.col("heavy_size") + F.col("offset")).alias("jump"))
    rel = stage.save(rel, "offsets")
    # A chain's start is the sum of the offsets of the chains that its path runs through.
    chains = nodes.filter("pos = 0").select(F.col("node_id").alias("head"), F.explode(F.col("segments.chain")).alias("chain"))
    hot = hot_values(chains.groupBy("chain").agg(F.count(F.lit(1)).alias("n")), "chain", "n", nodes.count())
    starts = hot_join(chains, rel, "chain", hot, "left").groupBy("head").agg(F.coalesce(F.sum("jump"), F.lit(0)).alias("start"))
    hot = hot_values(nodes.groupBy("head").agg(F.count(F.lit(1)).alias("n")), "head", "n", nodes.count())
    out = hot_join(nodes, stage.save(starts, "starts"), "head", hot, "inner")
    return out.withColumn("pre", F.col("start") + F.col("pos")).withColumn("last", F.col("pre") + F.col("n_below")).drop("start")


def paths(h: Hierarchy) -> DataFrame:
    """node_id, path: all node ids from the root down to the node, from its chain segments.
    Chains are kept in blocks of CHAIN_BLOCK places, so a path meets only those that it runs
    through, and blocks that many paths run through are joined as hot keys."""
    key = lambda chain, block: F.concat_ws(":", F.col(chain).cast("string"), F.col(block).cast("string")).alias("key")
    member = h.nodes.select("head", F.expr(f"pos div {CHAIN_BLOCK}").alias("block"), F.struct("pos", "node_id").alias("x"))
    blocks = member.groupBy("head", "block").agg(F.array_sort(F.collect_list("x")).alias("m")).select(key("head", "block"), F.col("m.node_id").alias("ids"))
    seg = h.nodes.select("node_id", F.posexplode("segments").alias("ord", "s")).select("node_id", "ord", "s.*")
    seg = seg.select("node_id", "ord", "chain", "upto", F.explode(F.sequence(F.lit(0), F.expr(f"upto div {CHAIN_BLOCK}"))).alias("block"))
    met = seg.select("node_id", "ord", "block", key("chain", "block"), F.least(F.col("upto") - F.col("block") * CHAIN_BLOCK + 1, F.lit(CHAIN_BLOCK)).cast("int").alias("take"))
    n = h.nodes.count()
    steps = hot_join(met, blocks, "key", hot_keys(met, "key", n, n), "inner").select("node_id", F.struct("ord", "block", F.slice("ids", F.lit(1), F.col("take")).alias("ids")).alias("x"))
    return steps.groupBy("node_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("node_id", F.flatten("x.ids").alias("path"))


def descendants(h: Hierarchy) -> DataFrame:
    """ancestor_id, node_id, distance: every pair; the paths read the other way round."""
    p = paths(h).select("node_id", F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor_id"))
    return p.filter("ancestor_id <> node_id").select("ancestor_id", "node_id", (F.col("n") - 1 - F.col("i")).cast("long").alias("distance"))
