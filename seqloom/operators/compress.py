"""Sequence compression as rounds of joins.

Every sequence is cut into segments. A segment is a range of a representative text and an
edit script; representative texts are what matched nothing before. The greedy scan of one
sequence after another is replaced by linear-time clustering: a place of a minimizer looks at
the first HITS places that have it, so candidates are at most HITS times the minimizers.
Candidates are grown with gaps and verified once; what follows joins ids and places:

* forest: segments refer to segments, which makes them nodes of trees at most max_depth
  deep, found level by level;
* flat: the same with one level, so what refers to a part that is no representative itself
  becomes one.

Both restore every sequence exactly; `decompress` joins segments and representatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions import align, edits
from seqloom.functions.minimizers import batch_minimizers, variety
from seqloom.functions.residue import rule_matrix
from seqloom.operators.skew import hot_join, hot_values
from seqloom.session import Stage


@dataclass(frozen=True)
class Params:
    """min_length: residues of the shortest match; identity, deep_identity: least percent of
    equal columns for a match to a root or to a node below; hits: places that a seed looks at;
    gapped, ungapped, run: residues of a gapped step, positions in which the next run of equal
    residues is looked for, and length of such a run; reach: residues beyond the outermost
    shared seeds of a diagonal into which a match may grow; variety: different residues that a
    seed must have, as runs and short repeats match everywhere."""

    seed: int = 7
    min_length: int = 40
    identity: int = 50
    deep_identity: int = 60
    max_depth: int = 5
    hits: int = 32
    gapped: int = 25
    ungapped: int = 10
    run: int = 4
    reach: int = 2_000
    variety: int = 4


_BLOCKS = "ARRAY<STRUCT<q: BIGINT, r: BIGINT, n: BIGINT>>"
_MATCH = f"seq_id BIGINT, ref_id BIGINT, q_from BIGINT, q_to BIGINT, r_from BIGINT, r_to BIGINT, same BIGINT, percent BIGINT, blocks {_BLOCKS}"
_BLOCK_TYPE = pa.list_(pa.struct([("q", pa.int64()), ("r", pa.int64()), ("n", pa.int64())]))
_MATCH_SCHEMA = pa.schema([*[(c, pa.int64()) for c in ("seq_id", "ref_id", "q_from", "q_to", "r_from", "r_to", "same", "percent")], ("blocks", _BLOCK_TYPE)])


def _match_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 9
    blocks = pa.array([[dict(zip("qrn", x)) for x in b] for b in cols[8]], _BLOCK_TYPE)
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:8]], blocks], schema=_MATCH_SCHEMA)


def candidate_links(seqs: DataFrame, stage: Stage, p: Params) -> DataFrame:
    """seq_id, ref_id, diagonal, lo, hi: stretches of shared minimizers on one diagonal of a
    sequence and one of smaller id, among the first `hits` places of each minimizer. Spark
    keeps so many per minimizer in the map tasks, so a frequent one doesn't meet in one task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            owner, pos, h = batch_minimizers(texts, p.seed, p.min_length // 2)
            rich = variety(texts, owner, pos, p.seed) >= p.variety
            owner, pos, h = owner[rich], pos[rich], h[rich]
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(owner)), pa.array(pos)], ["anchor", "seq_id", "pos"])

    found = stage.save(seqs.select("seq_id", "residues").mapInArrow(find, "anchor BIGINT, seq_id BIGINT, pos BIGINT"), "anchors")
    per = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("seq_id").alias("low"), F.max("seq_id").alias("high")).filter("low < high")
    per = stage.save(per.select("anchor", "n"), "shared")
    hot = hot_values(per, "anchor", "n", per.agg(F.sum("n")).first()[0] or 0)
    rank = F.row_number().over(W.partitionBy("anchor").orderBy("seq_id", "pos"))
    first = found.withColumn("rank", rank).filter(F.col("rank") <= p.hits).join(per.select("anchor"), "anchor", "left_semi")
    first = stage.save(first.select("anchor", F.col("seq_id").alias("ref_id"), F.col("pos").alias("ref_pos")), "first")
    met = hot_join(found, first, "anchor", hot, "inner").filter("ref_id < seq_id AND seq_id >= 0")
    links = met.groupBy("seq_id", "ref_id", (F.col("pos") - F.col("ref_pos")).alias("diagonal")).agg(F.min("pos").alias("lo"), (F.max("pos") + p.seed).alias("hi"))
    return stage.save(links, "links")


def grow_both_ways(q: str, r: str, at: int, d: int, matrix: np.ndarray, p: Params) -> tuple[int, int, int, int, list[tuple[int, int, int]]]:
    """(q_from, q_to, r_from, r_to, pieces without a gap) around the seed at q[at] and r[at - d]."""
    grow = lambda a, b: align.gapped_growth(a, b, matrix, p.gapped, p.ungapped, p.run, p.identity)
    i, j, after = grow(q[at:], r[at - d :])
    u, v, before = grow(q[:at][::-1], r[: at - d][::-1])
    blocks = [(at - x - n, at - d - y - n, n) for x, y, n in before[::-1]]
    for x, y, n in after:
        x, y = at + x, at - d + y
        if blocks and (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) == (x, y):
            x, y, n = blocks[-1][0], blocks[-1][1], blocks.pop()[2] + n
        blocks.append((x, y, n))
    return at - u, at + i, at - d - v, at - d + j, blocks


def verified_matches(seqs: DataFrame, links: DataFrame, p: Params) -> DataFrame:
    """seq_id, ref_id, q_from, q_to, r_from, r_to, same, percent, blocks: candidates grown with
    gaps as far as they are alike, that reach the length and identity asked for. `blocks` are
    the parts without a gap; `same` counts equal columns. What is sent is a window around the
    shared seeds of both texts, not the texts."""
    window = lambda text, lo, hi: F.col(text).substr((F.greatest(lo - p.reach, F.lit(0)) + 1).cast("int"), (hi + p.reach - F.greatest(lo - p.reach, F.lit(0))).cast("int"))
    own = links.join(seqs.select("seq_id", "residues"), "seq_id").select("seq_id", "ref_id", "diagonal", "lo", "hi", window("residues", F.col("lo"), F.col("hi")).alias("q"))
    refs = seqs.select(F.col("seq_id").alias("ref_id"), F.col("residues").alias("ref"))
    full = own.join(refs, "ref_id").withColumn("r", window("ref", F.col("lo") - F.col("diagonal"), F.col("hi") - F.col("diagonal")))
    matrix = rule_matrix()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for seq, ref, d, lo, hi, q, r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                q0, r0 = max(lo - p.reach, 0), max(lo - d - p.reach, 0)
                upto = lo
                for at in (lo, hi - p.seed):  # both ends, if growth from the first stops between
                    if at < upto:
                        continue
                    a, b, x, y, blocks = grow_both_ways(q, r, at - q0, d - q0 + r0, matrix, p)
                    upto = b + q0
                    cols = (b - a) + (y - x) - sum(n for *_, n in blocks)
                    same = sum(q[i] == r[j] for u, v, n in blocks for i, j in zip(range(u, u + n), range(v, v + n)))
                    if b - a >= p.min_length and y > x and 100 * same >= p.identity * cols:
                        out.append((seq, ref, a + q0, b + q0, x + r0, y + r0, same, 100 * same // cols, [(u + q0, v + r0, n) for u, v, n in blocks]))
            if out:
                yield _match_batch(out)

    return full.select("seq_id", "ref_id", "diagonal", "lo", "hi", "q", "r").mapInArrow(run, _MATCH)


def _on_ref(blocks: list[tuple[int, int, int]], x: int) -> int:
    """The place of the reference that stands beside place x of the sequence."""
    q, r, n = max((b for b in blocks if b[0] <= x), default=blocks[0])
    return r + min(max(x - q, 0), n)


def choose(matches: DataFrame, least: int) -> DataFrame:
    """Of each sequence's matches those that don't overlap, the one with most equal columns
    first (ties: smallest reference, then place); a match that overlaps is cut down to what is
    left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for seq, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                taken: list[tuple[int, int]] = []
                for m in sorted(found, key=lambda m: (-m["same"], m["ref_id"], m["q_from"], m["r_from"])):
                    a, b = m["q_from"], m["q_to"]
                    for x, y in taken:
                        if a < y and x < b:
                            a, b = (y, b) if b - y >= x - a else (a, x)
                    if b - a < least or any(a < y and x < b for x, y in taken):
                        continue
                    blocks = [(x["q"], x["r"], x["n"]) for x in m["blocks"]]
                    lo, hi = (m["r_from"], m["r_to"]) if (a, b) == (m["q_from"], m["q_to"]) else (_on_ref(blocks, a), _on_ref(blocks, b))
                    kept = [(u + max(a - u, 0), v + max(a - u, 0), min(u + n, b) - max(u, a)) for u, v, n in blocks if u < b and a < u + n]
                    if lo < hi and kept:
                        taken.append((a, b))
                        out.append((seq, m["ref_id"], a, b, lo, hi, m["same"], m["percent"], kept))
            if out:
                yield _match_batch(out)

    per = matches.groupBy("seq_id").agg(F.collect_list(F.struct(*_MATCH_SCHEMA.names[1:])).alias("m"))
    return per.mapInArrow(run, _MATCH)


def _pieces(seqs: DataFrame, matches: DataFrame) -> DataFrame:
    """seq_id, q_from, q_to, ref_id, r_from: matches, and what lies between them (no ref)."""
    per = matches.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("q_from", "q_to", "ref_id", "r_from"))).alias("m"))
    all_ = seqs.select("seq_id", F.length("residues").cast("long").alias("n")).join(per, "seq_id", "left")
    m = F.coalesce("m", F.expr("CAST(array() AS ARRAY<STRUCT<q_from: BIGINT, q_to: BIGINT, ref_id: BIGINT, r_from: BIGINT>>)"))
    none = F.lit(None).cast("long")
    hole = lambda a, b: F.struct(a.alias("q_from"), b.alias("q_to"), none.alias("ref_id"), none.alias("r_from"))
    holes = F.transform(m, lambda x, i: hole(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(m, i - 1)["q_to"]), x["q_from"]))
    last = hole(F.coalesce(F.get(m, F.size(m) - 1)["q_to"], F.lit(0).cast("long")), F.col("n"))
    every = F.filter(F.concat(m, holes, F.array(last)), lambda x: x["q_from"] < x["q_to"])
    return all_.select("seq_id", F.explode(every).alias("x")).select("seq_id", "x.*")


def compress_flat(seqs: DataFrame, p: Params = Params(), stage: Stage | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(coarse, segments) of seq_id, residues (one row per id, none below 0). coarse: coarse_id,
    residues; segments: seq_id, q_from, coarse_id, c_start, c_end, diff. Empty texts have no
    segment. known: representatives (coarse_id, residues) of a database that this batch is
    appended to; they are matched before the batch itself, and only new ones are returned."""
    stage = stage or Stage(seqs.sparkSession, "flat")
    new = seqs.select("seq_id", "residues").filter("seq_id IS NOT NULL AND residues <> ''")
    names = None
    if known is not None:  # below 0, so that they come before all new ids
        names = stage.save(known.select((F.lit(-1) - F.pmod(F.xxhash64("coarse_id"), F.lit(2**62))).alias("ref_id"), "coarse_id", "residues"), "known")
        new = new.unionByName(names.select(F.col("ref_id").alias("seq_id"), "residues"))
    seqs = stage.save(new, "seqs")
    nodes = stage.save(_texts(seqs, _levels(seqs, stage, p, 1)).filter("seq_id >= 0"), "nodes")
    own = F.col("own")
    coarse = stage.save(nodes.filter("ref_id IS NULL").select(_name("seq_id", "q_from").alias("coarse_id"), own.alias("residues")), "coarse")
    empty = F.expr(f"CAST(array() AS {edits.SCRIPT})")
    literal = nodes.filter("ref_id IS NULL").select("seq_id", "q_from", _name("seq_id", "q_from").alias("coarse_id"), F.lit(0).cast("long").alias("c_start"), F.length(own).cast("long").alias("c_end"), empty.alias("diff"))
    cols = ["seq_id", "q_from", "coarse_id", F.col("parent_start").alias("c_start"), F.col("parent_end").alias("c_end"), edits.build("aligned_old", "aligned_own").alias("diff")]
    linked = _aligned(nodes.filter("ref_id IS NOT NULL"))
    if names is None:
        linked = linked.withColumn("coarse_id", _name("ref_id", "p_from"))
    else:
        linked = linked.join(names.select("ref_id", "coarse_id"), "ref_id", "left").withColumn("coarse_id", F.coalesce("coarse_id", _name("ref_id", "p_from")))
    return coarse, stage.save(literal.unionByName(linked.select(*cols)), "segments")


def _name(seq: str, at: str) -> Column:
    return F.concat_ws(":", F.col(seq).cast("string"), F.col(at).cast("string"))


def decompress(coarse: DataFrame, segments: DataFrame) -> DataFrame:
    """seq_id, residues: segments in order, each its range of the representative, edited. A
    segment of a representative that isn't there is an error."""
    found = F.when(F.col("residues").isNull(), F.raise_error(F.concat(F.lit("no representative "), F.coalesce("coarse_id", F.lit("null"))))).otherwise(F.col("residues"))
    range_ = F.col("text").substr((F.col("c_start") + 1).cast("int"), (F.col("c_end") - F.col("c_start")).cast("int"))
    piece = segments.join(coarse, "coarse_id", "left").withColumn("text", found).select("seq_id", "q_from", edits.apply("diff", range_).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("q_from", "piece")))
    return piece.groupBy("seq_id").agg(ordered.alias("p")).select("seq_id", F.array_join(F.col("p.piece"), "").alias("residues"))


def _levels(seqs: DataFrame, stage: Stage, p: Params, max_depth: int, known: DataFrame | None = None) -> DataFrame:
    """seq_id, q_from, q_to, ref_id, p_from, parent_start, parent_end, depth: the segments of all
    sequences; roots have no ref_id. A match refers to the node of the next higher level that
    holds most of its range, and is cut down to that. known: nodes (seq_id, q_from, q_to, depth)
    of sequences below 0, which can be referred to and have no segments of their own here."""
    matches = stage.save(choose(verified_matches(seqs, candidate_links(seqs, stage, p), p), p.min_length), "matches")
    cols = ["seq_id", "q_from", "q_to", "ref_id", "p_from", "parent_start", "parent_end", "depth"]
    root = lambda df: df.select("seq_id", "q_from", "q_to", *[F.lit(None).cast("long").alias(c) for c in cols[3:7]], F.lit(0).alias("depth"))
    level = nodes = stage.save(root(_pieces(seqs if known is None else seqs.filter("seq_id >= 0"), matches).filter("ref_id IS NULL")), "nodes0")
    left = matches.select("seq_id", "q_from", "q_to", "ref_id", "r_from", "r_to", "percent", "blocks")
    key = ["seq_id", "q_from", "q_to", "ref_id", "r_from"]

    def on_own(x: str) -> Column:  # the place of the sequence beside place x of the reference
        before = F.filter("blocks", lambda b: b["r"] <= F.col(x))
        last = F.get(before, F.size(before) - 1)
        return F.when(F.col(x) == F.col("r_to"), F.col("q_to")).otherwise(F.coalesce(last["q"] + F.least(F.col(x) - last["r"], last["n"]), F.col("q_from")))

    for d in range(1, max_depth + 1):
        above = level if known is None else level.select("seq_id", "q_from", "q_to").unionByName(known.filter(F.col("depth") == d - 1).select("seq_id", "q_from", "q_to"))
        spot = above.select(F.col("seq_id").alias("ref_id"), F.col("q_from").alias("p_from"), F.col("q_to").alias("p_to"))
        over = left.filter(F.col("percent") >= (p.identity if d == 1 else p.deep_identity)).join(spot, "ref_id").withColumn("a", F.greatest("r_from", "p_from")).withColumn("b", F.least("r_to", "p_to")).filter(F.col("b") - F.col("a") >= p.min_length)
        over = over.withColumn("qa", F.when(F.col("a") == F.col("r_from"), F.col("q_from")).otherwise(on_own("a"))).withColumn("qb", on_own("b")).filter("qa < qb")
        best = over.groupBy(*key).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("n"), (-F.col("p_from")).alias("m"), "a", "b", "qa", "qb", "p_from")).alias("x"))
        best = stage.save(best, f"best{d}")
        level = best.select("seq_id", F.col("x.qa").alias("q_from"), F.col("x.qb").alias("q_to"), "ref_id", F.col("x.p_from").alias("p_from"), (F.col("x.a") - F.col("x.p_from")).alias("parent_start"), (F.col("x.b") - F.col("x.p_from")).alias("parent_end"), F.lit(d).alias("depth"))
        # What was cut off on either side is a root of its own; no other node refers to it.
        ends = F.explode(F.array(F.struct(F.col("q_from").alias("u"), F.col("x.qa").alias("v")), F.struct(F.col("x.qb").alias("u"), F.col("q_to").alias("v"))))
        off = best.select("seq_id", ends.alias("e")).select("seq_id", F.col("e.u").alias("q_from"), F.col("e.v").alias("q_to")).filter("q_from < q_to")
        nodes = nodes.unionByName(level).unionByName(root(off))
        left = stage.save(left.join(best, key, "left_anti"), f"left{d}")
        if left.isEmpty():
            break
    return nodes.unionByName(root(left))  # too deep, or no node holds enough of the range


def _texts(seqs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with `own`, their text, and `old`, the parent's range that it is made from."""
    cut = lambda t, a, b: F.col(t).substr((a + 1).cast("int"), (b - a).cast("int"))
    own = nodes.join(seqs, "seq_id").withColumn("own", cut("residues", F.col("q_from"), F.col("q_to"))).drop("residues")
    full = own.join(seqs.select(F.col("seq_id").alias("ref_id"), F.col("residues").alias("ref")), "ref_id", "left")
    return full.withColumn("old", cut("ref", F.col("p_from") + F.col("parent_start"), F.col("p_from") + F.col("parent_end"))).drop("ref")


def _aligned(linked: DataFrame) -> DataFrame:
    """Rows with aligned_old and aligned_own. Texts of one length stand side by side as they
    are; only others are aligned with gaps."""
    even = F.length("old") == F.length("own")
    same = linked.filter(even).withColumn("aligned_old", F.col("old")).withColumn("aligned_own", F.col("own"))
    gaps = align.align_pairs(linked.filter(~even), "old", "own", rule_matrix()).withColumnsRenamed({"aligned_a": "aligned_old", "aligned_b": "aligned_own"})
    return same.unionByName(gaps)


def compress_forest(seqs: DataFrame, p: Params = Params(), stage: Stage | None = None, known: DataFrame | None = None) -> DataFrame:
    """Forest nodes: node_id ("seq:from"), seq_id, q_from, q_to, parent_id, depth, parent_start,
    parent_end (0-based, in the parent's own text), sequence (roots only), diff (children).
    Ids are 0 or more. known: nodes of a forest to which these sequences are added; new nodes
    may refer to them, and only new ones are returned."""
    stage = stage or Stage(seqs.sparkSession, "forest")
    new, there = seqs.select("seq_id", "residues").filter("seq_id >= 0 AND residues <> ''"), None
    if known is not None:
        there = known.select((-1 - F.col("seq_id")).alias("seq_id"), "q_from", "q_to", "depth")
        new = new.unionByName(restore_forest(known, p.max_depth).select((-1 - F.col("seq_id")).alias("seq_id"), "residues"))
    seqs = stage.save(new, "seqs")
    full = stage.save(_texts(seqs, _levels(seqs, stage, p, p.max_depth, there)), "nodes")
    cols = ["seq_id", "q_from", "q_to"]
    none = lambda t: F.lit(None).cast(t)
    place = [F.col(c).cast("long").alias(c) for c in ("parent_start", "parent_end")]
    parent = F.concat_ws(":", F.when(F.col("ref_id") < 0, -1 - F.col("ref_id")).otherwise(F.col("ref_id")).cast("string"), F.col("p_from").cast("string"))
    roots = full.filter("ref_id IS NULL").select(_name("seq_id", "q_from").alias("node_id"), *cols, none("string").alias("parent_id"), "depth", *place, F.col("own").alias("sequence"), none(edits.OPERATIONS).alias("diff"))
    kids = _aligned(full.filter("ref_id IS NOT NULL")).select(_name("seq_id", "q_from").alias("node_id"), *cols, parent.alias("parent_id"), "depth", *place, none("string").alias("sequence"), edits.forest_ops("aligned_old", "aligned_own").alias("diff"))
    return stage.save(roots.unionByName(kids), "forest")


def restore_forest(nodes: DataFrame, max_depth: int = 5) -> DataFrame:
    """seq_id, residues from forest nodes: one join per level, at most max_depth of them."""
    stage = Stage(nodes.sparkSession, "restore")
    level = stage.save(nodes.filter("depth = 0").select("node_id", "seq_id", "q_from", F.col("sequence").alias("text")), "level0")
    every = level
    for d in range(1, max_depth + 1):
        kids = nodes.filter(F.col("depth") == d).select("node_id", "seq_id", "q_from", "parent_id", "parent_start", "parent_end", "diff")
        if kids.isEmpty():
            break
        up = level.select(F.col("node_id").alias("parent_id"), F.col("text").alias("up"))
        seg = F.col("up").substr((F.col("parent_start") + 1).cast("int"), (F.col("parent_end") - F.col("parent_start")).cast("int"))
        level = stage.save(kids.join(up, "parent_id").select("node_id", "seq_id", "q_from", edits.apply_forest("diff", seg).alias("text")), f"level{d}")
        every = every.unionByName(level)
    ordered = F.array_sort(F.collect_list(F.struct("q_from", "text")))
    return every.groupBy("seq_id").agg(ordered.alias("p")).select("seq_id", F.array_join(F.col("p.text"), "").alias("residues"))


def ratio(coarse: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row: residues kept and given, and their ratio in percent."""
    kept = coarse.agg(F.coalesce(F.sum(F.length("residues")), F.lit(0)).alias("kept"))
    given = seqs.agg(F.coalesce(F.sum(F.length("residues")), F.lit(0)).alias("given")).first()[0]
    return kept.select("kept", F.lit(given).cast("long").alias("given"), (100.0 * F.col("kept") / max(given, 1)).alias("percent"))
