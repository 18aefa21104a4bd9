"""Long exact spans shared between records, by suffix automata of reference shards.

Sending the automaton of every reference shard to every document would cost shards times
documents. Here documents meet only the shard that can match them:

1. Equal texts are one class. Records of a class with several ids are shared as a whole.
2. Every run of MIN_SPAN residues holds a minimizer: the smallest hash of its ANCHOR-mers.
   Equal runs choose the same one, so windows around anchors that two classes have in
   common hold every shared run.
3. The windows of an anchor are a reference shard. Its automaton, over the distinct window
   texts, knows for each state the smallest and largest class that contains it; streaming a
   window through it gives the matching statistics against all other classes, and the places
   where they reach MIN_SPAN.
4. A shard of more than SHARD distinct windows (low complexity) is split by what stands beside
   the anchor: runs that begin a to b residues before it have a residues on its left and
   MIN_SPAN - ANCHOR - b on its right in common, so each range of beginnings has shards of
   its own. Ranges are halved until shards are small; at one beginning a shard is one text.
5. Spans of a record are put together to maximal runs; `remove_spans` takes them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions.minimizers import batch_minimizers
from seqloom.functions.text import clean_residues
from seqloom.operators.skew import hot_join, hot_values
from seqloom.session import Stage

#: Residues of the shortest span that counts.
MIN_SPAN = 40
#: Length of an anchor; each run of MIN_SPAN holds MIN_SPAN - ANCHOR + 1 of them.
ANCHOR = 20
#: Distinct windows of one shard, about 60 residues each; larger shards are split.
SHARD = 2_000


class Automaton:
    """Suffix automaton over several texts; each state knows the smallest and the largest
    owner of the texts that contain it."""

    __slots__ = ("high", "length", "link", "low", "next")

    def __init__(self, texts: list[str], owners: list[tuple[int, int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.low, self.high = [None], [None]
        for text, (low, high) in zip(texts, owners):
            last = 0
            for c in text:
                last = self._extend(last, c)
                self._own(last, low, high)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self._own(self.link[s], self.low[s], self.high[s])

    def _own(self, s: int, low: int | None, high: int | None) -> None:
        if low is not None:
            self.low[s] = low if self.low[s] is None else min(self.low[s], low)
            self.high[s] = high if self.high[s] is None else max(self.high[s], high)

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        self.low.append(None)
        self.high.append(None)
        return len(self.length) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matching(self, text: str, owner: int) -> list[int]:
        """For each position the length of the longest suffix that ends there and occurs in
        a text of another owner."""
        out, s, n = [], 0, 0
        for c in text:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            t, m = s, n
            while t and self.low[t] == owner == self.high[t]:
                t = self.link[t]
                m = self.length[t]
            out.append(m)
        return out


def long_spans(matching: list[int], least: int) -> list[tuple[int, int]]:
    """0-based spans [from, to] of the matches of at least that length, put together."""
    spans: list[tuple[int, int]] = []
    for i, m in enumerate(matching):
        if m >= least:
            a = i - least + 1  # longer matches have begun their span before
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], i)
            else:
                spans.append((a, i))
    return spans


def _shard_spans(texts: list[str], owners: list[tuple[int, int]], least: int) -> list[list[tuple[int, int]]]:
    """Shared spans of each distinct window of a shard."""
    if all(a != b for a, b in owners):
        return [[(0, len(t) - 1)] for t in texts]
    if len(texts) == 1:
        return [[]]
    auto = Automaton(texts, owners)
    return [[(0, len(t) - 1)] if a != b else long_spans(auto.matching(t, a), least) for t, (a, b) in zip(texts, owners)]


def _grouped(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: one automaton after the other."""
    key, texts, owners, out = None, [], [], []

    def close() -> None:
        for t, spans in zip(texts, _shard_spans(texts, owners, least)):
            out.extend((key, t, a, b) for a, b in spans)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["shard", "window", "a", "b"])

    for batch in batches:
        for k, t, low, high in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if k != key:
                close()
                key, texts, owners = k, [], []
            texts.append(t)
            owners.append((low, high))
        if len(out) > 50_000:
            yield flush()
            out.clear()
    close()
    if out:
        yield flush()


def shared_spans(records: DataFrame, least: int = MIN_SPAN, shard: int = SHARD) -> DataFrame:
    """seq_id, span_from, span_to: maximal runs of positions (1-based, both included) that
    lie in a run of `least` clean residues which also occurs in another record.

    Rows without seq_id are dropped; null residues are empty; of rows with one seq_id and
    several residues the largest text counts. A text may be of any length.
    """
    stage = Stage(records.sparkSession, "spans")
    half = least - ANCHOR
    if half < 0:
        raise ValueError(f"spans must have at least {ANCHOR} residues")
    recs = stage.save(clean_records(records).filter(F.length("text") >= least).select("seq_id", "text", F.md5("text").alias("key")), "records")
    classes = recs.groupBy("key").agg(F.min("seq_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    classes = stage.save(classes, "classes")
    many = classes.filter("n > 1").select("key", F.lit(True).alias("many"))
    hot = hot_values(classes, "key", "n", recs.count())
    whole = hot_join(recs.select("seq_id", "key", F.length("text").alias("n")), many, "key", hot, "inner").select("seq_id", F.lit(1).alias("span_from"), F.col("n").alias("span_to"))
    texts = classes.select("owner", "n").join(recs.select(F.col("seq_id").alias("owner"), "text"), "owner")
    texts = stage.save(texts, "texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, pos, h = batch_minimizers([t.encode() for t in b.column(1).to_pylist()], ANCHOR, least)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(owner)), pa.array(pos.astype(np.int32))], ["shard", "owner", "pos"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "window", "owner", "start", "off"]
        for b in batches:
            rows: list[tuple] = []
            for o, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                anchors, places = (wanted.values.field(i).to_pylist() for i in range(2))
                for x, p in zip(anchors, places):
                    a = max(0, p - half)
                    rows.append((x, t[a : p + least], o, a, p - a))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    found = stage.save(texts.select("owner", "text").mapInArrow(find, "shard BIGINT, owner BIGINT, pos INT"), "anchors")
    per = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low < high")
    per = stage.save(per.select("shard", "n"), "shared_anchors")
    hot = hot_values(per, "shard", "n", per.agg(F.sum("n")).first()[0] or 0)
    wanted = hot_join(found, per.select("shard"), "shard", hot, "inner").groupBy("owner").agg(F.collect_list(F.struct("shard", "pos")).alias("wanted"))
    windows = texts.join(wanted, "owner").select("owner", "text", "wanted").mapInArrow(cut, "shard BIGINT, window STRING, owner BIGINT, start BIGINT, off BIGINT")
    windows = stage.save(windows, "windows")
    stage.drop("anchors", "shared_anchors")

    ranges, at, spans = [(0, half)], windows, []
    while at is not None:
        # At one beginning a shard holds one text, so there is nothing left to split.
        told, crowded = _matched(stage, at, least, shard if any(a < b for a, b in ranges) else 2**31, len(spans))
        spans.append(told)
        ranges = [x for a, b in ranges for x in ([(a, (a + b) // 2), ((a + b) // 2 + 1, b)] if a < b else [(a, b)])]
        at = None
        if crowded is not None:
            # Back to the anchors' whole windows: what was split once is split anew, finer.
            windows = stage.save(windows.join(crowded.select("anchor").distinct().withColumnRenamed("anchor", "shard"), "shard", "left_semi"), f"crowd{len(spans)}")
            at = _split(windows, ranges, least)

    single = classes.filter("n = 1").select("owner")
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    every = every.distinct().join(single, "owner", "left_semi")
    w = W.partitionBy("owner").orderBy("lo", "hi")
    upto = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    isles = every.withColumn("new", (F.coalesce(F.col("lo") > upto + 1, F.lit(True))).cast("int")).withColumn("isle", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = isles.groupBy("owner", "isle").agg(F.min("lo").alias("span_from"), F.max("hi").alias("span_to"))
    return joined.select(F.col("owner").alias("seq_id"), F.col("span_from").cast("int"), F.col("span_to").cast("int")).unionByName(whole.select("seq_id", "span_from", "span_to"))


def _split(windows: DataFrame, ranges: list[tuple[int, int]], least: int) -> DataFrame:
    """The windows' parts for each range of beginnings (residues before the anchor), in shards
    of what all runs of that range have in common."""
    off, n = F.col("off"), F.length("window")
    parts = []
    for a, b in ranges:
        lo, hi = F.greatest(off - b, F.lit(0)), F.least(off + least - a, n)
        text = lambda x, y: F.col("window").substr((x + 1).cast("int"), (y - x).cast("int"))
        fits = (off >= a) & (off + least - b <= n)
        common = F.xxhash64(F.lit(a), text(off - a, off + least - b))
        parts.append(F.when(fits, F.struct(common.alias("shard"), text(lo, hi).alias("window"), (F.col("start") + lo).alias("start"))))
    got = windows.select("owner", F.col("shard").alias("anchor"), F.explode(F.array(*parts)).alias("p")).filter("p IS NOT NULL")
    return got.select("anchor", "p.shard", "p.window", "owner", "p.start")


def _matched(stage: Stage, at: DataFrame, least: int, shard: int, level: int) -> tuple[DataFrame, DataFrame | None]:
    """(owner, lo, hi of the spans in shards that aren't too large, the anchors of the others)."""
    at = at.withColumn("anchor", F.col("shard")) if level == 0 else stage.save(at, f"parts{level}")
    distinct = at.groupBy("shard", "window").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count(F.lit(1)).alias("n"), F.min("anchor").alias("anchor"))
    distinct = stage.save(distinct, f"distinct{level}")
    crowded = stage.save(distinct.groupBy("shard").agg(F.count(F.lit(1)).alias("m"), F.min("anchor").alias("anchor")).filter(F.col("m") > shard).select("shard", "anchor"), f"crowded{level}")
    calm = distinct.join(crowded.select("shard"), "shard", "left_anti").select("shard", "window", "low", "high")
    sharded = calm.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _grouped(it, least), "shard BIGINT, window STRING, a INT, b INT")
    sharded = stage.save(sharded.groupBy("shard", "window").agg(F.collect_list(F.struct("a", "b")).alias("spans")).withColumn("wkey", F.xxhash64("shard", "window")), f"sharded{level}")
    keyed = at.select("owner", "start", "window", F.xxhash64("shard", "window").alias("wkey"))
    hot = hot_values(distinct.withColumn("wkey", F.xxhash64("shard", "window")), "wkey", "n", at.count())
    told = hot_join(keyed, sharded.select("wkey", F.col("window").alias("same"), "spans"), "wkey", hot, "inner").filter("window = same")
    spans = told.select("owner", "start", F.explode("spans").alias("s")).select("owner", (F.col("start") + F.col("s.a") + 1).alias("lo"), (F.col("start") + F.col("s.b") + 1).alias("hi"))
    return spans, None if crowded.isEmpty() else crowded


def clean_records(records: DataFrame) -> DataFrame:
    """seq_id, text: clean residues, one row per seq_id (the largest text)."""
    named = records.filter("seq_id IS NOT NULL").select(F.col("seq_id").cast("long").alias("seq_id"), clean_residues("residues").alias("text"))
    return named.groupBy("seq_id").agg(F.max("text").alias("text"))


def remove_spans(records: DataFrame, spans: DataFrame) -> DataFrame:
    """seq_id, residues, n_removed: every record without the given maximal spans (of one record
    they neither overlap nor touch). Records without spans stay whole, empty ones empty."""
    per = spans.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("span_from", "span_to"))).alias("s"))
    text, s = F.col("text"), F.col("s")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["span_to"])
    kept = F.transform(s, lambda x, i: text.substr(before(i) + 1, x["span_from"] - 1 - before(i)))
    last = text.substr(F.element_at(s, -1)["span_to"] + 1, F.length(text))
    left = F.when(s.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), last))
    full = clean_records(records).join(per, "seq_id", "left").select("seq_id", left.alias("residues"), F.length(text).alias("n"))
    return full.select("seq_id", "residues", (F.col("n") - F.length("residues")).cast("long").alias("n_removed"))


def shared_amount(records: DataFrame, spans: DataFrame) -> DataFrame:
    """seq_id, n_residues, n_shared of every record."""
    clean = records.filter("seq_id IS NOT NULL").groupBy(F.col("seq_id").cast("long").alias("seq_id")).agg(F.max(F.length(clean_residues("residues"))).cast("long").alias("n_residues"))
    per = spans.groupBy("seq_id").agg(F.sum(F.col("span_to") - F.col("span_from") + 1).alias("n_shared"))
    return clean.join(per, "seq_id", "left").select("seq_id", "n_residues", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
