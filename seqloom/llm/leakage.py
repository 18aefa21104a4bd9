"""Evaluation texts leaking into training text, by suffix arrays of training shards.

Test items are a stated query set: they are taken in blocks of at most BLOCK_WORDS words,
and each block is broadcast (messages are decoded once for all blocks). Every task cuts its documents into shards of about SHARD_WORDS
words and builds a suffix array over each shard's words; every suffix of the test items is
then looked up by binary search, which gives the longest verbatim match and all places that
share its first N words. No document is compared with another and nothing is shuffled.

Words that occur in no test item of the block can't be part of a match, so a shard's array
holds the runs of at least N test words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.mail import text_parts, words
from seqloom.session import Stage

#: Consecutive words that make a leak.
N_WORDS = 12
#: Words of test items per broadcast block: at most some 100 MB in a task.
BLOCK_WORDS = 1_000_000
#: Kept words per shard of training text: bounds the memory of a task.
SHARD_WORDS = 2_000_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.int32()), ("doc_at", pa.int32()), ("item_at", pa.int32()), ("longest", pa.int32())])
DDL = "doc_id BIGINT, item_id BIGINT, part INT, doc_at INT, item_at INT, longest INT"


class _Items:
    """One block of test items as numbers; sent to every task."""

    def __init__(self, ids: list[int], texts: list[list[str]], n: int):
        self.vocabulary: dict[str, int] = {}
        seq, owner, at = [], [], []
        for item, ws in zip(ids, texts):
            seq += [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in ws] + [1]
            owner += [item] * (len(ws) + 1)
            at += range(len(ws) + 1)
        self.seq, self.owner, self.at = (np.array(x, t) for x, t in ((seq, np.int64), (owner, np.int64), (at, np.int32)))
        self.longest = max(map(len, texts), default=0)
        self.suffixes = run_starts(self.seq > 1, n)


def run_starts(inside: np.ndarray, n: int) -> np.ndarray:
    """Positions from which at least n entries lie inside."""
    if len(inside) < n:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(inside)])
    return np.flatnonzero(total[n:] - total[:-n] == n)


def prefix_ranks(seq: np.ndarray, upto: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words, until 2^k >= upto."""
    levels = [np.unique(seq, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while step < upto:
        r = levels[-1]
        nxt = np.zeros_like(r)
        nxt[:-step] = r[step:] + 1
        levels.append(np.unique(r * (len(r) + 2) + nxt, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return levels


def _first_n(levels: list[np.ndarray], pos: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the first n words at `pos`: the largest power of two, laid twice over n."""
    k = n.bit_length() - 1
    r = levels[k]
    return r[pos] * (len(r) + 2) + r[pos + n - (1 << k)]


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Words that suffixes a and b share."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            x, y = a + got, b + got
            ok = (x < size) & (y < size)
            same = np.zeros(len(a), bool)
            same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            got += same << k
    return got


def search_shard(seq: np.ndarray, doc: np.ndarray, part: np.ndarray, doc_at: np.ndarray, items: _Items, n: int) -> pa.RecordBatch | None:
    """Leaks of one shard: a row per document and item with the longest match between them (of
    equal ones the first in the document) and its places in both."""
    starts = run_starts(seq > 1, n)
    if not len(starts) or not len(items.suffixes):
        return None
    both = np.concatenate([seq, [0], items.seq, [0]])
    levels = prefix_ranks(both, max(n, items.longest))
    rank, tests, own = levels[-1], items.suffixes + len(seq) + 1, items.owner[items.suffixes]
    # The suffix array of the shard, and the test suffixes' own.
    order = starts[np.argsort(rank[starts], kind="stable")]
    head_sorted = _first_n(levels, order, n)  # ascending, as the array is in order of whole suffixes
    heads = _first_n(levels, tests, n)
    # An item's suffixes with one head are a group: their places are looked up once, and a place's
    # longest match among them is with one of its two neighbours in the order of suffixes.
    names, group = np.unique(np.stack([own, heads]), axis=1, return_inverse=True)
    group = group.ravel()
    lo, hi = np.searchsorted(head_sorted, names[1]), np.searchsorted(head_sorted, names[1], "right")
    met = np.flatnonzero(hi > lo)
    if not len(met):
        return None
    count = (hi - lo)[met]
    which = np.repeat(met, count)
    places = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[met], count)]
    width = len(both) + 1
    sorted_tests = np.argsort(group * width + rank[tests], kind="stable")
    keys = (group * width + rank[tests])[sorted_tests]
    after = np.searchsorted(keys, which * width + rank[places])
    best, share = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for near in (after - 1, after):
        ok = np.flatnonzero((near >= 0) & (near < len(keys)))
        ok = ok[group[sorted_tests[near[ok]]] == which[ok]]
        test = sorted_tests[near[ok]]
        common = _common(levels, places[ok], tests[test], len(both))
        more = common > share[ok]
        share[ok[more]], best[ok[more]] = common[more], test[more]
    item_at = items.at[items.suffixes[best]]
    first = np.lexsort((item_at, doc_at[places], part[places], -share, names[0][which], doc[places]))
    d, i = doc[places][first], names[0][which][first]
    pick = first[np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])])]
    cols = [doc[places][pick], names[0][which][pick], part[places][pick], doc_at[places][pick], item_at[pick], share[pick]]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def part_words(docs: DataFrame) -> DataFrame:
    """doc_id, part, words: the words of each text part of a message (from 0) between blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, k, " ".join(words(p))) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, p in enumerate(text_parts(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["doc_id", "part", "words"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id BIGINT, part INT, words STRING")


def _match(parts: DataFrame, sent: Broadcast, n: int) -> DataFrame:
    """Leaks of one block of test items in all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, get = sent.value, sent.value.vocabulary.get
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def shard() -> pa.RecordBatch | None:
            return search_shard(*map(np.concatenate, zip(*held)), block, n) if held else None

        for batch in batches:
            for doc_id, part, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seq = np.fromiter((get(w, 0) for w in text.split(" ")), np.int64)
                runs = run_starts(seq > 1, n)
                if not len(runs):
                    continue
                keep = np.zeros(len(seq) + 1, bool)
                for k in range(n):
                    keep[runs + k] = True
                keep[1:] |= keep[:-1]  # and the break behind each run
                kept = np.append(seq, 0)[keep]
                held.append((kept, np.full(len(kept), doc_id, np.int64), np.full(len(kept), part, np.int32), np.flatnonzero(keep).astype(np.int32)))
                size += len(kept)
            if size >= SHARD_WORDS:
                if (b := shard()) is not None:
                    yield b
                held, size = [], 0
        if (b := shard()) is not None:
            yield b

    return parts.mapInArrow(run, DDL)


def find_leaks(docs: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """doc_id, item_id, part, doc_at, item_at, longest: pairs where n consecutive words of the
    item stand in one text part of the message; the longest match begins at the 0-based word
    doc_at of that part and item_at of the item.

    Null texts hold no words; items of fewer than n words can't leak; a repeated item_id
    with other text counts as one item with both texts; repeated documents come once.
    """
    spark = docs.sparkSession
    split = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = _blocks(split, n)
    block, parts = next(blocks, None), part_words(docs)
    if block is None:
        return spark.createDataFrame([], DDL)
    following = next(blocks, None)
    if following is None:
        out = _match(parts, spark.sparkContext.broadcast(block), n)
    else:
        stage, out, k = Stage(spark, "leaks"), None, 0
        parts = stage.save(parts, "parts")
        while block is not None:
            sent = spark.sparkContext.broadcast(block)
            got = stage.save(_match(parts, sent, n), f"block{k}")
            sent.destroy()
            out = got if out is None else out.unionByName(got)
            block, following, k = following, next(blocks, None), k + 1
    # A part lies in one shard and an item in one block; parts of a message and repeated rows meet here.
    best = F.max(F.struct("longest", *[(-F.col(c)).alias(c) for c in ("part", "doc_at", "item_at")])).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[(-F.col(f"b.{c}")).alias(c) for c in ("part", "doc_at", "item_at")], F.col("b.longest").alias("longest"))


def _blocks(items: DataFrame, n: int) -> Iterator[_Items]:
    """The test items block by block; the driver holds one block at a time."""
    ids, texts, held = [], [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        ws = words(row["text"])
        if held and held + len(ws) > BLOCK_WORDS and ids[-1] != row["item_id"]:
            yield _Items(ids, texts, n)
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(ws)
        held += len(ws)
    if ids:
        yield _Items(ids, texts, n)


def item_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, n_documents, longest: for every test item, leaked or not."""
    per = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("longest").cast("long").alias("longest"))
    return items.select(F.col("item_id").cast("long").alias("item_id")).distinct().join(per, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def remove_leaked(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no passage of a test item; null ids stay."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
