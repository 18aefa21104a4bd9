"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Every document gets its size in tokens of a public tokenizer, and a shard of its source;
   a shard is about SHARD_TOKENS large, so that no task gets a whole source.
2. In each shard the documents follow one another in a seeded order and are cut into blocks
   of BLOCK_TOKENS: a document belongs to the block in which its first token lies.
3. The blocks of the mix go to the sources one by one, each to the highest quotient
   share / (2 k + 1); a source that has used all its blocks max_repeats times drops out. The
   same rule splits a source's quota among its shards.
4. A shard repeats all its blocks as often as the quota allows and then takes the first
   ones of a seeded order once more, the last one up to the document that reaches the quota;
   so no document is used more than max_repeats times.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heapreplace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.session import Stage

#: Tokens of a block, and blocks that a mix should have at least: a smaller mix takes smaller ones.
BLOCK_TOKENS, LEAST_SEATS = 2_048, 50_000
#: Tokens of a shard, unless a source would have more than MOST_SHARDS: those are ranked in one
#: window, so shards of larger sources are larger.
SHARD_TOKENS, MOST_SHARDS = 2_000_000, 10_000
#: The tokenizer's ranks: lines of a base64 token and its rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_name(col: Column | str) -> Column:
    """One spelling of a source: without blanks around, in lower case, `-` for `_`."""
    return F.translate(F.lower(F.trim(col)), "_", "-")


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of whole texts; a null text has no tokens. Special tokens in
    a text count as ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoding(tokenizer)
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_name("source").alias("source"), "text").mapInArrow(run, "doc_id BIGINT, source STRING, n_tokens BIGINT")


def sainte_lague(shares: dict[str, float], most: dict[str, int], seats: int) -> dict[str, int]:
    """Seats by highest quotients share / (2 k + 1), at most most[s] each, ties by name.

    All but a few seats follow at once from the divisor; the rest are given one by one. One
    entry per source of the configuration, however large the data.
    """
    names = sorted(s for s in shares if shares[s] > 0 and most.get(s, 0) > 0)
    got = dict.fromkeys(shares, 0)
    seats = min(seats, sum(most[s] for s in names))
    lo, hi = 0.0, float(2 * seats + 2) / min((shares[s] for s in names), default=1.0)
    at = lambda x: {s: min(most[s], int(shares[s] * x + 0.5)) for s in names}
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid).values()) <= seats else (lo, mid)
    got |= at(lo)
    left = seats - sum(got.values())
    heap = [(-shares[s] / (2 * got[s] + 1), s) for s in names if got[s] < most[s]]
    heapify(heap)
    while left > 0 and heap:
        _, s = heap[0]
        got[s] += 1
        left -= 1
        heapreplace(heap, (-shares[s] / (2 * got[s] + 1) if got[s] < most[s] else 1.0, s))
    return got


def _shard_quotas(shards: DataFrame) -> DataFrame:
    """source, shard, quota: the same rule within a source. shards: source, shard, n_blocks,
    quota; a source has at most MOST_SHARDS of them, one row each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = {f"{s:06d}": n for s, n in zip(pdf["shard"], pdf["n_blocks"])}
        seats = int(pdf["quota"].iloc[0]) if len(pdf) else 0
        got = sainte_lague(sizes, dict.fromkeys(sizes, seats), seats)
        return pd.DataFrame({"source": pdf["source"], "shard": pdf["shard"], "quota": [got[f"{s:06d}"] for s in pdf["shard"]]})

    return shards.select("source", "shard", "n_blocks", "quota").groupBy("source").applyInPandas(run, "source STRING, shard BIGINT, quota BIGINT")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None, block: int | None = None, shard: int = SHARD_TOKENS, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, report). chosen: doc_id, source, n_tokens, repeats. report: one row per source.

    total_tokens: size of the mix; by default the largest at which no source with documents
    must be used more often than allowed. Sources without documents get nothing and the
    others their shares of the whole; sources without target or with a null name are left
    out. A document without tokens is never chosen. Repeated doc_ids count once each row.
    An empty table gives no rows, and a report with zeros.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mix")
    sized = stage.save(count_tokens(docs, tokenizer), "sized")
    have = sized.filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    wanted = targets.filter("source IS NOT NULL AND target_share > 0").groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    # The targets are configuration: one row per named source.
    plan = {r["source"]: r for r in wanted.join(have, "source").filter("n_tokens > 0").collect()}
    share = {s: r["target_share"] for s, r in plan.items()}
    whole = sum(share.values())
    if total_tokens is None:
        total_tokens = min((int(r["max_repeats"] * r["n_tokens"] / (share[s] / whole)) for s, r in plan.items()), default=0)

    block = block or max(1, min(BLOCK_TOKENS, total_tokens // LEAST_SEATS))
    sizes = spark.createDataFrame([(s, int(r["n_tokens"])) for s, r in plan.items()] or [("", 0)], "source STRING, size BIGINT")
    in_plan = sized.filter("n_tokens > 0").join(F.broadcast(sizes), "source")
    h = lambda salt, *c: F.xxhash64(F.lit(seed), F.lit(salt), *c)
    put = in_plan.withColumn("shard", F.pmod(h(1, "doc_id"), F.least(F.ceil(F.col("size") / shard), F.lit(MOST_SHARDS))))
    run = W.partitionBy("source", "shard").orderBy(h(2, "doc_id"), "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    put = put.withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(run), F.lit(0)) / block))
    put = stage.save(put.select("doc_id", "source", "n_tokens", "shard", F.col("block").cast("long").alias("block")), "blocks")

    shards = put.groupBy("source", "shard").agg((F.sum("n_tokens") / block).alias("n_blocks"))
    counts = {r[0]: r[1] for r in shards.groupBy("source").agg(F.sum("n_blocks")).collect()}
    quota = sainte_lague(share, {s: int(plan[s]["max_repeats"] * counts.get(s, 0)) for s in share}, total_tokens // block)
    given = F.broadcast(spark.createDataFrame([(s, int(quota[s]), int(plan[s]["max_repeats"])) for s in share] or [("", 0, 0)], "source STRING, quota BIGINT, max_repeats INT"))
    quotas = _shard_quotas(shards.join(given, "source")).join(given.select("source", "max_repeats"), "source")

    # Tokens that the quota stands for: all documents so often, then the first ones in the seeded
    # order of their blocks.
    per = put.groupBy("source", "shard").agg(F.sum("n_tokens").alias("all")).join(quotas, ["source", "shard"])
    times = F.least(F.floor(F.col("quota") * block / F.col("all")), F.col("max_repeats").cast("long"))
    per = per.withColumn("times", times).withColumn("rest", F.col("quota") * block - F.col("times") * F.col("all"))
    order = W.partitionBy("source", "shard").orderBy(h(3, "shard", "block"), "block", h(2, "doc_id"), "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = put.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(per.select("source", "shard", "times", "rest", "max_repeats"), ["source", "shard"])
    more = (F.col("before") + F.col("n_tokens") / 2 < F.col("rest")).cast("long")
    chosen = placed.withColumn("repeats", F.least(F.col("times") + more, F.col("max_repeats").cast("long"))).filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    chosen = stage.save(chosen, "chosen")

    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_chosen"), F.sum("repeats").alias("n_uses"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    used = stage.save(used, "used")
    total = used.agg(F.sum("tokens")).first()[0] or 0
    report = wanted.join(have, "source", "full").join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = report.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.col("tokens") / F.lit(max(total, 1)), F.lit(0.0)).alias("actual_share"),
        zero("n_documents"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("available_tokens"), zero("n_chosen"), zero("n_uses"), zero("tokens"), zero("most_repeats"), zero("max_repeats"),
    )
    return chosen, report
