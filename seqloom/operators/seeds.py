"""Seed tables and seed look-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions.minimizers import chunks
from seqloom.functions.residue import ALPHABET, kmers, reduce_alphabet

#: Characters that no run is made of.
_ENDS = np.array([10, 13, 0x85, 0x2028, 0x2029], np.uint32)


def _seeds(texts: list[str], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, letters, hash) of the seeds of some texts, in one pass over all."""
    text = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    n = np.maximum(size - k, 0)  # the final window has no seed
    owner = np.repeat(np.arange(len(texts)), n)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + pos
    code = np.full(128, -1, np.int64)
    code[[ord(a) for a in ALPHABET]] = np.arange(len(ALPHABET))
    digit = np.where(text < 128, code[np.minimum(text, 127)], -1)
    wrong = np.concatenate([[0], np.cumsum(digit < 0)])
    ok = wrong[at + k] == wrong[at]
    if window > 0:
        # Where `window` equal residues begin, from the residues that equal the one before.
        same = np.concatenate([[0], np.cumsum(text[1:] == text[:-1])])
        starts = np.zeros(len(text) + 1, np.int64)
        last = len(text) - window + 1
        if last > 0:
            starts[1 : last + 1] = (same[window - 1 :] - same[:last] == window - 1) & ~np.isin(text[:last], _ENDS)
        starts = np.cumsum(starts)
        ok &= starts[at + 1] == starts[np.maximum(at - window, begin[owner])]
    owner, pos, at = owner[ok], pos[ok], at[ok]
    h = np.zeros(len(at), np.int64)
    for i in range(k):
        h = h * len(ALPHABET) + digit[at + i]
    return owner, pos, text[at[:, None] + np.arange(k)].astype(np.uint8), h


def seed_table(seqs: DataFrame, k: int = 6, window: int = 6) -> DataFrame:
    """seq_id, pos, kmer, kmer_hash: every window of k but the last of each sequence, except
    where a run of at least `window` equal residues lies within `window` on either side, or
    a letter is outside the alphabet. Texts shorter than k + 1 have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                owner, pos, letters, h = _seeds(texts[lo:hi], k, window)
                words = pa.StringArray.from_buffers(len(h), pa.py_buffer(np.arange(len(h) + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(letters.tobytes()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner + lo)), pa.array(pos.astype(np.int32)), words, pa.array(h)], ["seq_id", "pos", "kmer", "kmer_hash"])

    return seqs.select("seq_id", "residues").mapInArrow(find, f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, pos INT, kmer STRING, kmer_hash BIGINT")


def reduced_seeds(seqs: DataFrame, k: int = 5) -> DataFrame:
    """seq_id, pos, reduced: all windows of k in the reduced alphabet; windows with a letter
    outside it have no seed."""
    found = seqs.select("seq_id", F.explode(kmers(reduce_alphabet("residues"), k)).alias("s")).select("seq_id", "s.pos", F.col("s.kmer").alias("reduced"))
    return found.filter(F.col("reduced").rlike("^[0-9]+$"))


def first_hits(seeds: DataFrame, key: str, n: int = 32) -> DataFrame:
    """The first n seeds of each key in order of (seq_id, pos): what a look-up returns.
    Spark keeps n per key in the map tasks, so a hot key shuffles n rows a task."""
    rank = F.row_number().over(W.partitionBy(key).orderBy("seq_id", "pos"))
    return seeds.withColumn("rank", rank).filter(F.col("rank") <= n)


#: Places of one key that meet the queries in one task; more are dealt to parts.
KEY_PART = 10_000


def look_up(queries: DataFrame, seeds: DataFrame, key: str, n: int | None = 32) -> DataFrame:
    """query_id, q_pos, seq_id, pos: for each query seed the first n seeds of the table, or all
    of them if n is null; the query seeds then meet a frequent key in parts. Seeds are never broadcast:
    plans take them for no more than the texts that they come from."""
    q = queries.select(F.col("seq_id").alias("query_id"), F.col("pos").alias("q_pos"), key)
    if n is None:
        often = seeds.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / KEY_PART).alias("parts")).filter("parts > 1")
        parts = F.coalesce("parts", F.lit(1))
        q = q.join(often, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        s = seeds.select(key, "seq_id", "pos").join(often, key, "left").withColumn("part", F.pmod(F.xxhash64("seq_id", "pos"), parts))
        return q.join(s.hint("merge"), [key, "part"]).select("query_id", "q_pos", "seq_id", "pos")
    return q.join(first_hits(seeds, key, n).select(key, "seq_id", "pos").hint("merge"), key).select("query_id", "q_pos", "seq_id", "pos")
