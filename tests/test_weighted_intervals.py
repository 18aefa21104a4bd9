"""Weighted results and interval maps against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.operators import intervals, weighted


def test_values(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "z"), ("b", 5, None)]
    df = spark.createDataFrame(rows, "k STRING, v INT, weight STRING")  # a column whose name clashes
    got = {(r.k, r.v): r.weight for r in weighted.value_frequencies(df, "k", ["v"]).collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, ("b", 5): 1}
    freq = weighted.value_frequencies(df, "k", ["v"])
    assert {r.k: (r.n_values, r.n_rows) for r in weighted.per_key_counts(freq, "k").collect()} == {"a": (2, 3), "b": (1, 1)}
    assert {r.k: (r.mode, r.n_distinct) for r in weighted.per_key_mode(freq, "k", "v").collect()} == {"a": (1, 2), "b": (5, 1)}
    assert weighted.per_key_counts(weighted.value_frequencies(df.limit(0), "k", ["v"]), "k").count() == 0


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(1, 7), (1, 3), (1, 9)], "k INT, v INT")
    assert weighted.per_key_mode(weighted.value_frequencies(df, "k", ["v"]), "k", "v").first().mode == 3


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_percentiles(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aab"), rng.randrange(-20, 20)) for _ in range(300)]
    freq = weighted.value_frequencies(spark.createDataFrame(rows, "k STRING, v INT"), "k", ["v"])
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r.k, r.q): r.v for r in weighted.weighted_percentiles(freq, "k", "v", qs, width).collect()}
    for k in "ab":
        vals = sorted(v for x, v in rows if x == k)
        for q in qs:
            at = max(1, -(-len(vals) * int(q * 100) // 100))
            assert got[k, q] == vals[at - 1]


def covered(rows):
    out = {}
    for k, a, b in rows:
        if a is not None and b is not None:
            out.setdefault(k, set()).update(range(min(a, b), max(a, b) + 1))
    return out


def runs(points):
    out = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(0, 9))))
def test_map(pairs):
    m, points = intervals.IntervalMap(), set()
    for lo, n in pairs:
        m.insert(lo, lo + n)
        points.update(range(lo, lo + n + 1))
    assert list(zip(m.starts, m.ends)) == runs(points)
    assert m.gaps() == [(a[1] + 1, b[0] - 1) for a, b in zip(runs(points), runs(points)[1:])]


def test_runs_of_blocks():
    rng = random.Random(4)
    rows = [(rng.randrange(4), a := rng.choice([-(2**62), 0, 2**62]) + rng.randrange(60), a + rng.randrange(8)) for _ in range(300)]
    row, lo, hi = intervals.merge_runs(*map(np.array, zip(*rows)))
    want = {k: runs(p) for k, p in covered(rows).items()}
    assert [(rows[i][0], a, b) for i, a, b in zip(row, lo.tolist(), hi.tolist())] == [(k, *x) for k in sorted(want) for x in want[k]]


@pytest.mark.parametrize(("batch", "block", "fan"), [("10000", 200_000, 64), ("3", 10, 1), ("7", 5, 2), ("20", 40, 64)])
def test_gaps_and_periods(spark, monkeypatch, batch, block, fan):
    """Also with several Arrow batches a task, tiny blocks and a merge tree of several levels."""
    monkeypatch.setattr(intervals, "TILE", 16)
    monkeypatch.setattr(intervals, "BLOCK_ROWS", block)
    monkeypatch.setattr(intervals, "FAN", max(fan, 2))
    monkeypatch.setattr(intervals, "BLOCK_BYTES", 4_000_000 if fan > 2 else 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check_gaps_and_periods(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def check_gaps_and_periods(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), rng.choice([None, *range(-40, 300)]), None) for _ in range(150)]
    rows = [(k, a, None if a is None or rng.random() < 0.05 else a + rng.randrange(-6, 7)) for k, a, _ in rows]
    rows += rows[:20] + [("long", 0, 200), ("long", 260, 260), ("empty", None, None), ("one", 5, 5)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "k STRING, a INT, b INT, gap_from STRING")
    want = {k: runs(p) for k, p in covered(rows).items()}
    got = intervals.periods(df, ["k"], F.col("a"), F.col("b")).collect()
    assert Counter((r.k, r.lo, r.hi) for r in got) == Counter((k, *x) for k, v in want.items() for x in v)
    got = intervals.gaps(df, ["k"], F.col("a"), F.col("b")).collect()
    assert Counter((r.k, r.gap_from, r.gap_to) for r in got) == Counter((k, a[1] + 1, b[0] - 1) for k, v in want.items() for a, b in zip(v, v[1:]))
    assert intervals.gaps(df.limit(0), ["k"], F.col("a"), F.col("b")).count() == 0


def test_integer_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, 2), (None, 1, 2), (None, 5, 6), (2**60 + 1, 1, 1)], "k BIGINT, a INT, b INT")
    assert {(r.k, r.lo) for r in intervals.periods(df, ["k"], F.col("a"), F.col("b")).collect()} == {(1, 1), (None, 1), (None, 5), (2**60 + 1, 1)}
    with pytest.raises(ValueError):
        intervals.gaps(df.withColumnRenamed("k", "lo"), ["lo"], F.col("a"), F.col("b"))
