from collections import Counter

from seqloom.operators import skew


def test_hot_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    left = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 0), (None, 1), (9, 2)], "k INT, v INT")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k INT, w STRING")
    counts = left.groupBy("k").count()
    hot = skew.hot_values(counts, "k", "count", 33, 0.5)
    assert hot == [1]
    for how in ("left", "inner"):
        got = Counter(map(tuple, skew.hot_join(left, right, "k", hot, how).select("k", "v", "w").collect()))
        assert got == Counter(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()))


def test_few_hot_values(spark):
    counts = spark.createDataFrame([(i, 10**6) for i in range(500)], "k INT, n BIGINT")
    assert len(skew.hot_values(counts, "k", "n", 500 * 10**6)) <= 1 / skew.HOT_SHARE
