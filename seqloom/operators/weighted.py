"""Per-key results without hot tasks: value-frequency compression.

Rows are first grouped by key *and* value, so that a key with a third of all rows spreads
over all tasks; what reaches the grouping by key alone is one weighted row per distinct
value, and that grouping combines on the map side before it shuffles. Counts, distinct
counts, modes and percentiles of the original rows follow exactly from the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def value_frequencies(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per distinct (key, *values) with none of them null, and its `weight`.

    Other columns are left out, whatever their names. An empty table gives an empty table.
    """
    cols = [key, *values]
    kept = df.select(*cols).dropna(subset=cols)
    return kept.groupBy(*cols).agg(F.count(F.lit(1)).alias("weight"))


def per_key_counts(freq: DataFrame, key: str) -> DataFrame:
    """Per key: number of distinct values, and number of rows that carried them."""
    return freq.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), F.sum("weight").alias("n_rows"))


def per_key_mode(freq: DataFrame, key: str, value: str, weight: Column | None = None) -> DataFrame:
    """Per key the value with most weight (ties: the smallest value), and the number of
    distinct values. `freq` may hold several rows per (key, value): they are added first."""
    w = F.sum("weight") if weight is None else F.sum(weight)
    per = freq.groupBy(key, value).agg(w.alias("w"))
    return per.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.max("w").alias("mode_weight"),
        F.min_by(value, F.struct(-F.col("w"), F.col(value))).alias("mode"),
    )


def weighted_percentiles(freq: DataFrame, key: str, value: str, qs: list[float], width: int = 4096) -> DataFrame:
    """Exact discrete percentiles of an integer value per key: the smallest value at which
    the running weight reaches q of the key's total.

    Two levels keep every window small: weights are added per bucket of `width` values; a
    window over a key's buckets finds the bucket that a percentile falls in; a second
    window ranks only the distinct values (at most `width`) of that bucket.
    Result: key, q, value.
    """
    per = freq.groupBy(key, value).agg(F.sum("weight").alias("w")).withColumn("bucket", F.floor(F.col(value) / width))
    buckets = per.groupBy(key, "bucket").agg(F.sum("w").alias("bw"))
    run = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    placed = buckets.select(key, "bucket", "bw", F.sum("bw").over(run).alias("upto"), F.sum("bw").over(W.partitionBy(key)).alias("total"))
    q = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("q")) for x in qs])).alias("t")
    wanted = (
        placed.select(key, "bucket", "bw", "upto", "total", q)
        .select(key, "bucket", "t.q", (F.col("upto") - F.col("bw")).alias("before"), "upto", F.greatest(F.ceil(F.col("t.q") * F.col("total")), F.lit(1)).alias("rank"))
        .filter("before < rank AND rank <= upto")
    )
    inside = per.join(wanted, [key, "bucket"])
    grow = W.partitionBy(key, "q").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return inside.withColumn("run", F.col("before") + F.sum("w").over(grow)).filter("run >= rank").groupBy(key, "q").agg(F.min(value).alias(value))
