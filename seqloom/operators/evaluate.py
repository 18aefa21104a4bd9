"""Recall, precision, ROC and AUC of scored pairs, and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_scores(hits: DataFrame, pair: list[str], score: str) -> DataFrame:
    return hits.filter(F.col(score).isNotNull()).groupBy(*pair).agg(F.max(score).alias("score"))


def missed_extra(truth: DataFrame, found: DataFrame, pair: list[str]) -> DataFrame:
    """pair, kind: `missed` (true, not found) or `extra` (found, not true)."""
    t, f = truth.select(*pair).distinct(), found.select(*pair).distinct()
    return t.join(f, pair, "left_anti").withColumn("kind", F.lit("missed")).unionByName(f.join(t, pair, "left_anti").withColumn("kind", F.lit("extra")))


def recall_precision(truth: DataFrame, found: DataFrame, pair: list[str]) -> DataFrame:
    """One row: n_true, n_found, n_hit, recall, precision (0 where there is nothing)."""
    t = truth.select(*pair).distinct().withColumn("t", F.lit(1))
    f = found.select(*pair).distinct().withColumn("f", F.lit(1))
    both = t.join(f, pair, "full").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_found"), F.count(F.when(F.col("t") + F.col("f") == 2, 1)).alias("n_hit"))
    div = lambda b: F.when(F.col(b) > 0, F.col("n_hit") / F.col(b)).otherwise(0.0)
    return both.select("n_true", "n_found", "n_hit", div("n_true").alias("recall"), div("n_found").alias("precision"))


def universe_scores(truth: DataFrame, found: DataFrame, pair: list[str], score: str, n_pairs: int) -> DataFrame:
    """score, positive, n: how many of n_pairs pairs have a score, true and false ones apart.

    truth: the true pairs; found: pairs with scores, of which the highest counts. Pairs that
    weren't found score 0, true ones and all others of the n_pairs; the others are a count, no
    rows. Repeated pairs count once, null scores as not found.
    """
    t = truth.select(*pair).distinct().withColumn("true", F.lit(True))
    both = t.join(best_scores(found, pair, score), pair, "full")
    n = both.groupBy(F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("true", F.lit(False)).alias("positive")).agg(F.count(F.lit(1)).alias("n"))
    rest = n.agg((F.lit(n_pairs) - F.coalesce(F.sum("n"), F.lit(0))).cast("long").alias("n")).filter("n > 0")
    return n.unionByName(rest.select(F.lit(0.0).alias("score"), F.lit(False).alias("positive"), "n")).groupBy("score", "positive").agg(F.sum("n").alias("n"))


#: Ranges of scores that are added up one by one.
RANGES = 1_000


def _n(scored: DataFrame) -> Column:
    return F.col("n") if "n" in scored.columns else F.lit(1)


def running_counts(scored: DataFrame, width: float | None = None) -> DataFrame:
    """score, tp, fp: true and false pairs of at least each distinct score. scored: score,
    positive, and n if a row stands for n pairs. Scores are counted first, then added up in two
    levels: over ranges of `width` (by default RANGES of them from the lowest score to the
    highest), and within a range, so no task sees all scores."""
    n = lambda c: F.sum(F.when(c, _n(scored)).otherwise(0)).alias
    per = scored.groupBy("score").agg(n(F.col("positive"))("t"), n(~F.col("positive"))("f"))
    if width is None:
        lo, hi = scored.agg(F.min("score"), F.max("score")).first()
        width = (hi - lo) / RANGES if lo is not None and hi > lo else 1.0
    per = per.withColumn("bin", F.floor(F.col("score") / width))
    bins = per.groupBy("bin").agg(F.sum("t").alias("bt"), F.sum("f").alias("bf"))
    up = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)  # one row per range of scores
    bins = bins.select("bin", F.coalesce(F.sum("bt").over(up), F.lit(0)).alias("bt"), F.coalesce(F.sum("bf").over(up), F.lit(0)).alias("bf"))
    inside = W.partitionBy("bin").orderBy(F.desc("score"))
    return per.join(bins, "bin").select("bin", "score", "bt", "bf", (F.sum("t").over(inside) + F.col("bt")).alias("tp"), (F.sum("f").over(inside) + F.col("bf")).alias("fp"))


def roc_points(scored: DataFrame, width: float | None = None) -> DataFrame:
    """fpr, tpr, one point per distinct score and the origin; the diagonal's two ends if there
    are no positives or no negatives."""
    run = running_counts(scored, width)
    tot = scored.agg(F.coalesce(F.sum(F.when(F.col("positive"), _n(scored))), F.lit(0)), F.coalesce(F.sum(_n(scored)), F.lit(0))).first()
    p, n = tot[0], tot[1] - tot[0]
    if p == 0 or n == 0:
        return scored.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr DOUBLE, tpr DOUBLE")
    return run.select((F.col("fp") / n).alias("fpr"), (F.col("tp") / p).alias("tpr")).unionByName(scored.sparkSession.createDataFrame([(0.0, 0.0)], "fpr DOUBLE, tpr DOUBLE"))


def auc(scored: DataFrame, width: float | None = None) -> DataFrame:
    """One row: auc by trapezoids; null without positives or negatives. A step's area needs
    only the counts before it, which every row of running_counts knows."""
    run = running_counts(scored, width)
    w = W.partitionBy("bin").orderBy(F.desc("score"))
    tp0, fp0 = F.coalesce(F.lag("tp").over(w), F.col("bt")), F.coalesce(F.lag("fp").over(w), F.col("bf"))
    steps = run.select("tp", "fp", tp0.alias("tp0"), fp0.alias("fp0"))
    area = F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2.0)
    return steps.agg(area.alias("a"), F.max("tp").alias("p"), F.max("fp").alias("n")).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / (F.col("p") * F.col("n"))).alias("auc"))


def hash_order(col: Column | str, seed: int = 42) -> Column:
    """A fixed pseudo-random number below 1,000,003 for each whole number."""
    return F.pmod((F.col(col) if isinstance(col, str) else col) % 1_000_003 * 654_435 + seed * 7_919, F.lit(1_000_003))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same each time: those with the smallest hash (ties by key)."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def family_sample(df: DataFrame, family: str, key: str, n: int, per_family: int = 100, seed: int = 42) -> DataFrame:
    """Rows of the largest families first, at most per_family of each in hashed order, until
    n rows are taken. Each chosen family gives a row, so the sizes of the n largest are all
    that one window sees."""
    sizes = df.filter(F.col(family).isNotNull()).groupBy(family).agg(F.count(F.lit(1)).alias("size"))
    order = W.orderBy(F.desc("size"), F.asc(family))
    sizes = sizes.orderBy(F.desc("size"), F.asc(family)).limit(n)
    quota = F.least("size", F.lit(per_family))
    before = F.coalesce(F.sum(quota).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.select(family, F.row_number().over(order).alias("family_rank"), F.least(quota, F.lit(n) - before).alias("take")).filter("take > 0")
    inside = F.row_number().over(W.partitionBy(family).orderBy(hash_order(key, seed), key))
    return df.withColumn("i", inside).filter(F.col("i") <= per_family).join(F.broadcast(ranked), family).filter("i <= take").drop("i", "take")
