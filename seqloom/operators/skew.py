"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.01
#: Below this many rows a key is never hot: one task takes it in its stride.
HOT_ROWS = 20_000


def hot_values(counts: DataFrame, key: str, count: str, total: int, share: float = HOT_SHARE) -> list:
    """Keys that hold at least `share` of `total` rows, from a table of one count per key.

    By the pigeonhole principle the list has at most 1 / share entries, whatever the data.
    """
    least = max(share * total, HOT_ROWS)
    if total < least:
        return []
    return [r[0] for r in counts.filter(F.col(count) >= least).select(key).collect()]


def hot_keys(df: DataFrame, key: str, rows: int, total: int) -> list:
    """`hot_values` of a table of `rows` rows itself; where too few for a hot key, no job runs."""
    if rows < max(HOT_ROWS, HOT_SHARE * total):
        return []
    return hot_values(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n", total)


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """Join where `right` has one row per key and `left` any number.

    Rows of the hot keys (a bounded list) meet a broadcast of those few rows of `right`
    and are never shuffled; all others take the usual shuffle join. Null keys match nothing
    and stay spread out as they are ("left") or go ("inner").
    """
    null = left.filter(F.col(key).isNull())
    cold, parts = left.filter(F.col(key).isNotNull()), []
    if hot:
        is_hot = F.col(key).isin(hot)
        parts.append(cold.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))
        cold, right = cold.filter(~is_hot), right.filter(~is_hot)
    parts.append(cold.join(right, key, how))
    if how == "left":
        extra = [c for c in right.columns if c not in left.columns]
        types = dict(right.dtypes)
        parts.append(null.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in extra]))
    return reduce(lambda a, b: a.unionByName(b), parts)
