"""Top N items within every group: two-stage salted ranking.

Each group is hashed into subgroups by the item's identifier. N are kept per subgroup (Spark
limits each subgroup in the map tasks already, so rows beyond N never reach the shuffle),
then the survivors, at most N a subgroup, are ranked by score and identifier. A group of
millions of items never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Subgroups per group.
SALTS = 32


def top_n(df: DataFrame, group: str, order: list[Column], item: str, n: int, salts: int = SALTS) -> DataFrame:
    """group, item, rank: the first n items of each group in `order`, which must end with the
    item so that ties fall the same way each time.

    Repeated rows of an item count once; they are put together in the map tasks first, so an
    item that is loaded a million times doesn't reach one task. `order` must be equal in all
    rows of an item. A null group is a group of its own; filter before if it shouldn't count.
    Groups with fewer than n items come whole; an empty table gives an empty table.
    """
    once = df.dropDuplicates([group, item]).withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)))
    kept = once.withColumn("_rank", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.select(group, item, "rank")
