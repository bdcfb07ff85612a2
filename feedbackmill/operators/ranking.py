"""Top rows per group that stay parallel when one group holds much of the data."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_IN_LAST_WINDOW = 4096


def top_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    n: int,
    spread: list[str],
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows per group by ``order``; ``spread`` names columns that tell rows apart.

    Each group is first cut to ``n`` rows within each of some shares of its rows (Spark limits
    every map task to ``n`` rows per share before the shuffle), so the last window sees a few
    thousand rows of a group, however large the group is.
    """
    shares = min(max(ROWS_IN_LAST_WINDOW // n, 4), 64)
    share = F.pmod(F.xxhash64(*spread), F.lit(shares))
    in_share = F.row_number().over(W.partitionBy(*group, "_share").orderBy(*order))
    in_group = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    name = rank or "_rank"
    out = (
        df.withColumn("_share", share)
        .withColumn("_rank_in_share", in_share)
        .where(F.col("_rank_in_share") <= n)
        .drop("_share", "_rank_in_share")
        .withColumn(name, in_group)
        .where(F.col(name) <= n)
    )
    return out if rank else out.drop(name)
