"""Joins of a large table to a small one that stay parallel when one key holds much of the data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.session import stage, stored_bytes

SALTS = 32
BROADCAST_BYTES = 4 * 1024 * 1024  # of Parquet files; a few times as much in memory


def spread_join(
    df: DataFrame, staged: DataFrame, on: list[str], spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join ``df`` to a staged table with few rows per key.

    The size of the staged table is read from its files. Up to ``BROADCAST_BYTES`` it is broadcast
    and ``df`` is not shuffled. Beyond that, a key that holds much of ``df`` is spread over
    ``SALTS`` reducers by the columns ``spread``, with a copy of its lookup rows on each. Null keys
    are equal, so that rows without a key are not lost.
    """
    small = staged.withColumnsRenamed({k: f"_key_{k}" for k in on})
    same = F.lit(True)
    for key in on:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    if stored_bytes(staged) <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(small), same, how)
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        copies = small.withColumn("_copy", every).hint("merge")
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
        joined = salted.join(copies, same & (F.col("_salt") == F.col("_copy")), how)
    return joined.drop("_salt", "_copy", *[f"_key_{k}" for k in on])


def attach(
    df: DataFrame, lookup: DataFrame, on: list[str], spread: list[str], how: str = "inner"
) -> DataFrame:
    """Stage ``lookup``, which is not staged yet, and :func:`spread_join` it to ``df``."""
    return spread_join(df, stage(lookup, "lookup"), on, spread, how)
