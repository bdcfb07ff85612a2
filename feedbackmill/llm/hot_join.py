"""Joins of rows to the groups they form, when one group may hold a large part of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than this part of all rows is hot; so there are fewer hot groups than its inverse.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Each row with the columns of its group; rows without one are left out.

    ``groups`` has a row per key with its number of rows in ``size``; ``total`` is that of all rows.
    Fewer than ``1 / HOT_SHARE`` groups can be hot, whatever the size of the data, so those are
    broadcast and their rows stay where they lie. No key of the other rows, which are shuffled,
    holds more than ``HOT_SHARE`` of them. Both tables should be staged, as they are read twice.
    Null keys meet no group.
    """
    hot = F.col(size) > F.lit(max(1.0, total * HOT_SHARE))
    large = F.broadcast(groups.where(hot))
    met = rows.join(large, keys)
    rest = rows.join(large.select(*keys), keys, "left_anti").join(groups.where(~hot), keys)
    return met.unionByName(rest)


def without_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """The rows that :func:`join_groups` leaves out."""
    hot = F.col(size) > F.lit(max(1.0, total * HOT_SHARE))
    large = F.broadcast(groups.where(hot).select(*keys))
    return rows.join(large, keys, "left_anti").join(groups.where(~hot).select(*keys), keys, "left_anti")


def join_spread(rows: DataFrame, table: DataFrame, key: str, spread: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join of ``rows`` to a table with any number of rows per key; hot keys of ``rows`` are spread.

    ``counts`` has key and n, the number of rows of a key, of ``total`` in all; it should be staged.
    A hot key's rows go to as many tasks as it holds times ``HOT_SHARE``, by the column ``spread``,
    with a copy of the key's rows of ``table`` in each. Other keys are not copied.
    """
    bound = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n") > F.lit(bound)).select(key, F.ceil(F.col("n") / bound).cast("int").alias("_copies")))
    salt = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_copies")).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))
    salted = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_copies")
    copied = table.join(hot, key, "left").withColumn("_salt", copies).drop("_copies")
    return salted.join(copied, [key, "_salt"]).drop("_salt")
