"""Row numbers within each group, computed without sending a group to one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedbackmill.operators.lookup import attach
from feedbackmill.session import stage

ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def ordered_stage(df: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
    """Stage ``df`` range-sorted by group and order, with its sort position as ``_seq``."""
    ordered = df.orderBy(group, *order)
    return stage(ordered.withColumn("_seq", F.monotonically_increasing_id()), "ordered")


def number_runs(staged: DataFrame, group: str, pos: str = "pos") -> DataFrame:
    """Replace ``_seq`` of :func:`ordered_stage` by the 0-based position within the group.

    Rows of a group in one sorted partition form a run. The rows before a run are summed over the
    run table, which has one row per partition and group.
    """
    part = F.shiftright("_seq", ROW_BITS).alias("_part")
    runs = staged.groupBy(group, part).agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_n")
    )
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    rows = staged.withColumn("_part", F.shiftright("_seq", ROW_BITS))
    return (
        attach(rows, runs, [group, "_part"], spread=["_seq"])
        .withColumn(pos, F.col("_seq") - F.col("_first") + F.col("_before"))
        .drop("_part", "_first", "_before")
    )


def with_position(
    df: DataFrame, group: str, order: list[str | Column], pos: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row in its group; ``order`` must be unique in a group."""
    return number_runs(ordered_stage(df, group, order), group, pos).drop("_seq")


def with_line_number(
    df: DataFrame, group: str, order: list[str | Column], pos: str = "pos", line: str = "line_no"
) -> DataFrame:
    """Add the position in the group and a number that rises over all rows, with gaps."""
    numbered = number_runs(ordered_stage(df, group, order), group, pos)
    in_part = F.col("_seq") - F.shiftleft(F.shiftright("_seq", ROW_BITS), ROW_BITS)
    longest = numbered.agg(F.coalesce(F.max(in_part), F.lit(0))).first()[0] + 1
    part = F.shiftright("_seq", ROW_BITS)
    return numbered.withColumn(line, part * F.lit(longest) + in_part).drop("_seq")
