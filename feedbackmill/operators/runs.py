"""Views over the run registry: the latest state of each dataset."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.operators.dashboard import KEY
from feedbackmill.schemas import NOT_FOUND


def latest_status(runs: DataFrame) -> DataFrame:
    """One row per dataset: the status with the latest time stamp."""
    return runs.groupBy(KEY).agg(F.max_by("status", "ts").alias("status"))


def status_of(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of each asked dataset; one without a run is ``not_found``."""
    found = keys.join(latest_status(runs), KEY, "left")
    return found.withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))


def duplicate_keys(datasets: DataFrame) -> DataFrame:
    """Keys that occur more than once in a table meant to have one row per key."""
    return datasets.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > 1)
