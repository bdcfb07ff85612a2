"""Reviews built from the sample tables: documents are reviews, their source is the business."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedbackmill.schemas import NEGATIVE, NEUTRAL, POSITIVE

_FROM_EVENTS = {"user_name", "rating"}
_FROM_ORDERS = {"date"}
_FROM_LABELS = {"sentiment"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_reviews(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The asked columns of ``reviews``; a table that supplies none of them is not read."""
    out = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("business_url"),
        F.col("text").alias("review_text"),
    )
    wanted = set(columns)
    if wanted & _FROM_EVENTS:
        events = table(spark, sf_dir, "events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_name"),
            F.least(F.floor(F.col("value") / 10) / 2, F.lit(5.5)).alias("rating"),
        )
        out = out.join(events, "id", "left")
    if wanted & _FROM_ORDERS:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        )
        out = out.join(orders, "id", "left")
    if wanted & _FROM_LABELS:
        labels = table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("id"),
            F.when(F.col("toxic") == 1, NEGATIVE)
            .when(F.col("quality") == 1, POSITIVE)
            .when(F.col("quality") == 0, NEUTRAL)
            .alias("sentiment"),
        )
        out = out.join(labels, "id", "left")
    return out.select(*columns)
