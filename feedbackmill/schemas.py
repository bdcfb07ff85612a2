"""Schemas of the stored and inbound tables, and the label sets they use."""

from pyspark.sql import types as T

POSITIVE, NEGATIVE, NEUTRAL = "Positive", "Negative", "Neutral"
SENTIMENTS = (POSITIVE, NEGATIVE, NEUTRAL)
UNKNOWN = "Unknown"
DEFAULT_DATASET = "Uploaded_CSV"
NO_ASPECT = "Overall Experience"
NO_TOPIC = "General Feedback"

PENDING, COMPLETED, FAILED, NOT_FOUND = "pending", "completed", "failed", "not_found"
SKIPPED = "skipped"  # of a batch that is in the store already; no status of a dataset

RAW_REVIEW = T.StructType([
    T.StructField("user_name", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("review_text", T.StringType()),
])

REVIEWS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("business_url", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
])

ASPECT_SENTIMENTS = T.StructType([
    T.StructField("business_url", T.StringType()),
    T.StructField("review_id", T.LongType()),
    T.StructField("aspect", T.StringType()),
    T.StructField("sentiment_score", T.StringType()),
])

REVIEW_CLUSTERS = T.StructType([
    T.StructField("business_url", T.StringType()),
    T.StructField("review_id", T.LongType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("cluster_label", T.StringType()),
])

TERM_FREQUENCIES = T.StructType([
    T.StructField("business_url", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("rank", T.IntegerType()),
])

DATASET_RUNS = T.StructType([
    T.StructField("business_url", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("warnings", T.StringType()),
    T.StructField("next_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])
