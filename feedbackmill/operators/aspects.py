"""Aspect mentions: which of a short list of topics each review names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.schemas import NO_ASPECT

# The aspects looked for unless the caller passes others.
ASPECTS = (
    "food", "service", "price", "ambience", "cleanliness", "staff", "atmosphere", "wait", "time",
    "friendly", "taste", "delivery", "order", "quality", "pizza", "crust",
)


def aspect_mentions(reviews: DataFrame, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """One row per review and aspect its lower-cased text contains.

    A review that names none gets one ``Overall Experience`` row; one without text gets none.
    """
    rows = reviews.where(F.coalesce(F.col("review_text"), F.lit("")) != "").select(
        "business_url", "id", "sentiment", F.lower("review_text").alias("_text")
    )
    named = F.array_compact(
        F.array(*[F.when(F.contains("_text", F.lit(a)), F.initcap(F.lit(a))) for a in aspects])
    )
    rows = rows.select("business_url", "id", "sentiment", named.alias("_named"))
    hits = F.when(F.size("_named") == 0, F.array(F.lit(NO_ASPECT))).otherwise(F.col("_named"))
    return rows.select(
        "business_url",
        F.col("id").alias("review_id"),
        F.explode(hits).alias("aspect"),
        F.col("sentiment").alias("sentiment_score"),
    )


def of_reviews(derived: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows of a derived table (aspects, clusters) that belong to the given reviews."""
    ids = reviews.select("business_url", F.col("id").alias("review_id"))
    return derived.join(ids, ["business_url", "review_id"], "left_semi")
