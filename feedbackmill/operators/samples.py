"""Sample texts and the context handed to an insight writer."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.operators.dashboard import KEY, dataset_counts
from feedbackmill.operators.ranking import top_per_group
from feedbackmill.schemas import NEGATIVE, POSITIVE


def sentiment_samples(reviews: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` positive and negative reviews of each business, in row order."""
    rows = reviews.where(F.col("sentiment").isin(POSITIVE, NEGATIVE)).select(
        KEY, "sentiment", "id", "review_text"
    )
    return top_per_group(rows, [KEY, "sentiment"], [F.col("id")], n, ["id"], rank="rank")


def insight_context(reviews: DataFrame, n: int = 5) -> DataFrame:
    """One row per business: counts and the sample texts of both labels, in row order."""
    ranked = F.struct("rank", "review_text")

    def texts(label: str):
        picked = F.collect_list(F.when(F.col("sentiment") == label, ranked))
        return F.transform(F.array_sort(picked), lambda s: s["review_text"])

    samples = (
        sentiment_samples(reviews, n)
        .groupBy(KEY)
        .agg(texts(POSITIVE).alias("pos_samples"), texts(NEGATIVE).alias("neg_samples"))
    )
    empty = F.array().cast("array<string>")
    return (
        dataset_counts(reviews)
        .join(samples, KEY, "left")
        .withColumn("pos_samples", F.coalesce("pos_samples", empty))
        .withColumn("neg_samples", F.coalesce("neg_samples", empty))
    )
