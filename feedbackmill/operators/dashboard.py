"""Dashboard aggregates, for every business at once.

All charts that group by sentiment or rating bucket come from one wide aggregation per business.
Labels and buckets are fixed, so they are conditional counts: no join is needed to fill zeros.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedbackmill.functions.dates import month_period
from feedbackmill.functions.labels import sentiment_or_neutral
from feedbackmill.functions.ratings import half_up, rating_bucket, rating_or_zero
from feedbackmill.functions.text import utf16_length
from feedbackmill.schemas import NEGATIVE, POSITIVE, SENTIMENTS, UNKNOWN

KEY = "business_url"
BUCKETS = (1, 2, 3, 4, 5)


def _long(wide: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """One output row per entry of ``rows``, named ``names``."""
    entries = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return wide.select(KEY, F.inline(F.array(*entries)))


CHARTS = ("sentiment", "rating", "sentiment_rating", "rating_length", "cross")


def dashboard_totals(reviews: DataFrame, *charts: str) -> DataFrame:
    """One row per business with the counts and means of the asked charts, all unless named."""
    rows = reviews.select(
        KEY,
        sentiment_or_neutral(F.col("sentiment")).alias("sentiment"),
        rating_bucket(F.col("rating")).alias("bucket"),
        rating_or_zero(F.col("rating")).alias("rating"),
        utf16_length(F.col("review_text")).alias("length"),
    )
    labelled = {s: F.col("sentiment") == s for s in SENTIMENTS}
    rated = {b: F.col("bucket") == b for b in BUCKETS}
    aggs = {
        "sentiment": lambda: [F.count_if(c).alias(f"n_{s}") for s, c in labelled.items()],
        "rating": lambda: [F.count_if(c).alias(f"n_{b}") for b, c in rated.items()],
        "sentiment_rating": lambda: [
            F.avg(F.when(c, F.col("rating"))).alias(f"rating_{s}") for s, c in labelled.items()
        ],
        "rating_length": lambda: [
            F.avg(F.when(c, F.col("length"))).alias(f"length_{b}") for b, c in rated.items()
        ],
        "cross": lambda: [
            F.count_if(cs & cb).alias(f"n_{s}_{b}")
            for s, cs in labelled.items() for b, cb in rated.items()
        ],
    }
    return rows.groupBy(KEY).agg(*[a for chart in charts or CHARTS for a in aggs[chart]()])


# Partial sums that can be added up: those of parts of a business's reviews give those of all of them.

COUNTS = (
    "n", "pos", "neg", "rated", *(f"n_{s}" for s in SENTIMENTS), *(f"n_{b}" for b in BUCKETS),
    *(f"n_{s}_{b}" for s in SENTIMENTS for b in BUCKETS), *(f"length_sum_{b}" for b in BUCKETS),
)
SUMS = ("rating_sum", *(f"rating_sum_{s}" for s in SENTIMENTS))


def dashboard_partials(reviews: DataFrame) -> DataFrame:
    """One row per business with ``COUNTS`` (long) and ``SUMS`` (double)."""
    rows = reviews.select(
        KEY, F.col("sentiment").alias("given"), F.col("rating").alias("raw"),
        sentiment_or_neutral(F.col("sentiment")).alias("sentiment"),
        rating_bucket(F.col("rating")).alias("bucket"),
        rating_or_zero(F.col("rating")).alias("rating"),
        utf16_length(F.col("review_text")).cast("long").alias("length"),
    )
    labelled = {s: F.col("sentiment") == s for s in SENTIMENTS}
    rated = {b: F.col("bucket") == b for b in BUCKETS}
    made = {
        "n": F.count("*"), "pos": F.count_if(F.col("given") == POSITIVE), "neg": F.count_if(F.col("given") == NEGATIVE),
        "rated": F.count("raw"), "rating_sum": F.coalesce(F.sum("raw"), F.lit(0.0)),
    }
    for s, is_s in labelled.items():
        made[f"n_{s}"] = F.count_if(is_s)
        made[f"rating_sum_{s}"] = F.coalesce(F.sum(F.when(is_s, F.col("rating"))), F.lit(0.0))
        made |= {f"n_{s}_{b}": F.count_if(is_s & is_b) for b, is_b in rated.items()}
    for b, is_b in rated.items():
        made[f"n_{b}"] = F.count_if(is_b)
        made[f"length_sum_{b}"] = F.coalesce(F.sum(F.when(is_b, F.col("length"))), F.lit(0).cast("long"))
    return rows.groupBy(KEY).agg(*(made[c].alias(c) for c in (*COUNTS, *SUMS)))


def totals_of_partials(partials: DataFrame) -> DataFrame:
    """What :func:`dashboard_totals` gives for all charts, with n, pos, neg and avg_rating, from partial sums."""
    added = partials.groupBy(KEY).agg(*(F.sum(c).alias(c) for c in (*COUNTS, *SUMS)))

    def mean(total: str, count: str) -> Column:
        return F.when(F.col(count) > 0, F.col(total) / F.col(count))

    means = {f"rating_{s}": mean(f"rating_sum_{s}", f"n_{s}") for s in SENTIMENTS}
    means |= {f"length_{b}": mean(f"length_sum_{b}", f"n_{b}") for b in BUCKETS}
    return added.withColumns(means | {"avg_rating": mean("rating_sum", "rated")})


def monthly_partials(reviews: DataFrame) -> DataFrame:
    """Number and sum of ratings per business and month that has a readable date."""
    rows = reviews.select(KEY, month_period(F.col("date")).alias("period"), rating_or_zero(F.col("rating")).alias("rating"))
    return rows.where(F.col("period") != UNKNOWN).groupBy(KEY, "period").agg(
        F.count("*").alias("n"), F.sum("rating").alias("rating_sum")
    )


def months_of_partials(partials: DataFrame) -> DataFrame:
    """What :func:`monthly_volume_rating` gives, from partial sums."""
    return (
        partials.groupBy(KEY, "period")
        .agg(F.sum("n").alias("n"), (F.sum("rating_sum") / F.sum("n")).alias("avg_rating"))
        .orderBy(KEY, "period")
    )


def sentiment_breakdown(totals: DataFrame) -> DataFrame:
    return _long(totals, [[F.lit(s), F.col(f"n_{s}")] for s in SENTIMENTS], ["sentiment", "n"])


def rating_distribution(totals: DataFrame) -> DataFrame:
    label = {b: F.lit("1 Star" if b == 1 else f"{b} Stars") for b in BUCKETS}
    rows = [[F.lit(b).cast("long"), label[b], F.col(f"n_{b}")] for b in BUCKETS]
    return _long(totals, rows, ["bucket", "label", "n"])


def avg_rating_by_sentiment(totals: DataFrame) -> DataFrame:
    rows = [[F.lit(s), F.coalesce(F.col(f"rating_{s}"), F.lit(0.0))] for s in SENTIMENTS]
    return _long(totals, rows, ["sentiment", "avg_rating"])


def avg_length_by_rating(totals: DataFrame) -> DataFrame:
    rows = [
        [F.lit(b).cast("long"), F.coalesce(half_up(F.col(f"length_{b}")), F.lit(0).cast("long"))]
        for b in BUCKETS
    ]
    return _long(totals, rows, ["bucket", "avg_length"])


def sentiment_by_rating(totals: DataFrame) -> DataFrame:
    rows = [
        [F.lit(s), F.lit(b).cast("long"), F.col(f"n_{s}_{b}")] for s in SENTIMENTS for b in BUCKETS
    ]
    return _long(totals, rows, ["sentiment", "bucket", "n"])


def aspect_sentiment(aspects: DataFrame) -> DataFrame:
    """Counts of the three labels per aspect."""
    return aspects.groupBy(KEY, "aspect").agg(
        *[F.count_if(F.col("sentiment_score") == s).alias(s.lower()) for s in SENTIMENTS]
    )


def monthly_volume_rating(reviews: DataFrame) -> DataFrame:
    """Review count and mean rating per month; rows without a readable date are left out."""
    rows = reviews.select(
        KEY,
        month_period(F.col("date")).alias("period"),
        rating_or_zero(F.col("rating")).alias("rating"),
    )
    return (
        rows.where(F.col("period") != UNKNOWN)
        .groupBy(KEY, "period")
        .agg(F.count("*").alias("n"), F.avg("rating").alias("avg_rating"))
        .orderBy(KEY, "period")
    )


def dataset_counts(reviews: DataFrame) -> DataFrame:
    """Rows, and rows labelled positive and negative, per business."""
    return reviews.groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sentiment") == POSITIVE).alias("pos"),
        F.count_if(F.col("sentiment") == NEGATIVE).alias("neg"),
    )


def overall_average(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(KEY).agg(F.avg("rating").alias("avg_rating"))
