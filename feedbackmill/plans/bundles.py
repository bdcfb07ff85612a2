"""Results that are asked for together."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.operators import dashboard as d
from feedbackmill.operators.aspects import of_reviews
from feedbackmill.operators.samples import insight_context
from feedbackmill.operators.terms import top_words
from feedbackmill.schemas import NEGATIVE, NOT_FOUND, POSITIVE
from feedbackmill.session import stage
from feedbackmill.sinks.store import ReviewStore


class DatasetNotFound(LookupError):
    """The store holds no such dataset, or no reviews of it."""


def dashboard_bundle(reviews: DataFrame) -> dict[str, DataFrame]:
    """The dashboard charts. Five of them read one aggregate, which is computed once."""
    totals = stage(d.dashboard_totals(reviews), "totals")
    return {
        "sentiment_breakdown": d.sentiment_breakdown(totals),
        "rating_distribution": d.rating_distribution(totals),
        "avg_rating_by_sentiment": d.avg_rating_by_sentiment(totals),
        "avg_length_by_rating": d.avg_length_by_rating(totals),
        "top_words": top_words(reviews),
        "sentiment_by_rating": d.sentiment_by_rating(totals),
    }


def stored_dashboard(store: ReviewStore, key: str | None = None) -> dict[str, DataFrame]:
    """The dashboard charts of a store, kept up to date by its writes: all but ``top_words`` read no reviews."""
    totals = d.totals_of_partials(store.read("review_totals", key))
    return {
        "sentiment_breakdown": d.sentiment_breakdown(totals),
        "rating_distribution": d.rating_distribution(totals),
        "avg_rating_by_sentiment": d.avg_rating_by_sentiment(totals),
        "avg_length_by_rating": d.avg_length_by_rating(totals),
        "top_words": top_words(store.read("reviews", key)),
        "sentiment_by_rating": d.sentiment_by_rating(totals),
        "monthly_volume_rating": d.months_of_partials(store.read("review_months", key)),
        "dataset_counts": totals.select(d.KEY, "n", "pos", "neg"),
        "overall_average": totals.select(d.KEY, "avg_rating"),
    }


def advanced_bundle(store: ReviewStore, key: str) -> dict[str, DataFrame]:
    """Aspects, clusters, term clouds and the charts over them for one dataset."""
    if store.status(key) == NOT_FOUND:
        raise DatasetNotFound(key)
    reviews = store.read("reviews", key)
    aspects = of_reviews(store.read("aspect_sentiments", key), reviews)
    terms = store.read("term_frequencies", key)
    return {
        "aspects": aspects,
        "clusters": of_reviews(store.read("review_clusters", key), reviews),
        "positive_terms": terms.where(F.col("sentiment") == POSITIVE),
        "negative_terms": terms.where(F.col("sentiment") == NEGATIVE),
        "aspect_sentiment": d.aspect_sentiment(aspects),
        "monthly_volume_rating": d.monthly_volume_rating(reviews),
    }


def insight_bundle(store: ReviewStore, key: str) -> DataFrame:
    """Counts and sample texts of one dataset, for whoever words the insights."""
    reviews = store.read("reviews", key)
    if reviews.isEmpty():
        raise DatasetNotFound(key)
    return insight_context(reviews)
