"""Label columns: sentiment, names and JSON payloads."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedbackmill.functions.text import blank_to_null
from feedbackmill.schemas import NEUTRAL, SENTIMENTS, UNKNOWN


def valid_sentiment(label: Column) -> Column:
    """One of the three labels; everything else is Neutral."""
    return F.when(label.isin(*SENTIMENTS), label).otherwise(F.lit(NEUTRAL))


def sentiment_or_neutral(label: Column) -> Column:
    """Missing label is Neutral; other labels stay."""
    return F.coalesce(blank_to_null(label), F.lit(NEUTRAL))


def name_or_unknown(name: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.lit(UNKNOWN))


def title_case(terms: Column) -> Column:
    """Terms joined by commas, each with a capital."""
    return F.initcap(F.array_join(terms, ", "))


def json_body(payload: Column) -> Column:
    """Payload without Markdown fences."""
    return F.trim(F.regexp_replace(payload, "```(json)?", ""))


def parse_struct(payload: Column, schema: str, **defaults) -> Column:
    """Struct read from a JSON payload; missing fields and bad payloads take the defaults."""
    parsed = F.from_json(json_body(payload), schema)
    return F.struct(*[
        F.coalesce(parsed[name], F.lit(value)).alias(name) for name, value in defaults.items()
    ])


def parse_sentiments(payload: Column, size: Column) -> Column:
    """``size`` labels from ``{"sentiments": [...]}``; a gap or a bad payload is Neutral."""
    given = F.from_json(json_body(payload), "sentiments array<string>")["sentiments"]
    slots = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(slots, lambda i: valid_sentiment(F.get(given, i)))


def record_json(*columns: str) -> Column:
    """Row as a JSON record that keeps nulls."""
    return F.to_json(F.struct(*(columns or ("*",))), {"ignoreNullFields": "false"})
