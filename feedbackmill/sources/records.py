"""Structured review records and the choice between two sources of a dataset."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.functions.labels import json_body
from feedbackmill.operators.dashboard import KEY
from feedbackmill.operators.lookup import attach
from feedbackmill.schemas import RAW_REVIEW


def parse_records(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per review in a JSON list; ``item_pos`` is its place. A bad payload gives no row."""
    items = F.from_json(json_body(F.col(payload)), f"array<{RAW_REVIEW.simpleString()}>")
    kept = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*kept, F.posexplode(items).alias("item_pos", "_item"))
    return rows.where(F.col("_item").isNotNull()).select(*kept, "item_pos", "_item.*")


def prefer(primary: DataFrame, fallback: DataFrame, spread: list[str]) -> DataFrame:
    """Rows of ``primary``, and rows of ``fallback`` for the datasets ``primary`` does not have.

    ``spread`` names columns that tell the rows of a dataset apart.
    """
    covered = primary.select(KEY).distinct()
    return primary.unionByName(attach(fallback, covered, [KEY], spread, "left_anti"))
