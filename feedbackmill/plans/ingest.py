"""Ingest jobs: reviews from CSV files or stored pages into the store, with all derived tables."""

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedbackmill.functions.dates import fill_unknown_date, normalize_date
from feedbackmill.functions.text import clean_text
from feedbackmill.operators.aspects import ASPECTS, aspect_mentions
from feedbackmill.operators.dashboard import KEY
from feedbackmill.operators.positions import with_line_number
from feedbackmill.operators.sentiment import Scorer, classify_sentiment, lexicon_sentiment
from feedbackmill.operators.terms import term_frequencies
from feedbackmill.operators.topics import cluster_reviews
from feedbackmill.schemas import COMPLETED, FAILED, PENDING, SKIPPED
from feedbackmill.session import scratch, stage
from feedbackmill.sinks.commit_log import ConflictingWrite
from feedbackmill.sinks.store import ReviewStore
from feedbackmill.sources.csv_files import read_review_csv
from feedbackmill.sources.pages import Selectors, dataset_of, page_items
from feedbackmill.sources.records import prefer

log = logging.getLogger(__name__)

RAW_COLUMNS = (KEY, "pos", "line_no", "user_name", "rating", "date", "review_text")
DERIVED = ("aspect_sentiments", "review_clusters", "term_frequencies")


@dataclass(frozen=True)
class IngestOptions:
    as_of: date | None = None  # day that relative dates count back from; today unless given
    scorer: Scorer | None = None  # labels texts; the word lists are used unless given
    batch_size: int = 50
    aspects: tuple[str, ...] = ASPECTS
    n_clusters: int = 5
    stop_words: list[str] | None = None
    derived: tuple[str, ...] = DERIVED  # the derived tables to fill


@dataclass
class RunResult:
    run_id: str
    status: str
    warnings: list[str] = field(default_factory=list)


def prepare(raw: DataFrame, first_id: int, options: IngestOptions) -> DataFrame:
    """Raw rows as reviews: cleaned, labelled, dated and numbered."""
    as_of = F.current_date() if options.as_of is None else F.lit(options.as_of)
    cleaned = raw.withColumn("review_text", clean_text(F.col("review_text")))
    if options.scorer is None:
        labelled = lexicon_sentiment(cleaned)
    else:
        labelled = classify_sentiment(cleaned, options.scorer, options.batch_size)
    dated = normalize_date(F.col("date"), as_of)
    return labelled.select(
        (F.lit(first_id) + F.col("line_no")).alias("id"),
        KEY,
        "user_name",
        "rating",
        fill_unknown_date(dated, F.col("pos"), as_of).alias("date"),
        "review_text",
        "sentiment",
    )


def derived_tables(options: IngestOptions, warnings: list[str]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """How each of the wanted derived tables follows from the reviews."""
    tables = {
        "aspect_sentiments": lambda r: aspect_mentions(r, options.aspects),
        "review_clusters": lambda r: cluster_reviews(
            r, options.n_clusters, stop_words=options.stop_words, warnings=warnings
        ),
        "term_frequencies": lambda r: term_frequencies(r, merge_plurals=True, collocations=True),
    }
    return {name: tables[name] for name in options.derived}


def ingest(
    store: ReviewStore, raw: DataFrame, datasets: DataFrame, options: IngestOptions, batch: str | None = None
) -> RunResult:
    """Replace ``datasets`` by the raw rows and all that is derived from them.

    A derived table that fails leaves a warning; any other failure marks the run as failed and is
    raised. The scorer is called once per review, since its labels are staged. If another run replaces
    one of the datasets in the meantime, this one fails. ``batch`` names the batch of a stream; one whose
    reviews are in the store already changes nothing and is skipped.
    """
    run = RunResult(uuid.uuid4().hex, PENDING)
    if batch and store.log.has_batch(batch):
        run.status = SKIPPED
        return run
    since = store.log.version()
    # Observed while the rows are staged; they are numbered once.
    seen = Observation()
    last = F.coalesce(F.max("line_no"), F.lit(-1)).alias("last")
    raw = stage(raw.observe(seen, last), "raw")
    first_id = store.take_ids(seen.get["last"] + 1)
    next_id = first_id + seen.get["last"] + 1
    store.log_run(datasets, run.run_id, PENDING, next_id)
    try:
        reviews = stage(prepare(raw, first_id, options), "reviews")
        store.replace("reviews", reviews, datasets, since, run.run_id, batch)
        for table, derive in derived_tables(options, run.warnings).items():
            try:
                store.replace(table, stage(derive(reviews), table), datasets, since, run.run_id)
            except ConflictingWrite:
                raise
            except Exception as e:
                log.warning("%s was not derived", table, exc_info=True)
                run.warnings.append(f"{table}: {type(e).__name__}")
                # What was derived from the replaced reviews must not stay.
                store.clear(table, datasets, since, run.run_id)
        run.status = COMPLETED
    except Exception:
        run.status = FAILED
        raise
    finally:
        store.log_run(datasets, run.run_id, run.status, next_id, "; ".join(run.warnings))
    return run


def ingest_csv(
    store: ReviewStore,
    paths: list[str],
    options: IngestOptions = IngestOptions(),
    max_rows: int | None = None,
    multi_line: bool = True,
    batch: str | None = None,
) -> RunResult:
    """The files replace the datasets that their titles, or else their names, stand for.

    Files of one dataset are parts of one upload, in the order in which they were written.
    """
    with scratch(store.spark):
        raw, datasets = read_review_csv(store.spark, paths, max_rows, multi_line)
        return ingest(store, raw, datasets, options, batch)


def ingest_pages(
    store: ReviewStore,
    pages: DataFrame,
    records: DataFrame | None = None,
    options: IngestOptions = IngestOptions(),
    selectors: Selectors = Selectors(),
    max_items: int | None = None,
) -> RunResult:
    """Stored pages (page_id, url, html) replace the datasets of their addresses.

    ``records`` holds structured rows (business_url, page_id, item_pos and the review fields); a
    dataset that has any takes those and not the rows found in its pages.
    """
    with scratch(store.spark):
        # Staged, since the sort below reads its input twice and pages should be parsed once.
        items = stage(page_items(pages, selectors, max_items), "items")
        datasets = pages.select(dataset_of(F.col("url")).alias(KEY)).distinct()
        if records is not None:
            order = ["page_id", "item_pos"]
            items = prefer(records.select(*items.columns), items, spread=order)
            datasets = datasets.union(records.select(KEY)).distinct()
        raw = with_line_number(items, KEY, ["page_id", "item_pos"]).select(*RAW_COLUMNS)
        return ingest(store, raw, stage(datasets, "datasets"), options)
