"""Named queries over the sample tables, one per operator; the entry module registers them."""

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedbackmill.functions.dates import fill_unknown_date, month_period, normalize_date
from feedbackmill.functions.labels import (
    name_or_unknown,
    parse_sentiments,
    parse_struct,
    record_json,
    title_case,
    valid_sentiment,
)
from feedbackmill.functions.ratings import parse_rating, rating_bucket
from feedbackmill.functions.text import chart_tokens, clean_text, utf16_length
from feedbackmill.operators import aspects as asp
from feedbackmill.operators import dashboard, runs, samples, sentiment, terms, tfidf, topics
from feedbackmill.operators.positions import with_position
from feedbackmill.operators.ranking import top_per_group
from feedbackmill.plans import adhoc, bundles
from feedbackmill.plans.ingest import IngestOptions, ingest_csv, ingest_pages
from feedbackmill.schemas import UNKNOWN
from feedbackmill.session import hadoop_path, shared_dir, stage
from feedbackmill.sinks.csv_export import export_csv
from feedbackmill.sinks.store import ReviewStore
from feedbackmill.sources import csv_files
from feedbackmill.sources.pages import Selectors, page_items
from feedbackmill.sources.records import parse_records, prefer
from feedbackmill.sources.sample_tables import sample_reviews, table
from feedbackmill.streaming.drop_folder import stream_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = "business_url"
# Word parts that the sample texts hold, since they name none of the default aspects.
SAMPLE_ASPECTS = ("the", "heit", "tion", "ment", "ado")
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = ("that", "with", "est"), ("this", "from", "une")


def as_of():
    """Fixed day that relative dates count back from."""
    return F.lit("2025-01-31").cast("date")


def length_scorer(texts: list[str]) -> list[str]:
    """Stand-in for a model: the label follows from the length of the text."""
    return [("Positive", "Negative", "mixed")[len(t) % 3] for t in texts]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Dashboards


def _totals(spark, sf_dir, chart, *columns):
    """Totals of one chart, read from the columns it needs."""
    rows = sample_reviews(spark, sf_dir, KEY, *columns)
    kinds = {"sentiment": "string", "rating": "double", "review_text": "string"}
    unused = {n: F.lit(None).cast(kind) for n, kind in kinds.items() if n not in columns}
    return dashboard.dashboard_totals(rows.withColumns(unused), chart)


@query
def sentiment_breakdown(spark, sf_dir):
    return dashboard.sentiment_breakdown(_totals(spark, sf_dir, "sentiment", "sentiment"))


@query
def rating_distribution(spark, sf_dir):
    return dashboard.rating_distribution(_totals(spark, sf_dir, "rating", "rating"))


@query
def avg_rating_by_sentiment(spark, sf_dir):
    totals = _totals(spark, sf_dir, "sentiment_rating", "sentiment", "rating")
    return dashboard.avg_rating_by_sentiment(totals)


@query
def avg_length_by_rating(spark, sf_dir):
    totals = _totals(spark, sf_dir, "rating_length", "rating", "review_text")
    return dashboard.avg_length_by_rating(totals)


@query
def sentiment_by_rating(spark, sf_dir):
    return dashboard.sentiment_by_rating(_totals(spark, sf_dir, "cross", "sentiment", "rating"))


@query
def monthly_volume_rating(spark, sf_dir):
    return dashboard.monthly_volume_rating(sample_reviews(spark, sf_dir, KEY, "date", "rating"))


@query
def dataset_counts(spark, sf_dir):
    return dashboard.dataset_counts(sample_reviews(spark, sf_dir, KEY, "sentiment"))


@query
def overall_average(spark, sf_dir):
    return dashboard.overall_average(sample_reviews(spark, sf_dir, KEY, "rating"))


# Words, aspects and samples


@query
def top_words(spark, sf_dir):
    return terms.top_words(sample_reviews(spark, sf_dir, KEY, "id", "review_text"))


@query
def term_frequencies(spark, sf_dir):
    return terms.term_frequencies(sample_reviews(spark, sf_dir, KEY, "sentiment", "review_text"))


@query
def cloud_terms(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, KEY, "sentiment", "review_text")
    return terms.term_frequencies(rows, merge_plurals=True, collocations=True)


def _aspects(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, "id", KEY, "review_text", "sentiment")
    return asp.aspect_mentions(rows, SAMPLE_ASPECTS)


@query
def aspect_mentions(spark, sf_dir):
    return _aspects(spark, sf_dir)


@query
def aspect_sentiment(spark, sf_dir):
    return dashboard.aspect_sentiment(_aspects(spark, sf_dir))


@query
def overall_experience(spark, sf_dir):
    return _aspects(spark, sf_dir).where(F.col("aspect") == "Overall Experience")


@query
def aspects_of_dataset(spark, sf_dir):
    reviews = sample_reviews(spark, sf_dir, "id", KEY).where(F.col(KEY) == "src7")
    return asp.of_reviews(_aspects(spark, sf_dir).where(F.col(KEY) == "src7"), reviews)


@query
def sentiment_samples(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, "id", KEY, "review_text", "sentiment")
    out = samples.sentiment_samples(rows)
    return out.withColumn("review_text", F.md5("review_text"))


@query
def insight_context(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, "id", KEY, "review_text", "sentiment")
    out = samples.insight_context(rows)
    for name in ("pos_samples", "neg_samples"):
        out = out.withColumn(name, F.md5(F.array_join(name, "|")))
    return out


# Column functions


@query
def clean_text_digest(spark, sf_dir):
    text = clean_text(F.col("review_text"))
    return sample_reviews(spark, sf_dir, "id", "review_text").select(
        "id", F.md5(text).alias("digest")
    )


@query
def chart_token_digest(spark, sf_dir):
    tokens = chart_tokens(F.col("review_text"))
    return sample_reviews(spark, sf_dir, "id", "review_text").select(
        "id", F.md5(F.array_join(tokens, " ")).alias("digest")
    )


@query
def text_length(spark, sf_dir):
    return sample_reviews(spark, sf_dir, "id", "review_text").select(
        "id", utf16_length(F.col("review_text")).alias("length")
    )


@query
def rating_buckets(spark, sf_dir):
    return sample_reviews(spark, sf_dir, "id", "rating").select(
        "id", "rating", rating_bucket(F.col("rating")).alias("bucket")
    )


@query
def parsed_ratings(spark, sf_dir):
    """Ratings written in good and bad number forms, chosen by the kind of event."""
    raw = (
        F.when(F.col("event_type") == "view", F.concat(F.lit(" +"), F.col("value")))
        .when(F.col("event_type") == "click", F.concat(F.col("value"), F.lit("d")))
        .when(F.col("event_type") == "error", F.lit("nan"))
        .when(F.col("event_type") == "signup", F.concat(F.col("user_id"), F.lit("e-1 ")))
        .otherwise(F.concat(F.lit("-"), F.col("user_id"), F.lit(".")))
    )
    return table(spark, sf_dir, "events").select("event_id", parse_rating(raw).alias("rating"))


@query
def default_names(spark, sf_dir):
    name = F.when(F.col("event_type") == "error", "").when(
        F.col("event_type") != "view", F.concat(F.lit("user_"), F.col("user_id"))
    )
    return table(spark, sf_dir, "events").select("event_id", name_or_unknown(name).alias("name"))


def _date_wording():
    """Date texts in every form a source may hold, made from the row itself."""
    n = F.pmod("doc_id", F.lit(40)).cast("string")
    forms = [
        F.lit(" A month ago"), F.concat(n, F.lit(" Weeks ago")), F.concat(n, F.lit(" years ago")),
        F.lit("yesterday\n"), F.concat(n, F.lit(" hours ago")), F.lit("  "),
        F.concat(F.lit("2024/05/"), n), F.lit("UNKNOWN"), F.lit("an hour in a day"),
        F.concat(n, F.lit(" year "), n, F.lit(" months ago")),
        F.concat(F.repeat(n, 12), F.lit(" days ago")),
    ]
    return F.get(F.array(*forms), F.pmod("n_chars", F.lit(len(forms))).cast("int"))


@query
def relative_dates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", normalize_date(_date_wording(), as_of()).alias("date")
    )


@query
def synthetic_dates(spark, sf_dir):
    """Unknown dates take the day that lies as far back as the row's place in its business."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias(KEY),
        normalize_date(_date_wording(), as_of()).alias("date"),
    )
    placed = with_position(rows, KEY, ["id"])
    return placed.select("id", fill_unknown_date(F.col("date"), F.col("pos"), as_of()).alias("date"))


@query
def month_periods(spark, sf_dir):
    """Months of dates written in the forms a source may hold."""
    day = F.col("o_orderdate")
    forms = [
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "M/d/yyyy"),
        F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "yyyy-MM-dd't'HH:mm:ss'z'"),
        F.lit(UNKNOWN), F.lit("31-31-31"), F.lit(None).cast("string"),
    ]
    written = F.get(F.array(*forms), F.pmod("o_custkey", F.lit(len(forms))).cast("int"))
    period = month_period(written).alias("period")
    return table(spark, sf_dir, "orders").select("o_orderkey", period)


@query
def title_labels(spark, sf_dir):
    words = F.array(F.lower("lang"), F.lower("source"), F.lit("pizza crust"))
    return table(spark, sf_dir, "documents").select("doc_id", title_case(words).alias("label"))


# Numbering, scans and keys


@query
def row_index(spark, sf_dir):
    return with_position(sample_reviews(spark, sf_dir, "id", KEY), KEY, ["id"])


@query
def capped_rows(spark, sf_dir):
    """The row cap of an upload: the first 30 rows of each business."""
    rows = sample_reviews(spark, sf_dir, "id", KEY)
    top = top_per_group(rows, [KEY], [F.asc("id")], 30, ["id"], rank="rank")
    return top.select("id", KEY, (F.col("rank") - 1).cast("long").alias("pos"))


@query
def capped_csv(spark, sf_dir):
    """The first 30 rows of each upload, read from CSV files."""
    reviews, _ = csv_files.read_review_csv(spark, [_write_uploads(spark, sf_dir)], max_rows=30)
    return reviews.select(KEY, "pos", "user_name")


@query
def reviews_of_dataset(spark, sf_dir):
    columns = ("id", KEY, "user_name", "rating", "date", "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns).where(F.col(KEY) == "src7")
    return rows.withColumn("review_text", F.md5("review_text"))


@query
def label_join(spark, sf_dir):
    """Labels from their own table; those that are missing or not one of the three are Neutral."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Positive")
        .otherwise("mixed").alias("sentiment"),
    )
    return sentiment.attach_labels(sample_reviews(spark, sf_dir, "id", KEY), labels)


@query
def valid_labels(spark, sf_dir):
    label = F.initcap("event_type")
    known = F.when(label == "Error", "Negative").when(label == "Purchase", "Positive")
    return table(spark, sf_dir, "events").select(
        "event_id", valid_sentiment(F.coalesce(known, label)).alias("sentiment")
    )


def _run_log(spark, sf_dir):
    status = (
        F.when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("pending")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id")).alias(KEY), status.alias("status"), "ts"
    )


@query
def dataset_status(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user_"), F.col("c_custkey")).alias(KEY)
    )
    return runs.status_of(keys, _run_log(spark, sf_dir))


@query
def duplicate_keys(spark, sf_dir):
    return runs.duplicate_keys(_run_log(spark, sf_dir))


# Sources


@query
def page_links(spark, sf_dir):
    """List items of every page: the link text is the review text, its target the user name."""
    selectors = Selectors(
        container="li", user_name="a", rating=".stars", date=".when", review_text="a",
        attributes={"user_name": "href", "rating": "aria-label"},
    )
    return page_items(table(spark, sf_dir, "pages"), selectors)


@query
def page_items_capped(spark, sf_dir):
    selectors = Selectors(container="li", review_text="a")
    return page_items(table(spark, sf_dir, "pages"), selectors, max_items=3)


@query
def page_ads(spark, sf_dir):
    """Text of the block with class ``ad`` inside the body of every page."""
    selectors = Selectors(container="body", review_text="div.ad")
    return page_items(table(spark, sf_dir, "pages"), selectors)


@query
def source_precedence(spark, sf_dir):
    """Structured rows where a business has any, page rows for the other businesses."""
    rows = sample_reviews(spark, sf_dir, "id", KEY, "sentiment", "review_text")
    structured = (F.col("sentiment") == "Negative") & (F.length("review_text") > 4000)
    primary = rows.where(structured).select(KEY, "id", F.lit("structured").alias("origin"))
    return prefer(primary, rows.select(KEY, "id", F.lit("page").alias("origin")), ["id"])


@query
def structured_records(spark, sf_dir):
    """Reviews sent as fenced JSON lists, some of them broken, read back as rows."""
    rows = sample_reviews(spark, sf_dir, "id", "user_name", "rating", "date", "review_text")
    body = F.to_json(F.array(F.struct("user_name", "rating", "date", "review_text")))
    payload = F.when(F.col("rating") == 0, F.lit("no reviews")).otherwise(
        F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    )
    out = parse_records(rows.select("id", payload.alias("payload")))
    return out.withColumn("review_text", F.md5("review_text"))


@query
def parsed_replies(spark, sf_dir):
    """Scorer replies as JSON: short, unknown and broken ones are filled with Neutral."""
    reply = (
        F.when(F.col("event_type") == "error", F.lit("oops"))
        .when(F.col("event_type") == "view", F.lit('{"sentiments": "Positive"}'))
        .when(F.col("event_type") == "click", F.lit('{"sentiments": ["Negative"]}'))
        .otherwise(F.lit('```json{"sentiments": ["Positive", "great", "Negative"]}```'))
    )
    labels = parse_sentiments(reply, F.lit(2))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(labels, ",").alias("labels")
    )


@query
def parsed_plans(spark, sf_dir):
    """Query plans sent as JSON, with defaults for what is missing."""
    plan = F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(
        F.concat(F.lit('{"sql": "select '), F.col("user_id"), F.lit('", "needs_graph": true}'))
    )
    parsed = parse_struct(
        plan, "sql string, needs_graph boolean, chart_type string",
        sql="", needs_graph=False, chart_type="none",
    )
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select(
        "event_id", "p.*"
    )


@query
def review_records(spark, sf_dir):
    """Rows as JSON records with nulls kept."""
    rows = sample_reviews(spark, sf_dir, "id", KEY, "sentiment")
    return rows.select("id", record_json("id", KEY, "sentiment").alias("record"))


@query
def dataset_key(spark, sf_dir):
    """Datasets of files: the last title a file holds, else its name."""
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), "source", F.lit(".csv")).alias("file_path"),
        F.concat("source", F.lit(".csv")).alias("file_name"),
        F.lit(None).cast("timestamp").alias("file_time"),
        F.col("doc_id").alias("pos"),
        F.when(F.col("n_chars") > 9000, F.concat("lang", F.lit(" shop "), "doc_id"))
        .when(F.col("n_chars") > 2000, "").alias("title"),
    )
    return csv_files.dataset_keys(rows).drop("file_time")


def _write_uploads(spark, sf_dir, documents=None):
    """Documents as CSV files of 500 rows, with line breaks and quotes inside fields."""
    folder = f"{shared_dir(spark)}/upload-{uuid.uuid4().hex}"
    part = F.expr("doc_id div 500")
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    rows = documents.select(
        part.alias("part"),
        F.concat(F.lit("d"), "doc_id").alias(" Name"),
        F.col("text").alias("TEXT"),
        F.concat(F.pmod("doc_id", F.lit(6)).cast("string"), F.lit(".5")).alias("Stars"),
        _date_wording().alias("Posted Time"),
        F.concat(F.lit("upload "), part).alias("title"),
        "doc_id",
    )
    (
        rows.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id")
        .write.partitionBy("part").option("header", True).option("quoteAll", True)
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(folder)
    )
    return folder


@query
def uploaded_csv(spark, sf_dir):
    """CSV files read as uploads."""
    reviews, _ = csv_files.read_review_csv(spark, [_write_uploads(spark, sf_dir)])
    return reviews.drop("line_no").withColumn("review_text", F.md5("review_text"))


def _new_store(spark):
    return ReviewStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _stored(store):
    """Stored reviews without their ids, which follow the order of the files."""
    return store.read("reviews").drop("id").withColumn("review_text", F.md5("review_text"))


INGEST_DAY = date(2025, 1, 31)


@query
def ingested_csv(spark, sf_dir):
    """The upload job from files to stored reviews, with labels from a scorer."""
    store = _new_store(spark)
    ingest_csv(store, [_write_uploads(spark, sf_dir)], IngestOptions(INGEST_DAY, length_scorer))
    return _stored(store)


@query
def ingested_aspects(spark, sf_dir):
    """Aspects the upload job derives, per dataset."""
    store = _new_store(spark)
    options = IngestOptions(INGEST_DAY, length_scorer, aspects=SAMPLE_ASPECTS)
    ingest_csv(store, [_write_uploads(spark, sf_dir)], options)
    return dashboard.aspect_sentiment(store.read("aspect_sentiments"))


@query
def ingested_pages(spark, sf_dir):
    """The page job from stored pages to stored reviews."""
    store = _new_store(spark)
    selectors = Selectors(
        container="li", user_name="a", review_text="a", attributes={"user_name": "href"}
    )
    pages = table(spark, sf_dir, "pages")
    options = IngestOptions(INGEST_DAY, length_scorer)
    ingest_pages(store, pages, options=options, selectors=selectors)
    return _stored(store)


@query
def ingested_terms(spark, sf_dir):
    """Word clouds that the upload job stores, of all datasets."""
    store = _new_store(spark)
    options = IngestOptions(INGEST_DAY, length_scorer, derived=("term_frequencies",))
    ingest_csv(store, [_write_uploads(spark, sf_dir)], options)
    return store.read("term_frequencies")


def _cluster_shape(clusters):
    """Per business: clustered reviews, whether their cluster numbers fit, and whether a cluster has one label."""
    labels = clusters.groupBy(KEY, "cluster_id").agg(F.count("*").alias("n"), F.count_distinct("cluster_label").alias("labels"))
    most = F.greatest(F.least(F.lit(5), F.floor(F.sum("n") / 2)), F.lit(1))
    few = F.sum("n") < topics.MIN_TEXTS
    return labels.groupBy(KEY).agg(
        F.sum("n").alias("reviews"), (F.max("cluster_id") < F.when(few, 1).otherwise(most)).alias("ids_fit"),
        (F.max("labels") == 1).alias("one_label_each"),
    )


@query
def ingested_cluster_rules(spark, sf_dir):
    """Shape of the clusters that the upload job stores, of all datasets."""
    store = _new_store(spark)
    options = IngestOptions(INGEST_DAY, length_scorer, derived=("review_clusters",))
    ingest_csv(store, [_write_uploads(spark, sf_dir)], options)
    return _cluster_shape(store.read("review_clusters"))


@query
def ingested_bundle_clusters(spark, sf_dir):
    """Shape of the clusters in the bundle of one dataset, after the upload job."""
    store = _new_store(spark)
    options = IngestOptions(INGEST_DAY, length_scorer, derived=("review_clusters",))
    ingest_csv(store, [_write_uploads(spark, sf_dir)], options)
    return _cluster_shape(bundles.advanced_bundle(store, "upload 0")["clusters"])


def _place_parts(spark, written, folder):
    """Move the CSV files that ``_write_uploads`` wrote to one name per part in ``folder``, over what is there."""
    source, files = hadoop_path(spark, written)
    target, _ = hadoop_path(spark, folder)
    files.mkdirs(target)
    for part in files.listStatus(source):
        name = part.getPath().getName()
        if name.startswith("part="):
            (one,) = [f.getPath() for f in files.listStatus(part.getPath()) if f.getPath().getName().endswith(".csv")]
            place, _ = hadoop_path(spark, f"{folder}/{name.removeprefix('part=')}.csv")
            files.delete(place, False)
            files.rename(one, place)


@query
def streamed_drop_folder(spark, sf_dir):
    """A drop folder read by a stream twice: all parts, and again after every third one was rewritten."""
    store, folder = _new_store(spark), f"{shared_dir(spark)}/drop-{uuid.uuid4().hex}"
    options = IngestOptions(INGEST_DAY, length_scorer, derived=())
    documents = table(spark, sf_dir, "documents")
    third = (F.expr("doc_id div 500") % 3 == 0) & (F.col("doc_id") % 3 == 0)
    for rows in (documents, documents.where(third)):
        _place_parts(spark, _write_uploads(spark, sf_dir, rows), folder)
        stream_new_files(store, folder, f"{folder}-state", options).awaitTermination()
    return _stored(store)


@query
def vacuumed_store(spark, sf_dir):
    """A store after appends, a replacement and a vacuum of its log, and a replacement after that."""
    store = _new_store(spark)
    columns = ("id", KEY, "user_name", "rating", "date", "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns)
    keys = rows.select(KEY).distinct()
    store.append(rows.where("id % 2 = 0"))
    store.append(rows.where("id % 2 = 1"))
    store.replace("reviews", rows.where("sentiment = 'Negative' and business_url = 'src3'"), keys.where("business_url = 'src3'"))
    store.log.vacuum()
    store.replace("reviews", rows.where("sentiment = 'Positive' and business_url = 'src4'"), keys.where("business_url = 'src4'"))
    return store.read("reviews").withColumn("review_text", F.md5("review_text"))


@query
def replaced_reviews(spark, sf_dir):
    """A store filled with all reviews, then with new rows for one business."""
    store = _new_store(spark)
    columns = ("id", KEY, "user_name", "rating", "date", "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns)
    store.replace("reviews", rows, rows.select(KEY).distinct())
    new = rows.where((F.col(KEY) == "src3") & (F.col("sentiment") == "Negative"))
    store.replace("reviews", new, rows.select(KEY).distinct().where(F.col(KEY) == "src3"))
    return store.read("reviews").withColumn("review_text", F.md5("review_text"))


@query
def replaced_derived(spark, sf_dir):
    """Aspects after a second run of one business, whose first rows must be gone."""
    store, columns = _new_store(spark), ("id", KEY, "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns)
    store.replace("aspect_sentiments", asp.aspect_mentions(rows, SAMPLE_ASPECTS), rows.select(KEY).distinct())
    one = rows.where(F.col(KEY) == "src3")
    again = asp.aspect_mentions(one.where("id % 2 = 0"), SAMPLE_ASPECTS)
    store.replace("aspect_sentiments", again, one.select(KEY).distinct())
    store.clear("aspect_sentiments", rows.where(F.col(KEY) == "src4").select(KEY).distinct())
    return store.read("aspect_sentiments")


@query
def stored_dataset(spark, sf_dir):
    """One business read from a store of all by its key."""
    store = _new_store(spark)
    columns = ("id", KEY, "user_name", "rating", "date", "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns)
    store.replace("reviews", rows, rows.select(KEY).distinct())
    return store.read("reviews", "src7").withColumn("review_text", F.md5("review_text"))


@query
def appended_reviews(spark, sf_dir):
    """A store to which half of the reviews were added after the others."""
    store = _new_store(spark)
    columns = ("id", KEY, "user_name", "rating", "date", "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns)
    store.append(rows.where("id % 2 = 0"))
    store.append(rows.where("id % 2 = 1"))
    return store.read("reviews").withColumn("review_text", F.md5("review_text"))


@query
def stored_status(spark, sf_dir):
    """Status of asked businesses by the registry of a store; unknown ones are not found."""
    store = _new_store(spark)
    keys = table(spark, sf_dir, "documents").select(F.col("source").alias(KEY)).distinct()
    store.log_run(keys, "first", "pending", 1)
    store.log_run(keys.where(F.length(KEY) == 4), "first", "completed", 1)
    asked = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 10 == 0, F.lit("nowhere")).otherwise(F.col("source")).alias(KEY)
    ).distinct()
    return runs.status_of(asked, store.read("dataset_runs"))


def _bundle_store(spark, sf_dir):
    """A store with reviews and aspects of all businesses, and runs of them."""
    store = _new_store(spark)
    columns = ("id", KEY, "user_name", "rating", "date", "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns)
    keys = rows.select(KEY).distinct()
    store.replace("reviews", rows, keys)
    store.replace("aspect_sentiments", asp.aspect_mentions(rows, SAMPLE_ASPECTS), keys)
    store.replace("review_clusters", rows.select(KEY, F.col("id").alias("review_id"), F.pmod("id", F.lit(3)).cast("int").alias("cluster_id"), F.lit("Label").alias("cluster_label")), keys)
    store.log_run(keys, "run", "completed", 1)
    return store


@query
def advanced_bundle_aspects(spark, sf_dir):
    """Aspects and their sentiments of one business, as its bundle gives them."""
    bundle = bundles.advanced_bundle(_bundle_store(spark, sf_dir), "src7")
    return bundle["aspect_sentiment"]


@query
def advanced_bundle_clusters(spark, sf_dir):
    """Clusters of one business, as its bundle gives them."""
    return bundles.advanced_bundle(_bundle_store(spark, sf_dir), "src7")["clusters"]


@query
def dashboard_bundle_buckets(spark, sf_dir):
    """Average text lengths of all businesses, as the dashboard bundle gives them."""
    store = _bundle_store(spark, sf_dir)
    return bundles.dashboard_bundle(store.read("reviews"))["avg_length_by_rating"]


def _changed_store(spark, sf_dir):
    """A store after two appends and a replacement."""
    store = _new_store(spark)
    columns = ("id", KEY, "user_name", "rating", "date", "review_text", "sentiment")
    rows = sample_reviews(spark, sf_dir, *columns)
    store.append(rows.where("id % 2 = 0"))
    store.append(rows.where("id % 2 = 1"))
    new = rows.where("sentiment = 'Negative' and business_url = 'src3'")
    store.replace("reviews", new, rows.select(KEY).distinct().where("business_url = 'src3'"))
    return store


@query
def kept_sentiment_by_rating(spark, sf_dir):
    """A chart from the partial sums of a store that was written to three times."""
    return bundles.stored_dashboard(_changed_store(spark, sf_dir))["sentiment_by_rating"]


@query
def kept_months(spark, sf_dir):
    """Monthly volume and mean rating from the partial sums of such a store."""
    return bundles.stored_dashboard(_changed_store(spark, sf_dir))["monthly_volume_rating"]


@query
def exported_csv(spark, sf_dir):
    """Lines of the CSV export without its header."""
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export_csv(sample_reviews(spark, sf_dir, "id", KEY, "rating", "sentiment"), folder)
    return spark.read.text(folder).where(~F.startswith("value", F.lit('"id"')))


# SQL of the caller


def _views(sf_dir):
    def load(session):
        reviews = sample_reviews(
            session, sf_dir, "id", KEY, "user_name", "rating", "date", "review_text", "sentiment"
        )
        return {"reviews": reviews, "aspect_sentiments": _aspects(session, sf_dir)}

    return load


@query
def adhoc_sql(spark, sf_dir):
    session = adhoc.scoped_session(spark, _views(sf_dir))
    return adhoc.run_query(
        session,
        "SELECT sentiment, COUNT(*) AS n, AVG(rating) AS avg_rating FROM reviews"
        " GROUP BY sentiment",
    )


@query
def scoped_sql(spark, sf_dir):
    """A join that names no business, run in the scope of one."""
    session = adhoc.scoped_session(spark, _views(sf_dir), "src7")
    return adhoc.run_query(
        session,
        "SELECT a.aspect, r.sentiment, COUNT(*) AS n FROM reviews r"
        " JOIN aspect_sentiments a ON a.review_id = r.id GROUP BY a.aspect, r.sentiment",
    )


@query
def chart_axes(spark, sf_dir):
    session = adhoc.scoped_session(spark, _views(sf_dir), "src7")
    result = adhoc.answer(
        session,
        "SELECT substr(date, 1, 4) AS year, COUNT(*) AS reviews, AVG(rating) AS rating"
        " FROM reviews GROUP BY 1 ORDER BY 1",
        needs_graph=True, chart_type="line", x_label="year", y_label="reviews",
    )
    return result.chart.points


@query
def page_items_sql(spark, sf_dir):
    """List items taken out of pages by a table function in the SQL of the caller."""
    selectors = Selectors(container="li", user_name="a", review_text="a", attributes={"user_name": "href"})
    session = adhoc.scoped_session(spark, lambda s: {"pages": table(s, sf_dir, "pages")}, selectors=selectors)
    return adhoc.run_query(
        session,
        "SELECT p.page_id, i.item_pos, i.user_name AS target, trim(i.review_text) AS label"
        " FROM pages p, LATERAL page_items(p.html) i",
    )


# Sentiment and topics


@query
def scored_sentiment(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, "id", "review_text")
    return sentiment.classify_sentiment(rows, length_scorer).select("id", "sentiment")


@query
def lexicon_sentiment(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, "id", "review_text")
    scored = sentiment.lexicon_sentiment(rows, SAMPLE_POSITIVE, SAMPLE_NEGATIVE)
    return scored.select("id", "sentiment")


@query
def tfidf_terms(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, KEY, "id", "review_text")
    out = tfidf.tfidf_terms(rows, stop_words=list(terms.CLOUD_STOP_WORDS))
    return out.withColumn("idf", F.round("idf", 8))


@query
def tfidf_weights(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, KEY, "id", "review_text")
    found = stage(tfidf.review_terms(rows), "terms")
    vocab = stage(tfidf.vocabulary(found, list(terms.CLOUD_STOP_WORDS)), "vocabulary")
    out = tfidf.tfidf_weights(found, vocab)
    return out.select(KEY, "id", "term", F.round("weight", 8).alias("weight"))


def _clusters(spark, sf_dir):
    rows = sample_reviews(spark, sf_dir, KEY, "id", "review_text")
    return topics.cluster_reviews(rows)


@query
def review_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query
def cluster_labels(spark, sf_dir):
    return topics.cluster_sizes(_clusters(spark, sf_dir))


GIVEN = 3  # clusters given to the steps that are checked: reviews by the remainder of their id


def _given_topics(spark, sf_dir, stop_words, clusters=None):
    """Vectors, chunks, vocabulary and centres, the means of given clusters (business_url, id, cluster)."""
    rows = sample_reviews(spark, sf_dir, KEY, "id", "review_text")
    found = stage(tfidf.review_terms(rows), "terms")
    vocab = stage(tfidf.vocabulary(found, stop_words), "vocabulary")
    width = (vocab.agg(F.max("slot")).first()[0] or 0) + 1
    sizes = topics.cluster_counts(rows, GIVEN)
    vectors = stage(topics.review_vectors(vocab, found, sizes), "vectors")
    chunks = stage(vectors.select(KEY, "chunk").distinct(), "chunks")
    if clusters is None:
        clusters = vectors.select(KEY, "id", F.pmod("id", F.lit(GIVEN)).cast("int").alias("cluster"))
    members = stage(vectors.join(clusters, [KEY, "id"]), "members")
    counts = members.groupBy(KEY, "cluster").agg(F.count("*").alias("n"))
    entries = members.select(KEY, "cluster", F.inline(F.arrays_zip("slots", "weights")))
    sums = entries.groupBy(KEY, "cluster", "slots").agg(F.sum("weights").alias("w")).join(counts, [KEY, "cluster"])
    place = F.col("cluster") * width + F.col("slots")
    means = sums.groupBy(KEY).agg(
        F.map_from_entries(F.collect_list(F.struct(place, F.col("w") / F.col("n")))).alias("means"),
    )
    top = clusters.groupBy(KEY).agg((F.max("cluster") + 1).alias("k"))
    points = F.transform(F.sequence(F.lit(0), F.col("k") * width - 1), lambda i: F.coalesce(F.element_at("means", i), F.lit(0.0)))
    centres = means.join(top, KEY).select(
        KEY, F.lit(0).alias("start"), points.alias("points"), F.lit(float("inf")).alias("cost"), F.lit(True).alias("moving"),
    )
    return vectors, chunks, vocab, stage(centres, "centres"), width


@query
def kmeans_steps(spark, sf_dir):
    """Two steps of k-means from given centres, and the nearest centre of each review after them."""
    vectors, chunks, _, centres, width = _given_topics(spark, sf_dir, list(terms.CLOUD_STOP_WORDS))
    centres, _ = topics.settle(vectors, chunks, centres, width, max_iter=2, tol=0.0)
    near = topics.nearest_centres(vectors, chunks, centres, width)
    return near.withColumn("square", F.round("square", 6))


@query
def centroid_terms(spark, sf_dir):
    """Labels of given clusters: the heaviest terms of their means."""
    _, _, vocab, centres, width = _given_topics(spark, sf_dir, list(terms.CLOUD_STOP_WORDS))
    return topics.centre_labels(topics.single_centres(centres, width), vocab)


@query
def cluster_rules(spark, sf_dir):
    """Shape of all clusters, and whether reviews lie with the nearest mean.

    The cost of reviews to the means of their own clusters is what is left of their squared lengths; a step
    from those means gives the cost to the nearest ones.
    """
    found = stage(_clusters(spark, sf_dir), "clusters")
    given = found.select(KEY, F.col("review_id").alias("id"), F.col("cluster_id").alias("cluster"))
    vectors, chunks, _, centres, width = _given_topics(spark, sf_dir, tfidf.english_stop_words(), given)
    nearest = topics.next_centres(vectors, chunks, centres, width, 0.0).select(KEY, "cost")
    length = F.aggregate("weights", F.lit(0.0), lambda total, w: total + w * w)
    lengths = vectors.groupBy(KEY).agg(F.sum(length).alias("squares"))
    sizes = given.groupBy(KEY, "cluster").agg(F.count("*").alias("n"))
    means = topics.single_centres(centres, width).join(sizes, [KEY, "cluster"])
    square = F.aggregate("point", F.lit(0.0), lambda total, w: total + w * w)
    explained = means.groupBy(KEY).agg(F.sum(F.col("n") * square).alias("explained"))
    settled = nearest.join(lengths, KEY).join(explained, KEY).select(
        KEY, (F.abs(F.col("squares") - F.col("explained") - F.col("cost")) < 0.01).alias("settled")
    )
    return _cluster_shape(found).join(settled, KEY, "left")
