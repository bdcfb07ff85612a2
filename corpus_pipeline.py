"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedbackmill.llm import decontaminate, packing, pii, simhash, toxicity
from feedbackmill.llm.queries import word_tokenizer
from feedbackmill.session import shared_dir
from feedbackmill.sources.sample_tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores stays below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of SimHash links."""
    return simhash.keep_first(docs.select(*COLUMNS))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item, edited ones included."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data."""
    redacted = pii.redact_documents(docs.select(*COLUMNS))
    changed = F.when(F.col("redacted"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return redacted.withColumn("n_chars", changed).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(docs, word_tokenizer(), capacity=2048, end_id=0)
    return packing.pack_pieces(pieces, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
# Models, hashes and alignments can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of the last one, with everything before it staged."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
