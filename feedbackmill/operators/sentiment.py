"""Sentiment labels: a batch scorer given by the caller, or a word list that stays in the JVM."""

import hashlib
import logging
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedbackmill.functions.labels import valid_sentiment
from feedbackmill.functions.text import letters_only
from feedbackmill.operators.lookup import attach
from feedbackmill.schemas import NEGATIVE, NEUTRAL, POSITIVE, SENTIMENTS

Scorer = Callable[[list[str]], list[str]]

POSITIVE_WORDS = (
    "amazing", "awesome", "best", "delicious", "delightful", "enjoyed", "excellent", "fantastic",
    "fresh", "friendly", "good", "great", "happy", "helpful", "loved", "love", "nice", "perfect",
    "pleasant", "recommend", "tasty", "wonderful",
)
NEGATIVE_WORDS = (
    "awful", "bad", "bland", "cold", "dirty", "disappointed", "disappointing", "disgusting",
    "horrible", "overpriced", "poor", "rude", "slow", "stale", "terrible", "unfriendly", "worst",
    "wrong",
)


#: Labels of texts that a task keeps, so that equal ones are scored once.
KEPT_LABELS = 100_000
#: Rows that wait at most until a batch is full; then it is sent as it is.
WAITING_ROWS = 10_000


def score_batch(scorer: Scorer, texts: list[str], attempts: int = 1) -> list[str]:
    """One label per text: a failing or short reply is Neutral where it has no label.

    A failing scorer is asked again, ``attempts`` times in all.
    """
    reply = []
    for attempt in range(attempts):
        try:
            reply = scorer(texts)
            break
        except Exception:
            logging.getLogger(__name__).warning(
                "scorer failed on %d texts, attempt %d of %d", len(texts), attempt + 1, attempts, exc_info=True
            )
    if not isinstance(reply, list):
        reply = []
    labels = [s if s in SENTIMENTS else NEUTRAL for s in reply[: len(texts)]]
    return labels + [NEUTRAL] * (len(texts) - len(labels))


def _labels(texts: Iterator[str], score: Callable[[list[str]], list[str]], batch_size: int, calls: int) -> Iterator[list[str]]:
    """Labels of a stream of texts, in order; batches are of different texts that have no label yet.

    At most ``calls`` batches are with the scorer at once, and their texts are what is held.
    """
    known: dict[bytes, str] = {}
    waiting: dict[bytes, str] = {}  # of the batch that is being filled
    order: list[bytes] = []
    running: list[tuple[list[bytes], Future]] = []
    asked: set[bytes] = set()

    def finish() -> None:
        keys, future = running.pop(0)
        known.update(zip(keys, future.result(), strict=True))
        asked.difference_update(keys)

    def hand_out() -> list[str]:
        done = [known[k] for k in order]
        order.clear()
        if len(known) > KEPT_LABELS:
            known.clear()
        return done

    with ThreadPoolExecutor(calls) as pool:

        def send() -> None:
            if len(running) == calls:
                finish()
            running.append((list(waiting), pool.submit(score, list(waiting.values()))))
            asked.update(waiting)
            waiting.clear()

        for text in texts:
            key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            order.append(key)
            if key not in known and key not in asked and key not in waiting:
                waiting[key] = text
                if len(waiting) == batch_size:
                    send()
            if waiting and len(order) >= WAITING_ROWS:
                send()
            if not waiting and len(order) >= batch_size * calls:
                while running:
                    finish()
                yield hand_out()
        if waiting:
            send()
        while running:
            finish()
        yield hand_out()


def classify_sentiment(
    df: DataFrame, scorer: Scorer, batch_size: int = 50, calls: int = 1, attempts: int = 1
) -> DataFrame:
    """Add ``sentiment`` by calling ``scorer`` on ``batch_size`` texts at a time.

    Only the text column crosses to Python. Batches go on from one Arrow batch to the next, and a text
    that a task has met lately is not scored again. A task has ``calls`` batches with the scorer at
    once, from as many threads, and tries each up to ``attempts`` times. The calls may cost money, so
    Spark is told not to repeat them in a plan; stage the result.
    """

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        texts = (text for batch in batches for text in batch.fillna(""))
        for labels in _labels(texts, lambda part: score_batch(scorer, part, attempts), batch_size, calls):
            yield pd.Series(labels, dtype=object)

    return df.withColumn("sentiment", label.asNondeterministic()("review_text"))


def classify_once(
    df: DataFrame, scorer: Scorer, key: str = "id", batch_size: int = 50, calls: int = 1, attempts: int = 1
) -> DataFrame:
    """Add ``sentiment`` like :func:`classify_sentiment`, but send each different text to the scorer once.

    Texts meet by their hash before they are scored, which moves each different one; then the labels are
    joined to the rows. It pays where copies are many and calls are dear. ``key`` is a column that
    tells rows apart, by which the rows of a very common text are spread.
    """
    text = F.coalesce("review_text", F.lit(""))
    keyed = df.withColumn("_text_hash", F.sha2(text, 256))
    different = keyed.groupBy("_text_hash").agg(F.first(text).alias("review_text"))
    labels = classify_sentiment(different, scorer, batch_size, calls, attempts).select("_text_hash", "sentiment")
    return attach(keyed.drop("sentiment"), labels, ["_text_hash"], spread=[key]).drop("_text_hash")


def _count_words(letters: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_count(letters, F.lit(r"\b(" + "|".join(words) + r")\b"))


def lexicon_sentiment(
    df: DataFrame,
    positive: tuple[str, ...] = POSITIVE_WORDS,
    negative: tuple[str, ...] = NEGATIVE_WORDS,
) -> DataFrame:
    """Add ``sentiment`` from the words each text holds of two lists, row by row."""
    letters = df.withColumn("_letters", letters_only(F.col("review_text")))
    score = _count_words(F.col("_letters"), positive) - _count_words(F.col("_letters"), negative)
    label = F.when(score > 0, POSITIVE).when(score < 0, NEGATIVE).otherwise(NEUTRAL)
    return letters.withColumn("sentiment", label).drop("_letters")


def attach_labels(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels from a table (id, sentiment); a review without a valid one is Neutral."""
    joined = reviews.drop("sentiment").join(labels.select("id", "sentiment"), "id", "left")
    return joined.withColumn("sentiment", valid_sentiment(F.col("sentiment")))
