"""TF-IDF weights per business as a long table.

The terms of a review are counted where it lies, and its vector is made next to the vocabulary of its
business, so a review is moved once and no row per term is.
"""

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.functions.text import feature_tokens
from feedbackmill.operators.dashboard import KEY
from feedbackmill.operators.lookup import attach, spread_join
from feedbackmill.operators.ranking import top_per_group
from feedbackmill.operators.word_lists import plain_or_words, row_words
from feedbackmill.session import stage

MAX_FEATURES = 1000
CHUNK_ROWS = 10_000  # reviews of a business that one task weighs at a time


def english_stop_words() -> list[str]:
    """Spark's English list; its entries with apostrophes never match a token."""
    return StopWordsRemover.loadDefaultStopWords("english")


def with_text(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.coalesce(F.col("review_text"), F.lit("")) != "")


def review_terms(reviews: DataFrame) -> DataFrame:
    """The different terms of each review with text and how often it holds each, stop words included.

    (business_url, id, terms, counts); to be staged, since the vocabulary and the vectors read it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, words = row_words(batch)
            words = words.dictionary_encode()
            different = max(len(words.dictionary), 1)
            pairs, counts = np.unique(owner * different + words.indices.to_numpy(), return_counts=True)
            edges = pa.array(np.searchsorted(pairs, np.arange(len(batch) + 1) * different), pa.int32())
            terms = pa.ListArray.from_arrays(edges, words.dictionary.take(pa.array(pairs % different)))
            counts = pa.ListArray.from_arrays(edges, pa.array(counts, pa.int32()))
            columns = [batch.column(KEY), batch.column("id"), terms, counts]
            yield pa.RecordBatch.from_arrays(columns, [KEY, "id", "terms", "counts"])

    text = F.col("review_text")
    rows = with_text(reviews).select(KEY, "id", *plain_or_words(text, feature_tokens(text)))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"{KEY} string, id {kind}, terms array<string>, counts array<int>")


def _added(urls: pa.Array, rows: np.ndarray, terms: pa.Array, *values: np.ndarray):
    """Sums of ``values`` by the business in ``urls`` of the row and by term: codes, dictionaries and sums, by business."""
    urls, terms = urls.dictionary_encode("encode"), terms.dictionary_encode()
    different = max(len(terms.dictionary), 1)
    pairs = urls.indices.to_numpy().astype(np.int64)[rows] * different + terms.indices.to_numpy()
    order = np.argsort(pairs)
    pairs = pairs[order]
    firsts = np.flatnonzero(np.diff(pairs, prepend=-1))
    sums = [np.add.reduceat(v[order], firsts) if len(firsts) else v for v in values]
    return *np.divmod(pairs[firsts], different), urls.dictionary, terms.dictionary, *sums


def vocabulary(terms: DataFrame, stop_words: list[str], max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms of each business with document frequency and smoothed idf.

    ``slot`` numbers the terms of a business by falling frequency, from 0. Totals and document frequencies are
    added up within a batch of reviews, then by share: one of a business of up to ``CHUNK_ROWS`` reviews, and all
    shares of a larger one, each with the terms that fall to it. A share keeps the first ``max_features`` terms.
    """
    shares = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = "terms array<string>, totals array<bigint>, dfs array<bigint>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(stop_words, pa.string())
        for batch in batches:
            rows = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
            url, term, urls, words, total, df = _added(
                batch.column(KEY), rows, batch.column("terms").flatten(), counts, np.ones_like(counts)
            )
            kept = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)[term]
            url, term, total, df = url[kept], term[kept], total[kept], df[kept]
            one, every = (
                np.array([crc32(w or b"") % shares for w in names.cast(pa.binary()).to_pylist()], np.int64) for names in (urls, words)
            )
            large = pc.unique(batch.column(KEY).filter(pc.greater(batch.column("docs"), CHUNK_ROWS)))
            large = pc.is_in(urls, value_set=large).to_numpy(zero_copy_only=False)
            lots = url * shares + np.where(large[url], every[term], one[url])
            order = np.argsort(lots, kind="stable")
            lots, firsts = np.unique(lots[order], return_index=True)
            edges = pa.array(np.append(firsts, len(order)), pa.int32())
            values = words.take(pa.array(term[order])), pa.array(total[order]), pa.array(df[order])
            yield pa.RecordBatch.from_arrays(
                [urls.take(pa.array(lots // shares)), pa.array(lots % shares, pa.int32()), *(pa.ListArray.from_arrays(edges, v) for v in values)],
                [KEY, "share", "terms", "totals", "dfs"],
            )

    def first(table: pa.Table) -> pa.Table:
        lists = [table[c].combine_chunks() for c in ("terms", "totals", "dfs")]
        rows = np.repeat(np.arange(len(table)), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
        values = [v.flatten().to_numpy() for v in lists[1:]]
        url, term, urls, words, total, df = _added(table[KEY].combine_chunks(), rows, lists[0].flatten(), *values)
        order = np.lexsort((-total, url))
        nth = np.arange(len(order)) - np.searchsorted(url[order], url[order])
        # All terms as frequent as the last one stay; ties are settled by the term, by Spark.
        last = np.zeros(len(urls), np.int64)
        last[url[order[nth == max_features - 1]]] = total[order[nth == max_features - 1]]
        kept = np.flatnonzero(total >= last[url])
        columns = urls.take(pa.array(url[kept])), words.take(pa.array(term[kept])), pa.array(total[kept]), pa.array(df[kept])
        return pa.table(columns, [KEY, "term", "total", "df"])

    sizes = stage(terms.groupBy(KEY).agg(F.count("*").alias("docs")), "sizes")
    rows = spread_join(terms.select(KEY, "id", "terms", "counts"), sizes, [KEY], spread=["id"])
    parts = rows.select(KEY, "terms", "counts", "docs").mapInArrow(add, f"{KEY} string, share int, {lists}")
    totals = parts.repartition(shares, "share").groupBy("share").applyInArrow(first, f"{KEY} string, term string, total long, df long")
    order = [F.desc("total"), F.asc("term")]
    top = top_per_group(totals, [KEY], order, max_features, ["term"], rank="slot")
    idf = F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1
    return (
        top.join(sizes, KEY)
        .withColumn("idf", idf)
        .withColumn("slot", F.col("slot") - 1)
        .drop("docs")
    )


def tfidf_terms(
    reviews: DataFrame,
    max_features: int = MAX_FEATURES,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """Vocabulary with total, df and idf per business and term."""
    stop = english_stop_words() if stop_words is None else stop_words
    return vocabulary(stage(review_terms(reviews), "terms"), stop, max_features).drop("slot")


def in_chunks(rows: DataFrame, sizes: DataFrame, chunk_rows: int) -> DataFrame:
    """Add what ``sizes`` (business_url, docs) holds, the chunks of the business and the chunk of the row's id.

    A business of more than ``chunk_rows`` rows has chunks of half as many, so that more tasks share it.
    """
    many = F.ceil(2 * F.col("docs") / chunk_rows)
    return attach(rows, sizes, [KEY], spread=["id"]).withColumn(
        "chunks", F.when(F.col("docs") <= chunk_rows, 1).otherwise(many).cast("int")
    ).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))


def by_chunk(rows: DataFrame) -> DataFrame:
    """Rows dealt by chunk over all shuffle partitions: the tasks cost arithmetic, so small ones must not be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, "chunk")


def beside_words(terms: DataFrame, vocab: DataFrame):
    """Each chunk of ``terms`` next to the vocabulary of its business, one row with the terms by slot."""
    keys = [KEY, "chunk"]
    words = F.array_sort(F.collect_list(F.struct("slot", "term", "idf"))).alias("words")
    chunks = terms.select(*keys).distinct().toDF(*keys)
    copies = chunks.join(vocab.groupBy(KEY).agg(words), KEY)
    return by_chunk(terms).groupBy(*keys).cogroup(copies.groupBy(*keys))


def weigh(rows: pa.Table, words: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Vectors of length 1 of the ids in a chunk: the ids, the id of each row, and slots, terms and weights of each id.

    Rows of one id count as one review.
    """
    ids = rows["id"].combine_chunks().dictionary_encode("encode")
    owner = ids.indices.to_numpy()
    lists = rows["terms"].combine_chunks()
    known = words["words"].combine_chunks().flatten()
    width = max(len(known), 1)
    slots = pc.index_in(lists.flatten(), value_set=known.field("term"))
    found = slots.is_valid().to_numpy(zero_copy_only=False)
    owners = np.repeat(owner, pc.list_value_length(lists).to_numpy(zero_copy_only=False))[found].astype(np.int64)
    counts = rows["counts"].combine_chunks().flatten().to_numpy()[found]
    pairs, place = np.unique(owners * width + slots.drop_null().to_numpy(), return_inverse=True)
    owners, at = pairs // width, pairs % width
    weights = np.bincount(place, counts, len(pairs)) * known.field("idf").to_numpy()[at]
    norms = np.sqrt(np.bincount(owners, weights * weights, len(ids.dictionary)))
    edges = pa.array(np.searchsorted(owners, np.arange(len(ids.dictionary) + 1)), pa.int32())
    values = pa.array(at, pa.int32()), known.field("term").take(pa.array(at)), pa.array(weights / norms[owners])
    return ids.dictionary, owner, *(pa.ListArray.from_arrays(edges, v) for v in values)


def tfidf_weights(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Weight of each vocabulary term in each review that holds it; both tables are staged."""
    kind = terms.schema["id"].dataType.simpleString()

    def entries(key: tuple, rows: pa.Table, words: pa.Table) -> pa.Table:
        ids, _, slots, names, weights = weigh(rows, words)
        return pa.table({
            KEY: pa.repeat(key[0].as_py(), len(ids)).cast(pa.string()), "id": ids,
            "slots": slots, "terms": names, "weights": weights,
        })

    rows = in_chunks(terms, terms.groupBy(KEY).agg(F.count("*").alias("docs")), CHUNK_ROWS)
    lists = beside_words(rows, vocab).applyInArrow(
        entries, f"{KEY} string, id {kind}, slots array<int>, terms array<string>, weights array<double>"
    )
    return lists.select(KEY, "id", F.inline(F.arrays_zip(
        F.col("slots").alias("slot"), F.col("terms").alias("term"), F.col("weights").alias("weight")
    )))
