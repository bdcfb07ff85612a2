"""Words and terms: the top-words chart and the term counts behind the two word clouds."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedbackmill.functions.text import CHART_STOP_WORDS, chart_words, cloud_tokens
from feedbackmill.operators.dashboard import KEY
from feedbackmill.operators.lookup import attach, spread_join
from feedbackmill.operators.ranking import top_per_group
from feedbackmill.operators.word_lists import plain_or_words, row_words
from feedbackmill.schemas import NEGATIVE, POSITIVE
from feedbackmill.session import stage

# Stop list of the word clouds (the English list of the public wordcloud library).
CLOUD_STOP_WORDS = tuple(
    """a about above after again against all also am an and any are aren't as at be because been
    before being below between both but by can can't cannot com could couldn't did didn't do does
    doesn't doing don't down during each else ever few for from further get had hadn't has hasn't
    have haven't having he he'd he'll he's hence her here here's hers herself him himself his how
    how's however http i i'd i'll i'm i've if in into is isn't it it's its itself just k let's like
    me more most mustn't my myself no nor not of off on once only or other otherwise ought our ours
    ourselves out over own r same shall shan't she she'd she'll she's should shouldn't since so
    some such than that that's the their theirs them themselves then there there's therefore these
    they they'd they'll they're they've this those through to too under until up very was wasn't we
    we'd we'll we're we've were weren't what what's when when's where where's which while who who's
    whom why why's with won't would wouldn't www you you'd you'll you're you've your yours yourself
    yourselves""".split()
)
CLOUD_SIZE = 100
CLOUD_BYTES = 8 * 1024 * 1024  # text of a group whose word pairs one task counts
COLLOCATION_THRESHOLD = 30.0


def top_words(
    reviews: DataFrame, n: int = 5, stop_words: tuple[str, ...] = CHART_STOP_WORDS
) -> DataFrame:
    """The ``n`` most frequent words per business; ties go to the word seen first."""
    words = reviews.select(KEY, "id", chart_words(F.col("review_text")).alias("_words"))
    firsts = words.select("*", F.array_distinct("_words").alias("_firsts"))
    # Each review gives its distinct words in order of appearance, then all of its words: the
    # first part tells where a word was first seen, the second how often. Both reduce to
    # fixed-width buffers, so the partial aggregation hashes instead of sorting tokens.
    tokens = firsts.select(
        KEY,
        "id",
        F.size("_firsts").alias("_distinct"),
        F.posexplode_outer(F.concat("_firsts", "_words")).alias("_at", "word"),
    ).where(~F.col("word").isin(*stop_words))
    is_first = F.col("_at") < F.col("_distinct")
    counts = tokens.groupBy(KEY, "word").agg(
        F.count_if(~is_first).alias("n"),
        F.min("id").alias("_id"),
        F.min_by("_at", F.when(is_first, F.col("id"))).alias("_at"),
    )
    order = [F.desc("n"), F.asc("_id"), F.asc("_at")]
    return top_per_group(counts, [KEY], order, n, ["word"], rank="rank").drop("_id", "_at")


def _cloud_words(text: Column) -> Column:
    """Tokens of a text without possessive endings and bare numbers."""
    bare = F.transform(
        cloud_tokens(text),
        lambda t: F.when(F.endswith(t, F.lit("'s")), F.substring(t, F.lit(1), F.length(t) - 2))
        .otherwise(t),
    )
    # Only a token that starts below "a" can be a number, so few tokens reach the pattern.
    return F.filter(bare, lambda t: ~((t < "a") | (t > "{")) | ~t.rlike(r"^\p{N}+$"))


def _count_terms(terms: DataFrame, group: list[str], merge_plurals: bool) -> DataFrame:
    """Occurrences of each stem as itself (``n_stem``) and with a plural s (``n_plural``).

    The stem of a word in -s (not -ss) is the word without it. A stem never ends in s itself, so
    a singular and its plural, and no others, share a stem: one grouping finds both.
    """
    term, stem = F.col("term"), F.col("term")
    if merge_plurals:
        plural = F.endswith(term, F.lit("s")) & ~F.endswith(term, F.lit("ss"))
        cut = F.substring(term, F.lit(1), F.length(term) - 1)
        stem = F.when(plural, cut).otherwise(term)
    stems = terms.select(*group, stem.alias("stem"), (stem != term).alias("_plural"))
    return stems.groupBy(*group, "stem").agg(
        F.count_if(~F.col("_plural")).alias("n_stem"), F.count_if("_plural").alias("n_plural")
    )


def _standard_term() -> Column:
    """The singular where it occurs, else the plural."""
    return F.when(F.col("n_stem") > 0, F.col("stem")).otherwise(F.concat("stem", F.lit("s")))


def _totals(counts: DataFrame, group: list[str]) -> DataFrame:
    total = F.col("n_stem") + F.col("n_plural")
    return counts.select(*group, _standard_term().alias("term"), total.alias("n"))


def _written_forms(counts: DataFrame, group: list[str]) -> DataFrame:
    """Each word as written with its standard term and that term's count."""
    plural = F.when(F.col("n_plural") > 0, F.concat("stem", F.lit("s")))
    written = F.array_compact(F.array(F.when(F.col("n_stem") > 0, F.col("stem")), plural))
    return counts.select(
        *group,
        F.explode(written).alias("form"),
        _standard_term().alias("term"),
        (F.col("n_stem") + F.col("n_plural")).alias("n"),
    )


def _log_likelihood(k: Column, n: Column, x: Column) -> Column:
    """Binomial log likelihood with x kept off 0 and 1."""
    p = F.greatest(F.least(x, F.lit(1 - 1e-10)), F.lit(1e-10))
    return F.log(p) * k + F.log(1 - p) * (n - k)


def collocation_score(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of a word pair against independent words."""
    p, p_if_first = second / total, pair / first
    p_else = (second - pair) / F.greatest(total - first, F.lit(1))
    independent = _log_likelihood(pair, first, p) + _log_likelihood(second - pair, total - first, p)
    dependent = _log_likelihood(pair, first, p_if_first) + _log_likelihood(
        second - pair, total - first, p_else
    )
    return -2 * (independent - dependent)


def _collocations(
    words: DataFrame, counts: DataFrame, group: list[str], stop: tuple[str, ...], plurals: bool
) -> DataFrame:
    """Terms per group when pairs that occur together more than by chance count as one term."""
    following = words.withColumn("_following", F.slice("_words", F.lit(2), F.size("_words")))
    neighbours = following.select(*group, F.inline_outer(F.arrays_zip("_words", "_following")))
    kept = ~F.col("_words").isin(*stop) & ~F.col("_following").isin(*stop)
    pairs = neighbours.where(kept).select(
        *group, F.concat_ws(" ", "_words", "_following").alias("term")
    )
    pairs = _totals(_count_terms(pairs, group, plurals), group).select(
        "*",
        F.substring_index("term", " ", 1).alias("first"),
        F.substring_index("term", " ", -1).alias("second"),
    )
    unigrams, forms = _totals(counts, group), _written_forms(counts, group)

    def side(name: str) -> DataFrame:
        return forms.withColumnsRenamed({"form": name, "term": f"{name}_term", "n": f"n_{name}"})

    scored = pairs.join(side("first"), [*group, "first"]).join(side("second"), [*group, "second"])
    totals = unigrams.groupBy(*group).agg(F.sum("n").alias("total"))
    score = collocation_score(F.col("n"), F.col("n_first"), F.col("n_second"), F.col("total"))
    found = attach(scored, totals, group, spread=["term"]).where(score > COLLOCATION_THRESHOLD)
    changes = found.select(*group, F.inline(F.array(
        F.struct("term", "n"),
        F.struct(F.col("first_term").alias("term"), (-F.col("n")).alias("n")),
        F.struct(F.col("second_term").alias("term"), (-F.col("n")).alias("n")),
    )))
    changed = unigrams.unionByName(changes).groupBy(*group, "term").agg(F.sum("n").alias("n"))
    return changed.where(F.col("n") > 0)


def _llr(pair: np.ndarray, first: np.ndarray, second: np.ndarray, total: np.ndarray) -> np.ndarray:
    """:func:`collocation_score` of arrays."""

    def likelihood(k, n, x):
        p = np.clip(x, 1e-10, 1 - 1e-10)
        return np.log(p) * k + np.log(1 - p) * (n - k)

    p, p_if_first = second / total, pair / first
    p_else = (second - pair) / np.maximum(total - first, 1)
    independent = likelihood(pair, first, p) + likelihood(second - pair, total - first, p)
    return -2 * (independent - likelihood(pair, first, p_if_first) - likelihood(second - pair, total - first, p_else))


def _sums(keys: np.ndarray, *masks: np.ndarray) -> list[np.ndarray]:
    """The different keys, and how many rows of each a mask holds."""
    different, place = np.unique(keys, return_inverse=True)
    return [different, *(np.bincount(place[m], minlength=len(different)) for m in masks)]


def _plus_s(words: pa.Array, places: np.ndarray, plural: np.ndarray) -> pa.Array:
    words = words.take(pa.array(places))
    return pc.if_else(pa.array(plural), pc.binary_join_element_wise(words, "s", ""), words)


def _clouds(table: pa.Table, n: int, stop: tuple[str, ...], plurals: bool) -> pa.Table:
    """The terms of :func:`_collocations` of all groups in ``table``, those that are behind ``n`` others left out.

    As there, reviews without a business give single words only.
    """
    urls, moods = (table[c].combine_chunks().dictionary_encode("encode") for c in (KEY, "sentiment"))
    groups = urls.indices.to_numpy().astype(np.int64) * len(moods.dictionary) + moods.indices.to_numpy()
    rows, words = row_words(table, cloud=True)
    words = words.dictionary_encode()
    written, at = words.dictionary, words.indices.to_numpy()
    plural = np.zeros(len(written), bool)
    if plurals:
        plural = pc.and_not(pc.ends_with(written, "s"), pc.ends_with(written, "ss")).to_numpy(zero_copy_only=False)
    stems = pc.if_else(pa.array(plural), pc.utf8_slice_codeunits(written, 0, -1), written).dictionary_encode()
    stem, stems = stems.indices.to_numpy().astype(np.int64), stems.dictionary
    kept = ~pc.is_in(written, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)[at]
    wide = max(len(stems), 1)
    keys, n_stem, n_plural = _sums((groups[rows] * wide + stem[at])[kept], ~plural[at[kept]], plural[at[kept]])
    group, count = keys // wide, n_stem + n_plural
    terms = _plus_s(stems, keys % wide, n_stem == 0)

    named = ~pc.is_null(table[KEY]).to_numpy()[rows]
    pairs = np.flatnonzero((rows[1:] == rows[:-1]) & kept[1:] & kept[:-1] & named[1:])
    first, second = at[pairs].astype(np.int64), at[pairs + 1]
    # The group and the first word, which stays as written, in one number, so that the key of a pair fits 64 bits.
    heads, head = np.unique(groups[rows[pairs]] * max(len(written), 1) + first, return_inverse=True)
    found, pair_stem, pair_plural = _sums(head * wide + stem[second], ~plural[second], plural[second])
    pair_group, first = np.divmod(heads[found // wide], max(len(written), 1))
    second, pair_count = found % wide, pair_stem + pair_plural
    first_at, second_at = np.searchsorted(keys, pair_group * wide + stem[first]), np.searchsorted(keys, pair_group * wide + second)
    total = np.bincount(group, count, minlength=groups.max(initial=0) + 1)
    together = _llr(pair_count, count[first_at], count[second_at], total[pair_group]) > COLLOCATION_THRESHOLD
    left = count - sum(np.bincount(p[together], pair_count[together], minlength=len(count)).astype(np.int64) for p in (first_at, second_at))
    second = _plus_s(stems, second[together], pair_stem[together] == 0)
    pair_terms = pc.binary_join_element_wise(written.take(pa.array(first[together])), second, " ")

    group, count = np.append(group, pair_group[together]), np.append(left, pair_count[together])
    order = np.lexsort((-count, group))
    nth = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    last = np.ones(groups.max(initial=0) + 1, np.int64)
    last[group[order[nth == n - 1]]] = np.maximum(count[order[nth == n - 1]], 1)
    chosen = np.flatnonzero(count >= last[group])
    names = pa.concat_arrays([terms, pair_terms]).take(pa.array(chosen))
    parts = np.divmod(group[chosen], len(moods.dictionary) or 1)
    columns = [d.dictionary.take(pa.array(p)) for d, p in zip((urls, moods), parts)]
    return pa.table([*columns, names, pa.array(count[chosen])], [KEY, "sentiment", "term", "n"])


def _clouds_by_lot(reviews: DataFrame, size: int, n: int, stop: tuple[str, ...], plurals: bool) -> DataFrame:
    """Terms of groups of up to ``CLOUD_BYTES``, many groups to a lot; a task counts the pairs of a lot at a time.

    ``size`` is the number of bytes of all texts.
    """
    tasks = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots = max(4 * tasks, 2 * size // CLOUD_BYTES)
    lot = F.pmod(F.xxhash64(KEY, "sentiment"), F.lit(lots)).cast("int").alias("lot")
    dealt = reviews.select(KEY, "sentiment", "review_text", lot).repartition(tasks, "lot")
    text = F.col("review_text")
    words = dealt.select("lot", KEY, "sentiment", *plain_or_words(text, _cloud_words(text)))

    def count(table: pa.Table) -> pa.Table:
        return _clouds(table, n, stop, plurals)

    return words.groupBy("lot").applyInArrow(count, f"{KEY} string, sentiment string, term string, n long")


def term_frequencies(
    reviews: DataFrame,
    n: int = CLOUD_SIZE,
    stop_words: tuple[str, ...] = CLOUD_STOP_WORDS,
    merge_plurals: bool = False,
    collocations: bool = False,
) -> DataFrame:
    """The ``n`` most frequent terms of the positive and of the negative reviews of a business.

    ``collocations`` also counts word pairs within a review, as the word clouds do. Nearly every pair is a
    different one, so groups of up to ``CLOUD_BYTES`` of text are counted by one task each, without a row per pair.
    """
    group = [KEY, "sentiment"]
    reviews = reviews.where(F.col("sentiment").isin(POSITIVE, NEGATIVE))
    clouds = None
    if collocations:
        sizes = stage(reviews.groupBy(*group).agg(F.coalesce(F.sum(F.octet_length("review_text")), F.lit(0)).alias("_bytes")), "sizes")
        small = F.col("_bytes") <= CLOUD_BYTES
        few, many = sizes.agg(F.sum(F.when(small, F.col("_bytes"))), F.count_if(~small)).first()
        reviews = spread_join(reviews.select(*group, "review_text"), sizes, group, spread=["review_text"])
        clouds = _clouds_by_lot(reviews.where(small), few or 0, n, stop_words, merge_plurals)
        reviews = reviews.where(~small)
        if not many:
            return top_per_group(clouds, group, [F.desc("n"), F.asc("term")], n, ["term"], rank="rank")
    words = reviews.select(*group, _cloud_words(F.col("review_text")).alias("_words"))
    tokens = words.select(*group, F.explode_outer("_words").alias("term"))
    tokens = tokens.where(~F.col("term").isin(*stop_words))
    counts = _count_terms(tokens, group, merge_plurals)
    if collocations:
        counts = stage(counts, "stems")  # read by both sides of the pairs and for the totals
        terms = _collocations(words, counts, group, stop_words, merge_plurals).unionByName(clouds)
    else:
        terms = _totals(counts, group)
    return top_per_group(terms, group, [F.desc("n"), F.asc("term")], n, ["term"], rank="rank")
