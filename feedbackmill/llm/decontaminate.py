"""Copies of benchmark items in documents, edited ones too: rare n-gram seeds and local alignment.

A passage that scores half of an item's best or more keeps many of the item's neighbouring words
together. So of the item's word pairs it must hold some of the rarest, whose number is such that no
copy goes without. Those are the seeds, by which documents are joined to items. In the documents
found, the pairs kept are counted around each place, and what reaches the count is aligned.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedbackmill.llm.bitmap import hash_bitmap, in_bitmap, only_survivors, survivors
from feedbackmill.llm.common import share, slices, worker_store
from feedbackmill.llm.hot_join import join_spread
from feedbackmill.session import stage

#: Words that an item has at least; shorter ones are found nowhere.
LEAST_WORDS = 3
#: Smith-Waterman scores, and the part of an item's best score from which a passage is a copy.
MATCH, MISMATCH, GAP = 2, -1, -1
COPY_AT = 0.5
#: What a copy of n words holds of the item's pairs of neighbours: KEPT times those that stay together
#: plus PARTED times those with one foreign word between them is n - SPARE or more. For with MATCH = 2
#: and costs of 1, a step to the next matched word brings 2 or 1 in these two cases, 1 at most if it
#: leaves out one word of the item and nothing if it leaves out more; the steps cover n - 1 words at
#: most, and must bring n - 2 for a score of COPY_AT * MATCH * n = n.
KEPT, PARTED, SPARE = 3, 1, 3
#: Seeds that a document must share with an item, if a copy of it holds so many.
SHARED_SEEDS = 2
#: Words of which a Python worker keeps the hashes.
KEPT_WORDS = 500_000

_WORD = re.compile(r"\w+")


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the position in ``words`` just after its end.

    A row of the matrix is filled at once: a gap in the item costs the same per word, so the best
    way to come from the left is a running maximum.
    """
    slope = np.arange(len(words) + 1) * GAP
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(words == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(step - slope) + slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


@dataclass
class Items:
    """Benchmark items as numbered words, with their pairs."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> "Items":
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for item_id, text in rows:
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall((text or "").lower())]
            if len(found) >= LEAST_WORDS:
                ids.append(item_id)
                words.append(np.array(found, np.int64))
        return cls(ids, words, vocabulary)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Words by number, -1 if no item has them."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)

    def pairs(self, numbers: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair as one number, position) of the items' words that stand ``gap`` places apart."""
        left, right = numbers[:-gap], numbers[gap:]
        known = np.flatnonzero((left >= 0) & (right >= 0))
        return left[known] * len(self.vocabulary) + right[known], known


@dataclass
class Pairs:
    """All pairs of neighbouring words of the items; a pair's items lie between its bounds.

    The first and the last word of an item of three are a pair too, since those two are a copy.
    """

    pairs: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    times: np.ndarray
    needed: np.ndarray

    @classmethod
    def of(cls, items: Items) -> "Pairs":
        found = []
        for i, words in enumerate(items.words):
            gaps = (1, 2) if len(words) == LEAST_WORDS else (1,)
            codes, times = np.unique(np.concatenate([items.pairs(words, g)[0] for g in gaps]), return_counts=True)
            found.append(np.stack([codes, np.full(len(codes), i), times], 1))
        table = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        pairs, first = np.unique(table[:, 0], return_index=True)
        needed = np.array([max(PARTED, len(w) - SPARE) for w in items.words], np.int64)
        return cls(pairs, np.r_[first, len(table)], table[:, 1], table[:, 2], needed)

    def _known(self, codes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        hit = self.pairs[at] == codes
        return at[hit], positions[hit]

    def places(self, items: Items, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, positions) from which on twice the item's length may hold all pairs of a copy."""
        if not len(self.pairs):
            return
        kept, kept_at = self._known(*items.pairs(numbers, 1))
        parted, parted_at = self._known(*items.pairs(numbers, 2))
        if not len(kept) + len(parted):
            return
        pair, at = np.r_[kept, parted], np.r_[kept_at, parted_at]
        weight = np.r_[np.full(len(kept), KEPT), np.full(len(parted), PARTED)]
        # First by what the whole text holds, each pair of an item once.
        held, place = np.unique(pair, return_index=True)  # kept ones come first
        counts = self.bounds[held + 1] - self.bounds[held]
        entry = np.repeat(self.bounds[held] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        sums = np.bincount(
            self.items[entry], np.repeat(weight[place], counts) * self.times[entry], minlength=len(self.needed)
        )
        for i in np.flatnonzero(sums >= self.needed):
            mine = entry[self.items[entry] == i]
            value = np.zeros(len(self.pairs), np.int64)
            value[np.searchsorted(self.bounds, mine, side="right") - 1] = self.times[mine]
            value = value[pair] * weight
            order = np.flatnonzero(value)
            order = order[np.argsort(at[order], kind="stable")]
            where, total = at[order], np.r_[0, np.cumsum(value[order])]
            until = np.searchsorted(where, where + 2 * len(items.words[i]))
            enough = total[until] - total[:-1] >= self.needed[i]
            if enough.any():
                yield int(i), np.unique(where[enough])


def copies(items: Items, pairs: Pairs, text: str) -> list[tuple[int, float, int, int]]:
    """(item position, score, start, end) of the best copy of each item; code points, end exclusive."""
    words = _WORD.findall(text.lower())
    numbers = items.numbers(words)
    found, places = [], None
    for i, starts in pairs.places(items, numbers):
        item = items.words[i]
        reach = 2 * len(item)  # a copy has no more words, as each one too many costs a point
        best = (0, 0, 0)
        # Places whose surroundings overlap are aligned together.
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * reach) + 1):
            low, high = max(0, int(group[0]) - reach), int(group[-1]) + reach
            window = numbers[low:high]
            # Words that the window lacks can't match, which bounds the score before any alignment.
            if np.isin(item, window).sum() < COPY_AT * len(item):
                continue
            score, end = align(item, window)
            if score > best[0]:
                _, back = align(item[::-1], window[max(0, end - reach) : end][::-1])
                best = (score, low + end - back, low + end)
        if best[0] >= COPY_AT * MATCH * len(item):
            if places is None:
                places = [m.span() for m in _WORD.finditer(text.lower())]
            found.append((i, best[0] / (MATCH * len(item)), places[best[1]][0], places[best[2] - 1][1]))
    return found


def _gap_hashes(hashes: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of the pairs of words that stand ``gap`` places apart, as signed numbers."""
    left, right = hashes[:-gap], hashes[gap:]
    mixed = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + (left >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(32)).view(np.int64)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, in lower case."""
    from xxhash import xxh64_intdigest

    known = worker_store("word hashes")
    if len(known) > KEPT_WORDS:
        known.clear()
    words = _WORD.findall(text.lower())
    found = list(map(known.get, words))
    if None in found:
        for i, value in enumerate(found):
            if value is None:
                found[i] = known[words[i]] = xxh64_intdigest(words[i])
    return np.array(found, np.uint64)


def seed_plan(words: int) -> tuple[int, int]:
    """How many of an item's rarest pairs are seeds, and how many of them a copy holds at least.

    An item of n words has n - 1 pairs (three words: 3, see Pairs). A copy holds k of them, since each
    gives KEPT at most of the weight n - SPARE. It may lack the other ones, whatever they are; so of
    all but k - s of the pairs it holds s at least.
    """
    pairs = words - 1 if words > LEAST_WORDS else 3
    held = max(1, -(-(words - SPARE) // KEPT))
    shared = min(SHARED_SEEDS, held)
    return pairs - held + shared, shared


def numbered_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The different items (item, item_id, text), numbered and staged."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").isNotNull()).distinct()
    return stage(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")


def item_pairs(items: DataFrame) -> DataFrame:
    """item, gram, times, seeds, shared: each different pair of an item, and its plan of seeds."""

    def pairs(batches):
        for batch in slices(batches, "text"):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = word_hashes(text)
                if len(hashes) < LEAST_WORDS:
                    continue
                gaps = (1, 2) if len(hashes) == LEAST_WORDS else (1,)
                grams, times = np.unique(np.concatenate([_gap_hashes(hashes, g) for g in gaps]), return_counts=True)
                plan = [np.full(len(grams), x) for x in seed_plan(len(hashes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (np.full(len(grams), item), grams, times, *plan)], ["item", "gram", "times", "seeds", "shared"]
                )

    return stage(items.select("item", "text").mapInArrow(pairs, "item long, gram long, times long, seeds long, shared long"), "pairs")


def document_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, grams: the different pairs of each text that items have, too, staged.

    Pairs with one foreign word between count as well. What items have is told by a bitmap of fixed
    size, so that any number of items takes one pass; it may let through some pairs that none has.
    """
    shared = share(docs.sparkSession, hash_bitmap(pairs, "gram"))

    def held(batches):
        words = shared()
        for batch in slices(batches, "text"):
            docs, sizes, grams = [], [0], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = word_hashes(text or "")
                found = np.concatenate([_gap_hashes(hashes, 1), _gap_hashes(hashes, 2)])
                found = np.unique(found[in_bitmap(words, found)])
                if len(found):
                    docs.append(doc)
                    grams.append(found)
                    sizes.append(sizes[-1] + len(found))
            if docs:
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(grams)))
                yield pa.RecordBatch.from_pydict({"doc": pa.array(docs, pa.int64()), "grams": lists})

    return stage(docs.select("doc", "text").mapInArrow(held, "doc long, grams array<long>"), "document-pairs")


def rare_seeds(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, item, times, shared: the rarest pairs of each item by number of documents, staged."""
    known = pairs.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = F.expr("coalesce(sum(times) over (partition by item order by n, gram rows between unbounded preceding and 1 preceding), 0)")
    rare = known.withColumn("before", before).where("before < seeds and n > 0")
    return stage(rare.select("gram", "item", "times", "shared"), "seeds")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc, item: what the join by seeds leaves, staged. Every document with a copy is there, with the item."""
    pairs = item_pairs(items)
    held = document_pairs(docs, pairs).select("doc", F.explode("grams").alias("gram"))
    counts = stage(held.groupBy("gram").agg(F.count("*").alias("n")), "counts")
    seeds = rare_seeds(pairs, counts)
    likely = only_survivors(held, survivors(seeds, ["gram"]), ["gram"]).where("survives")
    likely = stage(likely.select("doc", "gram").distinct(), "seed-hits")
    met = join_spread(likely, seeds, "gram", "doc", counts, likely.count())
    enough = met.groupBy("doc", "item").agg(F.sum("times").alias("times"), F.max("shared").alias("shared"))
    return stage(enough.where("times >= shared").select("doc", "item"), "candidates")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column, Column]:
    """A hash of id and text, which joins candidates to their documents, and both. Documents with one
    hash share their candidates, which changes no result, as all are aligned."""
    key, said = F.col(doc_id).cast("long"), F.col(text)
    return F.xxhash64(key, said).alias("doc"), key.alias("doc_id"), said.alias("text")


def _aligned(docs: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """doc, doc_id, item_id, score, start, end of the copies among the candidates; only their texts are moved."""
    named = found.join(items, "item").groupBy("doc").agg(F.collect_list(F.struct("item_id", F.col("text").alias("said"))).alias("items"))
    likely = only_survivors(docs, survivors(found, ["doc"]), ["doc"]).where("survives").drop("survives")
    schema = "doc long, doc_id long, item_id long, score double, start long, end long"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def search(batches):
        for batch in slices(batches, "text"):
            rows = []
            for doc, doc_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "doc_id", "text", "items")), strict=True):
                items = Items.of([(i["item_id"], i["said"]) for i in wanted])
                rows += [(doc, doc_id, items.ids[i], *at) for i, *at in copies(items, Pairs.of(items), text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["doc", "doc_id", "item_id", "score", "start", "end"]
                )

    return likely.join(named, "doc").select("doc", "doc_id", "text", "items").mapInArrow(search, schema)


def find_copies(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, item_id, score, start, end: the best copy of each item in each document that has one.

    Whole texts are searched, in upper or lower case and whatever stands between words. Null and
    empty texts have no copies; items of fewer than three words are found nowhere.
    Repeated documents and items of one id but different texts are each reported, repeated items
    once. Other columns are ignored. Documents are read twice, whatever the number of items: for
    their pairs of words, and for the texts of those that share seeds with an item.
    """
    rows = docs.select(*_keyed(docs, doc_id, text))
    items = numbered_items(benchmark)
    return _aligned(rows, candidates(rows, items), items).drop("doc")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no copy of any item, with all their columns."""
    key, one, said = _keyed(docs, doc_id, text)
    rows, items = docs.select(key, one, said), numbered_items(benchmark)
    found = candidates(rows, items)
    copied = stage(_aligned(rows, found, items).select("doc").distinct(), "copied")
    whole = docs.select(key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marked = only_survivors(whole, survivors(copied, ["doc"]), ["doc"])
    # Only the few rows that the bitmap lets through are moved to be told apart.
    clean = marked.where("not survives").unionByName(marked.where("survives").join(copied, "doc", "left_anti"))
    return clean.select("row.*")
