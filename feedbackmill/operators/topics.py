"""Topic clusters of each business: TF-IDF vectors grouped by k-means, labelled by top terms.

The vectors of a business are split into chunks of bounded size. A business of one chunk is clustered by
one task. All larger ones and all random starts are clustered together, so the number of jobs depends on the
iterations and not on the number of businesses: a task compares one chunk with the centres and returns
sums, which Spark adds up.
"""

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedbackmill.functions.labels import title_case
from feedbackmill.operators.dashboard import KEY
from feedbackmill.operators.lookup import attach, spread_join
from feedbackmill.operators.ranking import top_per_group
from feedbackmill.operators.tfidf import (
    CHUNK_ROWS,
    MAX_FEATURES,
    beside_words,
    by_chunk,
    english_stop_words,
    in_chunks,
    review_terms,
    vocabulary,
    weigh,
    with_text,
)
from feedbackmill.schemas import NO_TOPIC
from feedbackmill.session import stage

log = logging.getLogger(__name__)

MIN_TEXTS = 5
DENSE_ROWS = 128  # vectors unpacked at a time inside it, few enough for a processor's cache
SAME = 1e-9  # squared distance up to which vectors of length 1 count as equal


def cluster_counts(reviews: DataFrame, n_clusters: int) -> DataFrame:
    """Texts per business and its number of clusters, min(n_clusters, half of the texts)."""
    return (
        with_text(reviews)
        .groupBy(KEY)
        .agg(F.count("*").alias("docs"))
        .withColumn("k", F.least(F.lit(n_clusters), F.floor(F.col("docs") / 2)).cast("int"))
    )


def review_vectors(vocab: DataFrame, terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sparse vector, chunk, number of chunks and k of every review; without a known term it is empty."""

    def vectors(key: tuple, rows: pa.Table, words: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select([KEY, "chunk", "chunks", "id", "k"]).append_column("slots", pa.array([], pa.list_(pa.int32()))) \
                .append_column("weights", pa.array([], pa.list_(pa.float64())))
        _, owner, slots, _, weights = weigh(rows, words)
        owner = pa.array(owner, mask=rows["id"].is_null().to_numpy())
        out = rows.select([KEY, "chunk", "chunks", "id", "k"])
        return out.append_column("slots", slots.take(owner)).append_column("weights", weights.take(owner))

    kind = terms.schema["id"].dataType.simpleString()
    found = beside_words(in_chunks(terms, sizes, CHUNK_ROWS), vocab).applyInArrow(
        vectors,
        f"{KEY} string, chunk int, chunks int, id {kind}, k int, slots array<int>, weights array<double>",
    )
    return found.withColumns({
        "slots": F.coalesce("slots", F.array().cast("array<int>")),
        "weights": F.coalesce("weights", F.array().cast("array<double>")),
    })


class Rows:
    """The vectors of a group as flat arrays."""

    def __init__(self, table: pa.Table):
        slots = table["slots"].combine_chunks()
        self.edges = np.concatenate([[0], np.cumsum(pc.list_value_length(slots).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.slots = slots.flatten().to_numpy().astype(np.int64)
        self.weights = table["weights"].combine_chunks().flatten().to_numpy()
        self.ids = table["id"].combine_chunks().fill_null(0).to_numpy().astype(np.int64) if "id" in table.column_names else None

    def __len__(self) -> int:
        return len(self.edges) - 1

    def dense(self, first: int, last: int, width: int) -> np.ndarray:
        a, b = self.edges[first], self.edges[last]
        out = np.zeros((last - first) * width)
        rows = np.repeat(np.arange(last - first) * width, np.diff(self.edges[first:last + 1]))
        out[rows + self.slots[a:b]] = self.weights[a:b]
        return out.reshape(-1, width)

    def pick(self, rows: np.ndarray, width: int) -> np.ndarray:
        lengths = np.diff(self.edges)[rows]
        ends = np.cumsum(lengths)
        at = np.arange(lengths.sum()) + np.repeat(self.edges[rows] - ends + lengths, lengths)
        out = np.zeros(len(rows) * width)
        out[np.repeat(np.arange(len(rows)) * width, lengths) + self.slots[at]] = self.weights[at]
        return out.reshape(-1, width)

    def squares(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of the vectors, dense, with the squared distance of each to every point."""
        lengths, twice = (points * points).sum(axis=1), 2 * points.T
        owner = np.repeat(np.arange(len(self)), np.diff(self.edges))
        own = np.bincount(owner, self.weights * self.weights, len(self))
        for i in range(0, len(self), DENSE_ROWS):
            last = min(i + DENSE_ROWS, len(self))
            dense = self.dense(i, last, points.shape[1])
            yield dense, np.maximum(own[i:last, None] + lengths - dense @ twice, 0.0)


def _edges(parts: list) -> np.ndarray:
    return np.cumsum([0, *map(len, parts)])


def _points(column: Iterable, width: int) -> list[np.ndarray]:
    return [np.asarray(flat, float).reshape(-1, width) for flat in column]


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    lists = column.combine_chunks()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.split(lists.flatten().to_numpy(), ends[:-1]) if len(lists) else []


def _named(key: tuple, columns: dict, schema: str) -> pa.Table:
    """A table of the columns that ``schema`` names, with the business in each row."""
    count = len(next(iter(columns.values())))
    columns = {KEY: pa.repeat(pa.scalar(key[0].as_py(), pa.string()), count), **columns}
    kinds = {
        "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(),
        "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    }
    fields = [part.split() for part in schema.split(", ")]
    arrays = [c if isinstance(c := columns[name], pa.ChunkedArray) else pa.array(c, kinds[kind]) for name, kind in fields]
    return pa.table(arrays, [name for name, _ in fields])


def _by_chunk(vectors: DataFrame, chunks: DataFrame, centres: DataFrame):
    """Each chunk of vectors next to a copy of the rows of its business in ``centres``.

    Businesses without such rows are left where they lie.
    """
    keys = [KEY, "chunk"]
    copies = spread_join(centres, chunks, [KEY], spread=["start"])
    wanted = vectors.join(F.broadcast(centres.select(KEY)), KEY, "left_semi")
    return wanted.groupBy(*keys).cogroup(copies.groupBy(*keys))


# Starts: k-means||. Each round draws vectors far from those drawn before, in all chunks at once; the few
# that all rounds drew are weighted by the vectors nearest to them and thinned to k.


def _uniform(ids: np.ndarray, starts: np.ndarray, round_: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the id, the start and the round only (ids × starts)."""
    steps = [(start * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % 2**64 for start in starts.tolist()]
    mixed = ids.astype(np.int64).view(np.uint64)[:, None] + np.array(steps, np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
    return ((mixed ^ mixed >> np.uint64(31)) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


DRAWN = "business_url string, start int, id long, draw double, k int, slots array<int>, weights array<double>"


def _by_start(drawn: pa.Table, width: int) -> tuple[np.ndarray, pa.Table, np.ndarray, np.ndarray]:
    """The starts in ``drawn``, its rows in their order, the first row of each, and all rows dense."""
    drawn = drawn.sort_by("start")
    starts, firsts = np.unique(drawn["start"].to_numpy(), return_index=True)
    return starts, drawn, firsts, Rows(drawn).dense(0, drawn.num_rows, width)


def _distant(rows: Rows, points: np.ndarray, firsts: np.ndarray, starts: np.ndarray, round_: int) -> np.ndarray:
    """How long each vector waits to be drawn, per start; NaN if it equals one that was."""
    far = np.concatenate([np.minimum.reduceat(squares, firsts, axis=1) for _, squares in rows.squares(points)])
    return -np.log(_uniform(rows.ids, starts, round_)) / np.where(far > SAME, far, np.nan)


def _nearest_counts(rows: Rows, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of vectors nearest to each point, among those of its start."""
    counts = np.zeros(len(points), np.int64)
    for _, squares in rows.squares(points):
        for a, b in zip(edges, edges[1:]):
            counts[a:b] += np.bincount(squares[:, a:b].argmin(axis=1), minlength=b - a)
    return counts


def draw_distant(
    vectors: DataFrame, chunks: DataFrame, drawn: DataFrame, round_: int, draws: int, width: int
) -> DataFrame:
    """For each start, ``draws`` more vectors per business, likelier the farther they lie from those in ``drawn``.

    A vector at squared distance d waits an exponential time of rate d, and the first ones are taken: so
    each draw takes one of those left with a probability in proportion to d, and no total is needed.
    Vectors that are equal to one drawn before are never taken.
    """

    def wait(key: tuple, table: pa.Table, before: pa.Table) -> pa.Table:
        taken, starts, times = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        if table.num_rows and before.num_rows:
            asked, _, firsts, points = _by_start(before, width)
            waits = _distant(Rows(table), points, firsts, asked, round_)
            best = np.argsort(waits, axis=0, kind="stable")[:draws]
            times = np.take_along_axis(waits, best, axis=0).T.ravel()
            kept = np.isfinite(times)
            taken, starts, times = best.T.ravel()[kept], np.repeat(asked, len(best))[kept], times[kept]
        rows = table.take(pa.array(taken))
        return _named(key, {"start": starts, "draw": times, **{c: rows[c] for c in ("id", "k", "slots", "weights")}}, DRAWN)

    columns = drawn.select(KEY, "start", "slots", "weights")
    far = _by_chunk(vectors, chunks, columns).applyInArrow(wait, DRAWN)
    order = [F.asc("draw"), F.asc("id")]
    return top_per_group(far, [KEY, "start"], order, draws, ["id"], rank="_rank").drop("_rank")


def _weigh(vectors: DataFrame, chunks: DataFrame, drawn: DataFrame, width: int) -> DataFrame:
    """Number of vectors nearest to each drawn one."""
    schema = "start int, id long, business_url string, n long"

    def count(key: tuple, table: pa.Table, before: pa.Table) -> pa.Table:
        if not (table.num_rows and before.num_rows):
            return _named(key, {"start": [], "id": [], "n": []}, schema)
        _, mine, firsts, points = _by_start(before, width)
        counts = _nearest_counts(Rows(table), points, np.append(firsts, len(points)))
        return _named(key, {"start": mine["start"], "id": mine["id"], "n": counts}, schema)

    columns = drawn.select(KEY, "start", "id", "slots", "weights")
    counts = _by_chunk(vectors, chunks, columns).applyInArrow(count, schema)
    return counts.groupBy(KEY, "start", "id").agg(F.sum("n").alias("n"))


def thin(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the points: each next one is drawn by its weight and its squared distance from those taken."""
    rng = np.random.default_rng(seed)
    squares, taken = np.full(len(points), np.inf), []
    for _ in range(min(k, len(points))):
        mass = weights * (squares if taken else 1.0)
        total = mass.sum()
        if not total > 0:
            break
        # As rng.choice draws, without its checks, which cost most where a business has few reviews.
        sums = (mass / total).cumsum()
        taken.append(int((sums / sums[-1]).searchsorted(rng.random(), side="right")))
        squares = np.minimum(squares, ((points - points[taken[-1]]) ** 2).sum(axis=1))
    return points[taken]


def first_centres(
    vectors: DataFrame, chunks: DataFrame, n_clusters: int, n_starts: int, width: int, rounds: int = 2
) -> DataFrame:
    """For each start of a business, k of its vectors that lie far from each other (a row per start)."""
    prints = vectors.select(KEY, "id", F.xxhash64("slots", "weights").alias("print"))
    firsts = [F.min(F.struct(F.xxhash64("print", F.lit(i)), "id"))["id"] for i in range(n_starts)]
    picked = prints.groupBy(KEY).agg(F.array(*firsts).alias("ids")).select(KEY, F.posexplode("ids").alias("start", "id"))
    drawn = vectors.select(KEY, "id", "k", "slots", "weights").join(picked, [KEY, "id"])
    drawn = stage(drawn.select(KEY, "start", "id", "k", "slots", "weights"), "drawn")
    for round_ in range(rounds):
        more = draw_distant(vectors, chunks, drawn, round_, 2 * n_clusters, width)
        drawn = stage(drawn.unionByName(more.select(*drawn.columns)), "drawn")
    weighted = drawn.join(_weigh(vectors, chunks, drawn, width), [KEY, "start", "id"])

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        points = Rows(rows).dense(0, rows.num_rows, width)
        start = rows["start"][0].as_py()
        chosen = thin(points, rows["n"].to_numpy().astype(float), rows["k"][0].as_py(), start)
        return _named(key, {"start": [start], "points": [chosen.ravel()]}, schema)

    schema = "business_url string, start int, points array<double>"
    chosen = weighted.groupBy(KEY, "start").applyInArrow(choose, schema)
    return chosen.withColumns({"cost": F.lit(float("inf")), "moving": F.lit(True)})


# Steps


def _sums(rows: Rows, points: list[np.ndarray], width: int) -> np.ndarray:
    """For the centres of several starts, the sums of the vectors nearest to each, their number and cost."""
    edges = _edges(points)
    sums = np.zeros((edges[-1], width + 2))
    for dense, squares in rows.squares(np.concatenate(points)):
        member = np.zeros_like(squares)
        at = np.arange(len(dense))
        for a, b in zip(edges, edges[1:]):
            member[at, a + squares[:, a:b].argmin(axis=1)] = 1.0
        sums[:, :-2] += member.T @ dense
        sums[:, -2] += member.sum(axis=0)
        sums[:, -1] += (member * squares).sum(axis=0)
    return sums


def _moved(before: np.ndarray, total: np.ndarray, tol: float) -> tuple[np.ndarray, float, bool]:
    """The centres after a step, the cost before it, and whether one has moved by more than ``tol``."""
    count = total[:, -2:-1]
    after = np.where(count > 0, total[:, :-2] / np.maximum(count, 1), before)
    return after, float(total[:, -1].sum()), bool(np.sqrt(((after - before) ** 2).sum(axis=1)).max(initial=0) > tol)


def next_centres(vectors: DataFrame, chunks: DataFrame, centres: DataFrame, width: int, tol: float) -> DataFrame:
    """All starts after a step: means of the vectors nearest to each centre; one without vectors stays.

    ``cost`` is that before the step. ``moving`` says whether a centre has moved by more than ``tol``.
    """
    schema = "business_url string, start int, sums array<double>"

    def add(key: tuple, table: pa.Table, mine: pa.Table) -> pa.Table:
        """Per start, its centres' sums of the nearest vectors, their number and cost, in one array."""
        if not (table.num_rows and mine.num_rows):
            return _named(key, {"start": [], "sums": []}, schema)
        points = _points(_lists(mine["points"]), width)
        edges, sums = _edges(points), _sums(Rows(table), points, width)
        flat = [sums[a:b].ravel() for a, b in zip(edges, edges[1:])]
        return _named(key, {"start": mine["start"], "sums": flat}, schema)

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = zip(_points(batch["points"], width), _points(batch["sums"], width + 2))
            made = [_moved(before, total, tol) for before, total in both]
            names = ("points", "cost", "moving")
            made = {name: [m[i].ravel() if i == 0 else m[i] for m in made] for i, name in enumerate(names)}
            yield batch[["business_url", "start"]].assign(**made)

    sums = _by_chunk(vectors, chunks, centres.select(KEY, "start", "points")).applyInArrow(add, schema)
    total = sums.groupBy(KEY, "start").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    both = centres.select(KEY, "start", "points").join(total, [KEY, "start"])
    return both.mapInPandas(move, "business_url string, start int, points array<double>, cost double, moving boolean")


def settle(
    vectors: DataFrame, chunks: DataFrame, centres: DataFrame, width: int, max_iter: int, tol: float
) -> tuple[DataFrame, int]:
    """The centres at rest, or after ``max_iter`` steps, and how many starts still move."""
    moving = None
    for _ in range(max_iter):
        # Observed while the centres are written, so that the check costs no job.
        seen = Observation()
        moved = next_centres(vectors, chunks, centres.where("moving"), width, tol).observe(seen, F.count_if("moving").alias("moving"))
        centres = stage(moved.unionByName(centres.where("not moving").select(*moved.columns)), "centres")
        moving = seen.get["moving"]
        if not moving:
            break
    return centres, moving or 0


def best_start(centres: DataFrame) -> DataFrame:
    """The start with the lowest cost of each business."""
    best = F.min_by(F.struct("start", "points"), F.struct("cost", "start")).alias("best")
    return centres.groupBy(KEY).agg(best).select(KEY, "best.*")


def _nearest(rows: Rows, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [(squares.argmin(axis=1), squares.min(axis=1)) for _, squares in rows.squares(points)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def nearest_centres(vectors: DataFrame, chunks: DataFrame, centres: DataFrame, width: int) -> DataFrame:
    """The nearest centre of each vector, of one start per business, and its squared distance."""

    schema = "business_url string, review_id long, cluster_id int, square double"

    def assign(key: tuple, table: pa.Table, mine: pa.Table) -> pa.Table:
        if not (table.num_rows and mine.num_rows):
            return _named(key, {"review_id": [], "cluster_id": [], "square": []}, schema)
        (points,) = _points(_lists(mine["points"]), width)
        cluster, square = _nearest(Rows(table), points)
        return _named(key, {"review_id": table["id"], "cluster_id": cluster, "square": square}, schema)

    copies = _by_chunk(vectors, chunks, centres.select(KEY, "start", "points"))
    return copies.applyInArrow(assign, schema)


def single_centres(centres: DataFrame, width: int) -> DataFrame:
    """A row per centre (business_url, cluster, point) of rows per start."""
    parts = F.sequence(F.lit(0), F.floor(F.size("points") / width).cast("int") - 1)
    parts = F.transform(parts, lambda i: F.slice("points", i * width + 1, width))
    return centres.select(KEY, F.posexplode(parts).alias("cluster", "point"))


def centre_labels(centres: DataFrame, vocab: DataFrame, terms: int = 3) -> DataFrame:
    """Label of each cluster: its heaviest terms, heaviest first."""
    return entry_labels(centre_entries(centres), vocab, terms)


def centre_entries(centres: DataFrame) -> DataFrame:
    """A row per place of a centre (business_url, cluster_id, slot, weight)."""
    return centres.select(KEY, F.col("cluster").alias("cluster_id"), F.posexplode("point").alias("slot", "weight"))


def entry_labels(entries: DataFrame, vocab: DataFrame, terms: int = 3) -> DataFrame:
    """Label of each cluster, of the entries of its centre."""
    # A centre at the origin keeps one row, so that its cluster keeps a label.
    entries = entries.where((F.col("weight") > 0) | (F.col("slot") == 0))
    term = F.when(F.col("weight") > 0, F.col("term")).alias("term")
    named = entries.join(vocab.select(KEY, "slot", "term"), [KEY, "slot"]).select(
        KEY, "cluster_id", "slot", "weight", term
    )
    # Rounded, so that weights which are equal but for the order of their sums tie.
    order = [F.desc(F.round("weight", 12)), F.asc("term")]
    ids = [KEY, "cluster_id"]
    top = top_per_group(named, ids, order, terms, ["slot"], rank="_rank")
    ranked = F.array_sort(F.collect_list(F.struct("_rank", "term")))
    label = title_case(F.filter(ranked["term"], lambda t: t.isNotNull()))
    return (
        top.groupBy(*ids)
        .agg(label.alias("cluster_label"))
        .withColumn(
            "cluster_label",
            F.when(F.col("cluster_label") == "", NO_TOPIC).otherwise(F.col("cluster_label")),
        )
    )


ALONE = (
    "business_url string, review_ids array<long>, cluster_ids array<int>,"
    " entries array<struct<cluster_id: int, slot: int, weight: double>>, moving int"
)


def _starts_alone(rows: Rows, hashes: np.ndarray, k: int, draws: int, width: int, rounds: int) -> list[np.ndarray]:
    """The first centres of :func:`first_centres`, of a business that lies in one task."""
    starts = np.arange(hashes.shape[1])
    firsts = [rows.ids[np.lexsort((rows.ids, h))[0]] for h in hashes.T]
    drawn = [np.flatnonzero(rows.ids == first) for first in firsts]
    for round_ in range(rounds):
        every, edges = np.concatenate(drawn), _edges(drawn)
        waits = _distant(rows, rows.pick(every, width), edges[:-1], starts, round_)
        for start in starts:
            best = np.lexsort((rows.ids, waits[:, start]))[:draws]
            drawn[start] = np.append(drawn[start], best[np.isfinite(waits[best, start])])
    every, edges = np.concatenate(drawn), _edges(drawn)
    points = rows.pick(every, width)
    counts = _nearest_counts(rows, points, edges)
    chosen = []
    for start, (a, b) in enumerate(zip(edges, edges[1:])):
        order = a + np.argsort(rows.ids[every[a:b]], kind="stable")
        _, place = np.unique(rows.ids[every[order]], return_inverse=True)
        chosen.append(thin(points[order], np.bincount(place, counts[order])[place], k, start))
    return chosen


def cluster_alone(
    vectors: DataFrame, n_clusters: int, n_starts: int, max_iter: int, tol: float, rounds: int = 2
) -> DataFrame:
    """All of k-means for businesses of one chunk, a row per business.

    The starts, the steps and the choice are those of the businesses that many tasks share. ``entries`` are
    those of the centres, ``moving`` is the number of starts that still move after ``max_iter`` steps.
    """

    def cluster(key: tuple, table: pa.Table) -> pa.Table:
        rows = Rows(table)
        width = int(rows.slots.max(initial=0)) + 1
        hashes = table["hashes"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        points = _starts_alone(rows, hashes, table["k"][0].as_py(), 2 * n_clusters, width, rounds)
        costs, moving = np.full(len(points), np.inf), list(range(len(points)))
        for _ in range(max_iter):
            if not moving:
                break
            mine = [points[start] for start in moving]
            edges, sums = _edges(mine), _sums(rows, mine, width)
            after = [_moved(p, sums[a:b], tol) for p, a, b in zip(mine, edges, edges[1:])]
            for start, (moved, cost, _) in zip(moving, after):
                points[start], costs[start] = moved, cost
            moving = [start for start, (_, _, still) in zip(moving, after) if still]
        best = points[int(costs.argmin())]
        cluster_ids, _ = _nearest(rows, best)
        kept = best > 0
        kept[:, 0] = True
        cluster, slot = np.nonzero(kept)
        entries = pa.StructArray.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(slot, pa.int32()), pa.array(best[kept])], ["cluster_id", "slot", "weight"]
        )
        ids = table["id"].combine_chunks().cast(pa.int64())
        one = [ids, pa.array(cluster_ids, pa.int32()), entries]
        return pa.table(
            [pa.array([key[0].as_py()], pa.string()), *(pa.ListArray.from_arrays([0, len(c)], c) for c in one),
             pa.array([len(moving)], pa.int32())],
            ["business_url", "review_ids", "cluster_ids", "entries", "moving"],
        )

    print_ = F.xxhash64("slots", "weights")
    hashes = F.array(*[F.xxhash64(print_, F.lit(i)) for i in range(n_starts)])
    rows = vectors.select(KEY, "chunk", "id", "k", "slots", "weights", hashes.alias("hashes"))
    return by_chunk(rows).groupBy(KEY, "chunk").applyInArrow(cluster, ALONE)


def cluster_together(
    vectors: DataFrame, n_clusters: int, n_starts: int, width: int, max_iter: int, tol: float
) -> tuple[DataFrame, DataFrame, int]:
    """Clusters of the reviews of businesses of many chunks, their centres, and how many starts still move."""
    # Kept partitioned by chunk, so that an iteration moves only the centres. A lost executor
    # costs a re-read of the staged vectors.
    vectors = by_chunk(vectors).sortWithinPartitions(KEY, "chunk")
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    chunks = stage(vectors.select(KEY, "chunk").distinct(), "chunks")
    centres = stage(first_centres(vectors, chunks, n_clusters, n_starts, width), "centres")
    centres, moving = settle(vectors, chunks, centres, width, max_iter, tol)
    best = stage(best_start(centres), "centres")
    assigned = stage(nearest_centres(vectors, chunks, best, width).drop("square"), "assigned")
    vectors.unpersist()
    return assigned, single_centres(best, width), moving


def cluster_reviews(
    reviews: DataFrame,
    n_clusters: int = 5,
    max_features: int = MAX_FEATURES,
    n_starts: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
    stop_words: list[str] | None = None,
    warnings: list[str] | None = None,
) -> DataFrame:
    """Cluster and label of every review with text (business_url, review_id, cluster_id, label).

    A business with fewer than five texts has one cluster; one whose texts hold no term but stop
    words has none. Centres move until none moves more than ``tol``; starts that have come to rest
    are not computed again. If some still move after ``max_iter`` steps, ``warnings`` says so.
    """
    stop = english_stop_words() if stop_words is None else stop_words
    sizes = stage(cluster_counts(reviews, n_clusters), "sizes")
    few = with_text(reviews).select(KEY, "id")
    few = attach(few, sizes.where(F.col("docs") < MIN_TEXTS), [KEY], spread=["id"]).select(
        KEY,
        F.col("id").alias("review_id"),
        F.lit(0).alias("cluster_id"),
        F.lit(NO_TOPIC).alias("cluster_label"),
    )

    if sizes.where(F.col("docs") >= MIN_TEXTS).isEmpty():
        return few

    terms = stage(review_terms(reviews), "terms")
    vocab = stage(vocabulary(terms, stop, max_features), "vocabulary")
    # Vectors are as wide as the largest vocabulary, which short texts keep far below the limit.
    width = (vocab.agg(F.max("slot")).first()[0] or 0) + 1
    large = sizes.where(F.col("docs") >= MIN_TEXTS).join(
        vocab.select(KEY).distinct(), KEY, "left_semi"
    )
    vectors = stage(review_vectors(vocab, terms, large), "vectors")

    alone = cluster_alone(vectors.where("chunks = 1"), n_clusters, n_starts, max_iter, tol)
    alone = stage(alone, "alone")
    moving = alone.agg(F.sum("moving")).first()[0] or 0
    labels = entry_labels(alone.select(KEY, F.inline("entries")), vocab)
    # One row per business on both sides, however many they are.
    named = labels.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "cluster_label"))).alias("names"))
    clusters = alone.drop("entries").join(named, KEY).select(
        KEY, "names", F.inline(F.arrays_zip(F.col("review_ids").alias("review_id"), F.col("cluster_ids").alias("cluster_id")))
    ).select(KEY, "review_id", "cluster_id", F.element_at("names", F.col("cluster_id")).alias("cluster_label"))

    if not sizes.where(F.col("docs") > CHUNK_ROWS).isEmpty():
        many = vectors.where("chunks > 1")
        assigned, centres, still = cluster_together(many, n_clusters, n_starts, width, max_iter, tol)
        moving += still
        labelled = attach(assigned, centre_labels(centres, vocab), [KEY, "cluster_id"], spread=["review_id"])
        clusters = clusters.unionByName(labelled.select(*clusters.columns))
    if moving:
        text = f"k-means stopped after {max_iter} steps, with centres still moving"
        log.warning(text)
        if warnings is not None:
            warnings.append(text)
    return clusters.unionByName(few)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Reviews per cluster and its label."""
    return clusters.groupBy(KEY, "cluster_id", "cluster_label").agg(F.count("*").alias("n"))
