"""Nearest neighbours by collision counting on single projections.

Vectors are dealt to shards of bounded size. A shard keeps, for each of many random directions, its
projections in sorted order. A query looks at the window of each array around its own projection;
vectors that lie in enough windows are verified by their true distance. Windows grow by virtual
rehashing: radius after radius, only what a wider window adds is counted. A query is done when its
k-th verified distance is within the radius.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Directions, window width at radius 1, and part of the windows that a vector must lie in.
PROJECTIONS = 64
WIDTH = 2.719
THRESHOLD = 0.72
#: Factor from a radius to the next.
GROWTH = 1.2
#: Vectors of a shard at most, on average, and queries that a task handles at once.
SHARD_ROWS = 8192
QUERY_BATCH = 256
SEED = 11


def directions(size: int, n: int = PROJECTIONS) -> np.ndarray:
    """Random directions, the same in every task."""
    return np.random.default_rng([SEED, size]).normal(size=(size, n))


class Shard:
    """Sorted projections of the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        """``ids`` ascend; rows of equal vectors are one candidate with all their ids."""
        raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, firsts, group = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors = vectors[firsts]
        order = np.lexsort((ids, group))
        self.ids, self.ends = ids[order], np.cumsum(np.bincount(group))
        self.axes = directions(vectors.shape[1], projections)
        projected = (self.vectors @ self.axes).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        ordered = np.take_along_axis(projected, self.order, 1)
        # The arrays stand one after the other, far enough apart that one search serves them all.
        reach = float(ordered.max() - ordered.min())
        self.limit = 4 * reach + 1
        self.shift = np.arange(projections) * (3 * self.limit) - ordered.min()
        self.flat = (ordered + self.shift[:, None]).ravel()
        self.order = self.order.ravel()

    def ids_of(self, candidate: int, most: int) -> np.ndarray:
        start = self.ends[candidate - 1] if candidate else 0
        return self.ids[start : min(self.ends[candidate], start + most)]

    def search(self, query: np.ndarray, own: int, k: int, radius: float) -> list[tuple[float, int]]:
        """The k nearest (distance, id) found, without the row ``own``; all candidates if they are fewer.

        ``radius`` is where the windows begin.
        """
        n, m = len(self.vectors), self.axes.shape[1]
        need = math.ceil(THRESHOLD * m)
        starts = np.arange(m) * n
        place = np.clip(query @ self.axes + self.shift - np.arange(m) * 3 * self.limit, -self.limit, self.limit)
        place = place + np.arange(m) * 3 * self.limit
        low = high = np.clip(np.searchsorted(self.flat, place), starts, starts + n)
        counts, verified = np.zeros(n, np.int32), np.zeros(n, bool)
        distances, candidates = np.zeros(0), np.zeros(0, np.int64)
        while True:
            reach = min(WIDTH * radius / 2, 2 * self.limit)
            left = np.clip(np.searchsorted(self.flat, place - reach), starts, low)
            right = np.clip(np.searchsorted(self.flat, place + reach, side="right"), high, starts + n)
            fresh = [self.order[a:b] for a, b in zip(np.r_[left, high].tolist(), np.r_[low, right].tolist()) if a < b]
            low, high = left, right
            fresh.append(np.zeros(0, self.order.dtype))
            met = np.concatenate(fresh)
            counts += np.bincount(met, minlength=n)
            ready = np.flatnonzero((counts >= need) & ~verified)
            verified[ready] = True
            if len(ready):
                exact = np.sqrt(((self.vectors[ready] - query) ** 2).sum(1))
                distances, candidates = np.concatenate([distances, exact]), np.concatenate([candidates, ready])
                # One more than k, since the query's own row may be among them.
                if len(distances) > 4 * (k + 1):
                    keep = distances <= np.partition(distances, k)[k]
                    distances, candidates = distances[keep], candidates[keep]
            everything = (high - low == n).all()
            if everything or (len(distances) and self._enough(distances, candidates, own, k, radius)):
                break
            radius *= GROWTH
        found = [(d, int(i)) for d, c in zip(distances, candidates) for i in self.ids_of(c, k + 1) if i != own]
        return sorted(found)[:k]

    def _enough(self, distances, candidates, own, k, radius) -> bool:
        within = candidates[distances <= radius]
        held = sum(len(self.ids_of(c, k + 1)) for c in within[: k + 1])
        return held > k

    def first_radius(self) -> float:
        """Half of what some vectors are away from their nearest one; any radius gives the same results."""
        some = self.vectors[:: max(1, len(self.vectors) // 32)]
        away = []
        for v in some:
            far = ((self.vectors - v) ** 2).sum(1)
            away += [math.sqrt(far[far > 0].min())] if (far > 0).any() else []
        return max(float(np.median(away)) / 2, 1e-12) if away else 1.0


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec (doubles) and dim of the rows that take part.

    Null vectors and ids, and vectors that are empty, zero, or hold a null, NaN or infinite
    component take no part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    return rows.where(fine).withColumn("dim", F.size("vec"))


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id ``every`` divides.

    Euclidean distance in double precision, ties to the smaller id. Candidates are all other rows
    of as many components. Rows of one id count once, with the smallest vector. Each query goes
    to every shard, gets the k nearest there, and keeps the k nearest of all. Other columns are ignored.
    """
    rows = usable(vectors, vec_id, embedding)
    # One row per number of components; bounded by how long vectors are, not by how many.
    sizes = {r["dim"]: -(-r["count"] // SHARD_ROWS) for r in rows.groupBy("dim").count().collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = F.lit(1)
    for dim, n in sorted(sizes.items()):
        count = F.when(F.col("dim") == dim, F.lit(n)).otherwise(count)
    rows = rows.withColumn("shards", count)
    # The shard of a row follows from its id, so rows of one id meet and are told apart there.
    stored = rows.select("dim", F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"), F.lit(0).alias("asks"), "vec_id", "vec")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "dim", "shards")).alias("q"))
    asked = queries.select("vec_id", "q.*").select(
        "dim", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), F.lit(1).alias("asks"), "vec_id", "vec"
    )

    def search(batches):
        key, ids, held, shard, start = None, [], [], None, 0.0
        out: list[tuple[int, int, float]] = []

        def flush():
            q, v, s = zip(*out)
            return pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            dims, parts, asks, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "asks", "vec_id"))
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(dims)])
            for i in range(batch.num_rows):
                if (dims[i], parts[i]) != key:
                    key, ids, held, shard = (dims[i], parts[i]), [], [], None
                vector = flat[offsets[i] : offsets[i + 1]]
                if not asks[i]:
                    if not ids or ids[-1] != names[i]:  # sorted, so the smallest vector of an id comes first
                        ids.append(names[i])
                        held.append(vector.copy())
                    continue
                if not ids:
                    continue
                if shard is None:
                    shard = Shard(np.array(ids, np.int64), np.array(held))
                    start = shard.first_radius()
                out += [(names[i], v, d) for d, v in shard.search(vector, names[i], k, start)]
                if len(out) >= QUERY_BATCH * k:
                    yield flush()
                    out.clear()
        if out:
            yield flush()

    dealt = stored.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks", "vec_id", "vec")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
