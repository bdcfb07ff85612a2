"""Whitening of embeddings by shifted Cholesky QR.

The Gram matrix of the centred rows is summed over all tasks, its shifted Cholesky factor R makes the
rows nearly orthogonal through a triangular solve, and the next passes do so again with what is left.
The factors are composed, and the singular values of the composed R give the components.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedbackmill.session import stage

#: What entries are rounded to, and what is added so that they count from zero on.
SCALE, OFFSET = 64, 1_000_000
#: Factors at most; three do, a shifted one and two more, unless the rows are deficient in rank.
PASSES = 6
#: No more factors are needed when no entry of the Gram matrix is farther from the identity.
CLOSE = 1e-12
_ROWS = 4096
_WIDE = 1 << 62


def _exact(values: np.ndarray, factor: int) -> np.ndarray:
    """``values`` as Python integers if ``factor`` times the largest doesn't fit 64 bits."""
    top = int(np.abs(values).max(initial=0))
    return values.astype(object) if top * factor >= _WIDE else values


def _batches(batches, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded rows, with their x-vectors as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding."""
    x = _exact(x, 2 * n)
    return x * n - np.array(sums, dtype=x.dtype)


def solve_upper(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = rows, for an upper triangular R: one column after the other."""
    q = np.empty_like(rows)
    for j in range(rows.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def cholesky_factor(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """The upper triangular R with R'R = gram, or = gram plus a shift of its diagonal.

    The shift is the usual bound of the rounding errors of ``rows`` rows. It is added if asked for,
    or if there is no R without it, and grows until there is one.
    """
    dims = len(gram)
    top = max(float(np.abs(np.linalg.eigvalsh(gram)).max()), np.finfo(float).tiny * 1e30)
    step = 11 * (rows * dims + dims * (dims + 1)) * np.finfo(float).eps / 2 * top
    shift = step if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(dims)).T
        except np.linalg.LinAlgError:
            shift = max(step, shift * 16)


def _added(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray], values: Callable, width: int) -> np.ndarray:
    """The sum over all rows of ``function``, a matrix of ``width`` columns per slice of rows.

    Each task gives its sum row by row; rows of one number meet in a second step, so what reaches
    the driver is one matrix, whatever the number of tasks.
    """
    schema = "row int, sums array<double>"

    def table(total: dict[int, np.ndarray]):
        flat = np.concatenate([*total.values(), np.zeros(0)])
        edges = pa.array(np.arange(len(total) + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_pydict({
            "row": pa.array(list(total), pa.int32()), "sums": pa.ListArray.from_arrays(edges, pa.array(flat)),
        })

    def partial(batches):
        total = None
        for part in values(batches):
            made = function(part)
            total = made if total is None else total + made
        if total is not None:
            yield table(dict(enumerate(total)))

    def finish(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                parts = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for row, part in zip(batch.column("row").to_pylist(), parts, strict=True):
                    total[row] = total[row] + part if row in total else part.copy()
        yield table(total)

    sums = rows.mapInArrow(partial, schema).repartition("row").mapInArrow(finish, schema).collect()
    out = np.zeros((len(sums), width))
    for row in sums:
        out[row["row"]] = row["sums"]
    return out


def _x_vectors(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id and x of the vectors that take part, staged, and their number of components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))

    def fits(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 56)))

    rows = rows.where(F.col("_v").isNotNull()).where(F.forall("_v", fits))
    sizes = rows.groupBy(F.size("_v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    x = F.transform("_v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return stage(rows.where(F.size("_v") == dims).select("vec_id", x.alias("x")), "x-vectors"), dims


def whiten(vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector that takes part and component: see the columns below.

    An entry c counts as x = floor(64 * c) + 1000000. ``n`` vectors have the sums S per dimension.
    vec_id, component (from 1, by falling eigenvalue), n, deviation (sum of (n * x - S)^2, exact;
    null beyond a long), whitened (x - S / n on the component, over the root of its eigenvalue),
    explained (eigenvalue by the trace of the covariance), identity_error (largest absolute entry of
    the whitened columns' covariance minus the identity, measured over all rows).

    Null vectors and those with null or non-finite entries, or entries of 2^56 or more, take no part,
    nor do vectors with another number of entries than most have (of ties, the larger number).
    Components without variance, as of constant dimensions or too few vectors, are left out. Of
    either sign a component has the one that makes its largest entry positive. Repeated rows and null ids
    count as any other row; other columns are ignored; no vectors give no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = _x_vectors(vectors, vec_id, vector)
    n = rows.count() if dims else 0
    if not n:
        return spark.createDataFrame([], schema)
    places = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in places.orderBy("at").collect()]

    def centred(batches):
        for _, x in _batches(batches, dims):
            yield (_deviations(x, n, sums) / n).astype(float)

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def product(part):
            for r in factors:
                part = solve_upper(part, r)
            return part.T @ part

        return _added(rows, product, centred, dims)

    factors, left = [], gram([])
    while len(factors) < PASSES and not (factors and np.abs(left - np.eye(dims)).max() <= CLOSE):
        factors = [*factors, cholesky_factor(left, n, shifted=not factors)]
        left = gram(factors)
    base, directions = _components(factors, left, n)
    keep = min(components, len(base))
    if not keep:
        return spark.createDataFrame([], schema)
    trace = float(base.sum())
    scaled = directions[:keep].T / np.sqrt(base[:keep])

    def project(batches):
        for batch, x in _batches(batches, dims):
            away = _deviations(x, n, sums)
            wide = _exact(away, dims * int(np.abs(away).max(initial=0)))
            squares = [int(s) for s in (wide * wide).sum(1)]
            white = (away / n).astype(float) @ scaled
            edges = pa.array(np.arange(len(white) + 1, dtype=np.int32) * keep)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"),
                "deviation": pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()),
                "white": pa.ListArray.from_arrays(edges, pa.array(white.ravel())),
            })

    whitened = stage(rows.mapInArrow(project, "vec_id long, deviation long, white array<double>"), "whitened")

    def white(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.column("white").flatten().to_numpy(zero_copy_only=False).reshape(-1, keep)

    mean = _added(whitened, lambda part: part.sum(0, keepdims=True), white, keep)[0] / n
    covariance = _added(whitened, lambda part: (part - mean).T @ (part - mean), white, keep) / n
    error = float(np.abs(covariance - np.eye(keep)).max())
    shares = F.array(*(F.lit(float(e / trace)) for e in base[:keep]))
    return whitened.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _components(factors: list[np.ndarray], gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit eigenvectors as rows.

    ``gram`` is that of the rows after all ``factors``: the identity but for rounding, and for
    directions without variance. Its root goes in front of the composed R.
    """
    values, vectors = np.linalg.eigh(gram)
    composed = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for r in reversed(factors):
        composed = composed @ r
    _, singular, directions = np.linalg.svd(composed)
    real = singular > singular.max(initial=0) * len(gram) * np.finfo(float).eps * 8
    directions = directions[: len(singular)][real]
    largest = np.abs(directions).argmax(1)
    directions = directions * np.sign(directions[np.arange(len(directions)), largest])[:, None]
    return singular[real] ** 2 / n, directions
