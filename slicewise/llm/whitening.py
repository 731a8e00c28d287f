"""Whitening of embeddings by shifted Cholesky QR.

1. Entries become whole numbers, x = floor(scale * c) + offset; the fit list is each distinct x vector once.
   n and the sums S come from one aggregation, so centring (n * x - S) is exact.
2. Gram passes: every task adds up Q'Q of its rows (numpy, one batch at a time), partial sums
   meet in a tree of tasks, and the driver receives one d x d matrix per pass. Its Cholesky factor R_k (the
   first with a shift that keeps rounding from making the matrix indefinite) goes back to the tasks, where
   the centred rows are solved against R_1, R_2, ... in turn. Passes go on until Q'Q is the identity
   to rounding, at most `MAX_PASSES`.
3. R = ... R_2 R_1 is composed on the driver; its singular value decomposition (with the last
   Gram matrix, which differs from the identity only where the rows span fewer than d
   dimensions) gives the components and eigenvalues of the covariance.
4. A last pass measures the covariance of the whitened fit list against the identity.

Nothing but d x d numbers (d is the length of a vector) reaches the driver or
is sent to tasks; a task holds one batch and one such matrix. Copies of a vector are
removed map-side before the shuffle.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part; of vectors of
several lengths those of the commonest length (the shortest on ties) take part; null or
repeated ids are rows like any other; entries beyond 2^61 / scale are cut to that; `deviation` is null where it does not
fit a long; directions without variance (eigenvalue below `RANK` of the largest) are no
components, so one vector alone, or copies of one, give no rows; vectors of many thousand dimensions need
memory for d x d numbers per task and nothing else; an empty table gives an empty result; only the id and the
vector are read, so further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
MAX_PASSES = 5
#: Largest entry of Q'Q minus the identity at which the passes end.
ORTHOGONAL = 1e-13
#: Eigenvalues below this share of the largest are rounding.
RANK = 1e-20
_SLOTS = 32
_LIMIT = 1 << 61


@dataclass
class Whitening:
    """n, sums (exact, of x - offset), eigenvalues by falling size, components (d x k), the trace, and the measured error."""
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every entry, as array of long (the offset cancels wherever rows are centred)."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))))


def scorable(df: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return df.filter((F.size(v) > 0) & finite)


def _dims(rows: DataFrame) -> int | None:
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they hold it, else in Python's whole numbers."""
    if len(x) == 0:
        return np.zeros(x.shape)
    if max(int(x.max()), -int(x.min())) * n + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of the upper triangular r, column after column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(fit: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Q'Q of rows_of(x) over all rows: one partial sum per task, added up in a tree of tasks."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                q = rows_of(_matrix(batch.column("x")))
                total += q.T @ q
        slot = TaskContext.get().partitionId() % _SLOTS
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "gram"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(d * d), False
        for batch in batches:
            for v in batch.column("gram"):
                total, seen = total + np.frombuffer(v.as_buffer(), dtype=float), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "gram"])

    shape = "slot int, gram binary"
    sums = fit.mapInArrow(partial, shape).repartition("slot").mapInArrow(added, shape).repartition(1).mapInArrow(added, shape)
    got = sums.first()                                   # d x d numbers
    return np.frombuffer(got["gram"]).reshape(d, d).copy() if got else np.zeros((d, d))


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift; the shift grows until rounding no longer gets in the way."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).tiny)


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors `x` (array of long, one length) of `rows`; None without variance."""
    head = rows.groupBy().agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = head["n"], head["d"]
    if not n:
        return None
    sums = {r["pos"]: int(r["s"]) for r in (rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos")
                                             .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect())}   # d numbers
    sums = [sums[i] for i in range(d)]
    centre = lambda x: _centred(x, n, sums).astype(float) / n
    factors: list[np.ndarray] = []

    def rows_of(x: np.ndarray) -> np.ndarray:
        q = centre(x)
        for r in factors:
            q = _solved(q, r)
        return q

    first = gram = _gram(rows, rows_of, d)
    trace = float(np.trace(first)) / n
    if not trace > 0:
        return None
    unit, shift = np.finfo(float).eps / 2, 0.0
    for step in range(MAX_PASSES):
        if step and np.abs(gram - np.eye(d)).max() <= ORTHOGONAL:
            break
        # the shift that bounds rounding of a sum over n rows of d entries; later passes need it only where rows span less than d
        shift = 11 * (n * d + d * (d + 1)) * unit * np.linalg.norm(gram, 2) if not step else d * unit * np.linalg.norm(gram, 2)
        factors.append(_cholesky(gram, min(shift, np.linalg.norm(gram, 2))))
        gram = _gram(rows, rows_of, d)
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    # rows = Q R with Q'Q = gram, so the rows' Gram matrix is (gram^1/2 R)'(gram^1/2 R)
    e, v = np.linalg.eigh((gram + gram.T) / 2)
    _, s, vt = np.linalg.svd((v * np.sqrt(np.maximum(e, 0))).T @ r)
    eigen = s ** 2 / n
    k = min(k, int((eigen > RANK * eigen[0]).sum()))
    model = Whitening(n, sums, eigen[:k], vt[:k].T, trace)
    project = _projection(model)
    white = lambda x: centre(x) @ project
    model.identity_error = float(np.abs(_gram(rows, white, k) / n - np.eye(k)).max())
    return model


def _projection(model: Whitening) -> np.ndarray:
    return model.components / np.sqrt(model.eigenvalues)


def transform(rows: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """id, deviation, whitened (array of k doubles) of every row (id_col, x)."""
    n, sums, project = model.n, model.sums, _projection(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _centred(_matrix(batch.column("x")), n, sums)
            if far.dtype != object and float(np.abs(far).max()) ** 2 * far.shape[1] < 2.0 ** 62:
                deviation = (far * far).sum(axis=1).tolist()
            else:
                deviation = [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in far)]
            white = (far.astype(float) / n) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * project.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(deviation, pa.int64()), lists], [id_col, "deviation", "whitened"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(id, deviation, whitened array) of every scorable row, and the fitted model (None without variance: then no rows)."""
    scratch = Scratch(vectors.sparkSession)
    rows = scorable(vectors.select(F.col(id_col), F.col(vector_col).alias("_vector")), "_vector").select(id_col, whole(F.col("_vector")).alias("x"))
    d = _dims(rows)
    rows = rows.filter(F.size("x") == (d or 0))
    distinct = scratch.keep(rows.select("x").distinct(), "fit")
    model = fit(distinct, k)
    if model is None:
        kind = rows.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, deviation long, whitened array<double>"), None
    return transform(rows, model, id_col), model


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    n, share, error = (model.n, model.explained.tolist(), model.identity_error) if model else (0, [0.0], 0.0)
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
            .select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(F.array(*map(F.lit, share)), F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
