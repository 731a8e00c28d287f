"""Nearest rows by blocks: top-k candidates of vectors and questions that agree on keys.

One row per (question, vector) pair is what makes a search slow: all of them would be scored one by one and sorted
for their ranks. Here each task packs its rows into blocks (rows of one key, their vectors as one matrix),
Spark joins blocks with blocks on the key (broadcasting the questions while they are small), and
a task scores a pair of blocks by matrix products. A block gives at most k rows per question, so what is
ranked afterwards are k rows per question and block.

Products only choose candidates: all whose approximate distance is within the rounding error of the kth. Candidates
get the distance of `retrieval.squared_l2`, summed from differences in the vector's order, so the numbers and their ties
are the same as those of a scan row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20                 # a block's matrix
BLOCK_ROWS = 4096
QUESTION_ROWS = 512                   # questions in a block
HELD_BYTES = 32 << 20                 # what a task holds of blocks that are not full
PAIRS = 1 << 19                       # distances worked out at a time
ROWS_PER_YIELD = 1 << 13

#: (rows of a block of vectors, rows of a block of questions) -> (first question, after the last) -> which pairs count
Rule = Callable[[pa.StructArray, pa.StructArray], Callable[[int, int], np.ndarray]]


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dims)


def _packing(keys: list[str], block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}                                    # key -> its columns, rows, matrices, number of rows
        bytes_held = 0

        def block(key):
            columns, rows, parts, _ = held.pop(key)
            values, x = pa.concat_arrays(rows), np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.array([x.tobytes()], pa.binary())],
                [*keys, "rows", "matrix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.select(keys).to_pandas().groupby(keys, sort=False).indices
            for key, at in places.items():
                columns = [batch.column(c).take(pa.array(at[:1])) for c in keys]
                dims = columns[-1][0].as_py()
                limit = max(1, min(block_rows, BLOCK_BYTES // (8 * dims + 1)))
                for a in range(0, len(at), limit):
                    mine = pa.array(at[a:a + limit])
                    x = _matrix(batch.column("vector").take(mine), dims)
                    if key in held and held[key][3] + len(x) > limit:
                        bytes_held -= sum(p.nbytes for p in held[key][2])
                        yield block(key)
                    entry = held.setdefault(key, [columns, [], [], 0])
                    entry[1].append(batch.column("rows").take(mine))
                    entry[2].append(x)
                    entry[3] += len(x)
                    bytes_held += x.nbytes
            if bytes_held > HELD_BYTES:
                for key in list(held):
                    yield block(key)
                bytes_held = 0
        for key in list(held):
            yield block(key)
    return run


def _packed(df: DataFrame, keys: list[str], vector_col: str, block_rows: int, side: str) -> DataFrame:
    """Blocks of `df`: its keys and the vectors' length, the other columns as `rows`, the vectors as `matrix`."""
    others = [c for c in df.columns if c != vector_col]
    names = [f"k{i}" for i in range(len(keys))] + ["dims"]
    named = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.size(vector_col).alias("dims"),
                      F.struct(*others).alias("rows"), F.col(vector_col).alias("vector"))
    for name in names[:-1]:
        named = named.filter(F.col(name).isNotNull())
    schema = T.StructType([*[named.schema[n] for n in names], T.StructField("rows", T.ArrayType(named.schema["rows"].dataType)),
                           T.StructField("matrix", T.BinaryType())])
    named = named.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    blocks = named.mapInArrow(_packing(names, block_rows), schema)
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns])


def nearest_pairs(v: np.ndarray, q: np.ndarray, k: np.ndarray, order: np.ndarray,
                  counts: Callable[[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, vector, squared distance) of the k[question] nearest rows of v, by distance and `order`."""
    n, dims = v.shape
    step, columns = max(1, PAIRS // max(1, n)), np.ascontiguousarray(v.T)
    out = []
    with np.errstate(all="ignore"):
        vv = (v * v).sum(axis=1)
        largest = vv[np.isfinite(vv)].max(initial=0.0)
        for a in range(0, len(q), step):
            mine, most = q[a:a + step], int(k[a:a + step].max(initial=0))
            qq = (mine * mine).sum(axis=1)
            allowed = counts(a, a + len(mine)) if counts else np.ones((len(mine), n), dtype=bool)
            if most < n:
                rough = vv[None, :] + qq[:, None] - 2.0 * (mine @ v.T)
                unknown = ~np.isfinite(rough)              # decided by the exact distance alone
                rough[unknown | ~allowed] = np.inf
                error = 32.0 * (dims + 8) * np.finfo(np.float64).eps * (largest + qq)
                kth = np.partition(rough, most - 1, axis=1)[:, most - 1] if most else np.full(len(mine), -np.inf)
                near = allowed & (unknown | (rough <= (kth + error)[:, None]))
            else:
                near = allowed
            i, j = np.nonzero(near)
            for b in _cuts(i, PAIRS):
                out.append(_ranked(i[b], j[b], columns, mine, k[a:a + step], order, a))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = (np.concatenate(x) for x in zip(*out))
    return i, j, d


def _cuts(i: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of about `size` pairs that keep a question's pairs together."""
    start = 0
    while start < len(i):
        end = min(len(i), start + size)
        end = int(np.searchsorted(i, i[end - 1], side="right"))
        yield slice(start, end)
        start = end


def _ranked(i, j, columns, q, k, order, first):
    d = np.zeros(len(i))
    for c in range(len(columns)):
        diff = columns[c][j] - q[i, c]
        d += diff * diff
    by = np.lexsort((order[j], d, i))
    i, j, d = i[by], j[by], d[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k[i]
    return i[keep] + first, j[keep], d[keep]


def _scoring(k_col: str, ties: list[str], rule: Rule | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def result():
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held)], ["q", "v", "distance"])

        for batch in batches:
            # one block of vectors comes once for every block of questions
            for at in range(batch.num_rows):
                dims = batch.column("v_dims")[at].as_py()
                v_rows, q_rows = batch.column("v_rows")[at].values, batch.column("q_rows")[at].values
                v = np.frombuffer(batch.column("v_matrix")[at].as_buffer(), dtype=np.float64).reshape(len(v_rows), dims)
                q = np.frombuffer(batch.column("q_matrix")[at].as_buffer(), dtype=np.float64).reshape(len(q_rows), dims)
                k = q_rows.field(k_col).to_numpy(zero_copy_only=False).astype(np.int64)
                table = pa.table({c: v_rows.field(c) for c in ties})
                places = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ties], null_placement="at_start").to_numpy()
                order = np.empty(len(places), dtype=np.int64)
                order[places] = np.arange(len(places))
                i, j, d = nearest_pairs(v, q, k, order, rule(v_rows, q_rows) if rule else None)
                if len(i):
                    held.append((q_rows.take(pa.array(i)), v_rows.take(pa.array(j)), pa.array(d)))
                    size += len(i)
                if size >= ROWS_PER_YIELD:
                    yield result()
                    held, size = [], 0
        if held:
            yield result()
    return run


def nearest(vectors: DataFrame, queries: DataFrame, on: list[tuple[str, str]], k: str, ties: list[str], vector_col: str = "embedding",
            query_vector_col: str = "query_vector", rule: Rule | None = None) -> DataFrame:
    """Of every two blocks that agree on the keys `on` (column of `vectors`, column of `queries`): the nearest pairs.

    Every question's k (its column `k`) nearest rows, by distance and the columns `ties` of `vectors`, are among the
    result, of each pair of blocks at most k. Vectors of another length than the question's, null ones and ones
    with a null component take no part, nor do null keys and questions whose k is null.
    rule: which pairs count. The two sides' column names must differ.
    Output: the columns of both sides but the vectors, and `distance` (squared).
    """
    asked = queries.filter(F.col(k) > 0)
    v = _packed(vectors, [a for a, _ in on], vector_col, BLOCK_ROWS, "v")
    q = _packed(asked, [b for _, b in on], query_vector_col, QUESTION_ROWS, "q")
    same = F.col("v_dims") == F.col("q_dims")
    for i in range(len(on)):
        same = same & (F.col(f"v_k{i}") == F.col(f"q_k{i}"))
    joined = v.join(q, same).select("v_dims", "v_rows", "v_matrix", "q_rows", "q_matrix")
    q_rows, v_rows = (joined.schema[c].dataType.elementType for c in ("q_rows", "v_rows"))
    schema = T.StructType([T.StructField("q", q_rows), T.StructField("v", v_rows), T.StructField("distance", T.DoubleType())])
    return joined.mapInArrow(_scoring(k, ties, rule), schema).select("q.*", "v.*", "distance")


try:  # shipped by value, as the merge walk, so executors need not have the package installed
    from pyspark import cloudpickle as _cp
    import sys as _sys
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass
