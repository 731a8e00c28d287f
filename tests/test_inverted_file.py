"""The stored inverted file: exact answers with skipping, appends that rewrite nothing, recall, odd rows."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.operators.retrieval import knn
from slicewise.sources import inverted_file as ivf

DIMS = 6
SCHEMA = "collection string, chunk_id long, chunk_index long, note string, embedding array<float>"


def _rows(seed, n, first=0):
    """Vectors around 12 centres, a third of all in one place and every tenth a copy of another; 'a' holds most rows."""
    r = np.random.RandomState(seed)
    centres = r.uniform(-10, 10, (12, DIMS))
    out = []
    for i in range(n):
        c = 0 if i % 3 == 0 else i % 12
        v = [float(x) for x in (centres[c] + r.normal(0, 0.3, DIMS)).astype("float32")]
        if i % 10 == 9:
            v = out[-1][4]
        out.append(("a" if i % 4 else "b", first + i, first + i, "x", v))
    return out


ODD = [("a", 9001, 9001, "x", None), ("a", 9002, 9002, "x", [1.0] * (DIMS - 1)), ("a", 9003, 9003, "x", [None] + [1.0] * (DIMS - 1)),
       ("a", 9004, 9004, "x", [float("nan")] * DIMS), ("a", 9005, 9005, "x", [float("inf")] * DIMS), ("c", 9006, 9006, None, [0.5] * DIMS)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    rows = _rows(1, 1200)
    ivf.build(spark.createDataFrame(rows + ODD, SCHEMA), path, DIMS, cells=12)
    return path, rows + [ODD[-1]]


def _queries(spark, rows):
    asked = [(r[1], r[0], r[4]) for r in rows if r[1] % 50 == 0]
    asked += [(-1, "a", [100.0] * DIMS), (-2, "c", [0.0] * DIMS), (-3, "nowhere", [0.0] * DIMS), (-4, "a", None), (-5, "a", [float("nan")] * DIMS)]
    return spark.createDataFrame(asked, "query_id long, collection string, query_vector array<float>")


def _scan(spark, rows, queries, k):
    usable = queries.filter(F.col("query_id") > -4)
    return {tuple(r) for r in knn(usable, spark.createDataFrame(rows, SCHEMA), k, dims=DIMS)
            .select("query_id", "chunk_id", "rank", "distance").collect()}


def _found(hits):
    return {tuple(r) for r in hits.select("query_id", "chunk_id", "rank", "distance").collect()}


def test_exact_search_equals_a_scan(spark, index):
    path, rows = index
    q = _queries(spark, rows)
    for k in (1, 8, 2000):                                          # 2000: more than any collection holds
        assert _found(ivf.search(spark, path, q, k, DIMS, exact=True)) == _scan(spark, rows, q, k)


def test_cells_out_of_reach_are_skipped(spark, index):
    path, rows = index
    q = _queries(spark, rows).filter("query_id >= 0")
    plan = ivf._probes(spark, path, q, ivf.quantiser(spark, path))
    first = ivf._top(ivf._scored(plan.filter(ivf._near(1, 8)), ivf._vectors(spark, path), DIMS), 8)
    left = ivf.remaining_probes(plan, first, ivf._near(1, 8), 8)
    assert left.count() < 0.3 * plan.filter(~ivf._near(1, 8)).count()


def test_recall_after_calibration(spark, index):
    path, rows = index
    q = _queries(spark, rows).filter("query_id >= 0")
    probes = ivf.calibrate(spark, path, 8, DIMS)
    assert 1 <= probes <= 12
    truth = {(a, b) for a, b, _, _ in _scan(spark, rows, q, 8)}
    got = {(a, b) for a, b, _, _ in _found(ivf.search(spark, path, q, 8, DIMS))}
    assert len(got) == len(truth) and len(got & truth) >= 0.9 * len(truth)
    # one probe, but the search goes on until it has k rows
    assert ivf.search(spark, path, q.limit(5), 600, DIMS, probes=1).filter("collection = 'a'").groupBy("query_id").count().filter("count < 600").count() == 0


def test_append_rewrites_nothing_and_a_lost_append_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    old, new = _rows(2, 300), _rows(3, 200, first=5000)
    ivf.build(spark.createDataFrame(old, SCHEMA), path, DIMS)
    before = set(glob.glob(f"{path}/vectors/**/*.parquet", recursive=True))
    # an append that died after writing its cells' figures
    ghost = spark.createDataFrame([("a", 0, 50, 99.0), ("b", 1, 7, 99.0)], "collection string, cell int, n long, radius double")
    ghost.write.mode("append").parquet(f"{path}/cells")
    q = _queries(spark, old)
    assert _found(ivf.search(spark, path, q, 8, DIMS, exact=True)) == _scan(spark, old, q, 8)
    ivf.append(spark.createDataFrame(new, SCHEMA), path, DIMS)
    assert before < set(glob.glob(f"{path}/vectors/**/*.parquet", recursive=True))
    q = _queries(spark, old + new)
    assert _found(ivf.search(spark, path, q, 8, DIMS, exact=True)) == _scan(spark, old + new, q, 8)


def test_empty_index_and_clashing_columns(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    ivf.build(empty, str(tmp_path / "e"), DIMS)
    for exact in (True, False):
        assert ivf.search(spark, str(tmp_path / "e"), _queries(spark, _rows(1, 60)), 3, DIMS, exact=exact).count() == 0
    with pytest.raises(ValueError):
        ivf.build(empty.withColumn("cell", F.lit(1)), str(tmp_path / "f"), DIMS)


def test_probes_prune_cell_folders(spark, index):
    path, rows = index
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = ivf.search(spark, path, _queries(spark, rows).limit(1), 3, DIMS, probes=1)
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "dynamicpruning" in plan.lower() and "WindowGroupLimit" in plan and "CartesianProduct" not in plan
