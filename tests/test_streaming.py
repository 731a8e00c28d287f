"""Incremental indexing over a file stream: every document indexed once, replays write nothing twice."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from slicewise.plans import catalog
from slicewise.sources.tables import SHIPPED_STRATEGIES, STRATEGY_SCHEMA
from slicewise.streaming import incremental_index


def test_incremental_index(spark):
    src = tempfile.mkdtemp(prefix="slicewise-stream-src-")
    shutil.copy(f"{SMALL}/documents.parquet", os.path.join(src, "part-0.parquet"))
    index_path = os.path.join(tempfile.mkdtemp(prefix="slicewise-index-"), "index")
    resolved, _ = catalog.resolved_experiments(spark, SMALL)
    pairs = resolved.filter(F.col("method") != "outside").select(
        "collection", "file_type", "chunking_strategy", "method", "chunk_size", "chunk_overlap",
        "separators").distinct()
    rows = [dict(zip(STRATEGY_SCHEMA.fieldNames(), r)) for r in SHIPPED_STRATEGIES]
    q = incremental_index.start(spark, src, pairs, rows, index_path)
    q.awaitTermination(600)
    got = {r.collection: r.n for r in spark.read.parquet(index_path).groupBy("collection")
           .agg(F.count("*").alias("n")).collect()}
    want = {r.collection: r.n for r in catalog.collection_chunks(spark, SMALL).groupBy("collection")
            .agg(F.count("*").alias("n")).collect()}
    assert got == want
    # the same documents again: already indexed, nothing is added
    incremental_index.index_batch(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), pairs, rows,
                                  index_path, 99)
    again = spark.read.parquet(index_path)
    assert again.count() == sum(want.values())
    assert again.filter(F.col("version") == 99).count() == 0


def test_incremental_versioned_index(spark, tmp_path):
    """Two arrivals: each adds files and rewrites none; a replay of the second adds nothing."""
    from slicewise.sources import versioned_index
    src, index_path = tmp_path / "src", str(tmp_path / "index")
    src.mkdir()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id")
    resolved, _ = catalog.resolved_experiments(spark, SMALL)
    pairs = resolved.filter(F.col("method") != "outside").select(
        "collection", "file_type", "chunking_strategy", "method", "chunk_size", "chunk_overlap", "separators").distinct()
    rows = [dict(zip(STRATEGY_SCHEMA.fieldNames(), r)) for r in SHIPPED_STRATEGIES]
    half = docs.approxQuantile("doc_id", [0.5], 0.0)[0]
    seen: dict = {}
    for i, part in enumerate([docs.filter(F.col("doc_id") <= half), docs.filter(F.col("doc_id") > half)]):
        part.toPandas().to_parquet(src / f"part-{i}.parquet")
        incremental_index.start(spark, str(src), pairs, rows, index_path, versioned=True).awaitTermination(600)
        files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "index" / "deltas").rglob("*.parquet")}
        assert seen.items() <= files.items() and len(files) > len(seen)
        seen = files
    incremental_index.index_batch(spark, docs.filter(F.col("doc_id") > half), pairs, rows, index_path, 1, versioned=True)
    got = versioned_index.read(spark, index_path).groupBy("collection").agg(F.count("*").alias("n"))
    want = catalog.collection_chunks(spark, SMALL).groupBy("collection").agg(F.count("*").alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())
