"""Layout of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables above this size (bytes, as Spark estimates the scan) are never dealt anew.
SPREAD_BYTES = 1 << 30


def scan_bytes(df: DataFrame) -> int:
    """Spark's size estimate of the plan; file sizes for a scan, so nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition a small `df` by `keys` when its scan yields fewer splits than there are cores.

    Per-document work (splitting, merging, tokenising) is CPU-heavy per byte; a
    corpus of a few row groups would run on a few cores. Only inputs below
    SPREAD_BYTES are dealt anew, however many cores the cluster has: a large corpus keeps
    its splits and is never shuffled. The rows are the same either way.
    """
    if scan_bytes(df) >= SPREAD_BYTES:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= target else df.repartition(target, *keys)
