"""Dense positional index without a single-task window.

`row_number() over (order by x)` with no partition moves every row into one
task. `dense_index` numbers rows 0..n-1 within `partition_cols` by `order_col`
in bounded steps: quantiles of the order values (one pass over that column) cut them
into up to `BUCKETS` buckets of about equal numbers of rows; bucket counts, summed
map-side, give each bucket its offset (a running sum over at most `BUCKETS` rows per
partition value); rows are then numbered inside their bucket. However large one
partition value is and however sparse its order values are, no window holds more than
about 1/`BUCKETS` of all rows (rows of one order value stay together).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def dense_index(df: DataFrame, partition_cols: list[str], order_col: str, out_col: str = "index",
                orders: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """orders: a cheaper frame with the same order values (the raw rows, say) to take the quantiles from."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = (orders if orders is not None else df).agg(F.percentile_approx(order_col, shares, F.lit(10 * buckets))).first()[0]
    cuts = sorted(set(cuts or []))                        # at most BUCKETS numbers
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order_col))) if cuts else F.lit(0)
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*partition_cols, "_bucket").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*partition_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*partition_cols, "_bucket").orderBy(order_col)
    return (keyed.join(offsets, [*partition_cols, "_bucket"])
            .withColumn(out_col, (F.col("_offset") + F.row_number().over(inner) - 1).cast("long"))
            .drop("_bucket", "_offset"))
