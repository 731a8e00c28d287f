"""Settings that bound what a task holds in memory."""

import pyarrow.dataset as ds
from pyspark.sql import functions as F


def test_row_groups_of_long_texts_are_bounded(spark, tmp_path):
    """A task writes 40 MB of texts as several row groups, so it never holds them all."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1600)), lambda i: F.md5(F.concat_ws("-", "id", i))), "")
    spark.range(800).coalesce(1).select("id", text.alias("text")).write.parquet(str(tmp_path / "texts"))
    groups = [g for f in ds.dataset(str(tmp_path / "texts")).get_fragments() for g in f.row_groups]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 24 << 20
