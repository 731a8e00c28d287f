"""Spark session helpers.

On a cluster the session is created by the platform; `get_session` only fills
in settings that are unset. Lineage is cut with `checkpoint()` into the shared
folder named by `spark.checkpoint.dir`; a local folder is chosen only when the
setting is missing (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts are long: batches by rows alone would take much memory in the Python workers
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # and so do batches of the Parquet reader in the JVM
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.session.timeZone": "UTC",
    # JSON replies from models may repeat a key; the last one wins (as in Python's json).
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# a Parquet writer holds a row group in memory; Parquet's own default is 128 MB for each task
_ROW_GROUP = ("parquet.block.size", str(16 << 20))


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "slicewise") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("SLICEWISE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill in engine defaults that the session leaves unset."""
    given = spark.conf.getAll
    for key, value in _DEFAULTS.items():
        if key not in given and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    if _ROW_GROUP[0] not in given and spark.sparkContext._jsc.hadoopConfiguration().get(_ROW_GROUP[0]) is None:
        spark.conf.set(*_ROW_GROUP)
    # Python workers look for this package where the driver found it (on a cluster: also ship it with --py-files)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local one only when none is configured."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            # a machine-local folder would not survive the loss of an executor
            raise ValueError("spark.checkpoint.dir must name a shared folder (e.g. on the cluster's "
                             "distributed file system) for materialised tables and stream state")
        current = tempfile.mkdtemp(prefix="slicewise-ckpt-")   # local mode only (tests, laptops)
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


_MATERIALISED: list[str] = []


def cut_lineage(df: DataFrame, eager: bool = True, owner: list[str] | None = None) -> DataFrame:
    """Materialise `df` as a Parquet table in the shared checkpoint folder and read it back.

    One computation (RDD checkpointing without persist computes the plan twice),
    columnar and compressed, and on shared storage, so it survives the loss of
    any executor. Never a local checkpoint. owner: the list that the table's path is
    noted in (by default the process's), for `release_tables`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/slicewise-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    (_MATERIALISED if owner is None else owner).append(path)
    return spark.read.parquet(path)


def note_table(path: str) -> str:
    """Note a table written elsewhere for `release_tables`."""
    _MATERIALISED.append(path)
    return path


def release_tables(spark: SparkSession, owner: list[str] | None = None) -> int:
    """Delete the tables noted in `owner` (by default those noted for the process); call once their results are consumed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths, n = _MATERIALISED if owner is None else owner, 0
    while paths:
        p = jvm.org.apache.hadoop.fs.Path(paths.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            n += 1
    return n
