"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.session import checkpoint_dir

# The word classes of the query contracts.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, _UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_scan(docs: DataFrame) -> bool:
    """Whether `docs` are rows of files as they stand there, at most filtered or with other columns."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and len(docs.inputFiles()) > 0


def located(scratch: Scratch, docs: DataFrame, *columns: str) -> DataFrame:
    """`row` (all columns of `docs` as one struct, so none clashes), `place`, and the named columns.

    place names the row by its file and its number there, alike in every scan; rows that come from
    no file are stored first.
    """
    if not _is_scan(docs):
        docs = scratch.keep(docs, "rows")
    inside = docs.metadataColumn("_metadata")
    place = F.struct(F.xxhash64(inside["file_path"]).alias("file"), F.xxhash64(inside["file_path"], F.lit(1)).alias("file2"), inside["row_index"].alias("at"))
    return docs.select(F.struct(*docs.columns).alias("row"), place.alias("place"), *columns)


class Scratch:
    """Tables of one operator run, as Parquet in the shared checkpoint folder.

    `keep` cuts lineage: the rows are computed once, survive lost executors and
    give every later reader the same rows (so ids from
    `monotonically_increasing_id` are stable once kept). `drop` deletes a table
    that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        self._made: list[str] = []
        self._alive: list[DataFrame] = []

    def path(self, name: str) -> str:
        self._n += 1
        self._made.append(f"{self.base}/{self._n:03d}-{name}")
        return self._made[-1]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._alive.append(out)
        return out

    def stored(self, df: DataFrame) -> list[DataFrame]:
        """The tables of this run that `df` reads by its plan."""
        files = df.inputFiles()
        return [x for x in self._alive if (p := self._paths.get(id(x))) and any(p[p.rindex("/llm/"):] in f for f in files)]

    def only(self, *frames: DataFrame) -> None:
        """Delete every table of this run but those of `frames`, streaming state and other paths included."""
        kept = {self._paths[id(df)] for df in frames}
        for path in [p for p in self._made if p not in kept]:
            self.delete(path)
            self._made.remove(path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                self._made.remove(path)
                self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
