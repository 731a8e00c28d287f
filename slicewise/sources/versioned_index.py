"""A chunk-vector index of immutable files (S8, S9): an upsert writes its own rows only.

Below one path stand Parquet folders `deltas/delta=<id>/collection=<name>` and small JSON files
`snapshots/<number>.json`. A snapshot names its deltas, each with the number of the snapshot that added it, and
collections cleared. A change writes its files first and then takes the next number by
a rename that fails where the number is taken (then it is tried on the newer snapshot); a job that dies before
leaves files that nothing names. Older snapshots stay readable until `vacuum`. The rename must be atomic, as on HDFS;
on a file system without that one writer at a time is allowed.

Merge on read: only keys that stand in a later delta than the first are compared, on narrow columns; the rows that lose
are taken out by an anti-join, so texts and vectors are not shuffled while these are few. `compact`
writes the merged rows as one delta, which is read without a comparison.

Newest version wins, of equal versions the later upsert; a null version is older than any. Rows without vector, collection name
or chunk_id are rejected. Of rows with one key in one upsert the largest stands (version, then the other columns in order).
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["collection", "chunk_id"]
RESERVED = ["delta", "_seq"]
ATTEMPTS = 20                           # commits tried against other writers


class Conflict(RuntimeError):
    """Other writers changed what this change rests on."""


# --------------------------------------------------------------------------- snapshots
def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(hpath)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored snapshots."""
    fs, folder = _fs(spark, f"{path}/snapshots")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, path: str, snapshot: int | None = None) -> dict:
    """What a snapshot (the last one) holds; an index never written has number 0."""
    if snapshot is None:
        snapshot = max(snapshots(spark, path), default=0)
        if not snapshot:
            return {"snapshot": 0, "schema": None, "deltas": {}, "cleared": {}, "batches": {}}
    fs, file = _fs(spark, f"{path}/snapshots/{snapshot:012d}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, new: dict) -> bool:
    """Store `new` under its number; False where the number is taken."""
    fs, target = _fs(spark, f"{path}/snapshots/{new['snapshot']:012d}.json")
    _, written = _fs(spark, f"{path}/snapshots/_{uuid.uuid4().hex}")
    stream = fs.create(written, False)
    stream.write(bytearray(json.dumps(new).encode()))
    stream.close()
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    plain = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)          # no overwriting
    try:
        hadoop.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(written, target, plain)
        return True
    except Py4JJavaError as e:
        fs.delete(written, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise


def _change(spark: SparkSession, path: str, step: Callable[[dict], dict | None]) -> int:
    """Apply `step` to the last snapshot and store the next; None changes nothing. Returns the number."""
    for _ in range(ATTEMPTS):
        old = state(spark, path)
        new = step(json.loads(json.dumps(old)) | {"snapshot": old["snapshot"] + 1})
        if new is None:
            return old["snapshot"]
        if _publish(spark, path, new):
            return new["snapshot"]
    raise Conflict(f"{path}: {ATTEMPTS} commits were overtaken")


# --------------------------------------------------------------------------- changes
def _merged_schema(old: str | None, new: T.StructType) -> str:
    fields = {f["name"]: f for f in json.loads(old)["fields"]} if old else {}
    for f in new.fields:
        mine = json.loads(T.StructField(f.name, f.dataType, True).json())
        if fields.setdefault(f.name, mine)["type"] != mine["type"]:
            raise ValueError(f"column {f.name} is stored as {fields[f.name]['type']}, not {mine['type']}")
    return json.dumps({"type": "struct", "fields": list(fields.values())})


def _write(rows: DataFrame, path: str) -> str:
    name = uuid.uuid4().hex
    rows.write.partitionBy("collection").parquet(f"{path}/deltas/delta={name}")
    return name


def upsert(spark: SparkSession, path: str, new: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
    """Add a delta with the rows of `new` (collection, chunk_id, version, embedding, ...).

    Returns the rejected rows (computed when they are read). batch: (stream, number) of a micro-batch; one that is
    not above the stream's last number was committed before and is skipped, so a replay adds nothing. (A stream that starts
    anew counts from 0 again: give it another name, such as its query id.)
    """
    clash = [c for c in RESERVED if c in new.columns]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    before = state(spark, path)
    usable = F.col("embedding").isNotNull() & F.col("chunk_id").isNotNull() & (F.coalesce(F.col("collection"), F.lit("")) != "")
    rejected = new.filter(~usable)
    if batch and before["batches"].get(batch[0], -1) >= batch[1]:
        return rejected
    _merged_schema(before["schema"], new.schema)                     # fails before anything is written
    others = [c for c in new.columns if c not in (*KEY, "version")]
    one = new.filter(usable).groupBy(*KEY).agg(F.max(F.struct("version", *others)).alias("_row"))
    name = _write(one.select(*KEY, "_row.*"), path)

    def step(s: dict) -> dict | None:
        if batch:
            if s["batches"].get(batch[0], -1) >= batch[1]:
                return None
            s["batches"][batch[0]] = batch[1]
        s["schema"] = _merged_schema(s["schema"], new.schema)
        s["deltas"][name] = s["snapshot"]
        return s
    _change(spark, path, step)
    return rejected


def clear(spark: SparkSession, path: str, collection: str) -> int:
    """Empty a collection. No file is touched; later upserts fill it again."""
    return _change(spark, path, lambda s: s | {"cleared": s["cleared"] | {collection: s["snapshot"]}})


def compact(spark: SparkSession, path: str) -> int:
    """Write the merged rows as one delta. Upserts and clears that commit meanwhile stay on top of it."""
    base = state(spark, path)
    rows = read(spark, path, base["snapshot"]) if base["deltas"] else None
    if rows is None or (len(base["deltas"]) == 1 and not base["cleared"]):
        return base["snapshot"]
    name, seq = _write(rows, path), max(base["deltas"].values())

    def step(s: dict) -> dict:
        if any(s["deltas"].get(d) != n for d, n in base["deltas"].items()):
            raise Conflict(f"{path}: compacted by another writer")
        s["deltas"] = {name: seq} | {d: n for d, n in s["deltas"].items() if d not in base["deltas"]}
        s["cleared"] = {c: n for c, n in s["cleared"].items() if base["cleared"].get(c) != n}
        return s
    return _change(spark, path, step)


def vacuum(spark: SparkSession, path: str, keep: int = 1, older_than_s: float = 86400.0) -> int:
    """Delete all but the last `keep` snapshots, and deltas that none of these names.

    Deltas younger than older_than_s stay: their writer may not have committed yet. Returns the number of deltas deleted.
    """
    numbers = snapshots(spark, path)
    named = {d for n in numbers[-keep:] for d in state(spark, path, n)["deltas"]}
    for n in numbers[:-keep]:
        fs, file = _fs(spark, f"{path}/snapshots/{n:012d}.json")
        fs.delete(file, False)
    fs, folder = _fs(spark, f"{path}/deltas")
    gone = 0
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        young = s.getModificationTime() / 1000 > time.time() - older_than_s
        if s.getPath().getName().removeprefix("delta=") not in named and not young:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone


# --------------------------------------------------------------------------- reading
def _number(of: Column, numbers: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[of]


def read(spark: SparkSession, path: str, snapshot: int | None = None, collections: list[str] | None = None) -> DataFrame | None:
    """The rows of a snapshot (the last one), or None if nothing was ever written.

    collections: only these; prunes folders in every scan of the merge. (A filter on the result prunes the scan of
    the rows, not those that find the keys written more than once.)
    """
    s = state(spark, path, snapshot)
    if not s["deltas"]:
        return None
    schema = T.StructType.fromJson(json.loads(s["schema"]))
    files = spark.read.schema(T.StructType([*schema.fields, T.StructField("delta", T.StringType())])).option("basePath", f"{path}/deltas")
    rows = files.parquet(*[f"{path}/deltas/delta={d}" for d in s["deltas"]])
    rows = rows.withColumn("_seq", _number(F.col("delta"), s["deltas"]))
    if collections is not None:
        rows = rows.filter(F.col("collection").isin(collections))
    if s["cleared"]:
        rows = rows.filter(F.col("_seq") > F.coalesce(_number(F.col("collection"), s["cleared"]), F.lit(0)))
    if len(s["deltas"]) > 1:
        narrow = rows.select(*KEY, "version", "_seq")
        first = min(s["deltas"].values())
        later = narrow.filter(F.col("_seq") > first)
        pool = later.unionByName(narrow.filter(F.col("_seq") == first).join(later.select(*KEY), KEY, "left_semi"))
        best = F.max(F.struct("version", "_seq")).over(Window.partitionBy(*KEY))["_seq"]
        losers = pool.withColumn("_best", best).filter(F.col("_seq") != F.col("_best")).select(*KEY, "_seq")
        rows = rows.join(losers, [*KEY, "_seq"], "left_anti")
    return rows.select(*schema.fieldNames())


stored = read                           # as vector_index names it
