"""Exact deduplication as a stateful stream with disk-backed keyed state.

Rows are normalised (A-Z lower-cased, null as empty) and reduced to a SHA-256
digest with a stable identifier (doc_id, row number) and a content locator (the
file that holds the text). These digest rows are a streaming source; the stream keeps, per
digest and for ever (no watermark, no expiry), the identifier and locator of the row
that stays and the number of rows seen, in RocksDB state stores whose
checkpoints lie in the shared folder. The stream aggregates map-side first, so a text
that a third of all rows share reaches its state as one row per task. A stream
started again on the same folder goes on with its state: `advance`
takes only digest rows that it has not seen.

A hit (a row whose digest has another keeper) is checked on its full bytes: its
normalised text is compared with the keeper's, fetched by digest and id.
Digests under which texts differ are grouped anew by the whole text, so the result
is right for any digest function (tests use a weak one).

Of equal texts the row with the largest doc_id stays.

Defined cases: null text equals empty text; null doc_ids rank below all others;
rows that repeat a doc_id and its text: exactly one is kept (the one with the
largest row number), group_size counts all; empty table: empty result; only doc_id and
text are read, so further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, located, lower_ascii, table

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: preallocated log files would take more disk than the state
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of digest rows that one micro-batch takes.
BATCH_BYTES = 8 << 30


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, rid, locator, digest, sha256: what the stream reads. `docs` may itself be a stream's micro-batch."""
    norm = normalised(F.col("text"))
    place = [c for c in docs.columns if c == "place"]
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.input_file_name().alias("locator"),
                       digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), *place)


def advance(spark: SparkSession, source: str, schema, state: str) -> DataFrame:
    """Run the stream over new files of `source` until none is left; the keyed state: digest, keeper, group_size."""
    old = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(source)
        seen = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "rid", "locator")).alias("keeper"), F.count("*").alias("group_size"))
        query = (seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        got = spark.read.format("statestore").load(state)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    keeper, size = got.schema["value"].dataType.names[:2]
    return got.select(F.col("key").getField(got.schema["key"].dataType.names[0]).alias("digest"),
                      F.col("value").getField(keeper).alias("keeper"), F.col("value").getField(size).alias("group_size"))


def _differing(scratch: Scratch, docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, norm) of groups, and the digests under which not all bytes are the keeper's."""
    norm = normalised(F.col("text"))
    rows = (docs.select("doc_id", norm.alias("norm"), digest(norm).alias("digest"))
            .withColumn("short", F.xxhash64("digest"))
            .join(groups.select(F.xxhash64("digest").alias("short")).distinct(), "short", "left_semi").drop("short"))
    rows = scratch.keep(rows, "hits")                   # read twice below; the corpus only once
    mine = groups.select("digest", F.col("keeper.doc_id").alias("keep_id"))
    first = (rows.join(mine, "digest").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .select("digest", F.col("norm").alias("kept_norm")).dropDuplicates(["digest"]))
    bad = rows.join(first, "digest").filter("norm != kept_norm").select("digest").distinct()
    return rows, bad


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs`."""
    return _decided(Scratch(docs.sparkSession), docs.select("doc_id", "text"), digest)


def _decided(scratch: Scratch, docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The columns of `dedup`, and place where `docs` (doc_id, text) has it."""
    spark = docs.sparkSession
    source = scratch.path("digests")
    digest_rows(docs, digest).write.parquet(source)
    rows = spark.read.parquet(source)
    place = [c for c in docs.columns if c == "place"]
    state = advance(spark, source, rows.schema, scratch.path("state"))
    groups = scratch.keep(state.filter("group_size > 1").select("digest", "keeper", "group_size"), "groups")
    full, bad = _differing(scratch, docs, groups, digest)
    bad = scratch.keep(bad, "bad")
    out = (rows.join(groups, "digest", "left")
           .select("doc_id", "rid", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
                   F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                   (F.col("group_size").isNull() | (F.col("keeper.rid") == F.col("rid"))).alias("kept"), "text_sha256", "digest", *place))
    if not bad.isEmpty():
        out = out.join(bad, "digest", "left_anti").unionByName(_by_text(rows, full, bad), allowMissingColumns=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *place)


def kept_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of `docs` that stay, all columns. Only the places of rows that go are kept and joined."""
    scratch = Scratch(docs.sparkSession)
    rows = located(scratch, docs, "doc_id", "text")
    gone = scratch.keep(_decided(scratch, rows.select("doc_id", "text", "place"), digest).filter("NOT kept").select("place"), "gone")
    scratch.only(gone, *scratch.stored(rows))
    return rows.select("row", "place").join(gone, "place", "left_anti").select("row.*")


def _by_text(rows: DataFrame, full: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of digests that stand for several texts, grouped by the texts themselves."""
    named = (full.join(bad, "digest", "left_semi").select("doc_id", "digest", "norm", sha256(F.col("norm")).alias("text_sha256")).distinct())
    keyed = rows.join(bad, "digest", "left_semi").withColumnRenamed("doc_id", "d")
    # a row and its text meet over id and true digest; texts that even share that are told apart by themselves
    keyed = keyed.join(named.withColumnRenamed("digest", "g").withColumnRenamed("text_sha256", "t"),
                       (F.col("digest") == F.col("g")) & (F.col("text_sha256") == F.col("t")) & F.col("d").eqNullSafe(F.col("doc_id")))
    groups = keyed.groupBy("norm").agg(F.max(F.struct("doc_id", "rid")).alias("keeper"), F.count("*").alias("group_size"))
    place = [c for c in rows.columns if c == "place"]
    return (keyed.select("doc_id", "rid", "norm", "text_sha256", "digest", *place).join(groups, "norm")
            .select("doc_id", "rid", F.col("keeper.doc_id").alias("keep_id"), "group_size",
                    (F.col("keeper.rid") == F.col("rid")).alias("kept"), "text_sha256", "digest", *place))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
