"""Documents and QA jobs from text files.

A file type names one text file (or a glob). Files are read whole
(`wholetext`), one row per file, keyed by their path; a file type whose file
is missing or unreadable becomes a reject row instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.functions.text import file_stem

REASON_MISSING_FILE = "text file not found"


def load_documents(spark: SparkSession, file_types: DataFrame, base_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """(name, path) rows -> (documents(doc_id, file_type, text, n_chars, path), rejects(file_type, reason)).

    The paths of the configuration are read in one `spark.read.text` call; the
    configuration is small (one row per file type), so its paths are listed on
    the driver, while the texts are read by the executors.
    """
    prefix = base_dir.rstrip("/") + "/" if base_dir else ""
    named = file_types if "position" in file_types.columns else file_types.withColumn("position", F.monotonically_increasing_id())
    types = (named.groupBy(F.col("name").alias("file_type")).agg(F.min_by("path", "position").alias("path"))   # first definition wins
             .withColumn("path", F.concat(F.lit(prefix), F.col("path"))))
    found = _matches(spark, [r.path for r in types.select("path").distinct().collect()])
    files = spark.createDataFrame(found, "path string, full_path string")
    docs = spark.createDataFrame([], "full_path string, text string")
    if found:
        docs = spark.read.text(sorted({f for _, f in found}), wholetext=True).select(
            _plain_path(_decoded(F.col("_metadata.file_path"))).alias("full_path"), F.col("value").alias("text"))
    docs = (types.join(files, "path").withColumn("full_path", _plain_path(F.col("full_path"))).join(docs, "full_path")
            .select(F.xxhash64("file_type", "full_path").alias("doc_id"), "file_type", "text",
                    F.length("text").cast("long").alias("n_chars"), "path"))
    rejects = types.join(files.select("path").distinct(), "path", "left_anti").select(
        "file_type", F.lit(REASON_MISSING_FILE).alias("reason"))
    return docs, rejects


def _matches(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(configured path or glob, qualified path of a file it names); one listing per configured path."""
    jvm, out = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        out += [(p, s.getPath().toString()) for s in (fs.globStatus(fs.makeQualified(hp)) or []) if s.isFile()]
    return out


def _decoded(uri: Column) -> Column:
    """Spark's metadata gives URL-encoded paths; listings don't."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def _plain_path(path: Column) -> Column:
    """`file:///a` and `file:/a` are one file."""
    return F.regexp_replace(path, "^file:/+", "/")


def qa_jobs(spark: SparkSession, input_glob: str, output_dir: str) -> DataFrame:
    """One QA-generation job per regular file: (path, stem, text, output_path `{stem}_qa_pairs.txt`)."""
    files = spark.read.text(input_glob, wholetext=True).select(
        _decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    stem = file_stem(F.col("path"))
    return files.select("path", stem.alias("stem"), "text",
                        F.concat(F.lit(output_dir.rstrip("/") + "/"), stem, F.lit("_qa_pairs.txt")).alias("output_path"))
