"""QA pairs in the legacy text format.

A file is one row (path, value), as `spark.read.text(path, wholetext=True)`
yields. Parsing is map-side inside the row: lines are stripped; a `Q:` line
opens a pair (a later `Q:` replaces it), the next `A:` line closes it, an `A:`
with no open question and all other lines are ignored. So a pair is an `A:`
line whose nearest preceding Q/A line is a `Q:` line. The text after the
first three characters is the field. An answer written as `[...]` becomes
the list of its single-quoted items, anything else a one-item list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.functions.text import py_strip


def parse(files: DataFrame, path_col: str = "path", value_col: str = "value") -> DataFrame:
    """-> path, qa_index, question, answers (array<string>)."""
    lines = F.transform(F.split(F.regexp_replace(F.col(value_col), "\r\n?", "\n"), "\n", -1), py_strip)
    marked = F.filter(lines, lambda ln: ln.startswith("Q:") | ln.startswith("A:"))
    staged = files.select(F.col(path_col).alias("path"), marked.alias("_qa"))
    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("_qa") - 1, F.lit(1))),
                    lambda i: F.struct(F.try_element_at("_qa", i).alias("q"), F.try_element_at("_qa", i + 1).alias("a"))),
        lambda p: p["q"].startswith("Q:") & p["a"].startswith("A:") & (F.length(py_strip(F.substring(p["q"], 4, 1 << 30))) > 0))
    exploded = staged.select("path", F.posexplode(pairs).alias("qa_index", "p"))
    answer = py_strip(F.expr("substring(p.a, 4)"))
    listed = (answer.startswith("[") & answer.endswith("]"))
    return exploded.select(
        "path", F.col("qa_index").cast("long"),
        py_strip(F.expr("substring(p.q, 4)")).alias("question"),
        F.when(listed, F.regexp_extract_all(
            F.substring(answer, F.lit(2), F.length(answer) - 2), F.lit("'([^']*?)'"), 1))
         .otherwise(F.array(answer)).alias("answers"))


def py_repr_str(item):
    """A string rendered as Python's repr does: single quotes, or double quotes when the text
    has an apostrophe and no double quote; backslash, the chosen quote and \\n \\r \\t escaped."""
    esc = F.replace(item, F.lit("\\"), F.lit("\\\\"))
    for ch, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))
    dq = F.contains(item, F.lit("'")) & ~F.contains(item, F.lit('"'))
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def render(qa: DataFrame, path_col: str = "path", order_col: str = "qa_index") -> DataFrame:
    """One text row per file: `Q: question`, `A: <Python list repr>`, blank line, in QA order.

    Items with an apostrophe are double-quoted as Python prints them, and the
    reader (single-quoted items only) loses them, as the legacy format does.
    """
    block = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: ["),
                     F.array_join(F.transform("answers", py_repr_str), ", "),
                     F.lit("]\n\n"))
    return (qa.groupBy(path_col)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col), block.alias("b")))),
                                          lambda s: s["b"]), "").alias("value"))
            .withColumnRenamed(path_col, "path"))


def read_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """Whole QA text files as (path, value) rows."""
    return spark.read.text(path_glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
