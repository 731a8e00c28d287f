"""Prompts and answer context.

Templates are rows of a (task, template) table joined by task; an unknown task
renders from a blank template. Placeholders are `{document}`, `{question}`,
`{std}`, `{judge}`; a null field leaves its placeholder as it is; `document`
is substituted last so retrieved text is never rescanned. A list field is
joined with newlines. The raw text, if any, follows after two newlines, and
the whole prompt is cut to a number of characters (8192 by default; `truncated` tells when).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.functions.text import PROMPT_MAX_CHARS

# ---------------------------------------------------------------------------
# Guard answers of the answering step.
# ---------------------------------------------------------------------------
NO_QUESTION_ANSWER = "Error: No question provided."
NO_DOCUMENTS_ANSWER = "Could not retrieve relevant documents to answer the question."
# ---------------------------------------------------------------------------

# Default templates (replaceable rows; the placeholders are what matters).
DEFAULT_TEMPLATES = [
    ("RAGAnswer", "Answer question Q using only document D. If D lacks the information, say so.\n"
                  "Document D:\n{document}\n\nQuestion Q:\n{question}\n"),
    ("GenQAs", "Write 3 to 8 questions a reader would ask about the text, each with 1 to 3 answers, "
               "as a JSON array of {\"question\": ..., \"answers\": [...]}.\n\nText:\n{document}\n"),
    ("JudgeAs", "Rate the model answer against the standard answer.\nQuestion: {question}\n"
                "Documents: {document}\nModel answer: {judge}\nStandard answer: {std}\n"
                "Reply as {\"score\": 0|1|2, \"justification\": \"...\"}.\n"),
]
FIELD_ORDER = ("question", "std", "judge", "document")


def templates_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else DEFAULT_TEMPLATES, "task string, template string")


def _as_text(c: Column, is_list: bool) -> Column:
    return F.array_join(c, "\n") if is_list else c


def render_column(template: Column, fields: dict[str, tuple[Column, bool]], original: Column | None = None) -> Column:
    """P5: substitute fields into a template column; fields: name -> (column, is_list)."""
    out = template
    for name in FIELD_ORDER:
        if name not in fields:
            continue
        col, is_list = fields[name]
        val = _as_text(col, is_list)
        out = F.when(val.isNull(), out).otherwise(F.replace(out, F.lit("{" + name + "}"), val))
    if original is not None:
        out = F.concat(out, F.lit("\n\n"), F.coalesce(original, F.lit("")))
    return out


def render(df: DataFrame, templates: DataFrame, task: str, fields: dict[str, tuple[str, bool]],
           original_col: str | None = None, out_col: str = "prompt", max_chars: int = PROMPT_MAX_CHARS) -> DataFrame:
    """P4 + P5 + P6 over a frame: adds `prompt` (cut to max_chars) and `truncated`, which tells when it was cut."""
    # templates are configuration rows, joined on their task
    t = templates.groupBy(F.col("task").alias("_task")).agg(F.first("template").alias("_tpl"))
    joined = df.withColumn("_task", F.lit(task)).join(t, "_task", "left").drop("_task")
    full = render_column(F.coalesce(F.col("_tpl"), F.lit(" ")),
                         {k: (F.col(c), is_list) for k, (c, is_list) in fields.items()},
                         F.col(original_col) if original_col else None)
    return (joined.withColumn("_full", full)
                  .withColumn(out_col, F.substring("_full", 1, max_chars))
                  .withColumn("truncated", F.length("_full") > max_chars)
                  .drop("_tpl", "_full"))


def assemble_context(questions: DataFrame, hits: DataFrame, kept_hits: DataFrame, key_cols: list[str],
                     order_col: str, rerank_col: str = "rerank") -> DataFrame:
    """A6 + A5 + P14: context list in rank order, counts, guard status and guard answers.

    questions: key_cols + question + rerank flag; hits: all retrieved rows (key_cols);
    kept_hits: key_cols + order_col + chunk_text after rerank. Lists are bounded by k.
    """
    per_q = kept_hits.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("chunk_text").alias("t")))),
                    lambda s: s["t"]).alias("context"),
        F.count("*").cast("long").alias("kept_count"))
    retrieved = hits.groupBy(*key_cols).agg(F.count("*").cast("long").alias("retrieved_count"))
    j = questions.join(per_q, key_cols, "left").join(retrieved, key_cols, "left")
    blank_q = F.col("question").isNull() | (F.col("question") == "")
    no_docs = F.col("context").isNull()
    status = F.when(blank_q, F.lit("no question")).when(no_docs, F.lit("no documents")).otherwise(F.lit("ok"))
    guard = F.when(blank_q, F.lit(NO_QUESTION_ANSWER)).when(no_docs, F.lit(NO_DOCUMENTS_ANSWER))
    ok = ~blank_q & ~no_docs
    return (j.withColumn("status", status)
             .withColumn("guard_answer", guard)
             .withColumn("context", F.when(ok, F.col("context")).otherwise(F.array().cast("array<string>")))
             .withColumn("retrieved_count", F.when(ok, F.col("retrieved_count")).otherwise(F.lit(0).cast("long")))
             .withColumn("reranked_count", F.when(ok & F.col(rerank_col), F.col("kept_count"))
                         .otherwise(F.lit(0).cast("long")))
             .drop("kept_count"))
