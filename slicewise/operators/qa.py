"""QA sets: sampling (T5), regeneration policies (J6, X1, X2) and the QA <-> experiment join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewise.functions.text import PROMPT_MAX_CHARS
from slicewise.session import cut_lineage

DEFAULT_QA_PER_FILE = 8


def sample(qa: DataFrame, n: int = DEFAULT_QA_PER_FILE, seed: str = "seed0", key: str = "file_type") -> DataFrame:
    """T5: at most n QA pairs per file, chosen by a seeded hash (deterministic, reproducible in SQL).

    The rank filter becomes a WindowGroupLimit before the shuffle, so a file with
    a huge QA set sends only n rows per partition across the network.
    """
    w = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed), F.col("question"))), F.col("qa_id"))
    return (qa.withColumn("sample_rank", F.row_number().over(w).cast("long"))
              .filter(F.col("sample_rank") <= n))


def needs_generation(files: DataFrame, existing: DataFrame, policy: str, key: str = "file_type") -> DataFrame:
    """Files to (re)generate QA for; `skip` leaves files that already have pairs."""
    if policy == "skip":
        return files.join(existing.select(key).distinct(), key, "left_anti")
    if policy in ("append", "rebuild"):
        return files
    raise ValueError(f"unknown QA build policy: {policy}")


def apply_policy(new: DataFrame, existing: DataFrame, policy: str, key: str = "file_type") -> DataFrame:
    """Combine freshly generated pairs with the stored ones.

    append  -> new pairs first, then the existing ones (no dedupe), `qa_order` keeps that order
               (positions are non-negative and below 2**52);
    rebuild -> new pairs replace the stored ones of the files that were regenerated;
    skip    -> stored pairs stay; new pairs only for files that had none.
    """
    cols = [key, "question", "answers"]
    new_t = new.select(*cols, F.lit(0).alias("_src"), F.col("qa_index").alias("_pos"))
    old_t = existing.select(*cols, F.lit(1).alias("_src"), F.col("qa_index").alias("_pos"))
    if policy == "append":
        both = new_t.unionByName(old_t)
    elif policy == "rebuild":
        both = new_t.unionByName(old_t.join(new_t.select(key).distinct(), key, "left_anti"))
    elif policy == "skip":
        both = old_t.unionByName(new_t.join(old_t.select(key).distinct(), key, "left_anti"))
    else:
        raise ValueError(f"unknown QA build policy: {policy}")
    # position within a file type without one window over the whole (possibly hot) file type:
    # a unique integer order (source first, then position) numbered in bounded buckets
    from slicewise.functions.indexing import dense_index
    ordered = both.withColumn("_ord", F.col("_src").cast("long") * F.lit(1 << 62) + F.col("_pos").cast("long"))
    return dense_index(ordered, [key], "_ord", "qa_order").drop("_src", "_pos", "_ord")


def generate(documents: DataFrame, templates: DataFrame, responder, key: str = "file_type",
             max_chars: int = PROMPT_MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """GenQAs prompt per document -> responder hook -> P10 -> QA rows.

    documents: key + text. responder: DataFrame(key, prompt) -> DataFrame(key, reply),
    e.g. `mapInPandas` over a model client. The document fills `{document}` and the
    prompt is cut to max_chars; `truncated` says in both results which documents the
    model did not see whole. Returns (qa rows (key, qa_index, question, answers, truncated),
    skipped keys with no pairs).
    """
    from slicewise.functions.replies import qa_answers, qa_items, qa_question
    from slicewise.operators.prompts import render

    prompts = render(documents, templates, "GenQAs", {"document": ("text", False)}, max_chars=max_chars)
    prompts = prompts.select(key, "prompt", "truncated")
    # read twice below, asked once
    replies = cut_lineage(responder(prompts).select(key, "reply").join(prompts.select(key, "truncated"), key))
    items = replies.select(key, "truncated", qa_items(F.col("reply"))["items"].alias("items"))
    qa_rows = items.select(key, "truncated", F.posexplode("items").alias("qa_index", "item")).select(
        key, F.col("qa_index").cast("long"), qa_question(F.col("item")).alias("question"),
        qa_answers(F.col("item")).alias("answers"), "truncated")
    skipped = items.filter(F.size("items") == 0).select(key, "truncated")
    return qa_rows, skipped
