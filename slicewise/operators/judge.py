"""Judge until the reply is valid, in bounded rounds.

The reference asks again until a reply parses as a valid score (unbounded).
Here a request is resolved by its first valid attempt; attempts are rows, so
a round is one batch over the pending set (requests left-anti valid replies).
After `max_rounds` the request is reported unresolved with a null score and
left out of the score ratio's count.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions.replies import judgement
from slicewise.session import cut_lineage

DEFAULT_MAX_ROUNDS = 3


def parse_judgements(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    j = replies.withColumn("_j", judgement(F.col(reply_col)))
    return j.select(*[c for c in replies.columns], "_j.valid", "_j.score", "_j.justification", "_j.branch")


def accept(parsed: DataFrame, key: str, attempt_col: str = "attempt") -> DataFrame:
    """First valid attempt per request; unresolved requests keep a null score."""
    best = parsed.groupBy(key).agg(
        F.count("*").cast("long").alias("attempts_seen"),
        F.min(F.when(F.col("valid"), F.struct(F.col(attempt_col), F.col("score"), F.col("justification")))).alias("first"))
    return best.select(key, "attempts_seen",
                       F.col("first")[attempt_col].alias("accepted_attempt"),
                       F.col("first.score").alias("score"), F.col("first.justification").alias("justification"),
                       F.col("first").isNotNull().alias("resolved"))


def pending(requests: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Requests with no valid reply yet: the next round's batch."""
    return requests.join(parsed.filter(F.col("valid")).select(key).distinct(), key, "left_anti")


def run_rounds(requests: DataFrame, ask: Callable[[DataFrame, int], DataFrame], key: str,
               max_rounds: int = DEFAULT_MAX_ROUNDS, tables: list | None = None) -> DataFrame:
    """Drive a judge hook round by round: ask(pending_requests, attempt) -> replies (key, attempt, reply).

    Each round's replies are parsed and unioned; the loop ends when nothing is
    pending or after max_rounds. The driver only sees a bounded count per round.
    """
    parsed = None
    todo = requests
    for attempt in range(max_rounds):
        # materialised: the model is asked once per request and round, and the reply tested is the one kept
        got = cut_lineage(parse_judgements(ask(todo, attempt)), owner=tables)
        parsed = got if parsed is None else parsed.unionByName(got)
        todo = pending(requests, parsed, key)
        if todo.limit(1).count() == 0:
            break
    return accept(parsed, key)
