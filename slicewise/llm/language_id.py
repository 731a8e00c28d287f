"""Language identification by prediction by partial matching (PPM) over bytes.

Per language a variable-order context tree counts which byte follows which
context of up to `MAX_ORDER` bytes; contexts reach back to the start of a word
(the space before it included). The statistics are frozen after learning. The
code length of a byte is -log2 of its count share in the longest known context
that has it; every longer known context costs an escape of
D / (T + D) (D distinct followers, T occurrences; method C, no exclusions), and a
byte unknown to the empty context costs an escape and 8 bits. A text's code length
is the exact sum over all its bytes, and the language with the shortest code wins
(ties: the smaller name). The score is the winner's posterior under equal priors.

Since contexts stop at word starts, the code length of a word is the same
wherever it stands: every distinct word is walked through the trees once (a whole
batch of new words at a time) and looked up afterwards, in a table of at most
`CACHE_WORDS` words that is emptied when full.

Learning uses a bounded sample of labelled rows: up to `SAMPLE_DOCS` documents per
language, those with the smallest keyed hash, so reruns learn the same model. Word
counts of the sample are gathered by Spark; the model is broadcast, at most
`MAX_MODEL_BYTES`.

Defined cases: null text, or text without a letter: `und`, score 0; no labelled
rows to learn from: `und` for all; empty table: empty result; null doc_id: not held
out and not learnt from; repeated rows are predicted each for itself; lang, source
and doc_id never reach the prediction and other columns are not read (or, in
`with_language`, carried along untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

MAX_ORDER = 4
SAMPLE_DOCS = 250
CACHE_WORDS = 400_000
MAX_MODEL_BYTES = 256 << 20
MAX_LANGS = 1000

_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ' word ' for every word, each byte's place in it, and where each word starts."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    return data, np.arange(len(data)) - np.repeat(starts, lengths), starts


def _keys(data: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that have `order` bytes of context and are not the leading space, with (context, byte) and context keys."""
    at = np.flatnonzero(place >= max(order, 1))
    context = np.zeros(len(at), dtype=np.int64)
    for back in range(order, 0, -1):
        context = (context << 8) | data[at - back]
    return at, (context << 8) | data[at], context


class Model:
    """Frozen context trees of all languages: per order, sorted keys and cost columns (one per language)."""

    def __init__(self, words: pd.DataFrame, max_order: int = MAX_ORDER):
        """words: lang, word, n."""
        self.langs = sorted(words["lang"].unique())
        self.orders = []
        code = {lang: i for i, lang in enumerate(self.langs)}
        data, place, starts = _packed([w.encode("utf-8", "surrogatepass") for w in words["word"]]) if len(words) else (np.zeros(0, np.int64),) * 3
        lengths = np.diff(np.append(starts, len(data)))
        lang = np.repeat(words["lang"].map(code).to_numpy(dtype=np.int64), lengths)
        count = np.repeat(words["n"].to_numpy(dtype=np.float64), lengths)
        for order in range(max_order + 1):
            at, pairs, contexts = _keys(data, place, order)
            pair_keys, pair_at = np.unique(pairs, return_inverse=True)
            n = np.zeros((len(pair_keys), len(self.langs)))
            np.add.at(n, (pair_at, lang[at]), count[at])
            context_keys, of = np.unique(pair_keys >> 8, return_inverse=True)
            total = np.zeros((len(context_keys), len(self.langs)))
            distinct = np.zeros_like(total)
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.where(n > 0, np.log2((total + distinct)[of]) - np.log2(n), np.inf)
                escape = np.where(distinct > 0, np.log2(total + distinct) - np.log2(distinct), 0.0)
            self.orders.append((pair_keys, cost.astype(np.float32), context_keys, escape.astype(np.float32)))
        size = sum(x.nbytes for o in self.orders for x in o)
        if size > MAX_MODEL_BYTES:
            raise ValueError(f"a model of {size} bytes; the broadcast bound is {MAX_MODEL_BYTES}")

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits per word (rows) and language (columns)."""
        data, place, starts = _packed(words)
        bits = np.zeros((len(data), len(self.langs)))
        open_ = np.ones(bits.shape, dtype=bool)
        open_[starts] = False
        for order in range(len(self.orders) - 1, -1, -1):
            pair_keys, cost, context_keys, escape = self.orders[order]
            at, pairs, contexts = _keys(data, place, order)
            if not len(at) or not len(pair_keys):
                continue
            k = np.minimum(np.searchsorted(pair_keys, pairs), len(pair_keys) - 1)
            c = np.where((pair_keys[k] == pairs)[:, None], cost[k], np.inf)
            settled = open_[at] & np.isfinite(c)
            k = np.minimum(np.searchsorted(context_keys, contexts), len(context_keys) - 1)
            e = np.where((context_keys[k] == contexts)[:, None], escape[k], 0.0)
            bits[at] += np.where(settled, c, np.where(open_[at], e, 0.0))
            open_[at] &= ~settled
        bits += np.where(open_, 8.0, 0.0)
        return np.add.reduceat(bits, starts, axis=0)


class Scorer:
    """Per-worker word table over a frozen model."""

    def __init__(self, model: Model):
        self.model, self.index, self.costs = model, {}, np.zeros((0, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index, new = {}, list(words)
            self.costs = self.costs[:0]
        parts = []
        for i in range(0, len(new), 20_000):
            parts.append(self.model.code_lengths([w.encode("utf-8", "surrogatepass") for w in new[i:i + 20_000]]))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.costs = np.concatenate([self.costs, *parts])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.model.langs:
            return out
        group: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            group.append((i, text.lower().split()))
            size += len(group[-1][1])
            if size > 200_000:
                self._flush(group, out)
                group, size = [], 0
        self._flush(group, out)
        return out

    def _flush(self, group: list[tuple[int, list[str]]], out: list) -> None:
        if not group:
            return
        self.learn(set().union(*(w for _, w in group)))
        for i, words in group:
            at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
            bits = self.costs[at].sum(axis=0)
            best = int(bits.argmin())
            out[i] = (self.model.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_order: int = MAX_ORDER) -> Model:
    """The model from rows that are not held out; `docs` has doc_id, text and lang."""
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    key = F.abs(F.xxhash64("doc_id") % (1 << 30)) / (1 << 30)
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if not counts:
        return Model(pd.DataFrame({"lang": [], "word": [], "n": []}), max_order)
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    # about twice the rows wanted, picked in the scan: only they are shuffled
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 2 * sample_docs / r["count"])])
    near = rows.withColumn("_u", key).filter(F.col("_u") < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id", "text"))
    words = (near.withColumn("_r", rank).filter(F.col("_r") <= sample_docs)
             .select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
             .filter("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n")))
    return Model(words.toPandas(), max_order)                             # a bounded sample's words


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame(scorer.predict(texts.tolist()), columns=["lang", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return (docs.select(*kept, predict("text").alias("_p"))
            .select(*kept, F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (with_language(docs.select("doc_id", "text"), learn(docs))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
