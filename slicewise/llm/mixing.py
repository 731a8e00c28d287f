"""Mixing sources to target weights by a low-discrepancy source schedule.

1. Sizes (words) per document and source; targets share all words by weight,
   capped at `MAX_REPEAT` times a source's size (the excess goes to the others).
2. The mix has one slot per `BLOCK_WORDS` words. Slot j gets the golden-ratio
   point (j * GOLDEN) mod 2^31, which the cumulative targets map to a source.
3. Slots are ranked per source; rank r takes block r mod n of the source's n
   blocks in pass r div n.
4. A source's documents are laid out one after the other in a keyed shuffle
   order (md5 of the id) and cut into blocks of `BLOCK_WORDS` words. Slots join
   blocks; a document's share is the sum of its overlaps with the blocks taken.

All running sums are taken in steps whose windows are small however large a
source is: 64 x 64 shuffle buckets per source for documents, runs of 1,024 slots
for ranks. The only global window has one row per source.

Defined cases: null or blank texts have size 0 and are taken 0 times; a null
source is a source of its own (last in order); null or repeated ids are rows like any
other (repeated rows count each, their order among themselves is fixed by a
kept row number); an empty table gives an empty result; only doc_id, text and
source are read, so further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, Scratch, located, table

BLOCK_WORDS = 64
MAX_REPEAT = 3
# Fixed value: the odd integer next to 2^31 / golden ratio.
GOLDEN = 1327217885
PERIOD = 1 << 31
_CELL = PERIOD >> 12
_RUN = 1024


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, weight, target, cum (targets before it) from (source, size) rows.

    Weights 1, 2, 3 repeat over the sources by code point, null last. With
    ratio = cap / weight, a source is capped if filling everyone up to its ratio
    takes no more than all words: then its target is its cap, else weight times
    the common level of the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("i", F.row_number().over(by_name)).withColumn("weight", (F.col("i") - 1) % 3 + 1)
    cap = F.col("source_size") * max_repeat
    ratio = cap / F.col("weight")
    before = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    per = (per.withColumn("cap", cap).withColumn("ratio", ratio)
           .withColumn("total", F.sum("source_size").over(every))
           .withColumn("rest_w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("capped", F.col("filled") + F.col("ratio") * F.col("rest_w") <= F.col("total")))
    # null where every source is capped, which only a corpus without words is
    level = F.try_divide(F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every),
                         F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every))
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double"))
                         .otherwise(level * F.col("weight")))
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return (per.withColumn("cum", F.coalesce(F.sum("target").over(upto), F.lit(0.0)))
            .select("i", "source", "source_size", "weight", "target", "cum", "total"))


def slots(spark: SparkSession, per: DataFrame, total: int, block_words: int, max_repeat: int) -> DataFrame:
    """i, block, pass of every slot; `per` comes from `targets`."""
    n = -(-total // block_words)
    lo = F.floor(F.col("cum") / F.col("total") * PERIOD)
    hi = F.floor((F.col("cum") + F.col("target")) / F.col("total") * PERIOD)
    ends = Window.orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    cuts = (per.filter("target > 0").withColumn("lo", lo)
            # the last source takes what rounding leaves
            .withColumn("hi", F.when(F.max("i").over(ends).isNull(), F.lit(PERIOD)).otherwise(hi))
            .filter("hi > lo")
            .withColumn("n_blocks", F.expr(f"(source_size + {block_words} - 1) div {block_words}"))
            .select("i", "n_blocks", "lo", "hi",
                    F.explode(F.expr(f"sequence(lo div {_CELL}, (hi - 1) div {_CELL})")).alias("cell")))
    points = (spark.range(n).withColumnRenamed("id", "j")
              .withColumn("p", F.expr(f"((j % {PERIOD}) * {GOLDEN}) % {PERIOD}"))
              .withColumn("cell", F.expr(f"p div {_CELL}")))
    hit = (points.join(cuts, "cell").filter("p >= lo AND p < hi")
           .select("i", "n_blocks", "j", F.expr(f"j div {_RUN}").alias("run"), F.expr(f"j div {_RUN * _RUN}").alias("far")))
    runs = hit.groupBy("i", "far", "run").agg(F.count("*").alias("n"))
    fars = runs.groupBy("i", "far").agg(F.sum("n").alias("n"))
    upto = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    fars = fars.select("i", "far", F.coalesce(F.sum("n").over(upto("i", by="far")), F.lit(0)).alias("far_at"))
    runs = (runs.select("i", "far", "run", F.coalesce(F.sum("n").over(upto("i", "far", by="run")), F.lit(0)).alias("run_at"))
            .join(fars, ["i", "far"]).select("i", "run", (F.col("far_at") + F.col("run_at")).alias("at")))
    rank = F.col("at") + F.row_number().over(Window.partitionBy("i", "run").orderBy("j")) - 1
    return (hit.drop("far").join(runs, ["i", "run"]).withColumn("rank", rank)
            .select("i", F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks").alias("pass"))
            .filter(F.col("pass") < max_repeat))


def layout(sized: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """rid, i, size, at: each document's first word in its source's shuffled stream."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    num = F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    docs = (sized.filter("size > 0")
            .join(per.select("i", "source"), sized["source"].eqNullSafe(per["source"]))
            .select("rid", "doc_id", "i", "size", h.alias("h"), F.expr("1").alias("one"), num.alias("num"))
            .withColumn("b1", F.expr("num div 64")).withColumn("b2", F.expr("num % 64")))
    small = docs.groupBy("i", "b1", "b2").agg(F.sum("size").alias("s"))
    large = small.groupBy("i", "b1").agg(F.sum("s").alias("s"))
    upto = lambda *keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    large = large.select("i", "b1", F.coalesce(F.sum("s").over(upto("i", by=["b1"])), F.lit(0)).alias("at1"))
    small = (small.select("i", "b1", "b2", F.coalesce(F.sum("s").over(upto("i", "b1", by=["b2"])), F.lit(0)).alias("at2"))
             .join(large, ["i", "b1"]).select("i", "b1", "b2", (F.col("at1") + F.col("at2")).alias("at12")))
    inner = F.coalesce(F.sum("size").over(upto("i", "b1", "b2", by=["h", "doc_id", "rid"])), F.lit(0))
    return (docs.join(small, ["i", "b1", "b2"]).withColumn("at", F.col("at12") + inner)
            .select("rid", "i", "size", "at"))


def takes(spark: SparkSession, sized: DataFrame, per: DataFrame, total: int, block_words: int = BLOCK_WORDS,
          max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """rid, pass, words: how many words of a document each pass of the mix takes (from its start)."""
    pieces = (layout(sized, per, seed)
              .withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
              .withColumn("words", F.expr(f"least(at + size, (block + 1) * {block_words}) - greatest(at, block * {block_words})")))
    return (pieces.select("rid", "i", "block", "words")
            .join(slots(spark, per, total, block_words, max_repeat), ["i", "block"])
            .groupBy("rid", "pass").agg(F.sum("words").alias("words")))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = scratch.keep(_sized(docs.select("doc_id", "text", "source")).drop("text")
                         .withColumn("rid", F.monotonically_increasing_id()), "sized")
    per = scratch.keep(targets(sized, max_repeat), "targets")
    total = int(per.agg(F.max("total")).first()[0] or 0)          # one number
    taken = takes(spark, sized, per, total, block_words, max_repeat, seed).groupBy("rid").agg(F.sum("words").alias("taken"))
    return (sized.join(taken, "rid", "left")
            .join(per.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def _word_ends(rows):
    """end: characters up to the end of word number `words` of the text."""
    import re
    word = re.compile(SPACED_WORD)
    for pdf in rows:
        pdf["end"] = [next((m.end() for k, m in enumerate(word.finditer(text), 1) if k == n), len(text))
                      for text, n in zip(pdf["text"], pdf["words"], strict=True)]
        yield pdf[["rid", "pass", "end"]]


def apply_mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """The mixed corpus: a row per document and pass, with the words that the pass takes.

    Columns and types of `docs`; n_chars, if there, is the length of the new text.
    At most one document per source and pass is cut, the others come whole. Texts are shuffled once,
    at every size of the input: rows meet the list of their passes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cols = docs.columns
    rows = located(scratch, docs, "doc_id", "text", "source")
    sized = scratch.keep(_sized(rows.select("place", "doc_id", "text", "source")).drop("text").withColumn("rid", F.monotonically_increasing_id()), "sized")
    per = scratch.keep(targets(sized, max_repeat), "targets")
    total = int(per.agg(F.max("total")).first()[0] or 0)
    took = scratch.keep(takes(spark, sized, per, total, block_words, max_repeat, seed)
                        .join(sized.select("rid", "place", "size"), "rid"), "took")
    # documents that a pass takes a part of: the last one of a source in each pass
    parts = rows.select("place", "text").join(took.filter("words < size").select("place", "rid", "pass", "words"), "place")
    ends = parts.select("rid", "pass", "text", "words").mapInPandas(_word_ends, "rid long, pass long, end int")
    passes = (took.join(ends, ["rid", "pass"], "left").groupBy("rid").agg(F.first("place").alias("place"), F.collect_list(F.struct("pass", "end")).alias("passes")))
    passes = scratch.keep(passes.select("place", "passes"), "passes")               # at most max_repeat + 1 passes a document
    scratch.only(passes, *scratch.stored(rows))
    out = rows.select("row", "place").join(passes.hint("shuffle_hash"), "place").select("row", F.explode("passes").alias("taken"))
    text = F.when(F.col("taken.end").isNull(), F.col("row.text")).otherwise(F.substring(F.col("row.text"), F.lit(1), F.col("taken.end")))
    new = {"text": text, "n_chars": F.length(text)}
    kinds = {f.name: f.dataType for f in docs.schema}
    return out.select(*[(new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c) for c in cols])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACED_WORD}')), 0) AS size FROM documents),
per0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM sized GROUP BY source),
per1 AS (
  SELECT *, (i - 1) % 3 + 1 AS weight, source_size * {MAX_REPEAT} AS cap,
         (source_size * {MAX_REPEAT}) / ((i - 1) % 3 + 1) AS ratio, sum(source_size) OVER () AS total FROM per0),
per2 AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) + ratio * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) <= total AS capped
  FROM per1 WINDOW w AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per3 AS (
  SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
    / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight END AS target FROM per2),
per AS (
  SELECT *, coalesce(sum(target) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM per3),
cuts AS (
  SELECT i, (source_size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS} AS n_blocks, floor(cum / total * {PERIOD}) AS lo,
         CASE WHEN i = max(i) OVER () THEN {PERIOD} ELSE floor((cum + target) / total * {PERIOD}) END AS hi
  FROM per WHERE target > 0),
points AS (
  SELECT j, (j % {PERIOD} * {GOLDEN}) % {PERIOD} AS p
  FROM (SELECT unnest(range(CAST((max(total) + {BLOCK_WORDS} - 1) // {BLOCK_WORDS} AS BIGINT))) AS j FROM per)),
slot AS (
  SELECT i, n_blocks, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS r
  FROM points JOIN cuts ON p >= lo AND p < hi),
uses AS (
  SELECT i, r % n_blocks AS block, count(*) AS uses FROM slot WHERE r // n_blocks < {MAX_REPEAT} GROUP BY 1, 2),
laid AS (
  SELECT doc_id, p.i, size, coalesce(sum(size) OVER (
           PARTITION BY p.i ORDER BY md5('mix:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source WHERE size > 0),
pieces AS (
  SELECT doc_id, i, pos, size, unnest(range(CAST(pos // {BLOCK_WORDS} AS BIGINT), CAST((pos + size - 1) // {BLOCK_WORDS} + 1 AS BIGINT))) AS block FROM laid),
taken AS (
  SELECT doc_id, sum(uses * (least(pos + size, (pieces.block + 1) * {BLOCK_WORDS}) - greatest(pos, pieces.block * {BLOCK_WORDS}))) AS taken
  FROM pieces JOIN uses USING (i, block) GROUP BY doc_id)
SELECT s.doc_id, s.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN taken t ON s.doc_id = t.doc_id
"""
