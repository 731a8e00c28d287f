"""Line deduplication by a suffix array over line-ID sequences, in DataFrame operations only.

A document is its sequence of lines; equal lines get equal ids. A suffix is a
place (document, line) with the lines from there to the document's end. Prefix
doubling ranks the suffixes by their first 1, 2, 4, ... lines: round k+1 ranks the
pairs (rank_k at the place, rank_k 2^k lines on) and two suffixes get one rank exactly if
they share their first 2^(k+1) lines. Ranks keep the order: they number the pairs
that occur more than once in a range-partitioned sort. Suffixes without an equal
leave the table, so it shrinks from round to round.

Which depth counts: a repeated run counts if it holds at least `min_words`
words. For every line two runs suffice, the shortest such run that starts at it and
the shortest that ends at it: each line of a longer repeated run lies in one of
these runs inside it (a line before which the run has fewer words
lies in the run's first shortest run, any other in the one that ends at it). So the suffixes are
grouped into the longest-common-prefix intervals of those depths: suffixes agree on n lines, 2^k <= n < 2^(k+1),
if they have equal rank_k at their start and equal rank_k at n - 2^k lines on. The first suffix of
an interval (by doc_id, then line) is the first copy; the runs of the others are
later copies, and the union of later copies is deleted: exactly the lines of maximal
repeated runs that occur earlier.

Rounds go on to the largest depth that counts. No group is gathered anywhere: hot
lines are counted map-side, and ranks are joined back by joins that Spark may
split. Windows run inside one document's stretch of repeated lines.

Defined cases: null text has no lines and stays null; empty text is one empty line; a
text repeated inside one document is deleted there too; repeated rows are copies like
any other (in the order of a kept row number); null doc_ids sort first;
empty table: empty result; only doc_id and text are read (`without_copies` carries
other columns along, whatever their names, except those starting with `_ld_`).
Line ids are two 64-bit hashes of the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, Scratch, table

MIN_WORDS = 50
_WAY = ["rid", "ln"]


def _ranked(scratch: Scratch, pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and rank of the keys that occur more than once, ranks in the order of the keys."""
    again = pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return scratch.keep(again.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("rank", F.monotonically_increasing_id()), name)


def _stretches(first: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines in unbroken stretches of at least `min_words` words, with the words before each line in it."""
    w = Window.partitionBy("rid").orderBy("ln")
    first = first.withColumn("stretch", F.col("ln") - F.row_number().over(w))
    inside = Window.partitionBy("rid", "stretch")
    before = inside.orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return (first.withColumn("total", F.sum("words").over(inside)).filter(F.col("total") >= min_words)
            .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
            .withColumn("stop", F.max("ln").over(inside) + 1))


def _shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """rid, ln, n: per line the shortest run of at least `min_words` words that starts, and that ends, there."""
    spot = F.struct(F.col("before").alias("v"), F.col("ln").alias("at"))
    end = F.struct(F.col("total").alias("v"), F.col("stop").alias("at"))
    is_last = F.col("ln") + 1 == F.col("stop")
    # every line boundary (the stretch's end included) is an event and asks in both directions
    marks = (lines.select("rid", "stretch", F.explode(F.when(is_last, F.array(spot, end)).otherwise(F.array(spot))).alias("e"))
             .select("rid", "stretch", "e.v", "e.at"))
    asks = marks.select("rid", "stretch", "at", F.explode(F.array(
        F.struct(F.col("v"), F.lit(0).alias("dir")), F.struct((F.col("v") + min_words).alias("v"), F.lit(1).alias("dir")),
        F.struct((F.col("v") - min_words).alias("v"), F.lit(-1).alias("dir")))).alias("a")).select("rid", "stretch", "at", "a.v", "a.dir")
    mark = F.when(F.col("dir") == 0, F.col("at"))
    part = Window.partitionBy("rid", "stretch")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    # the first boundary with at least v words before it, and the last with at most v
    ahead = F.last(mark, ignorenulls=True).over(part.orderBy(F.desc("v"), F.col("dir") != 0, F.desc("at")).rowsBetween(*so_far))
    behind = F.last(mark, ignorenulls=True).over(part.orderBy("v", F.col("dir") != 0, "at").rowsBetween(*so_far))
    runs = (asks.withColumn("ahead", ahead).withColumn("behind", behind)
            .select("rid", F.when(F.col("dir") == 1, F.col("at")).when(F.col("dir") == -1, F.col("behind")).alias("ln"),
                    F.when(F.col("dir") == 1, F.col("ahead")).when(F.col("dir") == -1, F.col("at")).alias("stop"))
            .filter("ln IS NOT NULL AND stop IS NOT NULL"))
    return runs.select("rid", "ln", (F.col("stop") - F.col("ln")).alias("n")).filter("n > 0").distinct()


def later_copies(rows: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rid, ln) of deleted lines, once each, and (rid, doc_id, n_lines) of all rows; `rows` has rid, doc_id, text."""
    cut = F.split("text", "\n", -1)
    lines = (rows.select("rid", "doc_id", F.posexplode_outer(cut).alias("ln", "line"))      # a row without text keeps one, with no line
             .select("rid", "doc_id", "ln", F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("\n"), F.col("line"))).alias("h2"),
                     F.regexp_count("line", F.lit(SPACED_WORD)).alias("words")))
    every = scratch.keep(lines, "lines")
    counts = every.groupBy("rid", "doc_id").agg(F.count("ln").alias("n_lines"))
    lines = every.filter("ln IS NOT NULL")
    ids = _ranked(scratch, lines, ["h1", "h2"], "rank0")
    first = lines.join(ids, ["h1", "h2"]).select("rid", "doc_id", "ln", "words", "rank")
    known = scratch.keep(_stretches(first, min_words), "stretches")
    runs = scratch.keep(_shortest_runs(known, min_words).withColumn("k", F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")), "runs")
    top = runs.agg(F.max("k")).first()[0]
    rank, found, k = known.select("rid", "ln", "rank"), [], 0
    while top is not None:
        mine = runs.filter(F.col("k") == k).withColumn("tail", F.col("ln") + F.col("n") - (1 << k))
        ends = rank.select("rid", F.col("ln").alias("tail"), F.col("rank").alias("rank_tail"))
        found.append(scratch.keep(mine.join(rank, _WAY).join(ends, ["rid", "tail"])
                                  .select("rid", "ln", "n", "rank", "rank_tail"), f"depth{k}"))
        if k == top:
            break
        shifted = rank.select("rid", (F.col("ln") - (1 << k)).alias("ln"), F.col("rank").alias("rank2"))
        pairs = scratch.keep(rank.withColumnRenamed("rank", "rank1").join(shifted, _WAY), f"pairs{k}")
        names = _ranked(scratch, pairs, ["rank1", "rank2"], f"rank{k + 1}")
        rank = scratch.keep(pairs.join(names, ["rank1", "rank2"]).select("rid", "ln", "rank"), f"suffixes{k + 1}")
        k += 1
    place = F.struct("doc_id", "rid", "ln")
    ids = known.select("rid", "doc_id", "ln")
    deleted = None
    for depth in found:
        key = ["n", "rank", "rank_tail"]
        suffixes = depth.join(ids, _WAY)
        intervals = suffixes.groupBy(*key).agg(F.count("*").alias("copies"), F.min(place).alias("first")).filter("copies > 1")
        later = (suffixes.join(intervals.select(*key, F.col("first.rid").alias("r1"), F.col("first.ln").alias("l1")), key)
                 .filter("rid != r1 OR ln != l1")
                 .select("rid", F.explode(F.expr("sequence(ln, ln + n - 1)")).alias("ln")))
        deleted = later if deleted is None else deleted.unionByName(later)
    empty = lines.select("rid", "ln").filter("false")
    return (empty if deleted is None else deleted.distinct()), counts


def _rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.keep(docs.withColumn("rid", F.monotonically_increasing_id()), "rows")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (ascending, from 0) of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    gone, counts = later_copies(rows, scratch, min_words)
    per = gone.groupBy("rid").agg(F.array_sort(F.collect_list("ln")).alias("removed_lines"))      # lines of one document
    return (counts.join(per, "rid", "left")
            .select("doc_id", "n_lines",
                    F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines")))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without the lines of later copies (a document of which nothing is left has an empty text)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.withColumn("_ld_rid", F.monotonically_increasing_id()), "rows")
    gone, _ = later_copies(rows.select(F.col("_ld_rid").alias("rid"), "doc_id", "text"), scratch, min_words)
    per = gone.groupBy(F.col("rid").alias("_ld_rid")).agg(F.collect_list("ln").alias("_ld_gone"))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_ld_gone", i)), "\n")
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(left)
    return rows.join(per, "_ld_rid", "left").withColumn("text", text).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (removed_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines")))


OP1_SQL = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(range(len(p))) AS ln, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT *, len(regexp_extract_all(line, '{SPACED_WORD}')) AS words FROM lines),
-- all equal lines of two places, the earlier one first; equal shifts in a row form a repeated run
m AS (
  SELECT b.doc_id, b.ln, a.doc_id AS doc_a, b.ln - a.ln AS shift, b.words
  FROM w a JOIN w b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.ln < b.ln))),
i AS (
  SELECT *, ln - row_number() OVER (PARTITION BY doc_id, doc_a, shift ORDER BY ln) AS island FROM m),
r AS (SELECT doc_id, ln, sum(words) OVER (PARTITION BY doc_id, doc_a, shift, island) AS run_words FROM i),
gone AS (SELECT DISTINCT doc_id, ln FROM r WHERE run_words >= {MIN_WORDS}),
g AS (SELECT doc_id, count(*) AS n, string_agg(ln::VARCHAR, ',' ORDER BY ln) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed_lines
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
