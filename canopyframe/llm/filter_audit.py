"""What every order of five filters removes, from the counts of the filters that each document fails."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Filters in lexicographic order; a mask has bit i where filter i fails.
FILTERS = "ABCDE"
_SUMS = ("n", "good", "toxic")


def lehmer_start(prefix: tuple[int, ...], size: int) -> int:
    """Rank of the first permutation of ``range(size)`` that begins with prefix."""
    rank, free = 0, list(range(size))
    for i, f in enumerate(prefix):
        rank += free.index(f) * factorial(size - 1 - i)
        free.remove(f)
    return rank


def removal_intervals(size: int) -> list[tuple[int, int, int, int]]:
    """Rows (mask, step, start, stop): orders of rank start to stop - 1 remove documents with that mask at that step.

    A mask is removed at step k by every order whose first k - 1 filters it passes and whose k-th it fails. The orders
    with one such beginning are consecutive in lexicographic order.
    """
    rows = []
    for mask in range(1, 1 << size):
        passed = [f for f in range(size) if not mask >> f & 1]
        for k in range(len(passed) + 1):
            for before in permutations(passed, k):
                for f in range(size):
                    if mask >> f & 1:
                        start = lehmer_start((*before, f), size)
                        rows.append((mask, k + 1, start, start + factorial(size - k - 1)))
    return rows


def failed_filters(text: Column) -> Column:
    """Mask of the filters A to D that a text fails; null is empty.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 3 % of the code points are A to Z;
    D: any of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents of each (part, mask): n, and those of them that are labelled good and toxic.

    E fails where a smaller id has the same text. Equal texts fail the same of A to D, so each text needs only its
    counts by part and the counts of its smallest id: copies are summed before they are shuffled to their text. Texts
    are told by SHA-256. Null ids are neither smaller nor larger than others, and have no labels; repeated ids count
    each. A repeated label takes its largest value. Null text is empty, a null part is the empty string.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sum"), failed_filters(F.col(text_col)).alias("mask"),
    )
    rows = rows.groupBy("id", "part", "sum").agg(F.first("mask").alias("mask"), F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").cast("string").alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic")
    )
    # null ids have keys of their own, so that they neither match nor meet in one task
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("sum")))
    rows = rows.withColumn("key", key).join(known, "key", "left")
    rows = rows.select("id", "part", "sum", "mask", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in _SUMS[1:]))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *_SUMS))).alias("least")
    unnamed = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"null_{c}") for c in _SUMS]
    parts = rows.groupBy("sum", "part").agg(F.first("mask").alias("mask"), *(F.sum(c).alias(c) for c in _SUMS), least, *unnamed)
    first = F.min("least.id").over(Window.partitionBy("sum"))
    parts = parts.withColumn("holds", F.coalesce(F.col("least.id") == first, F.lit(False)))
    stays = [(F.col(f"null_{c}") + F.when(F.col("holds"), F.col(f"least.{c}")).otherwise(0)).alias(c) for c in _SUMS]
    repeat = 1 << FILTERS.index("E")
    both = F.explode(F.array(
        F.struct("mask", *stays),
        F.struct((F.col("mask") + repeat).alias("mask"), *((F.col(c) - s).alias(c) for c, s in zip(_SUMS, stays))),
    ))
    out = parts.select("part", both.alias("row")).select("part", "row.*").where("n > 0")
    return out.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in _SUMS))


def _orders(spark: SparkSession, filters: str) -> DataFrame:
    size = len(filters)
    rows = [(rank, step + 1, f, "".join(filters[i] for i in order)) for rank, order in enumerate(permutations(range(size))) for step, f in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, step int, filter int, filter_order string")


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each step of each order of the filters removes, for every part of ``counts`` (part, mask, n, good, toxic).

    Each mask is added at the ends of the intervals of orders that remove it at one step; running sums over the ranks
    give the totals of every order. All tables but ``counts`` are of the size of parts times orders; the broadcast
    ones depend on the number of filters alone (at most 6). A part without any removal has rows of zeros; no parts,
    no rows. Returns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    size = len(filters)
    if not 0 < size <= 6:
        raise ValueError("between 1 and 6 filters")
    spark, last = counts.sparkSession, factorial(size)
    steps = spark.createDataFrame(removal_intervals(size), "mask int, step int, start int, stop int")
    ends = F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign"))))
    ends = counts.join(F.broadcast(steps), "mask").select("part", "step", *_SUMS, ends.alias("end")).where(F.col("end.rank") < last)
    ends = ends.select("part", "step", "end.rank", *((F.col(c) * F.col("end.sign")).alias(c) for c in _SUMS))
    fails = lambda f: F.sum(F.when(F.col("mask").bitwiseAND(1 << f) != 0, F.col("n")).otherwise(0))
    alone = lambda f: F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0))
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("all"), F.array(*map(fails, range(size))).alias("fails"), F.array(*map(alone, range(size))).alias("alone")
    )
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(last - 1))).alias("rank"))
    ends = ends.unionByName(grid.select("*", *(F.lit(0).cast("long").alias(c) for c in _SUMS)))
    ends = ends.groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in _SUMS))
    upto = Window.partitionBy("part", "step").orderBy("rank")
    removed = ends.select("part", "step", "rank", *(F.sum(c).over(upto).alias(c) for c in _SUMS))
    rows = removed.join(F.broadcast(_orders(spark, filters)), ["rank", "step"]).join(parts, "part")
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))
    return rows.select(
        "part", "filter_order", "step", (F.col("all") - gone).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails")[F.col("filter")] - F.col("n")).alias("redundant"), F.col("alone")[F.col("filter")].alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Audit of the five filters over whole documents, in all 120 orders and for every part.

    One scan of the texts; what is shuffled are checksums, masks and counts, which copies of a text share. See
    ``mask_counts`` for nulls, repeated rows and ties, ``audit_orders`` for the columns. Extra columns are ignored; an
    empty table gives an empty result.
    """
    return audit_orders(materialize(mask_counts(docs, labels, id_col, text_col, part_col), "masks"))
