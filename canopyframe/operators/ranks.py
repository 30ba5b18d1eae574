"""Exact ranks and percentiles of any number of groups of any size, by counting digits of sortable numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import col, small

def coarse(value, bits: int) -> Column:
    """A double rounded to 53 - bits significant bits, in the order of the values, by three operations."""
    v = col(value)
    near = lambda x: x * float((1 << bits) + 1) - (x * float((1 << bits) + 1) - x)
    return F.when(F.abs(v) < 2.0**900, near(v)).when(F.abs(v) == float("inf"), v).otherwise(near(v * 2.0**-100) * 2.0**100)


#: Digits of doubles: 12 significant bits with sign and exponent, 32 bits, the value.
DOUBLES = (lambda v: coarse(v, 41), lambda v: coarse(v, 21), lambda v: v)
#: Digits of whole numbers: 24 bits, 44 bits, the number.
LONGS = (lambda v: F.shiftright(v, 40), lambda v: F.shiftright(v, 20), lambda v: v)
#: Rows below one digit that are told apart by their keys at once, without a digit between.
_FEW = 1_000_000


def _equal(keys, left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in keys], F.lit(True))


def _counted(rows: DataFrame, parts, digit: Column) -> DataFrame:
    """Rows of each digit in each part, and of all smaller digits of the part."""
    counts = rows.groupBy(*parts, digit.alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
    return small(counts).withColumn("_before", F.sum("_n").over(Window.partitionBy(*parts).orderBy("_next")) - F.col("_n"))


def _narrowed(found: DataFrame, counts: DataFrame, keys, parts) -> DataFrame:
    both = found.alias("f").join(counts.alias("c"), _equal(parts, "f", "c"))
    both = both.where((F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n")))
    return both.select(*[F.col(f"f.{c}").alias(c) for c in keys], "rank", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_next").alias("_digit"), "_n")


def _selected(rows: DataFrame, keys, wanted: DataFrame, key: str, digits, counts: DataFrame) -> DataFrame:
    """``select_ranks`` from the counts of the first digit on."""
    found, used = small(_narrowed(wanted.select(*keys, "rank", F.col("rank").alias("_left")), counts, keys, keys)), digits[0]
    for digit in digits[1:]:
        if digit is not digits[-1] and (found.agg(F.max("_n")).first()[0] or 0) <= _FEW:
            continue
        held = small(found.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], F.col("_digit").alias("_h")).distinct())
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(keys)], F.col("_digit") == F.col("_h"))
        here, parts = rows.select(*keys, key, used(F.col(key)).alias("_digit")).join(held, same, "left_semi"), [*keys, "_digit"]
        found, used = small(_narrowed(found.drop("_n"), _counted(here, parts, digit(F.col(key))), keys, parts)), digit
    return found.select(*keys, "rank", F.col("_digit").alias(key))


def select_ranks(rows: DataFrame, by, wanted: DataFrame, key: str = "_k", digits=DOUBLES) -> DataFrame:
    """The key at wanted ranks (from 0) of each group. rows: by, key; wanted: by, rank. Returns by, rank, key.

    One pass for each of ``digits``, functions of the key in its order, from coarse to the key itself: the first
    counts the coarsest digit in every group, each next one a finer digit of only those rows that share a wanted rank's
    digit so far; the middle one is left out where few rows share it. Counts are summed in each task before they are
    shuffled, so no task holds a group and no buffer grows with one: what is sorted are the digits of a group, at most
    2^24 of them. Tables of digits are broadcast while they are few; each pass runs when the plan is built.
    """
    keys = list(by)
    return _selected(rows, keys, wanted, key, digits, _counted(rows, keys, digits[0](F.col(key))))


def percentiles(df: DataFrame, by, value: str, shares, discrete: bool = False, name: str = "q") -> DataFrame:
    """Exact percentiles of each group: by, and an array of one value a share, in the order of ``shares``.

    Interpolated between the two values around p * (n - 1), or with ``discrete`` the first value with a cumulative share
    of p or more. Null and NaN are left out; a group of nothing else has no row; null groups count as one group. Equal
    values, infinities and both zeros have their place. Two passes over df in most cases, three at most.
    """
    keys = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_k"))
    counts = _counted(rows, keys, DOUBLES[0](F.col("_k")))
    n = counts.groupBy(*keys).agg(F.sum("_n").alias("_all")).where("_all > 0")

    def place(p):
        return F.greatest(F.ceil(F.lit(float(p)) * F.col("_all")), F.lit(1)) - 1 if discrete else F.lit(float(p)) * (F.col("_all") - 1)

    ends = [f(place(p)).cast("long") for p in shares for f in (F.floor, F.ceil)]
    wanted = n.select(*keys, F.explode(F.array_distinct(F.array(*ends))).alias("rank"))
    found = _selected(rows, keys, wanted, "_k", DOUBLES, counts)
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_k"))).alias("_m"))  # two entries a share at most
    both = n.alias("n").join(at.alias("a"), _equal(keys, "n", "a"))

    def of(p):
        h, low, high = place(p), F.element_at("_m", F.floor(place(p)).cast("long")), F.element_at("_m", F.ceil(place(p)).cast("long"))
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return both.select(*[F.col(f"n.{c}").alias(c) for c in keys], F.array(*map(of, shares)).alias(name))


def with_percentiles(summary: DataFrame, df: DataFrame, by, value: str, names: dict[str, float]) -> DataFrame:
    """Adds named percentiles of each group to a summary of one row a group; NULL where a group has no values."""
    q = percentiles(df, by, value, list(names.values()))
    keys = list(by)
    out = summary.alias("s").join((q if keys else F.broadcast(q)).alias("q"), _equal(keys, "s", "q"), "left")
    return out.select("s.*", *[F.col("q.q")[i].alias(c) for i, c in enumerate(names)])
