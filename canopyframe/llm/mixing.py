"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, uniform

#: Documents that one fold of the reduction tree takes together; a level leaves at most one in so many.
FAN_IN = 128


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of the sources: ``share`` of all sizes split by weight, none above ``cap`` times its source.

    sizes: (source, source_size, n). Weights repeat over the sources by code point, null last. What a capped
    source cannot take is shared by weight among the others until none is above its cap: with the sources in
    order of cap/weight, a source is capped if the level left for it and the later ones reaches its own.
    One row per source throughout.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("w", F.element_at(turn, (F.row_number().over(every) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("top", cap * F.col("source_size")).withColumn("at", F.col("top") / F.col("w"))
    before = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (
        F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("at") <= F.col("level"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("top")).otherwise(free * F.col("w"))).select(
        "source", "source_size", "n", "target"
    )


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of (size, key, id, base, mass, u): the carried document and the next one
    exchange words until one of the two is wholly in or out. The expected mass of each and the sum of both stay."""
    fate = "struct<size:bigint,key:bigint,id:bigint,base:int,copies:int,mass:double>"
    nobody = F.lit(None).cast(fate)

    def fate_of(x: Column, mass: Column, copies) -> Column:
        return F.struct(x["size"].alias("size"), x["key"].alias("key"), x["id"].alias("id"), x["base"].alias("base"), copies.cast("int").alias("copies"), mass.alias("mass")).cast(fate)

    def settled(x: Column, mass: Column) -> Column:
        return (mass <= 1e-9 * x["size"]) | (mass >= (1 - 1e-9) * x["size"])

    def meet(s: Column, x: Column) -> Column:
        c = s["carry"]
        down, up = F.least(c["mass"], x["size"] - x["mass"]), F.least(c["size"] - c["mass"], x["mass"])

        def moved(t: Column) -> Column:
            cm, xm = c["mass"] + t, x["mass"] - t
            c_done, x_done = settled(c, cm), settled(x, xm)
            mine = fate_of(c, cm, F.when(c_done, (cm * 2 > c["size"]).cast("int")))
            other = fate_of(x, xm, F.when(x_done, (xm * 2 > x["size"]).cast("int")))
            left = F.when(~c_done, mine).when(~x_done, other).otherwise(nobody)
            return F.struct(left.alias("carry"), F.concat(s["out"], F.filter(F.array(mine, other), lambda f: f["copies"].isNotNull())).alias("out"))

        begin = F.struct(fate_of(x, x["mass"], F.lit(None)).alias("carry"), s["out"].alias("out"))
        return F.when(c.isNull(), begin).otherwise(_let(F.when(x["u"] * (down + up) < up, -down).otherwise(up), moved))

    start = F.struct(nobody.alias("carry"), F.array().cast(f"array<{fate}>").alias("out"))
    done = F.aggregate(items, start, meet)
    return F.concat(done["out"], F.filter(F.array(done["carry"]), lambda f: f.isNotNull()))


def _with_turns(rows: DataFrame) -> DataFrame:
    """rows with ``turn``, from 1, among those with one ``row`` hash: each task's follow those of the tasks before it."""
    counts = rows.groupBy("row", "task").agg(F.count(F.lit(1)).alias("c"))
    earlier = F.sum("c").over(Window.partitionBy("row").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("earlier", earlier).where("earlier is not null or c > 1")
    own = F.row_number().over(Window.partitionBy("row", "task").orderBy("size"))
    several = rows.join(counts.drop("c"), ["row", "task"], "left").withColumn("turn", own + F.coalesce("earlier", F.lit(0)))
    return several.select("id", "name", "size", "row", "turn")


def mix_sources(
    docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Whole copies of documents such that each source's words come to its target.

    A source's documents start with the same fractional number of copies, target / size. Whole copies are kept;
    the fractional parts are rounded by pairs that exchange words at random until one is integral (pivotal
    sampling), inside groups of about ``FAN_IN`` documents dealt by hash, then among what these leave, and so
    on: a reduction tree in which a hot source only has more groups. Large documents meet first, so that what
    remains at the root, the only deviation from the target, is small. Draws depend on the seed, on id, source and
    text, and among rows equal in these on their turn, so reruns agree under any partitioning.

    Size is the number of words of the text (null: 0). Documents without words take nothing. Null sources form
    one source, last in order. Rows with a null or repeated id are separate documents. Equal rows take turns, each
    task numbering its own behind those of the tasks before it, so many of them spread over the groups like others. Only
    the three named columns are read. An empty table gives an empty result.

    Returns: id, source, size, source_size, target, copies (0 up to ceil(cap)), taken (copies * size).
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("sum"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = rows.select("id", "source", name, "size", F.xxhash64(F.lit(seed), "id", "name", "size", "sum").alias("row"), F.spark_partition_id().alias("task"))
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n")), weights, share, cap), "targets")
    split = _with_turns(rows).join(targets.select(name, "source_size", "target", "n"), "name")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    split = split.withColumn("base", F.floor(ratio).cast("int")).withColumn("part", ratio - F.floor(ratio))
    split = split.withColumn("key", F.when(F.col("turn") == 1, F.col("row")).otherwise(F.xxhash64("row", "turn")))
    whole = (F.col("size") == 0) | (F.col("part") <= 0)
    decided = [split.where(whole).select("name", "id", "size", F.when(F.col("size") > 0, F.col("base")).otherwise(0).alias("copies"))]

    rest = split.where(~whole).select("name", "n", "size", "key", "id", "base", (F.col("part") * F.col("size")).alias("mass"))
    most = targets.agg(F.max("n")).first()[0] or 0
    level = 0
    while most:
        groups = F.ceil(F.col("n") / F.lit(FAN_IN)).cast("long")
        rest = rest.withColumn("n", groups).withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(level)), F.col("n")))
        item = F.struct("size", "key", "id", "base", "mass", uniform(F.col("key"), F.lit(f"{seed}-{level}")).alias("u"))
        folded = rest.groupBy("name", "n", "bucket").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
        out = materialize(folded.select("name", "n", F.inline(_fold(F.col("items")))), "pivot")
        decided.append(out.where("copies is not null").select("name", "id", "size", (F.col("base") + F.col("copies")).alias("copies")))
        rest = out.where("copies is null").select("name", "n", "size", "key", "id", "base", "mass")
        level += 1
        if most <= FAN_IN:
            break
        most = -(-most // FAN_IN)
    last = (uniform(F.col("key"), F.lit(f"{seed}-root")) * F.col("size") < F.col("mass")).cast("int")
    decided.append(rest.select("name", "id", "size", (F.col("base") + last).alias("copies")))
    copies = decided[0]
    for more in decided[1:]:
        copies = copies.unionByName(more)
    return copies.join(targets.select(name, "source", "source_size", "target"), "name").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"),
    )
