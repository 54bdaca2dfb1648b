"""Mixing sources to target weights by capped water-filling.

Every source wants the budget in proportion to its weight, but no more than ``epochs`` times its own size. Sources that
would get more are clamped there and the excess goes to the others by weight, until none is above. Sorted by how soon
they fill (cap over weight), the clamped sources come first; the common level of the rest is what is left of the budget
over what is left of the weights. A source then takes all its documents the whole number of times its target holds, and
for the rest the documents whose seeded hash is smallest, up to the cut at which their words come nearest to the rest.
The cut is found among 4096 hash buckets of the source and then 4096 parts of one of them, so no task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.llm.staging import staged
from tabulyse.llm.words import SPACE_WORDS, named

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def _sort_key(source: Column) -> Column:
    """Never null, and in the order of the sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _mark(key: Column, text: Column, seed: str) -> Column:
    """Six hex digits that depend on the seed, the key and the text alone."""
    whole = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(whole), 1, 6)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """(source_key, source_size, target) from rows (source_key, size): one row per source, in one task.

    Sources in order of their keys weigh as ``weights`` says, over and over. ``share`` of all sizes is dealt out.
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    weighed = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "source_key")
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.sum("source_size").over(everything) * share if share != 1.0 else F.sum("source_size").over(everything)
    level = (budget - before) / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", level.cast("double"))
    # Past the clamped sources the level only falls, so the first one, which holds, is the largest.
    common = F.max(F.when(F.col("fill") > F.col("level"), F.col("level"))).over(everything)
    target = F.when(F.col("fill") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * common)
    return levels.select("source_key", "source_size", target.alias("target"))


def _first_above(sums: DataFrame, bucket: str) -> DataFrame:
    """Per source the first bucket at which the running sum passes ``rest``, with the sum before it (``passed``)."""
    running = Window.partitionBy("source_key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.col("passed") + F.sum("words").over(running)).where(F.col("upto") > F.col("rest"))
    first = F.min(F.struct(bucket, (F.col("upto") - F.col("words")).alias("passed"), "words"))
    return run.groupBy("source_key", "source_size", "target", "whole", "rest").agg(first.alias("cut")).select("source_key", "source_size", "target", "whole", "rest", "cut.*")


def picks(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """One row per source: its target, whole repetitions, and the mark up to which documents come once more.

    ``sizes`` holds source_key, size, mark of all documents and is read four times: write it first.
    """
    plan = targets(sizes, weights, epochs, share).withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = staged(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    coarse = sizes.groupBy("source_key", F.substring("mark", 1, 3).alias("bucket")).agg(F.sum("size").alias("words"))
    crossed = _first_above(coarse.join(plan, "source_key").withColumn("passed", F.lit(0).cast("long")), "bucket")
    crossed = staged(crossed.withColumnRenamed("words", "bucket_words"), "mix-bucket")
    inside = sizes.withColumn("bucket", F.substring("mark", 1, 3)).join(crossed.select("source_key", "bucket"), ["source_key", "bucket"])
    fine = inside.groupBy("source_key", "mark").agg(F.sum("size").alias("words"))
    cut = _first_above(fine.join(crossed.drop("bucket", "bucket_words"), "source_key"), "mark")
    nearest = (2 * (F.col("rest") - F.col("passed")) >= F.col("words")).alias("inclusive")
    cut = cut.select("source_key", F.col("mark").alias("cut"), nearest)
    return staged(plan.join(cut, "source_key", "left").drop("rest"), "mix-picks")


def mixed(df: DataFrame, key: str, source: str, text: str, columns: list[str], weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """``columns`` of every row, and size, source_size, target (its source's), repeats (times the mix takes it), taken (words).

    Null texts have size 0; null sources are one source, the last; a source without words has target 0 and is not taken.
    No row is taken more than ``epochs`` times, rows without words included.
    Rows that share key and text are drawn alike, null keys included. An empty table gives an empty table. Names of other
    columns don't matter. Runs over the same rows agree, whatever their order or partitions. The table of sources is
    broadcast only while Spark finds it below spark.sql.autoBroadcastJoinThreshold; beyond, it is joined.
    """
    kept = [f"_{i}" for i in range(len(columns))]
    body = [_sort_key(named(source)).alias("source_key"), _size(named(text)).alias("size"), _mark(named(key), named(text), seed).alias("mark")]
    sizes = staged(df.select(*body), "mix-sizes")
    rows = df.select(*(named(c).alias(k) for c, k in zip(columns, kept)), *body)
    more = F.coalesce((F.col("mark") < F.col("cut")) | (F.col("inclusive") & (F.col("mark") == F.col("cut"))), F.lit(False))
    repeats = F.when(F.col("source_size") > 0, F.least(F.col("whole") + more.cast("long"), F.lit(epochs))).otherwise(0).cast("long")
    joined = rows.join(picks(sizes, weights, epochs, share), "source_key")
    out = joined.select(*kept, "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))
    return out.toDF(*columns, "size", "source_size", "target", "repeats", "taken")
