"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame functions only.

The rows that one task reads are a run; its entries (digest, smallest row, number of rows) are unique and sorted by digest.
In every round ``fan`` neighbouring runs become one: they are exchanged by run and digest, sorted, merged, and of equal
digests the smallest identifier stays. A digest that a third of all rows share thus meets ``fan`` entries at a time, never
its rows; after the last round one entry a digest is left, spread over all tasks by digest.

Equal digests are not believed. The texts of repeated digests go through the same rounds with the whole text as part of the
entry, so entries merge only where the texts agree, at every level. A digest that stands for several texts is taken apart by
its texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyse.llm.staging import staged
from tabulyse.llm.words import named

#: What is neither a single blank nor a printed character: runs that become one blank.
_SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """Every run of white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def merged_runs(entries: DataFrame, keys: list[str], runs: int = 512, fan: int = 8) -> DataFrame:
    """One row per distinct ``keys`` of ``entries`` (run, keys, least, n): the smallest ``least`` and the sum of ``n``.

    ``run`` numbers the run an entry belongs to, from 0; numbers count modulo ``runs``. The first round makes the runs
    themselves, merging inside each task before anything is exchanged; every later one merges ``fan`` of them.
    """
    level = entries.withColumn("run", F.pmod(F.col("run"), F.lit(runs)).cast("int"))
    while True:
        level = level.groupBy("run", *keys).agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        if runs == 1:
            return level.drop("run")
        runs = -(-runs // fan)
        level = level.withColumn("run", F.floor(F.col("run") / fan).cast("int"))


def with_copies(df: DataFrame, key: str, text: str, columns: list[str] | None = None, digest: Callable[[Column], Column] = sha256, runs: int = 512, fan: int = 8, most: int = 200_000) -> DataFrame:
    """Per row: ``key``, ``columns``, ``keep_id`` (the smallest key of the rows with an equal text), ``group_size``, ``kept``
    (true for just one row of a group, one with that key), and ``digest`` of the normalised text.

    Null texts count as empty ones. Null keys come last, so keep_id is null only if all keys of a group are. Repeated rows
    come back repeated, one of them kept. An empty table gives an empty table; names of other columns don't matter.
    Any ``digest`` gives the same groups. ``most`` only chooses how the repeated digests reach the texts: by broadcast up to
    so many, else by a join that shuffles.
    """
    others = [c for c in columns or [] if c != key]
    kept = [f"c{i}" for i in range(len(others))]
    spelled = df.select(named(key).alias("key"), *(named(c).alias(k) for c, k in zip(others, kept)), normalised(named(text)).alias("text"))
    texts = spelled.withColumn("digest", digest(F.col("text")))
    rows = staged(texts.drop("text").withColumn("row", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id()), "digests")
    least = F.struct(F.col("key").isNull().alias("last"), "key", "row").alias("least")
    classes = staged(merged_runs(rows.select("run", "digest", least, F.lit(1).cast("long").alias("n")), ["digest"], runs, fan), "classes")
    repeated = classes.where("n > 1").select("digest")
    met = texts.select("digest", "text").join(F.broadcast(repeated) if repeated.count() <= most else repeated, "digest", "left_semi")
    met = met.select(F.spark_partition_id().alias("run"), "digest", "text", F.lit(1).alias("least"), F.lit(1).cast("long").alias("n"))
    proved = merged_runs(met, ["digest", "text"], runs, fan)
    mixed = staged(proved.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "mixed-digests")
    found = _placed(rows, classes, ["digest"])
    if not mixed.isEmpty():
        apart = staged(texts.join(mixed, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id()), "mixed-rows")
        own = merged_runs(apart.select("run", "digest", "text", least, F.lit(1).cast("long").alias("n")), ["digest", "text"], runs, fan)
        found = found.join(mixed, "digest", "left_anti").unionByName(_placed(apart, own, ["digest", "text"]))
    return found.select("key", *kept, "keep_id", "group_size", "kept", "digest").toDF(key, *others, "keep_id", "group_size", "kept", "digest")


def _placed(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with what its class keeps."""
    met = rows.join(classes, keys).withColumn("keep_id", F.col("least.key")).withColumn("kept", F.col("row") == F.col("least.row"))
    return met.withColumnRenamed("n", "group_size").drop("run", "row", "least", "text")
