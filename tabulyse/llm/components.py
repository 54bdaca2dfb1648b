"""Connected components of a link table, by alternating star rewrites, entirely as joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.llm.staging import merging, staged

PARTS = 256


def _dealt(links: DataFrame) -> DataFrame:
    """The links, those of each ``u`` dealt in parts: a hub may have a third of all."""
    return links.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))


def _least(dealt: DataFrame) -> DataFrame:
    """(u, part, m): the smallest neighbour of each ``u``, told to each of its parts. One row a part goes to the node."""
    told = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    return told.select("u", "part", F.min("m").over(Window.partitionBy("u")).alias("m"))


def _stars(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node around it (u > v in the result)."""
    both = _dealt(links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = _least(both).select("u", "part", F.least("u", "m").alias("m"))
    return merging(both.where(F.col("v") > F.col("u"))).join(least, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _drawn_in(links: DataFrame) -> DataFrame:
    """A node's neighbours below it, and itself, are linked to the smallest of them. Takes links with u > v."""
    links = _dealt(links)
    least = _least(links)
    moved = merging(links).join(least, ["u", "part"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(mark)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v long) but the roots; the root is the smallest node of its component.

    Links may repeat, point either way or to themselves. Each round is written to the shared folder, and
    the driver sees one count and one checksum of it. A component of any size takes a few rounds (their
    number grows with the logarithm of the longest path); the links of hub nodes are dealt in parts, and no
    join sends a table to the driver. An empty table gives an empty table.
    """
    links = staged(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(links)
    while before[0]:
        links = staged(_drawn_in(_stars(links)), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
