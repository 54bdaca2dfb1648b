"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are made once per document inside Arrow batches. Equal fingerprints collapse to one node before
anything is linked, so a group of exact copies costs one row. Nodes meet in ``2 ** (radius + 1) - 1`` tables;
table v keeps the bits whose vector has an odd product with v. Any ``radius`` differing bits have vectors of
rank ``radius`` at most, so some v is orthogonal to all of them, and that table keeps none of those bits: every
pair within the radius meets at least once. The check of the distance follows.

A bucket of up to ``bucket`` fingerprints is compared inside one task and leaves a spanning star. Larger ones go
another, equally exact way, linear in their size: two fingerprints lie within ``radius`` just if they share a
point within half the radius of each, so grouping by those points links them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.llm.components import components
from tabulyse.llm.staging import merging, ships, staged
from tabulyse.llm.words import per_text

ships(__name__)

BITS = 64
PARTS = 256


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles, A-Z lower-cased; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    size = min(shingle, len(words))
    pieces = [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    digests = b"".join(map(xxhash.xxh64_digest, pieces, repeat(seed)))
    ones = np.zeros(BITS, np.int64)
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for k in range(0, len(hashes), 1 << 16):  # memory stays bounded on very long texts
        ones += np.unpackbits(hashes[k : k + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(df: DataFrame, text: str, columns: list[str], shingle: int = 4) -> DataFrame:
    """``columns`` of the table and the long ``fingerprint`` (two's complement) of ``text``."""

    def produce(texts: list[bytes | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return per_text(df, text, columns, "fingerprint long", produce)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask per nonzero vector v of radius + 1 bits: bit i is kept if v and i's vector share an odd number of ones.

    Vectors are dealt to the bits in turn, so every mask keeps about half of the bits.
    """
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _linked(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A star for every set of fingerprints that steps within the radius connect."""
    if len(prints) == 2:
        a, b = (int(x) for x in prints)
        return [(b, a)] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius else []
    left, links = np.sort(prints), []
    while len(left):
        root, reached, left = left[0], left[:1], left[1:]
        while len(reached) and len(left):
            near = np.zeros(len(left), bool)
            for part in np.array_split(reached, -(-len(reached) // 64)):
                near |= (np.bitwise_count((part[:, None] ^ left[None, :]).view(np.uint64)) <= radius).any(0)
            reached, left = left[near], left[~near]
            links += [(int(x), int(root)) for x in reached]
    return links


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, ends = np.asarray(column.flatten()), np.asarray(column.offsets) - column.offsets[0].as_py()
            links = [x for a, b in zip(ends[:-1], ends[1:]) for x in _linked(values[a:b], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"])

    return run


def fingerprint_links(nodes: DataFrame, radius: int = 4, bucket: int = 1024) -> DataFrame:
    """Links (u, v) between the distinct longs of ``nodes`` (column fingerprint) that connect all pairs within ``radius`` bits.

    Not every pair is listed: a bucket leaves a star for each set that steps within the radius connect, so a link may join
    the ends of several steps. ``bucket`` only chooses between two exact ways.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))))
    dealt = nodes.select("fingerprint", F.explode(tables).alias("at")).select("at.t", "at.key", "fingerprint")
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = merging(dealt).join(sizes, ["t", "key"])
    small = met.where(F.col("size") <= bucket).groupBy("t", "key").agg(F.collect_list("fingerprint").alias("prints")).select("prints")
    close = small.mapInArrow(_bucket_links(radius), "u long, v long").distinct()
    crowded = staged(met.where(F.col("size") > bucket).select("fingerprint").distinct(), "crowded")
    return close if crowded.isEmpty() else close.unionAll(_by_midpoints(crowded, radius))


def _by_midpoints(prints: DataFrame, radius: int) -> DataFrame:
    """Links between longs that share a point within half the radius (rounded up and down, so the two sum to it)."""

    def points(reach: int) -> DataFrame:
        found = prints.select("fingerprint", F.col("fingerprint").alias("point"))
        for _ in range(reach):  # one more bit flipped, or none
            step = F.explode(F.expr("transform(sequence(0, 64), i -> point ^ if(i = 64, 0L, shiftleft(1L, i)))"))
            found = found.select("fingerprint", step.alias("point")).distinct()
        return found

    near, far = points(radius // 2), points(radius - radius // 2)
    hubs = near.groupBy("point").agg(F.min("fingerprint").alias("hub"))
    return merging(far).join(hubs, "point").where("fingerprint != hub").select(F.col("fingerprint").alias("u"), F.col("hub").alias("v")).distinct()


def _with_least(placed: DataFrame, parts: int = PARTS) -> DataFrame:
    """(fingerprint, component_id, root): the smallest ``least`` of all nodes of a root. Nulls are never the smallest.

    A component may hold a third of all nodes, so these are dealt by root and one of ``parts`` parts. Only one row a part,
    its smallest, goes to the root, and comes back to the part. ``parts`` changes no result.
    """
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.lit(parts)))
    told = dealt.groupBy("root", "part").agg(F.min("least").alias("least"))
    told = told.select("root", "part", F.min("least").over(Window.partitionBy("root")).alias("component_id"))
    return merging(dealt).join(told, ["root", "part"]).select("fingerprint", "component_id", "root")


def near_duplicates(df: DataFrame, key: str, text: str, columns: list[str] | None = None, shingle: int = 4, radius: int = 4, bucket: int = 1024) -> DataFrame:
    """Per row: ``key``, ``columns``, ``fingerprint`` (16 hex digits), ``component_id``, the smallest key reachable over
    fingerprints that differ in at most ``radius`` bits, and ``component``, one fingerprint of the component.

    Null and wordless texts have fingerprint zero and are linked like any other; a text below ``shingle`` words is one
    shingle. Null keys take part but are never the smallest (component_id is null if a component has no other).
    Repeated rows come back repeated. An empty table gives an empty table. Names of other columns don't matter.
    """
    others = [c for c in columns or [] if c != key]
    prints = staged(with_fingerprints(df, text, [key, *others], shingle).toDF("key", *(f"c{i}" for i in range(len(others))), "fingerprint"), "fingerprints")
    nodes = staged(prints.groupBy("fingerprint").agg(F.min("key").alias("least")), "nodes")
    roots = components(fingerprint_links(nodes, radius, bucket))
    placed = merging(nodes).join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    classes = staged(_with_least(placed), "classes")
    digits = [F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("fingerprint", "root")]
    found = merging(prints).join(classes, "fingerprint").select("key", *(f"c{i}" for i in range(len(others))), digits[0], "component_id", digits[1])
    return found.toDF(key, *others, "fingerprint", "component_id", "component")
