"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last one also says which copy a row is.
Stages join and filter; none holds documents on the driver. Columns beyond those of ``documents`` go through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulyse.llm.decontaminate import contamination
from tabulyse.llm.mixing import mixed
from tabulyse.llm.pii import masked, with_spans
from tabulyse.llm.quality import with_quality
from tabulyse.llm.simhash import near_duplicates
from tabulyse.llm.staging import merging, staged

#: No SQL: stages compress with zstandard, hash with XXH64 and train a classifier. tests/llm holds them against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with names that no operator gives to its own columns, and these names."""
    names = [f"in_{c}" for c in docs.columns]
    return docs.toDF(*names), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    own, names = _apart(docs)
    return with_quality(own, "in_text", names).where("kept").select(*names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id, then the smallest hash of the text; null ids are last."""
    own, names = _apart(docs)
    key = [F.coalesce(F.col("in_doc_id").cast("string"), F.lit("")).alias("id"), F.col("in_doc_id").isNull().alias("no_id"), F.xxhash64("in_text").alias("mark")]
    own = own.select(*names, *key)
    found = near_duplicates(own, "in_doc_id", "in_text", ["id", "no_id", "mark"])
    first = found.groupBy("component").agg(F.min(F.struct("no_id", "in_doc_id", "id", "mark")).alias("first"))
    first = staged(first.select("first.id", "first.no_id", "first.mark"), "first-of-group")
    same = Window.partitionBy("id", "no_id", "mark").orderBy("id")
    kept = merging(own).join(first, ["id", "no_id", "mark"], "left_semi").withColumn("n", F.row_number().over(same)).where("n = 1")
    return kept.select(*names).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    own, names = _apart(docs)
    found = contamination(own, "in_text", names, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return found.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind; n_chars follows the text."""
    own, names = _apart(docs)
    found = with_spans(own, "in_doc_id", "in_text", names).withColumn("in_text", masked(F.col("in_text"), F.col("spans")))
    if "in_n_chars" in names:
        found = found.withColumn("in_n_chars", F.when(F.size("spans") > 0, F.length("in_text")).otherwise(F.col("in_n_chars")).cast(own.schema["in_n_chars"].dataType))
    return found.select(*names).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, numbered by ``copy``."""
    own, names = _apart(docs)
    drawn = mixed(own, "in_doc_id", "in_source", "in_text", names).where("repeats > 0")
    return drawn.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy")).toDF(*docs.columns, "copy")


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
