"""One query per operator over its whole tables, with production parameters, in the result form they are checked in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyse.llm.alignment import with_links
from tabulyse.llm.chat import formatted, read_back
from tabulyse.llm.decontaminate import contamination
from tabulyse.llm.exact_dedup import with_copies
from tabulyse.llm.language import HELD_OUT, fit, remainder, with_language
from tabulyse.llm.mixing import mixed
from tabulyse.llm.pii import KINDS, listed, with_spans
from tabulyse.llm.quality import with_quality
from tabulyse.llm.repeats import without_repeats
from tabulyse.llm.simhash import near_duplicates
from tabulyse.llm.spelling import spelling_variants
from tabulyse.llm.token_counts import histogram
from tabulyse.llm.url_rules import BLOCK, document, judged, mined_rules, tokens


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(_table(spark, sf, "documents"), "doc_id", "source", "text", ["doc_id"]).drop("repeats")


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(_table(spark, sf, "documents"), "text", ["doc_id"], _table(spark, sf, "benchmark"), "item_id", "text")
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op3_chat(spark: SparkSession, sf: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{probe}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{probe}'")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(formatted(rows, "conv_id", "turn", "role", "text")).withColumnRenamed("conv", "conv_id")


def op4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(_table(spark, sf, "documents"), "text")


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    documents = _table(spark, sf, "documents")
    rest = remainder(F.col("doc_id"))
    model = fit(documents, "text", "lang", rest != HELD_OUT[1])
    out = F.coalesce(rest == HELD_OUT[1], F.lit(False))
    return with_language(documents, "text", ["doc_id"], model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    return with_quality(_table(spark, sf, "documents"), "text", ["doc_id"])


def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages, labels = _table(spark, sf, "pages"), _table(spark, sf, "labels")
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    known = pages.join(bad, document(F.col("url")) == bad["doc_id"])
    items = F.when(F.col("bad"), F.concat(tokens(F.col("url")), F.array(F.lit(BLOCK)))).otherwise(tokens(F.col("url")))
    return judged(pages, "url", ["page_id"], mined_rules(known.select(items.alias("items"))))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"), "doc_id", "text")


def op9_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = without_repeats(_table(spark, sf, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = with_spans(_table(spark, sf, "documents"), "doc_id", "text", ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(_table(spark, sf, "documents"), "doc_id", "text")


def op12_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = with_copies(_table(spark, sf, "documents"), "doc_id", "text")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return with_links(_table(spark, sf, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat": op3_chat,
    "op4_tokens": op4_tokens,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_url_rules": op7_url_rules,
    "op8_simhash": op8_simhash,
    "op9_repeats": op9_repeats,
    "op10_pii": op10_pii,
    "op11_spelling": op11_spelling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_alignment": op13_alignment,
}
