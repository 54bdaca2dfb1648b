"""URL filters: given rules by host and path, and rules that FP-growth mines from labelled pages.

A URL is a set of tokens: host labels, the registered ending, path segments with numbers made alike, and names of query
parameters. FP-growth finds the token combinations that labelled pages share with the label ``block``; those with enough
support, that are surer than the share of bad pages by far and not by chance, and no shorter one as sure, become rules. A rule stands in an inverted index under its rarest
token, so a URL meets few rules, and is checked against all its tokens there. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulyse.llm.staging import staged
from tabulyse.llm.words import named

#: (host, path, verdict); a rule holds for the host, all its subdomains, and every path that starts with its own.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BLOCK = "label:block"
LEAST_SUPPORT = 0.002
LEAST_COUNT = 10
#: A rule's confidence is at least so many times the share of bad pages; where that is above a third, halfway from it to 1.
LEAST_LIFT = 2.0
#: And it is above that share by so many standard errors of the rule's pages, which thousands of combinations don't reach by chance.
LEAST_ERRORS = 4.0


def document(url: Column) -> Column:
    """The number of the document that a page shows: that of the last path segment, an ending aside; null if it is none."""
    return F.regexp_extract(path(url), r"/([0-9]+)(?:\.[A-Za-z]+)?/?$", 1).try_cast("bigint")


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    """Up to the first slash, question mark or number sign after the scheme, A-Z lower-cased; empty without a scheme."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the first slash after the host to a question mark, number sign or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; empty for null."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    ending = F.array_join(F.slice(labels, -2, 2), ".")
    segments = F.transform(F.filter(F.split(path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(_after_scheme(url), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    ends = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), ends, segments, names)
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def mined_rules(baskets: DataFrame, support: float = LEAST_SUPPORT, least: int = LEAST_COUNT, confidence: float | None = None) -> DataFrame:
    """(rule array<string>, confidence, support, token): combinations that imply ``BLOCK``; ``token`` is the rarest of each.

    ``baskets`` has one array ``items`` per labelled page, tokens and, where it holds, ``BLOCK``. Rules need the larger of
    ``support`` (share of the baskets) and ``least`` baskets. Their confidence is judged against the share of baskets with
    ``BLOCK``, by ``LEAST_LIFT`` and ``LEAST_ERRORS``; or, where it is given, by ``confidence`` alone. A rule goes if a part of
    it is as sure. Of tokens equally rare, the smallest stands for the rule. No baskets, or none with ``BLOCK``, give no
    rules; repeated baskets count each; ``items`` are distinct and not null. Other columns are not read, whatever their names.
    """
    many, bad = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    spark = baskets.sparkSession
    if not bad:
        return spark.createDataFrame([], "rule array<string>, confidence double, support double, token string")
    usual = bad / many
    wanted = min(LEAST_LIFT * usual, (1 + usual) / 2) if confidence is None else confidence
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / many)), minConfidence=wanted).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK)).select(F.array_sort("antecedent").alias("rule"), "confidence", "support")
    if confidence is None:
        pages = F.col("support") * many / F.col("confidence")
        rules = rules.where((F.col("confidence") - usual) * F.sqrt(pages) > LEAST_ERRORS * (usual * (1 - usual)) ** 0.5)
    rules = staged(rules, "url-rules")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("rule", F.explode("rule").alias("token")).join(often, "token").groupBy("rule").agg(F.min(F.struct("freq", "token")).alias("rarest"))
    indexed = staged(rules.join(rarest, "rule").select("rule", "confidence", "support", F.col("rarest.token").alias("token")), "url-index")
    parts = indexed.select(F.col("rule").alias("part"), F.col("confidence").alias("sure"), "token")
    wholes = indexed.select("rule", "confidence", F.explode("rule").alias("token")).join(parts, "token")
    implied = wholes.where((F.size("part") < F.size("rule")) & (F.size(F.array_except("part", "rule")) == 0) & (F.col("sure") >= F.col("confidence")))
    return staged(indexed.join(implied.select("rule").distinct(), "rule", "left_anti"), "url-rules")


def _matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule): the surest rule whose tokens a URL has, through the index of rarest tokens."""
    tokened = urls.select("url", tokens(F.col("url")).alias("tokens"))
    met = tokened.select("url", "tokens", F.explode("tokens").alias("token")).join(rules, "token")
    whole = met.where(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.array_join("rule", " ").alias("rule"))).alias("best")
    return whole.groupBy("url").agg(best).select("url", F.col("best.rule").alias("mined_rule"))


def given_rule(host_name: Column, url_path: Column, rules=RULES) -> Column:
    """The longest given rule that fits, as struct(rule, verdict); null if none does."""
    fits = [
        F.when(((host_name == h) | host_name.endswith("." + h)) & url_path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def judged(df: DataFrame, url: str, columns: list[str], mined: DataFrame, rules=RULES) -> DataFrame:
    """``columns`` of every row, host, path, rule (the given rule, null if none), verdict and mined_rule (null if none).

    The verdict is the given rule's; else ``block`` if a mined rule matches; else ``allow``. Null URLs and URLs without
    ``://`` have empty host and path, no tokens and are allowed. Equal URLs are matched once; repeated rows come back
    repeated. An empty table gives an empty table. Names of other columns don't matter.
    """
    kept = [f"_{i}" for i in range(len(columns))]
    rows = df.select(*(named(c).alias(k) for c, k in zip(columns, kept)), named(url).alias("url"))
    found = _matched(rows.select("url").where("url IS NOT NULL").distinct(), mined)
    placed = rows.join(found, "url", "left").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    ruled = placed.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    out = ruled.select(*kept, "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")
    return out.toDF(*columns, "host", "path", "rule", "verdict", "mined_rule")
