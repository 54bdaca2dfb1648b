"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans. Four labelers vote on each, for (1), against (-1) or not at all (0): ``form`` (the pattern's own
rules: check digits, ranges, lengths), ``gazetteer`` (endings, issuer digits, calling codes, key prefixes, reserved
addresses), ``context`` (words before the span) and ``edges`` (whether the span is cut out of a longer token).
Expectation-maximisation over the counts of vote patterns, at most 81 rows a kind, estimates for each kind how reliable each
labeler is and how likely each pattern is personal data. With those soft labels a logistic regression is trained on the spans
themselves: beside the votes it sees the words around a span, its shape and its length, hashed, and so tells spans apart that
have equal votes. Features are of one kind each and kinds weigh alike, so however many spans one kind has, it does not decide
on another. It learns from about ``SAMPLE_SPANS`` spans of each kind, chosen by hash. Spans that pass their kind's own rules
(``base``) stay whatever it says; it decides on the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulyse.llm.staging import merging, staged
from tabulyse.llm.words import named

#: Kinds with rules of their own, in the order that breaks ties. ``++`` takes as much as ``+`` would here, without recursion.
#: A match starts where its run of characters does, or (``\G``) where the last match ended: further in, it would fail as it did
#: there, and trying each place of a run would cost the square of its length.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",  # what has fewer digits never passes
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9(+.-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{24,}+",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
LEFT, RIGHT = 48, 8

#: Endings of mail addresses: those of countries have two letters, of the others the common ones.
ENDINGS = r"^(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|cloud|email)$"
#: Calling codes: zones 1 and 7, codes of two digits, and the beginnings of those of three.
CALLING_CODES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69]\d|3[578]\d|42\d|50\d|59\d|6[789]\d|80\d|85\d|8[78]\d|9[679]\d)"
KEY_PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "AKIA", "AIza", "xox")
CUES = {
    "email": "mail|contact|write|courriel|correo",
    "ip": r"\bip\b|address|host|server|login|adresse",
    "card": "card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|whatsapp|telefon|portable|llama",
    "local_phone": r"phone|tel\b|tel\.|call|mobile|fax|whatsapp|telefon|portable|llama",
    "ssn": "ssn|social security|tax id",
    "secret": "token|secret|key|password|passwd|credential|bearer",
}
COUNTER_CUES = r"version|release|page|chapter|isbn|issn|price|order|invoice|figure|table|sha|md5|commit|checksum|hash"
LABELERS = ("form", "gazetteer", "context", "edges")
#: Labelers that know nothing of a kind: that they abstain there says nothing.
SILENT = {"ssn": ("gazetteer",), "local_phone": ("gazetteer",)}
#: Where the estimates start, and what they are held near by ``PRIOR_WEIGHT`` imagined spans: P(vote | class) for votes -1, 0, 1.
START = {
    "form": {1: (0.02, 0.08, 0.90), 0: (0.80, 0.10, 0.10)},
    "gazetteer": {1: (0.10, 0.40, 0.50), 0: (0.30, 0.45, 0.25)},
    "context": {1: (0.05, 0.65, 0.30), 0: (0.20, 0.75, 0.05)},
    "edges": {1: (0.10, 0.05, 0.85), 0: (0.40, 0.05, 0.55)},
}
PRIOR_WEIGHT = 20.0
#: Estimation ends when no probability changes by more than this, or after so many rounds.
SETTLED, MOST_ROUNDS = 1e-3, 40
#: Spans of each kind that the classifier learns from, about; hashed features; and how far from 0 the weights are held.
SAMPLE_SPANS, HASHED_FEATURES, REGULARISATION = 4_000, 1 << 12, 1e-4
THRESHOLD = 0.5


def _hits(documents: DataFrame) -> DataFrame:
    """(doc, mark, kind, start, end, hit, left, right): matches of every pattern, positions in code points.

    What lies between the matches, which split() gives, tells where they are: sums of lengths, over rows and not in one row,
    so a text with very many matches costs in proportion.
    """
    found = documents
    for kind, pattern in PATTERNS.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found = found.withColumn(f"hit_{kind}", F.when(F.contains("text", F.lit(NEEDS[kind])), hits) if kind in NEEDS else hits)
    for kind, pattern in PATTERNS.items():
        found = found.withColumn(f"gap_{kind}", F.when(F.size(f"hit_{kind}") > 0, F.split("text", pattern, -1)))

    def rows(kind: str) -> Column:
        gaps = F.col(f"gap_{kind}")
        each = F.transform(
            f"hit_{kind}",
            lambda hit, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), hit.alias("hit"), F.length(gaps[i]).alias("gap"), F.right(gaps[i], F.lit(LEFT)).alias("left"), F.left(gaps[i + 1], F.lit(RIGHT)).alias("right")
            ),
        )
        return F.when(F.size(f"hit_{kind}") > 0, each).otherwise(F.array().cast("array<struct<kind:string,i:int,hit:string,gap:int,left:string,right:string>>"))

    each = found.select("doc", "mark", F.explode(F.concat(*map(rows, PATTERNS))).alias("at")).select("doc", "mark", "at.*")
    each = each.dropDuplicates(["doc", "mark", "kind", "i"])  # equal rows have equal matches
    upto = Window.partitionBy("doc", "mark", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    return each.select("doc", "mark", "kind", (end - F.length("hit")).alias("start"), end.alias("end"), "hit", "left", "right")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, digit).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(hit: Column) -> Column:
    def fits(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(number) <= 3) & (F.coalesce(number.try_cast("int"), F.lit(256)) <= 255)

    return F.forall(F.split(hit, r"\."), fits)


def _passes() -> Column:
    """Whether a match meets the rules of its kind."""
    hit, kind = F.col("hit"), F.col("kind")
    count = F.length(_digits(hit))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", _octets(hit))
        .when(kind == "card", F.when(count.between(12, 19), _luhn(_digits(hit))).otherwise(False))
        .when(kind == "phone", count.between(9, 15))
        .when(kind == "ssn", ~hit.rlike("^(000|666|9)|-00-|-0000$"))
        .when(kind == "secret", hit.rlike("[0-9].*[0-9].*[0-9]") & hit.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(hit, ""))) >= 10))
        .otherwise(F.lit(True))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(spans: DataFrame) -> DataFrame:
    """The spans with ``base`` and one column per labeler."""
    hit, kind, left, right = (F.col(c) for c in ("hit", "kind", "left", "right"))
    passes = _passes()
    digits = _digits(hit)
    ending = F.lower(F.substring_index(hit, ".", -1))
    known = (
        F.when(kind == "email", ending.rlike(ENDINGS))
        .when(kind == "ip", hit.rlike(r"^(?:0*+[1-9]|0*+[1-9]\d|0*+1\d\d|0*+2[01]\d|0*+22[0-3])\."))
        .when(kind == "card", digits.rlike("^[3-6]"))
        .when(kind == "phone", digits.rlike(CALLING_CODES))
        .when(kind == "secret", F.greatest(*(hit.startswith(p) for p in KEY_PREFIXES)))
        .otherwise(F.lit(False))
    )
    reserved = F.when(kind == "ip", hit.rlike(r"^(0|10|127|255)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.")).when(kind == "card", digits.rlike(r"^([0-9])\1+$")).otherwise(F.lit(False))
    near = F.lower(left)
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, near.rlike(words)).otherwise(cue)
    cut = left.rlike(r"[A-Za-z0-9]$") | right.rlike(r"^[A-Za-z0-9]")
    return (
        spans.withColumn("form", _vote(passes, ~passes))
        .withColumn("gazetteer", _vote(known, reserved))
        .withColumn("context", _vote(cue, near.rlike(COUNTER_CUES) & ~cue))
        .withColumn("edges", _vote(~cut, cut))
        .withColumn("base", kind.isin(*KINDS) & (F.col("form") == 1))
        .withColumn("tokens", _tokens())
    )


def _tokens() -> Column:
    """What the classifier sees of a span beside its votes, each as kind:feature=value: the two words before it and the one
    after, the letters it touches, its shape (9 for digits, a for letters, runs as one) and the size of its length."""
    hit, near = F.col("hit"), F.lower("left")
    words = F.regexp_extract_all(near, F.lit(r"\p{L}{2,}"), F.lit(0))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    told = {
        "before": F.try_element_at(words, F.lit(-1)),
        "before2": F.try_element_at(words, F.lit(-2)),
        "after": F.nullif(F.regexp_extract(F.lower("right"), r"^[^\p{L}]{0,3}(\p{L}{2,})", 1), F.lit("")),
        "touches": F.concat(F.regexp_replace(F.right("left", F.lit(1)), r"\p{L}", "a"), F.lit("_"), F.regexp_replace(F.left("right", F.lit(1)), r"\p{L}", "a")),
        "shape": F.substring(shape, 1, 24),
        "length": F.least(F.floor(F.log2(F.length(hit)) * 2), F.lit(20)).cast("string"),
    }
    return F.array_compact(F.array(*(F.concat(F.col("kind"), F.lit(f":{name}="), value) for name, value in told.items())))


def _voting(kind: str) -> list[str]:
    return [name for name in LABELERS if name not in SILENT.get(kind, ())]


@dataclass
class Reliability:
    """Of the ``many`` spans of one kind: share of personal data, and P(vote | class) of each labeler for votes -1, 0, 1."""

    share: float
    table: dict[str, dict[int, tuple[float, float, float]]]
    many: float = 0.0

    def change(self, other: Reliability) -> float:
        """The largest difference of any probability."""
        pairs = [(p, q) for name in self.table for label in (0, 1) for p, q in zip(self.table[name][label], other.table[name][label])]
        return max(abs(p - q) for p, q in [(self.share, other.share), *pairs])

    def posterior(self) -> Column:
        def weight(label: int, share: float) -> Column:
            out = F.lit(share)
            for name in self.table:
                p = self.table[name][label]
                out = out * F.when(F.col(name) == -1, p[0]).when(F.col(name) == 0, p[1]).otherwise(p[2])
            return out

        yes = weight(1, self.share)
        return yes / (yes + weight(0, 1 - self.share))


def _posterior(rates: dict[str, Reliability]) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == kind, rate.posterior()) for kind, rate in rates.items()))


def estimated_by_kind(patterns: DataFrame, settled: float = SETTLED, rounds: int = MOST_ROUNDS) -> dict[str, Reliability]:
    """Expectation-maximisation over rows (kind, one column per labeler, n), for each kind by itself: each round is one aggregate
    over at most 81 rows a kind. It ends when nothing changes by more than ``settled``."""
    kinds = sorted(r["kind"] for r in patterns.select("kind").distinct().collect())
    now = {kind: Reliability(0.5, {name: START[name] for name in _voting(kind)}) for kind in kinds}
    for _ in range(rounds if kinds else 0):
        before = now.copy()
        soft = patterns.withColumn("p", _posterior(now))
        mass = {1: F.col("n") * F.col("p"), 0: F.col("n") * (1 - F.col("p"))}
        sums = [F.coalesce(F.sum(F.when(F.col(name) == v, mass[label])), F.lit(0.0)).alias(f"{name}_{label}_{v + 1}") for name in LABELERS for label in (0, 1) for v in (-1, 0, 1)]
        for row in soft.groupBy("kind").agg(*sums).collect():
            table = {}
            for name in _voting(row["kind"]):
                table[name] = {}
                for label in (0, 1):
                    counts = [row[f"{name}_{label}_{v}"] + PRIOR_WEIGHT * START[name][label][v] for v in range(3)]
                    table[name][label] = tuple(c / sum(counts) for c in counts)
            yes, no = (sum(row[f"form_{label}_{v}"] for v in range(3)) for label in (1, 0))
            now[row["kind"]] = Reliability((yes + PRIOR_WEIGHT / 2) / (yes + no + PRIOR_WEIGHT), table, yes + no)
        if all(now[k].change(before[k]) <= settled for k in kinds):
            break
    return now


def estimated(patterns: DataFrame) -> Reliability:
    """``estimated_by_kind`` of rows (one column per labeler, n) that are all of one kind, on which every labeler votes."""
    return estimated_by_kind(patterns.withColumn("kind", F.lit("")))[""]


def _featured(spans: DataFrame, kinds: list[str], hashed: int) -> DataFrame:
    """The spans with ``features``: kinds and the votes within each as they are, tokens hashed."""
    votes_of = [(kind, name, v) for kind in kinds for name, v in [("kind", 0), *((name, v) for name in _voting(kind) for v in (-1, 1))]]
    holds = [F.col("kind") == kind if name == "kind" else (F.col("kind") == kind) & (F.col(name) == v) for kind, name, v in votes_of]
    flags = spans.select("*", *(F.when(h, 1.0).otherwise(0.0).alias(f"flag{i}") for i, h in enumerate(holds)))
    hashing = HashingTF(inputCol="tokens", outputCol="hashed", numFeatures=hashed, binary=True)
    names = [f"flag{i}" for i in range(len(holds))]
    return VectorAssembler(inputCols=[*names, "hashed"], outputCol="features").transform(hashing.transform(flags)).drop(*names, "hashed")


def classifier(spans: DataFrame, rates: dict[str, Reliability], sample: int = SAMPLE_SPANS, hashed: int = HASHED_FEATURES) -> LogisticRegressionModel:
    """A logistic regression on the spans' features and soft labels. Every kind has the same weight in all.

    It learns from the spans whose hash falls below ``sample`` of their kind's number; equal ones are one row that weighs more.
    """
    share = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(sample / max(rate.many, 1.0))) for kind, rate in rates.items()))
    lot = F.pmod(F.xxhash64("kind", "doc", "mark", "start"), F.lit(1 << 30)) / (1 << 30)
    some = spans.where(lot < share).groupBy("kind", *LABELERS, "tokens").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("kind"))
    soft = _featured(some.withColumn("share", F.col("n") / total).withColumn("p", _posterior(rates)), list(rates), hashed).select("features", "share", "p")
    yes = soft.select("features", F.lit(1.0).alias("label"), (F.col("share") * F.col("p")).alias("weight"))
    no = soft.select("features", F.lit(0.0).alias("label"), (F.col("share") * (1 - F.col("p"))).alias("weight"))
    rows = staged(yes.unionAll(no), "pii-sample")
    return LogisticRegression(weightCol="weight", maxIter=100, regParam=REGULARISATION, fitIntercept=False, standardization=False).fit(rows)


def personal_spans(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, mark, kind, start, end, base, score): every span that is base, or that the classifier scores ``threshold`` or more.

    ``mark`` tells apart rows that share a key but not the text. Rows equal in both are listed once.
    """
    documents = df.select(named(key).alias("doc"), F.xxhash64(named(text)).alias("mark"), F.coalesce(named(text), F.lit("")).alias("text"))
    voted = votes(_hits(documents))
    spans = staged(voted.select("doc", "mark", "kind", "start", "end", "base", *LABELERS, "tokens"), "pii-spans")
    patterns = staged(spans.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")), "pii-votes")
    if patterns.isEmpty():
        scored = spans.withColumn("score", F.lit(0.0))
    else:
        rates = estimated_by_kind(patterns)
        model = classifier(spans, rates)
        judged = model.transform(_featured(spans, list(rates), HASHED_FEATURES))
        scored = judged.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    kind = F.when(F.col("kind") == "local_phone", "phone").otherwise(F.col("kind"))
    return scored.where(F.col("base") | (F.col("score") >= threshold)).select("doc", "mark", kind.alias("kind"), "start", "end", "base", "score")


def _order(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0)) + F.when(kind.isin(*KINDS), 0).otherwise(len(KINDS) + 1)


def with_spans(df: DataFrame, key: str, text: str, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of every row, and spans: array of struct(start, place, kind, end, base), by start, then kind as listed.

    Positions count code points, end exclusive. Null and empty texts have none. Null keys and rows that share a key are told
    apart by their texts; repeated rows come back repeated, with equal spans. An empty table gives an empty table. Names of
    other columns don't matter.
    """
    kept = [f"_{i}" for i in range(len(columns))]
    rows = df.select(named(key).alias("doc"), F.xxhash64(named(text)).alias("mark"), *(named(c).alias(k) for c, k in zip(columns, kept)))
    each = F.struct(F.col("start"), _order(F.col("kind")).alias("place"), "kind", "end", "base")
    found = personal_spans(df, key, text, threshold).groupBy("doc", "mark").agg(F.array_sort(F.collect_list(each)).alias("spans"))
    joined = merging(rows).join(found, rows["doc"].eqNullSafe(found["doc"]) & (rows["mark"] == found["mark"]), "left")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    return joined.select(*kept, spans.alias("spans")).toDF(*columns, "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one, by the first's."""

    def step(done: Column, s: Column) -> Column:
        apart = s["start"] >= done["upto"]
        before = F.substring(text, (done["upto"] + 1).cast("int"), (s["start"] - done["upto"]).cast("int"))
        out = F.when(apart, F.concat(done["out"], before, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["upto"], s["end"]).alias("upto"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))
    rest = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, (done["upto"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
