"""Synthetic tables from a list of column names and types.

Every value is a function of (seed, column, row number) through md5, so a table comes out the same
whatever the partitioning, a lost task recomputes the same rows, and drawing shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulyse.functions import vocabulary as v
from tabulyse.functions.binding import let
from tabulyse.functions.hashing import hash_word, keyed_md5
from tabulyse.functions.semantic_types import ColumnSpec

PREVIEW_ROWS = 5
#: Rows for which one task draws values: a few seconds for all types.
TASK_ROWS = 20_000
FEWEST_DEFAULT_COLUMNS, MOST_DEFAULT_COLUMNS = 3, 10
_MONEY_WORDS = {"price", "cost", "amount", "salary", "revenue"}
_STOCK_WORDS = {"quantity", "stock", "count"}
_PASSWORD_LETTERS = "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%+-=?@"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_FIRST_DAY = "1970-01-01"


class _Draw:
    """The random words of one column in one row."""

    def __init__(self, spec: ColumnSpec, row: Column, seed: int, as_of: str):
        self.name_words = set(re.split(r"[^a-z0-9#]+", spec.name.strip().lower()))
        self.row = row
        self.as_of = F.lit(as_of).cast("date")
        self._key = (seed, spec.name)

    def digest(self, block: int = 0) -> Column:
        seed, name = self._key
        parts = [seed, name, self.row] + ([block] if block else [])
        return keyed_md5(*parts)

    def word(self, i: int = 0) -> Column:
        return hash_word(self.digest(i // 4), i % 4)

    def whole(self, lo: int, hi: int, i: int = 0) -> Column:
        return F.lit(lo).cast("bigint") + self.word(i) % (hi - lo + 1)

    def real(self, lo: float, hi: float, digits: int, i: int = 0) -> Column:
        return F.round(F.lit(float(lo)) + self.word(i) / 4294967295.0 * (hi - lo), digits)

    def pick(self, options: list[str], i: int = 0) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), (self.word(i) % len(options) + 1).cast("int"))

    def byte(self, i: int) -> Column:
        """Byte ``i`` of the digest, as a number; also for ``i`` given as a column below 16."""
        at = i * 2 + 1 if isinstance(i, Column) else F.lit(2 * i + 1)
        return F.conv(F.substring(self.digest(), at, F.lit(2)), 16, 10).cast("int")

    def letters(self, alphabet: str, size: int) -> Column:
        """``size`` letters, up to 32, one from every byte of one or two digests."""

        def spelled(both: Column) -> Column:
            def letter(i: Column) -> Column:
                at = F.conv(F.substring(both, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(alphabet) + 1
                return F.substring(F.lit(alphabet), at, F.lit(1))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), letter), "")

        return let(F.concat(self.digest(), self.digest(1)), spelled)

    def digits(self, size: int, i: int = 0) -> Column:
        return F.lpad((self.word(i) % 10**size).cast("string"), size, "0")

    def words(self, count: int, first: int = 0) -> Column:
        return F.array(*[self.pick(v.WORDS, first + i) for i in range(count)])


def _full_name(d: _Draw) -> Column:
    return F.concat_ws(" ", d.pick(v.FIRST_NAMES), d.pick(v.LAST_NAMES, 1))


def _named(d: _Draw) -> Column:
    if d.name_words & {"first", "fname"}:
        return d.pick(v.FIRST_NAMES)
    if d.name_words & {"last", "lname"}:
        return d.pick(v.LAST_NAMES)
    return _full_name(d)


def _sentence(d: _Draw, first: int = 0, count: int = 6) -> Column:
    text = F.array_join(d.words(count, first), " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000), F.lit("."))


def _string(d: _Draw) -> Column:
    if d.name_words & {"name", "fname", "lname"}:
        return _named(d)
    if "title" in d.name_words:
        return F.concat_ws(" ", F.initcap(d.pick(v.ADJECTIVES)), d.pick(v.WORDS, 1), d.pick(v.NOUNS, 2))
    if d.name_words & {"description", "desc"}:
        return _sentence(d)
    if "status" in d.name_words:
        return d.pick(v.STATUSES)
    if "category" in d.name_words:
        return d.pick(v.CATEGORIES)
    return d.pick(v.WORDS)


def _number(d: _Draw) -> Column:
    if "age" in d.name_words:
        return d.whole(18, 99)
    if "id" in d.name_words:
        return d.row + 1
    if d.name_words & _MONEY_WORDS:
        return d.real(10, 10_000, 2)
    if "year" in d.name_words:
        return d.whole(1950, 2025)
    if d.name_words & _STOCK_WORDS:
        return d.whole(0, 500)
    return d.whole(1, 1000)


def _date(d: _Draw) -> Column:
    span = F.datediff(d.as_of, F.lit(_FIRST_DAY).cast("date"))
    return F.date_add(F.lit(_FIRST_DAY).cast("date"), (d.word() % span).cast("int"))


def _birth_date(d: _Draw) -> Column:
    youngest, oldest = F.add_months(d.as_of, -18 * 12), F.add_months(d.as_of, -91 * 12)
    return F.date_sub(youngest, (d.word() % F.datediff(youngest, oldest)).cast("int"))


def _timestamp(d: _Draw) -> Column:
    start = F.lit(_FIRST_DAY).cast("timestamp_ntz")
    seconds = d.word() % (F.datediff(d.as_of, F.lit(_FIRST_DAY).cast("date")).cast("bigint") * 86_400)
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def _handle(d: _Draw) -> Column:
    return F.lower(F.concat(d.pick(v.FIRST_NAMES), F.lit("."), d.pick(v.LAST_NAMES, 1), d.row.cast("string")))


def _email(d: _Draw) -> Column:
    return F.concat(_handle(d), F.lit("@"), d.pick(v.DOMAINS, 2))


def _domain(d: _Draw) -> Column:
    return F.concat(d.pick(v.WORDS), F.lit("-"), d.pick(v.NOUNS, 1), F.lit("."), d.pick(v.DOMAINS, 2))


def _street(d: _Draw) -> Column:
    number = d.whole(1, 999).cast("string")
    return F.concat_ws(" ", number, d.pick(v.STREETS, 1), d.pick(v.STREET_KINDS, 2))


def _address(d: _Draw) -> Column:
    return F.concat_ws(", ", _street(d), d.pick(v.CITIES, 3), F.concat_ws(" ", d.pick(v.STATES, 4), d.digits(5, 5)))


def _luhn_sum(digits: Column, size: int) -> Column:
    """Sum of the digits, doubled at every second place counted from the check digit to come."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when((size - i) % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.lit(0), add)


def _card(d: _Draw) -> Column:
    digits = F.concat(F.lit("400000"), d.digits(9))
    return let(digits, lambda known: F.concat(known, ((10 - _luhn_sum(known, 15) % 10) % 10).cast("string")))


def _iban(d: _Draw) -> Column:
    account = F.concat(d.digits(9), d.digits(9, 1))
    # D is 13 and E is 14; the two zeros stand for the check digits.
    remainder = F.concat(account, F.lit("131400")).cast("decimal(38,0)") % 97
    return F.concat(F.lit("DE"), F.lpad((98 - remainder).cast("int").cast("string"), 2, "0"), account)


def _ip(d: _Draw) -> Column:
    return F.concat(d.pick(["192.0.2.", "198.51.100.", "203.0.113."]), d.whole(1, 254, 1).cast("string"))


def _mac(d: _Draw) -> Column:
    pairs = [F.substring(d.digest(), 2 * i + 1, 2) for i in range(5)]
    return F.concat_ws(":", F.lit("02"), *pairs)


def _uuid(d: _Draw) -> Column:
    h = d.digest()
    variant = F.substring(F.lit("89ab"), d.byte(8) % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8),
        F.lit("-"),
        F.substring(h, 9, 4),
        F.lit("-4"),
        F.substring(h, 14, 3),
        F.lit("-"),
        variant,
        F.substring(h, 18, 3),
        F.lit("-"),
        F.substring(h, 21, 12),
    )


def _image(d: _Draw) -> Column:
    size = [d.whole(200, 800, i).cast("string") for i in (0, 1)]
    return F.concat(F.lit("https://images.example.com/"), size[0], F.lit("/"), size[1])


_BUILDERS: dict[str, Callable[[_Draw], Column]] = {
    "string": _string,
    "number": _number,
    "boolean": lambda d: d.word() % 2 == 0,
    "date": _date,
    "email": _email,
    "phone number": lambda d: F.concat(F.lit("("), d.whole(200, 999).cast("string"), F.lit(") 555-01"), d.digits(2, 1)),
    "date of birth": _birth_date,
    "name": _named,
    "first name": lambda d: d.pick(v.FIRST_NAMES),
    "last name": lambda d: d.pick(v.LAST_NAMES),
    "full name": _full_name,
    "gender": lambda d: d.pick(v.GENDERS),
    "ssn": lambda d: F.concat_ws("-", d.whole(900, 999).cast("string"), d.digits(2, 1), d.digits(4, 2)),
    "address": _address,
    "street": _street,
    "city": lambda d: d.pick(v.CITIES),
    "country": lambda d: d.pick(v.COUNTRIES),
    "state": lambda d: d.pick(v.STATES),
    "postal code": lambda d: d.digits(5),
    "zip code": lambda d: d.digits(5),
    "latitude": lambda d: d.real(-90, 90, 6),
    "longitude": lambda d: d.real(-180, 180, 6),
    "company name": lambda d: F.concat_ws(" ", d.pick(v.LAST_NAMES), d.pick(v.COMPANY_ENDINGS, 1)),
    "job title": lambda d: d.pick(v.JOBS),
    "department": lambda d: d.pick(v.DEPARTMENTS),
    "employee id": lambda d: F.when(d.row < 9999, F.format_string("EMP-%04d", d.row + 1)).otherwise(
        F.concat(F.lit("EMP-"), (d.row + 1).cast("string"))
    ),
    "currency": lambda d: d.real(1, 10_000, 2).cast("decimal(15,2)"),
    "credit card": _card,
    "url": lambda d: F.concat(F.lit("https://"), _domain(d), F.lit("/")),
    "domain": _domain,
    "image url": _image,
    "ip address": _ip,
    "mac address": _mac,
    "username": _handle,
    "password": lambda d: d.letters(_PASSWORD_LETTERS, 12),
    "paragraph": lambda d: F.concat_ws(" ", *[_sentence(d, 6 * i) for i in range(3)]),
    "sentence": _sentence,
    "word": lambda d: d.pick(v.WORDS),
    "description": _sentence,
    "uuid": _uuid,
    "slug": lambda d: F.array_join(d.words(3), "-"),
    "color": lambda d: d.pick(v.COLORS),
    "integer": lambda d: d.whole(1, 1000),
    "int": lambda d: d.whole(1, 1000),
    "float": lambda d: d.real(0, 100, 2),
    "decimal": lambda d: d.real(0, 100, 2),
    "price": lambda d: d.real(1, 1000, 2),
    "datetime": _timestamp,
    "timestamp": _timestamp,
    "time": lambda d: F.date_format(_timestamp(d), "HH:mm:ss"),
    "iban": _iban,
    "bitcoin address": lambda d: F.concat(F.lit("1"), d.letters(_BASE58, 32)),
}


def synth_types() -> list[str]:
    return sorted(_BUILDERS)


def register_synth_type(name: str, builder: Callable[[_Draw], Column]) -> None:
    _BUILDERS[name.strip().lower()] = builder


def synth_value(spec: ColumnSpec, row: Column, seed: int = 0, as_of: str = "2025-12-31") -> Column:
    """The value of a column in the row with the given number; an unknown type gives a word."""
    return _BUILDERS.get(spec.key, _BUILDERS["word"])(_Draw(spec, row.cast("bigint"), seed, as_of))


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt evenly to tasks of about ``rows`` each, to draw values next to.

    A value costs far more than the row it stands next to, so tasks that suit a scan are too few and too long: a file of one
    row group is one task. Rows are counted when the function is called, which Parquet answers from its footers. Leave out
    columns that are not needed first, the others are shuffled.
    """
    return df.repartition(max(1, -(-df.count() // rows)))


def synth_columns(df: DataFrame, row: str, specs: list[ColumnSpec], seed: int = 0, as_of: str = "2025-12-31") -> DataFrame:
    """Synthetic columns next to the existing ones, drawn by the row number in column ``row``."""
    return df.select("*", *[synth_value(s, F.col(row), seed, as_of).alias(s.name) for s in specs])


def synth(
    spark: SparkSession, specs: list[ColumnSpec], rows: int, seed: int = 0, as_of: str = "2025-12-31", partitions: int | None = None
) -> DataFrame:
    """A synthetic table with exactly ``rows`` rows."""
    numbered = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return numbered.select(*[synth_value(s, F.col("id"), seed, as_of).alias(s.name) for s in specs])


def synth_preview(spark: SparkSession, specs: list[ColumnSpec], seed: int = 0) -> DataFrame:
    return synth(spark, specs, PREVIEW_ROWS, seed)


def default_specs(topic: str, allowed: list[str], count: int = MOST_DEFAULT_COLUMNS) -> list[ColumnSpec]:
    """A ready-made schema for a topic, from the allowed types; 3 to 10 columns are asked for."""
    count = min(max(count, FEWEST_DEFAULT_COLUMNS), MOST_DEFAULT_COLUMNS)
    spelled = {t.lower(): t for t in reversed(allowed)}
    prefix = topic.lower().replace(" ", "_")
    usable = [
        ColumnSpec(name.format(topic=prefix), spelled[t.lower()]) for name, t in v.PRESET_COLUMNS if t.lower() in spelled
    ]
    return usable[:count]
