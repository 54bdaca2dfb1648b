"""Messy values to clean typed columns. Unparsable input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulyse.functions import fixed_values as fixed
from tabulyse.functions.binding import let

# White space as Unicode defines it; Java's \s and trim() know only part of it. In the character class the
# single characters and one wide range settle most letters before the gaps in that range are looked at.
_WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680-\u3000"
    r"&&[^\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff]]"
)
_NULL_RE = rf"^{_WS}*+(?i:{'|'.join(t.replace('-', chr(92) + '-') for t in fixed.NULL_TOKENS if t)})?{_WS}*+\z"

_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_FIXED_POINT = r"^[+-]?[0-9]*+\.?[0-9]*+\z"
_INFINITY = r"^[+-]?inf(?:inity)?\z"
# Everything that is not part of a number. An e stays only as an exponent, between digits.
_NUMBER_NOISE = r"[^0-9.eE+-]++|(?<![0-9.])[eE]|[eE](?![+-]?[0-9])"

_MONTH = "(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = r"^(?i:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?),?\s+"
_OFFSET = r"[+-](?<=:\d{2}(?:\.\d{1,9})?[+-])\d{2}:?\d{2}\z"
_ISO = "yyyy-M-d[['T'][' ']H:mm[:ss][.SSSSSSSSS]['Z']]"
_PLAIN_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?Z?)?\z"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
_LAST_EPOCH_SECOND = 253402300799  # 9999-12-31 23:59:59
_FIRST_EPOCH_MILLI = 10**12


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(_WS_CHARS))


def is_null_token(c: Column) -> Column:
    """True for NULL and for text that stands for a missing value."""
    return c.isNull() | c.rlike(_NULL_RE)


def null_if_token(c: Column) -> Column:
    return F.when(~is_null_token(c), c)


def parse_double(c: Column) -> Column:
    """Text to double: percent signs, currency marks, separators and letters are noise."""

    def noisy(s: Column) -> Column:
        percent = F.regexp_replace(s, r"[%,\s]", "").try_cast("double")
        number = let(F.regexp_replace(s, _NUMBER_NOISE, ""), lambda d: F.when(d.rlike(_PLAIN_NUMBER), d.try_cast("double")))
        return F.when(s.rlike(fixed.PERCENTAGE), percent).otherwise(F.round(number, 6))

    def parsed(s: Column) -> Column:
        return F.when(s.rlike(_PLAIN_NUMBER), F.round(s.try_cast("double"), 6)).otherwise(noisy(s))

    infinity = F.lit(float("inf"))
    return F.nullif(F.nullif(let(strip(null_if_token(c)), parsed), infinity), -infinity)


def parse_long(c: Column) -> Column:
    """Text to bigint, cutting the fraction off; NULL when out of range. Exact beyond 2^53 too, but for exponents."""

    def cut(d: Column) -> Column:
        whole = F.substring_index(d, ".", 1)
        plain = F.when(whole.rlike(r"[0-9]"), whole.try_cast("bigint")).when(d.rlike(r"\.[0-9]"), F.lit(0).cast("bigint"))
        return F.when(d.rlike(_FIXED_POINT), plain).when(d.rlike(_PLAIN_NUMBER), d.try_cast("double").try_cast("bigint"))

    def parsed(s: Column) -> Column:
        return F.when(s.rlike(_FIXED_POINT), cut(s)).otherwise(let(F.regexp_replace(s, _NUMBER_NOISE, ""), cut))

    return let(strip(null_if_token(c)), parsed)


def parse_boolean(c: Column) -> Column:
    """Text to boolean. Known words first, then any nonzero number is true; all else is false."""
    s = F.lower(strip(null_if_token(c)))
    nonzero = F.when(s.rlike(_PLAIN_NUMBER), s.try_cast("double") != 0).when(s.rlike(_INFINITY), True)
    return F.when(s.isin(fixed.TRUE_TOKENS), True).when(s.isin(fixed.FALSE_TOKENS), False).when(
        s.isNotNull(), F.coalesce(nonzero, F.lit(False))
    )


def clean_string(c: Column) -> Column:
    """Stripped, without one pair of matching outer quotes, white space runs as one space."""

    def unquoted(s: Column) -> Column:
        quoted = (s.startswith("'") & s.endswith("'")) | (s.startswith('"') & s.endswith('"'))
        return F.when(quoted & (F.length(s) >= 2), strip(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)

    # Single spaces, the bulk of white space, are left as they are.
    return F.regexp_replace(let(strip(null_if_token(c)), unquoted), rf" {_WS}++|(?! ){_WS}{_WS}*+", " ")


def _epoch(s: Column) -> Column:
    number = F.when(F.length(s) <= 17, s).try_cast("bigint")
    seconds = F.when(number > _FIRST_EPOCH_MILLI, number / 1000).otherwise(number.cast("double"))
    in_range = F.when(seconds <= _LAST_EPOCH_SECOND, seconds).cast("decimal(18,6)")
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), in_range)


def _first(s: Column, *patterns: str) -> Column:
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in patterns]
    return F.coalesce(*tries).cast("timestamp_ntz") if len(tries) > 1 else tries[0].cast("timestamp_ntz")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    made = F.try_make_timestamp(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), zero, zero, zero)
    return made.cast("timestamp_ntz")


def _date_inside(s: Column) -> Column:
    """A year-first, else a month-first, date anywhere in the text."""
    year_first = r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})"
    month_first = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group)

    return F.coalesce(
        F.when(s.rlike(year_first), _ymd(part(year_first, 1), part(year_first, 2), part(year_first, 3))),
        F.when(s.rlike(month_first), _ymd(part(month_first, 3), part(month_first, 1), part(month_first, 2))),
    )


def _four_digit_year(s: Column) -> Column:
    """Two-digit years become four digits: 69 to 99 are 19xx, 00 to 68 are 20xx."""
    slash, dash = r"^(\d{1,2}/\d{1,2}/)(\d{2})\z", r"^(\d{2})(-\d{1,2}-\d{1,2})\z"
    old_slash, old_dash = r"^(\d{1,2}/\d{1,2}/)(69|[7-9]\d)\z", r"^(69|[7-9]\d)(-\d{1,2}-\d{1,2})\z"
    return (
        F.when(s.rlike(old_slash), F.regexp_replace(s, old_slash, "$119$2"))
        .when(s.rlike(slash), F.regexp_replace(s, slash, "$120$2"))
        .when(s.rlike(old_dash), F.regexp_replace(s, old_dash, "19$1$2"))
        .when(s.rlike(dash), F.regexp_replace(s, dash, "20$1$2"))
        .otherwise(s)
    )


def _short_months(s: Column) -> Column:
    """Commas and runs of spaces as one space, words cut to three letters."""
    spaced = F.regexp_replace(s, r"[,\s]+", " ")
    return F.regexp_replace(spaced, r"(?<![A-Za-z])([A-Za-z]{3})[a-z]+(?= )", "$1")


def parse_timestamp(c: Column) -> Column:
    """Text in any of the known date formats to a timestamp without zone.

    A cheap regular expression picks the one class of formats to try, so a value costs one or two real
    parses. Month-first wins over day-first where both are valid dates. Zone offsets are dropped and the
    wall clock kept.
    """
    no_weekday = F.regexp_replace(strip(null_if_token(c)), _WEEKDAY, "")
    any_format = let(no_weekday, lambda s: let(_four_digit_year(s), _timestamp_in))
    return F.when(c.rlike(_PLAIN_ISO), _first(c, _ISO)).otherwise(any_format)


def _timestamp_in(s: Column) -> Column:
    with_words = let(F.when(s.rlike("[A-Za-z]{3}"), _short_months(s)), lambda words: _month_name_date(s, words))
    return F.coalesce(let(F.regexp_replace(s, _OFFSET, ""), lambda iso: _digits_date(s, iso)), with_words, _date_inside(s))


def _month_name_date(s: Column, words: Column) -> Column:
    return (
        F.when(
            words.rlike(rf"^[A-Za-z]{{3}} \d{{1,2}} \d{{4}}(?: {_CLOCK}(?: (?i:[ap]m))?)?\z") & s.rlike(f"^{_MONTH} "),
            _first(words, "MMM d yyyy[ H:mm[:ss]]", "MMM d yyyy h:mm[:ss] a"),
        )
        .when(words.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}\z") & s.rlike(f"^\\d+ {_MONTH} "), _first(words, "d MMM yyyy"))
        .when(words.rlike(r"^[A-Za-z]{3} \d{4}\z") & s.rlike(f"^{_MONTH} "), _first(words, "MMM yyyy"))
    )


def _digits_date(s: Column, iso: Column) -> Column:
    return (
        F.when(s.rlike(r"^\d{14}\z"), F.coalesce(_first(s, "yyyyMMddHHmmss"), _epoch(s)))
        .when(s.rlike(r"^\d{8}\z"), F.coalesce(_first(s, "yyyyMMdd"), _epoch(s)))
        .when(s.rlike(r"^\d{9,}\z"), _epoch(s))
        .when(
            iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?Z?)?\z"),
            _first(iso, _ISO),
        )
        .when(s.rlike(rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}(?: {_CLOCK})?\z"), _first(s, "yyyy/M/d[ H:mm[:ss]]"))
        .when(
            s.rlike(rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_CLOCK} (?i:[ap]m)\z"),
            _first(s, "M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a"),
        )
        .when(
            s.rlike(rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}(?: {_CLOCK})?\z"),
            _first(s, "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"),
        )
        .when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}\z"), _first(s, "M-d-yyyy", "d-M-yyyy"))
        .when(s.rlike(rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}} {_CLOCK}\z"), _first(s, "d-M-yyyy H:mm[:ss]"))
        .when(s.rlike(rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(?: {_CLOCK})?\z"), _first(s, "d.M.yyyy[ H:mm[:ss]]"))
    )


def parse_date(c: Column) -> Column:
    return parse_timestamp(c).cast("date")


def parse_time(c: Column) -> Column:
    """A clock time, alone or as part of a timestamp, as HH:mm:ss."""


    def clock(s: Column) -> Column:
        alone = F.when(s.rlike(rf"^{_CLOCK}\z"), _first(s, "H:mm[:ss]")).when(
            s.rlike(rf"^{_CLOCK} (?i:[ap]m)\z"), _first(s, "h:mm[:ss] a")
        )
        return F.coalesce(alone, parse_timestamp(s))

    return F.date_format(let(strip(null_if_token(c)), clock), "HH:mm:ss")


def date_unparsed(c: Column) -> Column:
    """True where there is text but no date in it."""
    return ~is_null_token(c) & parse_timestamp(c).isNull()


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_datetime(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
