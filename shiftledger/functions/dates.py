"""Timestamp columns. All times are zoneless (``timestamp_ntz``).

Nothing here passes through the session time zone, so local times that a zone skips stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftledger.functions.text import WHITESPACE

DAY_MICROS = 86_400_000_000
NOON = "12:00:00"
_OFFSET = r"[+-](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
# The usual spelling, read by position.
_USUAL = r"^\d{4}-\d{2}-\d{2}([^0-9](?:[01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d{1,6})?)?([+-](?:[01]\d|2[0-3]):?[0-5]\d)?)?$"
# Every ISO 8601 spelling: calendar or week date, long or short, then hour, minute, second and fraction, long or short.
_DATE = r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-W(\d{2})(?:-([1-7]))?|(\d{4})W(\d{2})([1-7])?)"
_CLOCK = r"(?:([01]\d|2[0-3])(?::([0-5]\d)(?::([0-5]\d)(?:[.,](\d+))?)?)?|([01]\d|2[0-3])([0-5]\d)(?:([0-5]\d)(?:[.,](\d+))?)?)"
_ANY = rf"^{_DATE}(?:[^0-9]{_CLOCK}(?:{_OFFSET})?)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(moment: datetime) -> Column:
    """A zoneless timestamp literal."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


_GROUPS = "|".join(f"${i}" for i in range(1, 21))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _any_spelling(text: Column) -> Column:
    """A timestamp from any ISO spelling; a date alone means midnight, digits of a second beyond the sixth are cut."""

    def moment(parts: Column) -> Column:
        def part(*groups: int) -> Column:  # the first of the pattern's groups that is there
            return F.coalesce(*[F.nullif(F.element_at(parts, g), F.lit("")) for g in groups])

        year, week = part(1, 4, 7, 10).cast("int"), part(8, 11).cast("int")
        fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
        weekday = F.coalesce(part(9, 12).cast("int"), F.lit(1))
        by_week = F.date_add(fourth, (week - 1) * 7 + weekday - 1 - F.weekday(fourth))
        # Not the ANSI make_date, which raises: an impossible date of digits is null.
        by_digits = F.concat_ws("-", part(1, 4), part(2, 5), part(3, 6)).try_cast("date")
        day = F.when(week.isNull(), by_digits).otherwise(_bound(by_week, lambda d: F.when(F.weekofyear(d) == week, d)))
        fraction = F.substring(F.rpad(F.coalesce(part(16, 20), F.lit("0")), 6, "0"), 1, 6)
        clock = F.concat(
            F.coalesce(part(13, 17), F.lit("00")), F.lit(":"), F.coalesce(part(14, 18), F.lit("00")), F.lit(":"),
            F.coalesce(part(15, 19), F.lit("00")), F.lit("."), fraction,
        )
        return F.when(year > 0, F.concat_ws(" ", day.cast("string"), clock).try_cast("timestamp_ntz"))

    return _bound(F.split(F.regexp_replace(text, _ANY, _GROUPS), r"\|", -1), moment)


def parse_record_date(c: Column | str) -> Column:
    """Lenient parse of submitted text: any ISO 8601 spelling; an offset is dropped, bad text is null.

    A bare date with dashes means noon, any other bare date midnight. The usual spelling is checked by
    one pattern and cut by position; only what is left goes through the pattern of all spellings.
    """

    def moment(text: Column) -> Column:
        clock = F.substring(text, 12, 40)
        for sign in "+-":
            clock = F.substring_index(clock, sign, 1)
        clock = F.when(F.length(text) == 10, NOON).otherwise(F.translate(clock, ",", "."))
        usual = F.concat_ws(" ", F.substring(text, 1, 10), clock).try_cast("timestamp_ntz")
        usual = F.when(F.substring(text, 1, 4) != "0000", usual)
        return F.when(text.rlike(_USUAL), usual).when(text.rlike(_ANY), _any_spelling(text))

    return _bound(F.replace(F.btrim(_col(c), F.lit(WHITESPACE)), F.lit("Z"), F.lit("+00:00")), moment)


def to_minute(c: Column | str) -> Column:
    ts = _col(c)
    return ts - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), ts))


def fill_missing_date(c: Column | str, as_of: datetime) -> Column:
    """Null dates become the as-of minute."""
    return F.coalesce(_col(c), instant(as_of.replace(second=0, microsecond=0)))


def display(c: Column | str) -> Column:
    """dd/MM/yyyy HH:mm"""
    ts = _col(c)
    parts = [F.lpad(part.cast("string"), 2, "0") for part in (F.dayofmonth(ts), F.month(ts), F.hour(ts), F.minute(ts))]
    year = F.lpad(F.year(ts).cast("string"), 4, "0")
    slash, colon = F.lit("/"), F.lit(":")
    return F.concat(parts[0], slash, parts[1], slash, year, F.lit(" "), parts[2], colon, parts[3])


def event_time(c: Column | str) -> Column:
    """The zoneless time read as UTC, as the ``timestamp`` that watermarks need."""
    ts = _col(c)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.timestamp_micros(days * DAY_MICROS + (seconds * 1_000_000).cast("bigint"))


def event_day(c: Column | str) -> Column:
    """The UTC day of an event time."""
    return F.date_from_unix_date(F.floor(F.unix_micros(_col(c)) / DAY_MICROS).cast("int"))
