"""Date and time columns.  Instants are naive UTC (``TIMESTAMP_NTZ``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.binding import let
from gleaner.functions.text import clean_inline, strip

# Russian month names in the genitive.
MONTHS = {
    "января": 1,
    "февраля": 2,
    "марта": 3,
    "апреля": 4,
    "мая": 5,
    "июня": 6,
    "июля": 7,
    "августа": 8,
    "сентября": 9,
    "октября": 10,
    "ноября": 11,
    "декабря": 12,
}

# Pattern tokens and the Java letters they stand for.
PATTERN_TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}

_ISO_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2})?"
_NAMED_DAY = r"([0-9]{1,2})\s+([а-яё]+)\s+([0-9]{4})"
_ZONE_TAIL = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"
_ISO_MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,6})?)?)?"


def java_pattern(pattern: str) -> str:
    """``YYYY-MM-DD HH:mm:ss`` style pattern in Java letters; other letters are quoted."""
    pieces = re.split("(" + "|".join(PATTERN_TOKENS) + ")", pattern)
    out = []
    for piece in pieces:
        if piece in PATTERN_TOKENS:
            out.append(PATTERN_TOKENS[piece])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group(0)}'", piece))
    return "".join(out)


def publication_date(value: Column) -> Column:
    """ISO day in the text, else a Russian long date, else the cleaned text."""
    return let(clean_inline(value), _publication_date)


def _publication_date(text: Column) -> Column:
    iso = F.regexp_extract(text, _ISO_DAY, 0)
    lower = F.lower(text)
    numbers = F.create_map(*[F.lit(x) for word, n in MONTHS.items() for x in (word, f"{n:02d}")])
    named = F.concat(
        F.regexp_extract(lower, _NAMED_DAY, 3),
        F.lit("-"),
        F.try_element_at(numbers, F.regexp_extract(lower, _NAMED_DAY, 2)),
        F.lit("-"),
        F.lpad(F.regexp_extract(lower, _NAMED_DAY, 1), 2, "0"),
    )
    return F.coalesce(F.when(iso != "", iso), named, text)


def _as_utc(moment: Column) -> Column:
    """Instant (``TIMESTAMP``) to naive UTC, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


def _zoned(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return _as_utc(F.regexp_replace(spaced, "z$", "Z").try_cast("timestamp"))


def aware_timestamp(value: Column) -> Column:
    """Only texts with an explicit zone are accepted; the rest is null."""
    return let(strip(value), lambda text: F.when(text.rlike(_ISO_MOMENT + _ZONE_TAIL), _zoned(text)))


def utc_timestamp(value: Column) -> Column:
    """ISO text, a missing zone means UTC (validity dates)."""
    return moment_in_zone(strip(value), "UTC")


def moment_in_zone(value: Column, zone: str) -> Column:
    return let(value, lambda text: _moment_in_zone(text, zone))


def _moment_in_zone(text: Column, zone: str) -> Column:
    local = F.when(text.rlike(_ISO_MOMENT + "$"), text.try_cast("timestamp_ntz"))
    return F.coalesce(
        F.when(text.rlike(_ISO_MOMENT + _ZONE_TAIL), _zoned(text)),
        F.convert_timezone(F.lit(zone), F.lit("UTC"), local),
    )


def iso_z(moment: Column) -> Column:
    """``2024-01-01T10:00:00Z``; a fraction only when it is not zero."""
    return let(moment, _iso_z)


def _iso_z(moment: Column) -> Column:
    micros = F.date_format(moment, "SSSSSS")
    base = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", F.concat(base, F.lit("Z"))).otherwise(
        F.concat(base, F.lit("."), micros, F.lit("Z"))
    )


def source_moment(value: Column, zone: str = "UTC", pattern: str = "") -> Column:
    text = clean_inline(value)
    if pattern:
        parsed = F.try_to_timestamp(text, F.lit(java_pattern(pattern))).cast("timestamp_ntz")
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), parsed)
    return let(text, lambda t: F.coalesce(moment_in_zone(t, zone), moment_in_zone(publication_date(t), zone)))


def source_datetime(value: Column, zone: str = "UTC", pattern: str = "") -> Column:
    """UTC text of a source date, null when it cannot be read."""
    return iso_z(source_moment(value, zone, pattern))


def to_local(moment: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)


def to_utc(local: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def offset_text(local: Column, utc: Column) -> Column:
    return let(F.timestamp_diff("MINUTE", utc, local), _signed_hours)


def _signed_hours(minutes: Column) -> Column:
    size = F.abs(minutes)
    return F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def iso_local(local: Column, zone: str) -> Column:
    """Local wall time with its offset, as ISO text."""
    return let(local, lambda moment: _iso_local(moment, zone))


def _iso_local(local: Column, zone: str) -> Column:
    micros = F.date_format(local, "SSSSSS")
    base = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    head = F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
    return F.concat(head, offset_text(local, to_utc(local, zone)))


def start_of_day(moment: Column, zone: str) -> Column:
    return iso_local(F.date_trunc("DAY", to_local(moment, zone)).cast("timestamp_ntz"), zone)


def end_of_day(moment: Column, zone: str) -> Column:
    day = F.date_trunc("DAY", to_local(moment, zone)).cast("timestamp_ntz")
    return iso_local(day + F.expr("interval 1 day - interval 1 microsecond"), zone)


def today(clock: Column, zone: str) -> Column:
    return F.date_format(to_local(clock, zone), "yyyy-MM-dd")


def yesterday(clock: Column, zone: str) -> Column:
    return F.date_format(F.date_sub(to_local(clock, zone).cast("date"), 1), "yyyy-MM-dd")


def now_text(clock: Column, zone: str) -> Column:
    return iso_local(to_local(clock, zone), zone)


def add_days(value: Column, days: Column | int) -> Column:
    """A day stays a day, a moment stays a moment (ISO text in, ISO text out)."""
    step = F.lit(days) if isinstance(days, int) else days
    day = F.date_format(F.date_add(value.try_cast("date"), step), "yyyy-MM-dd")
    moment = value.try_cast("timestamp_ntz") + F.make_dt_interval(step)
    return F.when(value.contains("T"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(day)


def format_date(moment: Column, pattern: str) -> Column:
    return F.date_format(moment, java_pattern(pattern))


def parse_date(value: Column, pattern: str) -> Column:
    moment = F.try_to_timestamp(value, F.lit(java_pattern(pattern)))
    has_time = any(token in pattern for token in ("HH", "mm", "ss"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss" if has_time else "yyyy-MM-dd")
