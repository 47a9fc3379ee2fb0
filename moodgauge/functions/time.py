"""Column-level date and time functions (rows C3, C4, D4, J5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_to_date(col) -> Column:
    """Epoch seconds -> UTC calendar date; 0 or null -> null.

    Assumes the session zone is UTC (``build_session`` sets it).
    """
    secs = F.nullif(_c(col).cast("double"), F.lit(0.0))
    return F.to_date(F.timestamp_seconds(secs))


def to_epoch_seconds(col) -> Column:
    """Seconds since the epoch of a timestamp / timestamp_ntz read as UTC."""
    return F.unix_micros(_c(col).cast("timestamp")) / F.lit(1_000_000.0)


# The ISO-8601 shapes that Python's ``datetime.fromisoformat``
# reads (extended and basic date; any separator character; hour, minute and
# second from the left; a fraction after ``.`` or ``,``; an offset, ``Z``).
_ISO = (r"^(\d{4})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d)|-W(\d\d)(?:-(\d))?|W(\d\d)(\d)?)"
        r"(?:[\s\S](\d\d)(?::(\d\d)(?::(\d\d)(?:[.,](\d+))?)?|(\d\d)(?:(\d\d)(?:[.,](\d+))?)?)?"
        r"(?:(Z)| ?([+-])(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?)?)?$")


def parse_iso(col) -> Column:
    """C4: tolerant ISO-8601 parse to a UTC instant; junk/empty -> null.

    All shapes of Python's ``fromisoformat``: date only, week dates, no
    seconds, any separator, basic forms, fractions of any length (cut to
    microseconds), ``Z`` and offsets with or without a colon. A string
    without an offset is read as UTC (the reference reads it in the machine
    zone, which is not reproducible). Impossible dates and times are null.
    """
    from .text import strip
    # the groups of one match, an array of one element otherwise; bound to a
    # lambda's variable, so that they are cut out once per value
    groups = F.split(F.regexp_replace(strip(col), _ISO, "|".join(f"${g}" for g in range(1, 23))), r"\|", -1)
    return F.get(F.transform(F.array(groups), _instant), F.lit(0))


def _instant(groups: Column) -> Column:
    def part(*numbers: int) -> Column:
        return F.coalesce(*[F.nullif(F.get(groups, F.lit(g - 1)), F.lit("")) for g in numbers])

    def number(*numbers: int) -> Column:
        return F.coalesce(part(*numbers).try_cast("int"), F.lit(0))

    def micros(*numbers: int) -> Column:
        return F.rpad(F.substring(F.coalesce(part(*numbers), F.lit("")), 1, 6), 6, "0").try_cast("int")

    year, week = part(1), part(6, 8).try_cast("int")
    # 4 January is in week 1; weeks start on Monday
    jan4 = F.try_to_timestamp(F.concat(year, F.lit("-01-04")), F.lit("yyyy-MM-dd")).cast("date")
    week_day = F.coalesce(part(7, 9).try_cast("int"), F.lit(1))
    by_week = F.date_add(F.date_sub(jan4, F.weekday(jan4)), (week - 1) * 7 + week_day - 1)
    # a week 53 that the year does not have is no date
    by_week = F.when(week.between(1, 53) & week_day.between(1, 7) & (F.weekofyear(by_week) == week), by_week)
    by_day = F.try_to_timestamp(F.concat_ws("-", year, part(2, 4), part(3, 5)), F.lit("yyyy-MM-dd")).cast("date")
    day = F.when(week.isNotNull(), by_week).otherwise(by_day)
    h, m, sec = number(10), number(11, 14), number(12, 15)
    off = (number(19) * 3600 + number(20) * 60 + number(21)).cast("long") * 1_000_000 + micros(22)
    ok = ((F.size(groups) == 22) & (h < 24) & (m < 60) & (sec < 60) & (off < 86_400_000_000) & (year != "0000"))
    off = F.when(part(18) == "-", -off).otherwise(off)
    at = (F.unix_date(day).cast("long") * 86_400_000_000 + (h * 3600 + m * 60 + sec).cast("long") * 1_000_000
          + micros(13, 16) - off)
    return F.when(ok, F.timestamp_micros(at))


def coerce_date(col, dtype: str | None = None) -> Column:
    """Calendar date of a date/timestamp/string column; bad -> null.

    ``dtype`` (the column's simple type name) avoids a string round trip for
    columns that already are dates or timestamps.
    """
    c = _c(col)
    if dtype == "date":
        return c
    if dtype in ("timestamp", "timestamp_ntz"):
        return c.cast("date")
    return F.try_to_timestamp(c.cast("string")).cast("date")


def session_day(ts_utc, zone: str = "America/New_York", close_hour: int = 16,
                close_minute: int = 0) -> Column:
    """J5 (first half): trading-session date of a UTC instant.

    The instant is shown in the exchange zone; at or after the close it
    belongs to the next calendar date. Daylight-saving changes follow the
    zone rules.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts_utc).cast("timestamp_ntz"))
    minutes = F.hour(local) * 60 + F.minute(local)
    after_close = minutes >= F.lit(close_hour * 60 + close_minute)
    d = F.to_date(local)
    return F.when(after_close, F.date_add(d, 1)).otherwise(d)
