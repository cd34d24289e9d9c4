"""The report moment ``as_of`` and the cutoffs and names made from it, all in UTC.

Cutoffs are worked out here and reach Spark as literals, so that filters on
``created_at`` get pushed into the scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Moment = datetime | str | None


def utc(as_of: Moment = None) -> datetime:
    """``as_of`` as a UTC time; without one, the current time. Naive times are UTC."""
    if as_of is None:
        return datetime.now(timezone.utc)
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        return as_of.replace(tzinfo=timezone.utc)
    return as_of.astimezone(timezone.utc)


def cutoff(df: DataFrame, column: str, as_of: Moment, days: int) -> Column:
    """The moment ``days`` before ``as_of``, in the type of ``column``."""
    moment = utc(as_of) - timedelta(days=days)
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def in_utc(df: DataFrame, column: str) -> Column:
    """A time column as the UTC time without zone, whatever the session's zone is."""
    return without_zone(F.col(column), df.schema[column].dataType)


def without_zone(value: Column, kind: T.DataType) -> Column:
    """A value of a time type as UTC time without zone. Values that have no zone are UTC."""
    if isinstance(kind, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
    return value.cast("timestamp_ntz")


def microseconds(value: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 as a number that follows the time, in any zone of the session."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    days = F.datediff(value.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(value)) * 3600 + F.minute(value) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")


def iso_seconds(value: Column, kind: T.DataType) -> Column:
    """ISO-8601 in UTC, to the second, with ``Z``."""
    text = F.substring(without_zone(value, kind).cast("string"), 1, 19)
    return F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))


def report_date(as_of: Moment = None) -> str:
    return utc(as_of).strftime("%Y-%m-%d")


def run_name(as_of: Moment = None) -> str:
    return "analysis-" + utc(as_of).strftime("%Y-%m-%dT%H-%M-%S")


def iso_text(as_of: Moment = None) -> str:
    """ISO-8601 with milliseconds and ``Z``."""
    moment = utc(as_of)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def short_date(as_of: Moment = None) -> str:
    """US short date, month and day without leading zeros."""
    moment = utc(as_of)
    return f"{moment.month}/{moment.day}/{moment.year}"
