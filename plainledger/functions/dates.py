"""Time columns: ISO texts, month keys, recency, feed dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plainledger.functions.values import col, yes

ZONE = "America/Los_Angeles"


def parse_iso(text: Column | str) -> Column:
    """`YYYY-MM-DDTHH:MM:SSZ` as a UTC wall-clock time, null when it is not one."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
    bare = F.replace(F.rtrim(col(text), F.lit("Z")), F.lit("T"), F.lit(" "))
    return F.when(yes(col(text).rlike(shape)), bare.try_cast("timestamp_ntz"))


def iso_text(at: Column | str) -> Column:
    return F.date_format(col(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc822(text: Column | str) -> Column:
    """Feed date of an ISO text, null when it cannot be read."""
    return F.date_format(parse_iso(text), "EEE, dd MMM yyyy HH:mm:ss '+0000'")


def month_key(at: Column | str) -> Column:
    return F.date_format(col(at), "yyyy-MM")


def zone_month(at: Column | str, zone: str = ZONE) -> Column:
    """Calendar month in a zone of a UTC wall-clock time."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), col(at).cast("timestamp_ntz")), "yyyy-MM")


def within_days(at: Column | str, now: Column, days: int) -> Column:
    return yes(col(at) >= now - F.expr(f"interval {days} days"))
