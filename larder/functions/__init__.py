"""Column expressions shared by the operators.  All are JVM-side built-ins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_SEPARATOR = " — "  # fixed value: what stands between id and name in a label
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"  # fixed value: timestamps kept as text


def full_name(first: str = "First_Name", last: str = "Last_Name") -> Column:
    """First and last name with a blank between; NULL if either is NULL."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def lenient_int(text: Column) -> Column:
    """The leading integer of a text, 0 if there is none, NULL for NULL."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0)))


def as_date(value: Column | dt.date | str | None) -> Column:
    """A date literal or column; None is today."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


def as_stamp(value: Column | dt.datetime | str | None) -> Column:
    """A moment as ``YYYY-MM-DD HH:MM:SS`` text; None is now."""
    if value is None:
        value = F.current_timestamp()
    elif isinstance(value, dt.datetime):
        value = F.lit(value.strftime("%Y-%m-%d %H:%M:%S"))
    elif isinstance(value, str):
        value = F.lit(value)
    return F.date_format(value.cast("timestamp_ntz"), STAMP_FORMAT)


def is_missing(text: Column) -> Column:
    """NULL or the empty string."""
    return text.isNull() | (text == "")


def strip(text: Column) -> Column:
    """Leading and trailing white space, tabs and line ends removed."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def warranty_status(expiry: Column, as_of: Column) -> Column:
    """``Expired`` before ``as_of``, ``Expiring Soon`` within 30 days, else ``Valid``."""
    day = expiry.try_cast("date")
    return (
        F.when(day < as_of, "Expired")
        .when(day < F.date_add(as_of, 30), "Expiring Soon")
        .otherwise("Valid")
    )


def label(id_col: str, name_col: str, price_col: str | None = None) -> Column:
    """``<id> — <name>``, with ``  (Rs. <price>)`` after it where a price is given."""
    parts = [F.col(id_col).cast("string"), F.lit(LABEL_SEPARATOR), F.col(name_col)]
    if price_col:
        parts += [F.lit("  (Rs. "), F.col(price_col).cast("string"), F.lit(")")]
    return F.concat(*parts)


def label_id(label_col: str | Column) -> Column:
    """The id back out of a label."""
    text = F.col(label_col) if isinstance(label_col, str) else label_col
    return F.split(text, LABEL_SEPARATOR, 2)[0].cast("bigint")
