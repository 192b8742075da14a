"""Default column roles from types and whole name tokens. Explicit arguments always win."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CALENDAR_SUFFIXES = ("_year", "_quarter", "_month", "_day_of_week")


def tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[^0-9a-z]+", name.lower()) if t]


def has_token(name: str, *wanted: str) -> bool:
    return any(t in wanted for t in tokens(name))


def is_id(name: str) -> bool:
    return has_token(name, "id", "ids", "orderid", "customerid", "key")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_date(f.dataType)]


def measure_columns(df: DataFrame) -> list[str]:
    """Numeric columns that measure something: no ids, flags or calendar parts."""
    return [
        c
        for c in numeric_columns(df)
        if not is_id(c) and not c.startswith("is_") and not c.endswith(CALENDAR_SUFFIXES)
    ]


def dimension_columns(df: DataFrame) -> list[str]:
    return [c for c in string_columns(df) if not is_id(c)]


def first_named(df: DataFrame, names: list[str]) -> str | None:
    """First column whose lower-cased name is one of ``names``."""
    return next((c for c in df.columns if c.lower() in names), None)


def first_with_token(df: DataFrame, *wanted: str) -> str | None:
    return next((c for c in df.columns if has_token(c, *wanted)), None)


def year_of(name: str) -> int | None:
    """The 19xx or 20xx year inside a column name, also next to an underscore."""
    found = re.search(r"(?<!\d)(?:19|20)\d\d(?!\d)", name)
    return int(found.group()) if found else None


def year_columns(df: DataFrame) -> list[tuple[int, str]]:
    """(year, column) of the yearly numeric columns, oldest first."""
    found = [
        (year_of(f.name), f.name)
        for f in df.schema
        if is_numeric(f.dataType) and year_of(f.name) is not None and not has_token(f.name, "growth", "projected")
    ]
    return sorted(found)
