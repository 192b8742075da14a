"""Cleaning rules that look at one row only, for batch and streaming tables alike.

None of them keeps state, so a stream needs no watermark. Rules that need a whole column
(imputation, medians, deduplication of the whole table) stay with the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean
from ..plans.cleaning import BusinessColumns


def clean_rows(df: DataFrame, business: BusinessColumns | None = None) -> DataFrame:
    """Headers, placeholders, id suffixes, known aliases, dates, quantity, price and discount."""
    out = clean.strip_id_suffix(clean.trim_null_placeholders(clean.normalize_headers(df)))
    for c, kind in clean.category_columns(out).items():
        out = clean.alias_standardize(out, c, kind)
    out = clean.parse_dates(out)
    business = business or BusinessColumns.of(out)
    if business.quantity:
        out = clean.clean_quantity(out, business.quantity)
    if business.price:
        out = clean.clean_price(out, business.price)
    if business.discount:
        out = clean.clean_discount(out, business.discount)
    return out


def write_cleaned(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to Parquet, exactly once, then stop."""
    return (
        clean_rows(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
