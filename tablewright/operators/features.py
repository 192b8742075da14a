"""Derived columns. Row-level ones are pure projections; scaling and encoding read one
small aggregate first and then project with its numbers as literals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, roles
from ..functions.expr import half_up, money_sum, tier
from . import order


def _prefix(column: str, fallback: str) -> str:
    return column.replace("_date", "").replace("date_", "").strip("_") or fallback


def _calendar(column: str, prefix: str) -> dict[str, Column]:
    day = F.col(column)
    return {
        f"{prefix}_year": F.year(day),
        f"{prefix}_quarter": F.quarter(day),
        f"{prefix}_month": F.month(day),
        f"{prefix}_day_of_week": F.weekday(day) + 1,
    }


def calendar_parts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Year, quarter, month, ISO weekday and weekend flag of every date column."""
    added: dict[str, Column] = {}
    for c in columns or roles.date_columns(df):
        p = _prefix(c, "date")
        added |= _calendar(c, p)
        added[f"is_{p}_weekend"] = (F.weekday(c) >= 5).cast("int")
    return df.withColumns(added) if added else df


def calendar_parts_if_absent(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The calendar parts without the flag, only where the year column does not exist yet."""
    added: dict[str, Column] = {}
    for c in columns or roles.date_columns(df):
        p = _prefix(c, "time")
        if f"{p}_year" not in df.columns:
            added |= _calendar(c, p)
    return df.withColumns(added) if added else df


def fulfilment_days(df: DataFrame, ordered: str, delivered: str, out: str = "delivery_days") -> DataFrame:
    return df.withColumn(out, F.greatest(F.datediff(F.col(delivered), F.col(ordered)), F.lit(0)))


def wide_years_to_long(
    df: DataFrame, entity: list[str], value: str = "value", years: list[tuple[int, str]] | None = None
) -> DataFrame:
    """One row per entity and yearly column."""
    years = years or roles.year_columns(df)
    arms = [F.struct(F.lit(y).alias("year"), F.col(f"`{c}`").cast("double").alias(value)) for y, c in years]
    rows = df.select(*[F.col(f"`{e}`") for e in entity], F.explode(F.array(*arms)).alias("__cell"))
    return rows.select(*[F.col(f"`{e}`") for e in entity], "__cell.year", f"__cell.{value}")


def horizon_years(latest_year: int, target_year: int | None = None, horizon: str | int | None = None) -> int:
    """Years to project: from the target year, else the first number in the text, else the default."""
    if target_year:
        return target_year - latest_year
    found = re.search(r"\d+", str(horizon)) if horizon else None
    return int(found.group()) if found else fixed.DEFAULT_HORIZON


def cagr_rate(oldest: Column, latest: Column, years: int) -> Column:
    """Yearly growth between two values, clipped."""
    ratio = latest.cast("double") / F.greatest(oldest.cast("double"), F.lit(1.0))
    grown = F.pow(ratio, F.lit(1.0 / max(years, 1))) - 1.0
    return F.least(F.greatest(grown, F.lit(fixed.CAGR_FLOOR)), F.lit(fixed.CAGR_CEILING))


def cagr(
    df: DataFrame, oldest: str | None = None, latest: str | None = None, years: int | None = None,
    out: str = "historical_cagr_pct",
) -> DataFrame:
    (y0, c0), (y1, c1) = _span(df, oldest, latest)
    rate = cagr_rate(F.col(f"`{c0}`"), F.col(f"`{c1}`"), years or y1 - y0)
    return df.withColumn(out, half_up(rate * 100.0, 4))


def _span(df: DataFrame, oldest: str | None, latest: str | None) -> tuple[tuple[int, str], tuple[int, str]]:
    if oldest and latest:
        return (roles.year_of(oldest) or 0, oldest), (roles.year_of(latest) or 0, latest)
    years = roles.year_columns(df)
    if len(years) < 2:
        raise ValueError("two yearly columns are needed")
    return years[0], years[-1]


def projected_name(latest: str, target_year: int) -> str:
    base = re.sub(r"(?<!\d)(?:19|20)\d\d(?!\d)", "", latest.lower())
    return f"{target_year}_projected_" + "_".join(t for t in re.split(r"[\s_]+", base) if t)


def project_value(
    df: DataFrame, target_year: int | None = None, horizon: str | int | None = None, out: str | None = None,
    oldest: str | None = None, latest: str | None = None,
) -> DataFrame:
    """Latest value grown at the clipped rate until the target year, as a whole number."""
    (y0, c0), (y1, c1) = _span(df, oldest, latest)
    ahead = horizon_years(y1, target_year, horizon)
    rate = cagr_rate(F.col(f"`{c0}`"), F.col(f"`{c1}`"), y1 - y0)
    value = F.round(F.col(f"`{c1}`") * F.pow(1.0 + rate, F.lit(float(ahead))), 0).try_cast("bigint")
    return df.withColumn(out or projected_name(c1, y1 + ahead), value)


def project_net_growth(df: DataFrame, projected: str, latest: str, out: str = "projected_net_growth") -> DataFrame:
    return df.withColumn(out, F.col(f"`{projected}`") - F.col(f"`{latest}`"))


def project_growth_pct(df: DataFrame, projected: str, latest: str, out: str = "projected_growth_pct") -> DataFrame:
    now = F.col(f"`{latest}`").cast("double")
    gain = (F.col(f"`{projected}`") - F.col(f"`{latest}`")) / F.greatest(now, F.lit(1.0))
    return df.withColumn(out, half_up(gain * 100.0, 2))


def project_growth(
    df: DataFrame, target_year: int | None = None, horizon: str | int | None = None
) -> DataFrame:
    """Rate, projection, net growth and growth in percent, named after the years used."""
    (_, _), (y1, c1) = _span(df, None, None)
    ahead = horizon_years(y1, target_year, horizon)
    name = projected_name(c1, y1 + ahead)
    out = project_value(cagr(df), target_year, horizon, name)
    out = project_net_growth(out, name, c1, f"projected_{ahead}y_net_growth")
    return project_growth_pct(out, name, c1, f"projected_{ahead}y_growth_pct")


def profit_margin(df: DataFrame, profit: str, sales: str, out: str = "profit_margin") -> DataFrame:
    return df.withColumn(out, half_up(F.col(profit) / F.greatest(F.col(sales), F.lit(0.01)) * 100.0, 2))


def revenue_per_unit(df: DataFrame, sales: str, quantity: str, out: str = "revenue_per_unit") -> DataFrame:
    units = F.when(F.col(quantity) == 0, F.lit(1.0)).otherwise(F.col(quantity))
    return df.withColumn(out, half_up(F.col(sales) / units, 2))


def estimated_margin(df: DataFrame, sales: str, cogs_ratio: float = fixed.COGS_RATIO) -> DataFrame:
    """Cost, profit and margin under an assumed cost ratio: an assumption, not a measurement."""
    keep = round(1.0 - cogs_ratio, 10)
    return df.withColumns(
        {
            "estimated_cogs": half_up(F.col(sales) * cogs_ratio, 2),
            "gross_profit": half_up(F.col(sales) * keep, 2),
            "profit_margin_pct": F.lit(round(keep * 100.0, 8)),
        }
    )


def discount_amount(
    df: DataFrame, quantity: str, price: str, discount: str, out: str = "discount_amount"
) -> DataFrame:
    return df.withColumn(out, half_up(F.col(quantity) * F.col(price) * F.col(discount), 2))


def _moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """count, min, max, mean and sample deviation of all columns in one pass."""
    row = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: row[f"s{i}"].asDict() for i, c in enumerate(columns)}


def _scalable(df: DataFrame, columns: list[str] | None) -> list[str]:
    return columns or roles.measure_columns(df)[:3]


def minmax_scale(df: DataFrame, columns: list[str] | None = None, stats: dict | None = None) -> DataFrame:
    columns = _scalable(df, columns)
    stats = stats or _moments(df, columns)
    added = {
        f"{c}_minmax": half_up((F.col(c) - s["min"]) / (s["max"] - s["min"]), 4)
        for c in columns
        if (s := stats[c])["n"] >= 2 and s["max"] > s["min"]
    }
    return df.withColumns(added) if added else df


def zscore_scale(df: DataFrame, columns: list[str] | None = None, stats: dict | None = None) -> DataFrame:
    columns = _scalable(df, columns)
    stats = stats or _moments(df, columns)
    added = {
        f"{c}_zscore": half_up((F.col(c) - s["mean"]) / (s["std"] or 1.0), 4)
        for c in columns
        if (s := stats[c])["n"] >= 2
    }
    return df.withColumns(added) if added else df


def log1p(df: DataFrame, columns: list[str] | None = None, stats: dict | None = None) -> DataFrame:
    columns = _scalable(df, columns)
    stats = stats or _moments(df, columns)
    added = {f"{c}_log1p": half_up(F.log1p(c), 4) for c in columns if (s := stats[c])["n"] >= 2 and s["min"] >= 0}
    return df.withColumns(added) if added else df


def scale_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The three scalings from one pass over the table."""
    columns = _scalable(df, columns)
    stats = _moments(df, columns)
    return log1p(zscore_scale(minmax_scale(df, columns, stats), columns, stats), columns, stats)


def revenue_tier(df: DataFrame, sales: str, out: str = "sales_revenue_tier") -> DataFrame:
    return df.withColumn(out, tier(F.col(sales), fixed.REVENUE_TIERS, fixed.REVENUE_TIER_REST))


def satisfaction_tier(df: DataFrame, rating: str, out: str = "satisfaction_sentiment") -> DataFrame:
    return df.withColumn(out, tier(F.col(rating), fixed.SATISFACTION_TIERS, fixed.SATISFACTION_TIER_REST))


def small_dictionaries(df: DataFrame, columns: list[str], limit: int = 15) -> dict[str, list[tuple[str, int]]]:
    """Values and counts of the text columns with at most ``limit`` values, in one grouped pass.

    Only ``limit + 1`` values per column are kept before anything reaches the driver.
    """
    if not columns:
        return {}
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = texts.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    rows = counts.where(F.col("value").isNotNull()).withColumn("place", place).where(F.col("place") <= limit + 1)
    found: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in rows.collect():
        found[r["column"]].append((r["value"], r["n"]))
    return {c: sorted(v) for c, v in found.items() if len(v) <= limit}


def _lookup(c: str, pairs: list[tuple[str, object]], kind: str) -> Column:
    if not pairs:
        return F.lit(None).cast(kind)
    entries = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(entries, F.col(c)).cast(kind)


def label_encode(
    df: DataFrame, columns: list[str] | None = None, limit: int = 15, dictionaries: dict | None = None
) -> DataFrame:
    """Position of the value in sorted order; at most ``limit`` values per column, so the
    dictionary is a literal map and no join is needed."""
    dictionaries = dictionaries or _encodable(df, columns, limit)
    added = {
        f"{c}_encoded": _lookup(c, [(v, i) for i, (v, _) in enumerate(pairs)], "int")
        for c, pairs in dictionaries.items()
    }
    return df.withColumns(added) if added else df


def frequency_encode(
    df: DataFrame, columns: list[str] | None = None, limit: int = 15, dictionaries: dict | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Share of all rows that hold the value."""
    dictionaries = dictionaries or _encodable(df, columns, limit)
    if not dictionaries:
        return df
    rows = max(df.count() if rows is None else rows, 1)
    added = {
        f"{c}_freq_pct": half_up(_lookup(c, pairs, "double") / F.lit(float(rows)), 4)
        for c, pairs in dictionaries.items()
    }
    return df.withColumns(added)


def _encodable(df: DataFrame, columns: list[str] | None, limit: int) -> dict[str, list[tuple[str, int]]]:
    if columns:
        found = small_dictionaries(df, columns, limit)
        wide = [c for c in columns if c not in found]
        if wide:
            raise ValueError(f"more than {limit} values in {wide}")
        return found
    candidates = [c for c in roles.dimension_columns(df) if not c.endswith(("_tier", "_sentiment"))]
    found = small_dictionaries(df, candidates, limit)
    return {c: found[c] for c in [c for c in candidates if c in found][:3]}


def long_texts(df: DataFrame) -> list[str]:
    """The first two text columns with more than five values."""
    candidates = roles.dimension_columns(df)
    if not candidates:
        return []
    row = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(candidates)]).first()
    return [c for i, c in enumerate(candidates) if row[f"d{i}"] > 5][:2]


def text_length(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Characters per cell, 0 for null."""
    columns = long_texts(df) if columns is None else columns
    added = {f"{c}_char_length": F.coalesce(F.char_length(c), F.lit(0)) for c in columns}
    return df.withColumns(added) if added else df


def column_total(df: DataFrame, value: str) -> float:
    return df.agg(money_sum(F.col(value))).first()[0] or 1.0


def pct_of_total(df: DataFrame, value: str, out: str | None = None, total: float | None = None) -> DataFrame:
    """Share of each row in the column's sum; the sum is one aggregate, no window."""
    total = column_total(df, value) if total is None else total
    return df.withColumn(out or f"{value}_pct_of_total", half_up(F.col(value) / F.lit(total) * 100.0, 4))


def running_total(
    df: DataFrame, value: str, order_by: list[str], buckets: int | None = None, made: list[str] | None = None,
    spent: list[str] | None = None, source: DataFrame | None = None,
) -> DataFrame:
    return order.running_total(df, value, order_by, buckets=buckets, made=made, spent=spent, source=source)


def dense_rank_desc(
    df: DataFrame, value: str, out: str | None = None, buckets: int | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Place of the row's value among the different values, the largest first; null has none.

    ``source`` may name an earlier, narrower table with the same values.
    """
    return order.ranked_by_value(df, {value: out or f"{value}_rank"}, "dense", True, buckets, source)
