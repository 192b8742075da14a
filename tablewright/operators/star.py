"""Star schema tables, their checks, and measures over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import roles
from ..functions.expr import half_up, money_sum, rounded_sum
from ..session import materialize
from . import order

def dim_date(df: DataFrame, date: str) -> DataFrame:
    """One row per day between the first and the last date."""
    span = df.agg(F.min(F.col(date).cast("date")).alias("a"), F.max(F.col(date).cast("date")).alias("z"))
    days = span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "z")).alias("Date"))
    return days.select(
        "Date", F.year("Date").alias("Year"), F.quarter("Date").alias("Quarter"), F.month("Date").alias("Month"),
        F.date_format("Date", "MMMM").alias("MonthName"), (F.weekday("Date") + 1).alias("DayOfWeek"),
    )


def dim_category(df: DataFrame, column: str, key: str | None = None, buckets: int | None = None) -> DataFrame:
    """The distinct values, numbered in sorted order; null is left out.

    A dimension may grow with the fact table, so it is numbered in ranges.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return order.global_row_number(values, [column], key or f"{column}_key", buckets)


def fact_dim_join(fact: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """The fact table with the surrogate key of each dimension instead of its value.

    Left equi-joins: a fact row without a dimension row keeps a null key. Dimensions are written
    first, so that Spark knows their size: it broadcasts those below its threshold, and the fact
    table is not shuffled on a handful of values; larger ones are merge-joined.
    """
    out = fact
    for column, dim in dimensions.items():
        out = out.join(materialize(dim, "dimension")[0], column, "left").drop(column)
    return out


def star_schema(df: DataFrame, date: str | None = None, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """The fact table, the calendar and one dimension per text column."""
    columns = columns or roles.dimension_columns(df)
    date = date or next(iter(roles.date_columns(df)), None)
    dims = {c: dim_category(df, c) for c in columns}
    tables = {"Dim" + "".join(p.capitalize() for p in c.replace("/", "_").replace(" ", "_").split("_")): d
              for c, d in dims.items()}
    if date:
        tables["DimDate"] = dim_date(df, date)
    tables["FactData"] = fact_dim_join(df, dims)
    return tables


def fact_orphans(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, name: str) -> DataFrame:
    """Check of a many-to-one relationship: fact rows without a dimension row, dimension keys
    that occur more than once. Keys are counted first, so a hot key joins as one row."""
    keys = fact.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("k")).agg(F.count("*").alias("n"))
    dims = dim.groupBy(F.col(dim_key).alias("k")).agg(F.count("*").alias("d"))
    orphans = keys.join(dims, "k", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count("*").alias("orphan_keys")
    ).first()
    doubled = dims.where("d > 1").count()
    return fact.agg(
        F.lit(name).alias("relationship"), F.count("*").alias("fact_rows"),
        F.count_if(F.col(fact_key).isNull()).alias("null_keys"),
        F.lit(orphans["orphan_rows"]).cast("bigint").alias("orphan_rows"),
        F.lit(orphans["orphan_keys"]).cast("bigint").alias("orphan_keys"),
        F.lit(doubled).cast("bigint").alias("duplicate_dim_keys"),
    )


def measure_totals(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Sum of every measure, row count, and the target per transaction, as rows."""
    columns = columns or [
        c for c in roles.numeric_columns(df)
        if c != target and not roles.is_id(c) and not roles.has_token(c, "year", "month", "quarter")
    ]
    row = df.agg(
        *[rounded_sum(F.col(c)).alias(f"Total {c}") for c in [target, *columns]],
        F.count("*").cast("double").alias("Total Transactions"),
        half_up(F.try_divide(money_sum(F.col(target)), F.count("*")), 2).alias("Average Transaction Value"),
    )
    names = row.columns
    return row.unpivot([], names, "measure", "value")


def measure_prior_year(df: DataFrame, date: str, target: str) -> DataFrame:
    """Total per month beside the total of the same month a year earlier.

    The months are summed first; the self-join runs on these few rows.
    """
    monthly = df.where(F.col(date).isNotNull()).groupBy(F.trunc(date, "month").alias("month")).agg(
        rounded_sum(F.col(target)).alias("total")
    )
    earlier = monthly.select(F.add_months("month", 12).alias("month"), F.col("total").alias("total_last_year"))
    return monthly.join(earlier, "month", "left").select("month", "total", "total_last_year")


def measure_yoy_growth(df: DataFrame, date: str, target: str) -> DataFrame:
    before = F.col("total_last_year")
    growth = F.try_divide(F.col("total") - before, F.nullif(before, F.lit(0.0)))
    return measure_prior_year(df, date, target).withColumn("yoy_growth", half_up(growth, 4))


def measure_entity_totals(df: DataFrame, current: str, projected: str | None = None, rate: str | None = None) -> DataFrame:
    measures = [F.sum(f"`{current}`").cast("double").alias("Total"), F.count("*").cast("double").alias("Total Entities")]
    if projected:
        measures.append(F.sum(f"`{projected}`").cast("double").alias("Total Projected"))
    if rate:
        measures.append(half_up(F.avg(f"`{rate}`"), 4).alias("Average Growth"))
    row = df.agg(*measures)
    return row.unpivot([], row.columns, "measure", "value")


def matrix_two_dims(
    df: DataFrame, rows: str, columns: str, measure: str, wide: bool = False, heads: list | None = None
) -> DataFrame:
    """A measure by two dimensions, one row per cell, or ``wide`` with one column per head.

    ``heads`` are the values of the second dimension that become columns; without them Spark
    takes all, up to ``spark.sql.pivotMaxValues``.
    """
    if not wide:
        return df.groupBy(rows, columns).agg(rounded_sum(F.col(measure)).alias("total"))
    known = df if heads is not None else df.where(F.col(columns).isNotNull())
    pivoted = known.groupBy(rows).pivot(columns, heads).agg(rounded_sum(F.col(measure)))
    if heads is not None:
        return pivoted
    every = df.select(rows).distinct().withColumnRenamed(rows, "__row")  # rows whose second value is missing stay
    return every.join(pivoted, F.col("__row").eqNullSafe(F.col(rows)), "left").select(
        F.col("__row").alias(rows), *[c for c in pivoted.columns if c != rows]
    )
