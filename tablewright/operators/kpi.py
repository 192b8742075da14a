"""Ready-made business queries: grouped aggregates with a fixed output schema.

Money is summed as decimal, so results do not depend on task order. Grouping is partial
first, so a hot key costs one row per task in the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import half_up, money_avg, money_sum, rounded_sum
from . import order


def _sum2(c: str) -> Column:
    return rounded_sum(F.col(c))


def _avg2(c: str) -> Column:
    return half_up(money_avg(F.col(c)), 2)


def top_categories(
    df: DataFrame, category: str = "category", sales: str = "total_sales", price: str = "unit_price",
    discount: str = "discount_percent", limit: int = 10,
) -> DataFrame:
    return (
        df.groupBy(F.coalesce(F.col(category), F.lit("All Categories")).alias("product_category"))
        .agg(
            F.count("*").alias("total_orders"),
            _sum2(sales).alias("gross_revenue"),
            half_up(F.avg(price), 2).alias("avg_unit_price"),
            half_up(F.avg(discount) * 100, 1).alias("avg_discount_pct"),
        )
        .orderBy(F.desc("gross_revenue"), "product_category")
        .limit(limit)
    )


def _growth(value: str, previous: str, digits: int) -> Column:
    rise = F.try_divide(F.col(value) - F.col(previous), F.nullif(F.col(previous), F.lit(0)))
    return half_up(rise * 100, digits)


def lag_growth(
    df: DataFrame, period: str, value: str, previous: str, growth: str, digits: int = 2, buckets: int | None = None
) -> DataFrame:
    """Previous period and growth in percent, null when the previous value is 0.

    The periods may be any number: they are ordered over ranges.
    """
    rows = order.previous(df, value, [period], previous, buckets)
    return rows.withColumn(growth, _growth(value, previous, digits))


def monthly_mom(df: DataFrame, date: str = "order_date", sales: str = "total_sales") -> DataFrame:
    monthly = (
        df.withColumn("order_month", F.date_format(F.col(date).try_cast("date"), "yyyy-MM"))
        .where(F.col(date).isNotNull())
        .groupBy("order_month")
        .agg(_sum2(sales).alias("monthly_revenue"), F.count("*").alias("order_volume"))
    )
    # one row per calendar month, so one window holds them
    before = F.lag("monthly_revenue").over(Window.orderBy("order_month"))
    return monthly.withColumn("prev_month_revenue", before).withColumn(
        "mom_growth_pct", _growth("monthly_revenue", "prev_month_revenue", 2)
    ).orderBy("order_month")


def share_over_total(df: DataFrame, value: str, out: str, digits: int = 2) -> DataFrame:
    """Percent of the sum over all rows; the sum is one aggregate, no window over the rows."""
    total = df.agg(money_sum(F.col(value))).first()[0]
    whole = F.lit(total).cast("double")
    return df.withColumn(out, half_up(F.try_divide((F.col(value) * 100).cast("double"), whole), digits))


def region_share(df: DataFrame, region: str = "region", sales: str = "total_sales") -> DataFrame:
    grouped = df.groupBy(F.coalesce(F.col(region), F.lit("Unknown")).alias("sales_region")).agg(
        F.count("*").alias("total_orders"),
        _sum2(sales).alias("regional_revenue"),
        _avg2(sales).alias("avg_order_value"),
        money_sum(F.col(sales)).alias("__sum"),
    )
    return (
        share_over_total(grouped, "__sum", "revenue_share_pct")
        .drop("__sum")
        .orderBy(F.desc("regional_revenue"), "sales_region")
    )


def _per_customer(df: DataFrame, customer: str, sales: str) -> DataFrame:
    return (
        df.where(F.col(customer).isNotNull())
        .groupBy(customer)
        .agg(
            F.count("*").alias("order_frequency"),
            money_sum(F.col(sales)).alias("__sum"),
            _sum2(sales).alias("monetary_lifetime_value"),
            _avg2(sales).alias("avg_basket_size"),
        )
    )


def customer_rank(
    df: DataFrame, customer: str = "customer_id", sales: str = "total_sales", limit: int = 15
) -> DataFrame:
    """The best customers with their dense rank.

    Every sum above one of the best rows is itself among the best rows, so ranking these
    few rows gives the rank over all customers.
    """
    best = _per_customer(df, customer, sales).orderBy(F.desc("__sum"), customer).limit(limit)
    rank = F.dense_rank().over(Window.orderBy(F.desc("__sum"))).cast("bigint")
    return best.withColumn("customer_rank", rank).drop("__sum")


def dense_rank_over_agg(df: DataFrame, key: str, value: str, out: str = "value_rank", buckets: int | None = None):
    """Sum per key and the dense rank of every key by it; ranked in range buckets."""
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(money_sum(F.col(value)).alias("total"))
    return order.global_rank(grouped, "total", out, "dense", descending=True, buckets=buckets)


def rank_over_agg(df: DataFrame, cohort: str, value: str, null_label: str = "All") -> DataFrame:
    """Count, sum, mean, share and rank per cohort; cohorts are ranked in ranges, so there may be any number."""
    grouped = df.groupBy(F.coalesce(F.col(cohort).cast("string"), F.lit(null_label)).alias("cohort")).agg(
        F.count("*").alias("total_records"), _sum2(value).alias("total_metric"), _avg2(value).alias("avg_metric")
    )
    ranked = order.global_rank(grouped.withColumn("__down", -F.col("total_metric")), "__down", "cohort_rank", "min")
    return share_over_total(ranked.drop("__down"), "total_metric", "share_of_total", 1)


def payment_mix(
    df: DataFrame, method: str = "payment_method", sales: str = "total_sales", rating: str = "customer_satisfaction"
) -> DataFrame:
    return (
        df.groupBy(F.coalesce(F.col(method), F.lit("Direct Payment")).alias("payment_type"))
        .agg(
            F.count("*").alias("transaction_count"),
            _sum2(sales).alias("total_processed_volume"),
            _avg2(sales).alias("avg_transaction_value"),
            half_up(F.avg(rating), 2).alias("avg_csat_rating"),
        )
        .orderBy(F.desc("total_processed_volume"), "payment_type")
    )


def percent_rank_filter(
    df: DataFrame, value: str, threshold: float = 0.95, out: str = "sales_percentile", digits: int = 4,
    buckets: int | None = None,
) -> DataFrame:
    """Rows whose rounded percent rank reaches the threshold.

    A sketched quantile below the threshold discards the low rows before anything is shuffled;
    how many they are is counted, so the ranks stay exact. Of several cuts, counted in one pass,
    the highest that is safe is taken. Null values sort first and take the lowest rank.
    """
    v = F.col(value)
    tried = [max(threshold - d, 0.0) for d in (0.01, 0.05, 0.25)]
    cuts = df.agg(F.percentile_approx(v, tried, 10000).alias("cuts")).first()["cuts"]
    if not cuts:
        return df.withColumn(out, F.lit(0.0)).where(F.lit(threshold <= 0))
    cuts = [*cuts, -math.inf]
    seen = df.agg(
        F.count("*").alias("rows"), *[F.count_if(v.isNull() | (v < cut)).alias(f"below{i}") for i, cut in enumerate(cuts)]
    ).first()
    rows = seen["rows"]
    # the highest cut below which no row can reach the threshold; the last one only leaves out nulls
    fits = [i for i in range(len(cuts) - 1) if seen[f"below{i}"] < (threshold - 10.0**-digits) * (rows - 1)]
    chosen = fits[0] if fits else len(cuts) - 1
    kept, skipped = df.where(v.isNotNull() & (v >= cuts[chosen])), seen[f"below{chosen}"]
    ranked = order.global_rank(kept, value, "__rank", "min", buckets=buckets)
    share = half_up((F.col("__rank") - 1 + skipped) / F.lit(float(max(rows - 1, 1))), digits)
    return ranked.withColumn(out, share).where(F.col(out) >= threshold).drop("__rank")


def high_value_orders(
    df: DataFrame, sales: str = "total_sales", key: list[str] | None = None, threshold: float = 0.95, limit: int = 20
) -> DataFrame:
    """The largest orders with their percent rank.

    Only the smallest listed value can have ties outside the list, so one count of rows
    above and at it is enough to rank the list; nothing is shuffled but the top rows.
    """
    key = key or ["order_id"]
    top = df.where(F.col(sales).isNotNull()).orderBy(F.desc(sales), *key).limit(limit)
    # `limit` rows: held as a local table, so that the input is read twice and not four times
    listed = top.collect()
    best = df.sparkSession.createDataFrame(listed, top.schema)
    edge = min((r[sales] for r in listed), default=None)
    if edge is None:
        return best.withColumn("sales_percentile", F.lit(None).cast("double"))
    seen = df.agg(
        F.count("*").alias("rows"), F.count_if(F.col(sales) > edge).alias("above"),
        F.count_if(F.col(sales) == edge).alias("at"),
    ).first()
    larger = F.count("*").over(Window.orderBy(F.desc(sales)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    up_to = F.when(F.col(sales) == edge, F.lit(seen["above"] + seen["at"])).otherwise(larger)
    share = half_up((F.lit(seen["rows"]) - up_to) / F.lit(float(max(seen["rows"] - 1, 1))), 4)
    return best.withColumn("sales_percentile", share).where(F.col("sales_percentile") >= threshold)


def metric_by_dims(df: DataFrame, metric: str, dims: list[str], limit: int = 20) -> DataFrame:
    """Count, sum and mean of a metric by one or two dimensions, largest sums first."""
    name = "_".join(metric.lower().replace("/", " ").split())
    number = F.col(f"`{metric}`").try_cast("double")
    return (
        df.where(F.col(f"`{dims[0]}`").isNotNull())
        .groupBy(*[F.col(f"`{d}`") for d in dims])
        .agg(
            F.count("*").alias("row_count"),
            rounded_sum(number).alias(f"total_{name}"),
            half_up(money_avg(number), 2).alias(f"avg_{name}"),
        )
        .orderBy(F.desc(f"total_{name}"), *[F.col(f"`{d}`") for d in dims])
        .limit(limit)
    )


def top_entities(
    df: DataFrame, entity: str, measure: str, group: str | None = None, projected: str | None = None, limit: int = 15
) -> DataFrame:
    shown = [F.col(f"`{entity}`").alias("country")]
    if group:
        shown.append(F.col(f"`{group}`").alias("continent"))
    shown.append(F.col(f"`{measure}`").alias("current_population"))
    if projected:
        shown.append(F.col(f"`{projected}`").alias("projected_population"))
    rows = df.where(F.col(f"`{entity}`").isNotNull()).select(*shown)
    return rows.orderBy(F.col("current_population").desc_nulls_last(), "country").limit(limit)


def group_rollup(df: DataFrame, group: str, measure: str, projected: str | None = None) -> DataFrame:
    sums = [F.count("*").alias("total_countries"),
            F.sum(F.col(f"`{measure}`").try_cast("bigint")).alias("current_continent_population")]
    if projected:
        sums.append(F.sum(F.col(f"`{projected}`").try_cast("bigint")).alias("projected_continent_population"))
    rows = df.where(F.col(f"`{group}`").isNotNull())
    return (
        rows.groupBy(F.col(f"`{group}`").alias("continent"))
        .agg(*sums)
        .orderBy(F.desc("current_continent_population"), "continent")
    )


def growth_leaders(df: DataFrame, entity: str, rate: str, group: str | None = None, limit: int = 15) -> DataFrame:
    shown = [F.col(f"`{entity}`").alias("country")]
    if group:
        shown.append(F.col(f"`{group}`").alias("continent"))
    shown.append(F.col(f"`{rate}`").alias("demographic_growth_velocity"))
    rows = df.where(F.col(f"`{entity}`").isNotNull() & F.col(f"`{rate}`").isNotNull()).select(*shown)
    return rows.orderBy(F.desc("demographic_growth_velocity"), "country").limit(limit)
