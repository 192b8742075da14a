"""KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import features, kpi
from tablewright.plans import suite
from tablewright.session import materialize
from tablewright.sources import files

from .inputs import CENSUS_CTE, ORDER_KEY, SALES_CTE, census, money_avg, money_sum, query, rounded, sales, sql, sum2

LATEST = "2001 Population"
PROJECTED = "2021_projected_population"


def projected_census(spark, sf):
    return features.project_growth(census(spark, sf))


def mom(spark, sf):
    return kpi.monthly_mom(sales(spark, sf))


def lag(spark, sf):
    monthly = (
        sales(spark, sf)
        .groupBy(F.date_format("delivery_date", "yyyy-MM").alias("month"))
        .agg(F.sum(F.col("quantity").cast("bigint")).alias("units"))
    )
    return kpi.lag_growth(monthly, "month", "units", "prev_units", "growth_pct")


def share(spark, sf):
    grouped = sales(spark, sf).groupBy("product").agg(
        F.sum(F.col("total_sales").cast("decimal(28,10)")).cast("double").alias("total")
    )
    return kpi.share_over_total(grouped, "total", "share_pct")


def high_value(spark, sf):
    rows = kpi.high_value_orders(sales(spark, sf), key=ORDER_KEY)
    return rows.select("order_id", "line_no", "customer_id", "order_date", "category", "region", "total_sales",
                       "quantity", "unit_price", "sales_percentile")


def percent_rank(spark, sf):
    rows = sales(spark, sf).select(*ORDER_KEY, "total_sales")
    return kpi.percent_rank_filter(rows, "total_sales", 0.95)


def retail_suite(spark, sf):
    return suite.kpi_suite(materialize(sales(spark, sf), "sales")[0], order_key=ORDER_KEY, target="total_sales", dims=["region", "category"]
                           ).select("template", "dimension", "measure", F.round("value", 3).alias("value"))


def readonly(spark, sf):
    files.register_views(sales(spark, sf), ["analytics_data"])
    return suite.sql_readonly(
        spark,
        "SELECT region, category, COUNT(*) AS orders, "
        "ROUND(SUM(CAST(total_sales AS DECIMAL(18,4))), 2) AS revenue -- update nothing\n"
        "FROM analytics_data WHERE category <> 'drop' GROUP BY region, category;",
        limit=500,
    )


QUERIES = {
    "kpi_top_categories": query(lambda s, d: kpi.top_categories(sales(s, d))),
    "kpi_monthly_mom": query(mom),
    "kpi_region_share": query(lambda s, d: kpi.region_share(sales(s, d))),
    "kpi_customer_rank": query(lambda s, d: kpi.customer_rank(sales(s, d))),
    "kpi_payment_mix": query(lambda s, d: kpi.payment_mix(sales(s, d))),
    "kpi_high_value_orders": query(high_value),
    "kpi_metric_by_dims": query(lambda s, d: kpi.metric_by_dims(sales(s, d), "total_sales", ["region", "category"])),
    "kpi_top_entities": query(
        lambda s, d: kpi.top_entities(projected_census(s, d), "Country/Territory", LATEST, "Continent", PROJECTED)
    ),
    "kpi_group_rollup": query(lambda s, d: kpi.group_rollup(projected_census(s, d), "Continent", LATEST, PROJECTED)),
    "kpi_growth_leaders": query(
        lambda s, d: kpi.growth_leaders(projected_census(s, d), "Country/Territory", "historical_cagr_pct", "Continent")
    ),
    "kpi_suite": query(retail_suite),
    "kpi_suite_yearly": query(lambda s, d: suite.kpi_suite(projected_census(s, d))),
    "sql_readonly": query(readonly),
    "lag_growth": query(lag),
    "share_over_total": query(share),
    "dense_rank_over_agg": query(
        lambda s, d: kpi.dense_rank_over_agg(sales(s, d), "customer_id", "total_sales", "customer_rank")
    ),
    "percent_rank_filter": query(percent_rank),
    "rank_over_agg": query(lambda s, d: kpi.rank_over_agg(sales(s, d), "region", "total_sales")),
}

TOP_CATEGORIES = f"""SELECT COALESCE(category, 'All Categories') AS product_category, COUNT(*) AS total_orders,
  {sum2('total_sales')} AS gross_revenue, {rounded('AVG(unit_price)', 2)} AS avg_unit_price,
  {rounded('AVG(discount_percent) * 100', 1)} AS avg_discount_pct
FROM sales GROUP BY 1 ORDER BY gross_revenue DESC, 1 LIMIT 10"""

MOM = f"""SELECT order_month, monthly_revenue, order_volume, prev_month_revenue,
  {rounded('(monthly_revenue - prev_month_revenue) / NULLIF(prev_month_revenue, 0) * 100', 2)} AS mom_growth_pct
FROM (SELECT *, LAG(monthly_revenue) OVER (ORDER BY order_month) AS prev_month_revenue FROM (
  SELECT strftime(order_date, '%Y-%m') AS order_month, {sum2('total_sales')} AS monthly_revenue,
    COUNT(*) AS order_volume FROM sales WHERE order_date IS NOT NULL GROUP BY 1))"""

REGION_SHARE = f"""SELECT COALESCE(region, 'Unknown') AS sales_region, COUNT(*) AS total_orders,
  {sum2('total_sales')} AS regional_revenue, {rounded(money_avg('total_sales'), 2)} AS avg_order_value,
  {rounded("CAST(SUM(CAST(total_sales AS DECIMAL(28,10))) * 100 AS DOUBLE) / "
           "CAST(SUM(SUM(CAST(total_sales AS DECIMAL(28,10)))) OVER () AS DOUBLE)", 2)} AS revenue_share_pct
FROM sales GROUP BY 1"""

CUSTOMERS = f"""SELECT customer_id, COUNT(*) AS order_frequency,
  {sum2('total_sales')} AS monetary_lifetime_value,
  {rounded(money_avg('total_sales'), 2)} AS avg_basket_size,
  DENSE_RANK() OVER (ORDER BY SUM(CAST(total_sales AS DECIMAL(28,10))) DESC) AS customer_rank
FROM sales WHERE customer_id IS NOT NULL GROUP BY 1 ORDER BY monetary_lifetime_value DESC, customer_rank, 1 LIMIT 15"""

PAYMENT = f"""SELECT COALESCE(payment_method, 'Direct Payment') AS payment_type, COUNT(*) AS transaction_count,
  {sum2('total_sales')} AS total_processed_volume,
  {rounded(money_avg('total_sales'), 2)} AS avg_transaction_value,
  {rounded('AVG(customer_satisfaction)', 2)} AS avg_csat_rating
FROM sales GROUP BY 1"""

RANKED = f"""ranked AS (SELECT *, {rounded('PERCENT_RANK() OVER (ORDER BY total_sales)', 4)} AS sales_percentile
FROM sales)"""

HIGH_VALUE = """SELECT order_id, CAST(line_no AS BIGINT) AS line_no, customer_id,
  strftime(order_date, '%Y-%m-%d') AS order_date, category, region, total_sales, quantity,
  unit_price, sales_percentile
FROM ranked WHERE sales_percentile >= 0.95
ORDER BY total_sales DESC, order_id, line_no, part_id, supplier_id LIMIT 20"""

BY_DIMS = f"""SELECT region, category, COUNT(*) AS row_count, {sum2('total_sales')} AS total_total_sales,
  {rounded(money_avg('total_sales'), 2)} AS avg_total_sales
FROM sales WHERE region IS NOT NULL GROUP BY 1, 2 ORDER BY total_total_sales DESC, region, category LIMIT 20"""

_RATE = 'LEAST(GREATEST(POWER(CAST("2001 Population" AS DOUBLE) / GREATEST("1995 Population", 1), 1.0 / 6) - 1, -0.03), 0.06)'
GROWTH_CTE = f"""growth AS (SELECT *, {rounded(_RATE + ' * 100', 4)} AS historical_cagr_pct,
  CAST(ROUND("2001 Population" * POWER(1 + {_RATE}, 20)) AS BIGINT) AS "{PROJECTED}" FROM census)"""
TOP_ENTITIES = f"""SELECT "Country/Territory" AS country, "Continent" AS continent,
  "2001 Population" AS current_population, "{PROJECTED}" AS projected_population
FROM growth ORDER BY "2001 Population" DESC, 1 LIMIT 15"""
ROLLUP = f"""SELECT "Continent" AS continent, COUNT(*) AS total_countries,
  CAST(SUM("2001 Population") AS BIGINT) AS current_continent_population,
  CAST(SUM("{PROJECTED}") AS BIGINT) AS projected_continent_population FROM growth GROUP BY 1"""
LEADERS = """SELECT "Country/Territory" AS country, "Continent" AS continent,
  historical_cagr_pct AS demographic_growth_velocity
FROM growth ORDER BY historical_cagr_pct DESC, 1 LIMIT 15"""


def _long(template: str, dimension: str, cte: str, measures: list[str], digits: bool = True) -> str:
    return " UNION ALL ".join(
        f"SELECT '{template}' AS template, {dimension} AS dimension, '{m}' AS measure, "
        + (f"ROUND(CAST({m} AS DOUBLE), 3)" if digits else f"CAST({m} AS DOUBLE)")
        + f" AS value FROM {cte}"
        for m in measures
    )


SUITE = sql(
    SALES_CTE, RANKED, f"t1 AS ({BY_DIMS})", f"t2 AS ({TOP_CATEGORIES})", f"t3 AS ({MOM})", f"t4 AS ({REGION_SHARE})",
    f"t5 AS ({CUSTOMERS})", f"t6 AS ({PAYMENT})",
    """t7 AS (SELECT concat_ws('-', order_id, line_no, part_id, supplier_id) AS order_ref, total_sales, quantity,
    unit_price, sales_percentile FROM ranked WHERE sales_percentile >= 0.95
    ORDER BY total_sales DESC, order_id, line_no, part_id, supplier_id LIMIT 20)""",
    query=" UNION ALL ".join([
        _long("target_metric_decomposition", "region || ' | ' || category",
              "(SELECT *, total_total_sales AS total FROM t1)", ["row_count", "total", "avg_total_sales"]),
        _long("top_products_revenue", "product_category", "t2",
              ["total_orders", "gross_revenue", "avg_unit_price", "avg_discount_pct"]),
        _long("monthly_sales_mom_growth", "order_month", "t3",
              ["monthly_revenue", "order_volume", "prev_month_revenue", "mom_growth_pct"]),
        _long("regional_contribution_share", "sales_region", "t4",
              ["total_orders", "regional_revenue", "avg_order_value", "revenue_share_pct"]),
        _long("customer_rfm_ranking", "CAST(customer_id AS VARCHAR)", "t5",
              ["order_frequency", "monetary_lifetime_value", "avg_basket_size", "customer_rank"]),
        _long("payment_method_aov", "payment_type", "t6",
              ["transaction_count", "total_processed_volume", "avg_transaction_value", "avg_csat_rating"]),
        _long("high_value_transaction_outliers", "order_ref", "t7",
              ["total_sales", "quantity", "unit_price", "sales_percentile"]),
    ]),
)

ORACLES = {
    "kpi_top_categories": sql(SALES_CTE, query=TOP_CATEGORIES),
    "kpi_monthly_mom": sql(SALES_CTE, query=MOM),
    "kpi_region_share": sql(SALES_CTE, query=REGION_SHARE),
    "kpi_customer_rank": sql(SALES_CTE, query=CUSTOMERS),
    "kpi_payment_mix": sql(SALES_CTE, query=PAYMENT),
    "kpi_high_value_orders": sql(SALES_CTE, RANKED, query=HIGH_VALUE),
    "kpi_metric_by_dims": sql(SALES_CTE, query=BY_DIMS),
    "kpi_top_entities": sql(CENSUS_CTE, GROWTH_CTE, query=TOP_ENTITIES),
    "kpi_group_rollup": sql(CENSUS_CTE, GROWTH_CTE, query=ROLLUP),
    "kpi_growth_leaders": sql(CENSUS_CTE, GROWTH_CTE, query=LEADERS),
    "kpi_suite": SUITE,
    "kpi_suite_yearly": sql(
        CENSUS_CTE, GROWTH_CTE, f"t1 AS ({TOP_ENTITIES})", f"t2 AS ({ROLLUP})", f"t3 AS ({LEADERS})",
        query=" UNION ALL ".join([
            _long("demographic_top_nations", "country", "t1", ["current_population", "projected_population"], False),
            _long("demographic_continent_rollup", "continent", "t2",
                  ["total_countries", "current_continent_population", "projected_continent_population"], False),
            _long("demographic_growth_leaders", "country", "t3", ["demographic_growth_velocity"], False),
        ]),
    ),
    "sql_readonly": sql(
        SALES_CTE,
        query="SELECT region, category, COUNT(*) AS orders, "
        "CAST(ROUND(SUM(CAST(total_sales AS DECIMAL(28,10))), 2) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2",
    ),
    "lag_growth": sql(
        SALES_CTE,
        query=f"""SELECT *, {rounded('CAST(units - prev_units AS DOUBLE) / NULLIF(prev_units, 0) * 100', 2)} AS growth_pct
FROM (SELECT *, LAG(units) OVER (ORDER BY month) AS prev_units FROM (
SELECT strftime(delivery_date, '%Y-%m') AS month, CAST(SUM(CAST(quantity AS BIGINT)) AS BIGINT) AS units
FROM sales GROUP BY 1))""",
    ),
    "share_over_total": sql(
        SALES_CTE,
        query=f"""SELECT product, {money_sum('total_sales')} AS total,
{rounded("CAST(SUM(CAST(total_sales AS DECIMAL(28,10))) AS DOUBLE) * 100 / "
         "CAST(SUM(SUM(CAST(total_sales AS DECIMAL(28,10)))) OVER () AS DOUBLE)", 2)} AS share_pct
FROM sales GROUP BY 1""",
    ),
    "dense_rank_over_agg": sql(
        SALES_CTE,
        query=f"""SELECT customer_id, {money_sum('total_sales')} AS total,
DENSE_RANK() OVER (ORDER BY SUM(CAST(total_sales AS DECIMAL(28,10))) DESC) AS customer_rank FROM sales GROUP BY 1""",
    ),
    "percent_rank_filter": sql(
        SALES_CTE, RANKED,
        query="SELECT order_id, CAST(line_no AS BIGINT) AS line_no, part_id, supplier_id, total_sales, sales_percentile "
        "FROM ranked WHERE sales_percentile >= 0.95",
    ),
    "rank_over_agg": sql(
        SALES_CTE,
        query=f"""SELECT *, {rounded('total_metric * 100 / SUM(total_metric) OVER ()', 1)} AS share_of_total,
RANK() OVER (ORDER BY total_metric DESC) AS cohort_rank FROM (
SELECT COALESCE(region, 'All') AS cohort, COUNT(*) AS total_records,
{sum2('total_sales')} AS total_metric, {rounded(money_avg('total_sales'), 2)} AS avg_metric
FROM sales GROUP BY 1)""",
    ),
}
