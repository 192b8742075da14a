"""What moves a metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import drivers

from .inputs import SALES_CTE, money_avg, query, rounded, sales, sql, sum2

FEATURES = ["region", "category", "payment_method", "order_status", "quantity", "unit_price", "discount_percent"]
DIMS = ["region", "category"]


def resolved(s, d):
    """Variance per numeric column and which one is chosen without a hint or a known word."""
    t = sales(s, d).select("line_no", "quantity", "unit_price", "discount_percent", "customer_satisfaction")
    target = drivers.resolve_target(t)
    rows = drivers.variances(t)
    return rows.select(
        "column_name", F.round("variance", 2).alias("variance"), (F.col("column_name") == target).alias("is_target")
    )


def planted(s, d):
    """A metric that falls with one feature alone; every order line takes part."""
    t = sales(s, d).withColumn("metric", 500.0 - 7.0 * F.col("quantity"))
    best = drivers.driver_importance(t, "metric", [c for c in FEATURES if c != "unit_price"], top=1)
    return best.select("feature", "impact_direction")


def resolved_by_name(s, d):
    """The target by hint and by keyword, with its sum over all rows."""
    t = sales(s, d).select("line_no", "quantity", "unit_price", "total_sales", "customer_satisfaction")
    rows = [
        t.agg(F.lit(how).alias("how"), F.lit(c).alias("target"), F.round(F.sum(F.col(c).cast("decimal(28,10)")), 2).cast("double").alias("total"))
        for how, c in (("hint", drivers.resolve_target(t, "unit price per order")), ("keyword", drivers.resolve_target(t)))
    ]
    return rows[0].unionByName(rows[1])


QUERIES = {
    "resolve_target": query(resolved),
    "resolve_target_by_name": query(resolved_by_name),
    "driver_importance_planted": query(planted),
    "driver_importance": query(lambda s, d: drivers.driver_importance(sales(s, d), "total_sales", FEATURES)),
    "driver_direction": query(lambda s, d: drivers.driver_direction(sales(s, d), "total_sales", FEATURES)),
    "cohort_compare": query(lambda s, d: drivers.cohort_compare(sales(s, d), "total_sales", DIMS)),
    "target_overview": query(lambda s, d: drivers.target_overview(sales(s, d), "total_sales", DIMS)),
}

_VARIANCES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(VAR_SAMP({c}), 2) AS variance FROM sales"
    for c in ["line_no", "quantity", "unit_price", "discount_percent", "customer_satisfaction"]
)
_CODED = ", ".join(
    f"CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" if c in FEATURES[:4] else c for c in FEATURES
)
_COHORTS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{d}' AS dimension, COALESCE({d}, 'null') AS value, COUNT(*) AS sample_size, "
    f"{rounded(money_avg('total_sales'), 2)} AS avg_target, {sum2('total_sales')} AS total_target "
    f"FROM sales GROUP BY {d}"
    for i, d in enumerate(DIMS)
)
LISTED = f"listed AS (SELECT * FROM ({_COHORTS}) ORDER BY position, avg_target DESC, value LIMIT 6)"

ORACLES = {
    "driver_importance_planted": sql(
        SALES_CTE,
        query="SELECT 'quantity' AS feature, CASE WHEN corr(quantity, 500.0 - 7.0 * quantity) < -0.1 THEN 'negative' END "
        "AS impact_direction FROM sales",
    ),
    "resolve_target_by_name": sql(
        SALES_CTE,
        query="SELECT 'hint' AS how, 'unit_price' AS target, CAST(ROUND(SUM(CAST(unit_price AS DECIMAL(28,10))), 2) AS DOUBLE) AS total "
        "FROM sales UNION ALL SELECT 'keyword', 'total_sales', CAST(ROUND(SUM(CAST(total_sales AS DECIMAL(28,10))), 2) AS DOUBLE) FROM sales",
    ),
    "resolve_target": sql(
        SALES_CTE,
        query="SELECT column_name, variance, CAST(CASE WHEN variance = MAX(variance) OVER () THEN 1 ELSE 0 END AS BIGINT) "
        f"AS is_target FROM ({_VARIANCES})",
    ),
    "driver_direction": sql(
        SALES_CTE, f"coded AS (SELECT total_sales, {_CODED} FROM sales)",
        query="SELECT feature, correlation, CASE WHEN r > 0.1 THEN 'positive' WHEN r < -0.1 THEN 'negative' "
        "ELSE 'neutral' END AS impact_direction FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, corr({c}, total_sales) AS r, {rounded(f'corr({c}, total_sales)', 4)} AS correlation "
            "FROM coded"
            for c in FEATURES
        )
        + ")",
    ),
    "cohort_compare": sql(SALES_CTE, LISTED, query="SELECT * EXCLUDE (position) FROM listed"),
    "target_overview": sql(
        SALES_CTE, LISTED,
        query=f"""SELECT COUNT(*) AS total_rows, {sum2('total_sales')} AS total_target,
{rounded(money_avg('total_sales'), 2)} AS avg_target,
(SELECT dimension || ': ' || value FROM listed ORDER BY position, avg_target DESC, value LIMIT 1) AS top_cohort,
(SELECT dimension || ': ' || value FROM listed ORDER BY position DESC, avg_target, value DESC LIMIT 1) AS bottom_cohort
FROM sales""",
    ),
}
