"""Derived columns on ``sales``, ``census`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import features
from tablewright.plans import featuring
from tablewright.session import materialize_all

from .inputs import CENSUS_CTE, CENSUS_YEARS, ORDER_KEY, SALES_COLUMNS, SALES_CTE, census, query, rounded, sales, sales_parts, sql, table

KEY = "order_id, CAST(line_no AS BIGINT) AS line_no, part_id, supplier_id"
PLACE = '"Country/Territory", "Continent"'


def _sales(s, d, *columns):
    return sales(s, d).select(*ORDER_KEY, *columns)


def _census(s, d):
    return census(s, d)


def snake_census(s, d):
    """The same table with snake-case headers."""
    t = census(s, d)
    return t.toDF("country", "continent", *[f"{y}_population" for y in CENSUS_YEARS])


def long_years(s, d):
    return features.wide_years_to_long(snake_census(s, d), ["country", "continent"], "population")


def margin(s, d):
    t = features.estimated_margin(_sales(s, d, "total_sales"), "total_sales")
    return features.profit_margin(t, "gross_profit", "total_sales")


def parts_if_absent(s, d):
    t = sales(s, d).select(*ORDER_KEY, "order_date", "delivery_date").withColumn("delivery_year", F.lit(0))
    return features.calendar_parts_if_absent(t)


def net_growth(s, d):
    t = features.project_value(_census(s, d), target_year=2020, out="projected")
    t = features.project_net_growth(t, "projected", "2001 Population")
    return t.select("Country/Territory", "projected", "projected_net_growth")


def growth_pct(s, d):
    t = features.project_value(_census(s, d), horizon="in 15 years", out="projected")
    t = features.project_growth_pct(t, "projected", "2001 Population")
    return t.select("Country/Territory", "projected", "projected_growth_pct")


SCALED = ["quantity", "unit_price", "total_sales"]


def full(s, d):
    """The full run; like any later step it reads its table from files."""
    t, path = materialize_all(sales_parts(s, d), "sales")
    return featuring.feature_pipeline(t, "full", ORDER_KEY, spent=[path])


def catalog(s, d):
    found = full(s, d)
    return found.catalog(found.scratch).select("feature_name", "feature_type", "missing_pct", "unique_count")


QUERIES = {
    "calendar_parts": query(lambda s, d: features.calendar_parts(_sales(s, d, "order_date", "delivery_date"))),
    "calendar_parts_events": query(
        lambda s, d: features.calendar_parts(table(s, d, "events").select("event_id", "ts"))
    ),
    "calendar_parts_if_absent": query(parts_if_absent),
    "fulfilment_days": query(
        lambda s, d: features.fulfilment_days(
            _sales(s, d, "order_date", "delivery_date"), "order_date", "delivery_date"
        )
    ),
    "wide_years_to_long": query(long_years),
    "cagr": query(lambda s, d: features.cagr(_census(s, d))),
    "project_value": query(lambda s, d: features.project_value(_census(s, d), target_year=2042)),
    "project_net_growth": query(net_growth),
    "project_growth_pct": query(growth_pct),
    "profit_margin": query(margin),
    "revenue_per_unit": query(
        lambda s, d: features.revenue_per_unit(_sales(s, d, "total_sales", "quantity"), "total_sales", "quantity")
    ),
    "estimated_margin": query(lambda s, d: features.estimated_margin(_sales(s, d, "total_sales"), "total_sales")),
    "discount_amount": query(
        lambda s, d: features.discount_amount(
            _sales(s, d, "quantity", "unit_price", "discount_percent"), "quantity", "unit_price", "discount_percent"
        )
    ),
    "minmax_scale": query(lambda s, d: features.minmax_scale(_sales(s, d, *SCALED), SCALED)),
    "zscore_scale": query(lambda s, d: features.zscore_scale(_sales(s, d, *SCALED), SCALED)),
    "log1p": query(lambda s, d: features.log1p(_sales(s, d, *SCALED), SCALED)),
    "revenue_tier": query(lambda s, d: features.revenue_tier(_sales(s, d, "total_sales"), "total_sales")),
    "satisfaction_tier": query(
        lambda s, d: features.satisfaction_tier(_sales(s, d, "customer_satisfaction"), "customer_satisfaction")
    ),
    "label_encode": query(
        lambda s, d: features.label_encode(_sales(s, d, "customer_segment", "region", "category", "order_status"))
    ),
    "frequency_encode": query(
        lambda s, d: features.frequency_encode(_sales(s, d, "customer_segment", "region", "category"))
    ),
    "text_length": query(lambda s, d: features.text_length(table(s, d, "documents").select("doc_id", "text", "source"))),
    "feature_pipeline": query(lambda s, d: full(s, d).table),
    "feature_pipeline_minimal": query(
        lambda s, d: featuring.feature_pipeline(_census(s, d), "minimal", target_year=2042).table
    ),
    "feature_catalog": query(catalog),
}


def _parts(c: str, p: str) -> str:
    return (
        f"year({c}) AS {p}_year, quarter({c}) AS {p}_quarter, month({c}) AS {p}_month, isodow({c}) AS {p}_day_of_week"
    )


def _weekend(c: str, p: str) -> str:
    return f"CAST(CASE WHEN isodow({c}) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_{p}_weekend"


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


def _rate(latest: str = "2001 Population", oldest: str = "1995 Population", years: int = 6) -> str:
    ratio = f'CAST("{latest}" AS DOUBLE) / GREATEST(CAST("{oldest}" AS DOUBLE), 1.0)'
    return f"LEAST(GREATEST(POWER({ratio}, 1.0 / {years}) - 1.0, -0.03), 0.06)"


def _projected(years: int) -> str:
    return f'CAST(ROUND("2001 Population" * POWER(1.0 + {_rate()}, {years}), 0) AS BIGINT)'


def _growth_pct(projected: str) -> str:
    return rounded(
        f'CAST({projected} - "2001 Population" AS DOUBLE) / GREATEST(CAST("2001 Population" AS DOUBLE), 1.0) * 100.0', 2
    )


def _minmax(c: str) -> str:
    return rounded(f"({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ())", 4) + f" AS {c}_minmax"


def _zscore(c: str) -> str:
    return rounded(f"({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()", 4) + f" AS {c}_zscore"


def _log(c: str) -> str:
    return rounded(f"LN({c} + 1.0)", 4) + f" AS {c}_log1p"


TIER = """CASE WHEN total_sales >= 10000 THEN 'Tier 1 - Enterprise (>=10k)' WHEN total_sales >= 3000
THEN 'Tier 2 - High (3k-10k)' WHEN total_sales >= 1000 THEN 'Tier 3 - Medium (1k-3k)' ELSE 'Tier 4 - Entry (<1k)' END
AS sales_revenue_tier"""
MOOD = """CASE WHEN customer_satisfaction >= 4 THEN 'Positive (4-5)' WHEN customer_satisfaction >= 3 THEN 'Neutral (3)'
ELSE 'Detractor (1-2)' END AS satisfaction_sentiment"""


def _encoded(c: str) -> str:
    return f"DENSE_RANK() OVER (ORDER BY {c}) - 1 AS {c}_encoded"


def _freq(c: str) -> str:
    return rounded(f"CAST(COUNT(*) OVER (PARTITION BY {c}) AS DOUBLE) / COUNT(*) OVER ()", 4) + f" AS {c}_freq_pct"


MARGIN = f"""{rounded('total_sales * 0.68::DOUBLE', 2)} AS estimated_cogs, {rounded('total_sales * 0.32::DOUBLE', 2)} AS gross_profit,
CAST(32.0 AS DOUBLE) AS profit_margin_pct"""
DAYS = "GREATEST(date_diff('day', order_date, delivery_date), 0) AS delivery_days"
PER_UNIT = rounded("total_sales / CASE WHEN quantity = 0 THEN 1.0 ELSE quantity END", 2) + " AS revenue_per_unit"
SAVED = rounded("quantity * unit_price * discount_percent", 2) + " AS discount_amount"
PCT = rounded(
    "total_sales / CAST(SUM(CAST(total_sales AS DECIMAL(28,10))) OVER () AS DOUBLE) * 100.0", 4
) + " AS total_sales_pct_of_total"
# the key, then the other columns of the table
SALES_ORDER = ', '.join(ORDER_KEY + [c for c in SALES_COLUMNS if c not in ORDER_KEY])
RUNNING = (
    "CAST(ROUND(SUM(CAST(total_sales AS DECIMAL(28,10))) OVER (ORDER BY " + SALES_ORDER + " "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE)"
) + " AS running_cumulative_total_sales"
RANK = "DENSE_RANK() OVER (ORDER BY total_sales DESC) AS total_sales_rank"
# the first three measures of the table, in column order
MEASURES = ["line_no", "quantity", "unit_price"]
DERIVED = ", ".join([
    _parts("order_date", "order"), _weekend("order_date", "order"), _parts("delivery_date", "delivery"),
    _weekend("delivery_date", "delivery"), DAYS, PER_UNIT, MARGIN, SAVED, *[_minmax(c) for c in MEASURES],
    *[_zscore(c) for c in MEASURES], *[_log(c) for c in MEASURES], TIER, MOOD,
    *[_encoded(c) for c in ["customer_segment", "region", "category"]],
    *[_freq(c) for c in ["customer_segment", "region", "category"]],
    "COALESCE(length(country), 0) AS country_char_length", "COALESCE(length(category), 0) AS category_char_length",
    PCT, RUNNING, RANK,
])
FULL = f"""SELECT * REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date, strftime(delivery_date, '%Y-%m-%d') AS delivery_date,
CAST(line_no AS BIGINT) AS line_no) FROM (SELECT *, {DERIVED} FROM sales)"""
KINDS = {
    "temporal": [f"{p}_{x}" for p in ("order", "delivery") for x in ("year", "quarter", "month", "day_of_week")]
    + ["is_order_weekend", "is_delivery_weekend", "delivery_days"],
    "calculated": ["revenue_per_unit", "estimated_cogs", "gross_profit", "profit_margin_pct", "discount_amount"],
    "scaled": [f"{c}_{x}" for c in MEASURES for x in ("minmax", "zscore", "log1p")],
    "binned": ["sales_revenue_tier", "satisfaction_sentiment"],
    "encoded": [f"{c}_{x}" for c in ("customer_segment", "region", "category") for x in ("encoded", "freq_pct")],
    "text": ["country_char_length", "category_char_length"],
    "window": ["total_sales_pct_of_total", "running_cumulative_total_sales", "total_sales_rank"],
}

ORACLES = {
    "calendar_parts": sql(
        SALES_CTE,
        query=f"SELECT {KEY}, {_iso('order_date')}, {_iso('delivery_date')}, {_parts('order_date', 'order')}, "
        f"{_weekend('order_date', 'order')}, {_parts('delivery_date', 'delivery')}, "
        f"{_weekend('delivery_date', 'delivery')} FROM sales",
    ),
    "calendar_parts_events": f"SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {_parts('ts', 'ts')}, "
    f"{_weekend('ts', 'ts')} FROM events",
    "calendar_parts_if_absent": sql(
        SALES_CTE,
        query=f"SELECT {KEY}, {_iso('order_date')}, {_iso('delivery_date')}, CAST(0 AS BIGINT) AS delivery_year, "
        f"{_parts('order_date', 'order')} FROM sales",
    ),
    "fulfilment_days": sql(
        SALES_CTE, query=f"SELECT {KEY}, {_iso('order_date')}, {_iso('delivery_date')}, {DAYS} FROM sales"
    ),
    "wide_years_to_long": sql(
        CENSUS_CTE,
        query=" UNION ALL ".join(
            f'SELECT "Country/Territory" AS country, "Continent" AS continent, CAST({y} AS BIGINT) AS year, '
            f'CAST("{y} Population" AS DOUBLE) AS population FROM census'
            for y in CENSUS_YEARS
        ),
    ),
    "cagr": sql(CENSUS_CTE, query=f"SELECT *, {rounded(_rate() + ' * 100.0', 4)} AS historical_cagr_pct FROM census"),
    "project_value": sql(
        CENSUS_CTE, query=f'SELECT *, {_projected(41)} AS "2042_projected_population" FROM census'
    ),
    "project_net_growth": sql(
        CENSUS_CTE,
        query=f'SELECT "Country/Territory", projected, projected - "2001 Population" AS projected_net_growth '
        f"FROM (SELECT *, {_projected(19)} AS projected FROM census)",
    ),
    "project_growth_pct": sql(
        CENSUS_CTE,
        query=f'SELECT "Country/Territory", projected, {_growth_pct("projected")} AS projected_growth_pct '
        f"FROM (SELECT *, {_projected(15)} AS projected FROM census)",
    ),
    "profit_margin": sql(
        SALES_CTE,
        query=f"SELECT *, {rounded('gross_profit / GREATEST(total_sales, 0.01) * 100.0', 2)} AS profit_margin "
        f"FROM (SELECT {KEY}, total_sales, {MARGIN} FROM sales)",
    ),
    "revenue_per_unit": sql(SALES_CTE, query=f"SELECT {KEY}, total_sales, quantity, {PER_UNIT} FROM sales"),
    "estimated_margin": sql(SALES_CTE, query=f"SELECT {KEY}, total_sales, {MARGIN} FROM sales"),
    "discount_amount": sql(
        SALES_CTE, query=f"SELECT {KEY}, quantity, unit_price, discount_percent, {SAVED} FROM sales"
    ),
    "minmax_scale": sql(
        SALES_CTE, query=f"SELECT {KEY}, {', '.join(SCALED)}, {', '.join(map(_minmax, SCALED))} FROM sales"
    ),
    "zscore_scale": sql(
        SALES_CTE, query=f"SELECT {KEY}, {', '.join(SCALED)}, {', '.join(map(_zscore, SCALED))} FROM sales"
    ),
    "log1p": sql(SALES_CTE, query=f"SELECT {KEY}, {', '.join(SCALED)}, {', '.join(map(_log, SCALED))} FROM sales"),
    "revenue_tier": sql(SALES_CTE, query=f"SELECT {KEY}, total_sales, {TIER} FROM sales"),
    "satisfaction_tier": sql(SALES_CTE, query=f"SELECT {KEY}, customer_satisfaction, {MOOD} FROM sales"),
    "label_encode": sql(
        SALES_CTE,
        query=f"SELECT {KEY}, customer_segment, region, category, order_status, "
        + ", ".join(map(_encoded, ["customer_segment", "region", "category"])) + " FROM sales",
    ),
    "frequency_encode": sql(
        SALES_CTE,
        query=f"SELECT {KEY}, customer_segment, region, category, "
        + ", ".join(map(_freq, ["customer_segment", "region", "category"])) + " FROM sales",
    ),
    "text_length": "SELECT doc_id, text, source, COALESCE(length(text), 0) AS text_char_length, "
    "COALESCE(length(source), 0) AS source_char_length FROM documents",
    "feature_pipeline": sql(SALES_CTE, query=FULL),
    "feature_pipeline_minimal": sql(
        CENSUS_CTE,
        query=f'SELECT *, "2042_projected_population" - "2001 Population" AS projected_41y_net_growth, '
        f'{_growth_pct(chr(34) + "2042_projected_population" + chr(34))} AS projected_41y_growth_pct '
        f"FROM (SELECT *, {rounded(_rate() + ' * 100.0', 4)} AS historical_cagr_pct, "
        f'{_projected(41)} AS "2042_projected_population" FROM census)',
    ),
    "feature_catalog": sql(
        SALES_CTE, f"full_table AS ({FULL})",
        query=" UNION ALL ".join(
            f"SELECT '{c}' AS feature_name, '{kind}' AS feature_type, "
            f"CAST(ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS DOUBLE) AS missing_pct, "
            f"COUNT(DISTINCT {c}) AS unique_count FROM full_table"
            for kind, names in KINDS.items()
            for c in names
        ),
    ),
}
