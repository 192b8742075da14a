"""The data behind each chart."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.operators import charts, features

from .inputs import CENSUS_CTE, CENSUS_YEARS, ORDER_KEY, SALES_CTE, census, money_avg, money_sum, query, rounded, sales, sql, sum2, table
from .kpis import GROWTH_CTE, LATEST, PROJECTED, projected_census

MATRIX = ["quantity", "unit_price", "discount_percent", "total_sales"]


def events(s, d):
    return table(s, d, "events").select("event_id", "ts", "event_type", "value")


def points(s, d):
    t = sales(s, d).select(*ORDER_KEY, "quantity", "total_sales", "category")
    return charts.scatter_sample(t, "quantity", "total_sales", ORDER_KEY, "category")


QUERIES = {
    "kpi_cards": query(lambda s, d: charts.kpi_cards(sales(s, d), "total_sales", "order_date", "order_id")),
    "kpi_cards_projection": query(
        lambda s, d: charts.kpi_cards_projection(projected_census(s, d), LATEST, PROJECTED, "historical_cagr_pct")
    ),
    "trend_monthly": query(lambda s, d: charts.trend_monthly(events(s, d), "value", "ts")),
    "trend_monthly_sales": query(lambda s, d: charts.trend_monthly(sales(s, d), "total_sales", "order_date")),
    "bar_top10": query(lambda s, d: charts.bar_top(sales(s, d), "product", "total_sales")),
    "grouped_bar_melt": query(lambda s, d: charts.grouped_bar_melt(sales(s, d), "country", "total_sales")),
    "histogram": query(lambda s, d: charts.histogram(table(s, d, "lineitem"), "l_extendedprice")),
    "kde_curve": query(lambda s, d: charts.kde_curve(table(s, d, "lineitem"), "l_extendedprice")),
    "boxplot_stats": query(lambda s, d: charts.boxplot_stats(sales(s, d), "category", "total_sales")),
    "corr_matrix": query(lambda s, d: charts.corr_matrix(sales(s, d).select(*MATRIX), MATRIX)),
    "scatter_sample": query(points),
    "linear_fit": query(lambda s, d: charts.linear_fit(sales(s, d), "quantity", "total_sales")),
    "donut_top5_other": query(lambda s, d: charts.donut_top_other(sales(s, d), "product", "total_sales")),
    "contribution_breakdown": query(
        lambda s, d: charts.contribution_breakdown(sales(s, d), "country", "total_sales")
    ),
    "forecast_trajectory": query(
        lambda s, d: charts.forecast_trajectory(projected_census(s, d), projected=PROJECTED)
    ),
    "forecast_trajectory_total": query(lambda s, d: charts.forecast_trajectory(census(s, d))),
    "top10_projected": query(lambda s, d: charts.top_projected(projected_census(s, d), "Country/Territory", PROJECTED)),
    "share_projected": query(lambda s, d: charts.share_projected(projected_census(s, d), "Continent", PROJECTED)),
    "custom_bar": query(lambda s, d: charts.custom_chart(sales(s, d), "bar", "product", "unit_price", aggregation="mean")),
    "custom_bar_counts": query(lambda s, d: charts.custom_chart(table(s, d, "documents"), "bar", "source")),
    "custom_line": query(lambda s, d: charts.custom_chart(sales(s, d), "line", "order_date", "total_sales")),
    "custom_histogram": query(lambda s, d: charts.custom_chart(table(s, d, "orders"), "hist", "o_totalprice")),
    "custom_box": query(
        lambda s, d: charts.custom_chart(table(s, d, "orders"), "box", "o_orderpriority", "o_totalprice")
    ),
    "custom_scatter": query(
        lambda s, d: charts.custom_chart(
            table(s, d, "lineitem"), "scatter", "l_quantity", "l_extendedprice", "l_returnflag",
            key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        )
    ),
}


def _formatted(c: str, prefix: str = "") -> str:
    def unit(divisor: str, suffix: str) -> str:
        return f"'{prefix}' || CAST(CAST(ROUND(CAST({c} / {divisor} AS DECIMAL(28,10)), 2) AS DECIMAL(28,2)) AS VARCHAR) || '{suffix}'"

    return (
        f"CASE WHEN ABS({c}) >= 1e9 THEN {unit('1e9', 'B')} WHEN ABS({c}) >= 1e6 THEN {unit('1e6', 'M')} "
        f"WHEN ABS({c}) >= 1e3 THEN {unit('1e3', 'K')} ELSE {unit('1.0', '')} END"
    )


_RATIO = "0.31999999999999995::DOUBLE"
_PARTS = {
    "Total Sales": (sum2("total_sales"), money_sum("total_sales"), "$"),
    "Gross Profit": (rounded(f"{money_sum('total_sales')} * {_RATIO}", 2), f"{money_sum('total_sales')} * {_RATIO}", "$"),
    "Average Order Value": (rounded(money_avg("total_sales"), 2), money_avg("total_sales"), "$"),
    "Orders": ("CAST(COUNT(DISTINCT order_id) AS DOUBLE)", "CAST(COUNT(DISTINCT order_id) AS DOUBLE)", ""),
}


def _cards() -> str:
    rows = []
    for title, (shown, measure, prefix) in _PARTS.items():
        monthly = f"(SELECT strftime(order_date, '%Y-%m') AS m, {measure} AS v FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 2)"
        change = rounded("(max_by(v, m) - min_by(v, m)) / NULLIF(min_by(v, m), 0) * 100.0", 1)
        rows.append(
            f"SELECT title, metric_value, {_formatted('metric_value', prefix)} AS formatted_value, change_pct, "
            "CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' ELSE 'neutral' END AS trend_direction "
            f"FROM (SELECT '{title}' AS title, {shown} AS metric_value, (SELECT {change} FROM {monthly}) AS change_pct FROM sales)"
        )
    return " UNION ALL ".join(rows)


_NOW, _THEN = f'SUM("{LATEST}")', f'SUM("{PROJECTED}")'
_PCT = rounded(f"CAST({_THEN} - {_NOW} AS DOUBLE) * 100.0 / GREATEST(CAST({_NOW} AS DOUBLE), 1.0)", 1)
_CARDS = [
    ("Current Total", f"CAST({_NOW} AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    ("Projected Total", f"CAST({_THEN} AS DOUBLE)", _PCT),
    ("Net Growth", f"CAST({_THEN} - {_NOW} AS DOUBLE)", _PCT),
    ("Mean Growth Rate", rounded("AVG(historical_cagr_pct)", 4), "CAST(NULL AS DOUBLE)"),
    ("Entities", "CAST(COUNT(*) AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
]


def _monthly(source: str, date: str, value: str) -> str:
    return (
        f"SELECT strftime({date}, '%Y-%m') AS month, {sum2(value)} AS monthly_revenue, "
        f"{rounded(f'{money_sum(value)} * {_RATIO}', 2)} AS monthly_profit FROM {source} WHERE {date} IS NOT NULL GROUP BY 1"
    )


def _histogram(source: str, c: str, top: float) -> str:
    return f"""SELECT b AS bin, {rounded('lo + (b - 1) * width', 4)} AS bin_start, {rounded('lo + b * width', 4)} AS bin_end,
(SELECT COUNT(*) FROM {source} WHERE {c} <= cut AND LEAST(floor(({c} - lo) / width) + 1, 25) = b) AS count,
{rounded('med', 4)} AS median, {rounded('mean', 4)} AS mean
FROM (SELECT *, (hi - lo) / 25 AS width FROM (SELECT q.cut, q.med, q.mean, MIN({c}) AS lo, MAX({c}) AS hi
  FROM {source}, (SELECT quantile_cont({c}, {top}) AS cut, quantile_cont({c}, 0.5) AS med, AVG({c}) AS mean FROM {source}) q
  WHERE {c} <= q.cut GROUP BY ALL)), range(1, 26) AS r(b)"""


KDE = """WITH shown AS (SELECT l_extendedprice AS v FROM lineitem
  WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem)),
p AS (SELECT COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi, POWER(COUNT(*), -0.2) * STDDEV_SAMP(v) AS bw FROM shown),
bins AS (SELECT LEAST(floor((v - lo) / ((hi - lo) / 512)), 511) AS bin, COUNT(*) AS c FROM shown, p GROUP BY 1)
SELECT g AS point, """ + rounded("MAX(lo + g * ((hi - lo) / 99))", 4) + """ AS x,
""" + rounded(
    "SUM(c * EXP(-POWER((lo + g * ((hi - lo) / 99) - (lo + (bin + 0.5) * ((hi - lo) / 512))) / bw, 2) / 2)) "
    "/ (MAX(n) * MAX(bw) * sqrt(2 * pi()))", 9
) + " AS density FROM bins, p, range(0, 100) AS r(g) GROUP BY g"


def _box(source: str, category: str, value: str, top: float | None) -> str:
    cut = f"WHERE {value} <= (SELECT quantile_cont({value}, {top}) FROM {source})" if top else ""
    inside = "v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)"
    return f"""SELECT c AS {category}, COUNT(*) AS n, {rounded('AVG(v)', 2)} AS mean, {rounded('MAX(q1)', 2)} AS q1,
{rounded('MAX(q2)', 2)} AS median, {rounded('MAX(q3)', 2)} AS q3, {rounded(f'MIN(CASE WHEN {inside} THEN v END)', 2)} AS whisker_low,
{rounded(f'MAX(CASE WHEN {inside} THEN v END)', 2)} AS whisker_high, COUNT(CASE WHEN NOT ({inside}) THEN 1 END) AS outlier_count
FROM (SELECT {category} AS c, {value} AS v, quantile_cont({value}, 0.25) OVER (PARTITION BY {category}) AS q1,
quantile_cont({value}, 0.5) OVER (PARTITION BY {category}) AS q2, quantile_cont({value}, 0.75) OVER (PARTITION BY {category}) AS q3
FROM {source} {cut}) GROUP BY c"""


def _matrix() -> str:
    rows = [f"SELECT '{c}' AS feature_x, '{c}' AS feature_y, 1.0::DOUBLE AS pearson_r" for c in MATRIX]
    for a, b in combinations(MATRIX, 2):
        for x, y in ((a, b), (b, a)):
            rows.append(f"SELECT '{x}', '{y}', {rounded(f'corr({a}, {b})', 3)} FROM sales")
    return " UNION ALL ".join(rows)


_SUMS = " UNION ALL ".join(
    f"SELECT CAST({y} AS BIGINT) AS year, 'history' AS kind, CAST(SUM(\"{y} Population\") AS DOUBLE) AS total, "
    f"CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM growth"
    for y in CENSUS_YEARS
)


def _trajectory(then: str) -> str:
    return (
        f"{_SUMS} UNION ALL SELECT CAST(2021 AS BIGINT), 'projection', t, ROUND(t * 0.96::DOUBLE, 0), "
        f"ROUND(t * 1.04::DOUBLE, 0) FROM (SELECT ROUND({then}, 0) AS t FROM growth)"
    )


_GROUPED = "SELECT {0} AS category, SUM(CAST(total_sales AS DECIMAL(28,10))) AS s FROM sales GROUP BY 1"

ORACLES = {
    "kpi_cards": sql(SALES_CTE, query=_cards()),
    "kpi_cards_projection": sql(
        CENSUS_CTE, GROWTH_CTE,
        query=" UNION ALL ".join(
            f"SELECT title, metric_value, "
            + (_formatted("metric_value") if t != "Mean Growth Rate"
               else "CAST(CAST(metric_value AS DECIMAL(10,4)) AS VARCHAR) || '%'")
            + f" AS formatted_value, change_pct FROM (SELECT '{t}' AS title, {v} AS metric_value, {p} AS change_pct FROM growth)"
            for t, v, p in _CARDS
        ),
    ),
    "trend_monthly": _monthly("events", "ts", "value"),
    "trend_monthly_sales": sql(SALES_CTE, query=_monthly("sales", "order_date", "total_sales")),
    "bar_top10": sql(
        SALES_CTE,
        query=f"SELECT product, {sum2('total_sales')} AS total_sales FROM sales GROUP BY 1 ORDER BY SUM(CAST(total_sales AS "
        "DECIMAL(28,10))) DESC, 1 LIMIT 10",
    ),
    "grouped_bar_melt": sql(
        SALES_CTE,
        f"best AS (SELECT country, {sum2('total_sales')} AS r, {rounded(money_sum('total_sales') + ' * ' + _RATIO, 2)} AS p "
        "FROM sales GROUP BY 1 ORDER BY r DESC, 1 LIMIT 8)",
        query="SELECT country, 'Revenue' AS metric, r AS amount FROM best UNION ALL SELECT country, 'Profit', p FROM best",
    ),
    "histogram": _histogram("lineitem", "l_extendedprice", 0.95),
    "kde_curve": KDE,
    "boxplot_stats": sql(SALES_CTE, query=_box("sales", "category", "total_sales", 0.95)),
    "corr_matrix": sql(SALES_CTE, query=_matrix()),
    "scatter_sample": sql(
        SALES_CTE,
        query="SELECT order_id, CAST(line_no AS BIGINT) AS line_no, part_id, supplier_id, quantity, total_sales, category "
        "FROM sales ORDER BY md5(concat_ws('|', order_id, line_no, part_id, supplier_id, '42')), order_id, line_no, part_id, "
        "supplier_id LIMIT 1000",
    ),
    "linear_fit": sql(
        SALES_CTE,
        query=f"SELECT {rounded('regr_slope(total_sales, quantity)', 4)} AS slope, "
        f"{rounded('regr_intercept(total_sales, quantity)', 2)} AS intercept, "
        f"{rounded('regr_r2(total_sales, quantity)', 4)} AS r2, CAST(regr_count(total_sales, quantity) AS BIGINT) AS n FROM sales",
    ),
    "donut_top5_other": sql(
        SALES_CTE,
        query=f"SELECT CASE WHEN rn <= 5 THEN category ELSE 'Other Categories' END AS category, "
        f"CAST(ROUND(SUM(s), 2) AS DOUBLE) AS sales FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY s DESC, category) AS rn "
        f"FROM ({_GROUPED.format('product')})) GROUP BY 1",
    ),
    "contribution_breakdown": sql(
        SALES_CTE,
        query=f"SELECT *, {rounded('metric_sum * 100 / SUM(metric_sum) OVER ()', 1)} AS share_pct FROM (SELECT country, "
        f"{sum2('total_sales')} AS metric_sum FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)",
    ),
    "forecast_trajectory": sql(CENSUS_CTE, GROWTH_CTE, query=_trajectory(f'CAST(SUM("{PROJECTED}") AS DOUBLE)')),
    "forecast_trajectory_total": sql(
        CENSUS_CTE, GROWTH_CTE,
        query=_trajectory(
            'CAST(SUM("2001 Population") AS DOUBLE) * POWER(POWER(CAST(SUM("2001 Population") AS DOUBLE) / '
            'SUM("1995 Population"), 1.0 / 6), 20)'
        ),
    ),
    "top10_projected": sql(
        CENSUS_CTE, GROWTH_CTE,
        query=f'SELECT "Country/Territory" AS entity, "{PROJECTED}" AS projected FROM growth ORDER BY 2 DESC, 1 LIMIT 10',
    ),
    "share_projected": sql(
        CENSUS_CTE, GROWTH_CTE,
        query=f'SELECT "Continent" AS "group", CAST(SUM("{PROJECTED}") AS BIGINT) AS total, '
        + rounded(f'SUM("{PROJECTED}") * 100.0 / SUM(SUM("{PROJECTED}")) OVER ()', 1) + " AS share_pct FROM growth GROUP BY 1",
    ),
    "custom_bar": sql(
        SALES_CTE,
        query=f"SELECT product, {rounded(money_avg('unit_price'), 4)} AS value FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    ),
    "custom_bar_counts": "SELECT source, CAST(COUNT(*) AS DOUBLE) AS value FROM documents GROUP BY 1 "
    "ORDER BY 2 DESC, source NULLS LAST LIMIT 15",
    "custom_line": sql(
        SALES_CTE,
        query=f"SELECT strftime(order_date, '%Y-%m-%d') AS order_date, {sum2('total_sales')} AS value FROM sales GROUP BY 1",
    ),
    "custom_histogram": _histogram("orders", "o_totalprice", 1.0),
    "custom_box": _box("orders", "o_orderpriority", "o_totalprice", None),
    "custom_scatter": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, "
    "l_extendedprice, l_returnflag FROM lineitem ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "'42')), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000",
}
