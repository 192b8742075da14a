"""Exploratory statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import stats

from .inputs import SALES_CTE, query, rounded, sales, sql, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["text", "lang", "source"]
HOLED = ["event_id", "value", "user_id"]


def lines(s, d):
    return table(s, d, "lineitem").select(*LINE)


def shaped(s, d):
    """Columns of different shape: uniform, right skewed, with many zeros, left skewed."""
    v = F.col("l_extendedprice")
    return table(s, d, "lineitem").select(
        "l_quantity", "l_extendedprice",
        (v * v * v / 1e12 * (v * v * v / 1e12)).alias("steep"),
        F.when(F.col("l_linenumber") > 3, 0.0).otherwise(F.col("l_quantity")).alias("many_zeros"),
        (-v * v * v / 1e9).alias("mirrored"),
    )


SHAPED_CTE = """shaped AS (SELECT l_quantity, l_extendedprice,
l_extendedprice * l_extendedprice * l_extendedprice / 1e12 * (l_extendedprice * l_extendedprice * l_extendedprice / 1e12)
AS steep,
CASE WHEN l_linenumber > 3 THEN 0.0::DOUBLE ELSE l_quantity END AS many_zeros,
-l_extendedprice * l_extendedprice * l_extendedprice / 1e9 AS mirrored FROM lineitem)"""
SHAPED = ["l_quantity", "l_extendedprice", "steep", "many_zeros", "mirrored"]


def holed(s, d):
    return table(s, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), "user_id"
    )


HOLED_CTE = "holed AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value, user_id FROM events)"


def numbers(s, d):
    return stats.numeric_summary(shaped(s, d), SHAPED)


def texts(s, d):
    return stats.categorical_summary(table(s, d, "documents"), TEXTS)


def derived(s, d):
    return sales(s, d).select(
        "quantity", "unit_price", "discount_percent", "total_sales", (F.col("quantity") * 2).alias("double_quantity")
    )


DERIVED = ["quantity", "unit_price", "discount_percent", "total_sales", "double_quantity"]
DERIVED_CTE = "derived AS (SELECT quantity, unit_price, discount_percent, total_sales, quantity * 2 AS double_quantity FROM sales)"

QUERIES = {
    "numeric_summary": query(numbers),
    "distribution_shape": query(lambda s, d: stats.distribution_shape(numbers(s, d))),
    "distribution_notes": query(lambda s, d: stats.distribution_notes(numbers(s, d))),
    "categorical_summary": query(texts),
    "pearson_pairs": query(lambda s, d: stats.pearson_pairs(derived(s, d), DERIVED)),
    "pearson_pairs_nulls": query(lambda s, d: stats.pearson_pairs(holed(s, d), HOLED)),
    "spearman_pairs": query(lambda s, d: stats.spearman_pairs(lines(s, d), LINE)),
    "spearman_pairs_nulls": query(lambda s, d: stats.spearman_pairs(holed(s, d), HOLED)),
    "iqr_outliers": query(lambda s, d: stats.iqr_outliers(shaped(s, d), SHAPED)),
    "zscore_outliers": query(lambda s, d: stats.zscore_outliers(shaped(s, d), SHAPED)),
    "insight_concentration": query(lambda s, d: stats.insight_concentration(texts(s, d))),
    "insight_top_correlation": query(
        lambda s, d: stats.insight_top_correlation(stats.pearson_pairs(derived(s, d), DERIVED))
    ),
    "insight_top_outlier": query(lambda s, d: stats.insight_top_outlier(stats.iqr_outliers(shaped(s, d), SHAPED))),
    "pareto_share": query(lambda s, d: stats.pareto_share(table(s, d, "orders"), "o_totalprice")),
    "pareto_share_ties": query(lambda s, d: stats.pareto_share(table(s, d, "lineitem"), "l_quantity")),
}


def _summary(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        q = {p: f"quantile_cont(v, {p})" for p in (0.25, 0.5, 0.75)}
        skew = "CASE WHEN COUNT(v) > 2 AND STDDEV_SAMP(v) > 0 THEN AVG(d * d * d) / POWER(AVG(d * d), 1.5) ELSE 0 END"
        kurt = (
            "CASE WHEN COUNT(v) > 3 AND STDDEV_SAMP(v) > 0 THEN AVG(d * d * d * d) / (AVG(d * d) * AVG(d * d)) - 3 "
            "ELSE 0 END"
        )
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT(v) AS n, AVG(v) AS mean, COALESCE(STDDEV_SAMP(v), 0) AS std, MIN(v) AS min, "
            f"{q[0.25]} AS p25, {q[0.5]} AS median, {q[0.75]} AS p75, MAX(v) AS max, {skew} AS skewness, {kurt} AS kurtosis, "
            f"COUNT(CASE WHEN v = 0 THEN 1 END) AS zeros "
            f"FROM (SELECT {c} AS v, {c} - (SELECT AVG({c}) FROM {source}) AS d FROM {source})"
        )
    shape = """CASE WHEN skewness > 1 THEN 'right_skewed' WHEN skewness < -1 THEN 'left_skewed'
WHEN kurtosis > 3 THEN 'heavy_tailed' WHEN CAST(zeros AS DOUBLE) / n > 0.3 THEN 'zero_inflated' ELSE 'normal_like' END"""
    figures = ["mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis"]
    advice = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TRANSFORM_ADVICE.items())
    return (
        f"SELECT *, CASE distribution_shape {advice} END AS recommended_transform "
        f"FROM (SELECT column_name, n AS count, {', '.join(f'{rounded(f, 2)} AS {f}' for f in figures)}, "
        f"{rounded('p75 - p25', 2)} AS iqr, {shape} AS distribution_shape FROM ({' UNION ALL '.join(parts)}))"
    )


SUMMARY = _summary("shaped", SHAPED)


def _categories(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        share = rounded(f"COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {source})", 1)
        parts.append(
            f"SELECT '{c}' AS column_name, ROW_NUMBER() OVER (ORDER BY n DESC, v NULLS LAST) AS place, "
            "COALESCE(v, 'null') AS category, n AS count, percentage, COUNT(*) OVER () AS unique_count, "
            "COUNT(CASE WHEN percentage < 1.0 THEN 1 END) OVER () AS rare_category_count "
            f"FROM (SELECT {c} AS v, COUNT(*) AS n, {share} AS percentage FROM {source} GROUP BY {c})"
        )
    return (
        "SELECT *, CASE WHEN unique_count > 30 THEN 'high_cardinality' WHEN unique_count > 10 THEN 'medium' ELSE 'low' END "
        f"AS cardinality_status FROM ({' UNION ALL '.join(parts)}) WHERE place <= 6"
    )


CATEGORIES = _categories("documents", TEXTS)


def _pearson(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, COUNT(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, "
        f"{rounded(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 3)} AS pearson_r FROM {source}"
        for a, b in combinations(columns, 2)
    )


def _spearman(source: str, columns: list[str]) -> str:
    def place(c):
        return f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"

    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, COUNT(*) AS n, {rounded('corr(x, y)', 3)} AS spearman_rho "
        f"FROM (SELECT {place(a)} AS x, {place(b)} AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in combinations(columns, 2)
    )


def _outliers(source: str, columns: list[str], method: str) -> str:
    parts = []
    for c in columns:
        edges = (
            f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS a, "
            f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS z"
            if method == "iqr"
            else f"AVG({c}) - 3 * STDDEV_SAMP({c}) AS a, AVG({c}) + 3 * STDDEV_SAMP({c}) AS z"
        )
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT(CASE WHEN {c} < a OR {c} > z THEN 1 END) AS anomaly_count, "
            f"{rounded(f'COUNT(CASE WHEN {c} < a OR {c} > z THEN 1 END) * 100.0 / COUNT({c})', 2)} AS outlier_pct, "
            f"{rounded('MIN(a)', 2)} AS lower_bound, {rounded('MIN(z)', 2)} AS upper_bound, '{method}' AS method "
            f"FROM {source}, (SELECT {edges} FROM {source}) WHERE z > a"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE anomaly_count > 0"


def _pareto(source: str, c: str) -> str:
    return f"""SELECT COUNT(*) AS total_rows, GREATEST(CAST(floor(COUNT(*) * 0.2::DOUBLE) AS BIGINT), 1) AS top_rows,
{rounded("CAST(SUM(CASE WHEN rn <= GREATEST(floor(n * 0.2::DOUBLE), 1) THEN m END) AS DOUBLE)", 2)} AS top_value,
{rounded("CAST(SUM(CASE WHEN rn <= GREATEST(floor(n * 0.2::DOUBLE), 1) THEN m END) AS DOUBLE) * 100.0 / CAST(SUM(m) AS DOUBLE)", 1)}
AS top_share_pct FROM (SELECT CAST({c} AS DECIMAL(28,10)) AS m, ROW_NUMBER() OVER (ORDER BY {c} DESC) AS rn,
COUNT(*) OVER () AS n FROM {source} WHERE {c} IS NOT NULL)"""


ORACLES = {
    "numeric_summary": sql(SHAPED_CTE, query=SUMMARY),
    "distribution_shape": sql(
        SHAPED_CTE,
        query=f"SELECT column_name, skewness, kurtosis, distribution_shape, recommended_transform FROM ({SUMMARY})",
    ),
    "distribution_notes": sql(
        SHAPED_CTE,
        query="SELECT column_name, format('{} is {} (skewness = {:.2f}, kurtosis = {:.2f}); try {}', column_name, "
        "replace(distribution_shape, '_', ' '), skewness, kurtosis, recommended_transform) AS note "
        f"FROM ({SUMMARY}) WHERE distribution_shape <> 'normal_like'",
    ),
    "categorical_summary": CATEGORIES,
    "pearson_pairs": sql(SALES_CTE, DERIVED_CTE, query=_pearson("derived", DERIVED)),
    "pearson_pairs_nulls": sql(HOLED_CTE, query=_pearson("holed", HOLED)),
    "spearman_pairs": _spearman("lineitem", LINE),
    "spearman_pairs_nulls": sql(HOLED_CTE, query=_spearman("holed", HOLED)),
    "iqr_outliers": sql(SHAPED_CTE, query=_outliers("shaped", SHAPED, "iqr")),
    "zscore_outliers": sql(SHAPED_CTE, query=_outliers("shaped", SHAPED, "zscore")),
    "insight_concentration": f"SELECT column_name, category, percentage, CASE WHEN percentage > 60 THEN 'warning' "
    f"ELSE 'info' END AS severity FROM ({CATEGORIES}) WHERE place = 1 AND percentage >= 30",
    "insight_top_correlation": sql(
        SALES_CTE, DERIVED_CTE,
        query=f"SELECT feature_x, feature_y, pearson_r, CASE WHEN pearson_r > 0 THEN 'positive' ELSE 'inverse' END AS direction "
        f"FROM (SELECT * FROM ({_pearson('derived', DERIVED)}) ORDER BY ABS(pearson_r) DESC, feature_x, feature_y LIMIT 1) "
        "WHERE ABS(pearson_r) >= 0.5",
    ),
    "insight_top_outlier": sql(
        SHAPED_CTE,
        query=f"SELECT * FROM ({_outliers('shaped', SHAPED, 'iqr')}) ORDER BY anomaly_count DESC, column_name LIMIT 1",
    ),
    "pareto_share": _pareto("orders", "o_totalprice"),
    "pareto_share_ties": _pareto("lineitem", "l_quantity"),
}
