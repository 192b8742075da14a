"""Star schema tables, measures and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import checks, star

from .inputs import CENSUS_CTE, ORDER_KEY, SALES_CTE, money_sum, query, rounded, sales, sql, sum2, table
from .kpis import GROWTH_CTE, LATEST, PROJECTED, projected_census

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
MEASURES = ["quantity", "unit_price", "discount_percent"]


def dimensions(s, d):
    t = sales(s, d)
    parts = [
        star.dim_category(t, c, "key").select(F.lit(c).alias("dimension"), "key", F.col(c).alias("value"))
        for c in ("region", "category", "product")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def large_dimension(s, d):
    """Numbered in range buckets, as a dimension that grows with the data is."""
    return star.dim_category(table(s, d, "customer"), "c_name", "customer_key")


def facts(s, d):
    t = sales(s, d).select(*ORDER_KEY, "region", "category", "total_sales")
    return star.fact_dim_join(t, {c: star.dim_category(t, c) for c in ("region", "category")})


def orphans(s, d):
    """Labels without a document, and order lines against their parts."""
    a = star.fact_orphans(table(s, d, "labels"), "doc_id", table(s, d, "documents"), "doc_id", "labels-documents")
    b = star.fact_orphans(
        table(s, d, "lineitem"), "l_partkey", table(s, d, "part"), "p_partkey", "lineitem-part"
    )
    return a.unionByName(b)


def totals(s, d):
    return star.measure_totals(sales(s, d), "total_sales", MEASURES)


QUERIES = {
    "dim_date": query(lambda s, d: star.dim_date(sales(s, d), "order_date")),
    "dim_category": query(dimensions),
    "dim_category_large": query(large_dimension),
    "fact_dim_join": query(facts),
    "fact_orphans": query(orphans),
    "measure_totals": query(totals),
    "measure_prior_year": query(lambda s, d: star.measure_prior_year(sales(s, d), "order_date", "total_sales")),
    "measure_yoy_growth": query(lambda s, d: star.measure_yoy_growth(sales(s, d), "order_date", "total_sales")),
    "measure_entity_totals": query(
        lambda s, d: star.measure_entity_totals(projected_census(s, d), LATEST, PROJECTED, "historical_cagr_pct")
    ),
    "matrix_two_dims": query(lambda s, d: star.matrix_two_dims(sales(s, d), "category", "region", "total_sales")),
    "matrix_two_dims_wide": query(
        lambda s, d: star.matrix_two_dims(sales(s, d), "category", "region", "total_sales", wide=True)
    ),
    "banned_vocabulary_scan": query(
        lambda s, d: checks.banned_vocabulary_scan(table(s, d, "documents"), "documents", ["text"])
    ),
    "banned_vocabulary_healthcare": query(
        lambda s, d: checks.banned_vocabulary_scan(table(s, d, "documents"), "documents", ["text", "source"], domain="healthcare")
    ),
    "banned_vocabulary_finance": query(
        lambda s, d: checks.banned_vocabulary_scan(table(s, d, "conversations"), "conversations", ["text"], domain="finance")
    ),
    "banned_vocabulary_turns": query(
        lambda s, d: checks.banned_vocabulary_scan(table(s, d, "conversations"), "conversations", ["role", "text"])
    ),
}

PRIOR = f"""monthly AS (SELECT date_trunc('month', order_date) AS month, SUM(CAST(total_sales AS DECIMAL(28,10))) AS t
FROM sales GROUP BY 1), prior AS (SELECT strftime(a.month, '%Y-%m-%d') AS month, CAST(ROUND(a.t, 2) AS DOUBLE) AS total,
CAST(ROUND(b.t, 2) AS DOUBLE) AS total_last_year FROM monthly a LEFT JOIN monthly b ON a.month = b.month + INTERVAL 1 YEAR)"""


def _orphans(fact: str, fk: str, dim: str, dk: str, name: str) -> str:
    return f"""SELECT '{name}' AS relationship, COUNT(*) AS fact_rows, COUNT(CASE WHEN {fk} IS NULL THEN 1 END) AS null_keys,
COUNT(CASE WHEN {fk} IS NOT NULL AND {fk} NOT IN (SELECT {dk} FROM {dim}) THEN 1 END) AS orphan_rows,
COUNT(DISTINCT CASE WHEN {fk} NOT IN (SELECT {dk} FROM {dim}) THEN {fk} END) AS orphan_keys,
(SELECT COUNT(*) FROM (SELECT {dk} FROM {dim} GROUP BY 1 HAVING COUNT(*) > 1)) AS duplicate_dim_keys FROM {fact}"""


def _banned(source: str, columns: list[str], domain: str = "demographics") -> str:
    rows = [
        f"SELECT '{source}' AS table_name, '{c}' AS column_name, '{t}' AS term, 'symbol' AS kind, "
        f"COUNT(CASE WHEN contains({c}, '{t}') THEN 1 END) AS hits FROM {source}"
        for c in columns
        for t in fixed.BANNED_SYMBOLS[domain]
    ] + [
        f"SELECT '{source}' AS table_name, '{c}' AS column_name, '{t}' AS term, 'word' AS kind, COUNT(CASE WHEN regexp_matches({c}, '(?i)\\b{t}\\b') THEN 1 END) AS hits FROM {source}"
        for c in columns
        for t in fixed.BANNED_TERMS[domain]
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE hits > 0"


ORACLES = {
    "dim_date": sql(
        SALES_CTE,
        query="""SELECT strftime(d, '%Y-%m-%d') AS "Date", year(d) AS "Year", quarter(d) AS "Quarter", month(d) AS "Month",
strftime(d, '%B') AS "MonthName", isodow(d) AS "DayOfWeek"
FROM (SELECT unnest(generate_series(MIN(order_date), MAX(order_date), INTERVAL 1 DAY)) AS d FROM sales)""",
    ),
    "dim_category": sql(
        SALES_CTE,
        query=" UNION ALL ".join(
            f"SELECT '{c}' AS dimension, DENSE_RANK() OVER (ORDER BY {c}) AS key, {c} AS value "
            f"FROM (SELECT DISTINCT {c} FROM sales)"
            for c in ("region", "category", "product")
        ),
    ),
    "dim_category_large": "SELECT c_name, ROW_NUMBER() OVER (ORDER BY c_name) AS customer_key "
    "FROM (SELECT DISTINCT c_name FROM customer)",
    "fact_dim_join": sql(
        SALES_CTE,
        query="SELECT order_id, CAST(line_no AS BIGINT) AS line_no, part_id, supplier_id, total_sales, "
        "DENSE_RANK() OVER (ORDER BY region) AS region_key, DENSE_RANK() OVER (ORDER BY category) AS category_key FROM sales",
    ),
    "fact_orphans": _orphans("labels", "doc_id", "documents", "doc_id", "labels-documents")
    + " UNION ALL " + _orphans("lineitem", "l_partkey", "part", "p_partkey", "lineitem-part"),
    "measure_totals": sql(
        SALES_CTE,
        query=" UNION ALL ".join(
            [f"SELECT 'Total {c}' AS measure, {sum2(c)} AS value FROM sales" for c in ["total_sales", *MEASURES]]
            + ["SELECT 'Total Transactions', CAST(COUNT(*) AS DOUBLE) FROM sales",
               f"SELECT 'Average Transaction Value', {rounded(money_sum('total_sales') + ' / COUNT(*)', 2)} FROM sales"]
        ),
    ),
    "measure_prior_year": sql(SALES_CTE, PRIOR, query="SELECT * FROM prior"),
    "measure_yoy_growth": sql(
        SALES_CTE, PRIOR,
        query=f"SELECT *, {rounded('(total - total_last_year) / NULLIF(total_last_year, 0)', 4)} AS yoy_growth FROM prior",
    ),
    "measure_entity_totals": sql(
        CENSUS_CTE, GROWTH_CTE,
        query=f"""SELECT 'Total' AS measure, CAST(SUM("{LATEST}") AS DOUBLE) AS value FROM growth
UNION ALL SELECT 'Total Entities', CAST(COUNT(*) AS DOUBLE) FROM growth
UNION ALL SELECT 'Total Projected', CAST(SUM("{PROJECTED}") AS DOUBLE) FROM growth
UNION ALL SELECT 'Average Growth', {rounded('AVG(historical_cagr_pct)', 4)} FROM growth""",
    ),
    "matrix_two_dims": sql(
        SALES_CTE, query=f"SELECT category, region, {sum2('total_sales')} AS total FROM sales GROUP BY 1, 2"
    ),
    "matrix_two_dims_wide": sql(
        SALES_CTE,
        query="SELECT category, "
        + ", ".join(
            f"CAST(ROUND(SUM(CASE WHEN region = '{r}' THEN CAST(total_sales AS DECIMAL(28,10)) END), 2) AS DOUBLE) AS \"{r}\""
            for r in REGIONS
        )
        + " FROM sales GROUP BY 1",
    ),
    "banned_vocabulary_scan": _banned("documents", ["text"]),
    "banned_vocabulary_healthcare": _banned("documents", ["text", "source"], "healthcare"),
    "banned_vocabulary_finance": _banned("conversations", ["text"], "finance"),
    "banned_vocabulary_turns": _banned("conversations", ["role", "text"]),
}
