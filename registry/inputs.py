"""The business tables the queries run on, derived from the supplied Parquet files.

``sales`` is one row per order line, ``census`` one row per country with yearly columns,
``dirty_sales`` is ``sales`` as text with known defects. Each has a Spark version and a
SQL version (a common table expression) that give the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import dealt, limit_methods, parts_of

ORDER_KEY = ["order_id", "line_no", "part_id", "supplier_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order, customer, country and part; equi-joins on keys only.

    Tables below the size threshold are broadcast, large ones are merge-joined. No hint is given.
    Orders meet their customers and lines their parts before the two meet, so that the lines,
    by far the largest table, are shuffled twice and not with the columns of all others.
    """
    countries = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(countries, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.col("l_extendedprice").cast("decimal(18,2)") * (
        F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    )
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("l_shipdate").cast("date").alias("delivery_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("product"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_discount") + 0.0).alias("discount_percent"),
        amount.cast("double").alias("total_sales"),
        (1 + (F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("double").alias("customer_satisfaction"),
    )


SALES_CTE = """sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supplier_id,
    CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS delivery_date,
    o_custkey AS customer_id, c_mktsegment AS customer_segment, r_name AS region, n_name AS country,
    p_type AS category, p_brand AS product, o_orderpriority AS payment_method, o_orderstatus AS order_status,
    l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_discount + 0.0 AS discount_percent,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS total_sales,
    CAST(1 + (l_orderkey + l_linenumber) % 5 AS DOUBLE) AS customer_satisfaction
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey)"""

SALES_COLUMNS = [
    "order_id", "line_no", "part_id", "supplier_id", "order_date", "delivery_date", "customer_id", "customer_segment",
    "region", "country", "category", "product", "payment_method", "order_status", "quantity", "unit_price",
    "discount_percent", "total_sales", "customer_satisfaction",
]

CENSUS_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per country and year, one column per year."""
    value = F.col("o_totalprice").cast("decimal(18,2)")
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy(F.col("n_name").alias("Country/Territory"), F.col("r_name").alias("Continent")).agg(
        *[
            F.floor(F.coalesce(F.sum(F.when(F.year("o_orderdate") == y, value)), F.lit(0).cast("decimal(18,2)")))
            .cast("bigint")
            .alias(f"{y} Population")
            for y in CENSUS_YEARS
        ]
    )


CENSUS_CTE = (
    'census AS (SELECT n_name AS "Country/Territory", r_name AS "Continent", '
    + ", ".join(
        f"CAST(floor(COALESCE(SUM(CASE WHEN year(o_orderdate) = {y} THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0)) "
        f'AS BIGINT) AS "{y} Population"'
        for y in CENSUS_YEARS
    )
    + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"
)


def _pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


_PLACEHOLDER_CELLS = ["unknown", "NA", "n/a", "NULL", "None", "-", "--", "", "NaN", "undefined", "nil", "N.A.", "?"]
_REGION = "customer_id % 5"
_CATEGORY = "part_id % 6"
_TAB_PAD = {"spark": "'\\t'", "duckdb": "chr(9)"}
_DATE = {
    "spark": "date_format(order_date, '{}')",
    "duckdb": "strftime(order_date, '{}')",
}
_LAYOUTS = {
    "spark": ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy"],
    "duckdb": ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %b %Y"],
}


def _dirty_sql(engine: str, source: str) -> str:
    dates = [_DATE[engine].format(x) for x in _LAYOUTS[engine]]
    compass = ["North", "South", "East", "West", "Central"]
    goods = ["Electronics", "Clothing", "Furniture", "Groceries", "Toys", "Beauty"]
    pay = ["Credit Card", "Debit Card", "UPI", "Net Banking", "Cash"]
    blank = _pick("k % 13", _PLACEHOLDER_CELLS)
    cents = "CAST(floor({} * 100 + 0.5) AS BIGINT)"

    def text(c: str) -> str:
        return f"CAST(CAST(floor({c} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({c} % 100 AS STRING), 2, '0')"

    names = [
        "Order ID", "Transaction ID", "Order Date", " Region ", "Category", "Payment Method", "Quantity",
        "Unit Price", "Discount", "Total Sales", "Customer Satisfaction",
    ]
    columns = [
        "CAST(order_id AS STRING) || CASE WHEN k % 11 = 0 THEN '.0' ELSE '' END",
        "'TX-' || CAST(order_id AS STRING) || '-' || CAST(line_no AS STRING) || '-' || CAST(part_id AS STRING)"
        " || '-' || CAST(supplier_id AS STRING)",
        f"CASE WHEN k % 53 = 0 THEN 'not a date' WHEN k % 4 = 0 THEN {dates[0]} WHEN k % 4 = 1 THEN {dates[1]}"
        f" WHEN k % 4 = 2 THEN {dates[2]} ELSE {dates[3]} END",
        f"CASE WHEN k % 17 = 0 THEN {blank} WHEN k % 9 = 0 THEN lower({_pick(_REGION, compass)})"
        f" WHEN k % 9 = 1 THEN {_pick(_REGION, ['n.', 's.', 'E.', 'w.', 'c.'])}"
        f" WHEN k % 9 = 2 THEN {_pick(_REGION, ['nort', 'suth', 'est', 'wst', 'cntral'])}"
        f" WHEN k % 9 = 3 THEN '  ' || {_pick(_REGION, compass)} || ' ' || {_TAB_PAD[engine]}"
        f" WHEN k % 9 = 4 THEN {_pick(_REGION, ['Northh', 'Southe', 'Eastt', 'Weest', 'Centrall'])}"
        f" ELSE {_pick(_REGION, compass)} END",
        f"CASE WHEN k % 17 = 1 THEN {blank} WHEN k % 9 = 0 THEN lower({_pick(_CATEGORY, goods)})"
        f" WHEN k % 9 = 1 THEN upper({_pick(_CATEGORY, goods)})"
        f" WHEN k % 9 = 2 THEN {_pick(_CATEGORY, ['electroncs', 'clothng', 'furnture', 'grocry', 'toy', 'beuty'])}"
        f" WHEN k % 9 = 3 THEN {_pick(_CATEGORY, ['Electronix', 'Clothes', 'Furnitur', 'Grocerie', 'Toyz', 'Beautyy'])}"
        f" WHEN k % 9 = 4 AND k % 5 = 0 THEN 'mid-market mix' ELSE {_pick(_CATEGORY, goods)} END",
        f"CASE WHEN k % 17 = 2 THEN {blank} WHEN k % 9 = 0 THEN upper({_pick(_REGION, pay)})"
        f" WHEN k % 9 = 1 THEN {_pick(_REGION, ['creditcard', 'card debit', 'u p i', 'netbanking', 'Cashh'])}"
        f" ELSE {_pick(_REGION, pay)} END",
        "CASE WHEN k % 29 = 0 THEN NULL WHEN k % 13 = 0 THEN '-' || CAST(CAST(quantity AS BIGINT) AS STRING)"
        " ELSE CAST(CAST(quantity AS BIGINT) AS STRING) END",
        f"'$' || CASE WHEN k % 31 = 0 THEN '-' ELSE '' END || {text(cents.format('unit_price'))}",
        f"CASE WHEN k % 3 = 0 THEN CAST({cents.format('discount_percent')} AS STRING) || '%'"
        f" ELSE '0.' || lpad(CAST({cents.format('discount_percent')} AS STRING), 2, '0') END",
        f"CASE WHEN k % 997 = 0 THEN {text('(100 * ' + cents.format('total_sales') + ')')}"
        f" ELSE {text(cents.format('total_sales'))} END",
        "CASE WHEN k % 37 = 0 THEN '99' WHEN k % 41 = 0 THEN '0'"
        " ELSE CAST(CAST(customer_satisfaction AS BIGINT) AS STRING) END",
    ]
    quote = "`" if engine == "spark" else '"'
    shown = ", ".join(f"{c} AS {quote}{n}{quote}" for c, n in zip(columns, names))
    empty = ", ".join(f"CAST(NULL AS STRING) AS {quote}{n}{quote}" for n in names)
    keyed = f"(SELECT *, order_id * 7 + line_no AS k FROM {source}) AS keyed"
    if engine == "spark":  # the joins below run once: a row is made once and then repeated
        listed = ", ".join(f"`{n}`" for n in names)
        twice = f"SELECT {shown}, CASE WHEN k % 101 = 0 THEN array(1, 2) ELSE array(1) END AS copies FROM {keyed}"
        doubled = f"SELECT {listed} FROM ({twice}) AS made LATERAL VIEW explode(copies) AS copy"
    else:
        doubled = f"SELECT {shown} FROM {keyed} UNION ALL SELECT {shown} FROM {keyed} WHERE k % 101 = 0"
    return f"{doubled} UNION ALL SELECT {empty} FROM (VALUES (1), (2), (3), (4), (5)) AS blank_rows(n)"


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_dirty_sql("spark", "{source}"), source=sales(spark, sf_dir))


def sales_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``sales`` in parts whose joins can run one after another: a part has some of the orders."""
    lines = sales(spark, sf_dir)
    return dealt(lines, [F.col("order_id")], parts_of(lines))


def dirty_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``dirty_sales`` in such parts; the blank rows are in the first."""
    made = [spark.sql(_dirty_sql("spark", "{source}"), source=part) for part in sales_parts(spark, sf_dir)]
    return [made[0], *[part.where("`Order ID` IS NOT NULL") for part in made[1:]]]


DIRTY_CTE = f"dirty AS ({_dirty_sql('duckdb', 'sales')})"


def sql(*ctes: str, query: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query


def rounded(expression: str, digits: int) -> str:
    """SQL twin of ``half_up``."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def money_sum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(28,10))) AS DOUBLE)"


def sum2(c: str) -> str:
    """SQL twin of ``rounded_sum``."""
    return f"CAST(ROUND(SUM(CAST({c} AS DECIMAL(28,10))), 2) AS DOUBLE)"


def money_avg(c: str) -> str:
    return f"({money_sum(c)} / COUNT({c}))"


def flat(df: DataFrame) -> DataFrame:
    """Plain result types: bigint, double, string. Dates become ISO texts."""
    shown = []
    for f in df.schema:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = c.cast("double") + 0.0
        elif isinstance(t, T.IntegralType):
            c = c.cast("bigint")
        shown.append(c.alias(f.name))
    return df.select(*shown)


def query(build):
    """Wrap ``build(spark, sf_dir)`` so that it returns plain result types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        limit_methods(spark)
        return flat(build(spark, sf_dir))

    run.__name__ = getattr(build, "__name__", "query")
    return run
