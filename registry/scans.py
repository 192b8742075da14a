"""Scans, sinks, views and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tablewright.session import scratch_path
from tablewright.sources import files

from .inputs import CENSUS_CTE, DIRTY_CTE, ORDER_KEY, SALES_CTE, census, dirty_sales, money_sum, query, sales, sql, table

TYPED = (
    "order_id bigint, line_no int, part_id bigint, supplier_id bigint, order_date date, delivery_date date, "
    "customer_id bigint, customer_segment string, region string, country string, category string, product string, "
    "payment_method string, order_status string, quantity double, unit_price double, discount_percent double, "
    "total_sales double, customer_satisfaction double"
)
SALES_TEXT = """SELECT order_id, CAST(line_no AS BIGINT) AS line_no, part_id, supplier_id,
  strftime(order_date, '%Y-%m-%d') AS order_date, strftime(delivery_date, '%Y-%m-%d') AS delivery_date, customer_id,
  customer_segment, region, country, category, product, payment_method, order_status, quantity, unit_price,
  discount_percent, total_sales, customer_satisfaction FROM sales"""


def csv_strings(spark, sf):
    source = dirty_sales(spark, sf)
    path = files.write_csv(source, scratch_path(spark, "dirty.csv"))
    return files.read_csv_strings(spark, path, source.columns)


def parquet(spark, sf):
    return files.read_parquet(spark, f"{sf}/orders.parquet")


def csv_typed(spark, sf):
    path = files.write_csv(sales(spark, sf), scratch_path(spark, "sales.csv"))
    return files.read_csv_typed(spark, path, TYPED)


def delimited(spark, sf):
    source = table(spark, sf, "customer")
    path = files.write_csv(source, scratch_path(spark, "customer.tsv"), sep="\t")
    return files.read_delimited(spark, path)


def detected(spark, sf):
    """Comma and semicolon files, the separator of the second found from its first line."""
    source = table(spark, sf, "supplier")
    parts = []
    for name, sep in (("supplier.csv", ","), ("supplier.txt", ";")):
        path = files.write_csv(source, scratch_path(spark, name), sep=sep)
        read = files.read_delimited(spark, path)
        parts.append(read.select(F.lit(name).alias("file"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in source.schema]))
    return parts[0].unionByName(parts[1])


def views(spark, sf):
    names = files.register_views(sales(spark, sf))
    counted = [
        spark.table(n).agg(
            F.lit(n).alias("view_name"),
            F.count("*").alias("row_count"),
            F.sum(F.col("total_sales").cast("decimal(28,10)")).cast("double").alias("total_sales"),
        )
        for n in names
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


def head(spark, sf):
    return files.head_sample(sales(spark, sf).select(*ORDER_KEY, "category", "total_sales"), 15, ORDER_KEY)


def sink_csv(spark, sf):
    source = census(spark, sf)
    path = files.write_csv(source, scratch_path(spark, "census.csv"))
    return files.read_csv_typed(spark, path, source.schema)


def sink_parquet(spark, sf):
    path = files.write_parquet(sales(spark, sf), scratch_path(spark, "sales.parquet"))
    return files.read_parquet(spark, path)


def preview(spark, sf):
    return files.preview_rows(table(spark, sf, "events"), 15, ["event_id"])


QUERIES = {
    "scan_delimited_detected": query(detected),
    "scan_csv_strings": query(csv_strings),
    "scan_parquet": query(parquet),
    "scan_csv_typed": query(csv_typed),
    "scan_delimited": query(delimited),
    "register_views": query(views),
    "head_sample": query(head),
    "write_csv": query(sink_csv),
    "write_parquet": query(sink_parquet),
    "preview_rows": query(preview),
}

_SUPPLIERS = "s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal + 0.0 AS s_acctbal FROM supplier"

ORACLES = {
    "scan_delimited_detected": f"SELECT 'supplier.csv' AS file, {_SUPPLIERS} UNION ALL SELECT 'supplier.txt' AS file, {_SUPPLIERS}",
    "scan_csv_strings": sql(SALES_CTE, DIRTY_CTE, query="SELECT NULLIF(COLUMNS(*), '') FROM dirty"),
    "scan_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
    "scan_csv_typed": sql(SALES_CTE, query=SALES_TEXT),
    "scan_delimited": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal + 0.0 AS c_acctbal, "
    "c_mktsegment FROM customer",
    "register_views": sql(
        SALES_CTE,
        query=" UNION ALL ".join(
            f"SELECT '{n}' AS view_name, COUNT(*) AS row_count, {money_sum('total_sales')} AS total_sales FROM sales"
            for n in files.VIEW_NAMES
        ),
    ),
    "head_sample": sql(
        SALES_CTE,
        query="SELECT order_id, CAST(line_no AS BIGINT) AS line_no, part_id, supplier_id, category, total_sales, "
        "(SELECT COUNT(*) FROM sales) AS total_rows FROM sales ORDER BY order_id, line_no, part_id, supplier_id LIMIT 15",
    ),
    "write_csv": sql(CENSUS_CTE, query="SELECT * FROM census"),
    "write_parquet": sql(SALES_CTE, query=SALES_TEXT),
    "preview_rows": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, event_type, value, props "
    "FROM events ORDER BY event_id LIMIT 15",
}
