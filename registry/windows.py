"""Row-level results that need the whole table: shares, running totals, ranks."""

from __future__ import annotations

from tablewright.operators import features

from .features import KEY, PCT, RANK, RUNNING, SALES_ORDER, _sales
from .inputs import ORDER_KEY, SALES_CTE, query, sql, table

RUNNING_NARROW = RUNNING.replace(SALES_ORDER, ", ".join([*ORDER_KEY, "total_sales"]))

QUERIES = {
    "pct_of_total": query(lambda s, d: features.pct_of_total(_sales(s, d, "total_sales"), "total_sales")),
    "running_total": query(
        lambda s, d: features.running_total(_sales(s, d, "total_sales"), "total_sales", ORDER_KEY)
    ),
    "running_total_hot": query(
        lambda s, d: features.running_total(
            table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
            "o_totalprice", ["o_orderpriority", "o_orderkey"],
        )
    ),
    "dense_rank_desc": query(lambda s, d: features.dense_rank_desc(_sales(s, d, "total_sales"), "total_sales")),
    "dense_rank_hot": query(
        lambda s, d: features.dense_rank_desc(_sales(s, d, "discount_percent"), "discount_percent")
    ),
}

ORACLES = {
    "pct_of_total": sql(SALES_CTE, query=f"SELECT {KEY}, total_sales, {PCT} FROM sales"),
    "running_total": sql(SALES_CTE, query=f"SELECT {KEY}, total_sales, {RUNNING_NARROW} FROM sales"),
    "running_total_hot": "SELECT o_orderkey, o_orderpriority, o_totalprice, "
    "CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(28,10))) OVER (ORDER BY o_orderpriority, o_orderkey "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE)"
    " AS running_cumulative_o_totalprice FROM orders",
    "dense_rank_desc": sql(SALES_CTE, query=f"SELECT {KEY}, total_sales, {RANK} FROM sales"),
    "dense_rank_hot": sql(
        SALES_CTE,
        query=f"SELECT {KEY}, discount_percent, DENSE_RANK() OVER (ORDER BY discount_percent DESC) "
        "AS discount_percent_rank FROM sales",
    ),
}
