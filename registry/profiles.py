"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import profile
from tablewright.sources import files

from .cleaning import HEADED_CTE, NAMES, headed
from .inputs import DIRTY_CTE, SALES_CTE, query, rounded, sales, sql, table

SALES_TYPES = {
    "order_id": "bigint", "line_no": "int", "part_id": "bigint", "supplier_id": "bigint", "order_date": "date",
    "delivery_date": "date", "customer_id": "bigint", "customer_segment": "string", "region": "string",
    "country": "string", "category": "string", "product": "string", "payment_method": "string",
    "order_status": "string", "quantity": "double", "unit_price": "double", "discount_percent": "double",
    "total_sales": "double", "customer_satisfaction": "double",
}
CUSTOMER_TYPES = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
}
EVENT_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
    "props": "string",
}


def holed_events(s, d):
    """``events`` with missing time stamps and types."""
    return table(s, d, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"), "user_id",
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), "value", "props",
    )


EVENTS_CTE = """holed AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts, user_id,
CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, value, props FROM events)"""


def inspected(s, d):
    return profile.inspect_columns(table(s, d, "customer"), approx_distinct=False, order_by=["c_custkey"])


def viewed(s, d):
    files.register_views(table(s, d, "customer"), ["inspected_customers"])
    return profile.inspect_view(s, "inspected_customers", approx_distinct=False, order_by=["c_custkey"])


def approx(s, d):
    return profile.inspect_columns(sales(s, d), order_by=["order_id", "line_no"]).drop("sample_values")


QUERIES = {
    "inspect_columns": query(inspected),
    "inspect_columns_approx": query(approx),
    "inspect_view": query(viewed),
    "profile_light": query(lambda s, d: profile.profile_light(holed_events(s, d))),
    "profile_role": query(lambda s, d: profile.profile_role(sales(s, d))),
    "profile_full": query(lambda s, d: profile.profile_full(table(s, d, "customer"))),
    "profile_full_nulls": query(lambda s, d: profile.profile_full(holed_events(s, d))),
    "profile_top_categories": query(
        lambda s, d: profile.profile_top_categories(table(s, d, "documents"), ["text", "lang", "source"])
    ),
    "profile_outlier_count": query(
        lambda s, d: profile.profile_outlier_count(sales(s, d), ["quantity", "unit_price", "total_sales"])
    ),
    "placeholder_cell_count": query(lambda s, d: profile.placeholder_cell_count(headed(s, d))),
    "duplicate_row_count": query(lambda s, d: profile.duplicate_row_count(headed(s, d))),
}


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _inspect(source: str, types: dict, order: str) -> str:
    return _union(
        f"SELECT '{c}' AS column_name, '{t}' AS inferred_type, (SELECT string_agg(COALESCE(CAST({c} AS VARCHAR), 'null'), "
        f"', ' ORDER BY {order}) FROM (SELECT * FROM {source} ORDER BY {order} LIMIT 5)) AS sample_values, "
        f"COUNT(*) AS row_count, CAST({len(types)} AS BIGINT) AS column_count, COUNT(*) - COUNT({c}) AS null_count "
        f"FROM {source}"
        for c, t in types.items()
    )


def _distinct(c: str) -> str:
    return f"(COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"


def _stamp(f: str, c: str) -> str:
    """Time stamp text without trailing zeros of the fraction."""
    return f"regexp_replace(strftime({f}({c}), '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')"


def _light(source: str, types: dict) -> str:
    parts = []
    for c, t in types.items():
        number, date, text = int(t in ("bigint", "int", "double")), int(t in ("date", "timestamp_ntz")), int(t == "string")
        low, high = (_stamp(f, c) if date else "CAST(NULL AS VARCHAR)" for f in ("MIN", "MAX"))
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, COUNT(*) AS total_rows, {_distinct(c)} AS cardinality, "
            f"CAST(ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS DOUBLE) AS null_pct, "
            f"CAST({number} AS BIGINT) AS is_numeric, CAST({date} AS BIGINT) AS is_temporal, "
            f"CAST({text} AS BIGINT) AS is_categorical, {low} AS min_val, {high} AS max_val FROM {source}"
        )
    return _union(parts)


def _role(c: str, t: str) -> str:
    if c in ("order_id", "customer_id"):
        return "'identifier'"
    if t in ("date", "timestamp_ntz"):
        return "'date'"
    if t in ("bigint", "int", "double"):
        return "'numerical'"
    return f"CASE WHEN {_distinct(c)} < 50 THEN 'categorical' ELSE 'text' END"


def _roles(source: str, types: dict) -> str:
    return _union(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, {_distinct(c)} AS unique_count, {_role(c, t)} AS role FROM {source}"
        for c, t in types.items()
    )


def _outliers(source: str, c: str) -> str:
    return (
        f"(SELECT COUNT(*) FROM {source}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS z FROM {source})"
        f" WHERE z > a AND ({c} < a - 1.5 * (z - a) OR {c} > z + 1.5 * (z - a)))"
    )


def _full(source: str, types: dict) -> str:
    parts = []
    for c, t in types.items():
        number, date = t in ("bigint", "int", "double"), t in ("date", "timestamp_ntz")
        none, text = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
        mode = (
            f"(SELECT COALESCE({c}, 'null') FROM {source} GROUP BY {c} ORDER BY COUNT(*) DESC, {c} NULLS LAST LIMIT 1)"
        )
        parts.append(
            f"SELECT '{c}' AS column_name, {_role(c, t)} AS role, COUNT({c}) AS non_null_count, "
            f"COUNT(*) - COUNT({c}) AS missing_count, {_distinct(c)} AS unique_count, "
            f"{rounded(f'MIN({c})', 2) if number else none} AS min_val, "
            f"{rounded(f'MAX({c})', 2) if number else none} AS max_val, "
            f"{rounded(f'AVG({c})', 2) if number else none} AS mean_val, "
            f"{rounded(f'STDDEV_SAMP({c})', 2) if number else none} AS std_val, "
            f"{rounded(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 2) if number else none} AS median_val, "
            + ", ".join(
                (_stamp(f, c) if date else text) + f" AS {n}"
                for f, n in (("MIN", "min_date"), ("MAX", "max_date"))
            )
            + f", {_outliers(source, c) if number else 'CAST(0 AS BIGINT)'} AS outlier_count, "
            f"CAST(ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS DOUBLE) AS missing_pct, "
            f"CAST(ROUND((COUNT(*) - {_distinct(c)}) * 100.0 / COUNT(*), 1) AS DOUBLE) AS duplicate_pct, "
            f"{mode if t == 'string' else text} AS mode_val FROM {source}"
        )
    return _union(parts)


def _top(source: str, columns: list[str]) -> str:
    return _union(
        f"(SELECT '{c}' AS column_name, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c} NULLS LAST) AS place, "
        f"COALESCE({c}, 'null') AS category, COUNT(*) AS count, "
        f"{rounded(f'COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {source})', 1)} AS percentage "
        f"FROM {source} GROUP BY {c} ORDER BY place LIMIT 5)"
        for c in columns
    )


_PLACEHOLDER = ", ".join("'" + p + "'" for p in fixed.PLACEHOLDERS)

ORACLES = {
    "inspect_columns": _inspect("customer", CUSTOMER_TYPES, "c_custkey"),
    "inspect_view": _inspect("customer", CUSTOMER_TYPES, "c_custkey"),
    "profile_light": sql(EVENTS_CTE, query=_light("holed", EVENT_TYPES)),
    "profile_role": sql(SALES_CTE, query=_roles("sales", SALES_TYPES)),
    "profile_full": _full("customer", CUSTOMER_TYPES),
    "profile_full_nulls": sql(EVENTS_CTE, query=_full("holed", EVENT_TYPES)),
    "profile_top_categories": _top("documents", ["text", "lang", "source"]),
    "profile_outlier_count": sql(
        SALES_CTE,
        query=_union(
            f"SELECT '{c}' AS column_name, a - 1.5 * (z - a) AS lower_bound, z + 1.5 * (z - a) AS upper_bound, "
            f"{_outliers('sales', c)} AS outlier_count "
            f"FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS z FROM sales)"
            for c in ["quantity", "unit_price", "total_sales"]
        ),
    ),
    "placeholder_cell_count": sql(
        SALES_CTE, DIRTY_CTE, HEADED_CTE,
        query="SELECT CAST(SUM("
        + " + ".join(
            f"CASE WHEN {n} IS NULL OR lower(regexp_replace({n}, '^\\s+|\\s+$', '', 'g')) IN ({_PLACEHOLDER}) THEN 1 ELSE 0 END"
            for n in NAMES
        )
        + f") AS BIGINT) AS placeholder_cells, COUNT(*) * {len(NAMES)} AS total_cells FROM headed",
    ),
    "duplicate_row_count": sql(
        SALES_CTE, DIRTY_CTE, HEADED_CTE,
        query="SELECT CAST(SUM(n) AS BIGINT) AS total_rows, COUNT(*) AS distinct_rows, "
        "CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicate_rows "
        "FROM (SELECT COUNT(*) AS n FROM headed GROUP BY " + ", ".join(NAMES) + ")",
    ),
}
