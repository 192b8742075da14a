"""Cleaning steps on ``dirty_sales``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import expr, fixed
from tablewright.operators import clean
from tablewright.plans import cleaning
from tablewright.session import materialize, materialize_all

from .inputs import DIRTY_CTE, ORDER_KEY, SALES_CTE, dirty_parts, dirty_sales, query, rounded, sales, sql, table

NAMES = ["order_id", "transaction_id", "order_date", "region", "category", "payment_method", "quantity", "unit_price",
         "discount", "total_sales", "customer_satisfaction"]
RAW = ["Order ID", "Transaction ID", "Order Date", " Region ", "Category", "Payment Method", "Quantity", "Unit Price",
       "Discount", "Total Sales", "Customer Satisfaction"]
SETS = ["region", "category", "payment_method"]
DONE = fixed.AUDIT_OPERATIONS


def headed(s, d):
    return clean.normalize_headers(dirty_sales(s, d))


def trimmed(s, d):
    return clean.strip_id_suffix(clean.trim_null_placeholders(headed(s, d)))


def _keys(s, d, *columns):
    return trimmed(s, d).select("transaction_id", *columns)


def aliases(s, d):
    out = _keys(s, d, *SETS)
    for c in SETS:
        out = clean.alias_standardize(out, c)
    return out


def fuzzy(s, d):
    out, _ = materialize(_keys(s, d, *SETS), "keys")  # read for the distinct values and for the result
    return clean.fuzzy_standardize_all(out)


def titles(s, d):
    return clean.title_case_fallback(_keys(s, d, *SETS), SETS)


def dates(s, d):
    return clean.parse_dates(_keys(s, d, "order_date"))


def times(s, d):
    """Event times as text in three layouts, one of them without a time of day."""
    texts = table(s, d, "events").selectExpr("event_id", """CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
        WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") ELSE date_format(ts, 'dd.MM.yyyy') END AS event_time""")
    return clean.parse_dates(texts, keep_time=True).select(
        "event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time")
    )


def sales_fixed_rows(s, d):
    t = _keys(s, d, "quantity", "unit_price", "discount", "total_sales")
    t = clean.clean_discount(clean.clean_price(clean.clean_quantity(t, "quantity"), "unit_price"), "discount")
    return clean.recompute_sales(t, "total_sales", "quantity", "unit_price", "discount", only_bad_rows=True)


def sales_fixed(s, d):
    t = _keys(s, d, "quantity", "unit_price", "discount", "total_sales")
    t = clean.clean_discount(clean.clean_price(clean.clean_quantity(t, "quantity"), "unit_price"), "discount")
    return clean.recompute_sales(t, "total_sales", "quantity", "unit_price", "discount")


def ids(s, d):
    return clean.cast_id_int(_keys(s, d, "order_id"))


def infer(s, d):
    """The text conversion of the columns that look numeric; the others keep their text."""
    return clean.infer_numeric_columns(
        _keys(s, d, "region", "unit_price", "discount", "total_sales"), ["region", "unit_price", "discount", "total_sales"]
    )


def medians(s, d):
    t = _keys(s, d, "quantity").withColumn("quantity", expr.to_number(F.col("quantity")))
    rated = sales(s, d).select(
        F.concat_ws("-", *ORDER_KEY).alias("transaction_id"),
        F.when(F.col("quantity") > 45, F.lit(None)).otherwise(F.col("total_sales")).alias("quantity"),
    )
    both, _ = materialize(t.unionByName(rated), "rated")  # read for nulls, medians and the result
    return clean.impute_median(both)


def mode(s, d):
    out, _ = materialize(_keys(s, d, *SETS), "keys")  # read for nulls, lengths, counts and the result
    return clean.impute_mode(out)


def fill(s, d):
    events = table(s, d, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("date")).alias("day")
    )
    return clean.forward_fill(events, ["day"], ["event_id"])


def run(s, d):
    """The pipeline reads its raw table from files, as it would in practice."""
    raw, path = materialize_all(dirty_parts(s, d), "dirty")
    return cleaning.clean_pipeline(raw, key=["transaction_id"], order_by=["transaction_id", "order_id"], spent=[path])


def recommendations(s, d):
    return run(s, d).recommendations()


QUERIES = {
    "normalize_headers": query(headed),
    "trim_null_placeholders": query(lambda s, d: clean.trim_null_placeholders(headed(s, d))),
    "strip_id_suffix": query(lambda s, d: clean.strip_id_suffix(headed(s, d)).select("order_id", "transaction_id")),
    "drop_empty_rows": query(lambda s, d: clean.drop_empty_rows(headed(s, d))),
    "dedupe_exact": query(lambda s, d: clean.dedupe_exact(headed(s, d))),
    "dedupe_key": query(lambda s, d: clean.dedupe_key(trimmed(s, d), ["order_id"], ["transaction_id"])),
    "alias_standardize": query(aliases),
    "fuzzy_standardize": query(fuzzy),
    "title_case_fallback": query(titles),
    "parse_dates_multi": query(dates),
    "parse_dates_keep_time": query(times),
    "recompute_sales_bad_rows": query(sales_fixed_rows),
    "clean_quantity": query(lambda s, d: clean.clean_quantity(_keys(s, d, "quantity"), "quantity")),
    "clean_price": query(lambda s, d: clean.clean_price(_keys(s, d, "unit_price"), "unit_price")),
    "clean_discount": query(lambda s, d: clean.clean_discount(_keys(s, d, "discount"), "discount")),
    "clean_rating": query(
        lambda s, d: clean.clean_rating(_keys(s, d, "customer_satisfaction"), "customer_satisfaction")
    ),
    "cast_id_int": query(ids),
    "infer_numeric_columns": query(infer),
    "recompute_sales": query(sales_fixed),
    "impute_median": query(medians),
    "impute_mode": query(mode),
    "forward_fill": query(fill),
    "clean_pipeline": query(lambda s, d: run(s, d).cleaned),
    "audit_trail": query(lambda s, d: run(s, d).audit),
    "before_after": query(lambda s, d: run(s, d).before_after),
    "quality_scorecard": query(lambda s, d: run(s, d).scorecard),
    "quality_recommendations": query(recommendations),
}


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _null_placeholder(c: str) -> str:
    return f"CASE WHEN lower({_trim(c)}) IN {_in(fixed.PLACEHOLDERS)} THEN NULL ELSE {_trim(c)} END"


def _no_zeros(c: str) -> str:
    return f"regexp_replace({c}, '\\.0+$', '')"


def _number(c: str) -> str:
    return f"TRY_CAST(regexp_replace({c}, '[^\\d.\\-]', '', 'g') AS DOUBLE)"


def _title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({c}), '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda w: upper(w[1]) || w[2:]), '')"
    )


HEADED_CTE = "headed AS (SELECT " + ", ".join(f'"{r}" AS {n}' for r, n in zip(RAW, NAMES)) + " FROM dirty)"
TRIMMED_CTE = (
    "trimmed AS (SELECT "
    + ", ".join(
        f"{_no_zeros(_null_placeholder(n)) if n in ('order_id', 'transaction_id') else _null_placeholder(n)} AS {n}"
        for n in NAMES
    )
    + " FROM headed)"
)
BASE = [SALES_CTE, DIRTY_CTE, HEADED_CTE]
TRIMMED = [*BASE, TRIMMED_CTE]
#: the same, each evaluated once however often the query reads it
MATERIALIZED = [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in TRIMMED]


def _alias_case(c: str) -> str:
    arms = " ".join(
        f"WHEN lower({c}) IN {_in(spellings)} THEN '{label}'" for label, spellings in fixed.ALIASES[c].items()
    )
    return f"CASE {arms} END"


def _lcs(source: str) -> list[str]:
    """Closest label of every unmatched value, by a longest-common-subsequence recursion."""
    values = " UNION ".join(
        f"SELECT '{c}' AS kind, {c} AS v FROM {source} WHERE {c} IS NOT NULL AND {_alias_case(c)} IS NULL" for c in SETS
    )
    labels = ", ".join(f"('{c}', '{lab}', {i})" for c in SETS for i, lab in enumerate(fixed.CANONICAL[c]))
    words = "array_to_string(list_sort(string_split(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), ' ')), ' ')"
    return [
        f"open_values AS ({values})",
        f"labels(kind, label, pos) AS (VALUES {labels})",
        f"pairs AS (SELECT o.kind, v, label, pos, {words.format('v')} AS a, {words.format('label')} AS b "
        "FROM open_values o JOIN labels l ON o.kind = l.kind)",
        """lcs AS (
  SELECT kind, v, label, pos, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS best FROM pairs
  UNION ALL
  SELECT kind, v, label, pos, a, b, i + 1,
    list_transform(range(1, length(b) + 2), lambda j: CAST(list_max(cand[1:j]) AS INTEGER))
  FROM (SELECT *, list_prepend(0, list_transform(range(1, length(b) + 1), lambda j: greatest(best[j + 1], best[j]
      + CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS BIGINT), 1) THEN 1 ELSE 0 END))) AS cand
    FROM lcs WHERE i < length(a)) AS step)""",
        f"""closest AS (SELECT kind, v, CASE WHEN score >= {fixed.FUZZY_CUTOFF} THEN label ELSE {_title('v')} END AS chosen
FROM (SELECT *, 200.0 * best[length(b) + 1] / (length(a) + length(b)) AS score,
  ROW_NUMBER() OVER (PARTITION BY kind, v ORDER BY 200.0 * best[length(b) + 1] / (length(a) + length(b)) DESC, pos) AS rn
  FROM lcs WHERE i = length(a)) AS scored WHERE rn = 1)""",
    ]


def _fuzzy(c: str) -> str:
    return f"COALESCE({_alias_case(c)}, (SELECT chosen FROM closest WHERE kind = '{c}' AND closest.v = {c}))"


def with_sql(ctes: list[str], query: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + query


LAYOUTS = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %b %Y"]
DATE = f"CAST(try_strptime(order_date, {LAYOUTS!r}) AS DATE)"
QUANTITY = f"GREATEST(COALESCE(ABS({_number('quantity')}), 1.0), 1.0)"
PRICE = f"ABS({_number('unit_price')})"
_D = f"ABS({_number('discount')})"
DISCOUNT = (
    f"CASE WHEN {_D} IS NULL THEN 0.0 ELSE LEAST(CASE WHEN {_D} > 1 OR contains(discount, '%') THEN {_D} / 100 ELSE {_D} END, 0.99) END"
)
_R = _number("customer_satisfaction")


def _rating(source: str) -> str:
    median = f"(SELECT quantile_cont({_R}, 0.5) FROM {source} WHERE {_R} <= 5)"
    return f"CASE WHEN {_R} > 5 THEN {median} WHEN {_R} < 1 THEN 1.0 ELSE {_R} END"


FORMULA = rounded("quantity * unit_price * (1.0 - discount)", 2)

# the whole run: one table expression per step
PIPELINE = [
    *TRIMMED,
    "filled AS (SELECT * FROM trimmed WHERE COALESCE(" + ", ".join(NAMES) + ") IS NOT NULL)",
    "uniq AS (SELECT DISTINCT * FROM filled)",
    "keyed AS (SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY transaction_id ORDER BY "
    + ", ".join(f"{c} ASC NULLS FIRST" for c in ["order_id", *NAMES[2:]])
    + ") AS rn FROM uniq) WHERE rn = 1)",
    *_lcs("keyed"),
    f"""ruled AS (SELECT CAST(order_id AS BIGINT) AS order_id, transaction_id, {DATE} AS order_date,
  {_fuzzy('region')} AS region, {_fuzzy('category')} AS category, {_fuzzy('payment_method')} AS payment_method,
  {QUANTITY} AS quantity, {PRICE} AS unit_price, {DISCOUNT} AS discount, {_number('total_sales')} AS total_sales,
  {_rating('keyed')} AS customer_satisfaction, region AS raw_region, category AS raw_category,
  payment_method AS raw_payment_method, order_date AS raw_order_date, {_number('quantity')} AS raw_quantity,
  {_number('unit_price')} AS raw_unit_price, {_number('discount')} AS raw_discount,
  {_number('total_sales')} AS raw_total_sales, {_R} AS raw_customer_satisfaction FROM keyed)""",
    f"""repaired AS (SELECT * REPLACE ({FORMULA} AS total_sales) FROM ruled
WHERE (SELECT bool_or(ABS(total_sales - {FORMULA}) > 5 OR total_sales > 100000) FROM ruled)
UNION ALL SELECT * FROM ruled
WHERE NOT (SELECT bool_or(ABS(total_sales - {FORMULA}) > 5 OR total_sales > 100000) FROM ruled))""",
]


def _mode(c: str, source: str) -> str:
    return (
        f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
    )


IMPUTED = (
    "cleaned AS (SELECT order_id, transaction_id, last_value(order_date IGNORE NULLS) OVER (ORDER BY transaction_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_date, "
    + ", ".join(f"COALESCE({c}, {_mode(c, 'repaired')}) AS {c}" for c in SETS)
    + ", quantity, unit_price, discount, total_sales, customer_satisfaction FROM repaired)"
)
CLEANED = [*PIPELINE, IMPUTED]

_BUSINESS = ["quantity", "unit_price", "discount", "total_sales", "customer_satisfaction"]
_RAW_DUPLICATES = "(SELECT (SELECT COUNT(*) FROM headed) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM headed)))"
_PLACEHOLDER_CELLS = (
    "(SELECT SUM("
    + " + ".join(f"CASE WHEN {n} IS NULL OR lower({_trim(n)}) IN {_in(fixed.PLACEHOLDERS)} THEN 1 ELSE 0 END" for n in NAMES)
    + ") FROM headed)"
)


def _outliers(source: str, columns: dict[str, str]) -> str:
    """Sum over columns of the values outside 1.5 interquartile ranges."""
    parts = [
        f"(SELECT COUNT(*) FROM {source}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS z "
        f"FROM {source}) WHERE z > a AND ({c} < a - 1.5 * (z - a) OR {c} > z + 1.5 * (z - a)))"
        for c in columns
    ]
    return " + ".join(parts)


def _audit(column: str, operation: str, rationale: str, count: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", '{operation}' AS operation, {rationale} AS rationale, "
        f"CAST({count} AS BIGINT) AS affected_rows"
    )


def _audit_sql() -> str:
    rows = [_audit("all_headers", DONE["headers"], f"'{len(NAMES)} headers to snake case'", "0")]
    for n in NAMES:
        rows.append(
            _audit(n, DONE["placeholders"], "'white space and placeholder texts'",
                   f"(SELECT COUNT(*) FROM headed WHERE {n} IS DISTINCT FROM ({_null_placeholder(n)}))")
        )
    for n in ["order_id", "transaction_id"]:
        rows.append(
            _audit(n, DONE["id_suffix"], "'trailing .0 of numeric ids'",
                   f"(SELECT COUNT(*) FROM headed WHERE ({_null_placeholder(n)}) IS DISTINCT FROM "
                   f"{_no_zeros(_null_placeholder(n))})")
        )
    rows.append(_audit("all_rows", DONE["empty_rows"], "'rows without any value'",
                       "(SELECT COUNT(*) FROM headed) - (SELECT COUNT(*) FROM filled)"))
    rows.append(_audit("entire_record", DONE["duplicates"], "'identical rows'",
                       "(SELECT COUNT(*) FROM filled) - (SELECT COUNT(*) FROM uniq)"))
    rows.append(_audit("transaction_id", DONE["key_duplicates"], "'rows sharing a key, first kept'",
                       "(SELECT COUNT(*) FROM uniq) - (SELECT COUNT(*) FROM keyed)"))
    for c in SETS:
        rows.append(_audit(c, DONE["categories"], "'aliases, closest label or title case'",
                           f"(SELECT COUNT(*) FROM repaired WHERE raw_{c} IS DISTINCT FROM {c})"))
    rows.append(_audit("order_date", DONE["dates"], "'many layouts to ISO dates'",
                       "(SELECT COUNT(*) FROM repaired WHERE raw_order_date IS DISTINCT FROM "
                       "strftime(order_date, '%Y-%m-%d'))"))
    words = {
        "quantity": (DONE["quantity"], "absolute value, at least 1"),
        "unit_price": (DONE["price"], "currency signs and negative signs removed"),
        "discount": (DONE["discount"], "share between 0 and 0.99"),
        "total_sales": (DONE["sales"], "quantity * price * (1 - discount)"),
        "customer_satisfaction": (DONE["rating"], "limited to the rating scale"),
    }
    for c, (operation, why) in words.items():
        rows.append(_audit(c, operation, f"'{why}'",
                           f"(SELECT COUNT(*) FROM repaired WHERE raw_{c} IS DISTINCT FROM {c})"))
    for c in SETS:
        rows.append(_audit(c, DONE["mode"],
                           f"'most frequent value ''' || {_mode(c, 'repaired')} || ''''",
                           f"(SELECT COUNT(*) FROM repaired WHERE {c} IS NULL)"))
    rows.append(_audit("order_date", DONE["forward_fill"], "'last value before'",
                       "(SELECT COUNT(*) FROM repaired WHERE order_date IS NULL)"))
    steps = " UNION ALL ".join(rows)
    return (
        f"SELECT * FROM ({steps}) WHERE affected_rows > 0 OR operation IN "
        f"('{DONE['headers']}', '{DONE['categories']}', '{DONE['dates']}')"
    )


BEFORE_AFTER = f"""SELECT b.*, 
  CAST(ROUND(GREATEST(0, CAST(before_nulls - after_nulls AS DOUBLE) / GREATEST(before_nulls, 1) * 100), 1) AS DOUBLE)
    AS null_improvement_pct,
  CASE WHEN before_duplicates > 0 THEN
    ROUND(CAST((SELECT COUNT(*) FROM filled) - (SELECT COUNT(*) FROM keyed) AS DOUBLE) / before_duplicates * 100, 1)
    ELSE 100.0 END AS duplicate_improvement_pct
FROM (SELECT (SELECT COUNT(*) FROM headed) AS before_rows, (SELECT COUNT(*) FROM cleaned) AS after_rows,
  CAST({len(NAMES)} AS BIGINT) AS before_cols, CAST({len(NAMES)} AS BIGINT) AS after_cols,
  CAST({_PLACEHOLDER_CELLS} AS BIGINT) AS before_nulls,
  CAST((SELECT SUM({' + '.join(f'CASE WHEN {n} IS NULL THEN 1 ELSE 0 END' for n in NAMES)}) FROM cleaned) AS BIGINT)
    AS after_nulls,
  {_RAW_DUPLICATES} AS before_duplicates,
  (SELECT COUNT(*) FROM cleaned) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM cleaned)) AS after_duplicates,
  {_outliers('repaired', {'raw_' + c: c for c in _BUSINESS})} AS before_outliers,
  {_outliers('cleaned', {c: c for c in _BUSINESS})} AS after_outliers) AS b"""

_HELD = " + ".join(f"COUNT(raw_{c})" for c in SETS)
_MOVED = " + ".join(f"COUNT(CASE WHEN raw_{c} IS DISTINCT FROM {c} THEN 1 END)" for c in SETS)
_CHECKED = ["quantity", "unit_price", "total_sales", "customer_satisfaction"]
_CELLS = " + ".join(f"(SELECT COUNT({c}) FROM keyed)" for c in _CHECKED)
_WRONG = " + ".join(
    f"COUNT(CASE WHEN raw_{c} IS NOT NULL AND raw_{c} IS DISTINCT FROM {c} THEN 1 END)" for c in _CHECKED
)
SCORECARD = f"""SELECT {rounded('0.35 * completeness + 0.25 * type_validity + 0.20 * uniqueness + 0.10 * consistency + 0.10 * accuracy', 1)}
    AS overall_score, {', '.join(f'{rounded(c, 1)} AS {c}' for c in ['completeness', 'type_validity', 'uniqueness', 'consistency', 'accuracy'])},
  total_nulls_imputed, total_rows_cleaned
FROM (SELECT (1 - CAST({_PLACEHOLDER_CELLS} AS DOUBLE) / ((SELECT COUNT(*) FROM headed) * {len(NAMES)})) * 100 AS completeness,
  100.0::DOUBLE AS type_validity,
  (1 - CAST((SELECT COUNT(*) FROM filled) - (SELECT COUNT(*) FROM keyed) AS DOUBLE) / (SELECT COUNT(*) FROM headed)) * 100
    AS uniqueness,
  (1 - CAST(({_MOVED}) AS DOUBLE) / ({_HELD})) * 100 AS consistency,
  (1 - CAST(({_WRONG}) AS DOUBLE) / ({_CELLS})) * 100 AS accuracy,
  {' + '.join(f'COUNT(*) - COUNT({c})' for c in NAMES)} AS total_nulls_imputed, COUNT(*) AS total_rows_cleaned
  FROM repaired) AS s"""


def _recommendations_sql() -> str:
    rows = []
    for c in _BUSINESS:
        rows.append(
            f"SELECT '{c}' AS column_name, 'outliers' AS issue, 'medium' AS severity, "
            f"{_outliers('cleaned', {c: c})} AS affected_rows, 'Cap or inspect extreme entries' AS recommended_action"
        )
    for c in NAMES:
        action = "Impute with column median" if c in _BUSINESS else (
            "Impute with mode or ''Unknown''" if c in SETS else "Forward fill or flag as missing")
        rows.append(
            f"SELECT '{c}', 'missing', CASE WHEN ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) > 10 THEN 'high' "
            f"ELSE 'medium' END, COUNT(*) - COUNT({c}), '{action}' FROM cleaned"
        )
    for c in SETS:
        rows.append(
            f"SELECT '{c}', 'high_cardinality', 'low', CASE WHEN COUNT(DISTINCT {c}) BETWEEN 31 AND 49 THEN COUNT(*) "
            f"ELSE 0 END, 'Group rare categories into ''Other''' FROM cleaned"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE affected_rows > 0"


ORACLES = {
    "normalize_headers": sql(*BASE, query="SELECT * FROM headed"),
    "trim_null_placeholders": sql(
        *BASE, query="SELECT " + ", ".join(f"{_null_placeholder(n)} AS {n}" for n in NAMES) + " FROM headed"
    ),
    "strip_id_suffix": sql(
        *BASE,
        query=f"SELECT {_no_zeros('order_id')} AS order_id, {_no_zeros('transaction_id')} AS transaction_id FROM headed",
    ),
    "drop_empty_rows": sql(
        *BASE, query="SELECT * FROM headed WHERE COALESCE(" + ", ".join(NAMES) + ") IS NOT NULL"
    ),
    "dedupe_exact": sql(*BASE, query="SELECT DISTINCT * FROM headed"),
    "dedupe_key": sql(
        *TRIMMED,
        query="SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in NAMES[1:])
        + ") AS rn FROM trimmed) WHERE rn = 1",
    ),
    "alias_standardize": sql(
        *TRIMMED,
        query="SELECT transaction_id, " + ", ".join(f"COALESCE({_alias_case(c)}, {c}) AS {c}" for c in SETS) + " FROM trimmed",
    ),
    "fuzzy_standardize": with_sql(
        [*TRIMMED, *_lcs("trimmed")],
        "SELECT transaction_id, " + ", ".join(f"{_fuzzy(c)} AS {c}" for c in SETS) + " FROM trimmed",
    ),
    "title_case_fallback": sql(
        *TRIMMED, query="SELECT transaction_id, " + ", ".join(f"{_title(c)} AS {c}" for c in SETS) + " FROM trimmed"
    ),
    "parse_dates_multi": sql(
        *TRIMMED, query=f"SELECT transaction_id, strftime({DATE}, '%Y-%m-%d') AS order_date FROM trimmed"
    ),
    "clean_quantity": sql(*TRIMMED, query=f"SELECT transaction_id, {QUANTITY} AS quantity FROM trimmed"),
    "clean_price": sql(*TRIMMED, query=f"SELECT transaction_id, {PRICE} AS unit_price FROM trimmed"),
    "clean_discount": sql(*TRIMMED, query=f"SELECT transaction_id, {DISCOUNT} AS discount FROM trimmed"),
    "clean_rating": sql(
        *TRIMMED, query=f"SELECT transaction_id, {_rating('trimmed')} AS customer_satisfaction FROM trimmed"
    ),
    "cast_id_int": sql(
        *TRIMMED, query="SELECT transaction_id, TRY_CAST(order_id AS BIGINT) AS order_id FROM trimmed"
    ),
    "infer_numeric_columns": sql(
        *TRIMMED,
        query=f"SELECT transaction_id, region, {_number('unit_price')} AS unit_price, {_number('discount')} AS discount, "
        f"{_number('total_sales')} AS total_sales FROM trimmed",
    ),
    "parse_dates_keep_time": """SELECT event_id, strftime(CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts)
  ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS event_time FROM events""",
    "recompute_sales_bad_rows": sql(
        *MATERIALIZED,
        f"parts AS MATERIALIZED (SELECT transaction_id, {QUANTITY} AS quantity, {PRICE} AS unit_price, {DISCOUNT} AS discount, "
        f"{_number('total_sales')} AS total_sales FROM trimmed)",
        query=f"""SELECT transaction_id, quantity, unit_price, discount,
CASE WHEN ABS(total_sales - {FORMULA}) > 5 OR total_sales > 100000 THEN {FORMULA} ELSE total_sales END AS total_sales FROM parts""",
    ),
    "recompute_sales": sql(
        *MATERIALIZED,
        f"parts AS MATERIALIZED (SELECT transaction_id, {QUANTITY} AS quantity, {PRICE} AS unit_price, {DISCOUNT} AS discount, "
        f"{_number('total_sales')} AS total_sales FROM trimmed)",
        query=f"""SELECT transaction_id, quantity, unit_price, discount,
CASE WHEN (SELECT bool_or(ABS(total_sales - {FORMULA}) > 5 OR total_sales > 100000) FROM parts) THEN {FORMULA}
ELSE total_sales END AS total_sales FROM parts""",
    ),
    "impute_median": sql(
        *TRIMMED,
        f"""both_tables AS (SELECT transaction_id, {_number('quantity')} AS quantity FROM trimmed
UNION ALL SELECT concat_ws('-', order_id, line_no, part_id, supplier_id),
  CASE WHEN quantity > 45 THEN NULL ELSE total_sales END FROM sales)""",
        query="SELECT transaction_id, COALESCE(quantity, (SELECT quantile_cont(quantity, 0.5) FROM both_tables)) "
        "AS quantity FROM both_tables",
    ),
    "impute_mode": sql(
        *MATERIALIZED,
        query="SELECT transaction_id, "
        + ", ".join(f"COALESCE({c}, {_mode(c, 'trimmed')}) AS {c}" for c in SETS) + " FROM trimmed",
    ),
    "forward_fill": """SELECT event_id, user_id, strftime(last_value(day IGNORE NULLS) OVER (ORDER BY event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '%Y-%m-%d') AS day
FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS day FROM events)""",
    "clean_pipeline": with_sql(
        CLEANED, "SELECT * REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date) FROM cleaned"
    ),
    "audit_trail": with_sql(PIPELINE, _audit_sql()),
    "before_after": with_sql(CLEANED, BEFORE_AFTER),
    "quality_scorecard": with_sql(PIPELINE, SCORECARD),
    "quality_recommendations": with_sql(CLEANED, _recommendations_sql()),
}
