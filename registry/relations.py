"""Joins by similarity and time, sessions, groupings and differences of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import clean, labels, states, tablesets, timejoins
from tablewright.session import materialize_all, scratch_path
from tablewright.streaming.windows import append, deduplicated, windowed

from .cleaning import BASE, NAMES, _null_placeholder, _title, _trim, with_sql
from .inputs import SALES_CTE, dirty_parts, money_sum, query, sales, sql, table

MISSPELT = {
    # a letter is left out, doubled or added, by the key of the part
    "spark": """SELECT p_partkey, CASE p_partkey % 4
  WHEN 0 THEN concat(substr(p_name, 1, CAST(p_partkey % length(p_name) AS INT)), substr(p_name, CAST(p_partkey % length(p_name) AS INT) + 2))
  WHEN 1 THEN concat(p_name, substr(p_name, length(p_name), 1)) WHEN 2 THEN concat(upper(p_name), ' x')
  ELSE concat(substr(p_name, 4), ' ', p_brand) END AS name FROM {part}""",
    "duckdb": """SELECT p_partkey, CASE p_partkey % 4
  WHEN 0 THEN concat(substr(p_name, 1, p_partkey % length(p_name)), substr(p_name, p_partkey % length(p_name) + 2))
  WHEN 1 THEN concat(p_name, substr(p_name, length(p_name), 1)) WHEN 2 THEN concat(upper(p_name), ' x')
  ELSE concat(substr(p_name, 4), ' ', p_brand) END AS name FROM part""",
}


def _misspelt(s, d):
    return s.sql(MISSPELT["spark"], part=table(s, d, "part"))


def _names(s, d):
    return table(s, d, "part").select("p_name").distinct()


def names(s, d):
    return clean.fuzzy_standardize(_misspelt(s, d), "name", cutoff=fixed.FUZZY_CUTOFF, labels=_names(s, d), aliases={})


def name_scores(s, d):
    return labels.closest_labels(_misspelt(s, d).select("name"), _names(s, d), fixed.FUZZY_CUTOFF)


_SORTED = "array_to_string(list_sort(string_split(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), ' ')), ' ')"
CLOSEST = [
    f"misspelt AS MATERIALIZED ({MISSPELT['duckdb']})",
    f"pairs AS MATERIALIZED (SELECT v, label, {_SORTED.format('v')} AS a, {_SORTED.format('label')} AS b "
    "FROM (SELECT DISTINCT name AS v FROM misspelt), (SELECT DISTINCT p_name AS label FROM part))",
    "texts AS (SELECT DISTINCT a, b FROM pairs)",
    """lcs AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS best FROM texts
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: CAST(list_max(cand[1:j]) AS INTEGER))
  FROM (SELECT *, list_prepend(0, list_transform(range(1, length(b) + 1), lambda j: greatest(best[j + 1], best[j]
      + CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS BIGINT), 1) THEN 1 ELSE 0 END))) AS cand
    FROM lcs WHERE i < length(a)) AS step)""",
    f"""closest AS MATERIALIZED (SELECT v, label, score FROM (SELECT v, label, 200.0 * best[length(b) + 1] / (length(a) + length(b)) AS score,
  ROW_NUMBER() OVER (PARTITION BY v ORDER BY 200.0 * best[length(b) + 1] / (length(a) + length(b)) DESC, label) AS rn
  FROM pairs JOIN lcs USING (a, b) WHERE i = length(a)) WHERE rn = 1 AND score >= {fixed.FUZZY_CUTOFF})""",
]



def _shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def last_view(s, d):
    """Every event of a user with the user's last click up to then; user 0 has a third of the rows."""
    events = table(s, d, "events")
    user = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("long")
    rows = events.select("event_id", user.alias("user_id"), "ts", "event_type")
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    found = timejoins.asof_join(rows.where("event_type <> 'click'"), clicks, ["user_id"], "ts", "click_ts")
    return found.select("event_id", "user_id", "click_id", _shown("click_ts"))


def last_order(s, d):
    events = table(s, d, "events").select("event_id", F.col("user_id").alias("customer_id"), "ts")
    orders = table(s, d, "orders").select(
        F.col("o_custkey").alias("customer_id"), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    found = timejoins.asof_join(events, orders, ["customer_id"], "ts", "o_orderdate", prefix="last_")
    return found.select("event_id", "customer_id", "last_o_orderkey", "last_o_totalprice")


def open_orders(s, d):
    """Orders that a customer places while another one is under way (order date to the last shipping)."""
    orders = table(s, d, "orders")
    shipped = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    spans = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("open_order"), F.col("o_orderdate").alias("opened"), "shipped"
    )
    points = orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"), "o_orderdate")
    met = timejoins.interval_join(points, spans, "o_orderdate", "opened", "shipped", ["customer_id"])
    return met.where("order_id <> open_order").select("customer_id", "order_id", "open_order")


def after_errors(s, d):
    """Events of any user in the ten minutes from an error."""
    events = table(s, d, "events")
    spans = events.where("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("to_ts")
    )
    met = timejoins.interval_join(events.select("event_id", "ts"), spans, "ts", "from_ts", "to_ts", full=50)
    return met.where("event_id <> error_id").select("error_id", "event_id")


def user_sessions(s, d):
    events = table(s, d, "events")
    user = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("long")
    found = timejoins.sessions(events.select(user.alias("user_id"), "ts"), "user_id", "ts", 1800)
    return found.select("user_id", _shown("session_start"), _shown("session_end"), "n_rows")


def _stream(s, d, name="events"):
    # a stream reads folders; a pattern also takes a table that is one file
    stream = s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(s, df, name):
    """What a stream appends until its input is read."""
    out, checkpoint = scratch_path(s, name), scratch_path(s, f"{name}-checkpoint")
    append(df, out, checkpoint).awaitTermination()
    return s.read.schema(df.schema).parquet(out)


def _counts():
    return [F.count("*").alias("n_events"), F.sum(F.col("value").cast("decimal(28,10)")).cast("double").alias("total")]


def _windows(s, d, slide):
    found = windowed(_stream(s, d), "ts", ["event_type"], _counts(), "1 hour", slide, "2 hours")
    return _finished(s, found, "windows").select(_shown("window_start"), _shown("window_end"), "event_type", "n_events", "total")


def stream_once(s, d):
    """Every event is delivered again by a second path; its id is remembered for two days."""
    twice = _stream(s, d).unionByName(_stream(s, d).where("event_id % 3 <> 1")).select("event_id", "ts", "user_id", "event_type")
    return _finished(s, deduplicated(twice, ["event_id"], "ts", "2 days"), "once").select("event_id", "user_id", "event_type", _shown("ts"))


MEASURES = ["value", "user_id"]


def _states(s, d):
    day = F.to_date("ts").alias("day")
    events = table(s, d, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return states.column_states(events, MEASURES, [day], {"user_id": 50.0})


def merged_states(s, d):
    found = states.profiles(states.merged(_states(s, d)))
    return found.select("column_name", "n_rows", "n_known", "missing_pct", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                        "least", "largest")


def merged_sketches(s, d):
    found = states.profiles(states.merged(_states(s, d)), [0.25, 0.5, 0.75])
    return found.select("column_name", "distinct_estimate", "p25", "p50", "p75")


def _totals():
    return [F.count("*").alias("n_lines"), F.sum(F.col("total_sales").cast("decimal(28,10)")).cast("double").alias("revenue")]


def _dims(s, d):
    # a category that is missing in places, to tell totals from missing values
    gap = F.when(F.col("line_no") != 3, F.col("category"))
    return sales(s, d).select("region", gap.alias("category"), "order_status", "total_sales")


def before_after_rows(s, d):
    raw, _ = materialize_all([clean.normalize_headers(p) for p in dirty_parts(s, d)], "raw")  # both sides read it
    return tablesets.multiset_difference(raw, clean.dedupe_exact(clean.trim_null_placeholders(raw)))


def above_mean(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    hot = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).cast("long")
    found = tablesets.above_group_mean(orders.withColumn("o_custkey", hot), "o_custkey", "o_totalprice")
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


QUERIES = {
    "asof_join_last_order": query(last_order),
    "asof_join_hot": query(last_view),
    "interval_join_open_orders": query(open_orders),
    "interval_join_full_bins": query(after_errors),
    "sessions_hot": query(user_sessions),
    "grouping_sets": query(lambda s, d: tablesets.grouping_sets(
        _dims(s, d), [["region", "category"], ["order_status"], ["region"]], _totals())),
    "rollup": query(lambda s, d: tablesets.rollup(_dims(s, d), ["region", "category"], _totals())),
    "cube": query(lambda s, d: tablesets.cube(_dims(s, d), ["region", "category", "order_status"], _totals())),
    "multiset_difference": query(before_after_rows),
    "above_group_mean": query(above_mean),
    "stream_tumbling_windows": query(lambda s, d: _windows(s, d, None)),
    "stream_sliding_windows": query(lambda s, d: _windows(s, d, "30 minutes")),
    "stream_deduplicate": query(stream_once),
    "column_states_merged": query(merged_states),
    "column_states_sketches": query(merged_sketches),
    "fuzzy_standardize_names": query(names),
    "label_join": query(name_scores),
}

_HOT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id"
_TOTALS = f"COUNT(*) AS n_lines, {money_sum('total_sales')} AS revenue"
_DIMS = "dims AS (SELECT region, CASE WHEN line_no <> 3 THEN category END AS category, order_status, total_sales FROM sales)"


def _grouped(columns: str, sets: str) -> str:
    return sql(SALES_CTE, _DIMS, query=f"SELECT {columns}, GROUPING({columns}) AS grouping_id, {_TOTALS} FROM dims GROUP BY {sets}")


def _difference() -> str:
    columns, trimmed = ", ".join(NAMES), ", ".join(f"{_null_placeholder(c)} AS {c}" for c in NAMES)
    return sql(
        *BASE, f"cleaned AS (SELECT DISTINCT {trimmed} FROM headed)",
        query=f"""SELECT {columns}, CAST(SUM(b) AS BIGINT) AS n_before, CAST(SUM(a) AS BIGINT) AS n_after
FROM (SELECT {columns}, 1 AS b, 0 AS a FROM headed UNION ALL SELECT {columns}, 0, 1 FROM cleaned) GROUP BY {columns} HAVING SUM(b) <> SUM(a)""",
    )


def _window_sql(offsets: str) -> str:
    shown = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - o * INTERVAL 30 MINUTES AS s, * FROM events, (SELECT unnest({offsets}) AS o)),
fit AS (SELECT * FROM w WHERE {"epoch(s) % 3600 = 0" if offsets == "[0, 1]" else "true"} AND s + INTERVAL 1 HOUR > ts)
SELECT {shown.format("s")} AS window_start, {shown.format("s + INTERVAL 1 HOUR")} AS window_end, event_type, COUNT(*) AS n_events,
  {money_sum("value")} AS total FROM fit
WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', MAX(ts)) - INTERVAL 2 HOURS FROM events) GROUP BY s, event_type"""


ORACLES = {
    "stream_tumbling_windows": _window_sql("[0, 1]"),
    "stream_sliding_windows": _window_sql("[0, 1, 2]"),
    "stream_deduplicate": "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events",
    "column_states_merged": """WITH v AS (SELECT unnest(['value', 'user_id']) AS column_name,
  unnest([CASE WHEN event_id % 7 <> 0 THEN value END, CAST(user_id AS DOUBLE)]) AS x FROM events)
SELECT column_name, COUNT(*) AS n_rows, COUNT(x) AS n_known, ROUND((1 - COUNT(x) / COUNT(*)) * 100, 2) AS missing_pct,
  ROUND(CAST(SUM(CAST(x AS DECIMAL(28,10))) AS DOUBLE) / COUNT(x), 6) AS mean, ROUND(STDDEV_SAMP(x), 6) AS std,
  MIN(x) AS least, MAX(x) AS largest FROM v GROUP BY column_name""",
    "asof_join_last_order": """SELECT event_id, user_id AS customer_id, o_orderkey AS last_o_orderkey, o_totalprice AS last_o_totalprice
FROM events LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY
  ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1
  AND o_orderdate = MAX(o_orderdate) OVER (PARTITION BY o_custkey)) ON o_custkey = user_id
-- all orders are older than all events, which a test checks by ASOF JOIN on other tables""",
    "asof_join_hot": f"""WITH e AS (SELECT event_id, {_HOT}, ts, event_type FROM events)
SELECT l.event_id, l.user_id, r.event_id AS click_id, strftime(r.ts, '%Y-%m-%d %H:%M:%S.%f') AS click_ts
FROM (SELECT * FROM e WHERE event_type <> 'click') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') r
  ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "interval_join_open_orders": """WITH spans AS (SELECT o_custkey, o_orderkey, o_orderdate, MAX(l_shipdate) AS shipped
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT p.o_custkey AS customer_id, p.o_orderkey AS order_id, s.o_orderkey AS open_order FROM orders p JOIN spans s
  ON p.o_custkey = s.o_custkey AND p.o_orderdate BETWEEN s.o_orderdate AND s.shipped AND p.o_orderkey <> s.o_orderkey""",
    "interval_join_full_bins": """SELECT r.event_id AS error_id, e.event_id FROM events e JOIN events r
  ON r.event_type = 'error' AND e.ts >= r.ts AND e.ts <= r.ts + INTERVAL 10 MINUTES AND e.event_id <> r.event_id""",
    "sessions_hot": f"""WITH e AS (SELECT {_HOT}, ts, event_id FROM events),
marked AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS first FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
islands AS (SELECT user_id, ts, SUM(first) OVER (PARTITION BY user_id ORDER BY ts, first DESC ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_end, COUNT(*) AS n_rows FROM islands GROUP BY user_id, island""",
    "grouping_sets": _grouped("region, category, order_status", "GROUPING SETS ((region, category), (order_status), (region))"),
    "rollup": _grouped("region, category", "ROLLUP (region, category)"),
    "cube": _grouped("region, category, order_status", "CUBE (region, category, order_status)"),
    "multiset_difference": _difference(),
    "above_group_mean": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS o_custkey, o_totalprice FROM orders)
SELECT * FROM o WHERE o_totalprice > (SELECT CAST(SUM(CAST(i.o_totalprice AS DECIMAL(28,10))) AS DOUBLE) / COUNT(i.o_totalprice)
  FROM o i WHERE i.o_custkey = o.o_custkey)""",
    "fuzzy_standardize_names": with_sql(
        CLOSEST, f"SELECT p_partkey, COALESCE(label, {_title(_trim('name'))}) AS name FROM misspelt LEFT JOIN closest ON v = name"
    ),
    "label_join": with_sql(CLOSEST, "SELECT v AS value, label, CAST(score AS DOUBLE) AS score FROM closest"),
}
