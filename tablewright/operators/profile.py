"""Column profiles: every column in one pass, one result row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, roles
from ..functions.expr import half_up, hashed, is_placeholder
from ..session import materialize, parts_of, released
from .quantiles import exact_quantiles

COLUMNS_PER_PASS = 200
#: columns of a large table whose different values are counted at a time
COLUMNS_AT_ONCE = 4
CATEGORY_LIMIT = 50
#: characters of a text that are a key as they are; longer texts are counted by these and 128 bits
HEAD = 64


def _rows_from_wide(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """Aggregate all columns in one job, then turn the wide row into one row per column."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = columns[start : start + COLUMNS_PER_PASS]
        cells = [
            F.struct(F.lit(c).alias("column_name"), *[m(c).alias(n) for n, m in measures.items()]) for c in chunk
        ]
        parts.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cell(c: str) -> Column:
    return F.col(f"`{c}`")


def _static(columns: list[str], values: dict[str, object], kind: str) -> Column:
    """A per-column constant, looked up by the column name."""
    entries = [F.lit(x) for c in columns for x in (c, values[c])]
    return F.try_element_at(F.create_map(*entries), F.col("column_name")).cast(kind)


def inspect_columns(
    df: DataFrame, approx_distinct: bool = True, samples: int = 5, order_by: list[str] | None = None
) -> DataFrame:
    """Type, nulls, approximate distinct count and sample values per column, with table size.

    The samples are the first rows in ``order_by``; without it any rows.
    """
    columns = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    measures = {
        "row_count": lambda c: F.count("*"),
        "null_count": lambda c: F.count("*") - F.count(_cell(c)),
    }
    if approx_distinct:
        measures["unique_count"] = lambda c: F.approx_count_distinct(_cell(c))
    head = (df.orderBy(*order_by) if order_by else df).limit(samples).collect()
    shown = {c: ", ".join("null" if r[c] is None else str(r[c]) for r in head) for c in columns}
    return _rows_from_wide(df, columns, measures).select(
        "column_name",
        _static(columns, types, "string").alias("inferred_type"),
        _static(columns, shown, "string").alias("sample_values"),
        "row_count",
        F.lit(len(columns)).cast("bigint").alias("column_count"),
        "null_count",
        *(["unique_count"] if approx_distinct else []),
    )


def inspect_view(
    spark: SparkSession, view: str, approx_distinct: bool = True, order_by: list[str] | None = None
) -> DataFrame:
    return inspect_columns(spark.table(view), approx_distinct, order_by=order_by)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, unique_count) of every column; null counts as one value.

    One narrow shuffle of (column, 128 bits of the value), whatever the length of a text. Many
    ``count_distinct`` in one aggregate would shuffle every column once per column. Of a large table a few
    columns are counted at a time, and their shuffle files go before the next.
    """
    columns = columns or df.columns
    if len(columns) <= COLUMNS_AT_ONCE or parts_of(df) == 1:
        return _distinct_counts(df, columns)
    found = []
    with released(df.sparkSession):
        for start in range(0, len(columns), COLUMNS_AT_ONCE):
            found += _distinct_counts(df, columns[start : start + COLUMNS_AT_ONCE]).collect()
    return df.sparkSession.createDataFrame([tuple(r) for r in found], "column_name string, unique_count bigint")


def _distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (i, c)])
    cells = F.array(
        *[F.struct(F.lit(i).alias("position"), *hashed([(_cell(c), kinds[c])])) for i, c in enumerate(columns)]
    )
    seen = df.select(F.inline(cells)).distinct().groupBy("position").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("position"))
    return every.join(seen, "position", "left").select(
        names[F.col("position")].alias("column_name"), F.coalesce("n", F.lit(0)).alias("unique_count")
    )


def _with_distinct(rows: DataFrame, df: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(distinct_counts(df)), "column_name")  # one row per column


def profile_light(df: DataFrame) -> DataFrame:
    """Null share, exact distinct count, type class and the range of date columns."""
    columns = df.columns
    dates = set(roles.date_columns(df))
    by = {f.name: f.dataType for f in df.schema}

    def edge(f):
        return lambda c: f(_cell(c)).cast("string") if c in dates else F.lit(None).cast("string")

    rows = _rows_from_wide(
        df,
        columns,
        {
            "total_rows": lambda c: F.count("*"),
            "null_pct": lambda c: F.coalesce(
                half_up(F.try_divide((F.count("*") - F.count(_cell(c))) * 100.0, F.count("*")), 2), F.lit(0.0)
            ),
            "min_val": edge(F.min),
            "max_val": edge(F.max),
        },
    )
    flags = {
        "is_numeric": {c: int(roles.is_numeric(by[c])) for c in columns},
        "is_temporal": {c: int(c in dates) for c in columns},
        "is_categorical": {c: int(isinstance(by[c], T.StringType)) for c in columns},
    }
    return _with_distinct(rows, df).select(
        "column_name",
        _static(columns, {c: by[c].simpleString() for c in columns}, "string").alias("dtype"),
        "total_rows", F.col("unique_count").alias("cardinality"), "null_pct",
        *[_static(columns, v, "int").alias(n) for n, v in flags.items()],
        "min_val", "max_val",
    )


def _type_role(f: T.StructField) -> str:
    name = f.name.lower()
    if roles.is_id(name) and (roles.has_token(name, "order", "customer", "transaction") or name == "id"):
        return "identifier"
    if roles.is_date(f.dataType):
        return "date"
    if roles.is_numeric(f.dataType):
        return "numerical"
    if isinstance(f.dataType, T.BooleanType):
        return "boolean"
    return "text" if isinstance(f.dataType, T.StringType) else "categorical"


def _with_role(rows: DataFrame, df: DataFrame) -> DataFrame:
    known = _static(df.columns, {f.name: _type_role(f) for f in df.schema}, "string")
    few = (known == "text") & (F.col("unique_count") < CATEGORY_LIMIT)
    return rows.withColumn("role", F.when(few, "categorical").otherwise(known))


def profile_role(df: DataFrame) -> DataFrame:
    """Identifier, date, numerical, boolean, categorical (under 50 values) or text."""
    rows = distinct_counts(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return _with_role(rows, df).select(
        "column_name", _static(df.columns, types, "string").alias("data_type"), "unique_count", "role"
    )


def text_sizes(df: DataFrame, columns: list[str]) -> tuple[int, list[str]]:
    """Number of rows, and the columns with a text longer than ``HEAD``."""
    longer = [F.max(F.length(_cell(c).cast("string")) > HEAD).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count("*").alias("rows"), *longer).first()
    return row["rows"], [c for i, c in enumerate(columns) if row[f"c{i}"]]


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, text, head, a, b): the first characters, and 128 bits of texts longer than these."""
    long = df.select(*[_cell(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "text")
    text = F.col("text")
    return long.select(
        "column_name", "text", F.substring(text, 1, HEAD).alias("head"),
        *[F.when(F.length(text) > HEAD, F.xxhash64(F.lit(seed), text)).alias(name) for seed, name in ((1, "a"), (2, "b"))],
    )


def value_counts(df: DataFrame, columns: list[str], keep_null: bool = True) -> DataFrame:
    """(column_name, head, a, b, n) of every value; null is a value of its own unless dropped.

    A key is as long as ``HEAD`` allows and no longer, so whole texts are not shuffled.
    """
    long = _texts(df, columns)
    long = long if keep_null else long.where(F.col("text").isNotNull())
    return long.groupBy("column_name", "head", "a", "b").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, counts: DataFrame, k: int, wide: list[str]) -> DataFrame:
    """(column_name, value, n, place): the k most frequent values per column, ties by value with null last.

    ``counts`` are those of ``df``, and ``wide`` its columns with texts beyond ``HEAD``. Whole texts are
    read for the values that can be among the first k only. The limits on the ranks are applied before
    the shuffle as well (group limit).
    """
    by_column = Window.partitionBy("column_name")
    if wide:
        near = F.rank().over(by_column.orderBy(F.desc("n"), F.col("head").asc_nulls_last()))
        counts, _ = materialize(counts.withColumn("near", near).where(F.col("near") <= k).drop("near"), "near")
        wanted = counts.where("a IS NOT NULL").select("column_name", "a", "b")
        found = _texts(df, wide).where("a IS NOT NULL").join(wanted, ["column_name", "a", "b"])
        texts = found.groupBy("column_name", "a", "b").agg(F.any_value("text").alias("text"))
        counts = counts.join(texts, ["column_name", "a", "b"], "left")
        value = F.coalesce("text", "head")
    else:
        value = F.col("head")
    valued = counts.select("column_name", value.alias("value"), "n")
    place = F.row_number().over(by_column.orderBy(F.desc("n"), F.col("value").asc_nulls_last()))
    return valued.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)


def profile_top_categories(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    columns = columns or roles.dimension_columns(df)
    rows, wide = text_sizes(df, columns)
    return top_values(df, value_counts(df, columns), k, wide).select(
        "column_name", "place", F.coalesce("value", F.lit("null")).alias("category"), F.col("n").alias("count"),
        half_up(F.col("n") * 100.0 / F.lit(float(max(rows, 1))), 1).alias("percentage"),
    )


def tukey_bounds(
    df: DataFrame, columns: list[str]
) -> dict[str, tuple[float, float, float, float] | None]:
    """(q25, q75, lower, upper) per column; None where the quartiles coincide or are missing."""
    from .quantiles import column_quantiles

    found = column_quantiles(df, columns, [0.25, 0.75])
    out: dict[str, tuple[float, float, float, float] | None] = {}
    for c in columns:
        q = found.get(c)
        spread = q[1] - q[0] if q else 0.0
        out[c] = (q[0], q[1], q[0] - 1.5 * spread, q[1] + 1.5 * spread) if spread > 0 else None
    return out


def outlier_count(c: str, bounds: tuple[float, float, float, float] | None) -> Column:
    if bounds is None:
        return F.lit(0).cast("bigint")
    return F.count_if((_cell(c) < bounds[2]) | (_cell(c) > bounds[3]))


def profile_outlier_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values outside 1.5 interquartile ranges, where the range is positive."""
    columns = columns or roles.measure_columns(df)
    bounds = tukey_bounds(df, columns)
    return _rows_from_wide(
        df,
        columns,
        {
            "lower_bound": lambda c: F.lit(bounds[c][2] if bounds[c] else None).cast("double"),
            "upper_bound": lambda c: F.lit(bounds[c][3] if bounds[c] else None).cast("double"),
            "outlier_count": lambda c: outlier_count(c, bounds[c]),
        },
    )


def profile_full(df: DataFrame) -> DataFrame:
    """Missing, unique and duplicate shares for every column; moments, quartile-based outliers
    and median for numbers; range for dates; most frequent value for texts."""
    numbers = [f.name for f in df.schema if _type_role(f) == "numerical"]
    dates = set(roles.date_columns(df))
    texts = roles.string_columns(df)
    rows_total, wide_texts = text_sizes(df, texts)
    from .quantiles import column_quantiles

    quartiles = column_quantiles(df, numbers, [0.25, 0.5, 0.75])
    bounds, medians = {}, {}
    for c in numbers:
        q = quartiles[c]
        spread = q[2] - q[0] if q else 0.0
        bounds[c] = (q[0], q[2], q[0] - 1.5 * spread, q[2] + 1.5 * spread) if spread > 0 else None
        medians[c] = q[1] if q else None
    number = set(numbers)

    def numeric(f):
        return lambda c: half_up(f(_cell(c)).cast("double"), 2) if c in number else F.lit(None).cast("double")

    def dated(f):
        return lambda c: f(_cell(c)).cast("string") if c in dates else F.lit(None).cast("string")

    wide = _rows_from_wide(
        df,
        df.columns,
        {
            "non_null_count": lambda c: F.count(_cell(c)),
            "missing_count": lambda c: F.count("*") - F.count(_cell(c)),
            "min_val": numeric(F.min),
            "max_val": numeric(F.max),
            "mean_val": numeric(F.avg),
            "std_val": lambda c: F.when(
                F.count(_cell(c)) > 0, F.coalesce(half_up(F.stddev_samp(_cell(c)), 2), F.lit(0.0))
            ) if c in number else F.lit(None).cast("double"),
            "median_val": lambda c: half_up(F.lit(medians.get(c)).cast("double"), 2),
            "min_date": dated(F.min),
            "max_date": dated(F.max),
            "outlier_count": lambda c: outlier_count(c, bounds.get(c)),
        },
    )
    total = F.lit(float(max(rows_total, 1)))
    out = _with_role(_with_distinct(wide, df), df).select(
        "*",
        half_up(F.col("missing_count") * 100.0 / total, 2).alias("missing_pct"),
        F.when(
            F.col("unique_count") > 0, half_up((F.lit(rows_total) - F.col("unique_count")) * 100.0 / total, 1)
        ).otherwise(0.0).alias("duplicate_pct"),
    )
    if not texts:
        return out.withColumn("mode_val", F.lit(None).cast("string"))
    mode = top_values(df, value_counts(df, texts), 1, wide_texts).select(
        "column_name", F.coalesce("value", F.lit("null")).alias("mode_val")
    )
    joined = out.join(F.broadcast(mode), "column_name", "left")  # one row per text column
    return joined.withColumn("mode_val", F.when(F.col("role").isin("categorical", "text"), F.col("mode_val")))


def placeholder_cells(df: DataFrame) -> Column:
    """Aggregate: null or placeholder cells over all columns."""
    per_row = [is_placeholder(_cell(c)).cast("bigint") for c in df.columns]
    total = per_row[0]
    for p in per_row[1:]:
        total = total + p
    return F.coalesce(F.sum(total), F.lit(0))


def placeholder_cell_count(df: DataFrame) -> DataFrame:
    return df.agg(
        placeholder_cells(df).alias("placeholder_cells"),
        (F.count("*") * len(df.columns)).alias("total_cells"),
    )


def null_cells(df: DataFrame) -> Column:
    total = _cell(df.columns[0]).isNull().cast("bigint")
    for c in df.columns[1:]:
        total = total + _cell(c).isNull().cast("bigint")
    return F.coalesce(F.sum(total), F.lit(0))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows: one grouped count over 128 bits of each row."""
    keys = df.select(*hashed([(_cell(c), kind) for c, kind in df.dtypes]))
    groups = keys.groupBy("a", "b").agg(F.count("*").alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def quality_recommendations(profile: DataFrame, rows: int) -> DataFrame:
    """Issues found in the rows of ``profile_full``: missing values, outliers, many categories."""
    role, missing = F.col("role"), F.col("missing_count")
    advice = F.when(role == "numerical", "Impute with column median").when(
        role == "categorical", "Impute with mode or 'Unknown'"
    ).otherwise("Forward fill or flag as missing")

    def item(issue: str, severity: Column, affected: Column, action: Column) -> Column:
        return F.struct(
            F.lit(issue).alias("issue"), severity.alias("severity"),
            affected.cast("bigint").alias("affected_rows"), action.alias("recommended_action"),
        )

    items = F.array(
        F.when(
            missing > 0,
            item("missing", F.when(F.col("missing_pct") > 10, "high").otherwise("medium"), missing, advice),
        ),
        F.when(
            F.col("outlier_count") > 0,
            item("outliers", F.lit("medium"), F.col("outlier_count"), F.lit("Cap or inspect extreme entries")),
        ),
        F.when(
            (role == "categorical") & (F.col("unique_count") > 30),
            item("high_cardinality", F.lit("low"), F.lit(rows), F.lit("Group rare categories into 'Other'")),
        ),
    )
    return profile.select("column_name", F.inline(F.filter(items, lambda x: x.isNotNull())))


def scorecard(
    completeness: float, type_validity: float, uniqueness: float, consistency: float, accuracy: float
) -> dict[str, float]:
    """Weighted score of five percentages, each limited to 0..100."""
    parts = {
        "completeness": completeness,
        "type_validity": type_validity,
        "uniqueness": uniqueness,
        "consistency": consistency,
        "accuracy": accuracy,
    }
    parts = {k: max(0.0, min(100.0, v)) for k, v in parts.items()}
    return {"overall_score": sum(fixed.SCORE_WEIGHTS[k] * v for k, v in parts.items()), **parts}


def grouped_quantiles(df: DataFrame, by: str, value: str, probs: list[float]) -> DataFrame:
    return exact_quantiles(df, value, probs, [by])
