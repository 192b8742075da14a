"""Cleaning steps. Each takes its columns as arguments and returns a DataFrame.

Row-level steps are projections. Steps that depend on a whole column read one small
aggregate and use its numbers as literals.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr, fixed, fuzzy, roles
from ..session import materialize, materialize_parts
from . import order, profile
from .labels import closest_labels
from .quantiles import column_quantiles


def header_names(columns: list[str]) -> list[str]:
    """Lower snake case without punctuation. The first column of a name keeps it; the others are
    numbered from 2 in their order, past the names that other columns have."""
    bases = ["_".join(re.sub(r"[^\w\s]", "", c).split()).lower() or "column" for c in columns]
    used = set(bases)
    places: dict[str, list[int]] = {}
    for i, base in enumerate(bases):
        places.setdefault(base, []).append(i)
    names = list(bases)
    for base, own in places.items():
        free = (f"{base}_{n}" for n in itertools.count(2))
        for i in own[1:]:
            names[i] = next(name for name in free if name not in used)
            used.add(names[i])
    return names


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*header_names(df.columns))


def _text(df: DataFrame, columns: list[str] | None) -> list[str]:
    texts = roles.string_columns(df)
    return texts if columns is None else [c for c in columns if c in texts]


def _replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns(changes) if changes else df


def trim_null_placeholders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _replace(df, {c: expr.null_placeholder(F.col(c)) for c in _text(df, columns)})


def strip_id_suffix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    chosen = [c for c in roles.string_columns(df) if roles.is_id(c)] if columns is None else _text(df, columns)
    return _replace(df, {c: expr.without_zero_fraction(F.col(c)) for c in chosen})


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Whole-row distinct; copies collapse in the partial aggregation, before the shuffle."""
    return df.dropDuplicates()


def dedupe_key(df: DataFrame, key: list[str], order_by: list[str], keep_null_keys: bool = False) -> DataFrame:
    """The first row per key in the given order; a missing key counts as one key unless kept.

    ``row_number() = 1`` is pushed below the shuffle as a group limit, so a hot key sends
    one row per task. Columns not named in the order break remaining ties.
    """
    rest = [c for c in df.columns if c not in key and c not in order_by]
    first = Window.partitionBy(*key).orderBy(*order_by, *rest)

    def firsts(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")

    if not keep_null_keys:
        return firsts(df)
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    return firsts(df.where(known)).unionByName(df.where(~known))


def _kind(column: str) -> str | None:
    return next((k for k in fixed.CANONICAL if k in column.lower()), None)


def category_columns(df: DataFrame) -> dict[str, str]:
    """Text columns that belong to one of the canonical sets."""
    return {c: k for c in roles.string_columns(df) if (k := _kind(c))}


def _alias(c: Column, aliases: dict[str, list[str]]) -> Column:
    entries = [F.lit(x) for label, spellings in aliases.items() for s in spellings for x in (s, label)]
    if not entries:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*entries), F.lower(expr.trim_all(c)))


def alias_standardize(df: DataFrame, column: str, kind: str | None = None) -> DataFrame:
    """Known spellings to their canonical label; other values stay."""
    aliases = fixed.ALIASES[kind or _kind(column)]
    return df.withColumn(column, F.coalesce(_alias(F.col(column), aliases), F.col(column)))


def title_case_fallback(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: expr.title_case(expr.trim_all(F.col(c))) for c in columns})


def fuzzy_scores(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """(value, label, score) for every distinct value: one Python call per value, not per row."""
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    scored = values.withColumn("__best", fuzzy.best_label(labels)(fuzzy.sorted_tokens(F.col("value"))))
    return scored.select("value", "__best.label", "__best.score")


def fuzzy_standardize(
    df: DataFrame,
    column: str,
    kind: str | None = None,
    cutoff: float = fixed.FUZZY_CUTOFF,
    labels: list[str] | DataFrame | None = None,
    aliases: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Alias, else the closest canonical label at or above the cutoff, else title case.

    ``labels`` may be a table with one column, a registry of any size: values then meet only the labels
    that share a rare gram with them (``labels.closest_labels``), and the first in code point
    order wins a tie.

    Values that an alias settles never reach Python. The others are scored once per
    distinct value and joined back; Spark broadcasts that table only if it is small. Rows
    that need no match get spread keys, so that a merge join has no pile of null keys.
    """
    kind = kind or _kind(column)
    labels = fixed.CANONICAL[kind] if labels is None else labels
    aliases = fixed.ALIASES.get(kind, {}) if aliases is None else aliases
    known = df.withColumn("__alias", _alias(F.col(column), aliases))
    open_value = F.when(F.col("__alias").isNull(), F.col(column))
    open_values = known.select(open_value.alias(column))
    if isinstance(labels, DataFrame):
        scores = open_values.distinct().where(F.col(column).isNotNull()).withColumnRenamed(column, "value").join(
            closest_labels(open_values, labels, cutoff), "value", "left"
        )
    else:
        scores = fuzzy_scores(open_values, column, labels)
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    chosen = scores.select(
        F.col("value").alias("__value"),
        F.when(F.col("score") >= cutoff, F.col("label"))
        .otherwise(expr.title_case(expr.trim_all(F.col("value"))))
        .alias("__chosen"),
    )
    chosen, _ = materialize(chosen, "labels")  # now Spark knows its size before it plans the join
    joined = known.withColumn("__open", F.coalesce(open_value, spread)).join(chosen, F.col("__open") == F.col("__value"), "left")
    settled = F.coalesce(F.col("__alias"), F.col("__chosen"))
    return joined.select(*[settled.alias(c) if c == column else F.col(c) for c in df.columns])


def fuzzy_standardize_all(
    df: DataFrame, kinds: dict[str, str] | None = None, cutoff: float = fixed.FUZZY_CUTOFF
) -> DataFrame:
    """``fuzzy_standardize`` of many columns (column: kind) by the fixed labels: one pass finds the distinct
    open values of all of them, one table holds their labels, and Spark sees the size of each column's part.
    """
    kinds = category_columns(df) if kinds is None else kinds
    if not kinds:
        return df
    columns = list(kinds)
    alias = {c: _alias(F.col(c), fixed.ALIASES.get(kinds[c], {})) for c in columns}
    opened = df.select(*[F.when(alias[c].isNull(), F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"v{i}").alias("value")) for i in range(len(columns))])
    values = opened.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    values, _ = materialize(values, "values")
    parts = []
    for kind in sorted(set(kinds.values())):  # a few labels each
        own = [i for i, c in enumerate(columns) if kinds[c] == kind]
        best = fuzzy.best_label(fixed.CANONICAL[kind])(fuzzy.sorted_tokens(F.col("value")))
        parts.append(values.where(F.col("place").isin(own)).withColumn("best", best))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    closest = F.when(F.col("best.score") >= cutoff, F.col("best.label"))
    label = F.coalesce(closest, expr.title_case(expr.trim_all(F.col("value"))))
    chosen = materialize_parts(scored.select("place", "value", label.alias("label")), "place", len(columns), "labels")
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    joined = df.withColumns({f"__alias{i}": alias[c] for i, c in enumerate(columns)}).withColumns({
        f"__open{i}": F.coalesce(F.when(F.col(f"__alias{i}").isNull(), F.col(c)), spread) for i, c in enumerate(columns)
    })
    for i in range(len(columns)):
        own = chosen[i].select(F.col("value").alias(f"__value{i}"), F.col("label").alias(f"__label{i}"))
        joined = joined.join(own, F.col(f"__open{i}") == F.col(f"__value{i}"), "left")
    settled = {c: F.coalesce(f"__alias{i}", f"__label{i}").alias(c) for i, c in enumerate(columns)}
    return joined.select(*[settled.get(c, F.col(c)) for c in df.columns])


def parse_dates(
    df: DataFrame, columns: list[str] | None = None, formats: list[str] | None = None, keep_time: bool = False
) -> DataFrame:
    """Texts in many layouts to dates (or timestamps); what fits none becomes null."""
    if columns is None:
        columns = [c for c in df.columns if roles.has_token(c, "date", "timestamp", "time")]
    parse = expr.parse_datetime if keep_time else expr.parse_date
    return _replace(
        df, {c: parse(F.col(c), formats) for c in columns if not roles.is_date(df.schema[c].dataType)}
    )


def clean_quantity(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, expr.quantity(F.col(column)))


def clean_price(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, expr.price(F.col(column)))


def clean_discount(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, expr.discount(F.col(column)))


def rating_replacement(df: DataFrame, column: str) -> float:
    """Median of the ratings on the scale."""
    valid = df.select(expr.to_number(F.col(column)).alias("r")).where(F.col("r") <= fixed.RATING_HIGH)
    found = column_quantiles(valid, ["r"], [0.5])["r"]
    return (found[0] if found else None) or fixed.RATING_DEFAULT


def clean_rating(df: DataFrame, column: str, replacement: float | None = None) -> DataFrame:
    replacement = rating_replacement(df, column) if replacement is None else replacement
    return df.withColumn(column, expr.rating(F.col(column), replacement))


def _shares(df: DataFrame, columns: list[str], pattern: str) -> dict[str, float | None]:
    """Share of the non-blank cells that match, all columns in one pass."""
    row = df.agg(
        *[
            F.avg(F.when(F.trim(c) != "", F.trim(F.col(c)).rlike(pattern).cast("int"))).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: row[f"s{i}"] for i, c in enumerate(columns)}


def cast_id_int(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Id columns to bigint when every value is a whole number; else trimmed text."""
    chosen = [c for c in roles.string_columns(df) if roles.is_id(c)] if columns is None else _text(df, columns)
    if not chosen:
        return df
    whole = _shares(df, chosen, r"^\d+(\.0+)?$")
    return _replace(
        df,
        {
            c: expr.without_zero_fraction(expr.trim_all(F.col(c))).try_cast("bigint")
            if whole[c] == 1.0
            else expr.trim_all(F.col(c))
            for c in chosen
        },
    )


# A text that looks like money, a percentage or a plain number.
NUMBER_PATTERN = r"^[$€£₹]?\s*-?[\d,]+(\.\d+)?%?\s*$"


def infer_numeric_columns(df: DataFrame, columns: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """Text columns whose values look like numbers (at least that share of them) to double."""
    chosen = [c for c in roles.string_columns(df) if not roles.is_id(c)] if columns is None else _text(df, columns)
    if not chosen:
        return df
    looks = _shares(df, chosen, NUMBER_PATTERN)
    return _replace(
        df, {c: expr.to_number(F.col(c)) for c in chosen if looks[c] is not None and looks[c] >= threshold}
    )


def wrong_sales(kept: Column, formula: Column) -> Column:
    off = (F.abs(kept - formula) > fixed.SALES_TOLERANCE) | (kept > fixed.SALES_CEILING)
    return F.coalesce(off, F.lit(False))


def recompute_sales(
    df: DataFrame, sales: str, quantity: str, price: str, discount: str | None = None, only_bad_rows: bool = False
) -> DataFrame:
    """If any amount is off by more than the tolerance or above the ceiling, take the formula.

    By default for the whole column, with ``only_bad_rows`` where it is wrong.
    """
    kept = F.col(sales) if roles.is_numeric(df.schema[sales].dataType) else expr.to_number(F.col(sales))
    formula = expr.sales_amount(F.col(quantity), F.col(price), F.col(discount) if discount else None)
    wrong = wrong_sales(kept, formula)
    if only_bad_rows:
        return df.withColumn(sales, F.when(wrong, formula).otherwise(kept))
    any_wrong = df.agg(F.max(wrong.cast("int"))).first()[0]
    return df.withColumn(sales, formula if any_wrong else kept)


def null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def impute_median(
    df: DataFrame, columns: list[str] | None = None, medians: dict[str, float] | None = None
) -> DataFrame:
    """Numeric nulls to the column median, 0 when the column has no value."""
    if medians is None:
        chosen = columns or roles.numeric_columns(df)
        holes = null_counts(df, chosen)
        chosen = [c for c in chosen if holes[c]]
        found = column_quantiles(df, chosen, [0.5])
        medians = {c: (found[c][0] if found[c] else 0.0) for c in chosen}
    return _replace(
        df, {c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in medians.items()}
    )


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest one in a tie.

    Values are counted first, so nothing but one row per column is held in one place.
    """
    if not columns:
        return {}
    counts = profile.value_counts(df, columns, keep_null=False)
    best = profile.top_values(df, counts, 1, profile.text_sizes(df, columns)[1])
    found = {r["column_name"]: r["value"] for r in best.collect()}
    return {c: found.get(c) or "Unknown" for c in columns}


def impute_mode(
    df: DataFrame, columns: list[str] | None = None, chosen: dict[str, str] | None = None
) -> DataFrame:
    """Text nulls to the most frequent value; order and transaction ids are left alone."""
    if chosen is None:
        wanted = columns or [
            c
            for c in roles.string_columns(df)
            if not (roles.is_id(c) and (roles.has_token(c, "order", "transaction") or c.lower() == "id"))
        ]
        holes = null_counts(df, wanted)
        chosen = modes(df, [c for c in wanted if holes[c]])
    return _replace(df, {c: F.coalesce(F.col(c), F.lit(m)) for c, m in chosen.items()})


def forward_fill(
    df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None, buckets: int | None = None,
    made: list[str] | None = None, spent: list[str] | None = None,
) -> DataFrame:
    """Dates and flags: the last value before, in the given order. ``made`` and ``spent`` as in ``order.running_total``."""
    if columns is None:
        columns = [
            f.name for f in df.schema if roles.is_date(f.dataType) or isinstance(f.dataType, T.BooleanType)
        ]
    if not order_by:
        raise ValueError("forward_fill needs an order")
    columns = [c for c in columns if c not in order_by]
    holes = null_counts(df, columns)
    columns = [c for c in columns if holes[c]]
    return order.forward_fill(df, columns, order_by, buckets, made, spent) if columns else df
