"""Feature derivation as one run, and the catalog of what it added."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, roles
from ..operators import features
from ..operators.profile import _cell, _rows_from_wide, distinct_counts
from ..functions.expr import half_up
from ..session import drop, materialize, released


@dataclass
class FeatureResult:
    table: DataFrame
    formulas: dict[str, tuple[str, str]] = field(default_factory=dict)
    scratch: list[str] = field(default_factory=list)

    def catalog(self, spent: list[str] | None = None) -> DataFrame:
        """Name, kind, formula and type of every derived column, with measured missing share
        and distinct count. ``spent`` are folders of the table that go once it has been read."""
        return feature_catalog(self.table, self.formulas, spent)


def feature_catalog(df: DataFrame, formulas: dict[str, tuple[str, str]], spent: list[str] | None = None) -> DataFrame:
    names = [c for c in df.columns if c in formulas]
    by = {f.name: f.dataType.simpleString() for f in df.schema}
    if not names:
        return df.sparkSession.createDataFrame(
            [], "feature_name string, feature_type string, formula string, data_type string, missing_pct double, "
            "unique_count bigint"
        )
    df, _ = materialize(df.select(*names), "features")  # read for the counts and the distinct values
    drop(df.sparkSession, *(spent or []))
    rows = _rows_from_wide(
        df,
        names,
        {
            "missing_pct": lambda c: half_up(
                F.try_divide((F.count("*") - F.count(_cell(c))) * 100.0, F.count("*")), 2
            ),
            "has_null": lambda c: F.max(_cell(c).isNull().cast("int")),
        },
    )
    sizes = distinct_counts(df, names)
    rows = rows.join(F.broadcast(sizes), "column_name").withColumn(  # one row per feature
        "unique_count", F.col("unique_count") - F.coalesce("has_null", F.lit(0))
    )
    text = {i: F.create_map(*[F.lit(x) for c in names for x in (c, formulas[c][i])]) for i in (0, 1)}
    kinds = F.create_map(*[F.lit(x) for c in names for x in (c, by[c])])
    name = F.col("column_name")
    return rows.select(
        name.alias("feature_name"), text[0][name].alias("feature_type"), text[1][name].alias("formula"),
        kinds[name].alias("data_type"), "missing_pct", "unique_count",
    )


def _note(result: FeatureResult, before: list[str], kind: str, formula) -> None:
    for c in result.table.columns:
        if c not in before:
            result.formulas[c] = (kind, formula(c))


def _step(result: FeatureResult, kind: str, change, formula) -> None:
    before = result.table.columns
    result.table = change(result.table)
    _note(result, before, kind, formula)


def feature_pipeline(
    df: DataFrame,
    policy: str = "full",
    order_by: list[str] | None = None,
    target_year: int | None = None,
    horizon: str | int | None = None,
    margin: bool = False,
    cogs_ratio: float = fixed.COGS_RATIO,
    buckets: int | None = None,
    spent: list[str] | None = None,
) -> FeatureResult:
    """``minimal`` adds only projections and a wanted margin, ``full`` everything the columns allow.

    The running total needs ``order_by``, a unique key; without one it is left out. With it the table is
    written in that order, and folders ``spent`` that hold the table as it came go once it has been read.
    """
    with released(df.sparkSession):
        result = _featured(df, policy, order_by, target_year, horizon, margin, cogs_ratio, buckets, spent)
    result.table = result.table.select("*")  # the caller's actions may reuse their shuffle files
    return result


def _featured(
    df: DataFrame, policy: str, order_by: list[str] | None, target_year: int | None, horizon: str | int | None, margin: bool,
    cogs_ratio: float, buckets: int | None, spent: list[str] | None,
) -> FeatureResult:
    result = FeatureResult(df)
    if policy == "minimal":
        if len(roles.year_columns(df)) >= 2:
            _step(result, "calculated", lambda d: features.project_growth(d, target_year, horizon),
                  lambda c: "compound growth of the yearly columns")
        sales = roles.first_named(df, ["total_sales", "sales", "revenue"])
        profit = roles.first_with_token(df, "profit")
        if margin and sales and profit:
            _step(result, "calculated", lambda d: features.profit_margin(d, profit, sales),
                  lambda c: f"{profit} / {sales} * 100")
        return result
    if policy != "full":
        raise ValueError(f"unknown policy {policy}")

    sales = roles.first_named(df, fixed.SALES_NAMES)
    base, last = df, []  # columns that need a shuffle: found on the table as it came, before it gets wide, and shown last
    if sales:
        _step(result, "window", lambda d: features.dense_rank_desc(d, sales, buckets=buckets, source=df),
              lambda c: f"dense_rank() over (order by {sales} desc)")
        if order_by:
            _step(result, "window", lambda d: features.running_total(d, sales, order_by, buckets, result.scratch, spent, df),
                  lambda c: f"sum({sales}) over (order by {', '.join(order_by)})")
            base = result.table.select(*[F.col(f"`{c}`") for c in df.columns])  # the same rows, still there
        last = [c for c in result.table.columns if c not in df.columns][::-1]
    dates = roles.date_columns(df)
    _step(result, "temporal", lambda d: features.calendar_parts(d, dates) if dates else d, lambda c: "calendar part")
    ordered = next((c for c in dates if roles.has_token(c, "order", "ordered")), None)
    delivered = next((c for c in dates if roles.has_token(c, "delivery", "delivered", "ship", "shipped")), None)
    if ordered and delivered:
        _step(result, "temporal", lambda d: features.fulfilment_days(d, ordered, delivered),
              lambda c: f"greatest({delivered} - {ordered}, 0)")
    quantity = roles.first_named(df, fixed.QUANTITY_NAMES)
    price = roles.first_named(df, ["unit_price", "price"])
    discount = roles.first_with_token(df, "discount")
    rating = roles.first_with_token(df, "rating", "satisfaction")
    if sales and quantity:
        _step(result, "calculated", lambda d: features.revenue_per_unit(d, sales, quantity),
              lambda c: f"{sales} / {quantity}")
    if sales:
        _step(result, "calculated", lambda d: features.estimated_margin(d, sales, cogs_ratio),
              lambda c: f"{sales} with an assumed cost ratio of {cogs_ratio}")
    if quantity and price and discount:
        _step(result, "calculated", lambda d: features.discount_amount(d, quantity, price, discount),
              lambda c: f"{quantity} * {price} * {discount}")
    measures = roles.measure_columns(df)[:3]
    if measures:
        _step(result, "scaled", lambda d: features.scale_all(d, measures), lambda c: c.rsplit("_", 1)[-1])
    if sales:
        _step(result, "binned", lambda d: features.revenue_tier(d, sales), lambda c: f"tier of {sales}")
    if rating:
        _step(result, "binned", lambda d: features.satisfaction_tier(d, rating), lambda c: f"tier of {rating}")
    dictionaries = features._encodable(base, None, 15)
    if dictionaries:
        _step(result, "encoded", lambda d: features.label_encode(d, dictionaries=dictionaries),
              lambda c: "position in sorted order")
        _step(result, "encoded", lambda d: features.frequency_encode(d, dictionaries=dictionaries, rows=base.count()),
              lambda c: "share of rows")
    texts = features.long_texts(base)
    if texts:
        _step(result, "text", lambda d: features.text_length(d, texts), lambda c: "characters")
    if sales:
        total = features.column_total(base, sales)
        _step(result, "window", lambda d: features.pct_of_total(d, sales, total=total),
              lambda c: f"{sales} / sum({sales}) * 100")
    result.table = result.table.select(*[F.col(f"`{c}`") for c in [*[c for c in result.table.columns if c not in last], *last]])
    return result
