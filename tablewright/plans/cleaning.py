"""The whole cleaning run with a measured audit trail, comparison and quality score.

The table is written to the shared checkpoint folder after each deduplication, before
imputation and after it. The column statistics in between read the columns they need from
those files instead of repeating the shuffles, and a lost executor costs no more than its
tasks. A folder goes when the next is written, shuffle files when their step ends, and large
tables are shuffled in parts, so the disk holds about two tables and a part at a time.
``CleanResult.scratch`` names the folders left; delete them when the cleaned table has
been written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr, fixed, roles
from ..operators import clean, order, profile
from ..session import dealt, drop, materialize, materialize_all, parts_of, released

DONE = fixed.AUDIT_OPERATIONS
AUDIT_SCHEMA = "column string, operation string, rationale string, affected_rows bigint"


@dataclass
class BusinessColumns:
    """Which columns play which part; found by name unless given."""

    quantity: str | None = None
    price: str | None = None
    discount: str | None = None
    sales: str | None = None
    rating: str | None = None

    @classmethod
    def of(cls, df: DataFrame) -> BusinessColumns:
        return cls(
            quantity=roles.first_named(df, fixed.QUANTITY_NAMES),
            price=roles.first_named(df, fixed.PRICE_NAMES),
            discount=roles.first_with_token(df, "discount"),
            sales=roles.first_named(df, fixed.SALES_NAMES),
            rating=roles.first_with_token(df, "satisfaction", "rating"),
        )

    def present(self) -> list[str]:
        return [c for c in (self.quantity, self.price, self.discount, self.sales, self.rating) if c]


@dataclass
class CleanResult:
    cleaned: DataFrame
    audit: DataFrame
    before_after: DataFrame
    scorecard: DataFrame
    rows: int
    scratch: list[str]

    def profile(self) -> DataFrame:
        return profile.profile_full(self.cleaned)

    def recommendations(self) -> DataFrame:
        return profile.quality_recommendations(self.profile(), self.rows)


def _changed(before: Column, after: Column) -> Column:
    return F.count_if(~before.eqNullSafe(after))


def _counts(df: DataFrame, measures: dict[str, Column]) -> dict[str, int]:
    if not measures:
        return {}
    row = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures.values())]).first()
    return {k: int(row[f"m{i}"] or 0) for i, k in enumerate(measures)}


def clean_pipeline(
    raw: DataFrame,
    key: list[str] | None = None,
    order_by: list[str] | None = None,
    business: BusinessColumns | None = None,
    date_columns: list[str] | None = None,
    consistency: float | None = None,
    accuracy: float | None = None,
    spent: list[str] | None = None,
) -> CleanResult:
    """Headers, placeholders, empty rows, duplicates, categories, dates, numbers, imputation.

    ``key`` names the business key (after header cleaning), ``order_by`` the order that
    decides which row of a key stays and what forward fill reads. ``consistency`` and
    ``accuracy`` replace the measured percentages of the score when given. ``spent`` are folders of
    the raw table that go when it has been read.
    """
    with released(raw.sparkSession):
        return _cleaned(raw, key, order_by, business, date_columns, consistency, accuracy, spent or [])


def _cleaned(
    raw: DataFrame, key: list[str] | None, order_by: list[str] | None, business: BusinessColumns | None,
    date_columns: list[str] | None, consistency: float | None, accuracy: float | None, spent: list[str],
) -> CleanResult:
    spark = raw.sparkSession
    audit: list[tuple[str, str, str, int]] = []
    headed = clean.normalize_headers(raw)
    renamed = sum(a != b for a, b in zip(raw.columns, headed.columns))
    if renamed:
        audit.append(("all_headers", DONE["headers"], f"{renamed} headers to snake case", 0))

    texts = roles.string_columns(headed)
    ids = [c for c in texts if roles.is_id(c)]
    trimmed = clean.strip_id_suffix(clean.trim_null_placeholders(headed), ids)
    trim_of = {c: expr.null_placeholder(F.col(c)) for c in texts}
    measures: dict[str, Column] = {
        "rows": F.count("*"),
        "placeholders": profile.placeholder_cells(headed),
    }
    measures |= {f"trim {c}": _changed(F.col(c), trim_of[c]) for c in texts}
    measures |= {f"suffix {c}": _changed(trim_of[c], expr.without_zero_fraction(trim_of[c])) for c in ids}
    first = _counts(headed, measures)
    for c in texts:
        if first[f"trim {c}"]:
            audit.append((c, DONE["placeholders"], "white space and placeholder texts", first[f"trim {c}"]))
    for c in ids:
        if first[f"suffix {c}"]:
            audit.append((c, DONE["id_suffix"], "trailing .0 of numeric ids", first[f"suffix {c}"]))
    raw_duplicates = profile.duplicate_row_count(headed).first()["duplicate_rows"]

    filled = clean.drop_empty_rows(trimmed)
    groups = [
        part.groupBy(*filled.columns).agg(F.count("*").alias("__copies"))
        for part in dealt(filled, [F.col(c) for c in key or order.tie_breaks(filled, [])], parts_of(filled))
    ]
    distinct, held = materialize_all(groups, "distinct")
    drop(spark, *spent)
    sizes = distinct.agg(F.count("*").alias("rows"), F.coalesce(F.sum("__copies"), F.lit(0)).alias("copies")).first()
    rows_distinct, rows_filled = sizes["rows"], sizes["copies"]
    unique = distinct.drop("__copies")
    order_by = order_by or (key or [])
    keyed = unique
    if key:  # read several times below, for the statistics that follow the key deduplication
        later = [c for c in order_by if c not in key]
        parts = [clean.dedupe_key(part, key, later) for part in dealt(unique, [F.col(c) for c in key], parts_of(unique))]
        keyed, key_path = materialize_all(parts, "keyed")
        drop(spark, held)
        held = key_path

    business = business or BusinessColumns.of(keyed)
    sets = {c: k for c, k in clean.category_columns(keyed).items() if c not in ids}
    dates = date_columns if date_columns is not None else [
        c for c in keyed.columns
        if roles.has_token(c, "date", "timestamp", "time") and not roles.is_date(keyed.schema[c].dataType)
    ]
    numbers = [c for c in business.present() if c in texts]
    watched = [*sets, *dates, *numbers]
    work = keyed.withColumns({f"__raw_{c}": F.col(c) for c in watched}) if watched else keyed
    work = clean.fuzzy_standardize_all(work, sets)
    work = clean.parse_dates(work, dates)
    if business.rating:
        replacement = clean.rating_replacement(keyed, business.rating)
        work = clean.clean_rating(work, business.rating, replacement)
    if business.quantity:
        work = clean.clean_quantity(work, business.quantity)
    if business.price:
        work = clean.clean_price(work, business.price)
    if business.discount:
        work = clean.clean_discount(work, business.discount)
    visible = keyed.columns
    whole = clean.cast_id_int(keyed, ids)
    open_texts = [c for c in texts if c not in ids and c not in sets and c not in dates and c not in business.present()]
    money_like = clean.infer_numeric_columns(keyed, open_texts) if open_texts else keyed
    for c in ids:
        if whole.schema[c].dataType != keyed.schema[c].dataType:
            work = work.withColumn(c, F.col(c).try_cast("bigint"))
    for c in open_texts:
        if roles.is_numeric(money_like.schema[c].dataType):
            work = work.withColumn(c, expr.to_number(F.col(c)))
    repair = bool(business.sales and business.quantity and business.price)
    if business.sales and not roles.is_numeric(work.schema[business.sales].dataType):
        work = work.withColumn(business.sales, expr.to_number(F.col(business.sales)))
    if repair:
        share = F.col(business.discount) if business.discount else None
        work = work.withColumn(
            "__formula", expr.sales_amount(F.col(business.quantity), F.col(business.price), share)
        )
    work, ruled_path = materialize(work, "ruled")
    drop(spark, held)
    held = ruled_path
    if repair:
        wrong_rows = F.count_if(clean.wrong_sales(F.col(business.sales), F.col("__formula")))
        if _counts(work, {"wrong": wrong_rows})["wrong"]:
            work = work.withColumn(business.sales, F.col("__formula"))

    measures = {"rows": F.count("*")}
    for c in sets:
        measures[f"set {c}"] = _changed(F.col(f"__raw_{c}"), F.col(c))
        measures[f"held {c}"] = F.count(f"__raw_{c}")
    for c in dates:
        measures[f"date {c}"] = _changed(F.col(f"__raw_{c}"), F.col(c).cast("string"))
    for c in numbers:
        measures[f"number {c}"] = _changed(expr.to_number(F.col(f"__raw_{c}")), F.col(c))
        measures[f"held {c}"] = F.count(f"__raw_{c}")
        measures[f"wrong {c}"] = F.count_if(
            F.col(f"__raw_{c}").isNotNull() & ~expr.to_number(F.col(f"__raw_{c}")).eqNullSafe(F.col(c))
        )
    measures |= {f"null {c}": F.count_if(F.col(c).isNull()) for c in visible}
    second = _counts(work, measures)
    rows_after = second["rows"]

    key_copies = rows_distinct - rows_after
    empty = first["rows"] - rows_filled
    exact = rows_filled - rows_distinct
    if empty:
        audit.append(("all_rows", DONE["empty_rows"], "rows without any value", empty))
    if exact:
        audit.append(("entire_record", DONE["duplicates"], "identical rows", exact))
    if key_copies:
        audit.append((",".join(key), DONE["key_duplicates"], "rows sharing a key, first kept", key_copies))
    for c in sets:
        audit.append((c, DONE["categories"], "aliases, closest label or title case", second[f"set {c}"]))
    for c in dates:
        audit.append((c, DONE["dates"], "many layouts to ISO dates", second[f"date {c}"]))
    wording = {
        business.quantity: (DONE["quantity"], "absolute value, at least 1"),
        business.price: (DONE["price"], "currency signs and negative signs removed"),
        business.discount: (DONE["discount"], "share between 0 and 0.99"),
        business.rating: (DONE["rating"], "limited to the rating scale"),
        business.sales: (DONE["sales"], "quantity * price * (1 - discount)"),
    }
    for c in numbers:
        if second[f"number {c}"]:
            audit.append((c, *wording[c], second[f"number {c}"]))

    holes = {c: second[f"null {c}"] for c in visible if second[f"null {c}"]}
    earlier = {f"__before_{c}": expr.to_number(F.col(f"__raw_{c}")) for c in numbers}
    staged = work.select(*visible, *[v.alias(n) for n, v in earlier.items()])
    kinds = {f.name: f.dataType for f in staged.schema}
    medians = [c for c in holes if roles.is_numeric(kinds[c])]
    protected = [c for c in ids if roles.has_token(c, "order", "transaction") or c.lower() == "id"]
    words = [c for c in holes if c in roles.string_columns(staged)]
    modal = [c for c in words if c not in protected]
    rest = [c for c in holes if c not in medians and c not in words]
    chosen = clean.modes(staged, modal)
    done = clean.impute_mode(clean.impute_median(staged, medians) if medians else staged, chosen=chosen)
    for c in medians:
        audit.append((c, DONE["median"], "column median", holes[c]))
    for c in modal:
        audit.append((c, DONE["mode"], f"most frequent value '{chosen[c]}'", holes[c]))
    made: list[str] = []
    if rest and order_by:
        done = clean.forward_fill(done, rest, order_by, made=made, spent=[held])
        for c in rest:
            audit.append((c, DONE["forward_fill"], "last value before", holes[c]))
    if not made:  # read below for quartiles, counts and duplicates, and by the caller: it is written in any case
        done, done_path = materialize(done, "imputed")
        drop(spark, held)
        made.append(done_path)
    cleaned = done.select(*visible)

    spread = [*numbers, *earlier]
    bounds = profile.tukey_bounds(done, spread) if spread else {}
    after = _counts(
        done,
        {"nulls": profile.null_cells(cleaned), "rows": F.count("*")}
        | {c: profile.outlier_count(c, bounds[c]) for c in spread},
    )
    outliers_before, outliers_after = sum(after[c] for c in earlier), sum(after[c] for c in numbers)
    duplicates_after = profile.duplicate_row_count(cleaned).first()["duplicate_rows"]
    removed = exact + key_copies
    null_gain = max(0.0, (first["placeholders"] - after["nulls"]) / max(first["placeholders"], 1) * 100.0)
    duplicate_gain = max(0.0, removed / raw_duplicates * 100.0) if raw_duplicates else 100.0
    before_after = spark.createDataFrame(
        [(
            first["rows"], after["rows"], len(raw.columns), len(cleaned.columns), first["placeholders"], after["nulls"],
            raw_duplicates, duplicates_after, outliers_before, outliers_after,
            round(null_gain, 1), round(duplicate_gain, 1),
        )],
        "before_rows bigint, after_rows bigint, before_cols bigint, after_cols bigint, before_nulls bigint, "
        "after_nulls bigint, before_duplicates bigint, after_duplicates bigint, before_outliers bigint, "
        "after_outliers bigint, null_improvement_pct double, duplicate_improvement_pct double",
    )
    held = sum(second[f"held {c}"] for c in sets)
    moved = sum(second[f"set {c}"] for c in sets)
    cells = sum(second[f"held {c}"] for c in numbers)
    wrong = sum(second[f"wrong {c}"] for c in numbers if c != business.discount)
    cells -= second[f"held {business.discount}"] if business.discount in numbers else 0
    typed = [f for f in cleaned.schema if f.dataType.simpleString() != "void"]
    score = profile.scorecard(
        completeness=(1.0 - first["placeholders"] / max(first["rows"] * len(raw.columns), 1)) * 100.0,
        type_validity=100.0 * len(typed) / max(len(cleaned.columns), 1),
        uniqueness=(1.0 - removed / max(first["rows"], 1)) * 100.0,
        consistency=consistency if consistency is not None else (1.0 - moved / held) * 100.0 if held else 100.0,
        accuracy=accuracy if accuracy is not None else (1.0 - wrong / cells) * 100.0 if cells else 100.0,
    )
    card = spark.createDataFrame(
        [tuple(score.values())], ", ".join(f"{k} double" for k in score)
    ).select(
        *[expr.half_up(F.col(k), 1).alias(k) for k in score],
        F.lit(sum(holes[c] for c in holes)).cast("bigint").alias("total_nulls_imputed"),
        F.lit(after["rows"]).cast("bigint").alias("total_rows_cleaned"),
    )
    trail = spark.createDataFrame(audit, AUDIT_SCHEMA)
    return CleanResult(cleaned, trail, before_after, card, after["rows"], made)
