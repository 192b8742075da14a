"""Hand-worked values for the 20-row retail sample."""

import pytest
from pyspark.sql import functions as F

import sample
from conftest import rows
from tablewright.operators import charts, clean, drivers, kpi, profile, stats
from tablewright.plans import cleaning


@pytest.fixture(scope="module")
def result(spark):
    return cleaning.clean_pipeline(
        sample.raw(spark), key=["transaction_id"], order_by=["order_date", "transaction_id"], consistency=96.5,
        accuracy=95.0,
    )


@pytest.fixture(scope="module")
def cleaned(result):
    return result.cleaned.cache()


def test_rows_and_types(result, cleaned):
    assert cleaned.count() == 18
    types = dict(cleaned.dtypes)
    assert types["order_date"] == "date" and types["gross_revenue"] == "double" and types["units_sold"] == "double"
    ba = result.before_after.first()
    assert (ba.before_rows, ba.after_rows, ba.before_duplicates, ba.after_duplicates) == (20, 18, 2, 0)
    assert (ba.before_nulls, ba.after_nulls) == (4, 0)
    assert (ba.null_improvement_pct, ba.duplicate_improvement_pct) == (100.0, 100.0)


def test_score_with_fixed_ratios(result):
    card = result.scorecard.first()
    assert (card.completeness, card.uniqueness, card.type_validity, card.overall_score) == (97.5, 90.0, 100.0, 96.3)


def test_audit(result):
    trail = {(r.column, r.operation): r.affected_rows for r in result.audit.collect()}
    assert trail[("entire_record", "Exact Deduplication")] == 2
    assert trail[("customer_segment", "Null Imputation (Mode)")] == 2
    assert trail[("customer_ltv", "Null Imputation (Median)")] == 2


def test_imputed_values(cleaned):
    got = {r.transaction_id: r for r in cleaned.collect()}
    assert got["TX-1005"].customer_ltv == 4300.0 and got["TX-1010"].customer_ltv == 4300.0
    assert got["TX-1006"].customer_segment == "Enterprise"
    assert got["TX-1018"].order_date.isoformat() == "2024-02-01"


def test_revenue_summary(cleaned):
    r = stats.numeric_summary(cleaned, ["gross_revenue"]).first()
    assert (r["count"], r["mean"], r["median"], r["min"], r["max"]) == (18, 10097.25, 7050.0, 950.0, 31200.0)
    assert (r["std"], r["p25"], r["p75"]) == (8881.86, 3425.38, 14662.5)
    assert stats.iqr_outliers(cleaned, ["gross_revenue"]).count() == 0


def test_ltv_quartiles_before_imputing(spark):
    raw = clean.dedupe_exact(clean.normalize_headers(sample.raw(spark)))
    t = clean.infer_numeric_columns(raw, ["customer_ltv"])
    r = stats.numeric_summary(t, ["customer_ltv"]).first()
    assert (r["p25"], r["median"], r["p75"]) == (2587.5, 4300.0, 6875.0)


def test_region_share(cleaned):
    got = [(r.sales_region, r.total_orders, r.regional_revenue, r.revenue_share_pct)
           for r in kpi.region_share(cleaned, sales="gross_revenue").collect()]
    assert got == [
        ("North America", 6, 68100.0, 37.47), ("Asia Pacific", 4, 63300.0, 34.83), ("Europe", 5, 40250.5, 22.15),
        ("Latin America", 3, 10100.0, 5.56),
    ]


def test_segments(cleaned):
    got = {r.value: (r.sample_size, r.total_target)
           for r in drivers.cohort_compare(cleaned, "gross_revenue", ["customer_segment"]).collect()}
    assert got == {"Enterprise": (8, 140600.0), "Mid-Market": (5, 31600.0), "SMB": (5, 9550.5)}


def test_pareto_and_months(cleaned):
    p = stats.pareto_share(cleaned, "gross_revenue").first()
    assert (p.top_rows, p.top_share_pct) == (3, 42.8)
    months = rows(kpi.monthly_mom(cleaned, sales="gross_revenue"))
    assert months == [("2024-01", 175850.5, 17, None, None), ("2024-02", 5900.0, 1, 175850.5, -96.64)]


def test_totals(cleaned):
    r = cleaned.agg(F.sum("units_sold"), F.round(F.avg("discount_rate"), 2), F.sum("gross_revenue")).first()
    assert tuple(r) == (68.0, 0.09, 181750.5)


def test_planted_driver_comes_first(spark):
    t = spark.range(400).select(
        (F.col("id") % 7).cast("double").alias("noise"),
        F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("grade"),
        ((F.col("id") % 4) * 100 + (F.col("id") % 3)).cast("double").alias("revenue"),
    )
    best = drivers.driver_importance(t, "revenue").collect()
    assert best[0].feature == "grade" and best[0].impact_direction == "positive"


def test_profile_of_sample(cleaned):
    p = {r.column_name: r for r in profile.profile_full(cleaned).collect()}
    assert p["customer_segment"].mode_val == "Enterprise" and p["customer_segment"].role == "categorical"
    assert p["transaction_id"].role == "identifier" and p["order_date"].min_date == "2024-01-15"


def test_donut_keeps_few_categories(cleaned):
    assert charts.donut_top_other(cleaned, "region", "gross_revenue").count() == 4
