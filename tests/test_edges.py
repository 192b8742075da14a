"""Empty tables, single rows, constants, nulls and ties."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablewright.operators import charts, clean, drivers, features, kpi, order, profile, quantiles, star, stats

SCHEMA = "id bigint, category string, region string, total_sales double, quantity double, order_date date"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def single(spark):
    import datetime

    return spark.createDataFrame([(1, "a", "r", 10.0, 2.0, datetime.date(2024, 1, 5))], SCHEMA)


@pytest.fixture(scope="module")
def blank(spark):
    return spark.createDataFrame([(i, None, None, None, None, None) for i in range(12)], SCHEMA)


@pytest.fixture(scope="module")
def constant(spark):
    return spark.range(20).select(
        F.col("id"), F.lit("a").alias("category"), F.lit("r").alias("region"), F.lit(5.0).alias("total_sales"),
        F.lit(1.0).alias("quantity"), F.lit("2024-01-01").cast("date").alias("order_date"),
    )


OPERATORS = {
    "running_total": lambda d: features.running_total(d, "total_sales", ["id"]),
    "dense_rank": lambda d: features.dense_rank_desc(d, "total_sales"),
    "forward_fill": lambda d: clean.forward_fill(d, ["order_date"], ["id"]),
    "row_number": lambda d: order.global_row_number(d, ["id"], "n"),
    "median": lambda d: clean.impute_median(d, ["total_sales"]),
    "mode": lambda d: clean.impute_mode(d, ["category"]),
    "summary": lambda d: stats.numeric_summary(d, ["total_sales", "quantity"]),
    "categories": lambda d: stats.categorical_summary(d, ["category"]),
    "pearson": lambda d: stats.pearson_pairs(d, ["total_sales", "quantity"]),
    "spearman": lambda d: stats.spearman_pairs(d, ["total_sales", "quantity"]),
    "outliers": lambda d: stats.iqr_outliers(d, ["total_sales"]),
    "zscores": lambda d: stats.zscore_outliers(d, ["total_sales"]),
    "pareto": lambda d: stats.pareto_share(d, "total_sales"),
    "profile": lambda d: profile.profile_full(d),
    "light": lambda d: profile.profile_light(d),
    "duplicates": lambda d: profile.duplicate_row_count(d),
    "scale": lambda d: features.scale_all(d, ["total_sales"]),
    "encode": lambda d: features.frequency_encode(features.label_encode(d, ["category"]), ["category"]),
    "histogram": lambda d: charts.histogram(d, "total_sales"),
    "kde": lambda d: charts.kde_curve(d, "total_sales"),
    "boxplot": lambda d: charts.boxplot_stats(d, "category", "total_sales"),
    "donut": lambda d: charts.donut_top_other(d, "category", "total_sales"),
    "cards": lambda d: charts.kpi_cards(d, "total_sales", "order_date", "id"),
    "percent_rank": lambda d: kpi.percent_rank_filter(d, "total_sales"),
    "high_value": lambda d: kpi.high_value_orders(d, key=["id"]),
    "monthly": lambda d: kpi.monthly_mom(d),
    "regions": lambda d: kpi.region_share(d),
    "cohorts": lambda d: drivers.cohort_compare(d, "total_sales"),
    "overview": lambda d: drivers.target_overview(d, "total_sales"),
    "dim_date": lambda d: star.dim_date(d, "order_date"),
    "dim": lambda d: star.dim_category(d, "category"),
    "fit": lambda d: charts.linear_fit(d, "quantity", "total_sales"),
    "matrix": lambda d: charts.corr_matrix(d, ["quantity", "total_sales"]),
    "direction": lambda d: drivers.driver_direction(d, "total_sales", ["category", "quantity"]),
    "yoy": lambda d: star.measure_yoy_growth(d, "order_date", "total_sales"),
    "totals": lambda d: star.measure_totals(d, "total_sales"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_runs_on_edge_inputs(name, empty, single, blank, constant):
    for df in (empty, single, blank, constant):
        OPERATORS[name](df).collect()


def test_constant_column_has_no_spread(constant):
    r = stats.numeric_summary(constant, ["total_sales"]).first()
    assert (r["std"], r["skewness"], r["kurtosis"], r["iqr"]) == (0.0, 0.0, 0.0, 0.0)
    assert stats.pearson_pairs(constant, ["total_sales", "quantity"]).first().pearson_r == 0.0
    assert stats.iqr_outliers(constant, ["total_sales"]).count() == 0
    out = features.scale_all(constant, ["total_sales"])
    assert "total_sales_minmax" not in out.columns and out.first().total_sales_zscore == 0.0


def test_null_column(blank):
    assert {r.total_sales for r in clean.impute_median(blank, ["total_sales"]).collect()} == {0.0}
    assert {r.category for r in clean.impute_mode(blank, ["category"]).collect()} == {"Unknown"}
    top = profile.profile_top_categories(blank, ["category"]).first()
    assert (top.category, top.percentage) == ("null", 100.0)


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert clean.modes(df, ["v"]) == {"v": "a"}


def test_zero_and_negative_denominators(spark):
    df = spark.createDataFrame([("2024-01", 0.0), ("2024-02", 5.0), ("2024-03", -5.0), ("2024-04", 10.0)],
                               "m string, v double")
    got = kpi.lag_growth(df, "m", "v", "prev", "growth").orderBy("m").collect()
    assert [r.growth for r in got] == [None, None, -200.0, -300.0]
    margin = features.profit_margin(spark.createDataFrame([(1.0, 0.0)], "p double, s double"), "p", "s")
    assert margin.first().profit_margin == 10000.0


def test_quantile_of_few_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert quantiles.column_quantiles(df, ["v"], [0.0, 0.5, 1.0])["v"] == [1.0, 1.5, 2.0]


def test_forward_fill_before_first_value(spark):
    df = spark.createDataFrame([(i, None if i % 3 != 2 else i) for i in range(12)], "id int, v int").withColumn(
        "v", F.date_add(F.lit("2024-01-01").cast("date"), F.col("v"))
    )
    got = [r.v and r.v.day for r in clean.forward_fill(df, ["v"], ["id"]).orderBy("id").collect()]
    assert got == [None, None, 3, 3, 3, 6, 6, 6, 9, 9, 9, 12]


def test_non_ascii_keys(spark):
    words = ["zebra", "Äpfel", "apple", "épée", "apples and pears and plums", "apples and pears and plumz", "日本"]
    got = rows(order.global_row_number(spark.createDataFrame([(w,) for w in words], "w string"), ["w"], "n"), "n")
    assert [w for w, _ in got] == sorted(words, key=lambda w: w.encode())


def test_typed_columns_pass_through(single):
    out = clean.parse_dates(clean.trim_null_placeholders(single))
    assert dict(out.dtypes) == dict(single.dtypes)
    assert clean.clean_quantity(single, "quantity").first().quantity == 2.0
