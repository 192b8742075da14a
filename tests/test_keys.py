"""Hashed keys, ranks by value, and values carried over ranges, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.functions import fixed
from tablewright.operators import clean, drivers, kpi, order, profile, stats

from conftest import rows

LONG = "https://example.org/a/beginning/that/is/longer/than/what/a/key/holds/of/a/text/"


def texts():
    drawn = random.Random(3)
    values = [None, "", "b", "a", "a" * profile.HEAD, "a" * (profile.HEAD + 1)] + [f"{LONG}{i}" for i in range(9)]
    return [drawn.choice(values) for _ in range(400)]


def best(values, k):
    counts = Counter(values)
    return [(v, n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, (x[0] or "").encode()))][:k]


@pytest.mark.parametrize("k", [1, 4, 40])
def test_top_values_of_long_texts(spark, k):
    values = texts()
    df = spark.createDataFrame([(v, "x") for v in values], "t string, u string").repartition(5)
    counts = profile.value_counts(df, ["t", "u"])
    n, wide = profile.text_sizes(df, ["t", "u"])
    assert (n, wide) == (400, ["t"])
    got = profile.top_values(df, counts, k, wide).where("column_name = 't'").orderBy("place").collect()
    assert [(r.value, r.n) for r in got] == best(values, k)
    assert clean.modes(df, ["t"]) == {"t": best([v for v in values if v is not None], 1)[0][0]}


def test_texts_with_one_beginning_and_one_count(spark):
    values = [f"{LONG}{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "t string").repartition(4)
    got = profile.profile_top_categories(df, ["t"], 3).orderBy("place").collect()
    assert [r.category for r in got] == values[:3]
    assert profile.distinct_counts(df).first()["unique_count"] == 500


def test_no_whole_text_is_shuffled(spark):
    df = spark.createDataFrame([("x" * 5000 + str(i),) for i in range(40)], "t string")
    plan = profile.value_counts(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert keys and all("head" in line and "text" not in line for line in keys)


def test_rows_that_differ_in_places_only(spark):
    data = [("a", None, 0.0), (None, "a", 0.0), ("a", "", 0.0), ("a", None, -0.0), ("a", None, None), ("ab", "c", 1.0),
            ("a", "bc", 1.0), ("a", None, float("nan")), ("a", None, float("nan"))]
    df = spark.createDataFrame(data, "s string, t string, d double")
    assert profile.duplicate_row_count(df).first().asDict() == {"total_rows": 9, "distinct_rows": 7, "duplicate_rows": 2}
    found = {r["column_name"]: r["unique_count"] for r in profile.distinct_counts(df).collect()}
    assert found == {"s": 3, "t": 5, "d": 4}


def test_nested_values_are_keys(spark):
    df = spark.createDataFrame(
        [([1, None], {"a": 1}), ([1], {"a": 1}), ([None, 1], {"a": None}), ([1], {"a": 1})], "l array<int>, m map<string, int>"
    )
    assert {r["column_name"]: r["unique_count"] for r in profile.distinct_counts(df).collect()} == {"l": 3, "m": 2}
    assert profile.duplicate_row_count(df).first()["duplicate_rows"] == 1


@pytest.mark.parametrize("method", ["dense", "min", "average"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_by_value_are_the_ranks_of_rows(spark, method, descending):
    drawn = random.Random(5)
    data = [(i, drawn.choice([None, 1.5, 2.0, -0.0, 0.0, 9.0 + drawn.randrange(90)]), drawn.randrange(7)) for i in range(600)]
    df = spark.createDataFrame(data, "id int, v double, w int").repartition(6)
    got = order.ranked_by_value(df, {"v": "rv", "w": "rw"}, method, descending, 5)
    want = order.global_rank(order.global_rank(df, "v", "rv", method, descending, 5), "w", "rw", method, descending, 5)
    assert got.dtypes == want.dtypes and rows(got, "id") == rows(want, "id")


def test_previous_value_over_ranges(spark):
    data = [(i, None if i % 7 == 0 else float(i * i % 13)) for i in range(300)]
    df = spark.createDataFrame(random.Random(1).sample(data, 300), "m int, v double")
    got = kpi.lag_growth(df, "m", "v", "prev", "growth", buckets=9).orderBy("m").collect()
    assert [r.prev for r in got] == [None] + [v for _, v in data[:-1]]
    empty = kpi.lag_growth(df.where("m < 0"), "m", "v", "prev", "growth")
    assert empty.count() == 0 and empty.columns == ["m", "v", "prev", "growth"]


def test_all_label_columns_at_once(spark):
    drawn = random.Random(2)
    words = {"region": ["suth", "N.", "Westt", "mid market", None, ""], "category": ["toy", "Grocry", "Furnitur", None],
             "ship_region": ["Eas", "zzz", "south"]}
    data = [tuple(drawn.choice(words[c]) for c in words) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, region string, category string, ship_region string")
    want = df
    for c in words:
        want = clean.fuzzy_standardize(want, c)
    got = clean.fuzzy_standardize_all(df)
    assert got.columns == df.columns and rows(got, "id") == rows(want, "id")
    assert clean.fuzzy_standardize_all(df.select("id")).columns == ["id"]
    assert clean.fuzzy_standardize_all(df.limit(0)).count() == 0


def test_dictionaries_lie_apart(spark):
    """The dictionary of a wide text does not make Spark merge-join that of a narrow one."""
    df = spark.range(3000).select(
        F.concat(F.lit("wide text "), F.col("id").cast("string")).alias("w"),
        F.pmod(F.col("id"), F.lit(3)).cast("string").alias("n"), F.col("id").cast("double").alias("y"),
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
        coded, _ = drivers.ordinal_features(df, "y", ["w", "n"])
        text = coded._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("BroadcastHashJoin") == 1 and text.count("SortMergeJoin") == 1


def test_shown_texts_are_fixed_values():
    assert len(fixed.AUDIT_OPERATIONS) == 16 and set(fixed.TRANSFORM_ADVICE) >= {"normal_like"}
    assert stats.fixed is fixed
