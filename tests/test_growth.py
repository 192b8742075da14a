"""Work that must not be repeated or piled up as tables grow."""

import datetime

from pyspark.sql import functions as F

from registry import cleaning as registry_cleaning
from registry import inputs, relations
from tablewright.functions import expr, fixed
from tablewright.operators import charts, drivers, features, tablesets
from tablewright.plans import cleaning, featuring
from tablewright.session import METHOD_BYTES, METHOD_LIMIT

TABLES = {
    "lineitem": "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double, l_shipdate timestamp",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string, o_orderstatus string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int, n_name string",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_type string, p_brand string",
}


def _write(spark, folder):
    day = datetime.datetime(2024, 1, 5)
    rows = {
        "lineitem": [(k, 1, 1, 1, 2.0, 20.0, 0.1, day) for k in (1, 2, 101, None)],
        "orders": [(k, 1, day, "HIGH", "O") for k in (1, 2, 101)],
        "customer": [(1, 1, "A")], "nation": [(1, 1, "N")], "region": [(1, "R")], "part": [(1, "T", "B")],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{folder}/{name}.parquet")


def test_dirty_rows_come_from_one_pass(spark, tmp_path):
    _write(spark, tmp_path)
    dirty = inputs.dirty_sales(spark, str(tmp_path))
    plan = dirty._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey#") and plan.count("Join Inner") == 5
    # k = 7 * order + line: 8, 15 and 708 = 7 * 101 + 1; none is a multiple of 101, and five rows are empty
    assert dirty.count() == 8


def test_row_with_a_copy(spark, tmp_path):
    _write(spark, tmp_path)
    lines = spark.createDataFrame([(1, 94, 1, 1, 2.0, 20.0, 0.1, None)], TABLES["lineitem"])  # k = 101
    lines.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert inputs.dirty_sales(spark, str(tmp_path)).where("`Order ID` IS NOT NULL").count() == 2


def test_zero_fractions_go_and_bare_texts_are_not_searched(spark):
    texts = ["1.0", "1.00", "1.0\n", "1.05", "10", "a.0.0", ".0", "1.0x", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    searched = df.select(F.regexp_replace("t", r"\.0+$", "").alias("t"))
    got = df.select(expr.without_zero_fraction(F.col("t")).alias("t"))
    assert got.collect() == searched.collect()
    assert "Contains" in _sources(got) or "contains" in _sources(got).lower()


def _sources(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_derived_table_is_made_once_for_all_its_readers(spark, tmp_path):
    _write(spark, tmp_path)
    for build in (relations.before_after_rows, registry_cleaning.mode, registry_cleaning.fuzzy):
        found = build(spark, str(tmp_path))
        assert "l_linenumber" not in _sources(found), build
        assert found.count() == (1 if build is relations.before_after_rows else 8)


def test_difference_reads_each_table_once(spark, tmp_path):
    rows = [(1, "a", 0.0, [1]), (1, "a", -0.0, [1]), (2, None, float("nan"), None), (2, None, float("nan"), None)]
    schema = "i int, t string, x double, l array<int>"
    for name, some in (("before", rows), ("after", rows[1:3])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}")
    found = tablesets.multiset_difference(*[spark.read.parquet(f"{tmp_path}/{x}") for x in ("before", "after")])
    assert _sources(found).count("Relation") == 2 and "Join" not in _sources(found)
    assert sorted(map(str, found.collect())) == [
        "Row(i=1, t='a', x=0.0, l=[1], n_before=1, n_after=0)", "Row(i=2, t=None, x=nan, l=None, n_before=2, n_after=1)",
    ]


def test_queries_keep_generated_methods_compilable(spark, tmp_path):
    _write(spark, tmp_path)
    spark.conf.unset(METHOD_LIMIT)
    inputs.query(inputs.dirty_sales)(spark, str(tmp_path))
    assert spark.conf.get(METHOD_LIMIT) == METHOD_BYTES


def test_trim_takes_all_white_space_and_nothing_else(spark):
    blanks = [chr(i) for i in range(0x3100) if chr(i) in expr.BLANKS]
    texts = ["", " ", "a", " a b ", "é ", " é", "\x1fa\x1f", "​a​", *[f"{b}a{b}b{b}" for b in blanks], None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~expr.trim_all(F.col("t")).eqNullSafe(old)).count() == 0
    listed = F.lower(old).isin(fixed.PLACEHOLDERS)
    odd = spark.createDataFrame([(t,) for t in [" UNDEFINED　", "unKnown", "undefined.", "İ" * 9, "nil", None]], "t string")
    assert odd.where(~expr.null_placeholder(F.col("t")).eqNullSafe(F.when(listed, None).otherwise(old))).count() == 0


def _counted(spark, rows, schema):
    """A table that counts how often a row of it is made."""
    seen = spark.sparkContext.accumulator(0)

    def made(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(made), schema), seen


def test_boxplot_makes_its_input_once(spark):
    df, seen = _counted(spark, [("ab"[i % 2], float(i)) for i in range(200)], "c string, x double")
    assert {r["n"] for r in charts.boxplot_stats(df, "c", "x").collect()} == {95}
    assert seen.value == 200


def test_forest_takes_parts_of_bounded_rows(spark):
    coded = spark.range(1000, numPartitions=1).select(F.col("id").cast("double").alias("x"))
    dealt = drivers._dealt(coded, 100)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) <= 150
    assert drivers._dealt(coded, 1000).rdd.getNumPartitions() == 1


def test_order_columns_are_found_before_the_table_gets_wide(spark, monkeypatch):
    widths = []
    for name in ("running_total", "dense_rank_desc"):
        plain = getattr(features, name)
        monkeypatch.setattr(features, name, lambda d, *a, _f=plain, **k: (widths.append(len(d.columns)), _f(d, *a, **k))[1])
    df = spark.createDataFrame([(i, float(i % 3), datetime.date(2024, 1, 1 + i)) for i in range(9)], "id long, sales double, order_date date")
    table = featuring.feature_pipeline(df, "full", ["id"]).table
    assert max(widths) <= 4
    assert table.columns[-2:] == ["running_cumulative_sales", "sales_rank"]
    assert [r[0] for r in table.orderBy("id").select("running_cumulative_sales").collect()] == [0, 1, 3, 3, 4, 6, 6, 7, 9]


def test_cleaned_table_is_read_from_files(spark):
    df = spark.createDataFrame([(str(i), "5" if i % 2 else None, f"2024-01-0{i + 1}" if i else None) for i in range(6)], "id string, quantity string, order_date string")
    run = cleaning.clean_pipeline(df, key=["id"], order_by=["id"])
    plan = run.cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
