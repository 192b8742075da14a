"""Small rules, one at a time."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablewright.functions import expr, fixed, fuzzy, roles
from tablewright.operators import checks, checks, clean, drivers, features, profile
from tablewright.plans import suite
from tablewright.sources import files


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, fn, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(fn(F.col("v"))).collect()]


def test_header_names():
    assert clean.header_names(["A b", "a_b", "!", " Gross  Revenue ($) ", "a b", "Été"]) == [
        "a_b", "a_b_2", "column", "gross_revenue", "a_b_3", "été",
    ]


def test_placeholders(spark):
    got = apply(spark, [" N/A\t", "x ", "", None, "--", " Unknown", "none!"], expr.null_placeholder)
    assert got == [None, "x", None, None, None, None, "none!"]


def test_title_case_like_python(spark):
    texts = ["mid-market", "it's ok", "ABC dEF", "x1y", "été à l'eau", "", "3rd ave"]
    assert apply(spark, texts, expr.title_case) == [t.title() for t in texts]


def test_dates_are_year_first_then_day_first(spark):
    texts = ["2024-02-01", "01/02/2024", "1/2/2024", "01-02-2024", "01 Feb 2024", "Feb 1, 2024", "20240201",
             "2024-02-01 10:11:12", "no date", "", None, "31/02/2024", "02/13/2024"]
    got = [d and d.isoformat() for d in apply(spark, texts, expr.parse_date)]
    assert got == ["2024-02-01"] * 8 + [None, None, None, None, "2024-02-13"]


def test_number_rules(spark):
    assert apply(spark, ["-3", "abc", None, "0.5", "1,200"], expr.quantity) == [3.0, 1.0, 1.0, 1.0, 1200.0]
    assert apply(spark, ["$-4.50", "€1,000", "?", None], expr.price) == [4.5, 1000.0, None, None]
    assert apply(spark, ["5%", "0.05", "150", None, "-20%", "1"], expr.discount) == [0.05, 0.05, 0.99, 0.0, 0.2, 0.99]
    assert apply(spark, ["99", "0", "4", None], lambda c: expr.rating(c, 3.5)) == [3.5, 1.0, 4.0, None]


def test_half_up_ties(spark):
    got = apply(spark, [2.675, 0.125, -2.675, 1e30, None, 1.005], lambda c: expr.half_up(c, 2), "double")
    assert got == [2.68, 0.13, -2.68, 1e30, None, 1.01]


def lcs(a, b):
    best = 0
    for n in range(min(len(a), len(b)), 0, -1):
        subs = {"".join(c) for c in itertools.combinations(a, n)}
        if any("".join(c) in subs for c in itertools.combinations(b, n)):
            return n
    return best


def test_fuzzy_score_against_brute_force(spark):
    random.seed(3)
    words = ["".join(random.choice("abc d") for _ in range(random.randint(1, 7))).strip() or "a" for _ in range(25)]
    labels = ["ab cd", "bad", "c ab"]
    df = column(spark, words).select("v", fuzzy.best_label(labels)(fuzzy.sorted_tokens(F.col("v"))).alias("b"))
    for r in df.collect():
        text = " ".join(sorted(r.v.split()))
        keys = [(label, " ".join(sorted(label.split()))) for label in labels]
        scores = [200.0 * lcs(text, k) / (len(text) + len(k)) for _, k in keys]
        best = max(scores)
        assert r.b.score == pytest.approx(best) and r.b.label == labels[scores.index(best)]


def test_fuzzy_standardize(spark):
    got = clean.fuzzy_standardize(column(spark, ["suth", "Southe", "sOUTH", "mid-market mix", None]), "v", "region")
    assert [r.v for r in got.orderBy("i").collect()] == ["South", "South", "South", "Mid-Market Mix", None]


def test_roles_use_whole_tokens():
    assert roles.is_id("order_id") and not roles.is_id("paid") and not roles.is_id("width")
    assert not roles.has_token("sentiment", "time")
    assert roles.year_of("1995_population") == 1995 and roles.year_of("12022") is None


def test_dedupe_key_keeps_first_in_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b"), (None, 1, "x"), (None, 2, "y")],
                               "k int, o int, v string")
    assert rows(clean.dedupe_key(df, ["k"], ["o"]), "v") == [(1, 1, "a"), (2, 2, "b"), (None, 1, "x")]
    assert clean.dedupe_key(df, ["k"], ["o"], keep_null_keys=True).count() == 4


def test_id_and_numeric_inference_look_at_every_row(spark):
    many = ["1"] * 50 + ["x"]
    df = column(spark, many).withColumnRenamed("v", "order_id")
    assert dict(clean.cast_id_int(df).dtypes)["order_id"] == "string"
    assert dict(clean.infer_numeric_columns(column(spark, many)).dtypes)["v"] == "string"
    assert dict(clean.infer_numeric_columns(column(spark, ["$1,000", "5%", None, "-3"])).dtypes)["v"] == "double"


def test_recompute_only_bad_rows(spark):
    df = spark.createDataFrame([(2.0, 10.0, 20.0), (1.0, 5.0, 500.0)], "q double, p double, s double")
    assert [r.s for r in clean.recompute_sales(df, "s", "q", "p").orderBy("q").collect()] == [5.0, 20.0]
    df2 = spark.createDataFrame([(2.0, 10.0, 22.0), (1.0, 5.0, 500.0)], "q double, p double, s double")
    assert [r.s for r in clean.recompute_sales(df2, "s", "q", "p", only_bad_rows=True).orderBy("q").collect()] == [5.0, 22.0]


def test_horizon():
    assert features.horizon_years(2022, 2042) == 20
    assert features.horizon_years(2022, None, "next 15 years") == 15
    assert features.horizon_years(2022) == fixed.DEFAULT_HORIZON


@pytest.mark.parametrize("statement", [
    "DROP TABLE data", "select 1; drop table data", "INSERT INTO data SELECT 1", "SET x=1", "SHOW TABLES", "CACHE TABLE data", "",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "/* select */ delete from data", "EXPLAIN SELECT 1",
    "WITH a AS (SELECT 1 AS x) -- it's\nINSERT INTO t SELECT * FROM a -- it's", "FROM data INSERT INTO t SELECT n INSERT INTO u SELECT n",
    "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT `reflect`('java.lang.System', 'nanoTime')",
    "SELECT n FROM data WHERE n = (SELECT max(java_method('java.lang.System', 'nanoTime')) FROM data)",
    "SELECT TRANSFORM(n) USING 'cat' AS (x) FROM data",
    "SELECT * FROM parquet.`/any/path`", "SELECT * FROM data JOIN csv . `/any/path` USING (x)",
    "SELECT count(*) FROM data, parquet.`/any/path`", "SELECT count(*) FROM `parquet`.`/any/path`",
    "SELECT count(*) FROM (parquet.`/any/path`)", "SELECT * FROM data CROSS JOIN LATERAL parquet.`/any/path`",
    "WITH a AS (SELECT * FROM json.`/any/path`) SELECT * FROM a", "SELECT (SELECT max(x) FROM text.`/any/path`) FROM data",
    "SELECT n FROM data WHERE EXISTS (SELECT 1 FROM orc.`/p`)", "SELECT * FROM data WHERE n IN (WITH a AS (SELECT * FROM csv.`/p`) SELECT x FROM a)",
    "TABLE parquet.`/any/path`", "SELECT * FROM spark_catalog.default.data", "SELECT * FROM not_registered",
])
def test_only_reading_sql(spark, statement):
    files.register_views(spark.range(100).toDF("n"), ["data"])
    with pytest.raises(PermissionError):
        suite.sql_readonly(spark, statement)


@pytest.mark.parametrize("statement", [
    "SELECT * FROM Data", "WITH A AS (SELECT n FROM data) SELECT * FROM a WHERE n IN (SELECT n FROM A)", "TABLE data",
    "SELECT d.n FROM data d, LATERAL (SELECT d.n + 1 AS m) WHERE m > 3", "SELECT 'parquet.`/any/path`' AS t FROM data; -- drop",
    "WITH a AS (SELECT 1 AS n), b AS (SELECT n FROM a) SELECT count(*) FROM b JOIN data USING (n)",
])
def test_reading_sql_that_is_allowed(spark, statement):
    files.register_views(spark.range(100).toDF("n"), ["data"])
    assert suite.sql_readonly(spark, statement, 5).count() <= 5


def test_hints_and_keywords_choose_the_target(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "separate double, unit_rate double, net_profit double")
    assert drivers.resolve_target(df, "the rate") == "unit_rate"
    assert drivers.resolve_target(df, "rates") == "net_profit"
    assert drivers.resolve_target(df) == "net_profit"


def test_repeated_headers():
    assert clean.header_names(["A b", "a_b", "A-b", "a_b_2", "a b", "", "!"]) == ["a_b", "a_b_3", "ab", "a_b_2", "a_b_4", "column", "column_2"]


def test_percent_signs(spark):
    got = rows(column(spark, ["1%", "0.5%", "15", "0.2", "150%", None]).select(expr.discount(F.col("v")).alias("d")))
    assert [r[0] for r in got] == [0.01, 0.005, 0.15, 0.2, 0.99, 0.0]


def test_reading_sql_is_capped(spark):
    files.register_views(spark.range(100).toDF("n"), ["data"])
    q = "WITH x AS (SELECT n FROM data ORDER BY n LIMIT 50) SELECT n, 'update; -- drop' AS t FROM x;"
    assert suite.sql_readonly(spark, q, limit=7).count() == 7


def test_suite_lists_what_it_skips(spark):
    df = spark.createDataFrame([("a", 1.0)], "region string, total_sales double")
    assert {n for n, _ in suite.skipped(df)} == {
        "top_products_revenue", "monthly_sales_mom_growth", "customer_rfm_ranking", "payment_method_aov",
        "high_value_transaction_outliers",
    }
    assert {r.template for r in suite.kpi_suite(df).collect()} == {"regional_contribution_share"}


def test_delimited_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'say "hi"')], "n int, t string")
    for name, sep in (("x.csv", ","), ("x.tsv", "\t"), ("x.txt", ";")):
        path = files.write_csv(df, str(tmp_path / name), sep=sep)
        assert rows(files.read_delimited(spark, path), "n") == [(1, "a,b"), (2, 'say "hi"')]
    with pytest.raises(ValueError):
        files.read_delimited(spark, "x.xlsx")


def test_banned_words_are_whole_words(spark):
    df = column(spark, ["Orders", "an order.", "PRICE is €5", "reprice", None])
    got = {r.term: r.hits for r in checks.banned_vocabulary_scan(df, "t", ["v"]).collect()}
    assert got == {"order": 1, "price": 1, "€": 1}


def test_inspect_view_counts(spark):
    files.register_views(column(spark, ["a", None, "a"]), ["small_view"])
    got = {r.column_name: (r.null_count, r.unique_count) for r in profile.inspect_view(spark, "small_view").collect()}
    assert got == {"i": (0, 3), "v": (1, 1)}


def test_banned_words_of_a_domain(spark):
    df = spark.createDataFrame([("ORDER order reorder",), ("a cart, $5",), (None,), ("net profit: €",), ("in-cart (b.c)",)], "t string")
    found = {(r.term, r.kind, r.hits) for r in checks.banned_vocabulary_scan(df, "x", domain="healthcare").collect()}
    assert found == {("order", "word", 1), ("cart", "word", 2), ("profit", "word", 1), ("$", "symbol", 1), ("€", "symbol", 1)}
    own = checks.banned_vocabulary_scan(df, "x", ["t"], ["in-cart", "cart"], [])
    assert {(r.term, r.hits) for r in own.collect()} == {("in-cart", 1), ("cart", 2)}
    assert checks.banned_vocabulary_scan(df, "x", domain="ecommerce").count() == 0


def test_shapes_skip_only_layouts_that_fail(spark):
    """Choosing layouts by shape gives what trying every layout gives."""
    random.seed(11)
    given = ["2024-02-29", "2023-02-29", "20240131", "1/2/2024", "31/12/2023", "12/31/2023", "05.06.2024", "5 March 2024", "05 Mar 2024",
             "Mar 5, 2024", "March 15, 2024", "2024/01/05", "2024-01-05 10:11:12", "2024-01-05T10:11:12", "+12024-01-05", "x", "", None,
             " 2024-01-05\t", "2024-1-5", "001/2/2024", "May 5, 2024", "5 mai 2024", "99999999", "2024-01-05 25:00:00"]
    given += ["".join(random.choice("0123/-. ,MarT:") for _ in range(random.randint(6, 12))) for _ in range(300)]
    df = column(spark, given)
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")
    try:
        text = expr.trim_all(F.col("v"))
        every = F.coalesce(*[F.try_to_date(text, f) for f in fixed.DATE_FORMATS])
        times = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in fixed.DATE_FORMATS])
        found = [expr.parse_date(F.col("v")), every, expr.parse_datetime(F.col("v")), times]
        out = df.select("v", *[c.cast("string").alias(n) for c, n in zip(found, "abcd", strict=True)])  # Python has no year 12024
        assert [r for r in out.collect() if r.a != r.b or r.c != r.d] == [] and out.where("a IS NOT NULL").count() >= 14
    finally:
        spark.conf.unset("spark.sql.legacy.timeParserPolicy")
    assert expr.layout_shape("EEE yyyy") is None
