"""Plans and results that must hold at any size: no single partition, hot keys, row order."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablewright.functions import expr
from tablewright.operators import charts, clean, drivers, features, kpi, order, profile, quantiles, stats


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_below_window(df) -> bool:
    """A single-partition exchange whose input is neither aggregated nor limited."""
    lines = final_plan(df).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = "\n".join(lines[i + 1 : i + 4])
            if "HashAggregate" not in below and "Limit" not in below and "SortAggregate" not in below:
                return True
    return False


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value; another part is null."""
    random.seed(5)
    data = [
        (i, 7.0 if i % 3 == 0 else (None if i % 11 == 0 else random.randint(0, 500) / 4.0), i % 5, f"k{0 if i % 3 == 0 else i % 400}")
        for i in range(6000)
    ]
    return spark.createDataFrame(data, "id long, v double, g int, k string").repartition(8).cache()


@pytest.fixture(scope="module")
def hot_pd(hot):
    return hot.toPandas().sort_values("id").reset_index(drop=True)


GLOBAL = {
    "running_total": lambda d, n: features.running_total(d, "v", ["g", "id"], buckets=n),
    "dense_rank": lambda d, n: features.dense_rank_desc(d, "v", buckets=n),
    "percent_rank": lambda d, n: kpi.percent_rank_filter(d, "v", 0.9, buckets=n),
    "forward_fill": lambda d, n: clean.forward_fill(d, ["v2"], ["id"], buckets=n),
    "row_number": lambda d, n: order.global_row_number(d, ["k", "id"], "n", buckets=n),
    "spearman": lambda d, n: stats.spearman_pairs(d, ["v", "g"], buckets=n),
    "pareto": lambda d, n: stats.pareto_share(d, "v", buckets=n),
}


@pytest.mark.parametrize("name", GLOBAL)
def test_no_single_partition_and_same_result(hot, name):
    df = hot.withColumn("v2", F.when(F.col("id") % 4 == 0, F.lit("2024-01-01").cast("date")))
    results = []
    for n in (2, 8, 64):
        out = GLOBAL[name](df, n)
        assert not single_partition_below_window(out), name
        results.append(sorted(map(str, rows(out))))
    shuffled = sorted(map(str, rows(GLOBAL[name](df.orderBy(F.md5(F.col("id").cast("string"))), 8))))
    assert results[0] == results[1] == results[2] == shuffled


@pytest.mark.parametrize("method", ["dense", "min", "average"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_match_pandas(hot, hot_pd, method, descending):
    got = order.global_rank(hot, "v", "r", method, descending).toPandas().sort_values("id").r.to_numpy(float)
    want = hot_pd.v.rank(method=method, ascending=not descending).to_numpy()
    assert np.allclose(got, want, equal_nan=True)


def test_running_total_matches_pandas(hot, hot_pd):
    got = features.running_total(hot, "v", ["g", "id"]).toPandas().sort_values("id").iloc[:, -1].to_numpy(float)
    p = hot_pd.sort_values(["g", "id"])
    want = p.v.fillna(0).cumsum().where(p.v.notna()).sort_index().to_numpy()
    assert np.allclose(got, want, equal_nan=True)


PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize(("accuracy", "final"), [(100, 10_000), (10_000, 10_000), (10, 5), (3, 1), (4, 50)])
def test_quantiles_are_exact(hot, hot_pd, accuracy, final):
    found = quantiles.column_quantiles(hot, ["v", "id", "g"], PROBS, accuracy, final)
    for c in ("v", "id", "g"):
        assert np.allclose(found[c], np.percentile(hot_pd[c].dropna(), [p * 100 for p in PROBS]))


@pytest.mark.parametrize("final", [10_000, 2])
def test_quantiles_per_hot_group(hot, hot_pd, final):
    named = hot.withColumn("k", F.when(F.col("k") != "k1", F.col("k")))  # a null key is a key
    found = quantiles.exact_quantiles(named, "v", PROBS, ["k"], 100, final).collect()
    assert len(found) == hot_pd.k.nunique()
    for r in found:
        values = hot_pd[hot_pd.k == (r.k or "k1")].v.dropna()
        assert r.n == len(values) and np.allclose(r.quantiles, np.percentile(values, [p * 100 for p in PROBS]))


def test_quantiles_when_the_sketch_misses(hot, hot_pd, monkeypatch):
    """Cuts that lie elsewhere: the gap of the rank is read again."""
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, ends, accuracy: F.array(*[F.lit(30.0 + i) for i in range(len(ends))]))
    found = quantiles.column_quantiles(hot, ["v", "id"], PROBS)
    for c in ("v", "id"):
        assert np.allclose(found[c], np.percentile(hot_pd[c].dropna(), [p * 100 for p in PROBS]))


def test_quantiles_put_few_values_in_order(spark, monkeypatch):
    """Ten million different values: no window sees more than the final number of them."""
    seen, ordered = [], quantiles._ordered

    def watched(wanted, values):
        seen.append(values.groupBy("__k", "__part").count().agg(F.max("count")).first()[0])
        return ordered(wanted, values)

    monkeypatch.setattr(quantiles, "_ordered", watched)
    n = 10_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"))
    found = quantiles.column_quantiles(df, ["v"], [0.25, 0.5], final=500)["v"]
    assert np.allclose(found, [(n - 1) * 0.25, (n - 1) * 0.5])
    assert len(seen) > 1 and all((s or 0) <= 500 for s in seen)


def test_sums_keep_small_digits_and_nan(spark):
    tiny = spark.createDataFrame([("a", 1e-11), ("b", 3e-11)], "k string, v double")
    assert {r.k: r.share_pct for r in charts.contribution_breakdown(tiny, "k", "v").collect()} == {"a": 25.0, "b": 75.0}
    total = tiny.agg(expr.money_sum(F.col("v")).alias("s"), expr.money_avg(F.col("v")).alias("m")).first()
    assert total.s == pytest.approx(4e-11, rel=1e-12) and total.m == pytest.approx(2e-11, rel=1e-12)
    huge = spark.createDataFrame([(1e25,), (1e25,), (None,)], "v double")
    assert huge.agg(expr.money_sum(F.col("v"))).first()[0] == 2e25
    bad = spark.createDataFrame([(1.0,), (float("nan"),)], "v double").agg(
        expr.money_sum(F.col("v")).alias("s"), expr.money_avg(F.col("v")).alias("m"), expr.rounded_sum(F.col("v")).alias("r")
    ).first()
    assert all(np.isnan(x) for x in bad)


def test_text_keys_with_a_long_common_beginning(spark):
    long = "https://example.org/the/same/beginning/of/every/path/"
    df = spark.createDataFrame([(f"{long}{i:05d}", 1.0) for i in range(3000)], "url string, v double")
    placed = order.ranged(df, ["url"], 8).groupBy(order.RANGE).count().collect()
    assert len(placed) == 8 and max(r["count"] for r in placed) < 1000
    got = rows(order.global_row_number(df.repartition(5), ["url"], "n", 8), "url")
    assert [r[2] for r in got] == list(range(1, 3001))


def test_wide_driver_text(spark):
    df = spark.range(12_000).select(
        F.format_string("t%05d", F.pmod(F.col("id") * 7919, F.lit(12_000))).alias("name"), F.col("id").cast("double").alias("metric")
    )
    coded, _ = drivers.ordinal_features(df, "metric", ["name"])
    assert coded.agg(F.min("name"), F.max("name"), F.countDistinct("name")).first() == (0.0, 11_999.0, 12_000)


def test_scans_grow_with_the_columns_not_faster(spark):
    def scans(k):
        df = spark.range(50).select(*[(F.rand(i) * 9).alias(f"c{i}") for i in range(k)], *[F.lit(f"x{i}").alias(f"t{i}") for i in range(k)])
        df.write.mode("overwrite").parquet(path := f"/tmp/scan-{uuid.uuid4().hex}")
        read = spark.read.parquet(path)
        return final_plan(drivers.driver_direction(read, "c0")).count("Scan parquet")

    assert scans(4) - scans(3) == scans(3) - scans(2) <= 3


def test_group_limits_are_pushed_below_the_shuffle(hot):
    for out in (
        clean.dedupe_key(hot, ["k"], ["id"]),
        profile.profile_top_categories(hot, ["k"]),
        stats.categorical_summary(hot, ["k"]),
    ):
        plan = final_plan(out)
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_k_is_not_a_full_sort(hot):
    assert "TakeOrderedAndProject" in final_plan(charts.scatter_sample(hot, "id", "v", ["id"]))


def test_scan_reads_only_needed_columns(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = t.transform(lambda d: charts.linear_fit(d, "l_quantity", "l_extendedprice"))._jdf.queryExecution().toString()
    schema = plan[plan.rindex("ReadSchema"):].split("\n")[0]
    assert "l_quantity" in schema and "l_extendedprice" in schema and "l_shipdate" not in schema


def test_filter_reaches_the_scan(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = final_plan(kpi.monthly_mom(t, "o_orderdate", "o_totalprice"))
    assert "PushedFilters: [IsNotNull(o_orderdate)]" in plan


def test_shuffle_partitions_do_not_change_results(spark, hot):
    def run():
        return [sorted(map(str, rows(d))) for d in (
            stats.categorical_summary(hot, ["k"]), kpi.rank_over_agg(hot, "g", "v"),
            clean.dedupe_key(hot, ["k"], ["id"]), charts.donut_top_other(hot, "k", "v"),
        )]

    before = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert run() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_hot_alias_rows_skip_the_fuzzy_join(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "n.").when(F.col("id") % 3 == 1, "Northh").otherwise(None).alias("region")
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = clean.fuzzy_standardize(df, "region")
        got = {(r.region, r["count"]) for r in out.groupBy("region").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {("North", 2000), (None, 1000)}
