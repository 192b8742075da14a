"""Time joins, sessions and table differences against plain loops, with hot keys over many ranges."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablewright.operators import tablesets, timejoins

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def made(seed, n, hot=True):
    """(key, time, id): a third of the rows have key 0, some keys and times are null, times repeat."""
    random.seed(seed)
    out = []
    for i in range(n):
        key = 0 if hot and i % 3 == 0 else random.choice([1, 2, 3, None])
        out.append((key, at(random.choice([None, *range(0, 400, 3)])), i))
    return out


def text(found):
    return Counter(map(str, found))


@pytest.mark.parametrize("buckets", [2, 7, 40])
def test_asof_join(spark, buckets):
    left, right = made(1, 300), made(2, 120)
    a = spark.createDataFrame(left, "k int, t timestamp, id int")
    b = spark.createDataFrame(right, "k int, rt timestamp, rid int")
    want = []
    for k, t, i in left:
        fit = [(rt, rid) for rk, rt, rid in right if rk == k and None not in (rt, t, k) and rt <= t]
        want.append((k, t, i, *max(fit, default=(None, None))))
    assert text(rows(timejoins.asof_join(a, b, ["k"], "t", "rt", buckets=buckets))) == text(want)


def test_asof_join_empty_sides_and_names(spark):
    a = spark.createDataFrame(made(1, 10), "k int, t timestamp, id int")
    none = a.limit(0)
    assert timejoins.asof_join(none, a, ["k"], "t", "t", "r_").count() == 0
    alone = timejoins.asof_join(a, none, ["k"], "t", "t", "r_")
    assert alone.count() == 10 and alone.where("r_id IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="prefix"):
        timejoins.asof_join(a, a, ["k"], "t", "t")


@pytest.mark.parametrize("buckets", [2, 9, 50])
def test_sessions(spark, buckets):
    data = made(3, 400) + [(5, at(10), -1)] * 30
    want = []
    for key in {k for k, *_ in data} - {None}:
        times = sorted(t for k, t, _ in data if k == key and t is not None)
        for t in times:
            if want and want[-1][0] == key and t - want[-1][2] <= timedelta(minutes=4):
                want[-1][2], want[-1][3] = t, want[-1][3] + 1
            else:
                want.append([key, t, t, 1])
    df = spark.createDataFrame(data, "k int, t timestamp, id int")
    got = rows(timejoins.sessions(df, "k", "t", 240, buckets))
    assert text(got) == text(map(tuple, want))


@pytest.mark.parametrize(("on", "width", "full"), [([], None, 5), (["k"], None, 20_000), (["k"], 60.0, 3), ([], 1e6, 10)])
def test_interval_join(spark, on, width, full):
    points, spans = made(4, 200), []
    for i, (k, t, _) in enumerate(made(5, 80)):
        spans.append((k, t, t and t + timedelta(minutes=random.choice([-5, 0, 3, 60])), i))
    a = spark.createDataFrame(points, "k int, t timestamp, id int")
    b = spark.createDataFrame(spans, "k int, s timestamp, e timestamp, sid int")
    if not on:
        b = b.withColumnRenamed("k", "sk")
    want = [
        (k, t, i, *([] if on else [sk]), s, e, j) for k, t, i in points for sk, s, e, j in spans
        if None not in (t, s, e) and s <= t <= e and (not on or (k is not None and k == sk))
    ]
    found = timejoins.interval_join(a, b, "t", "s", "e", on, width, full)
    assert text(rows(found)) == text(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def shuffled(df):
    """Rows that the exchanges of an executed plan wrote."""

    def written(plan):
        found = plan.metrics().get("shuffleRecordsWritten")
        children = plan.children()
        return (found.get().value() if found.isDefined() else 0) + sum(written(children.apply(i)) for i in range(children.size()))

    return written(df._jdf.queryExecution().executedPlan())


def test_interval_join_sends_a_span_once_to_a_full_bin(spark):
    sent = {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (200, 400):
            a = spark.createDataFrame([(at(i % 10), i) for i in range(n)], "t timestamp, id int")
            b = spark.createDataFrame([(at(i % 10), at(i % 10 + 5), i) for i in range(n // 2)], "s timestamp, e timestamp, sid int")
            found = timejoins.interval_join(a, b, "t", "s", "e", full=5)
            assert len(found.collect()) == n * n // 2 * 45 // 100
            sent[n] = shuffled(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # each point once and each span in at most the three bins of five minutes that it touches
    assert sent[200] <= 200 + 3 * 100 and sent[400] <= 2 * sent[200]


@pytest.mark.parametrize("kind", ["timestamp", "string", "date"])
def test_interval_join_of_bins_dealt_to_tasks(spark, monkeypatch, kind):
    monkeypatch.setattr(timejoins, "FULL", 40)
    monkeypatch.setattr(timejoins, "PAIRS", 100)
    monkeypatch.setattr(timejoins, "RUN", 3)
    points, spans = made(7, 300) + [(0, at(9), -1)] * 5, []
    for i, (k, t, _) in enumerate(made(8, 90)):
        back = timedelta(days=kind == "date")  # a day is its midnight
        spans.append((k, t and t - back, t and t + timedelta(minutes=random.choice([-5, 0, 3, 600])), i))
    a = spark.createDataFrame(points, "k int, t timestamp, id int").withColumn("t", F.col("t").cast(kind))
    b = spark.createDataFrame(spans, "k int, s timestamp, e timestamp, sid int")
    found = timejoins.interval_join(a, b, "t", "s", "e", ["k"], full=10)
    shown = {"date": lambda t: t.date(), "string": str, "timestamp": lambda t: t}[kind]
    level = (lambda t: t.replace(hour=0, minute=0)) if kind == "date" else (lambda t: t)
    want = [
        (k, shown(t), i, s, e, j) for k, t, i in points for sk, s, e, j in spans
        if None not in (k, t, s, e) and k == sk and s <= level(t) <= e
    ]
    assert want and text(rows(found)) == text(want)


def test_multiset_difference(spark):
    random.seed(6)
    pick = lambda n: [(random.choice([None, "", "a", "b:", "-"]), random.choice([None, 1, 2])) for _ in range(n)]
    before, after = pick(200) + [("hot", 0)] * 90, pick(180) + [("hot", 0)] * 90
    a, b = (spark.createDataFrame(x, "x string, n int") for x in (before, after))
    found = tablesets.multiset_difference(a, b)
    want = [(*r, before.count(r), after.count(r)) for r in set(before) | set(after) if before.count(r) != after.count(r)]
    assert text(rows(found)) == text(want)
    less = found.where("n_before > n_after").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("n_before - n_after"))))
    assert text(rows(less.select("x", "n"))) == text(rows(a.exceptAll(b)))
    assert tablesets.multiset_difference(a, a).count() == 0


def test_totals_differ_from_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, v int")
    found = rows(tablesets.rollup(df, ["g"], [F.sum("v").alias("s")]))
    assert text(found) == text([("a", 0, 1), (None, 0, 5), (None, 1, 6)])
    plan = tablesets.cube(df, ["g", "v"], [F.count("*").alias("n")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1


def test_above_group_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, None), (2, 5.0), (None, 9.0), (3, 4.0)], "k int, v double")
    assert rows(tablesets.above_group_mean(df, "k", "v")) == [(1, 3.0, 2.0)]
