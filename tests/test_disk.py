"""Disk: shuffle files and steps go when nothing reads them, and large tables are shuffled in parts with the same rows."""

import collections
import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from registry import inputs
from tablewright import session
from tablewright.operators import order, profile, tablesets
from tablewright.plans import cleaning, featuring

from test_growth import TABLES, _write


@pytest.fixture(params=[1, 4])
def parts(request, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 1 if request.param > 1 else 1 << 40)
    return request.param


def _all(df):
    return sorted(map(str, df.collect()))


def _left(spark, build):
    """What build() gives, and the names of the folders it has left."""
    folder = session.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    return build(), [f.split("-", 1)[1] for f in set(os.listdir(folder)) - before]


def test_shuffle_files_go_when_a_step_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: disk.getAllFiles().toString().count("shuffle_")
    before = held()
    session.materialize(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count())
    end = time.time() + 10
    while held() > before and time.time() < end:
        time.sleep(0.2)
    assert held() <= before
    assert spark.conf.get(session.RELEASE) == "false"


DIRTY = [
    (None if i % 11 == 0 else f"T{i % 40}", str(1 + i % 7) if i % 5 else None, f"2024-01-{1 + i % 28:02}" if i % 3 else "none",
     ["north", "Nort", " South ", None][i % 4])
    for i in range(120)
]


def test_cleaning_keeps_the_last_table_only(spark, tmp_path, parts, monkeypatch):
    rows = spark.createDataFrame(DIRTY + DIRTY[:30], "id string, quantity string, order_date string, region string")
    rows.write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    run, left = _left(spark, lambda: cleaning.clean_pipeline(raw, ["id"], ["id", "quantity"], spent=[f"{tmp_path}/raw"]))
    assert not {"distinct.parquet", "keyed.parquet", "ruled.parquet", "ranges.parquet"} & set(left)
    assert not os.path.exists(f"{tmp_path}/raw") and len(run.scratch) == 1
    found = [_all(x) for x in (run.cleaned, run.audit, run.before_after, run.scorecard, run.recommendations())]
    monkeypatch.setattr(session, "PART_BYTES", 1 << 40)
    whole = cleaning.clean_pipeline(rows, ["id"], ["id", "quantity"])
    assert found == [_all(x) for x in (whole.cleaned, whole.audit, whole.before_after, whole.scorecard, whole.recommendations())]
    assert run.cleaned.count() == 41 and run.before_after.first()["before_rows"] == 150


def test_orders_in_parts(spark, tmp_path, parts):
    day = datetime.date(2024, 1, 1)
    for key, kind in ((lambda i: f"k{i % 50:03}" if i % 9 else None, "string"), (lambda i: i % 50 if i % 9 else None, "long"),
                      (lambda i: day + datetime.timedelta(i % 50), "date"), (lambda i: float(i % 50), "double")):
        rows = [(key(i), i, float(i % 7) if i % 4 else None) for i in range(400)]
        spark.createDataFrame(rows, f"k {kind}, i long, x double").write.mode("overwrite").parquet(f"{tmp_path}/t")
        df, made = spark.read.parquet(f"{tmp_path}/t"), []
        assert order.parts_of(df) == parts
        for run in (lambda **a: order.running_total(df, "x", ["k"], **a), lambda **a: order.forward_fill(df, ["x"], ["k"], **a)):
            found, left = _left(spark, lambda: run(made=made))
            assert _all(found) == _all(run()) and "ranges.parquet" not in left
        assert len(made) == 2


def test_features_in_parts(spark, tmp_path, parts):
    rows = [(i, float(i % 13) if i % 10 else None, datetime.date(2024, 1, 1 + i % 28), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, sales double, order_date date, region string")
    df.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    result, left = _left(spark, lambda: featuring.feature_pipeline(read, "full", ["id"], spent=[f"{tmp_path}/t"]))
    assert "ranges.parquet" not in left and not os.path.exists(f"{tmp_path}/t")
    table = _all(result.table)
    whole = featuring.feature_pipeline(df, "full", ["id"])
    assert table == _all(whole.table) and result.table.columns == whole.table.columns
    assert _all(result.catalog(result.scratch)) == _all(whole.catalog())
    assert not os.path.exists(result.scratch[0])


def test_difference_and_counts_in_parts(spark, tmp_path, parts):
    rows = [(i % 60, None if i % 7 == 0 else "x" * (i % 9), 0.0 if i % 2 else -0.0, [i % 3]) for i in range(500)]
    schema = "i int, t string, x double, l array<int>"
    for name, some in (("before", rows), ("after", rows[100:] + rows[:50] * 2)):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}")
    before, after = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("before", "after"))
    found = tablesets.multiset_difference(before, after)
    a, b = (collections.Counter(map(str, x.collect())) for x in (before, after))
    want = sorted((r, a[r], b[r]) for r in a | b if a[r] != b[r])
    assert sorted((str(r.__class__(**{c: r[c] for c in before.columns})), r.n_before, r.n_after) for r in found.collect()) == want
    assert ("Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()) == (parts == 1)
    counts = {r[0]: r[1] for r in profile.distinct_counts(before.withColumn("u", F.lit(None).cast("int"))).collect()}
    assert counts == {"i": 60, "t": 10, "x": 2, "l": 3, "u": 1} or counts == {"i": 60, "t": 10, "x": 1, "l": 3, "u": 1}


def test_dirty_parts_are_the_dirty_table(spark, tmp_path, parts):
    _write(spark, tmp_path)
    made = inputs.dirty_parts(spark, str(tmp_path))
    assert len(made) == parts and len(TABLES) == 6
    rows = [r for part in made for r in _all(part)]
    assert sorted(rows) == _all(inputs.dirty_sales(spark, str(tmp_path)))
