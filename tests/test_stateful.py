"""Windows and deduplication on a stream that arrives in parts, and states that are merged."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablewright.operators import states
from tablewright.streaming import windows

START = datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp, k string"


def at(minutes):
    return START + timedelta(minutes=minutes)


class Arrivals:
    """Rows arrive as files one after another, each a micro-batch of its own."""

    def __init__(self, spark, folder):
        self.spark, self.source = spark, str(folder / "in")
        self.out, self.checkpoint = str(folder / "out"), str(folder / "checkpoint")
        os.makedirs(self.source)

    def arrive(self, data, build):
        self.spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.source)
        assert windows.append(build(stream), self.out, self.checkpoint).awaitTermination(120)
        return self.spark.read.schema(build(stream).schema).parquet(self.out)


def counts(df):
    return windows.windowed(df, "ts", ["k"], [F.count("*").alias("n")], "10 minutes", delay="5 minutes")


def test_late_rows_are_dropped_by_rule(spark, tmp_path):
    part = Arrivals(spark, tmp_path)
    assert part.arrive([(1, at(1), "a"), (2, at(9), "a"), (3, at(2), None)], counts).count() == 0
    # 14 minutes: the watermark is at 9, so the first window is open and a row of minute 3 counts
    assert part.arrive([(4, at(14), "a")], counts).count() == 0
    found = part.arrive([(5, at(3), "a"), (6, at(16), "b")], counts)
    first = (at(0), at(10))
    assert sorted(map(str, rows(found))) == sorted(map(str, [(*first, "a", 3), (*first, None, 1)]))
    # the watermark has passed 10: the window is closed, and each arrival was a new start from the checkpoint
    found = part.arrive([(7, at(4), "a"), (8, at(40), "a")], counts)
    second = (at(10), at(20))
    want = [(*first, "a", 3), (*first, None, 1), (*second, "a", 1), (*second, "b", 1)]
    assert sorted(map(str, rows(found))) == sorted(map(str, want))


def test_windows_on_a_batch(spark):
    df = spark.createDataFrame([(1, at(1), "a"), (2, at(12), "a"), (3, None, "a")], SCHEMA)
    sliding = windows.windowed(df, "ts", [], [F.count("*").alias("n")], "10 minutes", "5 minutes")
    assert rows(sliding, "window_start") == [(at(-5), at(5), 1), (at(0), at(10), 1), (at(5), at(15), 1), (at(10), at(20), 1)]
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="delay"):
        windows.windowed(stream, "timestamp", [], [F.count("*").alias("n")], "1 hour")


def test_deduplication_goes_on_after_a_restart(spark, tmp_path):
    once = lambda df: windows.deduplicated(df, ["id"], "ts", "30 minutes")
    part = Arrivals(spark, tmp_path)
    part.arrive([(1, at(0), "first"), (1, at(1), "first"), (2, at(5), "x")], once)
    found = part.arrive([(1, at(10), "again"), (3, at(20), "y")], once)  # a new query on the old state
    assert sorted((r.id, r.k) for r in found.collect()) == [(1, "first"), (2, "x"), (3, "y")]
    part.arrive([(4, at(200), "z")], once)  # the state of the others leaves
    found = part.arrive([(2, at(190), "new")], once)
    assert sorted((r.id, r.k) for r in found.collect()) == [(1, "first"), (2, "new"), (2, "x"), (3, "y"), (4, "z")]
    batch = once(spark.createDataFrame([(1, at(0), "a"), (1, at(0), "a")], SCHEMA))
    assert batch.count() == 1


@pytest.fixture(scope="module")
def values(spark):
    n = 60_000
    v = F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id"), F.lit(20_000)) / 8.0)
    nan = F.when(F.col("id") % 1000 == 7, F.lit(float("nan"))).otherwise(v)
    return spark.range(n).select(F.pmod("id", F.lit(9)).alias("day"), nan.alias("v"), (F.col("id") + 1e6).alias("big"), F.lit(None).cast("double").alias("none"))


COLUMNS = ["v", "big", "none"]


def test_merged_states_equal_one_pass(spark, values, tmp_path):
    daily = states.column_states(values, COLUMNS, [F.col("day")], {"big": 1e6})
    daily.write.parquet(str(tmp_path / "states"))  # kept, as bytes and numbers
    kept = spark.read.parquet(str(tmp_path / "states"))
    exact = ["column_name", "n_rows", "n_known", "missing_pct", "mean", "std", "least", "largest"]
    once = rows(states.profiles(states.column_states(values, COLUMNS, None, {"big": 1e6})).select(*exact), "column_name")
    merged = rows(states.profiles(states.merged(kept)).select(*exact), "column_name")
    weeks = states.merged(kept.withColumn("week", F.col("day") % 2), ["week"])
    assert merged == once == rows(states.profiles(states.merged(weeks)).select(*exact), "column_name")
    pd = values.toPandas()
    for name, n, known, missing, mean, std, least, largest in once:
        have = pd[name].dropna()
        assert (n, known) == (len(pd), len(have))
        if len(have):
            assert np.allclose([mean, std, least, largest], [have.mean(), have.std(ddof=1), have.min(), have.max()], rtol=1e-9)
        else:
            assert (mean, std, least, largest) == (None, None, None, None)


def test_sketch_errors(values):
    """Distinct values within three standard errors, quantiles within one part in a hundred of the rank."""
    daily = states.column_states(values, ["v", "big"], [F.col("day")])
    found = {r.column_name: r for r in states.profiles(states.merged(daily), [0.25, 0.5, 0.99]).collect()}
    pd = values.toPandas()
    for c in ("v", "big"):
        have = pd[c].dropna()
        assert abs(found[c].distinct_estimate / have.nunique() - 1) < 3 * 1.04 / 2 ** (states.LG_REGISTERS / 2)
        for p in (25, 50, 99):
            rank = (have <= found[c][f"p{p}"]).mean()
            assert abs(rank - p / 100) < 0.01, (c, p, rank)


def test_states_of_an_empty_table(values):
    found = states.profiles(states.merged(states.column_states(values.limit(0), ["v"])), [0.5])
    assert found.count() == 0
