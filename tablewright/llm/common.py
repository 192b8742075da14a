"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import scratch_path

#: a word, as the contracts of the queries define it
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (tests on one machine) the path lies in a temporary folder;
    any other master without the setting is an error. What is there goes when the session ends.
    """
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], name: str) -> str:
    """A column name that no column in ``taken`` has, whatever its case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``name``, their number from 0 in the given order.

    Rows are dealt over sorted ranges; a row's number is its place in the range plus the rows of
    the ranges before, so no task holds more than a range. Rows that are equal in the order are
    numbered as they come.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )  # one row per partition
    inside = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return inside.join(F.broadcast(starts), "__part").withColumn(
        name, (F.col("__start") + F.col("__row") - 1).cast("long")
    ).drop("__part", "__row", "__start")
