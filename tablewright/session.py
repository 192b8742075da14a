"""Spark session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: the JVM never compiles a method above 8000 bytes, and its interpreter takes many times as long; Spark
#: by default fuses wide projections into one such method, below this limit it splits them
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


#: Spark removes the shuffle files of an action when it ends, and not when the driver's garbage is collected
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: a table is shuffled in parts of about so many bytes of its files, but in at most so many parts
PART_BYTES, MOST_PARTS = 128 << 20, 4


def limit_methods(spark: SparkSession) -> None:
    """Lets a session that still has Spark's default keep generated methods to what the JVM compiles."""
    if spark.conf.get(METHOD_LIMIT, "65535") == "65535":
        spark.conf.set(METHOD_LIMIT, METHOD_BYTES)


def build_session(app_name: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset, so that spark-submit decides, and size
    ``spark.sql.shuffle.partitions`` for the data; AQE merges small partitions again.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT: METHOD_BYTES,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only when the setting is absent (tests, a laptop) a temporary folder is made
    and registered as the checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="tablewright-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the session ends."""
    path = os.path.join(shared_dir(spark), f"{uuid.uuid4().hex}-{name}")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Of tables made and run inside, the shuffle files go when their action ends."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes folders that ``materialize`` has written and nothing reads any more."""
    for path in paths:
        files, place = _files(spark, path)
        files.delete(place, True)


def materialize(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """Write the table to the shared folder and read it back.

    Later steps read only the columns they need, and a lost executor costs its tasks, not
    the steps before. The path is removed at the end of the session, or by the caller before.
    """
    return materialize_all([df], name)


def materialize_all(parts: list[DataFrame], name: str = "step") -> tuple[DataFrame, str]:
    """The rows of all parts in one folder; a part is written when the shuffle files of the one before are gone."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, f"{name}.parquet")
    with released(spark):
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path), path


def parts_of(*tables: DataFrame) -> int:
    """In how many parts to shuffle tables: by the size of the files they read, one where Spark knows none."""
    size = 0
    for t in tables:
        leaves = t._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
        size += sum(s for s in sizes if s < 1 << 60)
    return max(1, min(MOST_PARTS, -(-size // PART_BYTES)))


def dealt(df: DataFrame, by: list[Column], n: int) -> list[DataFrame]:
    """The table in ``n`` parts; rows that are equal in ``by`` are in one part."""
    if n == 1:
        return [df]
    place = F.pmod(F.xxhash64(F.lit(7), *by), F.lit(n))  # not the hash that deals a part out to tasks
    return [df.where(place == i) for i in range(n)]


def materialize_parts(df: DataFrame, by: str, n: int, name: str = "parts") -> list[DataFrame]:
    """Write the table once, with a folder for each value 0 to n - 1 of the column ``by``, and read each alone.

    Spark then knows the size of every part before it joins it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}.parquet")
    with released(spark):
        df.write.partitionBy(by).parquet(path)
    rest = df.drop(by)
    files, _ = _files(spark, path)
    parts = []
    for i in range(n):
        folder = f"{path}/{by}={i}"
        there = files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
        parts.append(spark.read.schema(rest.schema).parquet(folder) if there else rest.limit(0))
    return parts
