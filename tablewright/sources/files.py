"""File scans, sinks, named views and row previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import date_columns

# Separators by file extension.
SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": None}
# Names under which one table can be queried.
VIEW_NAMES = ["raw_source", "analytics_data", "raw_dataset", "dataset", "data"]


def _extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def _csv_reader(spark: SparkSession, sep: str = ","):
    return spark.read.options(
        header=True, sep=sep, mode="PERMISSIVE", quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every column as text; malformed rows are kept and an empty cell is null.

    Naming the columns saves the header read.
    """
    reader = _csv_reader(spark)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """With a schema one pass is enough; without one the types are inferred by an extra pass."""
    reader = _csv_reader(spark)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV, TSV or TXT with a header; other extensions are refused.

    The separator of a ``.txt`` file is the most frequent candidate in its first line.
    """
    extension = _extension(path)
    if extension not in SEPARATORS:
        raise ValueError(f"unsupported file format: {path}")
    sep = sep or SEPARATORS[extension]
    if sep is None:
        head = spark.read.text(path).first()
        line = head[0] if head else ""
        sep = max([",", "\t", ";", "|"], key=line.count)
    reader = _csv_reader(spark, sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or delimited text, by extension."""
    return read_parquet(spark, path) if _extension(path) in (".parquet", "") else read_delimited(spark, path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> str:
    df.write.mode(mode).options(
        header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


def write_parquet(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None
) -> str:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def register_views(df: DataFrame, names: list[str] | None = None) -> list[str]:
    """The same table under each name, for ad-hoc SQL."""
    names = names or VIEW_NAMES
    for name in names:
        df.createOrReplaceTempView(name)
    return names


def head_sample(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows with the row count of the whole table beside them."""
    total = df.count()
    return df.orderBy(*order_by).limit(n).withColumn("total_rows", F.lit(total).cast("bigint"))


def preview_rows(df: DataFrame, limit: int = 15, order_by: list[str] | None = None) -> DataFrame:
    """The first rows, dates as ISO texts, nulls kept. Without an order any rows may come."""
    rows = (df.orderBy(*order_by) if order_by else df).limit(limit)
    for c in date_columns(df):
        layout = "yyyy-MM-dd" if isinstance(df.schema[c].dataType, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss"
        rows = rows.withColumn(c, F.date_format(c, layout))
    return rows
