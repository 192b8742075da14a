"""Whole tables side by side: several groupings in one scan, differences as multisets, rows against their group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dealt, materialize, materialize_all, parts_of


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """One row per group of every set: the columns, grouping_id and the aggregates.

    Bit i of grouping_id from the left tells that column i is left out, which sets a total apart from the group
    of null values. The rows are expanded in the scan and summed up before they are shuffled.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id(*[F.col(c) for c in columns]).cast("long").alias("grouping_id"), *aggregates)


def rollup(df: DataFrame, columns: list[str], aggregates: list[Column]) -> DataFrame:
    """All prefixes of the columns, from the finest groups to the total."""
    return grouping_sets(df, [columns[:n] for n in range(len(columns), -1, -1)], aggregates)


def cube(df: DataFrame, columns: list[str], aggregates: list[Column]) -> DataFrame:
    """All subsets of the columns."""
    subsets = [[c for i, c in enumerate(columns) if n >> i & 1] for n in range(1 << len(columns))]
    return grouping_sets(df, subsets, aggregates)


def _keyed_by_value(kind: T.DataType) -> bool:
    """Whether a grouping tells the values apart as their texts do; numbers with two zeros and nested ones do not."""
    return isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.DecimalType))


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that the tables do not hold equally often: their columns, n_before and n_after.

    Rows are counted as they are, with one shuffle of both tables, and copies collapse before it (a third of a table
    may be one row). Small tables are read once; large ones are worked off in parts by the hash of a row, so that
    the disk holds the shuffles of one part at a time, and what differs is written. The rows with n_before above n_after, as often as the
    difference, are ``before EXCEPT ALL after``, and the other way round.
    """
    if before.columns != after.columns:
        raise ValueError("the tables have different columns")
    signed = before.withColumns({"__b": F.lit(1), "__a": F.lit(0)}).unionByName(
        after.withColumns({"__b": F.lit(0), "__a": F.lit(1)})
    )
    plain = {f.name: _keyed_by_value(f.dataType) for f in signed.schema}
    keys = [F.col(c) if plain[c] else F.col(c).cast("string").alias(f"__k{i}") for i, c in enumerate(before.columns)]
    shown = [F.any_value(c).alias(c) for c in before.columns if not plain[c]]
    n, parts = parts_of(signed), []
    for part in dealt(signed, _telling(before, plain) if n > 1 else [], n):
        counted = part.groupBy(*keys).agg(F.sum("__b").alias("n_before"), F.sum("__a").alias("n_after"), *shown)
        parts.append(counted.where("n_before <> n_after").select(*before.columns, "n_before", "n_after"))
    return parts[0] if len(parts) == 1 else materialize_all(parts, "difference")[0]


def _telling(df: DataFrame, plain: dict[str, bool], most: int = 2) -> list[Column]:
    """The columns with most different values, which deal rows out as well as all and cost less."""
    told = [F.col(c) if plain[c] else F.col(c).cast("string") for c in df.columns]
    counts = df.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(told)]).first()
    return [told[i] for i in sorted(range(len(told)), key=lambda i: -counts[i])[:most]]


def above_group_mean(df: DataFrame, key: str, value: str, out: str = "group_mean") -> DataFrame:
    """The rows whose value is above the mean of their key, with that mean.

    The correlated form (a mean for each row) becomes one aggregate, written so that its size is known,
    and one join; two scans of the table. A hot key is summed up in parts, and Spark splits its side of the join.
    """
    amount = F.col(value).cast("decimal(28,10)")
    means = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(
        (F.sum(amount).cast("double") / F.count(value)).alias(out)
    )
    means, _ = materialize(means, "means")
    return df.join(means, F.col(key) == F.col("__k")).where(F.col(value) > F.col(out)).drop("__k")
