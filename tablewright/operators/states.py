"""Column profiles that are kept as states and merged, so that a new day costs a scan of that day only.

A state is one row per partition value and column: counts, exact power sums of shifted values, least
and largest value, and two sketches as bytes (HyperLogLog for distinct values, KLL for
quantiles). States of any partitions merge into the state of all their rows without reading these again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: registers of the distinct sketch (2 to the power of it; standard error about 1.04 / sqrt of it), size of the quantile sketch
LG_REGISTERS, KLL_SIZE = 14, 400
_EXACT = "decimal(38,12)"


def column_states(df: DataFrame, columns: list[str], by: list[Column] | None = None, shift: dict[str, float] | None = None) -> DataFrame:
    """One row per value of ``by`` and numeric column.

    column_name, n_rows, n_known, s1 and s2 (exact sums of v - shift and its square, v rounded to six digits),
    shift, least, largest, distinct_sketch, quantile_sketch. Shifts keep squares small; states merge only if
    they have the same. NaN counts as a missing value.
    """
    shift = shift or {}
    long = df.select(
        *(by or []),
        F.explode(F.array(*[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(float(shift.get(c, 0.0))).alias("shift"),
                F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v"),
            ) for c in columns
        ])).alias("e"),
    )
    names = long.columns[:-1]
    d = (F.col("v") - F.col("shift")).cast("decimal(18,6)")
    return long.select(*names, "e.*").groupBy(*names, "column_name", "shift").agg(
        F.count("*").alias("n_rows"), F.count("v").alias("n_known"),
        F.sum(d).cast(_EXACT).alias("s1"), F.sum(d * d).cast(_EXACT).alias("s2"),
        F.min("v").alias("least"), F.max("v").alias("largest"),
        F.hll_sketch_agg(F.xxhash64("v"), LG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double("v", KLL_SIZE).alias("quantile_sketch"),
    )


def merged(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The states of larger groups: one row per value of ``by`` (all rows if empty) and column."""
    return states.groupBy(*(by or []), "column_name", "shift").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_known").alias("n_known"),
        F.sum("s1").cast(_EXACT).alias("s1"), F.sum("s2").cast(_EXACT).alias("s2"),
        F.min("least").alias("least"), F.max("largest").alias("largest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", KLL_SIZE).alias("quantile_sketch"),
    )


def profiles(states: DataFrame, probs: list[float] | None = None) -> DataFrame:
    """The states read out: counts, missing_pct, mean, std (ddof 1), least, largest, distinct_estimate, quantile estimates.

    mean and std are exact for the rounded values; a column without values has nulls.
    """
    n = F.col("n_known")
    spread = F.col("s2").cast("double") - F.col("s1").cast("double") * F.col("s1").cast("double") / n
    keys = [c for c in states.columns if c not in ("shift", "s1", "s2", "distinct_sketch", "quantile_sketch")]
    some = n > 0
    return states.select(
        *keys, F.round((1 - n / F.col("n_rows")) * 100, 2).alias("missing_pct"),
        F.when(some, F.col("s1").cast("double") / n + F.col("shift")).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("std"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        *[F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p)))).alias(f"p{round(p * 100)}") for p in probs or []],
    )
