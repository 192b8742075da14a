"""Exact quantiles (linear interpolation) of columns of any size, by narrowing rounds.

A sketch gives cut points around each wanted rank. One grouped count tells how many values lie
below, at and between the cuts; values between two cuts of one rank are counted one by one,
everything else is one row for its gap with its least and largest value. So the gap of each
rank is known exactly, whatever the sketch's error. A gap that holds the rank is cut again, at
evenly spaced values of its own, until it has at most ``FINAL`` different values; only those are
put in order. A round divides a gap by ``CUTS``, so the rounds grow with the logarithm of the
rows. All sizes go this way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import materialize

#: error of the sketch: one part in this many
ACCURACY = 10_000
#: different values of a gap that are put in order at last
FINAL = 10_000
#: parts that a further round cuts a gap into
CUTS = 64


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, accuracy: int = ACCURACY, final: int = FINAL
) -> DataFrame:
    """One row per key: ``n`` (non-null values) and ``quantiles`` (array, same order as ``probs``).

    Null keys are keys of their own. NaN is the largest value, as Spark orders it.
    """
    keys = keys or []
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(1)
    known = df.select(group.alias("__k"), F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    sizes, wanted, counted = _first_round(known, probs, accuracy)
    picked = _narrowed(known, wanted, counted, final)
    arrays, values = F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__at"), []
    position = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    for at in position:
        low, high = F.floor(at), F.ceil(at)
        a, z = F.element_at("__at", low), F.element_at("__at", high)
        values.append(F.when(high == low, a).otherwise((high - at) * a + (at - low) * z))
    whole = sizes.join(picked.groupBy("__k").agg(arrays), "__k")
    return whole.select(
        *[F.col("__k")[k].alias(k) for k in keys], F.col("__n").alias("n"), F.array(*values).alias("quantiles")
    )


def _first_round(known: DataFrame, probs: list[float], accuracy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows per key (__k, __n), the wanted ranks (__k, __rank) and the counts by gap.

    Counts have (__k, __gap, __v, __c, __lo, __hi); __v is null where a gap is one row.
    """
    slack = 3.0 / accuracy
    ends = [e for p in probs for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sizes, _ = materialize(
        known.groupBy("__k").agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, accuracy).alias("__ends")), "sizes"
    )
    v, gap, inside = F.col("__v"), F.lit(0), F.lit(False)
    for i in range(len(probs)):
        low, high = F.col("__ends")[2 * i], F.col("__ends")[2 * i + 1]
        # twice the cuts below and one for a cut that is met: the gaps and the cuts themselves have numbers of their own
        gap = gap + (v > low).cast("int") + (v >= low).cast("int") + (v > high).cast("int") + (v >= high).cast("int")
        inside = inside | ((v > low) & (v < high))
    placed = known.join(sizes.select("__k", "__ends"), "__k").select(
        "__k", gap.alias("__gap"), F.when(inside, v).alias("__v"), v.alias("__x")
    )
    counted, _ = materialize(
        placed.groupBy("__k", "__gap", "__v").agg(F.count("*").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")),
        "counted",
    )
    position = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(at).cast("long") for at in position for f in (F.floor, F.ceil)]))
    return sizes.select("__k", "__n"), sizes.select("__k", F.explode(ranks).alias("__rank")), counted


def _narrowed(known: DataFrame, wanted: DataFrame, counted: DataFrame, final: int) -> DataFrame:
    """(__k, __rank, __value) for all wanted ranks.

    __part names the gap that a rank is known to lie in; __local is its rank there.
    """
    part = F.lit("")
    wanted = wanted.withColumn("__part", part).withColumn("__local", F.col("__rank"))
    counted = counted.withColumn("__part", part)
    found, first = [], True
    while True:
        held, _ = materialize(_located(wanted, counted), "ranks")
        found.append(held.where(F.col("__value").isNotNull()).select("__k", "__rank", "__value"))
        wanted = held.where(F.col("__value").isNull()).select(
            "__k", "__rank", F.concat_ws(".", "__part", F.col("__gap").cast("string")).alias("__inner"),
            (F.col("__local") - F.col("__start")).alias("__local"), "__part", "__gap", "__lo", "__hi", "__missed",
        )
        counts = wanted.agg(F.count("*"), F.count_if(F.col("__missed"))).first()
        if not counts[0]:
            break
        gaps = wanted.select("__k", "__part", "__gap", "__inner", "__lo", "__hi", "__missed").distinct()
        values = counted.drop("__lo", "__hi").join(gaps.where(~F.col("__missed")), ["__k", "__part", "__gap"]).select(
            "__k", F.col("__inner").alias("__part"), "__v", "__c"
        )
        if first and counts[1]:
            # the sketch left the rank outside its cuts, in a gap whose values were not kept: they are read again
            again = known.join(gaps.where(F.col("__missed")), "__k").where(
                (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
            )
            values = values.unionByName(again.groupBy("__k", F.col("__inner").alias("__part"), "__v").agg(F.count("*").alias("__c")))
        values, _ = materialize(values, "gaps")
        wanted = wanted.drop("__part").withColumnRenamed("__inner", "__part").select("__k", "__rank", "__part", "__local")
        sizes = values.groupBy("__k", "__part").agg(
            F.count("*").alias("__rows"), F.percentile_approx("__v", [i / CUTS for i in range(CUTS + 1)], 50 * CUTS).alias("__cuts")
        )
        sizes, _ = materialize(sizes, "cuts")
        first = False
        few = sizes.where(F.col("__rows") <= final).select("__k", "__part")
        found.append(_ordered(wanted, values.join(few, ["__k", "__part"])))
        many = sizes.where(F.col("__rows") > final)
        if not many.limit(1).count():
            break
        wanted = wanted.join(many.select("__k", "__part"), ["__k", "__part"])
        cut = values.join(many, ["__k", "__part"])
        below = F.size(F.filter("__cuts", lambda c: c < F.col("__v"))) + F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))
        counted, _ = materialize(cut.select(
            "__k", "__part", below.alias("__gap"), "__v", "__c", F.col("__v").alias("__lo"), F.col("__v").alias("__hi")
        ), "counted")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _located(wanted: DataFrame, counted: DataFrame) -> DataFrame:
    """Each wanted rank with its gap (__gap, __start, __lo, __hi, __missed) and its __value if the gap tells it.

    The window runs over the gaps of a part, as many as there are cuts.
    """
    gaps = counted.groupBy("__k", "__part", "__gap").agg(
        F.sum("__c").alias("__c"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"),
        F.bool_and(F.col("__v").isNull()).alias("__missed"),
    )
    order = Window.partitionBy("__k", "__part").orderBy("__gap")
    placed = gaps.withColumn("__end", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("__end") - F.col("__c")
    at, low, high = F.col("__local"), F.col("__lo"), F.col("__hi")
    value = F.when((low == high) | (at == start), low).when(at == F.col("__end") - 1, high)
    return placed.withColumn("__start", start).join(wanted, ["__k", "__part"]).where(
        (at >= F.col("__start")) & (at < F.col("__end"))
    ).select("__k", "__part", "__rank", "__local", "__gap", "__start", "__lo", "__hi", "__missed", value.alias("__value"))


def _ordered(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """The ranks in parts of few different values, by putting these in order."""
    order = Window.partitionBy("__k", "__part").orderBy("__v")
    placed = values.withColumn("__end", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(wanted, ["__k", "__part"]).where(
        (F.col("__local") < F.col("__end")) & (F.col("__local") >= F.col("__end") - F.col("__c"))
    ).select("__k", "__rank", F.col("__v").alias("__value"))


def column_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], accuracy: int = ACCURACY, final: int = FINAL
) -> dict[str, list[float] | None]:
    """Quantiles per column as numbers on the driver: one small row per column; None if all null."""
    if not columns:
        return {}
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = typed.unpivot([], columns, "__column", "__value")
    found = exact_quantiles(long, "__value", probs, ["__column"], accuracy, final).collect()
    by_column = {r["__column"]: r["quantiles"] for r in found}
    return {c: by_column.get(c) for c in columns}
