"""Joins by time and sessions, for keys of any size.

As-of join and sessions put their rows in one order of (key, time) and deal them over sorted
ranges (``order.ranged``), so that a key with a third of all rows fills many ranges; what a range
needs from the ones before is carried over from a table with one row per range. The interval
join meets points and spans in bins of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .order import RANGE, _earlier, ranged

#: points of a bin that one task compares with the bin's spans
FULL = 20_000
#: most pairs of a point and a span that one task compares in a bin
PAIRS = 50_000_000
#: most points that meet a span as one row
RUN = 500


def _carried(cut: DataFrame, value: Column, position: Column) -> DataFrame:
    """(RANGE, __carry): the last value that is not null in the ranges before, one row per range."""
    lasts = cut.groupBy(RANGE).agg(F.max_by(value, F.when(value.isNotNull(), position)).alias("__last"))
    return F.broadcast(lasts.select(RANGE, F.last("__last", ignorenulls=True).over(_earlier()).alias("__carry")))


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, prefix: str = "", buckets: int | None = None
) -> DataFrame:
    """Every left row with the last right row of the same key at or before its time, else nulls.

    Of right rows at one time the one that comes last in the order of its columns counts. Null keys and null
    times match nothing. The right columns but the keys come last, with ``prefix`` before their names.
    """
    chosen = [c for c in right.columns if c not in on]
    names = [f"{prefix}{c}" for c in chosen]
    clash = set(names) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides, give a prefix: {sorted(clash)}")
    value = F.struct(*[F.col(c) for c in chosen])
    row = F.struct(*[F.col(c) for c in left.columns])
    keys = [f"__k{i}" for i in range(len(on))]
    whole = lambda df, time: [F.col(c).isNotNull() for c in on] + [F.col(time).isNotNull()]

    def every(conditions: list[Column]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & c
        return out

    marked = [F.col(c).alias(k) for c, k in zip(on, keys)]
    kind, shape = left.select(row.alias("r")).schema["r"].dataType, right.select(value.alias("v")).schema["v"].dataType
    rights = right.where(every(whole(right, right_time))).select(
        *marked, F.col(right_time).cast("timestamp").alias("__t"), F.lit(0).alias("__side"), value.alias("__value"),
        F.lit(None).cast(kind).alias("__row"), F.lit(0).cast("long").alias("__tie"),
    )
    lefts = left.where(every(whole(left, left_time))).select(
        *marked, F.col(left_time).cast("timestamp").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(shape).alias("__value"),
        row.alias("__row"), F.xxhash64(*left.columns).alias("__tie"),
    )
    order = [*keys, "__t", "__side", "__value", "__tie"]
    cut = ranged(rights.unionByName(lefts), order, buckets)
    last = F.when(F.col("__side") == 0, F.struct(*keys, "__value"))
    carried = _carried(cut, last, F.struct(*keys, "__t", "__value"))
    local = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, RANGE).withColumn("__found", F.coalesce(F.last(last, ignorenulls=True).over(local), F.col("__carry")))
    mine = every([F.col("__found")[k] == F.col(k) for k in keys])
    found = F.when(mine, F.col("__found")["__value"])
    matched = joined.where(F.col("__side") == 1).select("__row.*", *[found[c].alias(n) for c, n in zip(chosen, names)])
    rest = left.where(~every(whole(left, left_time))).select(
        *left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in zip(chosen, names)]
    )
    return matched.unionByName(rest)


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int, buckets: int | None = None) -> DataFrame:
    """One row per session: key, session_start, session_end, n_rows.

    A session goes on while the next row of the key is at most ``gap_seconds`` later. Null keys and
    null times belong to none.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("__k"), F.col(time).cast("timestamp").alias("__t"), F.monotonically_increasing_id().alias("__tie")
    )
    order = ["__k", "__t", "__tie"]
    cut = ranged(rows, order, buckets)
    here = F.struct("__k", "__t")
    before = F.coalesce(F.lag(here).over(Window.partitionBy(RANGE).orderBy(*order)), F.col("__carry"))
    apart = F.unix_micros("__t") - F.unix_micros(F.col("__before")["__t"]) > gap_seconds * 1_000_000
    first = F.col("__before").isNull() | (F.col("__before")["__k"] != F.col("__k")) | apart
    marked, _ = materialize(
        cut.join(_carried(cut, here, here), RANGE).withColumn("__before", before).select(*order, RANGE, first.cast("int").alias("__first")),
        "islands",
    )
    starts = marked.groupBy(RANGE).agg(F.sum("__first").alias("__n")).select(
        RANGE, F.coalesce(F.sum("__n").over(_earlier()), F.lit(0)).alias("__islands")
    )
    local = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.join(F.broadcast(starts), RANGE).withColumn("__island", F.col("__islands") + F.sum("__first").over(local))
    # an island may reach over ranges: its parts are summed up before they meet
    return numbered.groupBy("__k", "__island").agg(
        F.min("__t").alias("session_start"), F.max("__t").alias("session_end"), F.count("*").alias("n_rows")
    ).select(F.col("__k").alias(key), "session_start", "session_end", "n_rows")


def interval_join(
    points: DataFrame, spans: DataFrame, time: str, start: str, end: str, on: list[str] | None = None,
    width_seconds: float | None = None, full: int = FULL,
) -> DataFrame:
    """Points and spans of the same keys with ``start <= time <= end``; columns of both, the spans' keys once.

    A span is posted in every bin of time that it touches and a point in its own. Bins are as wide
    as the spans are on average (or ``width_seconds``), so all postings are about twice the spans. If a
    bin has more than ``full`` points, points meet the spans as runs of at most that many, each a row of points that
    follow one another in time: a span is sent to a bin once and not to each part of its points, and only the
    points of runs at its ends are compared with it. A bin is dealt by hash to more tasks, and its spans copied to each, when
    one task would compare too much. Null keys and times match nothing, nor do spans that end before they start.
    """
    on = on or []
    clash = (set(points.columns) & set(spans.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = lambda c: micros(c) / F.lit(1e6)
    held = spans.where(F.col(start) <= F.col(end))
    width = width_seconds
    if width is None:
        width = held.agg(F.avg(seconds(end) - seconds(start))).first()[0]
    width = max(float(width or 0), 1.0)
    bin_of = lambda c: F.floor(seconds(c) / F.lit(width)).cast("long")
    keys = [*on, "__bin"]
    keyed = points.where(F.col(time).isNotNull()).withColumn("__bin", bin_of(time))
    posted = held.withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    for c in on:
        keyed, posted = keyed.where(F.col(c).isNotNull()), posted.where(F.col(c).isNotNull())
    within = lambda t: (t >= F.col(start)) & (t <= F.col(end))
    busy, _ = materialize(keyed.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > full), "bins")
    if busy.isEmpty():
        met = keyed.join(posted, keys).where(within(F.col(time)))
        return met.select(*points.columns, *[c for c in spans.columns if c not in on])
    size = min(full, RUN)
    pairs = F.col("__n").cast("double") * F.col("__m")
    tasks = F.least(F.ceil(F.col("__n") / size), F.greatest(F.ceil(F.col("__n") / FULL), F.ceil(pairs / PAIRS))).cast("int")
    met = busy.join(posted.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
    dealing, _ = materialize(met.select(*keys, tasks.alias("__tasks")).where("__tasks > 1"), "dealing")
    parts = F.coalesce("__tasks", F.lit(1))
    dealt = keyed.join(dealing, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*points.columns), parts).cast("int"))
    place, rest = [*keys, "__part"], [c for c in spans.columns if c not in on]
    # a number of its own, as few bytes make many pairs and partitions must not be merged by their size
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    follow = F.row_number().over(Window.partitionBy(*place).orderBy(time))
    runs = dealt.repartition(n, *place).withColumn("__run", F.floor((follow - 1) / size)).groupBy(*place, "__run").agg(
        F.min(time).alias("__first"), F.max(time).alias("__last"), F.collect_list(F.struct(*points.columns)).alias("__points")
    )
    copied = posted.join(dealing, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__tasks")
    near, inside = copied.repartition(n, *place).join(runs, place), F.lit(False)
    # values of one type are ordered as they are compared
    if len({points.schema[time].dataType, spans.schema[start].dataType, spans.schema[end].dataType}) == 1:
        near = near.where((F.col("__first") <= F.col(end)) & (F.col("__last") >= F.col(start)))
        inside = within(F.col("__first")) & within(F.col("__last"))
    found = near.select(F.explode("__points").alias("__point"), inside.alias("__inside"), *rest).where(
        F.col("__inside") | within(F.col("__point")[time])
    )
    return found.select(*[F.col("__point")[c].alias(c) for c in points.columns], *rest)
