"""Global order without one partition.

``Window.orderBy`` without ``partitionBy`` moves a whole table into one task. The functions
here deal the rows over sorted ranges (Spark samples whole key values of any type for the
cuts), write them once with the number of their range, order each range by itself, and add
what lies in earlier ranges from a table with one row per range. There are as many ranges as
``spark.sql.shuffle.partitions`` says, so their size is set like that of any shuffle.

Every order ends with the remaining columns of the table, so it is total up to rows that are
equal throughout, and a value that fills many ranges is split by them. Its rank follows from
the ranges it begins and ends in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import half_up, money, money_rest
from ..session import dealt, drop, materialize, materialize_all, materialize_parts, parts_of

RANGE = "__range"
#: rows, by the hash of the whole row, that tell where to cut a table in parts
CUT_ROWS = 1000


def tie_breaks(df: DataFrame, order_by: list[str]) -> list[str]:
    """The columns that make an order total: those not named, as far as they can be sorted."""
    return [
        f.name for f in df.schema
        if f.name not in order_by and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]


def _in_order(df: DataFrame, key: str, n: int, source: DataFrame | None = None) -> list[DataFrame]:
    """The table in up to ``n`` parts that follow one another in the order of the column, null first."""
    if n == 1 or not isinstance(df.schema[key].dataType, (T.StringType, T.IntegralType, T.DateType)):
        return [df]
    c = F.col(f"`{key}`")
    source = df if source is None else source
    plain = [f.name for f in source.schema if f.name in tie_breaks(source, []) and isinstance(f.dataType, T.AtomicType)]
    hashed = F.xxhash64(*[F.col(f"`{x}`") for x in plain])
    some = source.where(c.isNotNull()).select(c.alias("key"), hashed.alias("hash")).orderBy("hash").limit(CUT_ROWS)
    values = some.agg(F.sort_array(F.collect_list("key"))).first()[0]
    cuts = sorted({i * len(values) // n for i in range(1, n)} - {0})
    ends = list(dict.fromkeys(values[i] for i in cuts))
    if not ends:
        return [df]
    inner = [df.where((c >= F.lit(low)) & (c < F.lit(high))) for low, high in zip(ends, ends[1:], strict=False)]
    return [df.where(c.isNull() | (c < F.lit(ends[0]))), *inner, df.where(c >= F.lit(ends[-1]))]


def ranged(df: DataFrame, order: list[Column | str], buckets: int | None = None, parts: int = 1) -> DataFrame:
    """The rows with ``RANGE``; ranges follow one another in the given order."""
    return _ranged(df, order, buckets, parts)[0]


def _ranged(
    df: DataFrame, order: list[Column | str], buckets: int | None, parts: int, source: DataFrame | None = None
) -> tuple[DataFrame, str, int]:
    """``ranged``, its folder and a bound of the ranges' numbers; parts are shuffled one after another."""
    n = max(2, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = _in_order(df, order[0], parts, source) if isinstance(order[0], str) else [df]
    own = max(2, -(-n // len(each)))
    cut = [
        part.repartitionByRange(own, *order).withColumn(RANGE, F.spark_partition_id() + F.lit(i * own))
        for i, part in enumerate(each)
    ]
    return *materialize_all(cut, "ranges"), own * len(each)


def _by_ranges(cut: DataFrame, bound: int, parts: int) -> list[DataFrame]:
    """The ranged table in ``parts``, neighbouring ranges together."""
    ends = [i * bound // parts for i in range(parts + 1)]
    return [cut.where((F.col(RANGE) >= low) & (F.col(RANGE) < high)) for low, high in zip(ends, ends[1:], strict=False)]


def _earlier() -> Window:
    # over a table with one row per range
    return Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def running_total(
    df: DataFrame, value: str, order_by: list[str], out: str | None = None, digits: int = 2, buckets: int | None = None,
    made: list[str] | None = None, spent: list[str] | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """Cumulative sum in the order of ``order_by``, then of the remaining columns.

    With ``made`` the table is written, in parts by its size, and its folder added; folders ``spent`` by the
    table as it came go as soon as its rows are in ranges. ``source`` may name an earlier table with the same
    values in the first column of the order, which tells where to cut.
    """
    out = out or f"running_cumulative_{value}"
    keys = [*order_by, *tie_breaks(df, order_by)]
    parts = 1 if made is None else parts_of(df)
    cut, path, bound = _ranged(df, keys, buckets, parts, source)
    drop(df.sparkSession, *(spent or []))
    amount, rest = money(F.col(value)), money_rest(F.col(value))
    sums = cut.groupBy(RANGE).agg(F.sum(amount).alias("__sum"), F.sum(rest).alias("__rest"))
    offsets = sums.select(
        RANGE, F.coalesce(F.sum("__sum").over(_earlier()), F.lit(0)).cast("decimal(36,10)").alias("__before"),
        F.coalesce(F.sum("__rest").over(_earlier()), F.lit(0.0)).alias("__rest_before"),
    )
    local = Window.partitionBy(RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.sum(amount).over(local), F.lit(0)).cast("decimal(36,10)") + F.col("__before")
    more = F.sum(rest).over(local) + F.col("__rest_before")
    shown = F.when(more == 0, half_up(total, digits)).otherwise(half_up(total.cast("double") + more, digits))
    result = [*df.columns, F.when(F.col(value).isNotNull(), shown).alias(out)]
    if made is None:
        return cut.join(F.broadcast(offsets), RANGE).select(*result)
    return _written(cut, path, offsets, bound, parts, result, made)


def _written(
    cut: DataFrame, path: str, carried: DataFrame, bound: int, parts: int, result: list, made: list[str]
) -> DataFrame:
    """The columns ``result`` of the ranges and what is carried to them, written; the ranges go."""
    carried, small = materialize(carried, "carried")  # one row per range, read by every part
    pieces = [part.join(F.broadcast(carried), RANGE).select(*result) for part in _by_ranges(cut, bound, parts)]
    done, folder = materialize_all(pieces, "ordered")
    drop(cut.sparkSession, path, small)
    made.append(folder)
    return done


def previous(df: DataFrame, value: str, order_by: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """The value of the row before in the order of ``order_by``, then of the remaining columns."""
    keys = [*order_by, *tie_breaks(df, order_by)]
    cut = ranged(df, keys, buckets)
    lasts = cut.groupBy(RANGE).agg(F.max_by(F.struct(value), F.struct(*keys)).alias("__last"))
    carried = lasts.select(RANGE, F.lag("__last").over(Window.orderBy(RANGE)).getField(value).alias("__carry"))
    local = Window.partitionBy(RANGE).orderBy(*keys)
    joined = cut.join(F.broadcast(carried), RANGE)  # one row per range
    before = F.when(F.row_number().over(local) == 1, F.col("__carry")).otherwise(F.lag(value).over(local))
    return joined.select(*df.columns, before.alias(out))


def forward_fill(
    df: DataFrame, columns: list[str], order_by: list[str], buckets: int | None = None, made: list[str] | None = None,
    spent: list[str] | None = None,
) -> DataFrame:
    """Replace nulls by the last value before them in the order of ``order_by``, then of the remaining columns.

    ``made`` and ``spent`` as in ``running_total``.
    """
    keys = [*order_by, *tie_breaks(df, order_by)]
    parts = 1 if made is None else parts_of(df)
    cut, path, bound = _ranged(df, keys, buckets, parts)
    drop(df.sparkSession, *(spent or []))
    position = F.struct(*keys)
    lasts = cut.groupBy(RANGE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"__last_{c}") for c in columns]
    )
    carried = lasts.select(
        RANGE, *[F.last(f"__last_{c}", ignorenulls=True).over(_earlier()).alias(f"__carry_{c}") for c in columns]
    )
    local = Window.partitionBy(RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(local), F.col(f"__carry_{c}")) for c in columns}
    result = [filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
    if made is None:
        return cut.join(F.broadcast(carried), RANGE).select(*result)
    return _written(cut, path, carried, bound, parts, result, made)


def global_rank(
    df: DataFrame,
    value: str,
    out: str,
    method: str = "dense",
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Rank of every row over the whole table: ``dense``, ``min`` or ``average``. Null has no rank."""
    v, rest = F.col(value), tie_breaks(df, [value])
    way = v.desc_nulls_first() if descending else v.asc_nulls_first()
    cut = ranged(df, [way, *rest], buckets)
    kind = "double" if method == "average" else "bigint"
    known = cut.where(v.isNotNull())
    first, last = (F.max(v), F.min(v)) if descending else (F.min(v), F.max(v))
    ends = known.groupBy(RANGE).agg(F.count("*").alias("__n"), first.alias("__lo"), last.alias("__hi"))
    local = Window.partitionBy(RANGE).orderBy(way)
    by_range = Window.orderBy(RANGE)
    goes_on = F.coalesce(F.lag("__hi").over(by_range) == F.col("__lo"), F.lit(False))
    if method == "dense":
        kinds = known.select(RANGE, value).distinct().groupBy(RANGE).agg(F.count("*").alias("__kinds"))
        placed = ends.join(kinds, RANGE).withColumn("__again", goes_on.cast("int")).select(
            RANGE, (F.coalesce(F.sum("__kinds").over(_earlier()), F.lit(0))
                    - F.sum("__again").over(by_range.rowsBetween(Window.unboundedPreceding, 0))).alias("__before"),
        )
        ranked = known.join(F.broadcast(placed), RANGE)
        rank = F.col("__before") + F.dense_rank().over(local)
    else:
        placed = ends.withColumn("__before", F.coalesce(F.sum("__n").over(_earlier()), F.lit(0)))
        # values at the ends of ranges may go on in the next: their first place and their number
        # come from all their ranges, two rows for each
        edge = placed.select(RANGE, F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias("__edge"))
        own = known.join(F.broadcast(edge), RANGE).where(v == F.col("__edge")).groupBy(RANGE, "__edge").agg(
            F.count("*").alias("__peers")
        ).join(F.broadcast(placed), RANGE)
        starts = F.when(F.col("__edge") == F.col("__lo"), F.col("__before")).otherwise(
            F.col("__before") + F.col("__n") - F.col("__peers")
        )
        total = own.groupBy("__edge").agg((F.min(starts) + 1).alias("__start"), F.sum("__peers").alias("__all"))
        ranked = known.join(F.broadcast(placed.select(RANGE, "__before")), RANGE).join(
            F.broadcast(total), v == F.col("__edge"), "left"
        )
        place = F.col("__before") + F.rank().over(local)
        if method == "min":
            rank = F.coalesce(F.col("__start"), place)
        else:
            peers = F.count("*").over(local.rangeBetween(Window.currentRow, Window.currentRow))
            rank = F.coalesce(F.col("__start") + (F.col("__all") - 1) / 2, place + (peers - 1) / 2)
    result = ranked.select(*df.columns, rank.cast(kind).alias(out))
    return result.unionByName(cut.where(v.isNull()).select(*df.columns, F.lit(None).cast(kind).alias(out)))


def value_ranks(
    df: DataFrame, columns: list[str], method: str = "average", descending: bool = False, buckets: int | None = None
) -> dict[str, DataFrame]:
    """For each column a table of its values and their ranks (``__value``, ``__rank``): ``dense``, ``min`` or ``average``.

    The different values of all columns of a type are counted in one pass, cut in ranges by (column, value)
    and written once, each column in a folder of its own. Null has no rank.
    """
    kinds = dict(df.dtypes)
    result = {}
    for kind in sorted({kinds[c] for c in columns}):
        own = [c for c in columns if kinds[c] == kind]
        cells = F.array(*[F.struct(F.lit(i).alias("__place"), F.col(f"`{c}`").alias("__value")) for i, c in enumerate(own)])
        known = df.select(F.inline(cells)).where(F.col("__value").isNotNull())
        counted = known.groupBy("__place", "__value").agg(F.count("*").alias("__n"))
        spent, many = [], parts_of(df)
        if many > 1:  # the counts' shuffle files are gone before the ranges'
            counted, path = materialize_all([
                part.groupBy("__place", "__value").agg(F.count("*").alias("__n")) for part in dealt(known, [F.col("__value")], many)
            ], "counted")
            spent.append(path)
        n, way = F.col("__n"), F.col("__value").desc() if descending else F.col("__value").asc()
        cut, path, _ = _ranged(counted, ["__place", way], buckets, 1)
        drop(df.sparkSession, *spent)
        size = F.lit(1) if method == "dense" else n
        earlier = Window.partitionBy("__place").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        # one row per range, and one more for each column that begins inside a range
        offsets = cut.groupBy(RANGE, "__place").agg(F.sum(size).alias("__sum")).select(
            RANGE, "__place", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before")
        )
        local = Window.partitionBy(RANGE, "__place").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
        through = F.sum(size).over(local) + F.col("__before")
        rank = {"dense": through, "min": through - n + 1, "average": through - (n - 1) / 2}[method]
        placed = cut.join(F.broadcast(offsets), [RANGE, "__place"]).select(
            "__place", "__value", rank.cast("double" if method == "average" else "bigint").alias("__rank")
        )
        result |= dict(zip(own, materialize_parts(placed, "__place", len(own), "ranks"), strict=True))
        drop(df.sparkSession, path)
    return result


def ranked_by_value(
    df: DataFrame, out: dict[str, str], method: str = "average", descending: bool = False, buckets: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """The rows with the ranks of their values (column: new column), as ``global_rank`` gives them.

    Rows are joined to ``value_ranks``: a table with few values is broadcast by its size, and of a value with
    many rows Spark splits the rows. ``source`` may name an earlier table with the same values.
    """
    tables = value_ranks(df if source is None else source, list(out), method, descending, buckets)
    for i, (c, name) in enumerate(out.items()):
        ranks = tables[c].select(F.col("__value").alias(f"__value{i}"), F.col("__rank").alias(name))
        df = df.join(ranks, F.col(f"`{c}`") == F.col(f"__value{i}"), "left").drop(f"__value{i}")
    return df


def global_row_number(df: DataFrame, order_by: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """1, 2, 3, ... in the order of ``order_by``, then of the remaining columns."""
    keys = [*order_by, *tie_breaks(df, order_by)]
    cut = ranged(df, keys, buckets)
    offsets = cut.groupBy(RANGE).agg(F.count("*").alias("__n")).select(
        RANGE, F.coalesce(F.sum("__n").over(_earlier()), F.lit(0)).alias("__before")
    )
    local = Window.partitionBy(RANGE).orderBy(*keys)
    joined = cut.join(F.broadcast(offsets), RANGE)
    number = (F.row_number().over(local) + F.col("__before")).cast("bigint")
    return joined.select(*df.columns, number.alias(out))
