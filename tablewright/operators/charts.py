"""The table behind each chart. Rendering is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, roles
from ..functions.expr import half_up, money_avg, money_sum, rounded_sum
from ..session import materialize
from . import stats
from .kpi import share_over_total
from .quantiles import column_quantiles, exact_quantiles

PROFIT_RATIO = 1.0 - fixed.COGS_RATIO


def formatted(c: Column, prefix: str = "") -> Column:
    """1234567 as ``1.23M``; two digits, units K, M, B."""
    size = F.abs(c)

    def unit(divisor: float, suffix: str) -> Column:
        return F.concat(
            F.lit(prefix), F.round((c / divisor).cast("decimal(28,10)"), 2).cast("decimal(28,2)").cast("string"), F.lit(suffix)
        )

    return (
        F.when(size >= 1e9, unit(1e9, "B")).when(size >= 1e6, unit(1e6, "M")).when(size >= 1e3, unit(1e3, "K"))
        .otherwise(unit(1.0, ""))
    )


def _as_rows(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    cells = [F.struct(F.lit(t).alias("title"), F.col(c).cast("double").alias("metric_value")) for c, t in titles.items()]
    return df.select(F.inline(F.array(*cells)))


def kpi_cards(
    df: DataFrame, sales: str, date: str, order: str | None = None, profit: str | None = None,
    profit_ratio: float = PROFIT_RATIO, prefix: str = "$",
) -> DataFrame:
    """Total, profit, mean and number of orders, each with its change from the month before the
    last month. Without a profit column the profit is the assumed ratio of the total.

    One pass to partial sums per month; orders are counted per month and over all months.
    """
    order = order or F.lit(None)
    month = F.date_format(date, "yyyy-MM").alias("month")
    gain = F.col(profit) if profit else F.col(sales)
    ratio = F.lit(1.0 if profit else profit_ratio)
    monthly = df.where(F.col(date).isNotNull()).groupBy(month).agg(
        money_sum(F.col(sales)).alias("total"),
        (money_sum(gain) * ratio).alias("profit"),
        money_avg(F.col(sales)).alias("mean"),
        F.count_distinct(order).cast("double").alias("orders"),
    )
    latest = monthly.orderBy(F.desc("month")).limit(2)
    names = ["total", "profit", "mean", "orders"]
    change = latest.agg(
        *[
            half_up(
                F.try_divide(F.max_by(n, "month") - F.min_by(n, "month"), F.nullif(F.min_by(n, "month"), F.lit(0.0)))
                * 100.0, 1,
            ).alias(n)
            for n in names
        ]
    )
    whole = df.agg(
        rounded_sum(F.col(sales)).alias("total"),
        half_up(money_sum(gain) * ratio, 2).alias("profit"),
        half_up(money_avg(F.col(sales)), 2).alias("mean"),
        F.count_distinct(order).cast("double").alias("orders"),
    )
    titles = {"total": "Total Sales", "profit": "Gross Profit", "mean": "Average Order Value", "orders": "Orders"}
    changes = _as_rows(change, titles).withColumnRenamed("metric_value", "change_pct")
    cards = _as_rows(whole, titles).join(F.broadcast(changes), "title")  # four rows
    shown = F.when(F.col("title") == "Orders", formatted(F.col("metric_value"))).otherwise(
        formatted(F.col("metric_value"), prefix)
    )
    trend = F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").otherwise("neutral")
    return cards.select(
        "title", "metric_value", shown.alias("formatted_value"), "change_pct", trend.alias("trend_direction")
    )


def kpi_cards_projection(df: DataFrame, current: str, projected: str, rate: str) -> DataFrame:
    now, then = F.sum(f"`{current}`"), F.sum(f"`{projected}`")
    whole = df.agg(
        now.cast("double").alias("current"), then.cast("double").alias("projected"),
        (then - now).cast("double").alias("growth"), half_up(F.avg(f"`{rate}`"), 4).alias("rate"),
        F.count("*").cast("double").alias("entities"),
        half_up((then - now) * 100.0 / F.greatest(now.cast("double"), F.lit(1.0)), 1).alias("pct"),
    )
    titles = {
        "current": "Current Total", "projected": "Projected Total", "growth": "Net Growth",
        "rate": "Mean Growth Rate", "entities": "Entities",
    }
    cells = [
        F.struct(
            F.lit(t).alias("title"), F.col(c).alias("metric_value"),
            (formatted(F.col(c)) if c != "rate" else F.concat(F.col(c).cast("decimal(10,4)").cast("string"), F.lit("%")))
            .alias("formatted_value"),
            (F.col("pct") if c in ("projected", "growth") else F.lit(None).cast("double")).alias("change_pct"),
        )
        for c, t in titles.items()
    ]
    return whole.select(F.inline(F.array(*cells)))


def trend_monthly(
    df: DataFrame, sales: str, date: str, profit: str | None = None, profit_ratio: float = PROFIT_RATIO
) -> DataFrame:
    gain = rounded_sum(F.col(profit)) if profit else half_up(money_sum(F.col(sales)) * profit_ratio, 2)
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.date_format(date, "yyyy-MM").alias("month"))
        .agg(rounded_sum(F.col(sales)).alias("monthly_revenue"), gain.alias("monthly_profit"))
        .orderBy("month")
    )


def bar_top(df: DataFrame, category: str, value: str, limit: int = 10, out: str = "total_sales") -> DataFrame:
    grouped = df.groupBy(category).agg(rounded_sum(F.col(value)).alias(out))
    return grouped.orderBy(F.desc(out), F.col(category).asc_nulls_last()).limit(limit)


def grouped_bar_melt(
    df: DataFrame, region: str, sales: str, profit: str | None = None, profit_ratio: float = PROFIT_RATIO, limit: int = 8
) -> DataFrame:
    """Revenue and profit of the largest regions, one row per region and metric."""
    gain = rounded_sum(F.col(profit)) if profit else half_up(money_sum(F.col(sales)) * profit_ratio, 2)
    best = (
        df.groupBy(region)
        .agg(rounded_sum(F.col(sales)).alias("Revenue"), gain.alias("Profit"))
        .orderBy(F.desc("Revenue"), region)
        .limit(limit)
    )
    return best.unpivot([region], ["Revenue", "Profit"], "metric", "amount")


def _visible(df: DataFrame, value: str, top: float) -> tuple[DataFrame, float, list[float]] | None:
    """Non-null values up to the quantile, the quantile, and (median)."""
    known = df.where(F.col(value).isNotNull())
    q = column_quantiles(known, [value], [top, 0.5])[value]
    return (known.where(F.col(value) <= q[0]), q[0], [q[1]]) if q else None


def histogram(
    df: DataFrame, value: str, bins: int = 25, top: float = 0.95
) -> DataFrame:
    """Equal bins over the values up to the 95th percentile, with median and mean of all values."""
    seen = _visible(df, value, top)
    if seen is None:
        return df.sparkSession.createDataFrame(
            [], "bin bigint, bin_start double, bin_end double, count bigint, median double, mean double"
        )
    shown, cut, (median,) = seen
    v = F.col(value).cast("double")
    row = df.agg(F.min(v).alias("lo"), F.max(F.when(v <= cut, v)).alias("hi"), F.avg(v).alias("mean")).first()
    lo, hi = row["lo"], row["hi"]
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((v - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("bigint")
    counted = shown.groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    all_bins = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        half_up(F.lit(lo) + (F.col("bin") - 1) * F.lit(width), 4).alias("bin_start"),
        half_up(F.lit(lo) + F.col("bin") * F.lit(width), 4).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
        half_up(F.lit(median), 4).alias("median"), half_up(F.lit(row["mean"]), 4).alias("mean"),
    )


def kde_curve(
    df: DataFrame, value: str, grid: int = 100, bins: int = 512, top: float = 0.95
) -> DataFrame:
    """Gaussian density with Scott's bandwidth on a fixed grid.

    The values are counted into fine bins first, so the sum of kernels has bins times grid
    terms whatever the number of rows.
    """
    seen = _visible(df, value, top)
    if seen is None:
        return df.sparkSession.createDataFrame([], "point bigint, x double, density double")
    shown, cut, _ = seen
    v = F.col(value).cast("double")
    row = shown.agg(
        F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("std")
    ).first()
    n, lo, hi = row["n"], row["lo"], row["hi"]
    bandwidth = n ** (-0.2) * (row["std"] or 0.0) or 1.0
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counted = shown.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    step = (hi - lo) / (grid - 1)
    points = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    terms = counted.select("bin", "n", points.alias("point"))
    x = F.lit(lo) + F.col("point") * F.lit(step)
    center = F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)
    z = (x - center) / F.lit(bandwidth)
    scale = n * bandwidth * math.sqrt(2 * math.pi)
    return (
        terms.groupBy(F.col("point").cast("bigint").alias("point"))
        .agg(F.max(x).alias("x"), (F.sum(F.col("n") * F.exp(-z * z / 2)) / F.lit(scale)).alias("density"))
        .select("point", half_up(F.col("x"), 4).alias("x"), half_up(F.col("density"), 9).alias("density"))
    )


def boxplot_stats(
    df: DataFrame, category: str, value: str, top: float | None = 0.95
) -> DataFrame:
    """Per category: quartiles, mean, whiskers and outliers of the values up to the 95th percentile."""
    known = df.select(category, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    known, _ = materialize(known, "known")  # two columns, read by every round of both quantiles and for the result
    if top is not None:
        cut = column_quantiles(known, ["__x"], [top])["__x"]
        known = known.where(F.col("__x") <= (cut[0] if cut else 0.0))
    named = known.where(F.col(category).isNotNull())
    box = exact_quantiles(named, "__x", [0.25, 0.5, 0.75], [category])
    q = [F.col("quantiles")[i] for i in range(3)]
    x, spread = F.col("__x"), q[2] - q[0]
    inside = (x >= q[0] - 1.5 * spread) & (x <= q[2] + 1.5 * spread)
    # one row per category, written so that Spark knows its size and broadcasts it when it is small
    joined = named.join(materialize(box, "boxes")[0], category)
    return joined.groupBy(category).agg(
        F.count("*").alias("n"), half_up(F.avg("__x"), 2).alias("mean"),
        half_up(F.max(q[0]), 2).alias("q1"), half_up(F.max(q[1]), 2).alias("median"), half_up(F.max(q[2]), 2).alias("q3"),
        half_up(F.min(F.when(inside, x)), 2).alias("whisker_low"),
        half_up(F.max(F.when(inside, x)), 2).alias("whisker_high"),
        F.count_if(~inside).alias("outlier_count"),
    )


def corr_matrix(df: DataFrame, columns: list[str] | None = None, limit: int = 6) -> DataFrame:
    """Both triangles and the diagonal of the Pearson matrix."""
    columns = (columns or roles.measure_columns(df))[:limit]
    pairs = stats.pearson_pairs(df, columns).select("feature_x", "feature_y", "pearson_r")
    both = F.array(
        F.struct(F.col("feature_x").alias("feature_x"), F.col("feature_y").alias("feature_y")),
        F.struct(F.col("feature_y").alias("feature_x"), F.col("feature_x").alias("feature_y")),
    )
    mirrored = pairs.select(F.explode(both).alias("p"), "pearson_r").select("p.feature_x", "p.feature_y", "pearson_r")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], mirrored.schema)
    return mirrored.unionByName(diagonal)


def scatter_sample(
    df: DataFrame, x: str, y: str, key: list[str], hue: str | None = None, n: int = 1000, seed: int = 42
) -> DataFrame:
    """At most ``n`` points, the same ones in every run: the smallest hashes of key and seed."""
    ticket = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    points = df.select(*key, x, y, *([hue] if hue else []), ticket.alias("__ticket"))
    return points.orderBy("__ticket", *key).limit(n).drop("__ticket")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through all rows."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(
        half_up(F.regr_slope(b, a), 4).alias("slope"), half_up(F.regr_intercept(b, a), 2).alias("intercept"),
        half_up(F.regr_r2(b, a), 4).alias("r2"), F.regr_count(b, a).alias("n"),
    )


def donut_top_other(
    df: DataFrame, category: str, value: str, keep: int = 5, most: int = 6, other: str = "Other Categories"
) -> DataFrame:
    """The largest categories and one bucket for the rest, when there are more than ``most``."""
    grouped = df.groupBy(F.col(category).alias("category")).agg(money_sum(F.col(value)).alias("sales"))
    order = [F.desc("sales"), F.col("category").asc_nulls_last()]
    size = grouped.count()
    if size <= most:
        return grouped.select("category", half_up(F.col("sales"), 2).alias("sales"))
    best = grouped.orderBy(*order).limit(keep).select(F.col("category").alias("__best"), F.lit(1).alias("__kept"))
    # `keep` rows
    marked = grouped.join(F.broadcast(best), F.col("category").eqNullSafe(F.col("__best")), "left")
    name = F.when(F.col("__kept").isNotNull(), F.col("category")).otherwise(F.lit(other))
    return marked.groupBy(name.alias("category")).agg(rounded_sum(F.col("sales")).alias("sales"))


def contribution_breakdown(df: DataFrame, dimension: str, metric: str, limit: int = 6) -> DataFrame:
    """The largest segments with their share of the listed total."""
    best = (
        df.groupBy(dimension)
        .agg(rounded_sum(F.col(metric)).alias("metric_sum"), money_sum(F.col(metric)).alias("__whole"))
        .orderBy(F.desc("metric_sum"), F.desc("__whole"), F.col(dimension).asc_nulls_last())
        .limit(limit)
    )
    return share_over_total(best, "__whole", "share_pct", 1).drop("__whole")


def forecast_trajectory(
    df: DataFrame, target_year: int | None = None, projected: str | None = None, band: float = 0.04,
    horizon: int = fixed.DEFAULT_HORIZON,
) -> DataFrame:
    """Total per yearly column and the projected point, with an assumed band around it.

    Without a projected column the totals are grown at their unclipped compound rate.
    """
    years = roles.year_columns(df)
    if not years:
        raise ValueError("no yearly column")
    first, last = years[0], years[-1]
    target = target_year or last[0] + horizon
    sums = [F.sum(f"`{c}`").cast("double").alias(f"y{y}") for y, c in years]
    extra = [F.sum(f"`{projected}`").cast("double").alias("then")] if projected else []
    whole = df.agg(*sums, *extra)
    oldest, latest = F.col(f"y{first[0]}"), F.col(f"y{last[0]}")
    rate = F.pow(latest / oldest, F.lit(1.0 / max(last[0] - first[0], 1))) - 1.0
    then = F.col("then") if projected else latest * F.pow(1.0 + rate, F.lit(float(target - last[0])))
    then = F.round(then, 0)
    none = F.lit(None).cast("double")
    points = [
        F.struct(F.lit(y).alias("year"), F.lit("history").alias("kind"), F.col(f"y{y}").alias("total"),
                 none.alias("lower"), none.alias("upper"))
        for y, _ in years
    ]
    points.append(
        F.struct(F.lit(target).alias("year"), F.lit("projection").alias("kind"), then.alias("total"),
                 F.round(then * (1.0 - band), 0).alias("lower"), F.round(then * (1.0 + band), 0).alias("upper"))
    )
    return whole.select(F.inline(F.array(*points)))


def top_projected(df: DataFrame, entity: str, projected: str, limit: int = 10) -> DataFrame:
    return (
        df.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{projected}`").alias("projected"))
        .orderBy(F.desc("projected"), "entity")
        .limit(limit)
    )


def share_projected(df: DataFrame, group: str, projected: str) -> DataFrame:
    grouped = df.groupBy(F.col(f"`{group}`").alias("group")).agg(F.sum(f"`{projected}`").alias("total"))
    return share_over_total(grouped, "total", "share_pct", 1)


def custom_bar(
    df: DataFrame, x: str, y: str | None = None, aggregation: str = "sum", limit: int = 15
) -> DataFrame:
    """Sum or mean of y by x, or how often each x occurs; the largest values."""
    if y is None:
        grouped = df.groupBy(x).agg(F.count("*").cast("double").alias("value"))
    else:
        measure = rounded_sum(F.col(y)) if aggregation == "sum" else half_up(money_avg(F.col(y)), 4)
        grouped = df.groupBy(x).agg(measure.alias("value"))
    return grouped.orderBy(F.col("value").desc_nulls_last(), F.col(x).asc_nulls_last()).limit(limit)


def custom_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x).agg(rounded_sum(F.col(y)).alias("value")).orderBy(x)


def custom_chart(
    df: DataFrame, kind: str, x: str, y: str | None = None, hue: str | None = None, aggregation: str = "sum",
    key: list[str] | None = None,
) -> DataFrame:
    """The data of a bar, line, histogram, box or scatter chart over any columns."""
    for c in (x, y, hue):
        if c and c not in df.columns:
            raise ValueError(f"no column {c}")
    kind = kind.lower().strip()
    if kind in ("bar", "horizontal_bar"):
        return custom_bar(df, x, y, aggregation)
    if kind in ("line", "scatter", "scatterplot") and not y:
        raise ValueError(f"a {kind} chart needs x and y")
    if kind == "line":
        return custom_line(df, x, y)
    if kind in ("hist", "histogram"):
        return histogram(df.select(x), x, top=1.0)
    if kind in ("box", "boxplot"):
        if y:
            return boxplot_stats(df.select(x, y).na.drop(), x, y, None)
        return boxplot_stats(df.select(F.lit(x).alias("column"), x).na.drop(), "column", x, None)
    if kind in ("scatter", "scatterplot"):
        return scatter_sample(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, key or [x, y], hue)
    raise ValueError(f"unsupported chart type: {kind}")
