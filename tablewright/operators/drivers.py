"""What moves a metric: target choice, feature importance, direction, cohorts."""

from __future__ import annotations


from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, roles
from ..functions.expr import correlation, half_up, money_avg, rounded_sum
from ..session import materialize
from . import order

#: rows that a task of the forest holds, some 400 bytes each for 50 trees
FOREST_ROWS = 250_000


def variances(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or roles.numeric_columns(df)
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("variance"))
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def resolve_target(df: DataFrame, hint: str | None = None) -> str:
    """The metric to explain.

    Names are compared by whole tokens. A hint chooses the numeric column that shares most
    tokens with it; without one that shares any, the first keyword that is a token of a column
    decides; else the column with the highest variance.
    """
    named = {c: set(roles.tokens(c)) for c in roles.numeric_columns(df)}
    if not named:
        raise ValueError("the table has no numeric column")
    asked = set(roles.tokens(hint or ""))
    shared = {c: len(asked & words) for c, words in named.items()}
    ranked = sorted((-n, len(named[c]), k, c) for k, (c, n) in enumerate(shared.items()) if n)
    if ranked:
        return ranked[0][-1]
    by_keyword = [c for word in fixed.TARGET_WORDS for c, words in named.items() if word in words]
    if by_keyword:
        return by_keyword[0]
    return variances(df, list(named)).orderBy(F.desc("variance"), "column_name").first()["column_name"]


def feature_columns(df: DataFrame, target: str) -> list[str]:
    dates = set(roles.date_columns(df))
    return [c for c in df.columns if c != target and c not in dates and not roles.is_id(c)]


def ordinal_features(
    df: DataFrame, target: str, features: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Complete rows as doubles; texts become their position in sorted order.

    The values of all texts are ranked in one pass over ranges, so a text may have
    any number of them. Each dictionary is joined back from a folder of its own, so Spark broadcasts
    the small ones whatever the size of the others.
    """
    features = features or feature_columns(df, target)
    texts = [c for c in features if c in set(roles.string_columns(df))]
    rows = df.select(target, *features).na.drop()
    dictionaries = order.value_ranks(rows, texts, "dense") if texts else {}
    for c in texts:
        codes = dictionaries[c].select(F.col("__value").alias(c), (F.col("__rank") - 1).cast("double").alias("__code"))
        rows = rows.join(codes, c).drop(c).withColumnRenamed("__code", c)
    return rows.select(*[F.col(c).cast("double").alias(c) for c in [target, *features]]), features


def _dealt(coded: DataFrame, rows_per_task: int = FOREST_ROWS) -> DataFrame:
    """The rows in parts of a bounded number of rows.

    Files are split by bytes, and codes take so few that one split can hold many millions of rows,
    each of which the forest keeps with its counts for all trees.
    """
    parts = -(-coded.count() // rows_per_task)
    return coded.repartition(parts) if parts > coded.rdd.getNumPartitions() else coded


def driver_importance(
    df: DataFrame, target: str, features: list[str] | None = None, top: int = 5, trees: int = 50, depth: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Random forest importance in percent of the strongest features, with their direction."""
    spark = df.sparkSession
    coded, features = ordinal_features(df, target, features)
    coded, _ = materialize(coded, "coded")  # read by the forest's rounds and for the directions
    # plain doubles: the assembler gets no category metadata, so codes are split as numbers
    assembled = VectorAssembler(inputCols=features, outputCol="__features").transform(_dealt(coded))
    forest = RandomForestRegressor(
        featuresCol="__features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed
    )
    model = forest.fit(assembled.select("__features", target))
    weights = [(c, float(w) * 100.0) for c, w in zip(features, model.featureImportances.toArray())]
    scores = spark.createDataFrame(weights, "feature string, weight double").select(
        "feature", half_up(F.col("weight"), 1).alias("importance_score")
    )
    best = scores.where("importance_score > 0").orderBy(F.desc("importance_score"), "feature").limit(top)
    return best.join(F.broadcast(_directions(coded, target, features)), "feature").select(
        "feature", "importance_score", "impact_direction"
    )


def _directions(coded: DataFrame, target: str, features: list[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("feature"), correlation(F.col(c), F.col(target)).alias("r")) for c in features
    ]
    r = F.col("r")
    return coded.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).select(
        "feature",
        half_up(r, 4).alias("correlation"),
        F.when(r > 0.1, "positive").when(r < -0.1, "negative").otherwise("neutral").alias("impact_direction"),
    )


def driver_direction(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Pearson r with the target and its sign, weak ones neutral."""
    coded, features = ordinal_features(df, target, features)
    return _directions(coded, target, features)


def _cohorts(df: DataFrame, target: str, dims: list[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(d).alias("dimension"),
                 F.coalesce(F.col(d).cast("string"), F.lit("null")).alias("value"))
        for i, d in enumerate(dims)
    ]
    long = df.select(F.col(target).alias("__t"), F.explode(F.array(*cells)).alias("c")).select("__t", "c.*")
    return long.groupBy("position", "dimension", "value").agg(
        F.count("*").alias("sample_size"),
        half_up(F.coalesce(money_avg(F.col("__t")), F.lit(0.0)), 2).alias("avg_target"),
        F.coalesce(rounded_sum(F.col("__t")), F.lit(0.0)).alias("total_target"),
    )


def cohort_compare(df: DataFrame, target: str, dims: list[str] | None = None, limit: int = 6) -> DataFrame:
    """Count, mean and total of the target per value of the first two dimensions, best means
    first within a dimension; the list is cut after ``limit`` rows."""
    dims = (dims or roles.dimension_columns(df))[:2]
    return (
        _cohorts(df, target, dims)
        .orderBy("position", F.desc("avg_target"), "value")
        .limit(limit)
        .drop("position")
    )


def target_overview(df: DataFrame, target: str, dims: list[str] | None = None, limit: int = 6) -> DataFrame:
    """Rows, total and mean of the target with the first and last listed cohort."""
    listed = cohort_compare(df, target, dims, limit).collect()
    names = [f"{r['dimension']}: {r['value']}" for r in listed]
    return df.agg(
        F.count("*").alias("total_rows"),
        F.coalesce(rounded_sum(F.col(target)), F.lit(0.0)).alias("total_target"),
        half_up(F.coalesce(money_avg(F.col(target)), F.lit(0.0)), 2).alias("avg_target"),
        F.lit(names[0] if names else None).cast("string").alias("top_cohort"),
        F.lit(names[-1] if names else None).cast("string").alias("bottom_cohort"),
    )
