"""Mixing sources to target weights.

Sizes are summed per source, targets are filled up to ``most`` times a source's size, and each
document is emitted floor(rate) times plus one more time if a hash of its key falls below the
fraction of the rate. Rows stay where they are: the documents are read once for the sums and
once for the copies, and only one row per source is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WORD, fresh, numbered, stored, table

#: hex digits of the digest that make the uniform number; 52 bits fit a double exactly
DIGITS = 13


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def source_sizes(sized: DataFrame, source: str, size: str) -> DataFrame:
    """One row per source (null is one): __source, __size."""
    return sized.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("__size"))


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds __target: the whole size shared by weight, stopped at ``most`` times the source's size.

    While a share lies above its stop, that source gets the stop and the excess goes to the
    others by weight. Each round is one aggregate over the sources that returns four numbers.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    # Spark compares strings by their UTF-8 bytes, which is the order of code points
    ranked = numbered(sources, [F.col("__source").isNull(), F.col("__source")], "__rank")
    weighed = stored(
        ranked.withColumn("__weight", F.element_at(cycle, (F.col("__rank") % len(weights) + 1).cast("int"))), "weights"
    )
    stop = F.lit(float(most)) * F.col("__size")
    level, before = 0.0, -1
    total = weighed.agg(F.sum("__size")).first()[0] or 0
    while True:
        full = F.col("__weight") * F.lit(level) > stop if before >= 0 else F.lit(False)
        got = weighed.agg(
            F.sum(F.when(full, F.col("__size"))).alias("size"), F.sum(F.when(~full, F.col("__weight"))).alias("weight"),
            F.count(F.when(full, True)).alias("n"),
        ).first()
        if got["n"] == before or not got["weight"]:
            break
        before = got["n"]
        level = (float(total) - most * float(got["size"] or 0)) / float(got["weight"])
    share = F.col("__weight") * F.lit(level)
    return weighed.withColumn("__target", F.when(share > stop, stop).otherwise(share))


def mix_rates(
    docs: DataFrame, source: str = "source", text: str = "text", key: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = (1, 2, 3), most: float = 3.0, seed: int = 17,
) -> DataFrame:
    """The documents with size, source_size, target and copies (the number of times the mix takes each).

    size: words of the text (null: 0). Sources weigh ``weights`` in turn by code point, null
    last. copies: floor(target / source_size), plus one with the fraction as probability, drawn
    from a hash of ``seed``, the key columns and the text, so reruns agree and rows that differ
    are drawn apart. A source without words has target 0 and its documents are emitted once, as
    they add nothing. Rows that are equal in key and text are drawn alike. Columns of the input
    keep their values; where one has the name of a new column, the new one is under ``_name``.
    An empty table gives an empty table.
    """
    names = {n: fresh(docs.columns, n) for n in ("size", "source_size", "target", "copies")}
    sized = docs.withColumn(names["size"], words(F.col(text)))
    shares = targets(source_sizes(sized, source, names["size"]), weights, most)
    of, held, aim = (fresh(sized.columns, n) for n in ("__source", "__size", "__target"))
    shares = shares.select(F.col("__source").alias(of), F.col("__size").alias(held), F.col("__target").alias(aim))
    rate = F.when(F.col(held) > 0, F.col(aim) / F.col(held)).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    extra = uniform(seed, *[F.col(k) for k in key], F.col(text)) < rate - whole
    joined = sized.join(shares, F.col(source).eqNullSafe(F.col(of)), "left")
    return joined.select(
        *[sized[c] for c in docs.columns], sized[names["size"]],
        F.col(held).alias(names["source_size"]), F.col(aim).alias(names["target"]),
        (whole + extra.cast("long")).cast("long").alias(names["copies"]),
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as ``mix_rates`` says, with the columns of the input."""
    rated = mix_rates(docs, **how)
    copies, copy = rated.columns[-1], fresh(rated.columns, "copy")
    repeated = F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))  # none for 0 copies
    return rated.withColumn(copy, repeated).select(*docs.columns)


def op5_mix_sources(spark, sf_dir):
    rated = mix_rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rated.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op5_mix_sources": op5_mix_sources}

ORACLES = {
    "op5_mix_sources": """
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER by_ratio AS k,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
         coalesce(sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM sources WINDOW by_ratio AS (ORDER BY source_size / weight, source)
), levels AS (
  SELECT k, (CAST(total AS DOUBLE) - 3.0 * CAST(full_size AS DOUBLE)) / CAST(weights - full_weight AS DOUBLE) AS level,
         source_size, weight FROM ordered
), level AS (
  SELECT level FROM levels WHERE weight * level <= 3.0 * source_size ORDER BY k LIMIT 1
), shares AS (
  SELECT source, source_size, least(weight * level, 3.0 * source_size) AS target FROM sources, level
), rated AS (
  SELECT d.doc_id, d.size, s.source_size, s.target,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 1.0 END AS rate,
         CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || coalesce(d.text, '')), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS draw
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated""",
}
