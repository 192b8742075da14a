"""Closest labels from a registry of any size: a set-similarity join instead of every label against every value.

The score of two texts is 200 * LCS / (len a + len b) on sorted tokens. A pair at or above the
cutoff has a common subsequence of at least ``need`` characters, so lengths lie in a known range
and the texts share at least ``need`` characters, or ``3 * need - len a - len b - 1`` pairs of
neighbouring characters (a character outside the subsequence breaks two pairs of its own text and
one of the other). With the grams of each text in one order, rare ones first, two texts
that share t of n grams share one among the first n - t + 1: only these are posted in the inverted
list, by gram and length. Candidates get their exact score; texts too short for pairs go by characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..session import materialize


def _lengths(cutoff: float) -> tuple[Column, Column]:
    """The range of partner lengths of a text of length n."""
    n = F.col("n")
    return F.greatest(F.lit(1), F.ceil(n * F.lit(cutoff / (200.0 - cutoff)) - 1e-9)), F.floor(n * F.lit((200.0 - cutoff) / cutoff) + 1e-9)


def _shared(q: int, cutoff: float) -> Column:
    """The least number of q-grams that a text of length n shares with any partner in its range."""
    low, high = _lengths(cutoff)

    def need(other: Column) -> Column:
        both = F.col("n") + other
        common = F.ceil(both * F.lit(cutoff / 200.0) - 1e-9)
        return common if q == 1 else 3 * common - both - 1

    return F.array_min(F.transform(F.sequence(low.cast("int"), F.greatest(low, high).cast("int")), need))


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """(t, n, q, g) for the q-grams of each text; those that repeat in it are numbered."""
    places = F.sequence(F.lit(1), F.col("n") - q + 1)
    raw = texts.where(F.col("n") >= q).withColumn("raw", F.transform(places, lambda i: F.substring(F.col("t"), i, F.lit(q))))
    named = F.transform(
        "raw", lambda g, i: F.concat(g, F.lit(":"), F.size(F.filter(F.slice("raw", F.lit(1), i), lambda x: x == g)).cast("string"))
    )
    return raw.select("t", "n", F.lit(q).alias("q"), F.explode(named).alias("g"))


def _prefixes(grams: DataFrame, counts: DataFrame, cutoff: float) -> DataFrame:
    """(t, n, q, g) for the grams that a partner must meet."""
    ranked = grams.join(counts, ["q", "g"], "left").groupBy("t", "n", "q").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "g"))).alias("held")
    )
    least = F.when(F.col("q") == 1, _shared(1, cutoff)).otherwise(_shared(2, cutoff))
    first = F.greatest(F.size("held") - F.greatest(least, F.lit(1)) + 1, F.lit(0)).cast("int")
    return ranked.select("t", "n", "q", F.explode(F.slice(F.col("held.g"), F.lit(1), first)).alias("g"))


def closest_labels(values: DataFrame, labels: DataFrame, cutoff: float) -> DataFrame:
    """(value, label, score) for the values that some label matches at ``cutoff`` or more.

    ``values`` and ``labels`` have one column each. The best score wins, of equal scores the label that
    comes first in code point order. Null and blank texts match nothing.
    """
    if not 0 < cutoff <= 100:
        raise ValueError("the cutoff lies above 0 and is at most 100")
    named = values.select(F.col(values.columns[0]).alias("value")).where("value IS NOT NULL").distinct()
    known = labels.select(F.col(labels.columns[0]).alias("label")).where("label IS NOT NULL").distinct()
    named, _ = materialize(named.withColumn("t", fuzzy.sorted_tokens(F.col("value"))), "values")
    known, _ = materialize(known.withColumn("t", fuzzy.sorted_tokens(F.col("label"))).where("length(t) > 0"), "labels")
    sized = [x.select("t").distinct().withColumn("n", F.length("t")) for x in (named, known)]
    low, high = _lengths(cutoff)
    ends = sized[1].agg(F.min("n"), F.max("n")).first()
    if ends[0] is None:
        return named.select("value", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score")).limit(0)
    # texts without a partner of fitting length, very long ones above all, are not taken apart: the
    # rest is written first, so that no filter on the parts is moved before this one
    open_texts, _ = materialize(sized[0].where((F.col("n") > 0) & (low <= ends[1]) & (high >= ends[0])), "fitting")
    posted = _grams(sized[1], 1).unionByName(_grams(sized[1], 2))
    counts, _ = materialize(posted.groupBy("q", "g").count(), "grams")
    lists = _prefixes(posted, counts, cutoff).select(
        "q", "g", F.explode(F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).alias("n"), F.col("t").alias("other")
    )
    paired = _shared(2, cutoff) >= 1
    asked = _grams(open_texts.where(~paired), 1).unionByName(_grams(open_texts.where(paired), 2))
    met = _prefixes(asked, counts, cutoff).join(lists, ["q", "g", "n"]).select("t", "other").distinct()
    scored = met.withColumn("score", fuzzy.pair_score()(F.col("t"), F.col("other"))).where(F.col("score") >= cutoff)
    matched = named.join(scored, "t").join(known.withColumnRenamed("t", "other"), "other")
    best = F.min(F.struct((-F.col("score")).alias("score"), "label"))
    return matched.groupBy("value").agg(best.alias("best")).select("value", "best.label", (-F.col("best.score")).alias("score"))
