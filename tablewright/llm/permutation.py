"""Nearest neighbours by a permutation index.

Pivots are the most spread vectors of a bounded sample (``SAMPLE`` by hash). A vector is represented by the order of its nearest
pivots and posted in the inverted files of the first ``POSTED`` of them. A query reads the files
of its own first pivots, ranks what it finds by the footrule distance of the two orders (the
sum of the differences of all pivots' places), and computes the cosine of the best share.

Vectors are dealt over shards of about ``SHARD`` and queries over blocks of as many; a task
builds the files of one shard and answers one block. Every vector is indexed and every query
meets every shard. Equal vectors are one entry with its smallest ids, so a vector that fills a
third of the table costs one entry.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored, table

#: vectors of which pivots are chosen; pivots; files a vector is posted in; share of the candidates that is reranked, and least number
SAMPLE, PIVOTS, POSTED, SHARE, LEAST = 2048, 64, 10, 0.25, 200
SHARD = 8192


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unit vectors, each the farthest from those before, so a crowd of near copies gives one."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    chosen, nearness = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(np.argmin(nearness)))
        nearness = np.maximum(nearness, unit @ unit[chosen[-1]])
    return unit[chosen]


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of every pivot in each vector's order of nearness."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def search_shard(
    vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, pivots: np.ndarray, top: int, posted: int, share: float, least: int
):
    """For each query (its number, vec_id, score) of the ``top`` nearest found, ties to smaller ids."""
    at, wanted = places(vectors, pivots), places(queries, pivots)
    files = [np.flatnonzero(at[:, p] < posted) for p in range(len(pivots))]
    lengths = np.linalg.norm(vectors, axis=1)
    first = np.array([i[0] for i in ids], np.int64)
    for q, (query, place) in enumerate(zip(queries, wanted, strict=True)):
        hit = np.zeros(len(vectors), bool)
        for p in np.flatnonzero(place < posted):
            hit[files[p]] = True
        found = np.flatnonzero(hit)
        if len(found) < least:
            found = np.arange(len(vectors))
        foot = np.abs(at[found] - place).sum(axis=1, dtype=np.int32)
        n = max(least, int(np.ceil(share * len(found))))
        if n < len(found):
            found = found[foot <= np.partition(foot, n - 1)[n - 1]]
        score = (vectors[found] @ query) / (lengths[found] * np.linalg.norm(query))
        if len(found) > top:
            near = score >= np.partition(score, len(found) - top)[len(found) - top]
            found, score = found[near], score[near]
            best = np.lexsort((first[found], -score))[:top]
            found, score = found[best], score[best]
        rows = sorted((-s, i) for f, s in zip(found, score.tolist(), strict=True) for i in ids[f])[:top]
        for s, i in rows:
            yield q, i, -s


def _answer(left: pa.Table, right: pa.Table, pivots: np.ndarray, top: int, posted: int, share: float, least: int) -> pa.Table:
    names = ["query", "vec_id", "score"]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    left = left.sort_by("first")
    found = search_shard(
        _matrix(left["vector"]), left["ids"].to_pylist(), _matrix(right["vector"]), pivots, top, posted, share, least
    )
    who, ids, score = zip(*found, strict=True)
    queries = right["query"].combine_chunks().take(pa.array(who))
    return pa.table([queries, pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=names)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Distinct (id, vector) with an id and a vector of finite numbers, not all zero; vectors as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(fine)
    # a sum with 0.0 makes -0.0 equal to 0.0 as a key
    return plain.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + 0.0).alias("vector")).distinct()


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, posted: int = POSTED, share: float = SHARE, least: int = LEAST, shard: int = SHARD,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` nearest other vectors that the index finds.

    Both tables have ``id_col`` and ``vector``. Nearness is the cosine in doubles, ties go to the
    smaller id. A query never finds its own id; if there are fewer than ``k`` others it finds all.
    Null ids and vectors that are null, zero or hold null or non-finite numbers take no part, nor
    do vectors whose length is not that of the pivots. Equal rows count once. Empty tables give
    an empty table.
    """
    own = usable(vectors, id_col, vector)
    asked = usable(queries, id_col, vector)
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = stored(
        ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("first", F.col("ids")[0]),
        "entries",
    )
    sample = entries.select("first", "vector").orderBy(F.xxhash64("first"), "first").limit(max(SAMPLE, pivots)).collect()
    if not sample:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = len(sample[0]["vector"])
    matrix = spread_pivots(np.array([r["vector"] for r in sample if len(r["vector"]) == size], np.float64), pivots)
    kinds = stored(
        asked.where(F.size("vector") == size).groupBy("vector").agg(F.min("id").alias("query")), "queries"
    )
    shards = max(1, -(-entries.count() // shard))
    blocks = max(1, -(-kinds.count() // shard))
    dealt = entries.where(F.size("vector") == size).withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = kinds.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = dealt.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(
        partial(_answer, pivots=matrix, top=k + 1, posted=min(posted, len(matrix)), share=share, least=least),
        "query long, vec_id long, score double",
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    named = asked.join(kinds, "vector").select(F.col("id").alias("query_id"), "query")
    others = named.join(best, "query").where(F.col("vec_id") != F.col("query_id"))
    last = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op9_permutation_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op9_permutation_index": op9_permutation_index}
