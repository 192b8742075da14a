"""Suffix-array dedup by longest previous factors.

Runs of windows are routed by ``runs`` to blocks. In a block the suffixes are sorted; for each
place the previous and the next smaller place in suffix order give the longest factor that
starts earlier, and the larger ones the longest that starts later. A window is a copy if a
factor is at least as long as the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import runs
from tablewright.llm.common import table
from tablewright.llm.suffix import Suffixes, previous_factors

LENGTH, CORE = 200, 64
#: bytes in the first sort key: 9 bits each (value + 1, and 0 for the end)
FIRST_KEY = 4


def lpf_intervals(texts: list[bytes], times: list[int], length: int, first: bool) -> Iterator[tuple[int, int, int]]:
    """Windows with an earlier (``first``) or any other place; a text that stands for several has others."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(sizes) - sizes
    block = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(block), bool)
    inside[start + sizes - 1] = False
    block[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    windows = sizes - length
    owner = np.repeat(np.arange(len(texts)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = start[owner] + within
    suffixes = Suffixes(block, length, FIRST_KEY)
    copy = previous_factors(suffixes, places) >= length
    if not first:
        copy |= previous_factors(suffixes, places, later=True) >= length
        copy |= (np.array(times) > 1)[owner]
    at = np.flatnonzero(copy)
    if not len(at):
        return
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    begin = at[new]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    yield from zip(owner[begin].tolist(), within[begin].tolist(), size.tolist(), strict=True)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    length: int = LENGTH, core: int = CORE, first: bool = True, crowd: int = runs.CROWD,
) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans and kept (the bytes left).

    With ``first`` a byte is removed if a string of ``length`` bytes that covers it started
    earlier (by id with null first, hash of the text, place): the first copy stays. Without, all
    copies go. A null text is empty. Ids may be null or repeat: of equal rows none is earlier, so
    they keep the same. New columns whose name is taken get a leading underscore; an empty table
    gives an empty table.
    """
    return runs.without_repeats(
        docs, id_col, text_col, runs.BYTES, length, core, lpf_intervals, ["n_bytes", "n_removed", "n_spans", "kept"],
        keep, first=first, crowd=crowd,
    )


def op6_suffix_dedup(spark, sf_dir):
    made = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], first=False)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}

ORACLES = {
    "op6_suffix_dedup": r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM docs WHERE length(h) >= 400)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1
), edges AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR before + 200 < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM edges
), spans AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_, b FROM spans
), kept AS (
  SELECT p.doc_id, count(*) AS n, sum(p.b - p.a) AS removed,
         string_agg(substr(d.h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY p.a) || substr(any_value(d.h), 2 * max(p.b) + 1) AS h
  FROM pieces p JOIN docs d USING (doc_id) GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)""",
}
