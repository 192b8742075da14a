"""Substring dedup with an FM-index per block.

Runs of windows are routed by ``runs`` to blocks; each block has a compressed FM-index (wavelet
matrix over the Burrows-Wheeler transform of its texts). The texts are streamed against it:
backward search gives the matching statistics, and stretches of at least ``length`` words that
occur twice or more are reported as intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import runs
from tablewright.llm.common import table
from tablewright.llm.fm import FmIndex, repeated_stretches

LENGTH, CORE = 35, 14


def fm_intervals(texts: list[bytes], times: list[int], length: int, first: bool) -> Iterator[tuple[int, int, int]]:
    """Repeated windows of a block of texts; a text that stands for several is repeated as a whole."""
    if first:
        raise ValueError("an interval of the FM-index has no order of places")
    ids: dict[bytes, int] = {}
    symbols: list[int] = []
    ends = []
    for text in texts:
        symbols += [ids.setdefault(w, len(ids) + 1) for w in text.split()]
        symbols.append(0)
        ends.append(len(symbols) - 1)
    block, end = np.array(symbols, np.int64), np.array(ends, np.int64)
    start = np.concatenate(([0], end[:-1] + 1))
    often = np.array(times) > 1
    for k in np.flatnonzero(often):
        yield int(k), 0, int(end[k] - start[k] - length + 1)
    once = np.flatnonzero(~often)
    if len(once):
        index = FmIndex(block, int((end - start).max()) + 1)
        for k, at, stop in zip(*repeated_stretches(index, block, start[once], end[once], length), strict=True):
            yield int(once[k]), int(at), int(stop - at - length + 1)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    length: int = LENGTH, core: int = CORE, crowd: int = runs.CROWD,
) -> DataFrame:
    """Every row with n_words, n_removed, n_spans and kept (UTF-8: the words left, joined by one space).

    A word is removed if a window of ``length`` words that covers it also starts at another
    place, same text included; all copies go. A null text is empty. Ids may be null or repeat:
    equal rows count as copies of each other. New columns whose name is taken get a leading
    underscore; an empty table gives an empty table.
    """
    return runs.without_repeats(
        docs, id_col, text_col, runs.WORDS, length, core, fm_intervals, ["n_words", "n_removed", "n_spans", "kept"],
        keep, crowd=crowd,
    )


def deduped(docs: DataFrame, text: str = "text", length: str = "n_chars", **how) -> DataFrame:
    """The documents with what is left of their text; texts without repeats stay as they are."""
    made = substring_dedup(docs, text_col=text, **how)
    removed, kept = made.columns[-3], made.columns[-1]
    new = F.when(F.col(removed) > 0, F.col(kept).cast("string")).otherwise(F.col(text))
    out = [
        new.alias(c) if c == text
        else F.when(F.col(removed) > 0, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c == length else F.col(c)
        for c in docs.columns
    ]
    return made.select(*out)


def op1_substring_dedup(spark, sf_dir):
    made = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}

ORACLES = {
    "op1_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, range(35) r(k)
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), spans AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone)
  WHERE before IS NULL OR before < i - 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN spans s USING (doc_id)""",
}
