"""Quality rules: cross-document line frequency beside rules on the single text.

Lines are normalised (words joined by one space, A-Z lowered) and hashed with their host. A
line is frequent if at least ``least`` documents of its host hold it and these are more than
``share`` of the host's documents. Frequent lines are removed; a document that keeps fewer
than ``rest`` of its words is depleted and rejected.

The counts are one aggregate with map-side combine over (host, line) hashes. Only lines over
the limits leave it: per host at most 1 / share times the mean number of lines of a document.
Their hashes go to every task while there are at most ``most_sent`` of them (16 MB); beyond
that, the lines of the documents are joined to them instead. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import tokens
from tablewright.llm.common import fresh, stored, table

SHARE, LEAST, REST, MOST_SENT = 0.1, 10, 0.5, 1_000_000
FEW_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICTS = ["n_frequent_words", "base_failed", "kept"]


def line_hash(host: bytes, words: list[bytes]) -> int:
    """Signed hash of a host and a normalised line."""
    value = xxhash.xxh3_64_intdigest(host + b"\0" + b" ".join(words).lower())
    return value - (1 << 64) if value >> 63 else value


def lines_of(text: bytes, host: bytes) -> dict[int, int]:
    """Words per distinct normalised line with a word."""
    found: dict[int, int] = {}
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            key = line_hash(host, words)
            found[key] = found.get(key, 0) + len(words)
    return found


def host_bytes(value) -> bytes:
    return b"\1" if value is None else b"\2" + str(value).encode()


def _lines(batches: Iterator[pa.RecordBatch], keyed: bool) -> Iterator[pa.RecordBatch]:
    """One row per document and distinct line: host and hash, and the document's key if ``keyed``."""
    for batch in batches:
        hosts = batch.column(1).to_pylist()
        for first, texts in tokens.blocks(batch.column(0)):
            rows: list[int] = []
            found: list[int] = []
            for k, text in enumerate(texts, first):
                lines = lines_of(text, host_bytes(hosts[k]))
                found += lines
                rows += [k] * len(lines)
            take = pa.array(rows, pa.int64())
            made = [batch.column(c).take(take) for c in ([1, 2] if keyed else [1])]
            yield pa.RecordBatch.from_arrays([*made, pa.array(found, pa.int64())], names=["host", "key", "line"][:: 1 if keyed else 2])


def frequent_lines(plain: DataFrame, share: float, least: int) -> DataFrame:
    """Hashes of the lines above the limits (column line); ``plain`` has __text and __host."""
    host = plain.schema["__host"].dataType.simpleString()
    hosts = plain.groupBy(F.col("__host").alias("name")).agg(F.count("*").alias("docs"))
    held = plain.select("__text", "__host").mapInArrow(partial(_lines, keyed=False), f"host {host}, line long")
    often = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return stored(
        often.join(hosts, F.col("host").eqNullSafe(F.col("name"))).where(F.col("n") > F.lit(share) * F.col("docs"))
        .select("line"), "frequent-lines",
    )


def repeated_words(hashes: np.ndarray, counts: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, the words inside windows of ``window`` words that the text holds twice or more."""
    n, doc = len(hashes), np.repeat(np.arange(len(counts)), counts)
    if n < window:
        return np.zeros(len(counts), np.int64)
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    prefix = tokens.prefix_hash(hashes)
    keys = tokens.mixed(tokens.span_hash(prefix, starts, starts + window) + doc[starts].astype(tokens.U))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(starts) + 1, bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    hits = starts[twice[:-1]]
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + window, -1)
    return np.bincount(doc, np.cumsum(cover[:n]) > 0, len(counts)).astype(np.int64)


def text_counts(texts: list[bytes]) -> list[np.ndarray]:
    """COUNTS of each text."""
    hashes, words = tokens.word_hashes(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate(([0], ends[:-1]))
    code_points = np.add.reduceat(((data & 0xC0) != 0x80) & ~tokens.SPACE[data], first, dtype=np.int64)
    symbols = np.add.reduceat(SYMBOLS[data], first, dtype=np.int64)
    repeated_lines = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                repeated_lines[k] += 1
            elif line and not line.isspace():
                seen.add(line)
    return [words.astype(np.int64), code_points, symbols, repeated_lines, repeated_words(hashes, words)]


def _judge(batches: Iterator[pa.RecordBatch], sent, rest: float, clean: bool) -> Iterator[pa.RecordBatch]:
    """Adds COUNTS and VERDICTS. Frequent lines come with the row (last column) or are sent to the task.

    Columns: text, host, the row's own columns, and, if none are sent, the row's frequent lines.
    """
    for batch in batches:
        hosts = batch.column(1).to_pylist()
        own = batch.num_columns - (sent is None)
        for first, texts in tokens.blocks(batch.column(0)):
            counts = text_counts(texts)
            lost = np.zeros(len(texts), np.int64)
            cleaned = list(texts)
            for k, text in enumerate(texts):
                often = sent.value if sent is not None else set(batch.column(own)[first + k].as_py() or ())
                if not often:
                    continue
                host = host_bytes(hosts[first + k])
                keep, found = [], 0
                for line in text.split(b"\n"):
                    words = line.split()
                    if words and line_hash(host, words) in often:
                        found += len(words)
                    else:
                        keep.append(line)
                if found:
                    lost[k], cleaned[k] = found, b"\n".join(keep)
            n, repeats = counts[0], counts[4]
            failed = (n < FEW_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
            kept = ~failed & (n - lost >= rest * n)
            rows = batch.slice(first, len(texts))
            made = [*rows.columns[2:own], *map(pa.array, [*counts, lost, failed, kept])]
            if clean:
                whole = rows.column(0).cast(pa.large_string())
                made.append(pa.array(
                    [c.decode() if lost[k] else whole[k].as_py() for k, c in enumerate(cleaned)], pa.string()
                ))
            yield pa.RecordBatch.from_arrays(made, names=[str(i) for i in range(len(made))])


def quality(
    docs: DataFrame, text: str = "text", host: str = "source", keys: list[str] | None = None, clean: bool = True,
    share: float = SHARE, least: int = LEAST, rest: float = REST, most_sent: int = MOST_SENT,
) -> DataFrame:
    """Every document (its ``keys`` columns, all if None) with counts and verdict, and the cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words (words in
    frequent lines), base_failed, kept, and with ``clean`` cleaned_text (the text without its
    frequent lines). A null text has no words and fails; cleaned it stays null. A null host is
    one host. Equal rows are documents of their own. Names that the input has already get a
    leading underscore. An empty table gives an empty table.
    """
    keys = docs.columns if keys is None else keys
    plain = docs.select(
        F.col(text).alias("__text"), F.col(host).alias("__host"), *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]
    )
    often = frequent_lines(plain, share, least)
    names: list[str] = []
    for name in [*COUNTS, *VERDICTS, *(["cleaned_text"] if clean else [])]:
        names.append(fresh(keys, name))
    kinds = [*["long"] * 6, "boolean", "boolean", "string"]
    out = T.StructType([T.StructField(f"__{i}", docs.schema[k].dataType) for i, k in enumerate(keys)])
    for name, kind in zip(names, kinds, strict=False):
        out = out.add(name, kind)
    if often.count() <= most_sent:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(r["line"] for r in often.collect()))
        rows = plain
    else:
        sent, key = None, tokens.text_key(F.col("__text")).alias("__key")
        host = plain.schema["__host"].dataType.simpleString()
        by_line = plain.select("__text", "__host", key).mapInArrow(
            partial(_lines, keyed=True), f"host {host}, key long, line long"
        )
        found = by_line.join(often, "line", "left_semi").groupBy("host", "key").agg(F.collect_set("line").alias("__lines"))
        rows = plain.withColumn("__key", key).join(
            found, F.col("__key").eqNullSafe(F.col("key")) & F.col("__host").eqNullSafe(F.col("host")), "left"
        ).select(*plain.columns, "__lines")
    judged = rows.mapInArrow(partial(_judge, sent=sent, rest=rest, clean=clean), out)
    return judged.select(*[F.col(f"__{i}").alias(k) for i, k in enumerate(keys)], *names)


def cleaned(docs: DataFrame, text: str = "text", length: str = "n_chars", **how) -> DataFrame:
    """The documents that are kept, without their frequent lines, with the columns of the input.

    Where the input has a column ``length``, it follows the text that is left.
    """
    judged = quality(docs, text, clean=True, **how)
    kept, new = judged.columns[-2:]
    out = [
        F.col(new).alias(c) if c == text
        else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == length else F.col(c)
        for c in docs.columns
    ]
    return judged.where(F.col(kept)).select(*out)


def op8_quality_rules(spark, sf_dir):
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keys=["doc_id"], clean=False)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "n_frequent_words")


QUERIES = {"op8_quality_rules": op8_quality_rules}

ORACLES = {
    "op8_quality_rules": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, source, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
), worded AS (
  SELECT doc_id, source, line, i, len(words) AS n,
         translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM lines WHERE len(words) > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), hosts AS (
  SELECT source, count(*) AS docs FROM docs GROUP BY source
), often AS (
  SELECT w.source, w.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM worded GROUP BY source, norm) w
  JOIN hosts h ON w.source IS NOT DISTINCT FROM h.source WHERE w.n >= 10 AND w.n > 0.1 * h.docs
), lost AS (
  SELECT w.doc_id, sum(w.n) AS n FROM worded w JOIN often o ON w.norm = o.norm AND w.source IS NOT DISTINCT FROM o.source
  GROUP BY w.doc_id
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) r(k) GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(length(array_to_string(d.words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(u.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_frequent_words
  FROM docs d LEFT JOIN dups u USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_frequent_words >= 0.5 * n_words AS kept
FROM counts""",
}
