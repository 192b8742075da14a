"""Repeated windows across documents: routing, index blocks and removal.

Two windows of ``length`` tokens that are equal have the same least hash among their ``core``-token
grams. Neighbouring windows of a document with the same least hash form a run, and the hash is
the run's core. So all occurrences of a window meet where the runs of its core are, and only
runs whose core occurs twice need an index:

1. every task cuts its documents into runs. Cores that it meets twice are settled there and
   send one marker, so a core has at most one row per task in the shuffle that counts the rest;
2. equal runs become one with a count. A run that alone has its core and occurs twice is
   repeated as a whole. The others fetch their text from one document and go, by core, to
   blocks of about ``BLOCK_TOKENS`` tokens, each with an index of its own;
3. the repeated windows are joined back to all documents that hold the run.

A core with more than ``crowd`` different runs would fill a block alone. Its runs are cut into
single windows, which need no index: equal ones are counted, spread by their digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import tokens
from tablewright.llm.common import fresh, stored

U = np.uint64
CROWD = 20_000
BLOCK_TOKENS = 1 << 19
#: tokens of a long text that are cut into runs at once, and bits for a place among them
PART, PLACE_BITS = 1 << 20, 23
#: runs a task holds to settle cores it meets twice
HELD_RUNS = 1 << 20

WORDS, BYTES = "words", "bytes"
HITS = "array<struct<start:int,n:int>>"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of(values: np.ndarray, counts: np.ndarray, length: int, core: int):
    """Runs of the texts whose tokens (as hashes) stand behind one another.

    Returns arrays: text, start (in its text), windows, core hash, run hash, inner (the core may
    occur twice inside the run).
    """
    n, width = len(values), length - core + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U), none.astype(U), none.astype(bool)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    prefix = tokens.prefix_hash(values)
    begin = np.arange(n - core + 1)
    grams = tokens.span_hash(prefix, begin, begin + core)
    # the place in the low bits makes the least gram of a window a known one: the first, or the last if equal
    high = grams & ~U((1 << PLACE_BITS) - 1)
    leftmost = sliding_least(high | begin.astype(U), width) & U((1 << PLACE_BITS) - 1)
    rightmost = U(n) - (sliding_least(high | (U(n) - begin.astype(U)), width) & U((1 << PLACE_BITS) - 1))
    window = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    if not len(window):
        return none, none, none, none.astype(U), none.astype(U), none.astype(bool)
    cores = grams[leftmost[window].astype(np.int64)]
    new = np.ones(len(window), bool)
    new[1:] = (cores[1:] != cores[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(window)))
    pieces = -(-size // width)  # periodic texts: no run has more windows than a core can join
    offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
    at, size = np.repeat(at, pieces) + offset, np.minimum(np.repeat(size, pieces) - offset, width)
    start, key = window[at], cores[at]
    run = tokens.span_hash(prefix, start, start + size + length - 1)
    inner = leftmost[start] != rightmost[start + size - 1]
    return text[start], start - first[text[start]], size, key, run, inner


def _segments(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and the number of tokens of each."""
    if unit == WORDS:
        return tokens.word_hashes(texts)
    return tokens.byte_values(b"".join(texts)), np.fromiter(map(len, texts), np.int64, len(texts))


def _block_runs(texts: list[bytes], unit: str, length: int, core: int):
    """``runs_of`` for a few texts; long ones are cut into overlapping parts first."""
    if unit == BYTES and max(map(len, texts)) > PART:
        parts, owner, shift = [], [], []
        for k, text in enumerate(texts):
            for at in range(0, max(1, len(text) - length + 1), PART):
                parts.append(text[at : at + PART + length - 1])
                owner.append(k)
                shift.append(at)
        made = []
        for k, part in enumerate(parts):
            found = runs_of(*_segments([part], unit), length, core)
            made.append((np.full(len(found[0]), owner[k]), found[1] + shift[k], *found[2:]))
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))
    values, counts = _segments(texts, unit)
    if len(values) <= 4 * PART:
        return runs_of(values, counts, length, core)
    made, at = [], 0
    for k, count in enumerate(counts):
        for part in range(0, max(1, count - length + 1), PART):
            own = values[at + part : at + min(count, part + PART + length - 1)]
            found = runs_of(own, np.array([len(own)]), length, core)
            made.append((np.full(len(found[0]), k), found[1] + part, *found[2:]))
        at += count
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_runs(batches: Iterator[pa.RecordBatch], unit: str, length: int, core: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, key, core, run, start, n, settled); a marker (start -1) stands for a settled core."""
    held: list[tuple] = []
    total = 0

    def flush():
        ids = pa.concat_arrays([h[0] for h in held])
        key, cores, run, start, size, inner = (np.concatenate([h[c] for h in held]) for c in range(1, 7))
        _, first, place, n = np.unique(cores, return_index=True, return_inverse=True, return_counts=True)
        twice = n[place] > 1
        settled = twice | inner
        mark = np.concatenate((first[n > 1], np.flatnonzero(inner & ~twice)))
        put = np.concatenate((np.arange(len(cores)), mark))
        start = np.concatenate((start, np.full(len(mark), -1)))
        settled = np.concatenate((settled, np.zeros(len(mark), bool)))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(put)), pa.array(key[put]), _signed(cores[put]), _signed(run[put]),
             pa.array(start.astype(np.int32)), pa.array(size[put].astype(np.int32)), pa.array(settled)],
            names=["id", "key", "core", "run", "start", "n", "settled"],
        )

    for batch in batches:
        keys = batch.column(2).to_numpy(zero_copy_only=False)
        for first, texts in tokens.blocks(batch.column(0)):
            text, start, size, cores, run, inner = _block_runs(texts, unit, length, core)
            if len(text):
                rows = text + first
                held.append((batch.column(1).take(pa.array(rows)), keys[rows], cores, run, start, size, inner))
                total += len(text)
            if total >= HELD_RUNS:
                yield from flush()
                held, total = [], 0
    if held:
        yield from flush()


def _text_of(whole: list[bytes] | bytes, start: int, n: int, length: int) -> bytes:
    part = whole[start : start + n + length - 1]
    return b" ".join(part) if isinstance(part, list) else part


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
NAMES = ["core", "run", "n", "times", "start", "text"]


def _fetch(batches: Iterator[pa.RecordBatch], unit: str, length: int) -> Iterator[pa.RecordBatch]:
    """The texts of the wanted runs of each document: id, key, NAMES."""
    for batch in batches:
        for row, text in enumerate(batch.column(0).cast(pa.large_binary())):
            data = text.as_py() or b""
            whole = data.split() if unit == WORDS else data
            wants = batch.column(3)[row].as_py()
            cols = list(zip(*[
                (w["core"], w["run"], w["n"], w["times"], w["start"], _text_of(whole, w["start"], w["n"], length))
                for w in wants
            ], strict=True))
            take = pa.array([row] * len(wants), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(take), batch.column(2).take(take),
                 *[pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)]], names=["id", "key", *NAMES],
            )


def _digests(batches: Iterator[pa.RecordBatch], unit: str, length: int) -> Iterator[pa.RecordBatch]:
    """A digest for every window of the runs: id, key, core, run, start, times, at, digest."""
    for batch in _fetch(batches, unit, length):
        core, run, n, times, start, text = (batch.column(c).to_pylist() for c in range(2, 8))
        rows: list[int] = []
        out: list[tuple] = []
        for k, data in enumerate(text):
            whole = data.split() if unit == WORDS else data
            for at in range(n[k]):
                rows.append(k)
                out.append((core[k], run[k], start[k], times[k], at, xxhash.xxh3_128_digest(_text_of(whole, at, 1, length))))
        cols = list(zip(*out, strict=True))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take),
             *[pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 2, pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)]],
            names=["id", "key", "core", "run", "start", "times", "at", "digest"],
        )


def _resolve(batches: Iterator[pa.RecordBatch], index: Callable, length: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Gathers whole cores into blocks, indexes each and gives the repeated windows of every run."""

    def rows() -> Iterator[tuple]:
        before = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != before:  # equal documents fetch a run twice
                    yield row
                before = row[:2]

    def settle(block: list[tuple]) -> pa.RecordBatch:
        found: list[list[dict]] = [[] for _ in block]
        for k, start, n in index([r[4] for r in block], [r[3] for r in block], length, first):
            found[k].append({"start": start, "n": n})
        kept = [k for k, s in enumerate(found) if s]
        return pa.RecordBatch.from_arrays(
            [pa.array([block[k][0] for k in kept], pa.int64()), pa.array([block[k][1] for k in kept], pa.int64()),
             pa.array([found[k] for k in kept], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))],
            names=["core", "run", "hits"],
        )

    block: list[tuple] = []
    size = 0
    for row in rows():
        if size >= BLOCK_TOKENS and row[0] != block[-1][0]:
            yield settle(block)
            block, size = [], 0
        block.append(row)
        size += row[2] + length
    if block:
        yield settle(block)


def repeats(
    docs: DataFrame, id_col: str, text_col: str, unit: str, length: int, core: int, index: Callable,
    first: bool = False, crowd: int = CROWD,
) -> DataFrame:
    """Per document that has some: id, key (of its text) and hits, the runs of repeated windows.

    A window is ``length`` neighbouring tokens (``unit``) of one text. It is repeated if the same
    tokens also start at another place of any text; with ``first``, only if they start at an
    earlier one (by id with null first, key of the text, place). ``index`` gets the texts of a
    block, in that order within a core, with their counts, and yields (text, first window, windows).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("id"), tokens.text_key(F.col(text_col)).alias("key")
    )
    cut = plain.mapInArrow(
        partial(_emit_runs, unit=unit, length=length, core=core),
        f"id {kind}, key long, core long, run long, start int, n int, settled boolean",
    )
    # settled rows need no partner: a salt keeps them apart, so a core has a row per task at most
    salt = F.when(F.col("settled"), F.xxhash64("key", "start")).otherwise(F.lit(0))
    met = cut.withColumn("met", F.count("*").over(Window.partitionBy("core", salt)))
    held = stored(
        met.where((F.col("start") >= 0) & (F.col("settled") | (F.col("met") > 1)))
        .select("id", "key", "core", "run", "start", "n"), "runs",
    )
    distinct = stored(held.groupBy("core", "run").agg(
        F.count("*").alias("times"), F.first("n").alias("n"), F.min(F.struct("id", "key", "start")).alias("at")
    ), "distinct-runs")
    kinds = distinct.groupBy("core").agg(F.count("*").alias("kinds")).withColumnRenamed("core", "of")
    ruled = stored(distinct.join(kinds, F.col("core") == F.col("of")).drop("of"), "ruled-runs")
    alone = (F.col("kinds") == 1) & (F.col("times") > 1) & F.lit(not first)
    whole = ruled.where(alone).select(
        "core", "run", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("n"))).alias("hits")
    )
    parts = [whole]

    def texts(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
        wants = rows.groupBy(F.col("at.id").alias("want_id"), F.col("at.key").alias("want_key")).agg(
            F.collect_list(F.struct("core", "run", "n", "times", F.col("at.start").alias("start"))).alias("wants")
        )
        own = F.col("id").eqNullSafe(F.col("want_id")) & (F.col("key") == F.col("want_key"))
        return plain.join(wants, own).select("text", "id", "key", "wants").mapInArrow(
            partial(work, unit=unit, length=length), f"id {kind}, key long, {schema}"
        )

    few = texts(
        ruled.where(~alone & (F.col("kinds") <= crowd)), _fetch,
        "core long, run long, n int, times long, start int, text binary",
    )
    parts.append(
        few.repartition("core").sortWithinPartitions("core", "id", "key", "start", "run")
        .select("core", "run", "n", "times", "text")
        .mapInArrow(partial(_resolve, index=index, length=length, first=first), f"core long, run long, hits {HITS}")
    )
    crowded = ruled.where(~alone & (F.col("kinds") > crowd))
    if crowded.limit(1).count():
        windows = texts(
            crowded, _digests, "core long, run long, start int, times long, at int, digest binary"
        ).dropDuplicates(["core", "run", "at"])
        place = F.struct("id", "key", (F.col("start") + F.col("at")).alias("place"))
        often = windows.groupBy(F.col("digest").alias("same")).agg(
            F.sum("times").alias("all"), F.min(place).alias("least")
        ).where(F.col("all") > 1)
        hit = windows.join(often, F.col("digest") == F.col("same"))
        if first:
            hit = hit.where(place != F.col("least"))
        parts.append(hit.groupBy("core", "run").agg(
            F.collect_list(F.struct(F.col("at").alias("start"), F.lit(1).alias("n"))).alias("hits")
        ))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.select(F.col("core").alias("of_core"), F.col("run").alias("of_run"), "hits")
    if first:
        again = distinct.select(F.col("core").alias("of_core"), F.col("run").alias("of_run"), "at")
        found = again.join(found, ["of_core", "of_run"], "left")
        whole_run = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("n")))
        is_first = F.struct("id", "key", "start").eqNullSafe(F.col("at"))
        hits = F.when(is_first, F.coalesce(F.col("hits"), F.array().cast(HITS))).otherwise(whole_run)
    else:
        hits = F.col("hits")
    moved = F.transform(hits, lambda h: F.struct((F.col("start") + h["start"]).alias("start"), h["n"].alias("n")))
    joined = held.join(found, (F.col("core") == F.col("of_core")) & (F.col("run") == F.col("of_run")))
    # rows that are equal have the same hits: a set, so that each gets its own and not those of all
    return joined.groupBy("id", "key").agg(F.flatten(F.collect_set(moved)).alias("hits"))


def _cover(hits, n: int, length: int) -> np.ndarray:
    """Which of n tokens lie in a repeated window."""
    edges = np.zeros(n + 1, np.int64)
    for hit in hits:
        edges[hit["start"]] += 1
        edges[min(n, hit["start"] + hit["n"] + length - 1)] -= 1
    return np.cumsum(edges[:n]) > 0


def _remove(batches: Iterator[pa.RecordBatch], unit: str, length: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The row's own columns, then tokens, removed tokens, removed runs and what is left of the text."""
    for batch in batches:
        own = batch.num_columns - 2
        for first, texts in tokens.blocks(batch.column(0)):
            all_hits = batch.column(1).slice(first, len(texts)).to_pylist()
            counts, removed, spans, left = [], [], [], []
            for text, hits in zip(texts, all_hits, strict=True):
                whole = text.split() if unit == WORDS else text
                gone = runs = 0
                if hits:
                    cover = _cover(hits, len(whole), length)
                    gone = int(cover.sum())
                    runs = int(cover[0]) + int(np.sum(cover[1:] & ~cover[:-1]))
                    keep = np.flatnonzero(~cover)
                    whole = [whole[k] for k in keep] if unit == WORDS else np.frombuffer(text, np.uint8)[keep].tobytes()
                counts.append(len(whole) + gone)
                removed.append(gone)
                spans.append(runs)
                left.append(b" ".join(whole) if unit == WORDS else whole)
            rows = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[2 : own + 2], *(pa.array(x, pa.int64()) for x in (counts, removed, spans)), pa.array(left, pa.binary())],
                names=names,
            )


def without_repeats(
    docs: DataFrame, id_col: str, text_col: str, unit: str, length: int, core: int, index: Callable,
    names: list[str], keep: list[str] | None = None, **how,
) -> DataFrame:
    """The ``keep`` columns of every row (all if None) and ``names``: tokens, removed, spans, kept bytes."""
    own = docs.columns if keep is None else keep
    found = repeats(docs, id_col, text_col, unit, length, core, index, **how)
    found = found.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "hits")
    plain = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("id"), tokens.text_key(F.col(text_col)).alias("key"),
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(own)],
    )
    joined = plain.join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    out = T.StructType([T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(own)])
    new = []
    for name in names:
        new.append(fresh([*own, *new], name))
        out = out.add(new[-1], "binary" if name == names[-1] else "long")
    made = joined.select("text", "hits", *[f"__{i}" for i in range(len(own))]).mapInArrow(
        partial(_remove, unit=unit, length=length, names=out.fieldNames()), out
    )
    return made.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(own)], *new)
