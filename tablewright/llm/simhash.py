"""SimHash near-dedup by anchor-point covering.

Two fingerprints that differ in at most three bits differ in at most one bit of their lower or
of their upper half. For a half the anchors are a covering code of radius one: 31 bits of the
Hamming code, the last bit free. Every fingerprint has one home, the anchor that covers it, and
is replicated to every anchor within radius plus threshold (1 + 1) of each half: at most 17. So
of a near pair, one's home is among the other's anchors, and they are compared there.

Equal fingerprints are one row from the start, so a group of copies of any size costs what one
fingerprint costs. Components are found by rounds of large-star and small-star joins on the
links; each round is a checkpoint in the shared folder.
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

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: bits of a half that the Hamming code covers; the rest of its 32 bits is free
CODED = 31
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of all shingles of ``size`` words, repeats included; all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -size])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the bits that are set in more than half of its hashes (0 for none)."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    first = (np.cumsum(counts) - counts)[some]
    # byte lanes hold up to 255, so sums are taken over at most 255 hashes at a time
    pieces = -(-counts[some] // 255)
    piece_first = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    text_first = np.cumsum(pieces) - pieces
    for bit in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(bit) & LANES, piece_first)
        each = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text_first, axis=0)
        majority = 2 * each > counts[some][:, None]
        for byte in range(8):
            out[some] |= majority[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The row's own columns and its fingerprint as a signed number."""
    for batch in batches:
        for first, texts in tokens.blocks(batch.column(0)):
            each = [np.array(shingle_hashes(t, size), np.uint64) for t in texts]
            bits = majority_bits(np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)))
            rows = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(bits.view(np.int64))], names=names)


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Every row without its text, with __bits, the 64-bit fingerprint."""
    own = [c for c in docs.columns if c != text]
    out = T.StructType([T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(own)]).add("__bits", "long")
    plain = docs.select(F.col(text).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(own)])
    made = plain.mapInArrow(partial(_fingerprints, size=size, names=out.fieldNames()), out)
    return made.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(own)], "__bits")


def _syndromes(halves: np.ndarray) -> np.ndarray:
    """Sum of the numbers of the set bits among the CODED: 0 on the code, else the bit to flip."""
    out = np.zeros(len(halves), np.uint32)
    for bit in range(CODED):
        out ^= np.where(halves >> np.uint32(bit) & np.uint32(1), np.uint32(bit + 1), np.uint32(0))
    return out


def _anchors(batches: Iterator[pa.RecordBatch], reach: bool) -> Iterator[pa.RecordBatch]:
    """Rows (half, anchor, bits): the home of each half, or with ``reach`` every anchor within distance two."""
    flip = np.concatenate(([0], np.uint32(1) << np.arange(CODED, dtype=np.uint32))).astype(np.uint32)
    free = np.uint32(1 << CODED)
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 14):
            bits = batch.column(0)[at : at + (1 << 14)].to_numpy(zero_copy_only=False).astype(np.int64)
            for half in (0, 1):
                part = (bits.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
                syndrome = _syndromes(part)
                home = part ^ flip[syndrome]
                owner, anchor = [np.arange(len(part))], [home]
                if reach:
                    owner.append(np.arange(len(part)))
                    anchor.append(home ^ free)  # one flip to the code and the free bit: at most two
                    off = np.flatnonzero(syndrome)
                    for i in range(1, CODED + 1):  # two flips whose numbers add up to the syndrome
                        j = syndrome[off] ^ np.uint32(i)
                        pair = off[(j > i)]
                        owner.append(pair)
                        anchor.append(part[pair] ^ flip[i] ^ flip[j[j > i]])
                who = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), half, np.int32)), pa.array(np.concatenate(anchor).astype(np.int64)),
                     pa.array(bits[who])], names=["half", "anchor", "bits"],
                )


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of different fingerprints that differ in at most ``threshold`` (up to 3) bits.

    A pair shows up at several anchors; pairs are made distinct, singles never leave the join.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("two halves cover differences of up to three bits")
    schema = "half int, anchor long, bits long"
    homes = distinct.mapInArrow(partial(_anchors, reach=False), schema)
    reach = distinct.mapInArrow(partial(_anchors, reach=True), "half int, anchor long, other long")
    close = (F.col("bits") != F.col("other")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= threshold)
    # Spark sizes what Python makes of a row as one row, so it would send all anchors to the driver: both sides are merged
    met = homes.hint("merge").join(reach.hint("merge"), ["half", "anchor"]).where(close)
    return met.select(F.least("bits", "other").alias("a"), F.greatest("bits", "other").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that can be reached) for every node of the links (a, b).

    Large star: every node links its larger neighbours to its smallest one. Small star: every
    node links its smaller neighbours, itself included, to the smallest. Both keep what is
    connected; when a round changes nothing, every link leads to a root.
    """
    held = stored(edges.select("a", "b"), "links")
    before = None
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("low")
        )
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("node")).select(
            F.col("low").alias("a"), "b"
        ).distinct()
        # now a < b: small star gives every b its smallest a, and the other a of b the same one
        low = large.groupBy("b").agg(F.min("a").alias("low")).withColumnRenamed("b", "node")
        small = large.join(low, F.col("b") == F.col("node")).select(
            F.explode(F.array(
                F.struct(F.col("low").alias("a"), F.col("b").alias("b")), F.struct(F.col("low").alias("a"), F.col("a").alias("b"))
            )).alias("e")
        ).select("e.a", "e.b").where(F.col("a") < F.col("b")).distinct()
        held = stored(small, "links")
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return held.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _grouped(docs: DataFrame, id_col: str, text: str, size: int, threshold: int) -> DataFrame:
    """Every row without its text, with __bits, __root (names the component) and __least (its smallest id)."""
    marked = stored(fingerprints(docs, text, size), "fingerprints")
    distinct = marked.groupBy(F.col("__bits").alias("bits")).agg(F.min(id_col).alias("least"))
    roots = components(links(distinct.select("bits"), threshold))
    led = distinct.join(roots, F.col("bits") == F.col("node"), "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    smallest = led.groupBy("root").agg(F.min("least").alias("__least")).withColumnRenamed("root", "__root")
    named = led.join(smallest, F.col("root") == F.col("__root")).select(F.col("bits").alias("__of"), "__root", "__least")
    return marked.join(named, F.col("__bits") == F.col("__of")).drop("__of")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """Every row without its text, with fingerprint (16 hex digits) and component_id.

    A-Z is lowered, words are cut at ASCII white space, each shingle of ``size`` words counts as
    often as it occurs. A text without words (null too) has fingerprint zero and is linked like
    any other. component_id is the smallest id of all rows that can be reached over links of at
    most ``threshold`` bits; null ids count only where all are null. Equal rows are in one
    component. New columns whose name is taken get a leading underscore; an empty table gives an
    empty table.
    """
    own = [c for c in docs.columns if c != text]
    name, group = fresh(own, "fingerprint"), fresh(own, "component_id")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *[F.col(c).alias(f"own{i}") for i, c in enumerate(own)])
    return _grouped(plain, "id", "text", size, threshold).select(
        *[F.col(f"own{i}").alias(c) for i, c in enumerate(own)], F.lpad(F.lower(F.hex("__bits")), 16, "0").alias(name), F.col("__least").alias(group)
    )


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """One document of each component, that with the smallest id, with the columns of the input.

    Rows with one id are told apart by a hash of the text; of rows equal in both, any one stays.
    """
    key = tokens.text_key(F.col(text))
    named = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), key.alias("key"))
    return first_of_each(docs, _grouped(named, "id", "text", size, threshold), id_col, text)


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text: str) -> DataFrame:
    """Of the rows (id, key, __root) of each component the document with the smallest id; ``key`` is the text's."""
    own, stay_id, stay_key = (fresh(docs.columns, n) for n in ("__key", "__stay", "__stay_key"))
    stay = groups.groupBy("__root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("stay"))
    stay = stored(stay.select(F.col("stay.id").alias(stay_id), F.col("stay.key").alias(stay_key)), "representatives")
    once = docs.withColumn(own, tokens.text_key(F.col(text))).join(
        stay, F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_key))
    )
    if groups.groupBy("id", "key").count().where("count > 1").limit(1).count():
        once = once.dropDuplicates([id_col, own])
    return once.select(*docs.columns)


def op10_simhash_neardup(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_simhash_neardup": op10_simhash_neardup}
