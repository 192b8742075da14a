"""Token ids packed into rows of fixed length, by best fit decreasing.

Documents become ids of a public byte-level vocabulary; a document longer than a row is cut into
pieces of a full row and a rest, so nothing is lost. Pieces are dealt by hash over shards of
about ``SHARD_BYTES`` of text and sorted by length in Spark; a task packs one shard after
another. The open rows of a shard stand in a segment tree over what they have free: the search
for the least free space that holds a piece takes two walks through the tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import tokens
from tablewright.llm.common import table

ROW, SHARD_BYTES = 2048, 1 << 24
#: white space as the vocabulary's pattern has it (Unicode White_Space)
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: a word with the space before it, or the white space before that; the pattern never matches over these cuts
TOKEN = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: words whose ids a task keeps before it starts anew
KEPT_WORDS = 800_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(ranks: bytes):
    import public_tokenizers
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


class WordIds:
    """Ids of the words met so far, one after another in an array."""

    def __init__(self, coder):
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, in order, and the number of ids of each."""
        if len(self.known) > KEPT_WORDS:
            self.clear()
        each = [TOKEN.findall(t.decode()) for t in texts]
        words = [w for part in each for w in part]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        new = list(set(words).difference(self.known))
        if new:
            encode = self.coder.encode_ordinary
            made = [encode(w) for w in new]
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(made), np.uint32)))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        kinds = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = self.size[kinds]
        begin = np.cumsum(size) - size
        place = np.repeat(self.first[kinds] - begin, size) + np.arange(int(size.sum()))
        text = np.repeat(np.arange(len(texts)), counts)
        return self.flat[place], np.bincount(text, size, len(texts)).astype(np.int64)


_WORDS: dict[int, WordIds] = {}


def _pieces(batches: Iterator[pa.RecordBatch], ranks, row: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns text, id, key become (id, key, piece, n, ids) rows of at most ``row`` ids."""
    coder = encoder(ranks.value)
    words = _WORDS.setdefault(id(coder), WordIds(coder))
    kind = id_type(coder.n_vocab)
    for batch in batches:
        for first, texts in tokens.blocks(batch.column(0)):
            ids, counts = words.ids(texts)
            ids = ids.astype(kind)
            owner, number, size, data, at = [], [], [], [], 0
            for k, count in enumerate(counts.tolist()):
                for piece, start in enumerate(range(0, count, row)):
                    part = ids[at + start : at + min(start + row, count)]
                    owner.append(first + k)
                    number.append(piece)
                    size.append(len(part))
                    data.append(part.tobytes())
                at += count
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(take), batch.column(2).take(take), pa.array(number, pa.int32()),
                 pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=names,
            )


def id_type(vocabulary: int) -> str:
    """Little-endian numbers of two bytes where the vocabulary fits, else four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class FreeSpace:
    """Open rows by free space, with a segment tree that tells the least space from a size on."""

    def __init__(self, row: int):
        self.width = 1 << row.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(row + 1)]

    def _add(self, space: int, change: int) -> None:
        node = space + self.width
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def best(self, size: int) -> int | None:
        """The least free space of at least ``size`` that some row has."""
        node = size + self.width
        if self.count[node]:
            return size
        while node > 1:  # up to the first right sibling that holds a row, then down its left side
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None

    def take(self, space: int) -> int:
        self._add(space, -1)
        return self.rows[space].pop()


def best_fit(sizes: list[int], row: int) -> list[list[int]]:
    """Rows as lists of the places of their pieces; ``sizes`` come in decreasing order."""
    free, rows = FreeSpace(row), []
    for place, size in enumerate(sizes):
        space = free.best(size)
        if space is None:
            rows.append([])
            number, space = len(rows) - 1, row
        else:
            number = free.take(space)
        rows[number].append(place)
        if space > size:
            free.put(space - size, number)
    return rows


def _pack(batches: Iterator[pa.RecordBatch], row: int, width: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns shard, id, piece, n, ids in order of shard and decreasing n become packed rows."""

    def packed(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = best_fit([h[2] for h in held], row)
        for at in range(0, len(rows), 512):
            made = []
            for number, places in enumerate(rows[at : at + 512], at):
                ends = np.cumsum([held[p][2] for p in places]).tolist()
                ids = b"".join(held[p][3] for p in places)
                made.append((
                    shard, number, ends[-1], [held[p][0] for p in places], [held[p][1] for p in places], [0, *ends],
                    [0, *ends[:-1]], ids.ljust(row * width, b"\0"),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    now, held = None, []
    for batch in batches:
        for shard, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and shard != now:
                yield from packed(now, held)
                held = []
            now = shard
            held.append(tuple(rest))
    if held:
        yield from packed(now, held)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str | None = None, row: int = ROW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Packed rows: shard, row, n_tokens, ids_of, pieces, cu_seqlens, resets, ids.

    ids_of and pieces name the documents and the number of the piece in each; cu_seqlens are the
    cumulative lengths from 0; positions start anew at resets; ids is a row of the matrix, ``row``
    little-endian numbers of two bytes (four for vocabularies over 65,536), zero after n_tokens.
    Pieces of a document in order are exactly its ids. ``ranks`` is the path of a vocabulary,
    read on the driver; words and runs of white space are encoded one by one, cut where the
    vocabulary's pattern always cuts, which gives the ids of the whole text. Texts without tokens
    (null, empty) have no piece. Equal rows are documents of their own; ids may be null. An
    empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    with open(ranks or default_ranks(), "rb") as f:
        data = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    width = np.dtype(id_type(encoder(data).n_vocab)).itemsize
    kind = docs.schema[id_col].dataType
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    plain = docs.select(F.col(text).alias("text"), F.col(id_col).alias("id"), tokens.text_key(F.col(text)).alias("key"))
    names = ["id", "key", "piece", "n", "ids"]
    schema = T.StructType([
        T.StructField("id", kind), *[T.StructField(n, k) for n, k in zip(
            names[1:], [T.LongType(), T.IntegerType(), T.IntegerType(), T.BinaryType()], strict=True)]
    ])
    cut = plain.mapInArrow(partial(_pieces, ranks=sent, row=row, names=names), schema)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "key", "piece"), F.lit(shards)))
    # enough partitions for one shard each, however the session counts its shuffle partitions
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n"), "id", "key", "piece")
    out = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids_of", T.ArrayType(kind)), T.StructField("pieces", T.ArrayType(T.IntegerType())),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("resets", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.BinaryType()),
    ])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    return ordered.select("shard", "id", "piece", "n", "ids").mapInArrow(partial(_pack, row=row, width=width, out=arrow), out)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, a folder for each shard, rows in order."""
    packed.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)


def op7_pack_tokens(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("ids_of", "doc_ids")


QUERIES = {"op7_pack_tokens": op7_pack_tokens}
