"""Token sequences filled by minimum bin slack.

A document becomes the ids of a public byte-level vocabulary and a closing id. Full windows of
a long document are sequences at once; the rests are dealt by hash over the partitions, where each
task keeps a stock of some thousand pieces as a multiset of lengths. A window takes the longest
piece of the stock and, of all multisets of the other lengths, the one whose sum is closest to
what is left: a subset-sum over bits, one shift for each length and power of two of its count,
until the wanted sum is reached. The bits kept after each shift lead back to the counts.

What a window still lacks is cut from the longest piece left. Sequences shorter than the window
are not padded if their length is a power of two, so the last pieces of a task, less than a
window, are cut there. Nothing is padded then, and only these cuts divide a document.
"""

from __future__ import annotations

import os
from bisect import bisect_right, insort
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
from tablewright.llm.packing import TOKEN, id_type

WINDOW, CLOSING = 1024, 0
#: words whose ids a task keeps before it starts anew
KEPT_WORDS = 1_000_000
#: pieces that a task holds before it fills windows, and those it keeps for choice while more come
STOCK, LEAST_STOCK = 8192, 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known(dict):
    """Numbers words as they are asked for; ``new`` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Words:
    """Ids of texts, word by word, by the vocabulary of a file; the ids of words met before are kept in an array.

    Words end where the vocabulary's pattern always ends one. New words go to the library many at a
    time, with a special token between them, at which it cuts whatever stands beside it.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data.decode())
        self.n_vocab = self.model.get_vocab_size()
        added = {i: t for i, t in self.model.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word)}
        self.specials = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.border = next(iter(added), None)
        self.between = added[self.border].content if added else None
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.flat = np.empty(0, np.uint32)
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        if self.between is None:
            made = [self.whole(w) for w in words]
            size, ids = np.fromiter(map(len, made), np.int64, len(made)), np.concatenate(made)
        else:
            ids = self.whole(self.between.join(words))
            border = ids == self.border
            ends = np.append(np.flatnonzero(border), len(ids))
            size, ids = np.diff(ends, prepend=-1) - 1, ids[~border]
        self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, ids)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.clear()
        each = [TOKEN.findall(t.decode()) for t in texts]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        kinds = np.fromiter(map(self.known.__getitem__, chain.from_iterable(each)), np.int64, int(counts.sum()))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        size = self.size[kinds]
        begin = np.cumsum(size) - size
        place = np.repeat(self.first[kinds] - begin, size) + np.arange(int(size.sum()))
        text = np.repeat(np.arange(len(texts)), counts)
        return self.flat[place], np.bincount(text, size, len(texts)).astype(np.int64)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, in order, and the number of ids of each; texts with special tokens are encoded whole."""
        special = {k for k, t in enumerate(texts) if any(s in t for s in self.specials)}
        if not special:
            return self._plain(texts)
        flat, counts = self._plain([b"" if k in special else t for k, t in enumerate(texts)])
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for k in special:
            parts[k] = self.whole(texts[k].decode())
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


@lru_cache(2)
def words_of(data: bytes) -> Words:
    return Words(data)


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary, window: int, closing: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns text, id, key become (id, key, start, total, ids) rows of at most ``window`` ids."""
    words = words_of(vocabulary.value)
    kind = id_type(words.n_vocab)
    end = np.array([closing], kind).tobytes()
    width = len(end)
    for batch in batches:
        for first, texts in tokens.blocks(batch.column(0)):
            ids, counts = words.ids(texts)
            flat = ids.astype(kind).tobytes()
            owner, start, total, data, at = [], [], [], [], 0
            for k, count in enumerate(counts.tolist()):
                mine = flat[width * at : width * (at + count)] + end
                for begin in range(0, count + 1, window):
                    owner.append(first + k)
                    start.append(begin)
                    total.append(count + 1)
                    data.append(mine[width * begin : width * (begin + window)])
                at += count
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(take), batch.column(2).take(take), pa.array(start, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(data, pa.binary())], names=names,
            )


def closest(stock: dict[int, int], capacity: int, lengths: list[int]) -> dict[int, int]:
    """How many pieces of each length sum up closest to ``capacity`` without exceeding it.

    ``lengths`` are those of the stock in increasing order. Bit s of ``reached`` tells that some
    multiset has sum s; ``layers`` keeps what was reached before a number of pieces of one length came in.
    """
    reached, mask, layers = 1, (1 << capacity + 1) - 1, []
    for length in reversed(lengths[: bisect_right(lengths, capacity)]):
        left, part = min(stock[length], capacity // length), 1
        while left:
            part = min(part, left)
            grown = (reached | reached << length * part) & mask
            if grown != reached:
                layers.append((reached, length, part))
                reached = grown
            left -= part
            part *= 2
        if reached >> capacity:
            break
    total, counts = reached.bit_length() - 1, {}
    for before, length, part in reversed(layers):
        if not before >> total & 1:
            counts[length] = counts.get(length, 0) + part
            total -= length * part
    return counts


class Stock:
    """Pieces (owner, start, ids) by length, and the windows that are filled from them."""

    def __init__(self, window: int, width: int):
        self.window, self.width = window, width
        self.pieces: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []  # increasing
        self.size = self.ids = 0

    def put(self, owner, start: int, data: bytes) -> None:
        length = len(data) // self.width
        if length not in self.counts:
            insort(self.lengths, length)
            self.pieces[length], self.counts[length] = [], 0
        self.pieces[length].append((owner, start, data))
        self.counts[length] += 1
        self.size += 1
        self.ids += length

    def take(self, length: int) -> tuple:
        piece = self.pieces[length].pop()
        self.counts[length] -= 1
        self.size -= 1
        self.ids -= length
        if not self.counts[length]:
            del self.pieces[length], self.counts[length]
            self.lengths.remove(length)
        return piece

    def cut(self, room: int) -> tuple:
        """``room`` ids from the beginning of the longest piece, which is longer; its rest stays."""
        owner, start, data = self.take(self.lengths[-1])
        self.put(owner, start + room, data[room * self.width :])
        return owner, start, data[: room * self.width]

    def window_full(self) -> list[tuple]:
        """The next full window; the stock has as many ids."""
        first = self.lengths[-1]
        chosen, room = [self.take(first)], self.window - first
        if room:
            for length, count in closest(self.counts, room, self.lengths).items():
                chosen += [self.take(length) for _ in range(count)]
                room -= length * count
        if room:  # no multiset reaches the capacity, so every piece left is longer than what it lacks
            chosen.append(self.cut(room))
        return chosen

    def rest(self) -> Iterator[list[tuple]]:
        """Less than a window: sequences of powers of two, the largest first."""
        while self.ids:
            room, chosen = 1 << self.ids.bit_length() - 1, []
            while room:
                fitting = [n for n in self.lengths if n <= room]
                chosen.append(self.take(fitting[-1]) if fitting else self.cut(room))
                room -= len(chosen[-1][2]) // self.width
            yield chosen


def _packed(batches: Iterator[pa.RecordBatch], window: int, width: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns id, start, total, ids, in the order of a hash, become pieces with their sequence and offset."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    stock, made = Stock(window, width), []

    def place(pieces: list[tuple]) -> None:
        nonlocal number
        at = 0
        for (owner, total), start, data in pieces:
            length = len(data) // width
            made.append((owner, start, length, total, number, at, data))
            at += length
        number += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) if made else [()] * 7
        ids = [np.frombuffer(d, f"<u{width}").astype("<u4").tobytes() for d in columns[6]]
        made.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip([*columns[:6], ids], out, strict=True)], schema=out
        )

    for part in batches:
        for owner, start, total, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if len(data) == window * width:
                place([((owner, total), start, data)])
            else:
                stock.put((owner, total), start, data)
            if stock.size >= STOCK:
                while stock.size > LEAST_STOCK and stock.ids >= window:
                    place(stock.window_full())
            if len(made) >= 4096:
                yield batch()
    while stock.ids >= window:
        place(stock.window_full())
        if len(made) >= 4096:
            yield batch()
    for pieces in stock.rest():
        place(pieces)
    yield batch()


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, window: int = WINDOW,
    closing: int = CLOSING,
) -> DataFrame:
    """One row for each piece: the id, start, length, doc_tokens, sequence_id, offset, ids.

    ``vocabulary`` is the path of a tokenizer's file with byte-level pieces, read on the driver; a
    document's ids are those of its whole text (special tokens as the file has them) and
    ``closing``. start counts the document's ids before the piece, doc_tokens all of them;
    sequence_id names the sequence, where the piece stands at offset; ids are little-endian numbers
    of four bytes. Every sequence has ``window`` ids, or a smaller power of two (at the end of a
    task's input); each id is in one piece. Null and empty texts have the closing id only. Rows that
    repeat, also in id, are documents of their own and are dealt by their place in the input. Sequence ids
    hold the number of the partition and agree between runs over the same files and settings.
    The id's column comes first under its own name, and other columns are ignored; an empty table
    gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if window < 1 or window & window - 1:
        raise ValueError("the window is a power of two")
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        data = f.read()
    width = np.dtype(id_type(words_of(data).n_vocab)).itemsize
    kind = docs.schema[id_col].dataType
    key = F.xxhash64(tokens.text_key(F.col(text)), F.col(id_col), F.monotonically_increasing_id())
    plain = docs.select(F.col(text).alias("text"), F.col(id_col).alias("id"), key.alias("key"))
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("key", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("total", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    cut = plain.mapInArrow(
        partial(_pieces, vocabulary=spark.sparkContext.broadcast(data), window=window, closing=closing, names=schema.fieldNames()),
        schema,
    ).withColumn("deal", F.xxhash64("key", "start"))
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.repartition(shares, "deal").sortWithinPartitions("deal", "key", "start")
    out = T.StructType([
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    packed = dealt.select("id", "start", "total", "ids").mapInArrow(partial(_packed, window=window, width=width, out=arrow), out)
    return packed.withColumnRenamed("id", id_col)


def op11_mbs_pack(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_mbs_pack": op11_mbs_pack}
