"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is a space and its bytes. Tokens of the lattice are a word with the space before it, a
single space or a line feed; no piece reaches over their ends (those made of several spaces have
no weight in the model). The weight of a piece is a power of its rank in the model. Per
distinct token the forward filter sums the weights of all ways to each place; per occurrence
the way back is drawn from these sums, for all tokens of a block at once. The random numbers
come from a hash of the row's key, the token's number and the step, so a row gives the same
pieces wherever and whenever it is encoded. A character that is no piece, and the sign that
stands for a space in the model, are spelled in byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import tokens
from tablewright.llm.common import fresh, table

U = np.uint64
TOKEN = re.compile(rb" ?[^ \n]+|[ \n]")
#: longer tokens are cut into lattices of their own, at characters
LONGEST = 256
#: edges of lattices a task keeps before it starts anew (some 16 bytes each)
KEPT_EDGES = 4_000_000
SPACE_SIGN = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


SLOTS = 1 << 20


def _hashes(strings: list[bytes]) -> np.ndarray:
    """The hashes that ``span_hash`` gives these strings."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(sizes) - sizes
    return tokens.span_hash(tokens.prefix_hash(tokens.byte_values(b"".join(strings))), begin, begin + sizes)


class _Flags:
    """A set of hashes that may hold a few more than were put in."""

    def __init__(self, hashes: np.ndarray):
        self.mask = U((1 << max(10, (8 * len(hashes)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(hashes & self.mask).astype(np.int64)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[(hashes & self.mask).astype(np.int64)]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room = np.empty(1 << 12, kind)
        self.size = 0

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            room = np.empty(max(end, 3 * len(self.room) // 2), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = more
        self.size = end


class Vocabulary:
    """Pieces of a model as bytes, their log weights and the ids of the byte pieces."""

    def __init__(self, model: bytes, power: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        self.spelled = [b""] * n
        self.bytes = np.zeros(256, np.int64)
        known: dict[int, tuple[int, float, int]] = {}
        heads: dict[int, set[bytes]] = {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[3:5], 16)
                self.spelled[i] = bytes([value])
                self.bytes[value] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.spelled[i] = piece.replace(SPACE_SIGN, " ").encode()
                if SPACE_SIGN not in piece[1:] and "\n" not in piece and " " not in piece:
                    data = self.spelled[i]
                    known[int(_hashes([data])[0])] = (i, -power * float(np.log1p(abs(m.get_score(i)))), len(data))
                    for end in range(1, len(data)):
                        heads.setdefault(end, set()).add(data[:end])
        self.longest = max(k[2] for k in known.values())
        # by length, what some longer piece begins with: a place is looked up no further than that
        self.heads = {k: _Flags(_hashes(list(v))) for k, v in heads.items()}
        keys = np.array(sorted(known), U)
        self.keys = keys
        self.ids = np.array([known[int(k)][0] for k in keys])
        self.weights = np.array([known[int(k)][1] for k in keys])
        self.byte_weight = -power * float(np.log1p(n))
        # the place of a key by its low bits; keys that share them are looked up in order
        slots = (keys & U(SLOTS - 1)).astype(np.int64)
        self.slot = np.full(SLOTS, -1, np.int32)
        self.slot[slots] = np.arange(len(keys))
        self.slot[np.flatnonzero(np.bincount(slots, minlength=SLOTS) > 1)] = -2

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their places in ids and weights."""
        place = self.slot[(hashes & U(SLOTS - 1)).astype(np.int64)]
        shared = np.flatnonzero(place == -2)
        place[shared] = np.minimum(np.searchsorted(self.keys, hashes[shared]), len(self.keys) - 1)
        hit = np.flatnonzero(place >= 0)
        hit = hit[self.keys[place[hit]] == hashes[hit]]
        return hit, place[hit]


@lru_cache(2)
def vocabulary(model: bytes, power: float) -> Vocabulary:
    return Vocabulary(model, power)


class Lattices:
    """Forward-filtered lattices of the tokens met so far; states are places in a token."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first = Grown(np.int32)  # of a token, the state before it
        self.last = Grown(np.int32)  # and the state after it
        self.states = 0
        self.edge = Grown(np.int32)  # of a state, its first edge back
        self.share = Grown(np.uint32)  # of an edge, the largest draw that takes it, among those of its state
        self.back = Grown(np.int32)
        self.piece = Grown(np.int32)

    def add(self, new: list[bytes]) -> None:
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        data = np.frombuffer(b"".join(new), np.uint8)
        owner = np.repeat(np.arange(len(new)), sizes)
        begin = np.cumsum(sizes) - sizes
        end_of = (begin + sizes)[owner]
        opens = (data & 0xC0) != 0x80
        opens[begin] = True
        prefix = tokens.prefix_hash(tokens.byte_values(data.tobytes()))
        chars = np.flatnonzero(opens)
        next_char = np.append(chars[1:], len(data))
        start, stop, piece, weight = [], [], [], []
        single = np.zeros(len(data), bool)
        char_end = np.zeros(len(data), np.int64)
        char_end[chars] = next_char
        at = chars
        for length in range(1, self.vocab.longest + 1):
            at = at[at + length <= end_of[at]]
            if not len(at):
                break
            hashes = tokens.span_hash(prefix, at, at + length)
            hit, place = self.vocab.find(hashes)
            found = at[hit]
            single[found[char_end[found] == found + length]] = True
            start.append(found)
            stop.append(found + length)
            piece.append(self.vocab.ids[place])
            weight.append(self.vocab.weights[place])
            at = at[self.vocab.heads[length].has(hashes)] if length in self.vocab.heads else at[:0]
        spelled = np.flatnonzero(~single[chars])  # characters that are no piece, byte by byte
        width = (next_char - chars)[spelled]
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        at = np.repeat(chars[spelled], width) + step
        start.append(at)
        stop.append(at + 1)
        piece.append(self.vocab.bytes[data[at]])
        weight.append(np.where(step == 0, self.vocab.byte_weight, 0.0))
        start, stop, piece, weight = map(np.concatenate, (start, stop, piece, weight))
        own = owner[start]
        offset = stop - begin[own]
        order = _sorted((((offset << 22) | stop) << 9) | (stop - start))
        start, stop, piece, weight, own, offset = (x[order] for x in (start, stop, piece, weight, own, offset))
        source, target = start + own, stop + own  # a state more than bytes for each token
        total = np.zeros(len(data) + len(new))
        for lo, hi in zip(*_groups(offset), strict=True):
            heads, _ = _groups(target[lo:hi])
            total[target[lo:hi][heads]] = np.logaddexp.reduceat(total[source[lo:hi]] + weight[lo:hi], heads)
        chance = np.exp(total[source] + weight - total[target])
        # edges of a state stand together, the likeliest first
        order = _sorted((((target << 12) | ((1.0 - np.minimum(chance, 1.0)) * 4095.0).astype(np.int64)) << 9) | (target - source))
        source, target, piece, chance = (x[order] for x in (source, target, piece, chance))
        heads, ends = _groups(target)
        running = np.cumsum(chance)
        running -= np.repeat(running[heads] - chance[heads], ends - heads)
        share = np.clip(running * 2.0**32, 1.0, 2.0**32) - 1
        share[ends - 1] = 2.0**32 - 1
        edge = np.zeros(len(data) + len(new), np.int32)
        edge[target[heads]] = heads + self.share.size
        first = begin + np.arange(len(new)) + self.states
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.edge.add(edge)
        self.share.add(share.astype(np.uint32))
        self.back.add(source + self.states)
        self.piece.add(piece)
        self.first.add(first)
        self.last.add(first + sizes)
        self.states += len(data) + len(new)

    def sample(self, found: list[bytes], seeds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all tokens, in order, and the number of pieces of each."""
        if self.share.size > KEPT_EDGES:
            self.clear()
        new = list(set(found).difference(self.known))
        for at in range(0, len(new), 1 << 13):
            self.add(new[at : at + (1 << 13)])
        kinds = np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))
        state, goal = self.last.room[kinds], self.first.room[kinds]
        first_edge, share, back, piece = self.edge.room, self.share.room, self.back.room, self.piece.room
        who = np.arange(len(found), dtype=np.int32)
        counts = np.zeros(len(found), np.int64)
        seed = seeds + numbers.astype(U) * U(0xA0761D6478BD642F)
        drawn = []
        step = 0
        while len(who):
            u = (tokens.mixed(seed[who] + U(step * 0xE7037ED1A0B428DB % (1 << 64))) >> U(32)).astype(np.uint32)
            edge = first_edge[state]
            short = np.flatnonzero(share[edge] < u)
            while len(short):
                edge[short] += 1
                short = short[share[edge[short]] < u[short]]
            drawn.append((who, piece[edge]))
            counts[who] += 1
            state = back[edge]
            go = state != goal[who]
            who, state = who[go], state[go]
            step += 1
        out = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        for before, (who, one) in enumerate(drawn):
            out[ends[who] - 1 - before] = one
        return out, counts


def _sorted(keys: np.ndarray) -> np.ndarray:
    """The order of different keys below 2^51, of up to 2^22."""
    bits = max(1, (len(keys) - 1).bit_length())
    if int(keys.max(initial=0)) >> (63 - bits):
        return np.argsort(keys)
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of equal neighbours."""
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return heads, np.append(heads[1:], len(values))


def lattice_tokens(text: bytes) -> list[bytes]:
    found = TOKEN.findall(b" " + text)
    if max(map(len, found)) <= LONGEST:
        return found
    out = []
    for token in found:
        while len(token) > LONGEST:
            cut = LONGEST
            while cut > LONGEST - 4 and token[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(token[:cut])
            token = token[cut:]
        out.append(token)
    return out


_LATTICES: dict[tuple[int, float], Lattices] = {}


def _encode(
    batches: Iterator[pa.RecordBatch], model, power: float, seed: int, verify: bool, names: list[str]
) -> Iterator[pa.RecordBatch]:
    """The row's own columns and its pieces; columns are text, key and own ones."""
    vocab = vocabulary(model.value, power)
    lattices = _LATTICES.setdefault((id(vocab), power), Lattices(vocab))
    for batch in batches:
        keys = tokens.mixed(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U) + U(seed))
        for first, texts in tokens.blocks(batch.column(0), 1 << 20):
            each = [lattice_tokens(t) if t else [] for t in texts]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            found = [t for part in each for t in part]
            number = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
            row = np.repeat(np.arange(len(texts)), counts)
            out, sizes = lattices.sample(found, keys[first + row], number)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, sizes, len(texts)).astype(np.int64))))
            rows = batch.slice(first, len(texts))
            missing = rows.column(0).is_null()
            pieces = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out), mask=missing)
            made = [*rows.columns[2:], pieces]
            if verify:
                same = [spelled(out[a:b].tolist(), vocab.spelled) == t for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
                made.append(pa.array(same))
            yield pa.RecordBatch.from_arrays(made, names=names)


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, power: float = 1.0, seed: int = 11,
    keep: list[str] | None = None, verify: bool = False,
) -> DataFrame:
    """The ``keep`` columns of every row (all if None) and pieces, a sampled segmentation as piece ids.

    With ``verify`` also lossless: the pieces were decoded at once and spell the text (null as empty).

    ``model`` is the path of a SentencePiece model, read on the driver. A piece of rank r weighs
    (1 + r) ** -power; a larger power keeps closer to the most frequent pieces. Rows with equal
    key and text get equal pieces, whatever their place; a null key is a key like any other. A
    null text gives null, an empty one no pieces. If the name is taken, the new column gets a
    leading underscore. An empty table gives an empty table.
    """
    own = docs.columns if keep is None else keep
    with open(model or default_model(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    name = fresh(own, "pieces")
    out = T.StructType([T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(own)])
    out, new = out.add(name, T.ArrayType(T.IntegerType())), [name]
    if verify:
        new.append(fresh([*own, name], "lossless"))
        out = out.add(new[-1], "boolean")
    plain = docs.select(
        F.col(text).alias("text"), F.xxhash64(key).alias("key"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(own)]
    )
    made = plain.mapInArrow(partial(_encode, model=sent, power=power, seed=seed, verify=verify, names=out.fieldNames()), out)
    return made.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(own)], *new)


def spelled(ids, spelling: list[bytes]) -> bytes:
    """The text of some pieces."""
    return b"".join([spelling[i] for i in ids])[1:]


def _decode(batches: Iterator[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    spelling = vocabulary(model.value, 1.0).spelled
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [None if ids is None else spelled(ids, spelling) for ids in _lists(part.column(0))]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(texts, pa.binary()).cast(pa.string())], names=names
            )


def _lists(column: pa.Array) -> Iterator[list[int] | None]:
    """The lists of a column, one after another."""
    offsets = column.offsets.to_pylist()
    values = column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_pylist()
    for k, good in enumerate(valid):
        yield values[offsets[k] : offsets[k + 1]].tolist() if good else None


def decode(encoded: DataFrame, pieces: str = "pieces", model: str | None = None, name: str = "decoded") -> DataFrame:
    """Every row and ``name``, the text its pieces spell: exactly what ``encode`` was given."""
    with open(model or default_model(), "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    own, new = encoded.columns, fresh(encoded.columns, name)
    out = T.StructType([T.StructField(f"__{i}", encoded.schema[c].dataType) for i, c in enumerate(own)]).add(new, "string")
    plain = encoded.select(F.col(pieces).alias("pieces"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(own)])
    made = plain.mapInArrow(partial(_decode, model=sent, names=out.fieldNames()), out)
    return made.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(own)], new)


def op2_sentencepiece(spark, sf_dir):
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], verify=True)
    return encoded.select(
        "doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "lossless"
    )


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
