"""SentencePiece sampling and token packing: exact round trips and the right chances."""

import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import packing, pieces

from .odd import ODD


@pytest.fixture(scope="module")
def vocab():
    with open(pieces.default_model(), "rb") as f:
        return pieces.vocabulary(f.read(), 1.0)


def ways(token, vocab):
    """All segmentations of a token with their weights, by the definition."""
    known = {}
    for i, place in zip(vocab.ids.tolist(), vocab.weights.tolist(), strict=True):
        known[vocab.spelled[i]] = (i, place)
    out, stack = {}, [(0, (), 0.0)]
    while stack:
        at, path, weight = stack.pop()
        if at == len(token):
            out[path] = np.exp(weight)
            continue
        width = 1
        while at + width < len(token) and token[at + width] & 0xC0 == 0x80:
            width += 1
        for end in range(at + 1, len(token) + 1):
            if token[at:end] in known:
                i, w = known[token[at:end]]
                stack.append((end, (*path, i), weight + w))
        if token[at : at + width] not in known:
            spelled = tuple(int(vocab.bytes[b]) for b in token[at : at + width])
            stack.append((at + width, (*path, *spelled), weight + vocab.byte_weight))
    total = sum(out.values())
    return {p: w / total for p, w in out.items()}


@pytest.mark.parametrize("token", [b" the", b" token", "▁é𐍈".encode(), b" "])
def test_samples_follow_the_weights(vocab, token):
    want = ways(token, vocab)
    lattices = pieces.Lattices(vocab)
    n = 20000
    out, counts = lattices.sample([token] * n, np.arange(n, dtype=np.uint64) * np.uint64(977), np.zeros(n, np.int64))
    got = Counter(tuple(out[e - c : e].tolist()) for e, c in zip(np.cumsum(counts), counts, strict=True))
    assert set(got) <= set(want)
    for path, chance in want.items():
        assert abs(got[path] / n - chance) < 5 * np.sqrt(chance * (1 - chance) / n) + 1e-4


def test_round_trip_and_reruns(spark, docs):
    rng = random.Random(1)
    signs = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "日", "𐍈", "<s>", "<0x41>", "the ", "\x00", " ", "é"]
    rows = [(i, "".join(rng.choices(signs, k=rng.randrange(60)))) for i in range(200)] + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    table = docs(rows)
    first = {r.doc_id: r.pieces for r in pieces.encode(table).collect()}
    again = {r.doc_id: r.pieces for r in pieces.encode(table.repartition(7)).collect()}
    assert first == again
    other = {r.doc_id: r.pieces for r in pieces.encode(table, seed=12).collect()}
    assert first != other
    for r in pieces.decode(pieces.encode(table)).collect():
        assert r.decoded == r.text


def test_odd_tables(spark, docs):
    table = docs(ODD).withColumn("Pieces", F.lit("mine")).withColumn("decoded", F.lit(1))
    made = pieces.decode(pieces.encode(table), "_pieces")
    assert made.columns == [*table.columns, "_pieces", "_decoded"]
    for r in made.collect():
        assert r["_decoded"] == r.text and (r["_pieces"] == []) == (r.text == "")
    assert pieces.decode(pieces.encode(docs([]))).count() == 0


def test_long_words_are_cut_at_characters():
    text = ("é" * 1000 + " " + "日" * 500).encode()
    found = pieces.lattice_tokens(text)
    assert b"".join(found) == b" " + text and max(map(len, found)) <= pieces.LONGEST
    assert all(t.decode() for t in found)


def rows_of(packed, row=packing.ROW):
    out = {}
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == row and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row
        assert r.resets == r.cu_seqlens[:-1] and not ids[r.n_tokens :].any()
        assert all(a < b for a, b in pairwise(r.cu_seqlens))
        for d, p, a, b in zip(r.ids_of, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            out.setdefault(d, []).append((p, ids[a:b].tolist()))
    return {d: [i for _, part in sorted(x) for i in part] for d, x in out.items()}


def test_packing_is_lossless(spark, docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(["word ", "日", "\n", "  ", "x1"], k=rng.randrange(300)))) for i in range(150)]
    packed = packing.pack(docs(rows), row=64, shard_bytes=4000)
    with open(packing.default_ranks(), "rb") as f:
        coder = packing.encoder(f.read())
    got = rows_of(packed, 64)
    for i, text in rows:
        assert coder.decode_bytes(got.get(i, [])) == text.encode()
    assert packed.select("shard").distinct().count() > 3
    assert packed.select("shard", "row").distinct().count() == packed.count()


def test_packing_odd_tables(spark, docs, tmp_path):
    table = docs(ODD).withColumn("n", F.lit("mine")).withColumn("shard", F.lit(1))
    packed = packing.pack(table)
    pieces_of = Counter(d for r in packed.collect() for d in r.ids_of)
    assert pieces_of[4] == 3 and pieces_of[5] == 2 and pieces_of[1] == pieces_of[2] == 0 and pieces_of[None] == 1
    assert packing.pack(docs([])).count() == 0
    packing.write_matrices(packed, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == packed.count()


def test_best_fit_takes_the_tightest_row():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 41) for _ in range(60)), reverse=True)
        rows = packing.best_fit(sizes, 40)
        assert sorted(p for r in rows for p in r) == list(range(60))
        free: list[int] = []
        for size in sizes:  # the same by a plain scan
            fits = [f for f in free if f >= size]
            if fits:
                free[free.index(min(fits))] -= size
            else:
                free.append(40 - size)
        assert sorted(40 - sum(sizes[p] for p in r) for r in rows) == sorted(free)
