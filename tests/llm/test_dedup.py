"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from .odd import ODD, words

from tablewright.llm import fm, lpf, runs, substring, suffix, tokens


def covered(texts, length, first=False):
    """Positions inside windows that start elsewhere (earlier), for lists or bytes."""
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    before, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = tuple(t[i : i + length])
            if (w in before) if first else (seen[w] > 1):
                gone[i : i + length] = True
            before.add(w)
        out.append(gone)
    return out


def texts_with_repeats(seed, n=60, size=90, letters=4):
    rng = random.Random(seed)
    base = [[str(rng.randrange(letters * 9)) for _ in range(size)] for _ in range(n)]
    for _ in range(n):
        a, b = rng.randrange(n), rng.randrange(n)
        i, j, k = rng.randrange(size), rng.randrange(size), rng.randrange(5, 50)
        base[a][i : i + k] = base[b][j : j + k]
    base += [list(b) for b in base[: n // 4]]
    base += [["p"] * 200, ["p", "q"] * 80, [], ["1"]]
    return base


@pytest.mark.parametrize("crowd", [20_000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, docs, seed, crowd):
    texts = texts_with_repeats(seed)
    made = substring.substring_dedup(
        docs([(i, " ".join(t)) for i, t in enumerate(texts)]), length=12, core=5, crowd=crowd, keep=["doc_id"]
    ).collect()
    gone = covered(texts, 12)
    assert len(made) == len(texts)
    for row in made:
        text, cover = texts[row.doc_id], gone[row.doc_id]
        assert (row.n_words, row.n_removed) == (len(text), int(cover.sum()))
        assert bytes(row.kept).decode() == " ".join(w for w, c in zip(text, cover, strict=True) if not c)


@pytest.mark.parametrize("crowd", [20_000, 1])
@pytest.mark.parametrize("first", [False, True])
def test_bytes_against_brute_force(spark, docs, first, crowd):
    texts = [" ".join(t) for t in texts_with_repeats(3, n=30, size=60)]
    made = lpf.suffix_dedup(
        docs(list(enumerate(texts))), length=25, core=9, first=first, crowd=crowd, keep=["doc_id"]
    ).collect()
    data = [t.encode() for t in texts]
    gone = covered(data, 25, first)
    for row in made:
        keep = np.frombuffer(data[row.doc_id], np.uint8)[~gone[row.doc_id]].tobytes()
        assert (row.n_bytes, row.n_removed, bytes(row.kept)) == (len(data[row.doc_id]), int(gone[row.doc_id].sum()), keep)


def test_odd_rows_and_extra_columns(spark, docs):
    from pyspark.sql import functions as F

    table = docs(ODD).withColumn("hits", F.lit(1)).withColumn("Kept", F.lit("mine")).withColumn("n_words", F.lit(None).cast("long"))
    made = substring.substring_dedup(table)
    assert made.columns == [*table.columns, "_n_words", "n_removed", "n_spans", "_kept"]
    got = made.collect()
    assert len(got) == len(ODD) and all(r["Kept"] == "mine" and r["n_words"] is None for r in got)
    for row in got:
        whole = len((row.text or "").split())
        assert row["_n_words"] == whole
        assert row["n_removed"] == (60 if row.text == words(60) else 0)
    made = lpf.suffix_dedup(table, first=True).collect()
    assert len(made) == len(ODD)
    assert {r.n_removed for r in made if r.text == "a" * 5000} == {4999}
    assert {r.n_removed for r in made if r.text == words(60)} <= {0, len(words(60))}


def test_empty_table(spark, docs):
    assert substring.substring_dedup(docs([])).count() == 0
    assert lpf.suffix_dedup(docs([])).count() == 0
    assert substring.deduped(docs([])).columns == docs([]).columns


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    monkeypatch.setattr(runs, "PART", 50)
    text = bytes(random.Random(1).choices(b"abc", k=400))
    for unit in (runs.BYTES, runs.WORDS):
        parts = text if unit == runs.BYTES else b" ".join(bytes([b]) for b in text)
        found = runs._block_runs([b"", parts, parts[:30]], unit, 20, 6)
        starts = sorted(s + i for t, s, n in zip(*found[:3], strict=True) for i in range(n) if t == 1)
        assert starts == list(range(381))


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(5)
    block = np.concatenate([np.append(rng.integers(1, 6, 40), 0) for _ in range(30)])
    index = fm.FmIndex(block, 64)
    text = "".join(map(chr, block))
    for _ in range(200):
        at, n = rng.integers(0, len(block) - 6), rng.integers(1, 6)
        pattern = block[at : at + n]
        if 0 in pattern:
            continue
        low, high = np.zeros(1, np.int64), np.full(1, len(block), np.int64)
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        want = sum(text.startswith("".join(map(chr, pattern)), i) for i in range(len(text)))
        assert high[0] - low[0] == want


def test_longest_previous_factors():
    rng = np.random.default_rng(6)
    block = np.concatenate([np.append(rng.integers(1, 4, 30), 0) for _ in range(8)])
    places = np.flatnonzero(block)
    got = suffix.previous_factors(suffix.Suffixes(block, 64, 4), places)
    later = suffix.previous_factors(suffix.Suffixes(block, 64, 1), places, later=True)

    def common(a, b):
        n = 0
        while block[a + n] and block[a + n] == block[b + n]:
            n += 1
        return n

    assert got.tolist() == [max([0, *(common(p, q) for q in places if q < p)]) for p in places]
    assert later.tolist() == [max([0, *(common(p, q) for q in places if q > p)]) for p in places]


def test_word_hashes_agree_with_split():
    texts = [b"", b" a  b\tc\n", "ü \xa0x".encode(), b"a"]
    hashes, counts = tokens.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert hashes[0] == hashes[-1] and len(set(hashes.tolist())) == 5


def test_query_digest(spark, docs, tmp_path):
    docs([(1, words(40)), (2, words(40)), (3, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in substring.op1_substring_dedup(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in (1, 2, 3)] == [(40, 40, empty)] * 2 + [(0, 0, empty)]
