"""Minimum bin slack: ids of whole texts, windows as close as any multiset, nothing padded or lost."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import mbs

from .odd import ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    with open(mbs.default_vocabulary(), "rb") as f:
        return Tokenizer.from_str(f.read().decode())


def plain_ids(coder, text):
    return [*coder.encode(text or "", add_special_tokens=False).ids, mbs.CLOSING]


def check(pieces, want, window):
    """pieces are rows of ``pack``; ``want`` the ids of each document."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert p.length == len(ids) > 0 and p.doc_tokens == len(want[p.doc_id])
        sequences[p.sequence_id].append((p.offset, ids))
        documents[p.doc_id].append((p.start, ids))
    for doc, parts in documents.items():
        parts.sort()
        assert [i for _, ids in parts for i in ids] == want[doc]
        assert [s for s, _ in parts] == np.cumsum([0, *[len(ids) for _, ids in parts]])[:-1].tolist()
    assert documents.keys() == want.keys()
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, ids in parts:
            assert offset == at
            at += len(ids)
        assert at <= window and at & at - 1 == 0  # full, or a power of two: no padding


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_closest_sum_against_all_multisets(stock, capacity):
    best = 0
    for counts in product(*[range(c + 1) for c in stock.values()]):
        total = sum(n * c for n, c in zip(stock, counts, strict=True))
        if total <= capacity:
            best = max(best, total)
    got = mbs.closest(stock, capacity, sorted(stock))
    assert sum(n * c for n, c in got.items()) == best
    assert all(0 < c <= stock[n] for n, c in got.items())


@given(st.lists(st.integers(1, 16), max_size=60), st.sampled_from([4, 8, 16]))
@settings(max_examples=100, deadline=None)
def test_stock_loses_nothing(lengths, window):
    stock = mbs.Stock(window, 1)
    for k, n in enumerate(lengths):
        stock.put(k, 0, bytes(min(n, window)))
    total, out = sum(min(n, window) for n in lengths), []
    while stock.ids >= window:
        out.append(stock.window_full())
        assert sum(len(p[2]) for p in out[-1]) == window
    out += stock.rest()
    assert sum(len(p[2]) for w in out for p in w) == total and stock.size == 0


def test_uncut_windows_are_preferred():
    stock = mbs.Stock(16, 1)
    for k, n in enumerate([10, 9, 7, 6]):
        stock.put(k, 0, bytes(n))
    assert sorted(len(p[2]) for p in stock.window_full()) == [6, 10]
    assert sorted(len(p[2]) for p in stock.window_full()) == [7, 9]


def test_ids_are_those_of_whole_texts(coder):
    random.seed(3)
    white = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", "　", "​", "᠎"]
    marks = ["a", "Ü", "word", "'s", "12", "½", "!", "漢字", "😀", "é", "<|endoftext|>", "<|endof"]
    texts = ["".join(random.choice(white if random.random() < 0.5 else marks) for _ in range(30)) for _ in range(400)]
    words = mbs.Words(coder.to_str().encode())
    ids, counts = words.ids([t.encode() for t in texts])
    for part, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts, strict=True):
        assert [*part.tolist(), mbs.CLOSING] == plain_ids(coder, text), repr(text)


@pytest.mark.parametrize("window", [16, 1024])
def test_odd_rows(spark, docs, coder, window):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(90, "<|endoftext|>a"), (91, "x " * 5000)]
    got = mbs.pack(docs(rows).withColumn("ids", F.lit(1)).withColumn("START", F.lit(2)), window=window).collect()
    check(got, {i: plain_ids(coder, t) for i, t in rows}, window)


def test_repeated_and_null_ids(spark, docs, coder):
    got = mbs.pack(docs([(None, "a b c")] * 3 + [(1, "x")] * 40), window=8).collect()
    count = defaultdict(int)
    for p in got:
        count[p.doc_id] += p.length
    assert count == {None: 3 * len(plain_ids(coder, "a b c")), 1: 40 * len(plain_ids(coder, "x"))}


def test_empty_table(spark, docs):
    got = mbs.pack(docs([]))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def test_query_over_the_table(spark, coder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: plain_ids(coder, t) for i, t in texts.items()}
    check(mbs.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect(), want, 1024)
    got = mbs.op11_mbs_pack(spark, SF)
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
        "sequence_id": "bigint", "offset": "bigint",
    }
    for r in got.collect():
        part = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())


def test_runs_agree(spark):
    first, second = (mbs.op11_mbs_pack(spark, SF).collect() for _ in range(2))
    assert sorted(first) == sorted(second)
