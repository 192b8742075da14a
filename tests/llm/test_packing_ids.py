"""Packed ids are those of the whole text, whatever its white space."""

import random

import pytest

from tablewright.llm import packing

BLANK = [" ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u3000"]


@pytest.fixture(scope="module")
def coder():
    with open(packing.default_ranks(), "rb") as f:
        return packing.encoder(f.read())


def ids_of(coder, texts):
    ids, counts = packing.WordIds(coder).ids([t.encode() for t in texts])
    ids, out = ids.tolist(), []
    for n in counts.tolist():
        out.append(ids[:n])
        ids = ids[n:]
    return out


def test_blank_lines_and_runs_of_spaces(coder):
    texts = ["a\n\n\nb", "a\n\n", "a\n\n b", "a\n\n\tb", "a  b", "a   ", "\n\n", "", " ", "it's 12\t\t x"]
    assert ids_of(coder, texts) == [coder.encode_ordinary(t) for t in texts]


def test_random_white_space(coder):
    rng = random.Random(7)
    texts = ["".join(rng.choices([*BLANK, "word", "it's", "12", "日本", "é", "...", "'ll"], k=rng.randrange(30))) for _ in range(3000)]
    assert ids_of(coder, texts) == [coder.encode_ordinary(t) for t in texts]
