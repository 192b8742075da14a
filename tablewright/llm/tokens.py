"""Words and hashes of many texts at once, on numpy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: odd multiplier of the polynomial hash over bytes and its inverse modulo 2^64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: bytes of text that are turned into arrays at once
BLOCK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, U)
        have[1] = U(base)
        span = 2
        while span < size:
            have[span : 2 * span] = have[:span] * U(pow(base, span, 1 << 64))
            span *= 2
        _POWERS[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = BASE^i * (hash of values[i:j])."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of values[start:end]; the length counts."""
    raw = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
    return mixed(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


_BYTE = mixed(np.arange(1, 257, dtype=U))


def byte_values(data: bytes) -> np.ndarray:
    """A random-looking number for each byte."""
    return _BYTE[np.frombuffer(data, np.uint8)]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def chunks(data: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Bounds that cut an array of bytes into parts of about ``size`` without cutting a word."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data):
            space = np.flatnonzero(SPACE[data[end : end + size]])
            if len(space):
                end += int(space[0])
                break
            end = min(end + size, len(data))
        yield at, end
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    hashes, starts = [np.empty(0, U)], [np.empty(0, np.int64)]
    for at, end in chunks(data, 2 * BLOCK):
        part = data[at:end]
        begin, stop = word_spans(part)
        hashes.append(span_hash(prefix_hash(_BYTE[part]), begin, stop))
        starts.append(begin + at)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(np.concatenate(starts), np.concatenate(([0], np.cumsum(sizes))))
    return np.concatenate(hashes), np.diff(bounds)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column (null: empty) as bytes, a few at a time: (row of the first, texts)."""
    first, held, total = 0, [], 0
    for row, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_py() or b""
        held.append(text)
        total += len(text)
        if total >= size:
            yield first, held
            first, held, total = row + 1, [], 0
    if held:
        yield first, held


def text_key(docs_text):
    """A hash of the text that, with the id, names a row where ids repeat or are null."""
    from pyspark.sql import functions as F

    return F.xxhash64(F.coalesce(docs_text.cast("binary"), F.lit(b"")), docs_text.isNull())
