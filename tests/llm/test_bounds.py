"""Bounds: archives closed by bytes, searches that run once, hits of repeated rows, spread joins."""

import glob
import os
import random
import time

import pytest

from tablewright.llm import runs, substring, warc

from .odd import words
from .test_warc_chat import archive, found


def noise(n, seed):
    return random.Random(seed).randbytes(n // 2).hex()


def test_archives_are_closed_by_bytes(spark, tmp_path):
    data = [(i, f"u{i}", noise(1_000 if i % 3 else 60_000, i)) for i in range(60)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    warc.write_pages(pages, str(tmp_path / "w"), records_per_file=40, bytes_per_file=100_000)
    sizes = [os.path.getsize(f) for f in glob.glob(str(tmp_path / "w" / "part-*"))]
    assert len(sizes) >= 6 and max(sizes) < 100_000 + 70_000
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert not [r for r in got if r.gap is not None]
    assert sorted((r.page_id, r.url, r.payload.decode()) for r in got) == data


def test_text_ids(spark, tmp_path):
    long = "x" * 200
    data = [("b/ü 1", "u", long), ("a", None, long), (None, "u", long), ("", "u", "small"), ("7", "u", "")]
    pages = spark.createDataFrame(data, "page_id string, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), ids="string").collect()
    told = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert told == {
        ("b/ü 1", "revisit", "a", 200), ("a", "response", None, 200), (None, "revisit", "a", 200),
        (None, "response", None, 5), ("7", "response", None, 0),
    }
    numbers = warc.read_archives(spark, str(tmp_path / "w"))
    assert {r.page_id for r in numbers.collect()} == {None, 7}
    with pytest.raises(ValueError):
        warc.read_archives(spark, str(tmp_path / "w"), ids="double")


def test_many_failures_in_a_bare_file_take_one_search():
    payloads, units = archive(3, 1)
    hurt = (warc.VERSION + b"\r\nContent-Length: x\r\n\r\n") * 40_000
    start = time.time()
    records, gaps = found(hurt + b"".join(units))
    assert time.time() - start < 20
    assert records == list(enumerate(payloads)) and gaps == [(0, len(hurt))]


def test_small_pages_meet_no_partner(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "") for i in range(500)] + [(500 + i, "u", "y" * 100) for i in range(5)],
                                  "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), payloads=False)
    assert got.where("record_type = 'response'").count() == 501
    assert {r.refers_to for r in got.where("record_type = 'revisit'").collect()} == {500}


def test_equal_rows_have_one_list_of_hits(spark):
    """The hits of a row do not grow with the number of rows that are equal to it."""
    sizes = []
    for n in (40, 400):
        docs = spark.createDataFrame([(1, words(400))] * n + [(2, words(60, 1000))], "doc_id long, text string")
        found = runs.repeats(docs, "doc_id", "text", runs.WORDS, 35, 14, substring.fm_intervals).collect()
        sizes.append({r.id: len(r.hits) for r in found})
        left = sorted((r.doc_id, r.n_removed) for r in substring.substring_dedup(docs).collect())
        assert left == [(1, 400)] * n + [(2, 0)]
    assert sizes[0] == sizes[1] and set(sizes[0]) == {1} and sizes[0][1] <= 400
