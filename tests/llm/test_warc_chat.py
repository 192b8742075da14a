"""WARC archives, whole and damaged, and reply trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat, warc


def archive(n, seed=1):
    rng = random.Random(seed)
    payloads = [rng.randbytes(rng.randrange(400)) for _ in range(n)]
    units = [warc.member(warc.record(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None, False)) for i, p in enumerate(payloads)]
    return payloads, units


def found(data):
    """(page, payload) of the records and (start, end) of the gaps."""
    records, gaps = [], []
    for start, end, fields, block in warc.salvage(data):
        if fields is None:
            gaps.append((start, end))
        else:
            records.append((int(fields["warc-record-id"][10:-1]), block))
    return records, gaps


def test_whole_archive():
    payloads, units = archive(30)
    assert found(warc.EMPTY_MEMBER.join(units)) == (list(enumerate(payloads)), [])
    assert zlib.decompress(warc.EMPTY_MEMBER, 31) == b""
    plain = b"".join(zlib.decompress(u, 31) for u in units)
    assert found(plain) == (list(enumerate(payloads)), [])


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "drop head"])
@pytest.mark.parametrize("plain", [False, True])
def test_salvage_recovers_all_but_the_damaged(damage, plain):
    payloads, units = archive(12, 3)
    if plain:
        units = [zlib.decompress(u, 31) for u in units]
    for k in range(12):
        hurt = list(units)
        middle = len(hurt[k]) - (8 if not plain else 6)
        if plain and not payloads[k]:
            continue
        hurt[k] = {
            "flip": hurt[k][:middle] + bytes([hurt[k][middle] ^ 1]) + hurt[k][middle + 1 :],
            "cut": hurt[k][:middle], "junk": b"\x1f\x8b\x08junk WARC/1. " + hurt[k], "drop head": hurt[k][4:],
        }[damage]
        data = b"".join(hurt)
        records, gaps = found(data)
        lost = {k} - ({k} if damage == "junk" else set())
        assert [r for r, _ in records] == [i for i in range(12) if i not in lost]
        assert all(payloads[i] == p for i, p in records)
        begin = sum(map(len, hurt[:k]))
        size = len(hurt[k]) if lost else len(hurt[k]) - len(units[k])
        assert gaps == [(begin, begin + size)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_round_trip(spark, tmp_path):
    big = "<p>é" * 60
    rows = [(1, "http://a/ü?q=1 2\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x"), (6, "v", "x"), (None, "n", big),
            (9, "z", "WARC/1.1\r\n\r\n" * 30), (9, "z", "WARC/1.1\r\n\r\n" * 30), (10, "z", "WARC/1.1\r\n\r\n" * 30)]
    table = pages(spark, rows).withColumn("digest", F.lit("mine")).withColumn("of", F.lit(1))
    warc.write_pages(table, str(tmp_path / "w"), records_per_file=3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.gap is None for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = []
    for page, url, html in rows:
        first = {big: 1, rows[-1][2]: 9}.get(html)
        revisit = first is not None and page != first
        want.append((page, url, digest(html), len((html or "").encode()), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.page_id, r.url, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r.payload) == (b"" if r.record_type == "revisit" else r.payload) for r in got)


def test_damaged_file_is_read_on(spark, tmp_path):
    payloads, units = archive(20, 5)
    (tmp_path / "w").mkdir()
    units[7] = units[7][:20] + b"\0\0" + units[7][22:]
    (tmp_path / "w" / "part-00000.txt").write_bytes(b"".join(units))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in got if r.gap is None) == [i for i in range(20) if i != 7]
    (gap,) = [r for r in got if r.gap is not None]
    assert (gap.start, gap.end) == (sum(map(len, units[:7])), sum(map(len, units[:8])))


def test_no_pages(spark, tmp_path):
    warc.write_pages(pages(spark, []), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


MESSAGES = "tree long, node long, parent long, score double, role string, text string"


def brute_paths(rows, top):
    parent = {n: (p if p in {r[1] for r in rows} else None) for _, n, p, *_ in rows}
    score, tree = {r[1]: r[3] or 0.0 for r in rows}, {r[1]: r[0] for r in rows}
    inner = {p for p in parent.values() if p is not None}
    out = {}
    for leaf in parent:
        if leaf in inner:
            continue
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            out.setdefault(tree[leaf], []).append((-sum(score[n] for n in path), -len(path), leaf, path[::-1]))
    return {(t, k): p[3] for t, found_ in out.items() for k, p in enumerate(sorted(found_)[:top], 1)}


def test_best_branches_against_brute_force(spark):
    rng = random.Random(7)
    rows, node = [], 0
    for tree in [*range(12), None]:
        own = []
        for _ in range(rng.randrange(1, 40)):
            parent = rng.choice([None, *own[-3:], *own]) if own else rng.choice([None, 10**6])
            rows.append((tree, node, parent, rng.choice([None, 0.0, 1.0, 2.0, -1.0]), "user", f"t{node}"))
            own.append(node)
            node += 1
    rows += [(99, 5000, 5001, 1.0, "user", "x"), (99, 5001, 5000, 1.0, "user", "y"), (99, 5002, 5001, 1.0, "user", "z")]
    got = {}
    for r in chat.best_paths(spark.createDataFrame(rows, MESSAGES), top=2).collect():
        got.setdefault((r.tree, r.rank), []).append((r.place, r.node))
    got = {k: sorted(v) for k, v in got.items()}
    assert all([p for p, _ in v] == list(range(len(v))) for v in got.values())
    assert {k: [n for _, n in v] for k, v in got.items()} == brute_paths(rows, 2)


def test_template_is_reversible(spark):
    texts = ["", "\\", "<|", "\\<|im_end|>", "<|im_end|>\n<|im_start|>assistant\n", "<\\|", "a\nb\\n", "<<||", None]
    rows = [(r, t) for r in ["assistant", "us\ner", "<|im_start|>", "\\\n", "", None] for t in texts]
    made = chat.formatted(spark.createDataFrame(rows, "role string, text string")).collect()
    for r in made:
        assert chat.parse_turn(r.formatted) == (r.role or "", r.text or "")
        assert r.formatted.count("<|") == 2
        masked = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
        assert chat.unescape(masked) == ((r.text or "") if r.role == "assistant" else "")


def test_conversations(spark, tmp_path):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (None, 1, "user", "n"), (None, 0, "assistant", None)]
    rows += [(7, i, "user" if i % 2 == 0 else "assistant", f"é{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("mine"))
    got = {r.tree: r for r in chat.digests(chat.format_trees(chat.as_tree(table))).collect()}
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha(["user\na\n", "assistant\nb\n", "assistant\nb\n"]))
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha(["bb"]))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (1, sha(["\n\n"]), 0)
    assert got[None].turns_sha256 == sha(["assistant\n\n", "user\nn\n"])
    assert got[7].turns_sha256 == sha(f"{'user' if i % 2 == 0 else 'assistant'}\né{i}\n" for i in range(300))
    empty = table.where("false")
    assert chat.digests(chat.format_trees(chat.as_tree(empty))).count() == 0
