"""The corpus pipeline against the stages by brute force, and the guard of the entry."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from tablewright import llm

from .test_dedup import covered
from .test_quality_mixing import brute, shares
from .test_simhash_search import fingerprint, groups

SF = "/root/testdata/sf0.001"


def expected(rows):
    """doc_id -> (text, copies) by the contracts of the stages; rows are (doc_id, text, source)."""
    kept = [(i, cleaned, s) for (i, t, s), (verdict, cleaned) in zip(rows, brute(rows, 0.1, 10, 0.5), strict=True) if verdict[-1]]
    kept.sort(key=lambda r: r[0])
    roots = groups([fingerprint(t) for _, t, _ in kept])
    kept = [r for k, r in enumerate(kept) if roots[k] == k]
    words = [t.split() if t.isascii() else [w.decode() for w in t.encode().split()] for _, t, _ in kept]
    gone = covered(words, 35)
    left = [
        (i, " ".join(w for w, c in zip(ws, g, strict=True) if not c) if g.any() else t, s)
        for (i, t, s), ws, g in zip(kept, words, gone, strict=True)
    ]
    sources = sorted({s for _, _, s in left}, key=lambda s: s.encode())
    size = {i: len(t.encode().split()) for i, t, _ in left}
    sizes = [sum(size[i] for i, _, s in left if s == name) for name in sources]
    rate = {n: t / z if z else 1.0 for n, t, z in zip(sources, shares(sizes, [1 + k % 3 for k in range(len(sources))], 3.0), sizes, strict=True)}
    import hashlib

    out = {}
    for i, t, s in left:
        draw = int(hashlib.md5(f"17:{i}:{t}".encode()).hexdigest()[:13], 16) / 16**13
        copies = int(rate[s]) + (draw < rate[s] - int(rate[s]))
        if copies:
            out[i] = (t, copies)
    return out


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, (_, n) in want.items()})
    for r in got:
        assert r.text == want[r.doc_id][0] and r.n_chars == len(r.text)
        assert r.lossless and r.n_pieces == len(r.pieces)


def test_stages_keep_the_columns_of_documents(spark, docs):
    table = docs([(1, None, None), (None, "", "s"), (2, "a b", "s")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF).schema.names == table.schema.names, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_neardup", "substring_dedup", "mix_to_targets", "sentencepiece"]


@pytest.mark.parametrize("key", sorted(llm.all_oracles()))
def test_query_against_sql(spark, key):
    text, fine = compare(spark, duck(SF), SF, key, entry.queries()[key], entry.oracle_sql()[key])
    assert fine, text


def test_all_operators_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in llm.all_queries())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_entry_without_the_subpackage(tmp_path):
    root = Path(entry.ROOT)
    for item in root.iterdir():
        if item.name not in {"corpus_pipeline.py", "tablewright", ".git"}:
            (tmp_path / item.name).symlink_to(item)
    (tmp_path / "tablewright").mkdir()
    for item in (root / "tablewright").iterdir():
        if item.name not in {"llm", "__pycache__"}:
            (tmp_path / "tablewright" / item.name).symlink_to(item)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    done = subprocess.run(
        [sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), 'pipeline' in q)"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120,
    )
    assert done.stdout.split()[-1:] == ["False"] and int(done.stdout.split()[-2]) > 100, done.stderr[-500:]
