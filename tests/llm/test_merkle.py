"""The manifest against a plain construction of the trees."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import merkle

from .odd import ODD


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(level, places):
    """The root of a level of digests, and for each of the places its siblings (left, digest) up to it."""
    proofs, at = [[] for _ in places], list(places)
    while len(level) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            proofs[k].append((other < p, level[other] if other < len(level) else None))
            at[k] = p // 2
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], proofs


def plain(rows):
    """(doc_id, leaf, subroot, root, siblings) for rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = []
    for name in names:
        held = sorted(groups[name], key=lambda r: r[:3])
        low.append((held, *climb([r[2] for r in held], range(len(held)))))
    root, high = climb([subroot for _, subroot, _ in low], range(len(low)))
    return sorted((
        (str(r[3]), r[2], subroot, root, tuple(proof + up))
        for (held, subroot, proofs), up in zip(low, high, strict=True) for r, proof in zip(held, proofs, strict=True)
    ), key=str)


def steps(segment):
    out = []
    for i in range(0, len(segment), merkle.STEP):
        side, digest = segment[i], segment[i + 1 : i + merkle.STEP].hex()
        out.append((side == 1, digest if side else None))
    return tuple(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def got(df):
    return sorted(((str(r.doc_id), r.leaf, r.subroot, r.root, steps(r.segment)) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 33, 70])
def test_trees_of_all_shapes(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 3)  # several rounds of building
    rows = [(i, "s", "abc"[i % 3] if n > 8 and i % 5 else "a", i, f"t{i}") for i in range(n)]
    assert got(merkle.manifest(table(spark, rows), merkle.FIELDS)) == plain(rows)


def test_odd_rows(spark):
    rows = [(i, None if k % 3 else "", [None, "", "é", "z", "𝄞", "�"][k % 6], None if k % 4 else k, t) for k, (i, t) in enumerate(ODD)]
    rows += [(3, "s", "en", 1, "same")] * 5 + [(None, None, None, None, None)] * 2
    docs = table(spark, rows)
    assert got(merkle.manifest(docs, merkle.FIELDS)) == plain(rows)
    more = docs.withColumn("LEAF", F.lit(1)).withColumn("at", F.lit("x")).withColumn("own0", F.lit(2))
    found = merkle.manifest(more, merkle.FIELDS)
    assert found.columns[:6] == ["doc_id", "lang", "LEAF", "at", "own0", "_leaf"]
    assert found.where("at = 'x' AND LEAF = 1 AND own0 = 2").count() == len(rows)


def test_empty_table(spark):
    assert merkle.manifest(table(spark, []), merkle.FIELDS).count() == 0


def test_tampering_shows(spark):
    rows = [(i, "s", "de" if i % 3 else None, None if i == 5 else i, f"t{i}") for i in range(20)]
    whole = merkle.manifest(table(spark, rows), merkle.FIELDS)
    as_they_are = merkle.verified(whole, F.col("leaf"))
    assert as_they_are.where("NOT verified").count() == 0
    changed = merkle.verified(whole, F.when(F.col("doc_id") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")))
    assert [r.doc_id for r in changed.where("NOT verified").collect()] == [4]
    proof = whole.select("doc_id", merkle.proof_digest(F.col("segment")).alias("p")).collect()
    siblings = {i: s for i, _, _, _, s in plain(rows)}
    assert {str(r.doc_id): r.p for r in proof} == {i: h("".join(d for _, d in s if d)) for i, s in siblings.items()}
