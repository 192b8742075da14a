"""Columns of the input that bear the names of inner columns keep their values."""

from pyspark.sql import functions as F

from tablewright.llm import mixing, simhash

INNER = ["__key", "__stay", "__stay_key", "__size", "__source", "__target", "__weight", "__bits", "__root", "__least"]


def with_inner(df):
    return df.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in INNER])


def kept(rows):
    return all(r[n] == f"{n} {r.doc_id}" for r in rows for n in INNER)


def test_near_dedup(docs):
    df = with_inner(docs([(1, "a b c d e"), (2, "a b c d e"), (3, "quite another text")]))
    rows = simhash.representatives(df).collect()
    assert sorted(r.doc_id for r in rows) == [1, 3] and kept(rows)
    rows = simhash.simhash_groups(df).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3} and kept(rows)


def test_mixing(docs):
    df = with_inner(docs([(1, "a b", "x"), (2, "c", "y"), (3, None, None)]))
    rows = mixing.mix_rates(df).collect()
    plain = mixing.mix_rates(docs([(1, "a b", "x"), (2, "c", "y"), (3, None, None)])).collect()
    assert kept(rows) and len(rows) == 3
    assert {(r.doc_id, r.size, r.source_size, r.target, r.copies) for r in rows} == {
        (r.doc_id, r.size, r.source_size, r.target, r.copies) for r in plain
    }
    assert kept(mixing.mix(df).collect())
