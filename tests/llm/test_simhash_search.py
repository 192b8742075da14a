"""SimHash groups and the permutation index against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import permutation, simhash

from .odd import ODD, words


def fingerprint(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, threshold=3):
    """Smallest place reachable from each place."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def test_groups_against_brute_force(spark, docs):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 2, 3, 40, 400, 900]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(["X", "Y"])
            rows.append((len(rows), " ".join(copy)))
    prints = [fingerprint(t) for _, t in rows]
    want = groups(prints)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs(rows)).collect()}
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(rows))] == want
    assert len(set(want)) < len(rows)
    stay = simhash.representatives(docs(rows))
    assert stay.columns == docs([]).columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(want))


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_links_lose_no_pair(spark, distance):
    rng = random.Random(distance)
    bits = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), distance):
            b ^= 1 << bit
        bits += [a, b]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    frame = spark.createDataFrame([(b,) for b in signed], "bits long")
    found = {(r.a, r.b) for r in simhash.links(frame).collect()}
    pairs = {tuple(sorted(signed[i : i + 2])) for i in range(0, len(signed), 2)}
    assert found == (pairs if distance <= 3 else set())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1002), (1001, 1002)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000, 1002: 1000}


def test_simhash_odd_tables(spark, docs):
    table = docs(ODD).withColumn("Fingerprint", F.lit("mine"))
    made = simhash.simhash_groups(table)
    assert "_fingerprint" in made.columns and made.count() == len(ODD)
    assert {r.component_id for r in made.collect() if r["_fingerprint"] == "0" * 16} == {1}
    assert simhash.simhash_groups(docs([])).count() == 0
    stay = simhash.representatives(docs(ODD)).collect()
    assert len(stay) == len({fingerprint(t) for _, t in ODD})
    assert {r.doc_id for r in simhash.representatives(docs([(None, words(9)), (None, words(9)), (None, words(9, 50))])).collect()} == {None}


def brute_nearest(rows, k=5):
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    for i, v in good:
        a = np.array(v)
        scored = sorted((-float(np.dot(a, w) / (np.linalg.norm(a) * np.linalg.norm(w))), j) for j, w in good if j != i)
        yield i, scored[:k]


def test_index_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    crowd = rng.normal(size=16)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    rows += [(2000 + i, (crowd + 0.01 * rng.normal(size=16)).tolist()) for i in range(500)]
    rows += [(5000 + i, crowd.tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    asked = frame.where("vec_id % 50 = 0")
    for r in permutation.nearest(frame, asked, shard=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for i, want in brute_nearest(rows):
        if i % 50:
            continue
        found = sorted(got[i])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(f[1] != i for f in found)
        keys = [(-f[2], f[1]) for f in found]
        assert keys == sorted(keys)
        hit += sum(f[2] >= -want[-1][0] - 1e-9 for f in found)
        total += 5
    assert hit / total >= 0.9


def test_index_small_and_odd(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [0.0, 2.0]), (7, [0.0, 2.0]), (100, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine")).withColumn("query", F.lit(1))
    got = permutation.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in found.items()} == {0: [50, 1, 7], 50: [0, 1, 7]}
    empty = frame.where("false")
    assert permutation.nearest(empty, empty).count() == 0
    assert permutation.nearest(frame, empty).count() == 0


def test_anchors_are_merged_and_not_sent_to_the_driver(spark):
    fingerprints = spark.createDataFrame([(0,), (1,), (0xFF00,)], "bits long")
    met = simhash.links(fingerprints)
    assert [tuple(r) for r in met.collect()] == [(0, 1)]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
