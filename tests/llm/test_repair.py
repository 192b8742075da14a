"""Repair against all edit sequences, and long conversations in blocks against one search."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(cost, audit) by trying every edit of every row with inserts between; rows are (initial, mark)."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        if any(m == repair.GONE and e != "D" for (_, m), e in zip(rows, edits, strict=True)):
            continue
        for inserts in product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""], strict=True))
            kept = [(e, r) for e, r in zip(edits, rows, strict=True) if e != "D"]
            cost = 2 * sum(inserts) + sum({"K": 0, "R": 2, "D": 3}[e] for e in edits) + sum(m == repair.SHORT for _, (_, m) in kept)
            if best is not None and (cost, audit) >= best:
                continue
            out, left = [], iter(rows)
            for letter in audit:
                row = next(left) if letter != "I" else None
                if letter == "K":
                    out.append(row[0])
                elif letter in "RI":
                    out.append("x")
            if not fits(out):
                continue
            best = (cost, audit)
    return best


def fits(initials):
    """Whether some choice of u and a for every x is well-formed."""
    if not initials:
        return True
    lead = initials[0] == "s"
    rest = initials[lead:]
    return bool(rest) and len(rest) % 2 == 0 and all(c in ("x", "ua"[k % 2]) for k, c in enumerate(rest))


ROWS = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([repair.CLEAN, repair.CLEAN, repair.SHORT, repair.GONE]))


@given(st.lists(ROWS, max_size=4))
@settings(max_examples=150, deadline=None)
def test_least_audit_against_all_edits(rows):
    assert repair.cheapest(rows, repair.EMPTY, repair.GOALS) == brute(rows)


@given(st.lists(ROWS, max_size=40), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_blocks_compose(rows, size):
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] or [[]]
    whole = [repair.solve(p, k == 0, k == len(parts) - 1) for k, p in enumerate(parts)]
    while len(whole) > 1:
        whole[-2:] = [repair.joined(whole[-2], whole[-1])]
    assert whole[0][repair.EMPTY, repair.EMPTY] == repair.cheapest(rows, repair.EMPTY, repair.GOALS)


def plain(rows, names):
    """The contract row by row: rows (conv, turn, role, text) in any order, ``names`` all conversations."""
    out = {}
    for name in names:
        mine = sorted(
            ((t is not None, t or 0, r, x) for c, t, r, x in rows if c == name), key=lambda m: (m[0], m[1], m[2].encode(), m[3].encode())
        )
        seen, marks, counts = set(), [], [0, 0, 0]
        for *_, role, text in mine:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], {0: repair.GONE, 1: repair.GONE, 2: repair.SHORT, None: repair.CLEAN}[fault]))
        turns = [m[1] for m in mine if m[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
        cost, audit = repair.cheapest(marks, repair.EMPTY, repair.GOALS)
        lines, left, state = [], iter(mine), 0
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter == "D":
                continue
            if letter == "K":
                lines.append(f"{row[2]}:{row[3]}")
                state = 1 if row[2][:1] == "u" else 0
            else:
                lines.append(f"{'assistant' if state else 'user'}:{row[3] if row else ''}")
                state = 1 - state
        out[name] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


ODD = [
    (1, 0, "user", "a."), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 5, "user", None), (1, None, "system", "s."),
    (None, None, None, None), (None, 1, "user", "x!"), (2, None, "user", ""), (2, None, "", "q?"), (3, 7, "assistant", " . \n"),
    (4, 0, "system", "s."), (4, 1, "user", "u."), (4, 2, "user", "u."), (5, 1, "tool", "x" * 50000 + "."), (5, 1, "tool", "y"), (6, 2, "user", "z\xa0"),
]


def test_odd_rows_against_the_contract(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    names = spark.createDataFrame([(i,) for i in (None, 1, 2, 3, 4, 5, 6, 99)], "conv_id long")
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD]
    found = got(repair.repaired(df.withColumn("conv", F.lit(1)).withColumn("AT", F.lit(2)), names))
    assert found == plain(filled, [None, 1, 2, 3, 4, 5, 6, 99])
    assert found[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    found = repair.damaged(spark.createDataFrame([(c, t, "assistant", "A. B! C?") for c in range(8) for t in range(12)] + [(None, None, None, None)], SCHEMA)).collect()
    want = []
    for c, t, role, text in [(c, t, "assistant", "A. B! C?") for c in range(8) for t in range(12)] + [(" ", " ", " ", " ")]:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (None if c == " " else c, None if t == " " else t, "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text))
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)


def test_a_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    random.seed(9)
    roles = ["user", "assistant", "system", "tool"]
    rows = [(7, t // 2, random.choice(roles), random.choice(["a.", "b", "", f"c{t}."])) for t in range(700)] + [(8, 1, "user", "u.")]
    assert got(repair.repaired(spark.createDataFrame(rows, SCHEMA))) == plain(rows, [7, 8])


def test_empty_table(spark):
    df = repair.repaired(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0 and df.columns[0] == "conv_id" and df.columns[-1] == "repaired_sha256"


def test_text_ids(spark):
    rows = [("x", 0, "user", "a."), ("y", 0, "assistant", "b.")]
    found = repair.repaired(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {r.conv_id: r.audit for r in found} == {"x": "KI", "y": "IK"}
