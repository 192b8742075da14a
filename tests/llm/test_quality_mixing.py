"""Quality rules and mixing against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing, quality

from .odd import ODD, words


def brute(rows, share, least, rest):
    """(counts, frequent words, failed, kept, cleaned) of each (id, text, host)."""
    per, hosts = defaultdict(set), Counter(h for _, _, h in rows)
    norm = lambda line: " ".join(x.decode() for x in line.encode().lower().split())
    for k, (_, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if line.encode().split():
                per[host, norm(line)].add(k)
    often = {key for key, held in per.items() if len(held) >= least and len(held) > share * hosts[key[0]]}
    for _, text, host in rows:
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        left = [x for x in text.split("\n") if (host, norm(x)) not in often or not x.encode().split()]
        lost = len(w) - sum(len(x.encode().split()) for x in left)
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover))
        yield (*counts, lost, failed, not failed and len(w) - lost >= rest * len(w)), "\n".join(left) if lost else text


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_quality_against_brute_force(spark, docs, most_sent):
    rng = random.Random(4)
    common = ["Accept  all Cookies", "share this page now please #", "© ü rights"]
    rows = []
    for k in range(80):
        lines = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(8))]
        for line in common:
            if rng.random() < 0.5:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice([line, line.replace("A", "a"), " " + line + "\t"]))
        if rng.random() < 0.2:
            lines += lines
        rows.append((k, "\n".join(lines), rng.choice(["x", "y", None])))
    rows += [(900 + i, t, "x") for i, (_, t) in enumerate(ODD)]
    got = quality.quality(docs(rows), share=0.2, least=4, most_sent=most_sent).collect()
    by_id = {r.doc_id: r for r in got}
    for (key, text, _), (want, cleaned) in zip(rows, brute(rows, 0.2, 4, 0.5), strict=True):
        r = by_id[key]
        assert tuple(r[c] for c in [*quality.COUNTS, *quality.VERDICTS]) == want
        assert r.cleaned_text == (None if text is None else cleaned)


def test_quality_odd_tables(spark, docs):
    table = docs(ODD).withColumn("kept", F.lit("mine")).withColumn("Line", F.lit(1))
    made = quality.quality(table)
    assert made.columns[: len(table.columns)] == table.columns and "_kept" in made.columns
    assert made.count() == len(ODD)
    kept = quality.cleaned(docs(ODD))
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 5, 6, 8]
    assert quality.quality(docs([])).count() == 0


def test_hosts_are_counted_alone(spark, docs):
    line = "one line that many documents of a host share with each other"
    rows = [(i, words(30, 100 * i) + "\n" + line, "big") for i in range(12)] + [(50 + i, words(30, 9000 + 100 * i) + "\n" + line, "small") for i in range(3)]
    got = {r.doc_id: r.n_frequent_words for r in quality.quality(docs(rows), clean=False).collect()}
    assert set(got.values()) == {0, 12} and all((got[i] > 0) == (i < 12) for i in got)


def shares(sizes, weights, most):
    """Targets by the rule of the contract, excess reshared step by step."""
    total, full = sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest = total - most * sum(sizes[i] for i in full)
        over = sum(weights[i] for i in open_)
        level = rest / over if over else 0.0
        new = {i for i in open_ if weights[i] * level > most * sizes[i]}
        if not new:
            return [most * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        full |= new


def test_mixing_targets_and_copies(spark, docs):
    rng = random.Random(3)
    names = ["b", "ä", "a", "Z", "zz", "", None]
    rows = [(i, words(rng.randrange(1, 40)), rng.choices(names, [400, 1, 9, 30, 2, 5, 3])[0]) for i in range(600)]
    rated = mixing.mix_rates(docs(rows)).collect()
    ordered = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    ordered = [n for n in ordered if any(r[2] == n for r in rows)]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in ordered]
    want = dict(zip(ordered, shares(sizes, [1 + k % 3 for k in range(len(ordered))], 3.0), strict=True))
    assert abs(sum(want.values()) - sum(sizes)) < 1e-6
    for r in rated:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[ordered.index(r.source)]
        rate = r.target / r.source_size
        digest = hashlib.md5(f"17:{r.doc_id}:{r.text}".encode()).hexdigest()
        assert r.copies == int(rate) + (int(digest[:13], 16) / 16**13 < rate - int(rate)) <= 3
    mixed = mixing.mix(docs(rows))
    assert mixed.columns == docs([]).columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rated if r.copies})


def test_mixing_odd_tables(spark, docs):
    table = docs([(i, t, s) for (i, t), s in zip(ODD, ["a", "b", None] * 9, strict=False)]).withColumn("Size", F.lit("mine"))
    rated = mixing.mix_rates(table)
    assert rated.columns == [*table.columns, "_size", "source_size", "target", "copies"]
    assert rated.count() == len(ODD) and rated.where("copies > 3 or copies is null").count() == 0
    assert mixing.mix_rates(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    blank = mixing.mix_rates(docs([(1, None), (2, " ")])).collect()
    assert [(r.target, r.copies) for r in blank] == [(0.0, 1), (0.0, 1)]
