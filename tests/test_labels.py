"""The label join against every label against every value."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablewright.functions import fuzzy
from tablewright.operators import clean, labels


def brute(values, names, cutoff):
    places, score = fuzzy._scorer()
    key = lambda text: " ".join(sorted(text.lower().split()))
    out = []
    for v in sorted(set(values)):
        best = [(-score(places(key(n)), len(key(n)), key(v)), n) for n in set(names) if key(n)]
        best = min((b for b in best if -b[0] >= cutoff), default=None)
        if best and key(v):
            out.append((v, best[1], pytest.approx(-best[0])))
    return out


def text(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("cutoff", [60.0, 80.0, 92.0])
def test_against_brute_force(spark, cutoff):
    random.seed(int(cutoff))
    word = lambda: "".join(random.choice("abcde ü") for _ in range(random.randint(1, 14)))
    names = [word() for _ in range(120)]
    values = [word() for _ in range(60)]
    for n in names[:100]:
        for _ in range(2):
            at = random.randrange(len(n) + 1)
            values.append(n[:at] + random.choice(["", "a", "zz", "e"]) + n[at + random.randrange(2) :])
    values += ["", " ", "x" * 100_000, names[0], names[0].upper()]
    got = rows(labels.closest_labels(text(spark, [*values, None]), text(spark, [*names, "", None], "l"), cutoff), "value")
    assert sorted(got) == brute(values, names, cutoff)


def test_empty_tables(spark):
    assert labels.closest_labels(text(spark, ["a"]), text(spark, []), 80.0).count() == 0
    assert labels.closest_labels(text(spark, []), text(spark, ["a"]), 80.0).count() == 0


def test_many_labels_compare_few(spark):
    """A registry of 5,000 labels: the candidates are a small share of all pairs."""
    names = spark.range(5_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("l"))
    values = spark.range(200).select(F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 15), F.lit("z")).alias("v"))
    got = labels.closest_labels(values, names, 85.0)
    assert got.count() == 200 and got.where("score < 93").count() == 0


def test_standardize_by_a_table(spark):
    df = spark.createDataFrame([(1, "Nrth"), (2, "completely other"), (3, None), (4, "soUTH ")], "i long, region string")
    out = clean.fuzzy_standardize(df, "region", labels=text(spark, ["North", "South"]), aliases={})
    assert [r.region for r in out.orderBy("i").collect()] == ["North", "Completely Other", None, "South"]
