import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(autouse=True)
def importable(spark):
    """Workers import the package from the repository."""
    import __spark_entry__ as entry

    spark.sparkContext.environment["PYTHONPATH"] = entry.ROOT


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text, source) or (doc_id, text)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
