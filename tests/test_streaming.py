"""The row-level rules give the same rows on a stream as in a batch."""

from conftest import rows
import sample
from tablewright.streaming import rowwise


def test_stream_equals_batch(spark, tmp_path):
    raw = sample.raw(spark)
    source = str(tmp_path / "in")
    raw.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(raw.schema).parquet(source)
    query = rowwise.write_cleaned(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    got = sorted(map(str, rows(spark.read.parquet(str(tmp_path / "out")))))
    assert got == sorted(map(str, rows(rowwise.clean_rows(raw))))
