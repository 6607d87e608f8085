from __future__ import annotations

from framewise.operators.cache import latest
from framewise.streaming.cache_log import append_stream

SCHEMA = "relative_path string, pipeline_signature string, focus_score double"


def test_later_batches_win_and_nothing_comes_twice(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for value in (1.0, 2.0):
        spark.createDataFrame([("a", "s", value), (f"b{value}", "s", value)], SCHEMA).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(SCHEMA).parquet(source), log, state).awaitTermination(120)
    rows = spark.read.parquet(log)
    assert rows.count() == 4
    assert {(r["relative_path"], r["focus_score"]) for r in latest(rows.drop("batch")).collect()} == {("a", 2.0), ("b1.0", 1.0), ("b2.0", 2.0)}
