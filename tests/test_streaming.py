"""Streams against the same statistics over all rows at once."""

from termweave.streaming import stats


def test_stream_equals_batch(spark, tmp_path):
    where = str(tmp_path / "rows")
    rows = [("a", 1.0), ("a", 2.0), ("b", None), ("c", 5.0), (None, 3.0), ("a", None)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "k string, v double").coalesce(1).write.mode("append").parquet(where)
    got = {r.k: tuple(r)[1:] for r in stats.run_available(spark, where, "k", "v").collect()}
    assert got == {r.k: tuple(r)[1:] for r in stats.summaries(spark.read.parquet(where), "k", "v").collect()}
    assert got["a"] == (2, 1.5, 0.5, 0.5**0.5, 1.0, 2.0, 3.0) and got["b"] == (0, None, None, None, None, None, None) and got[None][0] == 1


def test_empty_stream(spark, tmp_path):
    where = str(tmp_path / "none")
    spark.createDataFrame([], "k string, v double").write.parquet(where)
    assert stats.run_available(spark, where, "k", "v").count() == 0
