import datetime as dt

from pyspark.sql import functions as F

from codelode.streaming import windows

T0 = dt.datetime(2025, 1, 1)


def folder(spark, tmp_path, rows):
    path = tmp_path / "in"
    spark.createDataFrame(rows, windows.EVENTS).coalesce(1).write.parquet(str(path / "e1"))
    return str(path / "e1")


def stream(spark, path):
    return windows.event_stream(spark, path, "*.parquet")


def rows():
    return [(i, T0 + dt.timedelta(hours=h), u, "view", 1.0, None) for i, (h, u) in enumerate([(0, 1), (1, 1), (30, 1), (2, 2), (2, 2)])]


def test_windows(spark, tmp_path):
    path = folder(spark, tmp_path, rows())
    out = windows.to_table(windows.tumbling_counts(stream(spark, path)), "t")
    assert sorted(r.n for r in out.collect()) == [1, 4]
    out = windows.to_table(windows.sessions(stream(spark, path)), "s")
    assert sorted((r.user_id, r.n) for r in out.collect()) == [(1, 1), (1, 2), (2, 2)]
    out = windows.to_table(windows.sliding_counts(stream(spark, path), "1 hour", "1 hour"), "l")
    assert out.filter("user_id = 2").first().n == 2


def test_dedupe_debounce_and_join(spark, tmp_path):
    path = folder(spark, tmp_path, rows())
    out = windows.to_table(windows.deduplicated(stream(spark, path), ["user_id"], "100 hours"), "d", "append")
    assert out.count() == 2
    out = windows.to_table(windows.debounced(stream(spark, path), 3600.5), "b", "append")
    assert sorted(r.event_id for r in out.collect())[:1] == [0] and out.count() == 3
    files = spark.createDataFrame([(1, "a.py")], "user_id long, path string")
    out = windows.to_table(windows.enriched(stream(spark, path), files, "user_id").select("event_id", "path"), "j", "append")
    assert out.filter(F.col("path").isNull()).count() == 2
