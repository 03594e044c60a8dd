"""Operators that keep tables up to date, on small fixtures: skewed keys, repeated and removed rows, empty tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codelode.operators import edit, graph, logs, rank, store
from codelode.sources import remote
from codelode.streaming import windows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def log(spark):
    random.seed(3)
    data = [(i, random.choice("aaab") if i % 17 else None, random.choice([0.0, 5.0, 99.9, 100.0, 250.0, 251.0]) + 100 * random.randrange(9), random.randrange(9)) for i in range(400)]
    return spark.createDataFrame(data, "id long, k string, ts double, v int")


def test_spans_give_the_same_as_one_window(spark, log):
    order = Window.partitionBy("k").orderBy("ts", "id")
    got = logs.with_previous(log, ["k"], ["ts", "id"], ["id", "v"], 100.0).select("id", F.col("__before.id").alias("b"), F.col("__before.v").alias("w"))
    want = log.select("id", F.lag("id").over(order).alias("b"), F.lag("v").over(order).alias("w"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = logs.with_running_sum(log, ["k"], ["ts", "id"], F.col("v"), "s", 100.0)
    want = log.withColumn("s", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    assert rows(got, "id", "s") == rows(want, "id", "s")
    assert logs.with_previous(log.limit(0), ["k"], ["ts", "id"], ["v"]).count() == 0
    seconds = log.filter("k IS NOT NULL").withColumn("ts", F.col("ts").cast("long"))
    want = seconds.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k").orderBy("ts").rangeBetween(-60, 0)))
    assert rows(logs.rate_limited(seconds, 9, 60, "k"), "id", "n_recent") == rows(want, "id", "n")


def test_numbers_without_one_task(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 13)) for i in range(500)], "id long, score double").repartition(7)
    got = {r.id: r["rank"] for r in rank.ranked(df, "id").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-float(i * 7 % 13), i) for i in range(500)))}
    assert got == want and rank.ranked(df.limit(0), "id").count() == 0


def test_stored_index(spark, tmp_path):
    postings = spark.createDataFrame([(1, "graph", 2), (1, "ledger", 1), (2, "ledger", 3), (3, "other", 1)], "file_id long, token string, tf long")
    rank.save_index(postings, str(tmp_path / "i"))
    got = rank.bm25_stored(spark, str(tmp_path / "i"), ["graph", "ledger", "none"], "file_id", 10)
    want = rank.bm25(postings, ["graph", "ledger", "none"], "file_id", 10)
    assert rows(got, "file_id", "score", "rank") == rows(want, "file_id", "score", "rank") and got.count() == 2
    assert rank.bm25_stored(spark, str(tmp_path / "i"), ["none"], "file_id", 10).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "token_group" in plan


def test_index_is_built_once_per_version(spark, tmp_path):
    files = spark.createDataFrame([(1, "a/graph.py", "x")], "file_id long, path string, sha256 string")
    symbols = spark.createDataFrame([(1, "f", "q", "s", "d", "b")], "file_id long, name string, qualified string, signature string, docstring string, body_text string")
    path = rank.current_index(files, symbols, str(tmp_path))
    assert rank.current_index(files.repartition(3), symbols.limit(0), str(tmp_path)) == path
    assert rank.current_index(files.withColumn("sha256", F.lit("y")), symbols, str(tmp_path)) != path


def test_explore_query(spark):
    files = spark.createDataFrame([(i, f"f{i}.py") for i in range(1, 7)], "file_id long, path string")
    links = spark.createDataFrame([(1, 2, "calls"), (3, 2, "imports"), (3, 2, "calls"), (3, 4, "calls"), (5, 5, "calls")], "src_file long, dst_file long, kind string")
    scores = spark.createDataFrame([(1, 2.0), (4, 0.5)], "file_id long, score double")

    def found(**kw):
        return [(r.file_id, r.hop, r.via, r.reason, r.score) for r in graph.explore_query(scores, links, files, 1, **kw).orderBy("rank").collect()]

    seed = (1, 0, None, "bm25_seed", 2.0)
    assert found(hops=0) == [seed] and found(hops=-1) == [seed]
    assert found(hops=1) == [seed, (2, 1, "f1.py", "edge:calls", 0.0)]
    assert found(hops=9) == [seed, (2, 1, "f1.py", "edge:calls", 0.0), (3, 2, "f2.py", "edge:calls", 0.0), (4, 3, "f3.py", "edge:calls", 0.5)]
    assert found(hops=3, max_expanded=2) == found(hops=1)
    assert graph.explore_query(scores.limit(0), links, files).count() == 0


def test_enclosing_over_spans(spark):
    symbols = spark.createDataFrame([(1, 1, 1, 2000), (2, 1, 250, 300), (3, 1, 255, 256), (4, 2, 1, 9), (5, 1, 9, 3)], "symbol_id long, file_id long, line_start long, line_end long")
    places = spark.createDataFrame([(1, 1, 256), (2, 1, 257), (3, 1, 1999), (4, 1, 2001), (5, 2, 300), (6, 2, 1)], "place_id long, file_id long, line long")
    assert rows(graph.enclosing_symbols(places, symbols), "place_id", "symbol_id") == [(1, 3), (2, 2), (3, 1), (6, 4)]


def test_references_and_edits(spark):
    t = spark.createDataFrame([(1, "a run(run) rerun\nx\nrun"), (2, "nothing"), (3, None)], "file_id long, source_text string")
    assert rows(edit.references(t, "run"), "file_id", "line", "column") == [(1, 1, 2), (1, 1, 6), (1, 3, 0)]
    src = spark.createDataFrame([(1, "a.py", "one\n  two\n  three\nfour\n")], "file_id long, path string, source_text string")
    ask = spark.createDataFrame([(1, 2, 3, "taken"), (1, 3, 2, "taken"), (1, 2, 9, "taken"), (1, 1, 1, "a b"), (9, 1, 1, "x")], "file_id long, line_start int, line_end int, name string")
    out = {(r.error or "ok"): r for r in edit.extractions(src, ask).collect()}
    assert out["ok"].source_text == "one\n  taken()  # TODO: pass arguments\nfour\n\n\ndef taken():\n      two\n      three\n"
    assert out["ok"].diff.startswith("--- a/a.py\n+++ b/a.py\n@@") and "-  two\n" in out["ok"].diff
    assert set(out) == {"ok", "invalid line range", "the text has only 4 lines", "invalid identifier: a b", "file not found"}
    symbols = spark.createDataFrame([("f",), ("g",), ("g",)], "name string")
    texts = spark.createDataFrame([(1, "f() g()")], "file_id long, source_text string")
    assert edit.rename_by_name(symbols, texts, "f", "h").first().source_text == "h() g()"
    assert edit.rename_by_name(symbols, texts, "g", "h").count() == 0 and edit.rename_by_name(symbols, texts, "f", "g").count() == 0


def test_store_additions(spark):
    t = spark.createDataFrame([(1, "a", 0)], "k long, tag string, v int")
    more = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (2, "b", 6)], "k long, tag string, v int")
    assert rows(store.add_if_new(t, more, ["k", "tag"]), "k", "tag", "v") == [(1, "a", 0), (2, "b", 6)]
    assert store.latest_scan(spark.createDataFrame([(1.0, 2.0, 5), (3.0, 4.0, 6)], "started_at double, completed_at double, files_changed int")).first().files_changed == 6


def test_cache_expires_and_keeps_no_failures():
    now, asked = [0.0], []

    def fetch(address):
        asked.append(address)
        return '{"n": 1}' if "good" in address else "no json"

    cache = remote.Cache(lambda: now[0])
    assert cache.get("default", "good", fetch) == {"n": 1} == cache.get("default", "good", fetch) and len(asked) == 1
    now[0] = 301.0
    assert cache.get("default", "good", fetch) and len(asked) == 2
    assert cache.get("vcs", "bad", fetch) is None and cache.get("vcs", "bad", fetch) is None and len(asked) == 4
    assert remote.available({"a": "KEY_A", "b": None, "c": "KEY_C"}, {"KEY_A": "x"}) == ["a", "b"]


def test_switch_file(tmp_path):
    assert not remote.switched_off(str(tmp_path / "off"))
    (tmp_path / "off").write_text("")
    assert remote.switched_off(str(tmp_path / "off"))


def test_file_index_follows_changes(spark, tmp_path):
    index = windows.FileIndex(spark, str(tmp_path / "index"))
    assert index.files().count() == 0 and index.contains().count() == 0
    schema = "file_id long, path string, source_text string, seq long"
    index.update(spark.createDataFrame([(1, "a.py", "class A:\n    def f(self):\n        pass\n", 1), (2, "b.py", "def g():\n    pass\n", 1), (2, "b.py", "def old():\n    pass\n", 0)], schema))
    assert rows(index.symbols(), "file_id", "name") == [(1, "A"), (1, "f"), (2, "g")] and index.contains().count() == 1
    again = spark.createDataFrame([(1, "a.py", "def h():\n    pass\n", 2)], schema)
    index.update(again)
    index.update(again)
    assert rows(index.symbols(), "file_id", "name") == [(1, "h"), (2, "g")] and index.contains().count() == 0 and index.files().count() == 2
    index.update(spark.createDataFrame([(2, "b.py", None, 3)], schema))
    assert rows(index.symbols(), "file_id", "name") == [(1, "h")] and rows(index.files(), "path") == [("a.py",)]


def test_watched_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    pass\n")
    (tmp_path / "src" / "b.txt").write_text("no source")
    index = windows.FileIndex(spark, str(tmp_path / "index"))
    index.follow(windows.watched_files(spark, str(tmp_path / "src"))).awaitTermination()
    assert rows(index.files(), "path") == [("a.py",)]
    (tmp_path / "src" / "c.py").write_text("def g():\n    pass\n")
    index.follow(windows.watched_files(spark, str(tmp_path / "src"))).awaitTermination()
    assert rows(index.symbols(), "name") == [("f",), ("g",)]


def test_budget_scales():
    from codelode.functions.text import scaled_budget

    scales, families = {"large": 0.5}, {("mid", "2"): 0.75}
    assert [scaled_budget(1000, m, scales, families) for m in (None, "", " LARGE ", "the-mid-2b", "mid-1")] == [1000, 1000, 500, 750, 1000]


def test_embedding_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "abc")], "symbol_id long, text string")
    out = rank.embedded(df, lambda texts: [[float(len(t)), 1.0] for t in texts], "lengths")
    assert rows(out, "symbol_id", "model", "dim", "vector") == [(1, "lengths", 2, [2.0, 1.0]), (4, "lengths", 2, [3.0, 1.0])]
