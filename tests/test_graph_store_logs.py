import pytest
from pyspark.sql import functions as F

from codelode.operators import edit, graph, logs, pack, store


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_contains_and_imports(spark):
    s = spark.createDataFrame(
        [(1, 1, "A", "m.A", "class"), (2, 1, "f", "m.A.f", "Method"), (3, 1, "g", "m.g", "function"), (4, 2, "A", "n.A", "class"), (5, 2, "h", "n::B::h", "method")],
        "symbol_id long, file_id long, name string, qualified string, kind string",
    )
    assert rows(graph.contains_edges(s), "source_id", "target_id") == [(1, 2)]
    imports = spark.createDataFrame([(9, "m.A"), (9, "x::A"), (9, "zzz"), (9, "zzz")], "file_id long, path string")
    assert rows(graph.resolve_imports(imports, s), "path", "tier", "first_target", "n_targets") == [("m.A", 1, 1, 1), ("x::A", 2, 1, 2), ("zzz", 0, None, 0)]
    assert graph.resolve_imports(imports.limit(0), s).count() == 0


@pytest.fixture
def links(spark):
    return spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (5, 5)], "src_file long, dst_file long")


def test_graph(spark, links):
    edges = links.select(F.col("src_file").alias("source_id"), F.col("dst_file").alias("target_id"), F.lit("calls").alias("kind"))
    assert rows(graph.neighbours(edges, [2, 5]), "symbol_id", "other_id") == [(2, 1), (2, 3)]
    assert rows(graph.mutual_pairs(links), "a", "b") == [(1, 2)]
    assert rows(graph.degrees(edges), "symbol_id", "degree") == [(1, 2), (2, 3), (3, 2), (4, 1), (5, 1)]
    seeds = spark.createDataFrame([(1,)], "file_id long")
    assert rows(graph.explore(links, seeds, 2), "file_id", "hop") == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.explore(links, seeds, 9), "file_id", "hop")[-1] == (4, 3)
    assert rows(graph.explore(links, seeds, -1), "file_id", "hop") == [(1, 0)]
    assert rows(graph.impact(links, spark.createDataFrame([(3,), (4,)], "file_id long")), "changed_file", "dependent") == [(3, 2)]
    m = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12)], "symbol_id long, file_id long")
    assert rows(graph.file_edges(edges, m), "src_file", "dst_file") == [(10, 11), (11, 12)]
    assert rows(graph.concept_neighbours(edges, spark.createDataFrame([(1,)], "id long"), 3, 2), "id", "hop") == [(1, 0), (2, 1)]


def test_enclosing_and_references(spark):
    s = spark.createDataFrame([(1, 1, 1, 50), (2, 1, 10, 20), (3, 1, 10, 20)], "symbol_id long, file_id long, line_start long, line_end long")
    p = spark.createDataFrame([(1, 1, 15), (2, 1, 30), (3, 1, 99), (4, 2, 15)], "place_id long, file_id long, line long")
    assert rows(graph.enclosing_symbols(p, s), "place_id", "symbol_id") == [(1, 2), (2, 1)]
    d = spark.createDataFrame([("f", 1, 1), ("f", 2, 2)], "symbol string, file_id long, seq long")
    r = spark.createDataFrame([("f", 1), ("f", 1), ("f", 2)], "symbol string, file_id long")
    assert rows(graph.definition_references(d, r), "symbol", "def_file", "ref_file", "n") == [("f", 2, 1, 2)]


def test_cross_project(spark):
    i = spark.createDataFrame([("p", "A"), ("p", "A"), ("q", "A")], "project string, leaf string")
    s = spark.createDataFrame([("q", "A"), ("q", "A")], "project string, name string")
    assert rows(graph.cross_project(i, s), "source_project", "leaf", "target_project") == [("p", "A", "q")]
    a, b = (graph.import_checksums(x).first().checksum for x in (i.filter("project = 'p'"), i.filter("project = 'p'").distinct()))
    assert a == b


def test_store(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert rows(store.detect_changes(old, new), "path", "status") == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")]
    assert rows(store.detect_changes(old, new, force=True), "path", "status")[0] == ("a", "changed")
    assert {r.path: r.sha256 for r in store.upsert(old, new, ["path"]).collect()} == {"a": "1", "b": "2", "c": None, "d": "1"}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "source_id long, target_id long")
    assert rows(store.drop_edges_of(e, spark.createDataFrame([(2,)], "symbol_id long")), "source_id", "target_id") == [(3, 4)]


def test_merge_strategies(spark):
    schema = "content string, type string, expires_at double, session_id string"
    t = spark.createDataFrame([("x", "fact", 10.0, "t"), ("y", "fact", 50.0, "t")], schema)
    s = spark.createDataFrame([("x", "fact", 20.0, "s"), ("y", "fact", 5.0, "s"), ("z", "fact", 1.0, "s")], schema)

    def merged(strategy):
        return {r.content: (r.expires_at, r.session_id) for r in store.merge_notes(t, s, strategy).collect()}

    assert merged("newer_wins") == {"x": (20.0, "t"), "y": (50.0, "t"), "z": (1.0, "s")}
    assert merged("source_wins") == {"x": (20.0, "t"), "y": (5.0, "t"), "z": (1.0, "s")}
    assert merged("skip_existing") == {"x": (10.0, "t"), "y": (50.0, "t"), "z": (1.0, "s")}


def test_notes(spark):
    n = spark.createDataFrame([("a", "fact", 1.0, 9.0), ("b", "locked", 0.0, 99.0), ("c", "fact", 2.0, 3.0)], "content string, type string, created_at double, expires_at double")
    assert [r.content for r in store.active_notes(n, 5.0).collect()] == ["b", "a"]
    x = spark.createDataFrame([(" ".join(["w"] * 70), "locked"), (" ".join(["w"] * 30), "fact")], "c string, t string").select(store.note(F.col("c"), F.col("t"), 0.0).alias("n")).select("n.*").collect()
    assert [len(r.content.split()) for r in x] == [60, 20] and x[1].expires_at == 7 * 86400


def test_logs(spark):
    q = spark.createDataFrame([(1, "s", 0.0), (2, "s", 100.0)], "query_id long, session_id string, ts double")
    a = spark.createDataFrame([("s", "x", 0.0), ("s", "y", 59.9), ("s", "z", 60.0), ("t", "x", 10.0), ("s", "w", 130.0)], "session_id string, target string, ts double")
    assert rows(logs.query_action_pairs(q, a), "query_id", "target") == [(1, "y"), (2, "w")]
    h = spark.createDataFrame([(1, "find the graph", "low", "s", 1.0), (2, "find graph", "high", "s", 2.0), (3, "find graph", None, "s", 3.0), (4, "", None, "s", 4.0)], "query_id long, query_text string, confidence string, session_id string, logged_at double")
    assert rows(logs.retries(h), "query_id") == [(2,)]
    calls = spark.createDataFrame([(0,), (30,), (60,), (200,)], "ts long")
    assert [r.n_recent for r in logs.rate_limited(calls).orderBy("ts").collect()] == [1, 2, 3, 1]
    e = spark.createDataFrame([(1, "u", 0.0), (2, "u", 4.0), (3, "u", 9.0)], "event_id long, u string, ts double")
    assert rows(logs.debounced(e, "u"), "event_id") == [(1,), (3,)]
    s = spark.createDataFrame([("a", 100.0, "f"), ("b", 90.0, "f"), ("c", -9999.0, "f"), ("a", 100.0, "g")], "session_id string, last_seen double, file_path string")
    assert rows(logs.session_conflicts(s, s, 100.0), "session_id", "other_id", "files") == [("a", "b", "f"), ("b", "a", "f")]
    b = spark.createDataFrame([("s", 1.0, 1, 400), ("s", 2.0, 2, 40)], "session_id string, ts double, call_id long, n_chars int")
    assert rows(logs.token_budget(b, 100), "call_id", "used", "state") == [(1, 100, "warn"), (2, 110, "over")]
    acc = spark.createDataFrame([(1, "x"), (1, "y")], "query_id long, target string")
    res = spark.createDataFrame([(1, 3, "x"), (1, 5, "x")], "query_id long, pos long, file_path string")
    assert logs.rank_quality(acc, res).first()[:2] == (1, 26.0)


def test_pack(spark):
    c = spark.createDataFrame([(0, 1, 60, 30, 10, 5), (1, 2, 90, 50, 20, 5), (2, 3, 40, 15, 8, 5), (3, 4, 20, 9, 8, 7)], "rank long, file_id long, full long, sigs long, names long, path long")
    assert rows(pack.pack(c, 90), "file_id", "granularity", "char_count", "pos") == [(1, "full", 60, 0), (2, "names", 20, 1), (3, "names", 8, 2)]
    assert pack.pack(c.limit(0), 90).count() == 0
    order = spark.createDataFrame([(i,) for i in range(5)], "pos long")
    assert [r.pos for r in pack.lost_in_the_middle(order).orderBy("place").collect()] == [0, 2, 4, 3, 1]


def test_edits(spark):
    df = spark.createDataFrame([(1, "a handle b\nhandler"), (2, "none"), (3, None)], "file_id long, source_text string")
    assert rows(edit.renamed(df, "handle", "$x"), "file_id", "source_text") == [(1, "a $x b\nhandler")]
    t = spark.createDataFrame([("l1\n    l2\n    l3\nl4",)], "x string")
    assert t.select(edit.extract_block(F.col("x"), 2, 3, "f").alias("v")).first().v == "l1\n    f()  # TODO: pass arguments\nl4\n\n\ndef f():\n        l2\n        l3\n"
    m = t.select(edit.move_symbol(F.col("x"), F.lit("t\n"), 2, 3).alias("v")).first().v
    assert m.source == "l1\nl4" and m.target == "t\n\n\n    l2\n    l3\n"
    d = spark.createDataFrame([("def f():\n    return 1",)], "x string")
    assert d.select(edit.insert_docstring(F.col("x"), 1, "says").alias("v")).first().v == 'def f():\n    """says"""\n    return 1'
    assert d.select(edit.inline_return(F.col("x")).alias("v")).first().v == "1"


def test_concepts(spark):
    from codelode.operators import concepts as C

    schema = "concept_id long, name string, kind string, summary string, body string, confidence double, created_at double, updated_at double"
    known = spark.createDataFrame([(1, "Cache", "concept", "s", None, 0.5, 1.0, 1.0), (4, "Été", "risk", "s", None, 0.5, 1.0, 1.0)], schema)
    changes = spark.createDataFrame(
        [("CACHE", "pattern", "new", None, 0.9), ("graph", "concept", "g", None, 0.1), ("Graph", "concept", "g", None, 0.2), ("x", "nonsense", "", None, 0.5), (" ", "concept", "", None, 0.5), ("y", "concept", "", None, 2.0)],
        "name string, kind string, summary string, body string, confidence double",
    )
    out = C.upsert_concepts(known, changes, 9.0)
    assert rows(out, "concept_id", "name", "kind", "updated_at") == [(1, "Cache", "pattern", 9.0), (4, "Été", "risk", 1.0), (5, "graph", "concept", 9.0)]
    assert C.upsert_concepts(known.limit(0), changes.limit(0), 9.0).count() == 0
    edges = spark.createDataFrame([(1, 4, "refines", 1.0)], "source_id long, target_id long, relation string, weight double")
    links = spark.createDataFrame([(1, 4, "refines", 2.0, 1), (1, 4, "refines", 3.0, 2), (1, 1, "refines", 1.0, 3), (4, 1, "odd", 1.0, 4), (4, 1, "used_by", 1.0, 5)], "source_id long, target_id long, relation string, weight double, seq long")
    linked = C.link_concepts(edges, links)
    assert rows(linked, "source_id", "target_id", "relation", "weight") == [(1, 4, "refines", 3.0), (4, 1, "used_by", 1.0)]
    names = spark.createDataFrame([("cache",), ("New",), ("new",)], "name string")
    assert rows(C.missing_names(known, names), "name") == [("New",)]
    files = spark.createDataFrame([(7, "a.py"), (8, "b.py")], "file_id long, path string")
    none = spark.createDataFrame([], "concept_id long, file_id long, weight double")
    change = spark.createDataFrame([(1, 7, 0.5, 1), (1, 7, 0.9, 2), (2, 7, 1.0, 3), (1, 99, 1.0, 4), (4, 8, 0.1, 5)], "concept_id long, file_id long, weight double, seq long")
    attached = C.attach(none, change, known, files, "file_id")
    assert rows(attached, "concept_id", "file_id", "weight") == [(1, 7, 0.9), (4, 8, 0.1)]
    assert [r.path for r in C.linked_objects(attached, known, files, "file_id").collect()] == ["a.py", "b.py"]
    rest, kept = C.delete_concepts(known, linked, spark.createDataFrame([("cAcHe",)], "name string"))
    assert rows(rest, "concept_id") == [(4,)] and kept.count() == 0


def test_tuning_and_forms(spark):
    q = spark.createDataFrame([(12, 11.0, 0.5, 0.6, 0.7, 0.1)], "n_queries long, avg_rank double, name_miss double, signature_hit double, recency_hit double, hub_hit double")
    assert tuple(logs.tuned(q).first()) == ("low", 4, 3, 1.5, 1.0)
    assert tuple(logs.tuned(q.withColumn("n_queries", F.lit(3))).first()) == ("low", 3, 2, 1.0, 1.0)
    lists = spark.createDataFrame([(["b", "a"], ["a", "c"]), (None, ["x"])], "o array<string>, n array<string>")
    assert [r.v for r in lists.select(logs.merged_edits(F.col("o"), F.col("n"), 2).alias("v")).collect()] == [["a", "b"], ["x"]]
    f = spark.createDataFrame([(1, "a.py"), (2, "b.py")], "file_id long, path string")
    s = spark.createDataFrame([(2, 1, 9, "g", "function", None, None), (1, 1, 3, "f", "method", "def f()", "d" * 300)], "symbol_id long, file_id long, line_start long, name string, kind string, signature string, docstring string")
    forms = {r.file_id: r for r in pack.form_texts(f, s).collect()}
    assert forms[1].sigs == "def f()\n    " + "d" * 200 + "...\ng" and forms[1].names == "method     f\nfunction   g" and forms[2].sigs is None
    t = spark.createDataFrame([("x = my_name(1)\ny",)], "x string")
    assert [t.select(edit.identifier_at(F.col("x"), line, col).alias("v")).first().v for line, col in ((1, 6), (1, 4), (1, 3), (2, 0), (9, 0))] == ["my_name", "my_name", "", "y", ""]
