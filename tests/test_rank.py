import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import rank

DOCS = [(1, "graph ledger graph"), (2, "ledger budget of the ledger"), (3, "other words entirely"), (4, None), (5, "")]


def brute_bm25(docs, terms):
    toks = {i: (t or "").split() for i, t in docs}
    toks = {i: t for i, t in toks.items() if t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, t in toks.items():
        c, s = Counter(t), 0.0
        for w in set(terms):
            if c[w]:
                df = sum(w in x for x in toks.values())
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            out[i] = round(s, 6)
    return out


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    got = {r.id: r.score for r in rank.bm25(rank.text_postings(docs, "id", "text"), ["graph", "ledger", "ledger"], "id").collect()}
    assert got == brute_bm25(DOCS, ["graph", "ledger"])
    assert rank.bm25(rank.text_postings(docs, "id", "text"), ["nothing"], "id").count() == 0
    assert rank.bm25(rank.text_postings(docs.limit(0), "id", "text"), ["graph"], "id").count() == 0


def test_bm25_without_postings(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    terms = ["graph", "ledger"]
    freq = rank.term_frequencies(docs, "id", F.col("text"), terms)
    assert {r.id: r.score for r in rank.bm25_query(freq, terms, "id").collect()} == brute_bm25(DOCS, terms)
    assert rank.bm25_query(rank.term_frequencies(docs.limit(0), "id", F.col("text"), terms), terms, "id").count() == 0


def test_boosts_and_generated(spark):
    files = spark.createDataFrame([(1, "src/main.py"), (2, "vendor/lib.py")], "file_id long, path string")
    symbols = spark.createDataFrame([(1, "budget", "main.budget", "def budget()", None, None), (2, "budget", "lib.budget", "def budget()", None, "x " * 600)], "file_id long, name string, qualified string, signature string, docstring string, body_text string")
    tf = {(r.file_id, r.token): r.tf for r in rank.file_postings(files, symbols).collect()}
    assert tf[(1, "budget")] == 3 + 1 + 2 and tf[(2, "budget")] == 1 + 1 + 1 and tf[(1, "main")] == 2 + 1


def power_iteration(nodes, edges, rounds, d=0.85, v=None):
    n = len(nodes)
    v = v or {x: 1 / n for x in nodes}
    w = Counter()
    for a, b in edges:
        w[(a, b)] += 1
        w[(b, a)] += 1
    out = Counter()
    for (a, _), k in w.items():
        out[a] += k
    r = dict(v)
    for _ in range(rounds):
        lost = sum(r[x] for x in nodes if not out[x])
        nxt = {x: (1 - d) * v[x] + d * lost / n for x in nodes}
        for (a, b), k in w.items():
            nxt[b] += d * r[a] * k / out[a]
        r = nxt
    return r


@pytest.mark.parametrize("one_task", [rank.ONE_TASK, 0])
def test_pagerank(spark, monkeypatch, one_task):
    monkeypatch.setattr(rank, "ONE_TASK", one_task)
    nodes, edges = [1, 2, 3, 4, 5], [(1, 2), (1, 2), (2, 3), (3, 3), (4, 1)]
    got = {r.id: r.pr for r in rank.pagerank(spark.createDataFrame([(x,) for x in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long"), 8).collect()}
    want = power_iteration(nodes, edges, 8)
    assert all(abs(got[x] - want[x]) < 1e-12 for x in nodes) and abs(sum(got.values()) - 1) < 1e-9
    restart = spark.createDataFrame([(5, 2.0)], "id long, mass double")
    got = {r.id: r.pr for r in rank.pagerank(spark.createDataFrame([(x,) for x in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long"), 3, restart=restart).collect()}
    want = power_iteration(nodes, edges, 3, v={1: 0, 2: 0, 3: 0, 4: 0, 5: 1})
    assert all(abs(got[x] - want[x]) < 1e-12 for x in nodes)
    assert rank.pagerank(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fusion_and_confidence(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "file_id long, rank long")
    b = spark.createDataFrame([(2, 0), (3, 1)], "file_id long, rank long")
    rows = rank.fuse({"bm25": a, "pr": b}, weights={"pr": 0.7}).collect()
    assert [(r.file_id, r.rank) for r in sorted(rows, key=lambda r: r.rank)] == [(2, 0), (1, 1), (3, 2)]
    assert {r.file_id: r.rrf_score for r in rows}[2] == round(1 / 61 + 0.7 / 60, 9)
    assert rank.confidence(rank.fuse({"bm25": a, "pr": b})).first().label == "high"
    assert rank.confidence(rank.fuse({"bm25": a.limit(0)})).first().label == "low"


def test_recency_and_knn(spark):
    acts = spark.createDataFrame([("a", "read", 0.0), ("a", "edit", 3600.0), ("b", "read", 7200.0)], "target string, action string, ts double")
    assert {r.target: r.score for r in rank.recency(acts, 7200.0).collect()} == {"a": 2.0, "b": 1.0}
    e = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [1.0, 0.0]), (3, 11, [0.0, 2.0]), (4, 12, [1.0])], "symbol_id long, file_id long, vector array<float>")
    assert [(r.file_id, r.score, r.best_symbol) for r in rank.knn_files(e, [2.0, 0.0]).collect()] == [(10, 1.0, 1), (11, 0.0, 3)]


def test_naive_grep(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    assert {r.id for r in rank.naive_grep(docs, ["budget", "other"], "id", "text").select(F.col("id")).collect()} == {2, 3}


def test_tokens_in_place_are_code_tokens(spark):
    texts = ["HTTPSConnection item2vec _private __x__ a b2 5 x1y2Z3 ABCd aBcD", "snake_case-kebab.dotted/pathÄöü naïveCase 12 a1", "", None, "x " * 5000, "_ __ 7 77", "ÉCOLE2go", "日本語 テキスト"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = sorted({t for r in df.select(F.explode(T.code_tokens(F.col("text"))).alias("t")).collect() for t in [r.t]})
    got = {r.id: [r.dl, *[r[f"tf{i}"] for i in range(len(terms))]] for r in rank.term_frequencies(df, "id", F.col("text"), terms).collect()}
    want = {}
    for r in df.select("id", T.code_tokens(F.col("text")).alias("t")).collect():
        if r.t:
            count = Counter(r.t)
            want[r.id] = [len(r.t), *[count[t] for t in terms]]
    assert got == want


def test_vectors_that_do_not_count(spark):
    e = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 11, [0.0, 0.0]), (3, 12, [float("nan"), 1.0]), (4, 13, [1.0]), (5, 14, None), (6, 15, [None, 1.0]), (7, 16, [float("inf"), 1.0]), (1, 10, [1.0, 0.0])], "symbol_id long, file_id long, vector array<float>")
    assert [r.file_id for r in rank.knn_files(e, [1.0, 0.0]).collect()] == [10] and rank.knn_files(e.limit(0), [1.0]).count() == 0
