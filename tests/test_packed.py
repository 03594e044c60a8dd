import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelode.operators.packed import latest_by, packed_values, unpack

CASES = [
    ("a/b.py,c/d.py", ["a/b.py", "c/d.py"]),
    ("a.py;b.py|c.py\td.py\r\ne.py", ["a.py", "b.py", "c.py", "d.py", "e.py"]),
    (' "docs/x, y & z.md" ,a.py', ["docs/x, y & z.md", "a.py"]),
    ('"docs/the ""old"" way.md";b.py', ['docs/the "old" way.md', "b.py"]),
    ("'data/a;b.csv','c.py'", ["data/a;b.csv", "c.py"]),
    ("docs/user's guide.md,b.py", ["docs/user's guide.md", "b.py"]),
    ('["docs/the \\"old\\" way.md", "win\\\\build\\\\run.py"]', ['docs/the "old" way.md', "win\\build\\run.py"]),
    ("['a.py', \"docs/user's guide.md\", 'win\\\\x.py']", ["a.py", "docs/user's guide.md", "win\\x.py"]),
    ('["src/l\\u00e9gende.py"]', ["src/légende.py"]),
    ("win\\build\\run.py,app/[slug]/page.tsx,src/{id}.ts", ["win\\build\\run.py", "app/[slug]/page.tsx", "src/{id}.ts"]),
    ('"win\\build\\run.py"', ["win\\build\\run.py"]),
    ("a.py,,b.py,", ["a.py", "b.py"]),
    ("a.py,a.py", ["a.py", "a.py"]),
    ('"",a.py,"  "', ["a.py"]),
    ("\ue0000\ue001,\ue000", ["\ue0000\ue001", "\ue000"]),
    ('"a,b",\ue0000\ue001', ["a,b", "\ue0000\ue001"]),
    ("", []), ("  ", []), (",", []), ("-", []), ("(none)", []), ("NULL", []), ("[]", []), ('""', []), (None, []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, x string")
    got = {r.i: r.v for r in df.select("i", packed_values(F.col("x")).alias("v")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_positions_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "a,,b", "k"), (1, "a,,b", "k"), (2, None, None)], "id long, packed string, other string")
    rows = sorted((r.id, r.other, r.pos, r.value) for r in unpack(df, "packed").collect())
    assert rows == [(1, "k", 1, "a"), (1, "k", 1, "a"), (1, "k", 2, "b"), (1, "k", 2, "b")]
    assert unpack(df.limit(0), "packed").count() == 0


def test_very_long_field(spark):
    paths = [f"dir{i}/a, b{i}.py" for i in range(20_000)]
    df = spark.createDataFrame([(",".join(f'"{p}"' for p in paths),)], "x string")
    assert [r.value for r in unpack(df, "x").orderBy("pos").collect()] == paths


def test_latest(spark):
    df = spark.createDataFrame([(1, 1.0, "old"), (1, 2.0, "new"), (None, 1.0, "x")], "k long, t double, v string")
    assert {r.k: r.v for r in latest_by(df, ["k"], ["t"], ["v"]).collect()} == {1: "new", None: "x"}


PATH = st.text(alphabet="abc/._- ,;|'\"\\[]{}()é", min_size=1, max_size=12).map(str.strip).filter(lambda p: p and p.lower() not in ("-", "--", "[]", "{}", "()", "null"))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(PATH, min_size=1, max_size=5), min_size=8, max_size=8))
def test_round_trip(spark, lists):
    """JSON lists and quoted rows with doubled quotes come back whole."""
    rows = []
    for i, paths in enumerate(lists):
        rows.append((i, json.dumps(paths), paths))
        rows.append((i + 100, ",".join('"' + p.replace('"', '""') + '"' for p in paths), paths))
    df = spark.createDataFrame([(i, x) for i, x, _ in rows], "i int, x string")
    got = {r.i: r.v for r in df.select("i", packed_values(F.col("x")).alias("v")).collect()}
    assert got == {i: want for i, _, want in rows}


@pytest.mark.parametrize("delimiters", [",", ";"])
def test_other_delimiters(spark, delimiters):
    df = spark.createDataFrame([("a,b;c",)], "x string")
    assert df.select(packed_values(F.col("x"), delimiters).alias("v")).first().v == "a,b;c".split(delimiters)
