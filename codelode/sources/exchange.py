"""Exchange formats: JSON lines of the state, dependency manifests, index documents, project registries."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORTED = {"decision": ("notes", None), "action": ("actions", 7 * 86_400), "query": ("queries", 30 * 86_400)}


def export_state(notes: DataFrame, actions: DataFrame, queries: DataFrame, now: float, machine: str = "") -> DataFrame:
    """One JSON line per record (value): a manifest, unexpired notes, actions of 7 days and queries of 30 days."""
    live = notes.filter(F.col("expires_at") > now)
    recent = actions.filter(F.col("ts") > now - EXPORTED["action"][1])
    asked = queries.filter(F.col("logged_at") > now - EXPORTED["query"][1])

    def lines(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("data"))).alias("value"))

    head = notes.sparkSession.createDataFrame([("manifest", float(now), machine)], "kind string, exported_at double, machine string")
    return reduce(DataFrame.unionAll, [head.select(F.to_json(F.struct("*")).alias("value")), lines(live, "decision"), lines(recent, "action"), lines(asked, "query")])


def read_state(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """The records of one kind from exported lines (value); lines that aren't valid are skipped."""
    parsed = lines.select(F.from_json("value", f"kind string, data struct<{_fields(schema)}>").alias("r"))
    return parsed.filter((F.col("r.kind") == kind) & F.col("r.data").isNotNull()).select("r.data.*")


def _fields(schema: str) -> str:
    return ", ".join("{}: {}".format(*part.strip().split(" ", 1)) for part in _split(schema))


def _split(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def manifest_dependencies(manifests: DataFrame, limit: int | None = 50) -> DataFrame:
    """(project, name, ecosystem, pos): dependencies of each project's manifests, the first of a name, at most ``limit`` a project.

    ``manifests``: project, path, text. Known: requirements.txt, pyproject.toml, package.json and Cargo.toml, in this order.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = F.split("text", r"\r?\n")
    plain = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*([A-Za-z0-9_.-]+)", 1)), lambda x: x != "")
    block = F.regexp_extract("text", r"(?s)dependencies\"?\s*=\s*\[(.*?)\]", 1)
    listed = F.regexp_extract_all(block, F.lit(r"[\"']([A-Za-z0-9_.-]+)"), F.lit(1))
    crates = F.regexp_extract(F.concat("text", F.lit("\n[")), r"(?s)\[dependencies\]\s*\n(.*?)\n\[", 1)
    cargo = F.regexp_extract_all(F.concat(F.lit("\n"), crates), F.lit(r"\n([A-Za-z0-9_-]+)\s*="), F.lit(1))
    packages = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    node = F.concat(F.coalesce(F.map_keys(packages["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(packages["devDependencies"]), F.array().cast("array<string>")))

    def part(order: int, ecosystem: str, names):
        return F.struct(F.lit(order).alias("o"), F.lit(ecosystem).alias("e"), names.cast("array<string>").alias("n"))

    found = (
        F.when(name == "requirements.txt", part(0, "PyPI", plain))
        .when(name == "pyproject.toml", part(1, "PyPI", listed))
        .when(name == "package.json", part(2, "npm", node))
        .when(name.isin("Cargo.toml", "cargo.toml"), part(3, "crates.io", cargo))
    )
    rows = manifests.select("project", found.alias("f")).filter("f IS NOT NULL").select("project", "f.o", "f.e", F.posexplode("f.n").alias("p", "name"))
    first = rows.groupBy("project", "name").agg(F.min(F.struct("o", "p", "e")).alias("m"))
    from pyspark.sql import Window

    ordered = first.withColumn("pos", F.row_number().over(Window.partitionBy("project").orderBy("m.o", "m.p", "name")).cast("long") - 1)
    out = ordered.select("project", "name", F.col("m.e").alias("ecosystem"), "pos")
    return out if limit is None else out.filter(F.col("pos") < limit)


INDEX_DOCUMENT = "documents array<struct<relative_path: string, occurrences: array<struct<symbol: string, symbol_roles: int, range: array<int>>>>>"


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """(path, symbol, is_definition, line) of an index document in JSON; lines count from 1."""
    docs = spark.read.schema(INDEX_DOCUMENT).option("multiLine", True).json(path)
    d = docs.select(F.explode("documents").alias("d")).select("d.relative_path", F.explode("d.occurrences").alias("o"))
    definition = F.coalesce(F.col("o.symbol_roles"), F.lit(0)).bitwiseAND(1) == 1
    return d.select(F.col("relative_path").alias("path"), "o.symbol", definition.alias("is_definition"), (F.get("o.range", F.lit(0)) + 1).cast("long").alias("line"))


def project_registry(text: str) -> tuple[list[dict], list[str]]:
    """Projects of a registry in TOML, and warnings about those that lack a name or root; clusters name groups of projects."""
    data = tomllib.loads(text)
    projects, warnings = [], []
    for p in data.get("projects", data.get("project", [])):
        if not p.get("name") or not p.get("root"):
            warnings.append(f"a project without name or root: {p}")
            continue
        clusters = [c["name"] for c in data.get("clusters", data.get("cluster", [])) if p["name"] in c.get("projects", [])]
        projects.append({"name": p["name"], "root": p["root"], "languages": list(p.get("languages", [])), "clusters": clusters})
    return projects, warnings


def append_audit(records: DataFrame, path: str) -> None:
    """Adds audit records as JSON lines; earlier files stay."""
    records.write.mode("append").json(path)


def changed_since(spark: SparkSession, root: str, ref: str, seconds: float = 10.0) -> DataFrame:
    """(path): files that differ between a git reference and the working head; none if git fails or takes too long."""
    import subprocess

    try:
        run = subprocess.run(["git", "-C", root, "diff", "--name-only", ref, "HEAD"], capture_output=True, text=True, timeout=seconds, check=True)
        paths = [(p,) for p in run.stdout.splitlines() if p]
    except (OSError, subprocess.SubprocessError):
        paths = []
    return spark.createDataFrame(paths, "path string")
