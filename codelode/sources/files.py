"""Source trees as DataFrames: scan, ignore rules, languages, digests and line counts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language of each extension, and names that a scan leaves out.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".c": "c", ".h": "c",
    ".go": "go", ".java": "java", ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".php": "php", ".phtml": "php", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".zig": "zig", ".sol": "solidity",
}
IGNORED = (
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".next", "dist", "build", "target", ".venv", "venv", ".env", "vendor", "third_party", "reference",
    "*.pyc", "*.pyo", "*.so", "*.dylib", "*.dll", "*.min.js", "*.min.css", "*.lock",
)


def language_of(path: Column) -> Column:
    """The language of a path's extension; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(extension.isin(*LANGUAGES), table[extension])


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at the very end adds none."""
    n = F.size(F.split(text, "\n", -1))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(n - F.when(text.endswith("\n"), 1).otherwise(0)).cast("long")


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression for a whole name or path; a star also spans slashes."""
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def ignored(path: Column, patterns: Sequence[str] = IGNORED) -> Column:
    """Whether a relative path is left out: a pattern matches the path, or the name of one of its parts; dot directories are left out too."""
    if not patterns:
        return path.rlike(r"(?:^|/)\.[^/]+/")
    any_of = "|".join(_glob(p) for p in patterns)
    return path.rlike(rf"(?:^|/)\.[^/]+/|(?:^|/)(?:{any_of})(?:/|$)|^(?:{any_of})$")


def parse_ignore_file(text: str) -> list[str]:
    """Patterns of an ignore file; blank lines and comments are skipped, slashes at the end dropped."""
    return [line.strip().rstrip("/") for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def safe_path(root: str, path: str) -> str:
    """``path`` below ``root``; raises ValueError if it would leave it."""
    parts: list[str] = []
    for p in PurePosixPath(path).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"{path} leaves {root}")
            parts.pop()
        elif p == "/":
            raise ValueError(f"{path} leaves {root}")
        elif p != ".":
            parts.append(p)
    return str(PurePosixPath(root, *parts))


#: Folders that are no project whatever they hold: by their own name, and by names in a row anywhere on the path.
NO_ROOT_NAMES = frozenset(("node_modules", "site-packages", "dist-packages", "__pycache__", ".git", ".venv", "venv"))
SYSTEM_PATHS = (("usr", "lib"), ("usr", "bin"), ("etc",), ("proc",), ("sys",), ("windows", "system32"), ("program files",), ("appdata", "local"))


def check_root(root: str, home: str) -> str:
    """``root`` if it can be a project's; raises ValueError for the home folder and what lies above it, package folders and system folders."""
    path, top = PurePosixPath(root), PurePosixPath(home)
    parts = [p.lower() for p in path.parts if p != "/"]
    if not parts or path == top or path in top.parents:
        raise ValueError(f"{root} is no project: it holds home folders")
    if path.name in NO_ROOT_NAMES:
        raise ValueError(f"{root} is a folder of packages")
    for names in SYSTEM_PATHS:
        places = range(len(parts) - len(names) + 1) if len(names) > 1 or names[0] not in ("etc", "proc", "sys") else range(min(1, len(parts)))
        if any(tuple(parts[i : i + len(names)]) == names for i in places):
            raise ValueError(f"{root} lies in a system folder")
    return root


def known_languages(configured: Sequence[str], registered: Sequence[str] = ()) -> list[str]:
    """The languages to index: those of the configuration that are known, and those that extensions registered; all known ones if none is configured."""
    known = set(LANGUAGES.values()) | set(registered)
    return sorted((set(configured) & known if configured else known) | set(registered))


def scan(spark: SparkSession, root: str, patterns: Sequence[str] = IGNORED, extensions: Sequence[str] | None = None, max_files: int | None = None) -> DataFrame:
    """(path, sha256, language, line_count, byte_size, source_text) of the files below ``root``.

    The listing and the reading are distributed. The file source leaves out files without a byte.
    ``max_files`` bounds a scan on purpose, by path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/"))
    path = F.regexp_replace("path", rf"^(?:file:)?/*{base.lstrip('/')}/", "")
    wanted = [e.lower() for e in (extensions or LANGUAGES)]
    files = raw.withColumn("path", F.regexp_replace(path, "^/+", "")).filter(~ignored(F.col("path"), patterns) & F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*wanted))
    if max_files is not None:
        files = files.orderBy("path").limit(max_files)
    text = F.decode("content", "UTF-8")
    return files.select("path", F.sha2("content", 256).alias("sha256"), language_of(F.col("path")).alias("language"), line_count(text).alias("line_count"), F.col("length").alias("byte_size"), text.alias("source_text"))
