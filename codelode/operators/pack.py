"""Packing ranked files into a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the richest to the poorest form of a file.
LEVELS = ("full", "sigs", "names", "path")
# Names of files that come first whatever their rank.
IMPORTANT = (
    "readme.md", "readme.rst", "readme.txt", "readme", "license", "license.md", "license.txt", "claude.md", "agents.md", "cursor.md", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt",
    "cargo.toml", "package.json", "go.mod", "pom.xml", "build.gradle", "tsconfig.json", "dockerfile", "makefile", ".gitignore", ".env.example",
)


def is_important(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1)).isin(*IMPORTANT)


def form_texts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, sigs, names, path): a file's poorer forms as texts.

    sigs: signatures with documentation cut at 200 characters; names: kinds and names in two columns.
    Symbols come in the order of their lines; a file without symbols has null forms besides its path.
    """
    doc = F.when(F.length("docstring") > 200, F.concat(F.substring("docstring", 1, 200), F.lit("..."))).otherwise(F.col("docstring"))
    sig = F.concat_ws("\n    ", F.coalesce("signature", "name"), F.nullif(doc, F.lit("")))
    name = F.concat(F.when(F.length("kind") < 10, F.rpad("kind", 10, " ")).otherwise(F.col("kind")), F.lit(" "), "name")
    ordered = F.array_sort(F.collect_list(F.struct("line_start", "symbol_id", sig.alias("sig"), name.alias("nm"))))
    forms = symbols.groupBy("file_id").agg(ordered.alias("o")).select(
        "file_id", F.array_join(F.transform("o", lambda x: x["sig"]), "\n").alias("sigs"), F.array_join(F.transform("o", lambda x: x["nm"]), "\n").alias("names")
    )
    return files.select("file_id", "path").join(forms, "file_id", "left").select("file_id", "sigs", "names", "path")


def pack(candidates: DataFrame, budget: int) -> DataFrame:
    """(file_id, granularity, char_count, pos): files in rank order, each in the richest form that still fits, or skipped.

    ``candidates``: one row per file with file_id, rank and the lengths full, sigs, names, path, null
    where a form doesn't exist. At most a top-k list: a skipped file takes nothing from the budget,
    so the choice is sequential; it is one fold over an array of bounded length.
    """
    rows = candidates.agg(F.array_sort(F.collect_list(F.struct("rank", "file_id", *LEVELS))).alias("rows"))
    empty = F.array().cast("array<struct<file_id:bigint,granularity:string,char_count:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        left = acc["left"]
        level, size = F.lit(None).cast("string"), F.lit(None).cast("bigint")
        for name in reversed(LEVELS):
            fits = x[name].isNotNull() & (x[name] <= left)
            level, size = F.when(fits, F.lit(name)).otherwise(level), F.when(fits, x[name].cast("bigint")).otherwise(size)
        taken = F.array(F.struct(x["file_id"].cast("bigint").alias("file_id"), level.alias("granularity"), size.alias("char_count")))
        return F.when(size.isNotNull(), F.struct((left - size).alias("left"), F.concat(acc["out"], taken).alias("out"))).otherwise(acc)

    start = F.struct(F.lit(budget).cast("bigint").alias("left"), empty.alias("out"))
    folded = rows.select(F.aggregate("rows", start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select(F.posexplode("out").alias("pos", "x")).select("x.file_id", "x.granularity", "x.char_count", F.col("pos").cast("long").alias("pos"))


def lost_in_the_middle(packed: DataFrame) -> DataFrame:
    """``packed`` with place: even positions first in order, then odd ones backwards, so that the best stand at both ends."""
    n = packed.agg(F.count(F.lit(1)).alias("__n"))
    even = F.col("pos") % 2 == 0
    back = F.col("__n") - 1 - F.floor(F.col("pos") / 2)
    place = F.when(F.col("__n") <= 2, F.col("pos")).when(even, F.floor(F.col("pos") / 2)).otherwise(back)
    return packed.crossJoin(F.broadcast(n)).withColumn("place", place.cast("long")).drop("__n")


def format_context(parts: DataFrame, title: str) -> DataFrame:
    """One row (context): the parts by place under a title. ``parts``: place, file_path, granularity, content."""
    body = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("## "), F.col("file_path"), F.lit(" ["), F.col("granularity"), F.lit("]\n"), F.col("content")).alias("t"))))
    return parts.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(body, lambda x: x["t"]), "\n\n")).alias("context"))
