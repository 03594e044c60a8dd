"""Edits of source texts: renaming, moving and extracting by whole words and lines."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_text(text: Column, old: str, new: str) -> Column:
    """The text with whole-word ``old`` replaced; a substring check spares texts without it the regular expression."""
    return F.when(text.contains(old), F.regexp_replace(text, rf"\b{re.escape(old)}\b", re.sub(r"([\\$])", r"\\\1", new))).otherwise(text)


def renamed(sources: DataFrame, old: str, new: str, key: str = "file_id", text: str = "source_text") -> DataFrame:
    """(key, text): the texts that a rename changes, after it."""
    out = sources.select(key, F.col(text).alias("__old"), rename_text(F.col(text), old, new).alias(text))
    return out.filter(~F.col("__old").eqNullSafe(F.col(text))).select(key, text)


def line_slice(text: Column, start: Column | int, end: Column | int) -> Column:
    """Lines ``start`` to ``end``, counted from 1, both included."""
    lines = F.split(text, "\n", -1)
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def replace_lines(text: Column, start: Column | int, end: Column | int, new: Column | str) -> Column:
    """The text with lines ``start`` to ``end`` replaced by ``new``; with end = start - 1 it is inserted before ``start``."""
    lines = F.split(text, "\n", -1)
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    new = new if isinstance(new, Column) else F.lit(new)
    return F.array_join(F.concat(F.slice(lines, F.lit(1), start - 1), F.array(new), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))), "\n")


def extract_block(text: Column, start: int, end: int, name: str) -> Column:
    """Lines moved into a new function at the text's end, a call in their place."""
    block = line_slice(text, start, end)
    indent = F.regexp_extract(block, r"^([ \t]*)", 1)
    body = F.regexp_replace(block, r"(?m)^(?=.)", "    ")
    called = replace_lines(text, start, end, F.concat(indent, F.lit(f"{name}()  # TODO: pass arguments")))
    return F.concat(called, F.lit(f"\n\n\ndef {name}():\n"), body, F.lit("\n"))


def unified_diff(old: str | None, new: str | None, path: str) -> str:
    """A unified diff of two texts; empty if they are equal."""
    a, b = (old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True)
    return "".join(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}"))


def diff(old: Column, new: Column, path: Column) -> Column:
    """``unified_diff`` as a column, by batches of rows."""

    @F.pandas_udf("string")
    def diffs(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([unified_diff(*x) for x in zip(a, b, p, strict=True)], dtype=object)

    return diffs(old, new, path)


def extractions(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """(file_id, path, ok, error, source_text, diff): for each request the text with lines moved into a new function, or why it is refused.

    ``sources``: file_id, path, source_text; ``requests``: file_id, line_start, line_end, name. Refused are unknown files, ranges that are
    empty or leave the text, and names that are no identifiers. Nothing is written: ``source_text`` is the draft, null if refused.
    """
    joined = requests.join(sources.select("file_id", "path", "source_text"), "file_id", "left")
    n_lines = F.size(F.split("source_text", "\n", -1)) - F.when(F.col("source_text").endswith("\n"), 1).otherwise(0)
    error = (
        F.when(F.col("source_text").isNull(), "file not found").when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "invalid line range")
        .when(~F.col("name").rlike(r"^[A-Za-z_]\w*$"), F.concat(F.lit("invalid identifier: "), F.col("name"))).when(F.col("line_end") > n_lines, F.concat(F.lit("the text has only "), n_lines.cast("string"), F.lit(" lines")))
    )
    text = F.col("source_text")
    block = line_slice(text, F.col("line_start"), F.col("line_end"))
    indent = F.regexp_extract(block, r"^([ \t]*)", 1)
    called = replace_lines(text, F.col("line_start"), F.col("line_end"), F.concat(indent, F.col("name"), F.lit("()  # TODO: pass arguments")))
    draft = F.concat(F.regexp_replace(called, r"\n*$", ""), F.lit("\n\n\ndef "), F.col("name"), F.lit("():\n"), F.regexp_replace(block, r"(?m)^(?=.)", "    "), F.lit("\n"))
    out = joined.withColumn("error", error).withColumn("draft", F.when(F.col("error").isNull(), draft))
    return out.select("file_id", "path", F.col("error").isNull().alias("ok"), "error", F.col("draft").alias("source_text"), F.when(F.col("draft").isNotNull(), diff(text, F.col("draft"), F.col("path"))).alias("diff"))


def inlinings(symbols: DataFrame, files: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ok, error, file_id, source_text, diff): for each helper's name its file without the helper and with marked call sites, or why it is refused.

    ``symbols``: symbol_id, file_id, name, line_start, line_end; ``files``: file_id, path, language; ``sources``: file_id, source_text;
    ``names``: name. Refused are unknown and ambiguous names, other languages than Python, and bodies of more than one return. Arguments
    aren't put in: each call site gets a comment with the expression.
    """
    found = names.select("name").distinct().join(symbols.select("symbol_id", "file_id", "name", "line_start", "line_end"), "name", "left")
    one = found.groupBy("name").agg(F.count("symbol_id").alias("n"), F.min(F.struct("symbol_id", "file_id", "line_start", "line_end")).alias("s")).select("name", "n", "s.*")
    whole = one.join(files.select("file_id", "path", F.lower(F.trim("language")).alias("language")), "file_id", "left").join(sources.select("file_id", "source_text"), "file_id", "left")
    text = F.col("source_text")
    expression = inline_return(line_slice(text, F.col("line_start"), F.col("line_end")))
    error = (
        F.when(F.col("n") == 0, "not found").when(F.col("n") > 1, F.concat(F.lit("ambiguous: "), F.col("n").cast("string"), F.lit(" symbols")))
        .when(~F.coalesce(F.col("language") == "python", F.lit(False)), "only Python is supported").when(text.isNull(), "no text").when(F.col("expr").isNull(), "not a single return")
    )
    judged = whole.withColumn("expr", expression).withColumn("error", error)
    lines = F.split(text, "\n", -1)
    rest = F.concat(F.slice(lines, F.lit(1), F.col("line_start").cast("int") - 1), F.slice(lines, F.col("line_end").cast("int") + 1, F.greatest(F.size(lines) - F.col("line_end").cast("int"), F.lit(0))))
    marked = F.transform(rest, lambda x: F.when(x.contains(F.concat(F.col("name"), F.lit("("))), F.concat(x, F.lit("  # TODO: inlined "), F.col("name"), F.lit(" -> "), F.col("expr"))).otherwise(x))
    draft = F.when(F.col("error").isNull(), F.array_join(marked, "\n"))
    out = judged.withColumn("draft", draft)
    return out.select("name", F.col("error").isNull().alias("ok"), "error", "file_id", F.col("draft").alias("source_text"), F.when(F.col("draft").isNotNull(), diff(text, F.col("draft"), F.col("path"))).alias("diff"))


def references(sources: DataFrame, name: str, key: str = "file_id", text: str = "source_text") -> DataFrame:
    """(key, line, column): whole-word places of ``name`` (line from 1, column from 0); texts without it are left out by a substring check."""
    word = rf"(?<!\w){re.escape(name)}(?!\w)"
    lines = sources.filter(F.col(text).contains(name)).select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "row")).filter(F.col("row").rlike(word))
    # The lengths of what lies between the places give their columns.
    between = F.split("row", word, -1)
    count = F.size(between) - 1
    columns = F.transform(F.sequence(F.lit(1), count), lambda i: F.aggregate(F.slice(between, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * len(name))
    return lines.select(key, (F.col("at") + 1).cast("long").alias("line"), F.explode(columns).alias("column"))


def rename_by_name(symbols: DataFrame, sources: DataFrame, old: str, new: str, key: str = "file_id", text: str = "source_text") -> DataFrame:
    """(key, text): ``renamed``, if exactly one symbol defines ``old`` and none has the new name; otherwise nothing changes."""
    wanted = symbols.filter(F.col("name").isin(old, new)).agg(F.count_if(F.col("name") == old).alias("n"), F.count_if(F.col("name") == new).alias("taken"))
    safe = wanted.filter("n = 1 AND taken = 0").select(F.lit(True).alias("safe"))
    return renamed(sources, old, new, key, text).crossJoin(F.broadcast(safe)).drop("safe")


def definitions(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(symbol_id, path, line): where a name is defined, by its plain or its qualified form."""
    hits = symbols.filter((F.col("name") == name) | (F.col("qualified") == name)).select("symbol_id", "file_id", F.col("line_start").alias("line"))
    return hits.join(files.select("file_id", "path"), "file_id").select("symbol_id", "path", "line")


def move_symbol(source: Column, target: Column, start: Column | int, end: Column | int) -> Column:
    """A struct (source, target): the symbol's lines cut from one text and added to the end of the other."""
    block = line_slice(source, start, end)
    lines = F.split(source, "\n", -1)
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    rest = F.array_join(F.concat(F.slice(lines, F.lit(1), start - 1), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))), "\n")
    return F.struct(rest.alias("source"), F.concat(F.regexp_replace(target, r"\n*$", ""), F.lit("\n\n\n"), block, F.lit("\n")).alias("target"))


def insert_docstring(text: Column, line: Column | int, doc: Column | str) -> Column:
    """The text with a documentation string below the Python signature in ``line``, indented one level deeper."""
    line = line if isinstance(line, Column) else F.lit(line)
    doc = doc if isinstance(doc, Column) else F.lit(doc)
    indent = F.regexp_extract(line_slice(text, line, line), r"^([ \t]*)", 1)
    return replace_lines(text, line + 1, line, F.concat(indent, F.lit('    """'), doc, F.lit('"""')))


def inline_return(text: Column) -> Column:
    """The expression of a helper whose body is a single return, possibly after a documentation string; null for other bodies."""
    doc = r"(?:\"\"\"(?:[^\"]|\"(?!\"\"))*+\"\"\"\s*|'''(?:[^']|'(?!''))*+'''\s*)?"
    return F.nullif(F.regexp_extract(text, rf"^\s*def \w+\([^)]*\)[^:]*:\s*{doc}return[ \t]+([^\n]+?)\s*$", 1), F.lit(""))


def identifier_at(text: Column, line: Column | int, column: Column | int) -> Column:
    """The identifier around a place (line from 1, column from 0), both ways over letters, digits and underscores; empty if there is none."""
    line = line if isinstance(line, Column) else F.lit(line)
    column = column if isinstance(column, Column) else F.lit(column)
    row = F.coalesce(F.get(F.split(text, "\n", -1), line - 1), F.lit(""))
    before = F.regexp_extract(F.substring(row, F.lit(1), column), r"(\w*)$", 1)
    after = F.regexp_extract(F.substring(row, column + 1, F.length(row)), r"^(\w*)", 1)
    return F.concat(before, after)
