"""Source files that do not parse, per file and as rates per repository and language.

Each text is parsed by a recursive-descent parser of its language (package ``syntax``) in the Arrow
stage that follows the join with the file's path. All errors are kept, and the first one is classed
by its cause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax import CONFLICT, LANGUAGES, errors_of

_LANGUAGE = {extension: language for extension, (language, _) in LANGUAGES.items()}
_FOREIGN = re.compile(r"\A\s*(?:<!DOCTYPE|<html|<\?xml|#\s|package \w+\s*$|def \w+\(|from \w+ import|const \w+ = require|use \w+::)", re.M)


def cause_of(text: str, errors: list[tuple[int, str]]) -> str | None:
    """The first cause: conflict, truncated, foreign (another language or a page) or syntax; none without errors."""
    if not errors:
        return None
    if CONFLICT.search(text):
        return "conflict"
    line, message = errors[0]
    lines = text.rstrip().count("\n") + 1
    if len(errors) <= 3 and (line >= lines - 2 or "not closed" in message or message.endswith("the end")):
        return "truncated"
    if line <= 3 and _FOREIGN.search(text):
        return "foreign"
    return "syntax"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        errors, causes = [], []
        for text, extension in zip(b["text"], b["extension"], strict=True):
            found = errors_of(text, extension)
            errors.append([f"line {line}: {message}" if line else message for line, message in found])
            causes.append(cause_of(text or "", found))
        yield pd.DataFrame({"key": b["key"], "errors": errors, "cause": causes})


def parse_files(files: DataFrame, sources: DataFrame, key: str = "file_id", path: str = "path", text: str = "source_text", version: str = "last_parsed",
                project: str = "project") -> DataFrame:
    """(key, project, language, errors, cause): one row per file of a known language that has a text.

    ``errors`` is empty and ``cause`` null for a valid file. The extension of the latest path counts,
    not the language column. Null, empty and blank texts are valid; repeated rows count once; files
    of other extensions and null keys are left out.
    """
    latest = files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, path, project)).alias("l"))
    extension = F.lower(F.regexp_extract(F.col(f"l.{path}"), r"(\.[^./]+)$", 1))
    known = latest.select(F.col(key).alias("key"), F.col(f"l.{project}").alias("project"), extension.alias("extension")).filter(F.col("extension").isin(*_LANGUAGE))
    texts = sources.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(files.dtypes)[key]
    parsed = texts.join(known.select("key", "extension"), "key").select("key", "extension", "text").mapInPandas(_parse, f"key {kind}, errors array<string>, cause string")
    # A repeated text gives the same row again.
    one = parsed.groupBy("key").agg(F.max(F.struct("errors", "cause")).alias("r"))
    languages = F.create_map(*[F.lit(x) for pair in _LANGUAGE.items() for x in pair])
    return one.join(known, "key").select(F.col("key").alias(key), F.col("project").alias(project), languages[F.col("extension")].alias("language"), "r.errors", "r.cause")


def invalid_files(files: DataFrame, sources: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``parse_files`` that have errors."""
    return parse_files(files, sources, **columns).filter(F.size("errors") > 0)


def acceptance(parsed: DataFrame, project: str = "project") -> DataFrame:
    """(project, language, n_files, n_invalid, accepted): rates per repository and language."""
    bad = F.sum((F.size("errors") > 0).cast("int"))
    rates = parsed.groupBy(project, "language").agg(F.count(F.lit(1)).alias("n_files"), bad.alias("n_invalid"))
    return rates.withColumn("accepted", F.round(1 - F.col("n_invalid") / F.col("n_files"), 6))
