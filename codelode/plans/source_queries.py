"""Queries over the source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import exchange, files, outline
from ..session import table
from .catalogue import FILES, current_files


def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, line count and language of every source text."""
    t = table(spark, sf_dir, "file_sources").distinct().join(current_files(spark, sf_dir).select("file_id", "path"), "file_id")
    return t.select("file_id", F.sha2("source_text", 256).alias("sha256"), files.line_count(F.col("source_text")).alias("n_lines"), files.language_of(F.col("path")).alias("language"))


def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of every source text by outline."""
    return outline.symbols_of(_parsed(spark, sf_dir)).drop("body_text")


def parse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of every source text."""
    return outline.imports_of(_parsed(spark, sf_dir)).select("file_id", "module", F.array_join("names", ",").alias("names"), "line", "is_from")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "file_sources").distinct().join(current_files(spark, sf_dir).select("file_id", "path"), "file_id")
    return outline.parse(t.select("file_id", "path", files.language_of(F.col("path")).alias("language"), "source_text"))


def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, actions and queries written as JSON lines and read back: what has expired or is too old is left out."""
    history = table(spark, sf_dir, "query_history").select("query_id", "query_text", "confidence", "session_id", "logged_at").distinct()
    feedback = table(spark, sf_dir, "session_feedback").select(F.col("original_query").alias("content"), (F.col("logged_at") + 604_800).alias("expires_at")).distinct()
    acts = table(spark, sf_dir, "session_feedback").select(F.col("session_id").alias("target"), F.col("logged_at").alias("ts")).distinct()
    lines = exchange.export_state(feedback, acts, history, EXPORTED_AT)
    queries = exchange.read_state(lines, "query", "query_id long, query_text string, logged_at double").select(F.lit("query").alias("kind"), F.col("query_text").alias("text"), F.round("logged_at", 3).alias("at"))
    notes = exchange.read_state(lines, "decision", "content string, expires_at double").select(F.lit("decision").alias("kind"), F.col("content").alias("text"), F.round("expires_at", 3).alias("at"))
    actions = exchange.read_state(lines, "action", "target string, ts double").select(F.lit("action").alias("kind"), F.col("target").alias("text"), F.round("ts", 3).alias("at"))
    return queries.unionByName(notes).unionByName(actions)


#: A time in the middle of the logs, so that each kind has rows on both sides of its cut.
EXPORTED_AT = 1_745_500_000.0
_EXTENSIONS = ", ".join(f"('{e}', '{language}')" for e, language in files.LANGUAGES.items())
QUERIES = {f.__name__: f for f in (file_facts, parse_symbols, parse_imports, export_jsonl)}
ORACLES = {
    "file_facts": f"""WITH {FILES}, m(e, language) AS (VALUES {_EXTENSIONS}), t AS (SELECT DISTINCT file_id, source_text FROM file_sources)
      SELECT file_id, sha256(source_text) AS sha256, CASE WHEN source_text = '' THEN 0 ELSE len(string_split(source_text, chr(10))) - CASE WHEN ends_with(source_text, chr(10)) THEN 1 ELSE 0 END END AS n_lines, m.language
      FROM t JOIN f USING (file_id) LEFT JOIN m ON e = lower(regexp_extract(path, '([.][^./]+)$', 1))""",
    "export_jsonl": f"""SELECT 'query' AS kind, query_text AS text, round(logged_at, 3) AS "at" FROM (SELECT DISTINCT query_id, query_text, confidence, session_id, logged_at FROM query_history) WHERE logged_at > {EXPORTED_AT} - 2592000
      UNION ALL SELECT 'decision', content, round(e, 3) FROM (SELECT DISTINCT original_query content, logged_at + 604800 e FROM session_feedback) WHERE e > {EXPORTED_AT}
      UNION ALL SELECT 'action', session_id, round(logged_at, 3) FROM (SELECT DISTINCT session_id, logged_at FROM session_feedback) WHERE logged_at > {EXPORTED_AT} - 604800""",
}
