"""Streaming queries over the events, run to the end of what is there; their SQL is the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..streaming import windows
from .catalogue import FILES, current_files


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, by a watermarked stream."""
    out = windows.to_table(windows.tumbling_counts(windows.event_stream(spark, sf_dir)), "daily")
    return out.select(F.to_date("start").alias("day"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps of four hours."""
    out = windows.to_table(windows.sessions(windows.event_stream(spark, sf_dir)), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log without its repeated rows, whatever their delay."""
    raw = spark.readStream.schema("query_id long, query_text string, session_id string, logged_at double").option("pathGlobFilter", "query_history.parquet").parquet(sf_dir)
    timed = raw.withColumn("ts", F.timestamp_seconds("logged_at"))
    out = windows.to_table(windows.deduplicated(timed, ["query_id"], "3650 days"), "dedupe", "append")
    return out.select("query_id", "query_text", "session_id")


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events at least an hour after the one kept before."""
    out = windows.to_table(windows.debounced(windows.event_stream(spark, sf_dir), 3600.0), "debounce", "append")
    return out.select("event_id")


def stream_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the source texts kept by a stream of them: its files, with the number of lines."""
    texts = spark.readStream.schema("file_id long, source_text string").option("pathGlobFilter", "file_sources.parquet").parquet(sf_dir)
    paths = current_files(spark, sf_dir).select("file_id", "path")
    index = windows.FileIndex(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    index.follow(texts.join(F.broadcast(paths), "file_id").withColumn("seq", F.length("source_text"))).awaitTermination()
    return index.files().select("file_id", "sha256", "line_count")


def stream_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited files of hook records, by the nearest project root."""
    f = current_files(spark, sf_dir)
    record = F.to_json(F.struct(F.col("last_parsed").alias("ts"), F.struct(F.concat(F.lit("/w/"), "project", F.lit("/"), "path").alias("file_path")).alias("tool_input")))
    roots = [f"/w/{r['project']}" for r in f.select("project").distinct().orderBy("project").limit(3).collect()]
    return windows.hook_edits(f.select(record.alias("value")), ["/w", *roots]).select("root", "path")


def stream_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running index: events per target, replaced batch by batch."""
    stream = windows.event_stream(spark, sf_dir)
    grouped = stream.groupBy(F.get_json_object("props", "$.k").cast("long").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return windows.to_table(grouped, "index")


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_sessions, stream_dedupe, stream_debounce, stream_reindex, stream_hooks, stream_incremental_index)}
ORACLES = {
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 4 HOUR THEN 1 ELSE 0 END new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_dedupe": "SELECT DISTINCT query_id, query_text, session_id FROM query_history",
    "stream_debounce": """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r FROM events),
      k AS (SELECT user_id, event_id, t, r, t AS last, true AS kept FROM o WHERE r = 1
        UNION ALL SELECT o.user_id, o.event_id, o.t, o.r, CASE WHEN o.t - k.last >= 3600 THEN o.t ELSE k.last END, o.t - k.last >= 3600 FROM k JOIN o ON o.user_id = k.user_id AND o.r = k.r + 1)
      SELECT event_id FROM k WHERE kept""",
    "stream_reindex": f"""WITH {FILES}, t AS (SELECT file_id, arg_max(source_text, length(source_text)) x FROM file_sources GROUP BY file_id)
      SELECT file_id, sha256(x) AS sha256, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, chr(10))) - CASE WHEN ends_with(x, chr(10)) THEN 1 ELSE 0 END END AS line_count FROM t JOIN f USING (file_id)""",
    "stream_hooks": f"""WITH {FILES}, p AS (SELECT DISTINCT project FROM f ORDER BY project LIMIT 3)
      SELECT CASE WHEN project IN (SELECT project FROM p) THEN '/w/' || project ELSE '/w' END AS root, CASE WHEN project IN (SELECT project FROM p) THEN path ELSE project || '/' || path END AS path FROM f WHERE project IS NOT NULL AND path IS NOT NULL""",
    "stream_incremental_index": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, count(*) AS n FROM events GROUP BY 1",
}
