"""Structured Streaming forms of the log operators. Each takes a streaming DataFrame with an event time and gives another one."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..session import checkpoint_dir, written
from ..sources import files as file_source
from ..sources import outline

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_batch: int = 8) -> DataFrame:
    """The events as a stream of files; its time is usable for watermarks."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n): events per window and type."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(user_id, start, n): calls per user and sliding window, as for rate limits."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "4 hours") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without those whose keys came before within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def enriched(events: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table."""
    return events.join(files, key, "left")


def debounced(events: DataFrame, seconds: float = 5.0, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, ts): events at least ``seconds`` after the user's last kept one.

    State is one time per user. It is forgotten once the watermark has passed the time until which it could hold an event back, so it
    is bounded by the users of ``late`` and ``seconds``, not by all users ever seen. Events that come later than ``late`` are left out.
    """

    def keep(key: tuple, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        at = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6
        kept, i = [], 0
        while True:
            # The first event that is late enough after the last kept one.
            i = max(i, int(np.searchsorted(at, last + seconds, side="left")))
            if i >= len(at):
                break
            kept.append(i)
            last, i = at[i], i + 1
        if last > float("-inf"):
            state.update((float(last),))
            state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        out = rows.iloc[kept]
        yield pd.DataFrame({"user_id": key[0], "event_id": out["event_id"], "ts": out["ts"]})

    grouped = events.withWatermark("ts", late).groupBy("user_id")
    return grouped.applyInPandasWithState(keep, "user_id long, event_id long, ts timestamp", "last double", "append", "EventTimeTimeout")


class FileIndex:
    """An index of source texts that a stream of files keeps up to date: files, symbols and contains edges as tables below a folder.

    Each batch replaces what it names and nothing else: a file's older version, its symbols and the edges at them go, and what the new
    text declares comes. Rows lie in folders by a hash of the file, and a batch writes only the folders that its files are in, so its work
    grows with the batch and not with the index. A batch that is written again gives the same tables.
    """

    GROUPS = 32

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def files(self) -> DataFrame:
        """(file_id, path, language, sha256, line_count)"""
        return self._table("files", "file_id long, path string, language string, sha256 string, line_count long")

    def symbols(self) -> DataFrame:
        """(symbol_id, file_id, name, qualified, kind, line_start, line_end, ...); the id is a hash of file, qualified name and line."""
        return self._table("symbols", "file_id long, " + outline.SYMBOL.removeprefix("struct<").removesuffix(">").replace(": ", " ") + ", symbol_id long")

    def contains(self) -> DataFrame:
        """(source_id, target_id, kind) of classes and their methods."""
        return self._table("contains", "source_id long, target_id long, kind string, file_id long").drop("file_id")

    def update(self, batch: DataFrame, number: int = 0) -> None:
        """Takes in a batch of (file_id, path, source_text, seq); of several versions of a file the last counts. A null text removes the file."""
        latest = batch.groupBy("file_id").agg(F.max_by(F.struct("path", "source_text"), "seq").alias("l")).select("file_id", "l.path", "l.source_text").persist()
        try:
            language = file_source.language_of(F.col("path"))
            present = latest.filter("source_text IS NOT NULL")
            files = present.select("file_id", "path", language.alias("language"), F.sha2("source_text", 256).alias("sha256"), file_source.line_count(F.col("source_text")).alias("line_count"))
            parsed = outline.symbols_of(outline.parse(present.select("file_id", "path", language.alias("language"), "source_text")))
            symbols = written(parsed.withColumn("symbol_id", F.xxhash64("file_id", "qualified", "line_start")))
            edges = graph.contains_edges(symbols).join(symbols.select(F.col("symbol_id").alias("target_id"), "file_id"), "target_id").select("source_id", "target_id", "kind", "file_id")
            gone = latest.select("file_id")
            self._replace("symbols", self.symbols().drop("part"), symbols, gone)
            self._replace("contains", self._table("contains", "source_id long, target_id long, kind string, file_id long"), edges, gone)
            self._replace("files", self.files(), files, gone)
        finally:
            latest.unpersist()

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, part int").parquet(f"{self.folder}/{name}").drop("part")
        except AnalysisException as e:  # nothing was taken in yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _replace(self, name: str, old: DataFrame, new: DataFrame, gone: DataFrame) -> None:
        part = F.pmod(F.xxhash64("file_id"), F.lit(self.GROUPS)).cast("int")
        touched = gone.select(part.alias("part")).distinct()  # GROUPS rows at most
        touched = [r["part"] for r in touched.collect()]
        kept = old.withColumn("part", part).filter(F.col("part").isin(touched)).join(gone, "file_id", "left_anti")
        # Written aside first: a table can't be read and replaced at once.
        whole = written(kept.unionByName(new.withColumn("part", part).select(*kept.columns)))
        target = f"{self.folder}/{name}"
        for p in sorted(set(touched) - {r["part"] for r in whole.select("part").distinct().collect()}):
            jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/part={p}")
            jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)

    def follow(self, stream: DataFrame, available_now: bool = True, seconds: int = 2):
        """Keeps the index up to date from a stream of (file_id, path, source_text, seq): to the end of what is there, or every few seconds until it is stopped."""
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
        return stream.writeStream.option("checkpointLocation", f"{self.folder}/progress").trigger(**trigger).foreachBatch(self.update).start()


def watched_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """(file_id, path, source_text, seq): the text files below a folder as a stream; a file that is created or changed comes (again), a deleted one doesn't."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    named = raw.withColumn("path", path).filter(~file_source.ignored(F.col("path")) & file_source.language_of(F.col("path")).isNotNull())
    return named.select(F.xxhash64("path").alias("file_id"), "path", F.decode("content", "UTF-8").alias("source_text"), F.unix_micros("modificationTime").alias("seq"))


def hook_edits(lines: DataFrame, roots: Sequence[str]) -> DataFrame:
    """(root, path, ts): edited files of hook records, JSON lines (value) with tool_input.file_path and a time; the nearest project root above the file counts.

    Works on streams and on tables. Records without a path, and files below no root, are left out.
    """
    record = F.from_json("value", "ts double, tool_input struct<file_path: string>")
    read = lines.select(record["tool_input"]["file_path"].alias("file"), record["ts"].alias("ts")).filter("file IS NOT NULL")
    root = F.lit(None).cast("string")
    for r in sorted(set(roots), key=len):  # the longest last, so it wins
        root = F.when(F.col("file").startswith(r.rstrip("/") + "/"), F.lit(r)).otherwise(root)
    found = read.withColumn("root", root).filter("root IS NOT NULL")
    return found.select("root", F.expr("substring(file, length(root) + 2)").alias("path"), "ts")


def to_table(stream: DataFrame, name: str, mode: str = "complete", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and gives what it wrote.

    Results and progress go to the shared checkpoint folder, so a restarted run goes on where it
    stopped; in complete mode each batch replaces the result, else it is added under its number, so a
    batch that is written again replaces itself.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch) if each else batch
        out.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch=*")
    except Exception as e:  # nothing was written: the stream had no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
