"""Keeping tables up to date: change detection, upserts, cascades, merges, expiry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds until a note expires, and until a locked one does.
NOTE_TTL, LOCKED_TTL = 7 * 86_400, 100 * 365 * 86_400


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def detect_changes(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256", force: bool = False) -> DataFrame:
    """(key, status): new, changed, unchanged or deleted, by one full outer join of two snapshots with unique keys."""
    a, b = old.select(key, F.col(digest).alias("__o")), new.select(key, F.col(digest).alias("__n"))
    same = F.lit(False) if force else F.col("__o").eqNullSafe(F.col("__n"))
    status = F.when(F.col("__in_old").isNull(), "new").when(F.col("__in_new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    joined = a.withColumn("__in_old", F.lit(1)).join(b.withColumn("__in_new", F.lit(1)), key, "full_outer")
    return joined.select(key, status.alias("status"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source's rows, and the target's rows of other keys. Columns are matched by name."""
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source.select(*target.columns))


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the removed keys."""
    gone = removed.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def drop_edges_of(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those that touch a removed symbol at either end."""
    gone = removed.select("symbol_id").distinct()
    return edges.join(gone, edges["source_id"] == gone["symbol_id"], "left_anti").join(gone, edges["target_id"] == gone["symbol_id"], "left_anti")


def merge_notes(target: DataFrame, source: DataFrame, strategy: str = "newer_wins", keys: Sequence[str] = ("content", "type")) -> DataFrame:
    """Both sides' notes by key: newer_wins takes the later expiry, source_wins the source's, skip_existing the target's.

    The target's other columns stay in every case; a full outer join on unique keys.
    """
    rest = [c for c in target.columns if c not in (*keys, "expires_at")]
    a = target.select(*keys, F.col("expires_at").alias("t_exp"), F.struct(*rest).alias("t_rest"), F.lit(1).alias("in_t"))
    b = source.select(*keys, F.col("expires_at").alias("s_exp"), F.struct(*rest).alias("s_rest"))
    merged = {
        "newer_wins": F.greatest("t_exp", "s_exp"),
        "source_wins": F.coalesce("s_exp", "t_exp"),
        "skip_existing": F.coalesce("t_exp", "s_exp"),
    }[strategy]
    joined = a.join(b, list(keys), "full_outer")
    return joined.select(*keys, F.when(F.col("in_t").isNull(), F.col("s_exp")).otherwise(merged).alias("expires_at"), F.coalesce("t_rest", "s_rest").alias("r")).select(*keys, "expires_at", "r.*").select(*target.columns)


def unexpired(notes: DataFrame, now: float | DataFrame) -> DataFrame:
    """Notes that expire after ``now``, a time or one row (now)."""
    if not isinstance(now, DataFrame):
        return notes.filter(F.col("expires_at") > now)
    return notes.crossJoin(F.broadcast(now.select(F.col("now").alias("__now")))).filter("expires_at > __now").drop("__now")


def active_notes(notes: DataFrame, now: float | DataFrame, kind: str | None = None, tag: str | None = None, limit: int | None = None) -> DataFrame:
    """Unexpired notes, locked ones first, then the latest; possibly of one kind, with a tag, at most ``limit``."""
    live = unexpired(notes, now)
    live = live.filter(F.col("type") == kind) if kind else live
    live = live.filter(F.col("tags").ilike(f"%{tag}%")) if tag else live
    live = live.orderBy(F.desc((F.col("type") == "locked").cast("int")), F.desc("created_at"), "content")
    return live if limit is None else live.limit(limit)


def note(content: Column, kind: Column, now: float) -> Column:
    """A new note: its words capped at 20 (60 if locked) and its expiry."""
    from ..functions.text import cap_words

    locked = kind == "locked"
    return F.struct(
        cap_words(content, F.when(locked, 60).otherwise(20)).alias("content"), kind.alias("type"), F.lit(now).alias("created_at"), (F.lit(now) + F.when(locked, LOCKED_TTL).otherwise(NOTE_TTL)).alias("expires_at")
    )


def symbol_search(symbols: DataFrame, files: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """(symbol_id, name, path): symbols whose name contains ``part``, letter case aside."""
    hits = symbols.filter(F.col("name").ilike(f"%{part}%")).select("symbol_id", "name", "file_id")
    return hits.join(files.select("file_id", "path"), "file_id").orderBy("name", "symbol_id").limit(limit).select("symbol_id", "name", "path")


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is ``scope`` or below it."""
    return (path == scope) | path.startswith(scope.rstrip("/") + "/")


def undocumented(symbols: DataFrame, files: DataFrame, scope: str | None = None) -> DataFrame:
    """(symbol_id, path): public functions, methods and classes without documentation."""
    hits = symbols.filter(F.col("docstring").isNull() & (F.col("visibility") == "public") & F.lower(F.trim("kind")).isin("function", "method", "class"))
    joined = hits.join(files.select("file_id", "path"), "file_id")
    return joined.filter(in_scope(F.col("path"), scope) if scope else F.lit(True)).select("symbol_id", "path")


def unparsed(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files without symbols."""
    return files.join(symbols.select("file_id").distinct(), "file_id", "left_anti")


def resolve_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """(file_id, symbol_id): in each file the first symbol of that name or whose qualified name ends with it."""
    hits = symbols.filter((F.col("name") == name) | F.col("qualified").endswith("." + name))
    return hits.groupBy("file_id").agg(F.min(F.struct("line_start", "symbol_id")).alias("m")).select("file_id", F.col("m.symbol_id").alias("symbol_id"))


def symbols_of_file(symbols: DataFrame, file_id: int) -> DataFrame:
    """A file's symbols by line."""
    return symbols.filter(F.col("file_id") == file_id).orderBy("line_start", "symbol_id")


def tags_of_file(tags: DataFrame, file_id: int) -> DataFrame:
    """(tag): a file's tags, sorted, each once."""
    return tags.filter(F.col("file_id") == file_id).select("tag").distinct().orderBy("tag")


def add_if_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target's rows and the source's rows of new keys, one per key (the smallest); rows that are there stay as they are."""
    rest = [c for c in target.columns if c not in keys]
    fresh = source.join(target.select(*keys).distinct(), list(keys), "left_anti")
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]) if rest else fresh.select(*keys).distinct()
    return target.unionByName(one.select(*target.columns))


def latest_scan(scans: DataFrame) -> DataFrame:
    """The last completed scan, one row; of equal times the one that started later."""
    return scans.orderBy(F.desc("completed_at"), F.desc("started_at")).limit(1)


def statistics(files: DataFrame, symbols: DataFrame, edges: DataFrame, tags: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """(section, name, n): the size of the index as one table: totals, files per language and tag, symbols and edges per kind, the last scan."""

    def counted(section: str, df: DataFrame, name: Column) -> DataFrame:
        return df.groupBy(F.coalesce(name, F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")

    def total(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "n")

    parts = [
        total("files", files, F.count(F.lit(1))), total("lines", files, F.sum("line_count")), total("bytes", files, F.sum("byte_size")), total("symbols", symbols, F.count(F.lit(1))), total("edges", edges, F.count(F.lit(1))),
        counted("language", files, F.lower(F.trim("language"))), counted("symbol", symbols, F.lower(F.trim("kind"))), counted("edge", edges, F.col("kind")), counted("tag", tags, F.col("tag")),
    ]
    if scans is not None:
        parts.append(latest_scan(scans).select(F.lit("scan").alias("section"), F.lit("files_changed").alias("name"), F.col("files_changed").cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def store_vectors(vectors: DataFrame, path: str) -> None:
    """Writes vectors (symbol_id, file_id, model, dim, vector), a folder per model; a model's vectors are replaced, other models stay."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
