"""Log analytics: sessions, queries, file access, retries, limits, tuning."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence_value(label: Column) -> Column:
    """high 3, medium 2, everything else 1."""
    return F.when(label == "high", 3).when(label == "medium", 2).otherwise(1)


def top_queries(history: DataFrame, k: int = 20) -> DataFrame:
    """(query_text, n, last_at, avg_confidence): the most frequent queries."""
    grouped = history.groupBy("query_text").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("logged_at"), 3).alias("last_at"), F.round(F.avg(confidence_value(F.col("confidence"))), 6).alias("avg_confidence"))
    return grouped.orderBy(F.desc("n"), "query_text").limit(k)


def file_access(actions: DataFrame, k: int | None = 30) -> DataFrame:
    """(target, reads, edits, score): score is reads + 2 * edits, the best ``k`` targets."""
    reads, edits = (F.sum((F.col("action") == a).cast("long")) for a in ("read", "edit"))
    scored = actions.groupBy("target").agg(reads.alias("reads"), edits.alias("edits")).withColumn("score", F.col("reads") + 2 * F.col("edits"))
    return scored if k is None else scored.orderBy(F.desc("score"), "target").limit(k)


def query_action_pairs(queries: DataFrame, actions: DataFrame, within: float = 60.0) -> DataFrame:
    """(query_id, target): actions of the same session strictly after a query and less than ``within`` seconds later.

    The join is on session and time bucket, so a hot session is spread over its buckets; each query
    visits its own bucket and the next.
    """
    bucket = F.floor(F.col("ts") / within)
    q = queries.select("query_id", "session_id", F.col("ts").alias("q_ts"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    a = actions.select("session_id", "target", F.col("ts").alias("a_ts"), bucket.alias("bucket"))
    near = q.join(a, ["session_id", "bucket"]).filter((F.col("a_ts") > F.col("q_ts")) & (F.col("a_ts") < F.col("q_ts") + within))
    return near.select("query_id", "target")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger set of words; null without words."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.greatest(F.size(x), F.size(y)), F.lit(0))


#: Seconds of a log that one task orders for one key.
SPAN = 86_400.0


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], span: float = SPAN) -> DataFrame:
    """``rows`` with __before, a struct of ``columns`` of the key's row before (null for the first). ``order[0]`` is a time in seconds.

    A key's rows are ordered span by span, so a hot key is many tasks; the first row of a span takes the last one of
    the key's span before, which is one row a span.
    """
    cut = F.floor(F.col(order[0]) / span)
    within = Window.partitionBy(*keys, "__span").orderBy(*order)
    own = F.struct(*columns)
    placed = rows.withColumn("__span", cut).withColumn("__lag", F.lag(own).over(within)).withColumn("__first", F.row_number().over(within) == 1)
    last = rows.withColumn("__span", cut).groupBy(*keys, "__span").agg(F.max_by(own, F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__span"))).drop("__last")
    same = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(carried[k]) for k in [*keys, "__span"]])
    joined = placed.join(carried, same, "left")
    return joined.select(*[placed[c] for c in rows.columns], F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__lag")).alias("__before"))


def with_running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, span: float = SPAN) -> DataFrame:
    """``rows`` with the sum of ``value`` over the key's rows up to each; ordered span by span like ``with_previous``."""
    cut = F.floor(F.col(order[0]) / span)
    within = Window.partitionBy(*keys, "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = rows.withColumn("__span", cut).withColumn("__value", value)
    placed = valued.withColumn("__sum", F.sum("__value").over(within))
    totals = valued.groupBy(*keys, "__span").agg(F.sum("__value").alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.withColumn("__carried", F.coalesce(before, F.lit(0))).drop("__total")
    same = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(carried[k]) for k in [*keys, "__span"]])
    return placed.join(carried, same).select(*[placed[c] for c in rows.columns], (F.col("__sum") + F.col("__carried")).alias(name))


def retries(history: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(query_id, overlap): queries that repeat the session's previous one, which wasn't answered with high confidence."""
    rows = history.select("query_id", "query_text", "session_id", "logged_at", F.coalesce("confidence", F.lit("low")).alias("confidence"))
    before = with_previous(rows, ["session_id"], ["logged_at", "query_id"], ["query_text", "confidence"]).select("query_id", "query_text", F.col("__before.query_text").alias("p_text"), F.col("__before.confidence").alias("p_conf"))
    scored = before.filter(F.col("p_text").isNotNull() & (F.col("p_conf") != "high")).withColumn("overlap", token_overlap(F.col("query_text"), F.col("p_text")))
    return scored.filter(F.col("overlap") >= threshold).select("query_id", F.round("overlap", 6).alias("overlap"))


def rate_limited(calls: DataFrame, limit: int = 120, seconds: int = 60, key: str | None = None) -> DataFrame:
    """``calls`` with n_recent, the calls of the trailing window, and whether the limit is passed. ``calls`` has ts in epoch seconds.

    The log is cut into spans as long as the window; every call is also seen by the span after its own, so no key, and no log
    without keys, is one task.
    """
    span = F.floor(F.col("ts") / max(seconds, 1))
    seen = calls.withColumn("__at", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__span", span + F.col("__at"))
    w = Window.partitionBy(*([key] if key else []), "__span").orderBy("ts").rangeBetween(-seconds, Window.currentRow)
    counted = seen.withColumn("n_recent", F.count(F.lit(1)).over(w)).filter("__at = 0").drop("__at", "__span")
    return counted.withColumn("limited", F.col("n_recent") > limit)


def debounced(events: DataFrame, key: str, seconds: float = 5.0) -> DataFrame:
    """Events, with gap, whose predecessor of the same key lies at least ``seconds`` back."""
    gap = F.col("ts") - F.col("__before.ts")
    found = with_previous(events, [key], ["ts", "event_id"], ["ts"]).withColumn("gap", gap).drop("__before")
    return found.filter(F.col("gap").isNull() | (F.col("gap") >= seconds))


def session_conflicts(edits: DataFrame, asking: DataFrame, now: float | DataFrame, within: float = 3600.0) -> DataFrame:
    """(session_id, other_id, files): for each session of ``asking`` the other recent ones that edited the same files.

    ``edits``: session_id, last_seen, file_path; ``asking``: session_id; ``now``: a time or one row (now). A stated set of sessions
    against all: who asks for all sessions at once gets their files by ``contested_files``, since a file that very many sessions edit has
    a pair for any two of them.
    """
    recent = _recent_edits(edits, now, within)
    mine = recent.join(asking.select("session_id").distinct(), "session_id", "left_semi")
    met = mine.join(recent.withColumnRenamed("session_id", "other_id"), "file_path").filter("session_id <> other_id")
    return met.groupBy("session_id", "other_id").agg(F.array_join(F.array_sort(F.collect_set("file_path")), ",").alias("files"))


def _recent_edits(edits: DataFrame, now: float | DataFrame, within: float) -> DataFrame:
    clock = now if isinstance(now, DataFrame) else edits.sparkSession.range(1).select(F.lit(float(now)).alias("now"))
    return edits.crossJoin(F.broadcast(clock.select(F.col("now").alias("__now")))).filter(F.col("last_seen") > F.col("__now") - within).select("session_id", "file_path").distinct()


def contested_files(edits: DataFrame, now: float | DataFrame, within: float = 3600.0) -> DataFrame:
    """(file_path, n_sessions, first_session): files that several recent sessions edited. A file is the conflict's class, ``edits`` its membership; no pairs are made."""
    recent = _recent_edits(edits, now, within)
    return recent.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_sessions"), F.min("session_id").alias("first_session")).filter("n_sessions > 1")


def register_sessions(registry: DataFrame, seen: DataFrame, now: float, expire: float = 4 * 3600.0) -> DataFrame:
    """The registry (session_id, project, started_at, last_seen, edited_files) after ``seen`` (session_id, project) registered at ``now``.

    A known session keeps when it started, and its edited files are forgotten; sessions not seen for ``expire`` seconds are dropped.
    """
    new = seen.groupBy("session_id").agg(F.max("project").alias("project"))
    known = registry.select("session_id", F.col("started_at").alias("__started"))
    fresh = new.join(known, "session_id", "left").select(
        "session_id", "project", F.coalesce("__started", F.lit(now)).alias("started_at"), F.lit(now).alias("last_seen"), F.lit("").alias("edited_files")
    )
    kept = registry.filter(F.col("last_seen") > now - expire).join(new, "session_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def session_summary(actions: DataFrame) -> DataFrame:
    """(session_id, n_total, by_action): each session's actions by kind, as "kind=n" sorted by kind."""
    counts = actions.groupBy("session_id", "action").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("action", "n")))
    grouped = counts.groupBy("session_id").agg(F.sum("n").alias("n_total"), entries.alias("e"))
    return grouped.select("session_id", "n_total", F.array_join(F.transform("e", lambda x: F.concat(x["action"], F.lit("="), x["n"].cast("string"))), ",").alias("by_action"))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregate, no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__l")).select(*keys, *[F.col(f"__l.{c}").alias(c) for c in rest])


def since(rows: DataFrame, column: str, days: float, now: float | DataFrame) -> DataFrame:
    """Rows of the last ``days`` days before ``now``, a time or one row (now)."""
    clock = now if isinstance(now, DataFrame) else rows.sparkSession.range(1).select(F.lit(float(now)).alias("now"))
    return rows.crossJoin(F.broadcast(clock.select(F.col("now").alias("__now")))).filter(F.col(column) > F.col("__now") - days * 86_400).drop("__now")


def token_budget(calls: DataFrame, budget: int = 500_000, warn: float = 0.9) -> DataFrame:
    """``calls`` (session_id, ts, call_id, n_chars) with the running number of tokens (a quarter of the characters) and a state."""
    used = with_running_sum(calls, ["session_id"], ["ts", "call_id"], F.floor(F.col("n_chars") / 4), "used")
    return used.withColumn("state", F.when(F.col("used") > budget, "over").when(F.col("used") > warn * budget, "warn").otherwise("ok"))


def rank_quality(accessed: DataFrame, results: DataFrame, miss: int = 50) -> DataFrame:
    """One row (n_queries, avg_rank, confidence): the mean 0-based position of accessed files among the results; a miss counts ``miss``.

    ``accessed``: query_id, target; ``results``: query_id, pos (from 1), file_path.
    """
    first = results.groupBy("query_id", F.col("file_path").alias("target")).agg(F.min("pos").alias("pos"))
    placed = accessed.select("query_id", "target").distinct().join(first, ["query_id", "target"], "left")
    row = placed.agg(F.count_distinct("query_id").alias("n_queries"), F.round(F.avg(F.when(F.col("pos").isNull(), F.lit(miss)).otherwise(F.col("pos") - 1)), 6).alias("avg_rank"))
    label = F.when((F.col("n_queries") < 10) | F.col("avg_rank").isNull(), "low").when(F.col("avg_rank") <= 5, "high").when(F.col("avg_rank") <= 10, "medium").otherwise("low")
    return row.withColumn("confidence", label)


def tuned(quality: DataFrame) -> DataFrame:
    """One row (confidence, name_boost, signature_boost, recency_weight, pagerank_weight) by the tuning rules.

    ``quality`` is one row with n_queries, avg_rank and the rates name_miss, signature_hit, recency_hit and hub_hit.
    With fewer than ten queries nothing changes.
    """
    enough, low = F.col("n_queries") >= 10, F.col("avg_rank") > 10
    return quality.select(
        F.when(~enough, "low").when(F.col("avg_rank") <= 5, "high").when(F.col("avg_rank") <= 10, "medium").otherwise("low").alias("confidence"),
        F.when(enough & low & (F.col("name_miss") > 0.3), 4).otherwise(3).alias("name_boost"),
        F.when(enough & low & (F.col("signature_hit") > 0.5), 3).otherwise(2).alias("signature_boost"),
        F.when(enough & (F.col("recency_hit") > 0.6), 1.5).otherwise(1.0).alias("recency_weight"),
        F.when(enough & (F.col("hub_hit") > 0.5), 1.5).otherwise(1.0).alias("pagerank_weight"),
    )


def save_weights(path: str, weights: dict[str, float], spark, now: float) -> None:
    """Writes the tuned weights as one JSON line (key, value, updated_at)."""
    row = [("weights", json.dumps(weights, sort_keys=True), now)]
    spark.createDataFrame(row, "key string, value string, updated_at double").coalesce(1).write.mode("overwrite").json(path)


def load_weights(spark, path: str, default: dict[str, float]) -> dict[str, float]:
    """The stored weights over ``default``; the default alone if there are none."""
    try:
        row = spark.read.schema("key string, value string, updated_at double").json(path).filter("key = 'weights'").orderBy(F.desc("updated_at")).first()
    except AnalysisException:
        row = None
    return {**default, **json.loads(row["value"])} if row else dict(default)


def tuning_due(n_queries: int, confidence: str, every: int = 50) -> bool:
    """Whether weights are to be tuned now: every so many queries, if the tuner can be trusted."""
    return n_queries > 0 and n_queries % every == 0 and confidence in ("medium", "high")


def report(history: DataFrame, actions: DataFrame, indexed: DataFrame, days: float, now: float | DataFrame, k_queries: int = 20, k_files: int = 30) -> DataFrame:
    """(section, name, value): the usage report of the last ``days`` days as one table: totals, confidences, top queries, most used files, files never used.

    ``history``: query_text, confidence, session_id, logged_at; ``actions``: session_id, action, target, ts; ``indexed``: target.
    """
    asked, acts = since(history, "logged_at", days, now), since(actions, "ts", days, now)

    def part(section: str, df: DataFrame, name, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))

    totals = asked.agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("query_text").alias("different_queries"), F.count_distinct("session_id").alias("sessions"))
    totals = totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    per_session = acts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("n"))
    files = file_access(acts.filter("target IS NOT NULL"), k_files)
    unused = indexed.select("target").distinct().join(acts.select("target").distinct(), "target", "left_anti")
    parts = [
        part("total", totals, F.col("name"), F.col("value")), part("action", acts.groupBy("action").agg(F.count(F.lit(1)).alias("n")), F.col("action"), F.col("n")),
        part("confidence", asked.groupBy(F.coalesce("confidence", F.lit("none")).alias("c")).agg(F.count(F.lit(1)).alias("n")), F.col("c"), F.col("n")),
        part("query", top_queries(asked, k_queries), F.col("query_text"), F.col("n")), part("file", files, F.col("target"), F.col("score")), part("session", per_session, F.lit("mean actions"), F.col("n")),
        part("never used", unused.agg(F.count(F.lit(1)).alias("n")), F.lit("files"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def reduction(sizes: DataFrame) -> DataFrame:
    """One row (n, mean_reduction, median_reduction, mean_packed): how much smaller packed contexts are than naive ones, in percent. ``sizes``: naive, packed."""
    share = (F.col("naive") - F.col("packed")) * 100.0 / F.nullif(F.col("naive"), F.lit(0))
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 6).alias("mean_reduction"), F.round(F.median(share), 6).alias("median_reduction"), F.floor(F.avg("packed")).alias("mean_packed"))


def merged_edits(old: Column, new: Column, limit: int = 50) -> Column:
    """The union of two lists of edited files, sorted, at most ``limit``."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none))), 1, limit)


def funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """(step, name, users): users who did the first steps in this order, each strictly after the one before.

    One aggregate a step over the user's events; no join of events with events.
    """
    spark = events.sparkSession
    reached = events.select("user_id", "event_type", "ts")
    state = reached.filter(F.col("event_type") == steps[0]).groupBy("user_id").agg(F.min("ts").alias("at"))
    out = [state.agg(F.count(F.lit(1)).alias("users")).select(F.lit(1).alias("step"), F.lit(steps[0]).alias("name"), "users")]
    for i, step in enumerate(steps[1:], 2):
        state = reached.filter(F.col("event_type") == step).join(state, "user_id").filter("ts > at").groupBy("user_id").agg(F.min("ts").alias("at"))
        out.append(state.agg(F.count(F.lit(1)).alias("users")).select(F.lit(i).alias("step"), F.lit(step).alias("name"), "users"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "step int, name string, users long")
