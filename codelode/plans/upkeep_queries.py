"""Queries over keeping the store, logs, concepts and texts: what the operators do to given tables, and to small given inputs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concepts, edit, logs, pack, store
from ..session import checkpoint_dir, table
from ..sources import exchange, files, outline, remote
from .catalogue import ACTIONS, FILES, SYMBOLS, actions, current_files, current_symbols, documents

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def values(columns: str, rows: list[tuple]) -> str:
    """SQL that gives literal rows: what a query over a literal input must find."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


# Store ------------------------------------------------------------------------------------------


@query(f"WITH {FILES}, {SYMBOLS}, e AS (SELECT DISTINCT symbol_id source_id, symbol_id + 1 target_id FROM s), g AS (SELECT symbol_id FROM s JOIN f USING (file_id) WHERE line_count = 0) SELECT source_id, target_id FROM e WHERE source_id NOT IN (SELECT symbol_id FROM g) AND target_id NOT IN (SELECT symbol_id FROM g)")
def clear_edges(spark, d):
    """Edges without those at symbols of emptied files."""
    s = current_symbols(spark, d)
    edges = s.select(F.col("symbol_id").alias("source_id"), (F.col("symbol_id") + 1).alias("target_id"))
    return store.drop_edges_of(edges, s.join(current_files(spark, d).filter("line_count = 0").select("file_id"), "file_id"))


@query(
    f"""WITH {FILES}, t AS (SELECT file_id, CASE WHEN is_entry THEN 'entry' ELSE 'module' END tag FROM f), n AS (SELECT DISTINCT file_id, CASE WHEN is_entry THEN 'entry' ELSE 'other' END tag FROM files)
    SELECT file_id, tag FROM t UNION SELECT file_id, tag FROM n"""
)
def add_tags(spark, d):
    """Tags added to files that may have them already."""
    tags = current_files(spark, d).select("file_id", F.when(F.col("is_entry"), "entry").otherwise("module").alias("tag"))
    more = table(spark, d, "files").select("file_id", F.when(F.col("is_entry"), "entry").otherwise("other").alias("tag"))
    return store.add_if_new(tags, more, ["file_id", "tag"])


@query(f"WITH {SYMBOLS} SELECT symbol_id, name, line_start FROM s WHERE file_id = (SELECT min(file_id) FROM s)")
def symbols_of_file(spark, d):
    """The symbols of one file."""
    s = current_symbols(spark, d)
    return store.symbols_of_file(s, s.agg(F.min("file_id")).first()[0]).select("symbol_id", "name", "line_start")


SCANS = "sc AS (SELECT epoch_us(min(ts)) / 1e6 started_at, epoch_us(max(ts)) / 1e6 completed_at, count(*) files_changed FROM events GROUP BY CAST(ts AS DATE))"


def scans(spark, d) -> DataFrame:
    """Days of the event log as scans."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min(ts).alias("started_at"), F.max(ts).alias("completed_at"), F.count(F.lit(1)).alias("files_changed")).drop("day")


@query(f"WITH {SCANS} SELECT round(completed_at, 3) AS completed_at, files_changed FROM sc ORDER BY completed_at DESC LIMIT 1")
def latest_scan(spark, d):
    """The last scan."""
    return store.latest_scan(scans(spark, d)).select(F.round("completed_at", 3).alias("completed_at"), "files_changed")


@query(
    f"""WITH {FILES}, {SYMBOLS}, {SCANS}, e AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag k FROM lineitem), tg AS (SELECT DISTINCT file_id, CASE WHEN is_entry THEN 'entry' ELSE 'module' END tag FROM f)
    SELECT 'total' AS section, name, n FROM (SELECT 'files' AS name, count(*) AS n FROM f UNION ALL SELECT 'lines', CAST(coalesce(sum(line_count), 0) AS BIGINT) FROM f UNION ALL SELECT 'bytes', CAST(coalesce(sum(byte_size), 0) AS BIGINT) FROM f UNION ALL SELECT 'symbols', count(*) FROM s UNION ALL SELECT 'edges', count(*) FROM e)
    UNION ALL SELECT 'language', coalesce(lower(trim(language)), 'unknown'), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'symbol', coalesce(lower(trim(kind)), 'unknown'), count(*) FROM s GROUP BY 2 UNION ALL SELECT 'edge', k, count(*) FROM e GROUP BY 2
    UNION ALL SELECT 'tag', tag, count(*) FROM tg GROUP BY 2 UNION ALL SELECT 'scan', 'files_changed', files_changed FROM (SELECT * FROM sc ORDER BY completed_at DESC LIMIT 1)"""
)
def statistics(spark, d):
    """The size of the index: totals, files per language and tag, symbols and edges per kind, the last scan."""
    f = current_files(spark, d)
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("kind")).distinct()
    tags = f.select("file_id", F.when(F.col("is_entry"), "entry").otherwise("module").alias("tag")).distinct()
    return store.statistics(f, current_symbols(spark, d), edges, tags, scans(spark, d))


@query("WITH v AS (SELECT DISTINCT symbol_id, file_id, model, dim FROM symbol_embeddings WHERE model IS NOT NULL) SELECT model, count(*) AS n, min(dim) AS dim FROM v GROUP BY model")
def store_vectors(spark, d):
    """Vectors written by model, one model replaced, and read back."""
    path = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    v = table(spark, d, "symbol_embeddings").filter("model IS NOT NULL").dropDuplicates(["symbol_id", "file_id", "model", "dim"])
    first = v.agg(F.min("model").alias("m"))
    store.store_vectors(v.withColumn("dim", F.lit(0)), path)
    store.store_vectors(v.join(F.broadcast(first), v["model"] == F.col("m")).drop("m"), path)
    store.store_vectors(v.join(F.broadcast(first), v["model"] != F.col("m")).drop("m"), path)
    return spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("dim").alias("dim"))


# Logs -------------------------------------------------------------------------------------------

EDITS = f"WITH {ACTIONS}, mx AS (SELECT max(ts) m FROM a), ls AS (SELECT session_id, max(ts) last_seen FROM a GROUP BY session_id), re AS (SELECT DISTINCT a.session_id, CAST(target AS VARCHAR) file_path FROM a JOIN ls USING (session_id), mx WHERE action = 'edit' AND target IS NOT NULL AND last_seen > m - 43200)"


def edits(spark, d) -> tuple[DataFrame, DataFrame]:
    """Purchases as edits of their targets by users, and the time of the last event."""
    a = actions(spark, d)
    seen = a.groupBy("session_id").agg(F.max("ts").alias("last_seen"))
    rows = a.filter("action = 'edit' AND target IS NOT NULL").select("session_id", F.col("target").cast("string").alias("file_path")).join(seen, "session_id")
    return rows, a.agg(F.max("ts").alias("now"))


@query(EDITS + " SELECT x.session_id, y.session_id AS other_id, array_to_string(list_sort(list(DISTINCT y.file_path)), ',') AS files FROM re x JOIN re y USING (file_path) WHERE x.session_id <= 20 AND x.session_id <> y.session_id GROUP BY ALL")
def session_conflicts(spark, d):
    """Who else edits what twenty sessions edit."""
    e, now = edits(spark, d)
    return logs.session_conflicts(e, e.filter("session_id <= 20"), now, 43_200.0)


@query(EDITS + " SELECT file_path, count(*) AS n_sessions, min(session_id) AS first_session FROM re GROUP BY file_path HAVING count(*) > 1")
def contested_files(spark, d):
    """Files that several recent sessions edit."""
    e, now = edits(spark, d)
    return logs.contested_files(e, now, 43_200.0)


@query(
    """WITH r AS (SELECT session_id, max_by(project, last_seen) project, min(started_at) started_at, max(last_seen) last_seen FROM active_sessions GROUP BY session_id), mx AS (SELECT max(last_seen) m FROM r), n AS (SELECT DISTINCT session_id FROM query_history)
    SELECT session_id, true AS fresh, round(coalesce(started_at, 1e9), 3) AS started_at FROM n LEFT JOIN r USING (session_id) UNION ALL SELECT session_id, false, round(started_at, 3) FROM r WHERE last_seen > 1e9 - 14400 AND session_id NOT IN (SELECT session_id FROM n)"""
)
def register_sessions(spark, d):
    """The registry after the sessions of the query log registered."""
    r = table(spark, d, "active_sessions").groupBy("session_id").agg(F.max_by("project", "last_seen").alias("project"), F.min("started_at").alias("started_at"), F.max("last_seen").alias("last_seen")).withColumn("edited_files", F.lit("a,b"))
    seen = table(spark, d, "query_history").select("session_id", F.lit("p").alias("project")).distinct()
    out = logs.register_sessions(r, seen, 1e9)
    return out.select("session_id", (F.col("edited_files") == "").alias("fresh"), F.round("started_at", 3).alias("started_at"))


@query(f"WITH {ACTIONS}, g AS (SELECT session_id, action, count(*) n FROM a GROUP BY ALL) SELECT session_id, CAST(sum(n) AS BIGINT) AS n_total, string_agg(action || '=' || n, ',' ORDER BY action) AS by_action FROM g GROUP BY session_id")
def session_summary(spark, d):
    """Each session's actions by kind."""
    return logs.session_summary(actions(spark, d))


@query("WITH x AS (SELECT DISTINCT feedback_id, session_id, original_query, logged_at FROM session_feedback) SELECT session_id, feedback_id, original_query FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY logged_at DESC, feedback_id DESC) rn FROM x) WHERE rn = 1")
def latest_feedback(spark, d):
    """Each session's last feedback."""
    f = table(spark, d, "session_feedback").select("feedback_id", "session_id", "original_query", "logged_at").distinct()
    return logs.latest_per_key(f, ["session_id"], ["logged_at", "feedback_id"]).select("session_id", "feedback_id", "original_query")


@query("WITH h AS (SELECT DISTINCT query_id, logged_at FROM query_history), m AS (SELECT max(logged_at) m FROM h) SELECT query_id FROM h, m WHERE logged_at > m - 30 * 86400")
def recent_queries(spark, d):
    """Queries of the last thirty days of the log."""
    h = table(spark, d, "query_history").select("query_id", "logged_at").distinct()
    return logs.since(h, "logged_at", 30, h.agg(F.max("logged_at").alias("now"))).select("query_id")


@query(
    f"""WITH {ACTIONS}, h AS (SELECT DISTINCT query_id, query_text, confidence, session_id, logged_at FROM query_history), m AS (SELECT max(logged_at) m FROM h), hh AS (SELECT h.* FROM h, m WHERE logged_at > m - 60 * 86400), aa AS (SELECT * FROM a WHERE ts > (SELECT m FROM m) - 60 * 86400)
    SELECT 'total' AS section, 'queries' AS name, CAST(count(*) AS DOUBLE) AS value FROM hh UNION ALL SELECT 'total', 'different_queries', count(DISTINCT query_text) FROM hh UNION ALL SELECT 'total', 'sessions', count(DISTINCT session_id) FROM hh
    UNION ALL SELECT 'action', action, count(*) FROM aa GROUP BY action UNION ALL SELECT 'confidence', coalesce(confidence, 'none'), count(*) FROM hh GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'query', query_text, count(*) n FROM hh GROUP BY query_text ORDER BY n DESC, query_text LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'file', CAST(target AS VARCHAR), count(*) FILTER (action = 'read') + 2 * count(*) FILTER (action = 'edit') sc FROM aa WHERE target IS NOT NULL GROUP BY target ORDER BY sc DESC, target LIMIT 30)
    UNION ALL SELECT 'session', 'mean actions', round(avg(n), 6) FROM (SELECT count(*) n FROM aa GROUP BY session_id) UNION ALL SELECT 'never used', 'files', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT target FROM aa WHERE target IS NOT NULL))"""
)
def usage_report(spark, d):
    """The usage report of sixty days."""
    h = table(spark, d, "query_history").select("query_id", "query_text", "confidence", "session_id", "logged_at").distinct()
    indexed = table(spark, d, "documents").select(F.col("doc_id").alias("target"))
    return logs.report(h, actions(spark, d), indexed, 60, h.agg(F.max("logged_at").alias("now")))


TUNER = """WITH r AS (SELECT l_orderkey q, min(l_linenumber) pos, l_partkey t FROM lineitem GROUP BY ALL), ac AS (SELECT DISTINCT l_orderkey q, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN -1 ELSE l_partkey END t FROM lineitem WHERE l_quantity > 40),
  ql AS (SELECT count(DISTINCT q) n_queries, round(avg(CASE WHEN pos IS NULL THEN 50 ELSE pos - 1 END), 6) avg_rank FROM ac LEFT JOIN r USING (q, t))"""


def tuner_input(spark, d) -> DataFrame:
    """Order lines as ranked results; of the large ones some returned parts were looked for in vain."""
    lines = table(spark, d, "lineitem")
    results = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("file_path"))
    target = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), -1).otherwise(F.col("l_partkey"))
    return logs.rank_quality(lines.filter("l_quantity > 40").select(F.col("l_orderkey").alias("query_id"), target.alias("target")), results)


@query(TUNER + " SELECT n_queries, avg_rank, CASE WHEN n_queries < 10 OR avg_rank IS NULL THEN 'low' WHEN avg_rank <= 5 THEN 'high' WHEN avg_rank <= 10 THEN 'medium' ELSE 'low' END AS confidence FROM ql")
def tuner_quality(spark, d):
    """How well rankings foretell what is used."""
    return tuner_input(spark, d)


@query(
    TUNER
    + " SELECT CASE WHEN n_queries < 10 THEN 'low' WHEN avg_rank <= 5 THEN 'high' WHEN avg_rank <= 10 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN n_queries >= 10 AND avg_rank > 10 THEN 4 ELSE 3 END AS name_boost, CASE WHEN n_queries >= 10 AND avg_rank > 10 THEN 3 ELSE 2 END AS signature_boost, CASE WHEN n_queries >= 10 THEN 1.5 ELSE 1.0 END AS recency_weight, 1.0 AS pagerank_weight FROM ql"
)
def tuned_weights(spark, d):
    """Weights by the tuning rules, with given rates of hits and misses; written and read back."""
    q = tuner_input(spark, d).withColumns({"name_miss": F.lit(0.4), "signature_hit": F.lit(0.6), "recency_hit": F.lit(0.7), "hub_hit": F.lit(0.1)})
    row = logs.tuned(q).first().asDict()
    path = f"{checkpoint_dir(spark)}/weights-{uuid.uuid4().hex}"
    logs.save_weights(path, row, spark, 1.0)
    stored = logs.load_weights(spark, path, {"pagerank_weight": 9.0})
    return spark.createDataFrame([tuple(stored[k] for k in row)], "confidence string, name_boost int, signature_boost int, recency_weight double, pagerank_weight double")


@query("SELECT count(*) AS n, round(avg((o_totalprice - p) * 100.0 / o_totalprice), 6) AS mean_reduction, round(median((o_totalprice - p) * 100.0 / o_totalprice), 6) AS median_reduction, CAST(floor(avg(p)) AS BIGINT) AS mean_packed FROM (SELECT o_totalprice, least(o_totalprice, 16000) p FROM orders)")
def reduction_stats(spark, d):
    """Mean and median reduction by a budget, order totals as sizes."""
    return logs.reduction(table(spark, d, "orders").select(F.col("o_totalprice").alias("naive"), F.least("o_totalprice", F.lit(16_000.0)).alias("packed")))


@query("SELECT session_id, array_to_string(list_slice(list_sort(list_distinct(['z.py', 'a.py', session_id || '.py'])), 1, 2), ',') AS files FROM (SELECT DISTINCT session_id FROM active_sessions)")
def merged_edits(spark, d):
    """Two lists of edited files united and cut."""
    s = table(spark, d, "active_sessions").select("session_id").distinct()
    united = logs.merged_edits(F.array(F.lit("z.py"), F.lit("a.py")), F.array(F.lit("a.py"), F.concat("session_id", F.lit(".py"))), 2)
    return s.select("session_id", F.array_join(united, ",").alias("files"))


# Concepts ---------------------------------------------------------------------------------------


def concept_table(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("concept_id"), F.col("n_name").alias("name"), F.lit("concept").alias("kind"), F.lit("s").alias("summary"), F.lit("b").alias("body"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"))


@query(
    """SELECT n_nationkey AS concept_id, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'risk' ELSE 'concept' END AS kind, CASE WHEN n_regionkey = 1 THEN 2.0 ELSE 1.0 END AS updated_at FROM nation
    UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY lower(r_name)), r_name, 'glossary', 2.0 FROM region WHERE lower(r_name) NOT IN (SELECT lower(n_name) FROM nation)"""
)
def upsert_concepts(spark, d):
    """Nations as concepts: some change by a name in other letters, regions are new."""
    changed = table(spark, d, "nation").filter("n_regionkey = 1").select(F.lower("n_name").alias("name"), F.lit("risk").alias("kind"), F.lit("x").alias("summary"), F.lit("y").alias("body"), F.lit(0.9).alias("confidence"))
    new = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("glossary").alias("kind"), F.lit("x").alias("summary"), F.lit("y").alias("body"), F.lit(0.9).alias("confidence"))
    bad = new.withColumn("kind", F.lit("unknown")).withColumn("name", F.concat("name", F.lit("?")))
    return concepts.upsert_concepts(concept_table(spark, d), changed.unionByName(new).unionByName(bad), 2.0).select("concept_id", "name", "kind", "updated_at")


@query(f"WITH {FILES}, l AS (SELECT file_id % 25 AS concept_id, file_id, 1.0 AS weight FROM f) SELECT concept_id, file_id, CASE WHEN file_id % 3 = 0 THEN 0.25 ELSE weight END AS weight FROM l")
def attach_concepts(spark, d):
    """Links of concepts to files: a third is attached again with another weight, some to what doesn't exist."""
    f = current_files(spark, d)
    links = f.select((F.col("file_id") % 25).alias("concept_id"), "file_id", F.lit(1.0).alias("weight"))
    changes = links.filter("file_id % 3 = 0").withColumn("weight", F.explode(F.array(F.lit(0.75), F.lit(0.25)))).withColumn("seq", F.when(F.col("weight") == 0.25, 2).otherwise(1))
    nowhere = changes.withColumn("file_id", -F.col("file_id") - 1).unionByName(changes.withColumn("concept_id", F.lit(999).cast("long")))
    return concepts.attach(links, changes.unionByName(nowhere), concept_table(spark, d), f, "file_id")


@query(f"WITH {FILES} SELECT file_id, path, round(CAST(1 + file_id % 7 AS DOUBLE) / 7, 6) AS weight FROM f WHERE file_id % 25 IN (1, 2) ORDER BY weight DESC, file_id LIMIT 50")
def concept_objects(spark, d):
    """The files of two concepts, the heaviest links first."""
    f = current_files(spark, d)
    links = f.select((F.col("file_id") % 25).alias("concept_id"), "file_id", F.round((1 + F.col("file_id") % 7) / 7, 6).alias("weight"))
    return concepts.linked_objects(links, spark.createDataFrame([(1,), (2,), (1,)], "concept_id long"), f.select("file_id", "path"), "file_id")


@query("SELECT n_nationkey AS concept_id FROM nation WHERE lower(n_name) IN ('algeria', 'brazil') OR n_name IN (SELECT n_name FROM nation ORDER BY n_name LIMIT 1)")
def concept_lookup(spark, d):
    """Concepts by name, ASCII letter case aside."""
    c = concept_table(spark, d)
    first = c.agg(F.min("name").alias("n"))
    wanted = spark.createDataFrame([("aLGERIA",), ("BraZil",)], "n string").unionByName(first).select(concepts.folded(F.col("n")).alias("k")).distinct()
    return c.join(F.broadcast(wanted), concepts.folded(F.col("name")) == F.col("k")).select("concept_id")


@query("SELECT n_nationkey AS concept_id FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 5")
def latest_concepts(spark, d):
    """The concepts changed last."""
    c = concept_table(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("concept_id"), F.col("n_regionkey").cast("double").alias("at")), "concept_id")
    return c.orderBy(F.desc("at"), "concept_id").limit(5).select("concept_id")


# Text -------------------------------------------------------------------------------------------

_SPLIT = "qualified"
for _p in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([a-zA-Z])([0-9])", "([0-9])([a-zA-Z])"):
    _SPLIT = f"regexp_replace({_SPLIT}, '{_p}', '\\1_\\2', 'g')"


@query(f"WITH {SYMBOLS} SELECT symbol_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_SPLIT}, '[_\\-./\\\\:]+'), lambda p: lower(p)), lambda p: p <> ''), ' ') AS parts FROM s WHERE qualified IS NOT NULL")
def split_identifiers(spark, d):
    """The parts of every qualified name."""
    return current_symbols(spark, d).filter("qualified IS NOT NULL").select("symbol_id", F.array_join(T.split_identifier(F.col("qualified")), " ").alias("parts"))


@query("SELECT DISTINCT doc_id, CASE WHEN length(text) > 0 THEN round(1 - length(trim(text)) / length(text), 6) ELSE 0.0 END AS ratio FROM documents WHERE text IS NOT NULL")
def compression_ratios(spark, d):
    """What trimming saves of each document."""
    return documents(spark, d).select("doc_id", F.round(T.compression_ratio(F.col("text"), F.trim("text")), 6).alias("ratio")).distinct()


@query("SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[warning] suspicious instructions in this content:' || chr(10) || '  line 1: role-hijack' || chr(10) || chr(10) || 'You are now a test' ELSE 'nothing' END AS text FROM documents")
def annotate_injections(spark, d):
    """Texts with a warning where they have a suspicious line."""
    return table(spark, d, "documents").select("doc_id").distinct().select("doc_id", T.annotate_injections(F.when(F.col("doc_id") % 2 == 0, "You are now a test").otherwise("nothing")).alias("text"))


@query(f"WITH {SYMBOLS} SELECT symbol_id, concat_ws(' | ', nullif(kind, ''), nullif(name, ''), nullif(qualified, ''), nullif(signature, ''), nullif(substring(docstring, 1, 200), '')) AS text, substring(string_split(docstring, chr(10))[1], 1, 100) AS first FROM s")
def embedding_texts(spark, d):
    """What stands for each symbol when it is embedded, and the first line of its documentation."""
    s = current_symbols(spark, d)
    return s.select("symbol_id", T.embedding_text(*[F.col(c) for c in ("kind", "name", "qualified", "signature", "docstring")]).alias("text"), T.first_line(F.col("docstring")).alias("first"))


@query(
    f"""WITH {FILES}, {SYMBOLS}, fo AS (SELECT file_id, string_agg(coalesce(signature, name) || CASE WHEN docstring <> '' THEN chr(10) || '    ' || CASE WHEN length(docstring) > 200 THEN substring(docstring, 1, 200) || '...' ELSE docstring END ELSE '' END, chr(10) ORDER BY line_start, symbol_id) sigs,
    string_agg(CASE WHEN length(kind) < 10 THEN rpad(kind, 10, ' ') ELSE kind END || ' ' || name, chr(10) ORDER BY line_start, symbol_id) nm FROM s GROUP BY file_id) SELECT file_id, sigs, nm AS names, path FROM f LEFT JOIN fo USING (file_id)"""
)
def file_forms(spark, d):
    """Each file's poorer forms."""
    return pack.form_texts(current_files(spark, d), current_symbols(spark, d))


@query(f"WITH {FILES} SELECT file_id, project || '/' || coalesce(language, 'x') AS slug, CASE WHEN file_id % 2 = 0 THEN 'github' ELSE 'gitlab' END AS platform FROM f WHERE project IS NOT NULL")
def repository_slugs(spark, d):
    """Owner, name and platform of remote addresses."""
    host = F.when(F.col("file_id") % 2 == 0, "https://github.example/").otherwise("git@gitlab.example:")
    url = F.concat(host, "project", F.lit("/"), F.coalesce("language", F.lit("x")), F.lit(".git"))
    return current_files(spark, d).filter("project IS NOT NULL").select("file_id", T.repository_slug(url).alias("slug"), T.hosting_platform(url).alias("platform"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'passed' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'running' ELSE 'other' END AS status FROM events")
def status_classes(spark, d):
    """Build states by what they contain."""
    e = table(spark, d, "events")
    word = F.when(F.col("event_type") == "view", "Build SUCCESS").when(F.col("event_type") == "click", "has failed").when(F.col("event_type") == "purchase", "Pending").otherwise("none")
    return e.select("event_id", T.status_class(word).alias("status"))


# Edits ------------------------------------------------------------------------------------------

LINES = f"WITH {FILES}, t AS (SELECT file_id, max(source_text) x FROM file_sources GROUP BY file_id), l AS (SELECT file_id, path, lower(trim(language)) lang, x, string_split(x, chr(10)) l FROM t JOIN f USING (file_id))"


def texts(spark, d) -> DataFrame:
    """(file_id, path, language, source_text)"""
    t = table(spark, d, "file_sources").groupBy("file_id").agg(F.max("source_text").alias("source_text"))
    return t.join(current_files(spark, d).select("file_id", "path", "language"), "file_id")


@query(
    LINES
    + """, e AS (SELECT *, len(l) - CASE WHEN ends_with(x, chr(10)) THEN 1 ELSE 0 END n FROM l) SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'invalid line range' WHEN file_id % 5 = 1 THEN 'invalid identifier: 1x' WHEN n < 3 THEN 'the text has only ' || n || ' lines' END AS error,
    CASE WHEN file_id % 5 < 2 OR n < 3 THEN NULL ELSE md5(regexp_replace(l[1] || chr(10) || regexp_extract(l[2], '^([ \\t]*)', 1) || 'taken()  # TODO: pass arguments' || CASE WHEN len(l) > 3 THEN chr(10) || array_to_string(l[4:], chr(10)) ELSE '' END, '\\n*$', '') || repeat(chr(10), 3) || 'def taken():' || chr(10)
      || CASE WHEN l[2] = '' THEN '' ELSE '    ' || l[2] END || chr(10) || CASE WHEN l[3] = '' THEN '' ELSE '    ' || l[3] END || chr(10)) END AS digest FROM e WHERE x NOT LIKE '%' || chr(13) || '%'"""
)
def extract_functions(spark, d):
    """Lines 2 and 3 of each file moved into a function; some requests are refused."""
    t = texts(spark, d).filter(~F.col("source_text").contains("\r"))
    bad = F.col("file_id") % 5
    requests = t.select("file_id", F.lit(2).alias("line_start"), F.when(bad == 0, 1).otherwise(3).alias("line_end"), F.when(bad == 1, "1x").otherwise("taken").alias("name"))
    out = edit.extractions(t, requests)
    return out.select("file_id", "error", F.md5(F.encode("source_text", "UTF-8")).alias("digest"))


_HELPERS = [
    (1, "a.py", "python", "def one():\n    return 1 + 2\n\ndef two(x):\n    y = x\n    return y\n\nz = one() + two(3)\n"), (2, "b.rs", "rust", "fn three() -> u8 {\n    3\n}\n"), (3, "c.py", "python", "def four():\n    \"\"\"Gives four.\"\"\"\n    return 4\nw = four()\n"), (4, "d.py", "python", "def one():\n    return 5\n"),
]


@query(
    values(
        "name, ok, error, source_text, diff_lines",
        [("one", False, "ambiguous: 2 symbols", None, None), ("two", False, "not a single return", None, None), ("three", False, "only Python is supported", None, None), ("none", False, "not found", None, None), ("four", True, None, "w = four()  # TODO: inlined four -> 4\n", 8)],
    )
)
def inline_helpers(spark, d):
    """Helpers inlined where that is safe, and why not elsewhere."""
    f = spark.createDataFrame(_HELPERS, "file_id long, path string, language string, source_text string")
    s = spark.createDataFrame([(1, 1, "one", 1, 2), (2, 1, "two", 4, 6), (3, 2, "three", 1, 3), (4, 3, "four", 1, 3), (5, 4, "one", 1, 2)], "symbol_id long, file_id long, name string, line_start int, line_end int")
    names = spark.createDataFrame([("one",), ("two",), ("three",), ("four",), ("none",), ("four",)], "name string")
    out = edit.inlinings(s, f.drop("source_text"), f.select("file_id", "source_text"), names)
    return out.select("name", "ok", "error", "source_text", (F.size(F.split("diff", "\n")) - 1).alias("diff_lines")).withColumn("diff_lines", F.when(F.col("ok"), F.col("diff_lines")))


@query(LINES + " SELECT file_id, i AS line, CAST(count(*) AS BIGINT) AS n FROM (SELECT file_id, unnest(l) z, generate_subscripts(l, 1) i FROM l) , LATERAL (SELECT unnest(regexp_extract_all(z, '\\bhandle\\b'))) GROUP BY ALL")
def name_references(spark, d):
    """Places of a name per line of the texts."""
    found = edit.references(texts(spark, d), "handle")
    return found.groupBy("file_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES}, {SYMBOLS}, one AS (SELECT min(name) n FROM (SELECT name FROM s GROUP BY name HAVING count(*) = 1)) SELECT symbol_id, path, line_start AS line FROM s JOIN f USING (file_id) WHERE name = (SELECT n FROM one) OR qualified = (SELECT n FROM one)")
def name_definitions(spark, d):
    """Where a name is defined."""
    s = current_symbols(spark, d)
    name = s.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").agg(F.min("name")).first()[0]
    return edit.definitions(s, current_files(spark, d), name)


@query(
    f"""WITH {SYMBOLS}, one AS (SELECT min(name) n FROM (SELECT name FROM s GROUP BY name HAVING count(*) = 1) WHERE regexp_matches(name, '^[A-Za-z]\\w+$')), t AS (SELECT file_id, max(source_text) x FROM file_sources GROUP BY file_id)
    SELECT file_id, regexp_replace(x, '\\b' || n || '\\b', 'renamed_by_name', 'g') AS source_text FROM t, one WHERE regexp_matches(x, '\\b' || n || '\\b')"""
)
def rename_by_name(spark, d):
    """Texts after a symbol that only one place defines is renamed."""
    s = current_symbols(spark, d)
    name = s.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 1).filter(F.col("name").rlike(r"^[A-Za-z]\w+$")).agg(F.min("name")).first()[0]
    return edit.rename_by_name(s, texts(spark, d).select("file_id", "source_text"), name, "renamed_by_name")


@query(LINES + " SELECT file_id, l[1] || chr(10) || regexp_extract(l[1], '^([ \\t]*)', 1) || '    \"\"\"Says it.\"\"\"' || CASE WHEN len(l) > 1 THEN chr(10) || array_to_string(l[2:], chr(10)) ELSE '' END AS source_text FROM l")
def insert_docstrings(spark, d):
    """A documentation string below the first line of each text."""
    return texts(spark, d).select("file_id", edit.insert_docstring(F.col("source_text"), 1, "Says it.").alias("source_text"))


@query(LINES + " SELECT file_id, regexp_extract(substring(l[1], 1, 6), '(\\w*)$', 1) || regexp_extract(substring(l[1], 7), '^(\\w*)', 1) AS word FROM l")
def identifier_at(spark, d):
    """The identifier around column 6 of each text's first line."""
    return texts(spark, d).select("file_id", edit.identifier_at(F.col("source_text"), 1, 6).alias("word"))


# Sources ----------------------------------------------------------------------------------------

MANIFESTS = [
    ("a", "requirements.txt", "requests==2.0\n# note\nnumpy>=1\n"), ("a", "pyproject.toml", '[project]\ndependencies = ["numpy", "pandas>=2"]\n'), ("b", "package.json", '{"dependencies": {"left": "1"}, "devDependencies": {"jest": "2"}}'), ("b", "Cargo.toml", '[dependencies]\nserde = "1"\n\n[dev]\nx = "1"\n'),
]


@query(values("project, name, ecosystem", [("a", "requests", "PyPI"), ("a", "numpy", "PyPI"), ("a", "pandas", "PyPI"), ("b", "left", "npm"), ("b", "jest", "npm"), ("b", "serde", "crates.io")]))
def manifest_dependencies(spark, d):
    """Dependencies of two projects' manifests."""
    m = spark.createDataFrame(MANIFESTS, "project string, path string, text string")
    return exchange.manifest_dependencies(m).select("project", "name", "ecosystem")


@query(values("path, symbol, is_definition, line", [("a.py", "f", True, 3), ("a.py", "f", False, 10), ("b.py", "f", False, 1)]))
def index_occurrences(spark, d):
    """Occurrences of an index document that is written first."""
    occurrence = lambda line, roles: {"symbol": "f", "symbol_roles": roles, "range": [line, 0, 3]}
    doc = {"documents": [{"relative_path": "a.py", "occurrences": [occurrence(2, 1), occurrence(9, 0)]}, {"relative_path": "b.py", "occurrences": [occurrence(0, 8)]}]}
    path = f"{checkpoint_dir(spark)}/occurrences-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    return exchange.occurrences(spark, path)


FIXTURE = [
    (1, "m.py", 'import os, sys as s\nfrom a.b import c as d, e\n\n@dec\nclass A:\n    """Doc."""\n    def f(self):\n        def nested(): pass\n\ndef _g(x):\n    return 1\n'),
    (2, "m.rs", "use std::fs;\nmod a;\n/// Adds.\npub fn add(a: i32) -> i32 {\n    a\n}\nstruct P { x: i32 }\nimpl P {\n    fn new() -> P { P { x: 1 } }\n}\n"),
    (3, "m.ts", "import { a, b } from './x';\n/** Doc */\nexport class K {\n  private size: number = 1;\n  run(x: number): void {\n    if (x) { go(); }\n  }\n}\nexport const f = (x) => x;\ninterface I { a: string }\n"),
    (4, "m.go", 'package x\nimport (\n\t"fmt"\n)\n// Does.\nfunc Do(a int) int {\n\treturn a\n}\ntype T struct {\n\ta int\n}\nfunc (t *T) run() {\n}\n'),
    (5, "m.java", "import a.b.C;\npublic class K {\n    private int x;\n    public K(int x) {\n        this.x = x;\n    }\n    protected String run(int a) {\n        return null;\n    }\n}\n"),
    (6, "m.c", "#include <stdio.h>\ntypedef unsigned long size;\nstruct P {\n    int x;\n};\nint h(int a);\nstatic int f(int a) {\n    return a;\n}\n"),
    (7, "m.rb", "require 'set'\nclass A\n  def f(x)\n    x\n  end\nend\n"), (8, "m.php", "<?php\nnamespace A\\B;\nuse A\\C;\nclass K {\n  private function f() { return 1; }\n}\nfunction g() {}\n"),
    (9, "m.kt", "import a.b\nclass K {\n  fun f(x: Int): Int { return x }\n}\nfun g() {}\n"), (10, "m.swift", "import Foo\nstruct K {\n  func f() {}\n}\nprotocol P {}\n"), (11, "m.zig", 'const std = @import("std");\npub fn f() void {}\nconst P = struct {\n  x: i32,\n};\n'),
    (12, "m.sol", "contract C {\n  event E(uint a);\n  function f() public {}\n}\n"), (13, "m.js", "function g() {}\nclass Q {\n  go() {\n  }\n}\n"), (14, "m.py", "def broken(:\n    pass\ndef fine():\n    pass\n"), (15, "m.xyz", "nothing"), (16, "m.py", None), (17, "m.py", ""),
]
FOUND = [
    (1, "m.A", "class", 5, 8, "public"), (1, "m.A.f", "method", 7, 8, "public"), (1, "m._g", "function", 10, 11, "private"), (2, "m::a", "module", 2, 2, "private"), (2, "m::add", "function", 4, 6, "public"), (2, "m::P", "class", 7, 7, "private"), (2, "m::P::new", "method", 9, 9, "private"),
    (3, "m.K", "class", 3, 8, "public"), (3, "m.K.size", "function", 4, 4, "private"), (3, "m.K.run", "method", 5, 7, "public"), (3, "m.f", "function", 9, 9, "public"), (3, "m.I", "class", 10, 10, "public"), (4, "m.Do", "function", 6, 8, "public"), (4, "m.T", "class", 9, 11, "public"), (4, "m.T.run", "method", 12, 13, "private"),
    (5, "m.K", "class", 2, 10, "public"), (5, "m.K.x", "function", 3, 3, "private"), (5, "m.K.K", "method", 4, 6, "public"), (5, "m.K.run", "method", 7, 9, "protected"), (6, "m.size", "class", 2, 2, "public"), (6, "m.P", "class", 3, 5, "public"), (6, "m.h", "function", 6, 6, "public"), (6, "m.f", "function", 7, 9, "private"),
    (7, "m::A", "class", 2, 6, "public"), (7, "m::A::f", "method", 3, 5, "public"), (8, "m\\A\\B", "module", 2, 2, "public"), (8, "m\\K", "class", 4, 6, "public"), (8, "m\\K\\f", "method", 5, 5, "private"), (8, "m\\g", "function", 7, 7, "public"), (9, "m.K", "class", 2, 4, "public"), (9, "m.K.f", "method", 3, 3, "public"), (9, "m.g", "function", 5, 5, "public"),
    (10, "m.K", "class", 2, 4, "public"), (10, "m.K.f", "method", 3, 3, "public"), (10, "m.P", "class", 5, 5, "public"), (11, "m.f", "function", 2, 2, "public"), (11, "m.P", "class", 3, 5, "private"), (12, "m.C", "class", 1, 4, "public"), (12, "m.C.E", "method", 2, 2, "public"), (12, "m.C.f", "method", 3, 3, "public"),
    (13, "m.g", "function", 1, 1, "public"), (13, "m.Q", "class", 2, 5, "public"), (13, "m.Q.go", "method", 3, 4, "public"), (14, "m.broken", "function", 1, 2, "public"), (14, "m.fine", "function", 3, 4, "public"),
]
IMPORTED = [(1, "os", "", 1, False), (1, "sys", "", 1, False), (1, "a.b", "c,e", 2, True), (2, "std::fs", "", 1, False), (3, "./x", "a,b", 1, True), (4, "fmt", "", 3, False), (5, "a.b.C", "", 1, False), (6, "stdio.h", "", 1, False), (7, "set", "", 1, False), (8, "A\\C", "", 3, False), (9, "a.b", "", 1, False), (10, "Foo", "", 1, False), (11, "std", "", 1, False)]


def fixture(spark) -> DataFrame:
    f = spark.createDataFrame(FIXTURE, "file_id long, path string, source_text string")
    return outline.parse(f.withColumn("language", files.language_of(F.col("path"))))


@query(values("file_id, qualified, kind, line_start, line_end, visibility", FOUND))
def outline_symbols(spark, d):
    """Symbols of given sources in thirteen languages."""
    return outline.symbols_of(fixture(spark)).select("file_id", "qualified", "kind", "line_start", "line_end", "visibility")


@query(values("file_id, module, names, line, is_from", IMPORTED))
def outline_imports(spark, d):
    """Imports of the same sources."""
    return outline.imports_of(fixture(spark)).select("file_id", "module", F.array_join("names", ",").alias("names"), "line", "is_from")


@query(values("file_id, error", [(15, "unsupported language: None"), (16, "no text")]))
def outline_errors(spark, d):
    """What an outline can't read comes back as an error of its row."""
    return fixture(spark).select("file_id", F.explode("errors").alias("error"))


ANSWERS = [
    ("x", '{"vulns": [{"id": "V1", "score": 9.8, "summary": "bad"}, {"id": "V2", "score": 5.0}]}'), ("y", '{"vulns": [{"id": "V1", "score": 9.8}, {"id": "V3"}]}'), ("z", "no json"), ("w", '{"vulns": []}'),
]


@query(values("severity, n, worst", [("CRITICAL", 1, "V1"), ("MEDIUM", 1, "V2"), ("LOW", 1, "V3")]))
def security_report(spark, d):
    """Findings of several recorded answers per severity."""
    return remote.security_report(remote.shaped(spark.createDataFrame(ANSWERS, "service string, body string"), "vulnerabilities"))


NEWS = [
    ("b", '{"articles": [{"title": "T1", "url": "u1", "publishedAt": "2026-01-02T10:00:00Z", "source": {"name": "S"}}, {"title": "T2", "url": "u2", "publishedAt": "2026-01-05T00:00:00Z"}]}'),
    ("a", '{"articles": [{"title": "T1 again", "url": "u1", "publishedAt": "2026-01-03T10:00:00Z"}, {"title": "no address"}]}'),
]


@query(values("title, url, day, source, n_services", [("T1 again", "u1", "2026-01-03", "", 2), ("T2", "u2", "2026-01-05", "", 1)]))
def merged_news(spark, d):
    """Articles of two recorded answers, each address once."""
    return remote.merged_news(remote.shaped(spark.createDataFrame(NEWS, "service string, body string"), "news"))


BUILDS = [("ci", '{"builds": [{"id": "1", "status": "success"}, {"id": "2", "status": "FAILED"}, {"id": "3", "status": "running"}, {"id": "4", "status": "fixed"}]}'), ("other", '{"builds": [{"id": "1", "status": null}]}')]


@query(values("service, n, passed, failed, success", [("ci", 4, 2, 1, 0.6667), ("other", 1, 0, 0, None)]))
def build_report(spark, d):
    """Builds of recorded answers per service."""
    return remote.build_report(remote.shaped(spark.createDataFrame(BUILDS, "service string, body string"), "builds"))


SHAPED = [
    ("issues", '{"items": [{"number": 7, "title": "t", "user": {"login": "u"}, "labels": [{"name": "a"}, {"name": "b"}], "created_at": "2026-01-02T00:00:00Z"}]}'), ("packages", '{"packages": [{"name": "p", "version": "1.0"}]}'), ("language", '{"results": [{"label": "positive", "score": 0.98765}]}'),
]


@query(values("kind, text", [("issues", "7|t|unknown|u|a,b|2026-01-02"), ("packages", "p|1.0|unknown|"), ("language", "positive||0.9877")]))
def shaped_answers(spark, d):
    """Recorded answers of issue, package and language services as rows."""
    out = None
    for kind, body in SHAPED:
        rows = remote.shaped(spark.createDataFrame([("s", body)], "service string, body string"), kind)
        one = rows.select(F.lit(kind).alias("kind"), F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns if c not in ("service", "pos")]).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'regions' AS name, '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS body FROM region UNION ALL SELECT 'size', '[{\"n\":' || count(*) || '}]' FROM nation")
def dashboard(spark, d):
    """Small tables as JSON documents."""
    return remote.dashboard({"regions": table(spark, d, "region").select("r_regionkey", "r_name"), "size": table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n"))})
