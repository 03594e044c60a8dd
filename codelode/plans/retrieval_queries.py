"""Retrieval over the source files: four rankings fused, packed and formatted; exploration from the best hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, pack, rank
from ..session import checkpoint_dir, cut_lineage, table, written
from .catalogue import ACTIONS, CALLS, FILE_POSTINGS, PAGERANK_ROUNDS, TERMS, VECTOR, _IMPORTANT, _V, actions, bm25_sql, current_files, current_symbols, pagerank_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def symbol_calls(symbols: DataFrame) -> DataFrame:
    """(source_id, target_id, kind): from each symbol to the first symbol of each name that it calls."""
    names = F.explode(F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("name")
    first = symbols.groupBy("name").agg(F.min("symbol_id").alias("target_id"))
    used = symbols.select(F.col("symbol_id").alias("source_id"), names).join(first, "name")
    return used.filter("source_id <> target_id").select("source_id", "target_id", F.lit("calls").alias("kind")).distinct()


def symbol_edges(symbols: DataFrame) -> DataFrame:
    """Calls and containment."""
    return symbol_calls(symbols).unionByName(graph.contains_edges(symbols))


def inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Files and symbols, one row each; the symbols are written once, as several rankings read them."""
    return current_files(spark, d), written(current_symbols(spark, d))


SYMBOL_EDGES = """first AS (SELECT name, min(symbol_id) t FROM s GROUP BY name),
  ce AS (SELECT DISTINCT s.symbol_id source_id, first.t target_id, 'calls' AS kind FROM s, LATERAL (SELECT unnest(list_distinct(regexp_extract_all(s.body_text, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1))) AS leaf) u JOIN first ON first.name = u.leaf WHERE s.symbol_id <> first.t
    UNION ALL SELECT p.source_id, s.symbol_id, 'contains' FROM s JOIN (SELECT file_id, qualified, min(symbol_id) source_id FROM s GROUP BY ALL) p ON s.file_id = p.file_id AND regexp_replace(s.qualified, '(::|\\.)[^.:]*$', '') = p.qualified
      WHERE lower(trim(s.kind)) = 'method' AND p.source_id <> s.symbol_id)"""
RETRIEVE = f"""WITH RECURSIVE {bm25_sql(FILE_POSTINGS, 'file_id')}, {SYMBOL_EDGES},
  {pagerank_sql('SELECT symbol_id id, 1.0 / n v FROM s, n', 'e AS (SELECT source_id src, target_id dst FROM ce)', 's')},
  prf AS (SELECT file_id, round(sum(pr), 9) score FROM r{PAGERANK_ROUNDS} JOIN s ON symbol_id = id GROUP BY file_id), {ACTIONS}, mx AS (SELECT max(ts) m FROM a),
  x AS (SELECT target, count(*) n, max(ts) last, max(CASE WHEN action = 'edit' THEN 1 ELSE 0 END) ed FROM a WHERE target IS NOT NULL GROUP BY target),
  rc AS (SELECT target file_id, round(n * (1 + ed) / (1 + (m - last) / 3600), 6) score FROM (SELECT * FROM x ORDER BY last DESC, target LIMIT 50), mx WHERE target IN (SELECT file_id FROM f)),
  v AS (SELECT DISTINCT symbol_id, file_id, CAST(vector AS DOUBLE[]) x FROM symbol_embeddings WHERE len(vector) = 64 AND dim = 64
      AND len(list_filter(vector, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(vector, lambda y: y <> 0)) > 0 AND model = 'quill-mini'),
  c2 AS (SELECT symbol_id, file_id, round(list_dot_product(list_transform(x, lambda y: y / (sqrt(list_dot_product(x, x)) + 1e-12)), list_transform({_V}, lambda y: y / (sqrt(list_dot_product({_V}, {_V})) + 1e-12))), 6) score FROM v),
  em AS (SELECT file_id, max(score) score FROM c2 GROUP BY file_id ORDER BY score DESC, file_id LIMIT 20),
  lists AS (SELECT * FROM (SELECT file_id, 'bm25' sig, score, row_number() OVER (ORDER BY score DESC, file_id) - 1 AS rk FROM b) WHERE rk < 50
    UNION ALL SELECT file_id, 'pagerank', score, row_number() OVER (ORDER BY score DESC, file_id) - 1 FROM prf UNION ALL SELECT file_id, 'recency', score, row_number() OVER (ORDER BY score DESC, file_id) - 1 FROM rc
    UNION ALL SELECT file_id, 'embed', score, row_number() OVER (ORDER BY score DESC, file_id) - 1 FROM em),
  fu AS (SELECT file_id, round(sum(CASE sig WHEN 'embed' THEN 0.7 ELSE 1.0 END / (60 + rk)), 9) rrf_score, {', '.join(f"max(CASE WHEN sig = '{n}' THEN {c} END) {n}_{o}" for n in ('bm25', 'pagerank', 'recency', 'embed') for c, o in (('rk', 'rank'), ('score', 'score')))}
    FROM lists GROUP BY file_id),
  top AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, file_id) - 1 AS rank FROM fu ORDER BY rrf_score DESC, file_id LIMIT 15)"""
LABEL = """(SELECT CASE WHEN a / 0.05 > 0.5 AND a - b > 0.003 THEN 'high' WHEN a / 0.05 > 0.3 THEN 'medium' ELSE 'low' END FROM (SELECT max(CASE WHEN rank = 0 THEN rrf_score END) a, max(CASE WHEN rank = 1 THEN rrf_score END) b FROM top))"""


def fused(spark, d, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The 15 best files by terms, links, use and vectors."""
    by_terms = rank.bm25_query(rank.file_frequencies(files, symbols, TERMS), TERMS, "file_id", 50)
    pr = rank.pagerank(symbols.select(F.col("symbol_id").alias("id")), symbol_edges(symbols).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), PAGERANK_ROUNDS)
    per_file = pr.join(symbols.select(F.col("symbol_id").alias("id"), "file_id"), "id").groupBy("file_id").agg(F.round(F.sum("pr"), 9).alias("score"))
    used = actions(spark, d).filter("target IS NOT NULL")
    recent = rank.recent_files(used, files.select("file_id", F.col("file_id").alias("path")), used.agg(F.max("ts").alias("now")))
    near = rank.knn_files(table(spark, d, "symbol_embeddings").filter("model = 'quill-mini' AND dim = 64"), VECTOR, 20)
    signals = {"bm25": by_terms, "pagerank": rank.ranked(per_file, "file_id"), "recency": recent, "embed": rank.ranked(near, "file_id", 20)}
    return rank.fuse(signals, "file_id", {"embed": 0.7}, 15)


@query(RETRIEVE + " SELECT file_id, rrf_score, bm25_rank, bm25_score, pagerank_rank, pagerank_score, recency_rank, recency_score, embed_rank, embed_score, rank FROM top")
def rrf_fusion(spark, d):
    """Four rankings of the files fused, with each one's rank and score; the list by links isn't cut."""
    return fused(spark, d, *inputs(spark, d))


@query(RETRIEVE + f" SELECT {LABEL} AS label")
def confidence(spark, d):
    """How far the fused ranking can be trusted."""
    return rank.confidence(fused(spark, d, *inputs(spark, d)))


BUDGET = 16_000
FORMS = """, tx AS (SELECT file_id, max(source_text) y FROM file_sources GROUP BY file_id), tl AS (SELECT file_id, y, string_split(y, chr(10)) l FROM tx WHERE file_id IN (SELECT file_id FROM top)),
  full_ AS (SELECT file_id, CASE WHEN len(list_filter(l, lambda z: length(z) > 160)) > 0 THEN array_to_string(list_transform(l, lambda z: CASE WHEN length(z) > 160 THEN substring(z, 1, 160) || '... [+' || (length(z) - 160) || ' chars]' ELSE z END), chr(10))
      || chr(10) || '[' || len(list_filter(l, lambda z: length(z) > 160)) || ' long lines truncated]' ELSE y END t FROM tl),
  fo AS (SELECT file_id, string_agg(coalesce(signature, name) || CASE WHEN docstring <> '' THEN chr(10) || '    ' || CASE WHEN length(docstring) > 200 THEN substring(docstring, 1, 200) || '...' ELSE docstring END ELSE '' END, chr(10) ORDER BY line_start, symbol_id) sigs,
      string_agg(CASE WHEN length(kind) < 10 THEN rpad(kind, 10, ' ') ELSE kind END || ' ' || name, chr(10) ORDER BY line_start, symbol_id) nm FROM s GROUP BY file_id),"""
PACKED = f"""{RETRIEVE} {FORMS} cand AS (SELECT row_number() OVER (ORDER BY CASE WHEN lower(regexp_extract(path, '([^/]*)$', 1)) IN ({_IMPORTANT}) THEN 0 ELSE 1 END, top.rank) rk, file_id, path, t, sigs, nm FROM top JOIN f USING (file_id) LEFT JOIN full_ USING (file_id) LEFT JOIN fo USING (file_id)),
  fold(rk, remaining, file_id, granularity, content) AS (SELECT CAST(0 AS BIGINT), CAST({BUDGET} AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  UNION ALL SELECT c.rk, remaining - coalesce(length(CASE WHEN length(t) <= remaining THEN t WHEN length(sigs) <= remaining THEN sigs WHEN length(nm) <= remaining THEN nm WHEN length(path) <= remaining THEN path END), 0), c.file_id,
    CASE WHEN length(t) <= remaining THEN 'full' WHEN length(sigs) <= remaining THEN 'sigs' WHEN length(nm) <= remaining THEN 'names' WHEN length(path) <= remaining THEN 'path' END,
    CASE WHEN length(t) <= remaining THEN t WHEN length(sigs) <= remaining THEN sigs WHEN length(nm) <= remaining THEN nm WHEN length(path) <= remaining THEN path END FROM fold JOIN cand c ON c.rk = fold.rk + 1),
  pk AS (SELECT file_id, granularity, content, row_number() OVER (ORDER BY rk) - 1 AS pos, count(*) OVER () n FROM fold WHERE granularity IS NOT NULL),
  pl AS (SELECT *, CASE WHEN n <= 2 THEN pos WHEN pos % 2 = 0 THEN pos // 2 ELSE n - 1 - pos // 2 END place FROM pk)"""


def packed(spark, d) -> tuple[DataFrame, DataFrame]:
    """(the fused ranking, the packed forms with their texts): at most 15 files."""
    files, symbols = inputs(spark, d)
    top = cut_lineage(fused(spark, d, files, symbols))
    chosen = top.select("file_id", "rank").join(files.select("file_id", "path"), "file_id")
    texts = table(spark, d, "file_sources").join(F.broadcast(top.select("file_id")), "file_id").groupBy("file_id").agg(F.max("source_text").alias("t"))
    forms = pack.form_texts(chosen, symbols.join(F.broadcast(top.select("file_id")), "file_id"))
    with_texts = cut_lineage(
        chosen.join(forms.drop("path"), "file_id", "left").join(texts.select("file_id", T.truncate_long_lines(F.col("t")).alias("full")), "file_id", "left").select("file_id", "rank", pack.is_important(F.col("path")).alias("important"), "full", "sigs", "names", "path")
    )
    # Important files come first, each group in its order.
    sizes = with_texts.select("file_id", (F.when(F.col("important"), 0).otherwise(1_000) + F.col("rank")).alias("rank"), *[F.length(c).cast("long").alias(c) for c in pack.LEVELS])
    placed = pack.lost_in_the_middle(pack.pack(sizes, BUDGET))
    content = F.when(F.col("granularity") == "full", F.col("full")).when(F.col("granularity") == "sigs", F.col("sigs")).when(F.col("granularity") == "names", F.col("names")).otherwise(F.col("path"))
    return top, placed.join(with_texts.drop("rank"), "file_id").select("file_id", F.col("path").alias("file_path"), "granularity", "char_count", "place", content.alias("content"))


@query(PACKED + f" SELECT file_id, rank, rrf_score, granularity, length(content) AS char_count, place, md5(content) AS digest, {LABEL} AS label FROM pl JOIN top USING (file_id)")
def retrieve(spark, d):
    """Retrieval from end to end: the files that fit into the budget, each in its form and place, with the ranking's confidence."""
    top, parts = packed(spark, d)
    label = rank.confidence(top)
    return parts.join(top.select("file_id", "rank", "rrf_score"), "file_id").crossJoin(F.broadcast(label)).select("file_id", "rank", "rrf_score", "granularity", "char_count", "place", F.md5(F.encode("content", "UTF-8")).alias("digest"), "label")


@query(PACKED + " SELECT md5('# Context' || chr(10) || chr(10) || string_agg('## ' || path || ' [' || granularity || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY place)) AS digest FROM pl JOIN f USING (file_id)")
def format_context(spark, d):
    """The packed files as one text."""
    return pack.format_context(packed(spark, d)[1], "Context").select(F.md5(F.encode("context", "UTF-8")).alias("digest"))


@query(f"WITH {bm25_sql(FILE_POSTINGS, 'file_id')} SELECT file_id, score, row_number() OVER (ORDER BY score DESC, file_id) - 1 AS rank FROM b ORDER BY score DESC, file_id LIMIT 50")
def bm25_stored(spark, d):
    """``bm25f_boosted`` over a stored index, which is built on the first call for these files."""
    path = rank.current_index(current_files(spark, d), current_symbols(spark, d), f"{checkpoint_dir(spark)}/bm25")
    return rank.bm25_stored(spark, path, TERMS, "file_id", 50)


FILE_LINKS = "fl AS (SELECT DISTINCT x.file_id src, y.file_id dst, ce.kind FROM ce JOIN s x ON x.symbol_id = source_id JOIN s y ON y.symbol_id = target_id WHERE x.file_id <> y.file_id)"
_STEP = """SELECT * FROM (SELECT f.file_id, f.path, {hop} AS hop, w.via, 'edge:' || w.kind AS reason FROM (SELECT b, via, kind, row_number() OVER (PARTITION BY b ORDER BY via, kind) rn FROM
  (SELECT u.b, p.path via, u.kind FROM bo u JOIN {last} p ON u.a = p.file_id WHERE u.b NOT IN (SELECT file_id FROM {found}))) w JOIN f ON f.file_id = w.b WHERE rn = 1 ORDER BY f.path, f.file_id LIMIT (SELECT 30 - count(*) FROM {found}))"""


@query(
    f"""WITH {bm25_sql(FILE_POSTINGS, 'file_id')}, {SYMBOL_EDGES}, {FILE_LINKS}, bo AS (SELECT src a, dst b, kind FROM fl UNION ALL SELECT dst, src, kind FROM fl),
    h0 AS (SELECT b.file_id, f.path, 0 AS hop, CAST(NULL AS VARCHAR) via, 'bm25_seed' AS reason FROM (SELECT * FROM b ORDER BY score DESC, file_id LIMIT 5) b JOIN f USING (file_id)),
    h1 AS ({_STEP.format(hop=1, last='h0', found='h0')}), g1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1), h2 AS ({_STEP.format(hop=2, last='h1', found='g1')}), g2 AS (SELECT * FROM g1 UNION ALL SELECT * FROM h2)
    SELECT file_id, path, hop, via, reason, coalesce(score, 0) AS score, row_number() OVER (ORDER BY hop, coalesce(score, 0) DESC, path, file_id) - 1 AS rank FROM g2 LEFT JOIN b USING (file_id)"""
)
def explore_query(spark, d):
    """The five best files for a query and what lies within two steps of them, 30 at most."""
    files, symbols = inputs(spark, d)
    f = rank.file_frequencies(files, symbols, TERMS)
    scores = cut_lineage(rank.bm25_query(f, TERMS, "file_id").select("file_id", "score"))
    links = graph.typed_file_edges(symbol_edges(symbols), symbols.select("symbol_id", "file_id"))
    return graph.explore_query(scores, links, files, 5, 2, 30)


LINKED = f"WITH {CALLS}, {SYMBOL_EDGES}, {FILE_LINKS}"


def file_links(symbols: DataFrame) -> DataFrame:
    return graph.file_edges(symbol_edges(symbols), symbols.select("symbol_id", "file_id"))


@query(
    LINKED
    + """, un AS (SELECT file_id, count(DISTINCT leaf) n FROM c WHERE leaf NOT IN (SELECT name FROM s WHERE lower(trim(kind)) IN ('class', 'function', 'module') AND name IS NOT NULL) AND leaf NOT IN (SELECT qualified FROM s WHERE qualified IS NOT NULL) GROUP BY file_id),
    ex AS (SELECT file_id, array_to_string(list_sort(list(DISTINCT name)), ',') e FROM s WHERE visibility = 'public' GROUP BY file_id),
    im AS (SELECT src file_id, array_to_string(list_sort(list(DISTINCT path)), ',') i FROM fl JOIN f ON f.file_id = dst GROUP BY src), ib AS (SELECT dst file_id, array_to_string(list_sort(list(DISTINCT path)), ',') i FROM fl JOIN f ON f.file_id = src GROUP BY dst)
    SELECT f.file_id, f.path, ex.e AS exports, im.i AS imports_from, ib.i AS imported_by, coalesce(un.n, 0) AS n_unresolved FROM f LEFT JOIN ex USING (file_id) LEFT JOIN im USING (file_id) LEFT JOIN ib USING (file_id) LEFT JOIN un USING (file_id)
    WHERE (SELECT count(*) FROM f) <= 10 OR coalesce(ex.e, im.i, ib.i) IS NOT NULL OR un.n > 0"""
)
def dependencies(spark, d):
    """What each file exports, uses, is used by, and misses."""
    from .catalogue import calls

    files, symbols = inputs(spark, d)
    missing = graph.resolve_imports(calls(spark, d).select("file_id", F.col("leaf").alias("path")), symbols).filter("tier = 0")
    return graph.dependencies(files, symbols, file_links(symbols), missing)


@query(LINKED + " SELECT x.file_id, y.file_id AS dep_file, array_to_string(list_sort(list(DISTINCT y.name)), ',') AS names FROM ce JOIN s x ON x.symbol_id = source_id JOIN s y ON y.symbol_id = target_id WHERE x.file_id <> y.file_id GROUP BY ALL")
def dependency_names(spark, d):
    """Which names of which file each file uses."""
    symbols = inputs(spark, d)[1]
    return graph.names_by_dependency(symbol_edges(symbols), symbols)


@query(
    LINKED
    + """, dn AS (SELECT src file_id, count(DISTINCT dst) n FROM fl GROUP BY src), z AS (SELECT file_id, lower(trim(kind)) k, visibility, line_start, symbol_id, name || CASE WHEN docstring IS NULL THEN '' ELSE ': ' || substring(string_split(docstring, chr(10))[1], 1, 100) END t FROM s),
    li AS (SELECT file_id, array_to_string(list_slice(list(t ORDER BY line_start, symbol_id) FILTER (k = 'class'), 1, 5), chr(10)) cl, array_to_string(list_slice(list(t ORDER BY line_start, symbol_id) FILTER (k = 'function' AND visibility = 'public'), 1, 10), chr(10)) api FROM z GROUP BY file_id)
    SELECT f.file_id, path, line_count, coalesce(dn.n, 0) AS n_dependencies, coalesce(cl, '') AS classes, coalesce(api, '') AS api FROM f LEFT JOIN dn USING (file_id) LEFT JOIN li USING (file_id)"""
)
def summarize_detailed(spark, d):
    """Each file's size, dependencies, classes and public functions with the first line of their documentation."""
    files, symbols = inputs(spark, d)
    return graph.summaries(files, symbols, file_links(symbols), "detailed")


@query(LINKED + " SELECT DISTINCT src AS file_id FROM fl WHERE dst IN (SELECT file_id FROM f WHERE is_entry) AND src NOT IN (SELECT file_id FROM f WHERE is_entry)")
def affected_files(spark, d):
    """Everything that depends on an entry file."""
    files, symbols = inputs(spark, d)
    return graph.affected_files(graph.impact(file_links(symbols), files.filter("is_entry").select("file_id")))


@query(f"WITH {CALLS} SELECT DISTINCT c.project AS source_project, c.leaf, f.project AS target_project FROM c JOIN s ON s.name = c.leaf JOIN f ON s.file_id = f.file_id WHERE c.project <> f.project AND c.project NOT IN (SELECT DISTINCT project FROM f WHERE project < 'm')")
def cross_project_incremental(spark, d):
    """``cross_project`` of the projects whose used names changed; those before m have their checksum stored."""
    from .catalogue import calls

    used = written(calls(spark, d))
    defined = current_symbols(spark, d).join(current_files(spark, d).select("file_id", "project"), "file_id").select("project", "name")
    stored = graph.import_checksums(used.filter("project < 'm'"))
    return graph.cross_project_incremental(used, defined, stored)[0]


@query(f"WITH {CALLS} SELECT DISTINCT least(c.project, f.project) AS a, greatest(c.project, f.project) AS b FROM c JOIN s ON s.name = c.leaf JOIN f ON s.file_id = f.file_id WHERE c.project <> f.project")
def linked_projects(spark, d):
    """Pairs of projects that use each other's names."""
    from .catalogue import calls

    defined = current_symbols(spark, d).join(current_files(spark, d).select("file_id", "project"), "file_id").select("project", "name")
    return graph.linked_projects(graph.cross_project(calls(spark, d), defined))


_INNER = "(SELECT {key}, symbol_id, row_number() OVER (PARTITION BY {key} ORDER BY line_end - line_start, symbol_id) rn FROM {places} JOIN (SELECT symbol_id, file_id, line_start, line_end FROM s) USING (file_id) WHERE line BETWEEN line_start AND line_end)"


@query(
    LINKED
    + f""", rf AS (SELECT DISTINCT s.file_id, u.leaf AS sym, s.line_start AS line FROM s, LATERAL (SELECT unnest(list_distinct(regexp_extract_all(s.body_text, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1))) AS leaf) u WHERE u.leaf IN (SELECT name FROM s)),
    df AS (SELECT DISTINCT file_id, name AS sym, line_start AS line FROM s), di AS (SELECT * FROM {_INNER.format(key='file_id, sym, line', places='df')} WHERE rn = 1), ri AS (SELECT * FROM {_INNER.format(key='file_id, sym, line', places='rf')} WHERE rn = 1),
    dl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY lpad(CAST(file_id AS VARCHAR), 19, '0') DESC, line DESC, symbol_id DESC) o FROM di) WHERE o = 1)
    SELECT DISTINCT ri.symbol_id AS source_id, dl.symbol_id AS target_id, 'references' AS kind, 1.5 AS weight FROM ri JOIN dl USING (sym) WHERE ri.file_id <> dl.file_id"""
)
def reference_edges(spark, d):
    """Edges of an index of definitions and references, made of the symbols and the names they call."""
    symbols = inputs(spark, d)[1]
    path = F.lpad(F.col("file_id").cast("string"), 19, "0")
    defined = symbols.select(path.alias("path"), F.col("name").alias("symbol"), F.lit(True).alias("is_definition"), F.col("line_start").alias("line"))
    names = F.explode(F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("symbol")
    used = symbols.select(path.alias("path"), names, F.lit(False).alias("is_definition"), F.col("line_start").alias("line"))
    files = symbols.select("file_id").distinct().select("file_id", path.alias("path"))
    return graph.reference_edges(defined.unionByName(used), files, symbols)


@query(LINKED + ", u AS (SELECT source_id symbol_id, target_id other_id, kind FROM ce WHERE source_id IN (1, 2, 3, 4, 5) UNION SELECT target_id, source_id, kind FROM ce WHERE target_id IN (1, 2, 3, 4, 5)) SELECT symbol_id, other_id, kind, 'structure' AS part FROM u WHERE symbol_id <> other_id")
def neighbor_view(spark, d):
    """The neighbours of five symbols, references apart from structure."""
    return graph.neighbour_view(symbol_edges(inputs(spark, d)[1]), [1, 2, 3, 4, 5])
