"""The symbol graph: edges, neighbours, dependencies, exploration, impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def contains_edges(symbols: DataFrame) -> DataFrame:
    """(source_id, target_id, kind): class to method of the same file, by the qualified name without its last part.

    A class that is declared several times under one qualified name contributes its first symbol.
    """
    parents = symbols.groupBy("file_id", "qualified").agg(F.min("symbol_id").alias("source_id")).withColumnRenamed("qualified", "parent")
    methods = symbols.filter(F.lower(F.trim("kind")) == "method").select(F.col("symbol_id").alias("target_id"), "file_id", F.regexp_replace("qualified", r"(::|\.)[^.:]*$", "").alias("parent"))
    return methods.join(parents, ["file_id", "parent"]).filter("source_id <> target_id").select("source_id", "target_id", F.lit("contains").alias("kind"))


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, path, tier, first_target, n_targets): import paths against symbols.

    An exact qualified name is tier 1; only without one a class, function or module whose name is the
    path's last part is tier 2; what neither finds is unresolved, tier 0 without targets. Symbols are
    grouped by name before the joins, so a name that very many symbols bear stays one row.
    """
    from ..functions.text import import_leaf

    targets = [F.min("symbol_id").alias("first_target"), F.count(F.lit(1)).alias("n_targets")]
    exact = symbols.groupBy(F.col("qualified").alias("path")).agg(*targets)
    named = symbols.filter(F.lower(F.trim("kind")).isin("class", "function", "module")).groupBy(F.col("name").alias("leaf")).agg(*targets)
    tried = imports.select("file_id", "path", import_leaf(F.col("path")).alias("leaf")).distinct()
    one = tried.join(exact.select("path", F.col("first_target").alias("e_first"), F.col("n_targets").alias("e_n")), "path", "left")
    two = one.join(named, "leaf", "left")
    tier = F.when(F.col("e_n").isNotNull(), 1).when(F.col("n_targets").isNotNull(), 2).otherwise(0)
    return two.select("file_id", "path", tier.alias("tier"), F.coalesce("e_first", "first_target").alias("first_target"), F.coalesce("e_n", "n_targets", F.lit(0)).alias("n_targets"))


def neighbours(edges: DataFrame, symbols: Sequence[int]) -> DataFrame:
    """(symbol_id, other_id, kind): both directions as a union of two filtered scans, the symbol itself excluded."""
    wanted = list(symbols)
    out = edges.filter(F.col("source_id").isin(wanted)).select(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("other_id"), "kind")
    back = edges.filter(F.col("target_id").isin(wanted)).select(F.col("target_id").alias("symbol_id"), F.col("source_id").alias("other_id"), "kind")
    return out.unionByName(back).filter("symbol_id <> other_id").distinct()


def file_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(src_file, dst_file): distinct edges between different files; ``membership`` is the narrow (symbol_id, file_id)."""
    src = membership.select(F.col("symbol_id").alias("source_id"), F.col("file_id").alias("src_file"))
    dst = membership.select(F.col("symbol_id").alias("target_id"), F.col("file_id").alias("dst_file"))
    return edges.join(src, "source_id").join(dst, "target_id").filter("src_file <> dst_file").select("src_file", "dst_file").distinct()


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """(a, b; a < b): files that depend on each other. One aggregate on the unordered pair instead of a self join."""
    pairs = edges.select(F.least("src_file", "dst_file").alias("a"), F.greatest("src_file", "dst_file").alias("b"), (F.col("src_file") < F.col("dst_file")).cast("int").alias("forward"))
    return pairs.groupBy("a", "b").agg(F.max("forward").alias("f"), F.min("forward").alias("g")).filter("f = 1 AND g = 0").select("a", "b")


def degrees(edges: DataFrame) -> DataFrame:
    """(symbol_id, degree): edges at either end; a self-loop counts once."""
    ends = edges.select(F.col("source_id").alias("symbol_id")).unionAll(edges.filter("source_id <> target_id").select(F.col("target_id").alias("symbol_id")))
    return ends.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("degree"))


def explore(links: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(file_id, hop, via): files within ``hops`` undirected steps of the seeds; the smallest predecessor is named.

    Each step is one join of the frontier and one anti join; found files are checkpointed. It ends early when nothing new is found.
    """
    both = links.select(F.col("src_file").alias("a"), F.col("dst_file").alias("b")).unionAll(links.select(F.col("dst_file").alias("a"), F.col("src_file").alias("b"))).distinct()
    both = cut_lineage(both)
    found = seeds.select("file_id", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("via")).distinct()
    frontier = found
    for hop in range(1, hops + 1):
        step = both.join(frontier.select(F.col("file_id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("via"))
        frontier = cut_lineage(step.join(found.select(F.col("file_id").alias("b")), "b", "left_anti").select(F.col("b").alias("file_id"), F.lit(hop).alias("hop"), F.col("via").cast("long").alias("via")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def typed_file_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(src_file, dst_file, kind): distinct edges between different files with their kinds; ``membership``: symbol_id, file_id."""
    src = membership.select(F.col("symbol_id").alias("source_id"), F.col("file_id").alias("src_file"))
    dst = membership.select(F.col("symbol_id").alias("target_id"), F.col("file_id").alias("dst_file"))
    return edges.join(src, "source_id").join(dst, "target_id").filter("src_file <> dst_file").select("src_file", "dst_file", "kind").distinct()


def explore_query(scores: DataFrame, links: DataFrame, files: DataFrame, seeds: int = 5, hops: int = 2, max_expanded: int = 30) -> DataFrame:
    """(file_id, path, hop, via, reason, score, rank): the query's best files, and what lies within ``hops`` steps of them.

    ``scores``: file_id and score of every file that matches the query; ``links``: src_file, dst_file, kind; ``files``: file_id, path.
    A file is found at its first step; of several ways to it the smallest (path of the predecessor, kind) is named. No more than
    ``max_expanded`` files are kept, by (hop, path); the result is ordered by (hop, falling score, path). Without matching files nothing is found.
    """
    best = scores.orderBy(F.desc("score"), "file_id").limit(seeds)
    known = files.select("file_id", "path")
    found = cut_lineage(best.join(known, "file_id").select("file_id", "path", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"), F.lit("bm25_seed").alias("reason")))
    both = links.select(F.col("src_file").alias("a"), F.col("dst_file").alias("b"), "kind").unionAll(links.select(F.col("dst_file").alias("a"), F.col("src_file").alias("b"), "kind"))
    frontier, total = found, found.count()
    for hop in range(1, max(hops, 0) + 1):
        if total >= max_expanded:
            break
        # The frontier has max_expanded rows at most.
        step = both.join(F.broadcast(frontier.select(F.col("file_id").alias("a"), F.col("path").alias("via"))), "a").groupBy("b").agg(F.min(F.struct("via", "kind")).alias("w"))
        fresh = step.join(F.broadcast(found.select(F.col("file_id").alias("b"))), "b", "left_anti").select(F.col("b").alias("file_id"), "w").join(known, "file_id")
        named = fresh.select("file_id", "path", F.lit(hop).alias("hop"), F.col("w.via").alias("via"), F.concat(F.lit("edge:"), F.col("w.kind")).alias("reason"))
        frontier = cut_lineage(named.orderBy("path", "file_id").limit(max_expanded - total))
        n = frontier.count()
        if not n:
            break
        total += n
        found = found.unionByName(frontier)
    scored = found.join(scores.select("file_id", "score"), "file_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = [F.col("hop"), F.desc("score"), F.col("path"), F.col("file_id")]
    top = scored.orderBy(*order).limit(max_expanded)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - 1).select("file_id", "path", "hop", "via", "reason", "score", "rank")


def dependency_map(links: DataFrame) -> DataFrame:
    """(file_id, n_imports, n_imported_by): both directions by one aggregate."""
    ends = links.select(F.col("src_file").alias("file_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(links.select(F.col("dst_file").alias("file_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("file_id").agg(F.sum("o").alias("n_imports"), F.sum("i").alias("n_imported_by"))


def dependencies(files: DataFrame, symbols: DataFrame, links: DataFrame, unresolved: DataFrame, direction: str = "both", scope: str | None = None, names: int = 10) -> DataFrame:
    """(file_id, path, exports, imports_from, imported_by, n_unresolved): the dependency map of the files, lists sorted and joined by commas.

    ``direction``: imports, importers or both; the other lists are null. ``scope``: a path, or a folder. When there are more than ``names``
    files, those that export, import and miss nothing, and that nobody imports, are left out. ``unresolved``: file_id, path.
    """
    from .store import in_scope

    shown = files.select("file_id", "path").filter(in_scope(F.col("path"), scope) if scope else F.lit(True))
    many = shown.limit(names + 1).count() > names
    exports = symbols.filter(F.col("visibility") == "public").groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("exports"))
    paths = files.select("file_id", "path")

    def side(own: str, other: str, name: str) -> DataFrame:
        named = links.select(F.col(own).alias("file_id"), F.col(other).alias("other")).distinct().join(paths.select(F.col("file_id").alias("other"), F.col("path").alias("p")), "other")
        return named.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias(name))

    missing = unresolved.groupBy("file_id").agg(F.count_distinct("path").alias("n_unresolved"))
    out = shown.join(exports, "file_id", "left").join(missing, "file_id", "left")
    for way, own, other, name in (("imports", "src_file", "dst_file", "imports_from"), ("importers", "dst_file", "src_file", "imported_by")):
        out = out.join(side(own, other, name), "file_id", "left") if direction in (way, "both") else out.withColumn(name, F.lit(None).cast("string"))
    shown_all = out.withColumn("n_unresolved", F.coalesce("n_unresolved", F.lit(0))).select("file_id", "path", "exports", "imports_from", "imported_by", "n_unresolved")
    return shown_all.filter(F.coalesce("exports", "imports_from", "imported_by").isNotNull() | (F.col("n_unresolved") > 0)) if many else shown_all


def names_by_dependency(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, dep_file, names): which symbols of which other file each file's edges point to."""
    src = symbols.select(F.col("symbol_id").alias("source_id"), "file_id")
    dst = symbols.select(F.col("symbol_id").alias("target_id"), F.col("file_id").alias("dep_file"), "name")
    met = edges.join(src, "source_id").join(dst, "target_id").filter("file_id <> dep_file")
    return met.groupBy("file_id", "dep_file").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def summaries(files: DataFrame, symbols: DataFrame, links: DataFrame, depth: str = "medium", functions: int = 10, classes: int = 5) -> DataFrame:
    """(file_id, path, line_count, n_dependencies, classes, api): what each file holds.

    ``depth``: brief has no lists, medium names, detailed names with the first line of their documentation. Lists are sorted by line
    and cut to ``classes`` and ``functions`` names.
    """
    from ..functions.text import first_line

    kind = F.lower(F.trim("kind"))
    text = F.col("name") if depth != "detailed" else F.concat(F.col("name"), F.coalesce(F.concat(F.lit(": "), first_line(F.col("docstring"))), F.lit("")))

    def listed(wanted, most: int):
        rows = F.array_sort(F.collect_list(F.when(wanted, F.struct("line_start", "symbol_id", text.alias("t")))))
        return F.array_join(F.slice(F.transform(rows, lambda x: x["t"]), 1, most), "\n")

    held = symbols.groupBy("file_id").agg(listed(kind == "class", classes).alias("classes"), listed((F.col("visibility") == "public") & (kind == "function"), functions).alias("api"))
    needed = links.groupBy(F.col("src_file").alias("file_id")).agg(F.count_distinct("dst_file").alias("n_dependencies"))
    out = files.select("file_id", "path", "line_count").join(needed, "file_id", "left").join(held, "file_id", "left")
    lists = ["", ""] if depth == "brief" else [F.coalesce("classes", F.lit("")), F.coalesce("api", F.lit(""))]
    lists = [x if not isinstance(x, str) else F.lit(x) for x in lists]
    return out.select("file_id", "path", "line_count", F.coalesce("n_dependencies", F.lit(0)).alias("n_dependencies"), lists[0].alias("classes"), lists[1].alias("api"))


def affected_files(impacts: DataFrame) -> DataFrame:
    """(file_id): everything that depends on any changed file, once."""
    return impacts.select(F.col("dependent").alias("file_id")).distinct()


def impact(links: DataFrame, changed: DataFrame) -> DataFrame:
    """(changed_file, dependent): files that depend on a changed one and aren't changed themselves."""
    targets = changed.select(F.col("file_id").alias("dst_file")).distinct()
    return links.join(targets, "dst_file").join(targets.withColumnRenamed("dst_file", "src_file"), "src_file", "left_anti").select(F.col("dst_file").alias("changed_file"), F.col("src_file").alias("dependent")).distinct()


def cross_project(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_project, leaf, target_project): names that a project uses and other projects define.

    ``imports``: project, leaf; ``symbols``: project, name. Both sides are distinct before the join, so
    a name of which one project has very many symbols is one row.
    """
    used = imports.select(F.col("project").alias("source_project"), "leaf").distinct()
    defined = symbols.select(F.col("project").alias("target_project"), F.col("name").alias("leaf")).distinct()
    return used.join(defined, "leaf").filter("source_project <> target_project").select("source_project", "leaf", "target_project")


def cross_project_incremental(imports: DataFrame, symbols: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (as of ``cross_project``) of the projects whose import list changed since ``stored`` (project, checksum), and all checksums now.

    Projects with the stored checksum are not resolved again: their rows don't reach the join.
    """
    now = import_checksums(imports)
    changed = now.join(stored.select("project", F.col("checksum").alias("__old")), "project", "left").filter(~F.col("checksum").eqNullSafe(F.col("__old"))).select("project")
    return cross_project(imports.join(changed, "project", "left_semi"), symbols), now


def linked_projects(edges: DataFrame) -> DataFrame:
    """(a, b; a < b): projects that use each other's names in either direction."""
    return edges.select(F.least("source_project", "target_project").alias("a"), F.greatest("source_project", "target_project").alias("b")).distinct()


def import_checksums(imports: DataFrame) -> DataFrame:
    """(project, checksum): MD5 of a project's sorted distinct import list; it changes only with the list."""
    return imports.select("project", "leaf").distinct().groupBy("project").agg(F.md5(F.array_join(F.array_sort(F.collect_list("leaf")), ",")).alias("checksum"))


#: Lines of a file that one group of the interval join covers.
LINE_SPAN = 256


def enclosing_symbols(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """(place_id, symbol_id): the innermost symbol of the same file whose lines enclose the place; ties go to the smaller id.

    ``places``: place_id, file_id, line. Symbols are listed in every span of ``LINE_SPAN`` lines that they touch, so a place meets
    the symbols around it and not all of its file; one aggregate keeps the narrowest.
    """
    first, last = F.floor(F.col("line_start") / LINE_SPAN), F.floor(F.col("line_end") / LINE_SPAN)
    listed = symbols.filter("line_start <= line_end").select("symbol_id", "file_id", "line_start", "line_end", F.explode(F.sequence(first, last)).alias("span"))
    inside = places.withColumn("span", F.floor(F.col("line") / LINE_SPAN)).join(listed, ["file_id", "span"]).filter((F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end")))
    best = inside.groupBy("place_id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "symbol_id")).alias("m"))
    return best.select("place_id", F.col("m.symbol_id").alias("symbol_id"))


#: Weight of an edge from a reference that an index document names.
REFERENCE_WEIGHT = 1.5


def reference_edges(occurrences: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, weight): "references" edges between the symbols around each reference and around its definition in another file.

    ``occurrences``: path, symbol, is_definition, line. The last definition of a name (by path and line) wins.
    """
    placed = occurrences.join(files.select("path", "file_id"), "path").select("file_id", "path", "symbol", "is_definition", "line").distinct()
    placed = placed.withColumn("place_id", F.xxhash64("file_id", "symbol", "is_definition", "line"))
    around = placed.join(enclosing_symbols(placed.select("place_id", "file_id", "line"), symbols), "place_id")
    targets = around.filter("is_definition").groupBy("symbol").agg(F.max_by(F.struct("symbol_id", "file_id"), F.struct("path", "line", "symbol_id")).alias("d"))
    used = around.filter("NOT is_definition").join(targets, "symbol").filter(F.col("file_id") != F.col("d.file_id"))
    return used.select(F.col("symbol_id").alias("source_id"), F.col("d.symbol_id").alias("target_id"), F.lit("references").alias("kind"), F.lit(REFERENCE_WEIGHT).alias("weight")).distinct()


def neighbour_view(edges: DataFrame, symbols: Sequence[int]) -> DataFrame:
    """``neighbours`` with part: references, or structure for all other kinds."""
    return neighbours(edges, symbols).withColumn("part", F.when(F.col("kind") == "references", "references").otherwise("structure"))


def definition_references(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(symbol, def_file, ref_file, n): references of a symbol from other files than its definition's; the last definition wins.

    ``definitions``: symbol, file_id, seq; ``references``: symbol, file_id, pre-aggregated before the join.
    """
    last = definitions.groupBy("symbol").agg(F.max(F.struct("seq", "file_id")).alias("d")).select("symbol", F.col("d.file_id").alias("def_file"))
    used = references.groupBy("symbol", F.col("file_id").alias("ref_file")).agg(F.count(F.lit(1)).alias("n"))
    return used.join(last, "symbol").filter("def_file <> ref_file").select("symbol", "def_file", "ref_file", "n")


def concept_neighbours(edges: DataFrame, start: DataFrame, depth: int = 1, max_nodes: int | None = None) -> DataFrame:
    """(id, hop): concepts within ``depth`` undirected steps; with ``max_nodes`` the first by hop and id."""
    links = edges.select(F.col("source_id").alias("src_file"), F.col("target_id").alias("dst_file"))
    found = explore(links, start.select(F.col("id").alias("file_id")), depth).select(F.col("file_id").alias("id"), "hop")
    return found if max_nodes is None else found.orderBy("hop", "id").limit(max_nodes)
