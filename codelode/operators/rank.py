"""Ranking: boosted BM25, PageRank, recency, vectors, and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, written

K1, B = 1.5, 0.75
RRF_K = 60
#: Boosts of a symbol's fields.
BOOSTS = {"name": 3, "signature": 2, "docstring": 1, "body": 1}
BODY_TOKENS = 500
# Paths of generated and vendored files, which get half the boost.
GENERATED_PATH = r"_pb2\.py$|_pb2_grpc\.py$|\.generated\.|migrations/|alembic/versions/|__generated__/|\.min\.js$|\.min\.css$|vendor/|third_party/|\.d\.ts$|package-lock\.json$"


def is_generated(path: Column) -> Column:
    """Whether a path looks generated or vendored."""
    return path.rlike(GENERATED_PATH)


def file_postings(files: DataFrame, symbols: DataFrame, boosts: Mapping[str, int] = BOOSTS) -> DataFrame:
    """(file_id, token, tf): a file's terms from its path's stem and its symbols' fields, weighted by the fields' boosts.

    Term frequencies are multiplied by the boost instead of repeating terms. One aggregate over
    (file, token) with map-side combine; files without terms have no row.
    """
    generated = is_generated(F.col("path"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    paths = files.select("file_id", F.explode(T.code_tokens(stem)).alias("token"), F.lit(2).cast("long").alias("w"))
    half = F.when(F.col("generated"), 0.5).otherwise(1.0)

    def boosted(field: str) -> Column:
        return F.greatest(F.lit(1), F.floor(boosts[field] * half)).cast("long")

    fields = F.array(
        F.struct(T.code_tokens(F.col("name")).alias("tokens"), boosted("name").alias("w")),
        F.struct(T.code_tokens(F.col("qualified")).alias("tokens"), F.lit(1).cast("long").alias("w")),
        F.struct(T.code_tokens(F.col("signature")).alias("tokens"), boosted("signature").alias("w")),
        F.struct(T.code_tokens(F.col("docstring")).alias("tokens"), F.lit(1).cast("long").alias("w")),
        F.struct(F.slice(T.code_tokens(F.col("body_text")), 1, BODY_TOKENS).alias("tokens"), F.lit(1).cast("long").alias("w")),
    )
    of_symbols = symbols.join(files.select("file_id", generated.alias("generated")), "file_id").select("file_id", F.explode(fields).alias("f")).select("file_id", F.explode("f.tokens").alias("token"), "f.w")
    return paths.unionByName(of_symbols).groupBy("file_id", "token").agg(F.sum("w").alias("tf"))


def text_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf) of plain documents."""
    return docs.select(key, F.explode(T.code_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(postings: DataFrame, key: str) -> DataFrame:
    """One row: number of documents and mean length."""
    lengths = postings.groupBy(key).agg(F.sum("tf").alias("dl"))
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def bm25(postings: DataFrame, terms: Sequence[str], key: str = "file_id", top_k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score, rank): documents by BM25 for the terms, rank from 0; ties go to the smaller key.

    Only the query terms' postings meet the lengths; idf is ln(1 + (n - df + .5) / (df + .5)).
    """
    wanted = [t for t in dict.fromkeys(terms)]
    own = postings.filter(F.col("token").isin(wanted) if wanted else F.lit(False))
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    lengths = postings.groupBy(key).agg(F.sum("tf").alias("dl"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    # The terms' frequencies have a row a term, the statistics one row.
    scored = own.join(F.broadcast(df), "token").join(lengths, key).crossJoin(F.broadcast(stats)).groupBy(key).agg(F.round(F.sum(idf * norm), 6).alias("score")).filter("score > 0")
    return ranked(scored, key, top_k)


#: Bytes of text that a stage handles at a time.
SLICE = 8 << 20
# Where identifiers are cut, for patterns without look-around: the character before and those after.
_CUTS = (r"([a-z])([A-Z])", r"([A-Z])([A-Z][a-z])", r"([a-zA-Z])([0-9])", r"([0-9])([a-zA-Z])")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row, token) of each of ``functions.text.code_tokens``, for a batch of texts."""
    t = pc.fill_null(pc.cast(texts, pa.string()), "")
    for pattern in _CUTS:
        t = pc.replace_substring_regex(t, pattern, r"\1_\2")
    lists = pc.split_pattern_regex(t, r"[^\p{L}\p{N}_]+")
    words, row = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
    keep = pc.greater(pc.utf8_length(words), 1)
    words, row = words.filter(keep), row[np.asarray(keep)]
    lists = pc.split_pattern_regex(words, "_+")
    parts, row = pc.utf8_lower(pc.list_flatten(lists)), row[np.asarray(pc.list_parent_indices(lists))]
    keep = pc.or_(pc.greater(pc.utf8_length(parts), 1), pc.match_substring_regex(parts, "^[0-9]$"))
    return row[np.asarray(keep)], parts.filter(keep).dictionary_encode()


def _frequencies(key: str, terms: Sequence[str]):
    """Arrow stage: (key, dl, tf0, ...) of rows (key, text, w, most): the first ``most`` tokens count, ``w`` times each."""
    terms = list(terms)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0), dtype=np.int64)
            part = np.cumsum(sizes) // SLICE
            for lo in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
                s = b.slice(lo, int(np.searchsorted(part, part[lo], side="right")) - lo)
                row, tokens = _tokens(s.column("text"))
                number = np.asarray(tokens.indices)
                most = np.asarray(pc.fill_null(s.column("most"), np.iinfo(np.int32).max))
                inside = np.arange(len(row)) - np.searchsorted(row, row) < most[row]
                row, number = row[inside], number[inside]
                at = {v: i for i, v in enumerate(tokens.dictionary.to_pylist())}
                weight = np.asarray(s.column("w"))
                counts = [np.bincount(row, minlength=s.num_rows), *[np.bincount(row[number == at.get(t, -1)], minlength=s.num_rows) for t in terms]]
                yield pa.RecordBatch.from_arrays([s.column(key), *[pa.array((c * weight).astype(np.int64)) for c in counts]], names=[key, "dl", *[f"tf{i}" for i in range(len(terms))]])

    return stage


def term_frequencies(rows: DataFrame, key: str, text: Column, terms: Sequence[str], weight: Column | None = None, most: Column | None = None) -> DataFrame:
    """(key, dl, tf0, ...): length and the terms' frequencies per document, from one or more rows of text each.

    For a given query no postings are made: each batch of texts is cut into tokens by Arrow's functions and counted in place,
    and one aggregate with map-side combine adds up a few numbers per document. ``most``: so many first tokens of a row count.
    """
    terms = list(dict.fromkeys(terms))
    each = rows.select(key, text.alias("text"), (F.lit(1) if weight is None else weight).cast("long").alias("w"), (F.lit(None) if most is None else most).cast("int").alias("most"))
    kind, names = dict(rows.dtypes)[key], ["dl", *[f"tf{i}" for i in range(len(terms))]]
    counted = each.mapInArrow(_frequencies(key, terms), f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy(key).agg(*[F.sum(n).cast("long").alias(n) for n in names]).filter("dl > 0")


def file_frequencies(files: DataFrame, symbols: DataFrame, terms: Sequence[str], boosts: Mapping[str, int] = BOOSTS) -> DataFrame:
    """``term_frequencies`` of files, from their paths' stems and their symbols' boosted fields."""
    generated = is_generated(F.col("path"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    half = F.when(F.col("generated"), 0.5).otherwise(1.0)
    rows = files.select("file_id", stem.alias("text"), F.lit(2).cast("long").alias("w"), F.lit(None).cast("int").alias("most"))
    of = symbols.join(files.select("file_id", generated.alias("generated")), "file_id")

    def field(text: Column, boost: Column | int, most: int | None = None) -> Column:
        return F.struct(text.alias("text"), (F.lit(boost) if isinstance(boost, int) else boost).cast("long").alias("w"), F.lit(most).cast("int").alias("most"))

    def boosted(name: str) -> Column:
        return F.greatest(F.lit(1), F.floor(boosts[name] * half))

    fields = F.array(field(F.col("name"), boosted("name")), field(F.concat_ws(" ", "qualified", "docstring"), 1), field(F.col("signature"), boosted("signature")), field(F.col("body_text"), 1, BODY_TOKENS))
    rows = rows.unionByName(of.select("file_id", F.explode(fields).alias("f")).select("file_id", "f.*"))
    return term_frequencies(rows, "file_id", F.col("text"), terms, F.col("w"), F.col("most"))


def bm25_query(frequencies: DataFrame, terms: Sequence[str], key: str = "file_id", top_k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` from ``term_frequencies`` of the same terms; the statistics are one row over the same aggregate."""
    terms = list(dict.fromkeys(terms))
    frequencies = cut_lineage(frequencies)  # a few numbers per document, read for the statistics and for the scores
    hits = [F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    stats = frequencies.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"), *hits)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))).otherwise(0.0)
    scored = frequencies.crossJoin(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).filter("score > 0")
    return ranked(scored, key, top_k)


def ranked(scored: DataFrame, key: str, top_k: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(key, score, rank, keep): rank from 0 by falling score, then by key. With ``top_k`` only so many rows are sorted at all."""
    rows = scored.select(key, "score", *keep)
    order = [F.desc("score"), F.col(key)]
    if top_k is None:
        return numbered(rows, order)
    rows = rows.orderBy(*order).limit(top_k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order``, from 0, without one task that sees all of them.

    They are sorted by ranges and written with their place in the partition; the partitions' sizes, one row each, give the offsets.
    """
    within = F.monotonically_increasing_id()
    placed = written(rows.orderBy(*order).select("*", F.shiftright(within, 33).cast("int").alias("__range"), within.bitwiseAND((1 << 33) - 1).alias("__within")))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    offsets = sizes.select("__range", before.alias("__before"))  # a row a partition
    return placed.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__range", "__within", "__before")


#: Groups of tokens that a stored index is split into.
INDEX_GROUPS = 64


def save_index(postings: DataFrame, path: str, key: str = "file_id") -> None:
    """Writes postings (key, token, tf), the documents' lengths and the corpus statistics below ``path``, replacing what is there.

    The postings lie in folders by a hash of the token, sorted by token, so a query reads its tokens' row groups only.
    """
    group = F.pmod(F.xxhash64("token"), F.lit(INDEX_GROUPS)).cast("int")
    postings.withColumn("token_group", group).repartition(INDEX_GROUPS, "token_group").sortWithinPartitions("token_group", "token").write.mode("overwrite").partitionBy("token_group").parquet(f"{path}/postings")
    lengths = postings.groupBy(key).agg(F.sum("tf").alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    stored = postings.sparkSession.read.parquet(f"{path}/lengths")
    stored.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl")).write.mode("overwrite").parquet(f"{path}/stats")


def bm25_stored(spark, path: str, terms: Sequence[str], key: str = "file_id", top_k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` over an index written by ``save_index``: only the terms' groups of postings are read, and nothing is tokenised."""
    import xxhash

    wanted = list(dict.fromkeys(terms))

    def group(t: str) -> int:
        h = xxhash.xxh64_intdigest(t.encode(), seed=42)  # the seed of xxhash64 in SQL
        return (h - (1 << 64) if h >> 63 else h) % INDEX_GROUPS

    own = spark.read.parquet(f"{path}/postings").filter(F.col("token_group").isin(sorted({group(t) for t in wanted})) & F.col("token").isin(wanted))
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats, lengths = spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/lengths")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    # The terms' frequencies have a row a term, the statistics one row.
    scored = own.join(F.broadcast(df), "token").join(lengths, key).crossJoin(F.broadcast(stats)).groupBy(key).agg(F.round(F.sum(idf * norm), 6).alias("score")).filter("score > 0")
    return ranked(scored, key, top_k)


def index_version(files: DataFrame) -> str:
    """A digest of the files' digests, whatever their order: an index built for one version is valid until it changes."""
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("file_id", "sha256")).alias("x"), F.sum(F.pmod(F.xxhash64("sha256", "file_id"), F.lit(1 << 31))).alias("s")).first()
    return f"{row['n']}-{(row['x'] or 0) & ((1 << 64) - 1):016x}-{row['s'] or 0:x}"


def current_index(files: DataFrame, symbols: DataFrame, folder: str) -> str:
    """The path of a stored index of these files, built only if ``folder`` doesn't have this version: an edit invalidates it."""
    spark = files.sparkSession
    path = f"{folder}/{index_version(files)}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")):
        save_index(file_postings(files, symbols), path)
    return path


def recent_files(actions: DataFrame, files: DataFrame, now: float | DataFrame, limit: int = 50) -> DataFrame:
    """(file_id, score, rank): ``recency`` of targets that are paths of known files; others are dropped."""
    known = recency(actions, now, limit).join(files.select("file_id", F.col("path").alias("target")), "target")
    return ranked(known.select("file_id", "score"), "file_id", limit)


def naive_grep(docs: DataFrame, terms: Sequence[str], key: str, text: str) -> DataFrame:
    """(key, n_chars): documents that contain any term as a substring, letter case aside."""
    low = F.lower(F.col(text))
    hit = F.lit(False)
    for t in terms:
        hit = hit | low.contains(t)
    return docs.filter(hit).select(key, F.length(text).cast("long").alias("n_chars"))


#: Nodes and links up to which PageRank's rounds run in one task, on arrays; a larger graph takes a join and an aggregate a round.
ONE_TASK = 3_000_000


def _power_iteration(iterations: int, damping: float):
    """Grouped Arrow stage: all rounds of PageRank over rows (a, b, x): the share x of the link from a to b, or, where b is null, the restart mass x of node a."""

    def run(table: pa.Table) -> pa.Table:
        is_node = np.asarray(table["b"].is_null())
        a, x = np.asarray(table["a"]), np.asarray(table["x"])
        ids, restart = a[is_node], x[is_node]
        order = np.argsort(ids)
        ids, restart = ids[order], restart[order]
        src, dst, share = a[~is_node], np.asarray(table["b"].filter(pa.array(~is_node)), dtype=np.int64), x[~is_node]
        # A fixed order of the links, so that sums don't depend on how the rows arrived.
        order = np.lexsort((src, dst))
        src, dst, share = src[order], dst[order], share[order]
        alone = ~np.isin(ids, src)
        known = np.isin(src, ids) & np.isin(dst, ids)
        src, dst, share = np.searchsorted(ids, src[known]), np.searchsorted(ids, dst[known]), share[known]
        rank = restart.copy()
        for _ in range(iterations):
            inflow = np.bincount(dst, weights=rank[src] * share, minlength=len(ids))
            rank = (1 - damping) * restart + damping * (inflow + rank[alone].sum() / len(ids))
        return pa.table({"id": ids, "pr": rank})

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85, restart: DataFrame | None = None) -> DataFrame:
    """(id, pr): PageRank on the undirected graph, parallel edges counted; a self-loop counts twice.

    ``nodes`` has id, ``edges`` has src and dst; ``restart`` (id, mass) personalises, uniform if it is
    empty or sums to 0. Nodes without edges spread their mass evenly. The adjacency is aggregated and
    kept once; each round is one join with it and one aggregate, both by node, and writes a row of numbers per node. A graph of at most ``ONE_TASK``
    nodes and links is counted first and then ranked by one task. What goes to nodes that ``nodes`` doesn't have is lost; ids are integers.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    weights = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pr"))
    base = nodes.select("id", F.lit(1.0 / n).alias("v"))
    if restart is not None:
        mass = restart.groupBy("id").agg(F.sum("mass").alias("mass"))
        joined = nodes.join(mass, "id", "left").select("id", F.coalesce("mass", F.lit(0.0)).alias("mass"))
        total = joined.agg(F.sum("mass").alias("t"))
        base = joined.crossJoin(F.broadcast(total)).select("id", F.when(F.col("t") > 0, F.col("mass") / F.col("t")).otherwise(1.0 / n).alias("v"))
    # Kept by source in memory, or on the executors' disks; what is lost with an executor is computed again.
    share = weights.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share").persist()
    if n + share.count() <= ONE_TASK:
        rows = base.select(F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("v").alias("x")).unionByName(share.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("share").alias("x")))
        rank = written(rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_power_iteration(iterations, damping), "id long, pr double"))
        share.unpersist()
        return rank.select(F.col("id").cast(dict(nodes.dtypes)["id"]).alias("id"), "pr")
    linked = share.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    rank = written(base.join(linked, "id", "left").select("id", "v", F.coalesce("linked", F.lit(False)).alias("linked"), F.col("v").alias("pr")))
    for _ in range(iterations):
        incoming = share.join(rank.select("id", "pr"), share["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("pr") * F.col("share")).alias("inflow"))
        # The mass of nodes without edges, from the same rows: no join of its own.
        lost = rank.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("pr"))), F.lit(0.0)).alias("lost"))
        moved = rank.join(incoming, rank["id"] == incoming["dst"], "left").crossJoin(F.broadcast(lost))
        rank = written(moved.select("id", "v", "linked", ((1 - damping) * F.col("v") + damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("lost") / n)).alias("pr")))
    share.unpersist()
    return rank.select("id", "pr")


def recency(actions: DataFrame, now: float | DataFrame, limit: int = 50) -> DataFrame:
    """(target, score, actions): the latest ``limit`` targets, each with its number of actions (twice if one was an edit) over 1 + hours since the last.

    ``actions`` has target, action and ts (epoch seconds); ``now`` is a time or one row (now). The kinds of actions come sorted in one string.
    """
    clock = now if isinstance(now, DataFrame) else actions.sparkSession.range(1).select(F.lit(float(now)).alias("now"))
    seen = actions.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.max((F.col("action") == "edit").cast("int")).alias("edited"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions")
    )
    latest = seen.orderBy(F.desc("last"), "target").limit(limit)
    weight = F.col("n") * F.when(F.col("edited") == 1, 2).otherwise(1)
    return latest.crossJoin(F.broadcast(clock)).select("target", F.round(weight / (1 + (F.col("now") - F.col("last")) / 3600), 6).alias("score"), "actions")


def fuse(signals: Mapping[str, DataFrame], key: str = "file_id", weights: Mapping[str, float] | None = None, top_k: int | None = 20) -> DataFrame:
    """Reciprocal rank fusion: (key, rrf_score, <signal>_rank, <signal>_score, ..., rank).

    ``signals``: ranked lists with key, rank and possibly score. One shuffle: the lists are tagged, united and
    pivoted by one aggregate; no chain of outer joins.
    """
    weights = weights or {}
    tagged = None
    for name, df in signals.items():
        score = F.col("score").cast("double") if "score" in df.columns else F.lit(None).cast("double")
        one = df.select(key, F.lit(name).alias("signal"), F.col("rank").cast("long").alias("rank"), score.alias("score"), F.lit(float(weights.get(name, 1.0))).alias("weight"))
        tagged = one if tagged is None else tagged.unionByName(one)
    term = F.col("weight") / (RRF_K + F.col("rank"))
    own = [F.max(F.when(F.col("signal") == name, F.col(c))).alias(f"{name}_{c}") for name in signals for c in ("rank", "score")]
    fused = tagged.groupBy(key).agg(F.round(F.sum(term), 9).alias("rrf_score"), *own)
    order = [F.desc("rrf_score"), F.col(key)]
    if top_k is None:
        return numbered(fused, order)
    return fused.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


def confidence(fused: DataFrame) -> DataFrame:
    """One row (label): high, medium or low, by the top score against three perfect signals and its gap to the second."""
    top = fused.agg(F.max(F.when(F.col("rank") == 0, F.col("rrf_score"))).alias("a"), F.max(F.when(F.col("rank") == 1, F.col("rrf_score"))).alias("b"))
    relative = F.coalesce(F.col("a") / (3.0 / RRF_K), F.lit(0.0))
    gap = F.when(F.col("b").isNotNull(), F.col("a") - F.col("b")).otherwise(0.0)
    return top.select(F.when((relative > 0.5) & (gap > 0.003), "high").when(relative > 0.3, "medium").otherwise("low").alias("label"))


def _similarities(query: Sequence[float]):
    """Arrow stage: (file_id, symbol_id, score) of rows (file_id, symbol_id, vector), the cosine with ``query``."""
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.sqrt(q @ q) + 1e-12)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("vector").flatten(), dtype=np.float64).reshape(b.num_rows, len(q))
            with np.errstate(all="ignore"):  # infinite and missing values are left out below
                score = (x @ q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) + 1e-12)
            good = np.isfinite(score) & (x != 0).any(axis=1)
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(at), b.column("symbol_id").take(at), pa.array(score[good])], names=["file_id", "symbol_id", "score"])

    return stage


def knn_files(embeddings: DataFrame, query: Sequence[float], top_k: int = 10) -> DataFrame:
    """(file_id, score, best_symbol): exact cosine search, the best symbol of each file; ties go to the smaller symbol.

    ``embeddings`` has symbol_id, file_id and vector. The query is a parameter; the scan is one pass, and only the files' best scores
    are shuffled. Vectors of another size, with null or non-finite values, or all zero, don't count; repeated rows change nothing.
    """
    usable = embeddings.filter((F.size("vector") == len(query)) & ~F.exists("vector", lambda x: x.isNull())).select("file_id", "symbol_id", "vector")
    kinds = dict(usable.dtypes)
    scored = usable.mapInArrow(_similarities(query), f"file_id {kinds['file_id']}, symbol_id {kinds['symbol_id']}, score double").withColumn("score", F.round("score", 6))
    best = scored.groupBy("file_id").agg(F.max(F.struct("score", (-F.col("symbol_id")).alias("s"))).alias("b"))
    return best.select("file_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("best_symbol")).orderBy(F.desc("score"), "file_id").limit(top_k)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, key: str = "symbol_id", text: str = "text") -> DataFrame:
    """(key, model, dim, vector): each text's vector by ``embed``, a function of a list of texts that the workers can load; null and empty texts have none.

    No model is part of this package: who has one gives its function here, and it is called once per Arrow batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = embed(b[text].tolist()) if len(b) else []
            yield pd.DataFrame({key: b[key], "model": model, "dim": [len(v) for v in vectors], "vector": [list(v) for v in vectors]})

    kind = dict(texts.dtypes)[key]
    return texts.filter(F.length(text) > 0).select(key, text).mapInPandas(run, f"`{key}` {kind}, model string, dim int, vector array<float>")
