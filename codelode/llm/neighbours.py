"""The most similar vectors of every vector, through sharded, robust-pruned proximity graphs.

Vectors are normalised, so the cosine is a dot product. Coarse centres (fitted on a bounded sample)
split each model's vectors into cells. A vector is stored in the cell of its nearest centre, and is
searched for there and in the cells of the next few centres. A cell that is still too large is split by
centres of its own, fitted on a bounded sample of it, and so on, so cells stay of one size however many
vectors there are. In each cell a directed graph is built:
vectors are inserted in growing batches; greedy searches over the graph so far propose neighbours,
and relaxed distance pruning keeps those that no kept neighbour makes superfluous, so edges stay
diverse; edges back are pruned likewise. Then a beam search from a few entry points answers the
cell's queries. All searches of a cell run side by side in array operations.

A cell that no centres could split (very many vectors that hardly differ) is cut at random into parts of about ``MAX_CELL`` vectors
with a graph each, and its queries into chunks of about ``MAX_QUERIES``; every chunk visits every part. So no task gets more than a
part and a chunk, and no vector is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written

#: Vectors of a model and size that the centres are fitted on at most, and of all models together.
SAMPLE, ALL_SAMPLES = 20_000, 200_000
#: Vectors a cell should hold, the most centres that a model or a large cell is split by, the most vectors of one graph, and the most queries a task answers.
CELL, MAX_CENTRES, MAX_CELL, MAX_QUERIES = 600, 2_048, 6_000, 24_000
#: Times that cells which are too large are split by centres of their own.
LEVELS = 4
#: Cells that a query visits at most, and how much less similar a further centre may be than the nearest.
PROBES, PROBE_MARGIN = 3, 0.12
#: Graph: edges a vector keeps, width of the searches that build it, relaxation of the pruning.
DEGREE, BUILD_WIDTH, ALPHA = 14, 24, 1.2
#: Beam of the final search and the entry points it starts from.
BEAM, ENTRIES = 32, 24
#: Tasks over which the ids of one class of copies are spread.
SALTS = 32
#: Cosines that agree to so many digits, the accuracy of single precision, are ties.
DIGITS = 7
#: Unit vectors that agree to so many digits are copies: coarser than the rounding of single precision, so lengths don't matter.
UNIT_DIGITS = 6
SEED = 20250101


def usable(df: DataFrame, key: str, model: str, dim: str, vector: str) -> DataFrame:
    """(id, model, dim, vector) without vectors that have other than dim finite values or only zeros."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = df.filter(F.col(key).isNotNull() & F.col(model).isNotNull() & (F.size(v) == F.col(dim)) & finite & F.exists(v, lambda x: x != 0))
    return good.select(F.col(key).alias("id"), F.col(model).alias("model"), F.col(dim).cast("int").alias("dim"), v.alias("vector"))


def _normalised(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)
    scale = np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow of the squares
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow stage: each vector's two hashes of its rounded direction."""
    for b in batches:
        t = pa.Table.from_batches([b])
        sizes = np.asarray(t["dim"])
        for dim in np.unique(sizes).tolist():
            part = t.take(pa.array(np.flatnonzero(sizes == dim)))
            whole = np.rint(_normalised(part["vector"], dim) * 10.0**UNIT_DIGITS).astype(np.int64)
            factors = np.random.default_rng(SEED).integers(-(1 << 62), 1 << 62, (dim, 2)) * 2 + 1
            h = (whole @ factors[:, :1]).ravel(), (whole @ factors[:, 1:]).ravel()
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), part["model"].combine_chunks(), part["dim"].combine_chunks(), pa.array(h[0]), pa.array(h[1])], names=["id", "model", "dim", "h1", "h2"])


def fit_centres(x: np.ndarray, n: int, rounds: int = 6, seed: int = SEED) -> np.ndarray:
    """``n`` unit vectors by spherical k-means, empty clusters refilled at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        lengths = np.linalg.norm(sums, axis=1)
        empty = lengths < 1e-9
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        lengths[empty] = 1.0
        centres = sums / lengths[:, None]
    return centres.astype(np.float32)


class Graph:
    """A robust-pruned directed graph over unit vectors, built in batches and searched in batches."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, alpha: float = ALPHA, seed: int = SEED) -> None:
        self.x, self.degree, self.alpha = np.ascontiguousarray(x, dtype=np.float32), degree, alpha
        n = len(x)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        self.links = np.full((n, degree), -1, dtype=np.int32)
        self.entries = order[: min(n, ENTRIES)]
        # The entry points are linked among themselves first; then batches of doubling size are inserted.
        first = self.entries
        self._connect(first, np.tile(first, (len(first), 1)))
        done = len(first)
        while done < n:
            batch = order[done : done + max(1, min(done, 4096))]
            found, _ = self.search(self.x[batch], width, width)
            self._connect(batch, found)
            done += len(batch)

    def search(self, queries: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best vectors that a beam search finds for each query: (indices, similarities), -1 where there are fewer."""
        q, n = len(queries), len(self.x)
        seen = np.zeros((q, n), dtype=bool)
        seen[:, self.entries] = True
        ids = np.full((q, beam), -1, dtype=np.int32)
        sims = np.full((q, beam), -np.inf, dtype=np.float32)
        opened = np.ones((q, beam), dtype=bool)
        start = queries @ self.x[self.entries].T
        m = min(beam, len(self.entries))
        top = np.argsort(-start, axis=1, kind="stable")[:, :m]
        ids[:, :m], sims[:, :m], opened[:, :m] = self.entries[top], np.take_along_axis(start, top, 1), False
        active = np.arange(q)
        last_at = np.empty(q * n, dtype=np.int32)  # scratch: the last mention of a (query, vector) pair in a round
        per_round = 4
        while len(active):
            # Each query opens its best unopened vectors.
            rank = np.where(opened[active], np.inf, np.arange(beam)[None, :])
            pick = np.argpartition(rank, per_round - 1, axis=1)[:, :per_round] if beam > per_round else np.tile(np.arange(beam), (len(active), 1))
            valid = np.take_along_axis(rank, pick, 1) < np.inf
            alive = valid.any(axis=1)
            active, pick, valid = active[alive], pick[alive], valid[alive]
            if not len(active):
                break
            rows = np.repeat(active, valid.sum(axis=1))
            cols = pick[valid]
            opened[rows, cols] = True
            targets = self.links[ids[rows, cols]]
            who = np.repeat(rows, self.degree)
            to = targets.ravel()
            keep = to >= 0
            who, to = who[keep], to[keep]
            keep = ~seen[who, to]
            who, to = who[keep], to[keep]
            if len(who):
                # The same vector may be reached from several opened ones: the last mention counts.
                code, mention = who * n + to, np.arange(len(who), dtype=np.int32)
                last_at[code] = mention
                once = last_at[code] == mention
                who, to = who[once], to[once]
                seen[who, to] = True
                sim = np.einsum("ij,ij->i", queries[who], self.x[to])
                better = sim > sims[who, beam - 1]
                who, to, sim = who[better], to[better], sim[better]
            if len(who):
                self._merge(ids, sims, opened, who, to, sim, beam)
        return ids[:, :k], sims[:, :k]

    @staticmethod
    def _merge(ids, sims, opened, who, to, sim, beam) -> None:
        """Puts the new vectors into the queries' sorted beams."""
        changed, first, counts = np.unique(who, return_index=True, return_counts=True)
        widest = int(counts.max())
        slot = np.arange(len(who)) - np.repeat(first, counts)
        row = np.repeat(np.arange(len(changed)), counts)
        new_ids = np.full((len(changed), widest), -1, dtype=np.int32)
        new_sims = np.full((len(changed), widest), -np.inf, dtype=np.float32)
        new_ids[row, slot], new_sims[row, slot] = to, sim
        all_ids = np.concatenate([ids[changed], new_ids], axis=1)
        all_sims = np.concatenate([sims[changed], new_sims], axis=1)
        all_opened = np.concatenate([opened[changed], np.broadcast_to(new_ids < 0, new_ids.shape)], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[changed] = np.take_along_axis(all_ids, order, 1)
        sims[changed] = np.take_along_axis(all_sims, order, 1)
        opened[changed] = np.take_along_axis(all_opened, order, 1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Each node's kept edges among its candidates: (nodes, degree), -1 where there are fewer.

        The nearest candidate is kept; it makes those superfluous that are closer to it, by the
        relaxation, than to the node; and so on with the nearest one left.
        """
        c = candidates.copy()
        c[c == nodes[:, None]] = -1
        sims = np.einsum("id,ijd->ij", self.x[nodes], self.x[np.maximum(c, 0)])
        sims[c < 0] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
        same = (c[:, 1:] == c[:, :-1]) & (c[:, 1:] >= 0)  # repeated candidates lie side by side
        sims[:, 1:][same] = -np.inf
        vectors = self.x[np.maximum(c, 0)]
        between = np.einsum("ijd,ikd->ijk", vectors, vectors)
        far = 1.0 - sims  # half the squared distance
        left = np.isfinite(sims)
        out = np.full((len(nodes), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(nodes))
        for slot in range(self.degree):
            has = left.any(axis=1)
            if not has.any():
                break
            pick = np.argmax(left, axis=1)
            out[has, slot] = c[rows, pick][has]
            near = 1.0 - between[rows, pick]
            left &= (self.alpha * near > far) & has[:, None]
            left[rows, pick] = False
        return out

    def _connect(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Gives the nodes their edges, and their neighbours the edges back."""
        self.links[nodes] = self._prune(nodes, candidates.astype(np.int32))
        sources = np.repeat(nodes, self.degree)
        targets = self.links[nodes].ravel()
        ok = targets >= 0
        sources, targets = sources[ok], targets[ok]
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        to, first, counts = np.unique(targets, return_index=True, return_counts=True)
        # A much-wanted node looks at so many of its new admirers at a time.
        at = 0
        while (counts > at).any():
            some = counts > at
            rows, start, have = to[some], first[some] + at, np.minimum(counts[some] - at, self.degree)
            back = np.full((len(rows), self.degree), -1, dtype=np.int32)
            for i in range(self.degree):
                there = have > i
                back[there, i] = sources[start[there] + i]
            merged = np.concatenate([self.links[rows], back], axis=1)
            room = (self.links[rows] >= 0).sum(axis=1) + have <= self.degree
            if room.any():
                # Still room: the edges are added as they are.
                compact = np.sort(-merged[room] - 1, axis=1)  # existing ones first, as negatives
                self.links[rows[room]] = np.where(compact < 0, -compact - 1, -1)[:, : self.degree]
            if (~room).any():
                self.links[rows[~room]] = self._prune(rows[~room], merged[~room])
            at += self.degree


def _visits(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centre, whether it is the nearest): the centres each vector is stored and searched for at."""
    sims = x @ centres.T
    m = min(PROBES, sims.shape[1])
    near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    value = np.take_along_axis(sims, near, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
    rows, ranks = np.nonzero(value >= value[:, :1] - PROBE_MARGIN)
    return rows, near[rows, ranks], ranks == 0


def _assign(dims: dict[tuple[str, int], np.ndarray], count: bool = False):
    """Arrow stage: each vector with its cell, and once more as a query for each further cell it visits; or only the cells' numbers of vectors and of visits."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            models, sizes = np.asarray(t["model"].to_pylist(), dtype=object), np.asarray(t["dim"])
            for model, dim in sorted(set(zip(models.tolist(), sizes.tolist(), strict=True))):
                at = np.flatnonzero((models == model) & (sizes == dim))
                part = t.take(pa.array(at))
                raw = _normalised(part["vector"], dim).astype(np.float32)
                rows, cells, own = _visits(raw, dims[(model, dim)])
                if count:
                    met = np.unique(cells)
                    n, visits = (np.bincount(c, minlength=met[-1] + 1)[met] if len(met) else met for c in (cells[own], cells))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model] * len(met)), pa.array(np.full(len(met), dim, dtype=np.int32)), pa.array(met.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(visits.astype(np.int64))],
                        names=["model", "dim", "cell", "n", "visits"],
                    )
                    continue
                blobs = [raw[i].tobytes() for i in range(len(raw))]
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(rows)).combine_chunks(), pa.array([model] * len(rows)), pa.array(np.full(len(rows), dim, dtype=np.int32)), pa.array(cells.astype(np.int64)), pa.array(own), pa.array([blobs[i] for i in rows], pa.binary())],
                    names=["id", "model", "dim", "cell", "own", "unit"],
                )

    return stage


def _units(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=np.float32).reshape(-1, dim)


def _fit(cell: int, most: int):
    """Grouped Arrow stage: up to ``most`` centres, one for ``cell`` vectors, of the sampled vectors of one model or one cell; the column wanted says how many vectors there are in all."""

    def fit(table: pa.Table) -> pa.Table:
        dim, n = table["dim"][0].as_py(), table["wanted"][0].as_py()
        # The order in which rows arrive mustn't matter.
        x = np.unique(_normalised(table["vector"], dim) if "vector" in table.column_names else _units(table, dim).astype(np.float64), axis=0)
        centres = fit_centres(x, int(max(1, min(most, -(-n // cell), max(1, len(x) // 8)))))
        return pa.table({c: table[c].slice(0, 1) for c in ("model", "dim", "cell")} | {"centres": pa.array([centres.tobytes()], pa.binary())})

    return fit


def _split(most: int):
    """Cogrouped Arrow stage: a chunk of a large cell's rows with the cells that the cell is split into. A vector is stored in one; queries visit the nearest few."""

    def split(placed: pa.Table, fitted: pa.Table) -> pa.Table:
        if not placed.num_rows or not fitted.num_rows:
            return placed.drop_columns(["chunk"])
        dim = placed["dim"][0].as_py()
        centres = np.frombuffer(fitted["centres"][0].as_py(), dtype=np.float32).reshape(-1, dim)
        rows, cells, nearest = _visits(_units(placed, dim), centres)
        out = placed.drop_columns(["chunk"]).take(pa.array(rows))
        cell = pa.array((placed["cell"][0].as_py() + 1) * (most + 1) + cells)
        own = pa.array(np.asarray(placed["own"])[rows] & nearest)
        return out.set_column(out.column_names.index("cell"), "cell", cell).set_column(out.column_names.index("own"), "own", own)

    return split


def _cell_search(k: int):
    """Grouped Arrow stage: builds a cell's graph and answers the cell's queries."""

    def search(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        ids = np.asarray(table["id"])
        role = np.asarray(table["role"])  # 1: stored here, 2: query, 3: both
        x = _units(table, dim)
        # Smaller ids first, so ties keep them; equal rows are one.
        order = np.argsort(ids, kind="stable")
        ids, role, x = ids[order], role[order], x[order]
        stored = np.flatnonzero(role & 1)
        asking = np.flatnonzero(role & 2)
        stored = stored[np.concatenate([[True], ids[stored][1:] != ids[stored][:-1]])] if len(stored) else stored
        asking = asking[np.concatenate([[True], ids[asking][1:] != ids[asking][:-1]])] if len(asking) else asking
        out_q, out_n, out_s = [], [], []
        if len(stored) and len(asking):
            # Copies of a vector are one node; its k + 1 smallest ids stand for all of them in any top k.
            unique, inverse = np.unique(x[stored], axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
            by = np.argsort(inverse, kind="stable")
            starts = np.searchsorted(inverse[by], np.arange(len(unique)))
            counts = np.bincount(inverse, minlength=len(unique))
            graph = Graph(unique)
            lengths, unique_lengths = (np.linalg.norm(v.astype(np.float64), axis=1) for v in (x, unique))
            want = min(len(unique), k + 1)
            for lo in range(0, len(asking), 2048):
                rows = asking[lo : lo + 2048]
                beam = max(BEAM, want)
                found, sims = graph.search(np.ascontiguousarray(x[rows]), beam, beam)
                # All of the beam that single precision may have put in the wrong order is computed again.
                at, col = np.nonzero((found >= 0) & (sims >= sims[:, want - 1 : want] - 1e-5))
                node = found[at, col]
                again = np.full(found.shape, -np.inf)
                for part in range(0, len(at), 16_384):
                    one, n = rows[at[part : part + 16_384]], node[part : part + 16_384]
                    dots = np.einsum("ij,ij->i", x[one].astype(np.float64), unique[n].astype(np.float64))
                    # Units are kept in single precision: their true lengths undo its rounding.
                    again[at[part : part + 16_384], col[part : part + 16_384]] = dots / (lengths[one] * unique_lengths[n])
                # Ties go to the node with the smallest id.
                smallest = ids[stored[by[starts[np.maximum(found, 0)]]]]
                top = np.lexsort((smallest, -np.round(again, DIGITS)), axis=1)[:, :want]
                exact, found = np.take_along_axis(again, top, 1), np.take_along_axis(found, top, 1)
                found = np.where(np.isfinite(exact), found, -1)
                for r in range(k + 1):
                    # The r-th copy of each node.
                    has = (found >= 0) & (counts[np.maximum(found, 0)] > r)
                    if not has.any():
                        break
                    who, col = np.nonzero(has)
                    other = ids[stored[by[starts[found[who, col]] + r]]]
                    keep = other != ids[rows[who]]
                    out_q.append(ids[rows[who]][keep])
                    out_n.append(other[keep])
                    out_s.append(exact[who, col][keep])
        q, n, s = (np.concatenate(v) if v else np.zeros(0, dtype=t) for v, t in ((out_q, ids.dtype), (out_n, ids.dtype), (out_s, np.float64)))
        model = table["model"][0].as_py()
        return pa.table({"id": q, "model": pa.array([model] * len(q), pa.string()), "dim": pa.array(np.full(len(q), dim, dtype=np.int32)), "other": n, "cosine": s})

    return search


def nearest(df: DataFrame, k: int = 5, key: str = "symbol_id", model: str = "model", dim: str = "dim", vector: str = "vector", min_cosine: float | None = None) -> DataFrame:
    """(id, model, dim, other, cosine, rank): up to ``k`` most similar vectors of the same model and size for each usable vector.

    ``key`` must be an integer. Null, wrong-sized, non-finite and all-zero vectors don't count, repeated rows count once,
    ties go to the smaller id. With ``min_cosine`` less similar pairs are left out. An empty table gives no row.
    The search is approximate: measured recall is in the README.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    good = usable(df, key, model, dim, vector)
    sizes = {(r["model"], r["dim"]): r["n"] for r in good.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], f"id {kind}, model string, dim int, other {kind}, cosine double, rank int")
    # Copies, whatever their lengths, are one class, represented by its smallest id: a group of very many copies is one row of the graphs.
    # They are found by two hashes of the rounded unit vector, so only ids and hashes are shuffled; usually there are few.
    # A direction at the edge of a rounding gives a few classes, whose cosines tie.
    group = ["model", "dim"]
    hashed = cut_lineage(good.mapInArrow(_hash_units, f"id {kind}, model string, dim int, h1 long, h2 long"))
    several = hashed.groupBy(*group, "h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").drop("last")
    members = cut_lineage(hashed.join(several, [*group, "h1", "h2"]).select("rep", *group, "id").distinct())
    reps = good.join(members.filter("id <> rep").select("id", *group), ["id", *group], "left_anti")
    found = _class_pairs(reps.select("id", *group, "vector"), good, sizes, kind, k)
    if min_cosine is not None:
        found = found.filter(F.col("cosine") >= min_cosine)
    pairs = found.groupBy("id", *group, "other").agg(F.least(F.lit(1.0), F.max(F.round("cosine", DIGITS))).alias("cosine"))
    best = Window.partitionBy("id", *group).orderBy(F.desc("cosine"), "other")
    near = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    # The k + 1 smallest ids of each class: more can't be in anyone's top k.
    first = Window.partitionBy("rep", *group).orderBy("id")
    smallest = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    others = smallest.select(F.col("rep").alias("other"), *group, F.col("id").alias("copy"))
    spread = near.join(others, ["other", *group], "left").select("id", *group, F.coalesce("copy", "other").alias("other"), "cosine")
    own = smallest.select(F.col("rep").alias("id"), *group, F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    # A class's list is short: k neighbours of k + 1 copies at most, and its own. Each of its ids takes it without itself.
    entries = F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("c"), "other")))
    lists = spread.unionByName(own).groupBy("id", *group).agg(entries.alias("near"))
    # A class of very many ids is spread over salts.
    classes = members.filter("id = rep").select("id", *group, F.lit(True).alias("shared"))
    salted = lists.join(classes, ["id", *group], "left").withColumn("salt", F.explode(F.when(F.col("shared"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    owners = members.select(F.col("rep").alias("id"), *group, F.col("id").alias("member"), F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt"))
    mine = salted.join(owners, ["id", *group, "salt"], "left").filter("shared IS NULL OR member IS NOT NULL").select(F.coalesce("member", "id").alias("id"), *group, "near")
    mine = mine.select("id", *group, F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
    flat = mine.select("id", *group, F.posexplode("near").alias("at", "x"))
    return flat.select("id", *group, "x.other", (-F.col("x.c")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def _sampled(rows: DataFrame, share, salt: int) -> DataFrame:
    """A share of rows drawn by the hash of their id."""
    return rows.filter(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0 < share)


def search_groups(reps: DataFrame, good: DataFrame, sizes: dict[tuple[str, int], int], kind: str) -> DataFrame:
    """(id, model, dim, cell, part, chunk, role, unit): what each task of the search gets; role 1: stored there, 2: query, 3: both.

    A group of equal cell, part and chunk has about ``MAX_CELL`` stored rows and ``MAX_QUERIES`` queries at most.
    """
    group = ["model", "dim"]
    # Each model's bounded sample is fitted where it lies; only the centres come to the driver, a tenth of the samples in number at most.
    scale = min(1.0, ALL_SAMPLES / sum(min(n, SAMPLE) for n in sizes.values()))
    facts = {f"{m}\x00{d}": (scale * min(1.0, SAMPLE / n), n) for (m, d), n in sizes.items()}
    name = F.concat_ws("\x00", "model", F.col("dim").cast("string"))
    share = F.create_map(*[x for k, (v, _) in facts.items() for x in (F.lit(k), F.lit(v))])[name]
    wanted = F.create_map(*[x for k, (_, n) in facts.items() for x in (F.lit(k), F.lit(int(n)))])[name]
    drawn = _sampled(good.withColumn("cell", F.lit(0).cast("long")).withColumn("wanted", wanted), share, SEED)
    fitted_as = "model string, dim int, cell long, centres binary"
    fitted = drawn.groupBy(*group, "cell").applyInArrow(_fit(CELL, MAX_CENTRES), fitted_as).select(*group, "centres").collect()
    centres = {(r["model"], r["dim"]): np.frombuffer(bytes(r["centres"]), dtype=np.float32).reshape(-1, r["dim"]) for r in fitted}
    for m, d in sizes:  # a model of which no row was drawn is one cell
        centres.setdefault((m, d), np.eye(1, d, dtype=np.float32))
    schema = f"id {kind}, model string, dim int, cell long, own boolean, unit binary"
    # Counted over all rows, copies included: a bound. There are at most MAX_CENTRES cells a model.
    crowd = good.mapInArrow(_assign(centres, count=True), "model string, dim int, cell long, n long, visits long").groupBy(*group, "cell").agg(F.sum("n").alias("n"), F.sum("visits").alias("visits"))
    hot = (F.col("n") > MAX_CELL) | (F.col("visits") > MAX_QUERIES)
    placed = reps.mapInArrow(_assign(centres), schema)
    if not crowd.filter(hot).limit(1).count():
        return placed.select("id", *group, "cell", F.lit(0).alias("part"), F.lit(0).alias("chunk"), F.when(F.col("own"), 3).otherwise(2).alias("role"), "unit")
    placed = written(placed)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*group, "cell").agg(F.sum(F.col("own").cast("long")).alias("n"), F.count(F.lit(1)).alias("visits"))

    done, counts = None, counted(placed)
    for level in range(LEVELS):
        large = cut_lineage(counts.filter(F.col("n") > MAX_CELL))
        if not large.limit(1).count():
            break
        rows = placed.join(large, [*group, "cell"])
        drawn = _sampled(rows.filter("own").withColumn("wanted", F.col("n")), F.lit(float(SAMPLE)) / F.col("n"), SEED + level + 1)
        fitted = cut_lineage(drawn.select("id", *group, "cell", "wanted", "unit").groupBy(*group, "cell").applyInArrow(_fit(CELL, MAX_CENTRES), fitted_as))
        chunks = F.ceil(F.col("visits") / MAX_QUERIES).cast("int")
        left = rows.select("id", *group, "cell", "own", "unit", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))
        right = fitted.join(large, [*group, "cell"]).select(*group, "cell", "centres", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        keys = [*group, "cell", "chunk"]
        split = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_split(MAX_CENTRES), schema))
        small = placed.join(large.select(*group, "cell"), [*group, "cell"], "left_anti")
        done = small if done is None else done.unionByName(small)
        placed, counts = split, counted(split)
    placed = placed if done is None else done.unionByName(placed)
    # What is still too large is cut at random: stored rows into parts, queries into chunks.
    rows = placed.join(counted(placed).filter(hot), [*group, "cell"], "left")
    n_parts, n_chunks = (F.coalesce(F.ceil(F.col(c) / size), F.lit(1)).cast("int") for c, size in (("n", MAX_CELL), ("visits", MAX_QUERIES)))
    n_parts = F.greatest(n_parts, F.lit(1))
    home, mine = F.pmod(F.xxhash64("id"), n_parts).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), n_chunks).cast("int")

    def places(n, place) -> list:
        return F.transform(F.sequence(F.lit(0), n - 1), place)

    asking = places(n_parts, lambda p: F.struct(p.alias("part"), mine.alias("chunk")))
    stored = F.when(F.col("own"), places(n_chunks, lambda c: F.struct(home.alias("part"), c.alias("chunk")))).otherwise(F.array().cast("array<struct<part:int,chunk:int>>"))
    spread = rows.select("id", *group, "cell", "own", "unit", home.alias("home"), mine.alias("mine"), F.explode(F.array_union(asking, stored)).alias("x")).select("id", *group, "cell", "x.*", "own", "home", "mine", "unit")
    role = F.when(F.col("own") & (F.col("part") == F.col("home")), 1).otherwise(0) + F.when(F.col("chunk") == F.col("mine"), 2).otherwise(0)
    return spread.select("id", *group, "cell", "part", "chunk", role.alias("role"), "unit")


def _class_pairs(reps: DataFrame, good: DataFrame, sizes: dict[tuple[str, int], int], kind: str, k: int) -> DataFrame:
    """(id, model, dim, other, cosine): what the cells' graphs find among vectors of which no two are copies."""
    spread = search_groups(reps, good, sizes, kind)
    return spread.groupBy("model", "dim", "cell", "part", "chunk").applyInArrow(_cell_search(k), f"id {kind}, model string, dim int, other {kind}, cosine double")


def similar_pairs(df: DataFrame, k: int = 5, min_cosine: float = 0.85, **columns) -> DataFrame:
    """(id_a, id_b; id_a < id_b): pairs of which at least one is among the ``k`` most similar of the other."""
    near = nearest(df, k, min_cosine=min_cosine, **columns)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
