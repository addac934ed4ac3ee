"""Most similar vectors for every vector: stable low-dimensional projections under a kd-tree, with a chi-square stopping test.

Of unit vectors x, y, the squared distance of their Gaussian projections to m dimensions is |x - y|^2 times a
chi-square variable of m degrees of freedom. So with q the quantile of that distribution at ``confidence``, a
vector nearer than d lies within sqrt(q) * d in the projection, with that probability. Search visits kd-tree
cells and leaves in order of their projected distance, verifies what it meets there, and stops once the
next one lies beyond sqrt(q) times the k-th best true distance found so far (or the distance limit).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.session import cut_lineage

#: Projected dimensions (even), about how many vectors the upper kd-tree is fitted on (at most twice as many), and of these in a cell at least.
PROJECTED, SAMPLE, PER_CELL = 12, 32_768, 8
#: Vectors of a cell, in which a vector is searched for first, and of a leaf inside.
CELL, LEAF = 16_384, 256
#: Vectors of a block of neighbouring cells, which a task holds, blocks that there may be before they are that large, and visitors of a block in a task.
HELD, BLOCKS, VISITORS = 262_144, 16, 4_194_304
#: Queries that a task searches for at once, and that are broadcast at once.
BLOCK, QUERIES = 512, 4096


def chi_square_quantile(m: int, p: float) -> float:
    """Quantile of the chi-square distribution with an even number m of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        if 1 - math.exp(-x / 2) * total < p:
            low = x
        else:
            high = x
    return high


class Tree:
    """Median splits of the widest dimension; numbers a point's cell and bounds each cell by a box."""

    def __init__(self, points: np.ndarray, depth: int):
        m = points.shape[1]
        self.depth = depth
        self.axis, self.at = np.zeros(2**depth, np.int64), np.zeros(2**depth, np.float32)
        low, high = np.full((2 ** (depth + 1), m), -np.inf, np.float32), np.full((2 ** (depth + 1), m), np.inf, np.float32)
        member = {1: points}
        for node in range(1, 2**depth):
            own = member.pop(node)
            spread = own.max(0) - own.min(0) if len(own) else np.zeros(m)
            a = int(np.argmax(spread))
            c = float(np.median(own[:, a])) if len(own) else 0.0
            self.axis[node], self.at[node] = a, c
            right = own[:, a] >= self.at[node]
            member[2 * node], member[2 * node + 1] = own[~right], own[right]
            for child in (2 * node, 2 * node + 1):
                low[child], high[child] = low[node], high[node]
            high[2 * node, a] = low[2 * node + 1, a] = c
        self.low, self.high = low[2**depth :], high[2**depth :]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        row = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[row, self.axis[node]] >= self.at[node])
        return node - 2**self.depth


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(points), len(low)), np.float32)
    for j in range(points.shape[1]):
        p = points[:, j : j + 1]
        d = np.maximum(0, np.maximum(low[:, j] - p, p - high[:, j]))
        out += d * d
    return out


class _Best:
    """The k best neighbours so far of each query."""

    def __init__(self, n: int, k: int, least: float):
        self.cosine, self.other = np.full((n, k), -2.0), np.zeros((n, k), np.int64)
        self.least = least

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """Squared distance that a further neighbour must stay below."""
        return 2 - 2 * np.clip(self.floors(rows), -1, 1)

    def floors(self, rows: np.ndarray) -> np.ndarray:
        """Cosine below which nothing is wanted; under -1 while fewer than k are known and all are wanted."""
        kth = self.cosine[rows].min(1)
        return np.maximum(kth, self.least) if self.least > -1 else kth

    def add(self, row: np.ndarray, cosine: np.ndarray, other: np.ndarray) -> None:
        if not len(row):
            return
        order = np.lexsort((other, -cosine, row))
        row, cosine, other = row[order], cosine[order], other[order]
        k = self.cosine.shape[1]
        begin = np.searchsorted(row, row)
        place = np.arange(len(row)) - begin
        ok = place < k
        row, cosine, other, place = row[ok], cosine[ok], other[ok], place[ok]
        touched, index = np.unique(row, return_inverse=True)
        more, names = np.full((len(touched), k), -2.0), np.zeros((len(touched), k), np.int64)
        more[index, place], names[index, place] = cosine, other
        c, o = np.concatenate([self.cosine[touched], more], 1), np.concatenate([self.other[touched], names], 1)
        top = np.lexsort((o, -c), axis=1)[:, :k]
        self.cosine[touched], self.other[touched] = np.take_along_axis(c, top, 1), np.take_along_axis(o, top, 1)


class Index:
    """Vectors of a cell under a kd-tree of leaves."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, ids: np.ndarray, full: np.ndarray | None = None, cells: np.ndarray | None = None):
        depth = max(0, math.ceil(math.log2(max(1, len(vectors)) / LEAF)))
        leaf = Tree(projected, depth).cell(projected)
        order = np.argsort(leaf, kind="stable")
        self.vectors, self.projected, self.ids = vectors[order], projected[order], ids[order]
        self.full = self.vectors if full is None else full[order]
        self.cells = None if cells is None else cells[order]
        begins = np.flatnonzero(np.concatenate([[True], np.diff(leaf[order]) > 0])) if len(order) else np.zeros(0, np.int64)
        self.begins = np.append(begins, len(order))
        self.low = np.array([self.projected[a:b].min(0) for a, b in zip(self.begins[:-1], self.begins[1:], strict=True)]).reshape(-1, projected.shape[1])
        self.high = np.array([self.projected[a:b].max(0) for a, b in zip(self.begins[:-1], self.begins[1:], strict=True)]).reshape(-1, projected.shape[1])

    def search(self, vectors: np.ndarray, projected: np.ndarray, ids: np.ndarray, best: _Best, quantile: float, full: np.ndarray | None = None, cells: np.ndarray | None = None) -> None:
        """Adds neighbours to best: for blocks of queries, leaves nearest first in growing waves, until the stopping test holds for all.

        ``full`` and the index's own are the vectors in full precision, for the cosines that count. With ``cells`` (and the
        index's own) a query passes over the points of its cell.
        """
        full = vectors if full is None else full
        leaves = len(self.low)
        if not leaves:
            return
        place = np.argsort(gaps(projected, self.low, self.high).argmin(1), kind="stable") if leaves > 1 else np.arange(len(projected))
        for a in range(0, len(place), BLOCK):
            rows = place[a : a + BLOCK]
            gap = gaps(projected[rows], self.low, self.high)
            order = np.argsort(gap.min(0), kind="stable")
            done, wave = 0, 1
            while done < leaves:
                now = order[done : done + wave]
                done += len(now)
                wave = min(4 * wave, 64)
                near = gap[:, now] <= quantile * best.reach(rows)[:, None]
                now = now[near.any(0)]
                active = rows[near.any(1)]
                if not len(active):
                    continue
                at = np.concatenate([np.arange(self.begins[x], self.begins[x + 1]) for x in now])
                self._verify(vectors, projected, full, ids, cells, active, at, best, quantile)

    def _verify(self, vectors, projected, full, ids, cells, active: np.ndarray, at: np.ndarray, best: _Best, quantile: float) -> None:
        """Adds what is good enough of the points at hand; few are when the radius is small, else all are multiplied at once."""
        reach, floor = best.reach(active), best.floors(active)
        if quantile * np.median(reach) < PROJECTED:
            q, p = projected[active], self.projected[at]
            far = (q * q).sum(1)[:, None] + (p * p).sum(1) - 2 * (q @ p.T)
            x, y = np.nonzero(far <= quantile * reach[:, None])
            rough = np.concatenate([np.zeros(0, np.float32), *[np.einsum("ij,ij->i", vectors[active[x[c : c + 200_000]]], self.vectors[at[y[c : c + 200_000]]]) for c in range(0, len(x), 200_000)]])
            keep = rough >= floor[x] - 1e-4
            x, y = x[keep], y[keep]
        else:
            rough = vectors[active] @ self.vectors[at].T
            k = best.cosine.shape[1]
            if len(at) > k + 1 and (floor < -1).any():
                # nothing found yet: only the best here can stay (one may be the query itself)
                floor = np.maximum(floor, np.partition(rough, len(at) - k - 1, axis=1)[:, len(at) - k - 1])
            x, y = np.nonzero(rough >= floor[:, None] - 1e-4)
        s, t = active[x], at[y]
        other = ids[s] != self.ids[t] if cells is None else cells[s] != self.cells[t]
        for c in range(0, len(s), 200_000):
            u, v = s[c : c + 200_000][other[c : c + 200_000]], t[c : c + 200_000][other[c : c + 200_000]]
            m, n = full[u].astype(np.float64), self.full[v].astype(np.float64)
            m, n = m / np.abs(m).max(1, keepdims=True, initial=1e-300), n / np.abs(n).max(1, keepdims=True, initial=1e-300)
            exact = np.einsum("ij,ij->i", m, n) / (np.linalg.norm(m, axis=1) * np.linalg.norm(n, axis=1))
            good = exact >= best.least
            best.add(u[good], np.round(exact[good], 12), self.ids[v[good]])


def _unit(rows) -> np.ndarray:
    v = np.array(rows, np.float64) if isinstance(rows, np.ndarray) and rows.ndim == 2 else np.stack([np.asarray(r, np.float64) for r in rows])
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def usable(vector, dimensions: int):
    """Whether a vector column has the right number of finite values that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


#: A point, a visitor (cell: where it is at home, cosine: the least it wants) or a result (cell: the neighbour).
_FLOW = "place int, kind string, id long, cell long, cosine double, vector binary"


def vector_neighbors(vectors: DataFrame, k: int, dimensions: int, least: float = -1.0, confidence: float = 0.98, seed: int = 7) -> DataFrame:
    """(id, other, cosine): up to k most similar vectors of each, with cosine >= least, among distinct vectors (id long, vector array<float>).

    The upper kd-tree is fitted on at most 2 * SAMPLE vectors, every vector is indexed. A vector is first searched
    for in its own cell; then it visits just those blocks of cells that its stopping test cannot rule out. Each true neighbour
    is met with probability ``confidence`` at least. Ties go to the smaller id.

    Where no neighbour is close nothing is ruled out, and every vector visits every block: so blocks are as large as a task can hold, a vector is
    copied to at most max(BLOCKS, n / HELD) of them (twice that by rounding), and a block's visitors are split over as many tasks as they need.
    """
    n = vectors.count()
    step = max(1, n // SAMPLE)
    matrix = _projection(dimensions, seed)
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("vector").limit(2 * SAMPLE).toArrow()
    points = _unit(sample["vector"].to_numpy()) @ matrix if sample.num_rows else np.zeros((0, PROJECTED), np.float32)
    halvings = lambda size: max(0, math.ceil(math.log2(max(1, n) / size)))
    tree = Tree(points, min(halvings(CELL) if len(points) else 0, max(0, int(math.log2(max(1, len(points) / PER_CELL))))))
    quantile = chi_square_quantile(PROJECTED, confidence)
    cells = 2**tree.depth
    blocks = 2 ** min(tree.depth, max(int(math.log2(BLOCKS)), halvings(HELD)))
    each = cells // blocks
    low, high = tree.low.reshape(blocks, each, -1).min(1), tree.high.reshape(blocks, each, -1).max(1)
    parts = -(-n // VISITORS) or 1

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = np.stack(b["vector"]).astype(np.float32)
                yield pd.DataFrame({"place": tree.cell(_unit(raw) @ matrix), "kind": "p", "id": b["id"].to_numpy(), "cell": 0, "cosine": 0.0, "vector": [v.tobytes() for v in raw]})

    def load(rows: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b = pd.concat(rows) if rows else pd.DataFrame({"id": [], "vector": [], "cell": []})
        raw = np.frombuffer(b"".join(b["vector"]), np.float32).reshape(len(b), dimensions)
        unit = _unit(raw) if len(raw) else raw
        return unit, unit @ matrix, b["id"].to_numpy(np.int64), raw, b["cell"].to_numpy(np.int64)

    def results(best: _Best, ids: np.ndarray) -> pd.DataFrame:
        row, col = np.nonzero(best.cosine >= -1.5)
        return pd.DataFrame({"place": row % (blocks * parts), "kind": "r", "id": ids[row], "cell": best.other[row, col], "cosine": best.cosine[row, col], "vector": None})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for b in batches:
            for cell, rows in b.groupby("place"):
                held.setdefault(int(cell), []).append(rows[["id", "vector", "cell"]])
        for cell, rows in held.items():
            unit, projected, ids, full, _ = load(rows)
            best = _Best(len(ids), k, least)
            Index(unit, projected, ids, full).search(unit, projected, ids, best, quantile, full)
            yield results(best, ids)
            raw = [v.tobytes() for v in full]
            block = cell // each
            for part in range(parts):
                yield pd.DataFrame({"place": block * parts + part, "kind": "p", "id": ids, "cell": cell, "cosine": 0.0, "vector": raw})
            reach = quantile * best.reach(np.arange(len(ids)))
            floor = best.floors(np.arange(len(ids)))
            for a in range(0, len(ids), 2048):
                far = gaps(projected[a : a + 2048], low, high)
                row, to = np.nonzero(far <= reach[a : a + 2048, None])
                if each == 1:  # the block is the cell itself
                    row, to = row[to != block], to[to != block]
                row = row + a
                yield pd.DataFrame({"place": to * parts + ids[row] % parts, "kind": "q", "id": ids[row], "cell": cell, "cosine": floor[row], "vector": [raw[r] for r in row]})

    def beyond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come by place, a block's points before its visitors: the points are held, the visitors pass by in batches
        here, rows, index = -1, [], None
        for b in batches:
            if (told := b["kind"] == "r").any():
                yield b.loc[told, ["id", "cell", "cosine"]].rename(columns={"cell": "other"})
            for (place, kind), some in b[~told].groupby(["place", "kind"], sort=True):
                if place != here:
                    here, rows, index = place, [], None
                if kind == "p":
                    rows.append(some[["id", "vector", "cell"]])
                    continue
                if index is None:
                    index = Index(*load(rows))
                    rows = []
                unit, projected, ids, full, from_ = load([some])
                best = _Floored(_Best(len(ids), k, least), some["cosine"].to_numpy())
                index.search(unit, projected, ids, best, quantile, full, from_)
                yield results(best, ids)[["id", "cell", "cosine"]].rename(columns={"cell": "other"})

    assigned = vectors.mapInPandas(assign, _FLOW).repartitionById(cells, F.col("place"))
    flow = assigned.mapInPandas(own, _FLOW).repartitionById(blocks * parts, F.col("place")).sortWithinPartitions("place", "kind")
    found = flow.mapInPandas(beyond, "id long, other long, cosine double")
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= k).select("id", "other", "cosine")


class _Floored(_Best):
    """Best neighbours with, for each query, a cosine below which nothing is wanted."""

    def __init__(self, best: _Best, floor: np.ndarray):
        self.cosine, self.other, self.least, self.floor = best.cosine, best.other, best.least, floor

    def floors(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(super().floors(rows), self.floor[rows])


def _projection(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, PROJECTED)).astype(np.float32)


def nearest_nodes(points: DataFrame, k: int = 5, dimensions: int = 64, least: float = -1.0, confidence: float = 0.98) -> DataFrame:
    """(node_id, other, cosine, rank): the k points most similar to each, of points (node_id, dense) with a usable vector.

    Node ids must be unique. Points with the same vector are searched for once, through that vector; ties go to the smaller
    node_id, so only the k + 1 smallest ids of a vector can be anyone's neighbours and a vector that a third of all
    points share costs no more than another. Unusable vectors (null, wrong length, not finite, all zero) take no part.
    """
    from graphlake.llm import close  # which builds on this module

    good = points.select(F.col("node_id").cast("string").alias("node_id"), F.col("dense").cast("array<float>").alias("dense")).where("node_id is not null").where(usable(F.col("dense"), dimensions))
    keyed = cut_lineage(good.select(F.xxhash64("dense").alias("id"), "node_id", F.col("dense").alias("vector")))
    if least >= close.CLOSE:
        links = close.close_neighbors(keyed.select("id", "vector"), k, dimensions, least, confidence)
    else:
        clash = F.raise_error(F.lit("two vectors share a hash"))
        distinct = keyed.groupBy("id").agg(F.min("vector").alias("vector"), F.max("vector").alias("same")).select("id", F.when(F.col("vector") == F.col("same"), F.col("vector")).otherwise(clash).alias("vector"))
        links = vector_neighbors(distinct, k, dimensions, least, confidence)
    itself = keyed.select("id").distinct().select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("id").orderBy("node_id")
    names = keyed.select("id", "node_id").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k + 1)
    near = links.unionByName(itself).join(names.select(F.col("id").alias("other"), F.col("node_id").alias("name")), "other")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "name")
    near = near.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k + 1)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__r", "name", "cosine"))).alias("near"))  # k + 1 entries
    own = keyed.select("id", "node_id").join(lists, "id")
    others = F.slice(F.filter("near", lambda x: x["name"] != F.col("node_id")), 1, k)
    return own.select("node_id", F.posexplode(others).alias("rank", "n")).select("node_id", F.col("n.name").alias("other"), F.col("n.cosine").alias("cosine"), (F.col("rank") + 1).alias("rank"))


def nearest_of(queries: DataFrame, points: DataFrame, k: int = 5, dimensions: int = 64, confidence: float = 0.999, seed: int = 7) -> DataFrame:
    """(node_id, other, cosine, rank): the k points most similar to each query, of queries (node_id) among points (node_id, dense), however far.

    For a stated query set: queries are broadcast QUERIES at a time, and no point moves. Each task puts CELL points at a time
    under a kd-tree of their projections and verifies the leaves in order of projected distance until the stopping test
    holds against the k-th cosine the task knows; k rows per query and task meet in the end. Each true neighbour is found with probability
    ``confidence`` at least. Cosines are rounded to twelve decimals before ranking, ties go to the smaller node_id; unusable
    vectors take no part. Node ids of points must be unique.
    """
    good = points.select(F.col("node_id").cast("string").alias("node_id"), F.col("dense").cast("array<float>").alias("dense")).where("node_id is not null").where(usable(F.col("dense"), dimensions))
    asked = good.join(queries.select("node_id").distinct(), "node_id", "left_semi")
    quantile = chi_square_quantile(PROJECTED, confidence)
    schema = "node_id string, other string, cosine double"

    def prepared(rows) -> tuple[np.ndarray, np.ndarray]:
        full = np.stack([np.asarray(v, np.float64) for v in rows])
        return full / np.abs(full).max(1, keepdims=True), _unit(rows)

    def search(rows: list) -> DataFrame:
        names = np.array([r["node_id"] for r in rows], object)
        full, unit = prepared([r["dense"] for r in rows])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matrix = _projection(dimensions, seed)
            projected = unit @ matrix
            floor = np.full(len(names), -2.0)
            held: list[pd.DataFrame] = []

            def settle() -> pd.DataFrame:
                block = pd.concat(held).sort_values("node_id", ignore_index=True)
                held.clear()
                ids = block["node_id"].to_numpy(object)
                place = {n: i for i, n in enumerate(ids)}
                own_full, own_unit = prepared(block["dense"])
                index = Index(own_unit, own_unit @ matrix, np.arange(len(ids)), own_full)
                best = _Floored(_Best(len(names), k, -1.0), floor)
                index.search(unit, projected, np.array([place.get(n, -1) for n in names]), best, quantile, full)
                row, col = np.nonzero(best.cosine >= -1.5)
                floor[:] = np.maximum(floor, best.cosine.min(1))
                return pd.DataFrame({"node_id": names[row], "other": ids[best.other[row, col]], "cosine": best.cosine[row, col]})

            for b in batches:
                held.append(b)
                if sum(map(len, held)) >= CELL:
                    yield settle()
            if sum(map(len, held)):
                yield settle()

        return good.mapInPandas(run, schema)

    found, block = None, []
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block:
        found = search(block) if found is None else found.unionByName(search(block))
    if found is None:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
