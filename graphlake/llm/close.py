"""Close vectors for every vector, where only cosines from a high floor on are wanted: cells around random directions.

A vector lives in the cell of the direction on which its projection is largest. Of a vector with cosine ``least`` to it the
projections are known up to noise, so how far below its largest projection the direction of that vector's cell lies has a
quantile, taken from a sample; a vector visits the cells above it. Both of a pair visit, so a pair is met from either side.

Visitors are rounded to half bytes, vectors at home to bytes; what may be close is verified over the vectors as given. A
vector that found k neighbours at home visits in bytes, with its k-th cosine as the floor.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm.neighbors import CELL, Index, Tree, _Best, _unit, chi_square_quantile
from graphlake.session import cut_lineage

#: The least cosine from which on this search is used.
CLOSE = 0.85
#: Vectors of a cell, cells at most, blocks of cells that there may be before they are as large as a task holds, and vectors of such a block.
SMALL, CELLS, BLOCKS, HELD = 512, 16_384, 16, 1_048_576
#: Vectors that a task searches at home, and vectors for which a block's visitors are one task more.
HOME, VISITORS = 65_536, 8_388_608
#: Vectors of the sample, by how much a cosine between bytes may be wrong, and that between half bytes in standard deviations.
SAMPLE, WRONG, DEVIATIONS = 16_384, 0.01, 4.5
#: Visits that are gathered before they are made.
GATHERED = 2_097_152

_FLOW = "place int, kind string, data binary"


def _bytes(unit: np.ndarray, most: int = 127) -> np.ndarray:
    return np.round(unit * (most / np.abs(unit).max(1, keepdims=True))).astype(np.int8)


def _halved(small: np.ndarray) -> np.ndarray:
    """Two numbers from -7 to 7 in a byte."""
    even = np.pad(small, ((0, 0), (0, small.shape[1] % 2))).view(np.uint8)
    return even[:, ::2] << 4 | even[:, 1::2] & 15


def _whole(halved: np.ndarray, dimensions: int) -> np.ndarray:
    both = np.stack([halved.view(np.int8) >> 4, (halved << 4).view(np.int8) >> 4], 2)
    return both.reshape(len(halved), -1)[:, :dimensions]


def _exact(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cosines, line by line, of vectors as given."""
    m, n = m.astype(np.float64), n.astype(np.float64)
    m, n = m / np.abs(m).max(1, keepdims=True, initial=1e-300), n / np.abs(n).max(1, keepdims=True, initial=1e-300)
    return np.einsum("ij,ij->i", m, n) / (np.linalg.norm(m, axis=1) * np.linalg.norm(n, axis=1))


def _at_home(full: np.ndarray, unit: np.ndarray, ids: np.ndarray, best: _Best) -> None:
    """All pairs of a cell."""
    k = best.cosine.shape[1]
    for a in range(0, len(ids), 512):
        rough = unit[a : a + 512] @ unit.T
        floor = np.full(len(rough), best.least)
        if len(ids) > k + 1:  # the vector itself is among them
            floor = np.maximum(floor, np.partition(rough, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])
        x, y = np.nonzero(rough >= floor[:, None] - 1e-4)
        x += a
        x, y = x[x != y], y[x != y]
        for c in range(0, len(x), 200_000):
            u, v = x[c : c + 200_000], y[c : c + 200_000]
            cosine = _exact(full[u], full[v])
            good = cosine >= best.least
            best.add(u[good], np.round(cosine[good], 12), ids[v[good]])


class _Block:
    """Vectors of a block of cells, and visits to them."""

    def __init__(self, k: int):
        self.k = k
        self.cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.waiting: list[tuple] = []
        self.visitors = 0

    def wait(self, visitors: tuple) -> bool:
        """Whether enough wait."""
        self.waiting.append(visitors)
        self.visitors += len(visitors[-1])
        return self.visitors >= GATHERED

    def visits(self) -> Iterator[pd.DataFrame]:
        waiting, self.waiting, self.visitors = self.waiting, [], 0
        if not waiting:
            return
        ids, small, floor, counts, cells = (np.concatenate(x) for x in zip(*waiting, strict=True))
        who = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(cells, kind="stable")
        who, cells = who[order], cells[order]
        begins = np.flatnonzero(np.diff(cells.astype(np.int64), prepend=-1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(begins, np.append(begins[1:], len(cells)), strict=True):
            if int(cells[a]) not in self.cells:  # an empty one
                continue
            own, at_home = self.cells[int(cells[a])]
            unit = _unit(at_home)
            step = max(16, 131_072 // len(own))
            for c in range(a, b, step):
                rows = who[c : min(b, c + step)]
                x, y = self._near(_unit(small[rows]), floor[rows], unit)
                if len(x):
                    found.append((ids[rows[x]], own[y]))
            if sum(len(x) for x, _ in found) >= 500_000:
                yield _told(found)
                found = []
        if found:
            yield _told(found)

    def _near(self, visitors: np.ndarray, floor: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rough = visitors @ own.T
        rough -= (floor - np.float32(WRONG))[:, None]
        if rough.max() < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y = np.divmod(np.flatnonzero(rough >= 0), len(own))
        if len(x) > 4 * self.k * len(visitors) and len(own) > self.k:
            kth = np.partition(rough, len(own) - self.k, axis=1)[:, len(own) - self.k]
            x, y = np.nonzero(rough >= np.maximum(0, kth - 2 * WRONG)[:, None])
        return x, y


def _told(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    id_, other = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"id": id_, "other": other, "cosine": np.nan})


def close_neighbors(vectors: DataFrame, k: int, dimensions: int, least: float, confidence: float = 0.98, seed: int = 7) -> DataFrame:
    """(id, other, cosine): up to k most similar vectors of each, with cosine >= least, among the distinct ones of vectors (id long, vector array<float>).

    Each of a pair visits the other's cell with probability ``confidence``, or finds it at home. Ties go to the smaller id.
    There are at most CELLS cells; of 8,192 a vector meets about a sixtieth of all vectors.
    A vector goes to at most max(BLOCKS, n / HELD) blocks, in half a byte for each dimension, twelve bytes and two for each cell.
    """
    n = vectors.select("id").distinct().count()
    step = max(1, n // SAMPLE)
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).dropDuplicates(["id"]).select("vector").limit(2 * SAMPLE).toArrow()
    sample = np.unique(_unit(picked["vector"].to_numpy()), axis=0) if picked.num_rows else np.zeros((0, dimensions), np.float32)
    rng = np.random.default_rng(seed)
    sample = sample[rng.permutation(len(sample))]
    count = 2 ** max(0, math.floor(math.log2(min(CELLS, max(1, n // SMALL))))) if len(sample) > 1 else 1
    blocks = min(count, max(BLOCKS, 2 ** math.ceil(math.log2(max(1, n / HELD)))))
    homes, parts = min(count, max(blocks, -(-n // HOME))), -(-n // VISITORS) or 1
    directions = _unit(rng.standard_normal((count, dimensions)))
    directions = directions[np.argsort(Tree(directions, int(math.log2(blocks))).cell(directions), kind="stable")]  # a block's are near to each other
    mean = sample.mean(0) if len(sample) else np.zeros(dimensions, np.float32)
    margin = _margin(sample, mean, directions, least, confidence, rng) if count > 1 else 0.0
    wide = math.sqrt(1 - least * least) / least

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 2048):
                some = b.iloc[a : a + 2048]
                raw = np.stack(some["vector"]).astype(np.float32) + np.float32(0)  # no -0.0, which has the hash of 0.0
                cell = ((_unit(raw) - mean) @ directions.T).argmax(1)
                flow = pd.DataFrame({"place": cell * homes // count, "cell": cell, "id": some["id"].to_numpy(), "vector": [v.tobytes() for v in raw]})
                yield flow.drop_duplicates(["id", "vector"])  # so that a vector that many share goes a few times

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for b in batches:
            for cell, rows in b.groupby("cell"):
                held.setdefault(int(cell), []).append(rows[["id", "vector"]])
        for cell in list(held):
            b = pd.concat(held.pop(cell)).sort_values("id", kind="stable")
            again = b["id"].to_numpy()[1:] == b["id"].to_numpy()[:-1]
            if (again & (b["vector"].to_numpy()[1:] != b["vector"].to_numpy()[:-1])).any():
                raise ValueError("two vectors share a hash")
            b = b[np.concatenate([[True], ~again])]
            ids, full = b["id"].to_numpy(np.int64), np.frombuffer(b"".join(b["vector"]), np.float32).reshape(len(b), dimensions)
            unit = _unit(full)
            best = _Best(len(ids), k, least)
            if len(ids) > CELL:  # many vectors in one direction
                flat = unit @ np.random.default_rng(seed).standard_normal((dimensions, 12)).astype(np.float32)
                Index(unit, flat, ids, full).search(unit, flat, ids, best, chi_square_quantile(12, confidence), full)
            else:
                _at_home(full, unit, ids, best)
            kth = best.cosine.min(1)
            row, col = np.nonzero(best.cosine >= -1.5)
            block = cell * blocks // count
            yield row_of(block * parts + cell % parts, "r", (ids[row], best.other[row, col], best.cosine[row, col]))
            if count == 1:
                continue
            small, half = _bytes(unit), _bytes(unit, 7)
            for part in range(parts):
                yield row_of(block * parts + part, "p", (cell, ids, small))
            served, floor = kth >= least, np.maximum(kth, least)
            # a half-byte vector is at an angle to its own; its error beside that lies anyhow to a close one
            along = (_unit(half) * unit).sum(1)
            rough = least * along - least * wide * DEVIATIONS * np.sqrt(np.maximum(0, 1 - along * along) / (dimensions / 2))
            halves, rough = _halved(half), np.where(served, floor, rough).astype(np.float32)
            near = margin * np.sqrt(np.maximum(0, 1 - floor * floor)) / floor / wide + 1e-5
            for a in range(0, len(ids), 1024):
                score = (unit[a : a + 1024] - mean) @ directions.T
                hit = score >= (score.max(1) - near[a : a + 1024])[:, None]
                hit[:, cell] = False
                row, to = np.nonzero(hit)
                row += a
                for kind, chosen, what in (("q", served, small), ("s", ~served, halves)):
                    some = chosen[row]
                    r, c = row[some], to[some]
                    at = c * blocks // count
                    for x in np.unique(at):
                        who, counts = np.unique(r[at == x], return_counts=True)
                        yield row_of(int(x) * parts + cell % parts, kind, (ids[who], what[who], rough[who], counts.astype(np.uint16), c[at == x].astype(np.uint16)))

    def row_of(place: int, kind: str, data: tuple) -> pd.DataFrame:
        return pd.DataFrame({"place": [place], "kind": [kind], "data": [pickle.dumps(data, 5)]})

    def beyond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come by place, a block's vectors before its visitors
        here, block = -1, _Block(k)
        for b in batches:
            for place, kind, data in zip(b["place"], b["kind"], b["data"], strict=True):
                if place != here:
                    yield from block.visits()
                    here, block = place, _Block(k)
                data = pickle.loads(data)
                if kind == "r":
                    yield pd.DataFrame(dict(zip(("id", "other", "cosine"), data, strict=True)))
                elif kind == "p":
                    block.cells[data[0]] = data[1:]
                elif block.wait(data if kind == "q" else (data[0], _whole(data[1], dimensions), *data[2:])):
                    yield from block.visits()
        yield from block.visits()

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cosine = _exact(np.stack(b["v"]).astype(np.float32), np.stack(b["w"]).astype(np.float32))
                good = cosine >= least
                yield pd.DataFrame({"a": b["a"].to_numpy()[good], "b": b["b"].to_numpy()[good], "cosine": np.round(cosine[good], 12)})

    assigned = vectors.mapInPandas(assign, "place int, cell int, id long, vector binary").repartitionById(homes, F.col("place"))
    flow = assigned.mapInPandas(own, _FLOW).repartitionById(blocks * parts, F.col("place")).sortWithinPartitions("place", "kind")
    found = cut_lineage(flow.mapInPandas(beyond, "id long, other long, cosine double"))
    pairs = found.where("cosine is null and id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    clash = F.raise_error(F.lit("two vectors share a hash"))
    one = vectors.groupBy("id").agg(F.min("vector").alias("vector"), F.max("vector").alias("same")).select("id", F.when(F.col("vector") == F.col("same"), F.col("vector")).otherwise(clash).alias("vector"))
    pairs = pairs.join(one.select(F.col("id").alias("a"), F.col("vector").alias("v")), "a").join(one.select(F.col("id").alias("b"), F.col("vector").alias("w")), "b")
    near = pairs.mapInPandas(verified, "a long, b long, cosine double").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "cosine"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "cosine"))).alias("x")).select("x.*")
    links = found.where("cosine is not null").unionByName(near).groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return links.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= k).select("id", "other", "cosine")


def _margin(sample: np.ndarray, mean: np.ndarray, directions: np.ndarray, least: float, confidence: float, rng: np.random.Generator) -> float:
    """How far below a vector's largest projection that of the cell of a vector with cosine least lies, with that probability; noise like the data's or even, whichever is farther."""
    x = sample[rng.integers(0, len(sample), 4096)]
    quantiles = []
    for noise in (sample[rng.integers(0, len(sample), len(x))] + np.float32(1e-3) * rng.standard_normal(x.shape).astype(np.float32), rng.standard_normal(x.shape).astype(np.float32)):
        noise = noise - (noise * x).sum(1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        gap = []
        for a in range(0, len(x), 512):
            mine = (x[a : a + 512] - mean) @ directions.T
            theirs = (least * x[a : a + 512] + math.sqrt(1 - least * least) * noise[a : a + 512] - mean) @ directions.T
            gap.append(mine.max(1) - np.take_along_axis(mine, theirs.argmax(1)[:, None], 1)[:, 0])
        quantiles.append(float(np.quantile(np.concatenate(gap), confidence)))
    return max(quantiles)
