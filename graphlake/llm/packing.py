"""Filling fixed-capacity containers: non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.session import cut_lineage

#: A token is a longest run of letters, numbers and underscores, or of other characters that are not white space.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def shallow_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of at most three of the lengths that fill the window, which is the capacity, exactly; rows of three, 0 = none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    rows = []
    if there[capacity]:
        rows.append(np.array([[capacity, 0, 0]]))
    a = lengths[(lengths * 2 <= capacity)]
    b = capacity - a
    ok = (b >= a) & there[b]
    rows.append(np.stack([b[ok], a[ok], np.zeros(ok.sum(), a.dtype)], 1))
    for small in lengths[lengths * 3 <= capacity]:
        mid = lengths[(lengths >= small) & (lengths * 2 <= capacity - small)]
        top = capacity - small - mid
        ok = there[top]
        rows.append(np.stack([top[ok], mid[ok], np.full(ok.sum(), small)], 1))
    return np.concatenate(rows).astype(np.int64)


def nonnegative_least_squares(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A having the pattern's lengths; accelerated projected gradient."""
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    used = (patterns > 0).astype(float)
    scale = 1 / np.sqrt(np.maximum(histogram, 1.0))  # relative residuals, so that rare lengths count

    def times(x):
        out = np.zeros(size)
        for j in range(3):
            out += np.bincount(patterns[:, j], x * used[:, j], size)
        return out * scale

    def back(r):
        r = r * scale
        return sum(r[patterns[:, j]] * used[:, j] for j in range(3))

    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(times(v))
        v /= np.linalg.norm(v) or 1
    rate = 1 / (1.05 * np.linalg.norm(back(times(v))) or 1)
    goal = histogram * scale
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(times(y) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_containers(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of containers that hold every item of the histogram (index = length, 1..capacity).

    The solved repeat counts are rounded, then lowered to what is left of each length; the residual is
    packed greedily, longest first, each into the fullest container with room, in bulk per length.
    """
    left = np.asarray(histogram, np.int64).copy()
    left[0] = 0
    patterns = shallow_patterns(np.flatnonzero(left), capacity)
    solved = nonnegative_least_squares(patterns, left.astype(float))
    plan: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-solved, kind="stable"):
        if solved[i] < 0.5:
            break
        lengths = tuple(int(v) for v in patterns[i] if v)
        times = {v: lengths.count(v) for v in lengths}
        repeats = min(round(float(solved[i])), *(int(left[v]) // m for v, m in times.items()))
        if repeats > 0:
            plan.append((lengths, repeats))
            for v, m in times.items():
                left[v] -= repeats * m
    rooms: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        for room in sorted(r for r in rooms if r >= length):
            while todo and room in rooms:
                lengths, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                fits = room // length
                full = min(count, todo // fits)
                if full:
                    rooms.setdefault(room - fits * length, []).append([lengths + (length,) * fits, full])
                    todo -= full * fits
                    count -= full
                if count and 0 < todo < fits:
                    rooms.setdefault(room - todo * length, []).append([lengths + (length,) * todo, 1])
                    todo, count = 0, count - 1
                if count:
                    rooms.setdefault(room, []).append([lengths, count])
                    if not todo:
                        break
            if not todo:
                break
        if todo:
            fits = capacity // length
            if todo // fits:
                rooms.setdefault(capacity - fits * length, []).append([(length,) * fits, todo // fits])
            if rest := todo % fits:
                rooms.setdefault(capacity - rest * length, []).append([(length,) * rest, 1])
    plan += [(tuple(lengths), count) for room in sorted(rooms) for lengths, count in rooms[room]]
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lookup by (length, index among items of that length): sorted keys, first index, first container, items per container, offset inside."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, repeats in plan:
        place = 0
        for v in sorted(set(lengths), reverse=True):
            m = lengths.count(v)
            first = used.get(v, 0)
            rows.append((v << 44 | first, first, base, m, place))
            used[v] = first + repeats * m
            place += m * v
        base += repeats
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def count_tokens(df: DataFrame, key: str, text: str, capacity: int) -> DataFrame:
    """(key, piece, n_pieces, first_token, n_tokens) of every text; one larger than the capacity is cut after each ``capacity`` tokens.

    Tokens are counted in the JVM; texts never reach Python.
    """
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")
    n = F.col("__n")
    pieces = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    return (
        df.select(F.col(key).alias("key"), tokens.alias("__n"))
        .select("key", "__n", pieces.alias("n_pieces"))
        .select("key", "__n", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
        .select("key", "piece", "n_pieces", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), n - F.col("piece").cast("long") * capacity).alias("n_tokens"))
    )


def pack_containers(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024) -> DataFrame:
    """(key, piece, n_pieces, first_token, n_tokens, container, offset) of every row of df.

    Items stay whole unless larger than the capacity, which are cut after every ``capacity`` tokens. The
    driver sees only the histogram of lengths (capacity + 1 numbers, whatever the corpus) and solves it;
    items then find their container by their index among the items of their length. That index
    is a running number inside a partition plus the partition's offset, so a length that a third of
    the items share is not gathered anywhere. Texts without tokens, null ones too, have n_tokens 0 and a null
    container. Repeated rows are items of their own. Other columns are not read.
    """
    # the numbering must not change between its two uses, so the items (no texts) are written once
    items = count_tokens(df, key, text, capacity).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    items = cut_lineage(items)
    counts = items.where("n_tokens > 0").groupBy("n_tokens", "part").agg(F.count("*").alias("c"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, c in counts.groupBy("n_tokens").agg(F.sum("c")).collect():  # at most ``capacity`` rows
        histogram[length] = c
    keys, first, base, each, place = _slots(plan_containers(histogram, capacity))
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("n_tokens", "part").orderBy("row")
    numbered = items.withColumn("index", F.row_number().over(inside) - 1).join(offsets, ["n_tokens", "part"], "left")

    @F.pandas_udf("struct<container:long,offset:long>")
    def place_of(length: pd.Series, index: pd.Series) -> pd.DataFrame:
        known = index.notna().to_numpy() & (length.to_numpy() > 0)
        n, i = length.to_numpy()[known].astype(np.int64), index.to_numpy()[known].astype(np.int64)
        at = np.searchsorted(keys, n << 44 | i, "right") - 1
        step = i - first[at]
        out = pd.DataFrame({"container": pd.Series(pd.NA, index.index, "Int64"), "offset": pd.Series(pd.NA, index.index, "Int64")})
        out.loc[known, "container"] = base[at] + step // each[at]
        out.loc[known, "offset"] = place[at] + step % each[at] * n
        return out

    index = F.when(F.col("n_tokens") > 0, F.col("index") + F.col("skip"))
    placed = numbered.withColumn("__at", place_of("n_tokens", index))
    return placed.select(F.col("key").alias(key), "piece", "n_pieces", "first_token", "n_tokens", F.col("__at.container").alias("container"), F.col("__at.offset").alias("offset"))
