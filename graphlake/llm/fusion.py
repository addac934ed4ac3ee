"""One ranking from several differently scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.ranking import group_ranks
from graphlake.session import cut_lineage


def read_number(text: Column, comma: str | None = None) -> Column:
    """A number written as text, null if it cannot be read or is not finite.

    Blanks around it do not count; % means hundredths; exponents are read; ``comma`` says what a comma is:
    'decimal', 'thousands' or, by default, not part of a number.
    """
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    percent = bare.endswith("%")
    digits = F.regexp_replace(bare, r"(?U)\s*%$", "")
    if comma == "decimal":
        digits = F.regexp_replace(digits, ",", ".")
    elif comma == "thousands":
        digits = F.regexp_replace(digits, "(?<=[0-9]),(?=[0-9]{3})", "")
    number = F.when(digits.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), digits.try_cast("double"))
    number = F.when(F.abs(number) < float("inf"), number)
    return F.when(percent, number / 100).otherwise(number)


#: Items up to which a group is ranked by windows in one task; larger groups are ranked over many. Results are the same.
GROUP_LIMIT = 1_000_000


def fuse_rankings(df: DataFrame, group: str, item: str, scores: list[str], constant: int = 60, position: bool = True, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(group, item, n_items, rank_<score>, ties_<score> ..., fused[, position]) of every item.

    Items are ranked separately by each score, highest first, equal scores sharing the best rank; ``fused`` is
    the sum of 1 / (constant + rank), so the range of a score has no say. ``position`` orders the
    items of a group by it, ties sharing a position. A null, NaN or infinite score ranks nowhere and adds
    nothing; ``ties`` counts the items with the same score. Rows with a null group or item are left out;
    repeated (group, item) rows count once, with the highest of their scores.

    Rows are counted per group first. Groups of at most ``group_limit`` rows move once, by group, and are
    ranked by windows there; those of more are never gathered in one task but ranked by range-partitioned counting.
    """
    inner = [f"v{n}" for n in range(len(scores))]
    finite = lambda v: F.when(F.abs(F.col(v)) < float("inf"), F.col(v))
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(s).cast("double").alias(v) for v, s in zip(inner, scores, strict=True)]).where("g is not null and i is not null")
    rows = cut_lineage(rows.select("g", "i", *[finite(v).alias(v) for v in inner]))
    hot = cut_lineage(rows.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > group_limit).select("g"))
    some_hot = not hot.isEmpty()
    small = rows.join(hot, "g", "left_anti") if some_hot else rows
    best = [F.max(v).alias(v) for v in inner]
    fused = _by_windows(small.repartition("g").groupBy("g", "i").agg(*best), scores, inner, constant, position)
    if some_hot:
        fused = fused.unionByName(_by_ranges(rows.join(hot, "g", "left_semi").groupBy("g", "i").agg(*best), scores, inner, constant, position))
    named = [c for s in scores for c in (f"rank_{s}", f"ties_{s}")]
    return fused.select(F.col("g").alias(group), F.col("i").alias(item), "n_items", *named, "fused", *(["position"] if position else []))


def _total(scores: list[str], constant: int) -> Column:
    """The sum of the reciprocal ranks, in the order of the scores, so equal items get equal totals."""
    total = F.lit(0.0)
    for s in scores:
        total = total + F.coalesce(1 / (F.lit(constant) + F.col(f"rank_{s}")), F.lit(0.0))
    return total


def _by_windows(items: DataFrame, scores: list[str], inner: list[str], constant: int, position: bool) -> DataFrame:
    """Ranks of items that lie together by group; no window moves them again."""
    for s, v in zip(scores, inner, strict=True):
        there = F.col(v).isNotNull()
        items = items.withColumn(f"rank_{s}", F.when(there, F.rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_last(v))).cast("long")))
        items = items.withColumn(f"ties_{s}", F.when(there, F.count("*").over(Window.partitionBy("g", v))))
    fused = items.withColumn("n_items", F.count("*").over(Window.partitionBy("g"))).withColumn("fused", _total(scores, constant))
    return fused.withColumn("position", F.rank().over(Window.partitionBy("g").orderBy(F.desc("fused"))).cast("long")) if position else fused


def _by_ranges(items: DataFrame, scores: list[str], inner: list[str], constant: int, position: bool) -> DataFrame:
    """The same for groups too large for a task."""
    place = F.col("n_total") - F.col("n_below") - F.col("n_equal") + 1
    long = items.select("g", "i", F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(v).alias("value")) for n, v in enumerate(inner)])).alias("s")).select("g", "i", "s.*")
    ranked = long.join(group_ranks(long, ["g", "score"], "value"), ["g", "score", "value"], "left").withColumn("rank", place)
    columns = []
    for n, s in enumerate(scores):
        this = F.col("score") == n
        columns += [F.max(F.when(this, F.col("rank"))).alias(f"rank_{s}"), F.max(F.when(this, F.col("n_equal"))).alias(f"ties_{s}")]
    fused = ranked.groupBy("g", "i").agg(*columns).withColumn("fused", _total(scores, constant))
    fused = fused.join(items.groupBy("g").agg(F.count("*").alias("n_items")), "g")
    if position:
        fused = fused.join(group_ranks(fused, ["g"], "fused").select("g", "fused", place.alias("position")), ["g", "fused"])
    return fused.join(items, ["g", "i"])
