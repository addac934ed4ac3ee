"""Exact ranks inside groups of any size: range-partitioned counting with partition offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.session import cut_lineage


def group_ranks(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(groups, value, n_equal, n_below, n_total) of each distinct non-null value of each group.

    Rows are counted per (group, value) before anything moves. The distinct values are then split by
    range of (group, value), so a group that holds a third of all rows lies over many partitions; each
    partition counts on its own, and a group that crosses partitions gets offsets from a table of
    at most two rows per partition. Group columns must not be null. With ``weight``, a column of counts, a row
    stands for so many rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg((F.sum(weight) if weight else F.count("*")).alias("n_equal"))
    # range bounds come from sampling, so the split is written once and read by both uses
    ranged = cut_lineage(counts.repartitionByRange(parts, *groups, value).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*groups, "__part")
    running = inside.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__below", F.coalesce(F.sum("n_equal").over(running), F.lit(0))).withColumn("__all", F.sum("n_equal").over(inside))
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        ranged.groupBy(*groups, "__part")
        .agg(F.sum("n_equal").alias("__c"))
        .withColumn("__spans", F.count("*").over(by_group))
        .withColumn("__skip", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__c").over(by_group))
        .where("__spans > 1")
        .select(*groups, "__part", "__skip", "__total")
    )
    joined = local.join(F.broadcast(crossing), [*groups, "__part"], "left")
    return joined.select(
        *groups,
        value,
        "n_equal",
        (F.col("__below") + F.coalesce("__skip", F.lit(0))).alias("n_below"),
        F.coalesce("__total", "__all").alias("n_total"),
    )


def adjacent(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(key, prev, next): the keys before and after each row's in the order of its group, ties by key; null at the ends.

    Only these three columns move, split by range of (group, order, key), so a group that holds a third of all rows lies over many
    partitions; where it goes on in another partition, a table of at most two rows per partition tells. Rows without
    group are a group of their own. Keys must be unique and not null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(F.col(group).alias("__g"), F.col(order).alias("__o"), F.col(key).alias("__k"))
    ranged = cut_lineage(narrow.repartitionByRange(parts, "__g", "__o", "__k").withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__g", "__part").orderBy("__o", "__k")
    local = ranged.withColumn("__p", F.lag("__k").over(inside)).withColumn("__n", F.lead("__k").over(inside))
    by_group = Window.partitionBy("__g")
    row = F.struct("__o", "__k")
    crossing = (
        ranged.groupBy("__g", "__part")
        .agg(F.min(row).alias("__first"), F.max(row).alias("__last"))
        .withColumn("__spans", F.count("*").over(by_group))
        .withColumn("__before", F.lag("__last.__k").over(by_group.orderBy("__part")))
        .withColumn("__after", F.lead("__first.__k").over(by_group.orderBy("__part")))
        .where("__spans > 1")
        .select(F.col("__g").alias("__g2"), F.col("__part").alias("__part2"), "__before", "__after")
    )
    same = F.col("__g").eqNullSafe(F.col("__g2")) & (F.col("__part") == F.col("__part2"))
    joined = local.join(F.broadcast(crossing), same, "left")
    return joined.select(F.col("__k").alias(key), F.coalesce("__p", "__before").alias("prev"), F.coalesce("__n", "__after").alias("next"))
