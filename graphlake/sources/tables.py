"""Parquet tables and the valid rows of append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key of each append log; the other tables hold exact copies only.
LOG_KEYS = {
    "books": "id",
    "sections": "id",
    "chunks": "id",
    "concepts": "id",
    "code_symbols": "id",
    "edges": "id",
    "points": "node_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_rows(df: DataFrame, key: str | list[str], version: Column | str = "created_at") -> DataFrame:
    """One row for each non-null key (of one column or several), the one of the largest version.

    A null version loses to any other; rows that tie are taken to be identical. Copies are dropped on
    the map side first (the window becomes a group limit), so a key repeated in a third of all rows
    sends one row per map task.
    """
    version = F.col(version) if isinstance(version, str) else version
    rank = "__latest_rank"
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(version.desc_nulls_last())
    return df.dropna(subset=keys).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)


def valid(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The valid rows of a project table."""
    df = table(spark, sf_dir, name)
    if name == "points":
        return latest_rows(df, "node_id", F.col("payload.created_at"))
    return latest_rows(df, LOG_KEYS[name]) if name in LOG_KEYS else df.dropDuplicates()
