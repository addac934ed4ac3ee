"""Incremental ingest: batches that land in a folder are merged into a node table, bucket by bucket."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphlake.operators.store import overlay

BUCKET = "__bucket"


def _written(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", target).parquet(target)
    except AnalysisException:
        return None


def _newest(rows: DataFrame, upto: int | None = None) -> DataFrame:
    """Each bucket as the newest batch (of those up to a number) left it."""
    rows = rows if upto is None else rows.where(F.col("v") <= upto)
    last = rows.groupBy(BUCKET).agg(F.max("v").alias("v"))  # a row per bucket, from file paths
    return rows.join(F.broadcast(last), [BUCKET, "v"], "left_semi")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table after a batch, or after the last one."""
    rows = _written(spark, path)
    if rows is None:
        raise ValueError(f"nothing was written below {path}")
    return _newest(rows, version).drop(BUCKET, "v")


def stream_upserts(spark: SparkSession, landing: str, schema: StructType, target: str, checkpoint: str, key: list[str], ordinal: str | None = None, once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Merges every batch of parquet files into the table below ``target``.

    Rows lie in ``buckets`` by the hash of their key, in folders v=<batch>/__bucket=<n>. A batch reads and writes only the buckets of
    its keys; the others stay where an earlier batch wrote them. Its folder is named by the batch and it builds on earlier ones
    only, so a batch that is run again after a failure overwrites its own and nothing is merged twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(place).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        before = _written(session, target)
        if before is not None:
            before = before.where((F.col("v") < number) & F.col(BUCKET).isin(touched))
        if before is None or before.isEmpty():
            old = session.createDataFrame([], batch.drop(ordinal).schema if ordinal else batch.schema)
        else:
            old = _newest(before).drop(BUCKET, "v")
        merged = overlay(old, batch, key, ordinal).withColumn(BUCKET, place)
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target}/v={number}")

    writer = spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
