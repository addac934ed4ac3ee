"""Files as tables: whole texts, source trees, raw text and report sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.config import DEFAULTS, LANGUAGES, Settings


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def language_for_path(path: Column) -> Column:
    """The registered language of a path's suffix, else null."""
    return F.coalesce(*[F.when(path.endswith(suffix), name) for suffix, name in LANGUAGES.items()])


def module_path(path: Column) -> Column:
    """Dotted module of a path relative to its root: suffix dropped, a last __init__ too; '' for the root's __init__."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def source_filter(path: Column, length: Column, settings: Settings = DEFAULTS) -> Column:
    """Wanted suffix, no excluded folder above, not too large."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    suffix = F.lit(False)
    for s in settings.code_suffixes:
        suffix = suffix | path.endswith(s)
    return suffix & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in settings.code_excluded])) & (length <= settings.code_file_bytes)


def read_source_tree(spark: SparkSession, root: str, repo: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(file_id, repo, path, module_path, language, loc, content) of a tree; unwanted files are ruled out before their content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    files = found.withColumn("rel", relative).where(source_filter(F.col("rel"), F.col("length"), settings))
    content = F.decode("content", "UTF-8")
    return files.select(F.concat(F.lit("file_"), F.substring(F.md5(F.concat(F.lit(repo), F.lit("|"), F.col("rel"))), 1, 12)).alias("file_id"), F.lit(repo).alias("repo"), F.col("rel").alias("path"), module_path(F.col("rel")).alias("module_path"), language_for_path(F.col("rel")).alias("language"), F.regexp_count(content, F.lit("\n")).alias("newlines"), content.alias("content")).withColumn("loc", F.col("newlines") + 1).drop("newlines")


def write_raw_texts(books: DataFrame, root: str) -> DataFrame:
    """Writes each text to root/<topic>/<file_name> and gives (topic, file_name, n_bytes); books has topic, file_name and text.

    Files are written by the tasks that hold the texts, on any file system that pyarrow knows by its URI; a retried task writes the same
    file again. Null texts are left out.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        for b in batches:
            sizes = []
            for topic, name, text in zip(b["topic"], b["file_name"], b["text"], strict=True):
                body = text.encode("utf-8", "replace")
                where.create_dir(f"{base}/{topic}", recursive=True)
                with where.open_output_stream(f"{base}/{topic}/{name}") as out:
                    out.write(body)
                sizes.append(len(body))
            yield pd.DataFrame({"topic": b["topic"], "file_name": b["file_name"], "n_bytes": sizes})

    return books.select("topic", "file_name", "text").where("text is not null").mapInPandas(write, "topic string, file_name string, n_bytes long")


def json_report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))
