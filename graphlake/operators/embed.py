"""Dense vectors of texts: a pluggable embedder, by default feature hashing."""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words and word pairs, normalised; needs no model and gives the same vector everywhere."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float64)
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(feature.encode("utf-8", "surrogatepass"))
                out[i, h % self.dimensions] += 1.0 if h >> 31 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype(np.float32)


@lru_cache(maxsize=4)
def embedder(kind: type = HashingEmbedder, dimensions: int = 64) -> Embedder:
    """One instance per process, made when first needed."""
    return kind(dimensions)


def embed_one(text: str, kind: type = HashingEmbedder, dimensions: int = 64) -> np.ndarray:
    """The vector of one text."""
    return embedder(kind, dimensions).embed([text])[0]


def hashed_points(weights: DataFrame, key: str, dimensions: int = 64) -> DataFrame:
    """(key, dense, packed) of sparse vectors in long form (key, term, weight), in one pass and without Python: packed as of similarity.pack_terms,
    dense by signed feature hashing of the terms, so that texts and questions of one vocabulary meet in one space."""
    digest = F.md5("term")
    bucket = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % dimensions
    signed = F.when(F.substring(digest, 5, 1) < "8", F.col("weight")).otherwise(-F.col("weight"))
    sums = weights.groupBy(key, bucket.alias("bucket")).agg(F.sum(signed).alias("w"), F.collect_list(F.struct(F.xxhash64("term").alias("term"), "weight")).alias("e"))
    held = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"), F.flatten(F.collect_list("e")).alias("e"))  # a text's terms
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return held.select(key, dense.alias("dense"), F.struct(F.col("e.term").alias("terms"), F.col("e.weight").alias("weights")).alias("packed"))


def embed_texts(text: Column, dimensions: int = 64, kind: type = HashingEmbedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(kind, dimensions).embed(texts.fillna("").tolist())), index=texts.index, dtype=object)

    return run(text)


def with_embedding(df: DataFrame, text: str, to: str = "dense", dimensions: int = 64) -> DataFrame:
    return df.withColumn(to, embed_texts(F.col(text), dimensions))
