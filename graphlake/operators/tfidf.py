"""The sparse vector space, in long form (id, term, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.config import DEFAULTS
from graphlake.functions import text as T
from graphlake.session import cut_lineage

#: English words without weight (fixed values).
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself "
    "me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def term_counts(df: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """(key, term, tf): single terms and pairs of neighbours, stop words removed first."""
    return df.select(F.col(key), F.explode(T.tokens(F.col(text), STOP_WORDS, bigrams)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, documents: int, max_features: int = DEFAULTS.max_features) -> DataFrame:
    """(term, df, idf) of the most frequent terms; idf = ln((1 + n) / (1 + df)) + 1."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return kept.select("term", "df", (F.log((F.lit(1.0) + documents) / (F.col("df") + 1)) + 1).alias("idf"))


#: Size up to which a vocabulary is broadcast.
VOCABULARY_BYTES = 128 << 20


def _shared(vocab: DataFrame) -> DataFrame:
    """(term, idf), broadcast if small: it has at most max_features rows, but terms may be long."""
    held = vocab.agg(F.coalesce(F.sum(F.octet_length("term") + 40), F.lit(0))).first()[0]
    small = vocab.select("term", "idf")
    return F.broadcast(small) if held <= VOCABULARY_BYTES else small


def weighted(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * idf, each vector of length 1; unseen terms fall away.

    A vocabulary that is broadcast leaves the counts partitioned by key, so the lengths take no shuffle.
    """
    raw = counts.join(_shared(vocab), "term").withColumn("w", (F.log("tf") + 1) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


def fit_transform(df: DataFrame, key: str, text: str, max_features: int = DEFAULTS.max_features, bigrams: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights) of a corpus."""
    counts = term_counts(df, key, text, bigrams)
    # at most max_features rows, and read by every use of the space
    vocab = cut_lineage(vocabulary(counts, df.select(key).distinct().count(), max_features))
    return vocab, weighted(counts, vocab, key)


def transform(df: DataFrame, vocab: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    return weighted(term_counts(df, key, text, bigrams), vocab, key)


def as_struct(weights: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, sparse{indices, values}) with indices by alphabetical order of the vocabulary."""
    numbered = vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("index"))
    pairs = F.array_sort(F.collect_list(F.struct("index", "weight")))
    packed = weights.join(numbered, "term").groupBy(key).agg(pairs.alias("p"))
    return packed.select(key, F.struct(F.transform("p", lambda x: x["index"]).alias("indices"), F.transform("p", lambda x: x["weight"]).alias("values")).alias("sparse"))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
