"""How distinctive a term is per record: graph-of-words degree times collection rarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.plain import words
from graphlake.session import cut_lineage

#: Distinct terms a task holds before it passes their counts on; a bound on memory, not on terms.
FLUSH_TERMS = 400_000
#: Size up to which document frequencies are broadcast.
COUNT_BYTES = 128 << 20
_ROW = pa.schema([("id", pa.string()), ("term", pa.list_(pa.string())), ("tf", pa.list_(pa.int32())), ("degree", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64()))])
_DDL = "id string, term array<string>, tf array<int>, degree array<int>, docs array<long>"


def degrees(tokens: list[str], chosen: set[str], window: int) -> dict[str, int]:
    """Distinct neighbours of the chosen terms in the co-occurrence graph: edges join different words less than ``window`` apart."""
    near: dict[str, set[str]] = {t: set() for t in chosen}
    for i, t in enumerate(tokens):
        if t in near:
            near[t].update(tokens[max(0, i - window + 1) : i + window])
    return {t: len(s - {t}) for t, s in near.items()}


def _scan(window: int, min_tf: int, max_df: int | None):
    """Emits a row without id for the terms seen so far and their records, and a row for each record with its terms that may still qualify."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter[str] = Counter()
        held: list[tuple[str, list, list, list]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kept = held
            if max_df is not None:
                # a term in more than max_df records here is in more than max_df of all: it goes no further
                keep = [[docs[t] <= max_df for t in terms] for _, terms, _, _ in held]
                kept = [(key, *(list(compress(x, k)) for x in lists)) for (key, *lists), k in zip(held, keep, strict=True) if any(k)]
            rows = [(None, list(docs), None, None, list(docs.values())), *((*x, None) for x in kept)]
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)
            docs.clear()
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = words(text)
                tf = Counter(tokens)
                terms = [t for t in tf if t.isalpha()]
                docs.update(terms)
                chosen = {t for t in terms if tf[t] >= min_tf and (max_df is None or docs[t] <= max_df)}
                if chosen and key is not None:
                    found = degrees(tokens, chosen, window)
                    held.append((key, list(found), [tf[t] for t in found], list(found.values())))
                    size += len(found)
                if len(docs) >= FLUSH_TERMS or size >= FLUSH_TERMS:
                    yield flush()
                    size = 0
        yield flush()

    return scan


def distinctive_terms(df: DataFrame, key: str = "id", text: str = "text", window: int = 4, min_tf: int = 1, min_df: int = 1, max_df: int | None = None, least: float = 0.0) -> DataFrame:
    """(id, term, tf, df, degree, score): score = degree * ln((N + 1) / df).

    ``degree`` is the term's number of distinct neighbours in the record's graph of words, ``df`` the
    number of records with the term, N the number of records, each record of df being one (make keys
    unique first). Terms consist of letters only, in plain form. Rows come for terms with
    tf >= min_tf, min_df <= df <= max_df and score >= least (no score is below 0). Null and empty texts count as records
    without terms; ties in score are left to the reader. Other columns are not read, so their names cannot clash.

    One pass over the texts: what it finds is written once, a row per record, and read by both uses. Document frequencies are summed
    per task before they move, so a term of nearly every record sends one row a task. They go to the rows if
    they take at most COUNT_BYTES, else rows and frequencies meet by term; with max_df only the terms within it
    count, and tasks have dropped those that are too common already there.
    """
    texts = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    n = df.select(key).count()
    rows = cut_lineage(texts.mapInArrow(_scan(window, min_tf, max_df), _DDL))
    of_task = rows.where("id is null").select(F.explode(F.arrays_zip("term", "docs")).alias("t")).select("t.term", "t.docs")
    counts = of_task.groupBy("term").agg(F.sum("docs").alias("df")).where(F.col("df") >= min_df)
    if max_df is not None:
        counts = counts.where(F.col("df") <= max_df)
    counts = cut_lineage(counts)
    if counts.agg(F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0))).first()[0] <= COUNT_BYTES:
        counts = F.broadcast(counts)
    score = F.col("degree") * F.log((F.lit(n) + 1) / F.col("df"))
    listed = rows.where("id is not null").select("id", F.explode(F.arrays_zip("term", "tf", "degree")).alias("t")).select("id", "t.term", "t.tf", "t.degree")
    found = listed.join(counts, "term").withColumn("score", score)
    return found.where(F.col("score") >= least).select("id", "term", "tf", "df", "degree", "score")
