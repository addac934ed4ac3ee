"""Graph-augmented answering of many questions in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphlake.functions import text as T
from graphlake.operators.judge import Provider
from graphlake.operators.traverse import capped, incident
from graphlake.session import cut_lineage

NOTHING_FOUND = "Nothing in the graph bears on this question. Ingest more sources on its topic, or ask in other words."


def context_rows(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, position, node_id, label, text, extra) of seeds (query_id, node_id, rank): all seeds by rank, then each seed's neighbours in their order.

    A node counts once per question, where it first comes with a text; nodes without text or description fall away before that.
    """
    body = T.first_text(F.col("text"), F.col("description"))
    # the edges at the seeds say which nodes matter; nodes are read once, and bodies for those alone
    ends = cut_lineage(incident(seeds.select(F.col("node_id").alias("seed_id")), edges))
    wanted = ends.select(F.col("neighbor_id").alias("id")).union(seeds.select("node_id")).distinct()
    known = cut_lineage(nodes.select("id", "label", body.alias("body")).join(wanted, "id", "left_semi"))
    facts = known.select(F.col("id").alias("node_id"), "label", "body")
    own = seeds.select("query_id", "node_id", F.struct(F.lit(0).alias("stage"), F.col("rank"), F.lit(0).alias("ordinal")).alias("place"), F.lit("").alias("extra"))
    near = capped(ends, known, limit)
    around = seeds.select("query_id", F.col("node_id").alias("seed_id"), "rank").join(near, "seed_id")
    around = around.select("query_id", F.col("neighbor_id").alias("node_id"), F.struct(F.lit(1).alias("stage"), F.col("rank"), F.col("ordinal")).alias("place"), T.relation_note(F.col("rel_type"), F.col("explanation")).alias("extra"))
    told = own.unionByName(around).join(facts, "node_id").where("body <> ''")
    first = Window.partitionBy("query_id", "node_id").orderBy("place")
    told = told.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    order = Window.partitionBy("query_id").orderBy("place")
    return told.select("query_id", (F.row_number().over(order) - 1).alias("position"), "node_id", "label", F.col("body").alias("text"), "extra")


def contexts(rows: DataFrame) -> DataFrame:
    """(query_id, context, context_node_ids, context_preview) of context rows."""
    block = T.context_block(F.col("node_id"), F.col("label"), F.col("text"), F.col("extra"))
    listed = F.array_sort(F.collect_list(F.struct("position", "node_id", "label", F.substring("text", 1, 200).alias("snippet"), block.alias("block"))))
    return rows.groupBy("query_id").agg(listed.alias("x")).select(
        "query_id",
        F.array_join(F.transform("x", lambda x: x["block"]), "\n\n---\n\n").alias("context"),
        F.transform("x", lambda x: x["node_id"]).alias("context_node_ids"),
        F.transform("x", lambda x: F.struct(x["node_id"].alias("node_id"), x["label"].alias("label"), x["snippet"].alias("snippet"))).alias("context_preview"),
    )


def answer(questions: DataFrame, found: DataFrame, provider: Provider | None = None, system: str = "") -> DataFrame:
    """(query_id, question, context, context_node_ids, context_preview, answer); questions without context get a fixed answer."""
    joined = questions.select("query_id", "question").join(found, "query_id", "left")
    schema = StructType([*joined.schema.fields, StructField("answer", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = []
            for q, c in zip(b["question"], b["context"], strict=True):
                asked = f"QUESTION: {q}\n\nCONTEXT:\n\n{c}\n\nAnswer from this context alone."
                replies.append(NOTHING_FOUND if not isinstance(c, str) or not c else provider.complete(asked, system) if provider else c.split("\n", 1)[-1][:200])
            yield b.assign(answer=replies)

    return joined.mapInPandas(run, schema)
