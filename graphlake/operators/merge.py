"""Merging nodes: contraction of the graph onto the node that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.store import GraphTables, enriched_points


def contract_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges (keep_id, absorb_id, ordinal): ends move to keep_id, edges inside a merge vanish, a moved edge gives way to one of the same
    (source, type, target) that was there, else the one of the first absorbed node stays. Untouched edges stay as they are."""
    m = merges.where("keep_id <> absorb_id").select("absorb_id", "keep_id", F.col("ordinal").alias("o"))
    source = m.select(F.col("absorb_id").alias("source_id"), F.col("keep_id").alias("s"), F.col("o").alias("so"))
    target = m.select(F.col("absorb_id").alias("target_id"), F.col("keep_id").alias("t"), F.col("o").alias("to"))
    mapped = edges.join(source, "source_id", "left").join(target, "target_id", "left")
    moved = F.col("s").isNotNull() | F.col("t").isNotNull()
    new = mapped.where(moved).select(*[c for c in edges.columns if c not in ("source_id", "target_id")], F.coalesce("s", "source_id").alias("source_id"), F.coalesce("t", "target_id").alias("target_id"), F.least("so", "to").alias("__o"))
    new = new.where(F.col("source_id") != F.col("target_id"))
    key = ["source_id", "rel_type", "target_id"]
    best = Window.partitionBy(*key).orderBy("__o", "id")
    new = new.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(*edges.columns)
    # only keys of moved edges are compared; the edges that stay are not sorted
    rest = mapped.where(~moved).select(*edges.columns)
    there = rest.select(*key).join(new.select(*key), key, "left_semi")
    return rest.unionByName(new.join(there, key, "left_anti").select(*edges.columns))


def merge_nodes(graph: GraphTables, merges: DataFrame, vocab: DataFrame | None = None) -> GraphTables:
    """Contracts nodes, edges and points; keep_id gains merged_from and aliases of the absorbed nodes that exist, in order, and their texts, joined by blanks, in its point's text.

    With a vocabulary the point of each kept node is made anew of that text, dense and sparse, unless the text is blank.
    """
    m = merges.where("keep_id <> absorb_id")
    found = m.join(graph.nodes.select(F.col("id").alias("absorb_id"), F.col("label").alias("l"), F.coalesce(F.nullif("text", F.lit("")), F.nullif("description", F.lit(""))).alias("body")), "absorb_id")
    told = found.groupBy("keep_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "absorb_id", "l", "body"))).alias("x"))
    told = told.select(F.col("keep_id").alias("id"), F.transform("x", lambda x: x["absorb_id"]).alias("merged_from"), F.transform("x", lambda x: x["l"]).alias("new_aliases"), F.filter(F.transform("x", lambda x: x["body"]), lambda b: b.isNotNull()).alias("bodies"))
    gone = m.select(F.col("absorb_id").alias("id")).distinct()
    nodes = graph.nodes.join(gone, "id", "left_anti").join(told, "id", "left")
    body = F.coalesce(F.nullif("text", F.lit("")), F.nullif("description", F.lit("")))
    combined = F.array_join(F.concat(F.filter(F.array(body), lambda b: b.isNotNull()), F.coalesce("bodies", F.array().cast("array<string>"))), " ")
    nodes = nodes.withColumn("embedded_text", F.when(F.col("merged_from").isNotNull(), combined)).drop("bodies")
    points = graph.points.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti") if graph.points is not None else None
    out = GraphTables(nodes, contract_edges(graph.edges, merges), points)
    if vocab is not None and points is not None:
        out = out.upsert_points(enriched_points(nodes.where(F.trim("embedded_text") != ""), "embedded_text", vocab))
    return out
