"""The property graph and its points as immutable tables: lookups, upserts, deletes, statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators import tfidf
from graphlake.operators.embed import with_embedding
from graphlake.schema import REL_TYPES, make_edges, now, stable_id


def overlay(old: DataFrame, batch: DataFrame, key: list[str], ordinal: str | None = None) -> DataFrame:
    """Merge by key: columns of the batch win where it has the key (a null too), columns it lacks survive; of rows of one key in a batch the last wins."""
    if ordinal:
        last = Window.partitionBy(*key).orderBy(F.desc(ordinal))
        batch = batch.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", ordinal)
    batch = batch.select(*key, F.struct(*[c for c in batch.columns if c not in key]).alias("__new"))
    joined = old.withColumn("__there", F.lit(True)).join(batch, key, "full")
    new = batch.schema["__new"].dataType.names
    types = {f.name: f.dataType for f in old.schema.fields}
    columns = [F.when(F.col("__new").isNotNull(), F.col("__new")[c].cast(types[c]) if c in types else F.col("__new")[c]).otherwise(F.col(c) if c in types else F.lit(None)).alias(c) if c in new else F.col(c) for c in dict.fromkeys([*old.columns, *key, *new]) if c not in key]
    return joined.select(*key, *columns)


@dataclass(frozen=True)
class GraphTables:
    """nodes, edges and points; every change gives new tables."""

    nodes: DataFrame
    edges: DataFrame
    points: DataFrame | None = None

    def upsert_nodes(self, batch: DataFrame, ordinal: str | None = None) -> GraphTables:
        return replace(self, nodes=overlay(self.nodes, batch, ["type", "id"], ordinal))

    def upsert_edges(self, batch: DataFrame, ordinal: str | None = None) -> GraphTables:
        """Edges with an end that is gone are dropped; one edge per (source, type, target)."""
        # as an expression the ids are split anew: Spark 4.1 takes a union of parts split alike for split like them, and fails where their shuffles are reused
        ids = self.nodes.select(F.concat("id", F.lit("")).alias("id")).distinct()
        kept = batch.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
        return replace(self, edges=overlay(self.edges, kept, ["source_id", "rel_type", "target_id"], ordinal))

    def upsert_points(self, batch: DataFrame) -> GraphTables:
        """A point of the batch takes the place of the node's old one."""
        rest = self.points.join(batch.select("node_id"), "node_id", "left_anti")
        return replace(self, points=rest.unionByName(batch, allowMissingColumns=True))

    def delete_points(self, ids: DataFrame) -> GraphTables:
        return replace(self, points=self.points.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti"))

    def delete_nodes(self, ids: DataFrame) -> GraphTables:
        """Nodes with all their edges and points."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
        out = replace(self, nodes=self.nodes.join(gone, "id", "left_anti"), edges=edges)
        return out.delete_points(gone) if self.points is not None else out

    def create_relationship(self, wanted: DataFrame) -> GraphTables:
        """wanted: source_id, target_id, rel_type, weight, explanation, created_by; unknown types are refused, the method follows from who made it."""
        return self.upsert_edges(relationships(wanted))


def relationships(wanted: DataFrame) -> DataFrame:
    c = F.col
    known = wanted.where(c("rel_type").isin(REL_TYPES))
    method = F.when(c("created_by").startswith("user"), "manual").otherwise("llm_connection_finder")
    edges = make_edges(known.select("*"), c("source_id"), c("target_id"), c("rel_type"), "manual", c("weight"), c("explanation"))
    return edges.join(known.select("source_id", "target_id", "rel_type", c("created_by").alias("by"), method.alias("m")), ["source_id", "target_id", "rel_type"]).select("id", "source_id", "target_id", "rel_type", c("m").alias("method"), "weight", "explanation", c("by").alias("created_by"), "created_at", "metadata")


def concept_nodes(wanted: DataFrame) -> DataFrame:
    """Concepts of (label, description, topic, created_by), trimmed, with the text that is embedded for them."""
    label, description = F.trim("label"), F.trim(F.coalesce("description", F.lit("")))
    return wanted.select(stable_id("concept", F.lower(label)).alias("id"), F.lit("Concept").alias("type"), label.alias("label"), "topic", description.alias("description"), "created_by", F.concat(F.col("label"), F.lit(". "), F.coalesce("description", F.lit(""))).alias("embedded_text"))


def note_chunks(wanted: DataFrame) -> DataFrame:
    """Chunks without book or section from (label, text, topic, created_by)."""
    return wanted.select(stable_id("chunk", "created_by", "label", "text").alias("id"), F.lit("Chunk").alias("type"), F.trim("label").alias("label"), "topic", F.trim("text").alias("text"), "created_by")


def list_nodes(nodes: DataFrame, node_type: str | None = None, topic: str | None = None, search: str | None = None, limit: int | None = 100) -> DataFrame:
    """Newest first; search is a literal, in any case, in label or text."""
    if node_type:
        nodes = nodes.where(F.col("type") == node_type)
    if topic:
        nodes = nodes.where(F.col("topic") == topic)
    if search:
        wanted = F.lit(search.lower())
        nodes = nodes.where(F.contains(F.lower("label"), wanted) | F.contains(F.lower(F.coalesce("text", F.lit(""))), wanted))
    return nodes.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit) if limit else nodes


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges of each type, with the share of all and the style of its badge."""
    style = F.when(F.col("rel_type").isin("HAS_SECTION", "HAS_CHUNK", "NEXT_CHUNK"), "structural").when(F.col("rel_type").isin("SIMILAR_TO"), "manual").otherwise("llm")
    return edges.groupBy("rel_type").agg(F.count("*").alias("n")).withColumn("style", style)


def total_relationships(edges: DataFrame) -> DataFrame:
    """(n): all edges, as the sum of the counts by type."""
    return edge_counts(edges).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def embed_and_upsert(graph: GraphTables, batch: DataFrame, text: str, vocab: DataFrame, ordinal: str | None = None) -> GraphTables:
    """Points of a batch of nodes first, then the nodes: texts are embedded, weighed in the vocabulary's sparse space, and kept in the point's payload."""
    points = enriched_points(batch, text, vocab)
    return (graph if graph.points is None else graph.upsert_points(points)).upsert_nodes(batch, ordinal)


def enriched_points(batch: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """(node_id, dense, sparse, payload) of nodes (id, type, label, topic and a text); sparse is null where no term is in the vocabulary."""
    told = batch.select(F.col("id").alias("node_id"), "type", "label", "topic", F.coalesce(text, F.lit("")).alias("text"))
    sparse = tfidf.as_struct(tfidf.transform(told, vocab, "node_id", "text"), vocab, "node_id")
    payload = F.struct("type", "label", "topic", now().alias("created_at"), "text").alias("payload")
    return with_embedding(told, "text").join(sparse, "node_id", "left").select("node_id", "dense", "sparse", payload)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): incident edges of each node, a loop once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))
