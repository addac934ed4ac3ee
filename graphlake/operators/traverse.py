"""Neighbourhoods, hops and induced subgraphs, for many centres at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.session import cut_lineage


def incident(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed_id, edge_id, rel_type, explanation, outgoing, neighbor_id): all edges at each seed, undirected; a loop counts once, as outgoing."""
    e = edges.select(F.col("id").alias("edge_id"), "source_id", "target_id", "rel_type", F.coalesce("explanation", F.lit("")).alias("explanation"))
    out = e.select(F.col("source_id").alias("seed_id"), "edge_id", "rel_type", "explanation", F.lit(True).alias("outgoing"), F.col("target_id").alias("neighbor_id"))
    into = e.where("source_id <> target_id").select(F.col("target_id").alias("seed_id"), "edge_id", "rel_type", "explanation", F.lit(False).alias("outgoing"), F.col("source_id").alias("neighbor_id"))
    return out.unionByName(into).join(seeds.select("seed_id").distinct(), "seed_id")


def capped(near: DataFrame, nodes: DataFrame | None = None, limit: int | None = 50) -> DataFrame:
    """Incident edges with ``ordinal``, at most ``limit`` of each seed in order of type, neighbour, edge; with nodes (id), those with an end that is gone are left out first."""
    if nodes is not None:
        near = near.join(nodes.select(F.col("id").alias("seed_id")), "seed_id", "left_semi").join(nodes.select(F.col("id").alias("neighbor_id")), "neighbor_id", "left_semi")
    order = Window.partitionBy("seed_id").orderBy("rel_type", "neighbor_id", "edge_id")
    near = near.withColumn("ordinal", F.row_number().over(order))
    near = near.where(F.col("ordinal") <= limit) if limit else near
    return near.select("seed_id", "edge_id", "rel_type", "explanation", "outgoing", "neighbor_id", "ordinal")


def neighborhood(seeds: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, limit: int | None = 50) -> DataFrame:
    """(seed_id, edge_id, rel_type, explanation, outgoing, neighbor_id, ordinal): undirected one-hop edges of each seed, at most ``limit`` in order of type, neighbour, edge.

    A loop counts once, as outgoing. Edges are cut to those that touch a seed before anything else is asked of them. The
    cap is a group limit ahead of the shuffle, so hubs stay cheap. With nodes, edges to nodes that are gone are left out.
    """
    return capped(incident(seeds, edges), nodes, limit)


#: Neighbours from which a node is a hub: what lies behind it is not gathered row by row.
HUB = 64
#: Nodes and seeds of a hub that are multiplied at once.
HUB_NODES, HUB_SEEDS = 4096, 2048
#: Rows up to which a table of nodes is broadcast.
SHARED_ROWS = 500_000
#: Rows of hubs for which there is a task.
TASK_ROWS = 8_000_000


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed_id, node_id, distance): nodes within so many undirected hops of each seed, at their least distance.

    Each step spreads the frontier over the edges. In the last step, which gives most of the rows, what lies behind hubs is not spread and
    then gathered again to be made distinct: see _behind_hubs.
    """
    # the ends are written once, so that each step reads them and does not ask for the edges' valid rows again
    ends = cut_lineage(edges.select("source_id", "target_id").where("source_id is not null or target_id is not null"))
    both = ends.select(F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("e")).select("e.a", "e.b").where("a is not null")
    seen = seeds.select("seed_id", F.col("seed_id").alias("node_id"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in range(1, hops):
        step = both.join(_shared(frontier.select("seed_id", F.col("node_id").alias("a"))), "a").select("seed_id", F.col("b").alias("node_id"))
        frontier = cut_lineage(_unseen(step, seen).withColumn("distance", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return _last_hop(frontier, seen, both, hops) if hops > 0 else seen


def _shared(written: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(written) if written.count() <= SHARED_ROWS else written


def _last_hop(frontier: DataFrame, seen: DataFrame, both: DataFrame, hop: int) -> DataFrame:
    """seen and the nodes next to the frontier that are not seen."""
    stands = frontier.select("seed_id", F.col("node_id").alias("a"))
    near = both.join(_shared(cut_lineage(stands.select("a").distinct())), "a", "left_semi")
    # an edge that is there several times counts as often: the count only tells who is taken for a hub, and in how many parts
    counted = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
    hubs = cut_lineage(counted.withColumn("hub", F.row_number().over(Window.orderBy(F.desc("n"), "a"))).select("a", "hub", F.ceil(F.col("n") / HUB_NODES).cast("int").alias("parts")))
    if hubs.isEmpty():
        light = stands.join(near, "a").select("seed_id", F.col("b").alias("node_id"))
        return seen.unionByName(_unseen(light, seen).withColumn("distance", F.lit(hop)))
    named = _shared(hubs)
    at_hubs = stands.join(named, "a").select("seed_id", "hub", "parts")
    behind = cut_lineage(both.where("b is not null").join(named, "a").select("b", "hub", "parts").distinct().select("b", "hub", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")))
    of_seed = at_hubs.groupBy("seed_id").agg(F.collect_list("hub").alias("seed_hubs"))
    of_node = behind.groupBy("b").agg(F.collect_list("hub").alias("node_hubs"))
    # the rest: what a hub of the seed also leads to is left to the hub
    lone = stands.join(_shared(hubs.select("a")), "a", "left_anti").join(of_seed, "seed_id", "left")
    beyond = near.join(_shared(hubs.select("a")), "a", "left_anti").join(_shared(cut_lineage(of_node)), "b", "left")
    light = lone.join(beyond, "a").where(~F.coalesce(F.arrays_overlap("seed_hubs", "node_hubs"), F.lit(False))).select("seed_id", F.col("b").alias("node_id"))
    # edges of a hub that lack their other end
    light = light.unionByName(stands.join(near.where("b is null").join(_shared(hubs.select("a")), "a", "left_semi"), "a").select("seed_id", F.col("b").alias("node_id")))
    both_kinds = _unseen(light, seen).unionByName(_behind_hubs(at_hubs, behind, of_seed, of_node, seen))
    return seen.unionByName(both_kinds.withColumn("distance", F.lit(hop)))


def _unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    old = seen.select(F.col("seed_id").alias("s"), F.col("node_id").alias("n"))
    return rows.distinct().join(old, (F.col("seed_id") == F.col("s")) & F.col("node_id").eqNullSafe(F.col("n")), "left_anti")


def _behind_hubs(at_hubs: DataFrame, behind: DataFrame, of_seed: DataFrame, of_node: DataFrame, seen: DataFrame) -> DataFrame:
    """(seed_id, node_id): nodes behind the hubs of each seed, but those it has seen.

    Every seed at a hub (seed_id, hub, parts) gets every node behind it (b, hub, part). Blocks of seeds and of nodes are
    joined and unfold where they are, so the rows, seeds times nodes, take no shuffle: they are distinct as it is. For that, a node that
    several hubs of a seed lead to comes with the first of them, the largest; what the seed has seen is listed for each block.
    """
    groups = at_hubs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SEEDS).cast("int").alias("groups"))
    known = seen.select("seed_id", F.col("node_id").alias("b")).join(behind, "b").groupBy("seed_id", "hub", "part").agg(F.collect_list("b").alias("known"))
    asked = at_hubs.join(groups, "hub").join(of_seed, "seed_id").withColumn("earlier", F.filter("seed_hubs", lambda h: h < F.col("hub")))
    asked = asked.select("seed_id", "hub", "earlier", F.pmod(F.xxhash64("seed_id"), "groups").alias("group"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = asked.join(known, ["seed_id", "hub", "part"], "left").groupBy("hub", "part", "group").agg(F.collect_list(F.struct("seed_id", "earlier", "known")).alias("seeds"))
    nodes = behind.join(of_node, "b").groupBy("hub", "part").agg(F.collect_list(F.struct("b", "node_hubs")).alias("nodes"))
    units = cut_lineage(asked.join(nodes, ["hub", "part"]).select("seeds", "nodes"))
    total = units.agg(F.sum(F.size("seeds").cast("long") * F.size("nodes"))).first()[0] or 0
    # a number of its own, as tasks would otherwise be made by what they read, not by what they give
    split = units.repartition(1 + total // TASK_ROWS).select("nodes", F.explode("seeds").alias("s"))
    fresh = F.filter("nodes", lambda n: ~F.coalesce(F.array_contains("s.known", n["b"]), F.lit(False)) & ~F.arrays_overlap(n["node_hubs"], F.col("s.earlier")))
    left = F.when(F.col("s.known").isNull() & (F.size("s.earlier") == 0), F.col("nodes.b")).otherwise(F.transform(fresh, lambda n: n["b"]))
    return split.select(F.col("s.seed_id").alias("seed_id"), F.explode(left).alias("node_id"))


def induced_subgraph(nodes: DataFrame, edges: DataFrame, per_node: int | None = 30) -> DataFrame:
    """Edges with both ends among nodes (id), of at most ``per_node`` incident edges of each node, once each."""
    near = neighborhood(nodes.select(F.col("id").alias("seed_id")), edges, None, per_node)
    kept = edges.join(near.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")
    ids = nodes.select("id").distinct()
    return kept.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def visual_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.substring("label", 1, 40).alias("label"), F.col("type").alias("group"), F.col("topic").alias("title"))
