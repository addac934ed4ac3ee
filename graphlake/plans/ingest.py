"""Whole pipelines: books and code to nodes, edges, terms and points; the connection pass over chunks."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.config import DEFAULTS, Settings
from graphlake.functions import text as T
from graphlake.operators import chunking, code_parser, judge, resolve, similarity, tfidf
from graphlake.operators.embed import with_embedding
from graphlake.operators.store import GraphTables, embed_and_upsert
from graphlake.schema import bootstrap, stable_id
from graphlake.session import cut_lineage
from graphlake.sources import catalog


@dataclass(frozen=True)
class Ingested:
    """Tables of one run, all lazily derived from the same lineage, and its report."""

    nodes: DataFrame
    edges: DataFrame
    vocabulary: DataFrame
    terms: DataFrame
    points: DataFrame
    report: DataFrame


def _nodes(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ingest_books(books: DataFrame, settings: Settings = DEFAULTS) -> Ingested:
    """books (gutenberg_id, title, author, topic, text)."""
    named = books.select(stable_id("book", "topic", "gutenberg_id").alias("id"), F.lit("Book").alias("type"), F.substring("title", 1, 150).alias("label"), "topic", "author", "gutenberg_id", "text")
    sections, chunks = chunking.chunk_books(named, settings)
    chunks = cut_lineage(chunks)
    edges = chunking.structural_edges(sections, chunks)
    vocab, terms = tfidf.fit_transform(chunks, "id", "text", settings.max_features)
    points = with_embedding(chunks.select(F.col("id").alias("node_id"), "type", "label", "topic", "text"), "text")
    per_book = sections.groupBy("book_id").agg(F.count("*").alias("sections")).join(chunks.groupBy("book_id").agg(F.count("*").alias("chunks")), "book_id", "left")
    report = named.join(per_book.withColumnRenamed("book_id", "id"), "id", "left").select("id", "label", "topic", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return Ingested(_nodes(named.drop("text"), sections, chunks), edges, vocab, terms, points, report)


def ingest_code(files: DataFrame, vocab: DataFrame | None = None, settings: Settings = DEFAULTS) -> Ingested:
    """files (file_id, repo, path, module_path, language, loc, content, topic); with a vocabulary the sparse space is extended into, else fitted."""
    parsed = cut_lineage(code_parser.parse_files(files, settings))
    symbols, imports = code_parser.symbols_of(parsed), code_parser.imports_table(parsed)
    edges = code_parser.symbol_edges(symbols).unionByName(resolve.static_edges(files, symbols, imports))
    placed = symbols.join(files.select("file_id", "path", "topic"), "file_id")
    facts = {c: F.col(c) for c in ("kind", "qualified_name", "signature", "name", "base_classes", "path", "decorators", "docstring", "calls_raw", "text")}
    cards = placed.select(F.col("id").alias("node_id"), F.lit("Chunk").alias("type"), "label", "topic", T.embedding_card(facts).alias("text"), T.sparse_card(facts).alias("sparse_text"))
    if vocab is None:
        vocab, terms = tfidf.fit_transform(cards, "node_id", "sparse_text", settings.max_features)
    else:
        terms = tfidf.transform(cards, vocab, "node_id", "sparse_text")
    points = with_embedding(cards.drop("sparse_text"), "text")
    counts = symbols.groupBy("file_id").agg(F.count("*").alias("symbols"))
    report = files.select("file_id", "path", "loc").join(counts, "file_id", "left")
    file_nodes = files.select(F.col("file_id").alias("id"), F.lit("CodeFile").alias("type"), F.col("path").alias("label"), "topic", "repo", "path", "module_path", "language", "loc")
    symbol_nodes = placed.select("id", F.lit("Chunk").alias("type"), *[c for c in placed.columns if c not in ("id", "path")])
    return Ingested(_nodes(file_nodes, symbol_nodes), edges, vocab, terms, points, report)


@dataclass(frozen=True)
class Connected:
    pairs: DataFrame
    edges: DataFrame
    concepts: DataFrame
    concept_edges: DataFrame
    summary: DataFrame

    def united(self) -> DataFrame:
        """Typed edges and concept edges as one table."""
        return self.edges.unionByName(self.concept_edges)


#: Chunks of a pass that are held against all others to learn which score the judged pairs have at least.
SAMPLE = 512


def _contenders(mine: DataFrame, chunks: DataFrame, k: int, settings: Settings, partition: str) -> DataFrame:
    """Those of mine (node_id, dense, packed, partition) that can be in a judged pair; passes of at most SAMPLE chunks stay whole.

    The candidates of a sample of chunks are candidates of the whole pass. If there are as many as are judged, no judged pair
    scores less than the last of them, and as the sparse part of a score is bounded, both of its chunks have another one at
    a cosine above a floor. Only chunks without such a neighbour are left out, so the judged pairs are those of all chunks.
    """
    sizes = {r[partition]: r["count"] for r in mine.groupBy(partition).count().collect() if r["count"] > SAMPLE}
    if not sizes or settings.dense_weight <= 0:
        return mine
    large = mine.where(F.col(partition).isin(list(sizes)))
    order = Window.partitionBy(partition).orderBy(F.xxhash64("node_id"), "node_id")
    drawn = large.select("node_id", partition).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= SAMPLE).select(F.col("node_id").alias("query_id"))
    sample = large.withColumnRenamed("node_id", "query_id").join(F.broadcast(cut_lineage(drawn)), "query_id", "left_semi")
    scores = similarity.pair_scores(sample, large, k + 2, settings.similarity_threshold, partition, settings.dense_weight, settings.sparse_weight, True)
    candidates = similarity.top_candidates(scores, k, settings.similarity_threshold, chunks.select(F.col("id").alias("node_id"), "position"))
    candidates = candidates.join(chunks.select(F.col("id").alias("source_id"), partition), "source_id")
    last = judge.best_pairs(candidates, settings.judged_pairs, partition).groupBy(partition).agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= settings.judged_pairs)
    # the product of two lengths bounds a sparse score
    longest = large.groupBy(partition).agg(F.max(F.aggregate(F.coalesce("packed.weights", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
    floors = {r[partition]: (r["least"] - settings.sparse_weight * r["most"]) / settings.dense_weight - 1e-4 for r in last.join(longest, partition).collect()}
    floors = {name: floor for name, floor in floors.items() if floor > 0}
    if not floors:
        return mine
    near = similarity.near_points(large, floors, partition)
    rest = mine.where(~F.col(partition).isin(list(floors)))
    return cut_lineage(rest.unionByName(mine.where(F.col(partition).isin(list(floors))).join(near, "node_id", "left_semi")))


def connection_pass(chunks: DataFrame, points: DataFrame, terms: DataFrame, provider: judge.Provider | None = None, existing: DataFrame | None = None, k: int = 4, settings: Settings = DEFAULTS, partition: str | None = None, max_chunks: int | None = None) -> Connected:
    """Candidate pairs among chunks (id, topic, text, metadata, position), judged by the provider or else by rule, to typed edges and concepts.

    All pairs of chunks are scored, in blocks; positions must be unique. Fewer than two chunks give a summary of zeros.
    With ``partition`` (a column of chunks, not null) one plan runs a pass for each of its values: pairs, their limit, positions and
    the summary are by value; a concept that several passes name is one node and counts in each. With ``max_chunks`` only so many
    first positions (the newest chunks, say) of a pass take part.
    """
    if max_chunks is not None:
        if partition:
            order = Window.partitionBy(partition).orderBy("position")
            chunks = chunks.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= max_chunks).drop("__r")
        else:
            chunks = chunks.orderBy("position").limit(max_chunks)
    packed = similarity.pack_terms(terms.select(F.col("id").alias("node_id"), "term", "weight"), "node_id")
    groups = [partition] if partition else []
    mine = chunks.select(F.col("id").alias("node_id"), *groups).join(points.select("node_id", "dense"), "node_id", "left").join(packed, "node_id", "left")
    mine = cut_lineage(mine)
    if partition:
        mine = _contenders(mine, chunks, k, settings, partition)
    # at most two neighbours in the list are masked, so the best k + 2 hold the best k of the rest
    scores = similarity.pair_scores(mine.withColumnRenamed("node_id", "query_id"), mine, k + 2, settings.similarity_threshold, partition, settings.dense_weight, settings.sparse_weight, True)
    candidates = similarity.top_candidates(scores, k, settings.similarity_threshold, chunks.select(F.col("id").alias("node_id"), "position"))
    if partition:
        candidates = candidates.join(chunks.select(F.col("id").alias("source_id"), partition), "source_id")
    pairs = cut_lineage(judge.best_pairs(candidates, settings.judged_pairs, partition))
    replies = judge.ask(judge.pair_prompts(pairs, chunks), provider) if provider else judge.rule_judgments(pairs)
    found = cut_lineage(judge.judged(replies))
    edges = judge.typed_edges(found, judge.author(provider))
    nodes, concept_edges = judge.concepts(found, existing, chunks.select("id", "topic"), judge.author(provider))
    summary = judge.pass_summaries(chunks, pairs, edges, concept_edges, partition) if partition else judge.pass_summary(pairs, edges, nodes, concept_edges)
    return Connected(pairs, edges, nodes, concept_edges, summary)


def load_graph(spark: SparkSession, root: str) -> GraphTables:
    """The graph below root; its tables are made if absent."""
    return GraphTables(**bootstrap(spark, root))


def save_graph(graph: GraphTables, root: str) -> GraphTables:
    """Writes the tables below root and reads them again; all are computed before the first is replaced, as they may come from there."""
    spark = graph.nodes.sparkSession
    for name, table in [(n, cut_lineage(t)) for n, t in (("nodes", graph.nodes), ("edges", graph.edges), ("points", graph.points))]:
        table.write.mode("overwrite").parquet(f"{root}/{name}")
    return load_graph(spark, root)


def stored_points(done: Ingested) -> DataFrame:
    """Points of a run as they are stored: dense, sparse and payload."""
    of = done.points.select("node_id", "dense", "type", "label", "topic")
    sparse = tfidf.as_struct(done.terms.withColumnRenamed(done.terms.columns[0], "node_id"), done.vocabulary, "node_id")
    payload = F.struct("type", "label", "topic", F.lit(None).cast("double").alias("created_at")).alias("payload")
    return of.join(sparse, "node_id", "left").select("node_id", "dense", "sparse", payload)


def _listed(chunks: DataFrame, partition: str) -> DataFrame:
    """Chunks with their position in the store's list: newest first."""
    return chunks.withColumn("position", F.row_number().over(Window.partitionBy(partition).orderBy(F.desc_nulls_first("created_at"), "id")))


def _stored(graph: GraphTables, done: Ingested, root: str) -> GraphTables:
    points = stored_points(done)
    graph = graph.upsert_nodes(done.nodes)
    graph = GraphTables(graph.nodes, graph.edges, graph.points.select("node_id", "dense", "sparse", "payload")).upsert_points(points)
    tfidf.save_vocabulary(done.vocabulary, f"{root}/vocabulary")
    return save_graph(graph.upsert_edges(done.edges), root)


def _connected(graph: GraphTables, done: Ingested, root: str, provider: judge.Provider | None, settings: Settings) -> tuple[GraphTables, DataFrame]:
    """Runs a pass for each topic; concepts go in before the edges that end at them."""
    chunks = graph.nodes.where("type = 'Chunk'").join(done.points.select(F.col("node_id").alias("id")), "id", "left_semi").withColumn("pass_topic", F.coalesce("topic", F.lit("")))
    for name, kind in (("text", "string"), ("order_index", "int")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    known = graph.nodes.where("type = 'Concept'")
    terms = done.terms.withColumnRenamed(done.terms.columns[0], "id")
    out = connection_pass(_listed(chunks, "pass_topic"), graph.points, terms, provider, known, settings=settings, partition="pass_topic", max_chunks=settings.pass_chunks)
    # what is told and found was read from tables that are replaced below
    named, told = cut_lineage(out.concepts), cut_lineage(out.summary)
    vocab = tfidf.load_vocabulary(graph.nodes.sparkSession, f"{root}/vocabulary")
    graph = embed_and_upsert(graph, named.withColumn("text", F.concat_ws(". ", "label", "description")), "text", vocab)
    return save_graph(graph.upsert_edges(out.united()), root), told


@dataclass(frozen=True)
class Run:
    """What a run left below its root, and what it tells of itself."""

    graph: GraphTables
    report: DataFrame
    connections: DataFrame | None
    without_hits: list[str]
    elapsed_seconds: float


def run_books(spark: SparkSession, texts: DataFrame, root: str, topic: str | None = None, max_books: int = 1, connect: bool = True, provider: judge.Provider | None = None, settings: Settings = DEFAULTS) -> Run:
    """The whole pipeline: the catalogue's books with a text (gutenberg_id, text), of one topic or all, are fetched, structured, stored below root and connected.

    ``elapsed_seconds`` is the time until everything was written. Running it again changes nothing but that.
    """
    began = time.time()
    listed = catalog.catalog(spark)
    fetched = cut_lineage(catalog.fetch_topic(listed, texts, topic, max_books))
    wanted = listed.where(F.col("topic") == topic) if topic else listed
    without = sorted(r["topic"] for r in catalog.topics_without_hits(wanted, fetched).collect())  # topics of the catalogue
    done = ingest_books(fetched, settings)
    graph = _stored(load_graph(spark, root), done, root)
    graph, told = _connected(graph, done, root, provider, settings) if connect else (graph, None)
    return Run(graph, cut_lineage(done.report), told, without, time.time() - began)


def run_code(spark: SparkSession, files: DataFrame, root: str, connect: bool = False, provider: judge.Provider | None = None, settings: Settings = DEFAULTS) -> Run:
    """The same for source files as of ingest_code; a vocabulary that is there is kept and the sparse space extended into."""
    began = time.time()
    try:
        vocab = cut_lineage(tfidf.load_vocabulary(spark, f"{root}/vocabulary"))
    except AnalysisException:
        vocab = None
    done = ingest_code(files, vocab, settings)
    graph = _stored(load_graph(spark, root), done, root)
    graph, told = _connected(graph, done, root, provider, settings) if connect else (graph, None)
    return Run(graph, cut_lineage(done.report), told, [], time.time() - began)
