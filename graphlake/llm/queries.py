"""Queries of the training-data operators; SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import distinctive, doc_pairs, fusion, leakage, near_duplicates, neighbors, packing, quality, splitting
from graphlake.sources.tables import latest_rows, table, valid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LIMIT, OVERLAP, LEAST = 360, 30, 120
CAPACITY = 1024
SCORES = ["weight", "similarity", "lexical", "mentions"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _leveled(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    depth = splitting.depth_by_parent(valid(spark, sf_dir, "sections").select("id", "parent_section_id"), "id", "parent_section_id")
    return chunks.join(depth.select(F.col("id").alias("section_id"), F.col("depth").alias("level")), "section_id", "left")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts within the limit need not travel to the valid-row window: they cannot be cut
    chunks = table(spark, sf_dir, "chunks").select("id", "created_at", "section_id", F.when(splitting.word_count(F.col("text")) > LIMIT, F.col("text")).alias("text"))
    pieces = splitting.split_oversized(latest_rows(chunks, "id").drop("created_at"), "text", LIMIT, OVERLAP, LEAST)
    cut = pieces.where("n_pieces > 1 and piece = 0").select("id", "section_id")
    return _leveled(spark, sf_dir, cut).select(F.col("id").alias("chunk_id"), "level")


@query
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = valid(spark, sf_dir, "chunks").select("id", "section_id", "text")
    pieces = splitting.split_oversized(chunks, "text", LIMIT, OVERLAP, LEAST)
    return _leveled(spark, sf_dir, pieces).select(F.col("id").alias("chunk_id"), "level", "piece", "n_pieces", "first_word", "end_word", "piece_text")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = latest_rows(table(spark, sf_dir, "chunks").select("id", "created_at", "text"), "id")
    found = distinctive.distinctive_terms(chunks, min_tf=3, min_df=2, max_df=6)
    return found.select(F.col("id").alias("chunk_id"), "term")


@query
def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = latest_rows(table(spark, sf_dir, "chunks").select("id", "created_at", "text"), "id")
    scored = distinctive.distinctive_terms(chunks)
    return scored.select(F.col("id").alias("chunk_id"), "term", "tf", "df", "degree", F.round("score", 6).alias("score"))


def _judged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges the judge drew, with their four scores as numbers."""
    edges = latest_rows(table(spark, sf_dir, "edges").select("id", "created_at", "source_id", "rel_type", "method", "weight", "metadata"), "id")
    judged = edges.where("method = 'llm_connection_finder' and (rel_type is null or rel_type <> 'PART_OF_CONCEPT')")
    text = F.col("metadata")
    return judged.select(
        "source_id",
        F.col("id").alias("edge_id"),
        "weight",
        fusion.read_number(text["similarity_score"]).alias("similarity"),
        fusion.read_number(text["lexical_score"], "decimal").alias("lexical"),
        fusion.read_number(text["co_mentions"], "thousands").alias("mentions"),
    )


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit("w3").alias("kind"), F.col("id").alias("key"), F.col("created_at").alias("version"), "text")
    books = table(spark, sf_dir, "books").select(F.lit("c3").alias("kind"), F.col("id").alias("key"), F.col("created_at").alias("version"), F.col("label").alias("text"))
    return chunks.unionByName(books)


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_containers(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)
    # from the placed items: a text larger than a container is there with its first piece in one
    return packed.where("n_pieces > 1 and piece = 0 and container is not null").select("doc_id")


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_containers(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


@query
def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = leakage.leaked_passages(documents, table(spark, sf_dir, "eval_items"))
    return leakage.without_leaks(documents, found).select("doc_id", "book_id", "topic", "n_chars")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = fusion.fuse_rankings(_judged_edges(spark, sf_dir), "source_id", "edge_id", SCORES, position=False)
    # three first places make at least 3 / 61 of the fused ranking; of the candidates it gives, the strict winners stay
    wins = sum(F.when((F.col(f"rank_{s}") == 1) & (F.col(f"ties_{s}") == 1), 1).otherwise(0) for s in SCORES)
    candidates = ranked.where((F.col("n_items") >= 5) & (F.col("fused") >= 3 / 61 - 1e-9))
    return candidates.where(wins >= 3).select("source_id", "edge_id")


@query
def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse_rankings(_judged_edges(spark, sf_dir), "source_id", "edge_id", SCORES)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_pairs(_shingled(spark, sf_dir), 0.6)


@query
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates.similar_groups(_shingled(spark, sf_dir), 0.6)
    return groups.select(F.col("key").alias("node_id"), "group", "n_copies", "n_links")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "source_files").select("file_id", "path", "content", "committed_at"), "file_id", "committed_at")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_pairs.documented_functions(_files(spark, sf_dir))
    return found.where(F.col("path").endswith(".py")).select("file_id", "qualified_name", "start_line").distinct()


@query
def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pairs.documented_functions(_files(spark, sf_dir))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "doc_labels").dropDuplicates()
    return quality.text_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), labels)


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


@query
def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "points").select("node_id", "dense", F.col("payload.created_at").alias("created_at"))
    return latest_rows(points, "node_id").drop("created_at")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_nodes(_points(spark, sf_dir), k=5, dimensions=64, least=0.9)
    return near.select(F.least("node_id", "other").alias("node_a"), F.greatest("node_id", "other").alias("node_b")).distinct()


@query
def p2_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "rag_results").select(F.explode("seed_node_ids").alias("node_id")).distinct()
    near = neighbors.nearest_of(seeds, _points(spark, sf_dir), k=5, dimensions=64)
    return near.select("node_id", "other", F.round("cosine", 6).alias("cosine"), "rank")


@query
def p2_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_nodes(_points(spark, sf_dir), k=5, dimensions=64)
    return near.select("node_id", "other", F.round("cosine", 6).alias("cosine"), "rank")


# --- SQL of the queries that SQL can express --------------------------------------------------------------------

_LOG = "(SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY {1} ORDER BY {2} DESC NULLS LAST) = 1)"
_CHUNKS, _SECTIONS, _EDGES = _LOG.format("chunks", "id", "created_at"), _LOG.format("sections", "id", "created_at"), _LOG.format("edges", "id", "created_at")
_POINTS = _LOG.format("points", "node_id", "payload.created_at")
_BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE["p1_found"] = f"""WITH RECURSIVE s AS (SELECT id, parent_section_id FROM {_SECTIONS}),
 d AS (SELECT id, 1 AS level FROM s WHERE parent_section_id IS NULL OR parent_section_id NOT IN (SELECT id FROM s) UNION ALL SELECT s.id, level + 1 FROM s JOIN d ON s.parent_section_id = d.id)
SELECT c.id AS chunk_id, level FROM {_CHUNKS} c LEFT JOIN d ON d.id = c.section_id WHERE len(regexp_extract_all(text, '[^{_BLANK}]+')) > 360"""

_USABLE = "len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0"
ORACLE["p2_seeds"] = f"""WITH p AS (SELECT node_id, CAST(dense AS DOUBLE[]) AS v FROM {_POINTS} WHERE {_USABLE}),
 n AS (SELECT a.node_id, b.node_id AS other, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM p a JOIN p b ON a.node_id <> b.node_id WHERE a.node_id IN (SELECT unnest(seed_node_ids) FROM rag_results))
SELECT node_id, other, round(s, 6) AS cosine, CAST(row_number() OVER (PARTITION BY node_id ORDER BY s DESC, other) AS INTEGER) AS rank FROM n QUALIFY rank <= 5"""

ORACLE["p2_found"] = f"""WITH p AS (SELECT node_id, CAST(dense AS DOUBLE[]) AS v FROM {_POINTS} WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
 n AS (SELECT a.node_id AS x, b.node_id AS y, list_cosine_similarity(a.v, b.v) AS s FROM p a JOIN p b ON a.node_id <> b.node_id QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY s DESC, b.node_id) <= 5)
SELECT DISTINCT least(x, y) AS node_a, greatest(x, y) AS node_b FROM n WHERE s >= 0.9"""


def _number(key: str, comma: str) -> str:
    bare = f"regexp_replace(metadata['{key}'], '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"
    plain = {"": "x", "d": "replace(x, ',', '.')", "t": "replace(x, ',', '')"}[comma].replace("x", f"regexp_replace({bare}, '[{_BLANK}]*%$', '')")
    value = rf"CASE WHEN regexp_matches({plain}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({plain} AS DOUBLE) END"
    return f"CASE WHEN ends_with({bare}, '%') THEN ({value}) / 100 ELSE {value} END"


ORACLE["p4_found"] = f"""WITH e AS (SELECT source_id, id, weight AS s1, {_number("similarity_score", "")} AS s2, {_number("lexical_score", "d")} AS s3, {_number("co_mentions", "t")} AS s4 FROM {_EDGES} WHERE method = 'llm_connection_finder' AND rel_type <> 'PART_OF_CONCEPT'),
 l AS (SELECT source_id, id, k, CASE WHEN isfinite(s) THEN s END AS s FROM (SELECT source_id, id, unnest([1, 2, 3, 4]) AS k, unnest([s1, s2, s3, s4]) AS s FROM e)),
 w AS (SELECT source_id, id, k FROM l WHERE s IS NOT NULL QUALIFY rank() OVER (PARTITION BY source_id, k ORDER BY s DESC) = 1 AND count(*) OVER (PARTITION BY source_id, k, s) = 1)
SELECT source_id, id AS edge_id FROM w WHERE source_id IN (SELECT source_id FROM e GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2 HAVING count(*) >= 3"""

ORACLE["p4_ranking"] = f"""WITH e AS (SELECT DISTINCT source_id, id, weight AS s1, {_number("similarity_score", "")} AS s2, {_number("lexical_score", "d")} AS s3, {_number("co_mentions", "t")} AS s4 FROM {_EDGES} WHERE method = 'llm_connection_finder' AND (rel_type IS NULL OR rel_type <> 'PART_OF_CONCEPT') AND source_id IS NOT NULL),
 f AS (SELECT source_id, id, CASE WHEN isfinite(s1) THEN s1 END AS s1, CASE WHEN isfinite(s2) THEN s2 END AS s2, CASE WHEN isfinite(s3) THEN s3 END AS s3, CASE WHEN isfinite(s4) THEN s4 END AS s4, count(*) OVER (PARTITION BY source_id) AS n_items FROM e),
 r AS (SELECT source_id, id, n_items, {", ".join(f"CASE WHEN s{n} IS NOT NULL THEN rank() OVER (PARTITION BY source_id ORDER BY s{n} DESC NULLS LAST) END AS rank_{s}, CASE WHEN s{n} IS NOT NULL THEN count(*) OVER (PARTITION BY source_id, s{n}) END AS ties_{s}" for n, s in enumerate(SCORES, 1))} FROM f),
 t AS (SELECT *, {" + ".join(f"coalesce(1::DOUBLE / (60 + rank_{s}), 0)" for s in SCORES)} AS fused FROM r)
SELECT source_id, id AS edge_id, n_items, {", ".join(f"rank_{s}, ties_{s}" for s in SCORES)}, fused, rank() OVER (PARTITION BY source_id ORDER BY fused DESC) AS position FROM t"""

ORACLE["p7_found"] = rf"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_BLANK}]+')) > {CAPACITY}"


def _plain(x: str) -> str:
    """The plain form of a text column; of character references and compatibility forms only those that the tables have."""
    x = f"regexp_replace({x}, '<[^<>]{{0,200}}>', '', 'g')"
    x = f"replace(replace(replace({x}, '&nbsp;', ' '), chr(64257), 'fi'), chr(64258), 'fl')"
    x = rf"regexp_replace(strip_accents(regexp_replace({x}, '[\x{{ad}}\x{{180e}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g')), '\p{{M}}', '', 'g')"
    for _ in range(2):  # a match takes the letters beside it, so neighbours need a second turn
        x = rf"regexp_replace({x}, '(\p{{L}})[-\x{{2010}}][ \t]*\r?\n[ \t]*(\p{{L}})', '\1\2', 'g')"
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


_BOOKS = _LOG.format("books", "id", "created_at")

ORACLE["p3_found"] = rf"""WITH t AS (SELECT id, unnest({_plain("text")}) AS term FROM {_CHUNKS}), c AS (SELECT id, term, count(*) AS tf FROM t WHERE regexp_matches(term, '^\p{{L}}+$') GROUP BY 1, 2)
SELECT id AS chunk_id, term FROM c QUALIFY tf >= 3 AND count(*) OVER (PARTITION BY term) BETWEEN 2 AND 6"""

_PAIRS = f"""w AS (SELECT id, {_plain("text")} AS w FROM {_CHUNKS}), b AS (SELECT id, array_to_string({_plain("label")}, ' ') AS w FROM {_BOOKS}),
 s AS (SELECT DISTINCT 'w' AS kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w UNION SELECT DISTINCT 'c', id, unnest(list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2])) FROM b),
 n AS (SELECT kind, id, count(*) AS n, md5(kind || string_agg(g, chr(10) ORDER BY g)) AS sig FROM s GROUP BY 1, 2), p AS (SELECT x.kind, x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.kind = y.kind AND x.g = y.g AND x.id < y.id GROUP BY 1, 2, 3),
 pairs AS (SELECT a AS node_a, b AS node_b FROM p JOIN n l ON l.kind = p.kind AND l.id = a JOIN n r ON r.kind = p.kind AND r.id = b WHERE shared * 10 >= 6 * (l.n + r.n - shared))"""
ORACLE["p6_found"] = f"WITH {_PAIRS} SELECT * FROM pairs"
ORACLE["p6_groups"] = f"""WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT node_a AS a, node_b AS b FROM pairs UNION ALL SELECT node_b, node_a FROM pairs UNION ALL SELECT id, id FROM n),
 r AS (SELECT a, b FROM both_ways UNION SELECT r.a, y.b FROM r JOIN both_ways y ON r.b = y.a), g AS (SELECT a AS id, min(b) AS grp FROM r GROUP BY 1)
SELECT n.id AS node_id, grp AS "group", count(*) OVER (PARTITION BY n.sig) AS n_copies, (SELECT count(DISTINCT o.sig) FROM both_ways y JOIN n o ON o.id = y.b WHERE y.a = n.id AND o.sig <> n.sig) AS n_links FROM n JOIN g ON g.id = n.id"""

_RUNS = "SELECT DISTINCT {0}, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS run FROM (SELECT {0}, {1} AS w FROM {2})"
_LEAKS = f"""d AS ({_RUNS.format("doc_id", _plain("text"), "documents")}), e AS ({_RUNS.format("item_id", _plain("text"), "eval_items")}), leaks AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run))"""
ORACLE["p8_found"] = f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks"
ORACLE["p8_clean"] = f"WITH {_LEAKS} SELECT doc_id, book_id, topic, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)"

ORACLE["p2_neighbors"] = f"""WITH p AS (SELECT node_id, CAST(dense AS DOUBLE[]) AS v FROM {_POINTS} WHERE {_USABLE}),
 n AS (SELECT a.node_id, b.node_id AS other, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM p a JOIN p b ON a.node_id <> b.node_id)
SELECT node_id, other, round(s, 6) AS cosine, CAST(row_number() OVER (PARTITION BY node_id ORDER BY s DESC, other) AS INTEGER) AS rank FROM n QUALIFY rank <= 5"""

ORACLE["p3_scores"] = rf"""WITH w AS (SELECT id, {_plain("text")} AS w FROM {_CHUNKS}), t AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w),
 c AS (SELECT id, term, count(*) AS tf FROM t WHERE regexp_matches(term, '^\p{{L}}+$') GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
 g AS (SELECT a.id, a.term, count(DISTINCT b.term) FILTER (b.term <> a.term) AS degree FROM t a JOIN t b ON a.id = b.id AND abs(a.i - b.i) < 4 GROUP BY 1, 2)
SELECT id AS chunk_id, term, CAST(tf AS INTEGER) AS tf, df, CAST(degree AS INTEGER) AS degree, round(degree * ln(((SELECT count(*) FROM w) + 1) / df), 6) AS score FROM c JOIN f USING (term) JOIN g USING (id, term)"""

ORACLE["p8_passages"] = f"""WITH d AS (SELECT doc_id, {_plain("text")} AS w FROM documents), e AS (SELECT item_id, {_plain("text")} AS w FROM eval_items),
 dr AS (SELECT doc_id, i, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d)), er AS (SELECT item_id, i, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM e)),
 m AS (SELECT doc_id, item_id, dr.i AS a, er.i AS b FROM dr JOIN er USING (run)), r AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS island FROM m)
SELECT doc_id, item_id, min(a) - 1 AS doc_word, min(b) - 1 AS item_word, count(*) + 9 AS n_words FROM r GROUP BY doc_id, item_id, a - b, island"""
