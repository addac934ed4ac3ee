"""Queries of the engine's operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.functions import text as T
from graphlake.functions import vector as V
from graphlake.operators import chunking, code_parser, embed, judge, merge, resolve, similarity, store, tfidf, traverse
from graphlake.operators.ranking import group_ranks
from graphlake.plans import answer, ingest
from graphlake.schema import duplicate_keys, make_edges
from graphlake.session import cut_lineage
from graphlake.sources import catalog as books_catalog
from graphlake.sources import files as file_sources
from graphlake.sources.tables import latest_rows, table, valid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _v(name: str) -> str:
    key, version = ("node_id", "payload.created_at") if name == "points" else ("id", "created_at")
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {version} DESC NULLS LAST) = 1)"


_NODES = f"""nodes AS (
  SELECT id, type, label, topic, created_by, created_at, NULL::VARCHAR AS text, NULL::VARCHAR AS description FROM {_v("books")}
  UNION ALL SELECT id, type, label, topic, created_by, created_at, NULL, NULL FROM {_v("sections")}
  UNION ALL SELECT id, type, label, topic, created_by, created_at, text, NULL FROM {_v("chunks")}
  UNION ALL SELECT id, type, label, topic, created_by, created_at, NULL, description FROM {_v("concepts")}
  UNION ALL SELECT id, type, label, topic, created_by, created_at, text, NULL FROM {_v("code_symbols")})"""
_EDGES = f"edges_v AS {_v('edges')}"
_SPACE = r"[\t-\r \x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({_strip(x)}, '{_SPACE}+'), lambda w: w <> '')"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    base = ["id", "type", "label", "topic", "created_by", "created_at"]
    parts = []
    for name in ("books", "sections", "chunks", "concepts", "code_symbols"):
        extra = {"chunks": "text", "code_symbols": "text", "concepts": "description"}.get(name)
        rows = table(spark, sf, name)
        parts.append(rows.select(F.lit(name).alias("log"), *base, *[(c(x) if x == extra else F.lit(None).cast("string")).alias(x) for x in ("text", "description")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # the union comes first: one of parts that are already split by id counts as split by id, which fails where its shuffles are reused
    return latest_rows(out, ["log", "id"]).drop("log")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return valid(spark, sf, "edges")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return valid(spark, sf, "chunks")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return valid(spark, sf, "points").select("node_id", "dense", "sparse", c("payload.type").alias("type"), c("payload.topic").alias("topic"), c("payload.label").alias("label"))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: nodes named as seeds of stored answers."""
    return table(spark, sf, "rag_results").select(F.explode("seed_node_ids").alias("query_id")).where("query_id is not null").distinct()


# --- sources ---------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, {g})" for t, ids in books_catalog.TOPICS for i, g in enumerate(ids)) + ") AS t(topic, position, gutenberg_id)")
def catalog_topics(spark, sf):
    return books_catalog.catalog(spark).select("topic", "position", "gutenberg_id")


_CATALOG = "cat AS (SELECT t.topic, t.position, t.gutenberg_id, b.title FROM (VALUES " + ", ".join(f"('{t}', {i}, {g})" for t, ids in books_catalog.TOPICS for i, g in enumerate(ids)) + ") AS t(topic, position, gutenberg_id) JOIN (VALUES " + ", ".join("({}, '{}')".format(g, title.replace("'", "''")) for g, title, _ in books_catalog.BOOKS) + ") AS b(gutenberg_id, title) USING (gutenberg_id))"


@query(f"""WITH {_CATALOG}, first AS (SELECT * FROM cat QUALIFY row_number() OVER (PARTITION BY topic ORDER BY position) <= 2)
SELECT topic, gutenberg_id, left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug, length(repeat(title || '. ', 60)) AS n_chars FROM first WHERE length(repeat(title || '. ', 60)) >= 2000""")
def catalog_fetch(spark, sf):
    listed = books_catalog.catalog(spark)
    texts = listed.select("gutenberg_id", F.repeat(F.concat("title", F.lit(". ")), F.lit(60)).alias("text")).distinct()
    got = books_catalog.fetch_topic(listed, texts, None, 2)
    return got.select("topic", "gutenberg_id", T.slugify(c("title")).alias("slug"), F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {_CATALOG} SELECT DISTINCT topic FROM cat WHERE topic NOT IN (SELECT topic FROM {_v('books')} WHERE topic IS NOT NULL)")
def topics_without_hits(spark, sf):
    return books_catalog.topics_without_hits(books_catalog.catalog(spark), valid(spark, sf, "books"))


_FILES = "files AS (SELECT DISTINCT ON (file_id) file_id, repo, path, content FROM source_files)"


@query(rf"""WITH {_FILES} SELECT file_id, replace(regexp_replace(regexp_replace(path, '\.[^./]+$', ''), '(^|/)__init__$', ''), '/', '.') AS module_path,
CASE WHEN ends_with(path, '.py') THEN 'python' END AS language, CAST(len(string_split(content, chr(10))) AS BIGINT) AS loc,
ends_with(path, '.py') AND NOT regexp_matches('/' || path, '/(build|dist|venv|\.git|node_modules|__pycache__|\.venv|\.tox|\.mypy_cache|\.pytest_cache)/') AND octet_length(encode(content)) <= 512000 AS wanted FROM files""")
def source_scan(spark, sf):
    files = table(spark, sf, "source_files").dropDuplicates(["file_id"])
    wanted = file_sources.source_filter(c("path"), F.octet_length("content"))
    return files.select("file_id", file_sources.module_path(c("path")).alias("module_path"), file_sources.language_for_path(c("path")).alias("language"), (F.regexp_count("content", F.lit("\n")) + 1).cast("long").alias("loc"), wanted.alias("wanted"))


@query(f"WITH {_NODES} SELECT id, type, label, topic FROM nodes WHERE type = 'Chunk' AND topic = 'data_systems' AND (contains(lower(label), 'the w') OR contains(lower(coalesce(text, '')), 'the w')) ORDER BY created_at DESC NULLS FIRST, id LIMIT 100")
def node_list(spark, sf):
    return store.list_nodes(_nodes(spark, sf), "Chunk", "data_systems", "the w").select("id", "type", "label", "topic")


@query(f"WITH {_NODES} SELECT id, type, label, topic, created_by FROM nodes WHERE id IN (SELECT unnest(seed_node_ids) FROM rag_results)")
def node_get(spark, sf):
    return _nodes(spark, sf).join(_seeds(spark, sf).withColumnRenamed("query_id", "id"), "id", "left_semi").select("id", "type", "label", "topic", "created_by")


@query(f"SELECT node_id, payload.type AS type, payload.label AS label FROM {_v('points')} WHERE node_id IN (SELECT unnest(seed_node_ids) FROM rag_results)")
def point_get(spark, sf):
    return _points(spark, sf).join(_seeds(spark, sf).withColumnRenamed("query_id", "node_id"), "node_id", "left_semi").select("node_id", "type", "label")


@query(f"SELECT count(*) AS points, count(dense) AS dense, count(sparse) AS sparse FROM {_v('points')}")
def collection_stats(spark, sf):
    return _points(spark, sf).agg(F.count("*").alias("points"), F.count("dense").alias("dense"), F.count("sparse").alias("sparse"))


# --- text and chunking -----------------------------------------------------------------------------------------

_BANNERED = "'*** START OF THIS PROJECT GUTENBERG EBOOK X ***' || chr(13) || chr(10) || text || chr(10) || '*** END OF THIS PROJECT GUTENBERG EBOOK X ***' || chr(10) || 'more'"



def _cleaned(x: str) -> str:
    body = _strip(rf"regexp_replace(regexp_replace({x}, '(?is)^.*?\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*', ''), '(?is)\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG EBOOK.*$', '')")
    return rf"regexp_replace(regexp_replace({body}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, md5({_cleaned(_BANNERED)}) AS digest FROM documents")
def clean_text(spark, sf):
    mark = F.concat(F.lit("*** START OF THIS PROJECT GUTENBERG EBOOK X ***\r\n"), c("text"), F.lit("\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\nmore"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_text(mark)).alias("digest"))


# fixed values: the patterns of headings
_IS_HEADING = rf"""(length(s) BETWEEN 1 AND 90 AND (regexp_matches(s, '(?i)^(CHAPTER|PART|SECTION|BOOK){_SPACE}+[IVXLCDM\p{{Nd}}]+\.?{_SPACE}*[:.\-]?{_SPACE}*[^\n]*$')
 OR (regexp_matches(s, '^[A-Z][A-Z0-9 ,''\-:]{{3,70}}$') AND len(regexp_split_to_array(s, '{_SPACE}+')) <= 12)))"""


def _lines(source: str) -> str:
    return f"lines AS (SELECT doc_id, pos, line, {_strip('line')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source}))"


_LINES = _lines("documents")


@query(f"WITH {_LINES} SELECT doc_id, pos - 1 AS pos, s AS title FROM lines WHERE {_IS_HEADING}")
def line_headings(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(T.is_heading(c("line"))).select("doc_id", c("pos").cast("long").alias("pos"), T.strip(c("line")).alias("title"))


_SECTIONS_OF = f"""marked AS (SELECT *, {_IS_HEADING} AS head FROM lines),
 numbered AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM marked),
 grouped AS (SELECT doc_id, sec, max(CASE WHEN head THEN s END) AS title, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head) AS body, count(*) FILTER (NOT head) AS n FROM numbered GROUP BY doc_id, sec),
 sections_v AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS section_order, coalesce(title, 'Full Text') AS title, body FROM grouped WHERE n > 0)"""
_SECTIONS = f"{_LINES}, {_SECTIONS_OF}"


@query(f"WITH {_SECTIONS} SELECT doc_id, section_order, title, md5(body) AS digest FROM sections_v")
def split_sections(spark, sf):
    found = chunking.split_sections(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", "section_order", "title", F.md5("body").alias("digest"))


_PACKED = rf"""paras AS (SELECT doc_id, section_order, list_transform(list_filter(regexp_split_to_array(body, '\n\s*\n'), lambda p: {_strip("p")} <> ''), lambda p: {_words("p")}) AS ps FROM sections_v),
 folded AS (SELECT doc_id, section_order, list_reduce(ps, lambda a, p: CASE WHEN len(a.cur) + len(p.cur) >= 180
   THEN {{'out': list_append(a.out, array_to_string(list_concat(a.cur, p.cur), ' ')), 'cur': list_concat(a.cur, p.cur)[-30:]}}
   ELSE {{'out': a.out, 'cur': list_concat(a.cur, p.cur)}} END) AS f FROM (SELECT doc_id, section_order, list_prepend({{'out': []::VARCHAR[], 'cur': []::VARCHAR[]}}, list_transform(ps, lambda p: {{'out': []::VARCHAR[], 'cur': p}})) AS ps FROM paras)),
 done AS (SELECT doc_id, section_order, CASE WHEN len(f.cur) > 0 AND (len(f.out) = 0 OR len(f.cur) > 30) THEN list_append(f.out, array_to_string(f.cur, ' ')) ELSE f.out END AS texts FROM folded),
 pieces AS (SELECT doc_id, section_order, unnest(texts) AS text, generate_subscripts(texts, 1) AS piece FROM done),
 kept AS (SELECT *, len(string_split(text, ' ')) AS n_words FROM pieces WHERE len(string_split(text, ' ')) >= 15)"""


@query(f"WITH {_SECTIONS}, {_PACKED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_order, piece) - 1 AS INTEGER) AS order_index, CAST(n_words AS INTEGER) AS word_count, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS label, md5(text) AS digest FROM kept")
def pack_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(c("doc_id").cast("string").alias("id"), F.lit("t").alias("label"), "topic", "text")
    packed = chunking.packed_chunks(chunking.split_sections(docs, "id", "text"), "id")
    return packed.select(c("id").cast("long").alias("doc_id"), "order_index", "word_count", T.truncated_label(c("text")).alias("label"), F.md5("text").alias("digest"))


_CHAIN = f"chain AS (SELECT id, book_id, section_id, order_index, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM {_v('chunks')} WINDOW w AS (PARTITION BY book_id ORDER BY order_index, id))"


def _chained(spark, sf):
    return chunking.chunk_chain(_chunks(spark, sf), "book_id", "order_index", "id")


@query(f"WITH {_CHAIN} SELECT id, prev_id, next_id FROM chain")
def chunk_chain(spark, sf):
    return _chained(spark, sf).select("id", c("prev_chunk_id").alias("prev_id"), c("next_chunk_id").alias("next_id"))


_EDGE_ID = "'edge_' || substr(md5({s} || chr(31) || {r} || chr(31) || {t}), 1, 12)"


@query(f"""WITH {_CHAIN}, e AS (
 SELECT coalesce(parent_section_id, book_id) AS source_id, id AS target_id, 'HAS_SECTION' AS rel_type FROM {_v("sections")}
 UNION ALL SELECT section_id, id, 'HAS_CHUNK' FROM chain WHERE section_id IS NOT NULL
 UNION ALL SELECT id, next_id, 'NEXT_CHUNK' FROM chain WHERE next_id IS NOT NULL)
SELECT {_EDGE_ID.format(s="source_id", r="rel_type", t="target_id")} AS id, source_id, target_id, rel_type, 'structural' AS method, CAST(1.0 AS DOUBLE) AS weight FROM e""")
def structural_edges(spark, sf):
    return chunking.structural_edges(valid(spark, sf, "sections"), _chained(spark, sf)).select("id", "source_id", "target_id", "rel_type", "method", "weight")


@query(f"SELECT id, CAST(len({_words('text')}) AS INTEGER) AS n_words, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS label FROM {_v('chunks')}")
def chunk_words(spark, sf):
    return _chunks(spark, sf).select("id", T.word_count(c("text")).alias("n_words"), T.truncated_label(c("text")).alias("label"))


@query("SELECT p_partkey, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slugify(c("p_name")).alias("slug"))


@query(rf"""SELECT DISTINCT name, array_to_string(list_transform(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z0-9]+'), lambda x: lower(x)), ' ') AS parts FROM {_v("code_symbols")}""")
def identifier_parts(spark, sf):
    return valid(spark, sf, "code_symbols").select("name", F.array_join(T.split_identifier(c("name")), " ").alias("parts")).distinct()


@query(f"SELECT id, 'meta_' || m.key AS key, m.value AS value FROM (SELECT id, unnest(map_entries(metadata)) AS m FROM {_v('edges')})")
def metadata_flatten(spark, sf):
    return _edges(spark, sf).select("id", F.explode(T.flattened_metadata(c("metadata"))).alias("key", "value"))


@query("SELECT '{\"label\":\"' || lower(label) || '\",\"n\":' || count(*) || '}' AS report FROM doc_labels GROUP BY lower(label)")
def json_report(spark, sf):
    return file_sources.json_report(table(spark, sf, "doc_labels").groupBy(F.lower("label").alias("label")).agg(F.count("*").alias("n")))


_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('node:' || node_id))"


@query(f"SELECT node_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT node_id, {_SHA} AS h FROM {_v('points')})")
def point_ids(spark, sf):
    return _points(spark, sf).select("node_id", T.point_id(c("node_id")).alias("point_id"))


# --- vector space ----------------------------------------------------------------------------------------------

_STOPS = "[" + ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS) + "]"


def _tf(source: str, name: str) -> str:
    return f"""{name}_s AS (SELECT key, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOPS}, w)) AS w FROM {source}),
 {name}_t AS (SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_s),
 {name} AS (SELECT key, term, count(*) AS tf FROM {name}_t GROUP BY key, term)"""


_VOCAB = f"""ch AS (SELECT id AS key, text FROM {_v("chunks")}), {_tf("ch", "cc")},
 vocab AS (SELECT term, count(*) AS df, sum(tf) AS total, ln((1 + (SELECT count(*) FROM ch)) / (1 + count(*))) + 1 AS idf FROM cc GROUP BY term ORDER BY total DESC, term LIMIT 50000)"""


def _weights(name: str) -> str:
    return f"""{name}_r AS (SELECT key, term, (1 + ln(tf)) * idf AS w FROM {name} JOIN vocab USING (term)),
 {name}_w AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM {name}_r)"""


def _fitted(spark, sf):
    return tfidf.fit_transform(_chunks(spark, sf), "id", "text")


@query(f"WITH {_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, sf):
    vocab, _ = _fitted(spark, sf)
    return vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_VOCAB}, {_weights('cc')} SELECT key AS id, term, round(weight, 6) AS weight FROM cc_w")
def tfidf_weights(spark, sf):
    _, weights = _fitted(spark, sf)
    return weights.select("id", "term", F.round("weight", 6).alias("weight"))


_ITEMS = f"it AS (SELECT CAST(item_id AS VARCHAR) AS key, text FROM eval_items), {_tf('it', 'qc')}"


def _questions(spark, sf):
    return table(spark, sf, "eval_items").select(c("item_id").cast("string").alias("query_id"), c("text").alias("question"), "topic")


@query(f"WITH {_VOCAB}, {_ITEMS}, {_weights('qc')} SELECT key AS query_id, term, round(weight, 6) AS weight FROM qc_w")
def tfidf_query_transform(spark, sf):
    vocab, _ = _fitted(spark, sf)
    return tfidf.transform(_questions(spark, sf), vocab, "query_id", "question").select("query_id", "term", F.round("weight", 6).alias("weight"))


_KNN = f"""{_VOCAB}, {_weights("cc")}, {_ITEMS}, {_weights("qc")},
 sims AS (SELECT q.key AS query_id, d.key AS node_id, round(sum(q.weight * d.weight), 6) AS score FROM qc_w q JOIN cc_w d USING (term) GROUP BY 1, 2),
 knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM sims QUALIFY rank <= 5)"""


def _knn(spark, sf):
    vocab, weights = _fitted(spark, sf)
    asked = tfidf.transform(_questions(spark, sf), vocab, "query_id", "question")
    return similarity.sparse_search(asked, weights.withColumnRenamed("id", "node_id"), 5)


@query(f"WITH {_KNN} SELECT query_id, node_id, score FROM knn")
def sparse_knn(spark, sf):
    return _knn(spark, sf)


_USABLE = "len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0"
_POINTS = f"""pts AS (SELECT node_id, CAST(dense AS DOUBLE[]) AS dense, sparse, payload.type AS type, payload.topic AS topic FROM {_v("points")}), good AS (SELECT * FROM pts WHERE {_USABLE}),
 qs AS (SELECT DISTINCT unnest(seed_node_ids) AS query_id FROM rag_results)"""
_DENSE = """dn AS (SELECT q.node_id AS query_id, p.node_id, round(list_cosine_similarity(q.dense, p.dense), 6) AS score, p.topic FROM good q JOIN qs ON q.node_id = qs.query_id JOIN good p ON p.node_id <> q.node_id)"""


def _asked(spark, sf):
    return _points(spark, sf).join(_seeds(spark, sf).withColumnRenamed("query_id", "node_id"), "node_id", "left_semi").withColumnRenamed("node_id", "query_id")


@query(f"WITH {_POINTS}, {_DENSE} SELECT query_id, node_id, score FROM dn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10")
def dense_knn(spark, sf):
    return similarity.cosine_search(_asked(spark, sf), _points(spark, sf), 10)


@query(f"WITH {_POINTS} SELECT node_id, round(sqrt(list_sum(list_transform(dense, lambda x: x * x))), 6) AS norm, round(list_cosine_similarity(dense, list_transform(range(1, 65), lambda i: i::DOUBLE)), 6) AS ramp FROM good")
def vector_norms(spark, sf):
    p = _points(spark, sf).where(similarity.usable(c("dense"), 64))
    ramp = F.array(*[F.lit(float(i)) for i in range(1, 65)])
    return p.select("node_id", F.round(V.norm(c("dense")), 6).alias("norm"), F.round(V.cosine(c("dense"), ramp), 6).alias("ramp"))


_SPARSE = """long AS (SELECT node_id, topic, unnest(sparse.indices) AS term, unnest(sparse.values) AS weight FROM pts WHERE sparse IS NOT NULL),
 sp AS (SELECT q.node_id AS query_id, p.node_id, sum(q.weight * p.weight) AS dot FROM long q JOIN qs ON q.node_id = qs.query_id JOIN long p ON p.term = q.term AND p.node_id <> q.node_id GROUP BY 1, 2),
 nm AS (SELECT node_id, sqrt(sum(weight * weight)) AS n FROM long GROUP BY 1)"""


def _long(points: DataFrame, key: str) -> DataFrame:
    return points.where("sparse is not null").select(c("node_id").alias(key), F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e")).select(key, c("e.indices").alias("term"), c("e.values").alias("weight"))


def _long_asked(spark, sf):
    return _long(_points(spark, sf), "query_id").join(_seeds(spark, sf), "query_id", "left_semi")


@query(f"WITH {_POINTS}, {_SPARSE} SELECT query_id, sp.node_id, round(dot / (a.n * b.n + 1e-12), 6) AS score FROM sp JOIN nm a ON a.node_id = query_id JOIN nm b ON b.node_id = sp.node_id")
def sparse_cosine(spark, sf):
    return similarity.sparse_search(_long_asked(spark, sf), _long(_points(spark, sf), "node_id"), None, False)


_HYBRID = f"""{_POINTS}, {_DENSE}, {_SPARSE},
 cs AS (SELECT query_id, sp.node_id, round(dot / (a.n * b.n + 1e-12), 6) AS s FROM sp JOIN nm a ON a.node_id = query_id JOIN nm b ON b.node_id = sp.node_id),
 hy AS (SELECT query_id, node_id, round(coalesce(score, 0) * CAST(0.6 AS DOUBLE) + coalesce(s, 0) * CAST(0.4 AS DOUBLE), 6) AS score FROM dn FULL JOIN cs USING (query_id, node_id))"""


def _hybrid(spark, sf, k=None, least=None):
    # all pairs; what one side lacks counts as 0
    points = _points(spark, sf).select("node_id", "dense", F.when(c("sparse").isNotNull(), similarity.sparse_terms(c("sparse"))).alias("packed"))
    asked = points.join(_seeds(spark, sf).withColumnRenamed("query_id", "node_id"), "node_id", "left_semi").withColumnRenamed("node_id", "query_id")
    return similarity.pair_scores(asked, points, k, least)


@query(f"WITH {_HYBRID} SELECT * FROM hy")
def hybrid_pairs(spark, sf):
    return _hybrid(spark, sf)


@query(f"""WITH {_HYBRID}, pos AS (SELECT id AS node_id, row_number() OVER (PARTITION BY book_id ORDER BY order_index, id) AS p, book_id FROM {_v("chunks")}),
 ok AS (SELECT hy.* FROM hy LEFT JOIN pos a ON a.node_id = hy.query_id LEFT JOIN pos b ON b.node_id = hy.node_id WHERE score >= 0.3 AND NOT coalesce(a.book_id = b.book_id AND abs(a.p - b.p) <= 1, false)),
 near AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 8)
SELECT least(query_id, node_id) AS source_id, greatest(query_id, node_id) AS target_id, max(score) AS score FROM near GROUP BY 1, 2""")
def topk_candidates(spark, sf):
    order = Window.partitionBy("book_id").orderBy("order_index", "id")
    position = _chunks(spark, sf).select(c("id").alias("node_id"), c("book_id").alias("part"), F.row_number().over(order).alias("position"))
    # a chunk has at most two neighbours to be masked, so the best 8 + 2 hold the best 8 of the rest
    return similarity.top_candidates(_hybrid(spark, sf, 10, 0.3), 8, 0.3, position)


@query(f"""WITH {_POINTS}, {_DENSE}, {_SPARSE},
 d AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM dn WHERE topic = 'data_systems' QUALIFY r <= 40),
 s AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 6) DESC, node_id) AS r FROM sp WHERE node_id IN (SELECT node_id FROM pts WHERE topic = 'data_systems') QUALIFY r <= 40),
 f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (2 + r - 1)), 9) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM s) GROUP BY 1, 2)
SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_search_rrf(spark, sf):
    packed = F.when(c("sparse").isNotNull(), similarity.sparse_terms(c("sparse"))).alias("packed")
    return similarity.hybrid_search(_asked(spark, sf).select("query_id", "dense", packed), _points(spark, sf).select("node_id", "dense", packed, "topic"), 10, topic="data_systems")


# --- graph store -----------------------------------------------------------------------------------------------


@query("SELECT 'Edge' AS type, id, count(*) AS n FROM edges GROUP BY id HAVING count(*) > 1")
def unique_violations(spark, sf):
    return duplicate_keys(table(spark, sf, "edges").withColumn("type", F.lit("Edge")))


@query(f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_stats(spark, sf):
    return store.node_counts(_nodes(spark, sf))


@query(f"WITH {_EDGES} SELECT rel_type, count(*) AS n, CASE WHEN rel_type IN ('HAS_SECTION', 'HAS_CHUNK', 'NEXT_CHUNK') THEN 'structural' WHEN rel_type = 'SIMILAR_TO' THEN 'manual' ELSE 'llm' END AS style FROM edges_v GROUP BY rel_type")
def edge_stats(spark, sf):
    return store.edge_counts(_edges(spark, sf))


@query(f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges_v UNION ALL SELECT target_id FROM edges_v WHERE source_id <> target_id) WHERE id IS NOT NULL GROUP BY id")
def degree(spark, sf):
    return store.degrees(_edges(spark, sf))


@query(f"""WITH s AS (SELECT book_id, count(*) AS n FROM {_v("sections")} GROUP BY 1), k AS (SELECT book_id, count(*) AS n FROM {_v("chunks")} GROUP BY 1)
SELECT b.id AS book_id, coalesce(s.n, 0) AS sections, coalesce(k.n, 0) AS chunks FROM {_v("books")} b LEFT JOIN s ON s.book_id = b.id LEFT JOIN k ON k.book_id = b.id""")
def per_book_counts(spark, sf):
    s = valid(spark, sf, "sections").groupBy("book_id").agg(F.count("*").alias("sections"))
    k = _chunks(spark, sf).groupBy("book_id").agg(F.count("*").alias("chunks"))
    b = valid(spark, sf, "books").select(c("id").alias("book_id"))
    return b.join(s, "book_id", "left").join(k, "book_id", "left").select("book_id", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"WITH {_FILES}, s AS (SELECT file_id, count(*) AS symbols, count(*) FILTER (kind = 'module') AS modules FROM {_v('code_symbols')} GROUP BY 1) SELECT file_id, path, symbols, modules FROM files JOIN s USING (file_id)")
def per_file_symbols(spark, sf):
    counts = valid(spark, sf, "code_symbols").groupBy("file_id").agg(F.count("*").alias("symbols"), F.count_if(c("kind") == "module").alias("modules"))
    return table(spark, sf, "source_files").dropDuplicates(["file_id"]).join(counts, "file_id").select("file_id", "path", "symbols", "modules")


@query(f"WITH {_EDGES} SELECT rel_type, count(*) AS n, count(*) FILTER (weight < 1) AS guessed FROM edges_v WHERE method = 'static_analysis' GROUP BY 1")
def static_edge_counts(spark, sf):
    return _edges(spark, sf).where("method = 'static_analysis'").groupBy("rel_type").agg(F.count("*").alias("n"), F.count_if(c("weight") < 1).alias("guessed"))


@query("""WITH batch AS (SELECT id, type, label, created_by, row_number() OVER (PARTITION BY type, id ORDER BY created_at DESC, label) AS r FROM chunks),
 b AS (SELECT id, type, 'new: ' || label AS label, created_by FROM batch WHERE r = 1 AND created_by <> 'pipeline')
SELECT coalesce(b.type, o.type) AS type, coalesce(b.id, o.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.label ELSE o.label END AS label, o.topic AS topic, b.created_by AS created_by FROM (SELECT type, id, label, topic FROM """ + _v("chunks") + """ WHERE topic IS NOT NULL) o FULL JOIN b ON b.id = o.id AND b.type = o.type""")
def node_upsert(spark, sf):
    old = _chunks(spark, sf).where("topic is not null").select("type", "id", "label", "topic")
    batch = table(spark, sf, "chunks").select("type", "id", F.concat(F.lit("new: "), "label").alias("label"), "created_by", F.struct("created_at", F.lit(1)).alias("seq"))
    last = store.overlay(old.limit(0).select("type", "id", "label"), batch, ["type", "id"], "seq").where("created_by <> 'pipeline'")
    graph = store.GraphTables(old, _edges(spark, sf)).upsert_nodes(last)
    return graph.nodes.select("type", "id", "label", "topic", "created_by")


@query(f"WITH {_NODES}, {_EDGES} SELECT source_id, rel_type, target_id, max_by(id, id) AS id FROM edges_v WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY 1, 2, 3")
def edge_upsert(spark, sf):
    edges = _edges(spark, sf)
    batch = edges.withColumn("seq", c("id"))
    graph = store.GraphTables(_nodes(spark, sf), edges.limit(0)).upsert_edges(batch, "seq")
    return graph.edges.select("source_id", "rel_type", "target_id", "id")


@query(f"""WITH {_EDGES} SELECT source_id, target_id, rel_type, CASE WHEN starts_with(created_by, 'user') THEN 'manual' ELSE 'llm_connection_finder' END AS method, weight
FROM (SELECT DISTINCT source_id, target_id, rel_type, created_by, weight FROM edges_v WHERE method IN ('manual', 'llm_connection_finder') AND rel_type IN ('RELATES_TO', 'SUPPORTS', 'PART_OF_CONCEPT') QUALIFY row_number() OVER (PARTITION BY source_id, target_id, rel_type ORDER BY id) = 1)""")
def relationship_create(spark, sf):
    w = Window.partitionBy("source_id", "target_id", "rel_type").orderBy("id")
    wanted = _edges(spark, sf).where("method in ('manual', 'llm_connection_finder')").withColumn("r", F.row_number().over(w)).where("r = 1")
    wanted = wanted.withColumn("rel_type", F.when(c("rel_type").isin("RELATES_TO", "SUPPORTS", "PART_OF_CONCEPT"), c("rel_type")).otherwise("UNKNOWN"))
    return store.relationships(wanted.select("source_id", "target_id", "rel_type", "weight", "explanation", "created_by")).select("source_id", "target_id", "rel_type", "method", "weight")


@query(f"SELECT DISTINCT 'concept_' || substr(md5(lower(trim(label))), 1, 12) AS id, trim(label) AS label, trim(coalesce(description, '')) AS description, label || '. ' || coalesce(description, '') AS embedded_text FROM {_v('concepts')}")
def concept_create(spark, sf):
    return store.concept_nodes(valid(spark, sf, "concepts")).select("id", "label", "description", "embedded_text").distinct()


_ENDS = f"""{_NODES}, {_EDGES}, ids AS (SELECT DISTINCT id FROM nodes), live AS (SELECT id AS edge_id, source_id, target_id, rel_type, coalesce(explanation, '') AS explanation FROM edges_v WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)),
 ends AS (SELECT source_id AS seed_id, edge_id, rel_type, explanation, true AS outgoing, target_id AS neighbor_id FROM live UNION ALL SELECT target_id, edge_id, rel_type, explanation, false, source_id FROM live WHERE source_id <> target_id)"""


@query(f"""WITH {_ENDS}, q AS (SELECT DISTINCT unnest(seed_node_ids) AS seed_id FROM rag_results)
SELECT seed_id, edge_id, rel_type, outgoing, neighbor_id, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY rel_type, neighbor_id, edge_id) AS INTEGER) AS ordinal FROM ends SEMI JOIN q USING (seed_id) QUALIFY ordinal <= 50""")
def neighborhood(spark, sf):
    near = traverse.neighborhood(_seeds(spark, sf).withColumnRenamed("query_id", "seed_id"), _edges(spark, sf), _nodes(spark, sf), 50)
    return near.select("seed_id", "edge_id", "rel_type", "outgoing", "neighbor_id", "ordinal")


@query(f"""WITH {_EDGES}, b AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges_v UNION SELECT target_id, source_id FROM edges_v),
 h0 AS (SELECT DISTINCT unnest(seed_node_ids) AS seed_id FROM rag_results), h1 AS (SELECT DISTINCT seed_id, b AS node_id FROM h0 JOIN b ON a = seed_id), h2 AS (SELECT DISTINCT seed_id, b AS node_id FROM h1 JOIN b ON a = node_id)
SELECT seed_id, node_id, CAST(min(d) AS INTEGER) AS distance FROM (SELECT seed_id, seed_id AS node_id, 0 AS d FROM h0 UNION ALL SELECT seed_id, node_id, 1 FROM h1 UNION ALL SELECT seed_id, node_id, 2 FROM h2) WHERE seed_id IS NOT NULL GROUP BY 1, 2""")
def k_hop(spark, sf):
    return traverse.k_hop(_seeds(spark, sf).withColumnRenamed("query_id", "seed_id"), _edges(spark, sf), 2)


@query(f"""WITH {_EDGES}, n AS (SELECT id FROM {_v("chunks")} WHERE topic = 'data_systems'),
 ends AS (SELECT source_id AS seed_id, id, rel_type, target_id AS o FROM edges_v UNION ALL SELECT target_id, id, rel_type, source_id FROM edges_v WHERE source_id <> target_id),
 near AS (SELECT id FROM ends WHERE seed_id IN (SELECT id FROM n) QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY rel_type, o, id) <= 30)
SELECT id, source_id, target_id, rel_type FROM edges_v WHERE id IN (SELECT id FROM near) AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""")
def subgraph(spark, sf):
    nodes = _chunks(spark, sf).where("topic = 'data_systems'")
    return traverse.induced_subgraph(nodes, _edges(spark, sf)).select("id", "source_id", "target_id", "rel_type")


@query(f"WITH {_NODES} SELECT id, substr(label, 1, 40) AS label, type AS \"group\", topic AS title FROM nodes")
def visual_nodes(spark, sf):
    return traverse.visual_nodes(_nodes(spark, sf))


@query(f"WITH {_EDGES}, gone AS (SELECT DISTINCT unnest(seed_node_ids) AS id FROM rag_results) SELECT id, source_id, target_id FROM edges_v WHERE source_id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL) AND target_id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)")
def delete_detach(spark, sf):
    graph = store.GraphTables(_nodes(spark, sf), _edges(spark, sf), _points(spark, sf)).delete_nodes(_seeds(spark, sf).withColumnRenamed("query_id", "id"))
    return graph.edges.select("id", "source_id", "target_id")


@query(f"SELECT node_id FROM {_v('points')} WHERE node_id NOT IN (SELECT unnest(seed_node_ids) AS id FROM rag_results WHERE len(list_filter(seed_node_ids, lambda x: x IS NULL)) = 0)")
def delete_points(spark, sf):
    graph = store.GraphTables(_nodes(spark, sf), _edges(spark, sf), _points(spark, sf)).delete_points(_seeds(spark, sf).withColumnRenamed("query_id", "id"))
    return graph.points.select("node_id")


# concepts whose trimmed labels begin alike are merged onto the first of them
_MERGES = f"m AS (SELECT first_value(id) OVER (PARTITION BY lower(substr(trim(label), 1, 3)) ORDER BY id) AS keep_id, id AS absorb_id, row_number() OVER (PARTITION BY lower(substr(trim(label), 1, 3)) ORDER BY id) AS ordinal FROM {_v('concepts')}), mm AS (SELECT * FROM m WHERE keep_id <> absorb_id)"


def _merges(spark, sf):
    w = Window.partitionBy(F.lower(F.substring(F.trim("label"), 1, 3))).orderBy("id")
    return valid(spark, sf, "concepts").select(F.first("id").over(w).alias("keep_id"), c("id").alias("absorb_id"), F.row_number().over(w).alias("ordinal")).where("keep_id <> absorb_id")


@query(f"""WITH {_EDGES}, {_MERGES}, x AS (SELECT e.id, e.rel_type, coalesce(s.keep_id, source_id) AS source_id, coalesce(t.keep_id, target_id) AS target_id, s.keep_id IS NOT NULL OR t.keep_id IS NOT NULL AS moved, least(s.ordinal, t.ordinal) AS o
 FROM edges_v e LEFT JOIN mm s ON s.absorb_id = source_id LEFT JOIN mm t ON t.absorb_id = target_id),
 y AS (SELECT *, row_number() OVER (PARTITION BY source_id, rel_type, target_id ORDER BY moved, o, id) AS r FROM x WHERE NOT (moved AND source_id = target_id))
SELECT id, source_id, target_id, rel_type FROM y WHERE NOT moved OR r = 1""")
def graph_merge(spark, sf):
    return merge.contract_edges(_edges(spark, sf), _merges(spark, sf)).select("id", "source_id", "target_id", "rel_type")


@query(f"""WITH {_NODES}, {_MERGES}, a AS (SELECT keep_id, string_agg(absorb_id, ',' ORDER BY ordinal) AS merged_from, string_agg(n.description, ' ' ORDER BY ordinal) FILTER (n.description <> '') AS bodies FROM mm JOIN nodes n ON n.id = absorb_id GROUP BY 1)
SELECT id, merged_from, array_to_string(list_filter([nullif(description, ''), bodies], lambda x: x IS NOT NULL), ' ') AS embedded_text FROM nodes JOIN a ON a.keep_id = id""")
def merge_nodes(spark, sf):
    graph = merge.merge_nodes(store.GraphTables(_nodes(spark, sf), _edges(spark, sf), _points(spark, sf)), _merges(spark, sf))
    return graph.nodes.where("merged_from is not null").select("id", F.array_join("merged_from", ",").alias("merged_from"), "embedded_text")


# --- judged relationships --------------------------------------------------------------------------------------

_PICK = "CAST(('0x' || substr(md5(source_id || '|' || target_id), 1, 4)) AS INTEGER)"
_REPLIES = f"""rep AS (SELECT *, {_PICK} AS pick, ['RELATES_TO', 'SUPPORTS', 'CONTRADICTS', 'ELABORATES', 'PREREQUISITE_OF', 'HAS_CHUNK'][{_PICK} % 6 + 1] AS rel_type FROM pairs),
 found AS (SELECT source_id, target_id, score, rel_type, round(score, 3) AS confidence, CASE WHEN pick % 3 = 0 THEN 'Idea ' || (pick % 7) END AS concept_name FROM rep WHERE score >= 0.5 AND rel_type <> 'HAS_CHUNK')"""
_JUDGED = f"""{_EDGES}, pairs AS (SELECT least(source_id, target_id) AS source_id, greatest(source_id, target_id) AS target_id, max(round(weight, 6)) AS score FROM edges_v WHERE method = 'llm_connection_finder' AND rel_type <> 'PART_OF_CONCEPT' AND weight IS NOT NULL GROUP BY 1, 2),
 {_REPLIES}"""


def _found(spark, sf):
    e = _edges(spark, sf).where("method = 'llm_connection_finder' and rel_type <> 'PART_OF_CONCEPT' and weight is not null")
    pairs = e.groupBy(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id")).agg(F.max(F.round("weight", 6)).alias("score"))
    return pairs, judge.judged(judge.rule_judgments(pairs))


@query(f"WITH {_JUDGED} SELECT source_id, target_id, rel_type, confidence FROM found")
def judged_pairs(spark, sf):
    return _found(spark, sf)[1].select("source_id", "target_id", "rel_type", "confidence")


@query(f"WITH {_JUDGED} SELECT {_EDGE_ID.format(s='source_id', r='rel_type', t='target_id')} AS id, source_id, target_id, rel_type, 'llm_connection_finder' AS method, confidence AS weight, 'by rule' AS explanation FROM found")
def typed_edges(spark, sf):
    return judge.typed_edges(_found(spark, sf)[1]).select("id", "source_id", "target_id", "rel_type", "method", "weight", "explanation")


_SEEN_OF = """seen AS (SELECT lower(concept_name) AS key, concept_name AS label, score, source_id, target_id, side, CASE WHEN side = 0 THEN source_id ELSE target_id END AS chunk_id, confidence FROM found, (VALUES (0), (1)) AS s(side) WHERE concept_name IS NOT NULL),
 first AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY key, chunk_id ORDER BY score DESC, source_id, target_id, side) = 1)"""
_SEEN = f"{_JUDGED}, {_SEEN_OF}"


@query(f"WITH {_SEEN} SELECT 'concept_' || substr(md5(key), 1, 12) AS id, min(label) AS label, string_agg(chunk_id, ',' ORDER BY score DESC, source_id, target_id, side) AS chunk_ids FROM first GROUP BY key")
def concept_grouping(spark, sf):
    return judge.concepts(_found(spark, sf)[1])[0].select("id", "label", F.array_join("source_chunk_ids", ",").alias("chunk_ids"))


@query(f"WITH {_SEEN} SELECT chunk_id AS source_id, 'concept_' || substr(md5(key), 1, 12) AS target_id, 'PART_OF_CONCEPT' AS rel_type, confidence AS weight FROM first")
def concept_edges(spark, sf):
    return judge.concepts(_found(spark, sf)[1])[1].select("source_id", "target_id", "rel_type", "weight")


@query(f"WITH {_SEEN} SELECT 'candidates' AS what, count(*) AS n FROM pairs UNION ALL SELECT 'edges', count(*) FROM found UNION ALL SELECT 'concepts', count(DISTINCT key) FROM first UNION ALL SELECT 'concept_edges', count(*) FROM first")
def pass_summary(spark, sf):
    pairs, found = _found(spark, sf)
    return judge.pass_summary(pairs, judge.typed_edges(found), *judge.concepts(found))


@query(f"WITH {_JUDGED} SELECT source_id, target_id, score FROM pairs ORDER BY score DESC, source_id, target_id LIMIT 12")
def best_pairs(spark, sf):
    return judge.best_pairs(_found(spark, sf)[0], 12)


# --- code ------------------------------------------------------------------------------------------------------


def _code_files(spark, sf):
    files = table(spark, sf, "source_files").dropDuplicates(["file_id"]).where(file_sources.language_for_path(c("path")).isNotNull())
    return files.select("file_id", "repo", "path", file_sources.module_path(c("path")).alias("module_path"), "content", F.lit("code").alias("topic"), (F.regexp_count("content", F.lit("\n")) + 1).alias("loc"), F.lit("python").alias("language"))


@query()
def code_symbols(spark, sf):
    return code_parser.parse_symbols(_code_files(spark, sf)).drop("text")


@query(f"""WITH s AS (SELECT id, coalesce(parent_symbol_id, file_id) AS up, lead(id) OVER (PARTITION BY file_id ORDER BY order_index, id) AS next_id FROM {_v("code_symbols")}),
 e AS (SELECT up AS source_id, id AS target_id, 'HAS_CHUNK' AS rel_type FROM s UNION ALL SELECT id, next_id, 'NEXT_CHUNK' FROM s WHERE next_id IS NOT NULL)
SELECT {_EDGE_ID.format(s="source_id", r="rel_type", t="target_id")} AS id, source_id, target_id, rel_type, 'structural' AS method, CAST(1.0 AS DOUBLE) AS weight FROM e""")
def symbol_edges(spark, sf):
    return code_parser.symbol_edges(valid(spark, sf, "code_symbols")).select("id", "source_id", "target_id", "rel_type", "method", "weight")


@query()
def parsed_static_edges(spark, sf):
    files = _code_files(spark, sf)
    parsed = cut_lineage(code_parser.parse_files(files))
    return resolve.static_edges(files, code_parser.symbols_of(parsed), code_parser.imports_table(parsed)).select("id", "source_id", "target_id", "rel_type", "method", "weight")


_SYMBOLS = f"sy AS (SELECT id, file_id, parent_symbol_id, kind, name, qualified_name, order_index, base_classes, calls_raw FROM {_v('code_symbols')}), named AS (SELECT * FROM sy WHERE kind <> 'module')"
_IMPORTS = r"""imp AS (SELECT DISTINCT ON (file_id) file_id, imports FROM source_files),
 im AS (SELECT DISTINCT file_id, regexp_extract(i, '^from\s+(\S+)\s+import\s+(\w+)$', 2) AS local, regexp_extract(i, '^from\s+(\S+)\s+import\s+(\w+)$', 1) || '.' || regexp_extract(i, '^from\s+(\S+)\s+import\s+(\w+)$', 2) AS candidate FROM (SELECT file_id, unnest(imports) AS i FROM imp) WHERE regexp_matches(i, '^from\s+\S+\s+import\s+\w+$')
 UNION SELECT DISTINCT file_id, split_part(regexp_extract(i, '^import\s+(\S+)$', 1), '.', 1), regexp_extract(i, '^import\s+(\S+)$', 1) FROM (SELECT file_id, unnest(imports) AS i FROM imp) WHERE regexp_matches(i, '^import\s+\S+$')),
 it AS (SELECT file_id, local, max(candidate) AS candidate FROM im GROUP BY 1, 2)"""


def _import_table(spark, sf):
    """The import table as the stored import lines tell it."""
    lines = table(spark, sf, "source_files").dropDuplicates(["file_id"]).select("file_id", F.explode("imports").alias("i"))
    from_re, import_re = r"^from\s+(\S+)\s+import\s+(\w+)$", r"^import\s+(\S+)$"
    a = lines.where(c("i").rlike(from_re)).select("file_id", F.regexp_extract("i", from_re, 2).alias("local"), F.concat(F.regexp_extract("i", from_re, 1), F.lit("."), F.regexp_extract("i", from_re, 2)).alias("candidate"))
    b = lines.where(c("i").rlike(import_re)).select("file_id", F.substring_index(F.regexp_extract("i", import_re, 1), ".", 1).alias("local"), F.regexp_extract("i", import_re, 1).alias("candidate"))
    return a.unionByName(b).groupBy("file_id", "local").agg(F.max("candidate").alias("candidate"))


_MODULES = r"mods AS (SELECT DISTINCT ON (file_id) file_id, path, replace(regexp_replace(regexp_replace(path, '\.[^./]+$', ''), '(^|/)__init__$', ''), '/', '.') AS module_path FROM source_files), lastmod AS (SELECT module_path, max_by(file_id, path || chr(0) || file_id) AS module_file FROM mods GROUP BY 1)"


_LINKED = f"""{_MODULES}, c AS (SELECT DISTINCT candidate, string_split(candidate, '.') AS p FROM it), pre AS (SELECT candidate, n, array_to_string(p[1:n], '.') AS module_path FROM (SELECT candidate, p, unnest(range(0, len(p) + 1)) AS n FROM c)),
 best AS (SELECT candidate, max_by(module_file, n) AS module_file FROM pre JOIN lastmod USING (module_path) GROUP BY 1), linked AS (SELECT file_id, local, candidate, module_file FROM it LEFT JOIN best USING (candidate))"""


@query(f"WITH {_IMPORTS}, {_LINKED} SELECT * FROM linked")
def import_longest_prefix(spark, sf):
    files = table(spark, sf, "source_files").dropDuplicates(["file_id"]).select("file_id", "path", file_sources.module_path(c("path")).alias("module_path"))
    return resolve.longest_prefix(_import_table(spark, sf), files).select("file_id", "local", "candidate", "module_file")


def _resolved(name: str, column: str, kind: str | None = None) -> str:
    """CTEs ending in ``name`` (src, ordinal, raw, rule, target, weight): the first rule that hits for each entry of a list column."""
    of = f"WHERE kind = '{kind}'" if kind else ""
    only = f"AND q.kind = '{kind}'" if kind else ""
    return f"""{name}_u AS (SELECT id AS src, file_id, parent_symbol_id, trim(raw) AS name, raw, n - 1 AS ordinal, split_part(trim(raw), '.', 1) AS root, CASE WHEN contains(trim(raw), '.') THEN substr(trim(raw), length(split_part(trim(raw), '.', 1)) + 2) END AS rest FROM (SELECT *, unnest({column}) AS raw, generate_subscripts({column}, 1) AS n FROM sy) WHERE trim(raw) <> ''),
 {name}_f AS (SELECT file_id, name, min(id) AS target FROM named {of} GROUP BY 1, 2 HAVING count(*) = 1), {name}_g AS (SELECT name, min(id) AS target FROM named {of} GROUP BY 1 HAVING count(*) = 1),
 {name}_r AS (SELECT src, ordinal, raw, 1 AS rule, q.target, 1.0::DOUBLE AS weight FROM {name}_u u JOIN sy p ON p.id = u.parent_symbol_id AND p.kind = 'class' JOIN q ON q.qualified_name = p.qualified_name || '.' || rest {only} WHERE root IN ('self', 'cls') AND NOT contains(rest, '.')
  UNION ALL SELECT src, ordinal, raw, 2, q.target, 1.0 FROM {name}_u u JOIN it ON it.file_id = u.file_id AND it.local = root JOIN q ON q.qualified_name = candidate || '.' || rest {only}
  UNION ALL SELECT src, ordinal, raw, 3, q.target, 1.0 FROM {name}_u u JOIN it ON it.file_id = u.file_id AND it.local = root JOIN q ON q.qualified_name = candidate {only}
  UNION ALL SELECT src, ordinal, raw, 4, f.target, 0.9 FROM {name}_u u JOIN {name}_f f ON f.file_id = u.file_id AND f.name = u.name WHERE rest IS NULL
  UNION ALL SELECT src, ordinal, raw, 5, g.target, 0.4 FROM {name}_u u JOIN {name}_g g ON g.name = u.name WHERE rest IS NULL),
 {name} AS (SELECT src, CAST(ordinal AS INTEGER) AS ordinal, raw, rule, target, weight FROM {name}_r QUALIFY row_number() OVER (PARTITION BY src, ordinal, raw ORDER BY rule) = 1)"""


_QUALIFIED = "q AS (SELECT qualified_name, arg_max(id, (file_id, order_index)) AS target, arg_max(kind, (file_id, order_index)) AS kind FROM named GROUP BY 1)"


@query(f"WITH {_SYMBOLS}, {_IMPORTS}, {_QUALIFIED}, {_resolved('calls', 'calls_raw')} SELECT * FROM calls")
def name_resolution(spark, sf):
    symbols = valid(spark, sf, "code_symbols")
    uses = symbols.select(c("id").alias("src"), "file_id", "parent_symbol_id", F.posexplode("calls_raw").alias("ordinal", "raw"), F.lit(None).cast("string").alias("kind_filter"))
    return resolve.resolve_names(uses, symbols, _import_table(spark, sf))


@query(f"""WITH {_SYMBOLS}, {_IMPORTS}, {_QUALIFIED}, {_resolved("calls", "calls_raw")}, {_resolved("bases", "base_classes", "class")}, {_LINKED},
 e AS (SELECT file_id AS source_id, module_file AS target_id, 'IMPORTS' AS rel_type, 1.0::DOUBLE AS weight, 0 AS place FROM linked WHERE module_file <> file_id
  UNION ALL SELECT src, target, 'INHERITS_FROM', weight, ordinal FROM bases WHERE src <> target UNION ALL SELECT src, target, 'CALLS', weight, ordinal FROM calls)
SELECT {_EDGE_ID.format(s="source_id", r="rel_type", t="target_id")} AS id, source_id, target_id, rel_type, 'static_analysis' AS method, arg_min(weight, place) AS weight FROM e GROUP BY source_id, target_id, rel_type""")
def static_edges(spark, sf):
    files = table(spark, sf, "source_files").dropDuplicates(["file_id"]).select("file_id", "path", file_sources.module_path(c("path")).alias("module_path"))
    edges = resolve.static_edges(files, valid(spark, sf, "code_symbols"), _import_table(spark, sf))
    return edges.select("id", "source_id", "target_id", "rel_type", "method", "weight")


_CARD = rf"""{_FILES}, s AS (SELECT * FROM {_v("code_symbols")} WHERE file_id IS NOT NULL), cards AS (SELECT s.*, array_to_string(list_filter([kind || ': ' || qualified_name, CASE WHEN signature <> '' THEN 'signature: ' || name || signature END,
 CASE WHEN len(base_classes) > 0 THEN 'inherits from: ' || array_to_string(base_classes, ', ') END, 'in file: ' || path, CASE WHEN len(decorators) > 0 THEN 'decorators: ' || array_to_string(decorators, ', ') END, CASE WHEN docstring <> '' THEN docstring END,
 CASE WHEN len(calls_raw) > 0 THEN 'calls: ' || array_to_string(list_sort(list_distinct(calls_raw))[1:20], ', ') END], lambda x: x IS NOT NULL), chr(10)) || chr(10) || chr(10) || 'code:' || chr(10) || coalesce(text, '') AS card FROM s JOIN files USING (file_id))"""
_FACTS = ("kind", "qualified_name", "signature", "name", "base_classes", "path", "decorators", "docstring", "calls_raw", "text")


def _card_rows(spark, sf):
    return valid(spark, sf, "code_symbols").join(table(spark, sf, "source_files").dropDuplicates(["file_id"]).select("file_id", "path"), "file_id")


@query(f"WITH {_CARD} SELECT id, md5(card) AS digest FROM cards")
def embedding_card(spark, sf):
    return _card_rows(spark, sf).select("id", F.md5(T.embedding_card({x: c(x) for x in _FACTS})).alias("digest"))


def _parts(x: str) -> str:
    return rf"list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z0-9]+'), lambda p: lower(p))"


_SPLIT = f"{_parts('name')} || flatten(list_transform(calls_raw, lambda x: {_parts("string_split(x, '.')[-1]")})) || flatten(list_transform(base_classes, lambda x: {_parts('x')}))"


@query(f"WITH {_CARD} SELECT id, md5(card || chr(10) || array_to_string({_SPLIT}, ' ')) AS digest FROM cards")
def sparse_card(spark, sf):
    return _card_rows(spark, sf).select("id", F.md5(T.sparse_card({x: c(x) for x in _FACTS})).alias("digest"))


# --- answering -------------------------------------------------------------------------------------------------

_DIMENSIONS = 64


def _hashed(name: str, source: str) -> str:
    bucket, sign = f"CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % {_DIMENSIONS}", "CASE WHEN substr(md5(term), 5, 1) < '8' THEN 1.0 ELSE -1.0 END"
    return f"{name} AS (SELECT key, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM (SELECT key, {bucket} AS bucket, sum(weight * {sign}) AS w FROM {source} GROUP BY 1, 2))"


_FUSED = f"""{_VOCAB}, {_weights("cc")}, {_ITEMS}, {_weights("qc")}, {_hashed("qh", "qc_w")}, {_hashed("ch_h", "cc_w")},
 hd AS (SELECT q.key AS query_id, d.key AS node_id, round(sum(q.w * d.w), 6) AS score FROM qh q JOIN ch_h d USING (bucket) GROUP BY 1, 2),
 hs AS (SELECT q.key AS query_id, d.key AS node_id, round(sum(q.weight * d.weight), 6) AS score FROM qc_w q JOIN cc_w d USING (term) GROUP BY 1, 2),
 hb AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM hd QUALIFY r <= 20 UNION ALL SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM hs QUALIFY r <= 20),
 hf AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (1 + r)), 9) AS score FROM hb GROUP BY 1, 2),
 knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM hf QUALIFY rank <= 5)"""


def _fused(spark, sf):
    """The five best chunks of each question by hybrid search; questions and chunks share the vocabulary and, hashed, the dense space."""
    vocab, weights = _fitted(spark, sf)
    asked = tfidf.transform(_questions(spark, sf), vocab, "query_id", "question")
    # both branches read the points, which are about as large as the texts
    points = cut_lineage(embed.hashed_points(weights.withColumnRenamed("id", "node_id"), "node_id", _DIMENSIONS))
    return similarity.hybrid_search(cut_lineage(embed.hashed_points(asked, "query_id", _DIMENSIONS)), points, 5)


@query(f"WITH {_FUSED} SELECT query_id, node_id, score, CAST(rank AS INTEGER) AS rank FROM knn")
def question_seeds(spark, sf):
    return _fused(spark, sf)


_CONTEXT = f"""{_FUSED}, {_ENDS}, own AS (SELECT query_id, node_id, 0 AS stage, rank, 0 AS ordinal, '' AS extra FROM knn),
 nb AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY rel_type, neighbor_id, edge_id) AS ordinal FROM ends WHERE seed_id IN (SELECT node_id FROM knn) QUALIFY ordinal <= 50),
 near AS (SELECT query_id, neighbor_id AS node_id, 1 AS stage, rank, nb.ordinal, rel_type || ' (via ' || substr(explanation, 1, 120) || ')' AS extra FROM knn JOIN nb ON nb.seed_id = knn.node_id),
 told AS (SELECT x.*, label, coalesce(nullif(text, ''), nullif(description, ''), '') AS body FROM (SELECT * FROM own UNION ALL SELECT * FROM near) x JOIN nodes ON nodes.id = x.node_id),
 one AS (SELECT * FROM told WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY stage, rank, ordinal) = 1),
 ctx AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage, rank, ordinal) - 1 AS INTEGER) AS position, node_id, label, body, extra FROM one)"""


def _context(spark, sf):
    return answer.context_rows(cut_lineage(_fused(spark, sf)), _edges(spark, sf), _nodes(spark, sf))


@query(f"WITH {_CONTEXT} SELECT query_id, position, node_id, label, extra, substr(body, 1, 200) AS snippet FROM ctx")
def rag_context(spark, sf):
    return _context(spark, sf).select("query_id", "position", "node_id", "label", "extra", F.substring("text", 1, 200).alias("snippet"))


_BLOCKS = """SELECT query_id, string_agg('[' || node_id || '] ' || coalesce(label, '') || CASE WHEN extra <> '' THEN ' - ' || extra ELSE '' END || chr(10) || substr(body, 1, 700), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context, string_agg(node_id, ',' ORDER BY position) AS context_node_ids FROM ctx GROUP BY 1"""


@query(f"WITH {_CONTEXT} SELECT query_id, md5(context) AS digest, context_node_ids FROM ({_BLOCKS})")
def rag_contexts(spark, sf):
    return answer.contexts(_context(spark, sf)).select("query_id", F.md5("context").alias("digest"), F.array_join("context_node_ids", ",").alias("context_node_ids"))


@query(f"WITH {_CONTEXT}, b AS ({_BLOCKS}) SELECT key AS query_id, text AS question, CASE WHEN context IS NULL THEN '{answer.NOTHING_FOUND}' ELSE substr(substr(context, strpos(context, chr(10)) + 1), 1, 200) END AS answer, context_node_ids FROM it LEFT JOIN b ON b.query_id = it.key")
def rag_answers(spark, sf):
    told = answer.answer(_questions(spark, sf), answer.contexts(_context(spark, sf)))
    return told.select("query_id", "question", "answer", F.array_join("context_node_ids", ",").alias("context_node_ids"))


# --- ranking and whole pipelines -------------------------------------------------------------------------------


@query(f"WITH {_EDGES} SELECT source_id, weight, count(*) AS n_equal, min(r) - 1 AS n_below, any_value(n) AS n_total FROM (SELECT source_id, weight, rank() OVER (PARTITION BY source_id ORDER BY weight) AS r, count(*) OVER (PARTITION BY source_id) AS n FROM edges_v WHERE weight IS NOT NULL AND source_id IS NOT NULL) GROUP BY 1, 2")
def weight_ranks(spark, sf):
    return group_ranks(_edges(spark, sf).where("source_id is not null").select("source_id", "weight"), ["source_id"], "weight")


_BOOK_TEXTS = f"docs AS (SELECT doc_id, {_cleaned('text')} AS text FROM documents)"


@query(f"""WITH {_BOOK_TEXTS}, {_lines("docs")}, {_SECTIONS_OF}, {_PACKED}, s AS (SELECT doc_id, count(*) AS n FROM sections_v GROUP BY 1), k AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1)
SELECT 'book_' || substr(md5(coalesce(topic, '') || chr(31) || doc_id), 1, 12) AS id, coalesce(s.n, 0) AS sections, coalesce(k.n, 0) AS chunks FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)""")
def ingest_books(spark, sf):
    docs = table(spark, sf, "documents").select(c("doc_id").cast("int").alias("gutenberg_id"), F.concat(F.lit("Text "), c("doc_id").cast("string")).alias("title"), F.coalesce("topic", F.lit("")).alias("topic"), F.lit("").alias("author"), "text")
    return ingest.ingest_books(docs).report.select("id", "sections", "chunks")


@query()
def ingest_code(spark, sf):
    done = ingest.ingest_code(_code_files(spark, sf))
    return done.edges.groupBy("rel_type").agg(F.count("*").alias("n"))


@query(rf"""WITH {_VOCAB}, {_weights("cc")}, pts AS (SELECT node_id, CAST(dense AS DOUBLE[]) AS dense FROM {_v("points")}), good AS (SELECT * FROM pts WHERE {_USABLE}),
 placed AS (SELECT id, topic, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC NULLS FIRST, id) AS position FROM (SELECT id, created_at, coalesce(regexp_replace(lower(trim(topic)), '[\s_-]+', '_', 'g'), '') AS topic FROM {_v("chunks")})),
 dn AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(p.dense, q.dense), 6) AS d FROM placed a JOIN placed b ON a.topic = b.topic AND a.id <> b.id JOIN good p ON p.node_id = a.id JOIN good q ON q.node_id = b.id),
 sn AS (SELECT a.id AS x, b.id AS y, round(sum(p.weight * q.weight), 6) AS s FROM placed a JOIN cc_w p ON p.key = a.id JOIN cc_w q ON q.term = p.term JOIN placed b ON b.id = q.key AND a.topic = b.topic AND a.id <> b.id GROUP BY 1, 2),
 hy AS (SELECT x, y, round(coalesce(d, 0) * CAST(0.6 AS DOUBLE) + coalesce(s, 0) * CAST(0.4 AS DOUBLE), 6) AS score FROM dn FULL JOIN sn USING (x, y)),
 ok AS (SELECT x, y, score, a.topic FROM hy JOIN placed a ON a.id = x JOIN placed b ON b.id = y WHERE score >= 0.55 AND abs(a.position - b.position) > 1),
 near AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, y) <= 4),
 cand AS (SELECT least(x, y) AS source_id, greatest(x, y) AS target_id, topic, max(score) AS score FROM near GROUP BY 1, 2, 3),
 pairs AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, source_id, target_id) <= 12), {_REPLIES}, {_SEEN_OF},
 n AS (SELECT topic, 'candidates' AS what, count(*) AS n FROM pairs GROUP BY 1 UNION ALL SELECT topic, 'edges', count(*) FROM found JOIN placed ON id = source_id GROUP BY 1
  UNION ALL SELECT topic, 'concepts', count(DISTINCT key) FROM first JOIN placed ON id = chunk_id GROUP BY 1 UNION ALL SELECT topic, 'concept_edges', count(*) FROM first JOIN placed ON id = chunk_id GROUP BY 1)
SELECT t.topic, w.what, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic FROM placed) t CROSS JOIN (VALUES ('candidates'), ('edges'), ('concepts'), ('concept_edges')) AS w(what) LEFT JOIN n ON n.topic = t.topic AND n.what = w.what""")
def connection_pass(spark, sf):
    # spellings of a topic are one, chunks without a topic are a topic of their own
    chunks = _chunks(spark, sf).withColumn("pass_topic", F.coalesce(F.regexp_replace(F.lower(F.trim("topic")), r"[\s_-]+", "_"), F.lit("")))
    order = Window.partitionBy("pass_topic").orderBy(F.desc_nulls_first("created_at"), "id")
    placed = cut_lineage(chunks.select("id", "topic", "pass_topic", "created_at").withColumn("position", F.row_number().over(order)))
    # texts stay as they were split for their valid rows, by id, so that their terms are counted and packed without moving
    _, weights = tfidf.fit_transform(chunks, "id", "text")
    return ingest.connection_pass(placed, _points(spark, sf), weights, partition="pass_topic").summary.withColumnRenamed("pass_topic", "topic")


@query(f"WITH {_EDGES} SELECT source_id, target_id, rel_type, coalesce(weight, 0) AS weight FROM edges_v WHERE method = 'manual'")
def manual_edges(spark, sf):
    e = _edges(spark, sf).where("method = 'manual'")
    made = make_edges(e, c("source_id"), c("target_id"), c("rel_type"), "manual", F.coalesce("weight", F.lit(0.0)))
    return made.select("source_id", "target_id", "rel_type", "weight")


@query(f"WITH {_EDGES} SELECT count(*) AS n FROM edges_v")
def total_relationships(spark, sf):
    return store.total_relationships(_edges(spark, sf)).select(c("n").cast("long").alias("n"))


@query(f"WITH {_EDGES} SELECT id, explanation || ' (weight ' || printf('%.2f', weight) || ')' AS note FROM edges_v WHERE explanation <> '' AND weight IS NOT NULL")
def explained_edges(spark, sf):
    return _edges(spark, sf).where("explanation <> '' and weight is not null").select("id", T.explained(c("explanation"), c("weight")).alias("note"))


@query(f"SELECT id, m.key AS key, m.value AS value FROM (SELECT id, unnest(map_entries(metadata)) AS m FROM {_v('edges')}) WHERE m.key NOT IN ({', '.join(f"'{k}'" for k in T.CORE_KEYS)})")
def shown_metadata(spark, sf):
    return _edges(spark, sf).select("id", F.explode(T.shown_metadata(c("metadata"))).alias("key", "value"))


@query(f"SELECT 'chunk_' || substr(md5('user' || chr(31) || label || chr(31) || text), 1, 12) AS id, trim(label) AS label, trim(text) AS text FROM (SELECT id || ' ' AS label, ' ' || coalesce(description, '') AS text FROM {_v('concepts')})")
def note_chunks(spark, sf):
    wanted = valid(spark, sf, "concepts").select(F.concat("id", F.lit(" ")).alias("label"), F.concat(F.lit(" "), F.coalesce("description", F.lit(""))).alias("text"), "topic", F.lit("user").alias("created_by"))
    return store.note_chunks(wanted).select("id", "label", "text")


@query(f"WITH p AS (SELECT node_id, payload.label AS label FROM {_v('points')}), b AS (SELECT node_id, 'new' AS label FROM p WHERE node_id IN (SELECT unnest(seed_node_ids) FROM rag_results)) SELECT * FROM b UNION ALL SELECT * FROM p WHERE node_id NOT IN (SELECT node_id FROM b)")
def point_upsert(spark, sf):
    points = _points(spark, sf).select("node_id", "label")
    batch = points.join(_seeds(spark, sf).withColumnRenamed("query_id", "node_id"), "node_id", "left_semi").withColumn("label", F.lit("new"))
    return store.GraphTables(_nodes(spark, sf), _edges(spark, sf), points).upsert_points(batch).points.select("node_id", "label")


@query(f"WITH {_VOCAB}, {_weights('cc')}, num AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS i FROM vocab) SELECT key AS id, string_agg(i, ',' ORDER BY i) AS indices, round(list_sum(list(weight * weight)), 6) AS length FROM cc_w JOIN num USING (term) GROUP BY 1")
def sparse_structs(spark, sf):
    vocab, weights = _fitted(spark, sf)
    packed = tfidf.as_struct(weights, vocab, "id")
    squares = F.aggregate(F.transform("sparse.values", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return packed.select("id", F.array_join(F.transform("sparse.indices", lambda i: i.cast("string")), ",").alias("indices"), F.round(squares, 6).alias("length"))


def _side(n: str) -> str:
    return f"coalesce({n}.topic, '') || ', book: ' || coalesce({n}.metadata['book_title'], '?') || ')' || chr(10) || coalesce(substr({n}.text, 1, 900), '')"


@query(f"""WITH {_JUDGED}, ch AS (SELECT id, topic, text, metadata FROM {_v("chunks")})
SELECT source_id, target_id, md5('Passage 1 (topic: ' || {_side("a")} || chr(10) || chr(10) || 'Passage 2 (topic: ' || {_side("b")} || chr(10) || chr(10) || '{judge.PAIR_QUESTION}') AS digest FROM pairs JOIN ch a ON a.id = source_id JOIN ch b ON b.id = target_id""")
def pair_prompts(spark, sf):
    return judge.pair_prompts(_found(spark, sf)[0], _chunks(spark, sf)).select("source_id", "target_id", F.md5("prompt").alias("digest"))


@query(f"""WITH {_JUDGED}, ch AS (SELECT id FROM {_v("chunks")}) SELECT source_id, target_id, 'SUPPORTS' AS rel_type, CAST(0.25 AS DOUBLE) AS confidence FROM pairs WHERE source_id IN (SELECT id FROM ch) AND target_id IN (SELECT id FROM ch)""")
def asked_pairs(spark, sf):
    fenced = '```json\n{"related": true, "rel_type": "SUPPORTS", "confidence": 0.25}\n```'
    asked = judge.ask(judge.pair_prompts(_found(spark, sf)[0], _chunks(spark, sf)), judge.FixedProvider(fenced))
    return judge.judged(asked).select("source_id", "target_id", "rel_type", "confidence")


@query(f"""WITH {_VOCAB}, k AS (SELECT 'concept_' || id AS key, coalesce(label, '') || '. ' || coalesce(description, '') AS text FROM {_v("concepts")}), {_tf("k", "kc")}, {_weights("kc")}, num AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS i FROM vocab)
SELECT k.key AS node_id, 64 AS dimensions, s.indices FROM k LEFT JOIN (SELECT key, string_agg(i, ',' ORDER BY i) AS indices FROM kc_w JOIN num USING (term) GROUP BY 1) s ON s.key = k.key""")
def dual_upsert(spark, sf):
    vocab, _ = _fitted(spark, sf)
    batch = valid(spark, sf, "concepts").select("type", F.concat(F.lit("concept_"), "id").alias("id"), "label", "topic", F.concat(F.coalesce("label", F.lit("")), F.lit(". "), F.coalesce("description", F.lit(""))).alias("text"))
    none = _points(spark, sf).select("node_id", "dense", "sparse").limit(0)
    points = store.embed_and_upsert(store.GraphTables(_nodes(spark, sf), _edges(spark, sf), none), batch, "text", vocab).points
    return points.select("node_id", F.size("dense").alias("dimensions"), F.array_join(F.transform("sparse.indices", lambda i: i.cast("string")), ",").alias("indices"))
