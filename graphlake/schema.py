"""Node, edge and point schemas, vocabularies and deterministic ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
NODE_TYPES = ["Book", "Section", "Chunk", "Concept", "CodeFile"]
REL_TYPES = ["HAS_SECTION", "HAS_CHUNK", "NEXT_CHUNK", "SIMILAR_TO", "CALLS", "IMPORTS", "INHERITS_FROM", "RELATES_TO", "SUPPORTS", "CONTRADICTS", "ELABORATES", "PREREQUISITE_OF", "PART_OF_CONCEPT", "RELATED_CONCEPT"]
METHODS = ["structural", "static_analysis", "hybrid_similarity", "llm_connection_finder", "manual"]
JUDGED_TYPES = ["RELATES_TO", "SUPPORTS", "CONTRADICTS", "ELABORATES", "PREREQUISITE_OF"]
STRUCTURAL_TYPES = ["HAS_SECTION", "HAS_CHUNK", "NEXT_CHUNK"]

_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODE = _struct(id=_TEXT, type=_TEXT, label=_TEXT, topic=_TEXT, created_by=_TEXT, created_at=T.DoubleType(), metadata=T.MapType(_TEXT, _TEXT))
BOOK = T.StructType(NODE.fields + _struct(author=_TEXT, gutenberg_id=T.IntegerType(), source_url=_TEXT, license=_TEXT).fields)
SECTION = T.StructType(NODE.fields + _struct(book_id=_TEXT, parent_section_id=_TEXT, level=T.IntegerType(), order_index=T.IntegerType()).fields)
CHUNK = T.StructType(NODE.fields + _struct(book_id=_TEXT, section_id=_TEXT, text=_TEXT, word_count=T.IntegerType(), order_index=T.IntegerType(), prev_chunk_id=_TEXT, next_chunk_id=_TEXT).fields)
CONCEPT = T.StructType(NODE.fields + _struct(description=_TEXT, aliases=_TEXTS, source_chunk_ids=_TEXTS).fields)
CODE_FILE = T.StructType(NODE.fields + _struct(repo=_TEXT, path=_TEXT, module_path=_TEXT, language=_TEXT, loc=T.IntegerType(), imports=_TEXTS).fields)
EDGE = _struct(id=_TEXT, source_id=_TEXT, target_id=_TEXT, rel_type=_TEXT, method=_TEXT, weight=T.DoubleType(), explanation=_TEXT, created_by=_TEXT, created_at=T.DoubleType(), metadata=T.MapType(_TEXT, _TEXT))
POINT = _struct(node_id=_TEXT, dense=T.ArrayType(T.FloatType()), sparse=_struct(indices=T.ArrayType(T.IntegerType()), values=T.ArrayType(T.DoubleType())), payload=_struct(type=_TEXT, label=_TEXT, topic=_TEXT, created_at=T.DoubleType()))
#: What a file gives to the code parser.
SYMBOL = _struct(
    file_id=_TEXT, id=_TEXT, parent_symbol_id=_TEXT, parent_kind=_TEXT, kind=_TEXT, language=_TEXT, name=_TEXT, qualified_name=_TEXT, signature=_TEXT, docstring=_TEXT, decorators=_TEXTS, base_classes=_TEXTS, calls_raw=_TEXTS,
    start_line=T.IntegerType(), end_line=T.IntegerType(), complexity=T.IntegerType(), text=_TEXT, truncated=T.BooleanType(), order_index=T.IntegerType(), label=_TEXT,
)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and twelve digits of the key's hash: a retried task makes the same id again."""
    key = F.concat_ws("\x1f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(key), 1, 12))


def now() -> Column:
    """Seconds since the epoch, the same for all rows of a query."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def make_edges(df: DataFrame, source: Column, target: Column, rel_type: Column | str, method: str, weight: Column | float = 1.0, explanation: Column | str = "", created_by: Column | str = "pipeline", created_at: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Edges with the defaults of the edge schema and ids made of their identity; made now unless told otherwise."""
    rel = F.lit(rel_type) if isinstance(rel_type, str) else rel_type
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        stable_id("edge", source, rel, target).alias("id"),
        source.alias("source_id"),
        target.alias("target_id"),
        rel.alias("rel_type"),
        F.lit(method).alias("method"),
        as_column(weight).cast("double").alias("weight"),
        as_column(explanation).alias("explanation"),
        as_column(created_by).alias("created_by"),
        (created_at if created_at is not None else now()).cast("double").alias("created_at"),
        (metadata if metadata is not None else F.lit(None)).cast("map<string,string>").alias("metadata"),
    )


#: Tables of a graph.
TABLES = {"nodes": NODE, "edges": EDGE, "points": POINT}


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table below path, made empty if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return spark.read.schema(schema).parquet(path)


def bootstrap(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of a graph below root, made if absent; nodes that break uniqueness are an error. Running it again changes nothing."""
    tables = {name: ensure_table(spark, f"{root}/{name}", schema) for name, schema in TABLES.items()}
    if (twice := duplicate_keys(tables["nodes"]).first()) is not None:
        raise ValueError(f"node {twice['id']} is there {twice['n']} times")
    return tables


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """(type, id, n) of keys that break uniqueness; empty if the schema's constraint holds."""
    return nodes.groupBy("type", "id").agg(F.count("*").alias("n")).where("n > 1")
