"""Prose: sections, packed chunks, reading order and structural edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.config import DEFAULTS, Settings
from graphlake.functions import text as T
from graphlake.operators.ranking import adjacent
from graphlake.schema import make_edges, stable_id


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_order, title, body): running count of heading lines; lines before the first heading are 'Full Text'.

    A heading without lines before the next one is dropped; a text without heading is one section. Null texts give nothing.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    by_text = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("head", T.is_heading(F.col("line"))).withColumn("sec", F.sum(F.col("head").cast("int")).over(by_text))
    grouped = marked.groupBy(key, "sec").agg(
        F.max(F.when(F.col("head"), T.strip(F.col("line")))).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("lines"),
    )
    order = Window.partitionBy(key).orderBy("sec")
    return (
        grouped.where(F.size("lines") > 0)
        .withColumn("section_order", F.row_number().over(order) - 1)
        .select(key, "section_order", F.coalesce("title", F.lit("Full Text")).alias("title"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"))
    )


def packed(paragraphs: Column, target: int, overlap: int) -> Column:
    """Texts of whole paragraphs: one closes when it reaches the target, the next begins with its last words; a bare overlap is no text of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"))

    def add(state: Column, paragraph: Column) -> Column:
        cur = F.concat(state["cur"], T.words(paragraph))
        tail = F.slice(cur, F.greatest(F.lit(1), F.size(cur) - overlap + 1), overlap) if overlap else F.array().cast("array<string>")
        full = F.size(cur) >= target
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(F.array_join(cur, " ")))).otherwise(state["out"]).alias("out"),
            F.when(full, tail).otherwise(cur).alias("cur"),
        )

    def finish(state: Column) -> Column:
        rest = (F.size(state["cur"]) > 0) & ((F.size(state["out"]) == 0) | (F.size(state["cur"]) > overlap))
        return F.when(rest, F.concat(state["out"], F.array(F.array_join(state["cur"], " ")))).otherwise(state["out"])

    return F.aggregate(paragraphs, empty, add, finish)


def packed_chunks(sections: DataFrame, key: str, settings: Settings = DEFAULTS, paragraphs=T.paragraphs) -> DataFrame:
    """sections (key, section_order, body, ...) as (..., piece, text, word_count, order_index): their packed texts, those of few words left out, numbered through all sections of a key."""
    kept = [x for x in sections.columns if x not in ("title", "body")]
    texts = sections.select(*kept, F.posexplode(packed(paragraphs(F.col("body")), settings.chunk_words, settings.chunk_overlap)).alias("piece", "text"))
    texts = texts.withColumn("word_count", T.word_count(F.col("text"))).where(F.col("word_count") >= settings.chunk_least_words)
    return texts.withColumn("order_index", F.row_number().over(Window.partitionBy(key).orderBy("section_order", "piece")) - 1)


def chunk_chain(chunks: DataFrame, parent: str, order: str, key: str = "id") -> DataFrame:
    """prev_chunk_id and next_chunk_id along the reading order of each parent, ties by key; texts do not move for it, nor is a long parent gathered anywhere."""
    beside = adjacent(chunks, parent, order, key).select(key, F.col("prev").alias("prev_chunk_id"), F.col("next").alias("next_chunk_id"))
    return chunks.drop("prev_chunk_id", "next_chunk_id").join(beside, key)


def chunk_books(books: DataFrame, settings: Settings = DEFAULTS, paragraphs=T.paragraphs) -> tuple[DataFrame, DataFrame]:
    """(sections, chunks) of books (id, label, topic, text); chunks run through all sections of a book, those of few words left out."""
    cleaned = books.select("id", "label", "topic", T.clean_text(F.col("text")).alias("text"))
    found = split_sections(cleaned, "id", "text").withColumnRenamed("id", "book_id")
    sections = found.join(books.select(F.col("id").alias("book_id"), "topic"), "book_id").select(
        stable_id("sec", "book_id", "section_order").alias("id"), F.lit("Section").alias("type"), F.substring("title", 1, 120).alias("label"), "topic", "book_id", F.lit(None).cast("string").alias("parent_section_id"), F.lit(1).alias("level"), F.col("section_order").alias("order_index"), "body",
    )
    chunks = packed_chunks(sections.select("book_id", "topic", F.col("id").alias("section_id"), F.col("order_index").alias("section_order"), "body"), "book_id", settings, paragraphs)
    titles = books.select(F.col("id").alias("book_id"), F.col("label").alias("title"))
    chunks = chunks.join(titles, "book_id").select(
        stable_id("chunk", "book_id", "order_index").alias("id"), F.lit("Chunk").alias("type"), T.truncated_label(F.col("text")).alias("label"), "topic", "book_id", "section_id", "text", "word_count", "order_index", F.create_map(F.lit("book_title"), F.col("title")).alias("metadata"),
    )
    return sections.drop("body"), chunk_chain(chunks, "book_id", "order_index")


def structural_edges(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """HAS_SECTION, HAS_CHUNK and NEXT_CHUNK."""
    c = F.col
    has_section = make_edges(sections, F.coalesce(c("parent_section_id"), c("book_id")), c("id"), "HAS_SECTION", "structural")
    has_chunk = make_edges(chunks.where("section_id is not null"), c("section_id"), c("id"), "HAS_CHUNK", "structural")
    following = make_edges(chunks.where("next_chunk_id is not null"), c("id"), c("next_chunk_id"), "NEXT_CHUNK", "structural")
    return has_section.unionByName(has_chunk).unionByName(following)
