"""Judged relationships: providers, prompts, replies, typed edges and concepts."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphlake.functions import text as T
from graphlake.schema import JUDGED_TYPES, make_edges, stable_id

REPLY = "related boolean, rel_type string, confidence double, explanation string, concept_name string, concept_description string"


class Provider(Protocol):
    """Answers a prompt; must be picklable, as tasks call it."""

    def complete(self, prompt: str, system: str = "", json_mode: bool = False) -> str: ...


def _post(url: str, body: dict, headers: dict, path: tuple, timeout: float) -> str:
    """What lies under a path of the JSON reply; three attempts with growing pauses."""
    for attempt in range(3):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers), timeout=timeout) as r:
                value = json.load(r)
            for step in path:
                value = value[step]
            return str(value)
        except OSError:
            if attempt == 2:
                raise
            time.sleep(3 * (attempt + 1))
    return ""


@dataclass(frozen=True)
class HttpProvider:
    """A model server that takes JSON by POST and answers with the text under ``reply_path``; three attempts with growing pauses."""

    url: str
    model: str
    key: str = ""
    reply_path: tuple[str, ...] = ("response",)
    timeout: float = 180.0

    def complete(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        body = {"model": self.model, "prompt": prompt, "system": system, "stream": False, "options": {"temperature": 0.2}} | ({"format": "json"} if json_mode else {})
        return _post(self.url, body, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.reply_path, self.timeout)


@dataclass(frozen=True)
class CloudProvider:
    """A hosted model that takes contents and a generation configuration and answers with candidates; needs a key."""

    url: str
    model: str
    key: str
    timeout: float = 180.0

    def __post_init__(self):
        if not self.key:
            raise ValueError("a hosted model needs a key")

    def request(self, prompt: str, system: str = "", json_mode: bool = False) -> tuple[str, dict]:
        body = {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0.2, "responseMimeType": "application/json" if json_mode else "text/plain"}}
        return f"{self.url}/models/{self.model}:generateContent", body | ({"systemInstruction": {"parts": [{"text": system}]}} if system else {})

    def complete(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        url, body = self.request(prompt, system, json_mode)
        return _post(url, body, {"x-goog-api-key": self.key}, ("candidates", 0, "content", "parts", 0, "text"), self.timeout)


@dataclass(frozen=True)
class FixedProvider:
    """Always the same reply, for tests."""

    reply: str

    def complete(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        return self.reply


def provider_for(role: str, roles: dict[str, Provider]) -> Provider:
    if role not in roles:
        raise KeyError(f"no provider for {role}")
    return roles[role]


PAIR_QUESTION = "Are they related, and how? Answer in JSON with related, rel_type, confidence, explanation, concept_name, concept_description."


def pair_prompts(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs (source_id, target_id, score) with both passages and the prompt about them."""
    side = lambda n: chunks.select(F.col("id").alias(f"{n}_id"), F.col("topic").alias(f"{n}_topic"), F.coalesce(F.col("metadata")["book_title"], F.lit("?")).alias(f"{n}_book"), F.substring("text", 1, 900).alias(f"{n}_text"))
    both = pairs.join(side("source"), "source_id").join(side("target"), "target_id")
    prompt = F.format_string(
        "Passage 1 (topic: %s, book: %s)\n%s\n\nPassage 2 (topic: %s, book: %s)\n%s\n\n" + PAIR_QUESTION,
        *[F.coalesce(F.col(f"{n}_{x}"), F.lit("")) for n in ("source", "target") for x in ("topic", "book", "text")],
    )
    return both.withColumn("prompt", prompt)


def ask(prompts: DataFrame, provider: Provider, system: str = "", attempts: int = 3) -> DataFrame:
    """prompts with ``reply``: the model's JSON, null where no attempt gave any."""
    schema = StructType([*prompts.schema.fields, StructField("reply", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for prompt in batch["prompt"]:
                told = None
                for _ in range(attempts):
                    reply = strip_fences(provider.complete(prompt, system, True))
                    try:
                        json.loads(reply)
                        told = reply
                        break
                    except ValueError:
                        continue
                replies.append(told)
            yield batch.assign(reply=replies)

    return prompts.mapInPandas(run, schema)


def strip_fences(reply: str) -> str:
    lines = reply.strip().splitlines()
    if lines and lines[0].startswith("```"):
        lines = lines[1:]
        if lines and lines[-1].strip() == "```":
            lines = lines[:-1]
    return "\n".join(lines).strip()


def rule_judgments(pairs: DataFrame, related_from: float = 0.5) -> DataFrame:
    """Deterministic replies for pairs (source_id, target_id, score), as a model would write them."""
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", "source_id", "target_id")), 1, 4), 16, 10).cast("int")
    types = F.array(*[F.lit(t) for t in [*JUDGED_TYPES, "HAS_CHUNK"]])
    reply = F.to_json(F.struct((F.col("score") >= related_from).alias("related"), F.element_at(types, pick % 6 + 1).alias("rel_type"), F.round("score", 3).alias("confidence"), F.lit("by rule").alias("explanation"), F.when(pick % 3 == 0, F.concat(F.lit(" Idea "), (pick % 7).cast("string"))).alias("concept_name"), F.lit("an idea").alias("concept_description")))
    return pairs.withColumn("reply", reply)


def judged(replies: DataFrame) -> DataFrame:
    """Related pairs of (source_id, target_id, score, reply): unreadable replies are skipped, a type that is not allowed is not related, a missing confidence is one half."""
    j = replies.withColumn("j", F.from_json(T.code_fences_stripped(F.col("reply")), REPLY)).where("j is not null")
    related = F.coalesce(F.col("j.related"), F.lit(False)) & F.coalesce(F.col("j.rel_type").isin(JUDGED_TYPES), F.lit(False))
    return j.where(related).select("source_id", "target_id", "score", "j.rel_type", F.coalesce("j.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("j.explanation", F.lit("")).alias("explanation"), "j.concept_name", "j.concept_description")


def author(provider: Provider | None) -> str:
    """Who is named as the maker of what a provider found."""
    return f"llm:{getattr(provider, 'model', type(provider).__name__)}" if provider else "llm:rule"


def typed_edges(found: DataFrame, created_by: str = "llm:rule") -> DataFrame:
    """An edge for each related pair, its similarity score kept in the metadata."""
    c = F.col
    kept = F.create_map(F.lit("similarity_score"), c("score").cast("string"))
    return make_edges(found, c("source_id"), c("target_id"), c("rel_type"), "llm_connection_finder", c("confidence"), c("explanation"), created_by, metadata=kept)


def concepts(found: DataFrame, existing: DataFrame | None = None, topics: DataFrame | None = None, created_by: str = "llm:rule") -> tuple[DataFrame, DataFrame]:
    """(concepts, edges): one concept per name in any case, labelled as first seen (best pair first), with its chunks in order; PART_OF_CONCEPT edges once per (chunk, concept), with the first confidence.

    Names that ``existing`` concepts (id, label) already have keep those ids. With ``topics`` (id, topic) of the chunks a
    concept has the topic of the first chunk of its best pair.
    """
    key = F.lower(F.trim("concept_name"))
    named = found.where(F.trim(F.coalesce("concept_name", F.lit(""))) != "").withColumn("key", key)
    order = F.struct(-F.col("score"), F.col("source_id"), F.col("target_id"))
    seen = named.select("key", order.alias("o"), F.trim("concept_name").alias("label"), F.coalesce("concept_description", F.lit("")).alias("description"), "confidence", F.posexplode(F.array("source_id", "target_id")).alias("side", "chunk_id"))
    first = seen.groupBy("key").agg(F.min_by(F.struct("label", "description", F.col("chunk_id").alias("first_id")), F.struct("o", "side")).alias("f"))
    chunk = seen.groupBy("key", "chunk_id").agg(F.min(F.struct("o", "side")).alias("at"), F.min_by("confidence", F.struct("o", "side")).alias("confidence"))
    listed = chunk.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunk_ids"))
    nodes = first.join(listed, "key").select("key", stable_id("concept", "key").alias("new_id"), "f.label", "f.description", "f.first_id", "source_chunk_ids")
    of = topics.select(F.col("id").alias("first_id"), "topic") if topics is not None else None
    nodes = nodes.join(of, "first_id", "left") if of is not None else nodes.withColumn("topic", F.lit(None).cast("string"))
    if existing is not None:
        known = existing.groupBy(F.lower(F.trim("label")).alias("key")).agg(F.min("id").alias("old_id"))
        nodes = nodes.join(known, "key", "left").withColumn("new_id", F.coalesce("old_id", "new_id"))
    nodes = nodes.select(F.col("new_id").alias("id"), F.lit("Concept").alias("type"), "key", "label", "topic", "description", F.lit(created_by).alias("created_by"), "source_chunk_ids")
    c = F.col
    linked = chunk.join(nodes.select("key", c("id").alias("concept_id"), "label"), "key")
    told = F.concat(F.lit("Instance of concept '"), c("label"), F.lit("'"))
    return nodes.drop("key"), make_edges(linked, c("chunk_id"), c("concept_id"), "PART_OF_CONCEPT", "llm_connection_finder", c("confidence"), told, created_by)


def best_pairs(pairs: DataFrame, limit: int, partition: str | None = None) -> DataFrame:
    """The best pairs, of each value of ``partition`` if given."""
    if partition:
        order = Window.partitionBy(partition).orderBy(F.desc("score"), "source_id", "target_id")
        return pairs.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).drop("__r")
    return pairs.orderBy(F.desc("score"), "source_id", "target_id").limit(limit)


def pass_summary(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, concept_edges: DataFrame) -> DataFrame:
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, d in (("candidates", pairs), ("edges", edges), ("concepts", nodes), ("concept_edges", concept_edges))]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def pass_summaries(chunks: DataFrame, pairs: DataFrame, edges: DataFrame, concept_edges: DataFrame, partition: str) -> DataFrame:
    """(partition, what, n): pass_summary for each value that chunks (id, partition) have, zeros included."""
    of = chunks.select(F.col("id").alias("source_id"), partition)
    linked = concept_edges.join(of, "source_id")
    parts = [("candidates", pairs, F.count("*")), ("edges", edges.join(of, "source_id"), F.count("*")), ("concepts", linked, F.countDistinct("target_id")), ("concept_edges", linked, F.count("*"))]
    counts = None
    for name, d, n in parts:
        part = d.groupBy(partition).agg(n.alias("n")).select(partition, F.lit(name).alias("what"), "n")
        counts = part if counts is None else counts.unionByName(part)
    every = chunks.select(partition).distinct().withColumn("what", F.explode(F.array(*[F.lit(name) for name, _, _ in parts])))
    return every.join(counts, [partition, "what"], "left").select(partition, "what", F.coalesce("n", F.lit(0)).alias("n"))
