"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.plain import words

#: Words of a shard: a task builds one suffix array for so many (a longer text is a shard of its own).
SHARD_WORDS = 3_000_000
#: Words of test passages searched in one pass over the corpus; more passages take further passes.
BLOCK_WORDS = 2_000_000


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with a positive id, ordered by the ``depth`` or more ids from there on (prefix doubling)."""
    n = len(ids)
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    bits = max(1, int(ids.max()).bit_length())
    span = max(1, min(63 // bits, depth))
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(span, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(span):
        key = (key << np.uint64(bits)) | padded[j : j + n]
    order = at[np.argsort(key[at], kind="stable")]
    done = span
    while True:
        sorted_key = key[order]
        rank = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if done >= depth or rank[-1] == len(order):
            return order
        ranks = np.zeros(n + done, np.uint64)
        ranks[order] = rank
        key = (ranks[:n] << np.uint64(32)) | ranks[done : done + n]
        order = order[np.argsort(key[order], kind="stable")]
        done *= 2


def _search(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array whose suffixes start with each row of wanted, by binary search."""
    width = wanted.shape[1]
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)])
    steps = np.arange(width)

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            there = padded[order[mid][:, None] + steps]
            want = wanted[open_]
            differs = there != want
            first = differs.argmax(1)
            row = np.arange(len(open_))
            less = there[row, first] < want[row, first]
            less |= upper & ~differs[row, first]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    return bound(False), bound(True)


def _finder(item_ids: list, item_words: list[list[str]], least: int):
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int32) for ws in item_words]
    flat = np.concatenate([np.append(c, 0) for c in coded]) if coded else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(coded)), [len(c) + 1 for c in coded])
    start_of = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)
    starts = np.concatenate([[0], *(np.arange(max(0, len(c) - least + 1)) + start_of[i] for i, c in enumerate(coded))])[1:].astype(np.int64)

    def shard(docs: list, lengths: list[int], ids: np.ndarray) -> pd.DataFrame:
        order = suffix_array(ids, least)
        low, high = _search(ids, order, flat[starts[:, None] + np.arange(least)])
        count = high - low
        query = np.repeat(np.arange(len(starts)), count)
        place = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        test = starts[query]
        # a match that goes on to the left is part of a longer one
        keep = (test == 0) | (place == 0)
        keep |= flat[test - 1] != ids[place - 1]
        keep |= flat[test - 1] == 0
        place, test = place[keep], test[keep]
        length = np.full(len(place), least, np.int64)
        padded, wanted = np.append(ids, 0), np.append(flat, 0)
        going = np.arange(len(place))
        while going.size:
            a, b = padded[np.minimum(place[going] + length[going], len(ids))], wanted[np.minimum(test[going] + length[going], len(flat))]
            going = going[(a == b) & (a > 0)]
            length[going] += 1
        begins = np.concatenate([[0], np.cumsum(np.asarray(lengths) + 1)])
        doc = np.searchsorted(begins, place, "right") - 1
        who = owner[test]
        return pd.DataFrame(
            {
                "doc_id": np.asarray(docs, object)[doc],
                "item_id": np.asarray(item_ids, object)[who],
                "doc_word": place - begins[doc],
                "item_word": test - start_of[who],
                "n_words": length,
            }
        )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        held = 0
        get = vocabulary.get
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                coded = np.array([get(w, 0) for w in words(text)] + [0], np.int32)
                docs.append(doc)
                lengths.append(len(coded) - 1)
                parts.append(coded)
                held += len(coded)
                if held >= SHARD_WORDS:
                    yield shard(docs, lengths, np.concatenate(parts))
                    docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield shard(docs, lengths, np.concatenate(parts))

    return find


def leaked_passages(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = 10) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): longest runs of at least ``least`` words that a document and a test item share.

    Words are those of the plain form; positions count from 0. Every task turns its share of the corpus
    into shards, builds each shard's suffix array, binary-searches every suffix of every test item in
    it and extends what it finds to the longest verbatim match. The corpus is read once, in place, and
    nothing is shuffled. Test items pass through the driver in blocks of BLOCK_WORDS words (held-out sets
    are small; a larger one takes more passes). Null or shorter texts match nothing; items with the same
    text all match; a repeated document row gives repeated matches. Other columns are not read.
    """
    doc_type, item_type = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, doc_word long, item_word long, n_words long"
    source = documents.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found, keys, texts, held = None, [], [], 0

    def search() -> None:
        nonlocal found, keys, texts, held
        part = source.mapInPandas(_finder(keys, texts, least), schema)
        found = part if found is None else found.unionByName(part)
        keys, texts, held = [], [], 0

    for row in items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).distinct().toLocalIterator():
        tokens = words(row["t"])
        if len(tokens) >= least:
            keys.append(row["k"])
            texts.append(tokens)
            held += len(tokens)
            if held >= BLOCK_WORDS:
                search()
    if keys or found is None:
        search()
    return found


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The documents that hold no passage of a test item."""
    gone = leaks.select(F.col("doc_id").alias(doc_key)).distinct()
    return documents.join(gone, doc_key, "left_anti")
