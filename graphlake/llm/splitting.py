"""Splitting oversized items at natural boundaries by content-defined chunking."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.plain import SPACE
from graphlake.session import cut_lineage

_WORD = re.compile(f"[^{SPACE}]+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’)\]»]*$")
_CLAUSE_END = re.compile(r"[,;:–—、，；][\"'”’)\]»]*$")
_BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)")
#: Odd multiplier of the rolling hash.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolling(words: list[str], window: int) -> np.ndarray:
    """The rolling hash of the words before each inner boundary; entry i is the boundary after word i."""
    code = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        rolled = np.zeros_like(code)
        power = np.uint64(1)
        for back in range(min(window, len(code))):
            rolled[back:] += code[: len(code) - back] * power
            power = power * _BASE
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
    return rolled


def cut_points(text: str, limit: int, overlap: int, least: int, window: int = 8, divisor: int = 48) -> list[tuple[int, int, int, int]]:
    """(first word, end word, first character, end character) of each piece.

    A piece holds at most ``limit`` words, of which all but the first piece repeat the ``overlap`` words
    before. From one cut, the next lies between ``least`` and ``limit - overlap`` words on: at the natural
    boundary (blank line, line end or sentence end) nearest to the first landmark there, of two as near the stronger. As
    landmarks hang on nearby words only, an edit alters the pieces around it and later cuts fall
    into place again. A landmark is a rolling hash divisible by ``divisor``; where the span has none, its smallest hash
    is the landmark. Without such a boundary in the span the nearest clause end serves, without that the landmark itself.
    A word is never cut, however long.
    """
    if overlap >= limit:
        raise ValueError("overlap must be smaller than limit")
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, n, 0, len(text))]
    words = [text[a:b] for a, b in spans]
    grade = np.zeros(n, np.int8)
    for i in range(n - 1):
        gap = text[spans[i][1] : spans[i + 1][0]]
        if _BLANK_LINE.search(gap):
            grade[i] = 3
        elif "\n" in gap or "\r" in gap or _SENTENCE_END.search(words[i]):
            grade[i] = 2
        elif _CLAUSE_END.search(words[i]):
            grade[i] = 1
    rolled = _rolling(words, window)
    pieces, cut = [], 0
    while True:
        begin = max(0, cut - overlap)
        room = limit - (cut - begin)
        if n - cut <= room:
            pieces.append((begin, n, spans[begin][0], len(text)))
            return pieces
        low, high = cut + max(1, min(least, room)), cut + room
        here, near = rolled[low - 1 : high], grade[low - 1 : high]
        marked = np.flatnonzero(here % np.uint64(divisor) == 0)
        target = int(marked[0] if len(marked) else np.argmin(here))
        at = np.flatnonzero(near >= 2) if (near >= 2).any() else np.flatnonzero(near)
        end = target
        if len(at):
            far = np.abs(at - target)
            end = int(at[np.lexsort((at, -near[at], far))[0]])
        end += low - 1
        pieces.append((begin, end + 1, spans[begin][0], spans[end][1]))
        cut = end + 1


def word_count(text):
    """Words of a text column: longest runs of characters that are not Unicode white space."""
    # with (?U) \s is Unicode white space, and told by a table rather than range by range
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def split_oversized(df: DataFrame, text: str = "text", limit: int = 360, overlap: int = 30, least: int = 120) -> DataFrame:
    """The rows of df with ``text`` replaced by its pieces, in columns ``piece, n_pieces, first_word, end_word, piece_text``.

    Texts within the limit stay one piece and never leave the JVM; only oversized texts go through Python, in the same pass.
    A null text gives one piece with null ``piece_text``, an empty one a piece without words. Other
    columns are kept; one named like an output column is replaced. Repeated rows give repeated pieces.
    """
    added = ["piece", "n_pieces", "first_word", "end_word", "piece_text"]
    kept = [c for c in df.columns if c not in added or c == text]
    df = df.select(*kept).withColumn("__n", word_count(F.col(text)))
    others = [c for c in kept if c != text]
    piece = "array<struct<piece:int,n_pieces:int,first_word:int,end_word:int,piece_text:string>>"

    @F.pandas_udf(piece)
    def pieces(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            cuts = cut_points(t, limit, overlap, least)
            return [(i, len(cuts), a, b, t[x:y]) for i, (a, b, x, y) in enumerate(cuts)]

        return texts.map(one)

    large = F.col("__n") > limit
    whole = F.array(F.struct(F.lit(0), F.lit(1), F.lit(0), F.col("__n").cast("int"), F.col(text))).cast(piece)
    # rows are read once; to Python goes a null for a text that stays whole
    cut = df.withColumn("__cut", pieces(F.when(large, F.col(text))))
    return cut.select(*others, F.explode(F.when(large, F.col("__cut")).otherwise(whole)).alias("__p")).select(*others, "__p.*")


def depth_by_parent(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, depth): 1 without parent, else one more than its parent; a parent that is gone counts as none.

    Pointer doubling: after r rounds a row knows its 2^r-th ancestor, so four levels take two
    joins on narrow rows. Rows on a cycle never reach a root; they get a null depth.
    """
    ids = df.select(F.col(key).alias("k"))
    links = df.select(F.col(key).alias("k"), F.col(parent).alias("up"))
    known = links.join(ids.select(F.col("k").alias("up"), F.lit(True).alias("there")), "up", "left")
    state = cut_lineage(known.select("k", F.when(F.col("there"), F.col("up")).alias("up"), F.lit(1).alias("d")))
    # no chain is longer than there are rows: what is open after that many doublings is a cycle
    for _ in range(state.count().bit_length() + 1):
        if not state.where(F.col("up").isNotNull()).limit(1).count():
            break
        above = state.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        state = cut_lineage(state.join(above, "up", "left").select("k", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
    return state.select(F.col("k").alias(key), F.when(F.col("up").isNull(), F.col("d")).alias("depth"))
