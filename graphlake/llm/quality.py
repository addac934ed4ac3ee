"""Per-document text statistics, their outlier scores per language, and what kind of text they tell.

Statistics are shares in [0, 1], kept to three decimals. Exact ranks of each statistic per language come
from range-partitioned counting with partition offsets; a document's outlier scores are the negative
logarithms of its empirical tail probabilities. Weighed on hand labels, the tail scores of all statistics make the
first decision: what they find to be prose beyond doubt is prose. A second model, of statistics and tail scores, tells the kind of the rest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.ranking import group_ranks
from graphlake.session import cut_lineage

#: Most hand labels the models are fitted on (chosen by hash), and most languages told apart and very common words listed (ISO 639-1 has 183 languages).
LABEL_SAMPLE = 20_000
LANGUAGE_LIMIT, WORD_LIMIT = 200, 1_000_000
#: Probability of prose by the tail scores alone from which a text needs no further look.
BEYOND_DOUBT = 0.95
KINDS = ["prose", "list", "table", "junk"]

STATS = [
    "common", "length", "word_length", "symbols", "digits", "letters", "upper", "punctuated_lines", "line_words", "bullets", "leaders",
    "index_entries", "bare_lines", "row_entries", "tabular", "cells", "aligned", "tags", "single_letters", "no_vowel", "mixed_case", "foreign_letters", "broken_chars",
    "distinct_words", "distinct_lines", "packed", "sentence_words", "short_sentences", "alike_lines", "vowels", "long_words", "word_like", "rows",
]
#: Statistics whose tail scores the second model sees beside the statistics themselves.
SECOND = ["common", "word_length", "symbols", "digits", "punctuated_lines", "line_words", "distinct_words", "sentence_words", "packed", "vowels"]

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_BULLET = re.compile(r"\s*(?:[-*•–—·‣◦+>~]\s|\[[ xX]?\]|\(?\d{1,3}[.):]\s|\(?[a-zA-Z][.)]\s|\(?[ivxIVX]{1,5}[.)]\s|\d+\s?[x×]\s|#\d+)")
_PAGE = re.compile(r"\d+(?:[-–]\d+)?[,;]?")
_TAG = re.compile(r"</?(?:table|tr|td|th|tbody|thead|li|ul|ol|dl|dd|dt)\b[^<>]*>", re.I)
_GAP = re.compile(r"\S(?: {2,}|\t+ *)(?=\S)")
_SENTENCE = re.compile(r"(?<![.!?…:])[.!?…:]++[\"'”’)\]»]*+(?:\s+|$)")
_ENDS = frozenset(".!?…:;,\"”’'»)—-")
_LINE = re.compile(r"\r\n|\r|\n")
_PART = re.compile(r"[;,\n]")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUN = re.compile(r"a(?:[ '’-]a)+")
_VOWELS = frozenset("aeiouyäöüàâéèêëîïôûùœæ")


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


#: Classes of characters; letters may be upper case.
_OTHER, _SPACE, _DIGIT, _BROKEN, _TIMES, _LETTER, _VOWEL, _FOREIGN, _UPPER = 0, 1, 2, 3, 4, 5, 6, 7, 8


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each character of the basic plane; the last entry stands for all others."""
    out = np.zeros(65_537, np.uint8)
    for code in range(65_536):
        ch = chr(code)
        if ch.isalpha():
            small = ch.lower()
            c = _VOWEL if small in _VOWELS else _FOREIGN if code > 127 and small not in ("ß", "ç", "ñ") else _LETTER
            out[code] = c + (_UPPER if small != ch else 0)
        elif ch.isspace():
            out[code] = _SPACE
        elif ch.isdigit():
            out[code] = _DIGIT
        elif ch in "÷×":
            out[code] = _TIMES
        elif ch == "\ufffd" or code < 32:
            out[code] = _BROKEN
    return out


def _led(line: str) -> bool:
    """Whether a line ends in a number led up to by dots or a wide gap, as in a table of contents."""
    words = line.rstrip("0123456789ivxlc")
    head = words.rstrip()
    if len(words) == len(line):
        return False
    dots = head[len(head.rstrip(". \t")) :]
    return head.endswith(".") and dots.count(".") >= 3 or len(words) - len(head) >= 3 and line[len(words) :].isdigit()


def _indexed(line: str) -> bool:
    """Whether a line is a short entry without marks inside, then page numbers."""
    tokens = line.split()
    end = len(tokens)
    while end and _PAGE.fullmatch(tokens[end - 1]):
        end -= 1
    head = " ".join(tokens[:end])
    head = head[:-1] if head.endswith((",", ";", ":")) else head
    return end < len(tokens) and 0 < len(head) <= 60 and not any(c in head for c in ",;:.")


@lru_cache(maxsize=200_000)
def _told(word: str) -> tuple[bool, bool, bool]:
    """Of a lower-case word: letters only; then, has no vowel; looks like a word."""
    if not word.isalpha():
        return False, False, False
    n = len(word)
    v = sum(c in _VOWELS for c in word)
    return True, n > 1 and not v, 3 <= n <= 18 and 0.2 <= v / n <= 0.75


def statistics(text: str | None, common: dict[str, str]) -> tuple[str, list[float]]:
    """(language, statistics in the order of STATS); common maps very common words to their language(s).

    The language is the one with most common words, 'und' if there is none. A null or empty text has all statistics 0.
    """
    if not text or not text.strip():
        return "und", [0.0] * len(STATS)
    words = _WORD.findall(text)
    n = len(words)
    folded = [w.lower() for w in words]
    counts = Counter(folded)
    by_language: Counter[str] = Counter()
    hits = a = no_vowel = word_like = single = long_words = solid = 0
    for w, c in counts.items():
        if (l := common.get(w)) is not None:
            hits += c
            for x in l.split(","):
                by_language[x] += c
        k = len(w)
        solid += k * c
        single += c * (k == 1)
        long_words += c * (k > 18)
        alpha, bare_of_vowels, like = _told(w)
        a += c * alpha
        no_vowel += c * bare_of_vowels
        word_like += c * like
    language = min(by_language, key=lambda k: (-by_language[k], k)) if by_language else "und"
    size = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    of_class = np.bincount(_classes()[np.minimum(codes, 65_536)], minlength=16).tolist()
    spaces, digits, broken = of_class[_SPACE], of_class[_DIGIT], of_class[_BROKEN]
    foreign = of_class[_FOREIGN] + of_class[_FOREIGN + _UPPER] + of_class[_TIMES]
    vowels = of_class[_VOWEL] + of_class[_VOWEL + _UPPER]
    upper = sum(of_class[c + _UPPER] for c in (_LETTER, _VOWEL, _FOREIGN))
    letters = vowels + upper - of_class[_VOWEL + _UPPER] + of_class[_LETTER] + of_class[_FOREIGN]
    ink = size - spaces
    lines = [x for x in _LINE.split(text) if x and not x.isspace()]
    forms = [x for x in _LINE.split(_RUN.sub("a", _DIGITS.sub("9", _LETTERS.sub("a", text)))) if x and not x.isspace()]
    m = len(lines)
    whole = bullets = leaders = index = bare = tabular = cells = aligned = rows = punctuated = previous = 0
    shapes: Counter[str] = Counter()
    for x, form in zip(lines, forms, strict=True):
        s = x.strip()
        k = len(s)
        whole += k
        last = s[-1]
        punctuated += last in _ENDS
        tokens = s.split(None, 7)
        few = len(tokens) <= 7
        if _BULLET.match(x):
            bullets += k
        if last in "0123456789ivxlc,":
            if _led(s):
                leaders += k
            if _indexed(s):
                index += k
        if few and len(tokens) <= 6 and last not in ".!?…:":
            bare += k
        fields = s.count("|")
        if fields >= 2:
            cells += k
        else:
            fields = 0
        if "  " in s or "\t" in s:
            gaps = len(_GAP.findall(s))
            if gaps:
                aligned += k
                fields = max(fields, gaps)
        for mark in ";,\t":
            if (c := s.count(mark)) >= 2 and len(s.split()) <= 1.7 * (c + 1):
                rows += k
                fields = max(fields, c + 1)
                break
        if fields >= 2 and fields == previous or "<" in s and _TAG.search(s):
            tabular += k
        previous = fields
        shapes[form.strip()] += k
    entry = every = 0
    for p in _PART.split(text.lower()):
        if p and not p.isspace():
            every += len(p)
            w = p.split(None, 4)
            if len(w) <= 4 and not any(x in common for x in w):
                entry += len(p)
    sentence_words = [k for s in _SENTENCE.split(text) if (k := len(s.split()))]
    cased = [w for w, f in zip(words, folded, strict=True) if w != f]
    mixed = sum(len(w) > 1 and w[1:] != w[1:].lower() and not w.isupper() for w in cased)
    tags = sum(map(len, _TAG.findall(text))) if "<" in text else 0
    raw = text.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    said = len(folded)
    values = [
        _share(hits, said), min(1.0, log1p(n) / 10), _share(solid, said) / 15, _share(ink - letters - digits, ink), _share(digits, ink), _share(letters, ink), _share(upper, letters), _share(punctuated, m), min(1.0, _share(n, m) / 40), _share(bullets, whole), _share(leaders, whole),
        _share(index, whole), _share(bare, whole), _share(entry, every), _share(tabular, whole), _share(cells, whole), _share(aligned, whole), _share(tags, size), _share(single, said), _share(no_vowel, a), _share(mixed, n), _share(foreign, ink), _share(broken, size),
        _share(len(counts), said), _share(len(set(lines)), m), min(1.0, packed), min(1.0, _share(n, len(sentence_words)) / 60), _share(sum(k for k in sentence_words if k <= 4), sum(sentence_words)), _share(max(shapes.values(), default=0), whole), _share(vowels, letters), _share(long_words, said), _share(word_like, a),
        _share(rows, whole),
    ]
    return language, [round(min(1.0, max(0.0, v)), 3) for v in values]


def text_statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, one column per statistic) of every row; other columns are not read.

    common_words is a short list of the very common words of some languages; lists of more than LANGUAGE_LIMIT languages are refused.
    """
    found = common_words.select("lang", F.lower("word").alias("word")).where("lang is not null and word is not null").distinct().limit(WORD_LIMIT + 1).collect()
    common: dict[str, str] = {}
    for row in sorted(found):
        common[row["word"]] = f"{common[row['word']]},{row['lang']}" if row["word"] in common else row["lang"]
    if len(found) > WORD_LIMIT or len({r["lang"] for r in found}) > LANGUAGE_LIMIT:
        raise ValueError("common_words must be a short list")
    kind = documents.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [statistics(t, common) for t in batch["text"]]
            table = pd.DataFrame([v for _, v in told], columns=STATS, dtype=float)
            table.insert(0, "language", [l for l, _ in told])
            table.insert(0, "key", batch["key"].to_numpy())
            yield table

    schema = f"key {kind}, language string, " + ", ".join(f"{s} double" for s in STATS)
    return documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(scan, schema).withColumnRenamed("key", key)


def tail_tables(stats: DataFrame) -> dict[str, np.ndarray]:
    """Per language an array [statistic, value * 1000, (left, right)] of -ln of the tail probabilities P(X <= x), P(X >= x).

    The table that reaches the driver has at most LANGUAGE_LIMIT + 1 languages, len(STATS) statistics and 1001 values, whatever the corpus.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for language, part in b.groupby("language"):
                code = np.rint(part[STATS].to_numpy(float) * 1000).astype(np.int64) + 1001 * np.arange(len(STATS))
                total = held.setdefault(language, np.zeros(1001 * len(STATS), np.int64))
                total += np.bincount(code.ravel(), minlength=len(total))
        for language, total in held.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"language": language, "stat": at // 1001, "value": at % 1001, "c": total[at]})

    counts = stats.select("language", *STATS).mapInPandas(count, "language string, stat int, value int, c long")
    tables: dict[str, np.ndarray] = {}
    for r in group_ranks(counts, ["language", "stat"], "value", "c").collect():
        t = tables.setdefault(r["language"], np.zeros((len(STATS), 1001, 2), np.float32))
        total = r["n_total"]
        t[r["stat"], r["value"]] = -np.log((r["n_below"] + r["n_equal"]) / total), -np.log((total - r["n_below"]) / total)
    return tables


def outlier_scores(values: np.ndarray, language: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
    """Columns left, right of each statistic in turn, then their sums and the sum of the larger ones."""
    code = np.rint(values * 1000).astype(int)
    out = np.zeros((len(values), 2 * len(STATS) + 3))
    for l in pd.unique(language):
        rows = np.flatnonzero(language == l)
        if l in tables:
            t = tables[l][np.arange(len(STATS)), code[rows]].astype(float)
            out[rows, : 2 * len(STATS)] = t.reshape(len(rows), -1)
            out[rows, -3:] = np.stack([t[..., 0].sum(1), t[..., 1].sum(1), t.max(2).sum(1)], 1)
    return out


def _first_features(values: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(scores, 0))


_SECOND_AT = [2 * STATS.index(s) + side for s in SECOND for side in (0, 1)]


def _second_features(values: np.ndarray, scores: np.ndarray) -> np.ndarray:
    # hinges let a share count from a threshold on
    tails = scores[:, _SECOND_AT]
    left, right = tails[:, 0::2], tails[:, 1::2]
    told = np.concatenate([tails, np.stack([left.sum(1), right.sum(1), np.maximum(left, right).sum(1)], 1)], 1)
    return np.concatenate([values, np.maximum(0, values - 0.15), np.maximum(0, values - 0.4), np.minimum(values, 0.05) * 10, np.sqrt(np.maximum(told, 0))], 1)


class Kinds:
    """Kinds of texts: prose where the tail scores alone leave no doubt, else what the second model finds."""

    def __init__(self, values: np.ndarray, scores: np.ndarray, y: np.ndarray):
        self.first, self.second = Model(_first_features(values, scores), y), Model(_second_features(values, scores), y)

    def probabilities(self, values: np.ndarray, scores: np.ndarray) -> np.ndarray:
        p = self.first.probabilities(_first_features(values, scores))
        open_ = np.flatnonzero(p[:, 0] < BEYOND_DOUBT)
        if len(open_):
            p[open_] = self.second.probabilities(_second_features(values[open_], scores[open_]))
        return p


class Model:
    """Softmax regression, fitted anew without labels that the fit before found absurd."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 250, penalty: float = 2.0):
        keep = np.ones(len(y), bool)
        for _ in range(3):
            self._fit(x[keep], y[keep], rounds, penalty)
            p = self.probabilities(x)
            sure = (p.max(1) > 0.7) & (p[np.arange(len(y)), y] < 0.15)
            keep = ~sure if (~sure).sum() >= 20 else keep

    def _fit(self, x, y, rounds, penalty):
        self.mean, self.sd = x.mean(0), x.std(0) + 0.02
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        z = np.concatenate([z, np.ones((len(z), 1))], 1).astype(np.float32)
        goal = np.eye(len(KINDS), dtype=np.float32)[y]
        w = v = np.zeros((z.shape[1], len(KINDS)), np.float32)
        rate = np.float32(2.0 / (np.linalg.eigvalsh(z.T @ z)[-1] / 2 + penalty))
        t = 1.0
        for _ in range(rounds):
            p = z @ v
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grad = z.T @ (p - goal) + penalty * v
            new = v - rate * grad
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v = new + np.float32((t - 1) / t2) * (new - w)
            w, t = new, t2
        self.w = w

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        s = np.concatenate([z, np.ones((len(z), 1))], 1) @ self.w
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def text_kinds(documents: DataFrame, common_words: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, kind, sureness, outlier, statistics...) of every document.

    labels has the key and ``label`` (prose, list, table, junk in any case; others are ignored) for a sample of documents; at most LABEL_SAMPLE
    of them, chosen by hash, are read by the driver to fit the models. ``outlier`` sums the larger tail scores. Texts are read once.
    """
    stats = cut_lineage(text_statistics(documents, common_words, key, text))
    tables = tail_tables(stats)
    told = labels.select(F.col(key), F.lower(F.trim("label")).alias("label")).where(F.col("label").isin(KINDS)).distinct()
    chosen = told.orderBy(F.xxhash64(key, "label")).limit(LABEL_SAMPLE)
    sample = stats.join(chosen, key).orderBy(key, "label").toPandas()
    x = sample[STATS].to_numpy(float)
    model = Kinds(x, outlier_scores(x, sample["language"].to_numpy(), tables), sample["label"].map(KINDS.index).to_numpy(int)) if len(x) else None
    names = ["kind", "sureness", "outlier"]

    @F.pandas_udf("struct<kind:string,sureness:double,outlier:double>")
    def judge(language: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        values = np.stack([c.to_numpy(float) for c in columns], 1)
        scores = outlier_scores(values, language.to_numpy(), tables)
        if model is None:  # without labels all is taken for prose
            return pd.DataFrame({"kind": "prose", "sureness": 0.0, "outlier": scores[:, -1]})
        p = model.probabilities(values, scores)
        return pd.DataFrame({"kind": np.array(KINDS)[p.argmax(1)], "sureness": p.max(1), "outlier": scores[:, -1]})

    judged = stats.withColumn("__j", judge("language", *STATS))
    return judged.select(key, "language", *[F.col("__j")[c].alias(c) for c in names], *STATS)
